"""Vector retrieval. Only the best k rows per query leave a task; no row per (query, chunk) pair exists.

``dense_topk`` has two exact ways. A query table of checked size is broadcast as one matrix and the chunks
are scanned where they lie. Beyond that size both sides are cut into a grid of bounded cells, each cell one
matrix product, so neither side has to fit anywhere as a whole; with ``key`` the grid is built per key value
and a key that owns a large share of the rows is cut into as many cells as its size asks for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.sizing import join_skewed
from lectern.functions.vectors import as_double, matrix, unit_rows
from lectern.operators.best import SCORE_DIGITS, Best
from lectern.operators.keyword import rank_by_query

QUERY_ROWS = 8192  # broadcast bound: 64 MB of doubles at 1024 dimensions
CELL_ROWS = 20_000  # rows per side of a grid cell
PRODUCT_SIZE = 4_000_000  # entries of one score block
BLOCK_QUERIES = 2048  # queries of a score block
SINGLE = 2.0**-23  # relative step of single precision
EXACT_VALUES = 1 << 23  # numbers of vectors that are worked out at once
STEP = 1.1 * 10.0**-SCORE_DIGITS  # scores further apart stay in their order when they are rounded


def _cut(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
    return frame[frame.groupby("query_id", sort=False).cumcount() < k]


def _search(q_ids, q, ids, v, k: int, skip_same: bool) -> pd.DataFrame:
    """Best k items of each query by (score desc, id asc); holds one score block and the kept rows.

    ``skip_same`` leaves the item with the query's id out of the best k + 1.
    """
    order = pd.Series(ids).sort_values(kind="stable").index.to_numpy()
    ids, v = ids[order], v[order]
    wanted, found = k + 1 if skip_same else k, []
    # Single precision picks the rows that are worked out, with room for its error.
    narrow_q, narrow_v, room = q.astype(np.float32), v.astype(np.float32), SINGLE * (v.shape[1] + 8)
    piece = max(1, EXACT_VALUES // max(1, v.shape[1]))
    finite = bool(np.isfinite(narrow_q).all() and np.isfinite(narrow_v).all())
    for first in range(0, len(q_ids), BLOCK_QUERIES):
        block = narrow_q[first : first + BLOCK_QUERIES]
        best = Best(len(block), wanted)
        step = max(1, PRODUCT_SIZE // len(block))
        for lo in range(0, len(ids), step):
            scores = block @ narrow_v[lo : lo + step].T
            least = best.floor() - room
            # Few pass once the first items are in; of those, none that stays behind the best by more than all errors.
            if lo == 0 and finite and scores.shape[1] > wanted:
                least = np.partition(scores, -wanted, axis=1)[:, -wanted].astype(float) - 3 * room - STEP
            row, at = np.divmod(np.flatnonzero(scores > least.astype(np.float32)[:, None]), scores.shape[1])
            at += lo
            # In pieces: where many vectors are alike, all pairs of a block pass.
            for n in range(0, len(row), piece):
                r, a = row[n : n + piece], at[n : n + piece]
                best.offer(r, a, np.round(np.einsum("ij,ij->i", q[r + first], v[a]), SCORE_DIGITS) + 0.0)
        row, at, value = best.found()
        found.append(pd.DataFrame({"query_id": q_ids[row + first], "chunk_id": ids[at], "score": value}))
    # Rows of a repeated query id share its places.
    kept = _cut(pd.concat(found, ignore_index=True), wanted)
    return _cut(kept[kept["query_id"] != kept["chunk_id"]], k) if skip_same else kept


def _result_schema(queries: DataFrame, items: DataFrame, key: str | None) -> T.StructType:
    fields = [
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", items.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    return T.StructType(fields + ([T.StructField(key, queries.schema[key].dataType)] if key else []))


def _by_broadcast(queries: DataFrame, pulled: pd.DataFrame, items: DataFrame, k: int, key: str | None, skip_same: bool) -> DataFrame:
    schema = _result_schema(queries, items, key)
    if len(pulled) == 0:
        return queries.sparkSession.createDataFrame([], schema)
    groups = {None: pulled} if key is None else dict(list(pulled.groupby(key)))
    sides = {g: (p["query_id"].to_numpy(), unit_rows(matrix(p["vector"]))) for g, p in groups.items()}
    shared = queries.sparkSession.sparkContext.broadcast(sides)

    def scan(batches):
        kept: dict = {}
        for pdf in batches:
            if key is not None:
                pdf = pdf[pdf[key].isin(shared.value.keys())]
            parts = {None: pdf} if key is None else dict(list(pdf.groupby(key)))
            for g, part in parts.items():
                if g not in shared.value or len(part) == 0:
                    continue
                q_ids, q = shared.value[g]
                hits = _search(q_ids, q, part["chunk_id"].to_numpy(), unit_rows(matrix(part["vector"])), k, skip_same)
                kept[g] = _cut(pd.concat([kept[g], hits], ignore_index=True), k) if g in kept else hits
        for g, hits in kept.items():
            yield hits if key is None else hits.assign(**{key: g})

    cols = ["chunk_id", "vector"] + ([key] if key else [])
    return items.select(*cols).mapInPandas(scan, schema)


def _by_grid(
    queries: DataFrame, items: DataFrame, k: int, key: str | None, skip_same: bool, cell_rows: int
) -> DataFrame:
    schema = _result_schema(queries, items, key)
    key_col = F.col(key) if key else F.lit(0)
    q = queries.select("query_id", "vector", key_col.alias("_k"))
    v = items.select("chunk_id", "vector", key_col.alias("_k"))
    n_q = q.groupBy("_k").agg(F.count("*").alias("_nq"))
    n_v = v.groupBy("_k").agg(F.count("*").alias("_nv"))
    grid = n_q.join(n_v, "_k").select(
        "_k",
        "_nq",
        "_nv",
        F.ceil(F.col("_nq") / cell_rows).cast("int").alias("_gq"),
        F.ceil(F.col("_nv") / cell_rows).cast("int").alias("_gv"),
    )
    q = join_skewed(q, grid, "_k", "_nq", F.col("query_id"))
    v = join_skewed(v, grid, "_k", "_nv", F.col("chunk_id"))
    # Fresh column ids on both sides: queries and items may come from one table.
    q = q.select(
        F.col("_k").alias("_k"),
        F.pmod(F.xxhash64("query_id"), F.col("_gq")).cast("int").alias("_cq"),
        F.explode(F.sequence(F.lit(0), F.col("_gv") - 1)).alias("_cv"),
        F.col("query_id").alias("query_id"),
        F.col("vector").alias("vector"),
    )
    v = v.select(
        F.col("_k").alias("_k"),
        F.explode(F.sequence(F.lit(0), F.col("_gq") - 1)).alias("_cq"),
        F.pmod(F.xxhash64("chunk_id"), F.col("_gv")).cast("int").alias("_cv"),
        F.col("chunk_id").alias("chunk_id"),
        F.col("vector").alias("vector"),
    )

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            none = {"query_id": left["query_id"].head(0), "chunk_id": right["chunk_id"].head(0), "score": np.array([], dtype=float)}
            return pd.DataFrame({**none, key: left["_k"].head(0)} if key else none)
        found = _search(
            left["query_id"].to_numpy(),
            unit_rows(matrix(left["vector"])),
            right["chunk_id"].to_numpy(),
            unit_rows(matrix(right["vector"])),
            k,
            skip_same,
        )
        return found.assign(**{key: left["_k"].iloc[0]}) if key else found

    on = ["_k", "_cq", "_cv"]
    return q.groupBy(*on).cogroup(v.groupBy(*on)).applyInPandas(cell, schema)


def dense_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int = 10,
    key: str | None = None,
    skip_same: bool = False,
    per_key: bool = False,
    query_rows: int = QUERY_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Cosine top k: (query_id, chunk_id, score, rank), with ``key`` also that column.

    ``queries`` has (query_id, vector), ``items`` (chunk_id, vector); with ``key`` both carry that column and
    a query only searches items of its key value, ``per_key`` ranks a query's key values apart.
    ``skip_same`` leaves out the item with the query's own id.
    """
    q = queries.where(F.col("vector").isNotNull())
    v = items.where(F.col("vector").isNotNull())
    wanted = q.select("query_id", "vector", *([key] if key else []))
    pulled = wanted.limit(query_rows + 1).toPandas()  # never more than one row above the bound
    if len(pulled) <= query_rows:
        local = _by_broadcast(q, pulled, v, k, key, skip_same)
    else:
        local = _by_grid(q, v, k, key, skip_same, cell_rows)
    return rank_by_query(local, k, [key] if per_key and key else [])


def fit_cells(items: DataFrame, n_cells: int, seed: int = 42) -> KMeansModel:
    """Cluster the vectors into cells for ``dense_topk_cells``."""
    prepared = items.select(array_to_vector(as_double(F.col("vector"))).alias("features"))
    return KMeans(k=n_cells, seed=seed, maxIter=10).fit(prepared)


def nearest_cells(df: DataFrame, model: KMeansModel, n: int) -> DataFrame:
    """Add ``cell``: the ids of the n nearest centres, one row each."""
    centres = np.asarray(model.clusterCenters())

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        m = matrix(vectors)
        distance = (centres**2).sum(axis=1)[None, :] - 2.0 * m @ centres.T
        return pd.Series(list(np.argsort(distance, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return df.withColumn("cell", F.explode(nearest(as_double(F.col("vector")))))


def dense_topk_cells(
    queries: DataFrame, items: DataFrame, k: int = 10, n_cells: int = 16, n_probe: int = 4, seed: int = 42,
    skip_same: bool = False, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Top k among the items of each query's ``n_probe`` nearest cells; equals ``dense_topk`` at n_probe = n_cells."""
    model = fit_cells(items, n_cells, seed)
    placed = nearest_cells(items.select("chunk_id", "vector"), model, 1)
    probes = nearest_cells(queries.select("query_id", "vector"), model, n_probe)
    return rank_by_query(_by_grid(probes, placed, k, "cell", skip_same, cell_rows), k).drop("cell")
