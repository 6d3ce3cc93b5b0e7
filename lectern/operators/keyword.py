"""Keyword index and BM25 retrieval for a whole table of queries.

The index holds, per term, blocks of postings in the order of their impact (what a posting adds to a score, before the term's weight). It is
partitioned by term bucket, so that queries read the buckets of their terms only, and blocks carry their highest impact, so that a block is
left out where no query could gain a place in its top k from it. Terms with many postings are cut into shards by chunk, each in its own order.

Retrieval keeps matched postings of one chunk in one task (hash partitioned by ``chunk_id``, in its order) and adds up the weights of the
broadcast query terms there, some chunks at a time, so a (query, chunk) score is finished where it is computed and each task holds and sends on
at most k rows per query. The pairs that share a term are neither shuffled nor kept, however common the term is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from lectern.functions import text as T
from lectern.functions.sizing import BROADCAST_ROWS, broadcast_if_small, by_slices, dealt, fits, join_null_safe
from lectern.operators.best import SCORE_DIGITS, Best
from lectern.session import staged

# The published BM25 constants of the keyword search server.
K1 = 1.2
B = 0.75

BLOCK_POSTINGS = 128  # postings of a block
SHARD_POSTINGS = 16_384  # postings of a shard of a term, about
BUCKET_POSTINGS = 4_000_000  # postings of a bucket
BUCKETS = (32, 4096)  # fewest and most buckets
FILE_POSTINGS = 1_000_000  # postings of a file of a bucket, and of the task that writes it, about
PIECE_SHARDS = 16  # shards of a term that go to one task
CODEC = "zstd"  # of stored tables of about the size of the texts
#: A lower bound of a query's k-th score is known for k up to these ranks.
RANKS = (10, 100)
#: Scores are rounded; bounds leave room for that.
MARGIN = 1e-5
PAIRS = 2_000_000  # (query, chunk) pairs that a task scores at once


@dataclass
class KeywordIndex:
    """Posting blocks, term and corpus statistics; ``by`` names the columns that separate indexes."""

    blocks: DataFrame  # *by, bucket, term, shard, max_impact, n, chunk_ids, tfs, dls
    terms: DataFrame  # *by, bucket, term, df, top_1, top_10, top_100
    stats: DataFrame  # *by, n_chunks, avg_dl, n_postings
    by: tuple[str, ...] = ()
    n_buckets: int = BUCKETS[0]

    @property
    def postings(self) -> DataFrame:
        return unpacked(self.blocks, self.by)


def unpacked(blocks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (*by, chunk_id, term, tf, dl) per posting of the blocks."""
    zipped = F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))
    return blocks.select(*by, "term", F.explode(zipped).alias("_p")).select(*by, F.col("_p.chunk_id").alias("chunk_id"), "term", F.col("_p.tf").alias("tf"), F.col("_p.dl").alias("dl"))


def _counted(words: Column) -> Column:
    """(term, tf) of each distinct word of a sorted array."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))
        # Through a one-element array, so that the starts are found once.
        return F.transform(
            F.array(starts),
            lambda s: F.transform(
                s, lambda at, j: F.struct(F.element_at(t, at).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(t) + 1) - at).cast("long").alias("tf"))
            ),
        )[0]

    return F.transform(F.array(words), lambda t: F.when(F.size(t) > 0, F.struct(F.size(t).alias("dl"), runs(t).alias("terms"))))[0]


def counted(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per chunk with its length and the count of each of its terms."""
    return chunks.select(*by, "chunk_id", _counted(F.sort_array(T.tokens(F.col("text")))).alias("_c"))


def postings(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per chunk and term with the term's count and the chunk's length; counted in the row, nothing is shuffled."""
    return exploded(counted(chunks, by), by)


def exploded(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The postings of counted chunks."""
    # explode_outer keeps the optimizer from running the tokenizer again as a pushed filter.
    rows = counts.select(*by, "chunk_id", F.col("_c.dl").alias("dl"), F.explode_outer("_c.terms").alias("_t"))
    return rows.where(F.col("_t").isNotNull()).select(*by, "chunk_id", F.col("_t.term").alias("term"), "dl", F.col("_t.tf").alias("tf"))


def term_stats(posted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """In how many chunks each term occurs."""
    return posted.groupBy(*by, "term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of chunks that have words, their mean length, and how many postings they give."""
    return stats_of(counted(chunks, by), by)


def stats_of(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same of counted chunks."""
    sized = counts.select(*by, F.col("_c.dl").alias("dl"), F.size("_c.terms").cast("long").alias("n")).where(F.col("dl") > 0)
    return sized.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.avg("dl").alias("avg_dl"), F.sum("n").alias("n_postings"))


def impact(k1: float = K1, b: float = B) -> Column:
    """What a posting adds to a score for a term of weight one."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))


def _packed() -> Column:
    """Count and length as one number: both come from sizes of arrays, below 2^31."""
    return F.shiftleft("tf", 32) + F.col("dl")


def _unpacked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tf", F.shiftright("_n", 32)).withColumn("dl", F.col("_n").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).drop("_n")


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(n_buckets)).cast("int")


def posting_blocks(posted: DataFrame, stats: DataFrame, by: Sequence[str], n_buckets: int, files: int = 1) -> DataFrame:
    """Blocks of postings, highest impacts first within each shard of a term; one exchange, with a task for each file of a bucket.

    A term of more than ``PIECE_SHARDS`` shards is dealt over all tasks, so many of them together, so that no task gets more of it the more chunks there are.
    """
    by = list(by)
    sized = posted.withColumn("_shards", F.lit(1))
    if stats.where(F.col("n_chunks") > SHARD_POSTINGS).limit(1).count():
        hot = term_stats(posted, by).where(F.col("df") > SHARD_POSTINGS).select(*by, "term", F.ceil(F.col("df") / SHARD_POSTINGS).alias("_shards"))
        # At most one term in SHARD_POSTINGS postings is hot.
        sized = join_null_safe(posted, broadcast_if_small(staged(hot, "hot-terms")), [*by, "term"], "left")
    means = stats.select(*by, "avg_dl")
    shard = F.pmod(F.xxhash64("chunk_id"), F.coalesce("_shards", F.lit(1))).cast("int")
    # A posting's row is moved with few columns; the bucket and the impact follow from what is moved.
    rows = sized.select(*by, "term", shard.alias("shard"), "chunk_id", _packed().alias("_n"), "_shards")
    file = _bucket(n_buckets) * files + F.pmod(F.xxhash64(*by, "term"), F.lit(files))
    piece = F.pmod(F.xxhash64(*by, "term", F.floor(F.col("shard") / PIECE_SHARDS)), F.lit(n_buckets * files))
    rows = rows.withColumn("_task", F.when(F.col("_shards") > PIECE_SHARDS, piece).otherwise(file).cast("int")).drop("_shards")
    # By number, not by its hash, which would lead several files to one task.
    placed = _unpacked(rows.repartitionById(n_buckets * files, "_task"))
    placed = join_null_safe(placed, broadcast_if_small(means), by) if by else placed.withColumn("avg_dl", means.scalar())
    placed = placed.withColumn("impact", impact()).withColumn("bucket", _bucket(n_buckets))
    run = F.sort_array(F.collect_list(F.struct("impact", "chunk_id", "tf", "dl")), asc=False)
    runs = placed.groupBy(*by, "bucket", "_task", "term", "shard").agg(run.alias("_run"))
    slices = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_run") - 1) / BLOCK_POSTINGS).cast("int")), lambda i: F.slice("_run", i * BLOCK_POSTINGS + 1, F.lit(BLOCK_POSTINGS))
    )
    at_rank = {f"top_{r}": F.get("_run", F.lit(r - 1))["impact"] for r in RANKS}
    cut = runs.select(*by, "bucket", "term", "shard", *[c.alias(n) for n, c in at_rank.items()], F.explode(slices).alias("_b"))
    return cut.select(
        *by, "bucket", "term", "shard", F.col("_b")[0]["impact"].alias("max_impact"), *at_rank, F.size("_b").cast("long").alias("n"),
        F.col("_b.chunk_id").alias("chunk_ids"), F.col("_b.tf").alias("tfs"), F.col("_b.dl").alias("dls"),
    )


def term_table(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per term its chunks, its highest impact, and an impact that at least so many postings reach."""
    tops = [F.max("max_impact").alias("top_1"), *[F.max(f"top_{r}").alias(f"top_{r}") for r in RANKS]]
    return blocks.groupBy(*by, "bucket", "term").agg(F.sum("n").alias("df"), *tops)


def index_of(chunks: DataFrame, by: Sequence[str] = ()) -> KeywordIndex:
    """An index whose tables are recomputed wherever they are used; see ``write_index`` for the stored form."""
    counts = counted(chunks, by)
    stats = stats_of(counts, by)
    blocks = posting_blocks(exploded(counts, by), stats, by, BUCKETS[0])
    return KeywordIndex(blocks, term_table(blocks, by), stats, tuple(by))


def write_index(chunks: DataFrame, path: str, by: Sequence[str] = ()) -> KeywordIndex:
    """Store blocks and terms by bucket, and the corpus statistics, below ``path``."""
    spark, by = chunks.sparkSession, list(by)
    # One row per chunk, read for the statistics, the frequent terms and the blocks: texts are cut into words once.
    counts = staged(counted(chunks, by), "counted", CODEC)
    stats_of(counts, by).write.mode("overwrite").parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    n = _n_postings(stats)
    n_buckets = _n_buckets(n)
    blocks = posting_blocks(exploded(counts, by), stats, by, n_buckets, max(1, -(-n // (n_buckets * FILE_POSTINGS))))
    ordered = blocks.sortWithinPartitions("bucket", *by, "term", "shard", F.desc("max_impact"))
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks", compression=CODEC)
    stored = spark.read.parquet(f"{path}/blocks")
    terms = term_table(dealt(stored, n, "bucket"), by)
    terms.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    return read_index(spark, path, by)


def read_index(spark: SparkSession, path: str, by: Sequence[str] = ()) -> KeywordIndex:
    blocks, terms, stats = [spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "stats")]
    return KeywordIndex(blocks, terms, stats, tuple(by), _n_buckets(_n_postings(stats)))


def _n_postings(stats: DataFrame) -> int:
    return stats.agg(F.sum("n_postings")).first()[0] or 0


def _n_buckets(n_postings: int) -> int:
    return min(max(BUCKETS[0], -(-n_postings // BUCKET_POSTINGS)), BUCKETS[1])


def query_terms(queries: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Distinct terms per query with their count in the query."""
    exploded = queries.select("query_id", *keep, F.explode_outer(T.tokens(F.col("text"))).alias("term"))
    return exploded.where(F.col("term").isNotNull()).groupBy("query_id", *keep, "term").agg(F.count("*").alias("qtf"))


def rank_by_query(scored: DataFrame, k: int, within: Sequence[str] = (), order: Sequence[Column] | None = None) -> DataFrame:
    """Rank per query (and ``within``) and keep the first k; cut in each task before the shuffle."""
    order = order or [F.desc("score"), F.asc("chunk_id")]
    w = Window.partitionBy("query_id", *within).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def score_by_terms(
    matched: DataFrame, weights: DataFrame, on: Sequence[str], value: Sequence[Column], finish=lambda df: df, stored: bool = False
) -> DataFrame:
    """Aggregate per (query, chunk) over shared terms without shuffling the pairs.

    ``matched`` rows are hash partitioned by chunk, ``weights`` (query_id, term, ...) is broadcast in slices
    of bounded size; ``finish`` ranks one slice. ``stored`` weights are not written again.
    """
    placed = matched.repartition("chunk_id")
    # Small, but costly to derive: stored once, then counted, sliced and broadcast from there.
    weights = weights if stored else staged(weights, "weights")

    def one(part: DataFrame) -> DataFrame:
        pairs = placed.join(F.broadcast(part), list(on))
        keep = [c for c in ("collection",) if c in on]
        return finish(pairs.groupBy("query_id", "chunk_id", *keep).agg(*value))

    return by_slices(weights, "query_id", BROADCAST_ROWS, one)


def query_weights(queries: DataFrame, index: KeywordIndex, k: int = 10, bounded: bool = True) -> DataFrame:
    """(query_id, *by, bucket, term, w, avg_dl, least_impact), stored: a query's terms that the index knows.

    Postings of less impact than ``least_impact`` cannot bring a chunk into the query's first k: at least k chunks reach the k-th impact of
    one of the query's terms alone, and such a posting stays below that with the highest impacts of all the other terms added.
    """
    by = list(index.by)
    own = [c for c in by if c in queries.columns]
    terms = staged(query_terms(queries, own).withColumn("bucket", _bucket(index.n_buckets)), "terms")
    n = F.col("n_chunks")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = index.terms.where(F.col("bucket").isin(_wanted(terms)))
    small = fits(terms, BROADCAST_ROWS)
    found = known.join(F.broadcast(terms) if small else terms, ["bucket", "term", *own])
    if by:
        found = found.join(broadcast_if_small(index.stats), by)
    else:
        found = found.withColumn("n_chunks", index.stats.select("n_chunks").scalar()).withColumn("avg_dl", index.stats.select("avg_dl").scalar())
    found = found.withColumn("w", F.col("qtf") * idf)
    rank = next((r for r in RANKS if k <= r), None) if bounded else None
    one_query = Window.partitionBy("query_id", *by)
    floor = F.coalesce(F.max(F.col("w") * F.col(f"top_{rank}")).over(one_query), F.lit(0.0)) if rank else F.lit(0.0)
    most = F.sum(F.col("w") * F.col("top_1")).over(one_query) - F.col("w") * F.col("top_1")
    found = found.select("query_id", *by, "bucket", "term", "w", "avg_dl", floor.alias("_floor"), most.alias("_others"))
    least = (F.col("_floor") - MARGIN - F.col("_others")) / F.col("w")
    return staged(found.withColumn("least_impact", least).drop("_floor", "_others"), "weights")


def _wanted(weights: DataFrame) -> list[int]:
    """The term buckets that occur; there are at most as many as the index has."""
    return sorted(r[0] for r in weights.select("bucket").distinct().collect())


def wanted_blocks(weights: DataFrame, index: KeywordIndex) -> DataFrame:
    """The blocks of the index that some query needs, from the files of the queries' buckets."""
    by = list(index.by)
    least = weights.groupBy(*by, "bucket", "term").agg(F.min("least_impact").alias("least_impact"))
    least = F.broadcast(least) if fits(least, BROADCAST_ROWS) else least
    blocks = index.blocks.where(F.col("bucket").isin(_wanted(weights)))
    return blocks.join(least, ["bucket", "term", *by]).where(F.col("max_impact") >= F.col("least_impact"))


def bm25_topk(queries: DataFrame, index: KeywordIndex, k: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """Any-term BM25 top k: (query_id, *by, chunk_id, score, rank), ranked within each index of ``by``.

    Where ``queries`` itself carries the ``by`` columns, each query only searches its own index. Blocks are passed over by their highest
    impact where ``k1`` and ``b`` are those that the index was ordered by.
    """
    by = list(index.by)
    weights = query_weights(queries, index, k, (k1, b) == (K1, B))
    # Queries that name their own index are ranked per query, others per query and index.
    within = [c for c in by if c not in queries.columns]

    def one(part: DataFrame) -> DataFrame:
        return rank_by_query(_best_chunks(part, index, k, k1, b), k, within)

    return by_slices(weights, "query_id", BROADCAST_ROWS, one)


def _best_chunks(weights: DataFrame, index: KeywordIndex, k: int, k1: float, b: float) -> DataFrame:
    """(query_id, chunk_id, *by, score): of each task's chunks the best k per query (and index); ``weights`` has a bounded number of rows.

    Queries and terms are numbered on the driver, as the broadcast brings these rows there anyway.
    """
    by, spark = list(index.by), weights.sparkSession
    pulled = weights.select("query_id", *by, "term", "w", "avg_dl").toArrow().combine_chunks()
    id_field, chunk_field = weights.schema["query_id"], index.blocks.schema["chunk_ids"].dataType.elementType
    schema = ST.StructType([id_field, ST.StructField("chunk_id", chunk_field), *[weights.schema[c] for c in by], ST.StructField("score", ST.DoubleType())])
    if pulled.num_rows == 0:
        return spark.createDataFrame([], schema)

    group, n_groups = _numbered([pulled.column(c) for c in by], pulled.num_rows)
    query, n_queries = _numbered([pa.array(group), pulled.column("query_id")], pulled.num_rows)
    term, n_terms = _numbered([pa.array(group), pulled.column("term")], pulled.num_rows)
    # Rows of a term stand together; queries are numbered anew within each index.
    first_of_query = np.unique(query, return_index=True)[1]
    group_of_query = group[first_of_query]
    own_number = np.zeros(n_queries, np.int64)
    for g in range(n_groups):
        own_number[group_of_query == g] = np.arange((group_of_query == g).sum())
    order = np.argsort(term, kind="stable")
    begins = np.searchsorted(term[order], np.arange(n_terms + 1))
    shared = spark.sparkContext.broadcast(
        (begins, own_number[query[order]], pulled.column("w").to_numpy()[order], pulled.select(["query_id", *by]).take(pa.array(first_of_query)), group_of_query)
    )
    first_of_term = np.unique(term, return_index=True)[1]
    numbers = pulled.select([*by, "term", "avg_dl"]).take(pa.array(first_of_term))
    numbers = numbers.append_column("_t", pa.array(np.arange(n_terms))).append_column("_g", pa.array(group[first_of_term]))
    wanted = wanted_blocks(weights, index).join(F.broadcast(spark.createDataFrame(numbers)), ["term", *by])
    zipped = F.arrays_zip(F.col("chunk_ids").alias("chunk_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))
    hit = wanted.select("_g", "_t", "avg_dl", F.explode(zipped).alias("_p")).select("_g", "_t", "avg_dl", "_p.*")
    hit = hit.select("_g", "chunk_id", "_t", _packed().alias("_n"), "avg_dl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, queries, w, ids, group_of_query = shared.value
        rest, scorer, current = None, None, None

        def close() -> list[pa.RecordBatch]:
            query, chunk_ids, score = scorer.found()
            named = ids.take(pa.array(np.flatnonzero(group_of_query == current)[query]))
            columns = [named.column("query_id"), chunk_ids, *[named.column(c) for c in by], pa.array(score)]
            return pa.table(columns, names=["query_id", "chunk_id", *by, "score"]).combine_chunks().to_batches()

        def take_in(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal scorer, current
            g = rows.column("_g").to_numpy()
            for lo, hi in _runs(g):
                if g[lo] != current:
                    if scorer is not None:
                        yield from close()
                    current = g[lo]
                    scorer = _ChunkScores(begins, queries, w, int((group_of_query == current).sum()), k)
                scorer.add(rows.slice(lo, hi - lo))

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
            # The last chunk may go on in the next batch.
            last = int(_begins(rows, ["_g", "chunk_id"])[-1]) if rows.num_rows else 0
            rest = rows.slice(last)
            yield from take_in(rows.slice(0, last))
        if rest is not None and rest.num_rows:
            yield from take_in(rest)
        if scorer is not None:
            yield from close()

    # A chunk's postings lie in one task, chunks in the order of their ids, which decides between equal scores.
    placed = dealt(hit, _n_postings(index.stats), "chunk_id").sortWithinPartitions("_g", "chunk_id")
    return _unpacked(placed).select("_g", "chunk_id", "_t", impact(k1, b).alias("impact")).mapInArrow(run, schema)


def _numbered(columns: list, n_rows: int) -> tuple[np.ndarray, int]:
    """Numbers of the distinct values of some columns, in the order of their first row."""
    known: dict = {}
    rows = zip(*[c.to_pylist() for c in columns]) if columns else ((),) * n_rows
    numbers = np.fromiter((known.setdefault(repr(r), len(known)) for r in rows), np.int64, n_rows)
    return numbers, len(known)


def _runs(codes: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of equal neighbours."""
    at = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1, [len(codes)]])
    return [(int(lo), int(hi)) for lo, hi in zip(at[:-1], at[1:]) if lo < hi]


def _begins(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Where a row differs from the one before it in some column; null is a value like any other."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        code = rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


class _ChunkScores:
    """Adds up the scores of whole chunks, in the order of their ids, and keeps each query's best."""

    def __init__(self, begins: np.ndarray, queries: np.ndarray, weights: np.ndarray, n_queries: int, k: int):
        self.begins, self.queries, self.weights, self.n = begins, queries, weights, n_queries
        self.best, self.ids, self.seen = Best(n_queries, k), [], 0

    def add(self, rows: pa.Table) -> None:
        term, impact_of = rows.column("_t").to_numpy(), rows.column("impact").to_numpy()
        first = _begins(rows, ["chunk_id"])
        chunk = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
        width = self.begins[term + 1] - self.begins[term]
        # As many chunks at once as give the bounded number of pairs, at least one.
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(width, first))[:-1]])
        slot = np.maximum(before, np.arange(len(first)) * self.n) // PAIRS
        ends = np.append(first, len(term))
        for lo, hi in _runs(slot):
            a, z = ends[lo], ends[hi]
            n = width[a:z]
            posting = np.repeat(np.arange(a, z), n)
            pair = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n) + self.begins[term[posting]]
            cell = (chunk[posting] - lo) * self.n + self.queries[pair]
            score = np.bincount(cell, impact_of[posting] * self.weights[pair], (hi - lo) * self.n).reshape(hi - lo, self.n)
            # Weights and impacts are above zero, so a zero is a pair without a common term.
            at, query = np.nonzero((score > self.best.floor()[None, :]) & (score > 0))
            self.best.offer(query, at + self.seen + lo, np.round(score[at, query], SCORE_DIGITS))
        self.ids.append(rows.column("chunk_id").combine_chunks().take(pa.array(first)))
        self.seen += len(first)
        if self.seen > 4 * self.best.at.size + 100_000:
            self._forget()

    def _forget(self) -> None:
        """Keep the ids of the best alone."""
        kept = np.unique(self.best.at[self.best.at >= 0])
        self.ids = [self._all_ids().take(pa.array(kept))]
        self.best.at = np.where(self.best.at >= 0, np.searchsorted(kept, self.best.at), -1)
        self.seen = len(kept)

    def _all_ids(self) -> pa.Array:
        return pa.concat_arrays([c for part in self.ids for c in (part.chunks if isinstance(part, pa.ChunkedArray) else [part])])

    def found(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        query, at, score = self.best.found()
        return query, self._all_ids().take(pa.array(at)), score


def mine_terms(chunks: DataFrame, position: str, batch: int = 10, longest: int = 2) -> DataFrame:
    """Candidate domain terms: word sequences of 2 to 15 characters, counted once per batch of chunks."""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}_]+"), F.lit(0))
    cut = chunks.select(F.floor(F.col(position) / batch).alias("batch"), words.alias("_w"))
    w = F.col("_w")

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        joined = F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    terms = F.array_distinct(F.concat(w, *[grams(n) for n in range(2, longest + 1)]))
    each = cut.select("batch", F.explode_outer(terms).alias("term")).where(F.length("term").between(2, 15))
    counted = each.distinct().groupBy("term").agg(F.count("*").alias("freq"))
    return counted.withColumn("weight", F.least(F.col("freq") * 10, F.lit(100)))
