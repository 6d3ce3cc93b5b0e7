"""Chunk collections on shared storage.

A store is a folder of Parquet batches, ``<root>/batch=<n>/write=<id>/collection=<name>/``. Every write adds a batch folder numbered one above
all that are there, whoever writes, so later writes hide earlier ones after ``compact`` and ``drop_collection`` too; files
that are being read are never touched. A write may be named: done again under its name (a repeated micro-batch), it
changes nothing. Reading keeps the newest row per chunk id; ``compact`` folds all batches into one so that reads
start from there. ``compact`` and ``drop_collection`` want no other write to the same root at work.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.sizing import broadcast_if_small
from lectern.session import child_names, path_exists

DEFAULT_MODEL = "default"


def _batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches that were begun, ascending."""
    return sorted(int(n.removeprefix("batch=")) for n in child_names(spark, root) if n.startswith("batch="))


def _last_batch(spark: SparkSession, root: str) -> int:
    return max(_batches(spark, root), default=0)


def with_defaults(chunks: DataFrame) -> DataFrame:
    """Fill what an index entry must have: source, page (-1 for none) and node type."""
    cols = chunks.columns
    source = [F.col(c) for c in ("source", "file_name") if c in cols]
    out = chunks.withColumn("source", F.coalesce(*source, F.lit("")))
    out = out.withColumn("page", F.coalesce(F.col("page"), F.lit(-1)) if "page" in cols else F.lit(-1))
    return out.withColumn("node_type", F.coalesce(F.col("node_type"), F.lit("chunk")) if "node_type" in cols else F.lit("chunk"))


def upsert_chunks(chunks: DataFrame, root: str, name: str | int | None = None) -> int:
    """Write chunks as a new batch and give its number; rows of an earlier batch with the same id are hidden from then on.

    Several rows of one id inside the batch count as one: the one with the largest text. A write that was
    completed under the same ``name`` before is not repeated.
    """
    spark = chunks.sparkSession
    done = f"{root}-writes/name={name}"
    if name is not None and path_exists(spark, done):
        # nothing to read here: the write broke off before it was noted, and is done anew
        for (batch,) in spark.read.schema("batch long").parquet(done).take(1):
            return batch
    batch = _last_batch(spark, root) + 1
    w = Window.partitionBy("collection", "chunk_id").orderBy(F.desc("text"))
    unique = chunks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    unique.write.partitionBy("collection").parquet(f"{root}/batch={batch}/write={uuid.uuid4().hex}")
    if name is not None:
        spark.range(1).select(F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(done)
    return batch


def has_collection(spark: SparkSession, root: str, collection: str) -> bool:
    """True where a row of the collection is live; superseded rows need no look, as newer ones of the collection hide them."""
    return bool(_batches(spark, root)) and _live(spark, root, [collection]).limit(1).count() > 0


def append_collection(chunks: DataFrame, root: str, collection: str, force: bool = False, name: str | None = None) -> bool:
    """Add chunks to a collection; an existing one is left as it is unless ``force``. True when written."""
    if not force and has_collection(chunks.sparkSession, root, collection):
        return False
    upsert_chunks(chunks.withColumn("collection", F.lit(collection)), root, name)
    return True


def drop_collection(spark: SparkSession, root: str, collection: str) -> None:
    """Hide everything the collection holds so far; ``compact`` removes it from storage."""
    row = spark.range(1).select(F.lit(collection).alias("collection"), F.lit(_last_batch(spark, root)).cast("long").alias("dropped_at"))
    row.write.mode("append").parquet(f"{root}-dropped")


def _base(spark: SparkSession, root: str) -> int:
    """Number of the batch that reads start from."""
    return spark.read.parquet(f"{root}-base").agg(F.max("batch")).first()[0] if path_exists(spark, f"{root}-base") else 0


def _live(spark: SparkSession, root: str, collections: Sequence[str] | None = None) -> DataFrame:
    """Rows that were neither dropped nor folded into a later batch, with their ``batch`` and ``write``."""
    rows = spark.read.option("basePath", root).parquet(root)
    rows = rows.withColumns({"batch": F.col("batch").cast("bigint"), "write": F.col("write").cast("string"), "collection": F.col("collection").cast("string")})
    if collections is not None:
        rows = rows.where(F.col("collection").isin(*collections))
    rows = rows.where(F.col("batch") >= _base(spark, root))
    if path_exists(spark, f"{root}-dropped"):
        gone = spark.read.parquet(f"{root}-dropped").groupBy("collection").agg(F.max("dropped_at").alias("_gone"))
        rows = rows.join(broadcast_if_small(gone), "collection", "left")
        rows = rows.where(F.col("_gone").isNull() | (F.col("batch") > F.col("_gone"))).drop("_gone")
    return rows


def scan_collection(spark: SparkSession, root: str, collections: Sequence[str] | None = None) -> DataFrame:
    """Current chunks; folder names prune collections, columns and filters reach the scan.

    Superseded rows are found from ids and batch numbers alone, and not sought at all where one write is live.
    """
    rows, base = _live(spark, root, collections), _base(spark, root)
    writes = [w for b in _batches(spark, root) if b >= base for w in child_names(spark, f"{root}/batch={b}") if w.startswith("write=")]
    if len(writes) > 1:
        place = F.struct("batch", "write")
        ids = _live(spark, root, collections).select(F.col("collection").alias("_c"), F.col("chunk_id").alias("_i"), place.alias("_p"))
        old = ids.groupBy("_c", "_i").agg(F.max("_p").alias("_newest"), F.count("*").alias("_n")).where("_n > 1")
        rows = rows.join(old, F.col("collection").eqNullSafe(F.col("_c")) & F.col("chunk_id").eqNullSafe(F.col("_i")) & (place < F.col("_newest")), "left_anti")
    return rows.drop("batch", "write")


def compact(spark: SparkSession, root: str) -> int:
    """Write the current state as one batch that reads start from; older batch folders are no longer read."""
    batch = upsert_chunks(scan_collection(spark, root), root)
    spark.range(1).select(F.lit(batch).alias("batch")).write.mode("append").parquet(f"{root}-base")
    return batch


def collection_catalog(chunks: DataFrame, registry: DataFrame | None = None, default_model: str = DEFAULT_MODEL) -> DataFrame:
    """Chunk count and embedding model per collection."""
    counted = chunks.groupBy("collection").agg(F.count("*").alias("n_chunks"))
    if registry is None:
        return counted.withColumn("embedding_model", F.lit(default_model))
    named = counted.join(registry.select("collection", "embedding_model"), "collection", "left")
    return named.withColumn("embedding_model", F.coalesce("embedding_model", F.lit(default_model)))


def write_report(report: DataFrame, path: str, run: str) -> str:
    """Keep a report under its run name and as the latest one, as JSON lines."""
    kept = f"{path}/run={run}"
    report.write.mode("overwrite").json(kept)
    report.sparkSession.read.schema(report.schema).json(kept).write.mode("overwrite").json(f"{path}/latest")
    return kept
