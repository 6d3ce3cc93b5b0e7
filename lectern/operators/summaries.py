"""Summary rows over groups of chunks: clusters, communities, documents; and search through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.hooks import TextFunction, first_part
from lectern.functions.sizing import join_skewed
from lectern.functions.vectors import as_double
from lectern.operators.chunking import join_ordered, pack_segments
from lectern.operators.context import prefix_dedup
from lectern.operators.dense import dense_topk
from lectern.operators.keyword import rank_by_query
from lectern.operators.ordered import block_of, positions
from lectern.session import staged

# Members and characters a summary is made from; cluster counts by number of chunks.
CLUSTER_MEMBERS, CLUSTER_CHARS, CLUSTER_SHARE, CLUSTER_MOST = 8, 300, 8, 10
COMMUNITY_MEMBERS, COMMUNITY_CHARS, COMMUNITY_SHARE, COMMUNITY_MOST = 6, 250, 10, 8


def cluster_count(n_chunks: int, share: int = CLUSTER_SHARE, most: int = CLUSTER_MOST) -> int:
    return min(max(2, min(most, n_chunks // share)), max(n_chunks, 1))


def fit_clusters(chunks: DataFrame, n: int, n_init: int = 10, seed: int = 42) -> KMeansModel:
    """The best of several k-means fits by training cost."""
    prepared = chunks.select(array_to_vector(as_double(F.col("vector"))).alias("features"))
    models = [KMeans(k=n, seed=seed + i).fit(prepared) for i in range(n_init)]
    return min(models, key=lambda m: m.summary.trainingCost)


def assign_clusters(chunks: DataFrame, model: KMeansModel) -> DataFrame:
    """Add ``group_id``, the cluster of each chunk."""
    prepared = chunks.withColumn("features", array_to_vector(as_double(F.col("vector"))))
    return model.transform(prepared).withColumnRenamed("prediction", "group_id").drop("features")


def group_summaries(
    grouped: DataFrame, prefix: str, members: int, chars: int, text_fn: TextFunction = first_part
) -> DataFrame:
    """One summary row per ``group_id`` of (chunk_id, group_id, text, vector).

    The text comes from the first ``members`` chunks only (cut in each task before the shuffle), the vector is
    the mean over all members, combined in each task.
    """
    w = Window.partitionBy("group_id").orderBy("chunk_id")
    few = grouped.select("group_id", "chunk_id", F.substring("text", 1, chars).alias("text"))
    few = few.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= members)
    texts = few.groupBy("group_id").agg(join_ordered(["_n"], "text", "\n\n").alias("_joined"))
    mean = Summarizer.mean(array_to_vector(as_double(F.col("vector"))))
    sizes = grouped.groupBy("group_id").agg(F.count("*").alias("n_members"), mean.alias("_mean"))
    rows = sizes.join(texts, "group_id").select(
        F.concat(F.lit(prefix), F.col("group_id").cast("string")).alias("chunk_id"),
        "group_id",
        "n_members",
        text_fn(F.col("_joined")).alias("text"),
        vector_to_array("_mean").alias("vector"),
    )
    return staged(rows, "summaries")  # few rows that every later search reads


def cluster_summaries(
    chunks: DataFrame, n_clusters: int | None = None, n_init: int = 10, seed: int = 42, text_fn: TextFunction = first_part
) -> DataFrame:
    """Summaries of k-means clusters over the chunk vectors."""
    n = n_clusters or cluster_count(chunks.count())
    grouped = assign_clusters(chunks, fit_clusters(chunks, n, n_init, seed))
    return group_summaries(grouped, "raptor_summary_", CLUSTER_MEMBERS, CLUSTER_CHARS, text_fn)


def communities(labelled: DataFrame, text_fn: TextFunction = first_part) -> DataFrame:
    """Community rows over given groups; members stay rows of ``labelled`` (group_id, chunk_id)."""
    return group_summaries(labelled, "graphrag_community_", COMMUNITY_MEMBERS, COMMUNITY_CHARS, text_fn)


def find_communities(chunks: DataFrame, n: int | None = None, n_init: int = 10, seed: int = 42) -> DataFrame:
    """Label chunks with k-means communities."""
    n = n or cluster_count(chunks.count(), COMMUNITY_SHARE, COMMUNITY_MOST)
    return assign_clusters(chunks, fit_clusters(chunks, n, n_init, seed))


def summary_search(
    queries: DataFrame, base: DataFrame, summaries: DataFrame, k: int = 10, n_summaries: int = 3
) -> DataFrame:
    """The most similar summaries before the base hits; equal text prefixes once; k rows.

    ``base`` is (query_id, chunk_id, rank, text); chunk ids come back as text.
    """
    top = dense_topk(queries, summaries.select("chunk_id", "vector"), n_summaries)
    top = top.join(summaries.select("chunk_id", "text"), "chunk_id")
    rows = top.select("query_id", "chunk_id", F.col("rank"), "text").unionByName(
        base.select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), (F.col("rank") + n_summaries).alias("rank"), "text")
    )
    return prefix_dedup(rows, k)


def global_search(queries: DataFrame, groups: DataFrame, members: DataFrame, n_groups: int = 2, per_group: int = 3) -> DataFrame:
    """The most similar communities, each followed by its first members: (query_id, chunk_id, slot, rank)."""
    top = dense_topk(queries, groups.select("chunk_id", "vector"), n_groups)
    top = top.join(groups.select("chunk_id", "group_id"), "chunk_id").select("query_id", "chunk_id", "group_id", F.col("rank").alias("_g"))
    w = Window.partitionBy("group_id").orderBy("chunk_id")
    first = members.select("group_id", "chunk_id").withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= per_group)
    inside = top.drop("chunk_id").join(first, "group_id").select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "slot", "_g")
    rows = top.select("query_id", "chunk_id", F.lit(0).alias("slot"), "_g").unionByName(inside)
    return rank_by_query(rows, n_groups * (per_group + 1), (), [F.asc("_g"), F.asc("slot")]).drop("_g")


def safe_id(source):
    """A source name as part of an id."""
    return F.substring(F.regexp_replace(source.cast("string"), r"[/\\ ]", "_"), 1, 40)


def document_summaries(
    chunks: DataFrame, order: str | Sequence[str], done: DataFrame | None = None, max_chars: int = 3000, text_fn: TextFunction = first_part,
    order_span: int | None = None,
) -> DataFrame:
    """One summary row per packed segment of each source that has none yet."""
    todo = chunks if done is None else chunks.join(done.select("source").distinct(), "source", "left_anti")
    segments = pack_segments(todo, ["source"], order, max_chars, order_span=order_span)
    # Stored, so that a costly text function runs once per segment.
    segments = staged(segments.select("source", "seg_start", "n_chunks", text_fn(F.col("text")).alias("text")), "summaries")
    numbered = positions(segments, "seg_index", ["source"], ["seg_start"], block_of("seg_start"))
    totals = numbered.groupBy("source").agg(F.count("*").alias("n_segs"), F.sum("n_chunks").alias("orig_chunks"))
    out = join_skewed(numbered, totals, "source", "n_segs", F.col("seg_start"))
    name = F.concat(F.lit("raptor_"), safe_id(F.col("source")), F.lit("_"), F.col("seg_index").cast("string"))
    return out.select("source", name.alias("chunk_id"), F.lit("raptor_summary").alias("node_type"), "seg_index", "n_segs", "orig_chunks", "text")
