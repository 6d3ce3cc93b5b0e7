"""Chunk-entity graph as an edge table; a hop is an equi-join on the entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.sizing import BROADCAST_ROWS, fits, join_skewed
from lectern.operators.fusion import ALL
from lectern.session import staged
from lectern.operators.keyword import SCORE_DIGITS, postings, query_terms, rank_by_query, score_by_terms, term_stats

EXCERPT = 400  # fixed value: the part of a chunk entities are taken from


def _excerpts(chunks: DataFrame, chars: int) -> DataFrame:
    return chunks.select("chunk_id", F.substring("text", 1, chars).alias("text"))


def entity_idf(chunks: DataFrame, chars: int = EXCERPT) -> DataFrame:
    """(term, df, idf) over the excerpts of all chunks."""
    df = term_stats(postings(_excerpts(chunks, chars)))
    n = chunks.agg(F.count("*").alias("n")).scalar()
    # One row per term, stored: edges and query entities both look terms up in it.
    return staged(df.withColumn("idf", F.log(n / F.col("df"))), "idf")


def _top_terms(counted: DataFrame, idf: DataFrame, owner: str, topk: int) -> DataFrame:
    weighted = join_skewed(counted, idf, "term", "df", F.col(owner))
    score = F.round(F.col("tf") * F.col("idf"), SCORE_DIGITS)
    w = Window.partitionBy(owner).orderBy(F.desc("_s"), F.asc("term"))
    ranked = weighted.withColumn("_s", score).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= topk)
    return ranked.select(owner, F.col("term").alias("entity"))


def term_graph(chunks: DataFrame, topk: int = 8, chars: int = EXCERPT, idf: DataFrame | None = None) -> DataFrame:
    """Edges from each chunk to its ``topk`` terms of highest TF-IDF in the excerpt, weight 1."""
    idf = entity_idf(chunks, chars) if idf is None else idf
    counted = postings(_excerpts(chunks, chars)).select("chunk_id", "term", "tf")
    return _top_terms(counted, idf, "chunk_id", topk).withColumn("weight", F.lit(1))


def query_entities(queries: DataFrame, idf: DataFrame, topk: int = 6, chars: int = EXCERPT) -> DataFrame:
    """(query_id, entity): the query's terms of highest TF-IDF that occur in the corpus at all."""
    counted = query_terms(queries.withColumn("text", F.substring("text", 1, chars))).withColumnRenamed("qtf", "tf")
    return _top_terms(counted, idf, "query_id", topk)


def entity_graph(chunks: DataFrame, entities: str | None = None, topk: int = 5, chars: int = EXCERPT) -> DataFrame:
    """Edges from supplied entity lists (column ``entities``), or from the top terms where none are given."""
    if entities is None:
        return term_graph(chunks, topk, chars)
    listed = chunks.select("chunk_id", F.explode(F.array_distinct(T.split_entities(F.col(entities)))).alias("entity"))
    return listed.withColumn("weight", F.lit(1))


def _reached(seeds: DataFrame, base: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Chunks that share a seed entity with the query and are no base hits, best k per query."""
    ids = base.select("query_id", "chunk_id")
    small = fits(ids, BROADCAST_ROWS)
    ids = F.broadcast(ids) if small else ids
    hit = edges.select("chunk_id", "entity").distinct()

    def finish(found: DataFrame) -> DataFrame:
        fresh = found.join(ids, ["query_id", "chunk_id"], "left_anti")
        return rank_by_query(fresh, k, (), [F.asc("hop"), F.desc("shared"), F.asc("chunk_id")])

    return score_by_terms(hit, seeds, ["entity"], [F.min("hop").alias("hop"), F.count("*").alias("shared")], finish)


def _append(base: DataFrame, reached: DataFrame, k: int) -> DataFrame:
    sizes = base.select("query_id", "chunk_id", F.lit(0).alias("hop"), F.col("rank").alias("_r"))
    rows = sizes.unionByName(reached.select("query_id", "chunk_id", "hop", F.col("rank").alias("_r")))
    # ``reached`` is ranked over both hops, so base rows sort first and the rest keep their order.
    order = [F.asc(F.col("hop") > 0), F.asc("_r"), F.asc("chunk_id")]
    return rank_by_query(rows, k, (), order).drop("_r")


def kg_expand(
    base: DataFrame, entities: DataFrame, edges: DataFrame, k: int = 10, reserve: int = 0
) -> DataFrame:
    """Base hits, then chunks of the query's entities (hop 1), then chunks sharing an entity with a hit (hop 2).

    Cut to k. ``reserve`` keeps that many of the k places for expanded chunks.
    """
    base = staged(base, "hits")
    kept = base.where(F.col("rank") <= k - reserve)
    of_hits = base.select("query_id", "chunk_id").join(edges, "chunk_id").select("query_id", "entity", F.lit(2).alias("hop"))
    seeds = (
        entities.select("query_id", "entity", F.lit(1).alias("hop"))
        .unionByName(of_hits)
        .groupBy("query_id", "entity")
        .agg(F.min("hop").alias("hop"))
    )
    return _append(kept, _reached(seeds, base, edges, k), k)


def local_search(base: DataFrame, entities: DataFrame, edges: DataFrame, k: int | None = None) -> DataFrame:
    """Base hits followed by all other chunks that carry an entity of the query."""
    base = staged(base, "hits")
    seeds = entities.select("query_id", "entity", F.lit(1).alias("hop")).distinct()
    return _append(base, _reached(seeds, base, edges, k or ALL), k or ALL)


def local_global_merge(local: DataFrame, overall: DataFrame, k: int = 10, local_share: float = 0.6) -> DataFrame:
    """round(k * share) local rows, then the global rows for the other places; both carry ``text``."""
    n_local = F.greatest(F.bround(F.lit(float(k * local_share)), 0).cast("int"), F.lit(1))
    rows = (
        local.where(F.col("rank") <= n_local)
        .select("query_id", "chunk_id", "text", F.lit(0).alias("side"), "rank")
        .unionByName(
            overall.where(F.col("rank") <= k - n_local).select("query_id", "chunk_id", "text", F.lit(1).alias("side"), "rank")
        )
    )
    w = Window.partitionBy("query_id", F.substring("text", 1, 80)).orderBy("side", "rank", "chunk_id")
    kept = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).withColumnRenamed("rank", "_r")
    return rank_by_query(kept, k, (), [F.asc("side"), F.asc("_r")]).select("query_id", "chunk_id", "side", "rank")
