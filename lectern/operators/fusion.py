"""Fusing ranked lists: (query_id, list_id, chunk_id, rank) rows in, one ranked list per query out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.keyword import rank_by_query

RRF_K = 60  # fixed value: smoothing constant of reciprocal rank fusion
FUSION_DIGITS = 9
ALL = 2**31 - 1


def _add_up(share: Column) -> Column:
    return F.round(F.sum(share), FUSION_DIGITS)


def weighted_rrf(lists: Sequence[tuple[DataFrame, float]], within: Sequence[str] = (), rrf_k: int = RRF_K) -> DataFrame:
    """Sum of weight / (60 + rank) over lists, by chunk, no final cut."""
    tagged = [
        ranked.select("query_id", *within, "chunk_id", "rank", F.lit(i).alias("list_id"), F.lit(float(w)).alias("w"))
        for i, (ranked, w) in enumerate(lists)
    ]
    rows = tagged[0]
    for other in tagged[1:]:
        rows = rows.unionByName(other)
    scored = rows.groupBy("query_id", *within, "chunk_id").agg(
        _add_up(F.col("w") / (rrf_k + F.col("rank"))).alias("score"), F.min("list_id").alias("first_list")
    )
    order = [F.desc("score"), F.asc("first_list"), F.asc("chunk_id")]
    return rank_by_query(scored, ALL, within, order).drop("first_list")


def hybrid_rrf(keyword: DataFrame, dense: DataFrame, weights: tuple[float, float] = (0.5, 0.5), within: Sequence[str] = ()) -> DataFrame:
    """Keyword and vector rankings fused; keeps every chunk either of them found."""
    return weighted_rrf([(keyword, weights[0]), (dense, weights[1])], within)


def with_text(ranked: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """Look up chunk columns for ranked rows; chunk ids are unique, so neither side is skewed."""
    return ranked.join(chunks.select("chunk_id", *(columns or ("text",))), "chunk_id")


def rrf_merge(lists: DataFrame, prefix: int = 200, top_n: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Unweighted fusion of (query_id, list_id, chunk_id, rank, text); equal text prefixes are one document.

    The last document seen with a prefix stands for it.
    """
    key = F.substring("text", 1, prefix)
    return _merge(lists.withColumn("_key", key), top_n, rrf_k)


def _merge(keyed: DataFrame, top_n: int | None, rrf_k: int = RRF_K) -> DataFrame:
    seen_last = F.struct("list_id", "rank", "chunk_id")
    scored = keyed.groupBy("query_id", "_key").agg(
        _add_up(1.0 / (rrf_k + F.col("rank"))).alias("score"),
        F.min("list_id").alias("_first"),
        F.max_by("chunk_id", seen_last).alias("chunk_id"),
        F.max_by("text", seen_last).alias("text"),
    )
    order = [F.desc("score"), F.asc("_first"), F.asc("chunk_id")]
    return rank_by_query(scored, top_n or ALL, (), order).select("query_id", "chunk_id", "rank", "score", "text")


def multi_collection(ranked: DataFrame, chunks: DataFrame, top_k: int = 10, prefix: int = 200) -> DataFrame:
    """Fuse the rankings a query has in several collections; collections without hits simply add nothing."""
    # A collection's own name orders the lists, which makes ties deterministic.
    lists = with_text(ranked, chunks).select("query_id", F.col("collection").alias("list_id"), "chunk_id", "rank", "text")
    return rrf_merge(lists, prefix, top_k)


def bilingual(ranked: DataFrame, chunks: DataFrame, top_k: int = 10, prefix: int = 100) -> DataFrame:
    """Fuse what the original (variant 0) and the translated query (variant 1) found.

    Queries without a translation keep their own ranking unchanged.
    """
    rows = with_text(ranked, chunks)
    translated = ranked.where(F.col("variant") == 1).select("query_id").distinct().withColumn("_both", F.lit(True))
    rows = rows.join(translated, "query_id", "left")
    key = F.when(F.col("_both"), F.substring("text", 1, prefix)).otherwise(
        F.concat(F.lit("\0"), F.col("chunk_id").cast("string"))
    )
    return _merge(rows.withColumn("list_id", F.col("variant")).withColumn("_key", key), top_k)


def cross_collection(own: DataFrame, partner: DataFrame, chunks: DataFrame, top_k: int = 10, prefix: int = 100) -> DataFrame:
    """Fuse a query's ranking in its own collection with the translated query's ranking in the partner's."""
    rows = own.select("query_id", "chunk_id", "rank", F.lit(0).alias("variant")).unionByName(
        partner.select("query_id", "chunk_id", "rank", F.lit(1).alias("variant"))
    )
    return bilingual(rows, chunks, top_k, prefix)


def query_variants(queries: DataFrame, translated: DataFrame) -> DataFrame:
    """One row per query text: variant 0 as asked, variant 1 as translated where a translation exists."""
    asked = queries.select("query_id", F.lit(0).alias("variant"), "text")
    other = translated.where(F.col("translated").isNotNull()).select(
        "query_id", F.lit(1).alias("variant"), F.col("translated").alias("text")
    )
    return asked.unionByName(other)


def translation_lookup(queries: DataFrame, translations: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Add the stored translation of (src_lang, text) unless it is older than ``days``; the newest one wins."""
    fresh = translations.where(F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS"))
    latest = fresh.groupBy("src_lang", F.col("query").alias("text")).agg(
        F.max_by("translated", F.struct("created_at", "translated")).alias("translated")
    )
    return queries.join(latest, ["src_lang", "text"], "left")


def partner_collection(collections: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``partner``: the paired collection of the other language that exists in the catalog, or NULL."""
    name = F.col("collection")
    stem = F.substr(name, F.lit(1), F.length(name) - 3)
    first = F.when(name.endswith("_en"), F.concat(stem, F.lit("_zh"))).when(
        name.endswith("_zh"), F.concat(stem, F.lit("_en"))
    ).otherwise(F.concat(name, F.lit("_en")))
    second = F.when(name.endswith("_en"), stem)
    known = catalog.select("collection").distinct()
    named = collections.withColumn("_p1", first).withColumn("_p2", second)
    hit1 = known.select(F.col("collection").alias("_p1"), F.lit(True).alias("_h1"))
    hit2 = known.select(F.col("collection").alias("_p2"), F.lit(True).alias("_h2"))
    out = named.join(hit1, "_p1", "left").join(hit2, "_p2", "left")
    partner = F.when(F.col("_h1"), F.col("_p1")).when(F.col("_h2"), F.col("_p2"))
    return out.select(*collections.columns, partner.alias("partner"))
