"""Labels, hit rates, grouped metrics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.dense import dense_topk
from lectern.session import staged

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
SKIPPED_CATEGORIES = ("Fallback测试（知识库外）", "路由测试（闲聊）")  # fixed values: categories that are not scored
METRIC_DIGITS = 4
NO_RANK = 999  # fixed value: rank of a truth that was not found
TIE_BAND = 0.02  # fixed value: mean scores this close are a tie


def silver_labels(qa: DataFrame, chunks: DataFrame) -> DataFrame:
    """The nearest chunk for each item: among the pages next to its own, else among all.

    ``qa`` is (query_id, page, vector), ``chunks`` (chunk_id, page, vector). The page range is an equi-join: an
    item asks for three pages. ``found`` tells which search answered: ``page``, ``global`` or ``failed``.
    """
    asked = qa.where(F.col("vector").isNotNull())
    pages = asked.where(F.col("page").isNotNull()).select(
        "query_id", "vector", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page")
    )
    near = dense_topk(pages.where(F.col("page") >= 0), chunks.where(F.col("page").isNotNull()), 1, key="page")
    near = staged(near.select("query_id", "chunk_id", "score"), "labels")  # one row per item, read twice
    rest = asked.join(near.select("query_id"), "query_id", "left_anti")
    far = dense_topk(rest, chunks, 1).select("query_id", "chunk_id", "score")
    found = near.withColumn("found", F.lit("page")).unionByName(far.withColumn("found", F.lit("global")))
    return qa.select("query_id").join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.lit("failed")))


def first_hits(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank): the best rank of a true chunk per labelled query, NULL where none was found.

    ``truth`` is (query_id, chunk_id); every labelled query stays, also those without any result.
    """
    found = ranked.join(truth.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.min("rank").alias("rank")
    )
    return truth.select("query_id").distinct().join(found, "query_id", "left")


def _hits(digits: int) -> list[Column]:
    def share(n: int) -> Column:
        return F.round(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)), digits)

    return [share(1).alias("hit_at_1"), share(3).alias("hit_at_3"), share(5).alias("hit_at_5")]


def hit_at_k(first: DataFrame) -> DataFrame:
    """Hit@1/3/5 and mean reciprocal rank over all labelled queries."""
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), METRIC_DIGITS)
    return first.agg(F.count("*").alias("n_evaluated"), *_hits(METRIC_DIGITS), mrr.alias("mrr"))


def hit_by_group(first: DataFrame, groups: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Hit rates by each dimension in one pass over grouping sets; equal values of two dimensions stay apart."""
    rows = first.join(groups.select("query_id", *dimensions), "query_id", "left")
    rows = rows.select("rank", *[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dimensions])
    sets = [[F.col(d)] for d in dimensions]
    out = rows.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), *_hits(3), F.grouping_id().alias("_g"))
    full = 2 ** len(dimensions) - 1
    named = F.lit(None).cast("string")
    for i, d in enumerate(dimensions):
        named = F.when(F.col("_g") == full - 2 ** (len(dimensions) - 1 - i), F.lit(d)).otherwise(named)
    return out.select(named.alias("dimension"), F.coalesce(*dimensions).alias("value"), "n", "hit_at_1", "hit_at_3", "hit_at_5")


def _mean(column: str) -> Column:
    value = F.col(column)
    return F.round(F.avg(F.when(~F.isnan(value), value)), METRIC_DIGITS)


def metric_means(samples: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each metric over its numbers; NULL where there is none."""
    return samples.agg(F.count("*").alias("n"), *[_mean(m).alias(m) for m in metrics])


def metric_by_group(samples: DataFrame, group: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """The same per group, from scores that were computed once."""
    key = F.coalesce(F.col(group).cast("string"), F.lit("unknown")).alias(group)
    return samples.groupBy(key).agg(F.count("*").alias("n"), *[_mean(m).alias(m) for m in metrics])


def scored_items(items: DataFrame, skipped: Sequence[str] = SKIPPED_CATEGORIES) -> DataFrame:
    """Items that take part in scoring, with the metric set they get: four with, two without a reference."""
    kept = items.where(
        ~F.coalesce(F.col("category").isin(*skipped), F.lit(False))
        & (F.coalesce("answer", F.lit("")) != "")
        & (F.coalesce("route", F.lit("")) != "error")
    )
    return kept.withColumn("metric_set", F.when(F.coalesce("reference", F.lit("")) != "", "full").otherwise("no_reference"))


def eval_report(items: DataFrame, scores: DataFrame, skipped: Sequence[str] = SKIPPED_CATEGORIES) -> DataFrame:
    """Summary by category and over all scored categories (``scope`` = category or aggregate)."""
    rows = items.join(scores, "id", "left")
    numbers = [*METRICS, "top1_score", "elapsed"]
    means = [_mean(m).alias(f"avg_{m}" if m in ("top1_score", "elapsed") else m) for m in numbers]
    counted = F.count("*").alias("n")
    by_category = rows.groupBy("category").agg(counted, *means).withColumn("scope", F.lit("category"))
    scored = rows.where(~F.coalesce(F.col("category").isin(*skipped), F.lit(False)))
    overall = scored.agg(counted, *means).withColumn("category", F.lit("all")).withColumn("scope", F.lit("aggregate"))
    return by_category.unionByName(overall)


def corrected_hit_rate(first: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Hit rate with the misses a reviewer called right (verdict y), and the label noise that implies."""
    rows = first.join(verdicts.select("query_id", "verdict"), "query_id", "left")
    n = F.count("*")
    auto, right = F.count_if(F.col("rank").isNotNull()), F.count_if(F.col("verdict") == "y")
    return rows.agg(
        n.alias("n"),
        auto.alias("auto_hits"),
        right.alias("verdict_y"),
        F.count_if(F.col("verdict") == "n").alias("verdict_n"),
        F.round(auto / n, METRIC_DIGITS).alias("hit_rate"),
        F.round((auto + right) / n, METRIC_DIGITS).alias("corrected_rate"),
        F.round(right / n, METRIC_DIGITS).alias("label_noise"),
    )


def level_comparison(samples: DataFrame, level: str, levels: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metric by level matrix with the best level per metric; the level named first wins ties."""
    means = samples.groupBy(level).agg(*[_mean(m).alias(m) for m in metrics])
    long = means.unpivot([level], list(metrics), "metric", "value")
    place = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(level))
    wide = long.groupBy("metric").pivot(level, list(levels)).agg(F.first("value"))
    best = long.groupBy("metric").agg(F.max_by(level, F.when(F.col("value").isNotNull(), F.struct("value", -place))).alias("best"))
    return wide.join(best, "metric")


def scenario_accuracy(ranked: DataFrame, truth: DataFrame, partner: DataFrame | None = None) -> DataFrame:
    """Per scenario: hits within 1, 3 and 5, mean best and mean truth score, mean truth rank.

    ``truth`` is (query_id, scenario, chunk_id, truth_score); ``partner`` a second ranking whose truth rank is
    reported besides. A truth that was not found has rank 999.
    """
    top = ranked.where(F.col("rank") == 1).select("query_id", F.col("score").alias("top1_score"))
    at = ranked.select("query_id", "chunk_id", "rank")
    rows = truth.join(at, ["query_id", "chunk_id"], "left").join(top, "query_id", "left")
    rank = F.coalesce("rank", F.lit(NO_RANK))
    extra = []
    if partner is not None:
        rows = rows.join(partner.select("query_id", "chunk_id", F.col("rank").alias("_p")), ["query_id", "chunk_id"], "left")
        extra = [F.round(F.avg(F.coalesce("_p", F.lit(NO_RANK))), METRIC_DIGITS).alias("avg_partner_rank")]
    within = [F.count_if(rank <= n).alias(f"top{n}") for n in (1, 3, 5)]
    return rows.groupBy("scenario").agg(
        F.count("*").alias("n"), *within,
        F.round(F.avg("top1_score"), METRIC_DIGITS).alias("avg_top1"),
        F.round(F.avg("truth_score"), METRIC_DIGITS).alias("avg_truth"),
        F.round(F.avg(rank), METRIC_DIGITS).alias("avg_rank"), *extra,
    )


def compare_scenarios(a: DataFrame, b: DataFrame, band: float = TIE_BAND) -> DataFrame:
    """Two scenario tables side by side; the winner's mean best score lies above the tie band."""
    left = a.select("scenario", F.col("avg_top1").alias("a_top1"), F.col("top1").alias("a_hits"))
    right = b.select("scenario", F.col("avg_top1").alias("b_top1"), F.col("top1").alias("b_hits"))
    winner = (
        F.when(F.col("b_top1") > F.col("a_top1") + band, "b").when(F.col("a_top1") > F.col("b_top1") + band, "a").otherwise("tie")
    )
    return left.join(right, "scenario").withColumn("winner", winner)


# Lengths up to which the profile counts chunks.
PROFILE_STEPS = (30, 64, 128, 256, 512)


def chunk_profile(chunks: DataFrame, group: str) -> DataFrame:
    """Count, smallest, largest, median and mean length, and how many chunks stay within each step."""
    n = F.length("text")
    sized = chunks.select(group, n.alias("_n"))
    return sized.groupBy(group).agg(
        F.count("*").alias("n"),
        F.min("_n").cast("bigint").alias("min_len"),
        F.max("_n").cast("bigint").alias("max_len"),
        F.median("_n").alias("median_len"),
        F.round(F.avg("_n"), METRIC_DIGITS).alias("mean_len"),
        *[F.count_if(F.col("_n") <= s).alias(f"le_{s}") for s in PROFILE_STEPS],
        F.count_if(F.col("_n") > PROFILE_STEPS[-1]).alias("above"),
    )
