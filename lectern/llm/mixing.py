"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document is first given the whole copies that are certain (the integer
part of target over source size); the rest of a source's target is a sample in Pareto order: documents are
ranked by ``(u / (1 - u)) / (p / (1 - p))`` with a random ``u`` from a hash of seed, id and text and the
inclusion probability ``p``, and the first ones are taken until their words reach what is left of the target. The
sample has a fixed size in words, up to one small document.

No source meets in one task: the place of the cut is found on a histogram of the ranks (``BINS`` rows per source
at most), and only the documents of the bin at the cut, with ``ZONE`` documents before and after it, are walked in order; there,
up to ``SWAPS`` pairs are exchanged to meet the target. One in ``BINS`` documents of a source is a narrow row in one task there.

Defined results: null text has size 0; null source is a source of its own, last in order; a source of size 0 has target 0
and its documents are not taken; rows equal in id and text are taken alike; ids may repeat or be null.
Input columns called ``size``, ``copies``, ``source_size`` or ``target`` are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.sizing import broadcast_if_small
from lectern.llm.shared import WORD, row_key
from lectern.session import staged

BINS = 4096
ZONE = 128
SWAPS = 3
WEIGHTS = (1, 2, 3)
CAP = 3
UNIT = 2.0**-52


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight, cut at ``cap`` times the source's size.

    The excess of a cut source goes to the others by weight until none is above its cap. Taken in order of cap over
    weight, a source is cut when its ratio lies below the level that the sources from it onwards would share. The window
    runs over one row per source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(cap)).alias("limit"))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("w"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left_w = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / left_w).withColumn("cut", F.col("ratio") < F.col("level"))
    # where no later source is cut, all share the level of the first of them
    level = F.min(F.when(~F.col("cut"), F.struct("ratio", "level"))).over(every)["level"]
    return rows.select("source", "source_size", F.when(F.col("cut"), F.col("limit")).otherwise(F.col("w") * level).alias("target"))


def _ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    # the row travels as one struct, so that no column of it clashes with those added here
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), n_words(F.col(text_col)).alias("size"), F.col(source_col).alias("_source"),
        row_key(id_col, text_col).alias("_key"), ((F.shiftrightunsigned(h, 12) + F.lit(0.5)) * F.lit(UNIT)).alias("_u"),
    )


def _with_rank(rows: DataFrame) -> DataFrame:
    """Adds the Pareto rank, scaled to 0..1: odds / (1 + odds)."""
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("p") / (1 - F.col("p")))
    rank = F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(1.0)
    return rows.withColumn("_rank", rank).withColumn("_bin", F.least(F.floor(F.col("_rank") * BINS), F.lit(BINS - 1)).cast("int"))


def _fill(zone: pd.DataFrame) -> pd.DataFrame:
    """Takes documents of the zone in order while they fit what is left, then swaps pairs near the cut that fill it better."""
    zone = zone.sort_values(["_rank", "_key"], kind="stable")
    gap, take, sizes = float(zone["gap"].iloc[0]), [], zone["size"].to_numpy()
    for size in sizes.tolist():
        take.append(size <= gap)
        gap -= size if size <= gap else 0
    take = np.array(take)
    for _ in range(SWAPS):
        inside, outside = np.flatnonzero(take)[-2 * ZONE :], np.flatnonzero(~take)[: 2 * ZONE]
        more = sizes[outside][None, :] - sizes[inside][:, None]
        more = np.where(more <= gap, more, 0)
        if not more.size or more.max() <= 0:
            break
        i, j = np.unravel_index(more.argmax(), more.shape)
        take[inside[i]], take[outside[j]] = False, True
        gap -= more.max()
    return zone.assign(_take=take)[["_key", "_take"]]


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (of its source) and ``copies``, the times the mix takes it."""
    ranked = _ranked(docs, id_col, text_col, source_col, seed)
    narrow = staged(ranked.select("_source", "size", "_key", "_u"), "mix-sizes")
    targets = source_targets(narrow.select(F.col("_source").alias("source"), "size"), weights, cap)
    m = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(cap)))
    targets = targets.withColumn("_base", F.floor(m)).withColumn("p", m - F.col("_base"))
    targets = staged(targets.withColumn("_rest", F.col("target") - F.col("_base") * F.col("source_size")).withColumnRenamed("source", "_s"), "mix-targets")

    on_source = F.col("_source").eqNullSafe(F.col("_s"))
    units = narrow.groupBy("_source", "_key", "_u").agg(F.sum("size").alias("size"))
    units = _with_rank(units.join(broadcast_if_small(targets), on_source))
    hist = units.where("p > 0").groupBy("_s", "_rest", "_bin").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    upto = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("words_before", F.coalesce(F.sum("words").over(upto), F.lit(0))).withColumn("n_before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    at_cut = hist.where(F.col("words_before") + F.col("words") > F.col("_rest")).groupBy("_s").agg(
        F.min(F.struct("_bin", "words_before", "n_before")).alias("c")
    )
    near = hist.join(at_cut.withColumnRenamed("_s", "_c"), F.col("_s").eqNullSafe(F.col("_c"))).where(
        (F.col("n_before") + F.col("n") > F.col("c.n_before") - ZONE) & (F.col("n_before") < F.col("c.n_before") + ZONE)
    )
    cuts = near.groupBy("_s").agg(
        F.min("_bin").alias("_from"), F.max("_bin").alias("_to"), F.max(F.col("_rest") - F.col("words_before")).alias("gap")
    )
    cuts = staged(targets.join(cuts.withColumnRenamed("_s", "_c"), F.col("_s").eqNullSafe(F.col("_c")), "left").drop("_c"), "mix-cuts")

    zone = _with_rank(narrow.groupBy("_source", "_key", "_u").agg(F.sum("size").alias("size")).join(broadcast_if_small(cuts), on_source))
    zone = zone.where("p > 0 AND _bin BETWEEN _from AND _to").select("_s", "_key", "_rank", "size", "gap")
    walked = staged(zone.groupBy("_s").applyInPandas(_fill, "_key long, _take boolean").where("_take"), "mix-zone")

    rows = _with_rank(ranked.join(broadcast_if_small(cuts), on_source))
    rows = rows.join(broadcast_if_small(walked), "_key", "left")
    # a source without a cut bin takes all of its sample's documents
    sampled = (F.col("p") > 0) & ((F.col("_bin") < F.col("_from")) | F.col("_from").isNull() | F.coalesce("_take", F.lit(False)))
    copies = (F.col("_base") + sampled.cast("long")).alias("copies")
    kept = [F.col(f"_all.`{c}`") for c in docs.columns if c not in ("size", "copies", "source_size", "target")]
    return rows.select(*kept, "size", "source_size", "target", copies)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: the columns of ``docs``, a row for each copy taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all")
    names = {k: options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    held = docs.select(row, *[F.col(v).alias(k) for k, v in names.items()])
    planned = plan_mix(held, **{**options, **{k: k for k in names}}).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return planned.select("all", copies).select(*[F.col(f"all.`{c}`") for c in docs.columns])
