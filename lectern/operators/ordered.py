"""Ordered computations inside a key that may own a large share of all rows.

A plain window over the key would sort all its rows in one task. Here each key is cut into blocks of
neighbouring rows. The first level works inside a block, the second over one summary row per block, and
both are joined back on (key, block). ``block`` must not decrease along ``order`` and bounds the rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def block_of(position: str | Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of an integer position."""
    col = F.col(position) if isinstance(position, str) else position
    return F.floor(col / F.lit(rows)).cast("bigint")


def _key_cols(keys: Sequence[str]) -> list:
    return [F.col(k) for k in keys] or [F.lit(0)]


def _in_blocks(df: DataFrame, keys: Sequence[str], block: Column) -> DataFrame:
    """Add ``_blk``, and ``_own``, key and block as one value: null keys are equal in it, so windows and the join back need one exchange."""
    return df.withColumn("_blk", block).withColumn("_own", F.struct(*keys, "_blk"))


def _join_back(df: DataFrame, per_block: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = per_block.withColumn("_block", F.struct(*keys, "_blk")).drop(*keys, "_blk")
    return df.join(right, F.col("_own") == F.col("_block"), "left").drop("_own", "_block")


def running_sums(
    df: DataFrame, sums: dict[str, Column], keys: Sequence[str], order: Sequence[str], block: Column
) -> DataFrame:
    """Add inclusive running sums along ``order`` within ``keys`` (no keys: over the whole table)."""
    cols = df.columns
    base = _in_blocks(df, keys, block)
    inside = Window.partitionBy("_own").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = (
        Window.partitionBy(*_key_cols(keys)).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = base.groupBy(*keys, "_blk").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    offsets = totals.select(
        *keys, "_blk", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    local = base.select("*", *[F.sum(v).over(inside).alias(f"_i_{n}") for n, v in sums.items()])
    joined = _join_back(local, offsets, keys)
    return joined.select(*cols, *[(F.col(f"_i_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def positions(df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """Add a dense 0-based position along ``order`` within ``keys``."""
    out = running_sums(df, {name: F.lit(1)}, keys, order, block)
    return out.withColumn(name, (F.col(name) - 1).cast("bigint"))


def carry_last(
    df: DataFrame, values: dict[str, Column], keys: Sequence[str], order: Sequence[str], block: Column
) -> DataFrame:
    """Add the last non-null value seen so far along ``order`` within ``keys``."""
    cols = df.columns
    base = _in_blocks(df, keys, block).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    at = F.struct(*order)
    inside = Window.partitionBy("_own").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = (
        Window.partitionBy(*_key_cols(keys)).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    lasts = base.groupBy(*keys, "_blk").agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_l_{n}") for n in values]
    )
    carried = lasts.select(
        *keys, "_blk", *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in values]
    )
    local = base.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_i_{n}") for n in values])
    joined = _join_back(local, carried, keys)
    return joined.select(*cols, *[F.coalesce(f"_i_{n}", f"_c_{n}").alias(n) for n in values])


def neighbours(
    df: DataFrame, value: str, previous: str, following: str, keys: Sequence[str], order: Sequence[str], block: Column
) -> DataFrame:
    """Add the value of the row before and of the row behind along ``order`` within ``keys``."""
    cols = df.columns
    base = _in_blocks(df, keys, block)
    at = F.struct(*order)
    inside = Window.partitionBy("_own").orderBy(*order)
    across = Window.partitionBy(*_key_cols(keys)).orderBy("_blk")
    edges = base.groupBy(*keys, "_blk").agg(F.min_by(value, at).alias("_lo"), F.max_by(value, at).alias("_hi"))
    edges = edges.select(
        *keys, "_blk", F.lag("_hi").over(across).alias("_before"), F.lead("_lo").over(across).alias("_behind")
    )
    local = base.select("*", F.lag(value).over(inside).alias("_p"), F.lead(value).over(inside).alias("_n"))
    joined = _join_back(local, edges, keys)
    return joined.select(
        *cols, F.coalesce("_p", "_before").alias(previous), F.coalesce("_n", "_behind").alias(following)
    )
