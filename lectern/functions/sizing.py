"""Size checks and joins that hold when a few keys own most of the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of a query-side table that may be broadcast; larger tables take the other way.
BROADCAST_ROWS = 200_000
# Keys that are treated as hot in ``join_skewed``; any other key owns at most total / HOT_KEYS rows.
HOT_KEYS = 1000
SALTS = 256
# A core's share of a table that is worth moving to it.
SPLIT_BYTES = 1 << 20
# Rows of a task of ``dealt``, about.
TASK_ROWS = 2_000_000


def fits(df: DataFrame, rows: int) -> bool:
    """True when the table has at most ``rows`` rows; stops counting beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; beyond it the planner picks a shuffled join."""
    return F.broadcast(df) if fits(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out anew where a scan gives fewer splits than cores though it has some bytes for each of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_bytes = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if n_bytes >= cores * SPLIT_BYTES and df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows by key, in as many partitions as leave a task ``TASK_ROWS`` of at most ``rows`` rows; at least in the session's number of them."""
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def by_slices(table: DataFrame, key: str, rows: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``run`` over hash slices of ``table`` of about ``rows`` rows and union the results.

    A key stays in one slice, so results per key are whole.
    """
    if fits(table, rows):
        return run(table)
    n = -(-table.count() // max(rows // 2, 1))
    slice_of = F.pmod(F.xxhash64(key), F.lit(n))
    return reduce(DataFrame.unionByName, [run(table.where(slice_of == i)) for i in range(n)])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the result has the keys of ``left`` once."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    out = left.join(named, on, how).drop(*[f"_right_{k}" for k in keys])
    rest = [c for c in out.columns if c not in keys]
    return out.select(*keys, *rest)


def join_skewed(
    facts: DataFrame, dim: DataFrame, key: str, weight: str, spread_by: Column, keep_unmatched: bool = False
) -> DataFrame:
    """Join facts to a table that is unique on ``key`` and knows each key's fact count (``weight``).

    The ``HOT_KEYS`` heaviest keys are broadcast: exactly that many rows at most. By counting, every
    other key owns at most a thousandth of the facts, so those go through an ordinary shuffle; facts
    of hot keys are spread over salted keys there and keep the values found by the broadcast.
    """
    values = [c for c in dim.columns if c != key]
    hot = F.broadcast(
        dim.orderBy(F.desc(weight), key).limit(HOT_KEYS).select(key, F.struct(*values).alias("_hot"))
    )
    hot = hot.withColumnRenamed(key, "_hot_key")
    joined = facts.join(hot, F.col(key).eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")
    salted = F.struct(
        F.col(key).alias("k"),
        F.when(F.col("_hot").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int")).alias("s"),
    )
    cold = dim.select(F.struct(F.col(key).alias("k"), F.lit(-1).alias("s")).alias("_jk"), F.struct(*values).alias("_cold"))
    out = joined.withColumn("_jk", salted).join(cold, "_jk", "left")
    found = F.coalesce("_hot", "_cold")
    out = out.withColumn("_found", found)
    if not keep_unmatched:
        out = out.where(F.col("_found").isNotNull())
    return out.select(*facts.columns, *[F.col("_found")[v].alias(v) for v in values])
