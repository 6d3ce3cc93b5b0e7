"""Cut ordered rows into runs, where a run's end depends on where it began.

Greedy packing and "expires after" rules are such folds: from a given first row the end of the run is
known, but the first row is only known once all earlier runs are. The fold is made parallel in blocks:

1. each block (with the block before and the block behind it) works out, for every row at which a run can
   enter it, where that run chain leaves the block: a few transition rows per block;
2. the transitions of a key are walked from its first row: one small row set per key;
3. each block, now told where the chain enters, marks its run starts.

So no task ever holds more than three blocks of a key, and only the transitions of a key meet in one task.
Keys that fit one block, usually nearly all, go straight to step 3. Python sees bundles of many blocks at once.

A run may have any length: keys with a run that leaves the rows in sight are done again with blocks eight times as long. Such a run
is put together to one row in the end, so the narrow columns of its block are not what limits it. Rules of time spans make no such row: keys
that are dense in time take another way there (``_dense_spans``), whose groups are bounded whatever the density.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.sizing import broadcast_if_small, join_null_safe, join_skewed
from lectern.operators.ordered import BLOCK_ROWS, block_of, carry_last, positions
from lectern.session import staged

NONE = -(2**63)  # stands for "no row" in bigint columns of the helper tables

# A jump takes the columns of ordered rows and gives, for each row taken as the first of a run, the index of
# the first row of the next run, and whether that is certain from these rows alone.
Columns = dict[str, np.ndarray]
Jump = Callable[[Columns], tuple[np.ndarray, np.ndarray]]

BUNDLE_ROWS = 50_000
LONGER = 8  # how much longer the blocks of the next try are
DENSE_ROWS = 100_000  # rows of a key in a stretch of two spans beyond which its spans are found by doubling
RANGE_ROWS = 50_000  # rows of a range partition there


def _next_forced(forced: np.ndarray) -> np.ndarray:
    """For each index the nearest later index that must begin a run."""
    n = len(forced)
    at = np.append(np.flatnonzero(forced), n)
    return at[np.searchsorted(at, np.arange(n), side="right")]


def overflow(size: str, limit: int, forced: str | None = None) -> Jump:
    """A run ends before the row that would take its total above ``limit``, or before a forced row."""

    def jump(cols: Columns) -> tuple[np.ndarray, np.ndarray]:
        n = len(cols[size])
        total = np.concatenate([[0], np.cumsum(cols[size].astype(np.int64))])
        nxt = np.searchsorted(total, total[:-1] + limit, side="right") - 1
        nxt = np.minimum(np.maximum(nxt, np.arange(n) + 1), n)
        if forced is not None:
            nxt = np.minimum(nxt, _next_forced(cols[forced].astype(bool)))
        return nxt, nxt < n

    return jump


def filled(size: str, limit: int) -> Jump:
    """A run ends behind the row that takes its total to ``limit``."""

    def jump(cols: Columns) -> tuple[np.ndarray, np.ndarray]:
        n = len(cols[size])
        total = np.concatenate([[0], np.cumsum(cols[size].astype(np.int64))])
        end = np.searchsorted(total, total[:-1] + limit, side="left")
        return np.minimum(end, n), end <= n

    return jump


def elapsed(at: str, span: int, unstored: str | None = None) -> Jump:
    """A run ends before the first row at least ``span`` later; an unstored first row is a run of its own."""

    def jump(cols: Columns) -> tuple[np.ndarray, np.ndarray]:
        t = cols[at].astype(np.int64)
        n = len(t)
        nxt = np.searchsorted(t, t + span, side="left")
        if unstored is not None:
            nxt = np.where(cols[unstored].astype(bool), np.arange(n) + 1, nxt)
        return nxt, np.ones(n, dtype=bool)

    return jump


def mark_runs(
    df: DataFrame, keys: Sequence[str], order: str | Sequence[str], jump: Jump, features: dict[str, Column], block_rows: int = BLOCK_ROWS,
    order_span: int | None = None,
) -> DataFrame:
    """Add ``pos``, the dense position of a row in its key, and ``run_start``, the position its run begins at.

    ``order`` is a bigint column that is unique in the key, or several that are together; ``features`` are the values the jump reads. Where
    the (first) column has wide gaps or holds several rows, ``order_span`` is the stretch of it that holds about ``block_rows`` rows.
    """
    orders = [order] if isinstance(order, str) else list(order)
    slim = staged(df.select(*keys, *orders, *[c.alias(n) for n, c in features.items()]), "runs")
    placed = staged(positions(slim, "pos", keys, orders, block_of(orders[0], order_span or block_rows)), "runs")
    marks = _marks_of_any_length(placed.drop(*orders), keys, jump, block_rows)
    named = join_null_safe(marks, placed.select(*keys, *orders, "pos"), [*keys, "pos"])
    # Stored, so that a caller who reads the result twice does not run the fold twice.
    return join_null_safe(df, staged(named, "runs"), [*keys, *orders])


def _marks_of_any_length(placed: DataFrame, keys: Sequence[str], jump: Jump, block_rows: int) -> DataFrame:
    marks, stuck = _marks(placed, keys, "pos", block_of("pos", block_rows), jump)
    if stuck is None:
        return marks
    again = join_null_safe(placed, broadcast_if_small(stuck), list(keys))
    return marks.unionByName(_marks_of_any_length(staged(again, "runs"), keys, jump, block_rows * LONGER))


def mark_spans(df: DataFrame, keys: Sequence[str], at: str, span: int, unstored: Column | None = None) -> DataFrame:
    """Add ``run_start``: the time (bigint, unique in the key) at which the row's run of ``span`` began."""
    keys = list(keys)
    flag = F.lit(False) if unstored is None else unstored
    slim = staged(df.select(*keys, at, flag.alias("_unstored")), "spans")
    # Keys with few rows are one block; the others are cut into stretches of two spans.
    stretch = F.floor(F.col(at) / (2 * span))
    keyed = slim.withColumn("_key", F.struct(*keys))
    parts = keyed.groupBy("_key", stretch.alias("_s")).agg(F.count("*").alias("_rows"))
    counts = staged(parts.groupBy("_key").agg(F.sum("_rows").alias("_rows"), F.max("_rows").alias("_densest")), "spans")
    sized = join_skewed(keyed, counts, "_key", "_rows", F.col(at)).drop("_key")
    block = F.when(F.col("_rows") <= BLOCK_ROWS, F.lit(0)).otherwise(stretch)
    sparse = F.col("_densest") <= DENSE_ROWS
    marks, _ = _marks(sized.where(sparse).drop("_densest"), keys, at, block, elapsed(at, span, "_unstored"))
    if counts.where(~sparse).limit(1).count():
        marks = marks.unionByName(_dense_spans(sized.where(~sparse).drop("_densest", "_rows"), keys, at, span))
    return join_null_safe(df, staged(marks, "spans"), [*keys, at])


def _ranged(df: DataFrame, n_rows: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_part``, the number of a row's range partition along (keys, order); parts are about ``RANGE_ROWS`` long however rows lie."""
    parts = max(1, -(-n_rows // RANGE_ROWS))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return staged(ranged.withColumn("_part", F.spark_partition_id().cast("bigint")), "ranges")


def _dense_spans(slim: DataFrame, keys: Sequence[str], at: str, span: int) -> DataFrame:
    """(*keys, at, run_start) by pointer doubling; ``slim`` is (*keys, at, _unstored).

    Each row gets the time at which the next run begins if one begins here: the first event a span later. What is reached from a key's first
    event along 1, 2, 4, ... such steps are the starts; joins are by (keys, time), which is unique. Order matters in ranges of rows only.
    """
    keys = list(keys)
    slim = staged(slim, "dense")
    n_rows = slim.count()
    ahead = F.when(F.col("_unstored"), F.col(at) + 1).otherwise(F.col(at) + span)
    # Backwards in time: the last event seen by a probe is the first one at or after it; an event stands before a probe of its time.
    events = slim.select(*keys, (-F.col(at)).alias("_back"), F.lit(0).alias("_kind"), F.col(at).alias("_event"), F.lit(None).cast("bigint").alias("_from"))
    probes = slim.select(*keys, (-ahead).alias("_back"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_event"), F.col(at).alias("_from"))
    both = _ranged(events.unionByName(probes), 2 * n_rows, keys, ["_back", "_kind", "_from"])
    seen = carry_last(both, {"_next": F.col("_event")}, keys, ["_back", "_kind", "_from"], F.col("_part"))
    steps = staged(seen.where("_kind = 1").select(*keys, F.col("_from").alias("_t"), "_next"), "dense-steps")
    starts = staged(slim.groupBy(*keys).agg(F.min(at).alias("_t")), "dense-starts")
    n_starts = starts.count()
    while True:
        # What is reached so far, and all that a step leads to from there.
        onward = join_null_safe(starts, steps, [*keys, "_t"]).where(F.col("_next").isNotNull()).select(*keys, F.col("_next").alias("_t"))
        starts = staged(starts.unionByName(onward).distinct(), "dense-starts")
        found = starts.count()
        if found == n_starts:
            break
        n_starts = found
        # Steps twice as long.
        behind = steps.select(*keys, F.col("_t").alias("_next"), F.col("_next").alias("_after"))
        steps = staged(join_null_safe(steps.where(F.col("_next").isNotNull()), behind, [*keys, "_next"]).select(*keys, "_t", F.col("_after").alias("_next")), "dense-steps")
    marked = starts.select(*keys, F.col("_t").alias(at), F.col("_t").alias("_start"))
    placed = _ranged(join_null_safe(slim.select(*keys, at), marked, [*keys, at], "left"), n_rows, keys, [at])
    return carry_last(placed, {"run_start": F.col("_start")}, keys, [at], F.col("_part")).select(*keys, at, "run_start")


def _groups(pdf: pd.DataFrame, by: list[str], order: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Rows sorted by group and order, and the bounds of the groups."""
    code = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    place = np.lexsort((pdf[order].to_numpy(), code))
    code = code[place]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
    return pdf.iloc[place].reset_index(drop=True), bounds


def _marks(slim: DataFrame, keys: Sequence[str], order: str, block: Column, jump: Jump) -> tuple[DataFrame, DataFrame | None]:
    """(*keys, order, run_start) for a narrow stored table, and the keys left out, whose blocks are too short for a run.

    ``block`` must not decrease along ``order``.
    """
    keys = list(keys)
    slim = slim.withColumn("_blk", block)
    features = [c for c in slim.columns if c not in (*keys, "_blk")]
    bundles = max(1, slim.count() // BUNDLE_ROWS)
    along = Window.partitionBy(*keys).orderBy("_blk")
    whole = Window.partitionBy(*keys)
    blocks = (
        slim.groupBy(*keys, "_blk")
        .agg(F.min(order).alias("_lo"))
        .select(
            *keys,
            "_blk",
            "_lo",
            F.row_number().over(along).alias("_b"),
            F.lead("_lo", 2).over(along).alias("_after"),
            (F.count("*").over(whole) == 1).alias("_single"),
        )
    )
    blocks = staged(blocks, "blocks")
    rows = join_null_safe(slim, blocks, [*keys, "_blk"]).drop("_blk", "_lo")
    key_fields = [slim.schema[k] for k in keys]

    def in_bundles(df: DataFrame, by: list[str], run, schema: T.StructType) -> DataFrame:
        bundled = df.withColumn("_g", F.pmod(F.xxhash64(*by), F.lit(bundles)))
        return bundled.groupBy("_g").applyInPandas(run, schema)

    # _d = 0: the block's own row; 1: seen by the block behind it; -1: seen by the block before it.
    sides = F.when(F.col("_b") > 1, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    around = rows.where(~F.col("_single")).withColumn("_d", F.explode(sides)).withColumn("_b", F.col("_b") + F.col("_d"))
    steps_schema = T.StructType(
        key_fields
        + [
            T.StructField("_b", T.IntegerType()),
            T.StructField("enter", T.LongType()),
            T.StructField("leave", T.LongType()),
            T.StructField("opened", T.LongType()),
            T.StructField("sure", T.BooleanType()),
        ]
    )

    def block_steps(cols: Columns, place: np.ndarray, after) -> list[tuple[int, int, int, bool]]:
        own = np.flatnonzero(place == 0)
        if len(own) == 0:  # the slot behind the last block holds only rows to look back at
            return []
        first, end, n = int(own[0]), int(own[-1]) + 1, len(place)
        nxt, sure = jump(cols)
        at = cols[order]
        # Past the rows in sight: the first row of the block after next, if the chain must end there.
        nothing_more = after == NONE
        leave = np.empty(n, dtype=np.int64)
        opened = np.empty(n, dtype=np.int64)
        known = np.empty(n, dtype=bool)
        for i in range(end - 1, first - 1, -1):
            j = nxt[i]
            if j < end:
                leave[i], opened[i], known[i] = leave[j], opened[j], known[j]
            else:
                leave[i] = at[j] if j < n else after
                opened[i] = at[i]
                known[i] = sure[i] or nothing_more
        entered = nxt[:first]
        enters = np.unique(np.append(entered[(entered >= first) & (entered < end)], first))
        return [(int(at[i]), int(leave[i]), int(opened[i]), bool(known[i])) for i in enters]

    def transitions(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, bounds = _groups(pdf, [*keys, "_b"], order)
        cols = {f: pdf[f].to_numpy() for f in features}
        place = pdf["_d"].to_numpy()
        after = pdf["_after"].fillna(NONE).astype("int64").to_numpy()
        at_row, found = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = lo + int(np.argmax(place[lo:hi] == 0))
            steps = block_steps({f: c[lo:hi] for f, c in cols.items()}, place[lo:hi], after[own])
            at_row += [own] * len(steps)
            found += steps
        out = pdf[[*keys, "_b"]].iloc[at_row].reset_index(drop=True)
        table = np.array(found, dtype=object).reshape(-1, 4)
        for i, name in enumerate(("enter", "leave", "opened")):
            out[name] = table[:, i].astype(np.int64)
        out["sure"] = table[:, 3].astype(bool)
        return out

    steps = in_bundles(around, [*keys, "_b"], transitions, steps_schema)
    entries_schema = T.StructType(
        key_fields
        + [
            T.StructField("_b", T.IntegerType()),
            T.StructField("_enter", T.LongType()),
            T.StructField("_open", T.LongType()),
            T.StructField("_stuck", T.BooleanType()),
        ]
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_b", "enter"])
        parts = []
        for _, one in pdf.groupby(keys, sort=False, dropna=False):
            table = dict(zip(one["enter"], zip(one["_b"], one["leave"], one["opened"], one["sure"])))
            current, opened, stuck = one["enter"].iloc[0], NONE, False
            found = []
            for b in one["_b"].unique():
                inside = current != NONE and table[current][0] == b
                found.append((b, current if inside else NONE, opened))
                if inside:
                    _, leave, last, sure = table[current]
                    if not sure:
                        stuck = True
                        break
                    opened, current = last, leave
            part = pd.DataFrame(found, columns=["_b", "_enter", "_open"])
            part["_stuck"] = stuck
            for k in keys:
                part[k] = one[k].iloc[0]
            parts.append(part)
        return pd.concat(parts, ignore_index=True)[[f.name for f in entries_schema.fields]]

    alone = blocks.where("_single").select(*keys, "_b", F.col("_lo").alias("_enter"), F.lit(NONE).alias("_open"))
    entries, stuck = alone, None
    if blocks.where(~F.col("_single")).limit(1).count():
        walked = staged(in_bundles(steps, keys, walk, entries_schema), "walks")
        left_out = walked.where("_stuck").select(*keys).distinct()
        stuck = left_out if left_out.limit(1).count() else None
        entries = walked.where("NOT _stuck").drop("_stuck").unionByName(alone)
    marked_schema = T.StructType(key_fields + [slim.schema[order], T.StructField("run_start", T.LongType())])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, bounds = _groups(pdf, [*keys, "_b"], order)
        cols = {f: pdf[f].to_numpy() for f in features}
        enters, opens = pdf["_enter"].to_numpy(), pdf["_open"].to_numpy()
        run = np.empty(len(pdf), dtype=np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            part = {f: c[lo:hi] for f, c in cols.items()}
            nxt, _ = jump(part)
            at, n = part[order], hi - lo
            begins = np.zeros(n, dtype=bool)
            if enters[lo] != NONE:
                i = int(np.searchsorted(at, enters[lo]))
                while i < n:
                    begins[i] = True
                    i = int(nxt[i])
            latest = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
            run[lo:hi] = np.where(latest >= 0, at[np.maximum(latest, 0)], opens[lo])
        out = pdf[[*keys, order]].copy()
        out["run_start"] = run
        return out

    return in_bundles(join_null_safe(rows.drop("_after", "_single"), entries, [*keys, "_b"]), [*keys, "_b"], mark, marked_schema), stuck
