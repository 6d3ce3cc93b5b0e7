"""Ordered helpers and runs against plain loops, with blocks far smaller than a key."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import chunking, runs, tables
from lectern.operators.ordered import block_of, carry_last, neighbours, positions, running_sums


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    # One key owns nearly everything; gaps in the order.
    sizes = {"hot": 900, "b": 9, "c": 1}
    return [(k, i * 3, rnd.randint(1, 9), rnd.random() < 0.1, rnd.choice([None, "x", "y"])) for k, n in sizes.items() for i in range(n)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k string, p long, size int, strong boolean, mark string").cache()


def folded(rows, begins):
    out, state = {}, {}
    for k, p, size, strong, _ in rows:
        start, acc = state.get(k, (None, 0))
        if start is None or begins(acc, size, strong):
            start, acc = p // 3, 0
        state[k] = (start, acc + size)
        out[(k, p)] = start
    return out


@pytest.mark.parametrize("block", [25, 64, 4096])
@pytest.mark.parametrize("rule", ["overflow", "filled"])
def test_runs_equal_fold(table, rows, rule, block):
    if rule == "overflow":
        jump, want = runs.overflow("size", 20, "strong"), folded(rows, lambda acc, size, strong: strong or acc + size > 20)
    else:
        jump, want = runs.filled("size", 20), folded(rows, lambda acc, size, strong: acc >= 20)
    marked = runs.mark_runs(table, ["k"], "p", jump, {"size": F.col("size"), "strong": F.col("strong")}, block)
    assert {(r.k, r.p): r.run_start for r in marked.collect()} == want


def test_constant_sizes_never_realign(spark):
    # Runs of three in blocks of 25: block borders fall inside runs at ever other places.
    df = spark.range(500).select(F.lit("k").alias("k"), F.col("id").alias("p"), F.lit(10).alias("size"))
    marked = runs.mark_runs(df, ["k"], "p", runs.overflow("size", 30), {"size": F.col("size")}, 31)
    assert marked.where(F.col("run_start") != F.col("p") - F.col("p") % 3).count() == 0


def test_run_of_any_length(spark):
    # Runs of 500 and of 301 rows in blocks of 31, beside keys that fit.
    sizes = [("k", i, 0) for i in range(500)] + [(None, i, 7 if i == 300 else 0) for i in range(900)] + [("s", i, 30) for i in range(90)]
    df = spark.createDataFrame(sizes, "k string, p long, size int")
    want, acc, start, before = {}, 0, 0, object()
    for k, p, size in sizes:
        if k != before or acc + size > 6:
            acc, start, before = 0, p, k
        acc += size
        want[k, p] = start
    marked = runs.mark_runs(df, ["k"], "p", runs.overflow("size", 6), {"size": F.col("size")}, 31)
    assert {(r.k, r.p): r.run_start for r in marked.collect()} == want


def plain_tables(rows):
    """First block of each merged table, by the rule of ``merge_tables``, one table after the other."""
    starts, i = {}, 0
    while i < len(rows):
        width, empty, last, rule = rows[i]["_cols"], rows[i]["_no_data"], rows[i]["_last_in"], rows[i]["_has_rule"]
        starts[i], j = i, i + 1
        while j < len(rows) and abs(rows[j]["_page"] - rows[i]["_page"]) <= 1:
            r = rows[j]
            apart = abs(width - r["_cols"])
            follows = last is not None and r["_first_no"] is not None and r["_first_no"] == last + 1
            if not ((apart <= 1 and (r["_cont"] or empty or follows)) or (apart <= 5 and r["_values"])):
                break
            width = max(width, r["_cols_rows"])
            if rule:
                empty = empty and r["_n_rows"] == 0
                last = r["_last_rows"] if r["_last_rows"] is not None else last
            starts[j] = i
            j += 1
        i = j
    return starts


def as_columns(rows):
    return {c: np.array([float("nan") if r[c] is None else r[c] for r in rows]) for c in rows[0]}


def table_rows(n, seed):
    rnd = random.Random(seed)
    number = lambda p: rnd.randrange(9) if rnd.random() < p else None
    coin = lambda p: rnd.random() < p
    return [
        {"_page": i // 7, "_cols": rnd.choice([2, 3, 3, 4, 9]), "_cols_rows": rnd.choice([2, 3, 4]), "_no_data": coin(0.3), "_has_rule": coin(0.7),
         "_last_in": number(0.8), "_last_rows": number(0.5), "_first_no": number(0.8), "_n_rows": rnd.randrange(3), "_values": coin(0.2), "_cont": coin(0.4)}
        for i in range(n)
    ]


def test_table_rule_equals_plain_fold():
    for seed in range(60):
        rows = table_rows(120, seed)
        nxt, _ = tables._continues(as_columns(rows))
        starts, at = {}, 0
        while at < len(rows):
            starts.update({j: at for j in range(at, int(nxt[at]))})
            at = int(nxt[at])
        assert starts == plain_tables(rows)


def test_table_of_twenty_thousand_parts(spark):
    n = 20_000
    parts = [(0, i, 1, f"| No | name |\n|---|---|\n| {i + 1} | x |") for i in range(n)] + [(0, n, 5, "| a | b |\n|---|---|\n| 9 | y |")]
    merged = tables.merge_tables(spark.createDataFrame(parts, "doc long, seq long, page long, text string"), ["doc"], "seq", "page").collect()
    assert sorted((r.seq, r.n_blocks) for r in merged) == [(0, n), (n, 1)]
    assert max(merged, key=lambda r: r.n_blocks).text.count("\n") == 2 * n  # a part adds its heading row and its data row
    # Linear: every block goes through a state once, not through all blocks behind it.
    rows = [{**r, "_page": 1, "_cols": 2, "_cols_rows": 2, "_cont": True} for r in table_rows(1, 1)] * 200_000
    begun = time.time()
    nxt, _ = tables._continues(as_columns(rows))
    assert (nxt == 200_000).all() and time.time() - begun < 60


def test_spans_of_a_dense_key(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_ROWS", 10)
    monkeypatch.setattr(runs, "DENSE_ROWS", 50)
    monkeypatch.setattr(runs, "RANGE_ROWS", 200)
    rnd = random.Random(4)
    dense = [("hot", t, rnd.random() < 0.01) for t in range(3000)] + [("hot", t, False) for t in sorted(rnd.sample(range(5000, 60000), 300))]
    times = dense + [(None, t, False) for t in range(0, 400)] + [("b", t * 90, t == 3) for t in range(30)]
    df = spark.createDataFrame(times, "k string, t long, lost boolean")
    groups, real = [], runs._ranged
    monkeypatch.setattr(runs, "_ranged", lambda *a: groups.append(real(*a)) or groups[-1])
    got = {(r.k, r.t): r.run_start for r in runs.mark_spans(df, ["k"], "t", 100, F.col("lost")).collect()}
    want, state = {}, {}
    for k, t, lost in times:
        start, unstored = state.get(k, (None, False))
        if start is None or unstored or t >= start + 100:
            start, unstored = t, lost
        state[k] = (start, unstored)
        want[k, t] = start
    assert got == want
    assert len(groups) == 2
    assert max(r["count"] for g in groups for r in g.groupBy("_part").count().collect()) <= 4 * 200


def test_spans_equal_fold(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_ROWS", 10)  # the heavy key is cut into stretches
    rnd = random.Random(3)
    times = sorted(rnd.sample(range(3000), 200)) + sorted(rnd.sample(range(9000, 12000), 100))
    df = spark.createDataFrame([("hot", t, t % 7 == 0) for t in times] + [("b", 5, False)], "k string, t long, lost boolean")
    got = {(r.k, r.t): r.run_start for r in runs.mark_spans(df, ["k"], "t", 100, F.col("lost")).collect()}
    want, start = {("b", 5): 5}, None
    for t in times:
        if start is None or start % 7 == 0 or t >= start + 100:
            start = t
        want[("hot", t)] = start
    assert got == want


def test_ordered_helpers_equal_windows(table):
    blk = block_of("p", 64)
    w = Window.partitionBy("k").orderBy("p")
    full = w.rowsBetween(Window.unboundedPreceding, 0)
    out = running_sums(table, {"total": F.col("size")}, ["k"], ["p"], blk)
    assert out.withColumn("w", F.sum("size").over(full)).where("total <> w").count() == 0
    out = positions(table, "n", ["k"], ["p"], blk)
    assert out.where("n <> p / 3").count() == 0
    out = carry_last(table, {"seen": F.col("mark")}, ["k"], ["p"], blk)
    assert out.withColumn("w", F.last("mark", True).over(full)).where("not (seen <=> w)").count() == 0
    out = neighbours(table, "p", "before", "behind", ["k"], ["p"], blk)
    out = out.withColumn("b", F.lag("p").over(w)).withColumn("a", F.lead("p").over(w))
    assert out.where("not (before <=> b) or not (behind <=> a)").count() == 0
    assert out.count() == table.count()


def test_running_sum_without_keys(spark):
    df = spark.range(1000).select(F.col("id").alias("p"), F.lit(2).alias("v"))
    out = running_sums(df, {"total": F.col("v")}, [], ["p"], block_of("p", 50))
    assert out.where("total <> 2 * (p + 1)").count() == 0


def test_packing_reads_its_sections_once(spark):
    """Texts are joined to the runs after these are decided; the steps before must not run again for that."""
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    rows = [("a", k, f"{k} " * (k % 40 + 1)) for k in range(300)]
    looked = F.udf(look, "string").asNondeterministic()
    sections = spark.createDataFrame(rows, "source string, section long, text string").withColumn("text", looked("text"))
    headed = sections.select("*", *[F.lit(None).cast("string").alias(h) for h in chunking.HEADINGS])
    merged = chunking.greedy_chunks(chunking.merge_short_sections(headed, ["source"], "section"), ["source"], "section").collect()
    assert seen.value == len(rows) and sum(len(r.text.split()) for r in merged) >= sum(k % 40 + 1 for k in range(300))


def test_rows_move_once_for_running_sums(spark, table):
    """One exchange of the rows, and three of the narrow sums of blocks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = running_sums(table, {"total": F.col("size")}, ["k"], ["p"], block_of("p", 64))
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
