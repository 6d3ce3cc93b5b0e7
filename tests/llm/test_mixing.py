from collections import defaultdict

from pyspark.sql import functions as F

from fixtures import no_documents, odd_documents
from lectern.llm import mixing
from lectern.llm.shared import read

SF = "/root/testdata/sf0.01"


def filled(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight, cut and reshared in rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > cap * sizes[s]]
        if not over:
            target.update({s: w[s] * level for s in open_})
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1, "c": 200, None: 5, "d": 0}, {"x": 7}, {str(i): 3**i for i in range(9)}, {"a": 0, None: 0}):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = filled(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), (sizes, got, want)


def test_taken_words_near_target(spark):
    rows = mixing.plan_mix(read(spark, SF, "documents")).collect()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        assert 0 <= r.copies <= 3 and r.size == len(r.text.encode().split())
        taken[r.source] += r.copies * r.size
        size[r.source] += r.size
        target[r.source] = r.target
    want = filled(size)
    for s in want:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 50), s


def test_sample_is_fair(spark):
    """Over many seeds each document of a source is taken about as often as its probability says."""
    df = spark.createDataFrame([(i, "w " * 10, "s" if i < 40 else "t") for i in range(100)], "doc_id long, text string, source string")
    seen, n = defaultdict(int), 12
    for seed in range(n):
        for r in mixing.plan_mix(df, seed=seed).where("source = 't'").collect():
            seen[r.doc_id] += r.copies
    mean = sum(seen.values()) / n / 60
    assert abs(mean - (2 / 3 * 1000) / 600) < 0.02
    assert len({seen[i] for i in range(40, 100)}) > 1


def test_same_every_time_and_mixed_rows(spark):
    docs = odd_documents(spark)
    a, b = (sorted(map(str, mixing.plan_mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert a == b and len(a) == docs.count()
    planned = mixing.plan_mix(docs)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() == planned.agg(F.sum("copies")).first()[0]
    assert planned.where("copies > 3 OR size IS NULL").count() == 0


def test_clashing_columns_pass_through(spark):
    names = ["p", "gap", "_take", "_s", "_key", "_copy", "_all", "_u", "size", "copies", "a.b"]
    docs = odd_documents(spark)
    extra = docs.select(*[F.col(c) for c in docs.columns if c not in names], *[F.lit(k).alias(c) for k, c in enumerate(names)])
    mixed = mixing.mix(extra)
    assert mixed.columns == extra.columns and mixed.count() == mixing.mix(docs).count() > 0
    assert all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in mixed.collect())
    planned = mixing.plan_mix(extra).collect()
    assert all((r["p"], r["gap"], r["_take"], r["_s"], r["_key"], r["_copy"]) == (0, 1, 2, 3, 4, 5) for r in planned)


def test_empty_table(spark):
    assert mixing.plan_mix(no_documents(spark)).count() == 0
    assert mixing.mix(no_documents(spark)).count() == 0
