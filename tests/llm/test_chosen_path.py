import random

import numpy as np
import pytest

import __spark_entry__ as entry
from compare import compare, connection
from fixtures import no_documents, odd_documents
from lectern.llm import chosen_path as cp
from lectern.llm.groups import connected


def plain(rows, threshold=0.8, n=5):
    def grams(t):
        w = (t or "").lower().encode().split()
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    sets = {t: grams(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] and len(sets[t] & sets[u]) >= threshold * len(sets[t] | sets[u])] for t in texts}
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    out = []
    for i, t in rows:
        seen, todo = {t or ""}, [t or ""]
        while todo:
            for u in links[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        out.append((i, low([x for s in seen for x in texts[s]]), len(links[t or ""]), low(texts[t or ""])))
    return out


def mutated(rng, words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


key = lambda x: tuple((v is None, v or 0) for v in x)


@pytest.mark.parametrize("leaf, tile", [(64, 384), (3, 4)])
def test_links_equal_brute_force(spark, leaf, tile):
    rng = random.Random(4)
    rows, i = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 3, 20])):
            rows.append((i, mutated(rng, base, rng.choice([0, 0, 1, 2, 3]))))
            i += 1
    rows += [(r.doc_id, r.text) for r in odd_documents(spark).select("doc_id", "text").collect() if r.doc_id is None or r.doc_id > 99]
    rows += [(900, None), (901, ""), (902, " "), (903, "A b"), (904, "a  B"), (900, None), (None, "only text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.class_id, r.n_links, r.text_class) for r in cp.jaccard_classes(docs, leaf=leaf, tile=tile).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert compare(spark, sf, entry.queries()["op7_chosen_path_join"], entry.oracle_sql()["op7_chosen_path_join"], connection(sf)) == ""


def test_one_of_each_class_stays(spark):
    docs = odd_documents(spark)
    kept = cp.keep_first(docs)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    classes = {c for _, c, _, _ in plain([(r.doc_id, r.text) for r in docs.collect()]) if c is not None}
    assert got == sorted(classes)


def test_connected_groups(spark):
    rng = np.random.default_rng(0)
    links = [(k, k + 1) for k in range(0, 200)] + [(1000, x) for x in range(1001, 1100)] + [(x, y) for x, y in rng.integers(2000, 2300, (150, 2)).tolist()]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for p in links for x in p}
    while True:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not moved:
            break
    of = {}
    for node, root in got.items():
        assert of.setdefault(root, label[node]) == label[node]
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == linked and len(of) == len({label[x] for x in linked})


def test_empty_table(spark):
    assert cp.jaccard_classes(no_documents(spark)).count() == cp.keep_first(no_documents(spark)).count() == 0


def test_classes_with_repeated_and_null_ids(spark):
    rng = random.Random(8)
    a, b, c, d = ([f"{x}{rng.randrange(3000)}" for _ in range(60)] for x in "abcd")
    near = [mutated(rng, c, 1), mutated(rng, c, 1)]
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join(b)), (None, near[0]), (None, near[1]), (None, " ".join(c)), (None, " ".join(d))]
    kept = cp.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = sorted(r.text[0] for r in kept)
    assert texts == ["a", "b", "c", "d"] and [r.doc_id for r in kept if r.text[0] in "ab"] == [7, 7]


def test_runs_and_sketches_keep_the_recall():
    from math import ceil, comb

    t, k = cp.COORDINATES, ceil((cp.THRESHOLD - cp.MARGIN) * cp.COORDINATES)
    by_sketch = sum(comb(t, x) * cp.THRESHOLD**x * (1 - cp.THRESHOLD) ** (t - x) for x in range(k))
    by_runs = (1 - cp.THRESHOLD**2) ** cp.runs_for()
    assert by_sketch + by_runs <= 1 - cp.RECALL
