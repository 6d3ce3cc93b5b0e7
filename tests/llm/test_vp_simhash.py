import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from fixtures import no_documents, odd_documents
from lectern.llm import vp_simhash as vp
from lectern.llm.groups import connected
from lectern.llm.shared import read
from pyspark.sql import functions as F


def plain_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, distance=4):
    """Lowest index that each fingerprint reaches, comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    prints = [plain_print(t) for _, t in rows]
    roots = plain_roots(prints)
    low, size = {}, {}
    for (doc, _), root in zip(rows, roots):
        size[root] = size.get(root, 0) + 1
        low[root] = min((x for x in (low.get(root), doc) if x is not None), default=None)
    want = [(doc, f"{p:016x}", low[r], size[r]) for (doc, _), p, r in zip(rows, prints, roots)]
    got = [tuple(r) for r in vp.components(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def near_copies(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(300)]
    out = []
    for i in range(n):
        text = list(base) if i % 3 else [rng.choice(words) for _ in range(60)]
        for _ in range(i % 7):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append((i * 2, " ".join(text)))
    return out


def test_odd_rows(spark):
    check(odd_documents(spark, ("ONE two", "one TWO", "a b c", "İ ß Ω", "\x1c\x85 x")))


def test_given_table(spark):
    check(read(spark, "/root/testdata/sf0.001", "documents"))


def test_empty_table(spark):
    assert vp.components(no_documents(spark)).count() == 0


def test_near_copies(spark):
    check(spark.createDataFrame(near_copies(240), "doc_id long, text string"))


def test_hash_is_that_of_the_engine(spark):
    (row,) = spark.sql("SELECT xxhash64('one two three four') AS h").collect()
    assert vp.shingle_hashes(b"One two\tTHREE  four").view(np.int64).tolist() == [row.h]


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_tree_finds_all_values_within_the_radius(radius):
    rng = np.random.default_rng(3)
    for values in (rng.permutation(1 << 16)[:900], np.array([7]), np.arange(1 << 10), np.array([1 << i for i in range(16)] * 1)):
        values = np.unique(values).astype(np.uint16)
        q, v = vp.search_tree(vp.build_tree(rng.permutation(values), leaf=8), values, radius)
        want = {(int(a), int(b)) for a in values for b in values if (int(a) ^ int(b)).bit_count() <= radius}
        assert len(q) == len(want) and set(zip(q.tolist(), v.tolist())) == want


def test_triangle_bound_prunes():
    values = np.arange(1 << 16, dtype=np.uint16)
    nodes = vp.build_tree(np.random.default_rng(0).permutation(values))
    q, _ = vp.search_tree(nodes, values[:64], 1)
    assert len(q) == 64 * 17
    assert max(len(n[0]) for n in nodes if len(n) == 1) <= vp.LEAF


def planted(seed, n, bits):
    """Fingerprints in chains and balls around some centres, and others on their own."""
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, bits)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def check_links(spark, prints, distance):
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = vp.links(spark.createDataFrame([(s,) for s in signed], "fp long"), distance).collect()
    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
    groups = {}
    root = {s: s for s in signed}
    for node, r in connected(spark.createDataFrame(found, "a long, b long") if found else spark.createDataFrame([], "a long, b long")).collect():
        root[node] = r
    for s, r in root.items():
        groups.setdefault(r, set()).add(s)
    want = {}
    for s, r in zip(signed, plain_roots(prints, distance)):
        want.setdefault(r, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    return found


@pytest.mark.parametrize("distance", [0, 3, 4, 7])
def test_links_connect_what_all_pairs_connect(spark, distance):
    check_links(spark, planted(distance, 120, distance + 2), distance)


def test_hot_shard_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vp, "TILE", 16)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(500)}
    found = check_links(spark, sorted(ball | set(planted(9, 30, 5))), 4)
    assert len(found) < 40 * len(ball)  # not all pairs


def test_large_and_small_tiles_agree():
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    prints = np.unique(centre ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))).view(np.int64)
    one_tile = pa.table({"tile": np.zeros(len(prints), dtype=np.int64), "fp": prints, "role": np.full(len(prints), 2, dtype=np.int32)})
    assert len(vp.shard_links(one_tile, 4)) == len(prints) - 1
    assert len(vp.shard_links(one_tile.slice(0, 0), 4)) == 0


def test_copies_are_one_row_in_the_search(spark):
    docs = spark.createDataFrame([(i, "the very same text of some words") for i in range(3000)] + [(None, None)] * 500, "doc_id long, text string")
    got = vp.components(docs).groupBy("fingerprint", "component_id", "component_rows").agg(F.count("*").alias("n")).collect()
    assert sorted((r.component_id is None, r.component_rows, r.n) for r in got) == [(False, 3000, 3000), (True, 500, 500)]
