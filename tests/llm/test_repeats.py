import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from fixtures import no_documents, odd_documents
from lectern.llm import repeats
from lectern.llm.shared import read


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, rows, length=200, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = repeats.remove_repeats(docs, length, **options).collect()
    want = [(r[0], *x) for r, x in zip(rows, plain([r[1] for r in rows], length))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.n_removed == sum(s.end - s.begin for s in r.spans) and r.kept_sha256 == hashlib.sha256(r.kept).hexdigest()


def test_borders_equal_plain_prefixes():
    rng = random.Random(2)
    for _ in range(40):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 8))]
        n = rng.randrange(1, 7)
        count = Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
        bits = repeats.repeated_starts(texts, [max(0, len(t) - n + 1) for t in texts], n)
        for t, own in zip(texts, bits):
            k = max(0, len(t) - n + 1)
            assert np.unpackbits(np.frombuffer(own, np.uint8), count=k).tolist() == [int(count[t[i : i + n]] > 1) for i in range(k)]


def joined(texts):
    out = []
    for k, t in enumerate(texts):
        out += [*t, 256 + k]
    return np.array(out)


def test_suffixes_are_in_order_and_only_ties_are_sorted_again(monkeypatch):
    rng = random.Random(3)
    for letters in (b"a", b"ab", bytes(range(256))):
        texts = [bytes(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 12))]
        symbols = joined([*texts, *texts[:3]])
        assert repeats.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda k: symbols[k:].tolist())
    sorted_keys = []
    by_key = repeats._by_key
    monkeypatch.setattr(repeats, "_by_key", lambda key, bits: sorted_keys.append(len(key)) or by_key(key, bits))
    symbols = joined([rng.randbytes(400) for _ in range(50)] + [b"x" * 50] * 2)
    assert repeats.suffix_array(symbols).tolist() == sorted(range(len(symbols)), key=lambda k: symbols[k:].tolist())
    assert sum(sorted_keys) < 1.1 * len(symbols)


@pytest.mark.parametrize("hot", [repeats.HOT, 1])
def test_random_passages(spark, hot):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice([word(), word(), rng.choice(passages)]) for _ in range(rng.randrange(0, 25)))) for i in range(60)]
    rows += [(100, "z" * 1500), (101, "ab" * 400), (102, "ab" * 300 + "c"), (3, rows[3][1]), (None, None), (103, ""), (104, passages[0] * 9)]
    same(spark, rows, hot=hot)


def test_small_tables(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    same(spark, [(r.doc_id, r.text) for r in docs.collect()])
    same(spark, [(r.doc_id, r.text) for r in odd_documents(spark).collect()])


def test_empty_table(spark):
    assert repeats.remove_repeats(no_documents(spark)).count() == 0


def test_few_wide_rows_are_not_broadcast(spark, monkeypatch):
    table = spark.range(4).selectExpr("id", "sequence(1, 1000) AS begins")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    size = repeats.F.size("begins") * 8
    assert hinted(repeats._broadcast_if_small(table, size))
    monkeypatch.setattr(repeats, "SMALL", 4 * 8000 - 1)
    assert not hinted(repeats._broadcast_if_small(table, size))


def test_shuffled_way_equals_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SMALL", 0)
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcdef ") for _ in range(260)) for _ in range(4)]
    rows = [(i, "".join(rng.choice([rng.choice(passages), "".join(rng.choice("xyz ") for _ in range(90))]) for _ in range(6))) for i in range(30)]
    same(spark, rows)
