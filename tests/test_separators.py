"""The separator-aware cut: against whole-list merging, on its edges, and by its own bounds."""

import random

import pytest
from lectern.functions import separators as sep


def plain(text, size, overlap, length, seps):
    """The same rule by recursion over whole lists."""
    at = next((i for i, s in enumerate(seps) if not s or s in text), len(seps) - 1)
    mark, more = seps[at], seps[at + 1 :]
    parts = list(text) if not mark else [p for k, x in enumerate(text.split(mark)) for p in [mark * (k > 0) + x] if p]
    out, run = [], []

    def join():
        lo = 0
        while lo < len(run):
            hi = lo + 1
            while hi < len(run) and sum(map(length, run[lo : hi + 1])) <= size:
                hi += 1
            out.append("".join(run[lo:hi]))
            if hi == len(run):
                break
            while lo < hi and (sum(map(length, run[lo:hi])) > overlap or sum(map(length, run[lo : hi + 1])) > size):
                lo += 1
        run.clear()

    for part in parts:
        if length(part) < size or not more:
            run.append(part)
        else:
            join()
            out += plain(part, size, overlap, length, more)
    join()
    return out


def made(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["word", "a", "数据", "x" * rng.randrange(1, 40), "\n\n", "\n", "。", "；", "，", " ", " ", " "]) for _ in range(rng.randrange(120)))


@pytest.mark.parametrize("size, overlap", [(20, 5), (60, 0), (7, 6), (1, 0), (200, 40)])
@pytest.mark.parametrize("unit", ["chars", "words"])
def test_equals_plain_recursion(size, overlap, unit):
    if unit == "words" and size == 1:
        return
    length = sep.SIZES[unit]
    for seed in range(150):
        text = made(seed)
        want = [c.strip(sep.BLANKS) for c in plain(text, size, overlap, length, sep.SEPARATORS)] if text else []
        assert list(sep.cut(text, size, overlap, length)) == [c for c in want if c], seed


def test_chunks_are_short_and_lose_nothing():
    for seed in range(200):
        text = made(seed)
        chunks = list(sep.cut(text, 50, 10))
        assert all(0 < len(c) <= 50 for c in chunks)
        at = 0
        for c in chunks:  # each chunk is in the text, not before the one before it
            found = text.find(c, max(0, at - 60))
            assert found >= 0
            at = found
        if not text.strip(sep.BLANKS):
            assert not chunks


def test_strong_separators_first():
    assert list(sep.cut("aa bb\ncc dd\n\nee ff", 12, 0)) == ["aa bb\ncc dd", "ee ff"]
    assert list(sep.cut("aa bb\ncc dd\n\nee ff", 8, 0)) == ["aa bb", "cc dd", "ee ff"]
    assert list(sep.cut("一二三。四五六；七八九", 5, 0)) == ["一二三", "。四五六", "；七八九"]
    assert list(sep.cut("x" * 25, 10, 3)) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]


def test_odd_rows(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, " \n", None), (None, "some words here", "k"), (4, "w " * 30_000, None), (4, "w " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk_index string")
    got = sep.separator_chunks(docs.drop("chunk_index"), ["doc_id"], 100, 20).collect()
    assert {r.doc_id for r in got} == {None, 4}
    own = [r for r in got if r.doc_id == 4]
    assert len(own) == 2 * own[0].n_chunks and all(len(r.text) <= 100 for r in own)
    assert sep.separator_chunks(docs.limit(0), ["doc_id"]).count() == 0


def test_what_comes_out_of_a_batch_leaves_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} " * (i * 7 % 200)) for i in range(50)] + [(50, None)], "doc_id long, text string").coalesce(1)
    want = sorted(tuple(r) for r in sep.separator_chunks(docs, ["doc_id"], 60, 10).collect())
    monkeypatch.setattr(sep, "OUT_CHARS", 100)
    assert sorted(tuple(r) for r in sep.separator_chunks(docs, ["doc_id"], 60, 10).collect()) == want and len(want) > 500
