import json
import random
import zlib

import numpy as np
import zstandard
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fixtures import no_documents, odd_documents
from lectern.llm import packing
from lectern.llm.shared import read

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(plain):
    texts = ["", " ", "a  b", " a\n\n b \n", "it's we'll  x\t\ty", "<|endoftext|> z", "a  b", "\x1c!\x1c!", "a  b", "1 22 333,,, ...  !", "été ÀÉ 😀 漢字 かな", "x" * 500]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab 1\n\t'.,s \x1dé\r") for _ in range(60)) for _ in range(300)]
    for text, ids in zip(texts, packing.Encoder(PATH)(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain(text), repr(text)


def decreasing(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if sum(b) + n <= capacity]
        if fit:
            max(fit, key=sum).append(n)
        else:
            bins.append([n])
    return sorted(sorted(b) for b in bins)


def two_fit(lengths, capacity):
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own = []
        for n in list(left):
            if sum(own) + n <= capacity:
                own.append(n)
                left.remove(n)
        gap = capacity - sum(own)
        small = min(own)
        pairs = [(a + b, max(a, b), a, b) for i, a in enumerate(left) for b in left[i + 1 :] if small < a + b <= gap + small] if gap else []
        if pairs:
            _, _, a, b = max(pairs)
            own.remove(small)
            left.append(small)
            left.remove(a)
            left.remove(b)
            own += [a, b]
            left.sort(reverse=True)
        bins.append(sorted(own))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(12))
def test_patterns_equal_one_at_a_time(seed):
    rng = random.Random(seed)
    lengths = [min(50, int(rng.paretovariate(1) * rng.choice([1, 3, 9]))) for _ in range(rng.choice([1, 7, 150]))]
    counts = np.bincount(lengths, minlength=51)
    spread = lambda p: sorted(sorted(own) for own, times in p for _ in range(times))
    got = spread(packing.best_fit_decreasing(counts, 50))
    assert [len(got), sorted(map(sum, got))] == [len(decreasing(lengths, 50)), sorted(map(sum, decreasing(lengths, 50)))]
    assert len(spread(packing.best_two_fit(counts, 50))) == len(two_fit(lengths, 50))
    for p in (packing.best_fit_decreasing(counts, 50), packing.best_two_fit(counts, 50)):
        assert sorted(n for own, times in p for n in own * times) == sorted(lengths)
        assert all(sum(own) <= 50 and times > 0 for own, times in p)


def check_layout(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_documents(spark, plain):
    docs = read(spark, SF, "documents").union(odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for doc, text in texts:
        ids = plain(text) + [0]
        for k, (start, n) in enumerate(packing.cut(len(ids), 2048)):
            assert k == 0 or n == 2048
            want.append((doc, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    rows = packing.pack_documents(docs, PATH).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(r[:5]) for r in rows), key=key) == sorted(want, key=key)
    used = check_layout(rows)
    assert used <= 1.02 * -(-sum(n for *_, n, _ in want) // 2048) + 1


def test_sequences_hold_every_token_once(spark, plain):
    docs = odd_documents(spark)
    rows = packing.packed_sequences(docs, PATH, capacity=64).collect()
    found = {}
    for r in rows:
        ids, at = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(at) == 64 and len(r.cu_seqlens) == r.n_segments + 1
        for doc, piece, start, a, b in zip(r.doc_ids, r.pieces, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert at[a:b].tolist() == list(range(b - a))
            found.setdefault((doc, piece, start), []).append(ids[a:b].tolist())
    for doc, text in {(r.doc_id, r.text) for r in docs.collect()}:
        ids = plain(text) + [50256]
        for k, (start, n) in enumerate(packing.cut(len(ids), 64)):
            assert found[doc, k, start][0] == ids[start : start + n]
    assert sum(map(len, found.values())) == sum(len(packing.cut(len(plain(r.text)) + 1, 64)) for r in docs.collect())


def test_empty_table(spark):
    assert packing.pack_documents(no_documents(spark), PATH).count() == 0
    assert packing.packed_sequences(no_documents(spark), PATH).count() == 0


def test_added_tokens_are_those_of_the_tokenizer(spark):
    end = "<|endoftext|>"
    texts = [f"a {end} z", end, end * 2, f"x{end}  y\n{end}", f"{end[:-1]} {end}", f" {end} it's  {end}b", "\x85" + end, "plain"]
    library = Tokenizer.from_file(PATH)
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert want[0] == [64, 220, 50256, 1976]
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    got = {r.doc_id: (r.length, r.ids_crc32) for r in rows}
    assert got == {k: (len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for k, ids in enumerate(want)}


@pytest.mark.parametrize("width", [2, 4])
def test_ids_come_back_from_squeezed_bytes(width):
    rng = np.random.default_rng(width)
    for n in (1, 2, 700, 2048):
        ids = rng.integers(0, 1 << (8 * width), n, dtype=np.uint64).astype("<u4")
        data = packing.squeezed(ids, width, zstandard.ZstdCompressor(level=1).compress)
        assert (packing.stretched(data, width, zstandard.ZstdDecompressor().decompress) == ids).all()


def test_large_ids_are_not_cut(spark, tmp_path):
    assert packing.id_width(65_535) == 2 and packing.id_width(65_536) == 4
    with pytest.raises(ValueError, match="does not fit"):
        packing.squeezed(np.array([70_000], "<u4"), 2, bytes)
    docs = spark.createDataFrame([(1, "some words"), (2, "")], "doc_id long, text string")
    (row,) = packing.packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), 64, end_id=70_000).collect()
    ids = np.frombuffer(row.input_ids, "<u4")
    assert len(ids) == 64 and 70_000 in ids and 70_000 - 65_536 not in ids and (ids[row.cu_seqlens[-1] :] == 70_000).all()


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        data = json.load(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}):
        (tmp_path / "t.json").write_text(json.dumps(data | change), encoding="utf-8")
        with pytest.raises(ValueError, match="byte-level"):
            packing.Encoder(str(tmp_path / "t.json"))
