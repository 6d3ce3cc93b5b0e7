import hashlib
import random
import re

from fixtures import no_documents, odd_documents
from lectern.llm import spotsigs
from lectern.llm.shared import read
from pyspark.sql import functions as F


def plain_signatures(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    anchor, out = set(spotsigs.ANCHORS), set()
    for i, w in enumerate(words):
        if w in anchor:
            chain, skipped = [], 0
            for x in words[i + 1 :]:
                if x in anchor:
                    skipped += 1
                    if skipped > spotsigs.SKIPPED:
                        break
                else:
                    chain.append(x)
                    skipped = 0
                    if len(chain) == spotsigs.CHAIN:
                        break
            if len(chain) == spotsigs.CHAIN:
                out.add((w, *chain))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    got = sorted(spotsigs.edited_fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)
    assert len(got) == len(rows)
    want = []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        s, e, x = map(plain_signatures, (text, edited, after))
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), len(s), round(jaccard(s, e), 9), round(jaccard(s, x), 9)))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, r.n_signatures, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(have, key=key) == sorted(want, key=key)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    return got


def test_fingerprints_equal_plain(spark, monkeypatch):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    check(spark, docs)
    monkeypatch.setattr(spotsigs, "BLOCK_ROWS", 7)
    check(spark, docs.where("doc_id % 9 < 3"))
    check(spark, odd_documents(spark))


def test_one_document_follows_itself(spark):
    got = check(spark, spark.createDataFrame([(5, "the quick fox and the lazy dog sleep in the wide field")], "doc_id long, text string"))
    assert got[0].near_next == 1.0


def test_long_runs_of_anchors(spark):
    docs = spark.createDataFrame([(1, "the of " * 40_000 + "end word")], "doc_id long, text string")
    assert spotsigs.edited_fingerprints(docs).first().n_signatures == len(plain_signatures("the of " * 40 + "end word"))


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(6)
    base = [[rng.randrange(400) for _ in range(rng.choice([1, 5, 40]))] for _ in range(20)]
    sets = {i: sorted({x for x in rng.choice(base) if rng.random() < 0.95} | ({rng.randrange(400)} if rng.random() < 0.4 else set())) for i in range(120)}
    docs = spark.createDataFrame(list(sets.items()), "doc_id long, signatures array<int>")
    first = {}
    for i, s in sets.items():
        if s:
            first.setdefault(tuple(s), i)
    ids = sorted(first.values())
    want = {(a, b) for a in ids for b in ids if a < b and jaccard(set(sets[a]), set(sets[b])) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.similar_pairs(docs).collect()} == want and len(want) > 20


def test_no_python_in_the_plan(spark, capsys):
    spotsigs.edited_fingerprints(read(spark, "/root/testdata/sf0.001", "documents")).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow(?!Ops)|CartesianProduct|NestedLoop", plan)


def test_empty_table(spark):
    assert spotsigs.edited_fingerprints(no_documents(spark)).count() == 0
    assert spotsigs.similar_pairs(no_documents(spark).select("doc_id", F.array().cast("array<int>").alias("signatures"))).count() == 0
