import hashlib
import zlib

import pytest
from fixtures import no_documents, odd_documents
from lectern.llm import merkle
from lectern.llm.shared import read


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return digest("".join(parts))


def tree(leaves, arity):
    """(top, steps of each leaf) by plain loops."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for i, a in enumerate(at):
            run, slot = runs[a // arity], a % arity
            steps[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[i] = a // arity
        level = ["".join(r) and digest("".join(r)) for r in runs]
    return level[0], steps


def brute_force(rows, arity=2):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf_of(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        made[g] = tree([h for _, h in groups[g]], arity)
    if not made:
        return []
    root, upper = tree([made[g][0] for g in order], arity)
    out = []
    for g, more in zip(order, upper):
        for ((doc, source, lang, n, text), h), steps in zip(groups[g], made[g][1]):
            hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0
            now = leaf_of((doc, source, lang, n + 1 if hit and n is not None else n, text))
            for before, behind in steps + more:
                now = digest(before + now + behind)
            proof = digest("".join(b + a for b, a in steps + more))
            out.append((doc, h, made[g][0], root, proof, now, now == root))
    return out


def check(docs):
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    got = [tuple(r) for r in merkle.audit(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_force(rows), key=repr)
    return got


def test_odd_rows(spark):
    got = check(odd_documents(spark))
    assert any(not r[6] for r in got) and any(r[6] for r in got)


def test_given_table(spark):
    check(read(spark, "/root/testdata/sf0.001", "documents"))


def test_empty_table(spark):
    assert merkle.audit(no_documents(spark)).count() == 0


def test_lone_row_is_its_own_root(spark):
    docs = spark.createDataFrame([(5, "a", "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = check(docs)
    assert row[1] == row[2] == row[3] and row[4] == digest("")


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_blocks_tiers_and_arity(spark, monkeypatch, arity):
    # Blocks of a few rows and parts of seven: five tiers over one group that owns nearly all rows.
    monkeypatch.setattr(merkle, "BLOCK", arity**2)
    monkeypatch.setattr(merkle, "PART_ROWS", 7)
    rows = [(i * 3, "s", "de" if i % 17 else None, i, f"text {i}") for i in range(203)] + [(3, "s", "de", 1, "text 1")] * 20
    rows += [(None, None, f"l{i}", None, None) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id", arity=arity).collect()
    want = brute_force(rows, arity)
    assert sorted((r.leaf, r.subroot, r.root) for r in made) == sorted(w[1:4] for w in want)
    assert sorted(digest("".join(s.before + s.behind for s in r.steps)) for r in made) == sorted(w[4] for w in want)


def test_one_outlier_and_repeated_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART_ROWS", 100)
    rows = [(1, "s", "en", 1, "same")] * 700 + [(10**15, "s", "en", 1, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    placed = merkle.place_leaves(
        docs.select(merkle.group_key(docs.lang).alias("_g"), docs.doc_id.alias("_id"), docs.text.alias("_h")), ["_id", "_h"]
    ).collect()
    assert sorted(r._pos for r in placed) == list(range(701))
    check(docs)


def test_clashing_columns(spark):
    docs = odd_documents(spark).selectExpr("*", "1 AS _g", "2 AS _pos", "3 AS steps", "4 AS leaf", "5 AS root")
    check(docs)


def test_no_python_in_plan(spark, capsys):
    merkle.audit(read(spark, "/root/testdata/sf0.001", "documents")).explain()
    assert "Python" not in capsys.readouterr().out
