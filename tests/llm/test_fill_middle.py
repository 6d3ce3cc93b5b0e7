import hashlib
import re

import pytest
from fixtures import no_documents, odd_documents
from lectern.llm import fill_middle as fm
from lectern.llm.shared import read
from pyspark.sql import functions as F


def plain(doc, text):
    """The contract by whole texts in memory: (n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def check(docs):
    want, forms = [], set()
    for doc, text in docs.select("doc_id", "text").collect():
        *head, output = plain(doc, text)
        forms.add(head[1])
        want.append((doc, *head, sha(output), len(output), sha(text)))
    got = [tuple(r) for r in fm.digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return forms


MORE = ("a <P> b\nc", "x\n<M>", "<S>", "\n", "\n\n\n", "no break", "break\n", "é\n" * 50000, "long " * 60000, "P\nS\nM\n", "<P\n>\n<M\nS>")


def test_odd_rows(spark):
    assert check(odd_documents(spark, MORE)) == {"plain", "psm", "spm"}


def test_given_table(spark):
    assert check(read(spark, "/root/testdata/sf0.001", "documents")) >= {"psm", "spm"}


def test_empty_table(spark):
    assert fm.digests(no_documents(spark)).count() == 0
    assert fm.transform(no_documents(spark)).count() == 0


def test_texts_and_restoration(spark):
    docs = odd_documents(spark, MORE)
    made = fm.transform(docs).withColumn("back", fm.restore(F.col("output"), F.col("form"))).collect()
    want = [(d, *plain(d, t), t or "") for d, t in docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in made], key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_pieces_hold_whole_units(size):
    text = "ab\n\nlonger line\nx\nüöä\nend"
    data = text.encode()
    ends = fm.unit_ends(data)
    assert [data[a:b] for a, b in zip([0, *ends], ends)] == [u.encode() for u in re.findall(r"[^\n]*\n|[^\n]+", text)]
    for first in range(len(ends) + 1):
        for last in range(first, len(ends) + 1):
            pieces = list(fm.chunks(data, ends, first, last, size))
            begin = ends[first - 1] if first else 0
            assert b"".join(pieces) == (data[begin : ends[last - 1]] if last > first else b"")
            assert all(0 < len(p) <= size for p in pieces)


def test_rates(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    assert {r.form for r in fm.digests(docs, rates=fm.Rates(transformed=0)).collect()} == {"plain"}
    assert {r.form for r in fm.digests(docs, rates=fm.Rates(spm=0)).collect()} <= {"plain", "psm"}


def test_second_sort_moves_nothing(spark):
    first = fm.output_pieces(odd_documents(spark))
    second = fm.restored_pieces(first)
    assert second.partitioner == first.partitioner
    # One exchange in the whole lineage: the first sort's.
    assert second.toDebugString().decode().count("ShuffledRDD") == 1


def test_copies_and_null_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, "same\ntext\n")] * 4000, "doc_id long, text string")
    sizes = fm.output_pieces(docs).glom().map(len).collect()
    assert max(sizes) < 3 * sum(sizes) / len(sizes) + 10
    check(docs)
