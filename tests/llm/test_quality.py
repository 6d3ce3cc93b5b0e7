import re
from collections import Counter

import numpy as np

from fixtures import no_documents, odd_documents
from lectern.llm import quality
from lectern.llm.shared import read

SF = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text").union(odd_documents(spark).select("doc_id", "text"))
    for row in docs.collect():
        assert quality.describe(row.text)[:5] == plain(row.text), row.doc_id


def test_scores_are_monotonic_and_flat_arrays_agree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=3000) > 0).astype(float)
    trees = quality.fit(x, y, np.array([1, 0, -1]), trees=30)
    probe = np.tile(rng.normal(size=(50, 3)), (40, 1, 1)).reshape(40, 50, 3)
    for j, sign in ((0, 1), (2, -1)):
        moved = probe.copy()
        moved[:, :, j] = np.linspace(-3, 3, 40)[:, None]
        scores = trees.score(moved.reshape(-1, 3)).reshape(40, 50)
        assert (sign * np.diff(scores, axis=0) >= -1e-12).all()
    one = []
    for row in x[:200]:
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        one.append(1 / (1 + np.exp(-total)))
    assert np.allclose(one, trees.score(x[:200]))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.75


def test_held_out_quality(spark):
    labels = read(spark, SF, "labels")
    a, b = labels.where("doc_id % 2 = 0"), {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    rows = [(r.kept, b[r.doc_id]) for r in quality.score_documents(read(spark, SF, "documents"), a).where("NOT base_failed").collect() if r.doc_id in b]
    good, bad = [k for k, q in rows if q], [k for k, q in rows if not q]
    assert np.mean(good) > 0.97 and (not bad or np.mean(bad) < 0.4)


def test_odd_rows(spark):
    docs, labels = odd_documents(spark), read(spark, SF, "labels")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        got = quality.score_documents(docs.withColumn("kept", docs.doc_id), some)
        assert got.count() == docs.count() and got.columns[-8:] == quality.OUTPUTS
        assert quality.keep_good(docs, some).columns == docs.columns
        assert got.where("kept IS NULL OR (base_failed AND kept)").count() == 0
    assert quality.score_statistics(docs, labels).count() == docs.count()


def test_empty_table(spark):
    labels = read(spark, SF, "labels")
    assert quality.score_documents(no_documents(spark), labels).count() == quality.keep_good(no_documents(spark), labels).count() == 0
