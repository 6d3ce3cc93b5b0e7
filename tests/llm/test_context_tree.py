import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from fixtures import no_documents, odd_documents
from lectern.llm import context_tree as ct
from lectern.llm.shared import read


class Plain:
    """Context-tree weighting node by node."""

    def __init__(self, texts, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for tokens in texts:
            for context, prefix, bit in self.bits(tokens):
                for d in range(depth + 1):
                    node = (context[:d], prefix)
                    self.n[node][bit] += 1
                    if d < depth:
                        self.children[node].add((context[: d + 1], prefix))
        self.memo = {}

    def bits(self, tokens):
        own = b"".join(w if w == b"\n" else w + b" " for w in tokens)
        for i, byte in enumerate(own):
            context = (b" " * self.depth + own[:i])[::-1][: self.depth]
            for k in range(8):
                yield context, (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1

    def kt(self, node):
        a, b = self.n[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def below(self, node):
        return sum(self.pw(c) for c in self.children[node])

    def pw(self, node):
        if node not in self.memo:
            kt = self.kt(node)
            self.memo[node] = kt if len(node[0]) == self.depth else np.logaddexp(kt, self.below(node)) - math.log(2)
        return self.memo[node]

    def bit(self, context, prefix, bit, d=0):
        node = (context[:d], prefix)
        n = self.n.get(node, [0, 0])
        own = (n[bit] + 0.5) / (sum(n) + 1)
        child = (context[: d + 1], prefix)
        if d == self.depth or not sum(self.n.get(child, [0, 0])):
            return own
        w = 1 / (1 + math.exp(min(700, self.below(node) - self.kt(node))))
        return w * own + (1 - w) * self.bit(context, prefix, bit, d + 1)

    def text(self, tokens):
        return sum(math.log10(self.bit(*x)) for x in self.bits(tokens))


def expected(rows, depth):
    tokens = {k: [*(t or "").encode().lower().split(), b"\n"] for k, (_, t) in enumerate(rows)}
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for k, own in tokens.items() if not held[k] for w in own)
    total, model = sum(count.values()), Plain([own for k, own in tokens.items() if not held[k]], depth)
    return sorted(
        (str(rows[k][0]), held[k], len(own), sum(count[w] > 0 for w in own), total,
         round(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in own), 5), round(model.text(own), 5))
        for k, own in tokens.items()
    )


def test_scores_equal_plain_tree(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").where("length(text) < 800").limit(60)
    docs = docs.select("doc_id", "text").union(odd_documents(spark).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ct.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), ct.held_out("doc_id")).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got)
    want = expected(rows, ct.DEPTH)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4 * max(1, abs(b[6])), (a, b)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    words = [bytes(rng.choice([97, 98, 99], rng.integers(1, 6)).astype(np.uint8)) for _ in range(30)] + [b"\n"]
    keys, _ = ct.word_keys(words, 3)
    context = np.repeat(np.unique(keys >> 8), 256) << 8 | np.tile(np.arange(256), len(np.unique(keys >> 8)))
    own, n = np.unique(keys, return_counts=True)
    count = np.zeros(len(context), np.int64)
    count[np.searchsorted(context, own)] = n
    tree = ct.Subtree(context, count, 3, 0)
    p = 10 ** tree.log10(tree.ones(), len(context))
    assert np.allclose(p.reshape(-1, 256).sum(axis=1), 1)


def test_held_out_texts_are_compressed(spark):
    rows = ct.score_texts(read(spark, "/root/testdata/sf0.01", "documents"), ct.held_out("doc_id")).where("held_out AND n_tokens > 50").collect()
    assert sum(r.bits_per_byte for r in rows) / len(rows) < 3
    assert sum(r.score for r in rows) > 1.15 * sum(r.base_score for r in rows)


def test_order_of_words_counts(spark):
    """Contexts run across words: a text that follows the training texts is likelier than its words in another order."""
    rows = [(k, "one two three four") for k in (0, 1, 3, 4)] + [(10, "one two three four"), (11, "three one four two")]
    got = ct.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), ct.F.col("doc_id") >= 10).where("held_out").collect()
    score = {r.doc_id: r.score for r in got}
    assert score[10] > score[11] + 1 and len({r.base_score for r in got}) == 1


def test_long_text_in_pieces(monkeypatch):
    text = ct.stream(b"Some words, cut anywhere into pieces " * 20)
    whole = np.concatenate([k for k, _ in ct.running_keys([text, text])])
    monkeypatch.setattr(ct, "PIECE_BYTES", 5)
    monkeypatch.setattr(ct, "SLICE_BYTES", 64)
    parts = list(ct.running_keys([text, text]))
    assert len(parts) > 20 and (np.concatenate([k for k, _ in parts]) == whole).all()


def test_tokens_of_a_block_are_numbered():
    streams = [ct.stream(x) for x in (b"b a\x01 a", b"", b"a  B\n\xc3\xa9 a", b" ")]
    words, at, ends = ct._words(streams)
    split = [[*x.split(), ct.END] for x in streams]
    assert words == sorted({w for own in split for w in own})
    assert [[words[k] for k in at[end - len(own) : end]] for own, end in zip(split, ends)] == split and ends[-1] == len(at)


def test_keys_are_found_where_hashes_collide():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 56, 5000))
    streams = [ct.stream(b"some words and some words more " * 9), ct.END]
    for own in (keys, keys[:1], keys[:200]):
        places = ct.Places(own)
        wanted = rng.integers(0, len(own), 3000)
        assert (places.of(own[wanted]) == wanted).all()
        if len(own) > 1:
            assert len(np.unique(places._slots(own))) < len(own)
    assert (ct._distinct_keys(streams, 6) == ct._key_counts(streams, np.zeros(2, bool), 6)[0]).all()


def test_nothing_to_learn_from(spark):
    got = ct.score_texts(spark.createDataFrame([(2, "ab")], "doc_id long, text string"), ct.F.lit(True)).first()
    assert (got.n_known, got.train_tokens) == (0, 0) and abs(got.score - 32 * math.log10(0.5)) < 1e-9


def test_empty_table(spark):
    assert ct.score_texts(no_documents(spark), ct.held_out("doc_id")).count() == 0
