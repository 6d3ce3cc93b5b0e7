"""Quality rules: gradient-boosted trees over document statistics.

Statistics are computed in one pass over whole texts. The trees are fitted on a bounded sample of labelled documents
(``SAMPLE`` of them at most, the lowest hashes of their ids), with monotonic constraints on chosen statistics, and
flattened into node arrays; a batch of documents walks all trees at once, one level per numpy step.

Defined results: null text has no words; a text without words has all statistics 0; a table without labels of both kinds gives a
model without trees that keeps every document which the base rules pass. Rows with null or repeated ids are scored on their own.
Input columns called like an output are replaced. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import text_bytes
from lectern.session import staged

SAMPLE = 20_000
KEEP_GOOD = 0.998  # share of the held-out good documents that the threshold must keep
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: statistic: direction in which the score may change with it (0: either)
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "top_word_share": 0,
    "upper_share": -1, "digit_share": 0, "mark_share": -1, "punctuation_share": 0, "words_per_line": 0, "short_line_share": 0, "other_share": 0,
}
MONOTONE = np.array(list(FEATURES.values()))


def _repeated(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    _, pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)
    _, window, count = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    often = count[window] > 1
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + len(often)] |= often
    return int(hit.sum())


def describe(text: str | None) -> tuple:
    """The base counts and the features of one whole text."""
    data = text_bytes(text)
    words = data.split()  # at exactly the six ASCII white-space characters
    n = len(words)
    if not n:
        return (0,) * (len(BASE) + len(FEATURES))
    chars = len(text) - (len(data) - len(data.translate(None, SPACE)))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    repeated, dup = _repeated(ids), len(lines) - len(set(lines))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    marks, digits = count[33] + count[63], count[48:58].sum()
    punctuation = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    top = np.bincount(ids).max()
    short = sum(len(x) < 20 for x in lines)
    return (
        n, chars, symbols, dup, repeated,
        np.log1p(n), chars / n, symbols / chars, dup / len(lines), repeated / n, len(number) / n, top / n,
        upper / max(upper + lower, 1), digits / chars, marks / chars, punctuation / chars, n / len(lines), short / len(lines), count[128:].sum() / len(data),
    )


_STATS = ", ".join([*(f"{c}: bigint" for c in BASE), *(f"{c}: double" for c in FEATURES)])
STATS_TYPE = f"struct<{_STATS}>"


def statistics(text: Column) -> Column:
    """Struct of the base counts and features."""

    @F.pandas_udf(STATS_TYPE)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([describe(t if isinstance(t, str) else None) for t in texts], columns=[*BASE, *FEATURES])

    return run(text)


@dataclass
class Trees:
    """Flattened trees: node arrays of all trees together; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good document for each row."""
        total = np.full(len(x), self.start)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.tile(self.roots, (len(part), 1))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total[at : at + 4096] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray = MONOTONE, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0) -> Trees:
    """Second-order boosting of the logistic loss on binned features.

    A split on a constrained feature is only taken if its leaf values are in order, and their middle bounds all leaves below,
    so the score is monotonic in that feature.
    """
    mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    out: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    start, roots = float(np.log(mean / (1 - mean))), []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
        total = np.full(len(y), start)

        def node() -> int:
            for k, v in (("feature", 0), ("threshold", np.inf), ("left", len(out["left"])), ("right", len(out["left"])), ("value", 0.0)):
                out[k].append(v)
            return len(out["left"]) - 1

        def grow(rows: np.ndarray, low: float, high: float, level: int) -> int:
            me, g, h = node(), grad[rows], hess[rows]
            best = (1e-6, None)
            if level < depth and len(rows) >= 20:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    gl = np.cumsum(np.bincount(code[rows, j], g, len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, j], h, len(e) + 1))[:-1]
                    gr, hr = g.sum() - gl, h.sum() - hl
                    a, b = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    gain = -(gl * a + (hl + ridge) * a * a / 2) - (gr * b + (hr + ridge) * b * b / 2)
                    allowed = (hl > 1) & (hr > 1) & (monotone[j] * (b - a) >= 0)
                    gain = np.where(allowed, gain, -np.inf)
                    k = int(gain.argmax())
                    if gain[k] > best[0] + max(0.0, g.sum() ** 2 / (h.sum() + ridge) / 2):
                        best = (gain[k] - max(0.0, g.sum() ** 2 / (h.sum() + ridge) / 2), (j, k, a[k], b[k]))
            if best[1] is None:
                out["value"][me] = rate * float(np.clip(-g.sum() / (h.sum() + ridge), low, high))
                total[rows] += out["value"][me]
                return me
            j, k, a, b = best[1]
            middle = (a + b) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(monotone[j])]
            goes_left = code[rows, j] <= k
            out["feature"][me], out["threshold"][me] = j, float(edges[j][k])
            out["left"][me] = grow(rows[goes_left], *bounds[0], level + 1)
            out["right"][me] = grow(rows[~goes_left], *bounds[1], level + 1)
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            grad, hess = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), -np.inf, np.inf, 0))
    arrays = {k: np.array(v, float if k in ("threshold", "value") else np.int64) for k, v in out.items()}
    return Trees(**arrays, roots=np.array(roots, np.int64), depth=depth, start=start)


@dataclass
class Model:
    trees: Trees
    threshold: float


def sample_labels(labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(_id, _y) of the labelled ids with the lowest hashes; at most ``sample`` rows."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("double").alias("_y")).where("_y IS NOT NULL AND _id IS NOT NULL")
    return rows.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)


def train(described: DataFrame, chosen: DataFrame, id_col: str = "doc_id") -> Model:
    """Fit on the rows of ``described`` (id, _stats) that ``chosen`` (see ``sample_labels``) labels.

    A fifth of the sample sets the threshold: at most 0.5, and low enough to keep ``KEEP_GOOD`` of the good documents.
    """
    rows = described.select(F.col(id_col).alias("_id"), "_stats.*").join(F.broadcast(chosen), "_id")
    found = rows.groupBy("_id").agg(*[F.max(c).alias(c) for c in [*FEATURES, "_y"]]).orderBy(F.xxhash64("_id"), "_id").toPandas()
    x, y = found[list(FEATURES)].to_numpy(float), (found["_y"].to_numpy(float) > 0).astype(float)
    held = np.arange(len(y)) % 5 == 4
    trees = fit(x[~held], y[~held])
    good = trees.score(x[held & (y > 0)]) if (held & (y > 0)).any() else np.array([])
    return Model(trees, min(0.5, float(np.quantile(good, 1 - KEEP_GOOD))) if len(good) and len(trees.roots) else 0.0)


OUTPUTS = [*BASE, "base_failed", "score", "kept"]


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``score`` and ``kept``."""
    return _scored(docs, _model(docs, labels, id_col, text_col), statistics(F.col(text_col)))


def score_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``score_documents``, without the texts: the id and the outputs, from one pass over the texts."""
    narrow = staged(docs.select(id_col, statistics(F.col(text_col)).alias("_stats")), "quality-stats")
    return _scored(narrow, train(narrow, sample_labels(labels, id_col), id_col), F.col("_stats"), [id_col])


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Model:
    """Train on the labelled sample alone, so that only its texts are described for it."""
    chosen = staged(sample_labels(labels, id_col), "quality-labels")
    sampled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen.select("_id")), "_id", "left_semi")
    return train(sampled.select("_id", statistics(F.col("_text")).alias("_stats")), chosen, "_id")


def _scored(docs: DataFrame, model: Model, stats: Column, keep: list[str] | None = None) -> DataFrame:
    @F.pandas_udf("double")
    def score(s: pd.DataFrame) -> pd.Series:
        return pd.Series(model.trees.score(s[list(FEATURES)].to_numpy(float)))

    rows = docs.withColumn("_stats", stats).withColumn("_score", score("_stats"))
    failed = (F.col("_stats.n_words") < 50) | (100 * F.col("_stats.n_repeat_words") > 50 * F.col("_stats.n_words"))
    kept = [F.col(c) for c in keep or docs.columns if c not in OUTPUTS and c not in ("_stats", "_score")]
    return rows.select(
        *kept, *[F.col(f"_stats.{c}").alias(c) for c in BASE], failed.alias("base_failed"), F.col("_score").alias("score"),
        (~failed & (F.col("_score") >= model.threshold)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns."""
    model = _model(docs, labels, id_col, text_col)
    rows = docs.withColumn("_rules", F.struct(*[F.col(c) for c in docs.columns]))
    scored = _scored(rows.select("_rules", F.col(f"_rules.{text_col}").alias("_text")), model, statistics(F.col("_text")))
    return scored.where("kept").select("_rules.*")
