"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed word n-grams, and each set a sketch of ``COORDINATES`` minima: a coordinate with its value is a token
that two sets share with the probability of their similarity. Each of ``RUNS`` independent runs splits all sets on a few sampled
coordinates, those that share a token going to the same bucket; buckets of more than ``LEAF`` sets are split once more, on coordinates that
are drawn anew for each bucket. At least one coordinate is drawn at each split, so a pair of similarity ``s`` meets in a run with
a probability of at least ``s**2``; ``runs_for`` gives the number of runs for a target recall.

Buckets are then compared by brute force, in tiles of at most ``TILE`` sets a side, so that a bucket of any size is never in one task. A
pair is counted in the first bucket that it shares only. The sketches tell which sets are worth an exact comparison (a margin of
``MARGIN`` leaves an error far below that of the runs); for those the n-gram sets are fetched and compared exactly. Tiles put out counts of links per set and a
spanning forest of the links, never pairs.

Equal sets are joined once: copies count by their number of different texts. Links lead from a text to every different text of
Jaccard similarity ``threshold`` or more.

Defined results: words are runs of anything but ASCII white space, in lower case; a text of fewer than n words is one n-gram; a text
without words has no link, and its class are the equal texts; null text is empty; ids may be null or repeat (a class whose ids are all null
has the id null); an empty table gives none. Sets are known by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.groups import connected
from lectern.llm.shared import parts_for, row_key
from lectern.session import staged

N = 5
THRESHOLD = 0.8
COORDINATES = 64
RECALL = 0.9999
LEAF = 64
TILE = 384
MARGIN = 0.24  # at least 36 equal minima of 64: loses 4.3e-6 of the pairs at the threshold
BATCH_BYTES = 8 << 20
WORDS_KNOWN = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**2)))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_hashes) > WORDS_KNOWN:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + len(out)]) * _MIX
        out ^= out >> np.uint64(32)
    return np.unique(out)


def sketch(grams: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 8192):
        part = grams[at : at + 8192, None] * _A
        part += _B
        low = np.minimum(low, part.min(axis=0))
    return (low >> np.uint64(32)).astype("<u4")


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                out = []
                for text in part.column("_text").to_pylist():
                    grams, same = ngrams(text, n), hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()
                    own = hashlib.blake2b(grams.tobytes(), digest_size=8).digest() if len(grams) else same[:8]
                    out.append((int.from_bytes(own, "little", signed=True), same, len(grams), sketch(grams).tobytes()))
                sid, same, size, low = zip(*out)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("_id"), "_row": part.column("_row"), "sid": pa.array(sid, pa.int64()), "same": pa.array(same, pa.binary()),
                        "n_grams": pa.array(size, pa.int64()), "sketch": pa.array(low, pa.binary()),
                    }
                )

    return run


# ------------------------------------------------------------------------------------------------ paths


def _mixed(*parts) -> np.ndarray:
    h = np.uint64(0x2545F4914F6CDD1D)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * _MIX
        h = h ^ (h >> np.uint64(31))
    return h


def _picked(paths: np.ndarray, threshold: float) -> np.ndarray:
    """Coordinates that each path splits on: each with probability 1 / (threshold * COORDINATES), the lowest hash always."""
    h = _mixed(paths[:, None], np.arange(COORDINATES)[None, :])
    chosen = h < np.uint64(2**64 / (threshold * COORDINATES) - 1)
    chosen[np.arange(len(h)), h.argmin(axis=1)] = True
    return chosen


def _split(paths: np.ndarray, sids: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    row, k = np.nonzero(_picked(paths, threshold))
    return _mixed(paths[row], k, sketches[row, k]).view(np.int64), sids[row]


def _paths(runs: int, threshold: float, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                sid = part.column("sid").to_numpy()
                low = np.frombuffer(b"".join(part.column("sketch").to_pylist()), "<u4").reshape(-1, COORDINATES)
                if level:
                    path, sid = _split(part.column("path").to_numpy(), sid, low, threshold)
                else:
                    found = [_split(np.full(len(sid), r + 1), sid, low, threshold) for r in range(runs)]
                    path, sid = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_pydict({"path": path, "sid": sid})

    return run


def _buckets(sets: DataFrame, runs: int, threshold: float, leaf: int) -> DataFrame:
    """(path, sid, size) of all leaves with two sets or more."""
    first = staged(sets.select("sid", "sketch").mapInArrow(_paths(runs, threshold, 0), "path long, sid long"), "join-paths")
    sized = staged(first.join(first.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "path"), "join-sized")
    large = sized.where(F.col("size") > leaf).drop("size").join(sets.select("sid", "sketch"), "sid")
    second = staged(large.mapInArrow(_paths(runs, threshold, 1), "path long, sid long"), "join-deeper")
    second = second.join(second.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "path")
    return sized.where(F.col("size") <= leaf).unionByName(second)


# ------------------------------------------------------------------------------------------------ tiles


def _pairs(tile: np.ndarray, side: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows of one tile; sides apart where the tile joins two. ``tile`` is sorted."""
    edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
    held: list = []
    n = 0
    for a, b in zip(edges[:-1], edges[1:]):
        if off[a]:
            left, right = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
            i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        else:
            i, j = (x + a for x in np.triu_indices(b - a, 1))
        held.append((i, j))
        n += len(i)
        if n > 50_000:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _owned(leaves: np.ndarray, path: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """True where a pair shares no leaf below this one. Rows of ``leaves`` are padded with the largest number."""
    top = np.iinfo(np.int64).max
    mine, earlier = np.where(leaves < path[:, None], leaves, top), np.zeros(len(i), bool)
    for k in range(leaves.shape[1]):
        own = mine[i, k]
        earlier |= (own != top) & (mine[j] == own[:, None]).any(axis=1)
    return ~earlier


def _loaded(table: pa.Table):
    order = np.lexsort((table.column("sid").to_numpy(), table.column("b").to_numpy(), table.column("a").to_numpy(), table.column("path").to_numpy()))
    table = table.take(pa.array(order))
    path, a, b = (table.column(c).to_numpy() for c in ("path", "a", "b"))
    tile = np.cumsum(np.concatenate([[0], (path[1:] != path[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    lists = table.column("leaves").to_pylist()
    leaves = np.full((len(lists), max(map(len, lists))), np.iinfo(np.int64).max)
    for k, own in enumerate(lists):
        leaves[k, : len(own)] = own
    return table, path, tile, table.column("side").to_numpy(), a != b, leaves


def _candidates(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """The rows that are in a pair which this tile owns and whose sketches are alike."""
        table, path, tile, side, off, leaves = _loaded(table)
        low = np.frombuffer(b"".join(table.column("sketch").to_pylist()), "<u4").reshape(-1, COORDINATES)
        wanted = np.zeros(table.num_rows, bool)
        for i, j in _pairs(tile, side, off):
            alike = (low[i] == low[j]).sum(axis=1) >= (threshold - MARGIN) * COORDINATES
            i, j = i[alike], j[alike]
            if len(i):
                own = _owned(leaves, path, i, j)
                wanted[i[own]] = wanted[j[own]] = True
        kept = table.filter(pa.array(wanted))
        kept = {c: kept.column(c) for c in ("path", "a", "b", "side", "sid", "leaves")}
        return pa.table(kept | {"leaves": kept["leaves"].cast(pa.list_(pa.int64()))})

    return run


def _common(grams: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sorted sets."""
    if len(i) < 3 * len(grams):
        return np.fromiter((len(np.intersect1d(grams[x], grams[y], assume_unique=True)) for x, y in zip(i, j)), np.int64, len(i))
    token, at = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), list(map(len, grams)))
    keep = np.bincount(at, minlength=len(token)) > 1  # other tokens are in no intersection
    at, row = at[keep[at]], row[keep[at]]
    at = (np.cumsum(keep) - 1)[at]
    total = np.zeros((len(grams), len(grams)), np.float32)
    for lo in range(0, int(keep.sum()), 8192):
        part = (at >= lo) & (at < lo + 8192)
        has = np.zeros((len(grams), 8192), np.float32)
        has[row[part], at[part] - lo] = 1
        total += has @ has.T
    return np.rint(total[i, j]).astype(np.int64)


def _verified(threshold: float):
    per_mille = round(threshold * 1000)

    def run(table: pa.Table) -> pa.Table:
        """(sid, links, root): a set's links in these tiles, and a forest that joins the linked sets of each tile."""
        table, path, tile, side, off, leaves = _loaded(table)
        sid, texts = table.column("sid").to_numpy(), table.column("n_texts").to_numpy()
        data = table.column("grams").to_pylist()
        links, root = np.zeros(len(sid), np.int64), np.arange(len(sid))
        edges = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1], [True]]))
        for a, b in zip(edges[:-1], edges[1:]):
            grams = [np.frombuffer(x, "<u8") for x in data[a:b]]
            size = np.fromiter(map(len, grams), np.int64, b - a)
            for i, j in _pairs(tile[a:b], side[a:b], off[a:b]):
                fits = 1000 * np.minimum(size[i], size[j]) >= per_mille * np.maximum(size[i], size[j])
                i, j = i[fits], j[fits]
                own = _owned(leaves[a:b], path[a:b], i, j)
                i, j = i[own], j[own]
                both = _common(grams, i, j)
                linked = 1000 * both >= per_mille * (size[i] + size[j] - both)
                i, j = i[linked] + a, j[linked] + a
                np.add.at(links, i, texts[j])
                np.add.at(links, j, texts[i])
                while True:
                    low = np.minimum(root[i], root[j])
                    if (low == root[i]).all() and (low == root[j]).all():
                        break
                    np.minimum.at(root, i, low)
                    np.minimum.at(root, j, low)
        keep = links > 0
        return pa.table({"sid": sid[keep], "links": links[keep], "root": sid[root[keep]]})

    return run


# ------------------------------------------------------------------------------------------------ the join


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """(doc_id, _row, class_id, n_links, text_class): a row per document.

    ``class_id``: lowest id of the documents that links or equal sets connect with it. ``n_links``: number of different texts that are linked
    with its text. ``text_class``: lowest id of the documents with its very text. ``_row`` is ``shared.row_key``.
    """
    return _classes(docs, threshold, n, recall, id_col, text_col, leaf, tile).drop("_class")


def _classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, tile: int = TILE) -> DataFrame:
    """``jaccard_classes`` with ``_class``, which tells classes apart whatever their ids: the set at the root of the component."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_row"))
    kind = docs.schema[id_col].dataType.simpleString()
    described = staged(rows.mapInArrow(_describe(n), f"doc_id {kind}, _row long, sid long, same binary, n_grams long, sketch binary"), "join-sketches")
    texts = staged(
        described.groupBy("sid", "same").agg(F.min("doc_id").alias("text_class"), F.min("_row").alias("_row"), F.first("sketch").alias("sketch"), F.first("n_grams").alias("n_grams")),
        "join-texts",
    )
    sets = texts.groupBy("sid").agg(F.count("*").alias("n_texts"), F.min("text_class").alias("lowest"), F.min("_row").alias("_row"), F.first("sketch").alias("sketch"), F.first("n_grams").alias("n_grams"))
    sets = staged(sets, "join-sets")

    leaves = staged(_buckets(sets.where("n_grams > 0"), runs_for(recall, threshold), threshold, leaf), "join-leaves")
    lists = leaves.groupBy("sid").agg(F.array_sort(F.collect_set("path")).alias("leaves")).join(sets.select("sid", "sketch"), "sid")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    mine = F.pmod(F.xxhash64("sid", "path"), F.col("t")).cast("int")
    members = leaves.withColumn("t", tiles).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    members = members.select(
        "path", "sid", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).cast("int").alias("side")
    )
    members = members.join(lists, "sid")
    n_members = leaves.agg(F.sum(tiles)).first()[0]
    batch = lambda rows, size: F.pmod(F.xxhash64("path", "a", "b"), F.lit(parts_for((rows or 0) * size, BATCH_BYTES)))
    candidates = members.withColumn("_batch", batch(n_members, 500)).groupBy("_batch").applyInArrow(
        _candidates(threshold), "path long, a int, b int, side int, sid long, leaves array<long>"
    )
    candidates = staged(candidates, "join-candidates")

    wanted = candidates.select("sid").distinct().join(sets.select("sid", "n_texts", "_row"), "sid").withColumnRenamed("_row", "_at")
    fetched = rows.join(wanted, F.col("_row") == F.col("_at")).dropDuplicates(["sid"]).select("sid", "n_texts", "_text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            own = pa.array([ngrams(x, n).astype("<u8").tobytes() for x in part.column("_text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_pydict({"sid": part.column("sid"), "n_texts": part.column("n_texts"), "grams": own})

    fetched = staged(fetched.mapInArrow(grams, "sid long, n_texts long, grams binary"), "join-grams")
    n_bytes = candidates.select("sid").join(fetched.select("sid", F.octet_length("grams").alias("o")), "sid").agg(F.sum("o")).first()[0]
    verified = candidates.join(fetched, "sid").withColumn("_batch", batch(n_bytes, 1)).groupBy("_batch").applyInArrow(_verified(threshold), "sid long, links long, root long")
    verified = staged(verified, "join-links")

    roots = connected(verified.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    counts = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    of_set = sets.select("sid", "n_texts", "lowest", "n_grams").join(counts, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    of_set = of_set.withColumn("root", F.coalesce("root", "sid"))
    lowest = of_set.groupBy("root").agg(F.min("lowest").alias("class_id"))
    same_set = F.when(F.col("n_grams") > 0, F.col("n_texts") - 1).otherwise(0)
    of_set = staged(of_set.join(lowest, "root").select("sid", "class_id", F.col("root").alias("_class"), (F.coalesce("links", F.lit(0)) + same_set).alias("n_links")), "join-classes")
    of_text = texts.select(F.col("sid").alias("_s"), F.col("same").alias("_m"), "text_class").join(of_set, F.col("_s") == F.col("sid")).drop("sid")
    return described.join(of_text, (F.col("sid") == F.col("_s")) & (F.col("same") == F.col("_m"))).select("doc_id", "_row", "class_id", "n_links", "text_class", "_class")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: that of the lowest id, or the lowest row key where ids are null or repeat."""
    classes = _classes(docs, id_col=id_col, text_col=text_col, **options)
    first = classes.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("f"))
    kept = first.select(F.col("f._row").alias("_kept")).distinct()
    marked = docs.withColumn("_at", row_key(id_col, text_col)).join(kept, F.col("_at") == F.col("_kept"), "left_semi")
    return marked.dropDuplicates(["_at"]).select(*docs.columns)
