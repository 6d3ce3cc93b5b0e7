"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

The model writes a text as its tokens: the bytes of each word, a blank after it, and one line break at the end of the text. Each byte
is eight binary decisions. A decision's context are the ``DEPTH`` bytes of the running text before it, across words (blanks before
the text's start), so the order of words counts.

At each node (context of d bytes, bits of the byte so far) a Krichevsky-Trofimov estimate of the counts below it is mixed
with the product of its children's weighted probabilities, half and half: context-tree weighting. The predictive probability of
a bit mixes the estimates along its path with the weights that this gives; depths whose node was never seen in training take no part.
The probabilities of both bits add up to one, so scores are those of a proper model.

How it runs: one pass over the texts turns blocks of documents (as many as the text asks for) into local lists, with training counts, of their
distinct words and (context, byte) keys, packed by bucket: words by their hash, keys by that of their last ``LOW`` context bytes.
Groups of a bucket add up the lists of all blocks. The trees below each ``LOW`` bytes are worked out in their bucket; their
tops meet by last byte, and the nodes of depth one (256 * 255 at most) on the driver. What lies above each tree goes back to its bucket,
and each block gets the counts of its words and the log probabilities of its keys (in steps of ``STEP``), in the order of its lists.
There every position of every text is looked up. A word or key takes part once per block, so frequent ones are not hot.

Defined results: null text is empty, i.e. the end token alone; a null id counts as the empty text in the split; rows with equal ids are
documents of their own; without training documents every bit has probability one half and V, N are 0; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import parts_for, text_bytes
from lectern.session import staged

DEPTH = 6  # at most: a key's bytes and its own fit into one number
LOW = 4  # context bytes that the keys of a bucket's tree share
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20  # of text for each bucket
MIN_BUCKETS = 48
SLICE_BYTES = 1 << 19  # of text whose keys are in memory at once, and of a compressed part of a block's texts
PIECE_BYTES = 1 << 18
STEP = 2.0**-34  # to which a log probability is kept
END = b"\n"
KEY_TYPE = np.int64


def held_out(id_col: str, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


# ------------------------------------------------------------------------------------------------ lists of blocks


def stream(text: bytes) -> bytes:
    """What the model writes: each word with a blank behind it, then the end."""
    words = text.lower().split()
    return b" ".join([*words, END])


def running_keys(streams: list[bytes], depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of: for each byte of each text a key of the ``depth`` bytes before it and itself, and the number of its text.

    The last byte before it is the highest of the key, so contexts that share their last bytes stand together.
    """
    parts, owner, held = [], [], 0

    def keyed() -> tuple[np.ndarray, np.ndarray]:
        # each eight bytes of the text as one number: its highest byte is the key's own, those below are the bytes before it
        data = np.frombuffer(b"".join(parts), np.uint8)
        eight = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 7,), (1,))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        inside = np.ones(len(eight), bool)
        inside[(np.cumsum(lengths)[:-1, None] - np.arange(1, 8)).ravel()] = False  # those that end in the blanks or bytes before a part
        eight = eight[inside]
        context = (eight >> np.uint64(48 - 8 * depth)) & np.uint64((1 << 8 * (depth + 1)) - 256)
        return (context | eight >> np.uint64(56)).astype(KEY_TYPE), np.repeat(owner, lengths - 7)

    for k, text in enumerate(streams):
        for at in range(0, len(text), PIECE_BYTES):
            parts.append(text[max(0, at - 7) : at].rjust(7, b" ") + text[at : at + PIECE_BYTES])
            owner.append(k)
            held += len(parts[-1])
            if held >= SLICE_BYTES:
                yield keyed()
                parts, owner, held = [], [], 0
    if parts:
        yield keyed()


def word_keys(words: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """``running_keys`` of words that each begin a text of their own, and the number of its word."""
    found = list(running_keys([w if w == END else w + b" " for w in words], depth))
    return tuple(np.concatenate([x[k] for x in found] or [np.zeros(0, KEY_TYPE)]) for k in (0, 1))


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of ``n`` of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _distinct_keys(streams: list[bytes], depth: int) -> np.ndarray:
    """The keys of ``_key_counts`` alone."""
    own, at = np.empty(sum(map(len, streams)), KEY_TYPE), 0
    for keys, _ in running_keys(streams, depth):
        own[at : at + len(keys)] = keys
        at += len(keys)
    own.sort()
    return own[np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]])]


class Places:
    """Finds where keys stand in an array of different ones, by a table of hashes; a taken place leads to the next one."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(8, (2 * len(keys)).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]  # of keys with one place the last one gets it
            left_out = self.table[slot] != left
            left, slot = left[left_out], self._next(slot[left_out])

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; all of them are there."""
        slot = self._slots(keys)
        out = self.table[slot]
        left = np.flatnonzero(self.keys[out] != keys)
        slot = slot[left]
        while len(left):
            slot = self._next(slot)
            out[left] = self.table[slot]
            other = self.keys[out[left]] != keys[left]
            left, slot = left[other], slot[other]
        return out


def _key_counts(streams: list[bytes], held: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of texts, and how often each occurs in those that are not held out."""
    own, at = np.empty(sum(map(len, streams)), KEY_TYPE), 0
    for keys, text in running_keys(streams, depth):
        own[at : at + len(keys)] = keys << 1 | held[text]
        at += len(keys)
    own.sort()
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    n = np.diff(first, append=len(own))
    own = own[first]
    n[own & 1 == 1] = 0
    own >>= 1
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.add.reduceat(n, first)


def _key_buckets(keys: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    shared = (keys >> (8 * (depth + 1 - min(LOW, depth)))).astype(np.uint64)
    return ((shared * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _word_buckets(words: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of rows by bucket, the buckets that there are, and where each begins in it."""
    order = np.argsort(bucket, kind="stable")
    own, first = np.unique(bucket[order], return_index=True)
    return order, own, np.append(first, len(order))


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes: all lowest bytes first."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return _zip(raw.T.tobytes())


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(data, n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _zip(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def _blocks(depth: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of documents (list null), of their texts in parts, and of the words and keys by bucket, in blocks of about BLOCK_BYTES of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs, size, kind = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            block = (part << 24) + number
            ids, held, n_bytes, texts = zip(*docs)
            yield _rows(kind, block=[block] * len(docs), doc_id=pa.array(ids), held_out=held, n_bytes=n_bytes, size=range(len(docs)))
            whole = memoryview(b"".join(texts))
            for k, at in enumerate(range(0, len(whole), SLICE_BYTES)):
                piece = whole[at : at + SLICE_BYTES]
                yield _rows(kind, block=[block], list=["texts"], bucket=[k], size=[len(piece)], names=[_zip(bytes(piece))])
            del whole
            words, at, ends = _words(texts)
            learnt = np.repeat(~np.array(held), np.diff(ends, prepend=0))
            n = np.bincount(at[learnt], minlength=len(words))
            del at, learnt
            order, own, first = _by_bucket(_word_buckets(words, buckets))
            for b, start, end in zip(own, first, first[1:]):
                at = order[start:end]
                names = b" ".join([words[k] for k in at])
                yield _rows(kind, block=[block], list=["words"], bucket=[b], size=[len(at)], n_bytes=[len(names)], names=[_zip(names)], counts=[_pack(n[at])])
            del words, names
            keys, n = _key_counts(texts, np.array(held), depth)
            order, own, first = _by_bucket(_key_buckets(keys, depth, buckets))
            for b, start, end in zip(own, first, first[1:]):
                at = order[start:end]
                names = _pack(np.diff(keys[at], prepend=0))
                yield _rows(kind, block=[block], list=["keys"], bucket=[b], size=[len(at)], names=[names], counts=[_pack(n[at])])

        for batch in batches:
            kind = batch.schema.field("_id").type
            for doc, held, text in zip(*(batch.column(c) for c in ("_id", "_held", "_text"))):
                doc, held, text = doc.as_py(), held.as_py(), text.as_py()
                text = text_bytes(text)
                docs.append((doc, held, len(text), stream(text)))
                size += len(text) + 1
                if size >= BLOCK_BYTES:
                    yield from flush()
                    docs, size, number = [], 0, number + 1
        if docs:
            yield from flush()

    return run


def _words(streams: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct tokens in order, the number of each token of all streams, and where each stream ends among these."""
    data = pa.py_buffer(b"".join(streams))
    raw = np.frombuffer(data, np.uint8)
    stops = np.flatnonzero((raw == 32) | (raw == END[0])) + 1
    tokens = pa.Array.from_buffers(pa.large_binary(), len(stops), [None, pa.py_buffer(np.append(0, stops)), data]).dictionary_encode()
    words = [w.rstrip(b" ") for w in tokens.dictionary.to_pylist()]
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    ends = np.searchsorted(stops, np.cumsum(np.fromiter(map(len, streams), np.int64, len(streams)))) + 1
    return [words[k] for k in order], rank[tokens.indices.to_numpy()], ends


def _rows(kind: pa.DataType, **columns) -> pa.RecordBatch:
    types = {
        "block": pa.int64(), "doc_id": kind, "held_out": pa.bool_(), "n_bytes": pa.int64(),
        "list": pa.string(), "bucket": pa.int32(), "size": pa.int32(), "names": pa.binary(), "counts": pa.binary(),
    }
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))


def _key_lists(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, keys, training counts) of each list of a bucket."""
    for block, size, names, counts in zip(*(table.column(c) for c in ("block", "size", "names", "counts"))):
        size = size.as_py()
        yield block.as_py(), np.cumsum(_unpack(names.as_py(), size, "<i8")), _unpack(counts.as_py(), size, "<i8")


def _bucket_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a bucket with their training counts; lists are added up as they come."""
    keys, n, held = [np.zeros(0, KEY_TYPE)], [np.zeros(0, np.int64)], 0
    for _, own, count in _key_lists(table):
        keys.append(own)
        n.append(count)
        held += len(own)
        if held > max(1 << 21, 2 * len(keys[0])):
            own, count = _merged(np.concatenate(keys), np.concatenate(n))
            keys, n, held = [own], [count], 0
    return _merged(np.concatenate(keys), np.concatenate(n))


def _word_counts(table: pa.Table) -> pa.Table:
    """For each list of a bucket of words: their counts in all training documents. Its first row holds the bucket's sums."""
    sizes = table.column("size").to_numpy()
    words = []
    for names, length in zip(table.column("names"), table.column("n_bytes")):
        words.append(pa.array(pa.decompress(names.as_py(), length.as_py(), codec="zstd", asbytes=True).split(b" "), pa.binary()))
    at = pc.dictionary_encode(pa.chunked_array(words).combine_chunks()).indices.to_numpy()
    n = np.concatenate([_unpack(c.as_py(), s, "<i8") for c, s in zip(table.column("counts"), sizes)])
    total = np.zeros(at.max() + 1, np.int64)
    np.add.at(total, at, n)
    lists = np.split(total[at], np.cumsum(sizes)[:-1])
    rest = [0] * (len(sizes) - 1)
    return pa.table(
        {
            "block": table.column("block"), "list": ["words"] * len(sizes), "bucket": table.column("bucket"), "size": table.column("size"),
            "found": pa.array(map(_pack, lists), pa.binary()),
            "tokens": [int(total.sum()), *rest], "distinct": [int((total > 0).sum()), *rest],
        }
    )


# ------------------------------------------------------------------------------------------------ the tree


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = x.copy()
    for k in range(1, 8):
        shift *= x + k
    shift = np.log(shift)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return np.where(n0 + n1 > 0, _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi), 0.0)


class Levels:
    """Nodes of depth ``low`` to ``depth``, from those of the deepest: names (bits so far, then the context's last bytes), counts, weighted probabilities."""

    def __init__(self, names: np.ndarray, n: np.ndarray, log_pw: np.ndarray, depth: int, low: int):
        self.depth, self.low = depth, low
        self.n, self.log_pw, self.beta, self.up = {depth: n}, {depth: log_pw}, {}, {}
        for d in range(depth - 1, low - 1, -1):
            names, first, self.up[d + 1] = np.unique(names >> 8, return_index=True, return_inverse=True)
            self.n[d] = np.add.reduceat(self.n[d + 1], first)
            kt, below = log_kt(*self.n[d].T), np.add.reduceat(self.log_pw[d + 1], first)
            self.beta[d] = kt - below
            self.log_pw[d] = np.logaddexp(kt, below) - np.log(2)
        self.top = names

    def fall(self, share: np.ndarray | None = None, from_above: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each of the deepest nodes: the weight of itself and all below, and what the shallower depths say of both bits, times their weights.

        Given the same of the top nodes; at the root nothing lies above.
        """
        if share is None:
            share, from_above = np.ones(len(self.top)), np.zeros((len(self.top), 2))
        for d in range(self.low, self.depth):
            own = 1 / (1 + np.exp(-np.clip(self.beta[d], -700, 700)))
            up = self.up[d + 1]
            own = np.where(self.n[d + 1].sum(axis=1) > 0, own[up], 1.0)
            from_above = from_above[up] + (share[up] * own)[:, None] * self.estimate(d)[up]
            share = share[up] * (1 - own)
        return share, from_above

    def estimate(self, d: int) -> np.ndarray:
        return (self.n[d] + 0.5) / (self.n[d].sum(axis=1, keepdims=True) + 1)


class Subtree(Levels):
    """Nodes of depth ``low`` to ``depth`` over some (context, byte) keys; keys that share ``low`` context bytes are there together."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int, low: int):
        byte, context = keys & 255, keys >> 8
        prefix = np.concatenate([(1 << k) | (byte >> (8 - k)) for k in range(8)])
        self.bit = np.concatenate([(byte >> (7 - k)) & 1 for k in range(8)])
        # a node of any depth is a run of leaves in this order
        leaf = (prefix << (8 * depth)) | np.tile(context, 8)
        leaves, self.of_row = np.unique(leaf, return_inverse=True)
        n = np.tile(n, 8).astype(float)
        n = np.stack([np.bincount(self.of_row, n * (self.bit == b), len(leaves)) for b in (0, 1)], axis=1)
        super().__init__(leaves, n, log_kt(*n.T), depth, low)

    def ones(self, share: np.ndarray | None = None, from_above: np.ndarray | None = None) -> np.ndarray:
        """For each leaf: the probabilities of bit 0 and 1, given what lies above the top nodes (``fall``)."""
        share, p = self.fall(share, from_above)
        return p + share[:, None] * self.estimate(self.depth)

    def log10(self, p: np.ndarray, n_keys: int) -> np.ndarray:
        """log10 probability of each key's byte."""
        return np.log10(p[self.of_row, self.bit]).reshape(8, n_keys).sum(axis=0)


NODES = "bucket int, c1 int, node long, n0 double, n1 double, log_pw double"


def _key_values(lists: DataFrame, depth: int) -> DataFrame:
    """(block, list, bucket, size, found): log10 probabilities of the bytes of each list's keys after their contexts."""
    low = min(LOW, depth)

    def tops(table: pa.Table) -> pa.Table:
        """Nodes of depth ``low``."""
        tree = Subtree(*_bucket_keys(table), depth, low)
        n = len(tree.top)
        return pa.table(
            {
                "bucket": pa.array(np.full(n, table.column("bucket")[0].as_py(), np.int32)), "c1": pa.array(((tree.top >> (8 * (low - 1))) & 255).astype(np.int32)),
                "node": tree.top, "n0": tree.n[low][:, 0], "n1": tree.n[low][:, 1], "log_pw": tree.log_pw[low],
            }
        )

    nodes = staged(lists.groupBy("bucket").applyInArrow(tops, NODES), "ctw-nodes")

    def upper(table: pa.Table) -> tuple[pa.Table, Levels]:
        """Depth one to ``low`` over one last byte."""
        table = table.sort_by("node")
        node, n0, n1, log_pw = (table.column(c).to_numpy() for c in ("node", "n0", "n1", "log_pw"))
        return table, Levels(node, np.stack([n0, n1], axis=1), log_pw, low, 1)

    def one_byte(table: pa.Table) -> pa.Table:
        tree = upper(table)[1]
        return pa.table({"node": tree.top, "n0": tree.n[1][:, 0], "n1": tree.n[1][:, 1], "log_pw": tree.log_pw[1]})

    ones = sorted(nodes.groupBy("c1").applyInArrow(one_byte, "node long, n0 double, n1 double, log_pw double").collect())
    if ones:
        names, n0, n1, log_pw = map(np.array, zip(*ones))
        root_share, root_above = Levels(names, np.stack([n0, n1], axis=1), log_pw, 1, 0).fall()

    def lower(table: pa.Table) -> pa.Table:
        """What lies above each node of depth ``low``."""
        table, tree = upper(table)
        at = np.searchsorted(names, tree.top)
        share, p = tree.fall(root_share[at], root_above[at])
        return pa.table({"at": table.column("bucket"), "node": table.column("node"), "share": share, "p0": p[:, 0], "p1": p[:, 1]})

    above = nodes.groupBy("c1").applyInArrow(lower, "at int, node long, share double, p0 double, p1 double")

    def values(own: pa.Table, found: pa.Table) -> pa.Table:
        keys, n = _bucket_keys(own)
        found = found.sort_by("node")
        share, p0, p1 = (found.column(c).to_numpy() for c in ("share", "p0", "p1"))
        tree = Subtree(keys, n, depth, low)
        logp = tree.log10(tree.ones(share, np.stack([p0, p1], axis=1)), len(keys))
        steps = np.rint(-logp / STEP).astype("<i8")
        out = pa.array((_pack(steps[np.searchsorted(keys, k)]) for _, k, _ in _key_lists(own)), pa.binary())
        return pa.table({"block": own.column("block"), "list": own.column("list"), "bucket": own.column("bucket"), "size": own.column("size"), "found": out})

    return lists.groupBy("bucket").cogroup(above.groupBy("at")).applyInArrow(values, "block long, list string, bucket int, size int, found binary")


# ------------------------------------------------------------------------------------------------ scores


def _in_order(found: pa.Table, name: str, order: np.ndarray) -> np.ndarray:
    """The numbers of a block's lists, in the order of its words or keys."""
    found = found.filter(pc.equal(found.column("list"), name)).sort_by("bucket")
    out = np.zeros(len(order), np.int64)
    out[order] = np.concatenate([_unpack(v.as_py(), s.as_py(), "<i8") for v, s in zip(found.column("found"), found.column("size"))])
    return out


def _texts(found: pa.Table) -> list[bytes]:
    """The streams of a block's documents."""
    found = found.filter(pc.equal(found.column("list"), "texts")).sort_by("bucket")
    whole = b"".join(pa.decompress(v.as_py(), s.as_py(), codec="zstd", asbytes=True) for v, s in zip(found.column("found"), found.column("size")))
    return [text + END for text in whole.split(END)[:-1]]


def score_texts(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    ``held`` tells the documents that the model does not learn from.
    """
    doc_id = docs.schema[id_col].dataType.simpleString()
    buckets = max(MIN_BUCKETS, parts_for(docs.agg(F.sum(F.octet_length(text_col))).first()[0], BUCKET_BYTES))
    rows = docs.select(F.col(id_col).alias("_id"), held.alias("_held"), F.col(text_col).alias("_text")).mapInArrow(
        _blocks(depth, buckets),
        f"block long, doc_id {doc_id}, held_out boolean, n_bytes long, list string, bucket int, size int, names binary, counts binary",
    )
    rows = staged(rows, "ctw-blocks")
    documents = rows.where("list IS NULL").select("block", "doc_id", "held_out", "n_bytes", F.col("size").alias("place"))
    texts = rows.where("list = 'texts'").select("block", "list", "bucket", "size", F.col("names").alias("found"))
    lists = rows.where("list IN ('words', 'keys')").select("block", "list", "bucket", "size", "n_bytes", "names", "counts")

    counted = lists.where("list = 'words'").groupBy("bucket").applyInArrow(
        _word_counts, "block long, list string, bucket int, size int, found binary, tokens long, distinct long"
    )
    counted = staged(counted, "ctw-words")
    total = counted.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    tokens, distinct = int(total["tokens"] or 0), int(total["distinct"] or 0)
    values = _key_values(lists.where("list = 'keys'").drop("n_bytes"), depth)

    def document_values(own: pa.Table, found: pa.Table) -> pa.Table:
        own, texts = own.sort_by("place"), _texts(found)
        words, at, ends = _words(texts)
        c = _in_order(found, "words", _by_bucket(_word_buckets(words, buckets))[0])
        base = np.log10((c + 1) / (tokens + distinct + 1))
        n_tokens, n_known, base_score = np.diff(ends, prepend=0), [], []
        for start, end in zip(ends - n_tokens, ends):
            own_words = at[start:end]
            n_known.append(int((c[own_words] > 0).sum()))
            base_score.append(float(base[own_words].sum()))
        del at, words

        keys = _distinct_keys(texts, depth)
        logp = _in_order(found, "keys", _by_bucket(_key_buckets(keys, depth, buckets))[0]) * -STEP
        score, places = np.zeros(len(texts)), Places(keys)
        for key, text in running_keys(texts, depth):
            score += np.bincount(text, logp[places.of(key)], len(texts))
        return pa.table(
            {
                "doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([tokens] * own.num_rows, pa.int64()), "base_score": base_score, "score": score,
                "bits_per_byte": -score / np.log10(2) / (own.column("n_bytes").to_numpy() + 1),
            }
        )

    found = counted.drop("tokens", "distinct").unionByName(values).unionByName(texts).withColumnRenamed("block", "at")
    return documents.groupBy("block").cogroup(found.groupBy("at")).applyInArrow(
        document_values,
        f"doc_id {doc_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )
