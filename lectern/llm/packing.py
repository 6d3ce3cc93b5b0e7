"""Tokens of documents, and packing of token pieces into sequences of bounded length.

A packing algorithm works on the histogram of piece lengths (at most ``capacity`` numbers, whatever the number of pieces) and
returns patterns: lengths of one sequence, with the number of sequences that look like it. A piece finds its place from its
rank among the pieces of its length, so pieces are never gathered on the driver and no length meets in one task: ranks are
counted per (length, salt), and the ``capacity * SALTS`` counts are the largest thing that the driver sees.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import staged

CAPACITY = 2048
SALTS = 256
CACHE = 300_000  # words whose ids a worker remembers; more only costs time

Pattern = tuple[list[int], int]

# A piece of the tokenizer never holds white space after other characters, so a text may be cut before white space.
_CHUNKS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
# White space beyond that of _CHUNKS (and separators that only Python takes for it): such texts are not cut.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


#: The pieces of byte-level BPE, fixed by the tokenizer file's kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 characters are themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers; ids of frequent words are remembered.

    ``path`` is a tokenizer file of the library tokenizers, of the kind byte-level BPE whose ids stand in the order of their merges. Its
    vocabulary is run by tiktoken, which gives the same ids in a quarter of the time (tests compare the two). With ``added``, the file's added
    tokens are found in texts, as the library does unless its ``encode_special_tokens`` is set; without, they are spelled like other text.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocabulary, own = data["model"]["vocab"], data.get("added_tokens") or []
        before = data.get("pre_tokenizer") or {}
        if data["model"].get("type", "BPE") != "BPE" or data.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("only byte-level BPE without a normaliser or a blank before the text is supported")
        self.largest = max([*vocabulary.values(), *[x["id"] for x in own]])
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in own):
            raise ValueError("added tokens that hang on the text around them are not supported")
        self.added = {x["content"]: array("I", [x["id"]]).tobytes() for x in own} if added else {}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        symbols, names = _byte_symbols(), {x["content"] for x in own}
        ranks = {bytes(symbols[c] for c in token): i for token, i in vocabulary.items() if all(c in symbols for c in token) and token not in names}
        self.encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        ids = map(self.encoding.encode_ordinary, texts)
        return [array("I", x).tobytes() for x in ids]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if self.split and self.split.search(text):
                # an added token ends the text before it; what stands between two of them is encoded alone
                parts = self.split.split(text)
                yield b"".join(self.added[x] if k % 2 else self._encode([x])[0] for k, x in enumerate(parts))
                continue
            if _OTHER_SPACE.search(text):
                yield self._encode([text])[0]
                continue
            chunks = _CHUNKS.findall(text)
            if len(self.known) > CACHE:
                self.known = {}
            new = list({x for x in chunks if x not in self.known})
            if new:
                self.known.update(zip(new, self._encode(new)))
            yield b"".join(map(self.known.__getitem__, chunks))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path, added=True)
    return _encoders[path]


def id_width(largest: int) -> int:
    """Bytes of an id in matrices: two where they hold the largest id."""
    return 2 if largest < 1 << 16 else 4


def squeezed(ids: np.ndarray, width: int, compress: Callable[[bytes], bytes]) -> bytes:
    """Ids as compressed bytes."""
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"an id does not fit into {width} bytes")
    return compress(ids.astype(f"<u{width}").tobytes())


def stretched(data: bytes, width: int, decompress: Callable[[bytes], bytes]) -> np.ndarray:
    return np.frombuffer(decompress(data), f"<u{width}")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", width: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every document: its token ids, then ``end_id``, cut into pieces.

    With a ``width``, ``ids`` are a piece's ids of that many bytes each, ``squeezed``.

    Null text is empty: it gives one piece that holds the end id only. Rows with equal or null ids are cut on their own.
    """
    tail = np.asarray([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows, packed = [], []
                for k, ids in enumerate(encode([x or "" for x in part.column("_text").to_pylist()])):
                    ids += tail
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((k, piece, start, length, zlib.crc32(own)))
                        if width:
                            packed.append(squeezed(np.frombuffer(own, "<u4"), width, compress))
                k, piece, start, length, crc = np.array(rows, np.int64).T
                out = {"doc_id": part.column("_id").take(pa.array(k)), "piece": pa.array(piece, pa.int32()), "start": start, "length": length, "ids_crc32": crc}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(packed, pa.binary())} if width else {}))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * bool(width)
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(pieces, schema)


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns by best-two-fit. ``counts[n]`` pieces have length n.

    A sequence is filled with the longest pieces that fit. Then its smallest piece gives way to two unpacked
    pieces that fit the gap it leaves more tightly. The choices hang only on which lengths are left, so a pattern is
    used as often as its lengths allow before the next is sought: the result is that of packing one sequence at a time.
    """
    left = counts.astype(np.int64).copy()
    patterns = []
    while left[1:].any():
        have, own, gap = left.copy(), [], capacity
        while gap > 0 and have[1 : gap + 1].any():
            n = int(np.flatnonzero(have[1 : gap + 1])[-1]) + 1
            own.append(n)
            have[n] -= 1
            gap -= n
        while gap > 0 and len(own) > 0:
            small = min(own)
            a = np.flatnonzero(have[: gap + small + 1] > 0)
            a = a[a > 0]
            if not len(a):
                break
            # the longest partner of each length that still fits; a partner of the same length needs two pieces
            rest = np.minimum(gap + small - a, a)
            longest = np.maximum.accumulate(np.where(have > 0, np.arange(len(have)), 0))
            b = longest[rest]
            twice = (b == a) & (have[a] < 2)
            b[twice] = longest[a[twice] - 1]
            total = np.where(b > 0, a + b, 0)
            k = int(np.argmax(total))
            if total[k] <= small:
                break
            own.remove(small)
            own += [int(a[k]), int(b[k])]
            have[small] += 1
            have[a[k]] -= 1
            have[b[k]] -= 1
            gap = capacity - sum(own)
            break
        lengths, uses = np.unique(own, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        patterns.append((own, times))
    return patterns


class CapacityTree:
    """Segment tree over remaining capacities: finds the smallest one of at least a given size that some sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sum = np.zeros(2 * self.leaves, np.int64)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.sum[k] += n
            k >>= 1

    def at_least(self, capacity: int) -> int | None:
        k = capacity + self.leaves
        if self.sum[k]:
            return capacity
        while k > 1 and (k & 1 or not self.sum[k + 1]):
            k >>= 1
        if k == 1:
            return None
        k += 1
        while k < self.leaves:
            k = 2 * k if self.sum[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns by best-fit-decreasing: each piece, longest first, goes where it leaves the least room.

    Sequences of equal content are kept as one group with a count. A sequence that takes a piece stays the tightest as long as
    it can take more, so a group takes ``room // length`` pieces each before the next group is asked.
    """
    tree, groups, full = CapacityTree(capacity), {}, []

    def put(own: list[int], room: int, times: int) -> None:
        if times and room:
            groups.setdefault(room, []).append((own, times))
            tree.add(room, times)
        elif times:
            full.append((own, times))

    for n in range(capacity, 0, -1):
        todo = int(counts[n])
        while todo:
            room = tree.at_least(n)
            if room is None:
                each = capacity // n
                put([n] * each, capacity - each * n, todo // each)
                put([n] * (todo % each), capacity - todo % each * n, 1 if todo % each else 0)
                break
            own, times = groups[room].pop()
            tree.add(room, -times)
            each = room // n
            whole = min(times, todo // each)
            put(own + [n] * each, room - each * n, whole)
            todo -= whole * each
            if whole < times:
                put(own + [n] * todo, room - todo * n, 1 if todo else 0)
                put(own, room, times - whole - (1 if todo else 0))
                todo = 0
    return full + [x for rows in groups.values() for x in rows]


def places(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For pieces sorted by length and rank: the first rank of each run with its length, first sequence and offset."""
    rows, rank, sequence = [], {}, 0
    for own, times in patterns:
        offset = 0
        for n in own:
            at = rank.get(n, 0)
            rows.append((n, at, sequence, offset))
            rank[n] = at + times
            offset += n
        sequence += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(pieces: DataFrame, algorithm: Callable[[np.ndarray, int], list[Pattern]], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored, with doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``."""
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    salted = pieces.withColumn("_salt", salt)
    found = np.zeros((capacity + 1, SALTS), np.int64)
    for n, s, count in salted.groupBy("length", "_salt").count().toPandas().itertuples(index=False):
        found[n, s] = count
    first = np.cumsum(found, axis=1) - found  # rank of the first piece of each (length, salt)
    lengths, ranks, sequences, offsets = places(algorithm(found.sum(axis=1), capacity))
    shift = 1 << 44
    runs = lengths * shift + ranks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, salt, rn = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_salt", "_rn"))
            rank = first[n, salt] + rn - 1
            k = np.searchsorted(runs, n * shift + rank, "right") - 1
            out = {c: batch.column(c) for c in batch.schema.names if c not in ("_salt", "_rn")}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": sequences[k] + rank - ranks[k], "offset": offsets[k]})

    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return salted.withColumn("_rn", F.row_number().over(order)).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **columns) -> DataFrame:
    """Best-two-fit packing of all documents: a row per piece with its sequence and place."""
    pieces = staged(token_pieces(docs, tokenizer, 0, capacity, **columns), "pack-pieces")
    return pack(pieces, best_two_fit, capacity)


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 50256, **columns) -> DataFrame:
    """Best-fit-decreasing packing into model input, a row per sequence.

    ``input_ids`` and ``position_ids`` are rows of the id and position matrices: ``capacity`` little-endian unsigned 16-bit numbers
    (32-bit ones where the vocabulary or the end id asks for it), filled up with the end id and zeros; positions start again at 0 with each piece. ``cu_seqlens`` are the ends of the pieces, from 0.
    ``doc_ids``, ``pieces`` and ``starts`` tell what each piece is. Every token of every document is in exactly one place; documents
    longer than the capacity are cut into pieces. An empty table gives no sequence.
    """
    width = id_width(max(encoder(tokenizer).largest, end_id, capacity))
    pieces = staged(token_pieces(docs, tokenizer, end_id, capacity, width=width, **columns), "pack-ids")
    packed = pack(pieces, best_fit_decreasing, capacity)
    part = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("p"))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                parts = part.column("ids")
                segments = [stretched(x, width, decompress) for x in parts.flatten().to_pylist()]
                sizes = np.fromiter(map(len, segments), np.int64, len(segments))
                starts = np.cumsum(sizes) - sizes
                own = np.concatenate(segments)
                row = np.repeat(np.arange(len(part)), pa.compute.list_value_length(parts).to_numpy())
                filled = np.arange(capacity) < np.bincount(row, weights=sizes, minlength=len(part)).astype(np.int64)[:, None]
                out = {c: part.column(c) for c in part.schema.names if c != "ids"}
                for name, rest, values in (("input_ids", end_id, own), ("position_ids", 0, np.arange(len(own)) - np.repeat(starts, sizes))):
                    matrix = np.full((len(part), capacity), rest, f"<u{width}")
                    matrix[filled] = values
                    out[name] = pa.array([x.tobytes() for x in matrix], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    flat = rows.select(
        "sequence_id", F.size("p").alias("n_segments"),
        F.concat(F.array(F.lit(0)), F.transform("p", lambda x: (x["offset"] + x["length"]).cast("int"))).alias("cu_seqlens"),
        F.col("p.doc_id").alias("doc_ids"), F.col("p.piece").alias("pieces"), F.col("p.start").alias("starts"), F.col("p.ids").alias("ids"),
    )
    return flat.mapInArrow(
        matrices,
        f"sequence_id long, n_segments int, cu_seqlens array<int>, doc_ids array<{kind}>, pieces array<int>, starts array<long>, input_ids binary, position_ids binary",
    )


def write_sequences(sequences: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet, one row of the id matrix per row."""
    sequences.write.mode("errorifexists").parquet(path)
