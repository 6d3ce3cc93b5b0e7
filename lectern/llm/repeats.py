"""Exact substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if a string of ``length`` bytes that covers it also starts elsewhere, in the same or in another document.

1. Each start of such a string belongs to the anchor of the string: its smallest hash of ``GRAM`` bytes, the first of them. Equal strings
   have equal anchors. Neighbouring starts with one anchor at one place form a segment (at most ``RUN`` starts).
2. Anchors that occur once have no repeated string and go. Segments are counted by anchor and content: one that occurs twice is
   repeated as a whole. What is left are different segments with a common anchor, around the borders of passages; of
   those, only segments that also share the half string before or behind the anchor with another one can hold a repeated string.
3. The bytes of those segments, each content once, meet by anchor in groups of about ``GROUP_BYTES``. There the suffix
   array and its BWT are built, and intervals are extended backwards, breadth first: level n finds all borders whose common prefix
   is n bytes long. It stops at ``length``; borders that are still open then are those between starts with equal strings.
4. Anchors with more than ``HOT`` different segments are not put into one group: their strings are counted by hash instead,
   which Spark pre-aggregates, with the same result.
5. Marked starts become spans of their documents, in buckets of documents; texts are read again to cut them.

Contents and halves of strings are known by 64-bit hashes beside the 64-bit anchor.

Defined results: null text is empty; a document shorter than ``length`` bytes loses nothing; rows equal in id and text are documents of
their own that repeat each other; ids may be null or repeat; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import parts_for, row_key, text_bytes
from lectern.session import staged

LENGTH = 200
GRAM = 32
RUN = 256
HOT = 4096
GROUP_BYTES = 1 << 20
BUCKET_BYTES = 8 << 20
PACKED = 4  # symbols that the first sort of suffixes compares
SMALL = 32 << 20  # bytes of a table that is broadcast instead of shuffling texts or all segments
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: bytes, gram: int = GRAM) -> np.ndarray:
    """Hash of the ``gram`` bytes at each place."""
    n = len(data) - gram + 1
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    eights = np.zeros(len(data), np.uint64)
    for k in range(8):
        eights |= padded[k : k + len(data)].astype(np.uint64) << np.uint64(8 * k)
    h = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        h = (h ^ eights[at : at + n]) * _ODD
        h ^= h >> np.uint64(29)
    return h


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    have, out = 1, h
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def gram_length(length: int) -> int:
    return min(GRAM, max(8, length // 4) // 8 * 8)


def segments(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, first start, number of starts, place of the anchor after the start) of the segments of a text."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    gram = gram_length(length)
    h = _gram_hashes(data, gram)
    # the upper half of the hash decides, then the first place; so two equal strings never have one place in common
    place = _window_min(h >> np.uint64(32) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & np.uint64(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    n = np.diff(np.append(first, len(place)))
    pieces = -(-n // RUN)
    run = np.repeat(np.arange(len(first)), pieces)
    step = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[run] + step * RUN
    at = place[start].astype(np.int64)
    return h[at].view(np.int64), start, np.minimum(RUN, n[run] - step * RUN), at - start


def _find_segments(length: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows, contents = [], []
                for row, text in zip(part.column("_row").to_pylist(), part.column("_text").to_pylist()):
                    data = text_bytes(text)
                    anchor, start, n, gram_at = segments(data, length)
                    rows.append((np.full(len(anchor), row, np.int64), anchor, start, n, gram_at))
                    view = memoryview(data)
                    contents += [xxhash.xxh3_64_intdigest(view[s : s + k + length - 1]) for s, k in zip(start.tolist(), n.tolist())]
                row, anchor, start, n, gram_at = (np.concatenate(x) for x in zip(*rows))
                content = np.array(contents, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"_row": row, "anchor": anchor, "start": start, "n": n.astype(np.int32), "gram_at": gram_at.astype(np.int32), "content": content}
                )

    return find


# ------------------------------------------------------------------------------------------------ suffixes of a group


def _by_key(key: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of keys of so many bits; sorted together with the places where both fit one number, which is faster."""
    own = len(key).bit_length()
    if bits + own > 63:
        return np.argsort(key)
    return np.sort(key << own | np.arange(len(key))) & ((1 << own) - 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling from ``PACKED`` symbols on; symbols above 255 occur once, the last one is such. Only ties are sorted again."""
    n, end = len(symbols), symbols > 255
    key, after, code = np.zeros(n, np.int64), np.zeros(n, bool), np.minimum(symbols, 256) + 1
    for k in range(PACKED):
        key <<= 9
        key[: n - k] += np.where(after[: n - k], 0, code[k:])
        after[: n - k] |= end[k:]
    order = _by_key(key, 9 * PACKED)
    # those with a separator among the packed symbols are different all the same, in the order of their separators
    alone = after[order]
    own = order[alone]
    order[alone] = own[np.lexsort((own, key[own]))]
    key = key[order]
    head = np.concatenate([[True], (key[1:] != key[:-1]) | alone[1:]])  # of the suffixes that share the first h symbols
    rank, h, bits = np.empty(n, np.int64), PACKED, n.bit_length()
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        own = order[at]
        key = rank[own] << bits | rank[own + h]  # tied ones have no separator among h symbols, so they do not end there
        by = _by_key(key, 2 * bits)
        own, key = own[by], key[by]
        order[at], head[at] = own, np.concatenate([[True], key[1:] != key[:-1]])
        rank[own] = np.maximum.accumulate(np.where(head[at], at, 0))
        h *= 2


def open_borders(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Borders between neighbours in suffix order that share at least ``length`` symbols (border k: of suffixes k - 1 and k).

    The interval of the empty string is extended backwards by each symbol in front of it. An interval of level n whose right border is
    still open gives it the common prefix n - 1 and is extended further; others have been seen.
    """
    n = len(order)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    back = rank[order - 1]  # the place of the suffix with one symbol more in front; before the first stands the last separator
    letter, owner = symbols[order].astype(np.int32), np.empty(n, np.int32)
    border = np.ones(n + 1, bool)
    border[0] = border[n] = False
    left, right = np.array([0]), np.array([n])
    for level in range(length):
        if not len(left):
            break
        sizes = right - left
        interval = np.repeat(np.arange(len(left), dtype=np.int32), sizes)
        to = back[np.arange(len(interval)) + np.repeat(left - np.cumsum(sizes) + sizes, sizes)]
        # all elements of an interval with one symbol in front stand together: the first and last of them give the new interval
        owner[to] = interval
        to.sort()
        mine, front = owner[to], letter[to]
        first = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (front[1:] != front[:-1])]))
        to_left, to_right = to[first], to[np.append(first[1:], len(to)) - 1] + 1
        found = border[to_right] | ((level == 0) & (to_right == n))
        border[to_right] = False
        # an interval of one suffix has no border inside; its right border is closed all the same
        left, right = to_left[found], to_right[found]
    return border


def repeated_starts(texts: list[bytes], starts: list[int], length: int = LENGTH) -> list[bytes]:
    """For each segment the bits of its starts whose string of ``length`` bytes occurs twice in the group."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(sizes.sum()) + len(texts)
    symbols = np.empty(total, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(total, bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8)
    symbols[ends] = 256 + np.arange(len(texts))
    order = suffix_array(symbols)
    border = open_borders(symbols, order, length)
    hit = np.zeros(total, bool)
    hit[order] = border[:-1] | border[1:]
    first = ends - sizes
    return [np.packbits(hit[a : a + k]).tobytes() for a, k in zip(first.tolist(), starts)]


def _expand(length: int):
    def expand(table: pa.Table) -> pa.Table:
        starts = table.column("n").to_pylist()
        bits = repeated_starts(table.column("bytes").to_pylist(), starts, length)
        return pa.table({"anchor": table.column("anchor"), "content": table.column("content"), "bits": pa.array(bits, pa.binary())})

    return expand


def _string_hashes(length: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, content, data, n in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "bytes", "n"))):
                view = memoryview(data)
                own = [hashlib.blake2b(view[k : k + length], digest_size=16).digest() for k in range(n)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "anchor": pa.array([anchor] * n, pa.int64()), "content": pa.array([content] * n, pa.int64()), "n": pa.array([n] * n, pa.int32()),
                        "k": pa.array(range(n), pa.int32()), "string": pa.array(own, pa.binary()),
                    }
                )

    return hashes


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, own in zip(batch.column("n").to_pylist(), batch.column("ks").to_pylist()):
            hit = np.zeros(n, bool)
            hit[own] = True
            out.append(np.packbits(hit).tobytes())
        yield pa.RecordBatch.from_pydict({"anchor": batch.column("anchor"), "content": batch.column("content"), "bits": pa.array(out, pa.binary())})


# ------------------------------------------------------------------------------------------------ documents


def _cut_out(length: int):
    gram = gram_length(length)
    half = -(-(length - gram) // 2)

    def sides(data: memoryview, at: int) -> tuple[int | None, int | None]:
        """Hashes of the anchor with ``half`` bytes before it, and behind it: a string around it has all of one of the two."""
        left = xxhash.xxh3_64_intdigest(data[at - half : at + gram]) if at >= half else None
        right = xxhash.xxh3_64_intdigest(data[at : at + gram + half], 1) if at + gram + half <= len(data) else None
        return left, right

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of the wanted segments of a document."""
        for batch in batches:
            for at in range(0, len(batch), 200):
                part, out = batch.slice(at, 200), []
                for text, wanted in zip(part.column("_text").to_pylist(), part.column("wanted").to_pylist()):
                    data = memoryview(text_bytes(text))
                    for w in wanted:
                        own = bytes(data[w["start"] : w["start"] + w["n"] + length - 1])
                        out.append((w["anchor"], w["content"], w["n"], own, *sides(data, w["start"] + w["gram_at"])))
                anchor, content, n, own, left, right = zip(*out)
                signed = lambda x: pa.array([None if v is None else v - 2**64 if v >= 2**63 else v for v in x], pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {"anchor": pa.array(anchor), "content": pa.array(content), "n": pa.array(n, pa.int32()), "bytes": pa.array(own, pa.binary()), "left": signed(left), "right": signed(right)}
                )

    return cut


def spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs that the strings at ``starts`` cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    new = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.append(0, new)].tolist(), (starts[np.append(new - 1, len(starts) - 1)] + length).tolist()))


def _document_spans(length: int):
    def run(table: pa.Table) -> pa.Table:
        """(_row, begins, ends) of the documents of a bucket."""
        hits: dict[int, list] = {}
        for row, start, n, bits in zip(*(table.column(c).to_pylist() for c in ("_row", "start", "n", "bits"))):
            at = np.arange(n) if bits is None else np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=n))
            hits.setdefault(row, []).append(start + at)
        found = [spans(np.concatenate(x), length) for x in hits.values()]
        whole = pa.list_(pa.int64())
        return pa.table({"_at": list(hits), "begins": pa.array([[a for a, _ in x] for x in found], whole), "ends": pa.array([[b for _, b in x] for x in found], whole)})

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each document."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part, out = batch.slice(at, 500), []
            for text, begins, ends in zip(*(part.column(c).to_pylist() for c in ("_text", "begins", "ends"))):
                data, kept, end = text_bytes(text), [], 0
                for a, b in zip(begins or [], ends or []):
                    kept.append(data[end:a])
                    end = b
                rest = b"".join([*kept, data[end:]])
                out.append((len(data), len(data) - len(rest), len(begins or []), hashlib.sha256(rest).hexdigest(), rest, [{"begin": a, "end": b} for a, b in zip(begins or [], ends or [])]))
            n, removed, count, digest, rest, found = zip(*out)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()),
                    "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(rest, pa.binary()),
                    "spans": pa.array(found, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                }
            )


def _broadcast_if_small(table: DataFrame, n_bytes: Column) -> DataFrame:
    """Broadcast hint where the rows of a stored table, of ``n_bytes`` each, are SMALL bytes together or fewer."""
    return F.broadcast(table) if (table.agg(F.sum(n_bytes)).first()[0] or 0) <= SMALL else table


def _same_segment(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (anchor, content)."""
    b = b.withColumnsRenamed({"anchor": "_a", "content": "_c"})
    return a.join(b, (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")), how).drop("_a", "_c")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, spans) of every document; ``kept`` are the bytes that stay."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_row"))
    found = staged(
        rows.select("_row", "_text").mapInArrow(_find_segments(length), "_row long, anchor long, start long, n int, gram_at int, content long"), "repeat-segments"
    )
    several_uses = found.groupBy("anchor").agg(F.count("*").alias("uses")).where("uses > 1").select(F.col("anchor").alias("_a"))
    several_uses = _broadcast_if_small(staged(several_uses, "repeat-anchors"), F.lit(16))
    found = staged(found.join(several_uses, F.col("anchor") == F.col("_a"), "left_semi"), "repeat-several")

    contents = found.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("_row", "start", "n", "gram_at")).alias("at"))
    kinds = contents.groupBy("anchor").agg(F.count("*").alias("kinds")).withColumnRenamed("anchor", "_a")
    contents = staged(contents.join(kinds, F.col("anchor") == F.col("_a")).drop("_a"), "repeat-contents")
    wanted = contents.where("kinds > 1").select(F.col("at._row").alias("_at"), F.struct("anchor", "content", "at.start", "at.n", "at.gram_at").alias("w"))
    wanted = _broadcast_if_small(staged(wanted.groupBy("_at").agg(F.collect_list("w").alias("wanted")), "repeat-wanted"), F.size("wanted") * 64 + 32)
    once = rows.join(wanted, F.col("_row") == F.col("_at")).dropDuplicates(["_row"]).select("_text", "wanted")
    cut = staged(once.mapInArrow(_cut_out(length), "anchor long, content long, n int, bytes binary, left long, right long"), "repeat-bytes")

    sides = cut.select("anchor", "content", F.explode(F.array("left", "right")).alias("side")).where("side IS NOT NULL")
    shared = sides.groupBy("anchor", "side").agg(F.count("*").alias("uses")).where("uses > 1").select(F.col("anchor").alias("_a"), F.col("side").alias("_s"))
    near = sides.join(shared, (F.col("anchor") == F.col("_a")) & (F.col("side") == F.col("_s"))).select("anchor", "content").distinct()
    near = staged(near, "repeat-near")
    size = near.groupBy("anchor").agg(F.count("*").alias("kinds")).withColumnRenamed("anchor", "_k")
    cut = staged(_same_segment(cut.select("anchor", "content", "n", "bytes"), near).join(size, F.col("anchor") == F.col("_k")).drop("_k"), "repeat-bytes")

    groups = parts_for(cut.agg(F.sum(F.octet_length("bytes"))).first()[0], GROUP_BYTES)
    small = cut.where(F.col("kinds") <= hot).withColumn("_group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    by_bwt = small.groupBy("_group").applyInArrow(_expand(length), "anchor long, content long, bits binary")

    strings = cut.where(F.col("kinds") > hot).drop("kinds").mapInArrow(_string_hashes(length), "anchor long, content long, n int, k int, string binary")
    often = strings.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select(F.col("string").alias("_s"))
    by_hash = strings.join(often, F.col("string") == F.col("_s")).groupBy("anchor", "content", "n").agg(F.collect_list("k").alias("ks"))
    by_hash = by_hash.mapInArrow(_bits, "anchor long, content long, bits binary")

    whole = contents.where("times > 1").select("anchor", "content", F.lit(None).cast("binary").alias("bits"))
    part = by_bwt.unionByName(by_hash).where(F.length(F.translate(F.hex("bits"), "0", "")) > 0)
    part = _same_segment(part, contents.where("times = 1").select("anchor", "content"), "left_semi")
    marks = staged(whole.unionByName(part), "repeat-marks")
    marked = _same_segment(found.select("_row", "anchor", "content", "start", "n"), marks).select("_row", "start", "n", "bits")
    buckets = parts_for(found.count() * 200, BUCKET_BYTES)
    covered = marked.withColumn("_bucket", F.pmod(F.col("_row"), F.lit(buckets))).groupBy("_bucket").applyInArrow(_document_spans(length), "_at long, begins array<long>, ends array<long>")
    covered = _broadcast_if_small(staged(covered, "repeat-spans"), (F.size("begins") + F.size("ends")) * 8 + 64)
    return rows.join(covered, F.col("_row") == F.col("_at"), "left").select("_id", "_text", "begins", "ends").mapInArrow(
        _removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<begin: bigint, end: bigint>>"
    )
