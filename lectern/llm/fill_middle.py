"""Fill-in-the-middle transformation by secondary sort.

A text is cut into units (lines). Two places drawn from the document's id divide it into prefix, middle and suffix; the output has them in
the order of a form, each behind its mark. Nothing is put together in a row: a document becomes pieces of whole units, keyed by (row,
place in the output). ``repartitionAndSortWithinPartitions`` brings a document's pieces to one task in output order, where they stream
through an incremental digest. Restoration reads that stream of output pieces and the form alone: marks tell the part a piece belongs to,
the piece gets its place in the text as new key, and a second ``repartitionAndSortWithinPartitions`` by (row, place in the text) streams
the restored text. Its partitioner equals the first one's, so that pieces are sorted anew where they are and not moved again.

A task holds one batch of pieces in the sorter, which spills to the executor's disk, and one piece per digest: a document of any length
costs constant memory. Pieces longer than ``PIECE_BYTES`` are cut inside a unit. Documents are spread by row number, so that equal ids,
null ids and copies do not meet. The row number is that of the read order; ``docs`` must be a stored table (or a narrow step on one), which
gives the same order when a lost task is run again.

Defined results: null text is empty; an empty text and one that contains a mark stay as they are (form ``plain``); a null id draws as an
empty id; ties cannot occur, repeated rows are transformed each; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import parts_for

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PIECE_BYTES = 1 << 16
PART_BYTES = 32 << 20  # text of a shuffle partition
#: Order of the parts behind their marks in the output, and in the text.
FORMS = {"psm": "PSM", "spm": "SPM"}
IN_TEXT = "PMS"
PLACES = 1 << 40  # places of a part of a text

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Rates:
    """Per cent of documents that are transformed, and of these in suffix-first form; ``seed`` enters the draws."""

    transformed: int = 100
    spm: int = 50
    seed: int = 7


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def unit_ends(data: bytes) -> list[int]:
    """Ends of the units in the bytes of a text: behind each line break, and at the end."""
    ends, at = [], data.find(b"\n") + 1
    while at:
        ends.append(at)
        at = data.find(b"\n", at) + 1
    if data and (not ends or ends[-1] < len(data)):
        ends.append(len(data))
    return ends


def chunks(data: bytes, ends: list[int], first: int, last: int, size: int) -> Iterator[bytes]:
    """The units [first, last) in pieces of whole units of at most ``size`` bytes; longer units are cut."""
    begin = ends[first - 1] if first else 0
    done, at = begin, begin
    for end in ends[first:last]:
        if end - done > size and at > done:
            yield data[done:at]
            done = at
        while end - done > size:
            yield data[done : done + size]
            done += size
        at = end
    if at > done:
        yield data[done:at]


def cut(row: int, doc_id: int | None, text: str | None, rates: Rates, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple]:
    """((row, place in the output), content) of a document: its head at place 0, then marks and pieces in output order."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(doc_id, rates.seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rates.transformed:
        yield (row, 0), (doc_id, n, "plain", None, None)
        for place, piece in enumerate(chunks(data, ends, 0, n, piece_bytes), 1):
            yield (row, place), piece
        return
    form = "spm" if h4 % 100 < rates.spm else "psm"
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    spans = {"P": (0, a), "M": (a, b), "S": (b, n)}
    edge = [ends[i - 1] if i else 0 for i in (a, b)]
    chars = [len(data[lo:hi].decode("utf-8", "surrogatepass")) for lo, hi in ((0, edge[0]), (edge[0], edge[1]))]
    yield (row, 0), (doc_id, n, form, *chars)
    place = 1
    for part in FORMS[form]:
        yield (row, place), f"<{part}>".encode()
        for piece in chunks(data, ends, *spans[part], piece_bytes):
            place += 1
            yield (row, place), piece
        place += 1


def part_of(key: tuple) -> int:
    """Partition function: rows one after the other, whatever their ids."""
    return key[0] % PLACES + (key[0] >> 33)


def output_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates(), piece_bytes: int = PIECE_BYTES) -> RDD:
    """((row, place), content) sorted in each partition; all pieces of a row are in one partition, its head comes first."""
    n_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0]
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, parts_for(n_bytes, PART_BYTES))
    slim = docs.select(F.monotonically_increasing_id().alias("r"), F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).rdd
    pieces = slim.flatMap(lambda x: cut(x[0], x[1], x[2], rates, piece_bytes))
    return pieces.repartitionAndSortWithinPartitions(parts, part_of)


def restored_pieces(sorted_pieces: RDD) -> RDD:
    """The same rows sorted by place in the text, told from the output pieces and the form in the row's head.

    A row's head comes last in its place order, with the digest and the number of characters of the output behind it.
    """

    def relabel(records: Iterator[tuple]) -> Iterator[tuple]:
        row, head, digest, part, place, n_chars = None, None, None, 0, 0, 0
        for (r, _), content in records:
            if r != row:
                if row is not None:
                    yield (row, len(IN_TEXT) * PLACES), (*head, digest.hexdigest(), n_chars)
                row, head, digest, part, place, n_chars = r, content, hashlib.sha256(), 0, 0, 0
                continue
            digest.update(content)
            n_chars += characters(content)
            marked = head[2] != "plain" and len(content) == 3 and content in MARKS
            if marked:
                part, place = IN_TEXT.index(chr(content[1])), 0
            else:
                place += 1
                yield (row, part * PLACES + place), content
        if row is not None:
            yield (row, len(IN_TEXT) * PLACES), (*head, digest.hexdigest(), n_chars)

    # Keys keep their row, so the partitioner still holds and the next sort needs no exchange.
    placed = sorted_pieces.mapPartitions(relabel, preservesPartitioning=True)
    return placed.repartitionAndSortWithinPartitions(sorted_pieces.getNumPartitions(), part_of)


MARKS = frozenset(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))


def characters(data: bytes) -> int:
    """Code points that begin in a piece of UTF-8."""
    return len(data) - sum(map(data.count, CONTINUING)) if not data.isascii() else len(data)


CONTINUING = [bytes([b]) for b in range(0x80, 0xC0)]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates()) -> DataFrame:
    """Per row its draw and the digests of the output and of the text restored from it, each streamed piece by piece."""

    def finish(records: Iterator[tuple]) -> Iterator[tuple]:
        row, digest = None, None
        for (r, _), content in records:
            if r != row:
                row, digest = r, hashlib.sha256()
            if isinstance(content, bytes):
                digest.update(content)
            else:
                yield (*content, digest.hexdigest())

    rows = restored_pieces(output_pieces(docs, id_col, text_col, rates)).mapPartitions(finish)
    schema = f"{SCHEMA}, output_sha256 string, output_chars long, restored_sha256 string"
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False).withColumnRenamed("doc_id", id_col)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rates: Rates = Rates()) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): the training texts, joined from the sorted pieces of a row."""

    def join(records: Iterator[tuple]) -> Iterator[tuple]:
        row, head, parts = None, None, []
        for (r, _), content in records:
            if r == row:
                parts.append(content)
                continue
            if row is not None:
                yield (*head, b"".join(parts).decode("utf-8", "surrogatepass"))
            row, head, parts = r, content, []
        if row is not None:
            yield (*head, b"".join(parts).decode("utf-8", "surrogatepass"))

    rows = output_pieces(docs, id_col, text_col, rates).mapPartitions(join)
    return docs.sparkSession.createDataFrame(rows, f"{SCHEMA}, output string", verifySchema=False).withColumnRenamed("doc_id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text before the transformation, from a whole output and its form."""
    after = lambda mark: F.substring_index(output, mark, -1)
    until = lambda text, mark: F.substring_index(text, mark, 1)
    psm = F.concat(until(after(PREFIX), SUFFIX), after(MIDDLE), until(after(SUFFIX), MIDDLE))
    spm = F.concat(until(after(PREFIX), MIDDLE), after(MIDDLE), until(after(SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
