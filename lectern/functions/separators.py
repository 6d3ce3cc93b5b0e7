"""Cutting a text at the strongest separators that keep its pieces short, and merging pieces to overlapping chunks.

A text that is too long is cut before each occurrence of the first of the separators that it contains; pieces that are still too long are
cut at the next ones, down to single characters. Neighbouring short pieces of one cut are merged as long as they fit, and a chunk begins
with the last pieces of the chunk before it, as far as these fit into the overlap. One text is worked on where its row lies, in Arrow batches.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from strong to weak; the empty one stands for single characters.
SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")
# Fixed value: blanks that are trimmed off chunks.
BLANKS = " \t\n\r\f\x0b"

# Characters of chunks after which a task passes on what it has.
OUT_CHARS = 1 << 20

_UNITS = re.compile(r"[一-鿿]|[^ \n\t\r一-鿿]+")
SIZES: dict[str, Callable[[str], int]] = {"chars": len, "words": lambda text: len(_UNITS.findall(text))}


def pieces_before(text: str, separator: str) -> list[str]:
    """The text cut before each occurrence of the separator; single characters for the empty one."""
    if not separator:
        return list(text)
    first, *others = text.split(separator)
    return [p for p in (first, *[separator + x for x in others]) if p]


def merged(pieces: Iterator[tuple[str, int]], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring (piece, length) joined to chunks of at most ``size``, each with the end of the one before."""
    window, total = deque(), 0
    for piece, n in pieces:
        if window and total + n > size:
            yield "".join(p for p, _ in window)
            while window and (total > overlap or total + n > size):
                total -= window.popleft()[1]
        window.append((piece, n))
        total += n
    if window:
        yield "".join(p for p, _ in window)


def cut(text: str, size: int, overlap: int, length: Callable[[str], int] = len, separators: Sequence[str] = SEPARATORS) -> Iterator[str]:
    """The chunks of a text in order, trimmed; empty ones are left out."""
    # What is still to be cut, each with the place in the separators from which on it may be; a list of pieces is ready to be merged.
    todo: list = [(text, 0)]
    while todo:
        item = todo.pop()
        if isinstance(item, list):
            for chunk in merged(iter(item), size, overlap):
                if chunk.strip(BLANKS):
                    yield chunk.strip(BLANKS)
            continue
        whole, level = item
        while level < len(separators) - 1 and separators[level] not in whole:
            level += 1
        last = level >= len(separators) - 1
        found, group = [], []
        for piece in pieces_before(whole, separators[min(level, len(separators) - 1)]):
            n = length(piece)
            if n < size or last:
                group.append((piece, n))
                continue
            if group:
                found.append(group)
                group = []
            found.append((piece, level + 1))
        if group:
            found.append(group)
        todo.extend(reversed(found))


def separator_chunks(
    docs: DataFrame, keep: Sequence[str], size: int = 512, overlap: int = 50, unit: str = "chars", separators: Sequence[str] = SEPARATORS
) -> DataFrame:
    """(*keep, chunk_index, n_chunks, text): texts cut at separators into chunks of at most ``size`` units.

    A null or blank text gives no row. Only a text's own length bounds what a task holds. Where the last separator is not the empty one, a
    piece without any of them stays as long as it is.
    """
    seps, length = tuple(separators), SIZES[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rows, index, count, texts, chars = batch.column("_text"), [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                kept = batch.select(list(keep)).take(pa.array(rows, pa.int64()))
                columns = [*kept.columns, pa.array(index, pa.int64()), pa.array(count, pa.int64()), pa.array(texts, pa.string())]
                return pa.RecordBatch.from_arrays(columns, names=[*keep, "chunk_index", "n_chunks", "text"])

            for row in range(batch.num_rows):
                text = column[row].as_py()
                chunks = list(cut(text, size, overlap, length, seps)) if text else []
                rows += [row] * len(chunks)
                index += range(len(chunks))
                count += [len(chunks)] * len(chunks)
                texts += chunks
                chars += sum(map(len, chunks))
                # A batch holds a number of rows, however long they are: what comes out of it leaves in parts.
                if chars >= OUT_CHARS:
                    yield flush()
                    rows, index, count, texts, chars = [], [], [], [], 0
            yield flush()

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, f"{kinds}chunk_index long, n_chunks long, text string")
