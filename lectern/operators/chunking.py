"""From text blocks to chunks: sections, merging, packing, windows, links.

Ordered steps inside a source use ``ordered`` and ``runs``: no task sorts or folds a whole source, so a
source with a large share of all rows is spread like any other. Texts are concatenated per section, run or
page, which are single output rows anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.sizing import join_null_safe, join_skewed
from lectern.operators import runs
from lectern.operators.ordered import BLOCK_ROWS, block_of, carry_last, neighbours, running_sums
from lectern.session import staged

# Default sizes of the splitter.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
SHORT_SECTION = 30
PAGE_MINIMUM = 150
HEADINGS = ("h1", "h2", "h3", "h4")


def join_ordered(order: Sequence[str], text: str | Column, separator: str) -> Column:
    """Aggregate: texts of a group joined in order."""
    value = F.col(text) if isinstance(text, str) else text
    rows = F.array_sort(F.collect_list(F.struct(*order, value.alias("_x"))))
    return F.array_join(F.transform(rows, lambda r: r["_x"]), separator)


def size_in(unit: str, text: Column) -> Column:
    """Length of a text in ``chars`` or in ``words`` (CJK characters count singly)."""
    return T.unit_count(text) if unit == "words" else F.length(text)


# ------------------------------------------------------------------------------------------------- sections


def _lines(blocks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Trimmed non-empty lines with heading level and title: (*keys, order, _line, line, _level, _title)."""
    lines = blocks.select(*keys, order, F.posexplode_outer(F.split("text", "\n")).alias("_line", "line"))
    lines = lines.withColumn("line", T.strip(F.col("line"))).where(F.col("line") != "")
    # The marker of a heading line: one to four # and a blank.
    mark = F.regexp_extract("line", r"^(#{1,4}) ", 1)
    return lines.withColumn("_level", F.length(mark)).withColumn(
        "_title", F.when(F.col("_level") > 0, T.strip(F.regexp_replace("line", r"^#{1,4} ", "")))
    )


def _heading_path(heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add h1..h4 to section rows (*keys, section, _level, _title): the headings a section stands under."""
    marks = {
        f"_m{i}": F.when(F.col("_level") == i, F.struct("section", F.col("_title").alias("title"))) for i in range(1, 5)
    }
    carried = carry_last(heads, marks, keys, ["section"], block_of("section"))
    path = []
    for i in range(1, 5):
        mine = F.col(f"_m{i}")
        upper = [F.coalesce(F.col(f"_m{j}")["section"], F.lit(-1)) for j in range(1, i)]
        latest = F.greatest(*upper, F.lit(-1)) if upper else F.lit(-1)
        path.append(F.when(mine["section"] > latest, mine["title"]).alias(f"h{i}"))
    return carried.select(*heads.columns, *path)


def split_sections(blocks: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Cut ordered text blocks at H1-H4 lines; each section carries the headings it stands under.

    Input (*keys, order bigint, text); a block may hold several lines. Output (*keys, section, h1..h4, text)
    with ``section`` increasing along the text. Each section is one row, so its text is one value.
    """
    keys = list(keys)
    numbered = running_sums(
        _lines(blocks, keys, order), {"section": F.when(F.col("_level") > 0, 1).otherwise(0)}, keys, [order, "_line"],
        block_of(order, BLOCK_ROWS // 8),
    )
    sections = numbered.groupBy(*keys, "section").agg(
        F.max("_level").alias("_level"), F.max("_title").alias("_title"), join_ordered([order, "_line"], "line", "\n").alias("text")
    )
    # Read for the heading paths and for the result: lines are numbered and joined once.
    sections = staged(sections, "sections")
    heads = sections.select(*keys, "section", "_level", "_title")
    return join_null_safe(sections.drop("_level", "_title"), _heading_path(heads, keys).drop("_level", "_title"), [*keys, "section"])


def _merge_runs(rows: DataFrame, keys: Sequence[str], order: str, separator: str, headings: str) -> DataFrame:
    """One row per run; heading columns from its last (``last``) or first row (``first``)."""
    pick = F.max_by if headings == "last" else F.min_by
    have = [h for h in HEADINGS if h in rows.columns]
    if headings == "last":
        heads = [pick(h, F.when(F.col(h).isNotNull(), F.col(order))).alias(h) for h in have]
    else:
        heads = [pick(h, order).alias(h) for h in have]
    merged = rows.groupBy(*keys, F.col("run_start").alias(order)).agg(
        *heads, join_ordered([order], "text", separator).alias("text"), F.count("*").alias("n_parts")
    )
    return merged


def merge_short_sections(
    sections: DataFrame, keys: Sequence[str], order: str, min_length: int = SHORT_SECTION, unit: str = "chars",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Prepend each section shorter than ``min_length`` to the next one; later headings win."""
    # Stored, as the runs are decided on sizes and texts are joined to them afterwards; else all steps before would run twice.
    rows = staged(sections.withColumn("text", T.strip(F.col("text"))).where(F.col("text") != ""), "sections")
    # +1 per row stands for the line break between merged sections.
    extra = 1 if unit == "chars" else 0
    size = size_in(unit, F.col("text")) + extra
    marked = runs.mark_runs(rows, keys, order, runs.filled("_size", min_length + extra), {"_size": size}, block_rows)
    return _merge_runs(marked.drop(order).withColumnRenamed("pos", order), keys, order, "\n", "last")


def greedy_chunks(
    sections: DataFrame, keys: Sequence[str], order: str, chunk_size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    unit: str = "chars", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Pack sections up to ``chunk_size``; H1 and H2 sections always begin a chunk; larger ones are windowed.

    Output (*keys, order of the first section, piece, h1..h4, text).
    """
    sections = staged(sections, "sections")  # as in ``merge_short_sections``
    deepest = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in ((4, "h4"), (3, "h3"), (2, "h2"), (1, "h1"))], F.lit(0))
    features = {"_size": size_in(unit, F.col("text")), "_strong": deepest.isin(1, 2)}
    jump = runs.overflow("_size", chunk_size, "_strong")
    marked = runs.mark_runs(sections, keys, order, jump, features, max(block_rows, chunk_size))
    packed = _merge_runs(marked.drop(order).withColumnRenamed("pos", order), keys, order, "\n", "first")
    pieces = F.when(
        size_in(unit, F.col("text")) > chunk_size, windows_of(F.col("text"), chunk_size, overlap, unit)
    ).otherwise(F.array(F.col("text")))
    out = packed.select(*keys, order, *HEADINGS, F.posexplode_outer(pieces).alias("piece", "text"))
    return out.where(T.strip(F.col("text")) != "")


def section_chunks(
    blocks: DataFrame, keys: Sequence[str], order: str, min_length: int = SHORT_SECTION, chunk_size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sections, merging of short ones, packing and windowing in one go, in characters.

    Gives what ``split_sections``, ``merge_short_sections`` and ``greedy_chunks`` give after each other, but
    decides everything on sizes: a section, merged section or packed run is a stretch [from, end) of its key's
    lines, and text is first joined per finished chunk. A key without any heading is spread like any other.
    """
    keys = list(keys)
    width = F.length("line") + 1  # with the line break behind it
    sums = {"section": F.when(F.col("_level") > 0, 1).otherwise(0), "_end": width}
    lines = running_sums(_lines(blocks, keys, order), sums, keys, [order, "_line"], block_of(order, BLOCK_ROWS // 8))
    lines = lines.withColumn("_from", F.col("_end") - width)
    extent = [F.min("_from").alias("_from"), F.max("_end").alias("_end")]
    heads = lines.groupBy(*keys, "section").agg(
        F.max("_level").alias("_level"), F.max("_title").alias("_title"), F.count("*").alias("_lines"), *extent
    )
    heads = staged(_heading_path(staged(heads, "sections"), keys), "sections")
    size = F.col("_end") - F.col("_from") - 1
    first = runs.mark_runs(heads, keys, "section", runs.filled("_size", min_length + 1), {"_size": size + 1}, block_rows)
    first = first.select(*keys, "section", "_lines", *HEADINGS, "_from", "_end", "pos", F.col("run_start").alias("_merged"))
    later = [F.max_by(h, F.when(F.col(h).isNotNull(), F.col("pos"))).alias(h) for h in HEADINGS]
    merged = staged(first.groupBy(*keys, "_merged").agg(*later, *extent), "sections")
    strong = F.coalesce(*[F.when(F.col(h).isNotNull(), F.lit(i)) for i, h in ((4, "h4"), (3, "h3"), (2, "h2"), (1, "h1"))], F.lit(0)).isin(1, 2)
    jump = runs.overflow("_size", chunk_size, "_strong")
    packed = runs.mark_runs(merged, keys, "_merged", jump, {"_size": size, "_strong": strong}, max(block_rows, chunk_size))
    packed = packed.withColumnRenamed("run_start", "_run")
    stretch = packed.groupBy(*keys, "_run").agg(
        F.min("_from").alias("_run_from"), F.max("_end").alias("_run_end"), *[F.min_by(h, "pos").alias(h) for h in HEADINGS]
    )
    place = join_null_safe(packed.select(*keys, "_merged", "_run"), stretch, [*keys, "_run"])
    place = join_null_safe(first.select(*keys, "section", "_lines", "_merged"), place, [*keys, "_merged"]).drop("_merged")
    place = place.select(F.struct(*keys, "section").alias("_key"), "_lines", "_run", "_run_from", "_run_end", *HEADINGS)
    rows = lines.withColumn("_key", F.struct(*keys, "section")).select(*keys, "_key", "line", "_from", "_end")
    # A section may own any number of lines, so the join spreads those of heavy sections.
    rows = join_skewed(rows, staged(place, "sections"), "_key", "_lines", F.col("_from"))
    step = chunk_size - overlap
    total = F.col("_run_end") - F.col("_run_from") - 1
    n_windows = F.when(total <= chunk_size, 1).otherwise(F.ceil((total - chunk_size) / F.lit(step)) + 1)
    local = F.col("_from") - F.col("_run_from")
    piece = F.when(F.col("_end") == F.col("_run_end"), F.col("line")).otherwise(F.concat("line", F.lit("\n")))
    lowest = F.greatest(F.floor((local - chunk_size) / F.lit(step)) + 1, F.lit(0))
    highest = F.least(F.floor((local + F.length("line")) / F.lit(step)), n_windows - 1)
    rows = rows.withColumn("_piece", piece).withColumn("_local", local.cast("int"))

    def part(window: Column) -> Column:
        begin = (window * step).cast("int")
        lo = F.greatest(begin - F.col("_local"), F.lit(0))
        hi = F.least(begin + chunk_size - F.col("_local"), F.length("_piece"))
        return F.struct(window.cast("int").alias("piece"), F.substr("_piece", lo + 1, F.greatest(hi - lo, F.lit(0))).alias("_text"))

    # Cut before the explode: a long line is not repeated for each of its windows.
    parts = F.when(lowest <= highest, F.transform(F.sequence(lowest, highest), part))
    cut = rows.select(*keys, "_run", *HEADINGS, "_from", F.explode_outer(parts).alias("_p")).where(F.col("_p").isNotNull())
    chunks = cut.groupBy(*keys, F.col("_run").alias("section"), F.col("_p.piece").alias("piece")).agg(
        *[F.first(h, ignorenulls=True).alias(h) for h in HEADINGS], join_ordered(["_from"], F.col("_p._text"), "").alias("text")
    )
    return chunks.where(T.strip(F.col("text")) != "")


# -------------------------------------------------------------------------------------------------- windows


def window_starts(n: Column, size: int, step: int) -> Column:
    """Starts of windows of ``size`` every ``step`` until one reaches the end."""
    last = F.greatest(F.ceil((n - size) / F.lit(step)).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def windows_of(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, unit: str = "words") -> Column:
    """Overlapping windows over the units of a text; joined without the overlaps they give it back."""
    if unit == "chars":
        return F.transform(window_starts(F.length(text), size, size - overlap), lambda s: F.substr(text, s + 1, F.lit(size)))
    parts = T.units(text)
    return F.transform(
        window_starts(F.size(parts), size, size - overlap), lambda s: F.array_join(F.slice(parts, s + 1, F.lit(size)), "")
    )


def token_windows(docs: DataFrame, keep: Sequence[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(*keep, chunk_index, n_windows, text): overlapping word windows of each text, made where the row lies."""

    def windows(u: Column) -> Column:
        n = F.greatest(F.ceil((F.size(u) - size) / F.lit(size - overlap)).cast("int"), F.lit(0)) + 1
        starts = window_starts(F.size(u), size, size - overlap)
        return F.transform(starts, lambda s: F.struct(n.alias("n"), F.array_join(F.slice(u, s + 1, F.lit(size)), "").alias("text")))

    # Through a one-element array, so that the text is cut once; a window's row does not carry the words of the whole text.
    cut = docs.where(F.col("text").rlike(r"[^ \n\t\r]")).select(*keep, F.transform(F.array(T.units(F.col("text"))), windows)[0].alias("_w"))
    # The outer form: for the plain one the optimizer would cut the text a second time in a pushed filter.
    rows = cut.select(*keep, F.posexplode_outer("_w").alias("chunk_index", "_p"))
    return rows.select(*keep, "chunk_index", F.col("_p.n").alias("n_windows"), F.col("_p.text").alias("text"))


def sliding_windows(docs: DataFrame, keep: Sequence[str], size: int = 5000, step: int = 4000, min_filled: int = 200) -> DataFrame:
    """Character windows at every ``step``; windows with at most ``min_filled`` characters after trimming drop out."""
    n = F.length("text")
    # A window begins at every step below the end of the text, also where the one before already reached it.
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(step)).cast("int")), lambda i: i * step)
    rows = docs.where(n > 0).select(*keep, "text", F.explode(starts).alias("start"))
    rows = rows.select(
        *keep, "start", F.least(F.col("start") + size, n).alias("end"), F.substr("text", F.col("start") + 1, F.lit(size)).alias("text")
    )
    return rows.where(F.length(T.strip(F.col("text"))) > min_filled)


# ---------------------------------------------------------------------------------------------- other packing


def pack_segments(
    chunks: DataFrame, keys: Sequence[str], order: str | Sequence[str], max_chars: int = 3000, block_rows: int = BLOCK_ROWS,
    order_span: int | None = None,
) -> DataFrame:
    """Consecutive chunks of a key packed to at most ``max_chars``: (*keys, seg_start, n_chunks, text)."""
    rows = chunks.where(F.length("text") > 0)
    jump = runs.overflow("_size", max_chars)
    marked = runs.mark_runs(rows, keys, order, jump, {"_size": F.length("text")}, max(block_rows, max_chars), order_span)
    return marked.groupBy(*keys, F.col("run_start").alias("seg_start")).agg(
        F.count("*").alias("n_chunks"), join_ordered(["pos"], "text", "\n\n").alias("text")
    )


def page_segments(
    blocks: DataFrame, keys: Sequence[str], page: str, order: str, min_chars: int = PAGE_MINIMUM, drop_below: int = 50,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Text and table blocks by page; a page shorter than ``min_chars`` takes in the following ones.

    The segment is named after its last page.
    """
    wanted = blocks.where(F.col("type").isin("text", "table")).withColumn("text", T.strip(F.col("text"))).where(F.col("text") != "")
    pages = wanted.groupBy(*keys, F.coalesce(F.col(page), F.lit(0)).cast("bigint").alias("page")).agg(join_ordered([order], "text", "\n").alias("text"))
    size = {"_size": F.length("text") + 1}
    marked = runs.mark_runs(pages, keys, "page", runs.filled("_size", min_chars + 1), size, block_rows)
    merged = marked.groupBy(*keys, "run_start").agg(F.max("page").alias("page"), join_ordered(["pos"], "text", "\n").alias("text"))
    trimmed = merged.withColumn("text", T.strip(F.col("text")))
    return trimmed.where(F.length("text") >= drop_below).drop("run_start")


def excerpt_budget(
    blocks: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, budget: int = 6000
) -> DataFrame:
    """Blocks of a key joined until the budget is reached; tables are wrapped in markers, images skipped.

    Rows behind the budget drop out before texts are collected, so a group holds one budget at most.
    """
    rows = blocks.where(F.col("type") != "image").withColumn("text", T.strip(F.col("text"))).where(F.col("text") != "")
    rows = rows.withColumn("text", F.when(F.col("type") == "table", F.concat(F.lit("[表格]\n"), F.col("text"), F.lit("\n[/表格]"))).otherwise(F.col("text")))
    rows = running_sums(rows, {"_upto": F.length("text")}, keys, order, block)
    kept = rows.where(F.col("_upto") - F.length("text") < budget)
    return kept.groupBy(*keys).agg(F.count("*").alias("n_blocks"), join_ordered(order, "text", "\n\n").alias("text"))


# ---------------------------------------------------------------------------------------------------- links


def chunk_id(source: Column, position: Column, text: Column) -> Column:
    """Content-based id: the same source, place and text give the same id on every run."""
    return F.sha2(F.concat_ws("|", source.cast("string"), position.cast("string"), text), 256)


def enrich_chunks(chunks: DataFrame, source: str, order: Sequence[str], block: Column, position: Column) -> DataFrame:
    """Add ``chunk_id``, ``section_path`` and the ids of the chunks before and behind in the same source."""
    path = F.concat_ws(" > ", *[F.when(F.col(h) != "", F.col(h)) for h in HEADINGS if h in chunks.columns]) if any(
        h in chunks.columns for h in HEADINGS
    ) else F.lit("")
    named = chunks.withColumn("chunk_id", chunk_id(F.col(source), position, F.col("text"))).withColumn("section_path", path)
    return neighbours(named, "chunk_id", "prev_chunk_id", "next_chunk_id", [source], order, block)
