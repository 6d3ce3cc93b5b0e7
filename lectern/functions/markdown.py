"""Markdown and HTML tables held as text.

The steps of a longer computation are columns of their own, so that each is evaluated once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip

# What a separator line and a measured value look like.
SEPARATOR = r"^\|[\s\-:]+(\|[\s\-:]+)+\|?$"
MEASURED = r"^[-~<>≥≤0-9]"

FEATURES = ("n_cols", "n_separators", "n_data", "last_no", "first_no", "leads_values", "caption", "continues")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def _line(raw: Column) -> Column:
    """One line taken apart: trimmed text, pipe row?, separator?, filled cells, number of cells."""
    s = strip(raw)
    parts = F.transform(F.split(s, r"\|"), strip)
    return F.struct(
        s.alias("s"),
        F.startswith(s, F.lit("|")).alias("pipe"),
        s.rlike(SEPARATOR).alias("rule"),
        F.filter(parts, lambda c: c != "").alias("cells"),
        F.size(parts).alias("n"),
        raw.alias("raw"),
    )


def _width(rows: Column) -> Column:
    """Largest column count of the rows in which more than half of the cells are filled."""
    widths = F.transform(rows, lambda r: F.when(F.size(r["cells"]) > r["n"] / 2, r["n"] - 2).otherwise(F.lit(0)))
    return F.greatest(F.array_max(widths), F.lit(0))


def _numbers(rows: Column) -> Column:
    """Whole numbers that lead a row."""
    return F.filter(F.transform(rows, lambda r: F.get(r["cells"], F.lit(0))), lambda h: h.rlike(r"^[0-9]+$"))


def with_table_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Add what is known about the table in a text.

    ``n_cols``; ``n_separators``; ``n_data`` rows behind the first separator; ``last_no``, the last number that
    leads a data row; ``first_no``, the first that leads any row; ``leads_values``, whether the first row is
    mostly measured values; ``caption``, the first line outside the table; ``continues``, whether the text begins
    as a table without a heading row. For merging also ``table_rows``, ``n_rows``, ``row_cols`` and ``last_row_no``.
    """
    cols = df.columns
    step = df.withColumn("_l", F.filter(F.transform(lines(F.col(text)), _line), lambda x: x["s"] != ""))
    step = step.withColumn("_pipes", F.filter("_l", lambda x: x["pipe"]))
    step = step.withColumn("_rows", F.filter("_pipes", lambda x: ~x["rule"]))
    step = step.withColumn("_rule_at", F.array_position(F.transform("_pipes", lambda x: x["rule"]), True).cast("int"))
    behind = F.slice("_pipes", F.col("_rule_at") + 1, F.greatest(F.size("_pipes") - F.col("_rule_at"), F.lit(0)))
    step = step.withColumn("_data", F.filter(F.when(F.col("_rule_at") > 0, behind), lambda x: ~x["rule"]))
    step = step.withColumn("_numbers", _numbers(F.col("_rows"))).withColumn("_data_numbers", _numbers(F.col("_data")))
    head = F.get("_pipes", F.lit(0))["cells"]
    measured = F.size(F.filter(head, lambda c: c.rlike(MEASURED)))
    return step.select(
        *cols,
        _width(F.col("_pipes")).alias("n_cols"),
        F.size(F.filter("_l", lambda x: x["rule"])).alias("n_separators"),
        F.greatest(F.size("_data"), F.lit(0)).alias("n_data"),
        F.try_element_at("_data_numbers", F.lit(-1)).cast("bigint").alias("last_no"),
        F.get("_numbers", F.lit(0)).cast("bigint").alias("first_no"),
        F.coalesce((F.size(head) > 0) & (measured > F.size(head) / 2), F.lit(False)).alias("leads_values"),
        F.get(F.filter("_l", lambda x: ~x["pipe"]), F.lit(0))["s"].alias("caption"),
        (F.coalesce(F.get("_l", F.lit(0))["pipe"], F.lit(False)) & ~F.exists(F.slice("_l", 2, 3), lambda x: x["rule"])).alias("continues"),
        F.transform("_rows", lambda r: r["raw"]).alias("table_rows"),
        F.size("_rows").alias("n_rows"),
        _width(F.col("_rows")).alias("row_cols"),
        F.try_element_at("_numbers", F.lit(-1)).cast("bigint").alias("last_row_no"),
    )


def html_row_count(html: Column) -> Column:
    return F.regexp_count(html, F.lit("<tr"))


def html_has_more_rows(html: Column, text: Column) -> Column:
    """True where the HTML body holds more rows than the text kept of it."""
    kept = F.filter(
        F.transform(lines(text), strip),
        lambda s: F.startswith(s, F.lit("|")) & ~F.startswith(s, F.lit("|---")),
    )
    return html_row_count(html) > F.size(kept) + 1


def html_to_markdown(html: Column) -> Column:
    """Rows of an HTML table as pipe rows, with one separator behind the first non-empty row."""
    raw = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    parsed = F.filter(
        F.transform(
            raw,
            lambda r: F.transform(
                F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)),
                lambda c: strip(F.regexp_replace(c, r"<[^>]+>", "")),
            ),
        ),
        lambda row: F.size(row) > 0,
    )

    def line(row: Column, i: Column) -> Column:
        text = F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(row)))
        return F.when(i == 0, F.concat(text, F.lit("\n"), rule)).otherwise(text)

    return F.array_join(F.transform(parsed, line), "\n")


def truncate_table(df: DataFrame, text: str = "text", max_jump: int = 3) -> DataFrame:
    """Replace a text by the rows of its first paragraph up to where another table seems to begin.

    That is where the column count jumps by ``max_jump`` or where, behind a row led by a digit, a row is not.
    """
    others = [c for c in df.columns if c != text]
    step = df.withColumn("_text", strip(F.col(text)))
    first = F.get(F.split("_text", r"\n[ \t\r\f\x0b]*\n"), F.lit(0))
    step = step.withColumn("_rows", F.filter(F.transform(lines(first), _line), lambda x: x["pipe"] & ~x["rule"]))
    seen = F.transform(
        "_rows",
        lambda r: F.struct((r["n"] - 2).alias("cols"), F.coalesce(F.get(r["cells"], F.lit(0)), F.lit("")).alias("head")),
    )
    step = step.withColumn("_seen", seen)
    step = step.withColumn("_width", F.get("_seen", F.lit(0))["cols"])
    step = step.withColumn("_digit_at", F.array_position(F.transform("_seen", lambda s: s["head"].rlike(r"^[0-9]")), True))

    def stops(s: Column, i: Column) -> Column:
        behind_digits = (F.col("_digit_at") > 0) & (i + 1 > F.col("_digit_at"))
        return (F.abs(s["cols"] - F.col("_width")) >= max_jump) | (behind_digits & (s["head"] != "") & ~s["head"].rlike(r"^[0-9]"))

    step = step.withColumn("_stop", F.array_position(F.transform("_seen", stops), True).cast("int"))
    keep = F.when(F.col("_stop") == 0, F.size("_rows")).otherwise(F.col("_stop") - 1)
    kept = F.array_join(F.transform(F.slice("_rows", F.lit(1), keep), lambda r: r["raw"]), "\n")
    return step.select(*others, F.when(F.size("_rows") == 0, F.col("_text")).otherwise(kept).alias(text))
