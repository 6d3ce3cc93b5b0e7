"""Table rows and whole sheets as documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import clean_value, paragraph_pieces, strip

# Columns with personal contact data that never become text.
PRIVATE_COLUMNS = ("联系方式", "邮箱", "手机号", "微信号")


def _cell(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def _filled(name: str) -> Column:
    value = _cell(name)
    return F.when(strip(value) != "", F.concat(F.lit(f"{name}："), value))


def rows_to_documents(
    rows: DataFrame, text_columns: Sequence[str] | None = None, metadata_columns: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Each row as ``column：value`` lines of its non-blank columns; rows without any drop out."""
    cols = list(text_columns or rows.columns)
    text = F.concat_ws("\n", *[_filled(c) for c in cols])
    meta = [_cell(c).alias(f"meta_{c}") for c in metadata_columns]
    return rows.select(*keep, *meta, text.alias("text")).where(strip(F.col("text")) != "")


def sheet_to_document(rows: DataFrame, sheet: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One Markdown table per sheet. A sheet becomes one value, so its size is that of the document."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(_cell(c), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    body = F.array_join(F.transform(ordered, lambda r: r["_line"]), "\n")
    return rows.groupBy(sheet).agg(F.concat(F.lit(head + "\n"), body).alias("text"), F.count("*").alias("n_rows"))


def entity_header(kind: str, name: Column, parts: Sequence[Column] = (), separator: str = " | ") -> Column:
    """``【kind】name | part | part`` with the parts that have a value."""
    return F.concat_ws(separator, F.concat(F.lit(f"【{kind}】"), name), *[clean_value(p) for p in parts])


def entity_header_chunk(rows: DataFrame, header: Column, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Header and ``field：value`` lines of the configured columns; rows without any value drop out."""
    chosen = [c for c in columns if c not in PRIVATE_COLUMNS]
    values = [clean_value(_cell(c)) for c in chosen]
    fields = F.concat_ws("\n", *[F.concat(F.lit(f"{c}："), v) for c, v in zip(chosen, values)])
    return rows.select(*keep, header.alias("header"), fields.alias("_fields")).where(F.col("_fields") != "").select(
        *keep, F.concat("header", F.lit("\n"), "_fields").alias("text")
    )


def long_field_chunks(
    rows: DataFrame, header: Column, columns: Sequence[str], keep: Sequence[str], min_length: int = 20, size: int = 600
) -> DataFrame:
    """Long text columns, each split into labelled pieces under the row's header."""
    values = F.array(*[F.struct(F.lit(c).alias("field"), clean_value(_cell(c)).alias("value")) for c in columns if c not in PRIVATE_COLUMNS])
    long = rows.select(*keep, header.alias("header"), F.explode(values).alias("_v"))
    long = long.select(*keep, "header", "_v.field", "_v.value").where(F.length("value") >= min_length)
    cut = long.withColumn("_pieces", paragraph_pieces(F.col("value"), size))
    pieces = cut.select(*keep, "header", "field", F.size("_pieces").alias("n_pieces"), F.posexplode_outer("_pieces").alias("piece", "segment"))
    label = F.when(F.col("n_pieces") == 1, F.col("field")).otherwise(
        F.concat(F.col("field"), F.lit("（第"), (F.col("piece") + 1).cast("string"), F.lit("段）"))
    )
    return pieces.select(
        *keep, "field", "piece", F.concat("header", F.lit("\n【"), label, F.lit("】\n"), "segment").alias("text")
    )
