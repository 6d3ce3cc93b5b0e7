"""Scanning parsed documents: block lists, file lists, preferred versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import markdown as M
from lectern.functions.text import strip

BLOCK = (
    "struct<type: string, text: string, table_body: string, img_path: string, "
    "table_caption: array<string>, page_idx: int, bbox: array<double>>"
)
TEXT_TYPES = ("text", "table", "equation")
LIST_SUFFIX = "_content_list"

# Limits of an accepted upload.
MAX_FILE_BYTES = 300 * 1024 * 1024
UPLOAD_SUFFIXES = ("pdf", "doc", "docx", "xlsx", "xls")


def read_blocks(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(doc, path, block_idx, *block fields) of JSON block lists, order kept: one list per file, named after it.

    A list is one JSON value, so a file is one row until it is exploded; broken files give no rows here and
    are listed by ``broken_files``. ``packed`` files hold many lists, one object with ``doc`` and ``blocks`` per line, so that
    their number does not grow with that of the documents.
    """
    files = spark.read.option("wholetext", not packed).option("recursiveFileLookup", True).text(path)
    if packed:
        line = F.from_json("value", f"struct<doc: string, blocks: array<{BLOCK}>>")
        files = files.select(line["doc"].alias("doc"), F.input_file_name().alias("path"), line["blocks"].alias("blocks"))
    else:
        files = files.select(F.input_file_name().alias("path"), F.from_json("value", f"array<{BLOCK}>").alias("blocks"))
        name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), rf"({LIST_SUFFIX})?\.[^.]*$", "")
        files = files.select(F.url_decode(name).alias("doc"), "path", "blocks")
    return files.select("doc", "path", F.posexplode("blocks").alias("block_idx", "b")).select("doc", "path", "block_idx", "b.*")


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """Files whose content is no JSON list."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    parsed = F.from_json("value", f"array<{BLOCK}>")
    return files.select(F.input_file_name().alias("path"), "value").where(parsed.isNull() | ~strip(F.col("value")).startswith("[")).select("path")


def block_text() -> Column:
    """Text of a block; tables get their caption in front and their HTML body where the text was cut short."""
    caption = F.array_join(F.coalesce("table_caption", F.array().cast("array<string>")), " ")
    raw = F.coalesce("text", F.lit(""))
    html = F.coalesce("table_body", F.lit(""))
    body = F.when((html != "") & M.html_has_more_rows(html, raw), M.html_to_markdown(html)).otherwise(raw)
    table = F.when(caption != "", F.concat(caption, F.lit("\n"), body)).otherwise(body)
    return strip(F.when(F.col("type") == "table", table).otherwise(raw))


def scan_blocks(blocks: DataFrame, types: Sequence[str] = TEXT_TYPES) -> DataFrame:
    """Documents from blocks: wanted types with text, as (source, block_idx, page, block_type, text)."""
    rows = blocks.where(F.col("type").isin(*types))
    rows = rows.select(
        F.col("doc").alias("source"), "block_idx", F.col("page_idx").alias("page"), F.col("type").alias("block_type"), block_text().alias("text")
    )
    return rows.where(F.col("text") != "")


def file_manifest(
    spark: SparkSession, path: str, suffixes: Sequence[str] = UPLOAD_SUFFIXES, prefix: str | None = None, skip_folder: str | None = None,
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Input files below ``path`` with accepted suffix and size; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), "length", "modificationTime")
    out = out.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*suffixes))
    out = out.where((F.col("length") > 0) & (F.col("length") <= max_bytes))
    if prefix:
        out = out.where(F.col("name").startswith(prefix))
    if skip_folder:
        out = out.where(~F.col("path").contains(f"/{skip_folder}/"))
    return out


def prefer_enhanced(versions: DataFrame, doc: str, priority: str) -> DataFrame:
    """Per document the version of lowest ``priority``; combined in each task before the shuffle."""
    cols = [c for c in versions.columns if c != doc]
    best = versions.groupBy(doc).agg(F.min_by(F.struct(*cols), F.col(priority)).alias("_b"))
    return best.select(doc, "_b.*")
