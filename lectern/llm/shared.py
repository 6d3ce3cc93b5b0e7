"""Helpers that several operators of this folder use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass")


def parts_for(n_bytes: int, target: int) -> int:
    """Number of buckets that hold about ``target`` bytes each."""
    return max(1, -(-int(n_bytes or 0) // target))


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row's id and text; rows that agree in both share it."""
    return F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))
