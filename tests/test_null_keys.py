"""Rows with a null key are rows like any other."""

from pyspark.sql import functions as F

from lectern.functions.sizing import join_skewed
from lectern.operators import chunking, tables


def test_sections_and_chunks_of_a_null_source(spark):
    rows = [(s, i, t) for s in ("a", None) for i, t in enumerate(["# One", "text of one", "## Two", "text of two"])]
    blocks = spark.createDataFrame(rows, "source string, n long, text string")
    sections = chunking.split_sections(blocks, ["source"], "n")
    count = {r.source: r.c for r in sections.groupBy("source").agg(F.count("*").alias("c")).collect()}
    assert count == {"a": count["a"], None: count["a"]} and count["a"] >= 2
    merged = chunking.merge_short_sections(sections, ["source"], "section")
    assert {r.source for r in merged.select("source").collect()} == {"a", None}


def test_null_is_a_hot_key_too(spark):
    facts = spark.createDataFrame([(None if i % 3 else 1, i) for i in range(90)], "k long, v long")
    counts = facts.groupBy("k").agg(F.count("*").alias("n"))
    got = join_skewed(facts, counts, "k", "n", F.col("v"))
    assert got.count() == 90 and got.where("k IS NULL AND n = 60").count() == 60


def test_caption_far_back(spark):
    rows = [(None, 1, "table", 1, "", "", ["Caption"])] + [(None, i, "text", 1, "x", "", []) for i in range(2, 25)] + [(None, 25, "table", 1, "", "", [])]
    blocks = spark.createDataFrame(rows, "doc string, block_idx long, type string, page_idx int, text string, table_body string, table_caption array<string>")
    got = {r.block_idx: r.context for r in tables.empty_tables(blocks, ["doc"], "block_idx", "page_idx", reach=40).collect()}
    assert got[25] == "Caption"
