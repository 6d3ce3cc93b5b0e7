"""Where users plug in their own retrievers and models.

Nothing here needs a model: each hook has a default made of built-in functions. A user passes a function of
Columns; a ``pandas_udf`` is one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokens

# (queries, chunks) -> ranked rows (query_id, chunk_id, rank, score)
Retriever = Callable[[DataFrame, DataFrame], DataFrame]
PairScorer = Callable[[Column, Column], Column]
TextFunction = Callable[[Column], Column]
Embedder = Callable[[Column], Column]

SUMMARY_CHARS = 200  # fixed value: length of the extract that stands for a summary


def wrap(retriever: Retriever, *steps: Callable[[DataFrame], DataFrame]) -> Retriever:
    """A retriever whose result goes through further steps."""
    return lambda queries, chunks: reduce(lambda df, step: df.transform(step), steps, retriever(queries, chunks))


def first_part(text: Column) -> Column:
    """The default text function: the first part of the text."""
    return F.substring(text, 1, SUMMARY_CHARS)


def embed(rows: DataFrame, embedder: Embedder, max_chars: int | None = None) -> DataFrame:
    """Add ``vector`` by a user's function of the whole text, or of its first ``max_chars`` characters."""
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    return rows.withColumn("vector", embedder(text).cast("array<float>"))


def fit_hashing(chunks: DataFrame, dimensions: int = 256):
    """The default embedding: hashed terms weighted by IDF, unit length. Returns the fitted model."""
    prepared = chunks.select(tokens(F.col("text")).alias("_words"))
    stages = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(prepared)


def embed_hashing(rows: DataFrame, model) -> DataFrame:
    """Add ``vector`` by a model of ``fit_hashing``."""
    prepared = rows.withColumn("_words", tokens(F.col("text")))
    return model.transform(prepared).withColumn("vector", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_idf", "_unit")
