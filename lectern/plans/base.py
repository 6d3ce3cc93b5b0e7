"""The query registry and the tables it runs on.

Each registered query takes (spark, sf_dir) and returns a DataFrame over whole tables; its SQL twin is the
check on the result. SQL fragments below are shared common table expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.sizing import spread
from lectern.operators.keyword import KeywordIndex, read_index, write_index
from lectern.session import path_exists, work_root

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
INDEX_LAYOUT = "4"  # part of the name of stored indexes; raised when their content changes


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` together with its SQL twin."""

    def add(run: Query) -> Query:
        REGISTRY[name] = (run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as stored; one that comes in few large splits is spread over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: language as collection, a page number derived from the id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"),
        F.col("lang").alias("collection"),
        "source",
        (F.col("doc_id") % 40).alias("page"),
        "text",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have a vector."""
    return corpus(spark, sf_dir).select("chunk_id", "collection").join(vectors(spark, sf_dir), "chunk_id")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select(F.col("chunk_id").alias("query_id"), "vector")
    return questions(spark, sf_dir).select("query_id").join(v, "query_id")


def _file_mark(spark: SparkSession, path: str) -> str:
    """Changes whenever the files below ``path`` do."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    row = files.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return hashlib.md5(f"{INDEX_LAYOUT}|{path}|{row[0]}".encode()).hexdigest()


def corpus_index(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> KeywordIndex:
    """The stored keyword index of the corpus; built on first use and whenever the source files change."""
    mark = _file_mark(spark, f"{sf_dir}/documents.parquet")
    path = f"{work_root(spark)}/lectern-index-{mark}-{'_'.join(by) or 'all'}"
    if path_exists(spark, f"{path}/stats/_SUCCESS"):
        return read_index(spark, path, by)
    return write_index(corpus(spark, sf_dir), path, by)


# ---------------------------------------------------------------------------------------------- SQL fragments


def tok(col: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1)"


C = "c AS (SELECT doc_id AS chunk_id, lang AS collection, source, doc_id % 40 AS page, text FROM documents)"
Q = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
V = "v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vector, label FROM embeddings)"
CV = f"{V}, cv AS (SELECT c.chunk_id, c.collection, v.vector, v.label FROM c JOIN v USING (chunk_id))"
QV = "qv AS (SELECT q.query_id, v.vector FROM q JOIN v ON q.query_id = v.chunk_id)"


def bm25(queries: str = "q", chunks: str = "c", out: str = "bm", k: int = 10, by: str = "", own: bool = False) -> str:
    """CTEs that end in ``out``(query_id, [by], chunk_id, score, rank)."""
    p, o = (f"{by}, " if by else ""), out
    using = f"({by}, chunk_id)" if by else "(chunk_id)"
    on_t = f"({by}, term)" if by else "(term)"
    stats_join = f"JOIN {o}_st USING ({by})" if by else f", {o}_st"
    q_by = p if own else ""
    q_on = f"({by}, term)" if own else "(term)"
    rank_by = "query_id" if own or not by else f"query_id, {by}"
    return f"""
{o}_p AS (SELECT {p}chunk_id, term, count(*) AS tf FROM
  (SELECT {p}chunk_id, unnest({tok('text')}) AS term FROM {chunks}) GROUP BY ALL),
{o}_l AS (SELECT {p}chunk_id, sum(tf)::BIGINT AS dl FROM {o}_p GROUP BY ALL),
{o}_st AS (SELECT {p}count(*) AS n, avg(dl) AS avgdl FROM {o}_l {'GROUP BY ' + by if by else ''}),
{o}_t AS (SELECT {p}term, count(*) AS df FROM {o}_p GROUP BY ALL),
{o}_q AS (SELECT query_id, {q_by}term, count(*) AS qtf FROM
  (SELECT query_id, {q_by}unnest({tok('text')}) AS term FROM {queries}) GROUP BY ALL),
{o}_w AS (SELECT query_id, {p}term, qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS w, avgdl
  FROM {o}_q JOIN {o}_t USING {q_on} {stats_join}),
{o}_s AS (SELECT query_id, {p}chunk_id,
  round(sum(w * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM {o}_w JOIN {o}_p USING {on_t} JOIN {o}_l USING {using} GROUP BY ALL),
{o} AS (SELECT *, row_number() OVER (PARTITION BY {rank_by} ORDER BY score DESC, chunk_id) AS rank
  FROM {o}_s QUALIFY rank <= {k})"""


def cosine(a: str, b: str) -> str:
    return f"round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6) + 0.0"


def dense(queries: str, items: str, out: str, k: int = 10, where: str = "true", by: str = "") -> str:
    p = f"i.{by}, " if by else ""
    rank_by = f"query_id, {by}" if by else "query_id"
    return f"""
{out}_s AS (SELECT q0.query_id, {p}i.chunk_id, {cosine('q0.vector', 'i.vector')} AS score
  FROM {queries} q0, {items} i WHERE {where}),
{out} AS (SELECT *, row_number() OVER (PARTITION BY {rank_by} ORDER BY score DESC, chunk_id) AS rank
  FROM {out}_s QUALIFY rank <= {k})"""


def rrf(a: str, b: str, out: str, by: str = "") -> str:
    p = f"{by}, " if by else ""
    return f"""
{out}_s AS (SELECT query_id, {p}chunk_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score, min(l) AS l FROM (
  SELECT query_id, {p}chunk_id, rank, 0 AS l FROM {a} UNION ALL SELECT query_id, {p}chunk_id, rank, 1 FROM {b}) GROUP BY ALL),
{out} AS (SELECT query_id, {p}chunk_id, score,
  row_number() OVER (PARTITION BY query_id{', ' + by if by else ''} ORDER BY score DESC, l, chunk_id) AS rank FROM {out}_s)"""


def merged(rows: str, out: str, k: int, key: str) -> str:
    """Prefix-keyed fusion of ``rows``(query_id, list_id, chunk_id, rank, text)."""
    return f"""
{out}_s AS (SELECT query_id, {key} AS kk, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_id) AS l,
  arg_max(chunk_id, row(list_id, rank, chunk_id)) AS chunk_id FROM {rows} GROUP BY query_id, {key}),
{out} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, l, chunk_id) AS rank
  FROM {out}_s QUALIFY rank <= {k})"""


def finish(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select
