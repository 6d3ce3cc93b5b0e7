"""Registered queries over stored collections, summaries and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import hooks
from lectern.operators import context, dense, evaluate, fusion, graph, keyword, summaries
from lectern.operators.keyword import CODEC
from lectern.plans.base import (
    C, Q, QV, V, bm25, corpus, finish, query, question_vectors, questions, table, tok, vectors,
)
from lectern.plans.base import dense as dense_sql
from lectern.plans.evaluation import MEANS, SAMPLES, SCENARIO_SQL, _samples, _scenarios
from lectern.plans.retrieval import LOCAL, _bm25, _local, _ranked
from lectern.plans.shaping import PACK_ITEMS, PACKED, WINDOWS_SQL, _windows
from lectern.session import staged, work_path
from lectern.sources import collections as store
from lectern.streaming import ingest


def _stored(spark, sf, name):
    root = work_path(spark, name)
    store.upsert_chunks(store.with_defaults(corpus(spark, sf)), root, "first")
    return root


@query("scan_collection", "SELECT doc_id AS chunk_id, lang AS collection, doc_id % 40 AS page, length(text) AS n_chars FROM documents WHERE lang IN ('en', 'fr') AND doc_id % 40 IN (3, 4, 5)")
def scan_collection(spark, sf):
    rows = store.scan_collection(spark, _stored(spark, sf, "scan"), ["en", "fr"]).where(F.col("page").isin(3, 4, 5))
    return rows.select("chunk_id", "collection", "page", F.length("text").cast("bigint").alias("n_chars"))


@query("append_collection", "SELECT 'first' AS collection, count(*) AS n_chunks FROM documents WHERE lang = 'en' UNION ALL SELECT 'second', count(*) FROM documents")
def append_collection(spark, sf):
    root = work_path(spark, "append")
    docs = corpus(spark, sf).drop("collection")
    en, rest = (docs.join(table(spark, sf, "documents").where(c).select(F.col("doc_id").alias("chunk_id")), "chunk_id") for c in (F.col("lang") == "en", F.col("lang") != "en"))
    store.append_collection(en, root, "first")
    store.append_collection(rest, root, "first")  # exists: left as it is
    store.append_collection(en, root, "second")
    store.append_collection(rest, root, "second", force=True)
    return store.scan_collection(spark, root).groupBy("collection").agg(F.count("*").alias("n_chunks"))


@query("upsert_chunks", "SELECT doc_id AS chunk_id, 'docs' AS collection, md5(CASE WHEN doc_id % 3 = 0 THEN upper(lang) || text ELSE text END) AS text_hash, 'chunk' AS node_type FROM documents")
def upsert_chunks(spark, sf):
    root = work_path(spark, "upsert")
    old = store.with_defaults(corpus(spark, sf))
    new = old.where(F.col("chunk_id") % 3 == 0).withColumn("text", F.concat(F.upper("collection"), "text"))
    for number, part in enumerate((old, new, new)):
        store.upsert_chunks(part.withColumn("collection", F.lit("docs")), root, number)
    return store.scan_collection(spark, root).select("chunk_id", "collection", F.md5("text").alias("text_hash"), "node_type")


@query("drop_collection", "SELECT lang AS collection, count(*) AS n_chunks FROM documents WHERE lang <> 'de' OR doc_id % 3 = 0 GROUP BY 1")
def drop_collection(spark, sf):
    root = _stored(spark, sf, "drop")
    store.drop_collection(spark, root, "de")
    store.compact(spark, root)
    # what comes after the drop is seen
    store.upsert_chunks(store.with_defaults(corpus(spark, sf)).where("collection = 'de' AND chunk_id % 3 = 0"), root, "again")
    return store.scan_collection(spark, root).groupBy("collection").agg(F.count("*").alias("n_chunks"))


@query("collection_catalog", "SELECT source AS collection, count(*) AS n_chunks, CASE WHEN max(doc_id) % 2 = 0 THEN 'model_' || max(lang) ELSE 'default' END AS embedding_model FROM documents GROUP BY source")
def collection_catalog(spark, sf):
    d = table(spark, sf, "documents")
    registry = d.groupBy(F.col("source").alias("collection")).agg(F.max("doc_id").alias("m"), F.max("lang").alias("l")).where(F.col("m") % 2 == 0)
    registry = registry.select("collection", F.concat(F.lit("model_"), "l").alias("embedding_model"))
    return store.collection_catalog(d.select(F.col("source").alias("collection")), registry)


@query("write_report", finish(SAMPLES, select=f"SELECT category, count(*) AS n, {MEANS} FROM sm GROUP BY category"))
def write_report(spark, sf):
    path = work_path(spark, "report")
    report = evaluate.metric_by_group(_samples(spark, sf), "category")
    store.write_report(report, path, "first")
    return spark.read.schema(report.schema).json(f"{path}/latest")


INGESTED = (
    "u AS (SELECT doc_id, source, lang, regexp_extract_all(text, '(?:[一-鿿]|[^ \\n\\t\\r一-鿿]+)[ \\n\\t\\r]*') AS u FROM documents)",
    "ws AS (SELECT *, CASE WHEN len(u) <= 128 THEN 1 ELSE (len(u) - 128 + 95) // 96 + 1 END AS n FROM u WHERE len(u) > 0)",
    "wi AS (SELECT *, unnest(range(0, n)) AS i FROM ws)",
)


@query(
    "incremental_ingest",
    finish(*INGESTED, select="SELECT lang AS collection, source, sha256(concat_ws('|', source, doc_id, i)) AS chunk_id, CASE WHEN i > 0 THEN sha256(concat_ws('|', source, doc_id, i - 1)) END AS prev_chunk_id, "
           "CASE WHEN i + 1 < n THEN sha256(concat_ws('|', source, doc_id, i + 1)) END AS next_chunk_id, array_to_string(u[(i * 96 + 1):(i * 96 + 128)], '') AS text FROM wi"),
)
def incremental_ingest(spark, sf):
    """Documents as a stream of files, cut, linked and upserted batch by batch."""
    root = work_path(spark, "ingest")
    schema = table(spark, sf, "documents").schema
    # A pattern that names the table alone, whether it is one file (no folder to start from) or a folder of files.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/documents.parque[t]")
    docs = stream.select("doc_id", F.col("lang").alias("collection"), "source", "text")
    ingest.incremental_ingest(docs, root, f"{root}-checkpoint", lambda d: ingest.chunk_documents(d, 128, 32)).awaitTermination()
    return store.scan_collection(spark, root).select("collection", "source", "chunk_id", "prev_chunk_id", "next_chunk_id", "text")


# ------------------------------------------------------------------------------- parents, neighbours over windows

PARENTS = (*WINDOWS_SQL, "pc AS (SELECT doc_id || '-' || chunk_index AS chunk_id, CASE WHEN chunk_index % 7 <> 6 THEN doc_id END AS parent_chunk_id, chunk_index, text FROM wn)")


def _window_id(shift=0):
    return F.concat_ws("-", F.col("doc_id").cast("string"), (F.col("chunk_index") + shift).cast("string"))


def _children(spark, sf, windows=None):
    w = _windows(spark, sf) if windows is None else windows
    parent = F.when(F.col("chunk_index") % 7 != 6, F.col("doc_id"))
    return w.select(_window_id().alias("chunk_id"), parent.alias("parent_chunk_id"), "chunk_index", "text")


@query("rebuild_parents", finish(*PARENTS, select="SELECT parent_chunk_id AS chunk_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS text_hash, count(*) AS n_children FROM pc WHERE parent_chunk_id IS NOT NULL GROUP BY 1"))
def rebuild_parents(spark, sf):
    return context.rebuild_parents(_children(spark, sf)).select("chunk_id", F.md5("text").alias("text_hash"), "n_children")


def _stored_windows(spark, sf):
    """Windows are costly to cut and read several times: for the index, by id and as parents."""
    return staged(_windows(spark, sf), "windows", CODEC)


def _window_hits(spark, sf, children, k=10):
    index = keyword.write_index(children, work_path(spark, "windows"))
    return keyword.bm25_topk(questions(spark, sf), index, k)


@query(
    "swap_parents",
    finish(*PARENTS, Q, bm25(chunks="pc"),
           "hp AS (SELECT bm.*, CASE WHEN parent_chunk_id % 5 <> 0 THEN parent_chunk_id END AS par FROM bm JOIN pc USING (chunk_id))",
           "sw AS (SELECT query_id, coalesce(par::VARCHAR, chunk_id) AS chunk_id, par IS NOT NULL AS is_parent, score, rank AS r FROM hp QUALIFY row_number() OVER (PARTITION BY query_id, par IS NOT NULL, coalesce(par::VARCHAR, chunk_id) ORDER BY rank) = 1)",
           select="SELECT query_id, chunk_id, is_parent, score, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM sw"),
)
def swap_parents(spark, sf):
    children = _children(spark, sf, _stored_windows(spark, sf))
    parents = context.rebuild_parents(children).where(F.col("chunk_id") % 5 != 0)
    out = context.swap_parents(_window_hits(spark, sf, children), children, parents)
    return out.select("query_id", "chunk_id", "is_parent", "score", F.col("rank").cast("bigint").alias("rank"))


@query(
    "expand_neighbours",
    finish(*PARENTS, Q, bm25(chunks="pc"),
           "lk AS (SELECT doc_id || '-' || chunk_index AS chunk_id, CASE WHEN chunk_index > 0 THEN doc_id || '-' || (chunk_index - 1) END AS p, CASE WHEN chunk_index + 1 < n_windows THEN doc_id || '-' || (chunk_index + 1) END AS n FROM wn)",
           "nb AS (SELECT query_id, rank, 0 AS side, p AS chunk_id FROM bm JOIN lk USING (chunk_id) WHERE p IS NOT NULL UNION ALL SELECT query_id, rank, 1, n FROM bm JOIN lk USING (chunk_id) WHERE n IS NOT NULL)",
           "nx AS (SELECT query_id, chunk_id, min(rank * 2 + side) AS o FROM nb ANTI JOIN bm USING (query_id, chunk_id) GROUP BY ALL)",
           "al AS (SELECT query_id, chunk_id, score, rank AS o FROM bm UNION ALL SELECT query_id, chunk_id, 0.0, 1000000 + o FROM nx)",
           select="SELECT query_id, chunk_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY o) AS rank FROM al"),
)
def expand_neighbours(spark, sf):
    i = F.col("chunk_index")
    windows = _stored_windows(spark, sf)
    links = windows.select(
        _window_id().alias("chunk_id"), F.when(i > 0, _window_id(-1)).alias("prev_chunk_id"), F.when(i + 1 < F.col("n_windows"), _window_id(1)).alias("next_chunk_id")
    )
    return _ranked(context.expand_neighbours(_window_hits(spark, sf, _children(spark, sf, windows)), links))


# ----------------------------------------------------------------------------------------------------- summaries

SUMMARISED = "cl AS (SELECT c.chunk_id, c.text, v.label AS group_id, v.vector FROM c JOIN v USING (chunk_id))"
COMMUNITIES = (
    SUMMARISED,
    "cm AS (SELECT group_id, array_agg(m ORDER BY i) AS vector FROM (SELECT group_id, i, avg(x) AS m FROM (SELECT group_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM cl) GROUP BY ALL) GROUP BY group_id)",
    "ct AS (SELECT group_id, string_agg(text[1:250], chr(10) || chr(10) ORDER BY chunk_id)[1:200] AS text FROM (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY chunk_id) <= 6) GROUP BY group_id)",
    "co AS (SELECT 'graphrag_community_' || group_id AS chunk_id, group_id, (SELECT count(*) FROM cl x WHERE x.group_id = cm.group_id) AS n_members, text, vector FROM cm JOIN ct USING (group_id))",
)


def _labelled(spark, sf):
    return corpus(spark, sf).select("chunk_id", "text").join(vectors(spark, sf), "chunk_id").withColumnRenamed("label", "group_id")


@query("communities", finish(C, V, *COMMUNITIES, select="SELECT chunk_id, group_id, n_members, text, round(vector[1], 6) + 0.0 AS v_first, round(vector[64], 6) + 0.0 AS v_last FROM co"))
def communities(spark, sf):
    out = summaries.communities(_labelled(spark, sf))
    return out.select("chunk_id", "group_id", "n_members", "text", (F.round(F.col("vector")[0], 6) + 0.0).alias("v_first"), (F.round(F.col("vector")[63], 6) + 0.0).alias("v_last"))


@query("community_members", finish(C, V, SUMMARISED, select="SELECT group_id, chunk_id FROM cl"))
def community_members(spark, sf):
    return _labelled(spark, sf).select("group_id", "chunk_id")


GLOBAL = (
    dense_sql("qv", "co", "tg", 2),
    "gl AS (SELECT query_id, chunk_id, slot, row_number() OVER (PARTITION BY query_id ORDER BY g, slot) AS rank FROM (SELECT query_id, chunk_id, 0 AS slot, rank AS g FROM tg UNION ALL "
    "SELECT query_id, m.chunk_id::VARCHAR, m.slot, rank FROM tg JOIN co USING (chunk_id) JOIN (SELECT group_id, chunk_id, row_number() OVER (PARTITION BY group_id ORDER BY chunk_id) AS slot FROM cl QUALIFY slot <= 3) m USING (group_id)))",
)


@query("global_search", finish(C, Q, V, QV, *COMMUNITIES, *GLOBAL, select="SELECT * FROM gl"))
def global_search(spark, sf):
    labelled = _labelled(spark, sf)
    out = summaries.global_search(question_vectors(spark, sf), summaries.communities(labelled), labelled)
    return out.select("query_id", "chunk_id", F.col("slot").cast("bigint").alias("slot"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "local_global_merge",
    finish(*LOCAL, V, QV, *COMMUNITIES, *GLOBAL,
           "mm AS (SELECT query_id, chunk_id::VARCHAR AS chunk_id, 0 AS side, rank AS r, text FROM lo JOIN c USING (chunk_id) WHERE rank <= 6 UNION ALL SELECT query_id, gl.chunk_id, 1, rank, coalesce(co.text, c.text) FROM gl LEFT JOIN co ON co.chunk_id = gl.chunk_id LEFT JOIN c ON c.chunk_id::VARCHAR = gl.chunk_id WHERE rank <= 4)",
           "md AS (SELECT * FROM mm QUALIFY row_number() OVER (PARTITION BY query_id, text[1:80] ORDER BY side, r, chunk_id) = 1)",
           select="SELECT query_id, chunk_id, side, row_number() OVER (PARTITION BY query_id ORDER BY side, r) AS rank FROM md QUALIFY rank <= 10"),
)
def local_global_merge(spark, sf):
    labelled = _labelled(spark, sf)
    groups = summaries.communities(labelled)
    overall = summaries.global_search(question_vectors(spark, sf), groups, labelled)
    named = corpus(spark, sf).select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")
    texts = named.unionByName(groups.select("chunk_id", "text"))
    local = _local(spark, sf).select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "rank")
    merged = graph.local_global_merge(fusion.with_text(local, texts), fusion.with_text(overall, texts), 10)
    return merged.withColumn("rank", F.col("rank").cast("bigint"))


@query("cluster_summaries")
def cluster_summaries(spark, sf):
    return summaries.cluster_summaries(_labelled(spark, sf).drop("group_id"), n_init=2).select("chunk_id", "n_members", "text")


@query(
    "summary_search",
    finish(C, Q, V, QV, *COMMUNITIES, bm25(), dense_sql("qv", "co", "tg", 3),
           "al AS (SELECT query_id, chunk_id, rank AS r, text FROM tg JOIN co USING (chunk_id) UNION ALL SELECT query_id, chunk_id::VARCHAR, rank + 3, text FROM bm JOIN c USING (chunk_id))",
           "dd AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query_id, text[1:80] ORDER BY r, chunk_id) = 1)",
           select="SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY r, chunk_id) AS rank FROM dd QUALIFY rank <= 10"),
)
def summary_search(spark, sf):
    groups = summaries.communities(_labelled(spark, sf))
    base = fusion.with_text(_bm25(spark, sf), corpus(spark, sf))
    out = summaries.summary_search(question_vectors(spark, sf), base, groups, 10)
    return out.select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "document_summaries",
    finish(*WINDOWS_SQL, PACK_ITEMS, *PACKED,
           "nm AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY seg_start) - 1 AS seg_index, count(*) OVER (PARTITION BY source) AS n_segs, (sum(n_chunks) OVER (PARTITION BY source))::BIGINT AS orig_chunks, text[1:200] AS text FROM sg WHERE source <> 'src3')",
           select="SELECT source, 'raptor_' || source || '_' || seg_index AS chunk_id, 'raptor_summary' AS node_type, seg_index, n_segs, orig_chunks, text FROM nm"),
)
def document_summaries(spark, sf):
    windows = _windows(spark, sf)
    done = table(spark, sf, "documents").where(F.col("source") == "src3").select("source")
    return summaries.document_summaries(windows, ["doc_id", "chunk_index"], done, order_span=64)


@query("hashing_vectors", f"SELECT doc_id AS chunk_id, 64::INT AS dimensions, CASE WHEN len({tok('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents")
def hashing_vectors(spark, sf):
    chunks = corpus(spark, sf).select("chunk_id", "text")
    embedded = hooks.embed_hashing(chunks, hooks.fit_hashing(chunks, 64))
    return embedded.select("chunk_id", F.size("vector").alias("dimensions"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm"))


@query(
    "compare_scenarios",
    finish(*SCENARIO_SQL, "hv AS (SELECT chunk_id, label, vector[1:32] AS vector FROM v)", "hq AS (SELECT chunk_id AS query_id, vector FROM hv)", dense_sql("hq", "hv", "d2", 10, "q0.query_id <> i.chunk_id"),
           "sb AS (SELECT scenario, count(*) FILTER (WHERE r <= 1) AS top1, round(avg(top1_score), 4) AS avg_top1 FROM (SELECT ts.*, coalesce(d2.rank, 999) AS r, d1.score AS top1_score FROM ts LEFT JOIN d2 ON d2.query_id = ts.query_id AND d2.chunk_id = ts.chunk_id LEFT JOIN d2 d1 ON d1.query_id = ts.query_id AND d1.rank = 1) GROUP BY scenario)",
           select="SELECT scenario, sa.avg_top1 AS a_top1, sa.top1 AS a_hits, sb.avg_top1 AS b_top1, sb.top1 AS b_hits, CASE WHEN sb.avg_top1 > sa.avg_top1 + 0.02 THEN 'b' WHEN sa.avg_top1 > sb.avg_top1 + 0.02 THEN 'a' ELSE 'tie' END AS winner FROM sa JOIN sb USING (scenario)"),
)
def compare_scenarios(spark, sf):
    """The whole vectors against their first half as a second model."""
    ranked, truth = _scenarios(spark, sf)
    half = vectors(spark, sf).withColumn("vector", F.slice("vector", 1, 32))
    other = dense.dense_topk(half.select(F.col("chunk_id").alias("query_id"), "vector"), half, 10, skip_same=True)
    other = staged(other, "ranked")
    return evaluate.compare_scenarios(evaluate.scenario_accuracy(ranked, truth), evaluate.scenario_accuracy(other, truth))
