"""Registered retrieval queries: keyword, vector, fusion, context and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.sizing import BROADCAST_ROWS, fits, join_skewed
from lectern.functions.text import detect_language, is_aggregation_query, tokens
from lectern.operators import context, dense, fusion, graph, keyword
from lectern.plans.base import (
    C, CV, Q, QV, V, bm25, chunk_vectors, corpus, corpus_index, finish, merged, query, question_vectors,
    questions, rrf, table, tok, vectors,
)
from lectern.plans.base import dense as dense_sql
from lectern.session import staged

RANKED = "SELECT query_id, chunk_id, score, rank FROM "


def _ranked(df, *more):
    return df.select("query_id", *more, "chunk_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _bm25(spark, sf, k=10):
    return keyword.bm25_topk(questions(spark, sf), corpus_index(spark, sf), k)


@query(
    "build_postings",
    finish(C, f"w AS (SELECT chunk_id, unnest({tok('text')}) AS term FROM c)",
           "p AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY ALL)",
           "l AS (SELECT chunk_id, sum(tf)::BIGINT AS dl FROM p GROUP BY ALL)",
           select="SELECT chunk_id, term, tf, dl, count(*) OVER (PARTITION BY term) AS df FROM p JOIN l USING (chunk_id)"),
)
def build_postings(spark, sf):
    index = corpus_index(spark, sf)
    terms, blocks = index.terms.select("term", "df"), index.blocks.select("term", "chunk_ids", "tfs", "dls")
    # Joined by block of postings, not by posting.
    if fits(terms, BROADCAST_ROWS):
        found = blocks.join(F.broadcast(terms), "term")
    else:
        found = join_skewed(blocks, terms, "term", "df", F.col("chunk_ids")[0])
    full = keyword.unpacked(found, ["df"])
    return full.select("chunk_id", "term", "tf", F.col("dl").cast("bigint").alias("dl"), "df")


@query("tokenize", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS token_hash FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")
def tokenize(spark, sf):
    cut = table(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return cut.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("token_hash"))


@query("bm25_topk", finish(C, Q, bm25(), select=RANKED + "bm"))
def bm25_topk(spark, sf):
    return _ranked(_bm25(spark, sf))


def _self_search(spark, sf, k=10):
    v = vectors(spark, sf)
    return dense.dense_topk(v.select(F.col("chunk_id").alias("query_id"), "vector"), v, k, skip_same=True)


SELF = (V, "sq AS (SELECT chunk_id AS query_id, vector, label FROM v)", dense_sql("sq", "v", "dn", 10, "q0.query_id <> i.chunk_id"))


@query("dense_topk", finish(*SELF, select=RANKED + "dn"))
def dense_topk(spark, sf):
    return _ranked(_self_search(spark, sf))


@query("dense_topk_cells")
def dense_topk_cells(spark, sf):
    v = vectors(spark, sf)
    q = v.select(F.col("chunk_id").alias("query_id"), "vector")
    return _ranked(dense.dense_topk_cells(q, v, 10, n_cells=8, n_probe=4, skip_same=True))


@query("dense_topk_all_cells", finish(*SELF, select=RANKED + "dn"))
def dense_topk_all_cells(spark, sf):
    """Search by cells with every cell probed: the exact result."""
    v = vectors(spark, sf)
    q = v.select(F.col("chunk_id").alias("query_id"), "vector")
    return _ranked(dense.dense_topk_cells(q, v, 10, n_cells=8, n_probe=8, skip_same=True))


def _dense(spark, sf, k=10):
    return dense.dense_topk(question_vectors(spark, sf), chunk_vectors(spark, sf), k)


HYBRID = (C, Q, CV, QV, bm25(), dense_sql("qv", "cv", "dn"), rrf("bm", "dn", "hy"))


def _hybrid(spark, sf, k=10):
    return fusion.hybrid_rrf(_bm25(spark, sf, k), _dense(spark, sf, k))


@query("hybrid_rrf", finish(*HYBRID, select=RANKED + "hy"))
def hybrid_rrf(spark, sf):
    return _ranked(_hybrid(spark, sf))


LISTS = (
    "ls AS (SELECT query_id, list_id, chunk_id, rank, text FROM (SELECT query_id, chunk_id, rank, 0 AS list_id FROM bm "
    "UNION ALL SELECT query_id, chunk_id, rank, 1 FROM dn) JOIN c USING (chunk_id))"
)


@query("rrf_merge", finish(C, Q, CV, QV, bm25(), dense_sql("qv", "cv", "dn"), LISTS, merged("ls", "mg", 10, "text[1:30]"), select=RANKED + "mg"))
def rrf_merge(spark, sf):
    both = [r.select("query_id", F.lit(i).alias("list_id"), "chunk_id", "rank") for i, r in enumerate((_bm25(spark, sf), _dense(spark, sf)))]
    lists = fusion.with_text(both[0].unionByName(both[1]), corpus(spark, sf)).select("query_id", "list_id", "chunk_id", "rank", "text")
    return _ranked(fusion.rrf_merge(lists, prefix=30, top_n=10))


def _collections(spark, sf):
    """The collections that there are: as many names as the catalog has."""
    return sorted(r[0] for r in corpus(spark, sf).select("collection").where("collection IS NOT NULL").distinct().collect())


@query(
    "multi_collection",
    finish(C, Q, CV, QV, bm25(by="collection"), dense_sql("qv", "cv", "dn", by="collection"), rrf("bm", "dn", "hy", "collection"),
           "ls AS (SELECT query_id, h.collection AS list_id, chunk_id, rank, text FROM hy h JOIN c USING (chunk_id))",
           merged("ls", "mg", 10, "text[1:200]"), select=RANKED + "mg"),
)
def multi_collection(spark, sf):
    by_keyword = keyword.bm25_topk(questions(spark, sf), corpus_index(spark, sf, ("collection",)), 10)
    spread = question_vectors(spark, sf).withColumn("collection", F.explode(F.array(*[F.lit(c) for c in _collections(spark, sf)])))
    by_vector = dense.dense_topk(spread, chunk_vectors(spark, sf), 10, key="collection", per_key=True)
    per_collection = fusion.hybrid_rrf(by_keyword, by_vector, within=["collection"])
    return _ranked(fusion.multi_collection(per_collection, corpus(spark, sf).drop("collection"), 10))


# Translations are stored rows: a question's "translation" is another question of the table, some are out of date.
TRANSLATIONS = (
    "tr AS (SELECT 'en' AS src_lang, a.text AS query, b.text AS translated, "
    "TIMESTAMP '2024-01-31 00:00:00' - to_days((a.item_id % 10)::INT) AS created_at FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"
)
TRANSLATED = (
    "tq AS (SELECT query_id, text, arg_max(translated, row(created_at, translated)) FILTER "
    "(WHERE created_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS) AS translated "
    "FROM q LEFT JOIN tr ON tr.query = q.text GROUP BY query_id, text)"
)


def _translated(spark, sf):
    b = table(spark, sf, "benchmark")
    stored = b.select("item_id", F.col("text").alias("query")).join(
        b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("translated")), "item_id"
    )
    now = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    age = F.make_dt_interval((F.col("item_id") % 10).cast("int"))
    translations = stored.select(F.lit("en").alias("src_lang"), "query", "translated", (now - age).alias("created_at"))
    asked = questions(spark, sf).withColumn("src_lang", detect_language(F.col("text")))
    return fusion.translation_lookup(asked, translations, now)


@query("translation_lookup", finish(Q, TRANSLATIONS, TRANSLATED, select="SELECT query_id, translated FROM tq"))
def translation_lookup(spark, sf):
    return _translated(spark, sf).select("query_id", "translated")


VARIANTS = "vq AS (SELECT query_id * 2 AS query_id, text FROM q UNION ALL SELECT query_id * 2 + 1, translated FROM tq WHERE translated IS NOT NULL)"
VARIANT_LISTS = (
    "rows AS (SELECT query_id // 2 AS query_id, (query_id % 2)::INT AS list_id, chunk_id, rank, text FROM {0} JOIN c USING (chunk_id)), "
    "ls AS (SELECT *, CASE WHEN max(list_id) OVER (PARTITION BY query_id) = 1 THEN text[1:100] ELSE concat('#', chunk_id) END AS k FROM rows)"
)


@query("bilingual", finish(C, Q, TRANSLATIONS, TRANSLATED, VARIANTS, bm25("vq"), VARIANT_LISTS.format("bm"), merged("ls", "mg", 10, "k"), select=RANKED + "mg"))
def bilingual(spark, sf):
    variants = fusion.query_variants(questions(spark, sf), _translated(spark, sf))
    coded = variants.select((F.col("query_id") * 2 + F.col("variant")).alias("query_id"), "text")
    found = keyword.bm25_topk(coded, corpus_index(spark, sf), 10)
    ranked = found.select(
        F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).cast("int").alias("variant"), "chunk_id", "rank"
    )
    return _ranked(fusion.bilingual(ranked, corpus(spark, sf), 10))


CATALOG = "cat AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 'base_en' WHEN 'fr' THEN 'base' WHEN 'de' THEN 'other_zh' ELSE 'other_en' END AS collection FROM documents)"
PARTNERS = """pt AS (SELECT collection, CASE
  WHEN collection LIKE '%\\_en' ESCAPE '\\' THEN coalesce(
    (SELECT min(x.collection) FROM cat x WHERE x.collection = regexp_replace(cat.collection, '_en$', '_zh')),
    (SELECT min(x.collection) FROM cat x WHERE x.collection = regexp_replace(cat.collection, '_en$', '')))
  WHEN collection LIKE '%\\_zh' ESCAPE '\\' THEN (SELECT min(x.collection) FROM cat x WHERE x.collection = regexp_replace(cat.collection, '_zh$', '_en'))
  ELSE (SELECT min(x.collection) FROM cat x WHERE x.collection = cat.collection || '_en') END AS partner FROM cat)"""


def _named(col):
    """Collection names that follow the pairing convention, one per document language."""
    return F.when(col == "en", "base_en").when(col == "fr", "base").when(col == "de", "other_zh").otherwise("other_en")


@query("partner_collection", finish(CATALOG, PARTNERS, select="SELECT collection, partner FROM pt"))
def partner_collection(spark, sf):
    catalog = table(spark, sf, "documents").select(_named(F.col("lang")).alias("collection")).distinct()
    return fusion.partner_collection(catalog, catalog)


HOME = "CASE item_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END"
AWAY = "CASE item_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE 'es' END"


@query(
    "cross_collection",
    finish(C, f"q AS (SELECT item_id AS query_id, {HOME} AS collection, {AWAY} AS away, text FROM benchmark)", CV,
           "qv AS (SELECT q.query_id, q.collection, q.away, v.vector FROM q JOIN v ON q.query_id = v.chunk_id)",
           "qt AS (SELECT q.query_id, q.away, v.vector FROM q JOIN v ON q.query_id + 1 = v.chunk_id)",
           bm25(by="collection", own=True), dense_sql("qv", "cv", "dn", where="q0.collection = i.collection"), rrf("bm", "dn", "hy"),
           dense_sql("qt", "cv", "pn", where="q0.away = i.collection"),
           "rows AS (SELECT query_id, list_id, chunk_id, rank, text FROM (SELECT query_id, chunk_id, rank, 0 AS list_id FROM hy UNION ALL "
           "SELECT query_id, chunk_id, rank, 1 FROM pn) JOIN c USING (chunk_id)), "
           "ls AS (SELECT *, CASE WHEN max(list_id) OVER (PARTITION BY query_id) = 1 THEN text[1:100] ELSE concat('#', chunk_id) END AS k FROM rows)",
           merged("ls", "mg", 10, "k"), select=RANKED + "mg"),
)
def cross_collection(spark, sf):
    home = F.when(F.col("query_id") % 3 == 0, "en").when(F.col("query_id") % 3 == 1, "fr").otherwise("de")
    asked = questions(spark, sf).withColumn("collection", home)
    # Pairing by name, then back to the language codes the corpus uses.
    code = {"base_en": "en", "base": "fr", "other_zh": "de", "other_en": "es"}
    catalog = table(spark, sf, "documents").select(_named(F.col("lang")).alias("collection")).distinct()
    pairs = fusion.partner_collection(catalog, catalog)
    back = F.create_map(*[F.lit(x) for kv in code.items() for x in kv])
    pairs = pairs.select(back[F.col("collection")].alias("collection"), back[F.col("partner")].alias("partner"))
    v = vectors(spark, sf)
    own_vec = asked.join(v.select(F.col("chunk_id").alias("query_id"), "vector"), "query_id")
    moved = v.select((F.col("chunk_id") - 1).alias("query_id"), "vector")  # stands for the translated question's vector
    away = asked.join(pairs, "collection").join(moved, "query_id").select("query_id", F.col("partner").alias("collection"), "vector")
    items = chunk_vectors(spark, sf)
    own = fusion.hybrid_rrf(
        keyword.bm25_topk(asked, corpus_index(spark, sf, ("collection",)), 10), dense.dense_topk(own_vec, items, 10, key="collection")
    )
    partner = dense.dense_topk(away, items, 10, key="collection")
    return _ranked(fusion.cross_collection(own, partner, corpus(spark, sf), 10))


F1 = (
    "CASE WHEN len(qt) + len(ct) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(qt, ct)) / (len(qt) + len(ct)) END"
)


def rerank_sql(cands: str, out: str, n: int) -> str:
    return f"""
{out}_s AS (SELECT query_id, chunk_id, round({F1}, 6) AS score FROM (
  SELECT k.query_id, k.chunk_id, list_distinct({tok('q.text')}) AS qt, list_distinct({tok('c.text')}) AS ct
  FROM {cands} k JOIN q USING (query_id) JOIN c USING (chunk_id))),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {out}_s QUALIFY rank <= {n})"""


@query("rerank_topn", finish(C, Q, bm25(), rerank_sql("bm", "rr", 3), select=RANKED + "rr"))
def rerank_topn(spark, sf):
    return _ranked(context.rerank_topn(_bm25(spark, sf), questions(spark, sf), corpus(spark, sf), 3))


SUBS = "sq AS (SELECT {'query': item_id, 'part': i} AS query_id, s AS text FROM (SELECT item_id, unnest(string_split(text, '.')) AS s, generate_subscripts(string_split(text, '.'), 1) AS i FROM benchmark))"


@query(
    "subquery_union",
    finish(C, Q, SUBS, bm25("sq"),
           "u AS (SELECT query_id.query AS query_id, query_id.part AS sub_idx, chunk_id, rank, text FROM bm JOIN c USING (chunk_id))",
           "uu AS (SELECT query_id, chunk_id FROM u QUALIFY row_number() OVER (PARTITION BY query_id, text[1:80] ORDER BY sub_idx, rank, chunk_id) = 1)",
           rerank_sql("uu", "rr", 3), select=RANKED + "rr"),
)
def subquery_union(spark, sf):
    parts = questions(spark, sf).select("query_id", F.posexplode(F.split("text", r"\.")).alias("i", "text"))
    coded = parts.select(F.struct(F.col("query_id").alias("query"), (F.col("i") + 1).alias("part")).alias("query_id"), "text")
    found = keyword.bm25_topk(coded, corpus_index(spark, sf), 10)
    ranked = found.select(F.col("query_id.query").alias("query_id"), F.col("query_id.part").alias("sub_idx"), "chunk_id", "rank")
    union = context.subquery_union(ranked, corpus(spark, sf))
    return _ranked(context.rerank_topn(union, questions(spark, sf), corpus(spark, sf), 3))


@query(
    "prefix_dedup",
    finish(C, Q, bm25(k=50),
           "d AS (SELECT query_id, chunk_id, score, rank AS r FROM bm JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, text[1:80] ORDER BY rank, chunk_id) = 1)",
           select="SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY r, chunk_id) AS rank FROM d QUALIFY rank <= 10"),
)
def prefix_dedup(spark, sf):
    rows = fusion.with_text(_bm25(spark, sf, 50), corpus(spark, sf))
    return _ranked(context.prefix_dedup(rows, 10))


@query(
    "retrieval_gate",
    finish(*SELF,
           "a AS (SELECT query_id, (rank - 1) // 3 AS attempt, max(score) AS top FROM dn WHERE (rank - 1) // 3 <= 2 GROUP BY ALL)",
           "p AS (SELECT query_id, coalesce(min(CASE WHEN top >= 0.35 THEN attempt END), max(attempt)) AS attempt FROM a GROUP BY 1)",
           select="SELECT query_id, attempt, top AS top_score, CASE WHEN top >= 0.35 THEN 'generate' WHEN attempt < 2 THEN 'rewrite' ELSE 'fallback' END AS decision FROM p JOIN a USING (query_id, attempt)"),
)
def retrieval_gate(spark, sf):
    # Ranks 1-3, 4-6, ... stand for the results of successive attempts.
    tries = _self_search(spark, sf).select("query_id", F.floor((F.col("rank") - 1) / 3).alias("attempt"), "score")
    return context.retrieval_gate(tries, threshold=0.35)


@query("assemble_context", finish(C, Q, bm25(k=5), select="SELECT query_id, md5(string_agg('[' || rank || '] 来源：' || source || ' p.' || page || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context_hash, count(*) AS n_chunks FROM bm JOIN c USING (chunk_id) GROUP BY query_id"))
def assemble_context(spark, sf):
    built = context.assemble_context(_bm25(spark, sf, 5), corpus(spark, sf))
    return built.select("query_id", F.md5("context").alias("context_hash"), "n_chunks")


@query("citations", finish(C, Q, bm25(k=3), select='SELECT query_id, rank AS "index", round(score, 3) AS score, page, text[1:150] AS content FROM bm JOIN c USING (chunk_id)'))
def citations(spark, sf):
    cited = context.citations(_bm25(spark, sf, 3), corpus(spark, sf))
    return cited.withColumn("index", F.col("index").cast("bigint"))


@query(
    "history_window",
    "SELECT conv_id, string_agg((CASE WHEN role = 'user' THEN '用户：' ELSE '助手：' END) || text, chr(10) ORDER BY turn) AS history, count(*) AS n_messages "
    "FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id",
)
def history_window(spark, sf):
    return context.history_window(table(spark, sf, "conversations"))


@query("detect_language", "SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[\\p{L}\\p{N}_]')) > 0 AND len(regexp_extract_all(text, '[一-鿿]')) / len(regexp_extract_all(text, '[\\p{L}\\p{N}_]')) > 0.3 THEN 'zh' ELSE 'en' END AS detected FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN text || repeat('反应器温度', length(text) // 8) ELSE text END AS text FROM documents)")
def detect_language_of_documents(spark, sf):
    mixed = F.when(F.col("lang") == "de", F.concat("text", F.repeat(F.lit("反应器温度"), F.floor(F.length("text") / 8).cast("int")))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", detect_language(mixed).alias("detected"))


AGGR = "(?i)(一共|总共|共有?|总计)[多少几个家条份]|[多少几](个|家|只|条|份|种)|列出所有|列举所有|所有的?\\S+有哪些|统计.{0,10}(数量|个数|多少|几个|几家)"
ASKED = "CASE doc_id % 4 WHEN 0 THEN '请统计' || source || '的数量' WHEN 1 THEN source || '有多少个' WHEN 2 THEN '列出所有' || source ELSE '什么是' || source END"


@query("flag_aggregation_query", f"SELECT doc_id, regexp_matches(qt, '{AGGR}') AS is_aggregation, CASE WHEN regexp_matches(qt, '{AGGR}') THEN 'direct' ELSE 'retrieve' END AS route FROM (SELECT doc_id, {ASKED} AS qt FROM documents)")
def flag_aggregation_query(spark, sf):
    flagged = table(spark, sf, "documents").select("doc_id", F.expr(ASKED).alias("qt"))
    hit = is_aggregation_query(F.col("qt"))
    return flagged.select("doc_id", hit.alias("is_aggregation"), F.when(hit, "direct").otherwise("retrieve").alias("route"))


# ------------------------------------------------------------------------------------------------- term graph

IDF = (
    f"ep AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({tok('text[1:400]')}) AS term FROM c) GROUP BY ALL)",
    "idf AS (SELECT term, ln((SELECT count(*) FROM c) / count(*)) AS idf FROM ep GROUP BY term)",
)


def edges_sql(k: int, out: str = "ed") -> str:
    return f"""{out} AS (SELECT chunk_id, term AS entity, 1 AS weight FROM ep JOIN idf USING (term)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY round(tf * idf, 6) DESC, term) <= {k})"""


QENT = f"""qe AS (SELECT query_id, term AS entity FROM
  (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({tok('text[1:400]')}) AS term FROM q) GROUP BY ALL) JOIN idf USING (term)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(tf * idf, 6) DESC, term) <= 6)"""


@query("term_graph", finish(C, *IDF, edges_sql(8), select="SELECT * FROM ed"))
def term_graph(spark, sf):
    return graph.term_graph(corpus(spark, sf))


@query("entity_graph", finish(C, *IDF, edges_sql(5), select="SELECT * FROM ed"))
def entity_graph(spark, sf):
    return graph.entity_graph(corpus(spark, sf))


@query(
    "split_entities",
    "SELECT DISTINCT chunk_id, entity, 1 AS weight FROM (SELECT doc_id AS chunk_id, trim(unnest(string_split_regex(text, '[,，、\\n]')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS entity FROM documents) WHERE length(entity) >= 2",
)
def split_entities(spark, sf):
    return graph.entity_graph(corpus(spark, sf), entities="text")


def _graph_inputs(spark, sf):
    chunks = corpus(spark, sf)
    idf = graph.entity_idf(chunks)
    # The graph is a stored table that hops read from both ends.
    return graph.query_entities(questions(spark, sf), idf), staged(graph.term_graph(chunks, idf=idf), "edges")


def reached_sql(seeds: str, out: str, k: int | None = None) -> str:
    cut = f"QUALIFY r <= {k}" if k else ""
    return f"""{out} AS (SELECT query_id, chunk_id, min(hop) AS hop, count(*) AS shared,
  row_number() OVER (PARTITION BY query_id ORDER BY min(hop), count(*) DESC, chunk_id) AS r
  FROM {seeds} JOIN ed USING (entity) ANTI JOIN bm USING (query_id, chunk_id) GROUP BY query_id, chunk_id {cut})"""


@query(
    "kg_expand",
    finish(C, Q, bm25(), *IDF, edges_sql(8), QENT,
           "sd AS (SELECT query_id, entity, min(hop) AS hop FROM (SELECT query_id, entity, 1 AS hop FROM qe UNION ALL SELECT query_id, entity, 2 FROM bm JOIN ed USING (chunk_id)) GROUP BY ALL)",
           reached_sql("sd", "rx", 20),
           "al AS (SELECT query_id, chunk_id, 0 AS hop, rank AS r FROM bm UNION ALL SELECT query_id, chunk_id, hop, r FROM rx)",
           select="SELECT query_id, chunk_id, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop > 0, r) AS rank FROM al QUALIFY rank <= 20"),
)
def kg_expand(spark, sf):
    entities, edges = _graph_inputs(spark, sf)
    out = graph.kg_expand(_bm25(spark, sf), entities, edges, k=20)
    return out.select("query_id", "chunk_id", "hop", F.col("rank").cast("bigint").alias("rank"))


LOCAL = (C, Q, bm25(), *IDF, edges_sql(5), QENT, "sd AS (SELECT query_id, entity, 1 AS hop FROM qe)", reached_sql("sd", "rx"),
         "lo AS (SELECT query_id, chunk_id, hop, row_number() OVER (PARTITION BY query_id ORDER BY hop > 0, r) AS rank FROM "
         "(SELECT query_id, chunk_id, 0 AS hop, rank AS r FROM bm UNION ALL SELECT query_id, chunk_id, hop, r FROM rx))")


def _local(spark, sf):
    chunks = corpus(spark, sf)
    idf = graph.entity_idf(chunks)
    return graph.local_search(
        _bm25(spark, sf), graph.query_entities(questions(spark, sf), idf), graph.term_graph(chunks, 5, idf=idf)
    )


@query("local_search", finish(*LOCAL, select="SELECT * FROM lo"))
def local_search(spark, sf):
    return _local(spark, sf).select("query_id", "chunk_id", "hop", F.col("rank").cast("bigint").alias("rank"))


WORDS = "regexp_extract_all(text, '[\\p{L}_]+')"


@query(
    "mine_terms",
    f"WITH w AS (SELECT doc_id // 10 AS batch, {WORDS} AS w FROM documents), "
    "g AS (SELECT batch, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), "
    "d AS (SELECT DISTINCT batch, term FROM g WHERE length(term) BETWEEN 2 AND 15) "
    "SELECT term, count(*) AS freq, least(count(*) * 10, 100) AS weight FROM d GROUP BY term",
)
def mine_terms(spark, sf):
    return keyword.mine_terms(table(spark, sf, "documents"), "doc_id")
