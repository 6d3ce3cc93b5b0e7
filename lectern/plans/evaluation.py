"""Registered queries for labels, hit rates, metric reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import evaluate, keyword
from lectern.plans.base import C, Q, V, bm25, corpus, corpus_index, cosine, finish, query, questions, table, vectors
from lectern.plans.retrieval import SELF, _self_search
from lectern.session import staged


def _paged(spark, sf):
    v = vectors(spark, sf)
    chunks = v.select("chunk_id", F.floor(F.col("chunk_id") / 10).alias("page"), "vector")
    vector = F.when(F.col("chunk_id") % 17 != 5, F.col("vector"))
    qa = v.select(F.col("chunk_id").alias("query_id"), F.floor(F.col("chunk_id") / 6).alias("page"), vector.alias("vector"))
    return qa, chunks


LABELS = (
    V, "ch AS (SELECT chunk_id, chunk_id // 10 AS page, vector FROM v)",
    "qa AS (SELECT chunk_id AS query_id, chunk_id // 6 AS page, vector FROM v WHERE chunk_id % 17 <> 5)",
    f"nr AS (SELECT q0.query_id, i.chunk_id, {cosine('q0.vector', 'i.vector')} AS score FROM qa q0 JOIN ch i ON abs(i.page - q0.page) <= 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1)",
    f"fr AS (SELECT q0.query_id, i.chunk_id, {cosine('q0.vector', 'i.vector')} AS score FROM (SELECT * FROM qa ANTI JOIN nr USING (query_id)) q0, ch i QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) = 1)",
    "sl AS (SELECT v.chunk_id AS query_id, coalesce(f.chunk_id, -1) AS chunk_id, f.score, coalesce(f.found, 'failed') AS found FROM v LEFT JOIN (SELECT *, 'page' AS found FROM nr UNION ALL SELECT *, 'global' FROM fr) f ON f.query_id = v.chunk_id)",
)


@query("silver_labels", finish(*LABELS, select="SELECT * FROM sl"))
def silver_labels(spark, sf):
    labels = evaluate.silver_labels(*_paged(spark, sf))
    return labels.withColumn("chunk_id", F.coalesce("chunk_id", F.lit(-1)))


def _label_truth(spark, sf):
    """Other vectors of the same label count as relevant."""
    v = vectors(spark, sf)
    ranked = _self_search(spark, sf)
    own = v.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("own"))
    other = v.select("chunk_id", F.col("label").alias("other"))
    hits = ranked.join(own, "query_id").join(other, "chunk_id").where(F.col("own") == F.col("other"))
    first = own.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    return staged(first, "first-hits")  # two columns, read several times; the search behind them is run once


FIRST = (*SELF, "fh AS (SELECT sq.query_id, min(CASE WHEN v.label = sq.label THEN rank END) AS rank FROM sq LEFT JOIN dn USING (query_id) LEFT JOIN v USING (chunk_id) GROUP BY sq.query_id)")
HITS = "round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), {0}) AS hit_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), {0}) AS hit_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), {0}) AS hit_at_5"




@query(
    "hit_at_k",
    finish(*FIRST, select=f"SELECT count(*) AS n_evaluated, {HITS.format(4)}, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) AS mrr FROM fh"),
)
def hit_at_k(spark, sf):
    return evaluate.hit_at_k(_label_truth(spark, sf))


def _own_truth(spark, sf):
    """Truth by equal text hash: a question is relevant to documents that carry one of its sentences whole."""
    def parts(df, key, col):
        cut = df.select(key, F.explode(F.split(col, r"[.\n]")).alias("s")).withColumn("s", F.btrim("s"))
        return cut.where(F.length("s") >= 40).select(key, F.xxhash64("s").alias("h"), "s").distinct()

    q = parts(questions(spark, sf), "query_id", "text")
    d = parts(corpus(spark, sf), "chunk_id", "text")
    return q.join(d, ["h", "s"]).select("query_id", "chunk_id").distinct()


PARTS = "SELECT DISTINCT {k}, s FROM (SELECT {k}, trim(unnest(string_split_regex(text, '[.\\n]'))) AS s FROM {t}) WHERE length(s) >= 40"


@query(
    "first_hits",
    finish(C, Q, bm25(), f"qs AS ({PARTS.format(k='query_id', t='q')}), ds AS ({PARTS.format(k='chunk_id', t='c')})",
           "tr AS (SELECT DISTINCT query_id, chunk_id FROM qs JOIN ds USING (s))",
           select="SELECT query_id, coalesce(min(bm.rank), 999) AS rank FROM tr LEFT JOIN bm USING (query_id, chunk_id) GROUP BY query_id"),
)
def first_hits(spark, sf):
    ranked = keyword.bm25_topk(questions(spark, sf), corpus_index(spark, sf), 10)
    first = evaluate.first_hits(ranked, _own_truth(spark, sf))
    return first.select("query_id", F.coalesce("rank", F.lit(evaluate.NO_RANK)).cast("bigint").alias("rank"))


GROUPS = "gr AS (SELECT query_id, rank, CASE query_id % 4 WHEN 0 THEN 'factual' WHEN 1 THEN 'reasoning' WHEN 2 THEN 'negative' ELSE 'multi_hop' END AS question_type, CASE WHEN query_id % 3 = 0 THEN 'multi_hop' ELSE 'single_hop' END AS difficulty, 'topic' || (query_id % 7) AS topic_tag FROM fh)"


def _grouping(df):
    k = F.col("query_id")
    return df.select(
        "query_id",
        F.when(k % 4 == 0, "factual").when(k % 4 == 1, "reasoning").when(k % 4 == 2, "negative").otherwise("multi_hop").alias("question_type"),
        F.when(k % 3 == 0, "multi_hop").otherwise("single_hop").alias("difficulty"),
        F.concat(F.lit("topic"), (k % 7).cast("string")).alias("topic_tag"),
    )


@query(
    "hit_by_group",
    finish(*FIRST, GROUPS, select=" UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n, {HITS.format(3)} FROM gr GROUP BY {d}" for d in ("question_type", "difficulty", "topic_tag"))),
)
def hit_by_group(spark, sf):
    first = _label_truth(spark, sf)
    return evaluate.hit_by_group(first, _grouping(first), ["question_type", "difficulty", "topic_tag"])


# Metric columns derived from events; some are NaN, one group has no numbers at all.
SAMPLES = """sm AS (SELECT event_id AS id, event_type AS category, 'level' || (event_id % 3 + 1) AS level,
  CASE WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE (value * 7) % 1.0 END AS faithfulness,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE (value * 3) % 1.0 END AS answer_relevancy,
  CASE WHEN event_type = 'view' THEN 'nan'::DOUBLE ELSE (value * 5) % 1.0 END AS context_precision,
  (value * 11) % 1.0 AS context_recall, value % 1.0 AS top1_score, value AS elapsed FROM events)"""


def _samples(spark, sf):
    e = table(spark, sf, "events")
    i, v = F.col("event_id"), F.col("value")
    nan = F.lit(float("nan"))
    return e.select(
        i.alias("id"), F.col("event_type").alias("category"), F.concat(F.lit("level"), (i % 3 + 1).cast("string")).alias("level"),
        F.when(i % 11 == 0, nan).otherwise(v * 7 % 1.0).alias("faithfulness"),
        F.when(i % 13 != 0, v * 3 % 1.0).alias("answer_relevancy"),
        F.when(F.col("event_type") == "view", nan).otherwise(v * 5 % 1.0).alias("context_precision"),
        (v * 11 % 1.0).alias("context_recall"), (v % 1.0).alias("top1_score"), v.alias("elapsed"),
    )


def mean_sql(c: str, out: str | None = None) -> str:
    return f"round(avg(CASE WHEN NOT isnan({c}) THEN {c} END), 4) AS {out or c}"


MEANS = ", ".join(mean_sql(m) for m in evaluate.METRICS)


@query("metric_means", finish(SAMPLES, select=f"SELECT count(*) AS n, {MEANS} FROM sm"))
def metric_means(spark, sf):
    return evaluate.metric_means(_samples(spark, sf))


@query("metric_by_group", finish(SAMPLES, select=f"SELECT category, count(*) AS n, {MEANS} FROM sm GROUP BY category"))
def metric_by_group(spark, sf):
    return evaluate.metric_by_group(_samples(spark, sf), "category")


ITEMS = """im AS (SELECT id, category, CASE WHEN id % 9 = 0 THEN '' ELSE 'a' END AS answer, CASE WHEN id % 7 = 0 THEN 'error' ELSE 'retrieve' END AS route,
  CASE WHEN id % 4 = 0 THEN '' ELSE 'r' END AS reference FROM sm)"""


def _items(samples):
    i = F.col("id")
    return samples.select(
        "id", "category", F.when(i % 9 == 0, "").otherwise("a").alias("answer"), F.when(i % 7 == 0, "error").otherwise("retrieve").alias("route"),
        F.when(i % 4 == 0, "").otherwise("r").alias("reference"),
    )


REPORT = MEANS + ", " + mean_sql("top1_score", "avg_top1_score") + ", " + mean_sql("elapsed", "avg_elapsed")


@query(
    "eval_report",
    finish(SAMPLES, ITEMS, "kp AS (SELECT sm.* FROM sm JOIN im USING (id) WHERE sm.category <> 'signup' AND answer <> '' AND route <> 'error')",
           select=f"SELECT category, n, scope, faithfulness, answer_relevancy, context_precision, context_recall, avg_top1_score, avg_elapsed FROM (SELECT category, count(*) AS n, 'category' AS scope, {REPORT} FROM kp GROUP BY category UNION ALL SELECT 'all', count(*), 'aggregate', {REPORT} FROM kp)"),
)
def eval_report(spark, sf):
    samples = _samples(spark, sf)
    kept = evaluate.scored_items(_items(samples), skipped=["signup"])
    return evaluate.eval_report(kept.select("id", "category"), samples.drop("category", "level"), skipped=["signup"])


@query(
    "corrected_hit_rate",
    finish(*FIRST, "r AS (SELECT fh.rank, CASE WHEN quality = 1 AND fh.rank IS NULL THEN 'y' WHEN quality = 0 THEN 'n' END AS verdict FROM fh LEFT JOIN labels ON doc_id = query_id)",
           select="SELECT count(*) AS n, count(rank) AS auto_hits, count(*) FILTER (WHERE verdict = 'y') AS verdict_y, count(*) FILTER (WHERE verdict = 'n') AS verdict_n, round(count(rank)::DOUBLE / count(*), 4) AS hit_rate, "
                  "round((count(rank) + count(*) FILTER (WHERE verdict = 'y'))::DOUBLE / count(*), 4) AS corrected_rate, round((count(*) FILTER (WHERE verdict = 'y'))::DOUBLE / count(*), 4) AS label_noise FROM r"),
)
def corrected_hit_rate(spark, sf):
    first = _label_truth(spark, sf)
    judged = first.join(table(spark, sf, "labels").select(F.col("doc_id").alias("query_id"), "quality"), "query_id")
    verdict = F.when((F.col("quality") == 1) & F.col("rank").isNull(), "y").when(F.col("quality") == 0, "n")
    return evaluate.corrected_hit_rate(first, judged.select("query_id", verdict.alias("verdict")))


@query(
    "level_comparison",
    finish(SAMPLES, "mv AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, level, {mean_sql(m, 'value')} FROM sm GROUP BY level" for m in evaluate.METRICS) + ")",
           select="SELECT metric, max(CASE WHEN level = 'level1' THEN value END) AS level1, max(CASE WHEN level = 'level2' THEN value END) AS level2, max(CASE WHEN level = 'level3' THEN value END) AS level3, arg_min(level, row(-value, level)) AS best FROM mv GROUP BY metric"),
)
def level_comparison(spark, sf):
    return evaluate.level_comparison(_samples(spark, sf), "level", ["level1", "level2", "level3"])


SCENARIO = "CASE query_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END"
TRUE_CHUNK = "((query_id * 7 + 1) % (SELECT count(*) FROM v))"


def _scenarios(spark, sf):
    """Truth for each vector: its nearest neighbour for even ids, some other vector for odd ones."""
    v = vectors(spark, sf)
    ranked = staged(_self_search(spark, sf), "ranked")  # read for the truth, the best scores and the ranks
    n = v.agg(F.count("*")).scalar()
    k = F.col("query_id")
    best = ranked.where(F.col("rank") == 1 + F.col("query_id") % 6).select("query_id", F.col("chunk_id").alias("_near"))
    rows = v.select(F.col("chunk_id").alias("query_id")).join(best, "query_id", "left")
    scenario = F.when(k % 4 == 0, "A").when(k % 4 == 1, "B").when(k % 4 == 2, "C").otherwise("D")
    truth = rows.select("query_id", scenario.alias("scenario"), F.when(k % 2 == 0, F.col("_near")).otherwise((k * 7 + 1) % n).alias("chunk_id"))
    a = v.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("_q"))
    from lectern.functions.vectors import cosine as cos

    scored = truth.join(a, "query_id").join(v.select("chunk_id", "vector"), "chunk_id")
    truth = scored.select("query_id", "scenario", "chunk_id", F.round(cos(F.col("_q"), F.col("vector")), 6).alias("truth_score"))
    return ranked, staged(truth, "truth")


SCENARIO_SQL = (*SELF, f"tt AS (SELECT sq.query_id, {SCENARIO} AS scenario, CASE WHEN sq.query_id % 2 = 0 THEN dn.chunk_id ELSE {TRUE_CHUNK.replace('query_id', 'sq.query_id')} END AS chunk_id FROM sq LEFT JOIN dn ON dn.query_id = sq.query_id AND dn.rank = 1 + sq.query_id % 6)".replace("CASE query_id % 4", "CASE sq.query_id % 4"),
                f"ts AS (SELECT tt.*, {cosine('sq.vector', 'v.vector')} AS truth_score FROM tt JOIN sq USING (query_id) JOIN v ON v.chunk_id = tt.chunk_id)",
                "sa AS (SELECT scenario, count(*) AS n, count(*) FILTER (WHERE r <= 1) AS top1, count(*) FILTER (WHERE r <= 3) AS top3, count(*) FILTER (WHERE r <= 5) AS top5, round(avg(top1_score), 4) AS avg_top1, round(avg(truth_score), 4) AS avg_truth, round(avg(r), 4) AS avg_rank "
                "FROM (SELECT ts.*, coalesce(dn.rank, 999) AS r, d1.score AS top1_score FROM ts LEFT JOIN dn ON dn.query_id = ts.query_id AND dn.chunk_id = ts.chunk_id LEFT JOIN dn d1 ON d1.query_id = ts.query_id AND d1.rank = 1) GROUP BY scenario)")


@query("scenario_accuracy", finish(*SCENARIO_SQL, select="SELECT * FROM sa"))
def scenario_accuracy(spark, sf):
    return evaluate.scenario_accuracy(*_scenarios(spark, sf))


@query(
    "chunk_profile",
    "SELECT lang, count(*) AS n, min(length(text)) AS min_len, max(length(text)) AS max_len, median(length(text)) AS median_len, round(avg(length(text)), 4) AS mean_len, "
    + ", ".join(f"count(*) FILTER (WHERE length(text) <= {s}) AS le_{s}" for s in evaluate.PROFILE_STEPS)
    + ", count(*) FILTER (WHERE length(text) > 512) AS above FROM documents GROUP BY lang",
)
def chunk_profile(spark, sf):
    return evaluate.chunk_profile(table(spark, sf, "documents"), "lang")
