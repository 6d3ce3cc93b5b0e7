"""Registered queries over question-answer sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import TOPICS_STANDARDS, topic
from lectern.operators import curate
from lectern.operators.ordered import block_of
from lectern.plans.base import finish, query, table
from lectern.plans.shaping import strip_sql, topic_sql



def _qa(spark, sf):
    """One item per document: first line as question, an answer that breaks some rule for some ids."""
    d = table(spark, sf, "documents")
    first = F.get(F.split("text", "\n"), F.lit(0))
    k = F.col("doc_id")
    answer = (
        F.when(k % 8 == 0, "否，不适用").when(k % 8 == 1, "1").when(k % 8 == 2, "not in the text at all 温度").when(k % 8 == 3, "\\mathrm{kg} value").otherwise(first)
    )
    kind = F.when(k % 6 == 0, "factual").when(k % 6 == 1, "reasoning").when(k % 6 == 2, "negative").when(k % 6 == 3, "comparison").when(k % 6 == 4, "open").otherwise("")
    question = F.when(k % 10 == 9, F.concat(first, F.lit("..... 12"))).otherwise(first)
    item = d.select(
        k.alias("qa_id"), question.alias("question"), answer.alias("ground_truth"), F.when(k % 12 == 11, F.lit(None)).otherwise(F.col("text")).alias("source_text"),
        kind.alias("question_type"), F.when(k % 5 == 0, "multi_hop").otherwise("single_hop").alias("difficulty"), (k % 9).alias("page"),
    )
    return item.withColumn("topic_tag", topic(F.concat("question", "ground_truth"), TOPICS_STANDARDS))


QA = f"""qa AS (SELECT *, {topic_sql(TOPICS_STANDARDS, 'question || ground_truth')} AS topic_tag FROM (SELECT doc_id AS qa_id,
  CASE WHEN doc_id % 10 = 9 THEN f || '..... 12' ELSE f END AS question,
  CASE doc_id % 8 WHEN 0 THEN '否，不适用' WHEN 1 THEN '1' WHEN 2 THEN 'not in the text at all 温度' WHEN 3 THEN '\\mathrm{{kg}} value' ELSE f END AS ground_truth,
  CASE WHEN doc_id % 12 = 11 THEN '' ELSE text END AS source_text,
  CASE doc_id % 6 WHEN 0 THEN 'factual' WHEN 1 THEN 'reasoning' WHEN 2 THEN 'negative' WHEN 3 THEN 'comparison' WHEN 4 THEN 'open' ELSE '' END AS question_type,
  CASE WHEN doc_id % 5 = 0 THEN 'multi_hop' ELSE 'single_hop' END AS difficulty, doc_id % 9 AS page
  FROM (SELECT doc_id, text, string_split(text, chr(10))[1] AS f FROM documents)))"""
LATEX = r"'(\$|\\mathrm|\\times|\\sim|\\circ|\\leq|\\geq|\\frac|\\sqrt|\\[\p{L}\p{N}_]{2,})'"
ARTIFACT = r"'错误!未定义书签|\.{5,}|\.{3,}\s+[0-9]+'"
GT, SRC, QU = (strip_sql(c) for c in ("ground_truth", "source_text", "question"))
CHECKS = [
    ("question = ''", "missing:question"), ("ground_truth = ''", "missing:ground_truth"), ("source_text = ''", "missing:source_text"),
    ("question_type = ''", "missing:question_type"), ("difficulty = ''", "missing:difficulty"),
    ("question_type NOT IN ('', 'factual', 'reasoning', 'negative', 'comparison')", "invalid:question_type"),
    *[(f"regexp_matches({c}, {LATEX})", f"latex:{c}") for c in ("source_text", "ground_truth", "question")],
    *[(f"regexp_matches({c}, {ARTIFACT})", f"artifact:{c}") for c in ("source_text", "ground_truth", "question")],
    (f"question_type <> 'negative' AND length({GT}) < 2", "short:ground_truth"),
    (f"question_type = 'negative' AND {GT} = ''", "empty:ground_truth"),
    (f"length({QU}) < 8", "short:question"), ("length(question) > 200", "long:question"),
    (f"question_type = 'negative' AND NOT regexp_matches({GT}, '^(否|不|不可以|不允许|不适用|不符合|不能|不满足|非|没有|无|是)')", "form:negative"),
    (f"length({GT}) > 6 AND length({SRC}) > 20 AND question_type <> 'reasoning' AND len(list_filter(range(0, greatest(length({GT}) - 3, 1), 4), lambda i: contains({SRC}, {GT}[(i + 1):(i + 4)]))) = 0", "overlap:none"),
]
ISSUES = "iss AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in CHECKS) + "], lambda x: x IS NOT NULL) AS issues FROM qa)"


@query("qa_checks", finish(QA, ISSUES, select="SELECT qa_id, array_to_string(issues, ',') AS issues, topic_tag FROM iss"))
def qa_checks(spark, sf):
    return curate.qa_checks(_qa(spark, sf)).select("qa_id", F.array_join("issues", ",").alias("issues"), "topic_tag")


@query("duplicate_groups", finish(f"r AS (SELECT doc_id AS qa_id, {strip_sql('text')}[1:30] AS prefix FROM documents)", select="SELECT qa_id, prefix, n_members FROM (SELECT *, count(*) OVER (PARTITION BY prefix) AS n_members FROM r) WHERE n_members > 1"))
def duplicate_groups(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("qa_id"), F.col("text").alias("question"))
    return curate.duplicate_groups(rows, "qa_id").select("qa_id", "prefix", "n_members")


@query(
    "quality_report",
    finish(QA, ISSUES,
           "fa AS (SELECT 'all' AS dimension, 'total' AS value FROM iss UNION ALL SELECT 'all', 'flagged' FROM iss WHERE len(issues) > 0 UNION ALL SELECT 'issue', string_split(unnest(issues), ':')[1] FROM iss "
           "UNION ALL SELECT 'question_type', question_type FROM iss UNION ALL SELECT 'difficulty', difficulty FROM iss UNION ALL SELECT 'topic_tag', topic_tag FROM iss)",
           select="SELECT dimension, value, count(*) AS n FROM fa GROUP BY ALL"),
)
def quality_report(spark, sf):
    return curate.quality_report(curate.qa_checks(_qa(spark, sf)))


@query("stratified_sample", "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) <= 15")
def stratified_sample(spark, sf):
    return curate.stratified_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 15, "lang")


ALLOT = """al AS (SELECT doc_id, length(text) AS n_chars, CASE WHEN length(text) < 1500 THEN 5 WHEN length(text) < 3000 THEN 8 WHEN length(text) < 5000 THEN 12 ELSE 15 END AS q FROM documents WHERE length(text) >= 300),
sm AS (SELECT doc_id, n_chars, least(q, greatest(2000 - coalesce(sum(q) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0))::BIGINT AS n_questions FROM al)"""
HALF = "CASE WHEN abs(({0}) - floor({0}) - 0.5) < 1e-9 THEN 2 * round(({0}) / 2) ELSE round({0}) END"


@query(
    "allocate_questions",
    finish(ALLOT, "sp AS (SELECT *, greatest(" + HALF.format("n_questions * 0.3::DOUBLE") + ", 1)::BIGINT AS factual, greatest(" + HALF.format("n_questions * 0.2::DOUBLE") + ", 1)::BIGINT AS negative FROM sm)",
           select="SELECT doc_id, n_chars, n_questions, factual, factual AS reasoning, negative, n_questions - 2 * factual - negative AS comparison FROM sp"),
)
def allocate_questions(spark, sf):
    docs = table(spark, sf, "documents")
    out = curate.allocate_questions(docs, "doc_id", block_of("doc_id"), 2000, F.length("text"))
    split = curate.type_split(F.col("n_questions"))
    return out.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.col("n_questions").cast("bigint").alias("n_questions"), *[c.cast("bigint").alias(n) for n, c in split.items()])


@query(
    "parse_qa_replies",
    "SELECT doc_id, i AS item_idx, CASE WHEN i = 0 THEN '“' || string_split(text, chr(10))[1] || '”' ELSE source END AS question, lang AS ground_truth, CASE WHEN i = 0 THEN text ELSE 'x' END AS source_text "
    "FROM documents, (SELECT unnest([0, 1])::BIGINT AS i) WHERE doc_id % 5 <> 4 AND (i = 0 OR doc_id % 2 = 0)",
)
def parse_qa_replies(spark, sf):
    """Replies are written around each document: fenced, wrapped, in prose, with broken parts."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    first = F.concat(F.lit("“"), F.get(F.split("text", "\n"), F.lit(0)), F.lit("”"))
    good = F.struct(first.alias("question"), F.col("lang").alias("ground_truth"), F.col("text").alias("source_text"), F.lit("factual").alias("question_type"))
    lacking = F.struct(
        F.when(k % 2 == 0, F.col("source")).alias("question"), F.col("lang").alias("ground_truth"), F.lit("x").alias("source_text"), F.lit("factual").alias("question_type")
    )
    array = F.to_json(F.array(good, lacking))
    raw = (
        F.when(k % 5 == 0, array)
        .when(k % 5 == 1, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
        .when(k % 5 == 2, F.concat(F.lit('{"items": '), array, F.lit("}")))
        .when(k % 5 == 3, F.concat(F.lit("Here you are:\n"), array, F.lit("\nDone.")))
        .otherwise("no list at all")
    )
    out = curate.parse_qa_replies(d.select("doc_id", raw.alias("raw")), ["doc_id"])
    return out.select("doc_id", F.col("item_idx").cast("bigint").alias("item_idx"), "question", "ground_truth", "source_text")


@query("resume_todo", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def resume_todo(spark, sf):
    todo = table(spark, sf, "orders").select("o_orderkey")
    done = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "A").select(F.col("l_orderkey").alias("o_orderkey"))
    return curate.resume_todo(todo, done, ["o_orderkey"])


@query("run_tally", "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status, count(*) AS n FROM orders GROUP BY 1")
def run_tally(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped")
    return curate.run_tally(table(spark, sf, "orders").select(status.alias("status")))
