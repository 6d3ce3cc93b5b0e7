"""Building and checking question-answer sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.sizing import join_skewed
from lectern.functions.text import clean_latex, strip
from lectern.operators.ordered import running_sums

# What a question-answer item must look like.
REQUIRED = ("question", "ground_truth", "source_text", "question_type", "difficulty", "page")
TYPES = ("factual", "reasoning", "negative", "comparison")
DIFFICULTIES = ("single_hop", "multi_hop")
LATEX = r"(\$|\\mathrm|\\times|\\sim|\\circ|\\leq|\\geq|\\frac|\\sqrt|\\[\p{L}\p{N}_]{2,})"
ARTIFACT = r"错误!未定义书签|\.{5,}|\.{3,}\s+\d+"
NEGATIVE = r"^(否|不|不可以|不允许|不适用|不符合|不能|不满足|非|没有|无|是)"
TEXT_FIELDS = ("source_text", "ground_truth", "question")

# Questions per text length (below the length, this many), and shares of the question types.
QUESTION_STEPS = ((1500, 5), (3000, 8), (5000, 12))
QUESTION_MAXIMUM = 15
SHARES_STANDARDS = (0.30, 0.30, 0.20)
SHARES_SEGMENTS = (0.35, 0.25, 0.20)
SHARES_PAGES = (0.5, 0.3)


def clean_items(items: DataFrame, fields: Sequence[str], key: str, dropped: DataFrame | None = None) -> DataFrame:
    """Clean LaTeX out of the fields, tell whether a row changed, leave out listed rows."""
    rows = items if dropped is None else items.join(dropped.select(key), key, "left_anti")
    cleaned = {f: clean_latex(F.col(f)) for f in fields}
    differs = F.lit(False)
    for f, c in cleaned.items():
        differs = differs | (c != F.col(f))
    others = [c for c in items.columns if c not in fields]
    return rows.select(*others, *[c.alias(f) for f, c in cleaned.items()], differs.alias("changed"))


def length_filter(chunks: DataFrame, min_length: int, allowed: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Chunks of a minimum trimmed length and, where given, of allowed column values."""
    keep = F.length(strip(F.col("text"))) >= min_length
    for column, values in (allowed or {}).items():
        keep = keep & F.col(column).isin(*values)
    return chunks.where(keep)


def question_count(text_length: Column) -> Column:
    out = F.lit(QUESTION_MAXIMUM)
    for below, n in reversed(QUESTION_STEPS):
        out = F.when(text_length < below, n).otherwise(out)
    return out


def allocate_questions(
    docs: DataFrame, order: str, block: Column, target: int, text_length: Column, done: int = 0, shortest: int = 300
) -> DataFrame:
    """Questions per document by text length, in document order until the target is used up.

    ``n_questions`` is 0 behind the point where nothing remains; too short documents get no row.
    """
    sized = docs.withColumn("n_chars", text_length).where(F.col("n_chars") >= shortest)
    sized = sized.withColumn("_n", question_count(F.col("n_chars")))
    summed = running_sums(sized, {"_upto": F.col("_n")}, [], [order], block)
    left = F.lit(target - done) - (F.col("_upto") - F.col("_n"))
    return summed.withColumn("n_questions", F.least("_n", F.greatest(left, F.lit(0)))).drop("_n", "_upto")


def type_split(n: Column, shares: Sequence[float] = SHARES_STANDARDS) -> dict[str, Column]:
    """Questions per type; rounding is half to even, every named type but the last gets at least one."""
    if len(shares) == 3:
        parts = [F.greatest(F.bround(n * s, 0).cast("int"), F.lit(1)) for s in shares]
        return dict(zip(TYPES, [*parts, n - parts[0] - parts[1] - parts[2]]))
    factual = F.greatest(F.bround(n * shares[0], 0).cast("int"), F.lit(1))
    reasoning = F.greatest(F.bround(n * shares[1], 0).cast("int"), F.lit(0))
    return {"factual": factual, "reasoning": reasoning, "negative": F.greatest(n - factual - reasoning, F.lit(0))}


REPLY = "array<struct<question: string, ground_truth: string, source_text: string, question_type: string, difficulty: string>>"


def _parsed(raw: Column) -> Column:
    """JSON list in a reply: bare, fenced, wrapped as {items: [...]}, or in the middle of prose."""
    body = strip(F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    escaped = F.regexp_replace(body, r'(?<!\\)\\(?!["\\/bfnrtu])', r"\\\\\\\\")
    repaired = F.regexp_replace(escaped, "[“”]", r'\\\\"')
    plain = F.regexp_replace(F.regexp_replace(body, "[“”]", '"'), r'\\(?!["\\/bfnrtu0-9])', "")

    def listed(text: Column) -> Column:
        cut = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
        return F.from_json(F.when(cut != "", cut), REPLY)

    def usable(parsed: Column) -> Column:
        return F.when(F.exists(parsed, lambda q: q["question"].isNotNull()), parsed)

    return F.coalesce(usable(listed(body)), usable(listed(repaired)), usable(listed(plain)))


def parse_qa_replies(replies: DataFrame, keep: Sequence[str], raw: str = "raw") -> DataFrame:
    """Question-answer items out of model replies; items without the four needed fields drop out."""
    items = replies.select(*keep, F.posexplode_outer(_parsed(F.col(raw))).alias("item_idx", "i")).select(*keep, "item_idx", "i.*")
    for field in ("question", "ground_truth", "source_text", "question_type"):
        items = items.where(F.col(field).isNotNull())
    return items


def qa_issues() -> Column:
    """Names of the checks an item fails, as an array."""

    def text(f: str) -> Column:
        return F.coalesce(F.col(f).cast("string"), F.lit(""))

    gt, src, q, kind = (strip(text(f)) for f in ("ground_truth", "source_text", "question", "question_type"))
    negative = kind == "negative"
    checks = [F.when(F.length(text(f)) == 0, F.lit(f"missing:{f}")) for f in REQUIRED]
    checks.append(F.when((text("question_type") != "") & ~text("question_type").isin(*TYPES), "invalid:question_type"))
    checks.append(F.when((text("difficulty") != "") & ~text("difficulty").isin(*DIFFICULTIES), "invalid:difficulty"))
    checks += [F.when(text(f).rlike(LATEX), F.lit(f"latex:{f}")) for f in TEXT_FIELDS]
    checks += [F.when(text(f).rlike(ARTIFACT), F.lit(f"artifact:{f}")) for f in TEXT_FIELDS]
    checks.append(F.when(~negative & (F.length(gt) < 2), "short:ground_truth").when(negative & (gt == ""), "empty:ground_truth"))
    checks.append(F.when(F.length(q) < 8, "short:question"))
    checks.append(F.when(F.length(text("question")) > 200, "long:question"))
    checks.append(F.when(negative & ~gt.rlike(NEGATIVE), "form:negative"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(gt) - 3, F.lit(1)), F.lit(4))
    overlap = F.exists(starts, lambda i: F.contains(src, F.substr(gt, i, F.lit(4))))
    checks.append(F.when((F.length(gt) > 6) & (F.length(src) > 20) & (kind != "reasoning") & ~overlap, "overlap:none"))
    return F.array_compact(F.array(*checks))


def qa_checks(qa: DataFrame) -> DataFrame:
    return qa.withColumn("issues", qa_issues())


def duplicate_groups(qa: DataFrame, key: str, column: str = "question", prefix: int = 30) -> DataFrame:
    """Members of groups with equal leading characters, one row each: (prefix, n_members, key).

    Counted in each task first; members are looked up by a join that spreads heavy groups, so a group of any
    size is listed without being collected.
    """
    rows = qa.select(key, F.substring(strip(F.col(column)), 1, prefix).alias("prefix"))
    counts = rows.groupBy("prefix").agg(F.count("*").alias("n_members")).where(F.col("n_members") > 1)
    return join_skewed(rows, counts, "prefix", "n_members", F.col(key))


def quality_report(checked: DataFrame, dimensions: Sequence[str] = ("question_type", "difficulty", "topic_tag")) -> DataFrame:
    """(dimension, value, n): items, flagged items, flags by category and the distributions, in one pass."""
    kinds = F.transform(F.col("issues"), lambda i: F.struct(F.lit("issue").alias("dimension"), F.split(i, ":")[0].alias("value")))
    always = F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("total").alias("value")),
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dimensions],
    )
    flagged = F.when(F.size("issues") > 0, F.array(F.struct(F.lit("all").alias("dimension"), F.lit("flagged").alias("value")))).otherwise(
        F.array().cast("array<struct<dimension:string,value:string>>")
    )
    facts = checked.select(F.explode(F.concat(always, flagged, kinds)).alias("f"))
    return facts.groupBy("f.dimension", "f.value").agg(F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, key: str, n: int, stratum: str | None = None, seed: str = "42") -> DataFrame:
    """Exactly n rows (or all, where there are fewer) per stratum, the same ones for a seed."""
    draw = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
    if stratum is None:
        return rows.orderBy(draw, key).limit(n)
    w = Window.partitionBy(stratum).orderBy("_draw", key)
    return rows.withColumn("_draw", draw).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_draw", "_n")


def resume_todo(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is not finished yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def run_tally(items: DataFrame, status: str = "status") -> DataFrame:
    return items.groupBy(status).agg(F.count("*").alias("n"))
