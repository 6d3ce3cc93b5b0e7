"""Document fingerprints by spot signatures, with DataFrame functions only.

A signature is a common word (anchor) with the chain of the next ``CHAIN`` content words behind it; other anchors in between are passed
over, at most ``SKIPPED`` before each content word. The fingerprint of a text is the set of its signatures' 32-bit hashes, written in
order. Fingerprints are compared by the Jaccard similarity of the sets. ``similar_pairs`` finds all pairs of a table above a
threshold: sets are partitioned by length, so that only neighbouring partitions meet, and within them only sets that share one of
their rarest signatures; the rest is pruned by the lengths before sets are intersected.

Defined results: words are runs of letters and digits, in lower case; null text is empty; a text without signatures has the empty fingerprint;
two empty sets have likeness 1, an empty and another one 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.sizing import broadcast_if_small

CHAIN = 2
SKIPPED = 8
BLOCK_ROWS = 1000
#: Anchors: frequent words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in is it that for on with as be are by this not but have from or an at was they you we his her "
    "le la les un une des et en est que qui dans pour sur au aux du avec ne pas ce se "
    "der die das und den von zu mit ist im ein eine dem nicht auf sich als auch "
    "el los las y que en un una por con para del al se su es lo como de a"
).split()


def signatures(text: Column) -> Column:
    """Sorted array of the hashes of a text's distinct spot signatures."""
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    anchors = "|".join(sorted(set(ANCHORS)))
    marked = F.regexp_replace(words, f" ({anchors})(?= )", " #$1")
    content = rf"(?: #[^ ]+){{0,{SKIPPED}}} [^ #][^ ]*"
    chains = F.regexp_extract_all(marked, F.lit(f"#(?=([^ ]+(?:{content}){{{CHAIN}}}))"), F.lit(1))
    plain = F.transform(chains, lambda c: F.hash(F.when(F.contains(c, F.lit("#")), F.regexp_replace(c, " #[^ ]+", "")).otherwise(c)))
    return F.array_sort(F.array_distinct(plain))


def fingerprint(signatures: Column) -> Column:
    return F.array_join(signatures.cast("array<string>"), " ")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard similarity of two sets; pairs whose lengths alone keep it below ``floor`` are not intersected and get 0."""
    most = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0) | (most < floor), F.lit(0.0))
        .otherwise(both / (F.size(a) + F.size(b) - both))
    )


def similar_pairs(prints: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", set_col: str = "signatures") -> DataFrame:
    """(a, b, likeness) of all pairs of different sets, by their lowest ids; equal sets are one, empty sets are in no pair."""
    sets = prints.where(F.size(set_col) > 0).groupBy(F.col(set_col).alias("s")).agg(F.min(id_col).alias("id")).withColumn("n", F.size("s"))
    seen = sets.select("id", F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("uses"))
    # the rarest signatures first: two sets above the threshold share one of the first n - ceil(t n) + 1 of them
    ordered = sets.select("id", "n", F.explode("s").alias("g")).join(seen, "g").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("uses", "g"))).alias("o"))
    prefix = F.slice(F.col("o.g"), F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    part = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    keys = ordered.select("id", "n", part.alias("part"), F.explode(prefix).alias("g"))
    # a set looks for longer ones in its own partition of lengths and in the next
    left = keys.select(F.col("id").alias("a"), F.col("n").alias("na"), "g", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = keys.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g", "part")
    pairs = left.join(right, ["g", "part"]).where(((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))) & (F.col("na") >= F.col("nb") * threshold - 1e-9))
    pairs = pairs.select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sa"), F.col("sb"), threshold).alias("likeness"))
    return pairs.where(F.col("likeness") >= threshold - 1e-9)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures) of every row.

    The edited text ends with the beginning of the next document's, by descending id (ties by descending text; null ids last; after
    the last row comes the first). Rows are sorted in blocks of about ``BLOCK_ROWS`` ids, cut evenly between the lowest and the highest
    id; the first row of the next block is added to each block, so there is no global sort and texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    span = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low, high = int(span["low"] or 0), int(span["high"] or 0)
    width = max(1, math.ceil((high - low + 1) / max(1, span["n"] // BLOCK_ROWS)))
    rows = rows.withColumn("block", F.coalesce(F.floor((F.col("doc_id") - low) / width), F.lit(-1)).cast("long"))
    # one row per block: its first id, and the block that it follows
    heads = rows.groupBy("block").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.desc("block"))
    last = F.min("block").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("block").alias("_b"), "head", F.coalesce(F.lag("block").over(order), last).alias("_to"))
    first = rows.join(broadcast_if_small(heads), (F.col("block") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("_to", "doc_id").agg(F.max("text").alias("text"))
    ghosts = first.select("doc_id", "text", F.col("_to").alias("block"), F.lit(True).alias("ghost"))
    rows = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts).withColumn("own", signatures(F.col("text")))
    w = Window.partitionBy("block").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("text"))
    rows = rows.withColumns({"next": F.lead("text").over(w), "next_own": F.lead("own").over(w)}).where("NOT ghost")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    rows = rows.withColumn("edited_own", signatures(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited_own")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"), F.size("own").alias("n_signatures"),
    )
