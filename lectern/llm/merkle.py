"""Merkle manifest of a table: leaves, roots and inclusion proofs from lag and lead windows.

A row's leaf is the digest of its fields. Leaves of a group (a language) ascend by id; every ``arity`` consecutive nodes become their
digest until one is left, the group's subroot; the subroots, ordered by group, likewise give the root. Digests are lowercase hex sha256
of inputs concatenated as hex text.

Nodes stay in the rows of their leftmost leaf: on level l they stand ``arity ** l`` rows apart, so lags and leads by multiples of that
fixed offset, masked by a node's slot in its run, are its siblings; a run that ends early has null leads. Rows that hold a first child
hash their parent. Windows run inside blocks of at most ``BLOCK`` rows, a power of the arity: sibling runs never cross a block, all
levels of a block need one shuffle, and a group of any size is spread over its blocks. The blocks' top nodes are the leaves of the next
tier, so billions of rows need three or four tiers; then groups are put together in the same way. Each tier is written to the shared folder.

Places of leaves come from a range partition by (group, id, leaf): the place in a part plus the counts of the parts before.

Defined results: null fields are `-`, empty texts `0:`; rows of null group are a group of their own, before all others; null ids come first,
equal ids are ordered by leaf, and rows that agree in all fields have equal leaves in neighbouring places, so it does not matter which is
which; an empty table gives an empty table. Other columns of the input are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.sizing import broadcast_if_small
from lectern.session import staged

BLOCK = 1024  # most rows of a window
PART_ROWS = 100_000  # rows of a range partition
ALL = "all"  # the group of the subroots


def hex_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field as it enters a leaf: byte count, colon, value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return hex_digest(F.concat(*[field(f) for f in fields]))


def group_key(group: Column) -> Column:
    """A text that is never null and sorts like the group by bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def place_leaves(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``_pos``, the dense place of a row in its group ``_g`` along ``by``, and ``_n``, the group's rows."""
    parts = max(1, -(-rows.count() // PART_ROWS))
    # The row's number in the read order splits rows that agree in everything else.
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(parts, "_g", *by, "_tie").sortWithinPartitions("_g", *by, "_tie").drop("_tie")
    ranged = staged(ranged.withColumn("_at", F.monotonically_increasing_id()), "merkle-places")
    # Parts ascend with the numbers that rows get in them.
    part = F.shiftright("_at", 33)
    counts = ranged.groupBy("_g", part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_g", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy("_g")).alias("_n")
    )
    # One row per part and group; a key owns at most one part of the rows.
    placed = ranged.withColumn("_part", part).join(broadcast_if_small(starts), ["_g", "_part"])
    return placed.withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _depth(arity: int) -> int:
    depth = 1
    while arity ** (depth + 1) <= BLOCK:
        depth += 1
    return depth


def climb(nodes: DataFrame, arity: int) -> DataFrame:
    """All levels of a tier: nodes (_g, _pos, _n, _h, ...) with ``_steps`` and, in the first row of a block, ``_top``.

    ``_steps`` are the digests before and behind the node's ancestor, level by level; levels that the group does not have are left out.
    """
    depth = _depth(arity)
    rows = nodes.withColumn("_block", F.floor(F.col("_pos") / arity**depth))
    window = Window.partitionBy("_g", "_block").orderBy("_pos")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_h0", F.col("_h"))
    for level in range(depth):
        stride, h = arity**level, f"_h{level}"
        own = F.col("_pos") % stride == 0
        slot = F.floor(F.col("_pos") / stride) % arity
        shifts = {f"_lag{j}": F.lag(h, j * stride).over(window) for j in range(1, arity)}
        shifts |= {f"_lead{j}": F.lead(h, j * stride).over(window) for j in range(1, arity)}
        rows = rows.withColumns(shifts)
        none = F.lit("")
        before = [F.coalesce(F.when(slot >= j, F.col(f"_lag{j}")), none) for j in range(arity - 1, 0, -1)]
        behind = [F.coalesce(F.when(slot + j < arity, F.col(f"_lead{j}")), none) for j in range(1, arity)]
        there = F.col("_n") > stride  # the group has several nodes on this level
        rows = rows.withColumns({f"_b{level}": F.when(own & there, F.concat(*before)), f"_a{level}": F.when(own & there, F.concat(*behind))})
        parent = F.when(own & (slot == 0), F.when(there, hex_digest(F.concat(F.col(h), F.col(f"_a{level}")))).otherwise(F.col(h)))
        rows = rows.withColumn(f"_h{level + 1}", parent).drop(*shifts)
    # Each row below a node takes the node's siblings.
    sides = [F.last(f"_{s}{level}", ignorenulls=True).over(upto).alias(f"_{s}{level}") for level in range(depth) for s in "ba"]
    steps = [F.when(F.col("_n") > arity**level, F.struct(F.col(f"_b{level}").alias("before"), F.col(f"_a{level}").alias("behind"))) for level in range(depth)]
    rows = rows.select(*nodes.columns, "_block", F.col(f"_h{depth}").alias("_top"), *sides)
    return rows.select(*nodes.columns, "_block", "_top", F.array_compact(F.array(*steps)).alias("_steps"))


def tiers(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with ``_steps`` up to the group's top node, top nodes (_g, _h)) of placed nodes (_g, _pos, _n, _h, ...)."""
    size = arity ** _depth(arity)
    levels = [staged(climb(leaves, arity), "merkle-tier")]
    top = None
    while top is None:
        upper = levels[-1].where(F.col("_top").isNotNull()).select(
            "_g", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / size).alias("_n"), F.col("_top").alias("_h")
        )
        if upper.where("_n > 1").limit(1).count():
            levels.append(staged(climb(upper, arity), "merkle-tier"))
        else:
            top = upper.select("_g", "_h")
    # Down again: a node's steps go on with those of its block.
    full = levels[-1]
    for lower in reversed(levels[:-1]):
        above = full.select("_g", F.col("_pos").alias("_block"), F.col("_steps").alias("_more"))
        full = lower.join(above, ["_g", "_block"]).withColumn("_steps", F.concat("_steps", "_more")).drop("_more")
    return full.drop("_block", "_top"), top


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, digest, lambda h, s: hex_digest(F.concat(s["before"], h, s["behind"])))


def proof_text(steps: Column) -> Column:
    """Siblings of all levels, left to right, as one text."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["behind"])), "")


def manifest(rows: DataFrame, fields: Sequence[str], group: str, id_col: str, carry: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """(id, *carry, leaf, subroot, root, steps) of every row; ``steps`` is the proof, an array of (before, behind).

    ``fields`` enter the leaf in that order; ``carry`` are further values of a row that the result shall hold.
    """
    extra = {f"_c{i}": c for i, c in enumerate((carry or {}).values())}
    slim = rows.select(
        group_key(F.col(group)).alias("_g"), F.col(id_col).alias("_id"), leaf([F.col(f) for f in fields]).alias("_h"), *[c.alias(n) for n, c in extra.items()]
    )
    nodes, subroots = tiers(place_leaves(staged(slim, "merkle-leaves"), ["_id", "_h"]), arity)
    subroots = staged(subroots, "merkle-subroots")
    # The subroots are a tree of their own, in the order of their groups.
    named = subroots.select(F.lit(ALL).alias("_g"), F.col("_g").alias("_of"), "_h")
    upper, root = tiers(place_leaves(named, ["_of"]), arity)
    named_root = upper.join(root.withColumnRenamed("_h", "_root"), "_g")
    per_group = staged(
        named_root.select(F.col("_of").alias("_g"), F.col("_h").alias("_subroot"), F.col("_steps").alias("_more"), "_root"), "merkle-groups"
    )
    joined = nodes.join(broadcast_if_small(per_group, 10_000), "_g")
    return joined.select(
        F.col("_id").alias(id_col),
        *[F.col(c).alias(n) for c, n in zip(extra, carry or {})],
        F.col("_h").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        F.concat("_steps", "_more").alias("steps"),
    )


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a document whose ``n_chars`` was raised by one; of others their own leaf."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    number = F.col("n_chars").cast("decimal(38,0)")
    values = [F.col(c) for c in FIELDS]
    changed = [F.when(hit, number + 1).otherwise(number) if c == "n_chars" else v for c, v in zip(FIELDS, values)]
    return leaf(changed)


#: Columns of documents in the order in which they enter a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of documents, and what the tampered rows' proofs then give.

    ``proof_sha256`` is the digest of the proof's siblings; ``folded_root`` is recomputed from the leaf after tampering and the original
    siblings; ``verified`` says whether it is the root.
    """
    made = manifest(docs, FIELDS, "lang", "doc_id", {"_changed": tampered_leaf(docs)})
    folded = made.withColumn("folded_root", fold(F.col("_changed"), F.col("steps")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", hex_digest(proof_text(F.col("steps"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
