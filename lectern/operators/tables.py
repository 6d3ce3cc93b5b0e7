"""Table blocks: merging tables that were cut at page borders, finding empty ones."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import markdown as M
from lectern.functions.text import strip
from lectern.operators import runs
from lectern.operators.chunking import join_ordered
from lectern.operators.ordered import BLOCK_ROWS, block_of, neighbours

def _continues(cols: runs.Columns) -> tuple[np.ndarray, np.ndarray]:
    """For each block taken as the first of a merged table, the first block that is no part of it.

    What decides at block j is the state of the table so far: page of its first block, width, whether it has no data, its last number. Tables
    begun at neighbouring blocks soon have equal states, and from an equal state they end at the same block; each state is gone through once.
    """
    page, width_of, row_width = (cols[c].tolist() for c in ("_page", "_cols", "_cols_rows"))
    no_data, ruled, values, cont = (cols[c].astype(bool).tolist() for c in ("_no_data", "_has_rule", "_values", "_cont"))
    last_in, last_rows, first_no = (cols[c].astype(float) for c in ("_last_in", "_last_rows", "_first_no"))
    has_last = (~np.isnan(last_rows)).tolist()
    last_in, last_rows, first_no = (np.where(np.isnan(c), -np.inf, c).tolist() for c in (last_in, last_rows, np.where(np.isnan(first_no), np.inf, first_no)))
    n_rows = cols["_n_rows"].tolist()
    n = len(page)
    ends: dict[tuple, int] = {}
    nxt = np.empty(n, dtype=np.int64)
    for i in range(n - 1, -1, -1):
        width, empty, last, rule = width_of[i], no_data[i], last_in[i], ruled[i]
        j, passed = i + 1, []
        while j < n and abs(page[j] - page[i]) <= 1:
            state = (j, page[i], width, empty, last, rule)
            if state in ends:
                j = ends[state]
                break
            passed.append(state)
            apart = abs(width - width_of[j])
            near = apart <= 1 and (cont[j] or empty or first_no[j] == last + 1)
            if not (near or (apart <= 5 and values[j])):
                break
            # What the merged table looks like with the rows of block j below it.
            width = max(width, row_width[j])
            if rule:
                empty = empty and n_rows[j] == 0
                if has_last[j]:
                    last = last_rows[j]
            j += 1
        for state in passed:
            ends[state] = j
        nxt[i] = j
    return nxt, nxt < n


def merge_tables(blocks: DataFrame, keys: Sequence[str], order: str, page: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Join consecutive table blocks that are parts of one table.

    A block joins the table before it when their pages are at most one apart and it has no caption row of its
    own, or the table has no data rows yet, or its first number follows the table's last one, or its heading
    row consists of values. A caption on a joined block belongs to the table that follows.
    Output: (*keys, order of the first block, page, n_blocks, text).
    """
    keys = list(keys)
    text = F.col("text")
    rows = M.with_table_features(blocks.select(*keys, F.col(order).cast("bigint").alias(order), F.coalesce(F.col(page), F.lit(-1)).alias("_page"), text))
    features = {
        "_page": F.col("_page"),
        "_cols": F.col("n_cols"),
        "_cols_rows": F.col("row_cols"),
        "_no_data": F.col("n_data") == 0,
        "_has_rule": F.col("n_separators") > 0,
        "_last_in": F.col("last_no").cast("double"),
        "_last_rows": F.col("last_row_no").cast("double"),
        "_first_no": F.col("first_no").cast("double"),
        "_n_rows": F.col("n_rows"),
        "_values": F.col("leads_values"),
        "_cont": F.col("continues"),
    }
    rows = rows.withColumnRenamed("caption", "_caption")
    marked = runs.mark_runs(rows, keys, order, _continues, features, block_rows)
    head = F.col("pos") == F.col("run_start")
    part = F.when(head, F.col("text")).otherwise(F.array_join("table_rows", "\n"))
    merged = marked.groupBy(*keys, "run_start").agg(
        F.min(order).alias(order),
        F.min_by("_page", "pos").alias("page"),
        F.min_by("_caption", "pos").alias("_caption"),
        F.max_by("_caption", F.when(~head & F.col("_caption").isNotNull(), F.col("pos"))).alias("_handed_on"),
        F.count("*").alias("n_blocks"),
        join_ordered(["pos"], F.when(head, F.regexp_replace(part, r"\s+$", "")).otherwise(part), "\n").alias("_joined"),
        F.min_by("text", "pos").alias("_alone"),
    )
    body = F.when(F.col("n_blocks") == 1, F.col("_alone")).otherwise(F.col("_joined"))
    linked = neighbours(
        merged.withColumn("text", body), "_handed_on", "_from_before", "_unused", keys, ["run_start"], block_of("run_start", block_rows)
    )
    # The last table also takes a caption left over from its own parts.
    last = neighbours(linked.withColumn("_one", F.lit(1)), "_one", "_b", "_more", keys, ["run_start"], block_of("run_start", block_rows))
    given = F.when(F.col("_caption").isNull(), F.coalesce(F.col("_from_before"), F.when(F.col("_more").isNull(), F.col("_handed_on"))))
    titled = F.when(given.isNotNull(), F.concat(given, F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return last.select(*keys, order, "page", "n_blocks", titled.alias("text"))


def empty_tables(blocks: DataFrame, keys: Sequence[str], order: str, page: str, reach: int = 9) -> DataFrame:
    """Table blocks without any content, with the caption to describe them by.

    Their own caption, or that of the nearest of the ``reach`` blocks before that is a captioned table at most
    one page away (a document's very first block is only looked at from far enough behind it). The look-back
    joins on small order buckets, so it needs no ordered pass over the document.
    """
    keys = list(keys)
    caption = F.array_join("table_caption", " ")
    is_table = F.col("type") == "table"
    blank = (F.coalesce(strip(F.col("text")), F.lit("")) == "") & (F.coalesce(strip(F.col("table_body")), F.lit("")) == "")
    empty = blocks.where(is_table & blank).select(*keys, order, F.col(page).alias("page"), caption.alias("_own"))
    captioned = blocks.where(is_table & (F.size("table_caption") > 0)).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col(order).alias("_at"),
        F.coalesce(F.col(page), F.lit(-1)).alias("_p"),
        caption.alias("_c"),
        F.floor(F.col(order) / 16).alias("_bucket"),
    )
    first = F.greatest(F.col(order) - (reach + 1), F.lit(0)) + 1
    buckets = empty.withColumn("_first", first).withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("_first") / 16), F.floor(F.col(order) / 16)))
    )
    cond = buckets["_bucket"] == captioned["_bucket"]
    for k in keys:
        cond = cond & buckets[k].eqNullSafe(captioned[f"_k_{k}"])
    cond = cond & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col(order))
    cond = cond & (F.abs(F.col("_p") - F.coalesce(F.col("page"), F.lit(0))) <= 1)
    near = buckets.join(captioned, cond, "left").groupBy(*keys, order, "page", "_own").agg(F.max_by("_c", "_at").alias("_near"))
    return near.select(*keys, order, "page", F.when(F.col("_own") != "", F.col("_own")).otherwise(F.coalesce("_near", F.lit(""))).alias("context"))
