"""Connected groups of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import staged


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): nodes of one connected group have one root.

    Each round every node hooks onto the neighbour that is first in an order drawn anew for the round, two steps are joined into one, and
    links are mapped to the roots so found. The nodes that still have links shrink by a constant factor a round, whatever the shape of
    the groups; a hub's links are aggregated before the shuffle. Each round is written to the shared folder.
    """
    links = staged(links.where("a <> b AND a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct(), "groups-links")
    roots, number = None, 0
    while links.limit(1).count():
        both = links.union(links.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("r"), F.col(c).alias("n"))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hook = staged(hook.select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("root")), "groups-hooks")
        step = hook.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        hook = staged(hook.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "groups-jumps")
        to_a, to_b = hook.toDF("a", "ra"), hook.toDF("b", "rb")
        links = staged(links.join(to_a, "a").join(to_b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "groups-links")
        if roots is None:
            roots = hook
        else:
            step = hook.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            roots = staged(roots.join(step, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "groups-roots")
        number += 1
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
