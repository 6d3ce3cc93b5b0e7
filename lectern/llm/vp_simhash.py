"""Near copies by SimHash fingerprints and vantage-point trees.

A text's fingerprint has a bit for each bit that is set in over half of its shingles' hashes. Two fingerprints link when at most
``distance`` bits differ; a component is what links reach.

Search. At a radius of 4 a vantage-point tree over whole 64-bit fingerprints prunes next to nothing: most lie 32 +- 4 bits from any vantage
point, so a query enters both branches in three of four nodes. The fingerprints are therefore cut into ``QUARTERS`` parts of 16 bits, in one
of which a linked pair differs by a quarter of the distance (rounded down) at most, and each part has a tree of its own over the values that
occur in it, with that radius. A tree parts its values by their Hamming distance from a vantage value at the median, down to leaves of a few
values; a query value goes down the branches that the triangle inequality cannot rule out. The values that it meets are the shards whose
boundary it overlaps: a fingerprint is sent to its own shard and, as a query, to the overlapped shards of higher values. There all pairs are
verified on the whole 64 bits, so the result is exact.

Sizes. A tree has at most 65 536 values whatever the input is, so that building the trees and querying them by each of their own values is
bounded; it is done by one task per part. Equal fingerprints are one row before the search. A shard with many rows is cut into tiles of
``TILE`` rows for its members and for its queries, and each pair of tiles is a task's work of its own. Of the links found in a tile only a
spanning forest goes on, at most one link a row: components are the same, and a large group of near copies does not give all its pairs.

Defined results: null text is empty; a text without words has fingerprint zero, which links like any other; fewer words than a shingle are
one shingle; a null id is a row without influence on ``component_id`` (null where all ids of a component are null); copies and equal ids are
separate rows of the result; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.sizing import join_skewed
from lectern.llm.groups import connected
from lectern.llm.shared import WORD, text_bytes
from lectern.session import staged

SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
QUARTERS = 4
WIDTH = BITS // QUARTERS
LEAF = 32  # values of a leaf, which are compared one by one
TILE = 4096  # rows of a tile of a large shard
GROUP_ROWS = 100_000  # rows of a task's group of shards
PAIRS = 1 << 20  # pairs that are compared at once

_WORDS = re.compile(WORD.encode())
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ----------------------------------------------------------------------------------------------- fingerprints


def shingle_hashes(data: bytes) -> np.ndarray:
    """XXH64 of each run of ``SHINGLE`` words of a text, repeats included."""
    words = _WORDS.findall(data.translate(_LOWER))
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = max(1, len(words) - SHINGLE + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype=np.uint64, count=n)


def simhash(data: bytes, rows: int = 1 << 14) -> int:
    """The fingerprint of a text's bytes as a signed number; hashes are counted in slices."""
    hashes = shingle_hashes(data)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), rows):
        part = np.unpackbits(hashes[at : at + rows].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(text_bytes(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["_id", "fp"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, fp long")


# ------------------------------------------------------------------------------------------------------ trees


def build_tree(values: np.ndarray, leaf: int = LEAF) -> list[tuple]:
    """Nodes of a vantage-point tree over values, children behind their parents.

    An inner node is (vantage, border, near child, far child): values up to ``border`` bits away are near. A leaf is (values,).
    """
    nodes: list = [None]
    todo = [(0, values)]
    while todo:
        place, mine = todo.pop()
        if len(mine) > leaf:
            away = np.bitwise_count(mine ^ mine[len(mine) // 2])
            border = int(np.partition(away, len(away) // 2)[len(away) // 2])
            if border == away.max():  # the median is the largest distance: part below it
                border -= 1
            near = away <= border
            nodes[place] = (mine[len(mine) // 2], border, len(nodes), len(nodes) + 1)
            todo += [(len(nodes), mine[near]), (len(nodes) + 1, mine[~near])]
            nodes += [None, None]
        else:
            nodes[place] = (mine,)
    return nodes


def search_tree(nodes: list[tuple], queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (query, value) at most ``radius`` bits apart; all queries go down the tree together."""
    found_q, found_v = [], []
    todo = [(0, queries)]
    while todo:
        place, mine = todo.pop()
        node = nodes[place]
        if len(node) == 1:
            for at in range(0, len(mine), 4096):
                part = mine[at : at + 4096]
                q, v = np.nonzero(np.bitwise_count(part[:, None] ^ node[0][None, :]) <= radius)
                found_q.append(part[q])
                found_v.append(node[0][v])
            continue
        vantage, border, near, far = node
        away = np.bitwise_count(mine ^ vantage).astype(np.int64)
        for child, reached in ((near, away - radius <= border), (far, away + radius > border)):
            if reached.any():
                todo.append((child, mine[reached]))
    return np.concatenate(found_q or [queries[:0]]), np.concatenate(found_v or [queries[:0]])


def routes(sizes: DataFrame, distance: int) -> DataFrame:
    """(slot, n, targets): per part and value the shards that its fingerprints are sent to, with the number of their tiles.

    ``sizes`` (part, value, n) counts fingerprints. A slot is the number of a value in its part.
    """
    radius = distance // QUARTERS

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        order = np.argsort(table.column("value").to_numpy())
        values = table.column("value").to_numpy()[order].astype(np.uint16)
        counts = table.column("n").to_numpy()[order]
        shuffled = values[np.random.default_rng(part).permutation(len(values))]
        source, shard = search_tree(build_tree(shuffled), values, radius)
        up = shard >= source  # a pair of shards meets in the one of the higher value
        source, shard = np.searchsorted(values, source[up]), np.searchsorted(values, shard[up])
        members = -(-counts // TILE)
        reached = np.zeros(len(values), dtype=np.int64)
        np.add.at(reached, shard, counts[source])
        queries = -(-reached // TILE)
        place = np.lexsort((shard, source))
        source, shard = source[place], shard[place]
        offsets = np.searchsorted(source, np.arange(len(values) + 1)).astype(np.int32)
        base = part << WIDTH
        single = members[shard] * queries[shard] <= 1
        parts = [base + values[shard].astype(np.int64), np.where(single, 1, members[shard]), np.where(single, 1, queries[shard])]
        targets = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["shard", "n_a", "n_b"])
        return pa.table({"slot": pa.array(base + values.astype(np.int64)), "n": pa.array(counts), "targets": pa.ListArray.from_arrays(offsets, targets)})

    return sizes.groupBy("part").applyInArrow(run, "slot long, n long, targets array<struct<shard: long, n_a: long, n_b: long>>")


# ------------------------------------------------------------------------------------------------------ links


class Forest:
    """Connected rows of a batch; roots are found by passing on the lowest number along links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def tile_links(prints: np.ndarray, rows: np.ndarray, members: np.ndarray, distance: int, forest: Forest) -> None:
    """Link each of ``rows`` to the ``members`` within the distance (both are indexes into ``prints``)."""
    step = max(1, PAIRS // max(1, len(members)))
    own = prints[members]
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        q, m = np.nonzero(np.bitwise_count(prints[part][:, None] ^ own[None, :]) <= distance)
        forest.add(part[q], members[m])


def shard_links(table: pa.Table, distance: int) -> pa.Table:
    """A spanning forest of the links inside each shard tile of a group: (a, b) of fingerprints.

    Columns: tile, fp, role (0: query, 1: member, 2: both).
    """
    tile = table.column("tile").to_numpy()
    order = np.lexsort((-table.column("role").to_numpy(), tile))
    tile, role = tile[order], table.column("role").to_numpy()[order]
    signed = table.column("fp").to_numpy()[order]
    prints = signed.view(np.uint64)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1]) if len(tile) else np.empty(0, dtype=np.int64)
    size = np.diff(np.append(begin, len(tile)))
    n_members = np.add.reduceat((role > 0).astype(np.int64), begin) if len(tile) else size
    forest = Forest(len(tile))
    work = size * n_members
    small = work <= 4096
    # Members stand first in a tile. Small tiles: row i of a tile meets its members, all tiles at once.
    sized = np.repeat(np.where(small, n_members, 0), size)
    first = np.repeat(begin, size)
    upto = np.cumsum(sized)
    at = 0
    while at < len(tile):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        counts = sized[at:end]
        q = np.repeat(np.arange(at, end), counts)
        inside = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
        m = first[q] + inside
        near = (np.bitwise_count(prints[q] ^ prints[m]) <= distance) & (q != m)
        forest.add(q[near], m[near])
        at = end
    for k in np.flatnonzero(~small):
        here = np.arange(begin[k], begin[k] + size[k])
        tile_links(prints, here[role[here] != 1], here[role[here] > 0], distance, forest)
    linked = np.flatnonzero((forest.root != np.arange(len(tile))) & (signed != signed[forest.root]))
    return pa.table({"a": pa.array(signed[linked]), "b": pa.array(signed[forest.root[linked]])})


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links that connect what all pairs within ``distance`` connect; ``distinct`` (fp) holds each fingerprint once."""
    mask = (1 << WIDTH) - 1
    values = F.array(*[F.struct(F.lit(p).alias("part"), F.shiftrightunsigned("fp", p * WIDTH).bitwiseAND(F.lit(mask)).alias("value")) for p in range(QUARTERS)])
    cut = distinct.select("fp", F.explode(values).alias("v")).select("fp", "v.part", "v.value")
    sent = staged(routes(cut.groupBy("part", "value").agg(F.count("*").alias("n")), distance), "vp-routes")
    slots = cut.select("fp", (F.col("part") * (mask + 1) + F.col("value")).alias("slot"))
    routed = join_skewed(slots, sent, "slot", "n", F.col("fp")).select("fp", "slot", F.explode("targets").alias("t"))
    n_a, n_b, spot = F.col("t.n_a"), F.col("t.n_b"), F.xxhash64(F.lit(11), "fp")
    member = F.col("t.shard") == F.col("slot")

    def copy(a, b, role):
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(role).alias("role"))

    mine_a, mine_b = F.pmod(spot, n_a), F.pmod(spot, n_b)
    as_query = F.transform(F.sequence(F.lit(0).cast("long"), n_a - 1), lambda a: copy(a, mine_b, 0))
    as_member = F.transform(F.sequence(F.lit(0).cast("long"), n_b - 1), lambda b: copy(mine_a, b, 1))
    zero = F.lit(0)
    copies = (
        F.when((n_a == 1) & (n_b == 1), F.when(member, F.array(copy(zero, zero, 2))).otherwise(F.array(copy(zero, zero, 0))))
        .when(member, F.concat(as_query, as_member))
        .otherwise(as_query)
    )
    tiled = routed.select("fp", F.col("t.shard").alias("shard"), F.explode(copies).alias("c"))
    tiled = tiled.select("fp", F.xxhash64("shard", "c.a", "c.b").alias("tile"), "c.role")
    n_groups = max(1, sent.select(F.sum(F.col("n") * F.size("targets"))).first()[0] or 0) // GROUP_ROWS + 1
    grouped = tiled.withColumn("_g", F.pmod("tile", F.lit(n_groups))).groupBy("_g")
    found = grouped.applyInArrow(lambda table: shard_links(table, distance), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id, component_rows) of every row."""
    prints = staged(fingerprints(docs, id_col, text_col), "vp-prints")
    distinct = staged(prints.groupBy("fp").agg(F.count("*").alias("_n"), F.min("_id").alias("_low")), "vp-distinct")
    roots = connected(links(distinct.select("fp"), distance))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("_root", F.coalesce("root", "fp"))
    lows = named.groupBy("_root").agg(F.min("_low").alias("component_id"), F.sum("_n").alias("component_rows"))
    dim = staged(named.select("fp", "_n", "_root").join(lows, "_root").drop("_root"), "vp-components")
    out = join_skewed(prints, dim, "fp", "_n", F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_rows")
