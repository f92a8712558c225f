"""Documents in shards of near equal bytes, by a k-d tree over their metadata.

Every document is a point: its size, its place by id, its source and its language. A node that stands for several
shards is split along the dimension in which its points spread widest, at the weighted quantile that gives
each side bytes in proportion to its shards (the weighted median when both have as many). The cut is found by
histograms of bytes that Spark adds up, all nodes of a level at once, each finer than the one before and only over the
bin that holds the cut. The tree is an expression with one comparison for each split; no row moves
while it grows. Equal values are told apart by a hash, so a value that many rows share can be split.

Slots number the rows of a shard without gaps, in blocks of bounded size that are counted first. Null texts are
empty; null values of a dimension are its least. Repeated rows are rows of their own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.common import materialise

#: Bytes that a document counts on top of its text.
OVERHEAD = 16
#: Bits of a key that one histogram resolves, and bits of a key in all.
BIN_BITS, KEY_BITS = 12, 60
VALUE_BITS = 30
#: A cut is fine enough when its bin holds this share of a node's bytes.
TOLERANCE = 0.0005
#: Rows that one task numbers at most.
BLOCK_ROWS = 500_000


@dataclass
class Node:
    """Shards ``first`` to ``first + shards - 1``; split at ``cut`` of dimension ``by``: lower keys go left."""

    first: int
    shards: int
    by: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(self.by) < self.cut, self.left.column()).otherwise(self.right.column())


def _points(docs: DataFrame, id_col: str, text_col: str, numbers: list[str], kinds: list[str]) -> tuple[DataFrame, list[str]]:
    """Written rows (doc, size, crc, one key for each dimension), and the names of the keys."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("doc"),
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("crc"),
        *[F.col(c).cast("double").alias(f"v_{i}") for i, c in enumerate(numbers)],
        *[F.pmod(F.xxhash64(c), F.lit(1 << VALUE_BITS)).alias(f"c_{i}") for i, c in enumerate(kinds)],
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "points")
    values = {"size": F.log2("size")} | {c: F.col(f"v_{i}") for i, c in enumerate(numbers)}
    ends = rows.agg(*[f(v).alias(f"{n}_{i}") for i, v in enumerate(values.values()) for n, f in (("low", F.min), ("high", F.max))]).first()
    tie = F.pmod(F.xxhash64("doc", "crc", "row"), F.lit(1 << (KEY_BITS - VALUE_BITS)))
    keys = {}
    for i, v in enumerate(values.values()):
        low, high = ends[f"low_{i}"] or 0.0, ends[f"high_{i}"] or 0.0
        scale = ((1 << VALUE_BITS) - 1) / (high - low) if high > low else 0.0
        keys[f"k_{len(keys)}"] = F.coalesce(F.floor((v - low) * scale).cast("long"), F.lit(0).cast("long"))
    for i in range(len(kinds)):
        keys[f"k_{len(keys)}"] = F.col(f"c_{i}")
    whole = {k: v * (1 << (KEY_BITS - VALUE_BITS)) + tie for k, v in keys.items()}
    return rows.select("doc", "size", "crc", "row", *[v.alias(k) for k, v in whole.items()]), list(whole)


def _widest(points: DataFrame, node: Column, keys: list[str]) -> dict[int, str]:
    """For each node the dimension whose middle nine tenths span most of all values."""
    spread = points.groupBy(node.alias("node")).agg(*[F.percentile_approx(k, [0.05, 0.95], 200).alias(k) for k in keys])
    return {r["node"]: max(keys, key=lambda k: r[k][1] - r[k][0]) for r in spread.collect()}


def _split(points: DataFrame, root: Node, level: list[Node], keys: list[str]) -> None:
    """Give every node of ``level`` its dimension and cut."""
    node = root.column()
    wide = _widest(points, node, keys)
    level = [n for n in level if n.first in wide]
    if not level:
        return
    for n in level:
        n.by = wide[n.first]
    name = F.create_map(*[x for n in level for x in (F.lit(n.first), F.lit(n.by))])[F.col("node")]
    key = F.coalesce(*[F.when(F.col("by") == k, F.col(k)) for k in keys])
    rows = points.withColumn("node", node).where(F.col("node").isin([n.first for n in level]))
    rows = rows.withColumn("by", name).select("node", key.alias("key"), "size")
    low = {n.first: 0 for n in level}  # least key of the bin that holds the cut
    below = {n.first: 0 for n in level}  # bytes of lower keys
    target: dict[int, float] = {}
    whole: dict[int, int] = {}
    left = KEY_BITS
    open_ = {n.first: n for n in level}
    while open_ and left > 0:
        left -= BIN_BITS
        if left == KEY_BITS - BIN_BITS:
            inside = rows
        else:
            base = F.create_map(*[x for f in open_ for x in (F.lit(f), F.lit(low[f]))])[F.col("node")]
            inside = rows.where(F.col("node").isin(list(open_)) & (F.shiftright("key", left + BIN_BITS) == F.shiftright(base, left + BIN_BITS)))
        bins = inside.groupBy("node", F.shiftright("key", left).alias("bin")).agg(F.sum("size").alias("bytes"))
        by_node: dict[int, list] = {}
        for r in bins.collect():  # at most 2 ** BIN_BITS for each node
            by_node.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for f, found in by_node.items():
            n = open_[f]
            if f not in whole:
                whole[f] = sum(b for _, b in found)
                target[f] = whole[f] * (n.shards // 2) / n.shards
            at = below[f]
            for bin_, size in sorted(found):
                if at + size >= target[f]:
                    break
                at += size
            low[f], below[f] = bin_ << left, at
            if size <= TOLERANCE * whole[f] or left == 0:
                # The bin goes to the side that it brings closer to its share.
                n.cut = low[f] if target[f] - at < at + size - target[f] else (bin_ + 1) << left
                del open_[f]
    for n in level:
        half = n.shards // 2
        n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)


def grow(points: DataFrame, shards: int, keys: list[str]) -> Node:
    """The tree with a leaf for each shard; a node without rows stays whole."""
    root = Node(0, shards)
    level = [root] if shards > 1 else []
    while level:
        _split(points, root, level, keys)
        level = [c for n in level if n.left for c in (n.left, n.right) if c.shards > 1]
    return root


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    numbers: tuple[str, ...] = ("doc_id",),
    kinds: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """(doc, size, crc, shard, slot) for every row: ``shards`` shards, or as many as ``target_bytes`` asks for.

    ``numbers`` and ``kinds`` are the metadata that are dimensions beside the size.
    """
    points, keys = _points(docs, id_col, text_col, list(numbers), list(kinds))
    if shards is None:
        total = points.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(total / target_bytes))
    root = grow(points, shards, keys)
    placed = points.select("doc", "size", "crc", "row", root.column().cast("int").alias("shard"))
    rows = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    most = max(1, min(BLOCK_ROWS, sum(rows.values()) // (4 * shards)))
    blocks = F.create_map(*[x for s, n in rows.items() for x in (F.lit(s), F.lit(-(-n // most)))]) if rows else F.create_map(F.lit(0), F.lit(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc", "crc", "row"), blocks[F.col("shard")].cast("long")))
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc", "row"))
    numbered = placed.withColumn("place", place).join(counts.select("shard", "block", before.alias("before")), ["shard", "block"])
    return numbered.select("doc", "size", "crc", "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"))
