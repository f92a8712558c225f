"""What the operators of this package share: tables, written intermediates, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.sources.workspace import drop_written, materialise, send_code

__all__ = ["components", "crc", "drop_written", "load", "materialise", "send_code", "utf8"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """Bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def crc(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).where("a > b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a")
    hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return hung.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links lead to, for every node with a link.

    ``edges`` has two long columns ``a`` and ``b``. Each round joins every node to the least of its
    neighbours (large and small stars in turn), which ends when the edges are stars. A hub is a
    key with many rows in a join with one row, which adaptive execution splits. Rounds are
    written to the shared folder.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    sign = F.sum(F.xxhash64("a", "b") % 1_000_003)
    before = edges.agg(F.count("*"), sign).first()
    while before[0]:
        last, edges = edges, materialise(_round(edges), "edges")
        drop_written(last)
        after = edges.agg(F.count("*"), sign).first()
        if tuple(after) == tuple(before):
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
