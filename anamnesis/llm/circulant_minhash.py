"""Near duplicates by circulant MinHash: signatures from two permutations, bands, exact checks.

1. Every text becomes the set of its distinct n-grams (64-bit hashes). Texts with equal sets are one node from
   here on, so copies are never paired.
2. The n-grams fall on the ``SLOTS`` slots of a ring, which a first permutation shuffles. Coordinate k of a
   signature is the least value that a second permutation, shifted by k around the ring, gives to the slots of
   the set. The shifts of one slot lie side by side in memory, so all coordinates come from one gather and one minimum.
3. ``rows`` coordinates in a row are a band; sets that agree in a whole band share a key. At the threshold a pair
   is in no band with a chance of (1 - share ** rows) ** bands, which ``bands_for`` brings below ``MISS``.
4. Of every key with several nodes, all meet the least one, and the pair is checked on the full sets. Keys whose
   nodes are connected by these links are done.
5. Nodes of the keys that are left are clusters (connected by such keys). Their sets are compared all with
   all inside of a task, exactly, except those already connected; a large cluster in pairs of blocks. Links only leave as a
   spanning forest, so a group of near copies gives as many rows as it has members.

Null, empty and blank texts have empty sets, no links, and are their own component. Repeated rows are copies of each
other. Rows without an id link like others; a component is named by its least id, null if no row has one.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import BASE, U, mix
from anamnesis.llm.common import components, drop_written, materialise
from anamnesis.llm.shingles import GROUP_NGRAMS, checked, compare_group, describe, in_groups, read_sets, with_lead

#: Slots of the ring, as a power of two.
SLOT_BITS = 21
#: Coordinates of a band.
ROWS = 6
#: Chance that a pair at the threshold shares no band.
MISS = 1e-8
#: N-grams whose shifts are gathered at once.
GATHER = 1024
SEED = 20_240_601


def bands_for(share: int, rows: int = ROWS, miss: float = MISS) -> int:
    """How many bands of ``rows`` coordinates leave a pair at the threshold without a common one as rarely as ``miss``."""
    if share == 100:
        return 1
    return math.ceil(math.log(miss) / math.log1p(-((share / 100) ** rows)))


@functools.lru_cache(maxsize=2)
def ring(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and row s: the values of slot s under all shifts of the second."""
    random = np.random.default_rng(SEED)
    first = random.permutation(1 << SLOT_BITS).astype(np.uint32)
    second = random.permutation(1 << SLOT_BITS).astype(np.uint32)
    around = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def signature(ngrams: np.ndarray, coordinates: int) -> np.ndarray:
    """All coordinates of a set that is not empty."""
    first, shifts = ring(coordinates)
    slots = first[ngrams >> U(64 - SLOT_BITS)]
    least = shifts[slots[:GATHER]].min(axis=0)
    for low in range(GATHER, len(slots), GATHER):
        np.minimum(least, shifts[slots[low : low + GATHER]].min(axis=0), out=least)
    return least


def band_keys(ngrams: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band."""
    parts = signature(ngrams, bands * rows).reshape(bands, rows).astype(U)
    keys = np.arange(1, bands + 1, dtype=U) * BASE
    for k in range(rows):
        keys = mix(keys * BASE + parts[:, k])
    return keys


def minhash_links(
    docs: DataFrame, n: int, share: int, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, group_ngrams: int = GROUP_NGRAMS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows and nodes as ``shingles.describe`` gives them, and the links (a, b) of nodes that connect all linked ones."""
    if not 50 <= share <= 100:
        raise ValueError("share must be from 50 to 100 percent")
    bands = bands_for(share, rows)
    known, nodes = describe(docs, n, id_col, text_col, keys=lambda ngrams: band_keys(ngrams, bands, rows))

    chosen = known.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    keyed = chosen.select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low < top")
    shared = materialise(shared.select("key", "low"), "keys")
    met = materialise(keyed.join(shared, "key"), "met")
    drop_written(shared)

    pairs = materialise(met.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "pairs")
    wanted = nodes.join(met.select("node").distinct(), "node", "left_semi")
    sets = read_sets(docs, wanted, n, id_col, text_col)
    links = materialise(checked(pairs, sets, lambda own: with_lead(own, share)), "links")
    joined = materialise(components(links), "joined")

    named = met.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = named.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one < two")
    left = materialise(named.join(left.select("key"), "key").select("node", "low", "component"), "left")
    clusters = components(left.select(F.col("node").alias("a"), F.col("low").alias("b")))
    clusters = clusters.withColumnRenamed("component", "cluster")
    members = clusters.join(left.select("node", "component").distinct(), "node").join(sets.select("node", "n_ngrams"), "node")
    members = materialise(members, "members")
    placed = in_groups(members, group_ngrams).join(sets.select("node", "ngrams"), "node")

    def link(key, table):
        pa.default_memory_pool().release_unused()
        names = table.column("node").to_numpy()
        own = [np.frombuffer(s.as_buffer(), dtype=U) for s in table.column("ngrams")]
        halves = table.column("block").to_numpy() if key[1].as_py() != key[2].as_py() else None
        found = compare_group(own, table.column("component").to_numpy(), share, halves)
        ends = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(names[ends[:, 0]]), "b": pa.array(names[ends[:, 1]])})

    more = placed.select("cluster", "one", "two", "node", "block", "component", "ngrams")
    more = materialise(more.groupBy("cluster", "one", "two").applyInArrow(link, "a long, b long"), "links")
    drop_written(met, pairs, sets, joined, left, members)
    return known, nodes, links.union(more)


def minhash_components(
    docs: DataFrame, n: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, group_ngrams: int = GROUP_NGRAMS
) -> DataFrame:
    """(doc, n_ngrams, component) for every row of ``docs``; component is the least ``doc`` reachable by links.

    Two documents link when their sets of ``n`` words overlap by ``share`` percent or more of their union; a text of
    fewer words is one n-gram.
    """
    known, nodes, links = minhash_links(docs, n, share, id_col, text_col, rows, group_ngrams)
    named = components(links)
    firsts = nodes.join(named, "node", "left").select("high", "low", "first", F.coalesce("component", "node").alias("component"))
    firsts = materialise(firsts, "firsts")
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    of_set = firsts.join(least, "component").select("high", "low", F.col("least.doc").alias("component"), F.lit(True).alias("linked"))
    # Rows with many copies meet the one row of their set.
    found = known.drop("keys").join(of_set, ["high", "low"], "left")
    return found.select("doc", "n_ngrams", F.when(F.col("linked"), F.col("component")).otherwise(F.col("doc")).alias("component"))
