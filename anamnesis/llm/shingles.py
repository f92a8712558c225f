"""Sets of word n-grams of whole texts: who has which set, reading sets back, comparing them in groups.

A node is a distinct set. Sets are told apart by two sums of 64 bits each over their mixed n-grams, so
unlike sets of a corpus of 1e10 texts are one node with a chance of about 1e-18.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import INVERSE, LOWER, NOT_SPACE, U, Words, mix, text_runs, windows
from anamnesis.llm.common import components, drop_written, materialise, send_code

#: N-grams that one group holds at most, a single longer set aside.
GROUP_NGRAMS = 1_000_000
#: N-grams that are compared with one set at once, a single longer set aside.
PART_NGRAMS = 100_000
#: Least and most bits of the filter that keeps texts without partners from being read into sets: 16 for a wanted
#: set between them. Beyond the most (16 MB) more texts pass, which the join that follows drops.
FILTER_BITS = (1 << 16, 1 << 27)
#: Texts read into sets at once.
READ_ROWS = 512
#: Rows of two numbers up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000


def ngram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes); a text of fewer words is one n-gram, one without words none."""
    for first, data, offsets in text_runs(texts):
        words = Words(LOWER[data], offsets, NOT_SPACE)
        hashes = words.hashes()
        for row in range(len(offsets) - 1):
            own = hashes[words.first[row] : words.first[row + 1]]
            yield first + row, np.unique(windows(own, min(n, len(own)))) if len(own) else own


def digest(ngrams: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole set; order does not matter."""
    if not len(ngrams):
        return 0, 0
    size = U(len(ngrams)) << U(40)
    sums = [np.add.reduce(mix(ngrams ^ INVERSE)), np.add.reduce(mix(ngrams + U(0x5851F42D4C957F2D)))]
    high, low = mix(np.array([s ^ size for s in sums], dtype=U)).view(np.int64)
    return int(high), int(low)


def describe(
    docs: DataFrame, n: int, id_col: str, text_col: str, keys: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[DataFrame, DataFrame]:
    """All rows and all nodes, both written.

    Rows: (doc, mark, n_ngrams, high, low, keys, row); ``keys`` of the set as ``keys`` makes them, ``mark`` a hash of the
    text. Nodes: (node, high, low, n_ngrams, first); ``first`` is (without, doc, mark, row) of the least row that has the
    set, rows without an id last, and its row number is the node.
    """
    send_code(docs.sparkSession)

    def run(batches):
        for batch in batches:
            pa.default_memory_pool().release_unused()
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            names = np.zeros((batch.num_rows, 2), dtype=np.int64)
            made: dict = {}
            found = [None] * batch.num_rows
            for row, ngrams in ngram_sets(batch.column(1), n):
                name = digest(ngrams)
                sizes[row], names[row] = len(ngrams), name
                if keys is not None and len(ngrams):
                    if name not in made:
                        made[name] = keys(ngrams).view(np.int64)
                    found[row] = made[name]
            columns = [batch.column(0), batch.column(2), pa.array(sizes), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy())]
            yield pa.record_batch(
                [*columns, pa.array(found, pa.list_(pa.int64()))], names=["doc", "mark", "n_ngrams", "high", "low", "keys"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col))
    rows = texts.mapInArrow(run, f"doc {kind}, mark long, n_ngrams long, high long, low long, keys array<long>")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "sets")
    first = F.struct(F.col("doc").isNull().alias("without"), "doc", "mark", "row")
    nodes = rows.where("n_ngrams > 0").groupBy("high", "low").agg(F.min(first).alias("first"), F.max("n_ngrams").alias("n_ngrams"))
    return rows, materialise(nodes.withColumn("node", F.col("first.row")), "nodes")


def first_rows(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """(text, bit) of all rows, and the filter of the bits of those that stand for a node, and of few others."""
    bits = _filter_size(nodes.count())
    place = F.pmod(F.xxhash64("first.doc", "first.mark"), F.lit(bits)).alias("bit")
    rows = docs.select(F.col(text_col), F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(text_col)), F.lit(bits)).alias("bit"))
    return rows, _bits_of(nodes.select(place), bits)


def read_sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, n_ngrams, ngrams) of the ``wanted`` nodes, their n-grams as bytes, from texts read once more; written."""
    wanted = materialise(wanted, "wanted")
    known = wanted.select("high", "low", "node", "n_ngrams")
    known = F.broadcast(known) if wanted.count() <= BROADCAST_ROWS // 2 else known
    rows, bits = first_rows(docs, wanted, id_col, text_col)
    on = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(is_on(on.value, batch.column(1).to_numpy())))
            for part in range(0, batch.num_rows, READ_ROWS):
                sets = {digest(s): s.tobytes() for _, s in ngram_sets(batch.column(0).slice(part, READ_ROWS), n)}
                high, low = np.array(list(sets), dtype=np.int64).reshape(-1, 2).T
                yield pa.record_batch(
                    [pa.array(high.copy()), pa.array(low.copy()), pa.array(list(sets.values()), pa.binary())], names=["high", "low", "ngrams"]
                )

    read = rows.mapInArrow(run, "high long, low long, ngrams binary")
    return materialise(read.join(known, ["high", "low"]).dropDuplicates(["node"]).select("node", "n_ngrams", "ngrams"), "read")


def in_groups(members: DataFrame, group_ngrams: int) -> DataFrame:
    """``members`` (node, cluster, n_ngrams, …) with (one, two, block): the pairs of blocks in which a node is compared.

    A whole cluster is block 0 with itself. A larger one than ``group_ngrams`` is cut into blocks, and each node goes to
    every pair that its block is in, so any two nodes of a cluster meet, and no group grows with the data.
    """
    weight = members.groupBy("cluster").agg(F.sum("n_ngrams").alias("__weight"))
    blocks = F.when(F.col("__weight") <= group_ngrams, 1).otherwise(F.ceil(F.col("__weight") * 2 / group_ngrams)).cast("int")
    cut = members.join(weight, "cluster").withColumn("__blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("__blocks")).cast("int"))
    cut = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    pair = {"one": F.least("block", "__other"), "two": F.greatest("block", "__other")}
    return cut.withColumns(pair).drop("__weight", "__blocks", "__other")


class Joined:
    """Which of some places are connected."""

    def __init__(self, labels: np.ndarray) -> None:
        """Places of equal labels are connected from the start."""
        self.label = np.unique(labels, return_inverse=True)[1]
        self.members = {int(c): [] for c in np.unique(self.label)}
        for place, label in enumerate(self.label.tolist()):
            self.members[label].append(place)

    def link(self, a: int, b: int) -> bool:
        """Connect two places; False if they are connected already."""
        one, two = int(self.label[a]), int(self.label[b])
        if one == two:
            return False
        if len(self.members[one]) < len(self.members[two]):
            one, two = two, one
        moved = self.members.pop(two)
        self.label[moved] = one
        self.members[one] += moved
        return True


def compare_group(sets: list[np.ndarray], labels: np.ndarray, share: int, halves: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets that any links connect, beyond those of equal ``labels``.

    The sets that hold an n-gram are listed once, so the overlaps of a set with all others are one count over the lists of
    its n-grams. Sets that are connected with all others are passed over. With ``halves`` only sets of different halves are compared.
    """
    m = len(sets)
    joined = Joined(labels)
    if len(joined.members) < 2:
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(m, dtype=np.int32), sizes)[np.argsort(token, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(token)))
    cuts = np.append(0, np.cumsum(sizes))
    links = []
    # Small components first: the members of the largest are reached from all others.
    for x in np.argsort(np.bincount(joined.label)[joined.label], kind="stable").tolist():
        if len(joined.members) < 2:
            break
        other = joined.label != joined.label[x]
        other &= (100 * np.minimum(sizes, sizes[x]) >= share * np.maximum(sizes, sizes[x]))
        if halves is not None:
            other &= halves != halves[x]
        if not other.any():
            continue
        mine = token[cuts[x] : cuts[x + 1]]
        count = ends[mine + 1] - ends[mine]
        before = np.cumsum(count) - count
        met = np.bincount(owner[np.arange(int(count.sum())) + np.repeat(ends[mine] - before, count)], minlength=m)
        for y in np.flatnonzero(other & (100 * met >= share * (sizes + sizes[x] - met))).tolist():
            if joined.link(x, y):
                links.append((x, y))
    return links


#: Links (places of two sets) among sets: connecting all that any links connect, given labels of those connected already,
#: and halves, sets of one of which are not to be compared.
Compare = Callable[[list[np.ndarray], np.ndarray, np.ndarray | None], list[tuple[int, int]]]


def with_lead(sets: list[np.ndarray], share: int) -> list[tuple[int, int]]:
    """Links of the other sets with the first one."""
    lead, links = sets[0], []
    for i, own in enumerate(sets[1:], 1):
        if 100 * min(len(own), len(lead)) < share * max(len(own), len(lead)):
            continue
        at = np.searchsorted(lead, own)
        both = int((lead[np.minimum(at, len(lead) - 1)] == own).sum())
        if 100 * both >= share * (len(own) + len(lead) - both):
            links.append((i, 0))
    return links


def _as_table(names: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    ends = np.array(links, dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(names[ends[:, 0]]), "b": pa.array(names[ends[:, 1]])})


def checked(pairs: DataFrame, sets: DataFrame, first: Callable[[list[np.ndarray]], list[tuple[int, int]]]) -> DataFrame:
    """Links (a, b) of nodes among those that meet one ``b`` in ``pairs`` (a, b).

    They are dealt to parts of about ``PART_NGRAMS``, each with a copy of the set of ``b`` in front, and parts to groups of
    about ``GROUP_NGRAMS``, so that no group grows with the data. Only a ``b`` of several parts has to be looked up by the
    pairs; these are broadcast if there are few, so that the pairs of one ``b`` never meet in a task.
    """
    weight = pairs.join(sets.select(F.col("node").alias("a"), "n_ngrams"), "a").groupBy("b")
    weight = weight.agg(F.sum("n_ngrams").alias("weight"), F.count(F.lit(1)).alias("n"))
    weight = materialise(weight.withColumn("parts", F.ceil(F.col("weight") / PART_NGRAMS).cast("int")), "weight")
    several = weight.where("parts > 1").select("b", F.col("parts").alias("__parts"))
    total, split, rows = weight.agg(F.sum("weight"), F.count_if(F.col("parts") > 1), F.sum(F.col("n") + F.col("parts"))).first()
    total = total or 0
    cut = pairs.join(F.broadcast(several) if split <= BROADCAST_ROWS else several, "b", "left")
    part = F.pmod(F.xxhash64("a"), F.coalesce("__parts", F.lit(1))).cast("int").alias("part")
    members = cut.select(F.col("b").alias("low"), part, F.col("a").alias("node"))
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    members = members.union(weight.select(F.col("b").alias("low"), parts, F.col("b").alias("node")))
    group = F.pmod(F.xxhash64("low", "part"), F.lit(1 + 2 * total // GROUP_NGRAMS)).alias("group")
    members = members.withColumn("group", group)
    placed = sets.select("node", "ngrams").join(F.broadcast(members) if (rows or 0) <= BROADCAST_ROWS // 2 else members, "node")

    def run(table):
        pa.default_memory_pool().release_unused()
        low, part, node = (table.column(c).to_numpy() for c in ("low", "part", "node"))
        sets = [np.frombuffer(s.as_buffer(), dtype=U) for s in table.column("ngrams")]
        order = np.lexsort((node != low, part, low))
        starts = np.flatnonzero(np.append(True, (np.diff(low[order]) != 0) | (np.diff(part[order]) != 0)))
        links = []
        for own in np.split(order, starts[1:]):
            links += [(own[i], own[j]) for i, j in first([sets[k] for k in own.tolist()])]
        return _as_table(node, links)

    return placed.select("group", "low", "part", "node", "ngrams").groupBy("group").applyInArrow(run, "a long, b long")


def _bits_of(places: DataFrame, bits: int) -> np.ndarray:
    """Which of ``bits`` bits the column ``bit`` sets; read as at most a word for 64 bits."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    words = places.groupBy((F.col("bit") / 64).cast("long").alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    found = np.zeros(bits // 64, dtype=np.int64)
    found[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return found.view(U)


def _filter_size(count: int) -> int:
    return min(max(1 << (16 * count).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def is_on(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the bits of some numbers are set; the last digits of a number say which."""
    place = places.view(U) & U(64 * len(bits) - 1)
    return ((bits[place >> U(6)] >> (place & U(63))) & U(1)).astype(bool)


def top_half(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64) >> 32


#: A level of how common an n-gram is ends where it has so many rows; what more rows have is one level. Half of the keys of a level
#: or more don't reach the next one, so the filters of all levels together are bounded like the first.
LEVELS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)


def shared_keys(keyed: DataFrame, levels: tuple[int, ...] = LEVELS[:1]) -> list[np.ndarray]:
    """For each of ``levels`` the filter of the top halves of keys that more rows have; the first is what a key must pass to join any two nodes."""
    half = keyed.select(F.shiftright("key", 32).cast("int").alias("half"))
    twice = half.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > levels[0])
    twice = materialise(twice.select(F.col("half").cast("long").alias("half"), "n"), "twice")
    counts = twice.agg(*[F.count_if(F.col("n") > n) for n in levels]).first()
    found = []
    for n, count in zip(levels, counts, strict=True):
        if found and not count:
            break
        size = _filter_size(count)
        found.append(_bits_of(twice.where(F.col("n") > n).select(F.pmod("half", F.lit(size)).alias("bit")), size))
    drop_written(twice)
    return found


#: Partners that a node is compared with one by one, by keys of the whole corpus and by those of the nodes that are left.
ROUNDS = (1, 2)


def _shared(keyed: Callable, by_low: bool = False, levels: tuple[int, ...] | None = None) -> DataFrame:
    """(key, node, low) of the keys that several nodes have, with the least of these; written.

    ``keyed`` is given nothing, then the filter of ``shared_keys``, or those of all ``levels``. ``by_low`` makes one key of all that
    have the same least node, and adds ``n``, how many a node has of them: far fewer rows where nodes have many keys in common.
    """
    found = shared_keys(keyed(None)) if levels is None else shared_keys(keyed(None), levels)
    some = materialise(keyed(found[0] if levels is None else found), "keyed")
    shared = some.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("top")).where("low < top")
    shared = materialise(shared.select("key", "low"), "keys")
    met = some.join(shared, "key")
    if by_low:
        met = met.groupBy("node", "low").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.col("low"))
    met = materialise(met, "met")
    drop_written(some, shared)
    return met


def _with_partners(
    met: DataFrame, sets: DataFrame, first: Callable[[list[np.ndarray]], list[tuple[int, int]]], links: DataFrame | None, rounds: int
) -> tuple[DataFrame, DataFrame]:
    """Links, with those known before, and (node, low, component) of the keys whose nodes they don't connect; written.

    Each node meets the partner that it shares most keys with, then the next one if they are not connected by then.
    """
    count = F.sum("n") if "n" in met.columns else F.count(F.lit(1))
    pairs = met.where("node <> low").groupBy(F.col("node").alias("a"), F.col("low").alias("b")).agg(count.alias("n"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    pairs = materialise(pairs.withColumn("rank", rank).where(F.col("rank") <= rounds), "pairs")
    joined = None if links is None else materialise(components(links), "joined")
    for number in range(1, rounds + 1):
        asked = pairs.where(F.col("rank") == number).select("a", "b")
        if joined is not None:
            ends = [joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
            asked = asked.join(ends[0], "a", "left").join(ends[1], "b", "left")
            asked = asked.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
        asked = materialise(asked, "asked")
        found = materialise(checked(asked, sets, first), "links")
        drop_written(asked, *([] if joined is None else [joined]))
        links = found if links is None else links.union(found)
        joined = materialise(components(links), "joined")
    named = met.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = named.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("two")).where("one < two")
    left = materialise(named.join(left.select("key"), "key").select("node", "low", "component").distinct(), "left")
    drop_written(pairs, joined)
    return links, left


def _prefix(ngrams: np.ndarray, share: int, filters: list[np.ndarray]) -> np.ndarray:
    """What others may have of the first n - ceil(share n) + 1 n-grams, in order by how many of ``filters`` they pass, then by hash."""
    level = np.zeros(len(ngrams), dtype=np.int8)
    at = np.arange(len(ngrams))
    for bits in filters:
        at = at[is_on(bits, top_half(ngrams[at]))]
        level[at] += 1
    own = np.count_nonzero(level == 0)
    length = len(ngrams) - -(-share * len(ngrams) // 100) + 1
    return ngrams[np.argsort(level, kind="stable")[own : max(length, own)]]


def _prefixes(sets: DataFrame, share: int, filters: list[np.ndarray] | None) -> DataFrame:
    """(key, node): without filters all n-grams of the sets, with them those of their prefixes that others may have.

    N-grams are in order of rarity, by levels, then by hash; the first level are those that one set has alone. Two sets that link
    have an n-gram in common among the first n - ceil(share n) + 1 of each; one that is in a single set joins none, so a set of which
    more than 1 - share is its own has no key at all.
    """
    on = None if filters is None else sets.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, READ_ROWS):
                piece = batch.slice(low, READ_ROWS)
                keys = [np.frombuffer(one.as_buffer(), dtype=U) for one in piece.column(1)]
                keys = keys if on is None else [_prefix(k, share, on.value) for k in keys]
                nodes = np.repeat(piece.column(0).to_numpy(), [len(k) for k in keys])
                flat = np.concatenate(keys) if keys else np.zeros(0, dtype=U)
                yield pa.record_batch([pa.array(flat.view(np.int64)), pa.array(nodes)], names=["key", "node"])

    return sets.select("node", "ngrams").mapInArrow(run, "key long, node long")


def _members(left: DataFrame, clusters: DataFrame, sets: DataFrame, group_ngrams: int) -> DataFrame:
    """(node, cluster, component, n_ngrams): a cluster as it is, or by the least nodes of its keys if it is too large for a group.

    Nodes that have a key in common have its least node in common, so they still meet, and a chain of keys no longer makes
    all nodes along it meet each other.
    """
    placed = left.join(clusters, "node").join(sets.select("node", "n_ngrams"), "node")
    weight = placed.select("node", "cluster", "n_ngrams").distinct().groupBy("cluster").agg(F.sum("n_ngrams").alias("__weight"))
    cluster = F.when(F.col("__weight") <= group_ngrams, F.col("cluster")).otherwise(F.col("low"))
    return placed.join(weight, "cluster").withColumn("cluster", cluster).select("node", "cluster", "component", "n_ngrams").distinct()


def connect(
    keyed: Callable[[np.ndarray | None], DataFrame],
    nodes: DataFrame,
    read: Callable[[DataFrame], DataFrame],
    share: int,
    first: Callable[[list[np.ndarray]], list[tuple[int, int]]],
    compare: Compare,
    group_ngrams: int = GROUP_NGRAMS,
    by_low: bool = False,
) -> DataFrame:
    """Links (a, b) of nodes that connect all linked nodes of which any key of ``keyed`` (key, node) has both; written.

    1. Keys that one row has alone are left out, first by a filter of the halves of keys that come twice: ``keyed`` is
       called without a filter, then with it, and leaves out the keys that are not ``is_on`` by their ``top_half``.
    2. All nodes of a key have its least node as a partner, and meet the partners that they share most keys with. ``first``
       gives the links among those that meet one node. Keys whose nodes are connected by these links are done.
    3. Nodes of the keys that are left get new keys, the n-grams of their prefixes in order of rarity, and step 2 is done again
       with these. Nodes that have much of their own drop out here.
    4. Nodes of the keys that are left then are clusters, connected by such keys only. ``compare`` finds the links of a cluster
       inside of a task, all with all except those connected already; a large cluster is parted by the least nodes of its
       keys, and what is still large goes in pairs of blocks.

    With ``by_low`` keys of the same least node are one, for sets that have many in common.

    ``nodes`` has (node, n_ngrams, …) and ``read`` gives (node, n_ngrams, ngrams) of some of its rows, written. Links leave a
    task as a spanning forest, so a group of near copies gives as many rows as it has members.
    """
    met = _shared(keyed, by_low)
    sets = read(nodes.join(met.select("node").distinct(), "node", "left_semi"))
    links, left = _with_partners(met, sets, first, None, ROUNDS[0])
    drop_written(met)

    some = materialise(left.select("node").distinct(), "some")
    rest = sets.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, "node", "left_semi")
    rest = materialise(rest, "rest")
    drop_written(sets, left, some)
    met = _shared(lambda filters: _prefixes(rest, share, filters), levels=LEVELS)
    links, left = _with_partners(met, rest, first, links, ROUNDS[1])
    drop_written(met)

    clusters = components(left.select(F.col("node").alias("a"), F.col("low").alias("b")))
    clusters = clusters.withColumnRenamed("component", "cluster")
    members = materialise(_members(left, clusters, rest, group_ngrams), "members")
    places = materialise(in_groups(members, group_ngrams).drop("n_ngrams"), "places")
    few = places.count() <= BROADCAST_ROWS // 2
    placed = rest.select("node", "ngrams").join(F.broadcast(places) if few else places, "node")

    def link(key, table):
        pa.default_memory_pool().release_unused()
        own = [np.frombuffer(s.as_buffer(), dtype=U) for s in table.column("ngrams")]
        halves = table.column("block").to_numpy() if key[1].as_py() != key[2].as_py() else None
        return _as_table(table.column("node").to_numpy(), compare(own, table.column("component").to_numpy(), halves))

    more = placed.select("cluster", "one", "two", "node", "block", "component", "ngrams")
    more = materialise(more.groupBy("cluster", "one", "two").applyInArrow(link, "a long, b long"), "links")
    drop_written(rest, left, members, places)
    return links.union(more)
