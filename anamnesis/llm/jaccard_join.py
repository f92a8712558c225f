"""Documents whose sets of word n-grams overlap by a given share, joined over prefix trees.

1. Every text becomes the set of its distinct n-grams, held as 64-bit hashes. Texts with equal sets (by two 64-bit sums) are
   one node from here on, so copies are never paired.
2. Sets that link differ in at most ``d`` n-grams. Cut by hash value into d + 1 parts, two such
   sets agree in a whole part, and the hash of a part is the key by which they meet. ``d`` follows
   from the longest set of a band of lengths; a set takes the keys of its band and of the next.
   A few parts more make up for empty ones, which would let unlike sets meet. Or they meet by prefixes, see ``_prefix_keys``.
3. The least node of a key is a partner of all others. Nodes meet the partners that they share most keys with, in parts of a
   bounded size. A key whose nodes are connected by the links found is done; only the nodes of the others go on to meet each
   other, in groups of a bounded size.
4. In a part or group the sets, ordered by how common an n-gram is, form a prefix tree. It is walked once
   for all sets: at each edge the overlaps of all sets that are still possible grow by one count
   shared by the whole subtree, and a set is dropped as soon as the n-grams that remain can't
   bring it to the share. What reaches a leaf is exact. Links only leave as a spanning forest.

Null, empty and blank texts have empty sets and no links. Repeated rows are copies of each other.
The n-grams of a pair are compared by hash, with a chance of about 1e-19 per compared pair of
n-grams to be taken for equal when they are not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bytewords import U, mix
from anamnesis.llm.common import components, materialise
from anamnesis.llm.shingles import GROUP_NGRAMS, connect, describe, digest, first_rows, is_on, ngram_sets, read_sets, top_half

#: Texts whose keys a task holds at once.
BATCH_ROWS = 2048
#: Nodes whose ids are equal though their sets are not; a few in 1e10, so more than this are an error.
MAX_ODD = 100_000


def _bands(share: int) -> Callable[[int], tuple[tuple[int, int], tuple[int, int]]]:
    """For a set's size: (band, parts) of its own band and of the next larger one."""

    def upper(size: int) -> int:
        return size * 100 // share

    starts = [1]

    def parts(band: int) -> int:
        longest = starts[band + 1] - 1
        return 2 * longest * (100 - share) // (100 + share) + 1

    def of(size: int):
        while starts[-1] <= upper(size) * 2 + 2:
            starts.append(upper(starts[-1]) + 1)
        band = int(np.searchsorted(starts, size, side="right")) - 1
        return (band, parts(band)), (band + 1, parts(band + 1))

    return of


#: Parts beyond d + 1, as a share of them: so many empty parts need no key.
SPARE_PARTS = 0.02


def _keys(ngrams: np.ndarray, bands) -> np.ndarray:
    """A hash for each part of the set.

    With as many parts more as may be empty, two sets that link still agree in a part that is not
    empty; a set with more empty parts than that takes their keys too.
    """
    found = []
    for band, least in bands:
        if least == 1:
            continue  # only equal sets can link, and they are one node
        spare = -(-least * int(SPARE_PARTS * 1000) // 1000)
        parts = least + spare
        part = ((ngrams >> U(32)) * U(parts)) >> U(32)
        cut = np.searchsorted(part, np.arange(parts + 1, dtype=U))
        total = np.zeros(len(ngrams) + 1, dtype=U)
        np.cumsum(mix(ngrams ^ U(0x5851F42D4C957F2D)), out=total[1:])
        place = (U(band) << U(32)) + np.arange(parts, dtype=U)
        keys = mix((total[cut[1:]] - total[cut[:-1]]) ^ mix(place))
        empty = cut[1:] == cut[:-1]
        found.append(keys[~empty] if np.count_nonzero(empty) <= spare else keys)
    return np.concatenate(found) if found else np.zeros(0, dtype=U)


def _ids(nodes: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Nodes with the lower half of their digest as id, and the ids of those that it doesn't tell apart."""
    odd = nodes.groupBy("low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("low")
    other = F.xxhash64("high", "low")
    rows = nodes.join(odd, "low", "left_semi").select("high", "low", other.alias("id")).limit(MAX_ODD + 1).collect()
    if len(rows) > MAX_ODD:
        raise ValueError("the digests of sets agree far too often")
    ids = {(r["high"], r["low"]): r["id"] for r in rows}
    named = nodes.withColumn("node", F.col("low"))  # told apart below where halves are equal
    if ids:
        known = nodes.sparkSession.createDataFrame([(*k, v) for k, v in ids.items()], "high long, low long, __id long")
        named = named.join(F.broadcast(known), ["high", "low"], "left").withColumn("node", F.coalesce("__id", "node")).drop("__id")
    return named, ids


def _part_keys(share: int) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
    """Of a set and a filter of what comes twice: the keys of its parts that pass."""
    of = _bands(share)

    def keys(ngrams: np.ndarray, on: np.ndarray | None) -> np.ndarray:
        own = _keys(ngrams, of(len(ngrams)))
        return own if on is None else own[is_on(on, top_half(own))]

    return keys


def _prefix_keys(share: int) -> Callable[[np.ndarray, np.ndarray | None], np.ndarray]:
    """Of a set: without a filter the even half of its n-grams, which are counted; with one its prefix but for those it has alone.

    The order of n-grams is: counted ones that no other set has, odd ones, then the others, each by hash. It depends on
    the n-gram only, so two sets that link have one in common among the first n - ceil(share n) + 1 of each. A set that is known
    to have more than 1 - share to itself has no key.
    """

    def keys(ngrams: np.ndarray, on: np.ndarray | None) -> np.ndarray:
        odd = (ngrams & U(1)).astype(bool)
        if on is None:
            return ngrams[~odd]
        counted = ngrams[~odd]
        twice = counted[is_on(on, top_half(counted))]
        length = len(ngrams) - -(-share * len(ngrams) // 100) + 1 - (len(counted) - len(twice))
        return np.concatenate([ngrams[odd], twice])[: max(length, 0)]

    return keys


def _keyed(rows: DataFrame, firsts: np.ndarray, n: int, make: Callable, ids: dict[tuple[int, int], int], bits: np.ndarray | None) -> DataFrame:
    """(key, node): the keys that ``make`` gives with the filter ``bits``, of every node, once for a batch of texts.

    Of ``rows`` (text, bit) only those that ``firsts`` lets pass stand for a node; copies of them have nothing to add.
    """
    shared = rows.sparkSession.sparkContext.broadcast((firsts, bits))

    def run(batches):
        first, on = shared.value
        for whole in batches:
            whole = whole.filter(pa.array(is_on(first, whole.column(1).to_numpy())))
            for batch in (whole.slice(low, BATCH_ROWS) for low in range(0, whole.num_rows, BATCH_ROWS)):
                pa.default_memory_pool().release_unused()
                keys, nodes, seen = [], [], set()
                for _, ngrams in ngram_sets(batch.column(0), n):
                    name = digest(ngrams)
                    if len(ngrams) and name not in seen:
                        seen.add(name)
                        keys.append(make(ngrams, on))
                        nodes.append(np.full(len(keys[-1]), ids.get(name, name[1]), dtype=np.int64))
                if keys:
                    yield pa.record_batch([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["key", "node"])

    return rows.mapInArrow(run, "key long, node long")


def link_group(
    sets: list[np.ndarray], share: int, halves: np.ndarray | None = None, labels: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """Links between distinct sets that connect all sets that any links connect.

    With ``halves`` only sets of different halves are compared; sets of equal ``labels`` are connected already.
    """
    m = len(sets)
    if m < 2 or (labels is not None and (labels == labels[0]).all()):
        return []
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(token, minlength=len(tokens))
    place = np.empty(len(tokens), dtype=np.int64)
    place[np.argsort(-common, kind="stable")] = np.arange(len(tokens))
    token = place[token]
    owner = np.repeat(np.arange(m), sizes)
    by_token = np.argsort(token, kind="stable")
    holders = owner[by_token]
    starts = np.searchsorted(token[by_token], np.arange(len(tokens) + 1))
    cuts = np.append(0, np.cumsum(sizes))
    ordered = [np.sort(token[cuts[i] : cuts[i + 1]]) for i in range(m)]
    line = sorted(range(m), key=lambda i: ordered[i].astype(">u4").tobytes())
    shared = np.zeros(m, dtype=np.int64)
    for k in range(1, m):
        a, b = ordered[line[k - 1]], ordered[line[k]]
        short = min(len(a), len(b))
        differ = np.flatnonzero(a[:short] != b[:short])
        shared[k] = differ[0] if len(differ) else short
    parent = list(range(m))
    if labels is not None:
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        parent = first[of].tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    everyone = np.arange(m)
    # A stack of subtrees: the sets line[low:high] agree in their first ``depth`` n-grams, of
    # which ``met[i]`` are in set possible[i].
    stack = [(0, m, 0, everyone, np.zeros(m, dtype=np.int64))]
    while stack:
        low, high, depth, possible, met = stack.pop()
        lead = line[low]
        deep = int(shared[low + 1 : high].min()) if high - low > 1 else int(sizes[lead])
        edge = ordered[lead][depth:deep]
        if len(edge):
            begin, count = starts[edge], starts[edge + 1] - starts[edge]
            before = np.cumsum(count) - count
            rows = holders[np.arange(int(count.sum())) + np.repeat(begin - before, count)]
            met = met + np.bincount(rows, minlength=m)[possible]
        below = sizes[line[low:high]]
        # The overlap can still grow by what remains below and by what the set has not met; a
        # longer set asks for more, so each bound takes the kinder end.
        reach = met + np.minimum(int(below.max()) - deep, sizes[possible] - met)
        fits = (100 + share) * reach >= share * (sizes[possible] + int(below.min()))
        possible, met = possible[fits], met[fits]
        if high - low == 1:
            both = 100 * met >= share * (sizes[lead] + sizes[possible] - met)
            for other in possible[both & (possible != lead)].tolist():
                if halves is not None and halves[other] == halves[lead]:
                    continue
                a, b = root(lead), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    links.append((lead, other))
            continue
        if not len(possible) or (len(possible) == 1 and high - low == 1):
            continue
        forks = low + 1 + np.flatnonzero(shared[low + 1 : high] == deep)
        for a, b in zip([low, *forks.tolist()], [*forks.tolist(), high], strict=True):
            stack.append((a, b, deep, possible, met))
    return links


def jaccard_components(
    docs: DataFrame,
    n: int = 5,
    share: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_ngrams: int = GROUP_NGRAMS,
) -> DataFrame:
    """(doc, n_ngrams, component) for every document; component is the least linked ``doc``.

    Two documents link when their sets of ``n`` words overlap by ``share`` percent or more of
    their union; a text of fewer words is one n-gram.
    """
    found = linked_rows(docs, n, share, id_col, text_col, group_ngrams)
    return found.select("doc", "n_ngrams", F.coalesce("first.doc", "doc").alias("component"))


def linked_rows(
    docs: DataFrame,
    n: int = 5,
    share: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_ngrams: int = GROUP_NGRAMS,
    by_prefix: bool = False,
) -> DataFrame:
    """(doc, mark, n_ngrams, first) for every row; mark is a hash of its text, which tells rows of one id apart.

    first is (without, doc, mark) of the least row that links lead to, rows without an id last; it is null where
    the set is empty. Sets meet by parts, or ``by_prefix``: both give the same links, prefixes need fewer sets to be read where
    most sets have many n-grams to themselves.
    """
    if not 50 < share <= 100:
        raise ValueError("share must be over 50 and at most 100 percent")
    known, nodes = describe(docs, n, id_col, text_col)
    nodes, ids = _ids(nodes)
    rows, firsts = first_rows(docs, nodes, id_col, text_col)
    make = _prefix_keys(share) if by_prefix else _part_keys(share)
    links = connect(
        lambda bits: _keyed(rows, firsts, n, make, ids, bits),
        nodes,
        lambda wanted: read_sets(docs, wanted, n, id_col, text_col),
        share,
        lambda sets: link_group(sets, share),
        lambda sets, labels, halves: link_group(sets, share, halves, labels),
        group_ngrams,
        by_low=True,
    )
    firsts = nodes.join(components(links), "node", "left")
    firsts = firsts.select("high", "low", "first", F.coalesce("component", "node").alias("component"))
    firsts = materialise(firsts, "firsts")
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    of_set = firsts.join(least, "component").select("high", "low", F.col("least").alias("first"))
    # Rows with many copies meet the one row of their set.
    return known.join(of_set, ["high", "low"], "left").select("doc", "mark", "n_ngrams", "first")
