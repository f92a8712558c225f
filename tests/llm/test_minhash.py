"""Circulant MinHash against all pairs in plain Python."""

import numpy as np
import pytest
from test_jaccard import brute, corpus

from anamnesis.llm.bytewords import U, mix
from anamnesis.llm.circulant_minhash import SLOT_BITS, bands_for, minhash_components, ring, signature
from anamnesis.llm.shingles import compare_group


@pytest.mark.parametrize(("n", "share", "group"), [(2, 80, 4_000_000), (2, 80, 300), (5, 80, 600), (3, 100, 600)])
def test_same_as_all_pairs(spark, table, n, share, group):
    texts = corpus(n * share + group)
    found = minhash_components(table(texts), n, share, group_ngrams=group).collect()
    assert sorted(tuple(r) for r in found) == brute(texts, n, share)


def test_coordinates_are_shifts_of_one_permutation():
    ngrams = np.unique(mix(np.arange(1, 50, dtype=U)))
    first, shifts = ring(12)
    around = np.concatenate([shifts[:, 0], shifts[:12, 0]])
    slots = [int(first[int(x) >> (64 - SLOT_BITS)]) for x in ngrams]
    assert sorted(first[:10].tolist()) != list(range(10)) and len(np.unique(shifts[:, 0])) == 1 << SLOT_BITS
    assert signature(ngrams, 12).tolist() == [min(int(around[s + k]) for s in slots) for k in range(12)]


def test_share_of_equal_coordinates_is_the_overlap():
    rng = np.random.default_rng(3)
    pool = np.unique(mix(rng.integers(1, 1 << 60, 1500).astype(U)))
    one, two = np.sort(pool[:1200]), np.sort(pool[300:])
    overlap = len(np.intersect1d(one, two)) / len(pool)
    equal = (signature(one, 600) == signature(two, 600)).mean()
    assert abs(equal - overlap) < 0.08


def test_bands_miss_rarely():
    for rows in (4, 6):
        assert (1 - 0.8**rows) ** bands_for(80, rows) <= 1e-8


@pytest.mark.parametrize("seed", range(4))
def test_groups_by_counting(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 1 << 60, 40).astype(U)
    sets = []
    for _ in range(60):
        one = base.copy()
        one[rng.integers(0, 40, rng.integers(0, 6))] = rng.integers(1, 1 << 60)
        sets.append(np.unique(one))
    labels = rng.integers(0, 50, 60)
    halves = rng.integers(0, 2, 60) if seed % 2 else None
    label = labels.copy()
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            meet = halves is None or halves[i] != halves[j]
            if meet and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label[label == label[i]] = label[j]
    mine = labels.copy()
    links = compare_group(sets, labels, 80, halves)
    for i, j in links:
        mine[mine == mine[i]] = mine[j]
    pairs = lambda x: {(i, j) for i in range(60) for j in range(60) if x[i] == x[j]}
    assert pairs(mine) == pairs(label)
    assert len(links) == len(set(labels.tolist())) - len(set(mine.tolist()))


def test_edges(spark, table):
    docs = table(["a b c d", None, "", " ", "x"])
    again = docs.union(docs.limit(1)).withColumn("key", docs["doc_id"]).withColumn("node", docs["doc_id"])
    unnamed = spark.createDataFrame([(None, "a b  C d", "en", "s", 3, 1, 1), (None, None, "en", "s", 0, 1, 1)], again.schema)
    found = sorted(minhash_components(again.union(unnamed), 2, 80).collect(), key=str)
    assert sorted(map(tuple, found), key=str) == sorted(
        [(0, 3, 0), (0, 3, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (None, 3, 0), (None, 0, None)], key=str
    )
    assert minhash_components(docs.limit(0), 2, 80).count() == 0
