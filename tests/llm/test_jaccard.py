"""The prefix-tree join against all pairs in plain Python."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from anamnesis.llm.bytewords import U
from anamnesis.llm.jaccard_join import _part_keys, _prefix_keys, jaccard_components, link_group, linked_rows
from anamnesis.llm.shingles import top_half


def brute(texts, n, share):
    sets = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(60)] + ["É", "naïve", "ÀB", "X1"]
    passage = [rng.choice(words) for _ in range(12)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "two one", "a b c", "A\x0bb\x0cC", "a b c"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([4, 9, 20, 60, 150]))]
        if rng.random() < 0.4:
            base[2:2] = passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[: -rng.randint(1, 3)] or copy
            texts.append(rng.choice([" ", "  ", "\n"]).join(copy))
    return texts


@pytest.mark.parametrize(("n", "share", "group"), [(3, 90, 4_000_000), (3, 87, 300), (5, 80, 600)])
def test_same_as_all_pairs(spark, table, n, share, group):
    texts = corpus(n * share)
    found = jaccard_components(table(texts), n, share, group_ngrams=group).collect()
    assert sorted(tuple(r) for r in found) == brute(texts, n, share)


def test_prefix_tree_links_a_chain_without_all_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 200).astype(U))]
    for _ in range(30):  # each differs from the one before in a few
        last = sets[-1].copy()
        last[rng.integers(0, len(last), 4)] = rng.integers(0, 2**63, 4).astype(U)
        sets.append(np.unique(last))
    links = link_group(sets, 90)
    assert len(links) == 30
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    assert all(both(i, j) >= 0.9 for i, j in links)


def test_empty_table_and_clashing_columns(spark, table):
    assert jaccard_components(table([]), 3, 90).count() == 0
    docs = table(["a b c d", "a b c d"]).selectExpr("*", "1 as node", "2 as key", "3 as component", "4 as doc")
    assert sorted(tuple(r) for r in jaccard_components(docs, 3, 90).collect()) == [(0, 2, 0), (1, 2, 0)]


def test_rows_that_share_an_id_keep_their_links(spark, table):
    text = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (1, ""), (2, text("a") + " end"), (3, text("b") + " end"), (None, text("c")), (None, text("c") + " end"), (4, text("c") + " z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], table([]).schema)
    found = {(r["doc"], r["n_ngrams"], r["component"]) for r in jaccard_components(docs).collect()}
    assert found == {(1, 36, 1), (1, 0, 1), (2, 37, 1), (3, 37, 1), (None, 36, 4), (None, 37, 4), (4, 37, 4)}


@pytest.mark.parametrize(("n", "share", "group"), [(3, 87, 300), (5, 80, 600), (5, 80, 4_000_000)])
def test_same_by_prefixes(spark, table, n, share, group):
    texts = corpus(n * share + 1)
    found = linked_rows(table(texts), n, share, group_ngrams=group, by_prefix=True)
    found = found.selectExpr("doc", "n_ngrams", "coalesce(first.doc, doc)").collect()
    assert sorted(tuple(r) for r in found) == brute(texts, n, share)


def test_sets_with_much_of_their_own_have_no_prefix_key():
    rng = np.random.default_rng(5)
    common, copied = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (300, 600))
    unlike = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 300, dtype=np.uint64)])) for _ in range(50)]
    copies = [np.unique(copied), np.unique(np.append(copied[60:], rng.integers(0, 1 << 63, 40, dtype=np.uint64)))]
    make = _prefix_keys(80)
    halves, times = np.unique(np.concatenate([top_half(make(s, None)) for s in unlike + copies]), return_counts=True)
    places = halves[times > 1].view(np.int64) & ((1 << 16) - 1)
    on = np.zeros(1 << 10, dtype=U)
    np.bitwise_or.at(on, places >> 6, U(1) << (places & 63).astype(U))
    assert [len(make(s, on)) for s in unlike] == [0] * 50
    assert len(np.intersect1d(make(copies[0], on), make(copies[1], on)))
    parts = np.unique(np.concatenate([_part_keys(80)(s, None) for s in unlike]), return_counts=True)[1]
    assert (parts > 1).any()  # by parts some of them meet


def test_a_chain_of_keys_does_not_make_all_meet(spark):
    from anamnesis.llm.shingles import _members, in_groups

    left = spark.createDataFrame([(k + d, k, k + d) for k in range(99) for d in (0, 1)], "node long, low long, component long")
    clusters = spark.createDataFrame([(k, 0) for k in range(100)], "node long, cluster long")
    sets = spark.createDataFrame([(k, 10) for k in range(100)], "node long, n_ngrams long")
    placed = in_groups(_members(left, clusters, sets, 100), 100).collect()
    assert len(placed) == 198  # all pairs of blocks were 2,000 rows
    groups = {}
    for r in placed:
        groups.setdefault((r.cluster, r.one, r.two), set()).add(r.node)
    assert all(any({k, k + 1} <= g for g in groups.values()) for k in range(99))
    assert {r.cluster for r in _members(left, clusters, sets, 1000).collect()} == {0}


def test_rare_ngrams_come_first_in_a_prefix(spark):
    """Sets that have much in common with all others, and less with one, meet by what they have in common with that one."""
    from anamnesis.llm.shingles import LEVELS, _prefixes, _shared

    rng = np.random.default_rng(6)
    draw = lambda low, k: rng.integers(low << 40, (low + 1) << 40, k, dtype=np.uint64) << U(20)
    common, rows = draw(1, 60), []
    for pair in range(40):
        both = draw(1000 + pair, 40)
        rows += [(2 * pair + i, bytearray(np.unique(np.concatenate([common, both, draw(2000 + 2 * pair + i, 3)])).tobytes())) for i in (0, 1)]
    sets = spark.createDataFrame(rows, "node long, ngrams binary")
    met = _shared(lambda filters: _prefixes(sets, 90, filters), levels=LEVELS).collect()
    assert {(r.node, r.low) for r in met} == {(n, n - n % 2) for n in range(80)}  # by hash all 80 had the least node in common
