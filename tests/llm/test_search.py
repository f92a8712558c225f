"""Ranked search against plain Python over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anamnesis.llm import hybrid_search as H


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(texts, queries, k):
    held = [Counter(terms(t)) for t in texts]
    size = sum(1 for h in held if h)
    total = sum(sum(h.values()) for h in held)
    df = Counter(t for h in held for t in h)
    found = []
    for query in queries:
        scores = []
        for doc, own in enumerate(held):
            m = 10 + (90 * sum(own.values()) * size) // max(total, 1)
            score = 0
            for t in set(terms(query)) & set(own):
                w = math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * own[t]) // (1000 * own[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc))
        found.append([(r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])])
    return found


def corpus(seed):
    rng = random.Random(seed)
    words = ["w%d" % min(int(rng.expovariate(0.08)), 200) for _ in range(400)] + ["É", "naïve", "ÀB", "X1"]
    texts = [None, "", " \t,", "one", "ONE-one"]
    for _ in range(500):
        texts.append(rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 30, 120]))))
    texts += texts[5:60]
    queries = [None, "", ".", "absent", "one", "É x1 Naïve"] + [" ".join(rng.sample(words, rng.choice([1, 2, 5, 25]))) for _ in range(40)]
    return texts, queries


def asked(spark, queries):
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "item_id long, text string")


def by_query(found, n):
    rows = [[] for _ in range(n)]
    for r in found:
        rows[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    return [sorted(r) for r in rows]


@pytest.mark.parametrize(("seed", "docs", "block", "most"), [(1, 4096, 1 << 20, 1 << 22), (2, 100, 60, 1 << 22), (3, 64, 1 << 20, 10)])
def test_same_as_all_scores(spark, table, monkeypatch, seed, docs, block, most):
    monkeypatch.setattr(H, "BLOCK_DOCS", docs)
    texts, queries = corpus(seed)
    found = H.search(table(texts).repartition(3), asked(spark, queries), 10, block_terms=block, max_terms=most).collect()
    assert by_query(found, len(queries)) == brute(texts, queries, 10)


def test_runs_are_skipped_and_lists_are_short_and_long():
    rng = random.Random(5)
    texts = ["common " * rng.choice([1, 2]) + " ".join(rng.choice("abcdefgh") + str(rng.randrange(300)) for _ in range(40)) for _ in range(4000)]
    texts[30] = "rare common rare"
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    rows = list(H._blocks(batch, None))
    hash_of = lambda word: next(int(h[0]) for _, _, h in H._terms(pa.array([word])))
    common, rare, a = (hash_of(w) for w in ("common", "rare", "a7"))
    best, scored, runs = H.Best(10), 0, 0
    for start, lengths, names, counts, places, times in rows:
        row = {"ids": pa.array(range(start, start + len(lengths))), "lengths": lengths, "terms": names, "counts": counts, "places": places, "times": times}
        block = H.Block(row, {common: 5, rare: 9000, a: 3000}, len(texts), 40 * len(texts))
        assert common in block.long and a in block.short
        scored += block.search([common, rare, a], best)
        runs += block.runs
    assert best.rows[0][2] == 30 and len(best.rows) == 10
    assert scored < 0.7 * runs


def test_edges(spark, table):
    docs = table(["a b", "a", "a"]).withColumn("rank", F.lit(1))
    again = docs.union(docs.where("doc_id = 2")).union(spark.createDataFrame([(None, "a", "en", "s", 1, 1)], docs.schema))
    found = H.search(again, asked(spark, ["A", "a a"]), 4).orderBy("query", "rank").collect()
    assert [r["id"] for r in found[:4]] == [1, 2, 2, None] and [r["rank"] for r in found[:4]] == [1, 2, 3, 4]
    assert [tuple(r)[2:] for r in found[:4]] == [tuple(r)[2:] for r in found[4:]]
    assert H.search(docs.limit(0), asked(spark, ["a"])).count() == 0
    assert H.search(docs, asked(spark, ["a"]).limit(0)).count() == 0


def test_weights_of_other_ids(spark):
    docs = spark.createDataFrame([("x", "a b"), ("k", "a b")], "name string, body string")
    found = H.search(docs, asked(spark, ["b"]).withColumnRenamed("item_id", "n"), 1, "name", "body", "n").collect()
    assert [(r["id"], r["rank"]) for r in found] == [("k", 1)] and found[0]["score"] > 0
    assert np.int64(found[0]["score"]) == found[0]["score"]
