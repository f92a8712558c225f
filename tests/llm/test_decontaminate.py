"""Benchmark windows in documents against a scan in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from anamnesis.llm.decontaminate import drop_contaminated, find_passages, without_spans


def split(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, n):
    out = []
    for text in texts:
        words, hit, found = split(text), set(), set()
        for item, own in items:
            own = split(own)
            size = min(n, len(own))
            for i in range(len(own) - size + 1) if own else ():
                for k in range(len(words) - size + 1):
                    if words[k : k + size] == own[i : i + size]:
                        hit |= set(range(k, k + size))
                        found.add(str(item))
        out.append((len(words), len(hit), sorted(found)))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "cc", "Dd", "é", "naïve", "x1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 7, 9, 20])))) for i in range(8)]
    items += [(20, None), (21, ""), (22, "--"), (23, items[4][1]), (24, "one two three four five six seven eight")]
    texts = [None, "", "...", "a", "ONE-two three\nfour FIVE six seven eight, nine"]
    for _ in range(40):
        parts = [word() for _ in range(rng.choice([2, 10, 60]))]
        if rng.random() < 0.5:
            parts[1:1] = (rng.choice(items[:8])[1]).upper().split()
        texts.append(rng.choice([" ", "-", ". "]).join(parts))
    return texts, items


@pytest.mark.parametrize("block", [4 << 20, 90])
def test_same_as_a_scan(spark, table, block):
    texts, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_passages(table(texts), bench, n=7, block_bytes=block).orderBy("key").collect()
    assert [(r["n_words"], r["n_hit"], sorted(r["items"])) for r in found] == brute(texts, items, 7)


@pytest.mark.parametrize("block", [4 << 20, 90])
def test_only_contaminated_rows_go(spark, table, block):
    texts, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(texts).withColumn("n_hit", F.lit(7)).withColumn("key", F.lit("x"))
    kept = drop_contaminated(docs, bench, n=7, share=30, block_bytes=block)
    assert kept.columns == docs.columns
    want = [i for i, (n, hit, _) in enumerate(brute(texts, items, 7)) if not hit or 100 * hit < 30 * n]
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_spans_can_be_removed(spark, table):
    docs = table(["é one TWO three, end", "nothing", ""])
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    found = find_passages(docs, bench, n=3)
    both = docs.join(found, docs.doc_id == found.key).select("doc_id", without_spans(F.col("text"), F.col("spans")).alias("t"))
    assert sorted(tuple(r) for r in both.collect()) == [(0, "é , end"), (1, "nothing"), (2, "")]


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in find_passages(table(["a b"]), none).collect()] == [0]
    assert find_passages(table([]), none).count() == 0


@pytest.mark.parametrize("block", [4 << 20, 20])
def test_rows_are_judged_by_themselves_whatever_the_benchmark_size(spark, table, block):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "five six seven eight")], "item_id long, text string")
    rows = [(1, "one two three four"), (1, "clean words only here"), (None, "five six seven eight"), (None, "clean too"), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], table([]).schema).withColumn("_row", F.lit("x"))
    kept = drop_contaminated(docs, bench, n=4, block_bytes=block)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
