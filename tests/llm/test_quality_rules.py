"""Counts against plain Python, and what the decision list learns."""

import random
import re

from pyspark.sql import functions as F

from anamnesis.llm.quality_rules import COUNTS, FEATURES, base_failed, count_text, cover, kept, learn


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found, inside = {}, set()
    for i in range(len(words) - 2):
        found.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in found.values():
        if len(places) > 1:
            inside |= {p + k for p in places for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside))


TEXTS = [
    None,
    "",
    " \n\t",
    "one",
    "a b",
    "a b c",
    "a a a a",
    "a b c a b c",
    "x\ny\nx\n \n \ny ",
    "é # $% 🎉 <b> é # $%",
    "a\x0bb\x0cc\rd a b c d",
    "ab c ab c a bc a bc",
    "q w e r t y " * 400,
]


def test_counts(spark, table):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdé#\n") for _ in range(rng.choice([5, 30, 200]))) for _ in range(60)]
    docs = table(texts).withColumn("t", F.lit(1)).withColumn("counts", F.lit(2)).withColumn("h", F.lit(3))
    found = count_text(docs).orderBy("doc_id")
    assert [c for c in found.columns if c != "counts"] == [c for c in docs.columns if c != "counts"]
    rows = found.collect()
    assert [tuple(r["counts"][c] for c in COUNTS) for r in rows] == [brute(t) for t in texts]


def labelled(spark, table):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    texts, marks = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randint(60, 90))]
        bad = i % 4 == 0
        if bad and i % 8 == 0:
            words = [w + "%%" for w in words]
        elif bad:
            words = [w.upper() for w in words]
        texts.append(" ".join(words))
        marks.append((i, 0 if bad else 1, 0))
    marks += [(0, 1, 0), (1, None, 0), (None, 0, 0), (10_000, 0, 1)]
    return table(texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_learns_thresholds(spark, table):
    docs, labels = labelled(spark, table)
    counted = count_text(docs)
    rules = learn(counted, labels)
    assert {f for r in rules for f, _, _ in r.conditions} >= {"upper_case"} and len(rules) >= 2
    verdict = counted.select("doc_id", kept(rules, F.col("counts")).alias("kept")).collect()
    wrong = [r["doc_id"] for r in verdict if r["kept"] != (r["doc_id"] % 4 != 0)]
    assert not wrong
    plan = counted.select(kept(rules, F.col("counts")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_without_labels_base_rules_decide(spark, table):
    docs = table(TEXTS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counted = count_text(docs)
    assert learn(counted, labels) == []
    rows = counted.select(base_failed(F.col("counts")).alias("f"), kept([], F.col("counts")).alias("k")).collect()
    assert all(r["f"] != r["k"] for r in rows) and len(rows) == len(TEXTS)
    assert learn(count_text(table([])), labels) == []


def test_cover_prunes_what_does_not_help():
    names = list(FEATURES)
    edges = {f: [0.5] for f in names}
    bins = lambda **on: tuple(int(on.get(f, 0)) for f in names)
    cells = {}
    for grow in (True, False):
        cells[grow, bins(upper_case=1)] = [0, 50]
        cells[grow, bins(upper_case=1, word_length=1)] = [0, 40 if grow else 60]
        cells[grow, bins()] = [500, 3]
        cells[grow, bins(word_length=1)] = [300, 0]
    rules = cover(edges, cells)
    assert [r.conditions for r in rules] == [(("upper_case", True, 0.5),)]
    assert "upper_case >= 0.5" in str(rules[0])
