"""Runs of words against plain Python: all suffixes, all periods."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.llm import lyndon_runs as R
from anamnesis.llm.bytewords import U, mix


def brute_runs(words):
    """Every (start, length, period), by the definition."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            own = words[i : i + length]
            smaller = any(all(own[k] == own[k + d] for k in range(length - d)) for d in range(1, q))
            if length >= max(12, 2 * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def brute_lyndon(ranks):
    n = len(ranks)
    return [next((j for j in range(i + 1, n) if ranks[j:] < ranks[i:]), n) - i for i in range(n)]


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_lyndon_lengths(letters):
    rng = random.Random(letters)
    for _ in range(300):
        word = [rng.randrange(letters) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.4:
            word = (word[: rng.randrange(1, 7)] * 20)[: rng.randrange(2, 50)]
        ranks = np.unique(word, return_inverse=True)[1].tolist()
        assert R.lyndon_lengths(ranks) == brute_lyndon(ranks)


def sequence(rng):
    kinds = ["%s%d" % (rng.choice("ab"), i) for i in range(rng.choice([1, 2, 3, 8, 300]))]
    words = []
    while len(words) < rng.choice([0, 5, 13, 60, 200]):
        piece = [rng.choice(kinds) for _ in range(rng.choice([1, 2, 3, 7, 15]))]
        words += (piece * rng.choice([1, 1, 2, 3, 9]))[: rng.randrange(1, 60)]
        words += [rng.choice(kinds) for _ in range(rng.randrange(0, 9))]
    return words


@pytest.mark.parametrize("seed", range(3))
def test_same_as_all_periods(spark, table, seed):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "a " * 11, "a " * 12, "É É\x0b" * 6, "x y " * 12]
    texts += [rng.choice([" ", "  ", "\n", "\x0c"]).join(sequence(rng)) for _ in range(150)]
    found = {r["key"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in R.find_runs(table(texts)).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def test_hashes_that_mislead_are_caught(monkeypatch):
    rng = random.Random(9)
    words = [w for _ in range(20) for w in sequence(rng)]
    ids = np.unique(words, return_inverse=True)[1]
    hashes = mix(ids.astype(U) + U(1))
    expected = [(s, s + n, q) for s, n, q in brute_runs(ids.tolist())]
    monkeypatch.setattr(R._Prefixes, "same", lambda self, a, b, length: np.ones(len(a), dtype=bool))
    place, cuts = R.stretches(hashes, np.zeros(len(hashes), dtype=np.int64))
    got = [(place[s], place[e - 1] + 1, q) for s, e, q in R.runs_of(hashes[place], cuts).tolist()]
    assert got == expected


def test_a_long_text_of_one_word_and_of_far_repeats(spark, table):
    line = " ".join("w%d" % i for i in range(40))
    texts = ["ha " * 30_000, (line + " ") + " ".join("v%d" % i for i in range(50)) + " " + line]
    one, two = R.find_runs(table(texts)).orderBy("key").collect()
    assert [tuple(r) for r in one["runs"]] == [(0, 30_000, 1)] and one["collapsed"] == "ha"
    assert two["runs"] == [] and two["collapsed"] == texts[1]


def test_edges(spark, table):
    docs = table(["a b " * 6, None]).withColumn("key", F.lit(1)).withColumn("runs", F.lit("x"))
    found = R.find_runs(docs.union(docs))
    assert found.columns == ["key", "n_words", "runs", "collapsed"] and found.count() == 4
    assert R.find_runs(docs.limit(0)).count() == 0


def test_with_periods(spark):
    texts = [None, "", " ", "one", "a b  c\nd e f g h i j k l m n o p q r s t u v w x y z"]
    rows = [(t, n) for t in texts for n in [0, 10, 70, 71, 1230, 4294967290]]
    docs = spark.createDataFrame(rows, "text string, number long")
    for r in docs.select("text", "number", R.with_periods(F.col("text"), F.col("number")).alias("made")).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        n, g = len(words), r["number"] // 10
        if r["number"] % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert re.findall(r"[^\x20\x09-\x0D]+", r["made"] or "") == words


def test_query_against_all_periods(spark):
    import hashlib
    import zlib

    from anamnesis.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    found = {r["doc_id"]: r for r in QUERIES["op13_lyndon_runs"](spark, folder).collect()}
    docs = spark.read.parquet(folder + "/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs) and any(r["n_runs"] for r in found.values())
    for doc, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            words = words[:a] + [words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(a, n)]
        _, runs, left = brute(" ".join(words))
        start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        milli = None if length is None else 1000 * length // period
        listed = sha("".join("%d,%d,%d\n" % r for r in runs))
        assert tuple(found[doc]) == (doc, len(runs), start, length, period, milli, listed, sha(left))
