"""The language model: counts and base score in plain Python, proper probabilities, gain on held-out texts."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from anamnesis.llm import bilinear_lm as L


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    texts = [None, "", "  "]
    for _ in range(n):
        if rng.random() < 0.5:
            texts.append(" ".join(rng.choice(["the", "cat", "Sat", "on", "mat%d" % rng.randrange(40)]) for _ in range(rng.randint(1, 40))))
        else:
            texts.append("\n".join(rng.choice(["der", "hund", "lief", "über", "weg%den" % rng.randrange(40)]) for _ in range(rng.randint(1, 40))))
    return texts + ["unseen words only", texts[5], "x" * 5000]


def test_counts_and_scores(spark, table, monkeypatch):
    texts = corpus()
    train = [t for i, t in enumerate(texts) if i % 3 != 0]
    count = Counter(w for t in train for w in [*words(t), None])
    total, kinds = sum(count.values()), len(count)
    for head in (1 << 18, 20, 0):
        monkeypatch.setattr(L, "HEAD_WORDS", head)
        rows = {r["key"]: r for r in L.score_texts(table(texts), F.col("doc_id") % 3 != 0).collect()}
        assert len(rows) == len(texts)
        for i, text in enumerate(texts):
            own = [*words(text), None]
            base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own)
            r = rows[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), total)
            assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-9)
            assert r["score"] < 0
    held = [i for i in range(len(texts)) if i % 3 == 0]
    assert sum(rows[i]["score"] for i in held) > sum(rows[i]["base_score"] for i in held)


def test_probabilities_of_all_next_tokens_sum_to_one(spark, table, monkeypatch):
    monkeypatch.setattr(L, "MIN_OWN", 20)
    texts = [t for t in corpus(60) if t]
    docs = table(texts)
    counts = L.count_words(docs)
    model = L.Model(counts, docs)
    classes, end = len(model.groups.group), len(model.own)
    assert 20 <= end < classes
    # Every counted word, the end, and one unseen word in each class, after a given context.
    share = np.zeros(classes)
    own = {int(np.uint64(w).view(np.int64)): k for k, w in enumerate(model.own)}
    for r in counts.collect():
        share[own.get(r["word"], end + 1 + r["ending"])] += r["n"] + 1
    share[end] += model.ends + 1
    share += 1  # the unseen word
    for two, one in ((0, 0), (end, end), (3, 17), (classes - 1, 5)):
        log = model.log10(np.full(classes, two), np.full(classes, one), np.arange(classes))
        assert math.isclose((10**log * share).sum(), 1.0, rel_tol=1e-4)


def test_log_probabilities_by_plain_sums():
    rng = np.random.default_rng(2)
    groups = L.Groups.of(rng.integers(0, 100, 13))
    w = L.Weights(13, groups, rng.normal(size=len(L.Weights(13, groups).flat)).astype(np.float32))
    two, one, token = rng.integers(0, 13, (3, 40))
    found = w.log10(groups, two, one, token)
    for a, b, c, got in zip(two, one, token, found, strict=True):
        h = w.before[0, a] + w.before[1, b]
        g = groups.group[c]
        of_group = [math.exp(float(h @ u + x)) for u, x in zip(w.groups, w.group_bias, strict=True)]
        inside = [math.exp(float(h @ w.classes[g, k] + w.class_bias[g, k])) for k in range(groups.size) if groups.class_share[g, k]]
        want = math.log10(of_group[g] / sum(of_group)) + math.log10(inside[groups.place[c]] / sum(inside))
        assert math.isclose(got, want, rel_tol=1e-4, abs_tol=1e-5)


def test_training_finds_what_follows(spark, table):
    """After x comes a in eight of ten cases, after y in one; z says nothing."""
    rng = random.Random(0)
    texts = []
    for _ in range(400):
        words = []
        for _ in range(30):
            first = rng.choice("xyz")
            words += [first, "a" if rng.random() < {"x": 0.8, "y": 0.1, "z": 0.5}[first] else "b"]
        texts.append(" ".join(words))
    docs = table(texts).repartition(3)
    model = L.Model(L.count_words(docs), docs)
    names = {}
    for name in "xyzab":
        words = L.Words(np.frombuffer(name.encode(), np.uint8), np.array([0, 1]), L.NOT_SPACE)
        names[name] = int(np.flatnonzero(model.own == words.hashes()[0])[0])
    for first, want in (("x", 0.8), ("y", 0.1), ("z", 0.5)):
        log = model.weights.log10(model.groups, np.array([names["a"]] * 2), np.array([names[first]] * 2), np.array([names["a"], names["b"]]))
        assert abs(10 ** log[0] - want) < 0.15 and abs(10 ** log[1] - (1 - want)) < 0.15


def test_batches_hold_every_token_once():
    streams = [tuple(np.arange(low, low + n) for _ in range(3)) for low, n in ((0, 3), (3, 0), (3, 25), (28, 4))]
    parts = list(L.batches_of(iter(streams), 10))
    assert [len(p[2]) for p in parts] == [10, 10, 10, 2] and np.concatenate([p[0] for p in parts]).tolist() == list(range(32))


def test_words_of_their_own_grow_with_the_corpus(spark, table):
    sizes = []
    for n in (20, 200):
        rng = random.Random(n)
        docs = table([" ".join("w%d" % rng.randrange(20 * n) for _ in range(100)) for _ in range(n)])
        sizes.append(len(L.Model(L.count_words(docs), docs).own))
    assert sizes == [int((20 * 101) ** 0.5), int((200 * 101) ** 0.5)]


def test_empty_tables(spark, table):
    assert L.score_texts(table([]), F.lit(True)).count() == 0
    r = L.score_texts(table(["a b", None]), F.lit(False)).orderBy("key").collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"]) for x in r] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    clash = table(["a b", "c"]).selectExpr("*", "1 as row", "2 as word", "3 as rare", "4 as key", "5 as n")
    assert L.score_texts(clash, F.lit(True)).count() == 2


def test_moves_of_weights_are_sent_small(spark, monkeypatch):
    from anamnesis.llm import bilinear_lm as B

    sent = []
    weighed = B._weighed
    monkeypatch.setattr(B, "_weighed", lambda moved, draws: sent.append((len(moved), weighed(moved, draws))) or sent[-1][1])
    texts = spark.createDataFrame([(f"a b c{i % 7} d",) for i in range(400)], "text string").repartition(9)
    own = np.zeros(0, dtype=np.uint64)
    groups = B.Groups.of(np.ones(1 + B.ENDING_CLASSES))
    seen = []
    monkeypatch.setattr(type(texts), "coalesce", lambda self, n, f=type(texts).coalesce: seen.append(n) or f(self, n))
    start, end = B.Weights(len(groups.group), groups), B.train(texts, own, groups, 2000)
    assert seen == [1] * B.ROUNDS  # so few tokens are one task's, nine tasks had them before
    assert sent and all(row.column("flat")[0].as_buffer().size == 2 * n for n, row in sent)  # eight bytes before
    assert 0.1 < np.abs(end.flat - start.flat).max() < 100
