"""The field's marginals against all label sequences, and what it learns from labelled documents."""

import random
from itertools import product

import numpy as np
import pytest

from anamnesis.llm import toxic_crf as T


def brute(field, emission):
    total, hot = 0.0, np.zeros(len(emission))
    for states in product((0, 1), repeat=len(emission)):
        score, last = 0.0, 0
        for e, s in zip(emission, states, strict=True):
            score += field.step[last, s] + (e if s else 0.0)
            last = s
        weight = np.exp(score)
        total += weight
        hot += weight * np.array(states)
    return hot / total


@pytest.mark.parametrize("stretch", [1, 2, 3, 128])
def test_marginals_are_exact(monkeypatch, stretch):
    monkeypatch.setattr(T, "STRETCH", stretch)
    rng = np.random.default_rng(stretch)
    field = T.Field()
    field.step = rng.normal(0, 1.5, (2, 2))
    sizes = [3, 0, 1, 9, 0, 7, 2]
    first = np.append(0, np.cumsum(sizes))
    emission = rng.normal(0, 2, first[-1])
    found = T.marginals(field, emission, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b > a:
            assert np.allclose(found[a:b], brute(field, emission[a:b]))


def test_long_text_is_stable():
    field = T.Field()
    emission = np.full(200_000, -6.0)
    emission[150_000:150_003] = 30.0
    p = T.marginals(field, emission, np.array([0, 200_000]))
    assert p[150_000:150_003].min() > 0.99 and p[:149_000].max() < 0.01 and np.isfinite(p).all()


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(rng.randint(2, 8)))
    common = [word() for _ in range(300)]
    texts, toxic = [], []
    for i in range(n):
        words = [rng.choice(common) if rng.random() < 0.8 else word() for _ in range(rng.choice([5, 30, 120]))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vilejerk", "quxscum" + rng.choice(["o", "er", "ing", "ity"])]))
        texts.append(" ".join(words) + rng.choice([".", "!", ""]))
        toxic.append(int(bad))
    return texts, toxic


def test_learns_words_and_beginnings(spark, table):
    texts, toxic = corpus()
    labels = spark.createDataFrame(
        [(i, 1, t) for i, t in enumerate(toxic) if i >= 300] + [(None, 1, 1), (400, 1, None), (9999, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    docs = table(texts + [None, "", "...", "totally quxscumable é thing", texts[0]])
    rows = {r["key"]: r for r in T.tag_toxic(docs, T.learn(docs, labels)).collect()}
    assert len(rows) == len(texts) + 5
    right = sum((rows[i]["score"] >= 0.5) == bool(toxic[i]) for i in range(300))
    assert right >= 297
    for k in range(len(texts), len(texts) + 3):
        assert rows[k]["score"] == 0.0 and rows[k]["spans"] == []
    text = "totally quxscumable é thing"
    assert [text[s["start"] : s["end"]] for s in rows[len(texts) + 3]["spans"]] == ["quxscumable"]
    assert rows[len(texts) + 4]["score"] == rows[0]["score"]
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_no_labels_no_toxic_words(spark, table):
    docs = table(["some text", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = T.tag_toxic(docs, T.learn(docs, none)).collect()
    assert [r["spans"] for r in rows] == [[], []] and all(r["score"] < 0.5 for r in rows)
    assert T.tag_toxic(table([]), T.Field()).count() == 0
    clash = docs.selectExpr("*", "1 as key", "2 as score", "3 as spans", "4 as id", "5 as toxic")
    assert T.tag_toxic(clash, T.learn(clash, none)).count() == 2


def test_best_cut_parts_the_two_kinds():
    values = np.array([0.0, 1.0, 2.0, 8.0, 9.0])
    assert T.best_cut(values, np.array([False, False, False, True, True])) == 5.0
    assert T.best_cut(values, np.array([False, True, False, True, True])) in (0.5, 5.0)
    assert T.best_cut(values, np.zeros(5, dtype=bool)) == 10.0
