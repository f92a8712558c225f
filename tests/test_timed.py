"""Retrieval by bounds against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.operators import timed as M
from anamnesis.operators.retrieval import NORM_EPS, Layer


def network(seed, width, sizes, norm=True):
    rng = np.random.default_rng(seed)
    layers, before = [], width + 1
    for i, size in enumerate(sizes):
        weight = rng.normal(size=(size, before))
        if i == 0:
            weight[:, -1] /= 500
        scaled = norm and i < len(sizes) - 1
        layers.append(Layer(weight, rng.normal(size=size), rng.normal(size=size) if scaled else None, rng.normal(size=size) if scaled else None))
        before = size
    return layers


def forward(layers, x):
    for layer in layers:
        x = x @ layer.weight.T + layer.bias
        if layer.scale is not None:
            d = x - x.mean(axis=1, keepdims=True)
            x = np.maximum(d / np.sqrt((d**2).mean(axis=1, keepdims=True) + NORM_EPS) * layer.scale + layer.shift, 0)
    return 1 / (1 + np.exp(-x[:, 0]))


@pytest.mark.parametrize(("seed", "sizes", "norm"), [(1, [4, 1], True), (2, [8, 5, 1], True), (3, [1], False), (4, [6, 3, 1], False), (5, [16, 16, 4, 1], True)])
def test_no_score_is_above_its_bound(seed, sizes, norm):
    rng = np.random.default_rng(seed)
    layers, edges = network(seed, 3, sizes, norm), M.span_edges(5000, 20)
    x = rng.normal(size=(40, 3)) * [1, 5, 0.1]
    bounds = M.score_bounds(layers, x, edges)
    tight = 0.0
    for g in range(20):
        times = np.append(rng.uniform(edges[g], edges[g + 1], 30), [edges[g], edges[g + 1]])
        scores = np.stack([forward(layers, np.concatenate([x, np.full((40, 1), t)], axis=1)) for t in times])
        assert (scores.max(axis=0) <= bounds[:, g]).all()
        tight += np.median(bounds[:, g] - scores.max(axis=0)) / 20
    assert edges[0] == 0 and edges[-1] >= 5000 and tight < 0.35


def history(spark, n, every, seed, same=0):
    rng = np.random.default_rng(seed)
    rows = [(s, i, int(i * 5 + s), [float(v) for v in (rng.normal(size=2).round(1) if rng.random() > same else np.zeros(2))]) for s in (1, 2) for i in range(n // s)]
    events = spark.createDataFrame(rows, "subject_id long, event_idx long, time_min long, repr array<double>").repartition(3).cache()
    samples = events.where((F.col("event_idx") + 1) % every == 0).select(
        "subject_id",
        F.floor(F.col("event_idx") / every).alias("sample_no"),
        F.concat_ws("_", "subject_id", F.floor(F.col("event_idx") / every)).alias("sample_id"),
        (F.col("event_idx") + 1).alias("n_events"),
    )
    return events, samples


def rows_of(found):
    return sorted((r["sample_id"], r["rank"], r["event_idx"], round(r["score"], 9)) for r in found.collect())


@pytest.mark.parametrize(("seed", "k", "cutoff", "zeros"), [(1, 5, 0.0, True), (2, 3, 0.15, False), (3, 40, 0.3, True)])
def test_same_as_all_pairs(spark, monkeypatch, seed, k, cutoff, zeros):
    monkeypatch.setattr(M, "CHUNK_EVENTS", 16)
    monkeypatch.setattr(M, "BLOCK_SAMPLES", 4)
    events, samples = history(spark, 260, 9, seed, same=0.4)
    layers = network(seed, 2, [6, 3, 1])
    found = [rows_of(M.history_topk_timed(events, samples, layers, k, cutoff, zeros=zeros, worth=w)) for w in (0, 1e9)]
    assert found[0] == found[1] and found[0]


def test_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK_EVENTS", 32)
    monkeypatch.setattr(M, "BLOCK_SAMPLES", 16)
    layers = network(7, 2, [6, 1])
    counts = []
    for n in (400, 1600):
        events, samples = history(spark, n, 5, 7)
        events, samples = events.where("subject_id = 1"), samples.where("subject_id = 1")
        dated = samples.join(events.select("subject_id", (F.col("event_idx") + 1).alias("n_events"), F.col("time_min").alias("__end")), ["subject_id", "n_events"])
        pairs = []
        M.bounded_topk(events, dated.cache(), layers, 3, 0.0, "repr", pairs=pairs).count()
        counts.append(sum(pairs))
    everything = 1600 * 320 / 2
    assert counts[1] < everything / 4 and counts[1] < 8 * counts[0]


def test_edges(spark):
    events, samples = history(spark, 30, 10, 1)
    layers = network(1, 2, [4, 1])
    assert M.history_topk_timed(events, samples.limit(0), layers, 2, worth=0).count() == 0
    assert M.history_topk_timed(events.limit(0), samples.limit(0), layers, 2).count() == 0
    assert M.history_topk_timed(events, samples, layers, 2, cutoff=1.0, worth=0).count() == 0


@pytest.mark.parametrize(("seed", "sizes", "norm"), [(1, [4, 1], True), (2, [8, 5, 1], True), (4, [6, 3, 1], False)])
def test_scores_lie_in_their_ranges(seed, sizes, norm):
    rng = np.random.default_rng(seed)
    layers, edges = network(seed, 3, sizes, norm), M.span_edges(5000, 20)
    x = rng.normal(size=(40, 3)) * [1, 5, 0.1]
    least, most = M.score_ranges(layers, x, edges)
    t0 = rng.uniform(0, 4000, 40)
    t1 = t0 + rng.choice([0, 10, 900], 40)
    own = M.own_ranges(layers, x, t0, t1, edges)
    for part in np.linspace(0, 1, 40):
        for g in range(20):
            scores = forward(layers, np.concatenate([x, np.full((40, 1), edges[g] + part * (edges[g + 1] - edges[g]))], axis=1))
            assert (least[:, g] <= scores).all() and (scores <= most[:, g]).all()
        scores = forward(layers, np.concatenate([x, (t0 + part * (t1 - t0))[:, None]], axis=1))
        assert (own[0] <= scores).all() and (scores <= own[1]).all()
    assert (own[1] - own[0])[t0 == t1].max() < 1e-9


def test_spans_of_times(spark):
    edges = M.span_edges(5000, 20)
    times = [-3.0, 0.0, 0.5, 1.0, 2.0, 77.0, 4999.0, 5001.0, *edges[1:-1].tolist()]
    found = spark.createDataFrame([(t,) for t in times], "t double").select("t", *[M._span_of(F.col("t"), edges, b) for b in (False, True)]).collect()
    for t, first, last in found:
        there = [g for g in range(20) if edges[g] <= max(t, 0) <= edges[g + 1]]
        assert 0 <= first <= there[0] and there[-1] <= last <= 19 and last - first <= 2


def test_old_events_are_told_apart(spark, monkeypatch):
    """Scores that all come close to one another with age: bounds must be closer still, or every pair is scored."""
    from anamnesis.plans.vectors import timed_layers

    monkeypatch.setattr(M, "CHUNK_EVENTS", 16)
    monkeypatch.setattr(M, "BLOCK_SAMPLES", 4)
    rng = np.random.default_rng(3)
    rows = [(1, i, 700 * i, [float(rng.exponential(0.5)), i % 7 / 7]) for i in range(4000)]
    events = spark.createDataFrame(rows, "subject_id long, event_idx long, time_min long, repr array<double>").cache()
    samples = spark.createDataFrame([(1, j, f"1_{j}", 25 * j + 25) for j in range(160)], "subject_id long, sample_no long, sample_id string, n_events long")
    dated = samples.withColumn("__end", 700 * (F.col("n_events") - 1)).cache()
    pairs = []
    found = M.bounded_topk(events, dated, timed_layers(), 5, 0.3, "repr", pairs=pairs)
    assert rows_of(found) == rows_of(M.all_pairs_topk(events, dated, timed_layers(), 5, 0.3, "repr"))
    assert sum(pairs) < 160 * 4000 / 2 / 20
