"""Heads for several tasks at once against plain numpy."""

import math

import numpy as np
import pytest

from anamnesis.operators import heads as H
from anamnesis.operators import training as L

TASKS = [L.Task("b", "binary", 1), L.Task("m", "multiclass", 3), L.Task("l", "multilabel", 4)]
SCHEMA = "pooled array<double>, b int, m array<double>, l array<double>"


def rows(n, seed, width=5):
    rng = np.random.default_rng(seed)
    found = []
    for i in range(n):
        x = rng.normal(size=width) * [1, 10, 0.1, 1, 3][:width] + 1
        m, l = np.zeros(3), (rng.random(4) < 0.4 + 0.1 * (x[0] > 1)).astype(float)
        m[int(np.clip(x[1] // 8 + rng.integers(0, 2), 0, 2))] = 1
        b = int(x[0] + rng.normal() > 1)
        found.append((
            None if i % 17 == 16 else x.tolist(),
            [b, -1, None, b, b][i % 5],
            None if i % 7 == 0 else ([-1.0] * 3 if i % 7 == 1 else m.tolist()),
            [0.0] * 4 if i % 6 == 0 else l.tolist(),
        ))
    return found


def plain(data, weights, penalty):
    """Loss and gradient, row by row."""
    loss, gradient, first = 0.0, np.zeros_like(weights), 0
    for k, task in enumerate(TASKS):
        own = []
        for x, *labels in data:
            y = labels[k]
            t = None if y is None else np.atleast_1d(np.array(y, dtype=float))
            if x is None or t is None or not ((t >= 0).all() if task.kind == "binary" else (t == 1).any()):
                continue
            x1 = np.append(x, 1.0)
            z = weights[first : first + task.classes] @ x1
            if task.kind == "multiclass":
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                own.append((-math.log(p[t.argmax()]), np.outer(p - t, x1)))
            else:
                p = 1 / (1 + np.exp(-z))
                own.append((-(t * np.log(p) + (1 - t) * np.log(1 - p)).mean(), np.outer(p - t, x1) / task.classes))
        loss += np.mean([o[0] for o in own])
        gradient[first : first + task.classes] += np.mean([o[1] for o in own], axis=0)
        first += task.classes
    flat = weights.copy()
    flat[:, -1] = 0
    return loss + penalty / 2 * (flat**2).sum(), gradient + penalty * flat


def matrix(fitted):
    return np.array([[*w, b] for _, classes in fitted.heads.values() for w, b in classes])


def test_loss_and_gradient_of_all_tasks(spark):
    data = rows(90, 1)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    weights = np.random.default_rng(0).normal(size=(8, 6)) / 5
    loss, gradient, each = L._Loss(L.labelled_rows(df, TASKS, "pooled"), TASKS, 5, 0.1)(weights)
    expected = plain(data, weights, 0.1)
    assert loss == pytest.approx(expected[0]) and np.allclose(gradient, expected[1])
    assert set(each) == {"b", "m", "l"}


def test_sums_of_many_parts_go_up_in_levels(spark, monkeypatch):
    monkeypatch.setattr(L, "FAN_IN", 2)
    data = rows(60, 2)
    df = spark.createDataFrame(data, SCHEMA).repartition(9)
    loss, gradient, _ = L._Loss(L.labelled_rows(df, TASKS, "pooled"), TASKS, 5, 0.0)(np.zeros((8, 6)))
    expected = plain(data, np.zeros((8, 6)), 0.0)
    assert loss == pytest.approx(expected[0]) and np.allclose(gradient, expected[1])


def test_the_fit_ends_at_the_minimum(spark):
    data = rows(120, 3)
    df = spark.createDataFrame(data, SCHEMA).coalesce(2)
    fitted = L.fit_heads(df, TASKS, penalty=0.05, tolerance=1e-5)
    assert fitted.converged and fitted.losses == sorted(fitted.losses, reverse=True)
    assert np.abs(plain(data, matrix(fitted), 0.05)[1]).max() < 2e-5
    gradient = L.heads_gradient(fitted, df, TASKS, penalty=0.05).collect()
    assert len(gradient) == 8 * 6 and max(abs(r["gradient"]) for r in gradient) < 2e-5
    scored = H.linear_heads(df, fitted.heads).where("pooled is not null").first()
    assert len(scored["m"]) == 3 and sum(scored["m"]) == pytest.approx(1) and len(scored["l"]) == 4


def test_early_stop_gives_the_best_epoch(spark):
    train, valid = (spark.createDataFrame(rows(n, s), SCHEMA).coalesce(1) for n, s in ((30, 4), (60, 5)))
    fitted = L.fit_heads(train, TASKS, penalty=1e-6, valid=valid, patience=2, epoch_steps=1, steps=60)
    losses = [v for _, v in fitted.history]
    assert len(losses) >= 3 and not fitted.converged and min(losses) < min(losses[-2:])
    assert fitted.steps == len(losses) == losses.index(min(losses)) + 3


def test_what_cannot_be_fitted_is_an_error(spark):
    one = spark.createDataFrame([([1.0], 1, None, None), ([1.0, 2.0], 0, None, None)], SCHEMA)
    with pytest.raises(ValueError, match="components"):
        L.fit_heads(one, TASKS[:1])
    with pytest.raises(ValueError, match="no row"):
        L.fit_heads(one.limit(0), TASKS)
    with pytest.raises(ValueError, match="unknown kind"):
        L.Task("x", "regression", 1)
    with pytest.raises(ValueError, match="converge"):
        L.fit_heads(spark.createDataFrame(rows(40, 6), SCHEMA).coalesce(1), TASKS, steps=2)
    alone = L.fit_heads(one.limit(1), TASKS, penalty=1.0, tolerance=1e-4)
    assert all(w == [0.0] and b == 0 for task in ("m", "l") for w, b in alone.heads[task][1])


def test_null_vectors_have_no_prediction(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([0.0, 0.0],)], "pooled array<double>")
    found = [r["t"] for r in H.linear_heads(df.coalesce(1), {"t": ("binary", [([1.0, 1.0], 0.0)])}).collect()]
    assert found[1] is None and found[0] == pytest.approx([1 / (1 + math.exp(-3))]) and found[2] == [0.5]
