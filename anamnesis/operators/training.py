"""Linear heads for several tasks at once, fitted over tables of any size.

One pass over the rows for each step: a task of Spark turns its Arrow batches into matrix products and keeps one sum of
losses and gradients of all heads; the sums are added up in levels, each by groups of ``FAN_IN``. Only sums of a fixed size, classes
times components, reach the driver, which takes quasi-Newton steps. The loss of a task is the mean over its labelled
rows plus ``penalty`` / 2 times the squared weights, without the intercepts:

``binary``      label 0 or 1; -1 or null is not labelled
``multilabel``  an array of 0 and 1 per class, the mean of the binary losses; without any 1 (or null) not labelled
``multiclass``  an array with a 1 at the class, the negative log of its softmax; without any 1 (or null) not labelled
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.operators.heads import PENALTY, Weights, as_matrix, linear_heads
from anamnesis.operators.metrics import early_stop
from anamnesis.sources.workspace import drop_written, materialise, send_code

#: Sums that are added up by one group of a level.
FAN_IN = 32
#: Steps that the curvature is remembered for.
MEMORY = 12


@dataclass(frozen=True)
class Task:
    """A head to fit; its labels are in the column of its name."""

    name: str
    kind: str
    classes: int

    def __post_init__(self) -> None:
        if self.kind not in ("binary", "multiclass", "multilabel"):
            raise ValueError(f"{self.name}: unknown kind {self.kind!r}")
        if self.kind == "binary" and self.classes != 1:
            raise ValueError(f"{self.name}: a binary task has one class")


@dataclass(frozen=True)
class FittedHeads:
    """Heads as ``linear_heads`` takes them, the loss after each step and whether the fit ended by itself."""

    heads: dict[str, tuple[str, Weights]]
    losses: list[float]
    steps: int
    converged: bool
    history: list[tuple[int, float]] = field(default_factory=list)


def labelled_rows(df: DataFrame, tasks: Sequence[Task], vector: str) -> DataFrame:
    """``(x, y)``: the vector, and the labels of all tasks one after another, -1 where a task is not labelled.

    Rows without a vector or without any label are left out.
    """
    parts = []
    for task in tasks:
        label = F.col(task.name)
        if task.kind == "binary":
            value = F.array(F.coalesce(label.cast("float"), F.lit(-1.0)))
        else:
            known = F.exists(label, lambda x: x == 1)
            value = F.when(known, label.cast("array<float>")).otherwise(F.array_repeat(F.lit(-1.0), task.classes))
        parts.append(value.cast("array<float>"))
    rows = df.select(F.col(vector).cast("array<double>").alias("x"), F.concat(*parts).alias("y"))
    return rows.where(F.col("x").isNotNull() & F.exists("y", lambda v: v >= 0))


def _block(x: np.ndarray, y: np.ndarray, tasks: Sequence[Task], weights: np.ndarray) -> np.ndarray:
    """Sums over a block of rows: for each task its labelled rows and loss, then the gradient of all classes."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    logits = x1 @ weights.T
    slope, sums, first = np.zeros_like(logits), [], 0
    for task in tasks:
        own = slice(first, first + task.classes)
        first += task.classes
        z, t = logits[:, own], y[:, own]
        known = t[:, 0] >= 0 if task.kind == "binary" else (t == 1).any(axis=1)
        z, t = z[known], t[known]
        if task.kind == "multiclass":
            top = z.max(axis=1, keepdims=True, initial=-np.inf)
            raised = np.exp(z - top)
            total = raised.sum(axis=1, keepdims=True)
            hit = np.zeros_like(t)
            hit[np.arange(len(t)), t.argmax(axis=1)] = 1
            loss = (np.log(total) + top).sum() - (z * hit).sum()
            slope[known, own] = raised / total - hit
        else:
            # log(1 + exp(z)) - t z, without overflow.
            loss = (np.logaddexp(0, z) - t * z).sum() / task.classes
            slope[known, own] = (1 / (1 + np.exp(-z)) - t) / task.classes
        sums += [float(known.sum()), float(loss)]
    return np.concatenate([sums, (slope.T @ x1).ravel()])


def _sums(rows: DataFrame, make: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, labels: int) -> np.ndarray | None:
    """What ``make`` gives for all blocks of rows, added up in levels; None without rows."""

    def each(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                found = make(as_matrix(batch.column(0), width), as_matrix(batch.column(1), labels))
                total = found if total is None else total + found
        if total is not None:
            yield pa.record_batch([pa.array([total])], names=["sums"])

    def add(table):
        return pa.table({"sums": pa.array([np.sum([np.array(s.values) for s in table.column("sums")], axis=0)])})

    found = rows.select("x", "y").mapInArrow(each, "sums array<double>")
    parts = rows.rdd.getNumPartitions()
    while parts > FAN_IN:
        groups = -(-parts // FAN_IN)
        numbered = found.withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups)))
        found = numbered.groupBy("group").applyInArrow(add, "sums array<double>")
        parts = groups
    sums = [np.array(r["sums"]) for r in found.collect()]
    return np.sum(sums, axis=0) if sums else None


class _Loss:
    """Loss and gradient of all tasks over written rows, one pass each time."""

    def __init__(self, rows: DataFrame, tasks: Sequence[Task], width: int, penalty: float) -> None:
        self.rows, self.tasks, self.width, self.penalty = rows, list(tasks), width, penalty
        self.classes = sum(t.classes for t in tasks)
        self.passes = 0

    def __call__(self, weights: np.ndarray) -> tuple[float, np.ndarray, dict[str, float | None]]:
        """Of (classes, width + 1) weights: the loss, its gradient, and the loss of each task without the penalty."""
        self.passes += 1
        tasks, n = self.tasks, len(self.tasks)
        sums = _sums(self.rows, lambda x, y: _block(x, y, tasks, weights), self.width, self.classes)
        if sums is None:
            sums = np.zeros(2 * n + weights.size)
        gradient = sums[2 * n :].reshape(weights.shape).copy()
        loss, each, first = 0.0, {}, 0
        for i, task in enumerate(tasks):
            rows, total = sums[2 * i : 2 * i + 2]
            each[task.name] = total / rows if rows else None
            loss += total / max(rows, 1)
            gradient[first : first + task.classes] /= max(rows, 1)
            first += task.classes
        flat = weights.copy()
        flat[:, -1] = 0
        return loss + self.penalty / 2 * float((flat**2).sum()), gradient + self.penalty * flat, each


def _direction(gradient: np.ndarray, memory: list[tuple[np.ndarray, np.ndarray]], scale: np.ndarray) -> np.ndarray:
    """Minus the inverse curvature, as far as the last steps tell it, times the gradient."""
    q, back = gradient.copy(), []
    for step, change in reversed(memory):
        share = (step @ q) / (change @ step)
        back.append(share)
        q -= share * change
    if memory:
        step, change = memory[-1]
        scale = scale * ((step @ change) / (change @ (scale * change)))
    q *= scale
    for (step, change), share in zip(memory, reversed(back), strict=True):
        q += step * (share - (change @ q) / (change @ step))
    return -q


def fit_heads(
    train: DataFrame,
    tasks: Sequence[Task],
    vector: str = "pooled",
    penalty: float = PENALTY,
    steps: int = 1000,
    tolerance: float = 1e-6,
    valid: DataFrame | None = None,
    patience: int = S.PATIENCE,
    epoch_steps: int = 5,
) -> FittedHeads:
    """Heads for all tasks from the same passes over ``train``.

    Without ``valid`` it goes on until every component of the gradient is at most ``tolerance``; using up ``steps`` before is
    an error. With ``valid`` the mean loss of the tasks on it is looked at every ``epoch_steps`` steps; the fit ends when
    it was not better ``patience`` times in a row (``early_stop``), and the heads of the best epoch are given.
    A task without any labelled row keeps weights of 0.
    """
    spark = train.sparkSession
    send_code(spark)
    names = [t.name for t in tasks]
    if len(set(names)) < len(names) or not names:
        raise ValueError("tasks need names of their own")
    rows = materialise(labelled_rows(train, tasks, vector), "train")
    sizes = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.min(F.size("y")), F.max(F.size("y"))).first()
    classes = sum(t.classes for t in tasks)
    if sizes[0] is None:
        raise ValueError("no row has a vector and a label")
    if sizes[0] != sizes[1] or sizes[2:] != (classes, classes):
        raise ValueError(f"vectors of {sizes[0]} to {sizes[1]} components and {sizes[2]} to {sizes[3]} labels for {classes} classes")
    width = sizes[0]
    loss_of = _Loss(rows, tasks, width, penalty)
    checked = None
    if valid is not None:
        written = materialise(labelled_rows(valid, tasks, vector), "valid")
        checked = _Loss(written, tasks, width, 0.0)

    # Components of unlike size get steps of unlike size: the first guess of the curvature is a quarter of their mean square.
    moments = _sums(rows, lambda x, y: np.append((x**2).sum(axis=0), len(x)), width, classes)
    square = np.append(moments[:-1] / moments[-1], 1.0)
    scale = np.tile(1 / (square / 4 + penalty + 1e-12), classes)

    shape = (classes, width + 1)
    weights = np.zeros(shape)
    loss, gradient, _ = loss_of(weights)
    losses, memory, history, best = [loss], [], [], (np.inf, weights)
    converged, step = bool(np.abs(gradient).max() <= tolerance), 0
    while not converged and step < steps:
        step += 1
        flat = gradient.ravel()
        way = _direction(flat, memory, scale)
        slope = way @ flat
        length = 1.0 if memory else min(1.0, 1.0 / np.abs(flat).sum())
        while True:
            moved = weights + length * way.reshape(shape)
            new_loss, new_gradient, _ = loss_of(moved)
            if new_loss <= loss + 1e-4 * length * slope or length < 1e-10:
                break
            length /= 2
        change, moved_by = (new_gradient - gradient).ravel(), (moved - weights).ravel()
        if change @ moved_by > 1e-12 * (moved_by @ moved_by):
            memory = [*memory[-(MEMORY - 1) :], (moved_by, change)]
        weights, loss, gradient = moved, new_loss, new_gradient
        losses.append(loss)
        converged = bool(np.abs(gradient).max() <= tolerance)
        if checked is not None and (step % epoch_steps == 0 or converged):
            known = [v for v in checked(weights)[2].values() if v is not None]
            mean = float(np.mean(known)) if known else 0.0
            history.append((len(history), mean))
            best = (mean, weights) if mean < best[0] else best
            epochs = spark.createDataFrame([("fit", e, v) for e, v in history], "run_id string, epoch int, value double")
            if not early_stop(epochs, patience, "avg_loss").where("stopped").isEmpty():
                break
    drop_written(rows)
    if checked is not None:
        drop_written(checked.rows)
        weights = best[1] if history else weights
    elif not converged:
        raise ValueError(f"the heads did not converge in {steps} steps")
    heads, first = {}, 0
    for task in tasks:
        own = weights[first : first + task.classes]
        first += task.classes
        heads[task.name] = (task.kind, [(w[:-1].tolist(), float(w[-1])) for w in own])
    return FittedHeads(heads, losses, step, converged, history)


def heads_gradient(fitted: FittedHeads, train: DataFrame, tasks: Sequence[Task], vector: str = "pooled", penalty: float = PENALTY) -> DataFrame:
    """``(task, class, component, gradient)`` of the loss of ``fit_heads`` at the fitted heads; component -1 is the intercept.

    It is the same sum as in the fit, written as a DataFrame aggregate over one row per class and component.
    """
    labels = [F.col(t.name).alias(f"__y_{t.name}") for t in tasks]
    plain = train.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("__x"), *labels)
    scored = linear_heads(plain, {t.name: fitted.heads[t.name] for t in tasks}, "__x")
    parts = []
    for task in tasks:
        label = F.col(f"__y_{task.name}")
        if task.kind == "binary":
            known, truth = label >= 0, F.array(label.cast("double"))
        else:
            known, truth = F.exists(label, lambda x: x == 1), label.cast("array<double>")
        over = task.classes if task.kind == "multilabel" else 1
        errors = F.zip_with(F.col(task.name), truth, lambda p, t: (p - t) / over)
        parts.append(scored.where(known).select(F.lit(task.name).alias("task"), F.posexplode(errors).alias("class", "error"), "__x"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    values = F.concat(F.array(F.lit(1.0)), "__x")
    rows = rows.select("task", "class", "error", F.posexplode(values).alias("component", "value"))
    slope = rows.groupBy("task", "class", (F.col("component") - 1).alias("component")).agg(F.avg(F.col("error") * F.col("value")).alias("slope"))
    flat = [(t.name, c, i, float(w)) for t in tasks for c, (own, _) in enumerate(fitted.heads[t.name][1]) for i, w in enumerate([0.0, *own], -1)]
    known = train.sparkSession.createDataFrame(flat, "task string, class int, component int, weight double")
    return slope.join(known, ["task", "class", "component"]).select(
        "task", "class", "component", (F.col("slope") + penalty * F.col("weight")).alias("gradient")
    )
