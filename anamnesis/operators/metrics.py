"""Losses and metrics over long tables of truths and scores.

Ranking metrics first collapse equal scores to counts per (task, score) and then use
running sums over range-ordered segments, so one task may hold all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.operators.skew import running, running_split

LOG_FLOOR = -100.0


def task_table(tasks: DataFrame, source: str | None = None, name: str = "task") -> DataFrame:
    """Add ``kind`` and ``num_classes`` to task names."""
    task = F.col(name)
    kind, classes = F.lit(None).cast("string"), F.lit(None).cast("int")
    for pattern, family, count in reversed(S.TASK_FAMILIES):
        size = S.DIAGNOSIS_CLASSES.get(source, count) if family == "multilabel" else count
        kind = F.when(task.rlike(pattern), F.lit(family)).otherwise(kind)
        classes = F.when(task.rlike(pattern), F.lit(size)).otherwise(classes)
    single = task == S.SINGLE_TASK
    return tasks.withColumns(
        {
            "kind": F.when(single, F.lit("binary")).otherwise(kind),
            "num_classes": F.when(single, F.lit(1)).otherwise(classes),
        }
    )


def task_filter(df: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows of the given tasks."""
    return df.join(tasks.select("task").distinct(), "task", "left_semi")


def _clamped_log(p: Column) -> Column:
    return F.when(p > 0, F.greatest(F.ln(p), F.lit(LOG_FLOOR))).otherwise(F.lit(LOG_FLOOR))


def cross_entropy(truth: Column, p: Column) -> Column:
    return -(truth * _clamped_log(p) + (1 - truth) * _clamped_log(1 - p))


def masked_bce_loss(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    """Summed binary loss over labelled rows (truth is not -1), divided by all rows."""
    known = F.col(truth) != -1
    loss = F.when(known, cross_entropy(F.col(truth), F.col(p))).otherwise(F.lit(0.0))
    return df.groupBy(*keys).agg((F.sum(loss) / F.count(F.lit(1))).alias("loss"))


def _known(truth: str) -> Column:
    return F.aggregate(F.col(truth), F.lit(0.0), lambda a, x: a + x) > 0


def masked_multilabel_loss(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    """Summed binary loss over the classes of labelled rows, by classes and all rows."""
    each = F.zip_with(truth, p, lambda t, q: cross_entropy(t, q))
    row = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(truth)
    loss = F.when(_known(truth), row).otherwise(F.lit(0.0))
    return df.groupBy(*keys).agg((F.sum(loss) / F.count(F.lit(1))).alias("loss"))


def argmax(values: Column) -> Column:
    """0-based place of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def masked_nll_loss(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    """Negative log of the score of the true class, over labelled rows, by all rows."""
    hit = F.get(F.col(p), argmax(F.col(truth)))
    loss = F.when(_known(truth), -F.ln(hit + S.WEIGHT_EPS)).otherwise(F.lit(0.0))
    return df.groupBy(*keys).agg((F.sum(loss) / F.count(F.lit(1))).alias("loss"))


def binary_accuracy(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    hit = F.bround(F.col(p)) == F.bround(F.col(truth).cast("double"))
    return df.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("acc"))


def subset_accuracy(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    """All labels of a row must be right."""
    each = F.zip_with(truth, p, lambda t, q: F.bround(q) == F.bround(t))
    return df.groupBy(*keys).agg(F.avg(F.forall(each, lambda x: x).cast("double")).alias("acc"))


def multiclass_accuracy(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    hit = argmax(F.col(p)) == argmax(F.col(truth))
    return df.groupBy(*keys).agg(F.avg(hit.cast("double")).alias("acc"))


def ravel(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    """All (truth, score) pairs of array-valued rows, for micro-averaged ranking metrics."""
    pairs = F.arrays_zip(F.col(truth).alias("truth"), F.col(p).alias("score"))
    return df.select(*keys, F.explode(pairs).alias("__pair")).select(
        *keys, F.col("__pair.truth").alias("truth"), F.col("__pair.score").alias("score")
    )


def score_counts(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    positive = (F.col(truth) == 1).cast("bigint")
    return df.groupBy(*keys, F.col(p).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def _ranked_counts(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    """Score counts with the positives and negatives up to and including each score, from above."""
    return running_split(
        score_counts(df, keys, truth, p),
        list(keys),
        [F.desc("score")],
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom != 0, top / F.nullif(bottom, F.lit(0)))


def ranking_metrics(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    """AUROC and average precision per group from one ranked pass.

    A positive beats the negatives scored below it and half of those tied with it. AUROC is
    null where a class is missing.
    """
    ranked = _ranked_counts(df, keys, truth, p)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    sums = ranked.groupBy(*keys).agg(
        F.sum("pos").cast("double").alias("__p"),
        F.sum("neg").cast("double").alias("__n"),
        # Negatives ranked at or above each positive, ties counted half.
        F.sum(pos * (fp - neg / 2)).alias("__lost"),
        F.sum(pos * tp / (tp + fp)).alias("__precision"),
    )
    pairs = F.col("__p") * F.col("__n")
    return sums.select(
        *keys,
        _ratio(pairs - F.col("__lost"), pairs).alias("auroc"),
        _ratio(F.col("__precision"), F.col("__p")).alias("auprc"),
    )


def auroc(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    return ranking_metrics(df, keys, truth, p).select(*keys, "auroc")


def auprc(df: DataFrame, keys: Sequence[str], truth: str, p: str) -> DataFrame:
    return ranking_metrics(df, keys, truth, p).select(*keys, "auprc")


def metrics_of_binary(df: DataFrame, truth: str = "truth", p: str = "score") -> DataFrame:
    """Loss, AUPRC, AUROC and accuracy per task of a long binary table with masks (-1)."""
    known = df.where(F.col(truth) != -1)
    return (
        masked_bce_loss(df, ["task"], truth, p)
        .join(ranking_metrics(known, ["task"], truth, p), "task")
        .join(binary_accuracy(known, ["task"], truth, p), "task")
    )


def metrics_of_arrays(df: DataFrame, kind: str, truth: str = "truth", p: str = "p") -> DataFrame:
    """The same for multilabel or multiclass rows, whose ranking metrics are micro averages.

    A row whose truth holds -1 is masked: it counts in the divisor of the loss only.
    """
    known = df.where(~F.array_contains(truth, -1.0))
    loss = masked_multilabel_loss if kind == "multilabel" else masked_nll_loss
    accuracy = subset_accuracy if kind == "multilabel" else multiclass_accuracy
    return (
        loss(df, ["task"], truth, p)
        .join(ranking_metrics(ravel(known, ["task"], truth, p), ["task"], "truth", "score"), "task")
        .join(accuracy(known, ["task"], truth, p), "task")
    )


def evaluate(
    binary: DataFrame | None = None, multilabel: DataFrame | None = None, multiclass: DataFrame | None = None
) -> DataFrame:
    """Metric records of a run over tasks of all kinds, with the mean over tasks as task ``avg``.

    ``binary`` is ``(task, truth, score)``, the others are ``(task, truth, p)`` with arrays.
    """
    parts = [] if binary is None else [metrics_of_binary(binary)]
    parts += [] if multilabel is None else [metrics_of_arrays(multilabel, "multilabel")]
    parts += [] if multiclass is None else [metrics_of_arrays(multiclass, "multiclass")]
    names = ["task", "loss", "auprc", "auroc", "acc"]
    table = parts[0].select(*names)
    for part in parts[1:]:
        table = table.unionByName(part.select(*names))
    return task_metrics(table)


def task_metrics(per_task: DataFrame) -> DataFrame:
    """Long ``(task, metric, value)`` with the unweighted mean over tasks as task ``avg``.

    One row per task comes in; missing values (AUROC of a single class) are left out of the mean.
    """
    names = ["loss", "auprc", "auroc", "acc"]
    long = per_task.unpivot(["task"], names, "metric", "value")
    mean = long.groupBy("metric").agg(F.avg("value").alias("value"))
    return long.unionByName(mean.select(F.lit("avg").alias("task"), "metric", "value"))


def early_stop(
    history: DataFrame, patience: int = S.PATIENCE, metric: str = "avg_auroc", run: str = "run_id"
) -> DataFrame:
    """Per epoch: is it the best so far, evaluations since the best, and is it within the run.

    An epoch as good as the best counts as better. ``stopped`` marks the first epoch whose
    counter reaches the patience; later epochs are not part of the run. Metrics with
    ``loss`` in their name are better when lower.
    """
    value = -F.col("value") if "loss" in metric else F.col("value")
    best = running(
        history,
        [run],
        ["epoch"],
        {"__best": ("max", value, False), "__row": ("sum", F.lit(1).cast("bigint"))},
    )
    better = F.col("__best").isNull() | (value >= F.col("__best"))
    marked = best.withColumn("is_best", better)
    best_row = F.when(F.col("is_best"), F.col("__row"))
    counted = running(marked, [run], ["epoch"], {"__at": ("max", best_row)}).withColumn(
        "counter", F.col("__row") - F.col("__at")
    )
    reached = (F.col("counter") >= patience).cast("bigint")
    stopped = running(counted, [run], ["epoch"], {"__stops": ("sum", reached, False)})
    return (
        stopped.where(F.col("__stops") == 0)
        .withColumn("stopped", F.col("counter") >= patience)
        .drop("__best", "__row", "__at", "__stops")
    )
