"""Prediction heads on pooled vectors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.sources.workspace import send_code

Weights = Sequence[tuple[Sequence[float], float]]


def sigmoid(logits: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-logits))


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def as_matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Arrays of equal length as the rows of a matrix; none of them is null."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), width)


def linear_heads(
    df: DataFrame, heads: Mapping[str, tuple[str, Weights]], vector: str = "pooled"
) -> DataFrame:
    """Add one array column per task: ``heads[task] = (kind, [(weights, bias) per class])``.

    Multiclass heads give a softmax over the classes, all others a sigmoid per class. All heads are one matrix
    product for a batch of rows; a null vector has null in each task.
    """
    send_code(df.sparkSession)
    weights = np.array([w for _, classes in heads.values() for w, _ in classes], dtype=np.float64)
    bias = np.array([b for _, classes in heads.values() for _, b in classes], dtype=np.float64)
    cuts = np.append(0, np.cumsum([len(classes) for _, classes in heads.values()]))
    parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), [kind for kind, _ in heads.values()], strict=True))

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            there = vectors.is_valid()
            logits = as_matrix(vectors.filter(there), weights.shape[1]) @ weights.T + bias
            out = [(softmax if kind == "multiclass" else sigmoid)(logits[:, low:high]) for low, high, kind in parts]
            flat = pa.array(np.concatenate(out, axis=1).ravel()) if out else pa.array([], pa.float64())
            ends = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False))).astype(np.int32) * len(bias)
            yield pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~there.to_numpy(zero_copy_only=False), False)), flat)

    scored = df.withColumn("__heads", score(F.col(vector)))
    slices = {task: F.slice("__heads", low + 1, high - low) for task, (low, high, _) in zip(heads, parts, strict=True)}
    return scored.withColumns(slices).drop("__heads")


PENALTY = 1e-4


def fit_head(
    train: DataFrame, vector: str, label: str, iterations: int = 1000, tolerance: float = 1e-9
) -> LogisticRegressionModel:
    """A linear head (binary or multiclass by the labels present), fitted until it converges.

    The loss is the mean log loss plus ``PENALTY`` / 2 times the squared weights, without the
    intercept. A fit that uses up its iterations is an error.
    """
    rows = train.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
    )
    learner = LogisticRegression(maxIter=iterations, regParam=PENALTY, tol=tolerance, standardization=False)
    model = learner.fit(rows)
    if model.summary.totalIterations >= iterations:
        raise ValueError(f"the head did not converge in {iterations} iterations")
    return model



def head_weights(model: LogisticRegressionModel) -> tuple[str, Weights]:
    """Kind and weights of a fitted head, as ``linear_heads`` takes them."""
    matrix = model.coefficientMatrix.toArray().tolist()
    kind = "binary" if len(matrix) == 1 else "multiclass"
    return kind, list(zip(matrix, model.interceptVector.toArray().tolist()))


def predict_head(head: LogisticRegressionModel | tuple[str, Weights], df: DataFrame, vector: str) -> DataFrame:
    """Add ``probability`` (one value per class) and ``predicted_label``, the first of the largest."""
    kind, weights = head_weights(head) if isinstance(head, LogisticRegressionModel) else head
    scored = linear_heads(df, {"probability": (kind, weights)}, vector)
    if kind != "multiclass":
        one = F.col("probability")[0]
        scored = scored.withColumn("probability", F.array(1 - one, one))
    largest = F.array_position("probability", F.array_max("probability")) - 1
    return scored.withColumn("predicted_label", largest.cast("int"))


def head_gradient(head: LogisticRegressionModel | tuple[str, Weights], train: DataFrame, vector: str, label: str) -> DataFrame:
    """``(class, component, gradient)`` of the loss of ``fit_head`` at a head's weights.

    Component -1 is the intercept. At the minimum every gradient is 0.
    """
    kind, weights = head_weights(head) if isinstance(head, LogisticRegressionModel) else head
    scored = predict_head((kind, weights), train, vector)
    classes = range(len(weights))
    errors = F.array(
        *[F.col("probability")[c + (kind != "multiclass")] - (F.col(label) == c + (kind != "multiclass")).cast("double") for c in classes]
    )
    values = F.concat(F.transform(vector, lambda x: x.cast("double")), F.array(F.lit(1.0)))
    rows = scored.select(F.posexplode(errors).alias("class", "__error"), values.alias("__x"))
    rows = rows.select("class", "__error", F.posexplode("__x").alias("component", "__x"))
    slope = rows.groupBy("class", "component").agg(F.avg(F.col("__error") * F.col("__x")).alias("__slope"))
    width = len(weights[0][0])
    flat = [(c, i, float(x)) for c in classes for i, x in enumerate([*weights[c][0], 0.0])]
    known = train.sparkSession.createDataFrame(flat, "class int, component int, __w double")
    gradient = F.col("__slope") + PENALTY * F.col("__w")
    component = F.when(F.col("component") == width, -1).otherwise(F.col("component"))
    return slope.join(known, ["class", "component"]).select("class", component.alias("component"), gradient.alias("gradient"))
