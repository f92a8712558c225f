"""Retrieval: score every event, reject, keep the best per sample, back to time order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.functions import vectors as V
from anamnesis.functions.arrays import all_zero
from anamnesis.operators.skew import HotGroups, attach, row_in_window
from anamnesis.sources.workspace import send_code


def mask_zero_vectors(df: DataFrame, vector: str = "repr") -> DataFrame:
    """Drop padding: a vector of zeros can never be retrieved."""
    return df.where(~all_zero(F.col(vector)))


def cosine_scores(df: DataFrame, query: Sequence[float], vector: str = "repr") -> DataFrame:
    return df.withColumn("score", V.cosine_score(F.col(vector), query))


def query_vector(
    start: Sequence[float],
    hidden: tuple[np.ndarray, np.ndarray] | None = None,
    output: tuple[np.ndarray, np.ndarray] | None = None,
) -> list[float]:
    """The query itself, or its image under ``output(tanh(hidden(start)))``."""
    value = np.asarray(start, dtype=np.float64)
    if hidden is not None and output is not None:
        value = output[0] @ np.tanh(hidden[0] @ value + hidden[1]) + output[1]
    return value.tolist()


@dataclass(frozen=True)
class Layer:
    """A linear map, followed by normalisation and ReLU when it has a scale."""

    weight: np.ndarray
    bias: np.ndarray
    scale: np.ndarray | None = None
    shift: np.ndarray | None = None


NORM_EPS = 1e-5


def _activate(layer: Layer, x: np.ndarray) -> np.ndarray:
    x = x @ layer.weight.T + layer.bias
    if layer.scale is None:
        return x
    centred = x - x.mean(axis=1, keepdims=True)
    spread = np.sqrt((centred**2).mean(axis=1, keepdims=True) + NORM_EPS)
    return np.maximum(centred / spread * layer.scale + layer.shift, 0.0)


def mlp_score(
    df: DataFrame, layers: Sequence[Layer], vector: str = "repr", time: str | None = "time_min"
) -> DataFrame:
    """Add ``score`` in 0..1 from a small network over the vector and, optionally, its time.

    The weights travel with the task; batches arrive as Arrow arrays and are scored by
    matrix products.
    """
    send_code(df.sparkSession)
    network = list(layers)

    def forward(x: np.ndarray) -> pa.Array:
        for layer in network:
            x = _activate(layer, x)
        return pa.array(1.0 / (1.0 + np.exp(-x[:, 0])))

    def matrix(vectors: pa.Array) -> np.ndarray:
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, network[0].weight.shape[1])

    if time is None:

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for vectors in batches:
                yield forward(matrix(vectors))

        return df.withColumn("score", score(F.col(vector)))

    @F.arrow_udf("double")
    def timed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, times in batches:
            x = matrix(vectors)
            minutes = times.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), 1)
            yield forward(np.concatenate([x[:, : network[0].weight.shape[1] - 1], minutes], axis=1))

    return df.withColumn("score", timed(F.col(vector), F.col(time).cast("double")))


def reject_below(df: DataFrame, cutoff: float = 0.0) -> DataFrame:
    """Keep events that score above the cutoff."""
    return df.where(F.col("score") > cutoff)


def topk_rank(df: DataFrame, key: str, k: int = S.MAX_RETRIEVE_LEN, tie: str = "event_idx") -> DataFrame:
    """The k best events per sample with their rank, columns carried along."""
    return row_in_window(df, [key], [F.desc("score"), F.col(tie)], k)


def sort_by_time(top: DataFrame, key: str, fields: Sequence[str], time: str = "time_min", tie: str = "event_idx") -> DataFrame:
    """Retrieved events (at most k per sample) as one list per sample in time order."""
    event = F.struct(time, tie, *[f for f in fields if f not in (time, tie)])
    return top.groupBy(key).agg(F.sort_array(F.collect_list(event)).alias("events"))


def retrieve_topk(
    df: DataFrame,
    key: str,
    k: int = S.MAX_RETRIEVE_LEN,
    cutoff: float = 0.0,
    time: str = "time_min",
    tie: str = "event_idx",
) -> DataFrame:
    """Best events per sample above the cutoff, with ``rank`` and their ``time_rank``."""
    top = topk_rank(reject_below(df, cutoff), key, k, tie)
    by_time = Window.partitionBy(key).orderBy(time, tie)
    return top.withColumn("time_rank", F.row_number().over(by_time))


def retrieval_weights(top: DataFrame, key: str) -> DataFrame:
    """Share of each retrieved event in the score of its sample (at most k rows per sample)."""
    raised = F.col("score") + S.WEIGHT_EPS
    return top.withColumn("weight", raised / F.sum(raised).over(Window.partitionBy(key)))


def weighted_prediction(top: DataFrame, key: str, prediction: str = "pred") -> DataFrame:
    return top.groupBy(key).agg(F.sum(F.col("weight") * F.col(prediction)).alias("pred"))


def empty_retrieval_fallback(
    samples: DataFrame, pooled: DataFrame, key: str, constant: Sequence[float]
) -> DataFrame:
    """Give samples without any retrieved event a fixed vector."""
    filled = F.coalesce(F.col("pooled"), V.literal_vector(constant))
    return samples.join(pooled, key, "left").withColumn("pooled", filled)


LEVELS = (1024, 32_768, 1_048_576, 33_554_432, 1_073_741_824)
BLOCK_SAMPLES = 1024


def _node_of(place: Column, size: int | None) -> Column:
    """The range an event place lies in; without a size there is one range."""
    return F.floor(place / size) if size else F.lit(0).cast("bigint")


def history_topk(
    events: DataFrame,
    samples: DataFrame,
    k: int = S.MAX_RETRIEVE_LEN,
    levels: Iterable[int] = LEVELS,
    hot: HotGroups | None = None,
) -> DataFrame:
    """The k best events of every sample's history, without meeting all pairs.

    ``events`` has ``(subject_id, event_idx, score, …)`` and ``samples`` has ``(subject_id,
    sample_id, sample_no, n_events)``; a history is the first ``n_events`` events.

    Ranges of events of growing size keep only their k best. A history is put together
    from complete ranges, the largest first, and the single events of its last incomplete
    one. An event among the k best of a history is among the k best of its range, so the
    result is exact, while a sample meets a bounded number of rows per level. Levels longer
    than every history are left out. ``samples`` is used several times: write it first.
    """
    subject = "subject_id"
    best = [F.desc("score"), F.col("event_idx")]
    longest = samples.agg(F.max("n_events")).first()[0] or 0
    sizes = [1, *sorted(levels)]
    outers = [*sizes[1:], None]
    used = [(i, s, o) for i, (s, o) in enumerate(zip(sizes, outers)) if s <= max(longest, 1)]

    # Every range is filed under the range of the next level around it.
    table = None
    rows = events
    for level, size, outer in used:
        if level:
            long = samples.where(F.col("n_events") >= size).select(subject).distinct()
            noded = attach(rows, long, [subject], "left_semi", hot).withColumn(
                "__node", _node_of(F.col("event_idx"), size)
            )
            rows = row_in_window(noded, [subject, "__node"], best, k).drop("rank", "__node")
        filed = rows.withColumns(
            {"__level": F.lit(level), "__node": _node_of(F.col("event_idx"), outer)}
        )
        table = filed if table is None else table.unionByName(filed)

    spans = []
    for level, size, outer in used:
        node = _node_of(F.col("n_events"), outer)
        start = node * (outer or 0)
        stop = _node_of(F.col("n_events"), size) * size
        spans.append(
            F.struct(F.lit(level).alias("level"), node.alias("node"), start.alias("start"), stop.alias("stop"))
        )
    wanted = samples.select(
        subject,
        "sample_id",
        F.floor(F.col("sample_no") / BLOCK_SAMPLES).alias("__block"),
        F.explode(F.array(*spans)).alias("__span"),
    ).where(F.col("__span.start") < F.col("__span.stop"))
    wanted = wanted.withColumns({"__level": F.col("__span.level"), "__node": F.col("__span.node")})

    # The samples that need a range are consecutive, so they name a run of blocks.
    filed_by = [subject, "__level", "__node"]
    needed = wanted.groupBy(*filed_by).agg(
        F.min("__block").alias("__from"), F.max("__block").alias("__to")
    )
    offered = table.join(needed, filed_by).withColumn(
        "__block", F.explode(F.sequence("__from", "__to"))
    )
    met = offered.join(wanted, [*filed_by, "__block"]).where(
        (F.col("event_idx") >= F.col("__span.start")) & (F.col("event_idx") < F.col("__span.stop"))
    )
    carried = [c for c in events.columns if c != subject]
    return row_in_window(met.select(subject, "sample_id", *carried), ["sample_id"], best, k)
