"""The best events of every history when the score of an event depends on the sample, with bounds instead of all pairs.

The scorer sees the minutes between an event and the end of a sample. That is the only thing in which samples differ, so
each event has a lower and an upper bound for each span of minutes: the values of the first layer as they are over the span,
then interval arithmetic through the other layers of the network. A chunk of consecutive events has the largest bounds of its
events, and a run of chunks the largest of its chunks. Each block of samples takes the events of a few promising chunks that all
of its samples hold; the k-th best of their lower bounds is what every sample of the block has at least. It looks into the runs
and chunks whose upper bound is not below that, in the order of these bounds and in rounds of twice as many chunks; events whose own
bound is not below it either are paired and scored, the rest never is. The result is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.operators.cohort import join_history
from anamnesis.operators.heads import as_matrix
from anamnesis.operators.retrieval import NORM_EPS, Layer, mask_zero_vectors, mlp_score, reject_below
from anamnesis.operators.skew import row_in_window
from anamnesis.sources.workspace import drop_written, materialise, send_code

#: Spans of minutes that an event has a bound for.
SPANS = 64
CHUNK_EVENTS = 256
BLOCK_SAMPLES = 256
#: A subject goes by bounds if its events are in so many samples each, on average, for every span.
WORTH = 4
#: Chunks that go by one bound until a block of samples looks into them.
RUN_CHUNKS = 64
#: Runs, and chunks of them, whose events tell a block of samples what it has at least; chunks that it scores in the first round.
FIRST_RUNS, FIRST_CHUNKS, NEXT_CHUNKS = 2, 8, 16
#: More than rounding can move a score.
SLACK = 1e-11


def _product(weight: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest values of a linear map over intervals."""
    up, down = np.maximum(weight, 0).T, np.minimum(weight, 0).T
    return low @ up + high @ down, high @ up + low @ down


def _normed(layer: Layer, low: np.ndarray, high: np.ndarray, square: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Normalisation and ReLU over intervals of centred values, whose mean square lies in ``square``."""
    least, most = (1 / np.sqrt(np.maximum(s, 0) + NORM_EPS)[:, None] for s in (square[1], square[0]))
    ends = [low * least, low * most, high * least, high * most]
    low, high = np.minimum.reduce(ends), np.maximum.reduce(ends)
    low, high = np.where(layer.scale >= 0, low, high) * layer.scale, np.where(layer.scale >= 0, high, low) * layer.scale
    return np.maximum(low + layer.shift, 0), np.maximum(high + layer.shift, 0)


def _square(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = low**2, high**2
    least = np.where((low < 0) & (high > 0), 0, np.minimum(one, two))
    return least.mean(axis=1), np.maximum(one, two).mean(axis=1)


class Bounds:
    """What the scores of some rows of vectors are at least and at most, over spans of the time."""

    def __init__(self, layers: Sequence[Layer], x: np.ndarray) -> None:
        self.layers = layers
        first, width = layers[0], layers[0].weight.shape[1] - 1
        # A row for each unit: values at time 0, what a minute adds, and where and at which value a normalised one turns.
        self.still, self.moving = first.weight[:, :width] @ x[:, :width].T + first.bias[:, None], first.weight[:, width, None]
        if first.scale is not None:
            still, moving = self.still - self.still.mean(axis=0), self.moving - self.moving.mean()
            one, both, two = (still**2).mean(axis=0), (still * moving).mean(axis=0), (moving**2).mean()
            # The derivative of a normalised value is linear in the time beside a positive factor, so it turns once at most.
            with np.errstate(divide="ignore", invalid="ignore"):
                turn = (moving * (one + NORM_EPS) - still * both) / (still * two - moving * both)
            self.still, self.moving, self.turn = still, moving, np.where(np.isfinite(turn), turn, -1.0)
            square = one + 2 * both * self.turn + two * self.turn**2
            self.turned = (still + moving * self.turn) / np.sqrt(np.maximum(square, 0) + NORM_EPS)

    def at(self, time: np.ndarray | float, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Values of the units of the first layer, before scale and shift."""
        values = self.still[:, rows] + self.moving * time
        return values if self.layers[0].scale is None else values / np.sqrt(np.einsum("un,un->n", values, values) / len(values) + NORM_EPS)

    def over(
        self, t0: np.ndarray | float, t1: np.ndarray | float, ends: Sequence[np.ndarray], rows: np.ndarray | slice = slice(None)
    ) -> tuple[np.ndarray, np.ndarray]:
        """Of some rows while the time goes from ``t0`` to ``t1``, where the units have the values ``ends``."""
        first, low, high = self.layers[0], np.minimum(*ends), np.maximum(*ends)
        if first.scale is not None:
            turn, turned = self.turn[:, rows], self.turned[:, rows]
            inside = (turn > t0) & (turn < t1)
            low, high = np.where(inside, np.minimum(low, turned), low), np.where(inside, np.maximum(high, turned), high)
            scale, shift = first.scale[:, None], first.shift[:, None]
            low, high = np.where(scale >= 0, low, high) * scale, np.where(scale >= 0, high, low) * scale
            low, high = np.maximum(low + shift, 0), np.maximum(high + shift, 0)
        low, high = low.T, high.T
        for layer in self.layers[1:]:
            if layer.scale is None:
                low, high = _product(layer.weight, low, high)
                low, high = low + layer.bias, high + layer.bias
            else:
                low, high = _product(layer.weight - layer.weight.mean(axis=0), low, high)
                centre = layer.bias - layer.bias.mean()
                low, high = low + centre, high + centre
                low, high = _normed(layer, low, high, _square(low, high))
        return 1 / (1 + np.exp(-low[:, 0])) - SLACK, 1 / (1 + np.exp(-high[:, 0])) + SLACK


def score_ranges(layers: Sequence[Layer], x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of vectors and spans ``edges[g]`` to ``edges[g + 1]`` of the time: no score is below the first or above the second."""
    bounds = Bounds(layers, x)
    least, most = np.empty((2, len(x), len(edges) - 1))
    before = bounds.at(edges[0])
    for g in range(len(edges) - 1):
        after = bounds.at(edges[g + 1])
        least[:, g], most[:, g] = bounds.over(edges[g], edges[g + 1], (before, after))
        before = after
    return least, most


def score_bounds(layers: Sequence[Layer], x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For rows of vectors and spans ``edges[g]`` to ``edges[g + 1]`` of the time: no score is above these."""
    return score_ranges(layers, x, edges)[1]


def own_ranges(layers: Sequence[Layer], x: np.ndarray, t0: np.ndarray, t1: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a time of its own of each row, from ``t0`` to ``t1``; span by span, as bounds over long times are loose."""
    bounds = Bounds(layers, x)
    least, most = np.full(len(x), np.inf), np.full(len(x), -np.inf)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        rows = np.flatnonzero((t1 >= low) & (t0 <= high))
        if len(rows):
            ends = np.maximum(t0[rows], low), np.minimum(t1[rows], high)
            found = bounds.over(*ends, [bounds.at(t, rows) for t in ends], rows)
            least[rows], most[rows] = np.minimum(least[rows], found[0]), np.maximum(most[rows], found[1])
    return least, most


def span_edges(longest: float, spans: int = SPANS) -> np.ndarray:
    """Spans that grow with the time, from 0 to at least ``longest`` minutes."""
    return np.append(0.0, np.geomspace(1.0, max(float(longest), 2.0) + 1, spans))


def _span_of(minutes: Column, edges: np.ndarray, last: bool) -> Column:
    """Number of the first span, or of the ``last``, that a time lies in, from 0; next to an edge it may be one further out."""
    ratio = float(np.log(edges[-1] / edges[1])) / (len(edges) - 2)
    place = F.floor(F.ln(minutes) / ratio + (1e-6 if last else -1e-6)) + 1
    return F.when(minutes < 1, 0).otherwise(F.least(place, F.lit(len(edges) - 2))).cast("int")


def _merged(parts: DataFrame, by: list[str], spans: int) -> DataFrame:
    """Parts of the same chunk or run as one: the largest bounds of each span, the times and the first event."""
    largest = [F.array(*[F.max(F.col(c)[g]) for g in range(spans)]).alias(c) for c in ("sure", "most")]
    return parts.groupBy(*by).agg(*largest, F.min("first").alias("first"), F.max("last").alias("last"), F.min("from_idx").alias("from_idx"))


def _chunks(placed: DataFrame, network: list[Layer], vector: str, edges: np.ndarray) -> DataFrame:
    """(subject_id, chunk, sure, most, first, last, from_idx): lower and upper bounds of the events of a chunk by span, its times and its first event.

    A task sends one row for each run of events of a chunk, so bounds of single events never leave it.
    """
    width = network[0].weight.shape[1] - 1
    subject = "subject_id"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ranges = score_ranges(network, as_matrix(batch.column("x"), width), edges)
            keys = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in (subject, "chunk")]
            starts = np.flatnonzero(np.append(True, np.logical_or(*[np.diff(k) != 0 for k in keys])))
            largest = [np.maximum.reduceat(r, starts) for r in ranges]
            times, places = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("time_min", "event_idx"))
            yield pa.record_batch(
                [
                    *[batch.column(c).take(pa.array(starts)) for c in (subject, "chunk")],
                    *[pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) for m in largest],
                    pa.array(np.minimum.reduceat(times, starts)),
                    pa.array(np.maximum.reduceat(times, starts)),
                    pa.array(np.minimum.reduceat(places, starts)),
                ],
                names=[subject, "chunk", "sure", "most", "first", "last", "from_idx"],
            )

    kind = {c: placed.schema[c].dataType.simpleString() for c in (subject, "chunk", "time_min", "event_idx")}
    rows = placed.select(subject, "chunk", "time_min", "event_idx", F.slice(F.col(vector), 1, width).alias("x"))
    made = f"{subject} {kind[subject]}, chunk {kind['chunk']}, sure array<double>, most array<double>, first {kind['time_min']}, last {kind['time_min']}, from_idx {kind['event_idx']}"
    return _merged(rows.mapInArrow(run, made), [subject, "chunk"], len(edges) - 1)


def all_pairs_topk(
    events: DataFrame, dated: DataFrame, layers: Sequence[Layer], k: int, cutoff: float, vector: str
) -> DataFrame:
    """Every event of every history is scored, in the blocked join."""
    met = join_history(events, dated)
    aged = met.withColumn("__before", F.col("__end") - F.col("time_min"))
    scored = mlp_score(aged, layers, vector, "__before").select("subject_id", "sample_id", "event_idx", "score")
    return row_in_window(reject_below(scored, cutoff), ["sample_id"], [F.desc("score"), F.col("event_idx")], k)


def bounded_topk(
    events: DataFrame,
    dated: DataFrame,
    layers: Sequence[Layer],
    k: int,
    cutoff: float,
    vector: str,
    spans: int = SPANS,
    pairs: list[int] | None = None,
) -> DataFrame:
    """The same rows from bounds. ``pairs`` is given the number of scored pairs of each round (for that they are counted)."""
    subject = "subject_id"
    send_code(events.sparkSession)
    longest = dated.agg(F.max("__end")).first()[0] or 0
    edges = span_edges(longest, spans)
    network = list(layers)
    width = network[0].weight.shape[1] - 1

    def own(which: int) -> Column:
        """A bound of an event for the ages that it has in a block of samples: the lower one, or with 1 the upper one."""

        @F.arrow_udf("double")
        def bound(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for vectors, *ends in batches:
                t0, t1 = (np.maximum(t.to_numpy(zero_copy_only=False).astype(np.float64), 0) for t in ends)
                yield pa.array(own_ranges(network, as_matrix(vectors, width), t0, t1, edges)[which])

        return bound(F.slice(F.col(vector), 1, width), *[(F.col(c) - F.col("time_min")).cast("double") for c in ("early", "late")])

    def over(values: str) -> Column:
        """Bounds of a run or chunk for the spans of its ages in a block."""
        low, high = _span_of(F.col("early") - F.col("last"), edges, False), _span_of(F.col("late") - F.col("first"), edges, True)
        return F.slice(values, low + 1, high - low + 1)

    placed = events.withColumn("chunk", F.floor(F.col("event_idx") / CHUNK_EVENTS))
    placed = materialise(placed.select(subject, "chunk", "event_idx", "time_min", vector), "placed")
    chunks = _chunks(placed, network, vector, edges).withColumn("run", F.floor(F.col("chunk") / RUN_CHUNKS))
    chunks = materialise(chunks, "chunks")
    runs = _merged(chunks, [subject, "run"], spans)
    samples = dated.withColumn("block", F.floor(F.col("sample_no") / BLOCK_SAMPLES))
    blocks = samples.groupBy(subject, "block").agg(
        F.min("__end").alias("early"), F.max("__end").alias("late"), F.min("n_events").alias("all_have"), F.max("n_events").alias("some_have")
    )
    block = [subject, "block"]
    of_block = [*block, "early", "late", "all_have", "some_have"]

    def offers(units: DataFrame, asked: DataFrame, on: list[str], unit: str) -> DataFrame:
        """Bounds of runs or chunks for the blocks of ``asked`` whose samples reach them."""
        met = units.join(asked, on).where(F.col("from_idx") < F.col("some_have"))
        found = met.select(*of_block, unit, F.array_min(over("sure")).alias("sure"), F.array_max(over("most")).alias("bound"))
        return found.where(F.col("bound") > cutoff)

    def ranked(rows: DataFrame, by: str, unit: str) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*block).orderBy(F.desc(by), unit)))

    wide = materialise(offers(runs, blocks, [subject], "run"), "wide")
    first = ranked(wide, "sure", "run").where(F.col("place") <= FIRST_RUNS).select(*of_block, "run")
    first = offers(chunks, first, [subject, "run"], "chunk").where((F.col("chunk") + 1) * CHUNK_EVENTS <= F.col("all_have"))
    first = ranked(first, "sure", "chunk").where(F.col("place") <= FIRST_CHUNKS).select(*block, "early", "late", "chunk")
    # All samples of a block hold these events, so the k-th best of their lower bounds is below the k-th best of each sample.
    sure = first.join(placed, [subject, "chunk"]).select(*block, "event_idx", own(0).alias("least"))
    sure = row_in_window(sure, block, [F.desc("least"), F.col("event_idx")], k).where(F.col("rank") == k)
    least = F.greatest(F.lit(float(cutoff)), F.coalesce("least", F.lit(float(cutoff)))).alias("least")
    reached = materialise(blocks.select(*block).join(sure, block, "left").select(*block, least), "reached")

    into = wide.join(reached, block).where(F.col("bound") >= F.col("least")).select(*of_block, "run")
    offered = offers(chunks, into, [subject, "run"], "chunk").join(reached, block).where(F.col("bound") >= F.col("least"))
    offered = materialise(ranked(offered, "bound", "chunk").select(*block, "early", "late", "chunk", "bound", "place"), "offered")
    last = offered.agg(F.max("place")).first()[0] or 0

    best, low, size = None, 0, NEXT_CHUNKS
    names = [subject, "sample_id", "event_idx", "score"]
    while low < last:
        asked = offered.where((F.col("place") > low) & (F.col("place") <= low + size)).join(reached, block)
        asked = asked.where(F.col("bound") >= F.col("least"))
        held = asked.join(placed, [subject, "chunk"]).where(own(1) >= F.col("least"))
        held = held.select(*block, "event_idx", "time_min", vector)
        ends = samples.select(*block, "sample_id", "n_events", "__end")
        met = held.join(ends, block).where(F.col("event_idx") < F.col("n_events"))
        aged = met.withColumn("__before", F.col("__end") - F.col("time_min"))
        scored = mlp_score(aged, layers, vector, "__before").select(*names)
        if pairs is not None:
            scored = materialise(scored, "scored")
            pairs.append(scored.count())
        scored = reject_below(scored, cutoff)
        scored = scored if best is None else scored.union(best.select(*names))
        found = row_in_window(scored, ["sample_id"], [F.desc("score"), F.col("event_idx")], k)
        before, best = best, materialise(found, "best")
        if before is not None:
            drop_written(before)
        low, size = low + size, size * 2
        if low >= last:
            break
        # What the k-th best of every sample of a block is at least; a sample with fewer still takes all.
        kth = best.where(F.col("rank") == k).select("sample_id", F.col("score").alias("kth"))
        full = samples.join(kth, "sample_id", "left").groupBy(*block).agg(F.min(F.coalesce("kth", F.lit(float(cutoff)))).alias("now"))
        before = reached
        reached = materialise(before.join(full, block).select(*block, F.greatest("least", "now").alias("least")), "reached")
        drop_written(before)
        left = offered.where(F.col("place") > low).join(reached, block).where(F.col("bound") >= F.col("least"))
        if left.isEmpty():
            break
    drop_written(placed, chunks, wide, offered, reached)
    if best is None:
        return all_pairs_topk(events.limit(0), dated, layers, k, cutoff, vector)
    return best.select(*names, "rank")


def history_topk_timed(
    events: DataFrame,
    samples: DataFrame,
    layers: Sequence[Layer],
    k: int = S.MAX_RETRIEVE_LEN,
    cutoff: float = 0.0,
    vector: str = "repr",
    zeros: bool = True,
    worth: float = WORTH,
) -> DataFrame:
    """The k best events of every sample when their score depends on the sample.

    The scorer's time is the minutes before the last event of the sample, so an event has a score for each sample that
    holds it. ``events`` has ``(subject_id, event_idx, time_min, vector)``, its times rise with the place; without ``zeros``
    padding vectors are left out. Subjects whose events are in many samples (``worth`` for every span of ``SPANS``) go by
    bounds, for the others all pairs are fewer than the bounds would be. Both give the same rows.
    """
    subject = "subject_id"
    send_code(events.sparkSession)
    last = events.select(subject, (F.col("event_idx") + 1).alias("n_events"), F.col("time_min").alias("__end"))
    dated = samples.join(last, [subject, "n_events"])
    offered = events.select(subject, "event_idx", "time_min", vector)
    offered = offered if zeros else mask_zero_vectors(offered, vector)
    share = F.sum("n_events") / F.max("n_events")
    heavy = samples.groupBy(subject).agg(share.alias("share")).where(F.col("share") >= worth * SPANS).select(subject)
    heavy = materialise(heavy, "heavy")
    if heavy.isEmpty():
        return all_pairs_topk(offered, dated, layers, k, cutoff, vector)
    apart = lambda df, how: df.join(heavy, subject, how)
    many = materialise(apart(dated, "left_semi"), "dated")
    by_bounds = bounded_topk(apart(offered, "left_semi"), many, layers, k, cutoff, vector)
    others = all_pairs_topk(apart(offered, "left_anti"), apart(dated, "left_anti"), layers, k, cutoff, vector)
    return others.unionByName(by_bounds)
