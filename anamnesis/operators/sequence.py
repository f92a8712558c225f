"""Sequence shaping on long event and token tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.functions.arrays import next_multiple, next_power_of_two, pad_left, pad_right
from anamnesis.operators.skew import HotGroups, attach, explode_range, row_in_window, running


def place_events(
    df: DataFrame, key: str, order: Sequence[str], hot: HotGroups | None = None
) -> DataFrame:
    """0-based ``event_idx`` of each row within its sample."""
    placed = running(df, [key], order, {"__place": ("sum", F.lit(1).cast("bigint"))}, hot)
    return placed.withColumn("event_idx", F.col("__place") - 1).drop("__place")


def observation_window(
    df: DataFrame, key: str, hours: int, time: str = "time_min", hot: HotGroups | None = None
) -> DataFrame:
    """Events from the given hour on; the last event where none qualifies. Negative: all.

    ``df`` has ``event_idx``. The last event of each sample is found by aggregation, so a
    long sample is never gathered.
    """
    if hours < 0:
        return df
    start = hours * 60
    extent = df.groupBy(key).agg(
        F.max(time).alias("__latest"), F.max("event_idx").alias("__last")
    )
    keep = (F.col(time) >= start) | (
        (F.col("__latest") < start) & (F.col("event_idx") == F.col("__last"))
    )
    return attach(df, extent, [key], hot=hot).where(keep).drop("__latest", "__last")


def window_start(
    samples: DataFrame, events: DataFrame, hours: int, hot: HotGroups | None = None
) -> DataFrame:
    """The observation window as a first index per sample, before events are joined."""
    if hours < 0:
        return samples
    before = events.where(F.col("time_min") < hours * 60).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("__before")
    )
    first = F.least(F.coalesce("__before", F.lit(0)), F.col("n_events") - 1)
    joined = attach(samples, before, ["subject_id"], "left", hot)
    return joined.withColumn("from_idx", first).drop("__before")


def tail_events(df: DataFrame, key: str, max_len: int = S.MAX_SEQ_LEN) -> DataFrame:
    """The last ``max_len`` events of each sample."""
    return row_in_window(df, [key], [F.desc("event_idx")], max_len).drop("rank")


def sample_order(key: str, place: str, seed: int) -> Column:
    """A repeatable random order of the rows of a sample."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col(place).cast("string"), F.lit(str(seed))))


def sample_events(df: DataFrame, key: str, max_len: int, seed: int, place: str = "event_idx") -> DataFrame:
    """At most ``max_len`` random events per sample, without replacement."""
    order = [sample_order(key, place, seed), F.col(place)]
    return row_in_window(df, [key], order, max_len).drop("rank")


def chunk_index(lengths: DataFrame, key: str, length: str, max_len: int) -> DataFrame:
    """All chunks of all samples in sample order: ``(global_chunk, key, chunk, start, stop)``; no events, no chunk."""
    counted = lengths.where(F.col(length) > 0).withColumn("__chunks", F.ceil(F.col(length) / max_len))
    placed = running(counted, [], [key], {"__first": ("sum", F.col("__chunks"), False)})
    chunks = explode_range(
        placed.withColumnRenamed("__first", "__before"),
        "chunk",
        F.lit(0).cast("bigint"),
        F.col("__chunks") - 1,
    )
    return chunks.select(
        (F.col("__before") + F.col("chunk")).alias("global_chunk"),
        key,
        "chunk",
        (F.col("chunk") * max_len).alias("start"),
        F.least((F.col("chunk") + 1) * max_len, F.col(length)).alias("stop"),
    )


def chunk_lookup(lengths: DataFrame, wanted: DataFrame, key: str, length: str, max_len: int, number: str = "global_chunk") -> DataFrame:
    """The rows of ``wanted`` with ``(key, chunk, start, stop)`` of the chunk that their number names in ``chunk_index``.

    No chunk is listed: numbers and the first numbers of samples are merged in order, in ranges, and each number
    takes the last sample that starts at or before it. Numbers may repeat; one below 0, beyond the last chunk, or null
    names none and has nulls. Samples without events have no chunk.
    """
    counted = lengths.where(F.col(length) > 0).withColumn("__chunks", F.ceil(F.col(length) / max_len))
    placed = running(counted, [], [key], {"__first": ("sum", F.col("__chunks"), False)})
    sample = F.struct("__first", F.col(key).alias("__key"), F.col(length).alias("__length"), "__chunks").alias("__sample")
    starts = placed.select(F.col("__first").cast("bigint").alias("__number"), F.lit(0).alias("__asked"), sample)
    columns = F.struct(*wanted.columns).alias("__row")
    asked = wanted.select(F.col(number).cast("bigint").alias("__number"), F.lit(1).alias("__asked"), columns)
    both = starts.unionByName(asked, allowMissingColumns=True)
    merged = running(both, [], ["__number", "__asked"], {"__at": ("max", F.col("__sample"))}).where(F.col("__asked") == 1)
    place = F.col("__number") - F.col("__at.__first")
    inside = (F.col("__number") >= 0) & (place < F.col("__at.__chunks"))
    found = {
        key: F.col("__at.__key"),
        "chunk": place,
        "start": place * max_len,
        "stop": F.least((place + 1) * max_len, F.col("__at.__length")),
    }
    kept = [c for c in wanted.columns if c not in found]
    return merged.select(*[F.col(f"__row.{c}").alias(c) for c in kept], *[F.when(inside, v).alias(n) for n, v in found.items()])


def reassemble_chunks(
    pieces: DataFrame, expected: DataFrame, key: str, max_len: int, hot: HotGroups | None = None
) -> DataFrame:
    """Rows of chunks back as rows of samples, for samples whose chunks are all present.

    ``pieces`` is ``(key, chunk, pos, …)``, ``expected`` is ``(key, num_chunks)``. Events stay
    rows with their place in the sample, because a whole sample may not fit in one row.
    """
    present = pieces.groupBy(key, "chunk").agg(F.lit(1).alias("__one")).groupBy(key).agg(
        F.count(F.lit(1)).alias("__present")
    )
    complete = present.join(expected, key).where(F.col("__present") == F.col("num_chunks")).select(key)
    # A chunk may be delivered more than once; each of its places counts once.
    kept = attach(pieces, complete, [key], hot=hot).dropDuplicates([key, "chunk", "pos"])
    return kept.withColumn("event_idx", F.col("chunk") * max_len + F.col("pos")).drop("chunk", "pos")


def token_event_time(
    tokens: DataFrame,
    times: DataFrame,
    key: str,
    order: Sequence[str],
    hot: HotGroups | None = None,
) -> DataFrame:
    """Time of each token of a flat stream: its event is the count of SEPs before it.

    ``times`` is ``(key, event_no, time_min)``.
    """
    sep = (F.col("type_id") == S.TYPE_SEP).cast("bigint")
    numbered = running(tokens, [key], order, {"event_no": ("sum", sep, False)}, hot)
    return numbered.join(times, [key, "event_no"])


def minutes_before_last(
    df: DataFrame, key: str, time: str = "time_min", hot: HotGroups | None = None
) -> DataFrame:
    """Replace the time by the minutes before the latest event of the sample."""
    latest = df.groupBy(key).agg(F.max(time).alias("__latest"))
    return attach(df, latest, [key], hot=hot).withColumn(time, F.col("__latest") - F.col(time)).drop("__latest")


def max_sequence_length(stays: DataFrame, length: str, start: str, multiple: int = 128) -> DataFrame:
    longest = F.max(F.col(length) - F.col(start))
    return stays.agg((F.ceil(longest / multiple) * multiple).cast("bigint").alias("max_seq_len"))


def limit_samples(samples: DataFrame, order: Sequence[str], count: int = S.DEBUG_SAMPLES) -> DataFrame:
    return samples.orderBy(*order).limit(count)


def token_cap(chunks: int, chunk_size: int = S.MEMORY_CHUNK, memory: int = S.MEMORY_SIZE) -> int:
    """Tokens that fit in ``chunks`` chunks once the memory slots are taken off."""
    return chunks * (chunk_size - 2 * memory)


def cap_tokens_by_chunks(tokens: DataFrame, key: str, order: Sequence[Column], chunks: int, **sizes) -> DataFrame:
    """The last tokens of each stay that fit in the chunks; ``order`` is latest first."""
    return row_in_window(tokens, [key], order, token_cap(chunks, **sizes)).drop("rank")


def _pad_batch(df: DataFrame, batch: str, values: str, target: Column, pad, fill: Column) -> DataFrame:
    # A batch is a handful of samples, so joining its longest back is an even join.
    longest = df.groupBy(batch).agg(F.max(F.size(values)).alias("__longest"))
    sized = df.join(longest, batch).withColumn("padded_to", target)
    return sized.withColumn(values, pad(F.col(values), F.col("padded_to"), fill)).drop("__longest")


def pad_pow2(
    df: DataFrame, batch: str, values: str, cap: int = S.MAX_SEQ_LEN, fill: Column | None = None, left: bool = False
) -> DataFrame:
    """Pad the arrays of a batch to a power of two that holds the longest, at most ``cap``."""
    target = next_power_of_two(F.col("__longest"), cap)
    return _pad_batch(df, batch, values, target, pad_left if left else pad_right, _zero(fill))


def pad_multiple(
    df: DataFrame,
    batch: str,
    values: str,
    chunk: int = S.PAD_CHUNK,
    fill: Column | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Pad the arrays of a batch to a multiple of the chunk; with ``cap``, of its power of two."""
    length = F.col("__longest") if cap is None else next_power_of_two(F.col("__longest"), cap)
    return _pad_batch(df, batch, values, next_multiple(length, chunk), pad_right, _zero(fill))


def _zero(fill: Column | None) -> Column:
    return F.lit(0) if fill is None else fill


def stay_lengths(stays: DataFrame, column: str = "time") -> DataFrame:
    """Length of a list stored as text; an empty list has length 0."""
    return stays.withColumn("n_events", F.size(F.from_json(column, "array<int>")))


def split_filter(stays: DataFrame, split: str, column: str = "split_2020") -> DataFrame:
    return stays.where(F.col(column) == split)


def stay_key(stays: DataFrame, source: str) -> DataFrame:
    return stays.withColumnRenamed(S.STAY_KEYS[source], "stay_id")
