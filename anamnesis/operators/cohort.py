"""Cohort building: events before a prediction time become a sample.

Without a lower time bound a sample is a prefix of its subject's ordered events.
The place and the elapsed minutes of an event are therefore the same in every
sample it enters, and are computed once per event, before events and samples meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.functions.time import elapsed_minutes, whole_seconds
from anamnesis.operators.skew import HotGroups, attach, explode_range, find_hot, running
from anamnesis.sources.workspace import materialise

SUBJECT = "subject_id"
BLOCK_SAMPLES = 1024
#: Descriptions, a line of text each, up to which a dictionary of codes is broadcast.
BROADCAST_CODES = 200_000


def drop_birth_and_static(events: DataFrame, birth_code: str = S.BIRTH_CODE) -> DataFrame:
    """Drop birth events and events without subject or time; an event without code stays.

    Written as plain comparisons, which reach the Parquet scan.
    """
    not_birth = F.col("code").isNull() | (F.col("code") != birth_code)
    return events.where(F.col(SUBJECT).isNotNull() & F.col("time").isNotNull() & not_birth)


def birth_code_warning(codes: DataFrame, birth_code: str = S.BIRTH_CODE) -> DataFrame:
    """One row naming the birth code when the code dictionary does not have it."""
    known = codes.agg(F.coalesce(F.bool_or(F.col("code") == birth_code), F.lit(False)).alias("known"))
    return known.where(~F.col("known")).select(
        F.lit(birth_code).alias("code"), F.lit("not in the code dictionary").alias("warning")
    )


def drop_unlabelled(cohort: DataFrame, label: str = "boolean_value") -> DataFrame:
    return cohort.where(F.col(label).isNotNull())


def project_cohort(cohort: DataFrame, label: str = "boolean_value") -> DataFrame:
    return cohort.select(
        SUBJECT, F.col(label).alias("label"), F.col("prediction_time").alias("endtime")
    )


def prepare_cohort(cohort: DataFrame, label: str = "boolean_value") -> DataFrame:
    """Labelled predictions, one row per (subject, end time, label)."""
    return project_cohort(drop_unlabelled(cohort, label), label).distinct()


def truncate_seconds(events: DataFrame) -> DataFrame:
    return events.withColumn("time", whole_seconds(F.col("time")))


def describe_codes(events: DataFrame, codes: DataFrame) -> DataFrame:
    """Replace a code by its description where that is neither null nor empty.

    A dictionary of up to ``BROADCAST_CODES`` is broadcast, so a code that most events have is no key of a shuffle. With a
    longer one, the events of frequent codes meet their descriptions on a route of their own.
    """
    names = codes.where(F.col("description") != "").select(
        "code", F.col("description").alias("__description")
    )
    if names.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES:
        described = events.join(F.broadcast(names), "code", "left")
    else:
        described = attach(events, names, ["code"], "left")
    return described.withColumn("code", F.coalesce("__description", "code")).select(*events.columns)


def order_events(
    events: DataFrame, tie: Sequence[str], hot: HotGroups | None = None
) -> DataFrame:
    """Number the events of each subject by time and give their elapsed minutes."""
    ranked = running(
        events,
        [SUBJECT],
        ["time", *tie],
        {
            "__place": ("sum", F.lit(1).cast("bigint")),
            "__first": ("min", F.col("time")),
        },
        hot,
    )
    return ranked.withColumns(
        {
            "event_idx": F.col("__place") - 1,
            "time_min": elapsed_minutes(F.col("__first"), F.col("time")),
        }
    ).drop("__place", "__first")


def number_samples(samples: DataFrame, hot: HotGroups | None = None) -> DataFrame:
    """0-based number of each sample within its subject, and the sample id."""
    numbered = running(
        samples,
        [SUBJECT],
        ["endtime", "label"],
        {"__count": ("sum", F.lit(1).cast("bigint"))},
        hot,
    )
    number = F.col("__count") - 1
    return numbered.withColumns(
        {
            "sample_no": number,
            "sample_id": F.concat_ws("_", F.col(SUBJECT).cast("string"), number.cast("string")),
        }
    ).drop("__count")


def history_marks(events: DataFrame, cohort: DataFrame) -> DataFrame:
    happened = events.select(
        SUBJECT,
        F.col("time").alias("endtime"),
        F.lit(None).cast(cohort.schema["label"].dataType).alias("label"),
        F.lit(1).cast("bigint").alias("is_event"),
    )
    asked = cohort.select(SUBJECT, "endtime", "label", F.lit(0).cast("bigint").alias("is_event"))
    return happened.unionByName(asked)


def sample_index(
    events: DataFrame, cohort: DataFrame, hot: HotGroups | None = None
) -> DataFrame:
    """One row per sample with the extent of its history, without joining any pair.

    Events and predictions are merged into one time line per subject. At a prediction,
    the running count of events is the size of its history. Columns: ``sample_id,
    subject_id, sample_no, endtime, label, n_events, first_time, last_time``.
    """
    marks = history_marks(events, cohort)
    hot = find_hot(marks, [SUBJECT]) if hot is None else hot
    event_time = F.when(F.col("is_event") == 1, F.col("endtime"))
    # An event at the very prediction time belongs to the history: it sorts first.
    line = running(
        marks,
        [SUBJECT],
        ["endtime", F.desc("is_event"), "label"],
        {
            "n_events": ("sum", F.col("is_event")),
            "first_time": ("min", event_time),
            "last_time": ("max", event_time),
        },
        hot,
    )
    samples = line.where((F.col("is_event") == 0) & (F.col("n_events") > 0)).drop("is_event")
    return number_samples(samples, hot)


def history_span(index: DataFrame) -> DataFrame:
    """How many events of history each prediction has, and how many minutes they span."""
    return index.select(
        "sample_id",
        "label",
        "n_events",
        elapsed_minutes(F.col("first_time"), F.col("last_time")).alias("span_minutes"),
    )


def join_history(
    events: DataFrame,
    samples: DataFrame,
    chunk_events: int = S.ENCODE_CHUNK,
    block_samples: int = BLOCK_SAMPLES,
) -> DataFrame:
    """Every sample with each event of its history (``events`` come from ``order_events``).

    ``samples`` is used twice and best written first (``materialise``): it is small.

    A sample holds the events ``from_idx <= event_idx < n_events`` of its subject
    (``from_idx`` is optional and 0 without it). Events are cut into chunks and samples
    into blocks, and the join runs on (subject, chunk, block): no key meets more than
    chunk x block rows, and each sample names only the chunks that its history touches.
    Events of a chunk that no sample needs are dropped by the first join, on (subject, chunk).
    """
    if "from_idx" not in samples.columns:
        samples = samples.withColumn("from_idx", F.lit(0).cast("bigint"))

    def block_of(number: Column) -> Column:
        return F.floor(number / block_samples)

    def chunk_of(place: Column) -> Column:
        return F.floor(place / chunk_events)

    wanted = explode_range(
        samples.withColumn("block", block_of(F.col("sample_no"))),
        "chunk",
        chunk_of(F.col("from_idx")),
        chunk_of(F.col("n_events") - 1),
    )
    # A chunk goes to the blocks from the first to the last that need it, and to none if none does.
    needed = wanted.groupBy(SUBJECT, "chunk").agg(F.min("block").alias("__from"), F.max("block").alias("__to"))
    chunked = events.withColumn("chunk", chunk_of(F.col("event_idx"))).join(needed, [SUBJECT, "chunk"])
    have = explode_range(chunked, "block", F.col("__from"), F.col("__to")).drop("__from", "__to")
    inside = (F.col("event_idx") >= F.col("from_idx")) & (F.col("event_idx") < F.col("n_events"))
    return have.join(wanted, [SUBJECT, "chunk", "block"]).where(inside)


def tail_of(samples: DataFrame, max_events: int) -> DataFrame:
    """Restrict each sample to its last ``max_events`` events."""
    return samples.withColumn(
        "from_idx", F.greatest(F.col("n_events") - max_events, F.lit(0).cast("bigint"))
    )


def assemble_samples(
    joined: DataFrame,
    fields: Sequence[str],
    sample_fields: Sequence[str] = ("sample_id", "label"),
) -> DataFrame:
    """Nested samples: the ordered events of each (sample, chunk) of a joined history.

    A nested row holds the events of one chunk, whatever the length of the history.
    Grouping by the join keys first keeps the rows where the join left them.
    """
    keys = [SUBJECT, "chunk", "block", *sample_fields]
    event = F.struct("event_idx", *fields)
    return (
        joined.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(event)).alias("events"))
        .select(*sample_fields, "chunk", "events")
    )


def events_per_sample(index: DataFrame) -> DataFrame:
    return index.select("sample_id", "n_events")


def in_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], size: int
) -> DataFrame:
    """Ordered lists per key, cut into parts of at most ``size`` rows."""
    # A large group needs a large first key, which takes less to count.
    hot = find_hot(df, keys[:1])
    if hot and len(keys) > 1:
        hot = find_hot(hot.inside(df), keys)
    placed = running(df, keys, order, {"__place": ("sum", F.lit(1).cast("bigint"))}, hot)
    part = F.floor((F.col("__place") - 1) / size)
    return (
        placed.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(F.struct("__place", *fields))).alias("__rows"))
        .select(*keys, "part", *[F.col(f"__rows.{f}").alias(f) for f in fields])
    )


def group_events_by_time(events: DataFrame, order: Sequence[str], size: int = S.ENCODE_CHUNK) -> DataFrame:
    """Events of the same subject and time, all other columns as lists in input order."""
    fields = [c for c in events.columns if c not in (SUBJECT, "time")]
    return in_parts(events, [SUBJECT, "time"], order, fields, size)


def cohort_by_subject(cohort: DataFrame, size: int = S.ENCODE_CHUNK) -> DataFrame:
    """End times and labels of each subject as lists."""
    return in_parts(cohort, [SUBJECT], ["endtime", "label"], ["endtime", "label"], size)


def first_seen_order(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Place of each group by its first row in (order), counted over the whole table."""
    first = F.min(F.struct(*order)).alias("__first")
    groups = events.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n_rows"))
    placed = running(
        groups,
        [],
        [F.col(f"__first.{o}") for o in order] + [F.col(k) for k in keys],
        {"__place": ("sum", F.lit(1).cast("bigint"))},
    )
    return placed.withColumn("place", F.col("__place") - 1).drop("__place", "__first")


def subject_ids(events: DataFrame) -> DataFrame:
    return events.select(SUBJECT).distinct()


def keep_subjects(events: DataFrame, subjects: DataFrame) -> DataFrame:
    return events.join(subjects.select(SUBJECT), SUBJECT, "left_semi")


def shard_of(subject: Column | str, shards: int) -> Column:
    """The shard that all rows of a subject are written to."""
    return F.pmod(F.xxhash64(subject), F.lit(shards)).cast("int")


def worker_lists(events: DataFrame, workers: int) -> DataFrame:
    """``(subject_id, n_events, worker)``: subjects in order, cut into lists of nearly equal numbers of events.

    A subject goes to the worker in whose share of all events its middle event lies, so a list differs from an equal
    share by no more than half of the subjects at its ends. All of a subject's events have one worker.
    """
    counts = materialise(events.groupBy(SUBJECT).agg(F.count(F.lit(1)).alias("n_events")), "counts")
    placed = running(counts, [], [SUBJECT], {"__before": ("sum", F.col("n_events"), False)})
    total = counts.agg(F.sum("n_events")).first()[0] or 1
    worker = F.floor((2 * F.col("__before") + F.col("n_events")) * workers / F.lit(2 * total)).cast("int")
    return placed.select(SUBJECT, "n_events", worker.alias("worker"))


def latest_description(codes: DataFrame, order: Column) -> DataFrame:
    """One description per code: the last in order wins."""
    return codes.groupBy("code").agg(F.max_by("description", order).alias("description"))
