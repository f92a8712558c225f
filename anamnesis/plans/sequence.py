"""Sequence-shaping queries on samples, representations, stays and token streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.functions import arrays as A
from anamnesis.functions.time import time_features as features
from anamnesis.functions.vectors import text_of
from anamnesis.operators import cohort as C
from anamnesis.operators import sequence as Q
from anamnesis.operators.skew import find_hot, hot_rows
from anamnesis.plans import fixtures as X
from anamnesis.plans import tokens as TP
from anamnesis.registry import register_operator as query


def hot_samples(spark, sf_dir):
    return find_hot(X.vectors(spark, sf_dir).select("sample_id"), ["sample_id"])


def placed_vectors(spark, sf_dir, hot=None):
    """Representation rows with their place in the sample."""
    rows = X.vectors(spark, sf_dir).withColumnRenamed("event_idx", "vec_id")
    hot = hot_samples(spark, sf_dir) if hot is None else hot
    return Q.place_events(rows, "sample_id", ["time_min", "vec_id"], hot)


PLACED_VECTORS_SQL = X.VECTORS_SQL + """,
placed AS (
  SELECT sample_id, time_min, event_idx AS vec_id, label, repr,
         row_number() OVER (PARTITION BY sample_id ORDER BY time_min, event_idx) - 1 AS event_idx,
         count(*) OVER (PARTITION BY sample_id) AS n FROM vectors)"""


def subject_events(spark, sf_dir):
    """Placed events of each subject as (subject_id, event_idx, time_min)."""
    events = C.order_events(X.kept(spark, sf_dir), X.TIE)
    return events.select("subject_id", "event_idx", F.col("time_min").cast("bigint").alias("time_min"), "event_id")


@query(
    "observation_window",
    "WITH " + PLACED_VECTORS_SQL + """
SELECT sample_id, vec_id, time_min FROM placed p
WHERE time_min >= 47 * 60 OR (event_idx = n - 1 AND NOT EXISTS (
  SELECT 1 FROM placed o WHERE o.sample_id = p.sample_id AND o.time_min >= 47 * 60))""",
)
def observation_window(spark, sf_dir):
    hot = hot_samples(spark, sf_dir)
    kept = Q.observation_window(placed_vectors(spark, sf_dir, hot), "sample_id", 47, hot=hot)
    return kept.select("sample_id", "vec_id", "time_min")


@query(
    "tail_events",
    "WITH " + PLACED_VECTORS_SQL + " SELECT sample_id, vec_id, event_idx FROM placed WHERE event_idx >= n - 7",
)
def tail_events(spark, sf_dir):
    return Q.tail_events(placed_vectors(spark, sf_dir), "sample_id", 7).select("sample_id", "vec_id", "event_idx")


@query(
    "sample_events",
    "WITH " + PLACED_VECTORS_SQL + """,
drawn AS (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY
    md5(CAST(sample_id AS VARCHAR) || '|' || CAST(event_idx AS VARCHAR) || '|2020'), event_idx) AS r FROM placed)
SELECT sample_id, vec_id, event_idx FROM drawn WHERE r <= 7""",
)
def sample_events(spark, sf_dir):
    drawn = Q.sample_events(placed_vectors(spark, sf_dir), "sample_id", 7, seed=2020)
    return drawn.select("sample_id", "vec_id", "event_idx")


@query(
    "chunk_index",
    "WITH " + X.KEPT_SQL + """,
lengths AS (SELECT subject_id, count(*) AS n, (count(*) + 15) // 16 AS chunks FROM kept GROUP BY subject_id),
starts AS (SELECT *, sum(chunks) OVER (ORDER BY subject_id) - chunks AS first FROM lengths)
SELECT CAST(first + chunk AS BIGINT) AS global_chunk, subject_id, CAST(chunk AS BIGINT) AS chunk,
       CAST(chunk * 16 AS BIGINT) AS start, CAST(least((chunk + 1) * 16, n) AS BIGINT) AS stop
FROM (SELECT *, unnest(range(chunks)) AS chunk FROM starts)""",
)
def chunk_index(spark, sf_dir):
    lengths = X.kept(spark, sf_dir).groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    return Q.chunk_index(lengths, "subject_id", "n", 16)


@query(
    "chunk_lookup",
    "WITH " + X.KEPT_SQL + """,
lengths AS (SELECT subject_id, count(*) AS n, (count(*) + 15) // 16 AS chunks FROM kept GROUP BY subject_id),
starts AS (SELECT *, CAST(sum(chunks) OVER (ORDER BY subject_id) - chunks AS BIGINT) AS first FROM lengths),
wanted AS (SELECT event_id, event_id % 251 - 2 AS global_chunk FROM kept)
SELECT event_id, global_chunk, subject_id, global_chunk - first AS chunk, CAST((global_chunk - first) * 16 AS BIGINT) AS start,
       CAST(least((global_chunk - first + 1) * 16, n) AS BIGINT) AS stop
FROM wanted LEFT JOIN starts ON global_chunk >= first AND global_chunk < first + chunks""",
)
def chunk_lookup(spark, sf_dir):
    """The chunks that given numbers name, one number for each event: many repeat, some name no chunk."""
    kept = X.kept(spark, sf_dir)
    lengths = kept.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = kept.select("event_id", (F.col("event_id") % 251 - 2).alias("global_chunk"))
    return Q.chunk_lookup(lengths, wanted, "subject_id", "n", 16)


@query(
    "reassemble_chunks",
    "WITH " + PLACED_VECTORS_SQL + """,
gone AS (SELECT DISTINCT sample_id, event_idx // 6 AS chunk FROM placed WHERE label = 7 AND event_idx % 6 = 0)
SELECT sample_id, event_idx, vec_id FROM placed
WHERE sample_id NOT IN (SELECT sample_id FROM gone)""",
)
def reassemble_chunks(spark, sf_dir):
    """Chunks of six events; a chunk that starts with class 7 went missing."""
    hot = hot_samples(spark, sf_dir)
    rows = placed_vectors(spark, sf_dir, hot).withColumns(
        {"chunk": F.floor(F.col("event_idx") / 6), "pos": F.col("event_idx") % 6}
    )
    sizes = rows.groupBy("sample_id").agg((F.max("chunk") + 1).alias("num_chunks"))
    gone = rows.where((F.col("label") == 7) & (F.col("pos") == 0)).select("sample_id", "chunk")
    pieces = rows.drop("event_idx").join(gone, ["sample_id", "chunk"], "left_anti")
    whole = Q.reassemble_chunks(pieces, sizes, "sample_id", 6, hot)
    return whole.select("sample_id", "event_idx", "vec_id")


@query(
    "token_event_time",
    "WITH " + TP.ROWS_SQL + """,
times AS (
  SELECT subject_id, event_id, row_number() OVER w - 1 AS event_no,
         CAST(round_even(date_diff('second', date_trunc('second', min(time) OVER (PARTITION BY subject_id)),
                                   date_trunc('second', time)) / 60.0, 0) AS BIGINT) AS time_min
  FROM kept WINDOW w AS (PARTITION BY subject_id ORDER BY time, event_id))
SELECT r.event_id, CAST(r.pos AS BIGINT) AS pos, r.type_id, t.time_min
FROM token_rows r JOIN times t ON r.event_id = t.event_id""",
)
def token_event_time(spark, sf_dir):
    """The time of a token is found from the separators before it, not from its event id."""
    kept = X.kept(spark, sf_dir)
    # The events stand for their tokens in the size check; an event has at most so many.
    hot = find_hot(kept, ["subject_id"], hot_rows(spark) // S.MAX_EVENT_TOKENS)
    placed = C.order_events(kept, X.TIE, hot)
    events = TP.K.tokenize(placed, (*TP.NOT_FIELDS_OR_IDS, "event_idx", "time_min"))
    stream = TP.K.token_rows(events, ["subject_id", "event_id", "event_idx"])
    times = placed.select(
        "subject_id", F.col("event_idx").alias("event_no"), F.col("time_min").cast("bigint").alias("time_min")
    )
    timed = Q.token_event_time(stream, times, "subject_id", ["event_idx", "pos"], hot)
    return timed.select("event_id", F.col("pos").cast("bigint").alias("pos"), "type_id", "time_min")


@query(
    "minutes_before_last",
    "WITH " + X.VECTORS_SQL + """
SELECT sample_id, event_idx, max(time_min) OVER (PARTITION BY sample_id) - time_min AS time_min FROM vectors""",
)
def minutes_before_last(spark, sf_dir):
    return Q.minutes_before_last(X.vectors(spark, sf_dir), "sample_id").select("sample_id", "event_idx", "time_min")


@query(
    "max_sequence_length",
    "WITH " + X.PLACED_SQL + """
SELECT CAST(ceil(max(n - before) / 128.0) * 128 AS BIGINT) AS max_seq_len
FROM (SELECT subject_id, count(*) AS n, count(*) FILTER (time_min < 24 * 60) AS before FROM placed GROUP BY subject_id)""",
)
def max_sequence_length(spark, sf_dir):
    stays = subject_events(spark, sf_dir).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("time_min") < 24 * 60).alias("before")
    )
    return Q.max_sequence_length(stays, "n", "before")


@query(
    "limit_debug",
    "WITH " + X.JOINED_SQL + """
SELECT DISTINCT subject_id, sample_no, sample_id, n_events FROM joined ORDER BY subject_id, sample_no LIMIT 3000""",
)
def limit_debug(spark, sf_dir):
    index = C.sample_index(X.kept(spark, sf_dir), X.cohort(spark, sf_dir))
    rows = index.select("subject_id", "sample_no", "sample_id", "n_events")
    return Q.limit_samples(rows, ["subject_id", "sample_no"])


@query(
    "limit_debug_few",
    "WITH " + X.JOINED_SQL + """
SELECT DISTINCT subject_id, sample_no, sample_id, n_events FROM joined ORDER BY subject_id, sample_no LIMIT 50""",
)
def limit_debug_few(spark, sf_dir):
    """The same with a limit below the number of samples of the given tables."""
    index = C.sample_index(X.kept(spark, sf_dir), X.cohort(spark, sf_dir))
    rows = index.select("subject_id", "sample_no", "sample_id", "n_events")
    return Q.limit_samples(rows, ["subject_id", "sample_no"], count=50)


@query(
    "cap_tokens_by_chunks",
    "WITH " + TP.ROWS_SQL + """,
ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY r.subject_id ORDER BY k.time DESC, r.event_id DESC, pos DESC) AS r
  FROM token_rows r JOIN kept k ON r.event_id = k.event_id)
SELECT subject_id, event_id, CAST(pos AS BIGINT) AS pos, token FROM ranked WHERE r <= 492""",
)
def cap_tokens_by_chunks(spark, sf_dir):
    events = TP.tokenized(spark, sf_dir, TP.NOT_FIELDS_OR_IDS)
    rows = TP.K.token_rows(events, ["subject_id", "time", "event_id"])
    latest_first = [F.desc("time"), F.desc("event_id"), F.desc("pos")]
    capped = Q.cap_tokens_by_chunks(rows, "subject_id", latest_first, chunks=1)
    return capped.select("subject_id", "event_id", F.col("pos").cast("bigint").alias("pos"), "token")


# --- padding: the event times of each subject, eight subjects per batch ------------------


def batches(spark, sf_dir):
    lists = subject_events(spark, sf_dir).groupBy("subject_id").agg(
        F.sort_array(F.collect_list(F.struct("event_idx", "time_min"))).alias("__rows")
    )
    return lists.select(
        "subject_id",
        F.floor(F.col("subject_id") / 8).alias("batch"),
        F.col("__rows.time_min").alias("times"),
    )


BATCHES_SQL = X.PLACED_SQL + """,
lists AS (
  SELECT subject_id, subject_id // 8 AS batch, list(time_min ORDER BY event_idx) AS times
  FROM placed GROUP BY subject_id),
sized AS (SELECT *, max(len(times)) OVER (PARTITION BY batch) AS longest FROM lists)"""

RIGHT_SQL = """SELECT subject_id, CAST({size} AS BIGINT) AS padded_to,
  array_to_string(list_slice(list_concat(times, list_transform(range({size}), lambda i: CAST(0 AS BIGINT))), 1, {size}), ',') AS times
FROM {source}"""


def padded_text(df):
    return df.select(
        "subject_id",
        F.col("padded_to").cast("bigint").alias("padded_to"),
        F.array_join(F.col("times").cast("array<string>"), ",").alias("times"),
    )


POW2_SQL = "powers AS (SELECT *, CAST(least(pow(2, ceil(log2(longest))), 32) AS BIGINT) AS size FROM sized)"


@query("pad_pow2", "WITH " + BATCHES_SQL + ",\n" + POW2_SQL + "\n" + RIGHT_SQL.format(size="size", source="powers"))
def pad_pow2(spark, sf_dir):
    return padded_text(Q.pad_pow2(batches(spark, sf_dir), "batch", "times", cap=32))


@query(
    "pad_left",
    "WITH " + BATCHES_SQL + """,
powers AS (SELECT *, CAST(least(pow(2, ceil(log2(longest))), 64) AS BIGINT) AS size FROM sized)
SELECT subject_id, size AS padded_to,
  array_to_string(list_concat(list_transform(range(greatest(size - len(times), 0)), lambda i: CAST(0 AS BIGINT)),
    list_slice(times, greatest(len(times) - size, 0) + 1, len(times))), ',') AS times
FROM powers""",
)
def pad_left(spark, sf_dir):
    return padded_text(Q.pad_pow2(batches(spark, sf_dir), "batch", "times", cap=64, left=True))


@query(
    "pad_multiple",
    "WITH " + BATCHES_SQL + ",\nmultiples AS (SELECT *, CAST(ceil(longest / 20.0) * 20 AS BIGINT) AS size FROM sized)\n"
    + RIGHT_SQL.format(size="size", source="multiples"),
)
def pad_multiple(spark, sf_dir):
    return padded_text(Q.pad_multiple(batches(spark, sf_dir), "batch", "times", chunk=20))


@query(
    "time_features",
    "WITH " + X.VECTORS_SQL + """
SELECT event_idx, array_to_string(flatten(list_transform(range(4), lambda i: [
    CAST(CAST(round(sin((2880 - time_min) * exp(-2 * i * ln(10000.0) / 8)), 6) AS DECIMAL(38, 6)) AS VARCHAR),
    CAST(CAST(round(cos((2880 - time_min) * exp(-2 * i * ln(10000.0) / 8)), 6) AS DECIMAL(38, 6)) AS VARCHAR)])), ',') AS features
FROM vectors""",
)
def time_features(spark, sf_dir):
    rows = X.vectors(spark, sf_dir)
    return rows.select("event_idx", text_of(features(F.col("time_min"), 8, 48)).alias("features"))


@query(
    "encode_labels",
    "WITH " + X.SCORES_SQL + """
SELECT 'binary' AS kind, doc_id AS id, CAST(quality AS VARCHAR) AS encoded FROM scores
UNION ALL
SELECT 'multilabel', doc_id, CASE WHEN greatest(quality, 0) + greatest(toxic, 0) = 0 THEN '-1.0,-1.0'
  ELSE CAST(CAST(greatest(quality, 0) AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(greatest(toxic, 0) AS DOUBLE) AS VARCHAR) END FROM scores
UNION ALL
SELECT 'multiclass', vec_id, array_to_string(list_transform(range(10), lambda c:
  CASE WHEN label = 3 THEN '-1.0' WHEN label = c THEN '1.0' ELSE '0.0' END), ',') FROM embeddings""",
)
def encode_labels(spark, sf_dir):
    """Binary and multilabel from the document labels, multiclass with class 3 unknown."""
    scores, vectors = X.scores(spark, sf_dir), X.vectors(spark, sf_dir)
    present = F.filter(
        F.array(F.when(F.col("quality") == 1, 0), F.when(F.col("toxic") == 1, 1)), lambda c: c.isNotNull()
    )
    known = F.when(F.col("label") != 3, F.col("label"))

    def text(column):
        return F.array_join(column.cast("array<string>"), ",").alias("encoded")

    binary = scores.select(
        F.lit("binary").alias("kind"),
        F.col("doc_id").alias("id"),
        A.binary_label(F.nullif("quality", F.lit(-1))).cast("string").alias("encoded"),
    )
    many = scores.select(F.lit("multilabel"), "doc_id", text(A.multi_hot(present, 2)))
    one = vectors.select(F.lit("multiclass"), "event_idx", text(A.one_hot(known, 10)))
    return binary.union(many).union(one)
