"""Cohort queries: predicates, joins, aggregations and numbering on events and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis.functions.text import event_fields
from anamnesis.operators import cohort as C
from anamnesis.operators import predict as P
from anamnesis.operators import sequence as Q
from anamnesis.operators.skew import find_hot, running
from anamnesis.plans import fixtures as X
from anamnesis.registry import register_operator as query
from anamnesis.sources.workspace import materialise

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def stamp(column: str):
    return F.date_format(column, STAMP).alias(column)


def stamp_sql(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name or column}"


def histories(spark, sf_dir):
    """Placed events and the written sample index, with the hot subjects looked up once."""
    events, cohort = X.kept(spark, sf_dir), X.cohort(spark, sf_dir)
    hot = find_hot(C.history_marks(events, cohort), [C.SUBJECT])
    index = materialise(C.sample_index(events, cohort, hot), "index")
    return C.order_events(events, X.TIE, hot), index, hot


def joined(spark, sf_dir, *columns):
    events, samples, hot = histories(spark, sf_dir)
    narrow = events.select("subject_id", "event_idx", *columns)
    return C.join_history(narrow, samples)


@query(
    "history_span",
    "WITH " + X.JOINED_SQL + """
SELECT sample_id, label, count(*) AS n_events, max(time_min) AS span_minutes
FROM joined GROUP BY sample_id, label""",
)
def history_span(spark, sf_dir):
    index = C.sample_index(X.kept(spark, sf_dir), X.cohort(spark, sf_dir))
    return C.history_span(index).withColumn("span_minutes", F.col("span_minutes").cast("bigint"))


@query(
    "drop_birth_and_static",
    "WITH " + X.KEPT_SQL + f" SELECT subject_id, {stamp_sql('time')}, code, numeric_value, event_id FROM kept",
)
def drop_birth_and_static(spark, sf_dir):
    return X.kept(spark, sf_dir).select("subject_id", stamp("time"), "code", "numeric_value", "event_id")


@query(
    "birth_code_warning",
    """SELECT 'MEDS_BIRTH' AS code, 'not in the code dictionary' AS warning
FROM (SELECT coalesce(bool_or(event_type = 'MEDS_BIRTH'), false) AS known FROM events) WHERE NOT known""",
)
def birth_code_warning(spark, sf_dir):
    return C.birth_code_warning(X.meds(spark, sf_dir).select("code"))


@query(
    "drop_unlabelled",
    "WITH " + X.RAW_COHORT_SQL
    + f" SELECT subject_id, {stamp_sql('prediction_time')}, boolean_value FROM raw_cohort WHERE boolean_value IS NOT NULL",
)
def drop_unlabelled(spark, sf_dir):
    rows = C.drop_unlabelled(X.raw_cohort(spark, sf_dir))
    return rows.select("subject_id", stamp("prediction_time"), "boolean_value")


@query(
    "cohort_project",
    "WITH " + X.RAW_COHORT_SQL
    + f" SELECT subject_id, boolean_value AS label, {stamp_sql('prediction_time', 'endtime')} FROM raw_cohort",
)
def cohort_project(spark, sf_dir):
    rows = C.project_cohort(X.raw_cohort(spark, sf_dir))
    return rows.select("subject_id", "label", stamp("endtime"))


@query(
    "truncate_seconds",
    "WITH " + X.MEDS_SQL + " SELECT event_id, " + stamp_sql("date_trunc('second', time)", "time") + " FROM meds",
)
def truncate_seconds(spark, sf_dir):
    return C.truncate_seconds(X.meds(spark, sf_dir)).select("event_id", stamp("time"))


@query(
    "event_fields",
    """SELECT 'code,numeric_value,props,event_id' AS fields, count(*) AS n_events,
       count(event_type) + count(value) + count(props) + count(event_id) AS n_values FROM events""",
)
def event_fields_query(spark, sf_dir):
    events = X.meds(spark, sf_dir)
    names = [f.name for f in event_fields(events.schema)]
    values = sum((F.count(n) for n in names[1:]), F.count(names[0]))
    return events.agg(
        F.lit(",".join(names)).alias("fields"),
        F.count(F.lit(1)).alias("n_events"),
        values.alias("n_values"),
    )


@query(
    "cohort_event_join",
    "WITH " + X.JOINED_SQL + f" SELECT sample_id, event_idx, event_id, label, {stamp_sql('time')} FROM joined",
)
def cohort_event_join(spark, sf_dir):
    return joined(spark, sf_dir, "event_id", "time").select(
        "sample_id", "event_idx", "event_id", "label", stamp("time")
    )


CODES_SQL = f"codes(code, description) AS (VALUES {X.CODES})"


@query(
    "describe_codes",
    "WITH " + X.KEPT_SQL + ",\n" + CODES_SQL + """
SELECT event_id, coalesce(nullif(d.description, ''), k.code) AS code
FROM kept k LEFT JOIN codes d ON k.code = d.code""",
)
def describe_codes(spark, sf_dir):
    return C.describe_codes(X.kept(spark, sf_dir), X.codes(spark)).select("event_id", "code")


PREDICTED_SQL = """predictions AS (
  SELECT sample_id, CAST(count(*) AS DOUBLE) / (count(*) + 10) AS boolean_prediction
  FROM joined GROUP BY sample_id HAVING count(*) >= 5)"""


def predictions(index):
    """A score per sample with at least five events, from the length of its history."""
    n = F.col("n_events").cast("double")
    return index.where(F.col("n_events") >= 5).select(
        "sample_id", (n / (n + 10)).alias("boolean_prediction")
    )


@query(
    "attach_predictions",
    "WITH " + X.JOINED_SQL + ",\n" + PREDICTED_SQL + f"""
SELECT s.sample_id, s.label, {stamp_sql('s.endtime', 'endtime')}, round(p.boolean_prediction, 6) AS boolean_prediction
FROM (SELECT DISTINCT sample_id, label, endtime FROM joined) s
LEFT JOIN predictions p ON s.sample_id = p.sample_id""",
)
def attach_predictions(spark, sf_dir):
    _, index, _ = histories(spark, sf_dir)
    cohort = index.select("sample_id", "label", stamp("endtime"))
    return P.attach_predictions(cohort, predictions(index)).withColumn(
        "boolean_prediction", F.round("boolean_prediction", 6)
    )


ALL_IDS_SQL = """all_ids AS (
  SELECT CAST(subject_id AS VARCHAR) || '_' ||
         CAST(row_number() OVER (PARTITION BY subject_id ORDER BY prediction_time, boolean_value NULLS FIRST) - 1
              AS VARCHAR) AS sample_id
  FROM (SELECT DISTINCT * FROM raw_cohort)),
data_ids AS (SELECT DISTINCT sample_id FROM joined)"""


@query(
    "check_id_sets",
    "WITH " + X.JOINED_SQL + ",\n" + ALL_IDS_SQL + """
SELECT sample_id, 'data' AS found_in FROM data_ids WHERE sample_id NOT IN (SELECT sample_id FROM all_ids)
UNION ALL
SELECT sample_id, 'cohort' FROM all_ids WHERE sample_id NOT IN (SELECT sample_id FROM data_ids)""",
)
def check_id_sets(spark, sf_dir):
    """Ids of the built samples against ids counted over all predictions, labelled or not."""
    _, index, hot = histories(spark, sf_dir)
    everyone = C.project_cohort(X.raw_cohort(spark, sf_dir)).distinct()
    return P.check_id_sets(index, C.number_samples(everyone, hot))


@query(
    "id_set_equality",
    "WITH " + X.KEPT_SQL + ",\n" + X.COHORT_SQL + """,
positive AS (SELECT DISTINCT subject_id FROM cohort WHERE label)
SELECT subject_id, 'left' AS side FROM (SELECT subject_id FROM kept EXCEPT SELECT subject_id FROM positive)
UNION ALL
SELECT subject_id, 'right' FROM (SELECT subject_id FROM positive EXCEPT SELECT subject_id FROM kept)""",
)
def id_set_equality(spark, sf_dir):
    events = C.subject_ids(X.kept(spark, sf_dir))
    return P.id_set_difference(events, C.subject_ids(X.cohort(spark, sf_dir).where("label")))


@query(
    "partition_subjects",
    "WITH " + X.KEPT_SQL + """
SELECT subject_id, CAST(1 AS BIGINT) AS n_workers, count(*) AS n_events FROM kept GROUP BY subject_id""",
)
def partition_subjects(spark, sf_dir):
    """The shards that the rows of a subject are written to: always one."""
    parts = X.kept(spark, sf_dir).withColumn("shard_id", C.shard_of("subject_id", 8))
    per_shard = parts.groupBy("subject_id", "shard_id").agg(F.count(F.lit(1)).alias("n"))
    return per_shard.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_workers"), F.sum("n").alias("n_events")
    )


@query(
    "worker_lists",
    "WITH " + X.KEPT_SQL + """,
counts AS (SELECT subject_id, count(*) AS n_events FROM kept GROUP BY subject_id),
placed AS (SELECT *, coalesce(sum(n_events) OVER (ORDER BY subject_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
           sum(n_events) OVER () AS total FROM counts)
SELECT subject_id, n_events, CAST((2 * before + n_events) * 8 // (2 * total) AS INT) AS worker FROM placed""",
)
def worker_lists(spark, sf_dir):
    """Eight lists of subjects with nearly equal numbers of events."""
    return C.worker_lists(X.kept(spark, sf_dir), 8)


def _list_text(name: str, item):
    return F.array_join(F.transform(F.col(name), item), ",").alias(name)


@query(
    "group_events_by_time",
    "WITH " + X.KEPT_SQL + f""",
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY subject_id, time ORDER BY event_id) - 1) // 1024 AS part FROM kept)
SELECT subject_id, {stamp_sql('time')}, CAST(part AS BIGINT) AS part,
       string_agg(code, ',' ORDER BY event_id) AS code,
       string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS event_id
FROM placed GROUP BY subject_id, time, part""",
)
def group_events_by_time(spark, sf_dir):
    groups = C.group_events_by_time(X.kept(spark, sf_dir), X.TIE)
    return groups.select(
        "subject_id",
        stamp("time"),
        "part",
        F.array_join("code", ",").alias("code"),
        _list_text("event_id", lambda x: x.cast("string")),
    )


@query(
    "cohort_by_subject",
    "WITH " + X.COHORT_SQL + """,
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY subject_id ORDER BY endtime, label) - 1) // 1024 AS part FROM cohort)
SELECT subject_id, CAST(part AS BIGINT) AS part,
       string_agg(strftime(endtime, '%Y-%m-%d %H:%M:%S.%f'), ',' ORDER BY endtime, label) AS endtime,
       string_agg(CAST(label AS VARCHAR), ',' ORDER BY endtime, label) AS label
FROM placed GROUP BY subject_id, part""",
)
def cohort_by_subject(spark, sf_dir):
    lists = C.cohort_by_subject(X.cohort(spark, sf_dir))
    return lists.select(
        "subject_id",
        "part",
        _list_text("endtime", lambda x: F.date_format(x, STAMP)),
        _list_text("label", lambda x: x.cast("string")),
    )


@query(
    "assemble_samples",
    "WITH " + X.JOINED_SQL + """
SELECT sample_id, label, event_idx // 1024 AS chunk, count(*) AS n_events,
       string_agg(CAST(event_id AS VARCHAR) || ':' || CAST(time_min AS VARCHAR), ',' ORDER BY event_idx) AS events
FROM joined GROUP BY sample_id, label, event_idx // 1024""",
)
def assemble_samples(spark, sf_dir):
    fields = ["event_id", "time_min"]
    nested = C.assemble_samples(joined(spark, sf_dir, *fields), fields)
    return nested.select(
        "sample_id",
        "label",
        "chunk",
        F.size("events").cast("bigint").alias("n_events"),
        _list_text("events", lambda e: F.concat_ws(":", e["event_id"].cast("string"), e["time_min"].cast("string"))),
    )


@query(
    "events_per_sample",
    "WITH " + X.JOINED_SQL + " SELECT sample_id, count(*) AS n_events FROM joined GROUP BY sample_id",
)
def events_per_sample(spark, sf_dir):
    return C.events_per_sample(C.sample_index(X.kept(spark, sf_dir), X.cohort(spark, sf_dir)))


@query(
    "number_samples",
    "WITH " + X.JOINED_SQL + f" SELECT DISTINCT subject_id, {stamp_sql('endtime')}, label, sample_no, sample_id FROM joined",
)
def number_samples(spark, sf_dir):
    index = C.sample_index(X.kept(spark, sf_dir), X.cohort(spark, sf_dir))
    return index.select("subject_id", stamp("endtime"), "label", "sample_no", "sample_id")


@query(
    "elapsed_minutes",
    "WITH " + X.JOINED_SQL + " SELECT sample_id, event_id, time_min FROM joined",
)
def elapsed_minutes(spark, sf_dir):
    return joined(spark, sf_dir, "event_id", "time_min").select(
        "sample_id", "event_id", F.col("time_min").cast("bigint").alias("time_min")
    )


@query(
    "event_index",
    "WITH " + X.JOINED_SQL + """,
lengths AS (SELECT DISTINCT subject_id, sample_no, sample_id, n_events FROM joined),
starts AS (
  SELECT *, sum(n_events) OVER (ORDER BY subject_id, sample_no) - n_events AS start FROM lengths)
SELECT j.sample_id, j.event_id, j.event_idx, CAST(s.start + j.event_idx AS BIGINT) AS flat_offset
FROM joined j JOIN starts s ON j.sample_id = s.sample_id""",
)
def event_index(spark, sf_dir):
    events, samples, hot = histories(spark, sf_dir)
    started = running(
        samples, [], ["subject_id", "sample_no"], {"start": ("sum", F.col("n_events"), False)}
    )
    rows = C.join_history(events.select("subject_id", "event_idx", "event_id"), started)
    return rows.select(
        "sample_id", "event_id", "event_idx", (F.col("start") + F.col("event_idx")).alias("flat_offset")
    )


@query(
    "first_seen_order",
    "WITH " + X.KEPT_SQL + """,
firsts AS (
  SELECT subject_id, code, min(event_id) AS first, count(*) AS n_rows FROM kept GROUP BY subject_id, code)
SELECT subject_id, code, n_rows, row_number() OVER (ORDER BY first) - 1 AS place FROM firsts""",
)
def first_seen_order(spark, sf_dir):
    return C.first_seen_order(X.kept(spark, sf_dir), ["subject_id", "code"], ["event_id"])


@query(
    "unique_ids",
    "WITH " + X.KEPT_SQL + " SELECT DISTINCT subject_id FROM kept",
)
def unique_ids(spark, sf_dir):
    return C.subject_ids(X.kept(spark, sf_dir))


@query(
    "restore_subject_id",
    "WITH " + X.JOINED_SQL + " SELECT DISTINCT sample_id, subject_id FROM joined",
)
def restore_subject_id(spark, sf_dir):
    index = C.sample_index(X.kept(spark, sf_dir), X.cohort(spark, sf_dir))
    return P.restore_subject_id(index.select("sample_id"))


@query(
    "history_tail",
    "WITH " + X.JOINED_SQL + """
SELECT sample_id, event_id, event_idx FROM joined WHERE event_idx >= n_events - 8""",
)
def history_tail(spark, sf_dir):
    events, samples, hot = histories(spark, sf_dir)
    narrow = events.select("subject_id", "event_idx", "event_id")
    return C.join_history(narrow, C.tail_of(samples, 8)).select("sample_id", "event_id", "event_idx")


@query(
    "history_window",
    "WITH " + X.JOINED_SQL + """
SELECT sample_id, event_id, time_min FROM joined j
WHERE time_min >= 240 * 60 OR (event_idx = n_events - 1 AND NOT EXISTS (
  SELECT 1 FROM joined o WHERE o.sample_id = j.sample_id AND o.time_min >= 240 * 60))""",
)
def history_window(spark, sf_dir):
    events, samples, hot = histories(spark, sf_dir)
    narrow = events.select("subject_id", "event_idx", "event_id", "time_min")
    windowed = Q.window_start(samples, narrow, 240, hot)
    return C.join_history(narrow, windowed).select(
        "sample_id", "event_id", F.col("time_min").cast("bigint").alias("time_min")
    )
