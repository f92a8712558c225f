"""The given tables seen as events, cohorts, representations and scores.

Each mapping exists twice: as a DataFrame and as the SQL of the counterpart query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis.functions.vectors import literal_vector
from anamnesis.operators import cohort as C

BIRTH = "signup"
TIE = ["event_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- events and cohort -------------------------------------------------------------------


def as_meds(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("time"),
        F.col("event_type").alias("code"),
        F.col("value").alias("numeric_value"),
        "props",
        "event_id",
    )


def meds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_meds(table(spark, sf_dir, "events"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_birth_and_static(meds(spark, sf_dir), BIRTH)


def raw_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction at every purchase; small purchases have no outcome."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    outcome = F.when(F.col("value") >= 5, F.col("value") > 50)
    return events.select(
        F.col("user_id").alias("subject_id"),
        F.col("ts").alias("prediction_time"),
        outcome.alias("boolean_value"),
    )


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prepare_cohort(raw_cohort(spark, sf_dir))


def codes(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {CODES} AS codes(code, description)")


CODES = "('click', 'page click'), ('view', ''), ('error', NULL), ('purchase', 'order placed')"

MEDS_SQL = """meds AS (
  SELECT user_id AS subject_id, ts AS time, event_type AS code, value AS numeric_value,
         props, event_id
  FROM events)"""

KEPT_SQL = MEDS_SQL + """,
kept AS (
  SELECT * FROM meds
  WHERE subject_id IS NOT NULL AND time IS NOT NULL AND (code IS NULL OR code <> 'signup'))"""

RAW_COHORT_SQL = """raw_cohort AS (
  SELECT user_id AS subject_id, ts AS prediction_time,
         CASE WHEN value >= 5 THEN value > 50 END AS boolean_value
  FROM events WHERE event_type = 'purchase')"""

COHORT_SQL = RAW_COHORT_SQL + """,
cohort AS (
  SELECT DISTINCT subject_id, boolean_value AS label, prediction_time AS endtime
  FROM raw_cohort WHERE boolean_value IS NOT NULL)"""

# Events of a subject in order, with place and elapsed minutes.
PLACED_SQL = KEPT_SQL + """,
placed AS (
  SELECT *, row_number() OVER w - 1 AS event_idx,
         CAST(round_even(date_diff('second', date_trunc('second', min(time) OVER (PARTITION BY subject_id)),
                                   date_trunc('second', time)) / 60.0, 0) AS BIGINT) AS time_min
  FROM kept WINDOW w AS (PARTITION BY subject_id ORDER BY time, event_id))"""

# Every sample with its events.
JOINED_SQL = PLACED_SQL + ",\n" + COHORT_SQL + """,
pairs AS (
  SELECT e.*, c.endtime, c.label FROM placed e JOIN cohort c
  ON e.subject_id = c.subject_id AND e.time <= c.endtime),
numbers AS (
  SELECT subject_id, endtime, label, count(*) AS n_events,
         row_number() OVER (PARTITION BY subject_id ORDER BY endtime, label) - 1 AS sample_no
  FROM pairs GROUP BY subject_id, endtime, label),
joined AS (
  SELECT p.*, n.n_events, n.sample_no,
         CAST(p.subject_id AS VARCHAR) || '_' || CAST(n.sample_no AS VARCHAR) AS sample_id
  FROM pairs p JOIN numbers n
  ON p.subject_id = n.subject_id AND p.endtime = n.endtime AND p.label = n.label)"""


# --- representations ---------------------------------------------------------------------

DIM = 64
EVENTS_PER_SAMPLE = 20


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / EVENTS_PER_SAMPLE).alias("sample_id"),
        (F.col("vec_id") * 37 % 2880).alias("time_min"),
        F.col("vec_id").alias("event_idx"),
        "label",
        F.col("embedding").alias("repr"),
    )


def padded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with zero vectors: one class, and every 25th sample whole."""
    empty = (F.col("label") == 3) | (F.col("sample_id") % 25 == 24)
    zero = literal_vector([0.0] * DIM).cast("array<float>")
    return vectors(spark, sf_dir).withColumn("repr", F.when(empty, zero).otherwise(F.col("repr")))


VECTORS_SQL = """vectors AS (
  SELECT vec_id // 20 AS sample_id, vec_id * 37 % 2880 AS time_min, vec_id AS event_idx,
         label, CAST(embedding AS DOUBLE[]) AS repr
  FROM embeddings)"""

PADDED_SQL = VECTORS_SQL + """,
padded AS (
  SELECT sample_id, time_min, event_idx, label,
         CASE WHEN label = 3 OR sample_id % 25 = 24
              THEN list_transform(range(64), lambda i: CAST(0 AS DOUBLE)) ELSE repr END AS repr
  FROM vectors)"""


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The query: one vector, the one with id 0."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == 0).select("embedding").first()
    return [float(x) for x in row["embedding"]]


# --- scores ------------------------------------------------------------------------------


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two labels (missing: -1) and two scores on a grid."""
    documents = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels")

    def grid(factor: int):
        return (F.col("doc_id") * factor % 1000).cast("double") / 1000.0

    return documents.join(labels, "doc_id", "left").select(
        "doc_id",
        F.coalesce("quality", F.lit(-1)).alias("quality"),
        F.coalesce("toxic", F.lit(-1)).alias("toxic"),
        grid(7919).alias("p_quality"),
        grid(104729).alias("p_toxic"),
    )


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``(task, doc_id, truth, score)``."""
    pairs = F.array(
        F.struct(F.lit("mortality_1").alias("task"), F.col("quality").alias("truth"), F.col("p_quality").alias("score")),
        F.struct(F.lit("readmission").alias("task"), F.col("toxic").alias("truth"), F.col("p_toxic").alias("score")),
    )
    rows = scores(spark, sf_dir).select("doc_id", F.explode(pairs).alias("__row"))
    return rows.select("doc_id", "__row.task", "__row.truth", "__row.score")


SCORES_SQL = """scores AS (
  SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic,
         CAST(d.doc_id * 7919 % 1000 AS DOUBLE) / 1000.0 AS p_quality,
         CAST(d.doc_id * 104729 % 1000 AS DOUBLE) / 1000.0 AS p_toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
long_scores AS (
  SELECT 'mortality_1' AS task, doc_id, quality AS truth, p_quality AS score FROM scores
  UNION ALL
  SELECT 'readmission', doc_id, toxic, p_toxic FROM scores)"""
