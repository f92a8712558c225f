"""Queries that write the given tables in the formats of the sources and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from anamnesis import jobs as J
from anamnesis.operators import cohort as C
from anamnesis.operators import sequence as Q
from anamnesis.plans import fixtures as X
from anamnesis.plans import vectors as V
from anamnesis.plans.cohort import histories, stamp, stamp_sql
from anamnesis.plans.sequence import PLACED_VECTORS_SQL, placed_vectors
from anamnesis.registry import register_operator as query
from anamnesis.sources import events as SE
from anamnesis.sources import samples as SS
from anamnesis.sources.workspace import fresh_path, materialise
from anamnesis.streaming.ingest import event_stream, ingest_shards, read_ingested

CSV_SCHEMA = SE.EVENT_SCHEMA + ", event_id BIGINT"

#: Headers of the shards that the queries below write: other orders of the columns, and columns that not all shards have.
HEADERS = {
    "click": ["subject_id", "time", "code", "numeric_value", "event_id"],
    "view": ["time", "props", "code", "subject_id", "event_id", "numeric_value"],
    "error": ["event_id", "numeric_value", "code", "time", "subject_id", "props", "unit"],
}


def write_shards(events, root):
    """A folder of CSV shards for each code; the codes without a header of their own have that of ``view``."""
    shards = events.withColumns({"time": F.col("time").cast("string"), "unit": F.concat(F.lit("u"), F.col("event_id") % 3)})
    for code, header in HEADERS.items():
        named = F.col("code") == code if code != "view" else ~F.col("code").isin("click", "error")
        rows = shards.where(named).select(*header).repartition(3, "subject_id")
        rows.write.option("header", True).option("escape", '"').csv(f"{root}/shards/{code}")


@query(
    "scan_events",
    "WITH " + X.MEDS_SQL + f""" SELECT event_id, subject_id, {stamp_sql('time')}, code, numeric_value,
  CASE WHEN code <> 'click' THEN props END AS props, CASE WHEN code = 'error' THEN 'u' || CAST(event_id % 3 AS VARCHAR) END AS unit,
  CASE WHEN code IN ('click', 'error') THEN code ELSE 'view' END AS folder FROM meds""",
)
def scan_events(spark, sf_dir):
    """A directory with CSV shards of three headers in sub-directories, and a Parquet file that is passed over."""
    root = fresh_path(spark, "events")
    write_shards(X.meds(spark, sf_dir), root)
    X.codes(spark).write.parquet(f"{root}/codes")
    rows = SE.scan_events(spark, root, CSV_SCHEMA, {"folder": SE.split_from_path(f"{root}/shards")})
    return rows.select("event_id", "subject_id", stamp("time"), "code", "numeric_value", "props", "unit", "folder")


@query(
    "scan_malformed",
    "WITH " + X.MEDS_SQL + """ SELECT event_id % 3 = 0 AS broken, code, count(*) AS n_rows,
  CAST(sum(CASE WHEN event_id % 3 <> 0 THEN subject_id END) AS BIGINT) AS subjects,
  CAST(sum(CASE WHEN event_id % 3 = 0 THEN event_id END) AS BIGINT) AS broken_ids
FROM meds WHERE code IN ('click', 'error') GROUP BY 1, 2""",
)
def scan_malformed(spark, sf_dir):
    """Shards of two headers in which every third row has a time that is none, or a field too many."""
    root = fresh_path(spark, "events")
    events = X.meds(spark, sf_dir).where(F.col("code").isin("click", "error"))
    broken = F.col("event_id") % 3 == 0
    time = F.when(broken & (F.col("code") == "click"), "soon").otherwise(F.col("time").cast("string"))
    extra = F.when(broken & (F.col("code") == "error"), ",more").otherwise("")
    line = {
        "click": F.concat_ws(",", "subject_id", time, "code", "event_id"),
        "error": F.concat(F.concat_ws(",", "event_id", "code", time, "subject_id"), extra),
    }
    header = {"click": "subject_id,time,code,event_id", "error": "event_id,code,time,subject_id"}
    for code in line:
        rows = events.where(F.col("code") == code).select(line[code].alias("value"))
        first = spark.range(1).select(F.lit(header[code]).alias("value"))
        # One file, so that the header is its first line.
        first.union(rows).coalesce(1).write.text(f"{root}/{code}")
        _rename_parts(spark, f"{root}/{code}")
    schema = "subject_id BIGINT, time TIMESTAMP_NTZ, code STRING, event_id BIGINT"
    rows = SE.scan_events(spark, root, schema, {"folder": SE.split_from_path(root)}, malformed=True)
    text = F.col(SE.MALFORMED)
    ids = F.split(text, ",")
    broken_id = F.when(F.col("folder") == "click", F.get(ids, F.lit(3))).otherwise(F.get(ids, F.lit(0))).cast("bigint")
    return rows.groupBy(text.isNotNull().alias("broken"), F.col("folder").alias("code")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(text.isNull(), F.col("subject_id"))).alias("subjects"),
        F.sum(broken_id).alias("broken_ids"),
    )


def _rename_parts(spark, folder):
    """Text files of a folder as CSV files."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(path, name[:-4] + ".csv"))


@query(
    "scan_codes",
    """SELECT event_type AS code, arg_max(props, event_id) AS description FROM events GROUP BY event_type""",
)
def scan_codes(spark, sf_dir):
    """A code table that names each code many times, in the order of the events; the last row counts."""
    named = X.meds(spark, sf_dir).select("code", F.col("props").alias("description"), "event_id")
    path = fresh_path(spark, "codes")
    named.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(path)
    return SE.scan_codes(spark, path)


@query(
    "scan_cohort",
    "WITH " + X.RAW_COHORT_SQL + f" SELECT subject_id, {stamp_sql('prediction_time')}, boolean_value FROM raw_cohort",
)
def scan_cohort(spark, sf_dir):
    path = fresh_path(spark, "cohort")
    rows = X.raw_cohort(spark, sf_dir).withColumn("prediction_time", F.col("prediction_time").cast("string"))
    rows.write.option("header", True).csv(path)
    return SE.scan_cohort(spark, path).select("subject_id", stamp("prediction_time"), "boolean_value")


@query(
    "scan_test_cohort",
    "WITH " + X.RAW_COHORT_SQL + f" SELECT subject_id, {stamp_sql('prediction_time')}, boolean_value FROM raw_cohort",
)
def scan_test_cohort(spark, sf_dir):
    path = fresh_path(spark, "cohort")
    X.raw_cohort(spark, sf_dir).write.parquet(path)
    return SE.scan_test_cohort(spark, path).select("subject_id", stamp("prediction_time"), "boolean_value")


def split_of(subject):
    return F.when(subject % 10 < 8, F.lit("train")).when(subject % 10 == 8, F.lit("tuning")).otherwise(F.lit("held_out"))


SPLIT_SQL = "CASE WHEN subject_id % 10 < 8 THEN 'train' WHEN subject_id % 10 = 8 THEN 'tuning' ELSE 'held_out' END"


@query(
    "split_from_path",
    "WITH " + X.MEDS_SQL + f" SELECT {SPLIT_SQL} AS split, count(*) AS n_events FROM meds GROUP BY 1",
)
def split_from_path(spark, sf_dir):
    """Events of three splits, each in its sub-directory; the split is read off the path."""
    root = fresh_path(spark, "splits")
    events = X.meds(spark, sf_dir).withColumn("split", split_of(F.col("subject_id")))
    for name in ("train", "tuning", "held_out"):
        events.where(F.col("split") == name).drop("split").write.parquet(f"{root}/{name}")
    rows = SE.scan_events(spark, root, origin={"split": SE.split_from_path(root)})
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_events"))


FIELDS = ["event_id", "time_min"]


def nested_samples(spark, sf_dir):
    events, index, hot = histories(spark, sf_dir)
    rows = C.join_history(events.select("subject_id", "event_idx", *FIELDS), index)
    return C.assemble_samples(rows, FIELDS), index


def sample_sums(samples):
    def total(field):
        return F.aggregate(
            F.col("events"), F.lit(0).cast("bigint"), lambda a, e: a + e[field].cast("bigint")
        )

    return samples.select(
        "sample_id",
        "label",
        "chunk",
        F.size("events").cast("bigint").alias("n_events"),
        total("event_id").alias("ids"),
        total("time_min").alias("minutes"),
    )


SUMS_SQL = """SELECT sample_id, label, event_idx // 1024 AS chunk, count(*) AS n_events,
       CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(time_min) AS BIGINT) AS minutes
FROM joined {where} GROUP BY sample_id, label, event_idx // 1024"""


@query("write_samples", "WITH " + X.JOINED_SQL + SUMS_SQL.format(where=""))
def write_samples(spark, sf_dir):
    samples, _ = nested_samples(spark, sf_dir)
    path = fresh_path(spark, "samples")
    subject = F.split_part("sample_id", F.lit("_"), F.lit(1)).cast("bigint")
    SS.write_samples(samples.withColumn("split", split_of(subject)), path)
    return sample_sums(spark.read.parquet(path))


@query(
    "write_manifest",
    "WITH " + X.JOINED_SQL + " SELECT sample_id AS subject_id, count(*) AS num_events FROM joined GROUP BY sample_id",
)
def write_manifest(spark, sf_dir):
    index = C.sample_index(X.kept(spark, sf_dir), X.cohort(spark, sf_dir))
    path = fresh_path(spark, "manifest")
    SS.write_manifest(SS.manifest(index), path)
    return SS.read_manifest(spark, path).select("subject_id", "num_events")


@query(
    "read_samples_by_manifest",
    "WITH " + X.JOINED_SQL + SUMS_SQL.format(where="WHERE n_events >= 10"),
)
def read_samples_by_manifest(spark, sf_dir):
    """Samples in four shards; the manifest names those with ten events or more."""
    samples, index = nested_samples(spark, sf_dir)
    listed = SS.manifest(index, shards=4)
    shard = C.shard_of(F.split_part("sample_id", F.lit("_"), F.lit(1)).cast("bigint"), 4)
    path = fresh_path(spark, "samples")
    SS.write_samples(samples.withColumn("shard_id", shard), path)
    wanted = listed.where(F.col("num_events") >= 10)
    return sample_sums(SS.read_samples_by_manifest(spark.read.parquet(path), wanted))


@query(
    "overwrite_policy",
    """SELECT 'refused' AS second_write, count(*) AS n_rows, CAST(sum(event_id) AS BIGINT) AS ids FROM events""",
)
def overwrite_policy(spark, sf_dir):
    """A second write is refused, a rebased one replaces."""
    path, events = fresh_path(spark, "out"), X.meds(spark, sf_dir)
    SE.write_new(events.select("event_id").withColumn("event_id", F.col("event_id") * 0), path)
    try:
        SE.write_new(events.select("event_id"), path)
        second = "written"
    except FileExistsError:
        second = "refused"
    SE.write_new(events.select("event_id"), path, rebase=True)
    return spark.read.parquet(path).agg(
        F.lit(second).alias("second_write"),
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("event_id").alias("ids"),
    )


def cached_vectors(spark, sf_dir):
    path = fresh_path(spark, "repr")
    SS.write_repr_cache(placed_vectors(spark, sf_dir), path)
    return SS.read_repr_cache(spark, path)


def total_of(vector: str):
    return F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total")


@query(
    "write_repr_cache",
    "WITH " + PLACED_VECTORS_SQL + """
SELECT sample_id, event_idx, time_min, label, round(list_sum(repr), 6) AS total FROM placed""",
)
def write_repr_cache(spark, sf_dir):
    """Representation rows written to the cache and read back."""
    cache = cached_vectors(spark, sf_dir)
    return cache.select("sample_id", "event_idx", "time_min", "label", total_of("repr"))


@query(
    "read_repr_cache",
    "WITH " + PLACED_VECTORS_SQL + """
SELECT sample_id, event_idx, max(time_min) OVER (PARTITION BY sample_id) - time_min AS time_min,
       round(list_sum(repr), 6) AS total FROM placed""",
)
def read_repr_cache(spark, sf_dir):
    """The cache as retrieval reads it: times are minutes before the last event."""
    rows = Q.minutes_before_last(cached_vectors(spark, sf_dir), "sample_id")
    return rows.select("sample_id", "event_idx", "time_min", total_of("repr"))


@query(
    "fetch_repr_chunks",
    "WITH " + PLACED_VECTORS_SQL + """
SELECT sample_id, event_idx, round(list_sum(repr), 6) AS total FROM placed WHERE (sample_id + event_idx // 4) % 3 = 0""",
)
def fetch_repr_chunks(spark, sf_dir):
    """A third of the chunks of four vectors, fetched by number: (sample + chunk) divisible by three; chunk 9 exists nowhere."""
    path = fresh_path(spark, "repr")
    SS.write_repr_cache(placed_vectors(spark, sf_dir), path)
    samples = X.vectors(spark, sf_dir).select("sample_id").distinct()
    wanted = samples.withColumn("chunk", F.explode(F.array(*[F.lit(c).cast("bigint") for c in range(10)])))
    wanted = wanted.where((F.col("sample_id") + F.col("chunk")) % 3 == 0)
    rows = SS.read_repr_cache(spark, path, wanted.union(wanted.where("chunk = 0")), max_len=4)
    return rows.select("sample_id", "event_idx", total_of("repr"))


# --- legacy stays: one row per sample of twenty vectors, its event times as text ----------


def stays_csv(spark, sf_dir):
    path = fresh_path(spark, "stays")
    lists = X.vectors(spark, sf_dir).groupBy("sample_id").agg(F.sort_array(F.collect_list("time_min")).alias("t"))
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(47)), lambda h: F.size(F.filter("t", lambda m: m < h * 60))
    )
    lists.select(
        F.col("sample_id").alias("patientunitstayid"),
        split_of(F.col("sample_id")).alias("split_2020"),
        list_text(F.col("t")).alias("time"),
        list_text(starts).alias("hi_start"),
    ).write.option("header", True).csv(path)
    return path


def list_text(values):
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


STAY_SCHEMA = "patientunitstayid BIGINT, split_2020 STRING, time STRING, hi_start STRING"

STAYS_SQL = X.VECTORS_SQL + f""",
stays AS (
  SELECT sample_id AS stay_id, {SPLIT_SQL.replace('subject_id', 'sample_id')} AS split_2020,
         list(time_min ORDER BY time_min) AS time,
         list_transform(range(48), lambda h: len(list_filter(list(time_min), lambda m: m < h * 60))) AS hi_start
  FROM vectors GROUP BY sample_id)"""


@query(
    "scan_stays_csv",
    "WITH " + STAYS_SQL + """
SELECT stay_id, split_2020, array_to_string(time, ',') AS time, array_to_string(hi_start, ',') AS hi_start FROM stays""",
)
def scan_stays_csv(spark, sf_dir):
    stays = SE.scan_stays(spark, stays_csv(spark, sf_dir), STAY_SCHEMA)
    return stays.select(
        F.col("patientunitstayid").alias("stay_id"),
        "split_2020",
        F.array_join(F.col("time").cast("array<string>"), ",").alias("time"),
        F.array_join(F.col("hi_start").cast("array<string>"), ",").alias("hi_start"),
    )


def raw_stays(spark, sf_dir):
    path = stays_csv(spark, sf_dir)
    return spark.read.schema(STAY_SCHEMA).option("header", True).csv(path)


@query("split_filter", "WITH " + STAYS_SQL + " SELECT stay_id FROM stays WHERE split_2020 = 'train'")
def split_filter(spark, sf_dir):
    stays = Q.stay_key(raw_stays(spark, sf_dir), "eicu")
    return Q.split_filter(stays, "train").select("stay_id")


@query("stay_key", "WITH " + STAYS_SQL + " SELECT stay_id, split_2020 FROM stays")
def stay_key(spark, sf_dir):
    return Q.stay_key(raw_stays(spark, sf_dir), "eicu").select("stay_id", "split_2020")


@query("stay_lengths", "WITH " + STAYS_SQL + " SELECT stay_id, len(time) AS n_events FROM stays")
def stay_lengths(spark, sf_dir):
    stays = Q.stay_lengths(Q.stay_key(raw_stays(spark, sf_dir), "eicu"))
    return stays.select("stay_id", F.col("n_events").cast("bigint").alias("n_events"))


@query(
    "write_predictions",
    "WITH " + X.JOINED_SQL + f"""
SELECT subject_id, {stamp_sql('endtime')}, label, round(n / (n + 10), 6) AS boolean_prediction
FROM (SELECT subject_id, endtime, label, CAST(count(*) AS DOUBLE) AS n FROM joined GROUP BY subject_id, endtime, label)""",
)
def write_predictions(spark, sf_dir):
    index = C.sample_index(X.kept(spark, sf_dir), X.cohort(spark, sf_dir))
    n = F.col("n_events").cast("double")
    path = fresh_path(spark, "predictions")
    rows = index.select("subject_id", "endtime", "label", (n / (n + 10)).alias("boolean_prediction"))
    SS.write_predictions(rows, path)
    return spark.read.parquet(path).select(
        "subject_id", stamp("endtime"), "label", F.round("boolean_prediction", 6).alias("boolean_prediction")
    )


@query(
    "merge_partial_reprs",
    "WITH " + X.VECTORS_SQL + " SELECT sample_id, event_idx, time_min, round(list_sum(repr), 6) AS total FROM vectors",
)
def merge_partial_reprs(spark, sf_dir):
    """Two workers, each with the vectors of its classes and zeros for the others."""
    rows = X.vectors(spark, sf_dir).drop("label")
    labels = X.vectors(spark, sf_dir).select("event_idx", "label")
    rows = rows.join(labels, "event_idx")
    zero = X.literal_vector([0.0] * X.DIM).cast("array<float>")

    def worker(mine):
        return rows.withColumn("repr", F.when(mine, F.col("repr")).otherwise(zero)).drop("label")

    low = F.col("label") < 5
    merged = SS.merge_partial_reprs(worker(low).unionByName(worker(~low)), ("sample_id", "event_idx"))
    return merged.select("sample_id", "event_idx", "time_min", total_of("repr"))


@query(
    "union_shards",
    """SELECT subject_id, code, count(*) AS n_rows, count(props) AS n_props FROM (
  SELECT user_id AS subject_id, event_type AS code, props FROM events
  UNION ALL SELECT o_custkey, o_orderstatus, NULL FROM orders) GROUP BY subject_id, code""",
)
def union_shards(spark, sf_dir):
    """Event shards and order shards as one table; orders have no props."""
    orders = X.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("code")
    )
    events = X.meds(spark, sf_dir).select("subject_id", "code", "props")
    rows = SE.union_shards(events, orders)
    return rows.groupBy("subject_id", "code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("props").alias("n_props")
    )


@query(
    "ingest_shards",
    "WITH " + X.JOINED_SQL + """
SELECT sample_id AS subject_id, count(*) AS num_events FROM joined GROUP BY sample_id""",
)
def ingest_shards_query(spark, sf_dir):
    """The event table as a stream of shards; the manifest is what the batches wrote."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    stream = X.as_meds(event_stream(spark, sf_dir, spark.read.parquet(path).schema, "events.parquet"))
    out = fresh_path(spark, "ingest")
    cohort = materialise(X.cohort(spark, sf_dir), "cohort")
    run = ingest_shards(stream, cohort, out, X.TIE, X.BIRTH)
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return SS.read_manifest(spark, f"{out}/manifest").select("subject_id", "num_events")


@query(
    "ingest_split_subjects",
    "WITH " + X.JOINED_SQL + """
SELECT sample_id AS subject_id, count(*) AS num_events, CAST(sum(event_idx) AS BIGINT) AS places,
       CAST(sum(time_min) AS BIGINT) AS minutes FROM joined GROUP BY sample_id""",
)
def ingest_split_subjects(spark, sf_dir):
    """Three shards, each with a third of the events of every subject, in three batches: the samples are those of one batch."""
    root, out = fresh_path(spark, "shards"), fresh_path(spark, "ingest")
    events = X.meds(spark, sf_dir)
    for third in range(3):
        events.where(F.col("event_id") % 3 == third).coalesce(1).write.parquet(f"{root}/{third}")
    stream = event_stream(spark, root, events.schema, files=1)
    run = ingest_shards(stream, materialise(X.cohort(spark, sf_dir), "cohort"), out, X.TIE, X.BIRTH)
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    samples = read_ingested(spark, out, "samples")
    of = lambda field: F.aggregate("events", F.lit(0).cast("bigint"), lambda a, e: a + e[field].cast("bigint"))
    sums = samples.groupBy("sample_id").agg(F.sum(of("event_idx")).alias("places"), F.sum(of("time_min")).alias("minutes"))
    listed = read_ingested(spark, out, "manifest").select("subject_id", "num_events")
    return listed.join(sums.withColumnRenamed("sample_id", "subject_id"), "subject_id", "left")


# --- the jobs on files, with subjects that lie in two splits ------------------------------

SPLITS = ("train", "tuning", "held_out")

JOB_SQL = X.COHORT_SQL + """,
spread AS (
  SELECT *, CASE WHEN subject_id % 5 = 0 AND event_id % 2 = 0 THEN 'held_out'
                 WHEN subject_id % 10 < 8 THEN 'train' WHEN subject_id % 10 = 8 THEN 'tuning' ELSE 'held_out' END AS split
  FROM kept),
pairs AS (
  SELECT e.split, e.subject_id, e.event_id, c.endtime, c.label FROM spread e JOIN cohort c
  ON e.subject_id = c.subject_id AND e.time <= c.endtime),
numbers AS (
  SELECT split, subject_id, endtime, label, count(*) AS n_events, sum(event_id) AS ids,
         row_number() OVER (PARTITION BY split, subject_id ORDER BY endtime, label) - 1 AS sample_no
  FROM pairs GROUP BY split, subject_id, endtime, label)"""


def split_of_event():
    both = (F.col("subject_id") % 5 == 0) & (F.col("event_id") % 2 == 0)
    return F.when(both, F.lit("held_out")).otherwise(split_of(F.col("subject_id")))


def processed(spark, sf_dir, **options):
    """The first job on the event table, written to a folder for each split."""
    root, out = fresh_path(spark, "job events"), fresh_path(spark, "processed")
    events = X.meds(spark, sf_dir).withColumn("split", split_of_event())
    for name in SPLITS:
        rows = events.where(F.col("split") == name).drop("split")
        rows.repartitionByRange(2, "time", "event_id").sortWithinPartitions("time", "event_id").write.parquet(f"{root}/{name}")
    asked = fresh_path(spark, "asked")
    X.raw_cohort(spark, sf_dir).write.parquet(f"{asked}/all")
    J.process_events(spark, root, asked, out, birth_code=X.BIRTH, **options)
    return out


@query(
    "process_events_manifest",
    "WITH " + X.KEPT_SQL + ",\n" + JOB_SQL + """
SELECT split, CAST(subject_id AS VARCHAR) || '_' || CAST(sample_no AS VARCHAR) AS sample_id, n_events AS num_events FROM numbers""",
)
def process_events_manifest(spark, sf_dir):
    """The manifest of the job: subjects in two folders have samples in both."""
    table = SS.read_manifest(spark, f"{processed(spark, sf_dir, shards=4)}/manifest")
    return table.select("split", F.col("subject_id").alias("sample_id"), "num_events")


@query(
    "process_events_samples",
    "WITH " + X.KEPT_SQL + ",\n" + JOB_SQL + """
SELECT split, CAST(subject_id AS VARCHAR) || '_' || CAST(sample_no AS VARCHAR) AS sample_id, label, n_events
FROM numbers WHERE n_events >= 10""",
)
def process_events_samples(spark, sf_dir):
    """Samples of the job that its manifest names, from four shards of each split."""
    out = processed(spark, sf_dir, shards=4)
    wanted = SS.read_manifest(spark, f"{out}/manifest").where(F.col("num_events") >= 10)
    samples = SS.read_samples_by_manifest(spark.read.parquet(f"{out}/samples"), wanted)
    return samples.groupBy("split", "sample_id", "label").agg(F.sum(F.size("events")).alias("n_events"))


TEST_COHORT_SQL = "WITH " + V.LOOKUP_SQL + ",\n" + X.RAW_COHORT_SQL + """,
event_vectors AS """ + V.mean_sql("summed", "subject_id, event_id", "vector") + ",\n" + V.QUERY_SQL + """,
encoded AS (SELECT subject_id, event_id, CAST(pooled AS FLOAT[]) AS v FROM event_vectors),
event_scores AS (
  SELECT e.subject_id, e.event_id, k.time, CAST(e.v AS DOUBLE[]) AS vector, (list_cosine_similarity(CAST(e.v AS DOUBLE[]), q.v) + 1) / 2 AS score
  FROM encoded e JOIN kept k ON e.event_id = k.event_id, q),
asked AS (SELECT DISTINCT subject_id, prediction_time FROM raw_cohort WHERE subject_id % 2 = 0),
history AS (
  SELECT a.subject_id, a.prediction_time, s.event_id, s.vector, s.score, s.time
  FROM asked a JOIN event_scores s ON a.subject_id = s.subject_id AND s.time <= a.prediction_time),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY subject_id, prediction_time ORDER BY score DESC, time, event_id) AS rank FROM history WHERE score > 0.6),
pooled AS """ + V.mean_sql("(SELECT * FROM ranked WHERE rank <= 16)", "subject_id, prediction_time", "vector") + f""",
filled AS (
  SELECT h.subject_id, h.prediction_time, coalesce(p.pooled, {V.CONSTANT_SQL}) AS pooled
  FROM (SELECT DISTINCT subject_id, prediction_time FROM history) h
  LEFT JOIN pooled p ON h.subject_id = p.subject_id AND h.prediction_time = p.prediction_time),
scored AS (
  SELECT subject_id, prediction_time, 1 / (1 + exp(-list_dot_product(w[1], pooled))) AS score
  FROM filled, (SELECT {V.weights_sql(1, 64, 4)} AS w))
SELECT c.subject_id, strftime(c.prediction_time, '%Y-%m-%d %H:%M:%S.%f') AS prediction_time, c.boolean_value, round(s.score, 4) AS boolean_prediction
FROM raw_cohort c LEFT JOIN scored s ON c.subject_id = s.subject_id AND c.prediction_time = s.prediction_time
WHERE c.subject_id % 2 = 0"""


@query("predict_test_cohort", TEST_COHORT_SQL)
def predict_test_cohort(spark, sf_dir):
    """All three jobs over the events of three splits, then an outside cohort: half of the subjects, with unlabelled rows.

    Whole vectors; events that score 0.6 or less are rejected, and of the others the 16 best of each history are kept.
    """
    root, out, encoded = (fresh_path(spark, n) for n in ("test events", "processed", "encoded"))
    events = X.meds(spark, sf_dir).withColumn("split", split_of(F.col("subject_id")))
    for name in SPLITS:
        rows = events.where(F.col("split") == name)
        # Events of one time keep the order of their rows; the number of an event is no field of it.
        rows.repartitionByRange(2, "time", "event_id").sortWithinPartitions("time", "event_id").drop("split", "event_id").write.parquet(f"{root}/{name}")
    asked = fresh_path(spark, "asked")
    X.raw_cohort(spark, sf_dir).write.parquet(f"{asked}/all")
    J.process_events(spark, root, asked, out, birth_code=X.BIRTH)
    J.encode_events(spark, out, encoded, *V.embedding_tables(spark, sf_dir), dim=X.DIM)
    model = J.Model(
        heads={"meds_single_task": ("binary", V.head(1, 4))},
        constant=V.CONSTANT,
        query=X.first_vector(spark, sf_dir),
        rejection_cutoff=0.6,
        max_retrieve_len=16,
    )
    cohort = X.raw_cohort(spark, sf_dir).where(F.col("subject_id") % 2 == 0)
    found = J.predict_cohort(spark, out, encoded, model, test_cohort=cohort, check_ids=False)
    return found.select(
        "subject_id", stamp("prediction_time"), "boolean_value", F.round("boolean_prediction", 4).alias("boolean_prediction")
    )
