"""Samples, manifests, representation caches and predictions on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anamnesis import settings as S
from anamnesis.functions.arrays import all_zero
from anamnesis.operators.cohort import shard_of
from anamnesis.operators.skew import attach, find_hot, hot_rows
from anamnesis.sources.events import as_glob, write_new
from anamnesis.sources.workspace import materialise

MANIFEST_SCHEMA = "subject_id STRING, num_events BIGINT, shard_id INT"


def manifest(samples: DataFrame, shards: int = 1) -> DataFrame:
    """One row per sample with its number of events and the shard its subject lies in."""
    return samples.select(
        F.col("sample_id").alias("subject_id"),
        F.col("n_events").alias("num_events"),
        shard_of("subject_id", shards).alias("shard_id"),
        *[c for c in ("split",) if c in samples.columns],
    )


def write_manifest(table: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab separated, with a header in each file; one directory per split where there are splits."""
    writer = table.write.mode(mode).option("sep", "\t").option("header", True)
    (writer.partitionBy("split") if "split" in table.columns else writer).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).option("sep", "\t").option("header", True).csv(path)


def write_samples(samples: DataFrame, path: str, rebase: bool = False) -> None:
    """Nested samples, one directory per split (and per shard where there is one), in the order of samples in each file.

    A fetch of few samples reads only the row groups and pages that hold them. Rows stay in the tasks that made them.
    """
    by = tuple(c for c in ("split", "shard_id") if c in samples.columns)
    order = [c for c in (*by, "sample_id", "chunk") if c in samples.columns]
    write_new(samples.sortWithinPartitions(*order), path, rebase, by)


#: Samples up to which a fetch names them to the scan.
FEW_SAMPLES = 1_000
#: Samples up to which the list of those wanted is broadcast.
BROADCAST_SAMPLES = 2_000_000


def read_samples_by_manifest(samples: DataFrame, table: DataFrame, few: int = FEW_SAMPLES, most: int = BROADCAST_SAMPLES) -> DataFrame:
    """The samples a manifest names, from the splits and shards it names.

    The manifest is counted, never the samples. Few names go to the scan, which skips what doesn't hold them; up to ``most``
    are broadcast, so that no sample is shuffled. A longer list is joined; rows are nested chunks of up to a thousand events, so
    a sample counts as hot sooner there. Splits and shards are directories: those that the manifest lacks are not read.
    """
    by = [c for c in ("split", "shard_id") if c in samples.columns and c in table.columns]
    keys = ["sample_id", *by]
    wanted = table.select(F.col("subject_id").alias("sample_id"), *by).distinct()
    count = wanted.limit(most + 1).count()
    if count > most:
        hot = find_hot(samples, keys, hot_rows(samples.sparkSession) // S.ENCODE_CHUNK)
        return attach(samples, wanted, keys, "left_semi", hot)
    if count <= few:
        rows = wanted.collect()
        for key in keys:
            samples = samples.where(F.col(key).isin(sorted({r[key] for r in rows if r[key] is not None})))
    return samples.join(F.broadcast(wanted), keys, "left_semi")


def _index_path(path: str) -> str:
    return f"{path.rstrip('/')}.index"


def write_repr_cache(df: DataFrame, path: str, rebase: bool = False, key: str = "sample_id") -> None:
    """Event vectors in long form, ordered by sample and event, with an index beside them.

    The index, ``path`` with ``.index`` added, has the least and largest (sample, event) of each file.
    """
    vectors = df.withColumn("repr", F.col("repr").cast("array<float>"))
    ordered = vectors.repartitionByRange(key, "event_idx")
    write_new(ordered.sortWithinPartitions(key, "event_idx"), path, rebase)
    # The path of a row is a URI; a plus sign in it stands for itself.
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("file")
    place = F.struct(F.col(key).alias("key"), F.col("event_idx").cast("bigint").alias("event_idx"))
    written = df.sparkSession.read.parquet(path)
    write_new(written.groupBy(file).agg(F.min(place).alias("first"), F.max(place).alias("last")), _index_path(path), rebase)


#: Chunks up to which the files of a fetch are looked up in the index.
INDEXED_CHUNKS = 100_000


def read_repr_cache(
    spark: SparkSession, path: str, wanted: DataFrame | None = None, key: str = "sample_id", max_len: int = S.ENCODE_CHUNK
) -> DataFrame:
    """The cached vectors, or those of the wanted ``(key, chunk)``; chunk c holds the events from c * ``max_len`` on.

    The index names the files that hold wanted chunks; only these are read, and of few samples only the row groups that hold
    them. A chunk that the cache lacks has no rows; one that is wanted twice has them once.
    """
    if wanted is None:
        return spark.read.parquet(path)
    wanted = materialise(wanted.select(key, F.col("chunk").cast("bigint").alias("chunk")).where(F.col("chunk").isNotNull()).distinct(), "wanted")
    count = wanted.count()
    rows = spark.read.parquet(path)
    if count <= INDEXED_CHUNKS:
        index = spark.read.parquet(_index_path(path))
        ends = [F.struct(F.col(key).alias("key"), (F.col("chunk") * max_len + add).alias("event_idx")) for add in (0, max_len - 1)]
        holds = (F.col("first") <= F.col("to")) & (F.col("last") >= F.col("from"))
        spans = F.broadcast(wanted.select(ends[0].alias("from"), ends[1].alias("to")))
        files = [r["file"] for r in index.join(spans, holds, "left_semi").select("file").collect()]
        rows = spark.read.parquet(*[as_glob(f) for f in files]) if files else rows.limit(0)
        if count <= FEW_SAMPLES:
            rows = rows.where(F.col(key).isin([r[0] for r in wanted.select(key).distinct().where(F.col(key).isNotNull()).collect()]))
    rows = rows.withColumn("chunk", F.floor(F.col("event_idx") / max_len))
    asked = F.broadcast(wanted) if count <= BROADCAST_SAMPLES else wanted
    return rows.join(asked, [key, "chunk"], "left_semi").drop("chunk")


def merge_partial_reprs(partial: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Of several copies of an event vector keep a written one (not all zero)."""
    rest = [c for c in partial.columns if c not in keys]
    # Of several written copies the largest in the order of their columns, whatever order they come in.
    copy = F.struct(*rest)
    best = F.max_by(copy, F.struct("__written", copy))
    marked = partial.withColumn("__written", ~all_zero(F.col("repr")))
    return marked.groupBy(*keys).agg(best.alias("__best")).select(
        *keys, *[F.col(f"__best.{c}").alias(c) for c in rest]
    )


def write_predictions(df: DataFrame, path: str, rebase: bool = False) -> None:
    write_new(df, path, rebase)
