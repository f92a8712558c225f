"""Shards arriving as files, each batch appended to the same samples and manifest.

What is known of a subject is one row of a state table: the batches that had events of it, how many events and samples it has, its
first and last time. The state of batch n is in blocks of 1, 2, 4, … batches, as the binary digits of n + 1 say: a batch
writes a block of its own and merges it with blocks of the same size. So a batch looks up its subjects in a number of tables
that grows with the logarithm of the batches, and a row is rewritten as often.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from anamnesis.operators.cohort import (
    assemble_samples,
    describe_codes,
    drop_birth_and_static,
    history_marks,
    join_history,
    keep_subjects,
    order_events,
    sample_index,
    subject_ids,
)
from anamnesis.operators.skew import find_hot
from anamnesis.operators.tokens import drop_empty_events, tokenize
from anamnesis.sources.samples import manifest, write_manifest
from anamnesis.sources.workspace import materialise


#: Folders that the events of a batch are dealt to by subject, so that few are read for few returning subjects.
BUCKETS = 64


def event_stream(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files: int | None = None) -> DataFrame:
    """A directory of event shards as a stream, ``files`` of them in a batch."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(path)


def _blocks(batches: int) -> list[tuple[int, int]]:
    """The blocks (first, end) that hold the state of so many batches."""
    out, first = [], 0
    for size in (1 << k for k in reversed(range(batches.bit_length()))):
        if batches & size:
            out.append((first, first + size))
            first += size
    return out


def _block_path(out: str, block: tuple[int, int]) -> str:
    return f"{out}/state/from={block[0]}/to={block[1]}"


def _merged(tables: Sequence[DataFrame]) -> DataFrame:
    """One row per subject; the counts and times are those of its latest batch, which has seen all before."""
    rows = reduce(DataFrame.unionByName, tables)
    latest = F.max(F.struct("batch", "n_events", "n_samples", "first_time", "last_time")).alias("latest")
    batches = F.array_sort(F.array_distinct(F.flatten(F.collect_list("batches")))).alias("batches")
    return rows.groupBy("subject_id").agg(batches, latest).select("subject_id", "batches", "latest.*")


def read_state(spark: SparkSession, out: str, batches: int) -> DataFrame | None:
    """What so many batches know of each subject: (subject_id, batches, batch, n_events, n_samples, first_time, last_time)."""
    blocks = _blocks(batches)
    return _merged([spark.read.parquet(_block_path(out, b)) for b in blocks]) if blocks else None


def _write_state(spark: SparkSession, out: str, number: int, rows: DataFrame) -> None:
    rows.write.mode("overwrite").parquet(_block_path(out, (number, number + 1)))
    last = _blocks(number + 1)[-1]
    if last[1] - last[0] > 1:
        # The block of this batch and those that it is merged with, each as large as all after it.
        parts = [b for b in _blocks(number) if b[0] >= last[0]] + [(number, number + 1)]
        merged = _merged([spark.read.parquet(_block_path(out, b)) for b in parts])
        merged.write.mode("overwrite").parquet(_block_path(out, last))


def read_ingested(spark: SparkSession, out: str, name: str) -> DataFrame:
    """``events``, ``samples`` or ``manifest`` as they are after all batches: of each subject what its latest batch wrote."""
    options = {"sep": "\t", "header": True} if name == "manifest" else {}
    reader = spark.read.options(**options)
    rows = (reader.csv if name == "manifest" else reader.parquet)(f"{out}/{name}")
    batches = spark.read.parquet(f"{out}/state").agg(F.max("to")).first()[0]
    latest = read_state(spark, out, batches).select("subject_id", "batch")
    if name == "events":
        return rows.join(latest, ["subject_id", "batch"], "left_semi").drop("batch")
    sample = "subject_id" if name == "manifest" else "sample_id"
    of = F.split_part(sample, F.lit("_"), F.lit(1)).cast("bigint")
    latest = latest.withColumnsRenamed({"subject_id": "__subject", "batch": "__batch"})
    found = rows.join(latest, (of == F.col("__subject")) & (F.col("batch") == F.col("__batch")), "left_semi").drop("batch")
    if name == "manifest":
        return found.select("subject_id", F.col("num_events").cast("bigint"), F.col("shard_id").cast("int"))
    return found


def ingest_shards(
    stream: DataFrame,
    cohort: DataFrame,
    out: str,
    tie: Sequence[str],
    birth_code: str,
    fields: Sequence[str] = ("time_min", "tokens"),
    codes: DataFrame | None = None,
) -> StreamingQuery:
    """Build samples of every arriving batch and append them to ``out``.

    Subjects may return with events of any time: their earlier events are read from the batches that had some, and their whole
    history is built anew in the folder of this batch. ``read_ingested`` gives of each subject what its latest batch wrote, so the
    result is that of one batch with all events. Each batch writes to its own folder, which a repeated batch replaces: a lost
    executor or a restart leaves no double rows. ``codes`` is ``(code, description)``.
    """

    def build(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = drop_empty_events(drop_birth_and_static(batch, birth_code))
        kept = kept if codes is None else describe_codes(kept, codes)
        bucket = F.pmod(F.xxhash64("subject_id"), F.lit(BUCKETS)).cast("int")
        dealt = kept.withColumn("bucket", bucket)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/history/batch={number}")
        kept = spark.read.schema(dealt.schema).parquet(f"{out}/history/batch={number}")
        subjects = materialise(subject_ids(kept), "subjects")
        before = read_state(spark, out, number)
        if before is not None:
            again = materialise(before.join(subjects, "subject_id", "left_semi"), "again")
            places = again.select(F.explode("batches").alias("batch"), bucket.alias("bucket")).distinct().collect()
            if places:
                # At most a folder for each earlier batch and bucket.
                folders = [f"{out}/history/batch={r['batch']}/bucket={r['bucket']}" for r in places]
                earlier = spark.read.schema(kept.drop("bucket").schema).parquet(*folders)
                kept = kept.drop("bucket").unionByName(earlier.join(again.select("subject_id"), "subject_id", "left_semi"))
                kept = materialise(kept, "kept")
        kept = kept.drop("bucket")
        asked = keep_subjects(cohort, subjects)
        hot = find_hot(history_marks(kept, asked), ["subject_id"])
        index = materialise(sample_index(kept, asked, hot), "index")
        placed = tokenize(order_events(kept, tie, hot), ("subject_id", "time", "event_idx", "time_min"))
        wide = placed.select("subject_id", "time", "event_idx", *fields)
        wide.write.mode("overwrite").parquet(f"{out}/events/batch={number}")
        wide = spark.read.parquet(f"{out}/events/batch={number}").drop("time")
        nested = assemble_samples(join_history(wide, index), fields)
        nested.write.mode("overwrite").parquet(f"{out}/samples/batch={number}")
        write_manifest(manifest(index), f"{out}/manifest/batch={number}", mode="overwrite")

        seen = kept.groupBy("subject_id").agg(
            F.count(F.lit(1)).alias("n_events"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
        )
        samples = index.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_samples"))
        state = seen.join(samples, "subject_id", "left").withColumns(
            {"n_samples": F.coalesce("n_samples", F.lit(0).cast("bigint")), "batch": F.lit(number), "batches": F.array(F.lit(number))}
        )
        names = ["subject_id", "batches", "batch", "n_events", "n_samples", "first_time", "last_time"]
        _write_state(spark, out, number, state.select(*names))

    return (
        stream.writeStream.foreachBatch(build)
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
