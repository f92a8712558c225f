"""Files in and out."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import cohort as C
from anamnesis.registry import Registry
from anamnesis.sources import events as SE
from anamnesis.sources import samples as SS
from anamnesis.sources import workspace
from anamnesis.streaming.ingest import event_stream, ingest_shards

EVENTS = "subject_id BIGINT, time TIMESTAMP_NTZ, code STRING, numeric_value DOUBLE"


def some_events(spark, subjects, n=6):
    rows = [(s, datetime(2024, 1, 1 + i), "a" if i % 2 else 'say "b", c', i / 2) for s in subjects for i in range(n)]
    return spark.createDataFrame(rows, EVENTS)


def test_csv_wins_over_parquet_and_folders_are_searched(spark, tmp_path):
    some_events(spark, [1]).write.option("header", True).option("escape", '"').csv(f"{tmp_path}/deep/er")
    some_events(spark, [2]).write.parquet(f"{tmp_path}/other")
    got = SE.scan_events(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, some_events(spark, [1]).collect()))


def test_parquet_folder_single_file_and_unknown_kind(spark, tmp_path):
    some_events(spark, [1, 2]).coalesce(1).write.parquet(f"{tmp_path}/x")
    assert SE.scan_events(spark, str(tmp_path)).count() == 12
    file = next((tmp_path / "x").glob("*.parquet"))
    assert SE.scan_events(spark, str(file)).count() == 12
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "notes.txt").write_text("x")
    with pytest.raises(ValueError):
        SE.scan_events(spark, str(tmp_path / "empty"))


def test_the_last_description_of_a_code_counts(spark, tmp_path):
    rows = [("a", "old"), ("b", "x"), ("a", "new")]
    spark.createDataFrame(rows, "code STRING, description STRING").coalesce(1).write.parquet(f"{tmp_path}/codes")
    got = {r.code: r.description for r in SE.scan_codes(spark, f"{tmp_path}/codes").collect()}
    assert got == {"a": "new", "b": "x"}


def test_split_is_the_folder_or_the_file_name(spark, tmp_path):
    root = str(tmp_path)
    some_events(spark, [1]).write.parquet(f"{root}/train")
    some_events(spark, [2]).write.parquet(f"{root}/a/b")
    got = SE.scan_events(spark, root).select(SE.split_from_path(root).alias("s")).distinct()
    assert {r.s for r in got.collect()} == {"train", "a/b"}
    file = next((tmp_path / "train").glob("*.parquet"))
    alone = SE.scan_events(spark, str(file)).select(SE.split_from_path(str(tmp_path / "train")).alias("s"))
    assert {r.s for r in alone.distinct().collect()} == {file.name.rsplit(".", 1)[0]}


def test_existing_output_needs_rebase(spark, tmp_path):
    path = f"{tmp_path}/out"
    SE.write_new(some_events(spark, [1]), path)
    with pytest.raises(FileExistsError):
        SE.write_new(some_events(spark, [1]), path)
    SE.write_new(some_events(spark, [1, 2]), path, rebase=True)
    assert spark.read.parquet(path).count() == 12


def test_stay_lists(spark, tmp_path):
    rows = [(1, "train", "[0, 5, 9]", "[0, 1]"), (2, "test", "[]", "[]")]
    df = spark.createDataFrame(rows, SE.STAY_SCHEMA)
    df.write.option("header", True).csv(f"{tmp_path}/stays")
    got = {r.stay_id: (r.time, r.hi_start) for r in SE.scan_stays(spark, f"{tmp_path}/stays").collect()}
    assert got == {1: ([0, 5, 9], [0, 1]), 2: ([], [])}


def test_manifest_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([("1_0", 1, 4)], "sample_id STRING, subject_id BIGINT, n_events BIGINT")
    SS.write_manifest(SS.manifest(samples, 4), f"{tmp_path}/m")
    row = SS.read_manifest(spark, f"{tmp_path}/m").first()
    assert (row.subject_id, row.num_events) == ("1_0", 4) and 0 <= row.shard_id < 4
    header = next(p for p in (tmp_path / "m").glob("*.csv")).read_text().splitlines()[0]
    assert header == "subject_id\tnum_events\tshard_id"


def test_partial_copies_keep_the_written_one(spark):
    rows = [("a", 0, [0.0, 0.0]), ("a", 0, [0.0, -2.0]), ("a", 1, [0.0, 0.0]), ("b", 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "sample_id STRING, event_idx INT, repr ARRAY<FLOAT>")
    got = SS.merge_partial_reprs(df, ("sample_id", "event_idx"))
    assert {(r.sample_id, r.event_idx): r.repr for r in got.collect()} == {
        ("a", 0): [0.0, -2.0],
        ("a", 1): [0.0, 0.0],
        ("b", 0): [1.0, 0.0],
    }


def test_shards_that_arrive_later_are_added(spark, tmp_path):
    shards, out = f"{tmp_path}/shards", f"{tmp_path}/out"
    asked = spark.createDataFrame(
        [(s, datetime(2024, 1, 4, 12), True) for s in (1, 2, 3)],
        "subject_id BIGINT, prediction_time TIMESTAMP_NTZ, boolean_value BOOLEAN",
    )
    cohort = C.prepare_cohort(asked)
    counts = []
    for number, subjects in enumerate([[1], [2, 3]]):
        some_events(spark, subjects).write.parquet(f"{shards}/{number}")
        stream = event_stream(spark, shards, some_events(spark, [1]).schema)
        ingest_shards(stream, cohort, out, ["code"], "MEDS_BIRTH").awaitTermination()
        table = SS.read_manifest(spark, f"{out}/manifest")
        counts.append({r.subject_id: r.num_events for r in table.collect()})
    assert counts == [{"1_0": 4}, {"1_0": 4, "2_0": 4, "3_0": 4}]
    samples = spark.read.parquet(f"{out}/samples")
    assert {r.sample_id: len(r.events) for r in samples.collect()} == {"1_0": 4, "2_0": 4, "3_0": 4}


def test_shared_folder_is_the_one_the_session_names(spark):
    assert workspace.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = workspace.materialise(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).first()[0] == 20


def test_a_query_name_can_be_used_once():
    registry = Registry()
    registry.register("q")(lambda spark, sf_dir: None)
    with pytest.raises(ValueError):
        registry.register("q")(lambda spark, sf_dir: None)


def test_shuffle_files_go_with_the_write(spark):
    import time

    from anamnesis.sources.workspace import CLEANUP, materialise

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = disk.getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    table = materialise(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    until = time.time() + 10
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP, None) == setting
    assert sorted(table.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
