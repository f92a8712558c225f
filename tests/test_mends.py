"""Split keys, row order, outside cohorts, numbers of any type, chunks that come twice, workers elsewhere."""

import os
import subprocess
import sys
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from anamnesis import jobs as J
from anamnesis.functions import text as T
from anamnesis.operators import cohort as C
from anamnesis.operators import metrics as M
from anamnesis.operators import sequence as Q
from anamnesis.operators import tokens as K
from anamnesis.operators import vectors as E
from anamnesis.operators.skew import HotGroups
from anamnesis.sources import events as SE
from anamnesis.sources import samples as SS
from anamnesis.streaming import ingest as I
from anamnesis.streaming.ingest import event_stream, ingest_shards

T0 = datetime(2024, 1, 1)
EVENTS = "subject_id BIGINT, time TIMESTAMP_NTZ, code STRING, numeric_value DOUBLE"
COHORT = "subject_id BIGINT, prediction_time TIMESTAMP_NTZ, boolean_value BOOLEAN"


def tables(spark):
    def table(name, n):
        rows = [(i, [float(i % 7) - 3, 1.0, float(i % 3)]) for i in range(n)]
        return spark.createDataFrame(rows, f"{name} INT, embedding ARRAY<FLOAT>")

    return table("token_id", 200), table("type_id", 8), table("dpe_id", 100)


@pytest.fixture(scope="module")
def two_splits(spark, tmp_path_factory):
    """Subject 1 lies in both folders; events of one time come as z, a, m."""
    root = tmp_path_factory.mktemp("two splits")
    for split, shift in (("train", 0), ("held_out", 5)):
        rows = [(1, T0 + timedelta(hours=h + shift), code, 1.0) for h in range(3) for code in ("z", "a", "m")]
        rows += [(2, T0, "only", None)] if split == "train" else []
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{root}/events/{split}")
    asked = [(1, T0 + timedelta(hours=1), True), (1, T0 + timedelta(hours=9), False), (2, T0, True)]
    spark.createDataFrame(asked, COHORT).write.parquet(f"{root}/cohort/all")
    J.process_events(spark, f"{root}/events", f"{root}/cohort", f"{root}/out", shards=3)
    J.encode_events(spark, f"{root}/out", f"{root}/encoded", *tables(spark), dim=3)
    return root


def test_splits_never_mix_and_rows_keep_their_order(spark, two_splits):
    rows = spark.read.parquet(f"{two_splits}/out/samples").collect()
    found = {(r.split, r.sample_id): [next(t.token for t in e.tokens[2:]) for e in r.events] for r in rows}
    assert found == {
        ("train", "1_0"): ["z", "a", "m"] * 2,
        ("train", "1_1"): ["z", "a", "m"] * 3,
        ("train", "2_0"): ["only"],
        ("held_out", "1_0"): ["z", "a", "m"] * 3,
    }


def test_manifest_names_shards_that_exist(spark, two_splits):
    table = SS.read_manifest(spark, f"{two_splits}/out/manifest")
    samples = spark.read.parquet(f"{two_splits}/out/samples")
    wanted = table.where("num_events >= 9")
    got = SS.read_samples_by_manifest(samples, wanted).select("split", "sample_id").collect()
    assert sorted(map(tuple, got)) == [("held_out", "1_0"), ("train", "1_1")]
    assert samples.select("shard_id").distinct().exceptAll(table.select("shard_id").distinct()).isEmpty()


MODEL = J.Model(heads={"meds_single_task": ("binary", [([0.3, -0.2, 0.1], 0.05)])}, constant=[0.0] * 3, query=[1.0, 1.0, 0.0])


def test_an_outside_cohort_keeps_all_its_rows(spark, two_splits):
    out, encoded = f"{two_splits}/out", f"{two_splits}/encoded"
    rows = [
        (1, T0 + timedelta(hours=9), False),
        (1, T0 + timedelta(hours=6), None),  # unlabelled, with history
        (1, T0 - timedelta(hours=1), True),  # before the first event
        (7, T0, None),
    ]
    cohort = spark.createDataFrame(rows, COHORT)
    got = J.predict_cohort(spark, out, encoded, MODEL, split="held_out", test_cohort=cohort).collect()
    assert {(r.subject_id, r.prediction_time): r.boolean_prediction is not None for r in got} == {
        (1, T0 + timedelta(hours=9)): True,
        (1, T0 + timedelta(hours=6)): True,
        (1, T0 - timedelta(hours=1)): False,
        (7, T0): False,
    }
    with pytest.raises(ValueError, match="differ"):
        J.predict_cohort(spark, out, encoded, MODEL, split="held_out", test_cohort=cohort.where("subject_id = 7"))


def test_paths_with_spaces_and_single_files(spark, tmp_path):
    root = f"{tmp_path}/a folder+b"
    spark.createDataFrame([(1, T0, "x", 1.0)], EVENTS).coalesce(1).write.parquet(f"{root}/train")
    split = lambda path: SE.scan_events(spark, path).select(SE.split_from_path(path)).first()[0]
    assert split(root) == "train"
    part = next(f for f in os.listdir(f"{root}/train") if f.endswith(".parquet"))
    os.rename(f"{root}/train/{part}", f"{root}/train/tuning.parquet")
    assert split(f"{root}/train/tuning.parquet") == "tuning"


def test_numbers_of_any_type_are_rounded(spark):
    row = (Decimal("12.345678"), datetime(2024, 1, 1, 0, 0, 0, 123456), 1.23456, "2.000049 x", 7)
    df = spark.createDataFrame([row], "d DECIMAL(20,6), t TIMESTAMP_NTZ, f DOUBLE, s STRING, n INT")
    texts = [f.text for f in T.event_fields(df.schema, ())]
    found = [v.replace(" ", "") for v in df.select(*texts).first()]
    assert found == ["12.3457", "2024-01-0100:00:0.1235", "1.2346", "2.0x", "7"]


def test_places_that_have_no_id_have_no_vector(spark):
    long = "9" * 100 + "." + "1" * 3
    df = spark.createDataFrame([(1, long), (2, "0.1234567")], "event_id INT, s STRING")
    places = df.select(T.digit_place_ids(F.col("s"))).collect()
    assert [max(r[0]) for r in places] == [99, 6] and min(min(r[0]) for r in places) == 0
    fields = [T.EventField("s", df.schema["s"].dataType, False)]
    events = df.select("event_id", T.event_tokens(fields).alias("tokens"))
    vocabulary = spark.createDataFrame([("9", 104), ("1", 105)], "token STRING, token_id INT")
    rows = K.token_ids(K.token_rows(events, ["event_id"]), vocabulary)
    looked = E.mean_pool(E.token_embedding_lookup(rows, *tables(spark), dim=3), ["event_id"], "vector", skip_zero=False)
    slow = {r.event_id: r.pooled for r in looked.collect()}
    fast = {r.event_id: r.repr for r in E.event_vectors(events, vocabulary, *tables(spark), dim=3).collect()}
    assert fast.keys() == slow.keys()
    for key in fast:
        assert fast[key] == pytest.approx(slow[key], abs=1e-5)


def test_a_vocabulary_has_all_tokens(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"))
    assert K.build_vocabulary(rows).agg(F.count("*"), F.max("token_id")).first()[:] == (40_000, 40_103)


def test_a_chunk_that_comes_twice_counts_once(spark):
    pieces = spark.createDataFrame([(1, 0, p, p) for p in range(3)] + [(1, 1, 0, 9)], "k INT, chunk INT, pos INT, v INT")
    expected = spark.createDataFrame([(1, 2)], "k INT, num_chunks INT")
    got = Q.reassemble_chunks(pieces.union(pieces.where("chunk = 0")), expected, "k", 3)
    assert sorted(r.event_idx for r in got.collect()) == [0, 1, 2, 3]


def test_patience_counts_evaluations(spark):
    history = spark.createDataFrame([("r", e, v) for e, v in ((0, 0.5), (5, 0.4), (6, 0.4), (9, 0.4))], "run_id STRING, epoch BIGINT, value DOUBLE")
    rows = M.early_stop(history, patience=2).orderBy("epoch").collect()
    assert [(r.epoch, r.counter, r.stopped) for r in rows] == [(0, 0, False), (5, 1, False), (6, 2, True)]


def test_events_meet_only_blocks_that_need_them(spark):
    events = spark.range(4096).select(F.lit(1).cast("bigint").alias("subject_id"), F.col("id").alias("event_idx"))
    samples = spark.range(4096).select(
        F.lit(1).cast("bigint").alias("subject_id"), F.col("id").alias("sample_no"), (F.col("id") + 1).alias("n_events")
    )
    tail = C.tail_of(samples.withColumn("sample_id", F.col("sample_no").cast("string")), 8)
    joined = C.join_history(events, tail, chunk_events=64, block_samples=64)
    assert joined.count() == 8 * 4096 - 28
    # Each chunk of 64 events is wanted by its own block of samples and, for its tail, by the next.
    wide = joined.select("event_idx", "block").distinct().count()
    assert wide <= 2 * 4096


def test_hot_groups_have_no_limit(spark):
    heavy = spark.range(3000).select(F.col("id").alias("k"), F.lit(2).alias("__n"))
    hot = HotGroups(heavy, ["k"])
    assert (hot.count, hot.total) == (3000, 6000)
    assert hot.outside(spark.range(3001).select(F.col("id").alias("k"))).count() == 1


def test_ingest_is_read_by_encode_and_goes_on_with_known_subjects(spark, tmp_path):
    shards, out = f"{tmp_path}/shards", f"{tmp_path}/out"
    rows = lambda s, first=0: spark.createDataFrame([(s, T0 + timedelta(hours=h), "c0", float(h)) for h in range(first, first + 3)], EVENTS)
    cohort = C.prepare_cohort(spark.createDataFrame([(1, T0 + timedelta(hours=5), True), (1, T0 + timedelta(hours=1), False)], COHORT))
    codes = spark.createDataFrame([("c0", "zero")], "code STRING, description STRING")
    run = lambda: ingest_shards(event_stream(spark, shards, rows(1).schema), cohort, out, ["code"], "MEDS_BIRTH", codes=codes)
    rows(1).write.parquet(f"{shards}/0")
    run().awaitTermination()
    J.encode_events(spark, out, f"{tmp_path}/encoded", *tables(spark), dim=3)
    assert spark.read.parquet(f"{tmp_path}/encoded/vectors").count() == 3
    words = spark.read.parquet(f"{tmp_path}/encoded/vocabulary").select("token").collect()
    assert "zero" in {r.token for r in words}
    listed = lambda: {r["subject_id"]: r["num_events"] for r in I.read_ingested(spark, out, "manifest").collect()}
    assert listed() == {"1_0": 2, "1_1": 3}
    # Earlier events of a known subject, and another one; then nothing; then both again.
    rows(1, -3).union(rows(2)).write.parquet(f"{shards}/1")
    run().awaitTermination()
    assert listed() == {"1_0": 5, "1_1": 6}
    rows(1).limit(0).write.parquet(f"{shards}/2")
    run().awaitTermination()
    rows(1, 3).union(rows(2, 3)).write.parquet(f"{shards}/3")
    run().awaitTermination()
    assert listed() == {"1_0": 5, "1_1": 9}
    state = {r["subject_id"]: r for r in I.read_state(spark, out, 4 if (tmp_path / "out/state/from=0/to=4").exists() else 3).collect()}
    assert (state[1]["n_events"], state[1]["n_samples"], state[2]["n_events"], state[2]["n_samples"]) == (9, 2, 6, 0)
    assert state[1]["first_time"] == T0 - timedelta(hours=3) and state[2]["last_time"] == T0 + timedelta(hours=5)
    events = I.read_ingested(spark, out, "events")
    assert sorted(r["event_idx"] for r in events.where("subject_id = 1").collect()) == list(range(9))
    assert I.read_ingested(spark, out, "samples").selectExpr("sum(size(events))").first()[0] == 14
    J.encode_events(spark, out, f"{tmp_path}/again", *tables(spark), dim=3)
    assert spark.read.parquet(f"{tmp_path}/again/vectors").count() == 15


def test_state_is_in_blocks_by_the_digits_of_the_batches(spark, tmp_path):
    out = str(tmp_path)
    state = lambda n: spark.createDataFrame([(s, [n], n, n + 1, 0, T0, T0) for s in (n, 99)], "subject_id long, batches array<int>, batch int, n_events int, n_samples int, first_time timestamp, last_time timestamp")
    for number in range(7):
        I._write_state(spark, out, number, state(number))
        assert len(I._blocks(number + 1)) <= 3
        rows = {r["subject_id"]: r for r in I.read_state(spark, out, number + 1).collect()}
        assert sorted(rows) == [*range(number + 1), 99]
        assert rows[99]["batches"] == list(range(number + 1)) and rows[99]["batch"] == number
    assert I._blocks(7) == [(0, 4), (4, 6), (6, 7)] and I.read_state(spark, out, 0) is None


def test_workers_need_no_installed_package(tmp_path):
    """A session started in another folder, whose workers can't import the package by themselves."""
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from anamnesis.operators import vectors as E
t = lambda n: spark.createDataFrame([(i, [float(i)]) for i in range(200)], n + " INT, embedding ARRAY<FLOAT>")
e = spark.createDataFrame([(1, [("a", 2, 0)])], "event_id INT, tokens ARRAY<struct<token:string,type_id:int,dpe_id:int>>")
v = spark.createDataFrame([("a", 104)], "token STRING, token_id INT")
print("VECTOR", E.event_vectors(e, v, t("token_id"), t("type_id"), t("dpe_id"), 1).first().repr)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "VECTOR [106.0]" in done.stdout, done.stderr[-2000:]
