"""The three jobs end to end on files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anamnesis import jobs as J
from anamnesis.operators import metrics as M
from anamnesis.sources import samples as SS

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def processed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    for split, subjects in {"train": (1, 2), "held_out": (3,)}.items():
        rows = [(s, T0 + timedelta(hours=h), f"c{h % 3}", float(h) if h % 2 else None) for s in subjects for h in range(8)]
        rows += [(s, T0 - timedelta(days=9000), "MEDS_BIRTH", None) for s in subjects]
        rows += [(s, T0, None, None) for s in subjects]
        events = spark.createDataFrame(rows, "subject_id BIGINT, time TIMESTAMP_NTZ, code STRING, numeric_value DOUBLE")
        events.write.parquet(f"{root}/events/{split}")
    asked = [(s, T0 + timedelta(hours=h), h > 3) for s in (1, 2, 3) for h in (-1, 2, 5)]
    asked.append((3, T0 + timedelta(hours=7), None))
    spark.createDataFrame(asked, "subject_id BIGINT, prediction_time TIMESTAMP_NTZ, boolean_value BOOLEAN").write.parquet(
        f"{root}/cohort/all"
    )
    codes = [("c0", "zero"), ("c1", "")]
    spark.createDataFrame(codes, "code STRING, description STRING").write.parquet(f"{root}/codes")
    J.process_events(spark, f"{root}/events", f"{root}/cohort", f"{root}/out", codes=f"{root}/codes")
    return root


def test_samples_and_manifest(spark, processed):
    manifest = SS.read_manifest(spark, f"{processed}/out/manifest")
    expected = {f"{s}_{n}": e for s in (1, 2, 3) for n, e in ((0, 3), (1, 6))}
    assert {r.subject_id: r.num_events for r in manifest.collect()} == expected
    samples = spark.read.parquet(f"{processed}/out/samples")
    assert {r.sample_id: len(r.events) for r in samples.collect()} == expected
    assert {r.split for r in samples.where("sample_id like '3_%'").select("split").collect()} == {"held_out"}
    first = samples.where("sample_id = '1_1'").first()
    assert [e.time_min for e in first.events] == [0, 60, 120, 180, 240, 300]
    assert [t.token for t in first.events[0].tokens] == ["[CLS]", "code", "zero", "[SEP]"]


def test_a_second_run_is_refused(spark, processed):
    with pytest.raises(FileExistsError):
        J.process_events(spark, f"{processed}/events", f"{processed}/cohort", f"{processed}/out")


def test_encode_and_predict(spark, processed):
    def table(name, n):
        rows = [(i, [float(i % 7) - 3, 1.0, float(i % 3)]) for i in range(n)]
        return spark.createDataFrame(rows, f"{name} INT, embedding ARRAY<FLOAT>")

    tables = table("token_id", 200), table("type_id", 8), table("dpe_id", 100)
    J.encode_events(spark, f"{processed}/out", f"{processed}/encoded", *tables, dim=3)
    vectors = spark.read.parquet(f"{processed}/encoded/vectors")
    assert vectors.count() == 24
    model = J.Model(
        heads={"meds_single_task": ("binary", [([0.3, -0.2, 0.1], 0.05)])},
        constant=[0.0, 0.0, 0.0],
        query=[1.0, 1.0, 0.0],
        max_retrieve_len=4,
    )
    got = J.predict_cohort(
        spark, f"{processed}/out", f"{processed}/encoded", model, f"{processed}/held_out.parquet", "held_out"
    )
    rows = got.orderBy("prediction_time").collect()
    assert [(r.subject_id, r.boolean_value) for r in rows] == [(3, False), (3, True)]
    assert all(0 < r.boolean_prediction < 1 for r in rows)
    nothing = J.predict_cohort(
        spark,
        f"{processed}/out",
        f"{processed}/encoded",
        J.Model(model.heads, model.constant, model.query, rejection_cutoff=1.0),
    )
    assert nothing.count() == 6
    assert nothing.select(F.round("boolean_prediction", 6)).distinct().count() == 1
    scored = got.select(
        F.lit("meds_single_task").alias("task"),
        F.col("boolean_value").cast("int").alias("truth"),
        F.col("boolean_prediction").alias("score"),
    )
    assert M.metrics_of_binary(scored).count() == 1
