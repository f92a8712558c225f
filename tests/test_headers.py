"""Scans by header: other orders, further and missing columns, rows that don't fit, odd files and paths."""

import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from anamnesis import jobs
from anamnesis.sources import events as SE


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


ROOT = {
    "a/one.csv": "subject_id,time,code,numeric_value\n1,2024-01-01 00:00:00,x,1.5\n",
    "a/two.csv": 'time,code,subject_id,numeric_value,unit\n2024-01-02 00:00:00,"y, ""z""",7,,mg\n',
    "b/three.csv": '﻿code,subject_id,"odd\nname",time\nw,8,k,2024-01-03 00:00:00\n',
    "b/empty.csv": "",
    "b/header only.csv": "subject_id,time,code,numeric_value,later\n",
}


@pytest.fixture
def root(tmp_path):
    for name, text in ROOT.items():
        put(tmp_path, name, text)
    return str(tmp_path)


def test_columns_go_by_name(spark, root):
    found = SE.scan_events(spark, root)
    assert set(found.columns) == {"subject_id", "time", "code", "numeric_value", "unit", "odd\nname", "later"}
    assert found.columns[:4] == ["subject_id", "time", "code", "numeric_value"]
    assert dict(found.dtypes)["time"] == "timestamp_ntz" and dict(found.dtypes)["unit"] == "string"
    rows = {r["subject_id"]: r for r in found.collect()}
    assert sorted(rows) == [1, 7, 8]
    assert (rows[1]["time"], rows[1]["code"], rows[1]["numeric_value"], rows[1]["unit"]) == (datetime(2024, 1, 1), "x", 1.5, None)
    assert (rows[7]["time"], rows[7]["code"], rows[7]["numeric_value"], rows[7]["unit"]) == (datetime(2024, 1, 2), 'y, "z"', None, "mg")
    assert rows[8]["code"] == "w" and rows[8]["odd\nname"] == "k"


def test_origin_outlives_the_union(spark, root):
    origin = {"split": SE.split_from_path(root), "row": SE.source_order()}
    found = SE.scan_events(spark, root, origin=origin).collect()
    assert {(r["subject_id"], r["split"]) for r in found} == {(1, "a"), (7, "a"), (8, "b")}
    assert len({r["row"] for r in found}) == 3


def test_rows_that_do_not_fit_are_told_apart_whatever_is_read(spark, tmp_path):
    put(tmp_path, "x/one.csv", "subject_id,time,code,numeric_value\n1,2024-01-01 00:00:00,a,1\n2,soon,b,1\n3,2024-01-01 00:00:00,c\n4,2024-01-01 00:00:00,d,,9\nfive,2024-01-01 00:00:00,e,1\n")
    put(tmp_path, "x/two.csv", "code,subject_id,time\nf,6,2024-01-01 00:00:00\ng,7,2024-99-01\n")
    found = SE.scan_events(spark, str(tmp_path), malformed=True)
    wrong = found.where(F.col(SE.MALFORMED).isNotNull())
    assert {r["code"] for r in found.where(F.col(SE.MALFORMED).isNull()).select("code").collect()} == {"a", "f"}
    texts = {r[0] for r in wrong.select(SE.MALFORMED).collect()}
    assert len(texts) == 5 and "2,soon,b,1" in texts and "4,2024-01-01 00:00:00,d,,9" in texts and "g,7,2024-99-01" in texts
    assert found.count() == 7


def test_odd_files(spark, tmp_path):
    put(tmp_path, "no/one.csv", "1,2024-01-01 00:00:00,x,1.5\n")
    with pytest.raises(ValueError, match="first line"):
        SE.scan_events(spark, str(tmp_path / "no"))
    put(tmp_path, "twice/one.csv", "subject_id,time,code,code\n")
    with pytest.raises(ValueError, match="twice"):
        SE.scan_events(spark, str(tmp_path / "twice"))
    put(tmp_path, "none/one.csv", "")
    assert SE.scan_events(spark, str(tmp_path / "none"), malformed=True).count() == 0
    put(tmp_path, "{od}d [1] 100%,*/a b.csv", ROOT["a/one.csv"])
    put(tmp_path, "{od}d [1] 100%,*/c.csv", ROOT["a/two.csv"])
    odd = SE._files(spark, str(tmp_path).replace("\\", ""), "csv")
    assert any(f.endswith("/{od}d [1] 100%,*/a b.csv") for f in odd)
    groups = SE.csv_groups(spark, [f for f in odd if "{od}d" in f])
    assert [len(v) for v in groups.values()] == [1, 1]
    inferred = SE.scan_events(spark, put(tmp_path, "typed.csv", "subject_id,time,code,dose\n1,2024-01-01 00:00:00,x,2\n"), None)
    assert dict(inferred.dtypes)["dose"] == "int"
    alone = put(tmp_path, "alone.csv", ROOT["a/two.csv"])
    assert SE.scan_events(spark, alone).first()["unit"] == "mg"
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as out:
        out.write("x\n")


def test_paths_with_marks_of_patterns(spark, tmp_path):
    folder = tmp_path / "plain"
    put(folder, "x[1]{a,b}*?/a b%20.csv", ROOT["a/one.csv"])
    put(folder, "x[1]{a,b}*?/c.csv", ROOT["a/two.csv"])
    assert {r["subject_id"] for r in SE.scan_events(spark, str(folder)).collect()} == {1, 7}


def test_parquet_files_with_other_columns(spark, tmp_path):
    spark.sql("SELECT 1L subject_id, timestamp_ntz '2024-01-01' time, 'x' code").write.parquet(f"{tmp_path}/a/one")
    spark.sql("SELECT 'y' code, 2L subject_id, timestamp_ntz '2024-01-01' time, 'mg' unit").write.parquet(f"{tmp_path}/a/two")
    rows = {r["subject_id"]: r["unit"] for r in SE.scan_events(spark, str(tmp_path)).collect()}
    assert rows == {1: None, 2: "mg"}


def test_a_cohort_row_that_does_not_fit_is_an_error(spark, tmp_path):
    put(tmp_path, "c.csv", "boolean_value,prediction_time,subject_id\ntrue,2024-01-01 00:00:00,1\n,2024-01-02 00:00:00,2\n")
    rows = SE.scan_cohort(spark, str(tmp_path)).collect()
    assert {(r["subject_id"], r["boolean_value"]) for r in rows} == {(1, True), (2, None)}
    put(tmp_path, "d.csv", "boolean_value,prediction_time,subject_id\nperhaps,2024-01-01 00:00:00,3\n")
    with pytest.raises(Exception, match="not a row of a cohort"):
        SE.scan_cohort(spark, str(tmp_path)).collect()


def test_the_job_keeps_all_columns_and_lists_what_does_not_fit(spark, tmp_path):
    put(tmp_path, "events/train/one.csv", "code,time,subject_id,unit,numeric_value\na,2024-01-01 00:00:00,1,mg,2\nb,2024-01-02 00:00:00,1,ml,oops\n")
    put(tmp_path, "events/train/two.csv", "subject_id,time,code,numeric_value,site\n1,2024-01-03 00:00:00,c,3,left\n")
    put(tmp_path, "cohort/all.csv", "prediction_time,boolean_value,subject_id\n2024-02-01 00:00:00,true,1\n")
    out = f"{tmp_path}/out"
    jobs.process_events(spark, f"{tmp_path}/events", f"{tmp_path}/cohort", out)
    events = spark.read.parquet(f"{out}/events").orderBy("time").collect()
    texts = [[t["token"] for t in r["tokens"]] for r in events]
    assert len(texts) == 2 and "mg" in texts[0] and "left" in texts[1] and "unit" not in texts[1]
    broken = spark.read.parquet(f"{out}/malformed").collect()
    assert [(r["split"], r[SE.MALFORMED]) for r in broken] == [("train", "b,2024-01-02 00:00:00,1,ml,oops")]
    assert broken[0]["file"].endswith("one.csv")
