"""Fetches that read what they need, lookups by number, balanced lists, tables in blocks, encoders with a set-up."""

import os

import numpy as np
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from anamnesis.operators import cohort as C
from anamnesis.operators import sequence as Q
from anamnesis.operators import vectors as E
from anamnesis.sources import samples as SS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- samples by manifest ------------------------------------------------------------------


@pytest.fixture
def samples(spark, tmp_path):
    rows = spark.range(600).select(
        F.format_string("%d_0", F.col("id") % 200).alias("sample_id"),
        F.floor(F.col("id") / 200).alias("chunk"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("held out").alias("split"),
        (F.col("id") % 200 % 4).cast("int").alias("shard_id"),
        F.array(F.struct(F.col("id").alias("event_idx"))).alias("events"),
    )
    SS.write_samples(rows, f"{tmp_path}/samples")
    return spark.read.parquet(f"{tmp_path}/samples")


def wanted(spark, numbers):
    rows = [(f"{i}_0", 1, i % 4, "train" if i % 2 == 0 else "held out") for i in numbers]
    return spark.createDataFrame(rows, "subject_id string, num_events long, shard_id int, split string")


@pytest.mark.parametrize(("few", "most"), [(1000, 2000), (2, 2000), (0, 3)])
def test_fetch_of_samples(spark, samples, few, most):
    asked = wanted(spark, [3, 3, 5, 8, 8, 17, 999])
    found = SS.read_samples_by_manifest(samples, asked, few, most)
    assert sorted((r["sample_id"], r["chunk"]) for r in found.collect()) == sorted((f"{i}_0", c) for i in (3, 5, 8, 17) for c in range(3))
    if most > 3:
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
    if few > 2:
        assert "In(sample_id, [" in plan(found)
    wrong = asked.withColumn("split", F.lit("train")).where("subject_id = '3_0'")
    assert SS.read_samples_by_manifest(samples, wrong, few, most).count() == 0
    assert SS.read_samples_by_manifest(samples, asked.limit(0), few, most).count() == 0


def test_samples_are_in_order_in_each_file(spark, samples):
    rows = samples.select(F.col("_metadata.file_path").alias("file"), "sample_id", "chunk", F.monotonically_increasing_id().alias("row")).orderBy("row")
    by_file = {}
    for r in rows.collect():
        by_file.setdefault(r["file"], []).append((r["sample_id"], r["chunk"]))
    assert all(v == sorted(v) for v in by_file.values()) and len(by_file) > 3


# --- the cache by chunk -------------------------------------------------------------------


def test_only_files_with_wanted_chunks_are_read(spark, tmp_path):
    path = f"{tmp_path}/some + cache"
    rows = spark.range(4000).select(
        F.format_string("s%02d", F.floor(F.col("id") / 100)).alias("sample_id"),
        (F.col("id") % 100).cast("int").alias("event_idx"),
        F.array(F.col("id").cast("float")).alias("repr"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        SS.write_repr_cache(rows.repartition(3), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    asked = spark.createDataFrame([("s03", 0), ("s03", 0), ("s03", 9), ("s07", 2), ("s07", 40), ("none", 0), (None, 1), ("s01", None)], "sample_id string, chunk int")
    found = SS.read_repr_cache(spark, path, asked, max_len=10)
    got = sorted((r["sample_id"], r["event_idx"], r["repr"][0]) for r in found.collect())
    assert got == sorted(
        (f"s{s:02d}", e, float(s * 100 + e)) for s, first in ((3, 0), (3, 90), (7, 20)) for e in range(first, first + 10)
    )
    written = [f for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(written) > 1 and len([f for f in found.inputFiles() if "cache" in f]) < len(written)
    assert SS.read_repr_cache(spark, path).count() == 4000
    assert SS.read_repr_cache(spark, path, asked.limit(0), max_len=10).count() == 0
    many = SS.read_repr_cache(spark, path, spark.range(40).select(F.format_string("s%02d", "id").alias("sample_id"), F.lit(1).alias("chunk")), max_len=10)
    assert many.count() == 400


def test_the_written_copy_is_the_same_in_any_order(spark):
    rows = [(1, 0, [0.0, 0.0], 1), (1, 0, [1.0, 2.0], 2), (1, 0, [1.0, 3.0], 1), (2, 0, [0.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "s int, e int, repr array<double>, n int")
    for order in (df, df.orderBy(F.desc("n")), df.repartition(4)):
        got = {(r["s"], tuple(r["repr"])) for r in SS.merge_partial_reprs(order, ("s", "e")).collect()}
        assert got == {(1, (1.0, 3.0)), (2, (0.0, 0.0))}


# --- chunks by number, subjects by worker -------------------------------------------------


def test_chunk_lookup_is_the_row_of_the_index(spark):
    lengths = spark.createDataFrame([(i, [0, 1, 7, 8, 9, 25][i % 6]) for i in range(40)], "s long, n long")
    index = {r["global_chunk"]: tuple(r)[1:] for r in Q.chunk_index(lengths, "s", "n", 8).collect()}
    numbers = [None, -1, *range(len(index) + 3), 5, 5, 10**15]
    asked = spark.createDataFrame([(i, n, "x") for i, n in enumerate(numbers)], "row int, global_chunk long, s2 string")
    found = Q.chunk_lookup(lengths, asked, "s", "n", 8)
    assert found.columns == ["row", "global_chunk", "s2", "s", "chunk", "start", "stop"]
    got = {r["row"]: tuple(r)[1:] for r in found.collect()}
    assert got == {i: (n, "x", *index.get(n, (None,) * 4)) for i, n in enumerate(numbers)}
    assert Q.chunk_lookup(lengths.limit(0), asked, "s", "n", 8).where("s is null").count() == len(numbers)
    assert Q.chunk_lookup(lengths, asked.limit(0), "s", "n", 8).count() == 0


def test_lists_of_workers_are_balanced(spark):
    sizes = {s: [1, 3, 40, 7, 2][s % 5] for s in range(60)}
    events = spark.createDataFrame([(s,) for s, n in sizes.items() for _ in range(n)], "subject_id long")
    rows = C.worker_lists(events, 6).collect()
    assert {r["subject_id"]: r["n_events"] for r in rows} == sizes
    lists = [sum(r["n_events"] for r in rows if r["worker"] == w) for w in range(6)]
    assert max(lists) - min(lists) <= 40
    ordered = [r["worker"] for r in sorted(rows)]
    assert ordered == sorted(ordered)
    one = C.worker_lists(events.where("subject_id = 2"), 6).collect()
    assert len(one) == 1 and 0 <= one[0]["worker"] < 6
    assert C.worker_lists(events.limit(0), 6).count() == 0


# --- tables too large to send -------------------------------------------------------------


def coded(spark, seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        tokens = [("[CLS]", 5, 0)] + [(f"w{min(int(rng.zipf(1.3)), 400)}", int(rng.integers(1, 5)), int(rng.integers(0, 9))) for _ in range(rng.integers(0, 30))]
        rows.append((i, f"k{i}", tokens))
    return spark.createDataFrame(rows, "event_id long, other string, tokens array<struct<token:string,type_id:int,dpe_id:int>>")


def embeddings(spark, name, ids, seed, dim=4):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=dim)]) for i in ids], f"{name} int, embedding array<float>")


def tables(spark):
    words = spark.createDataFrame([(f"w{i}", 103 + i) for i in range(1, 380)], "token string, token_id int")
    # Not all ids have a vector.
    token = embeddings(spark, "token_id", [i for i in range(0, 500) if i % 13], 1)
    return words, token, embeddings(spark, "type_id", range(8), 2), embeddings(spark, "dpe_id", range(100), 3)


@pytest.mark.parametrize(("block", "rows"), [(10, 50), (1000, 10**6), (40, 10**6)])
def test_tables_in_blocks_give_the_same_vectors(spark, monkeypatch, block, rows):
    monkeypatch.setattr(E, "BLOCK_BYTES", block * 4 * 4)
    monkeypatch.setattr(E, "BLOCK_ROWS", rows)
    events = coded(spark, block, 80)
    words, *parts = tables(spark)
    expected = {r["event_id"]: r["repr"] for r in E.event_vectors(events, words, *parts, 4).collect()}
    sums = E.token_sums(events, "event_id", words, *parts, 4, block_bytes=block * 16).collect()
    assert len(sums) == 80
    for r in sums:
        assert np.allclose(np.array(r["vector"]) / r["n_tokens"], expected[r["event_id"]], atol=1e-5)


def test_no_table_is_refused(spark, monkeypatch):
    events = coded(spark, 5, 40)
    words, *parts = tables(spark)
    expected = {r["event_id"]: r["repr"] for r in E.event_vectors(events, words, *parts, 4).collect()}
    monkeypatch.setattr(E, "MAX_TABLE_BYTES", 100)
    found = E.event_vectors(events, words, *parts, 4)
    assert found.columns == ["event_id", "other", "repr"]
    got = found.collect()
    assert len(got) == 40 and all(np.allclose(r["repr"], expected[r["event_id"]], atol=1e-5) and r["other"] == f"k{r['event_id']}" for r in got)


# --- encoders -----------------------------------------------------------------------------


def test_an_encoder_is_set_up_once_in_a_worker(spark, tmp_path):
    log = str(tmp_path / "set_up")

    def load():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")

        def encode(batch):
            return np.stack([pc.utf8_length(batch.column("code")).to_numpy(), batch.column("n").to_numpy()], axis=1)

        return encode

    events = spark.range(200).select("id", F.repeat(F.lit("x"), (F.col("id") % 5).cast("int")).alias("code"), (F.col("id") * 2).alias("n"))
    coded = E.encode_with(events.repartition(40), ["id"], ["code", "n"], set_up=load)
    got = {r["id"]: r["repr"] for r in coded.collect()}
    assert got == {i: [float(i % 5), float(2 * i)] for i in range(200)}
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) < 40


def test_a_plain_encoder_and_wrong_ones(spark):
    events = spark.range(3).withColumn("n", F.col("id"))
    found = E.encode_with(events, ["id"], ["n"], lambda batch: np.ones((batch.num_rows, 2)))
    assert [r["repr"] for r in found.collect()] == [[1.0, 1.0]] * 3
    with pytest.raises(Exception, match="vectors came back"):
        E.encode_with(events, ["id"], ["n"], lambda batch: np.ones((1 + batch.num_rows, 2))).collect()
    with pytest.raises(ValueError, match="either"):
        E.encode_with(events, ["id"], ["n"])
