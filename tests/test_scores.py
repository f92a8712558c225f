"""Losses, metrics, labels, retrieval and heads on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from anamnesis.functions import arrays as A
from anamnesis.functions.time import time_features
from anamnesis.operators import heads as H
from anamnesis.operators import metrics as M
from anamnesis.operators import retrieval as R
from anamnesis.operators import sequence as Q
from anamnesis.operators import vectors as E


def scored(spark, rows):
    return spark.createDataFrame(rows, "task STRING, truth INT, score DOUBLE")


def random_scores(seed, n=400):
    rng = random.Random(seed)
    return [("t", int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(n)]


def brute_auroc(rows):
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def test_auroc_counts_ties_half(spark):
    rows = random_scores(3)
    got = M.auroc(scored(spark, rows), ["task"], "truth", "score").first().auroc
    assert got == pytest.approx(brute_auroc(rows), abs=1e-12)


def test_auroc_of_flipped_scores_is_the_rest(spark):
    rows = random_scores(4)
    flipped = [(t, y, 1 - s) for t, y, s in rows]
    a = M.auroc(scored(spark, rows), ["task"], "truth", "score").first().auroc
    b = M.auroc(scored(spark, flipped), ["task"], "truth", "score").first().auroc
    assert a + b == pytest.approx(1.0, abs=1e-9)


def test_auroc_agrees_with_the_evaluator(spark):
    df = scored(spark, random_scores(5))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="truth", numBins=0)
    ours = M.auroc(df, ["task"], "truth", "score").first().auroc
    assert ours == pytest.approx(evaluator.evaluate(df.withColumn("truth", F.col("truth").cast("double"))), abs=1e-9)


def test_average_precision_over_distinct_scores(spark):
    rows = [("t", 1, 0.9), ("t", 0, 0.8), ("t", 1, 0.8), ("t", 0, 0.1)]
    got = M.auprc(scored(spark, rows), ["task"], "truth", "score").first().auprc
    assert got == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 3)


def test_a_single_class_has_no_auroc_and_stays_out_of_the_mean(spark):
    rows = random_scores(6) + [("one", 1, 0.4), ("one", 1, 0.6), ("one", -1, 0.2)]
    table = M.task_metrics(M.metrics_of_binary(scored(spark, rows)))
    got = {(r.task, r.metric): r.value for r in table.collect()}
    assert got[("one", "auroc")] is None
    assert got[("avg", "auroc")] == pytest.approx(got[("t", "auroc")])
    assert got[("avg", "acc")] == pytest.approx((got[("t", "acc")] + got[("one", "acc")]) / 2)


def test_half_scores_round_to_zero(spark):
    rows = [("t", 1, 0.5), ("t", 0, 0.5)]
    assert M.binary_accuracy(scored(spark, rows), ["task"], "truth", "score").first().acc == 0.5


def test_masked_rows_stay_in_the_divisor_and_logs_are_clamped(spark):
    rows = [("t", 1, 0.0), ("t", 0, 0.5), ("t", -1, 0.9), ("t", 1, 1.0)]
    got = M.masked_bce_loss(scored(spark, rows), ["task"], "truth", "score").first().loss
    assert got == pytest.approx((100 + math.log(2)) / 4)


def test_labels(spark):
    df = spark.createDataFrame([(2, [0, 2]), (-1, []), (None, None)], "one INT, many ARRAY<INT>")
    got = df.select(
        A.one_hot(F.col("one"), 3).alias("one"),
        A.multi_hot(F.col("many"), 3).alias("many"),
        A.binary_label(F.col("one")).alias("b"),
    ).collect()
    assert got[0].one == [0, 0, 1] and got[0].many == [1, 0, 1] and got[0].b == 2
    assert got[1].one == got[2].one == got[1].many == got[2].many == [-1, -1, -1]
    assert got[1].b == got[2].b == -1


def test_task_kinds(spark):
    names = ["mortality_1", "los_7", "diagnosis", "creatinine_2", "wbc_1", "hb_3", "meds_single_task", "other"]
    df = spark.createDataFrame([(n,) for n in names], "task STRING")
    got = {r.task: (r.kind, r.num_classes) for r in M.task_table(df, "umcdb").collect()}
    assert got["diagnosis"] == ("multilabel", 13)
    assert M.task_table(df).where("task = 'diagnosis'").first().num_classes == 17
    assert got["meds_single_task"] == got["mortality_1"] == got["los_7"] == ("binary", 1)
    assert got["creatinine_2"] == ("multiclass", 5) and got["wbc_1"] == ("multiclass", 3)
    assert got["hb_3"] == ("multiclass", 4) and got["other"] == (None, None)


@pytest.mark.parametrize("limit", ["1000000", "3"])
def test_early_stopping(spark, limit):
    rows = [("a", i, v) for i, v in enumerate([0.5, 0.5, 0.4, 0.4, 0.4, 0.9])]
    history = spark.createDataFrame(rows, "run_id STRING, epoch INT, value DOUBLE")
    spark.conf.set("anamnesis.hotRows", limit)
    try:
        got = M.early_stop(history).orderBy("epoch").collect()
    finally:
        spark.conf.unset("anamnesis.hotRows")
    assert [(r.is_best, r.counter, r.stopped) for r in got] == [
        (True, 0, False),
        (True, 0, False),
        (False, 1, False),
        (False, 2, False),
        (False, 3, True),
    ]


def repr_rows(spark, rows):
    return spark.createDataFrame(rows, "sample_id STRING, event_idx INT, time_min INT, repr ARRAY<FLOAT>")


def test_retrieval_rejects_ranks_and_restores_time(spark):
    rows = repr_rows(
        spark,
        [
            ("a", 0, 50, [1.0, 0.0]),
            ("a", 1, 40, [1.0, 0.1]),
            ("a", 2, 30, [-1.0, 0.0]),
            ("a", 3, 20, [0.0, 0.0]),
            ("a", 4, 10, [1.0, 0.0]),
            ("b", 0, 0, [0.0, 0.0]),
        ],
    )
    real = R.cosine_scores(R.mask_zero_vectors(rows), [1.0, 0.0])
    top = R.retrieve_topk(real, "sample_id", 2, 0.5)
    assert [(r.event_idx, r.rank, r.time_rank) for r in top.orderBy("rank").collect()] == [(0, 1, 2), (4, 2, 1)]
    weights = R.retrieval_weights(top, "sample_id")
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    pooled = E.mean_pool(top, ["sample_id"], "repr")
    filled = R.empty_retrieval_fallback(rows.select("sample_id").distinct(), pooled, "sample_id", [9.0, 9.0])
    assert {r.sample_id: r.pooled for r in filled.collect()} == {"a": [1.0, 0.0], "b": [9.0, 9.0]}


def test_mlp_matches_plain_numpy(spark):
    rng = np.random.default_rng(1)
    widths = [5, 4, 2, 1]
    layers = [
        R.Layer(rng.normal(size=(b, a)), rng.normal(size=b), rng.normal(size=b), rng.normal(size=b))
        for a, b in zip(widths, widths[1:])
    ] + [R.Layer(rng.normal(size=(1, 1)), rng.normal(size=1))]
    data = rng.normal(size=(20, 4)).astype(np.float32)
    rows = repr_rows(spark, [("a", i, i * 3, v.tolist()) for i, v in enumerate(data)])
    got = {r.event_idx: r.score for r in R.mlp_score(rows, layers).collect()}
    for i, v in enumerate(data):
        x = np.append(v.astype(np.float64), i * 3.0)
        for layer in layers:
            x = layer.weight @ x + layer.bias
            if layer.scale is not None:
                x = np.maximum((x - x.mean()) / np.sqrt(x.var() + 1e-5) * layer.scale + layer.shift, 0)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-x[0])), abs=1e-9)


def test_heads_and_fitting(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(2 if i % 2 else -2, 0.5), rng.random()], i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "i INT, pooled ARRAY<DOUBLE>, label INT")
    model = H.fit_head(df, "pooled", "label")
    assert H.predict_head(model, df, "pooled").where("predicted_label <> label").isEmpty()
    heads = {"m": ("multiclass", [([1.0, 0.0], 0.0), ([0.0, 1.0], 0.0)]), "b": ("binary", [([1.0, 0.0], 0.5)])}
    row = H.linear_heads(df, heads).first()
    a, b = row.pooled
    assert row.m == pytest.approx([math.exp(a) / (math.exp(a) + math.exp(b)), math.exp(b) / (math.exp(a) + math.exp(b))])
    assert row.b == pytest.approx([1 / (1 + math.exp(-a - 0.5))])


def test_event_vectors_agree_with_the_lookup_of_each_token(spark):
    token = "struct<token:string,type_id:int,dpe_id:int>"
    events = spark.createDataFrame(
        [(1, [("[CLS]", 5, 0), ("a", 2, 0), ("7", 3, 6), ("zzz", 3, 0)]), (2, [("a", 3, 0)])],
        f"event_id INT, tokens ARRAY<{token}>",
    )
    vocabulary = spark.createDataFrame([("a", 104), ("7", 105)], "token STRING, token_id INT")

    def table(name, ids):
        rows = [(i, [float(i), i / 7, -float(i)]) for i in ids]
        return spark.createDataFrame(rows, f"{name} INT, embedding ARRAY<FLOAT>")

    tables = table("token_id", [101, 104, 105]), table("type_id", range(8)), table("dpe_id", range(10))
    from anamnesis.operators import tokens as K

    long = K.token_ids(K.token_rows(events, ["event_id"]), vocabulary)
    looked = E.token_embedding_lookup(long, *tables, dim=3)
    slow = {r.event_id: r.pooled for r in E.mean_pool(looked, ["event_id"], "vector", skip_zero=False).collect()}
    fast = {r.event_id: r.repr for r in E.event_vectors(events, vocabulary, *tables, dim=3).collect()}
    assert fast.keys() == slow.keys()
    for key, vector in fast.items():
        assert vector == pytest.approx(slow[key], abs=1e-5)


def test_padding_of_batches(spark):
    df = spark.createDataFrame([(1, 0, [1, 2, 3, 4, 5]), (2, 0, [6]), (3, 1, [7])], "i INT, batch INT, v ARRAY<INT>")
    assert {r.i: r.v for r in Q.pad_pow2(df, "batch", "v").collect()} == {
        1: [1, 2, 3, 4, 5, 0, 0, 0],
        2: [6, 0, 0, 0, 0, 0, 0, 0],
        3: [7],
    }
    assert {r.i: r.v for r in Q.pad_pow2(df, "batch", "v", cap=4).collect()}[1] == [1, 2, 3, 4]
    left = {r.i: r.v for r in Q.pad_pow2(df, "batch", "v", cap=4, left=True).collect()}
    assert left[1] == [2, 3, 4, 5] and left[2] == [0, 0, 0, 6]
    assert {r.i: len(r.v) for r in Q.pad_multiple(df, "batch", "v", chunk=3).collect()} == {1: 6, 2: 6, 3: 3}
    assert {r.i: len(r.v) for r in Q.pad_multiple(df, "batch", "v", chunk=3, cap=64).collect()} == {1: 9, 2: 9, 3: 3}


def test_time_features(spark):
    df = spark.createDataFrame([(30,)], "t INT").select(time_features(F.col("t"), 4, 24).alias("f"))
    left = 24 * 60 - 30
    assert df.first().f == pytest.approx(
        [math.sin(left), math.cos(left), math.sin(left / 100), math.cos(left / 100)], abs=1e-9
    )


def test_token_cap_takes_the_memory_off():
    assert Q.token_cap(1) == 492 and Q.token_cap(7) == 3444


def test_weighted_prediction_over_the_given_tables(spark):
    """The query itself, whose retrieved events give a probability each."""
    from anamnesis.plans import vectors as V

    sf_dir = "/root/testdata/sf0.01"
    weighed = R.retrieval_weights(V.top(spark, sf_dir), "sample_id").select("sample_id", "weight", "repr").collect()
    wanted = {}
    for row in weighed:
        wanted[row.sample_id] = wanted.get(row.sample_id, 0.0) + row.weight / (1 + math.exp(-row.repr[0]))
    found = {row.sample_id: row.pred for row in V.weighted_prediction(spark, sf_dir).collect()}
    assert found and found == pytest.approx(wanted, abs=1e-6)
