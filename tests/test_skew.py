"""Split groups give what whole groups give."""

import random

import pytest
from pyspark.sql import functions as F

from anamnesis.operators.skew import attach, explode_range, find_hot, row_in_window, running


def rows_with_a_hot_key(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        rows.append((key, rng.randrange(20), i, rng.randrange(-5, 6)))
    return rows


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        total, before, best = 0, 0, None
        for k, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            before = total
            total += v
            best = v if best is None else max(best, v)
            out[i] = (k, total, before, best)
    return out


def measures():
    return {
        "total": ("sum", F.col("v")),
        "before": ("sum", F.col("v"), False),
        "best": ("max", F.col("v")),
    }


@pytest.mark.parametrize("limit", ["1000000", "40", "3"])
def test_running_values(spark, limit):
    rows = rows_with_a_hot_key(1)
    df = spark.createDataFrame(rows, "key STRING, at INT, i INT, v INT")
    spark.conf.set("anamnesis.hotRows", limit)
    try:
        got = running(df, ["key"], ["at", "i"], measures()).collect()
    finally:
        spark.conf.unset("anamnesis.hotRows")
    assert {r.i: (r.key, r.total, r.before, r.best) for r in got} == brute(rows)


def test_running_over_the_whole_table(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame(list(enumerate(values)), "i INT, v INT").repartition(5)
    got = running(df, [], ["i"], {"start": ("sum", F.col("v"), False)}).collect()
    assert {r.i: r.start for r in got} == {i: sum(values[:i]) for i in range(len(values))}


def test_hot_groups_are_found_heaviest_first(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)] * 5 + [("c",)], "key STRING")
    hot = find_hot(df, ["key"], 4)
    assert hot and hot.total == 14
    assert {r.key for r in hot.inside(df).distinct().collect()} == {"a", "b"}
    assert {r.key for r in hot.outside(df).distinct().collect()} == {"c"}
    assert not find_hot(df, ["key"], 100)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_attach_is_a_join(spark, split_groups, how):
    df = spark.createDataFrame([("hot", i) for i in range(9)] + [("x", 1), (None, 2)], "key STRING, v INT")
    unique = spark.createDataFrame([("hot", 1), ("y", 2)], "key STRING, w INT")
    got = sorted(map(str, attach(df, unique, ["key"], how).collect()))
    assert got == sorted(map(str, df.join(unique, ["key"], how).collect()))


@pytest.mark.parametrize("limit", [2, 5])
def test_first_rows_with_and_without_early_cut(spark, limit):
    df = spark.createDataFrame(rows_with_a_hot_key(2), "key STRING, at INT, i INT, v INT")
    order = [F.desc("v"), F.col("i")]
    expected = sorted(map(str, row_in_window(df, ["key"], order, limit).collect()))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "1")
    try:
        got = sorted(map(str, row_in_window(df, ["key"], order, limit).collect()))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    assert got == expected


def test_long_ranges_are_exploded_in_steps(spark):
    df = spark.createDataFrame([(3, 9000), (5, 5), (4095, 4096)], "a BIGINT, b BIGINT")
    got = explode_range(df, "n", F.col("a"), F.col("b")).groupBy("a").agg(
        F.count("n").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")
    )
    assert {(r.a, r.c, r.lo, r.hi) for r in got.collect()} == {
        (3, 8998, 3, 9000),
        (5, 1, 5, 5),
        (4095, 2, 4095, 4096),
    }
