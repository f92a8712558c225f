"""Hand-made events and predictions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from anamnesis.operators import cohort as C
from anamnesis.operators import predict as P
from anamnesis.operators import retrieval as R
from anamnesis.operators import sequence as Q
from anamnesis.operators.tokens import drop_empty_events

T0 = datetime(2024, 1, 1)
EVENTS = "subject_id BIGINT, time TIMESTAMP_NTZ, code STRING, numeric_value DOUBLE, event_id BIGINT"
COHORT = "subject_id BIGINT, prediction_time TIMESTAMP_NTZ, boolean_value BOOLEAN"


def at(minutes=0.0):
    return T0 + timedelta(minutes=minutes)


def events(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EVENTS)


def cohort(spark, rows):
    return C.prepare_cohort(spark.createDataFrame(rows, COHORT))


def samples(spark, event_rows, cohort_rows):
    index = C.sample_index(events(spark, event_rows), cohort(spark, cohort_rows))
    return {r.sample_id: (r.n_events, r.label, r.endtime) for r in index.collect()}


def test_birth_and_static_events_go_and_a_null_code_stays(spark):
    rows = [
        (1, at(), "MEDS_BIRTH", None),
        (1, None, "static", None),
        (None, at(), "x", None),
        (1, at(1), None, 2.0),
        (1, at(2), "x", None),
    ]
    kept = C.drop_birth_and_static(events(spark, rows))
    assert [r.event_id for r in kept.orderBy("event_id").collect()] == [3, 4]


def test_a_known_birth_code_gives_no_warning(spark):
    codes = spark.createDataFrame([("MEDS_BIRTH", "")], "code STRING, description STRING")
    assert C.birth_code_warning(codes).isEmpty()
    assert C.birth_code_warning(codes, "OTHER").count() == 1


def test_history_is_inclusive_and_has_no_lower_bound(spark):
    got = samples(spark, [(1, at(0), "a", None), (1, at(5), "b", None), (1, at(6), "c", None)], [(1, at(5), True)])
    assert got == {"1_0": (2, True, at(5))}


def test_duplicate_predictions_collapse_and_two_labels_are_two_samples(spark):
    rows = [(1, at(5), True), (1, at(5), True), (1, at(5), False), (1, at(4), None)]
    got = samples(spark, [(1, at(0), "a", None)], rows)
    assert got == {"1_0": (1, False, at(5)), "1_1": (1, True, at(5))}


def test_a_prediction_without_history_takes_no_number(spark):
    got = samples(spark, [(1, at(5), "a", None)], [(1, at(1), True), (1, at(9), False)])
    assert got == {"1_0": (1, False, at(9))}


def test_elapsed_minutes_sort_first_and_round_half_to_even(spark):
    rows = [(1, at(1.5), "c", None), (1, at(0), "a", None), (1, at(0.5), "b", None), (1, at(2.5), "d", None)]
    ordered = C.order_events(events(spark, rows), ["event_id"]).orderBy("event_idx").collect()
    assert [(r.code, r.time_min) for r in ordered] == [("a", 0), ("b", 0), ("c", 2), ("d", 2)]


def test_elapsed_minutes_drop_parts_of_seconds_first(spark):
    rows = [(1, T0 + timedelta(milliseconds=900), "a", None), (1, T0 + timedelta(seconds=30, milliseconds=100), "b", None)]
    ordered = C.order_events(events(spark, rows), ["event_id"]).orderBy("event_idx").collect()
    assert [r.time_min for r in ordered] == [0, 0]


def test_elapsed_minutes_do_not_depend_on_the_session_zone(spark):
    rows = [(1, datetime(2024, 3, 31, 0, 30), "a", None), (1, datetime(2024, 3, 31, 4, 30), "b", None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        ordered = C.order_events(events(spark, rows), ["event_id"]).orderBy("event_idx").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.time_min for r in ordered] == [0, 240]


def test_events_without_any_field_are_dropped_before_numbering(spark):
    rows = [(1, at(0), "a", None), (1, at(1), None, None), (1, at(2), None, 3.0)]
    kept = drop_empty_events(events(spark, rows).drop("event_id"))
    assert kept.count() == 2


def test_descriptions_replace_codes_only_when_they_say_something(spark):
    codes = spark.createDataFrame([("a", "alpha"), ("b", ""), ("c", None)], "code STRING, description STRING")
    rows = [(1, at(), code, None) for code in ("a", "b", "c", "d", None)]
    got = C.describe_codes(events(spark, rows), codes).orderBy("event_id").collect()
    assert [r.code for r in got] == ["alpha", "b", "c", "d", None]


MANY = [(s, at(m * 7 + s), "x", float((m * 37 + s * 11) % 101)) for s in range(4) for m in range(40 if s else 120)]
ASKED = [(s, at(m * 31), m % 2 == 0) for s in range(4) for m in range(30 if s else 60)]


def brute_histories():
    out = {}
    for s in range(4):
        line = sorted((r[1], i, r[3]) for i, r in enumerate(MANY) if r[0] == s)
        number = 0
        for time, _ in sorted({(r[1], r[2]) for r in ASKED if r[0] == s}):
            history = [(i, v) for t, i, v in line if t <= time]
            if history:
                out[f"{s}_{number}"] = history
                number += 1
    return out


@pytest.mark.parametrize("chunk,block", [(1024, 1024), (7, 3), (1, 1)])
def test_joined_histories_match_a_nested_loop(spark, chunk, block):
    raw, asked = events(spark, MANY), cohort(spark, ASKED)
    index = C.sample_index(raw, asked)
    placed = C.order_events(raw, ["event_id"]).select("subject_id", "event_idx", "event_id")
    joined = C.join_history(placed, index, chunk_events=chunk, block_samples=block)
    got = {}
    for r in joined.orderBy("sample_id", "event_idx").collect():
        got.setdefault(r.sample_id, []).append(r.event_id)
    assert got == {k: [i for i, _ in v] for k, v in brute_histories().items()}

    tail = C.join_history(placed, C.tail_of(index, 5), chunk_events=chunk, block_samples=block)
    got = {}
    for r in tail.orderBy("sample_id", "event_idx").collect():
        got.setdefault(r.sample_id, []).append(r.event_id)
    assert got == {k: [i for i, _ in v][-5:] for k, v in brute_histories().items()}


def test_nested_samples_never_exceed_a_chunk(spark):
    raw, asked = events(spark, MANY), cohort(spark, ASKED)
    index = C.sample_index(raw, asked)
    placed = C.order_events(raw, ["event_id"]).select("subject_id", "event_idx", "event_id")
    nested = C.assemble_samples(C.join_history(placed, index, chunk_events=16), ["event_id"])
    rows = nested.orderBy("sample_id", "chunk").collect()
    assert max(len(r.events) for r in rows) == 16
    got = {}
    for r in rows:
        got.setdefault(r.sample_id, []).extend(e.event_id for e in r.events)
    assert got == {k: [i for i, _ in v] for k, v in brute_histories().items()}


@pytest.mark.parametrize("levels", [R.LEVELS, (4, 16, 64), (8, 1024), (2, 8, 32)])
def test_best_of_histories_match_a_full_sort(spark, levels):
    raw, asked = events(spark, MANY), cohort(spark, ASKED)
    index = C.sample_index(raw, asked)
    placed = C.order_events(raw, ["event_id"]).select(
        "subject_id", "event_idx", "event_id", F.col("numeric_value").alias("score")
    )
    got = {}
    for r in R.history_topk(placed, index, 3, levels).orderBy("sample_id", "rank").collect():
        got.setdefault(r.sample_id, []).append(r.event_id)
    expected = {}
    for sample, history in brute_histories().items():
        order = sorted(range(len(history)), key=lambda n: (-history[n][1], n))
        expected[sample] = [history[n][0] for n in order[:3]]
    assert got == expected


def test_best_of_histories_with_a_split_subject(spark, split_subjects):
    test_best_of_histories_match_a_full_sort(spark, (4, 16))


def test_window_keeps_the_last_event_when_none_qualifies(spark):
    rows = [("a", 0, 0), ("a", 1, 50), ("b", 0, 0), ("b", 1, 70), ("b", 2, 80)]
    df = spark.createDataFrame(rows, "sample_id STRING, event_idx INT, time_min INT")
    got = {(r.sample_id, r.event_idx) for r in Q.observation_window(df, "sample_id", 1).collect()}
    assert got == {("a", 1), ("b", 1), ("b", 2)}
    assert Q.observation_window(df, "sample_id", -1).count() == 5


def test_ids(spark):
    ids = spark.createDataFrame([("123_0",), ("7_12",)], "sample_id STRING")
    assert {r.subject_id for r in P.restore_subject_id(ids).collect()} == {123, 7}
    assert P.check_id_sets(ids, ids).isEmpty()
    assert P.check_id_sets(ids, ids.where("sample_id = '7_12'")).collect()[0].found_in == "data"
