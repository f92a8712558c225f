"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import SMALLEST as SF_DIR
from oracle import compare

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    if name in SQL:
        assert compare(spark, duck, SF_DIR, QUERIES[name], SQL[name], empty=True) is None
    else:
        assert QUERIES[name](spark, SF_DIR).count() > 0


# Queries whose groups are split when a group is large.
SPLIT = [
    "history_span",
    "cohort_event_join",
    "assemble_samples",
    "history_window",
    "history_topk",
    "group_events_by_time",
    "observation_window",
    "reassemble_chunks",
    "early_stop",
    "read_samples_by_manifest",
    "describe_codes",
]


@pytest.mark.parametrize("name", SPLIT)
def test_matches_sql_when_groups_are_split(spark, duck, split_subjects, name):
    assert compare(spark, duck, SF_DIR, QUERIES[name], SQL[name], empty=True) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["sample_id", "label", "n_events", "span_minutes"]
    assert result.count() > 0
