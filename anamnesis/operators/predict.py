"""Predictions back onto the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_predictions(cohort: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    return cohort.join(predictions, key, "left")


def check_id_sets(data: DataFrame, cohort: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids found on one side only; no rows when the two sets are equal."""
    ours, theirs = data.select(key).distinct(), cohort.select(key).distinct()
    missing = ours.join(theirs, key, "left_anti").withColumn("found_in", F.lit("data"))
    extra = theirs.join(ours, key, "left_anti").withColumn("found_in", F.lit("cohort"))
    return missing.unionByName(extra)


def id_set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in exactly one of the two tables."""
    return (
        left.exceptAll(right)
        .withColumn("side", F.lit("left"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    )


def restore_subject_id(df: DataFrame, sample: str = "sample_id") -> DataFrame:
    """``"123_0"`` becomes the subject 123."""
    subject = F.split_part(F.col(sample), F.lit("_"), F.lit(1)).cast("bigint")
    return df.withColumn("subject_id", subject)


def predicted_label(df: DataFrame, score: str = "boolean_prediction") -> DataFrame:
    return df.withColumn("predicted_label", (F.col(score) > 0.5).cast("int"))
