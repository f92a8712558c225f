"""Time expressions that do not depend on the session time zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_seconds(time: Column) -> Column:
    return F.date_trunc("second", time).cast("timestamp_ntz")


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end`` (both TIMESTAMP_NTZ, whole seconds)."""
    gap = end - start

    def part(unit: str) -> Column:
        return F.date_part(F.lit(unit), gap).cast("bigint")

    return ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60 + part("SECOND")


def elapsed_minutes(first: Column, time: Column) -> Column:
    """Minutes from ``first`` to ``time``, halves to the even minute."""
    seconds = seconds_between(whole_seconds(first), whole_seconds(time))
    return F.bround(seconds / F.lit(60.0)).cast("int")


def time_features(minutes: Column, dim: int, pred_hours: int) -> Column:
    """Interleaved sine and cosine of the minutes left until the prediction time."""
    left = (F.lit(pred_hours * 60) - minutes).cast("double")
    rates = [math.exp(-2 * i * math.log(10000.0) / dim) for i in range(dim // 2)]
    parts = []
    for rate in rates:
        parts += [F.sin(left * rate), F.cos(left * rate)]
    return F.array(*parts)
