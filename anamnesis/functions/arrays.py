"""Array expressions: padding lengths, padding, label vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_power_of_two(length: Column, cap: int) -> Column:
    """Smallest power of two that holds ``length``, at most ``cap``."""
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) - 1e-9))
    return F.least(power.cast("int"), F.lit(cap))


def next_multiple(length: Column, chunk: int) -> Column:
    return (F.ceil(length / F.lit(float(chunk))) * chunk).cast("int")


def pad_right(values: Column, target: Column, fill: Column) -> Column:
    """Pad at the end; what is longer than the target loses its end."""
    kept = F.slice(values, F.lit(1), target)
    return F.concat(kept, F.array_repeat(fill, target - F.size(kept)))


def pad_left(values: Column, target: Column, fill: Column) -> Column:
    """Pad in front; what is longer than the target loses its front."""
    kept = F.slice(values, F.greatest(F.size(values) - target, F.lit(0)) + 1, target)
    return F.concat(F.array_repeat(fill, target - F.size(kept)), kept)


def binary_label(label: Column) -> Column:
    return F.coalesce(label.cast("int"), F.lit(-1))


def one_hot(label: Column, classes: int) -> Column:
    """One-hot vector, all -1 where the label is missing (null or -1)."""
    known = label.isNotNull() & (label != -1)
    hot = F.array(*[(label == c).cast("double") for c in range(classes)])
    return F.when(known, hot).otherwise(F.array(*[F.lit(-1.0)] * classes))


def multi_hot(labels: Column, classes: int) -> Column:
    """Multi-hot vector of a class list, all -1 where the list is empty."""
    hot = F.array(*[F.array_contains(labels, F.lit(c)).cast("double") for c in range(classes)])
    known = labels.isNotNull() & (F.size(labels) > 0)
    return F.when(known, hot).otherwise(F.array(*[F.lit(-1.0)] * classes))


def all_zero(vector: Column) -> Column:
    return ~F.exists(vector, lambda x: x != 0)
