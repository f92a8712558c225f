"""Vector expressions in DOUBLE over array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine_score(vector: Column, query: Sequence[float]) -> Column:
    """(cosine + 1) / 2 against one query vector; null for a zero vector."""
    length = sum(float(q) * float(q) for q in query) ** 0.5
    cosine = dot(vector, literal_vector(query)) / F.nullif(norm(vector) * length, F.lit(0.0))
    return (cosine + 1) / 2


def text_of(vector: Column, places: int = 6) -> Column:
    """Comma-joined, rounded values."""
    rounded = F.transform(vector, lambda x: fixed(x.cast("double"), places))
    return F.array_join(rounded, ",")


def fixed(number: Column, places: int = 6) -> Column:
    """A number as text with a fixed count of decimals."""
    return F.round(number, places).cast(f"decimal(38,{places})").cast("string")
