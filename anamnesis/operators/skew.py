"""Per-group running values, joins and shares that hold when one group is huge.

A plain ``Window.partitionBy(key)`` puts a whole group into one task. The
helpers here first look for groups above ``hot_rows`` rows; without any the plain
window is used, otherwise only the rows of those groups take the split route.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anamnesis.sources.workspace import materialise

HOT_ROWS = 1_000_000
#: Hot groups up to which their list, and one partner row for each, is broadcast.
BROADCAST_GROUPS = 100_000
SALTS = 64
STEP = 4096

_SEG = "__seg"


def hot_rows(spark: SparkSession) -> int:
    """Rows from which a group is split (``anamnesis.hotRows`` in the session)."""
    return int(spark.conf.get("anamnesis.hotRows", str(HOT_ROWS)))


class HotGroups:
    """All groups of a table above a number of rows, as a written table of keys and sizes.

    Find them once for a job and hand them to its steps. The list is as long as the data
    make it; only a short one is broadcast.
    """

    def __init__(self, heavy: DataFrame, keys: Sequence[str]) -> None:
        self.keys = list(keys)
        self._table = materialise(heavy, "hot")
        self.count, self.total = self._table.agg(F.count(F.lit(1)), F.coalesce(F.sum("__n"), F.lit(0))).first()

    def __bool__(self) -> bool:
        return self.count > 0

    def few(self, df: DataFrame) -> DataFrame:
        """A table of at most one row per hot group, broadcast when there are few groups."""
        return F.broadcast(df) if self.count <= BROADCAST_GROUPS else df

    def frame(self) -> DataFrame:
        return self.few(self._table.select(*[F.col(k).alias(f"__hot_{k}") for k in self.keys]))

    def _matches(self, df: DataFrame) -> tuple[DataFrame, Column]:
        hot = self.frame()
        condition = F.lit(True)
        for key in self.keys:
            condition = condition & df[key].eqNullSafe(hot[f"__hot_{key}"])
        return hot, condition

    def inside(self, df: DataFrame) -> DataFrame:
        hot, condition = self._matches(df)
        return df.join(hot, condition, "left_semi")

    def outside(self, df: DataFrame) -> DataFrame:
        hot, condition = self._matches(df)
        return df.join(hot, condition, "left_anti")


def find_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> HotGroups:
    """Groups of ``keys`` above the limit, from one map-side combined count."""
    limit = hot_rows(df.sparkSession) if limit is None else limit
    heavy = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > limit)
    )
    return HotGroups(heavy, keys)


# How a running value of one segment is merged with that of all earlier segments.
_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def _frame(inclusive: bool) -> int:
    return Window.currentRow if inclusive else -1


def _empty_as_zero(kind: str, value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) if kind == "sum" else value


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    measures: Mapping[str, tuple],
    hot: HotGroups | None = None,
) -> DataFrame:
    """Add running values per group, in an order that is total within the group.

    ``measures`` maps an output name to ``(kind, column)`` or ``(kind, column, inclusive)``
    with kind ``sum``, ``min`` or ``max``. With no keys the order is global and always split.
    """
    if not keys:
        return running_split(df, keys, order, measures)
    hot = find_hot(df, keys) if hot is None else hot
    if not hot:
        return _running_plain(df, keys, order, measures)
    return _running_plain(hot.outside(df), keys, order, measures).unionByName(
        running_split(hot.inside(df), keys, order, measures, total=hot.total)
    )


def _measure(spec: tuple) -> tuple[str, Column, bool]:
    kind, column, *rest = spec
    return kind, column, (rest[0] if rest else True)


def _running_plain(df, keys, order, measures, extra=()):
    window = Window.partitionBy(*keys, *extra).orderBy(*order)
    out = {}
    for name, spec in measures.items():
        kind, column, inclusive = _measure(spec)
        over = window.rowsBetween(Window.unboundedPreceding, _frame(inclusive))
        out[name] = _empty_as_zero(kind, _COMBINE[kind][0](column).over(over))
    return df.withColumns(out)


def running_split(df, keys, order, measures, total: int | None = None) -> DataFrame:
    """Running values over range-ordered segments instead of whole groups.

    The rows are range partitioned by (keys, order) and written, so that each row's
    segment number is fixed. Each segment is scanned on its own, and one carry per
    (group, segment) brings in what came before. A segment holds about ``hot_rows`` rows
    where the ``total`` of rows is known, else the session's partitions set it. There are
    as many carries as segments and groups together; they are joined by an ordinary join.
    """
    spark = df.sparkSession
    named = {f"__in_{i}": _measure(spec)[1] for i, spec in enumerate(measures.values())}
    ranked = df.withColumns(named) if named else df
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    if total is None:
        ranged = ranked.repartitionByRange(*by)
    else:
        ranged = ranked.repartitionByRange(max(2, total // hot_rows(spark) + 1), *by)
    fixed = materialise(ranged.withColumn(_SEG, F.spark_partition_id()), "segments")

    inputs = {}
    for i, (name, spec) in enumerate(measures.items()):
        kind, _, inclusive = _measure(spec)
        inputs[name] = (kind, F.col(f"__in_{i}"), inclusive)
    local = _running_plain(fixed, list(keys), order, inputs, extra=[_SEG])

    totals = fixed.groupBy(*keys, _SEG).agg(
        *[_COMBINE[k][0](c).alias(f"__t_{n}") for n, (k, c, _) in inputs.items()]
    )
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(_SEG)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *[F.col(k).alias(f"__c_{k}") for k in keys],
        F.col(_SEG).alias("__c_seg"),
        *[_COMBINE[k][0](f"__t_{n}").over(earlier).alias(f"__c_of_{n}") for n, (k, _, _) in inputs.items()],
    )
    condition = F.col(_SEG) == F.col("__c_seg")
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__c_{key}"))
    joined = local.join(carry, condition)
    out = {
        n: _COMBINE[k][1](F.col(f"__c_of_{n}"), F.col(n)) for n, (k, _, _) in inputs.items()
    }
    return joined.select(
        *[c for c in df.columns if c not in out], *[v.alias(n) for n, v in out.items()]
    )


def row_in_window(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int
) -> DataFrame:
    """The first ``limit`` rows per key with their ``rank``.

    The rows are first ranked in ``SALTS`` parts of each group, so that a group that all
    input partitions hold doesn't meet in one task with all their candidates.
    """

    def first(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return rows.withColumn("rank", rank).where(F.col("rank") <= limit)

    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    return first(first(salted, *keys, "__salt").drop("rank", "__salt"), *keys)


def explode_range(df: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
    """One row per whole number in ``first..last``, by steps so that no array gets long."""
    steps = df.withColumns({"__first": first, "__last": last}).withColumn(
        "__step", F.explode(F.sequence(F.floor(F.col("__first") / STEP), F.floor(F.col("__last") / STEP)))
    )
    numbers = F.sequence(
        F.greatest(F.col("__first"), F.col("__step") * STEP),
        F.least(F.col("__last"), F.col("__step") * STEP + (STEP - 1)),
    )
    return steps.withColumn(name, F.explode(numbers)).drop("__first", "__last", "__step")


def attach(
    df: DataFrame, unique: DataFrame, keys: Sequence[str], how: str = "inner", hot: HotGroups | None = None
) -> DataFrame:
    """Join a table that has at most one row per key.

    Rows of hot keys meet their partner rows, one per hot key, by broadcast where these are
    few, else in a join that adaptive execution splits. The rest is an ordinary join.
    """
    hot = find_hot(df, keys) if hot is None else hot
    if not hot:
        return df.join(unique, list(keys), how)
    cold = hot.outside(df).join(unique, list(keys), how)
    few = hot.few(hot.inside(unique))
    return cold.unionByName(hot.inside(df).join(few, list(keys), how))
