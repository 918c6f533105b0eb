"""Exact ranks, quantiles and running sums without one task that holds everything.

Rows are dealt into ranges of the order columns, all of them, so that equal values of the first are split by the others.
How many ranges there are follows from the amount of data. The ranges are written once (the deal must not change between
counting and numbering), and each is numbered on its own from where those before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamstage.storage import cut

_PART, _AT = "__part", "__at"


def _ranges(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` in order of ``by``, with the number of each row's range and its place in the order of all rows."""
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(dealt.withColumn(_AT, F.monotonically_increasing_id())).withColumn(_PART, F.shiftright(_AT, 33))


def _before(parts: DataFrame, group: list[str], column: str) -> DataFrame:
    """``parts`` (a row per group and range) with the sum of ``column`` over the ranges before, and over all as ``n``."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # as many rows as ranges
    return parts.withColumns({"__before": F.sum(column).over(w.orderBy(_PART)) - F.col(column), "n": F.sum(column).over(w)})


def positions(df: DataFrame, order: list[str], group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """``df`` with ``rn`` (from 1, by ``order``) and ``n`` (rows) of each group.

    With ``weight``, a row stands for so many equal ones: ``rn`` is the number of the first of them.
    """
    group = group or []
    ranged = _ranges(df, [*group, *order])
    keys = [*group, _PART]
    parts = ranged.groupBy(*keys).agg(F.min(_AT).alias("__first"), F.sum(F.col(weight) if weight else F.lit(1)).alias("__in"))
    parts = _before(parts, group, "__in")
    if weight:
        inner = Window.partitionBy(*keys).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranged = ranged.withColumn("__own", F.sum(weight).over(inner) - F.col(weight))
    else:
        ranged = ranged.withColumn("__own", F.col(_AT))
        parts = parts.withColumn("__before", F.col("__before") - F.col("__first"))
    joined = matched(ranged, parts.select(*keys, "__before", "n"), keys)
    return joined.select(*df.columns, (F.col("__before") + F.col("__own") + 1).cast("long").alias("rn"), F.col("n").cast("long").alias("n"))


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, null among them, that keeps the left ones."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    return left.join(other, on, how).drop(*[f"__right_{k}" for k in keys])


def running_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with each, by ``order``."""
    ranged = _ranges(df, order)
    parts = _before(ranged.groupBy(_PART).agg(F.sum(value).alias("__in")), [], "__in")
    inner = Window.partitionBy(_PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn("__own", F.sum(value).over(inner)).join(parts.select(_PART, "__before"), _PART)
    return summed.withColumn(out, F.col("__before") + F.col("__own")).drop(_PART, _AT, "__own", "__before")


def nearest_rank_index(n: Column, p: float) -> Column:
    """Place from 0 of a quantile: floor(n * p), the last one at most."""
    return F.least(F.floor(n * F.lit(p)), n - 1)


def _counted(df: DataFrame, value: str, group: list[str], weight: str | None = None) -> tuple[DataFrame, Column]:
    """Distinct values with their positions and counts ``__w``, and a test: whether a place (from 0) is a value's."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("__w"))
    return positions(counted, [value], group, "__w"), lambda place: (place + 1 >= F.col("rn")) & (place + 1 < F.col("rn") + F.col("__w"))


def nearest_rank(df: DataFrame, value: str, points: dict[str, float], group: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Nearest-rank quantiles (name -> p) of ``value`` per group. Equal values are counted first and take one row."""
    group = group or []
    ranked, is_at = _counted(df, value, group)
    shown = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return ranked.groupBy(*group).agg(*[shown(F.max(F.when(is_at(nearest_rank_index(F.col("n"), p)), F.col(value)))).alias(name) for name, p in points.items()])


def linear_quantiles(df: DataFrame, value: str, points: dict[str, float], group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Quantiles (name -> p) by linear interpolation between the places around p * (n - 1), per group of any size.

    With ``weight`` (whole numbers), a row counts so often. Groups without a value are left out.
    """
    group = group or []
    ranked, is_at = _counted(df, value, group, weight)
    at = lambda p: (F.col("n") - 1) * F.lit(p)
    ends = [F.max(F.when(is_at(f(at(p))), F.col(value))).alias(f"__{name}_{side}") for name, p in points.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy(*group).agg(F.max("n").alias("n"), *ends)

    def between(name: str, p: float) -> Column:
        low, high, place = F.col(f"__{name}_low"), F.col(f"__{name}_high"), at(p)
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*group, *[between(name, p).cast("double").alias(name) for name, p in points.items()])


def every_kth(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every k-th row by ``order``, beginning with the first; k is the least that leaves ``most`` rows or fewer."""
    ranked = positions(df, order)
    return ranked.where((F.col("rn") - 1) % F.greatest(F.ceil(F.col("n") / most), F.lit(1)) == 0)


def last_n(df: DataFrame, order: str, most: int) -> DataFrame:
    """The ``most`` rows that are last by ``order``."""
    return df.orderBy(F.desc(order)).limit(most)
