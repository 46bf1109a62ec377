"""Statistics that differ by convention; each convention has a name of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import blocks as B

#: Position (from 0) of a percentile p among n sorted values, by convention.
POSITIONS = {
    "upper_median": lambda n, p: F.floor(n / 2),
    "nearest": lambda n, p: F.greatest(F.lit(0), F.least(n - 1, F.bround(p * (n - 1)))),
    "floor_last": lambda n, p: F.floor(p * (n - 1)),
    "floor_count": lambda n, p: F.least(n - 1, F.floor(n * p)),
    "quarter": lambda n, p: F.floor(n / 4) if p < 0.5 else F.floor(3 * n / 4),
}
#: Conventions between two neighbours: position from 0, clamped to the ends.
BETWEEN = {
    "linear": lambda n, p: p * (n - 1),
    "exclusive": lambda n, p: F.greatest(F.lit(0.0), F.least(n - 1.0, p * (n + 1) - 1)),
}


def counted(df: DataFrame, group: list[str], value: str, rows: str | None = None) -> DataFrame:
    """Distinct values of each group with ``n`` rows. Nulls are left out. Repeated values cost one row each. Each row of ``df`` is one,
    or as many as its column ``rows`` says.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n"))


def _wanted(asked: dict[str, tuple[str, float]], total: Column) -> dict[str, tuple[Column, Column | None]]:
    """For each name the position of its value among ``total`` sorted ones; between two, the lower one and the share of the higher."""
    out = {}
    for name, (kind, p) in asked.items():
        if kind in BETWEEN:
            where = BETWEEN[kind](total, p)
            out[name] = F.floor(where).cast("long"), where - F.floor(where)
        else:
            out[name] = POSITIONS[kind](total, p).cast("long"), None
    return out


def _narrowed(rows: DataFrame, group: list[str], value: str, positions: list[Column]) -> DataFrame:
    """Of counted values with the ``total`` of their group those near the asked positions, with ``before``, the rows below their ``cell``.

    Distributed selection: more than a block of values are dealt in order into cells of about a block, cells are counted, and only
    those that hold an asked position stay. So one round is enough, and about a block of values is sorted in one place.
    """
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    cells = -(-rows.count() // B.BLOCK)
    if cells <= 1:
        return rows.withColumns({"cell": F.lit(0), "before": F.lit(0).cast("long"), "total": F.sum("n").over(own)})
    rows = staged(rows.repartitionByRange(cells, *group, value).withColumn("cell", F.spark_partition_id()), "selection")
    sums = rows.groupBy(*group, "cell").agg(F.sum("n").alias("__n"))
    before = F.sum("__n").over(own.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumns({"before": F.coalesce(before, F.lit(0)), "total": F.sum("__n").over(own)})
    hit = [(F.col("before") <= p) & (p < F.col("before") + F.col("__n")) for p in positions]
    kept = sums.where(reduce(lambda a, b: a | b, hit)).drop("__n")
    return B.joined(rows, kept, [*group, "cell"])


def position_percentiles(df: DataFrame, group: list[str], value: str, asked: dict[str, tuple[str, float]], rows: str | None = None) -> DataFrame:
    """One row a group with one column for each (convention, p) asked. Exact; groups of any size. ``rows`` as in ``counted``."""
    n = staged(counted(df, group, value, rows), "counted")
    wanted = _wanted(asked, F.col("total"))
    positions = [p for low, part in wanted.values() for p in ([low] if part is None else [low, F.least(low + 1, F.col("total") - 1)])]
    near = _narrowed(n, group, value, positions)
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*group, "cell").orderBy(value))
    near = near.withColumn("upto", upto)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= position) & (position < F.col("upto")), F.col(value)))

    picks = []
    for name, (low, part) in wanted.items():
        if part is None:
            picks.append(at(low).alias(name))
        else:
            high = F.coalesce(at(F.least(low + 1, F.col("total") - 1)), at(low))
            picks.append((at(low) + (high - at(low)) * F.max(part)).alias(name))
    return near.groupBy(*group).agg(*picks)


def medians(df: DataFrame, group: list[str], columns: list[str], prefix: str = "") -> DataFrame:
    """One row a group with the median of each column, null where a group has no value: all columns in one pass."""
    each = df.select(
        *group,
        F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    ).select(*group, "x.*")
    m = position_percentiles(each, [*group, "k"], "v", {"m": ("linear", 0.5)})
    return m.groupBy(*group).agg(*[F.max(F.when(F.col("k") == c, F.col("m"))).alias(prefix + c) for c in columns])


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.when(x > 0, F.log(x))))


def share(condition: Column) -> Column:
    """Share of rows that meet a condition; rows where it is null are left out."""
    return F.avg(condition.cast("int"))


def ratio_or(n: Column, d: Column, empty: Column) -> Column:
    return F.when(d != 0, n / d).otherwise(empty)
