"""Ordered scans of groups of any size: rows are cut into blocks by value, blocks are summed, and the few sums are scanned.

Cuts come from a mergeable sketch of the order column over all rows, so a block holds about ``BLOCK`` rows however they
are spread over groups, and no window has more. Equal values share a block. Up to ``BLOCK`` rows are one block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and blocks at most: more rows make larger blocks.
BLOCK, BLOCKS = 1_000_000, 1_024
#: Relative error of the sketch is one by this.
ACCURACY = 100_000


def cuts(df: DataFrame, value: str) -> list:
    """Values that cut the rows into blocks of about ``BLOCK``; none for fewer rows."""
    n = df.agg(F.count(value)).first()[0]
    k = min(BLOCKS, -(-n // BLOCK))
    if k <= 1:
        return []
    got = df.agg(F.percentile_approx(value, [i / k for i in range(1, k)], ACCURACY)).first()[0]
    return sorted(set(got))


def block_of(value: Column, at: list) -> Column:
    """Number of cuts below a value: values up to the first cut are in block 0. Nulls are in block 0 too."""
    if not at:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in at]), lambda c: c < value)), F.lit(0))


def joined(rows: DataFrame, sums: DataFrame, on: list[str]) -> DataFrame:
    """Rows with the columns that ``sums`` has for their keys; nulls are keys like others."""
    other = sums.withColumnsRenamed({k: f"__k_{k}" for k in on})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in on])
    return rows.join(other, same).drop(*[f"__k_{k}" for k in on])


def scanned(
    df: DataFrame, keys: list[str], order: list[str], fold: dict[str, Callable[[], Column]],
    carry: Callable[[Window, Window], dict[str, Column]], desc: bool = False
) -> DataFrame:
    """``df`` with what lies before each row's block: columns of ``carry`` over the blocks' ``fold``.

    ``fold`` names the aggregates of a block; ``carry`` gets the windows of the blocks before and of all blocks of the keys and
    names what their rows hold. Adds ``__block``; windows inside are by ``[*keys, "__block"]``. Blocks are by the first order column.
    """
    rows = df.withColumn("__block", block_of(F.col(order[0]), cuts(df, order[0])))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = own.orderBy(F.col("__block").desc() if desc else F.col("__block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__block").agg(*[f().alias(name) for name, f in fold.items()])
    carried = carry(before, own)
    return joined(rows, sums.select(*keys, "__block", *[c.alias(name) for name, c in carried.items()]), [*keys, "__block"])


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], strict: bool = False) -> DataFrame:
    """``df`` with ``upto_<name>`` and ``total_<name>`` for each name and column: the running sum in order within the keys, and the whole.

    With ``strict`` the sum is that of the rows before (row by row); else rows that are equal in order share one.
    """
    fold = {f"__s_{n}": (lambda c=c: F.sum(c)) for n, c in sums.items()}
    carry = lambda before, own: {
        **{f"__b_{n}": F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)) for n in sums}, **{f"total_{n}": F.sum(f"__s_{n}").over(own) for n in sums}
    }
    rows = scanned(df, keys, order, fold, carry)
    inside = Window.partitionBy(*keys, "__block").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1) if strict else inside
    upto = {f"upto_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__b_{n}") for n, c in sums.items()}
    return rows.withColumns(upto).drop("__block", *[f"__b_{n}" for n in sums])
