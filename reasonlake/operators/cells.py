"""Cold against staged runs: speedups, ceilings, rollups, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as T
from ..functions.blocks import block_of, cuts, joined, running
from ..sources.staging import staged as kept_table


def pivot_modes(
    runs: DataFrame, keys: list[str], mode: str, value: str, modes: tuple[str, str] = ("cold", "staged")
) -> DataFrame:
    """One row a key with the value of either mode; keys with one mode alone have a null."""
    return runs.groupBy(*keys).pivot(mode, list(modes)).agg(F.max(value))


def canonical(cells: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    return cells.join(wanted, on, "left_semi")


def speedup_block(cells: DataFrame, sets: list[list[str]], cold: str = "cold_amt", staged: str = "staged_amt") -> DataFrame:
    """n, arithmetic, geometric and median mean, ratio of sums and maximum of cold / staged, for each grouping set;
    other keys are null.

    Medians come from counts by value, as no buffer may hold the ratios of all cells. Cells are made once, and values counted
    before the sets repeat them.
    """
    cols = sorted({c for s in sets for c in s})
    kinds = dict(cells.dtypes)
    own = [
        F.struct(F.lit(i).alias("__set"), *[(F.col(c) if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in cols]) for i,
        s in enumerate(sets)
    ]
    c, s = F.col(cold).cast("double"), F.col(staged).cast("double")
    each = kept_table(cells.select(*cols, (c / s).alias("__x"), c.alias("__c"), s.alias("__s")), "cells")
    x = each.select(F.explode(F.array(*own)).alias("g"), "__x", "__c", "__s").select("g.*", "__x", "__c", "__s")
    values = each.groupBy(*cols, "__x").agg(F.count(F.lit(1)).alias("__n")).select(F.explode(F.array(*own)).alias("g"), "__x", "__n")
    gm = F.exp(F.avg(F.when(F.col("__x") > 0, F.log("__x"))))
    keys = ["__set", *cols]
    main = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__x").alias("am"), gm.alias("gm"), (F.sum("__c") / F.sum("__s")).alias("agg"),
        F.max("__x").alias("max")
    )
    med = T.position_percentiles(values.select("g.*", "__x", "__n"), keys, "__x", {"med": ("linear", 0.5)}, "__n").withColumnsRenamed({k: f"__m_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__m_{k}")) for k in keys])
    return main.join(med, same, "left").select(*cols, "n", "am", "gm", "med", "agg", "max")


def latest(runs: DataFrame, keys: list[str], order: list[Column], n: int = 3) -> DataFrame:
    """The first n runs of each key in the given order (latest by name or time, or earliest in the file)."""
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def cell_speedup(
    runs: DataFrame, keys: list[str], mode: str, value: str, order: list[Column], base: str, n: int = 3, least: int = 2,
    least_value: float = 5.0, rc: str | None = None
) -> DataFrame:
    """Median of the latest base runs over that of the latest others, with at least ``least`` on either side; shorter
    runs are left out, and with ``rc`` those that did not end with 0. ``saved`` is the difference.
    """
    fine = runs.where(F.col(value) >= least_value) if rc is None else runs.where((F.col(value) >= least_value) & (F.col(rc) == 0))
    kept = latest(fine.withColumn("__base", F.col(mode) == base), [*keys, "__base"], order, n)
    side = lambda b, f: f(F.when(F.col("__base") == b, F.col(value)))
    med = lambda c: F.percentile(c, 0.5)  # noqa: E731 - of at most n runs
    g = kept.groupBy(*keys).agg(
        side(True, F.count).alias("n_base"), side(False, F.count).alias("n_other"), side(True, med).alias("base"),
        side(False, med).alias("other")
    )
    g = g.where((F.col("n_base") >= least) & (F.col("n_other") >= least)).withColumns(
        {"speedup": F.col("base") / F.col("other"), "saved": F.col("base") - F.col("other")}
    )
    return g.withColumn(
        "outcome", F.when(F.col("speedup") >= 1.20, "win").when(F.col("speedup") < 0.85, "loss").otherwise("even")
    )


def rep_medians(runs: DataFrame, keys: list[str], mode: str, value: str, rc: str, base: str) -> DataFrame:
    """Upper medians of the runs of either side that ended with 0, their ratio and the seconds saved; null where a side
    has none.
    """
    r = runs.where(F.col(rc) == 0).withColumn("__side", F.when(F.col(mode) == base, "base").otherwise("other"))
    m = T.position_percentiles(r, [*keys, "__side"], value, {"m": ("upper_median", 0.5)})
    p = m.groupBy(*keys).agg(
        F.max(F.when(F.col("__side") == "base", F.col("m"))).alias("base"),
        F.max(F.when(F.col("__side") == "other", F.col("m"))).alias("other")
    )
    return p.withColumns({"speedup": F.try_divide("base", "other"), "saved": F.col("base") - F.col("other")})


def efficiency_fit(cells: DataFrame, observed: str, ceiling: str, keys: list[str], least: int = 3) -> DataFrame:
    """Pearson r, its square and the mean efficiency over finite pairs; keys with fewer pairs are left out."""
    fine = cells.where(
        F.col(observed).isNotNull() & F.col(ceiling).isNotNull() & (F.abs(F.col(ceiling)) != float("inf")) & ~F.isnan(ceiling)
    )
    g = fine.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(observed, ceiling).alias("r"),
        F.avg(F.col(observed) / F.col(ceiling)).alias("efficiency")
    )
    return g.where(F.col("n") >= least).withColumn("r2", F.col("r") * F.col("r"))


def coverage(cells: DataFrame, expected: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """Expected keys with fewer than ``least`` cells, those without any included."""
    n = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return expected.select(*keys).distinct().join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < least)


def median_row(runs: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The whole row at position n div 2 of each key, in order of the value."""
    own = Window.partitionBy(*keys)
    r = runs.withColumns({"__i": F.row_number().over(own.orderBy(value, tie)), "__n": F.count(F.lit(1)).over(own)})
    return r.where(F.col("__i") == F.floor(F.col("__n") / 2) + 1).drop("__i", "__n")


def best_baseline(runs: DataFrame, keys: list[str], least: float, most_kills: int) -> DataFrame:
    """For each key the run with most rc-0 seconds among those submitted, with few kills and enough seconds; ties go to
    the smaller run.
    """
    fit = runs.where(F.col("submitted") & (F.col("n_kills") <= most_kills) & (F.col("rc0_s") >= least))
    return fit.withColumn(
        "__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rc0_s"), "run"))
    ).where("__n = 1").drop("__n")


def bandwidth_rollup(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, extremes, sample deviation (0 for one sample) and milliseconds for 4 MiB at the mean."""
    g = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd")
    )
    return g.withColumn("ms_per_4mib", F.try_divide(F.lit(4000.0), F.col("mean")))


def tool_ratio(samples: DataFrame, keys: list[str], tool: str, value: str, one: str, other: str) -> DataFrame:
    p = samples.groupBy(*keys).pivot(tool, [one, other]).agg(F.avg(value))
    return p.withColumn("ratio", F.try_divide(F.col(one), F.col(other)))


def monotonic(points: DataFrame, keys: list[str], x: str, y: str, tolerance: float = 0.05, spread: float = 50.0) -> DataFrame:
    """Whether y never falls by more than the tolerance as x grows, and whether its largest is ``spread`` times its smallest."""
    prev = F.lag(y).over(Window.partitionBy(*keys).orderBy(x))
    ok = points.withColumn("__ok", F.coalesce(F.col(y) >= prev * (1 - tolerance), F.lit(True)))
    return ok.groupBy(*keys).agg(
        F.bool_and("__ok").alias("monotonic"), F.coalesce(F.max(y) >= spread * F.min(y), F.lit(False)).alias("spread")
    )


def attributed(cells: DataFrame, saved: str, base: str, staged: str) -> DataFrame:
    gain = F.col(base) - F.col(staged)
    return cells.where(gain > 0).withColumn("attribution", F.col(saved) / gain)


def ecdf(df: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """Each distinct value with the share of rows at or below it; keys with few rows are left out. Counts come before
    the running sum, which is taken block by block, so ties and large groups are cheap.
    """
    run = running(T.counted(df, keys, value), keys, [value], {"n": "n"})
    return run.where(F.col("total_n") >= least).select(*keys, value, "n", (F.col("upto_n") / F.col("total_n")).alias("ecdf"))


def ks_statistic(df: DataFrame, keys: list[str], side: str, one: str, other: str, value: str) -> DataFrame:
    """Largest distance between the ECDFs of two sides."""
    n = df.where(F.col(side).isin(one, other) & F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.when(F.col(side) == one, 1)).alias("a"), F.count(F.when(F.col(side) == other, 1)).alias("b")
    )
    d = running(n, keys, [value], {"a": "a", "b": "b"})
    d = d.select(*keys, F.abs(F.try_divide("upto_a", "total_a") - F.try_divide("upto_b", "total_b")).alias("d"))
    return d.groupBy(*keys).agg(F.max("d").alias("ks"))


def delivery(queue: DataFrame, keys: list[str], order: str, emit: str, proc: str) -> DataFrame:
    """Delivery times of a serial queue, recv = max(emit, previous recv) + proc, without a loop.

    Each row maps the time at which the queue is free to max(emit, it) + proc. Such maps compose: those of a block are one map, (work, floor),
    time to max(time + work, floor). The blocks' maps are scanned, and each block starts from what the blocks before it leave.
    """
    rows = queue.drop("recv", "delay")
    work = lambda: F.sum(proc)
    # with S the running sum of proc, the floor of a block is S at its end plus the largest (emit - S before the row)
    inside = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumn("__block", block_of(F.col(order), cuts(rows, order)))
    own = own.withColumn("__s", F.sum(proc).over(inside)).withColumn("__room", F.col(emit) - (F.col("__s") - F.col(proc)))
    sums = own.groupBy(*keys, "__block").agg(work().alias("__work"), F.max("__room").alias("__most"))
    blocks = Window.partitionBy(*keys).orderBy("__block")
    upto, before = blocks.rowsBetween(Window.unboundedPreceding, Window.currentRow), blocks.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__done", F.sum("__work").over(upto)).withColumn("__past", F.col("__done") - F.col("__work"))
    free = F.col("__past") + F.max(F.col("__most") - F.col("__past")).over(before)  # when the queue is free at the block's start
    own = joined(own, sums.select(*keys, "__block", free.alias("__free")), [*keys, "__block"])
    recv = F.col("__s") + F.greatest(F.max("__room").over(inside), F.col("__free"))
    got = own.withColumn("recv", recv).drop("__s", "__room", "__block", "__free")
    return got.withColumn("delay", F.col("recv") - F.col(emit))
