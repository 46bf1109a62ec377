"""Cold and staged cells, speedups, distributions and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import stats as T
from ..operators import cells as C
from ..operators import planning as N
from ..sources import logs
from . import fixtures as X


def _r(names, d=4):
    return [F.round(F.col(n).cast("double"), d).alias(n) for n in names]


def speedup_blocks(spark, sf):
    b = C.speedup_block(X.cells(spark, sf), [["task"], ["model"], ["task", "model"], []])
    return b.select("task", "model", "n", *_r(("am", "gm", "med", "agg", "max")))


def _amdahl(spark, sf):
    c = X.cells(spark, sf).select(
        "cell", "task", "model", F.col("cold_amt").cast("double").alias("cold"),
        F.col("staged_amt").cast("double").alias("staged"),
        F.when(F.col("cell") % 13 == 0, 0.0).otherwise(F.col("cold_amt").cast("double") * 0.5).alias("csh"),
        F.when(F.col("cell") % 13 == 0, 0.0).otherwise(F.col("staged_amt").cast("double") * 0.25 + F.col("n_rows")).alias("ssh")
    )
    return c.withColumns(L.amdahl(F.col("cold"), F.col("staged"), F.col("csh"), F.col("ssh")))


def amdahl_cells(spark, sf):
    return _amdahl(spark, sf).select(
        "cell", *_r(("session_speedup", "shell_speedup", "shell_share", "io_share", "ceiling", "efficiency"))
    )


def amdahl_corr(spark, sf):
    return C.efficiency_fit(
        _amdahl(spark, sf), "session_speedup", "ceiling", ["task"]
    ).select("task", "n", *_r(("r", "r2", "efficiency")))


def io_share(spark, sf):
    c = X.cells(spark, sf).select(
        "cell", F.col("cold_amt").cast("double").alias("cold"), (F.col("n_rows") * 1000000).alias("read"), "n_rows"
    )
    split = L.io_split(F.col("cold"), F.col("cold") * 0.25, F.col("read"), 1000.0, 50000.0)
    c = c.withColumns(split).withColumns(
        {
            "regime": L.regime_io_share(F.col("cold"), F.col("read"), F.col("n_rows"), 2000.0, 0.5),
            "timely": L.timely(F.col("read"), F.col("n_rows"), F.col("cold") * 0.125, 1000.0, 0.25),
            "moveable": F.col("cold") * 50000.0, "mb_s": L.throughput(F.col("read"), F.col("cold")),
            "passes": L.pass_count(F.col("read"), F.lit(2_000_000))["passes"],
            "meets": L.pass_count(F.col("read"), F.lit(2_000_000))["meets"], "expanded": F.col("read") * 4
        }
    )
    return c.select(
        "cell", *_r(("llm_s", "io_s", "compute_s", "ideal_s")), *_r(("amdahl_max", "regime"), 3), "timely",
        F.round("moveable", 0).alias("moveable"), *_r(("mb_s",), 6), "passes", "meets"
    )


def latest_reps(spark, sf):
    o = X.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 50).alias("task"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("v"),
        "o_orderdate"
    )
    a = C.latest(o, ["task", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).withColumn("order", F.lit("latest"))
    b = C.latest(o, ["task", "o_orderstatus"], [F.asc("o_orderkey")]).withColumn("order", F.lit("first"))
    return a.unionByName(b).select("task", "o_orderstatus", "order", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def _orders(spark, sf):
    return X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 80).alias("task"), F.col("o_orderpriority").alias("model"),
        F.when(F.col("o_orderkey") % 3 == 0, "baseline").otherwise("staged").alias("mode"),
        F.col("o_totalprice").cast("double").alias("v"), "o_orderdate"
    )


def cell_medians(spark, sf):
    c = C.cell_speedup(_orders(spark, sf), ["task", "model"], "mode", "v", [F.desc("run")], "baseline")
    return c.select("task", "model", "n_base", "n_other", *_r(("base", "other"), 3), *_r(("speedup",)), "outcome")


def speedup_quantiles(spark, sf):
    c = C.cell_speedup(_orders(spark, sf), ["task", "model"], "mode", "v", [F.desc("run")], "baseline")
    q = T.position_percentiles(c, ["model"], "speedup", {f"q{p}": ("linear", p / 100) for p in (25, 50, 75)})
    return c.join(q, "model").groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.first(f"q{p}"), 3).alias(f"q{p}") for p in (25, 50, 75)],
        F.round(F.max("speedup"), 4).alias("best"), F.count(F.when(F.col("outcome") == "win", 1)).alias("wins"),
        F.count(F.when(F.col("outcome") == "loss", 1)).alias("losses")
    )


def coverage_audit(spark, sf):
    o = _orders(spark, sf)
    models = X.table(spark, sf, "region").select(F.col("r_name").alias("model")).unionByName(o.select("model").distinct())
    expected = o.select("task").distinct().crossJoin(models)  # the grid asked for
    canon = C.canonical(
        o, X.table(spark, sf, "customer").select((F.col("c_custkey") % 80).alias("task")).where("task % 2 = 0").distinct(),
        ["task"]
    )
    return C.coverage(canon, expected, ["task", "model"]).select("task", "model", "n")


def median_run(spark, sf):
    return C.median_row(_orders(spark, sf), ["task", "model"], "v", "run").select("task", "model", "run", "v")


def best_baseline(spark, sf):
    o = _orders(spark, sf).withColumns({"submitted": F.col("run") % 5 > 0, "n_kills": F.col("run") % 4, "rc0_s": F.col("v")})
    return C.best_baseline(o, ["task", "model"], 30.0, 1).select("task", "model", "run", "rc0_s")


def paired_modes(spark, sf):
    """Largest run of either mode side by side, and the saved share where there is a gain."""
    p = C.pivot_modes(_orders(spark, sf), ["task", "model"], "mode", "v", ("baseline", "staged"))
    a = C.attributed(p.withColumn("saved", F.col("baseline") * 0.125), "saved", "baseline", "staged")
    return p.join(
        a.select("task", "model", "attribution"), ["task", "model"], "left"
    ).select("task", "model", "baseline", "staged", *_r(("attribution",), 3))


def tier_bandwidth(spark, sf):
    l = X.table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", F.col("l_quantity").cast("double").alias("q"))
    key = l.columns[0]
    b = C.bandwidth_rollup(l, [key, "l_linenumber"], "q")
    return b.select(F.col(key).alias("tier"), "l_linenumber", "n", *_r(("mean", "min", "max", "sd", "ms_per_4mib")))


def tool_ratio(spark, sf):
    l = X.table(spark, sf, "lineitem").select("l_linenumber", "l_returnflag", F.col("l_quantity").cast("double").alias("q"))
    return C.tool_ratio(l, ["l_linenumber"], "l_returnflag", "q", "A", "R").select("l_linenumber", *_r(("A", "R", "ratio")))


def bandwidth_curve(spark, sf):
    l = X.table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 50).alias("curve"), F.col("l_quantity").alias("x")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("y")
    )
    return C.monotonic(l, ["curve"], "x", "y", 0.5, 50.0)


def latency_ecdf(spark, sf):
    e = X.table(spark, sf, "events").select("event_type", F.round("value", 0).alias("ms"))
    both = e.unionByName(e.withColumn("event_type", F.lit("all")))  # each type, and all pooled
    return C.ecdf(both, ["event_type"], "ms", 3).select("event_type", "ms", "n", *_r(("ecdf",), 6))


def ks_statistic(spark, sf):
    e = X.table(spark, sf, "events").select(
        (F.col("user_id") % 6).alias("g"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("side"), "value"
    )
    return C.ks_statistic(e, ["g"], "side", "a", "b", "value").select("g", *_r(("ks",), 6))


def queue_delay(spark, sf):
    """Delivery of events one at a time for each user: emitted a second apart, with the value as work."""
    e = X.table(spark, sf, "events").select(
        "user_id", "event_id",
        (F.expr("row_number() over (partition by user_id order by event_id)") * 20).cast("decimal(18,2)").alias("emit"),
        F.col("value").cast("decimal(18,2)").alias("proc")
    )
    d = C.delivery(e, ["user_id"], "event_id", "emit", "proc")
    return d.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("recv").cast("double").alias("last"), F.max("delay").cast("double").alias("most"),
        F.sum("delay").cast("double").alias("total")
    )


def percentile_family(spark, sf):
    l = X.table(spark, sf, "lineitem").select("l_linenumber", F.col("l_extendedprice").alias("v"))
    asked = {
        "p50_upper": ("upper_median", 0.5), "p95_nearest": ("nearest", 0.95), "p95_floor_last": ("floor_last", 0.95), "p95_floor_count": ("floor_count", 0.95),
        "q1": ("quarter", 0.25), "q3": ("quarter", 0.75), "p50_linear": ("linear", 0.5), "p95_exclusive": ("exclusive", 0.95)}
    p = T.position_percentiles(l, ["l_linenumber"], "v", asked)
    return p.withColumns({c: F.round(c, 3) for c in ("p50_linear", "p95_exclusive")})


def overhead_latency(spark, sf):
    """Mean, extremes and nearest-rank percentiles of event values by type, and how far the p99 is from the median."""
    e = X.table(spark, sf, "events").select("event_type", "value")
    p = T.position_percentiles(e, ["event_type"], "value", {f"p{q}": ("nearest", q / 100) for q in (50, 75, 95, 99)})
    m = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.round(F.avg(F.col("value").cast("decimal(18,4)")).cast("double"), 3).alias("mean")
    )
    return p.join(m, "event_type").select(
        "event_type", "n", "p50", "p75", "p95", "p99", "min", "max", "mean", F.round(F.col("p99") / F.col("p50"), 4).alias("tail")
    )


def set_ops(spark, sf):
    """Sizes of union, intersection and differences of two path sets, of a partial rerun, and of the row differences of
    two tables.
    """
    d = X.files(spark, sf).select("path", "bytes")
    a, b = d.where("bytes % 2 = 0").select("path"), d.where("bytes % 3 = 0").select("path")
    rerun = d.where("bytes % 5 = 0").withColumn("bytes", F.col("bytes") * 10)
    n = lambda name, x: x.agg(F.lit(name).alias("what"), F.count(F.lit(1)).alias("n"))
    merged = N.replace_part(d, rerun, ["path"])
    once = N.ordered_dedup(X.table(spark, sf, "documents").select("source", "lang", "doc_id"), ["source"], "lang", "doc_id")
    parts = [
        n("union", a.union(b).distinct()), n("both", a.intersect(b)), n("left", a.subtract(b)),
        n("rerun", N.differences(d, merged)), n("dedup", once), merged.agg(F.lit("sum").alias("what"), F.sum("bytes").alias("n"))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reports(spark, sf):
    """I/O reports, one an order, with a file for each line and seconds by function."""
    l = X.table(spark, sf, "lineitem")
    view = F.struct(
        F.concat(
            F.when(F.col("l_partkey") % 10 == 0, "/output/").otherwise("/data/"), F.col("l_partkey").cast("string")
        ).alias("file_name"),
        F.col("l_quantity").cast("long").alias("posix_count_sum"), F.floor("l_extendedprice").alias("posix_read_size_sum"),
        F.lit(1).cast("long").alias("posix_metadata_count_sum"),
        (F.col("l_linenumber") * 0.5).cast("double").alias("posix_time_sum")
    )
    one = F.col("l_returnflag")
    r = l.groupBy(F.col("l_orderkey").alias("file")).agg(
        F.collect_list(view).alias("file_name_view"), F.sum(F.when(one == "A", F.col("l_linenumber") * 0.5)).alias("a"),
        F.sum(F.when(one != "A", F.col("l_linenumber") * 0.5)).alias("b"), (F.count(F.lit(1)) * 10.0).alias("job_time")
    )
    func = F.array(
        *[
            F.struct(F.lit(n).alias("func_name"), F.col(c).cast("double").alias("posix_time_sum")) for n,
            c in (("read", "a"), ("open", "b"))
        ]
    )
    return r.select("file", "file_name_view", func.alias("func_name_view"), "job_time")


def io_report(spark, sf):
    """Reads of the reports: totals of each, seconds by function, and the files with enough reads."""
    r = reports(spark, sf)
    reads = logs.io_reads(r, least_bytes=1000, least_count=5).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_reads"), F.sum("bytes_read").alias("bytes_read")
    )
    t = logs.io_totals(r).join(reads, "file", "left")
    return t.select(
        "file", "job_time", F.col("n_files").cast("long").alias("n_files"), "posix_s",
        F.col("by_function")["read"].alias("read_s"), F.col("by_function")["open"].alias("open_s"),
        F.coalesce("n_reads", F.lit(0)).alias("n_reads"), F.coalesce("bytes_read", F.lit(0)).alias("bytes_read")
    )


QUERIES = {
    f.__name__: f for f in (
        speedup_blocks, amdahl_cells, amdahl_corr, io_share, latest_reps, cell_medians, speedup_quantiles, coverage_audit,
        median_run, best_baseline, paired_modes, tier_bandwidth, tool_ratio, bandwidth_curve, latency_ecdf, ks_statistic,
        queue_delay, percentile_family, overhead_latency, set_ops, io_report
    )
}

_X = "select task, model, cast(cold_amt as double) / cast(staged_amt as double) as x, cast(cold_amt as double) as c, cast(staged_amt as double) as s from fx_cells"
_AM = "select cell, task, cast(cold_amt as double) as cold, cast(staged_amt as double) as staged, case when cell % 13 = 0 then 0.0 else cast(cold_amt as double) * 0.5 end as csh, case when cell % 13 = 0 then 0.0 else cast(staged_amt as double) * 0.25 + n_rows end as ssh from fx_cells"
_AM2 = f"select *, cold / staged as session_speedup, case when csh = 0 then 1.0 else csh / ssh end as shell_speedup, case when csh = 0 then 0.0 else csh / cold end as shell_share from ({_AM})"
_AM3 = f"select *, case when shell_speedup > 1 then 1 - 1 / shell_speedup else 0.0 end as io_share, case when shell_speedup > 1 then 1 - shell_share * (1 - 1 / shell_speedup) * (1 - 1 / shell_speedup) else 1.0 end as rest from ({_AM2})"
_O = "select o_orderkey as run, o_custkey % 80 as task, o_orderpriority as model, case when o_orderkey % 3 = 0 then 'baseline' else 'staged' end as mode, cast(o_totalprice as double) as v from orders"
_CS = f"select task, model, count(*) filter (mode = 'baseline') as n_base, count(*) filter (mode <> 'baseline') as n_other, quantile_cont(v, 0.5) filter (mode = 'baseline') as base, quantile_cont(v, 0.5) filter (mode <> 'baseline') as other from (select * from ({_O}) where v >= 5 qualify row_number() over (partition by task, model, mode order by run desc) <= 3) group by task, model having count(*) filter (mode = 'baseline') >= 2 and count(*) filter (mode <> 'baseline') >= 2"

SQL = {
    "speedup_blocks": f"select task, model, count(*) as n, round(avg(x), 4) as am, round(exp(avg(ln(x))), 4) as gm, round(quantile_cont(x, 0.5), 4) as med, round(sum(c) / sum(s), 4) as agg, round(max(x), 4) as max from ({_X}) group by grouping sets ((task), (model), (task, model), ())",
    "amdahl_cells": f"select cell, round(session_speedup, 4) as session_speedup, round(shell_speedup, 4) as shell_speedup, round(shell_share, 4) as shell_share, round(io_share, 4) as io_share, round(1 / rest, 4) as ceiling, round(session_speedup * rest, 4) as efficiency from ({_AM3})",
    "amdahl_corr": f"with g as (select task, count(*) as n, corr(session_speedup, 1 / rest) as r, avg(session_speedup * rest) as e from ({_AM3}) group by task) select task, n, round(r, 4) as r, round(r * r, 4) as r2, round(e, 4) as efficiency from g where n >= 3",
    "io_share": "with c as (select cell, cast(cold_amt as double) as c, n_rows as n, n_rows * 1000000 as b from fx_cells), d as (select *, c - c * 0.25 as llm, b / 1000.0 as io, greatest(c * 0.25 - b / 1000.0, 0) as comp from c) select cell, round(llm, 4) as llm_s, round(io, 4) as io_s, round(comp, 4) as compute_s, round(llm + comp + b / 50000.0, 4) as ideal_s, round(c / (llm + comp + b / 50000.0), 3) as amdahl_max, round(least(b / 2000.0 + n * 0.5, 0.97 * c) / c, 3) as regime, greatest(b / 1000.0, n * 0.25) <= c * 0.125 as timely, round(c * 50000.0, 0) as moveable, round(b / 1e6 / c, 6) as mb_s, n / 2.0::double as passes, n / 2.0 >= 2 as meets from d",
    "latest_reps": "with o as (select o_orderkey, o_custkey % 50 as task, o_orderstatus, o_orderdate from orders) (select task, o_orderstatus, 'latest' as \"order\", o_orderkey, row_number() over (partition by task, o_orderstatus order by o_orderdate desc, o_orderkey desc) as rank from o qualify rank <= 3) union all (select task, o_orderstatus, 'first', o_orderkey, row_number() over (partition by task, o_orderstatus order by o_orderkey) as rank from o qualify rank <= 3)",
    "cell_medians": f"select task, model, n_base, n_other, round(base, 3) as base, round(other, 3) as other, round(base / other, 4) as speedup, case when base / other >= 1.20 then 'win' when base / other < 0.85 then 'loss' else 'even' end as outcome from ({_CS})",
    "speedup_quantiles": f"with c as (select model, base / other as x from ({_CS})) select model, count(*) as n, round(quantile_cont(x, 0.25), 3) as q25, round(quantile_cont(x, 0.5), 3) as q50, round(quantile_cont(x, 0.75), 3) as q75, round(max(x), 4) as best, count(*) filter (x >= 1.20) as wins, count(*) filter (x < 0.85) as losses from c group by model",
    "coverage_audit": f"with o as ({_O}), e as (select distinct t.task, m.model from (select distinct task from o) t cross join (select r_name as model from region union select model from o) m), n as (select task, model, count(*) as n from o where task in (select c_custkey % 80 from customer) and task % 2 = 0 group by task, model) select e.task, e.model, coalesce(n.n, 0) as n from e left join n on n.task = e.task and n.model = e.model where coalesce(n.n, 0) < 3",
    "median_run": f"select task, model, run, v from ({_O}) qualify row_number() over (partition by task, model order by v, run) = count(*) over (partition by task, model) // 2 + 1",
    "best_baseline": f"select task, model, run, v as rc0_s from ({_O}) where run % 5 > 0 and run % 4 <= 1 and v >= 30 qualify row_number() over (partition by task, model order by v desc, run) = 1",
    "paired_modes": f"with g as (select task, model, max(v) filter (mode = 'baseline') as baseline, max(v) filter (mode = 'staged') as staged from ({_O}) group by task, model) select task, model, baseline, staged, case when baseline - staged > 0 then round(baseline * 0.125 / (baseline - staged), 3) end as attribution from g",
    "tier_bandwidth": "with l as (select l_returnflag as tier, l_linenumber, cast(l_quantity as double) as q from lineitem) select tier, l_linenumber, count(*) as n, round(avg(q), 4) as mean, min(q) as min, max(q) as max, round(coalesce(stddev_samp(q), 0), 4) as sd, round(4000 / avg(q), 4) as ms_per_4mib from l group by tier, l_linenumber",
    "tool_ratio": "with l as (select l_linenumber, avg(l_quantity) filter (l_returnflag = 'A') as a, avg(l_quantity) filter (l_returnflag = 'R') as r from lineitem group by l_linenumber) select l_linenumber, round(a, 4) as \"A\", round(r, 4) as \"R\", round(a / r, 4) as ratio from l",
    "bandwidth_curve": "with g as (select l_partkey % 50 as curve, l_quantity as x, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as y from lineitem group by 1, 2), p as (select curve, y, coalesce(y >= lag(y) over (partition by curve order by x) * 0.5, true) as ok from g) select curve, bool_and(ok) as monotonic, max(y) >= 50 * min(y) as spread from p group by curve",
    "latency_ecdf": "with e as (select event_type, round(value, 0) as ms from events union all select 'all', round(value, 0) from events), n as (select event_type, ms, count(*) as n from e group by 1, 2) select event_type, ms, n, round(sum(n) over (partition by event_type order by ms) / sum(n) over (partition by event_type), 6) as ecdf from n",
    "ks_statistic": "with n as (select user_id % 6 as g, value, count(*) filter (event_id % 2 = 0) as a, count(*) filter (event_id % 2 = 1) as b from events group by 1, 2), d as (select g, abs(sum(a) over (partition by g order by value) / sum(a) over (partition by g) - sum(b) over (partition by g order by value) / sum(b) over (partition by g)) as d from n) select g, round(max(d), 6) as ks from d group by g",
    "queue_delay": """with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as i, cast(value as decimal(18,2)) as proc from events),
      q as (select user_id, i, cast(greatest(20, 0) + proc as decimal(28,2)) as recv from e where i = 1 union all select e.user_id, e.i, cast(greatest(20 * e.i, q.recv) + e.proc as decimal(28,2)) from q join e on e.user_id = q.user_id and e.i = q.i + 1)
      select user_id, count(*) as n, cast(max(recv) as double) as last, cast(max(recv - 20 * i) as double) as most, cast(sum(recv - 20 * i) as double) as total from q group by user_id""",
    "percentile_family": """with v as (select l_linenumber, l_extendedprice as v, row_number() over (partition by l_linenumber order by l_extendedprice) - 1 as i, count(*) over (partition by l_linenumber) as n from lineitem)
      select l_linenumber, max(v) filter (i = n // 2) as p50_upper, max(v) filter (i = cast(round_even(0.95 * (n - 1), 0) as bigint)) as p95_nearest, max(v) filter (i = cast(floor(0.95 * (n - 1)) as bigint)) as p95_floor_last, max(v) filter (i = cast(floor(n * 0.95) as bigint)) as p95_floor_count, max(v) filter (i = n // 4) as q1, max(v) filter (i = 3 * n // 4) as q3, round(quantile_cont(v, 0.5), 3) as p50_linear,
      round(max(v) filter (i + 1 = floor((n + 1) * 0.95)) + (max(v) filter (i = floor((n + 1) * 0.95)) - max(v) filter (i + 1 = floor((n + 1) * 0.95))) * max((n + 1) * 0.95 - floor((n + 1) * 0.95)), 3) as p95_exclusive from v group by l_linenumber""",
    "overhead_latency": """with v as (select event_type, value as v, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events),
      g as (select event_type, count(*) as n, max(v) filter (i = cast(round_even(0.5 * (n - 1), 0) as bigint)) as p50, max(v) filter (i = cast(round_even(0.75 * (n - 1), 0) as bigint)) as p75, max(v) filter (i = cast(round_even(0.95 * (n - 1), 0) as bigint)) as p95, max(v) filter (i = cast(round_even(0.99 * (n - 1), 0) as bigint)) as p99, min(v) as min, max(v) as max, round(cast(sum(cast(v as decimal(18,4))) as double) / count(*), 3) as mean from v group by event_type)
      select *, round(p99 / p50, 4) as tail from g""",
    "set_ops": """with a as (select path from fx_files where bytes % 2 = 0), b as (select path from fx_files where bytes % 3 = 0)
      select 'union' as what, count(*) as n from (select path from a union select path from b) union all select 'both', count(*) from (select path from a intersect select path from b) union all select 'left', count(*) from (select path from a except select path from b)
      union all select 'rerun', 2 * count(*) from fx_files where bytes % 5 = 0 and bytes > 0 union all select 'dedup', count(*) from (select distinct source, lang from documents) union all select 'sum', cast(sum(case when bytes % 5 = 0 then bytes * 10 else bytes end) as bigint) from fx_files""",
    "io_report": "select l_orderkey as file, cast(count(*) * 10 as double) as job_time, count(*) as n_files, cast(sum(l_linenumber * 0.5) as double) as posix_s, cast(coalesce(sum(l_linenumber * 0.5) filter (l_returnflag = 'A'), 0) as double) as read_s, cast(coalesce(sum(l_linenumber * 0.5) filter (l_returnflag <> 'A'), 0) as double) as open_s, count(*) filter (l_partkey % 10 <> 0 and l_extendedprice >= 1000 and l_quantity >= 5) as n_reads, cast(coalesce(sum(cast(floor(l_extendedprice) as bigint)) filter (l_partkey % 10 <> 0 and l_extendedprice >= 1000 and l_quantity >= 5), 0) as bigint) as bytes_read from lineitem group by 1",
}
