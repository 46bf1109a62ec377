"""Aggregates over whole runs: shares, counters, projections, slack, paths named, detector variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import stats as T

COUNTERS = ("rchar", "read_bytes", "wchar", "write_bytes", "syscr", "syscw")


def share_medians(split: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of the seconds of sessions (as ``wall_split`` gives them), and of their shares in percent, by key.
    Sessions without time have no share.

    A session's shares add up, medians of seconds don't, so both are taken session by session.
    """
    total = F.when(F.col("total_s") > 0, F.col("total_s"))
    s = split.withColumns({
        "tool_exec_pct": (F.col("tool_s") + F.col("other_s")) / total * 100, "reasoning_pct": F.col("stream_s") / total * 100,
        "comm_pct": F.col("comm_s") / total * 100, "harness_pct": F.col("harness_s") / total * 100})
    columns = [
        "total_s", "comm_s", "stream_s", "tool_s", "other_s", "harness_s", "tool_exec_pct", "reasoning_pct", "comm_pct",
        "harness_pct"
    ]
    return s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sessions")).join(T.medians(s, keys, columns), keys, "left")


def io_counters(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of the I/O counters of shell calls, their number and seconds; missing counters count as 0."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS if c in calls.columns]
    return calls.groupBy(*keys).agg(
        *sums, F.count(F.lit(1)).alias("n_shell_calls"), F.coalesce(F.sum("elapsed_s"), F.lit(0)).alias("shell_elapsed_total_s")
    )


def pathfulness(runs: DataFrame, keys: list[str]) -> DataFrame:
    """How many runs name no complete path (n_complete) and no absolute one (n_abs) in their reasoning, and the upper
    median and maximum of complete ones.
    """
    n = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count(F.when(F.col("n_complete") == 0, 1)).alias("zero_complete"),
        F.count(F.when(F.col("n_abs") == 0, 1)).alias("zero_abs"), F.max("n_complete").alias("most")
    )
    med = T.position_percentiles(runs, keys, "n_complete", {"median": ("upper_median", 0.5)})
    return n.join(med, keys) if keys else n.crossJoin(med)


def real_runs(totals: DataFrame, keys: list[str]) -> DataFrame:
    """Means of job seconds, I/O share and both projections over runs (job_time, posix_s)."""
    r = totals.withColumns(L.projections(F.col("job_time"), F.col("posix_s")))
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("job_time", "io_frac", "elim_speedup", "far_speedup")]
    )


def streaming_seconds(deltas: DataFrame) -> DataFrame:
    """(session_id, streaming_s): first to last delta of each turn (session_id, turn, t_ms), summed."""
    turn = deltas.where("t_ms is not null").groupBy("session_id", "turn").agg((F.max("t_ms") - F.min("t_ms")).alias("ms"))
    return turn.groupBy("session_id").agg((F.sum("ms") / 1000).alias("streaming_s"))


def slack_metrics(split: DataFrame, streamed: DataFrame, windows: DataFrame) -> DataFrame:
    """Sessions (total_s, shell_s) with streaming seconds, their share of the total, and the prefetch window; without
    deltas they stream for 0 seconds.
    """
    s = split.join(streamed, "session_id", "left").join(
        windows.select("session_id", "window_s"), "session_id", "left"
    ).withColumn("streaming_s", F.coalesce("streaming_s", F.lit(0.0)))
    return s.withColumn("slack_frac", F.when(F.col("total_s") > 0, F.col("streaming_s") / F.col("total_s")))


def slack_cells(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of total, shell and streaming seconds, window and slack of each cell; those that no session has are null."""
    n = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.join(T.medians(metrics, keys, ["total_s", "shell_s", "streaming_s", "window_s", "slack_frac"], "med_"), keys, "left")


def compliance_report(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (compliance, n_named), those with any access, all paths named, runs that name none, and the upper median of
    compliance.
    """
    n = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count("compliance").alias("n_with_access"), F.sum("n_named").alias("total_named"),
        F.count(F.when(F.col("n_named") == 0, 1)).alias("zero_named")
    )
    med = T.position_percentiles(runs, keys, "compliance", {"median_compliance": ("upper_median", 0.5)})
    return n.join(med, keys, "left") if keys else n.crossJoin(med)


def variant_report(scores: DataFrame, keys: list[str], recall: str = "byte_recall") -> DataFrame:
    """Median recall of each detector variant by key, and the sessions in which it finds nothing that was needed."""
    n = scores.groupBy("variant", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(recall) == 0, 1)).alias("no_detection")
    )
    return n.join(
        T.position_percentiles(scores, ["variant", *keys], recall, {"median_recall": ("linear", 0.5)}), ["variant", *keys]
    )


def lift(semantic: DataFrame, literal: DataFrame, keys: list[str], recall: str = "byte_recall") -> DataFrame:
    """Recall of the rules' layer less that of the literal layer for each key that both have, with both."""
    a = semantic.select(*keys, F.col(recall).alias("semantic"))
    b = literal.select(*keys, F.col(recall).alias("literal"))
    return a.join(b, keys).withColumn("lift", F.col("semantic") - F.col("literal"))
