"""Per-session arithmetic over turns: where the time went, when tools came, who compares with whom.

Turns are rows (session_id, turn, tool_name, duration_s, ...). A turn with several tools has one row with ``tool_names``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as T

SHELL = "run_shell_command"


def is_shell(df: DataFrame) -> Column:
    return F.array_contains("tool_names", SHELL) if "tool_names" in df.columns else F.col("tool_name") == SHELL


def shell_split(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Total, shell and other seconds. ``llm_s`` sums the turns without a shell; ``rest_s`` is the total less the shell."""
    shell = F.sum(F.when(is_shell(turns), F.col("duration_s")).otherwise(0))
    return turns.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("duration_s").alias("total_s"), shell.alias("shell_s"),
        F.sum(F.when(is_shell(turns), 0).otherwise(F.col("duration_s"))).alias("llm_s")
    ).withColumn("rest_s", F.col("total_s") - F.col("shell_s"))


def turn_starts(turns: DataFrame) -> DataFrame:
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("start_s", F.coalesce(F.sum("duration_s").over(before), F.lit(0)))


def prefetch_window(turns: DataFrame, dispatched: Column) -> DataFrame:
    """Start of the first dispatching turn, of the first shell turn, and the time between; null where one is missing."""
    s = turn_starts(turns).groupBy("session_id").agg(
        F.min(F.when(dispatched, F.col("start_s"))).alias("dispatch_s"),
        F.min(F.when(is_shell(turns), F.col("start_s"))).alias("shell_start_s")
    )
    return s.withColumn("window_s", F.col("shell_start_s") - F.col("dispatch_s"))


def wall_split(turns: DataFrame, keys: list[str], total: Column | None = None) -> DataFrame:
    """Waiting, streaming, tool and other seconds from the first and last delta times (ms) of each turn, and what of the
    total is left.

    A turn without deltas is all tool time if it ran a shell, else other.
    """
    d, shell = F.col("duration_s") * 1000, is_shell(turns)
    seen = F.col("t_first").isNotNull() & F.col("t_last").isNotNull()
    rest = F.when(seen, d - F.col("t_last")).otherwise(d)
    of = lambda c: F.sum(c) / 1000
    out = turns.groupBy(*keys).agg(
        of(F.when(seen, F.col("t_first")).otherwise(0)).alias("comm_s"),
        of(F.when(seen, F.col("t_last") - F.col("t_first")).otherwise(0)).alias("stream_s"),
        of(F.when(shell, rest).otherwise(0)).alias("tool_s"), of(F.when(shell, 0).otherwise(rest)).alias("other_s"),
        (F.sum("duration_s") if total is None else F.max(total)).alias("total_s")
    )
    return out.withColumn(
        "harness_s",
        F.greatest(F.lit(0.0), F.col("total_s") - F.col("comm_s") - F.col("stream_s") - F.col("tool_s") - F.col("other_s"))
    )


def first_tool(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("tool_name").isNotNull()).groupBy("session_id").agg(
        F.min_by("tool_name", "turn").alias("first_tool")
    )


def top_tools(first: DataFrame, sets: list[str], k: int = 5) -> DataFrame:
    """The k most frequent first tools of each value of each column, and overall (``dim`` all); ties go to the smaller name."""
    base = first.withColumn("all", F.lit("all"))
    each = base.select(
        "first_tool",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in [*sets, "all"]])
        ).alias("g")
    )
    n = each.groupBy("g.dim", "g.value", "first_tool").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("dim", "value")
    ranked = n.withColumns({"total": F.sum("n").over(own), "rank": F.row_number().over(own.orderBy(F.desc("n"), "first_tool"))})
    return ranked.where(F.col("rank") <= k).withColumn("share", F.col("n") / F.col("total"))


def timeout_audit(turns: DataFrame, keys: list[str], mode: str, base: str, cliff: float) -> DataFrame:
    """Shell turns at or over the cliff for the base mode and the others, and whether the two sides differ by more than one."""
    over = is_shell(turns) & (F.col("duration_s") >= cliff)
    n = turns.groupBy(*keys).agg(
        F.count(F.when(over & (F.col(mode) == base), 1)).alias("base_to"),
        F.count(F.when(over & (F.col(mode) != base), 1)).alias("staged_to")
    )
    asym = F.abs(F.col("base_to") - F.col("staged_to"))
    return n.withColumn("asymmetry", asym).withColumn(
        "class",
        F.when(
            F.col("base_to") + F.col("staged_to") == 0, "CLEAN"
        ).when(F.col("asymmetry") <= 1, "SYMMETRIC").otherwise("ASYMMETRIC")
    )


def slack(blocks: DataFrame) -> DataFrame:
    """Time from the first thinking block to the first tool use after which none is read; null if either is missing.
    Block order decides.
    """
    tool = F.min(F.when(F.col("type") == "tool_use", F.struct("block_seq", "t_first")))
    first = blocks.groupBy("session_id").agg(
        tool.alias("tool"), F.min(F.when(F.col("type") == "thinking", F.struct("block_seq", "t_first"))).alias("think")
    )
    return first.select(
        "session_id",
        F.when(
            F.col("think.block_seq") < F.col("tool.block_seq"), F.col("tool.t_first") - F.col("think.t_first")
        ).alias("slack_ms")
    )


def thinking(blocks: DataFrame) -> DataFrame:
    """Whether a session has thinking, and its characters."""
    own = F.col("type") == "thinking"
    return blocks.groupBy("session_id").agg(
        F.max(own).alias("has_thinking"), F.sum(F.when(own, F.length("text")).otherwise(0)).alias("thinking_chars")
    )


def thinking_chars(blocks: DataFrame, deltas: DataFrame) -> DataFrame:
    """(session_id, thinking_chars): characters of thinking blocks, or where a session's blocks have none, of its
    thinking deltas (session_id, delta).
    """
    own = thinking(blocks).select("session_id", F.nullif("thinking_chars", F.lit(0)).alias("a"))
    said = deltas.groupBy("session_id").agg(F.sum(F.length("delta")).alias("b"))
    return own.join(said, "session_id", "full").select("session_id", F.coalesce("a", "b", F.lit(0)).alias("thinking_chars"))


def replay_turns(calls: DataFrame) -> DataFrame:
    """Per session and turn: shell seconds, those of killed calls (rc -9), and the implied stream time, at least the
    last delta. Calls: rc, seconds, duration_s, last_delta_s.
    """
    s = calls.groupBy("session_id", "turn").agg(
        F.sum("seconds").alias("shell_s"), F.sum(F.when(F.col("rc") == -9, F.col("seconds")).otherwise(0)).alias("killed_s"),
        F.max("duration_s").alias("duration_s"), F.max("last_delta_s").alias("last_delta_s")
    )
    return s.withColumn("stream_s", F.greatest(F.col("duration_s") - F.col("shell_s"), "last_delta_s"))


def selection_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session_id").agg(
        F.count(F.when(F.col("rc") == -9, 1)).alias("n_kills"),
        F.sum(F.when(F.col("rc") == 0, F.col("seconds")).otherwise(0)).alias("rc0_s")
    )


def pair_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Tool uses with the content of their result; null without one. Of several results of an id the first by turn counts."""
    one = results.groupBy("tool_use_id").agg(F.min_by("content", "turn").alias("content"))
    return uses.join(one, uses["id"] == one["tool_use_id"], "left").drop("tool_use_id")


def exit_code(content: Column) -> Column:
    return F.regexp_extract(content, r"\(rc=(-?\d+), [0-9.]+s\)", 1).try_cast("int")


def exit_seconds(content: Column) -> Column:
    return F.regexp_extract(content, r"\(rc=-?\d+, ([0-9.]+)s\)", 1).try_cast("double")


def compliance(accessed: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """Share of accessed files that were named before, null where none was accessed; both are deduplicated."""
    a = accessed.select(*keys, "path").distinct()
    n = named.select(*keys, "path").distinct().withColumn("named", F.lit(1))
    emitted = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_named"))
    s = a.join(n, [*keys, "path"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_accessed"), F.count("named").alias("n_hit")
    )
    return s.join(emitted, keys, "full").withColumns(
        {
            "n_accessed": F.coalesce("n_accessed", F.lit(0)), "n_hit": F.coalesce("n_hit", F.lit(0)),
            "n_named": F.coalesce("n_named", F.lit(0)), "compliance": F.try_divide("n_hit", "n_accessed")
        }
    )


def first_pairs(runs: DataFrame, keys: list[str], mode: str, left: str, right: str, order: str, value: str) -> DataFrame:
    """The first run of either mode for each key, side by side, with the difference and the overhead in percent."""
    one = runs.where(F.col(mode).isin(left, right)).withColumn(
        "__n", F.row_number().over(Window.partitionBy(*keys, mode).orderBy(order))
    ).where("__n = 1")
    both = one.groupBy(*keys).agg(
        F.max(F.when(F.col(mode) == left, F.col(value))).alias("base"),
        F.max(F.when(F.col(mode) == right, F.col(value))).alias("other")
    ).where("base is not null and other is not null")
    return both.withColumns(
        {
            "delta": F.col("other") - F.col("base"),
            "overhead_pct": (F.col("other") - F.col("base")) / F.greatest(F.lit(1.0), F.col("base")) * 100
        }
    )


def against_median(runs: DataFrame, keys: list[str], mode: str, base: str, value: str) -> DataFrame:
    """Runs of other modes against the median of the base runs with the same keys."""
    m = T.position_percentiles(
        runs.where(F.col(mode) == base).withColumn(value, F.col(value).cast("double")), keys, value, {"base_median": ("linear", 0.5)}
    )
    return runs.where(F.col(mode) != base).join(m, keys).withColumn(
        "overhead_pct", (F.col(value) - F.col("base_median")) / F.greatest(F.lit(1.0), F.col("base_median")) * 100
    )


def segment_time(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Points (session_id, pos) with the time of the segment [start, end) that holds them, linear inside; null outside all.

    A union ordered by position carries the segment start down to its points: one sort per
    session instead of a range join.
    """
    s = segments.select(
        "session_id", F.col("start").alias("pos"), F.lit(0).alias("kind"),
        F.struct("start", "end", "t_first", "t_stop").alias("seg"), F.lit(None).cast("long").alias("point")
    )
    p = points.select(
        "session_id", "pos", F.lit(1).alias("kind"), F.lit(None).cast(s.schema["seg"].dataType).alias("seg"),
        F.col("point").cast("long")
    )
    last = Window.partitionBy("session_id").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = s.unionAll(p).withColumn("seg", F.last("seg", True).over(last)).where("kind = 1")
    inside = (F.col("pos") >= F.col("seg.start")) & (F.col("pos") < F.col("seg.end"))
    t = F.col("seg.t_first") + (F.col("seg.t_stop") - F.col("seg.t_first")) * (F.col("pos") - F.col("seg.start")) / F.greatest(
        F.lit(1), F.col("seg.end") - F.col("seg.start")
    )
    return g.select("session_id", "point", "pos", F.when(inside, t).alias("t_ms"))
