"""Turns, blocks, tools and time splits of sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import stats as T
from ..operators import sessions as S
from ..sources import logs
from . import fixtures as X


def _money(spark, sf):
    """Turns with their duration as a decimal of cents, so that sums don't depend on their order."""
    return X.turns(spark, sf).withColumn("duration_s", F.col("duration_s").cast("decimal(18,2)"))


def _d(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


def session_shell_split(spark, sf):
    return S.shell_split(_money(spark, sf), ["session_id"]).select(
        "session_id", "n_turns", *_d("total_s", "shell_s", "llm_s", "rest_s")
    )


def prefetch_window(spark, sf):
    w = S.prefetch_window(_money(spark, sf), F.col("tool_name") == "open_file")
    return w.select("session_id", *_d("dispatch_s", "shell_start_s", "window_s"))


def wall_split(spark, sf):
    t = _money(spark, sf).withColumns(
        {
            "t_first": F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 7) * 10),
            "t_last": F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 7) * 10 + (F.col("event_id") % 11) * 5)
        }
    )
    out = S.wall_split(t, ["session_id"])
    return out.select(
        "session_id",
        *[
            F.round(F.col(c).cast("double"), 4).alias(c) for c in (
                "comm_s", "stream_s", "tool_s", "other_s", "total_s", "harness_s"
            )
        ]
    )


def first_tool_dist(spark, sf):
    f = S.first_tool(X.turns(spark, sf)).withColumns(
        {
            "workload": F.concat(F.lit("w"), (F.col("session_id") % 5).cast("string")),
            "model": F.concat(F.lit("m"), (F.col("session_id") % 3).cast("string"))
        }
    )
    return S.top_tools(f, ["workload", "model"]).select(
        "dim", "value", "first_tool", "n", "total", F.col("rank").cast("long").alias("rank"), F.round("share", 4).alias("share")
    )


def probe_share(spark, sf):
    """Share of sessions whose first tool lists a directory, by model, and whether it reaches a fifth."""
    f = S.first_tool(X.turns(spark, sf)).groupBy((F.col("session_id") % 3).alias("model")).agg(
        F.count(F.lit(1)).alias("n"), F.round(T.share(F.col("first_tool") == "list_dir"), 4).alias("share")
    )
    return f.withColumn("meets", F.col("share") >= 0.2)


def timeout_audit(spark, sf):
    t = X.turns(spark, sf).withColumns(
        {"task": F.col("session_id") % 40, "mode": F.when(F.col("session_id") % 2 == 0, "baseline").otherwise("staged")}
    )
    return S.timeout_audit(t, ["task"], "mode", "baseline", 40.0)


def stream_blocks(spark, sf):
    """Deltas of one word each, shuffled by reading order, back into blocks."""
    c = X.table(spark, sf, "conversations").where("role <> 'system'")
    words = c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("block_idx"), "role",
        F.posexplode(F.split("text", "(?<= )")).alias("seq", "chunk")
    )
    e = words.select(
        "session_id", "block_idx", F.col("seq").cast("long").alias("seq"), F.lit("content_block_delta").alias("event"),
        (F.col("block_idx") * 1000.0 + F.col("seq")).alias("t_ms"), F.lit(None).cast("string").alias("block_type"),
        F.lit(None).cast("string").alias("tool_name"),
        F.when(F.col("role") == "user", "text_delta").otherwise("thinking_delta").alias("delta_type"), "chunk"
    )
    start = c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("block_idx"), F.lit(-1).cast("long").alias("seq"),
        F.lit("content_block_start").alias("event"), (F.col("turn") * 1000.0 - 1).alias("t_ms"),
        F.when(F.col("role") == "user", "text").otherwise("thinking").alias("block_type"),
        F.lit(None).cast("string").alias("tool_name"), F.lit(None).cast("string").alias("delta_type"),
        F.lit(None).cast("string").alias("chunk")
    )
    b = logs.assemble_blocks(e.unionByName(start))
    return b.select(
        "session_id", F.col("block_idx"), "type", "t_first", "t_stop", "text", F.col("chunks").cast("long").alias("chunks")
    )


def message_blocks(spark, sf):
    """Blocks of message histories, with turns counted over assistant messages and synthetic times."""
    m = X.table(spark, sf, "conversations").where("role <> 'system'").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role",
        F.array(
            F.struct(
                F.when(F.col("role") == "user", "tool_result").otherwise("text").alias("type"), F.col("text").alias("text"),
                F.lit(None).cast("string").alias("name")
            )
        ).alias("content")
    )
    return logs.message_blocks(m).select(
        "session_id", "block_seq", "turn", "type", "t_first", "t_stop", F.length("text").alias("n_chars")
    )


def thinking_slack(spark, sf):
    b = X.blocks(spark, sf)
    return S.slack(b).join(S.thinking(b), "session_id").select(
        "session_id", "slack_ms", "has_thinking", F.col("thinking_chars").cast("long").alias("thinking_chars")
    )


def _calls(spark, sf):
    """Every turn as a tool use; writes have no result. Long calls were killed, reads failed."""
    t = _money(spark, sf)
    rc = F.when(F.col("duration_s") >= 40, "-9").when(F.col("tool_name") == "read_file", "1").otherwise("0")
    out = F.concat(F.lit("run_shell_command (rc="), rc, F.lit(", "), F.col("duration_s").cast("string"), F.lit("s) done"))
    uses = t.select("session_id", (F.col("turn") / 3).cast("long").alias("turn"), F.col("event_id").alias("id"), "duration_s")
    results = t.where("tool_name <> 'write_file'").select(F.col("event_id").alias("tool_use_id"), "turn", out.alias("content"))
    p = S.pair_results(uses, results)
    return p.select(
        "session_id", "turn", "id", S.exit_code(F.col("content")).alias("rc"),
        S.exit_seconds(F.col("content")).cast("decimal(18,2)").alias("seconds"), "duration_s",
        F.lit(1).cast("decimal(18,2)").alias("last_delta_s")
    )


def tool_pairing(spark, sf):
    return _calls(spark, sf).select("id", "rc", F.col("seconds").cast("double").alias("seconds"))


def replay_turns(spark, sf):
    r = S.replay_turns(_calls(spark, sf).withColumn("seconds", F.coalesce("seconds", F.lit(0))))
    return r.select("session_id", "turn", *_d("shell_s", "killed_s", "stream_s"))


def selection_stats(spark, sf):
    return S.selection_stats(_calls(spark, sf)).select("session_id", "n_kills", F.col("rc0_s").cast("double").alias("rc0_s"))


def path_compliance(spark, sf):
    """Files opened (clicks and signups) against files named before (views), by session."""
    f = X.files(spark, sf).select("doc_id", "path")
    e = X.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("long").alias("doc_id"), "event_type"
    ).join(f, "doc_id")
    c = S.compliance(e.where("event_type in ('click', 'signup')"), e.where("event_type = 'view'"), ["session_id"])
    return c.select("session_id", "n_accessed", "n_hit", "n_named", F.round("compliance", 4).alias("compliance"))


def _runs(spark, sf):
    o = X.table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 60).alias("task"), F.col("o_orderpriority").alias("model"),
        F.when(F.col("o_orderkey") % 2 == 0, "baseline").otherwise("pathful").alias("mode"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("elapsed"), F.col("o_orderdate").alias("day")
    )


def paired_prompt_delta(spark, sf):
    p = S.first_pairs(_runs(spark, sf), ["task", "model"], "mode", "baseline", "pathful", "run", "elapsed")
    return p.select(
        "task", "model", *_d("base", "other", "delta"), F.round(F.col("overhead_pct").cast("double"), 4).alias("overhead_pct")
    )


def against_median(spark, sf):
    r = S.against_median(
        _runs(spark, sf).withColumn("elapsed", F.col("elapsed").cast("double")), ["task", "model"], "mode", "baseline", "elapsed"
    )
    return r.select("run", "task", "model", F.round("overhead_pct", 3).alias("overhead_pct"))


def campaign_filter(spark, sf):
    """Sessions by provider family and model key, without the ill-defined task, with defaults for missing fields."""
    o = X.table(spark, sf, "orders")
    names = F.array(
        *[F.lit(x) for x in ("claude-haiku-x", "claude-sonnet-y", "gemini-2.5-flash", "Qwen3", "deepseek-v", "other")]
    )
    s = o.select(
        F.concat(F.lit("task_"), (100 + F.col("o_custkey") % 5).cast("string")).alias("task"),
        F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("model"),
        F.when(F.col("o_orderkey") % 4 == 0, "openrouter").otherwise("").alias("provider"),
        F.coalesce(
            F.nullif(F.col("o_shippriority") if "o_shippriority" in o.columns else F.lit(0), F.lit(0)), F.lit(1)
        ).alias("turn"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("v")
    )
    k = s.where(L.is_well_defined(F.col("task"), ("task_101",)))
    return k.groupBy(
        "task", L.provider_family(F.col("provider"), F.col("model")).alias("family"), L.model_key(F.col("model")).alias("key"),
        F.col("turn").cast("int").alias("turn")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("v").cast("double").alias("total"))


def segment_time(spark, sf):
    """Times of every hundredth character of a session's text, from the block that holds it."""
    from ..operators.matching import transcript

    t = transcript(X.blocks(spark, sf)).select(
        "session_id", F.col("char_base").alias("start"), (F.col("char_base") + F.length("text")).alias("end"),
        F.col("t_first").cast("double").alias("t_first"), F.col("t_stop").cast("double").alias("t_stop")
    )
    ends = t.groupBy("session_id").agg(F.max("end").alias("n"))
    points = ends.select(
        "session_id", F.explode(F.sequence(F.lit(0), F.col("n") + 50, F.lit(100))).alias("pos")
    ).withColumn("point", F.col("pos"))
    return S.segment_time(points, t).select("session_id", "point", F.round("t_ms", 4).alias("t_ms"))


def pass_fractions(spark, sf):
    """Shares of sessions that meet bounds, by family, where a family has three at least."""
    s = S.shell_split(_money(spark, sf), ["session_id"]).select(
        "*", (F.col("session_id") % 7).alias("family"), F.col("total_s").cast("double").alias("x")
    )
    m = T.position_percentiles(s, ["family"], "x", {"median_s": ("linear", 0.5)})
    return s.join(m, "family").groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.round(T.share(F.col("total_s") >= 3000), 4).alias("long"),
        F.round(T.share(F.col("shell_s") * 5 >= F.col("total_s")), 4).alias("shell_heavy"),
        F.first("median_s").alias("median_s")
    ).where("n >= 3")


def new_per_turn(spark, sf):
    """Files a session opens for the first time, by turn."""
    f = X.table(spark, sf, "events").where("event_type = 'click'").select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("doc_id"), "ts"
    )
    turn = f.withColumn("turn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1)
    first = turn.groupBy("user_id", "doc_id").agg(F.min("turn").alias("turn"))
    return first.groupBy("user_id", "turn").agg(F.count(F.lit(1)).alias("n_new"))


QUERIES = {
    f.__name__: f for f in (
        session_shell_split, prefetch_window, wall_split, first_tool_dist, probe_share, timeout_audit, stream_blocks,
        message_blocks, thinking_slack, tool_pairing, replay_turns, selection_stats, path_compliance, paired_prompt_delta,
        against_median, campaign_filter, segment_time, pass_fractions, new_per_turn
    )
}

_T = "select session_id, turn, tool_name, cast(duration_s as decimal(18,2)) as d, event_id from fx_turns"
_SPLIT = f"select session_id, count(*) as n_turns, sum(d) as total_s, coalesce(sum(d) filter (tool_name = 'run_shell_command'), 0) as shell_s from ({_T}) group by session_id"
_FIRST = "select session_id, arg_min(tool_name, turn) as first_tool from fx_turns group by session_id"
_RUNS = "select o_orderkey as run, o_custkey % 60 as task, o_orderpriority as model, case when o_orderkey % 2 = 0 then 'baseline' else 'pathful' end as mode, cast(o_totalprice as decimal(18,2)) as elapsed from orders"
_CALLS = f"""select t.session_id, t.turn // 3 as turn, t.event_id as id, case when tool_name <> 'write_file' then (case when d >= 40 then -9 when tool_name = 'read_file' then 1 else 0 end) end as rc,
  case when tool_name <> 'write_file' then d end as seconds, d from ({_T}) t"""

SQL = {
    "session_shell_split": f"select session_id, n_turns, cast(total_s as double) as total_s, cast(shell_s as double) as shell_s, cast(total_s - shell_s as double) as llm_s, cast(total_s - shell_s as double) as rest_s from ({_SPLIT})",
    "prefetch_window": f"with s as (select *, coalesce(sum(d) over (partition by session_id order by turn rows between unbounded preceding and 1 preceding), 0) as st from ({_T})), g as (select session_id, min(st) filter (tool_name = 'open_file') as a, min(st) filter (tool_name = 'run_shell_command') as b from s group by session_id) select session_id, cast(a as double) as dispatch_s, cast(b as double) as shell_start_s, cast(b - a as double) as window_s from g",
    "wall_split": f"with t as (select *, case when event_id % 3 > 0 then event_id % 7 * 10 end as f, case when event_id % 3 > 0 then event_id % 7 * 10 + event_id % 11 * 5 end as l, tool_name = 'run_shell_command' as sh from ({_T})), g as (select session_id, coalesce(sum(f), 0) / 1000.0 as c, coalesce(sum(l - f), 0) / 1000.0 as s, coalesce(sum(d * 1000 - coalesce(l, 0)) filter (sh), 0) / 1000.0 as tl, coalesce(sum(d * 1000 - coalesce(l, 0)) filter (not sh), 0) / 1000.0 as o, sum(d) as total from t group by session_id) select session_id, round(cast(c as double), 4) as comm_s, round(cast(s as double), 4) as stream_s, round(cast(tl as double), 4) as tool_s, round(cast(o as double), 4) as other_s, cast(total as double) as total_s, 0.0::double as harness_s from g",
    "first_tool_dist": f"with f as ({_FIRST}), e as (select 'all' as dim, 'all' as value, first_tool from f union all select 'workload', concat('w', cast(session_id % 5 as varchar)), first_tool from f union all select 'model', concat('m', cast(session_id % 3 as varchar)), first_tool from f), n as (select dim, value, first_tool, count(*) as n from e group by dim, value, first_tool), r as (select *, cast(sum(n) over (partition by dim, value) as bigint) as total, row_number() over (partition by dim, value order by n desc, first_tool) as rank from n) select dim, value, first_tool, n, total, rank, round(n / total, 4) as share from r where rank <= 5",
    "probe_share": f"with f as ({_FIRST}) select session_id % 3 as model, count(*) as n, round(avg(cast(first_tool = 'list_dir' as int)), 4) as share, round(avg(cast(first_tool = 'list_dir' as int)), 4) >= 0.2 as meets from f group by 1",
    "timeout_audit": "with g as (select session_id % 40 as task, count(*) filter (tool_name = 'run_shell_command' and duration_s >= 40 and session_id % 2 = 0) as base_to, count(*) filter (tool_name = 'run_shell_command' and duration_s >= 40 and session_id % 2 = 1) as staged_to from fx_turns group by 1) select *, abs(base_to - staged_to) as asymmetry, case when base_to + staged_to = 0 then 'CLEAN' when abs(base_to - staged_to) <= 1 then 'SYMMETRIC' else 'ASYMMETRIC' end as class from g",
    "stream_blocks": "select conv_id as session_id, turn as block_idx, case when role = 'user' then 'text' else 'thinking' end as type, turn * 1000.0::double as t_first, turn * 1000.0::double + length(text) - length(replace(text, ' ', '')) - case when text like '% ' then 0 else 0 end as t_stop, text, cast(length(text) - length(replace(text, ' ', '')) + 1 as bigint) as chunks from conversations where role <> 'system'",
    "message_blocks": "with m as (select conv_id, turn, role, text, coalesce(sum(case when role = 'assistant' then 1 else 0 end) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as k from conversations where role <> 'system') select conv_id as session_id, cast(row_number() over (partition by conv_id order by turn) - 1 as bigint) as block_seq, cast(k as bigint) as turn, case when role = 'user' then 'tool_result' else 'text' end as type, cast(case when role = 'user' then greatest(k * 1000.0 - 500, 0) else k * 1000.0 end as double) as t_first, cast(case when role = 'user' then greatest(k * 1000.0 - 500, 0) else (k + 1) * 1000.0 end as double) as t_stop, cast(length(text) as integer) as n_chars from m",
    "thinking_slack": "with g as (select session_id, min(block_seq) filter (type = 'tool_use') as u, min(block_seq) filter (type = 'thinking') as k, coalesce(sum(length(text)) filter (type = 'thinking'), 0) as c, bool_or(type = 'thinking') as h from fx_blocks group by session_id) select session_id, case when k < u then (u - k) * 1000.0::double end as slack_ms, h as has_thinking, cast(c as bigint) as thinking_chars from g",
    "tool_pairing": f"select id, rc, cast(seconds as double) as seconds from ({_CALLS})",
    "replay_turns": f"select session_id, turn, cast(coalesce(sum(seconds), 0) as double) as shell_s, cast(coalesce(sum(seconds) filter (rc = -9), 0) as double) as killed_s, cast(greatest(max(d) - coalesce(sum(seconds), 0), 1) as double) as stream_s from ({_CALLS}) group by session_id, turn",
    "selection_stats": f"select session_id, count(*) filter (rc = -9) as n_kills, cast(coalesce(sum(seconds) filter (rc = 0), 0) as double) as rc0_s from ({_CALLS}) group by session_id",
    "path_compliance": "with e as (select distinct e.user_id as session_id, f.path, e.event_type = 'view' as named from events e join fx_files f on f.doc_id = cast(json_extract_string(e.props, '$.k') as bigint) where e.event_type in ('view', 'click', 'signup')), g as (select session_id, path, bool_or(named) as n, bool_or(not named) as a from e group by session_id, path) select session_id, count(*) filter (a) as n_accessed, count(*) filter (a and n) as n_hit, count(*) filter (n) as n_named, round(count(*) filter (a and n) / nullif(count(*) filter (a), 0), 4) as compliance from g group by session_id",
    "paired_prompt_delta": f"with r as ({_RUNS}), g as (select task, model, arg_min(elapsed, run) filter (mode = 'baseline') as b, arg_min(elapsed, run) filter (mode = 'pathful') as o from r group by task, model) select task, model, cast(b as double) as base, cast(o as double) as other, cast(o - b as double) as delta, round(cast(o - b as double) / greatest(1.0, cast(b as double)) * 100, 4) as overhead_pct from g where b is not null and o is not null",
    "against_median": f"with r as (select run, task, model, mode, cast(elapsed as double) as e from ({_RUNS})), m as (select task, model, quantile_cont(e, 0.5) as med from r where mode = 'baseline' group by task, model) select r.run, r.task, r.model, round((e - med) / greatest(1.0, med) * 100, 3) as overhead_pct from r join m on m.task = r.task and m.model = r.model where mode <> 'baseline'",
    "campaign_filter": "with s as (select concat('task_', cast(100 + o_custkey % 5 as varchar)) as task, o_orderkey % 6 as k, o_orderkey % 4 = 0 as p, cast(o_totalprice as decimal(18,2)) as v from orders) select task, case when k in (0, 1) then 'anthropic' when k = 2 then 'gemini' when p or k = 4 then 'openrouter' else 'oss' end as family, case k when 0 then 'haiku' when 1 then 'sonnet' when 2 then 'flash' when 3 then 'qwen3' end as key, 1 as turn, count(*) as n, cast(sum(v) as double) as total from s where task <> 'task_101' group by 1, 2, 3",
    "segment_time": "with t as (select session_id, coalesce(sum(length(text)) over (partition by session_id order by block_seq rows between unbounded preceding and 1 preceding), 0) as s, length(text) as n, t_first::double as f, t_stop::double as l from fx_blocks where type in ('thinking', 'text', 'tool_result')), e as (select session_id, max(s + n) as n from t group by session_id), p as (select session_id, unnest(range(0, cast(n + 51 as bigint), 100)) as pos from e) select p.session_id, p.pos as point, round(f + (l - f) * (pos - s) / greatest(1, t.n), 4) as t_ms from p left join t on t.session_id = p.session_id and pos >= s and pos < s + t.n",
    "pass_fractions": f"select session_id % 7 as family, count(*) as n, round(avg(cast(total_s >= 3000 as int)), 4) as long, round(avg(cast(shell_s * 5 >= total_s as int)), 4) as shell_heavy, quantile_cont(cast(total_s as double), 0.5) as median_s from ({_SPLIT}) group by 1 having count(*) >= 3",
    "new_per_turn": "with t as (select user_id, cast(json_extract_string(props, '$.k') as bigint) as doc_id, row_number() over (partition by user_id order by ts) - 1 as turn from events where event_type = 'click'), f as (select user_id, doc_id, min(turn) as turn from t group by user_id, doc_id) select user_id, turn, count(*) as n_new from f group by user_id, turn",
}
