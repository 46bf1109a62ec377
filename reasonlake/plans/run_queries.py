"""Aggregates over whole runs, bucket and mount lookups, variants of detectors, and choices among files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import paths as P
from ..functions import stats as T
from ..operators import cells as C
from ..operators import matching as M
from ..operators import planning as N
from ..operators import runs as R
from ..operators import scoring as S
from ..operators import sessions as E
from ..sources import logs
from ..sources.staging import staged
from . import cell_queries, session_queries
from . import detection_queries as D
from . import fixtures as X


def _r(names, d=4):
    return [F.round(F.col(n).cast("double"), d).alias(n) for n in names]


# ---- sessions

_SHARES = (
    "total_s", "comm_s", "stream_s", "tool_s", "other_s", "harness_s", "tool_exec_pct", "reasoning_pct", "comm_pct", "harness_pct"
)


def share_medians(spark, sf):
    """Medians of seconds and shares of sessions, by bench and mode."""
    keys = {"bench": F.col("session_id") % 4, "mode": F.when(F.col("session_id") % 2 == 0, "baseline").otherwise("staged")}
    s = session_queries.wall_split(spark, sf).withColumns(keys)
    return R.share_medians(s, ["bench", "mode"]).select("bench", "mode", "n_sessions", *_r(_SHARES, 3))


def _deltas(spark, sf):
    """Events as deltas, three to a turn: the value is the time in the turn."""
    t = X.turns(spark, sf)
    return t.select(
        "session_id", (F.col("turn") / 3).cast("long").alias("turn"),
        (F.col("duration_s") * 1000).cast("decimal(18,0)").alias("t_ms")
    )


def _slack(spark, sf):
    money = session_queries._money(spark, sf)
    split = E.shell_split(money, ["session_id"]).select("session_id", "total_s", "shell_s")
    return R.slack_metrics(
        split, R.streaming_seconds(_deltas(spark, sf)), E.prefetch_window(money, F.col("tool_name") == "open_file")
    )


def slack_metrics(spark, sf):
    return _slack(spark, sf).select("session_id", *_r(("streaming_s", "slack_frac", "window_s")))


def slack_cells(spark, sf):
    m = _slack(spark, sf).withColumns(
        {"task": F.col("session_id") % 10, "mode": F.when(F.col("session_id") % 2 == 0, "baseline").otherwise("staged")}
    )
    return R.slack_cells(m, ["task", "mode"]).select(
        "task", "mode", "n", *_r([f"med_{c}" for c in ("total_s", "shell_s", "streaming_s", "window_s", "slack_frac")], 3)
    )


def io_counters(spark, sf):
    """Counters of the shell calls of each session; reads of cached files are missing."""
    t = X.turns(spark, sf).where("tool_name = 'run_shell_command'")
    size = F.floor(F.col("duration_s") * 1000)
    c = t.select(
        "session_id", size.alias("rchar"), F.when(F.col("duration_s") >= 20, size * 4).alias("read_bytes"),
        F.lit(None).cast("long").alias("wchar"), F.col("duration_s").cast("decimal(18,2)").alias("elapsed_s")
    )
    return R.io_counters(c, ["session_id"]).select(
        "session_id", "rchar", "read_bytes", "wchar", "n_shell_calls",
        F.col("shell_elapsed_total_s").cast("double").alias("shell_elapsed_total_s")
    )


def _named(spark, sf):
    """(session_id, path, absolute): complete paths that a session's reasoning names."""
    said = X.talk(spark, sf).where("type = 'thinking'").select(
        "session_id", F.explode(P.path_tokens(F.col("text"))).alias("path"), "text"
    )
    return said.select(
        "session_id", "path", F.contains("text", F.concat(F.lit("/"), "path")).alias("absolute")
    ).groupBy("session_id", "path").agg(F.max("absolute").alias("absolute"))


def pathfulness(spark, sf):
    sessions = X.talk(spark, sf).select("session_id").distinct()
    n = _named(spark, sf).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_complete"), F.count(F.when(F.col("absolute"), 1)).alias("n_abs")
    )
    runs = sessions.join(n, "session_id", "left").select(
        (F.col("session_id") % 3).alias("bench"), F.coalesce("n_complete", F.lit(0)).alias("n_complete"),
        F.coalesce("n_abs", F.lit(0)).alias("n_abs")
    )
    return R.pathfulness(runs, ["bench"])


def compliance_report(spark, sf):
    runs = session_queries.path_compliance(spark, sf).withColumn(
        "model", F.concat(F.lit("m"), (F.col("session_id") % 3).cast("string"))
    )
    out = R.compliance_report(runs, ["model"]).unionByName(R.compliance_report(runs, []).withColumn("model", F.lit("all")))
    return out.select("model", "n_runs", "n_with_access", "total_named", "zero_named", *_r(("median_compliance",)))


def real_run_means(spark, sf):
    """Means of runs by priority, for the models that are kept."""
    o = X.table(spark, sf, "orders").where("o_orderstatus in ('F', 'O')").select(
        F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("workload")
    )
    t = logs.io_totals(cell_queries.reports(spark, sf)).join(o, "file")
    return R.real_runs(t, ["workload"]).select(
        "workload", "n_runs", *_r(("mean_job_time", "mean_io_frac", "mean_elim_speedup", "mean_far_speedup"), 3)
    )


def rep_medians(spark, sf):
    o = cell_queries._orders(spark, sf)
    rc = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("rc")
    )
    return C.rep_medians(
        o.join(rc, "run"), ["task"], "mode", "v", "rc", "baseline"
    ).select("task", "base", "other", *_r(("speedup", "saved"), 3))


#: Benchmarks of the orders, by the start or a part of their priority's name.
BENCHES = [("1-", "", "first"), ("4-", "MEDIUM", "middle")]


def campaign_runs(spark, sf):
    """Runs by benchmark, model and prompt, after the full campaign filter. A task is a priority and a clerk."""
    o = X.table(spark, sf, "orders")
    models = F.array(
        *[F.lit(x) for x in ("claude-haiku-4-5", "claude-sonnet-4-5", "gemini-2.5-flash", "Qwen/Qwen3.6-27B", "deepseek-v")]
    )
    k = F.col("o_orderkey")
    runs = o.select(
        F.concat_ws("/", "o_orderpriority", (F.col("o_custkey") % 7).cast("string")).alias("task"),
        F.element_at(models, (k % 5 + 1).cast("int")).alias("model"), F.lit("").alias("provider"),
        (F.col("o_custkey") % 11 == 0).alias("planning_prompt"), F.lit(1).alias("turn"), (F.col("o_orderstatus") != "P").alias("has_thinking"), (F.col("o_totalprice") > 1000).alias("has_metrics"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise("hinted").alias("prompt_mode"), F.when(
            F.col("o_orderpriority") == "5-LOW", "pathful_v4"
        ).otherwise("plain").alias("prompt_variant"))
    kept = logs.filter_campaign(
        runs, exclude_tasks=("2-HIGH/3",), ill_defined=("5-LOW/6",), model="-", family="anthropic", planning_prompt=False, turn=1,
        with_thinking=True, has_metrics=True
    )
    bucket = L.prompt_bucket(F.col("prompt_mode"), F.col("prompt_variant"), ("plain", "hinted"), ("pathful_v4",))
    return kept.groupBy(
        L.bench_of(F.col("task"), BENCHES, "rest").alias("bench"), L.model_label(F.col("model")).alias("label"), bucket.alias("prompt")
    ).agg(F.count(F.lit(1)).alias("n"))


# ---- lookups


def mount_classes(spark, sf):
    """Device classes of mounts made of the suppliers; types that hold no data are left out."""
    kinds = F.array(*[F.lit(x) for x in ("tmpfs", "nfs4", "fuse.s3fs", "ext4", "xfs", "proc", "overlay")])
    devices = F.array(*[F.lit(x) for x in ("/dev/nvme0n1", "/dev/sda1", "/dev/sdb", "none", "")])
    s = X.table(spark, sf, "supplier").select(
        "s_suppkey", F.element_at(kinds, (F.col("s_suppkey") % 7 + 1).cast("int")).alias("fs"),
        F.element_at(devices, (F.col("s_nationkey") % 5 + 1).cast("int")).alias("device"),
        F.when(F.col("s_nationkey") % 3 < 2, F.col("s_nationkey") % 3 == 0).alias("rotational")
    )
    s = s.where(~F.col("fs").isin(*L.SKIPPED_FS))
    return s.select("s_suppkey", "fs", L.device_class(F.col("fs"), F.col("device"), F.col("rotational")).alias("class"))


#: Buckets of the documents' tree, by the start of a path below its root.
TREE = [("en/src1/", "english_first"), ("en/", "english"), ("de/", "german")]
_ENDINGS = (".md", ".py", ".csv", ".png")
_TABLES = ("train", "test", "submission")


def _tree_files(spark, sf):
    """Documents as files of a tree: their folder is lang/source, their name and ending follow from id and size."""
    d = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(x) for x in _ENDINGS]), (d % len(_ENDINGS) + 1).cast("int"))
    stem = F.when(d % 9 < 3, F.element_at(F.array(*[F.lit(x) for x in _TABLES]), (d % 9 % 3 + 1).cast("int"))).when(
        d % 9 < 6, F.concat("lang", F.lit("."), (F.col("bytes") % 50).cast("string"))
    ).otherwise(F.concat("lang", F.lit("-"), (F.col("bytes") % 50).cast("string")))
    return X.files(spark, sf).select(F.concat("lang", F.lit("/"), "source", F.lit("/"), stem, ending).alias("relative"), "bytes")


def name_buckets(spark, sf):
    """Buckets of all documents' files by each rule."""
    f = _tree_files(spark, sf)
    name = P.basename(F.col("relative"))
    return f.groupBy(
        P.code_bucket(F.col("relative"), TREE).alias("code"), P.csv_role(name).alias("role"), P.csv_bucket(name).alias("csv"),
        P.class_bucket(name, {"en": "class_english", "fr": "class_french"}).alias("class")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def instance_buckets(spark, sf):
    """Buckets of paths that hold bands, days, months, detectors, samples and subjects."""
    d = F.col("doc_id")
    kind = F.when(
        d % 5 == 0,
        F.concat(
            F.lit("/g/2024/"), F.lpad((d % 366).cast("string"), 3, "0"), F.lit("/00/x_M6C0"), F.lit(8) + d % 2, F.lit("_s.nc")
        )
    )
    kind = kind.when(
        d % 5 == 1, F.concat(F.lit("/s/T10_2024"), F.lpad((d % 12 + 1).cast("string"), 2, "0"), F.lit("12T1_L2A.tif"))
    ).when(d % 5 == 2, F.concat(F.lit("/j/jw_nrca"), d % 4 + 1, F.lit("_cal.fits")))
    kind = kind.when(
        d % 5 == 3, F.concat(F.lit("/b/data/HG"), F.lpad((d % 100).cast("string"), 5, "0"), F.lit("/e/x.bam"))
    ).otherwise(F.concat(F.lit("/n/sub-"), F.col("lang"), F.lit("/x.nwb")))
    f = X.files(spark, sf).select(F.explode(P.instance_buckets(kind)).alias("bucket"), "bytes")
    return f.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def merged_prior(spark, sf):
    """One prior over many tasks: the files of the documents' sources."""
    d = X.table(spark, sf, "documents")
    tasks = d.where("lang = 'en'").select(F.concat("source", F.lit("-a")).alias("task"))
    files = d.select(
        F.concat("source", F.lit("-a")).alias("task"),
        F.when(F.col("lang") == "en", "train.csv").when(F.col("lang") == "de", "test.csv").otherwise("notes.csv").alias("name")
    )
    return P.merged_prior(tasks, files, "/data")


def command_paths(spark, sf):
    c = X.talk(spark, sf).select("session_id", F.concat(F.lit("cat "), "text").alias("cmd"))
    return P.command_paths(c, X.prior(spark, sf), [("/data/src1/", "/cold/a/"), ("/data/src", "/cold/b")])


# ---- detection

#: (variant, ord, name, pattern, bucket): the hand rules, those without tool results, and rules frozen for another workload.
VARIANTS = [
    *(("hand", *r[:4]) for r in X.RULES),
    *(("no_listing", *r[:4]) for r in X.RULES),
    ("frozen", 0, "first_inspect", "(?i)(the|le).{0,30}one", "first_file"),
    ("frozen", 1, "lang_es", "(?i)ci.{1,3}n{0,1}", "lang_es"),
    ("frozen", 2, "source_src3", "(?i)th{1,2}e", "source_src3"),
]


def rule_variants(spark):
    return spark.createDataFrame(VARIANTS, "variant string, ord int, rule string, pattern string, target_key string")


def variant_recall(spark, sf):
    """Byte recall of the files that each variant finds in a session, by bench: medians and sessions where nothing was found.

    All variants are matched in one pass; sessions with the same mix of rules share one score.
    """
    v = rule_variants(spark)
    rules = v.select(
        "ord", F.concat_ws("|", "variant", "rule").alias("name"), "pattern", F.array("target_key").alias("target_keys")
    )
    hit = M.matches(X.blocks(spark, sf), rules).withColumn("variant", F.substring_index("name", "|", 1))
    hit = hit.where("variant <> 'no_listing' OR type <> 'tool_result'")
    mix = hit.groupBy("session_id", "variant").agg(F.sort_array(F.collect_set(F.col("target_keys")[0])).alias("mix"))
    found = mix.select("mix").distinct().select("mix", F.explode("mix").alias("bucket")).join(X.prior(spark, sf), "bucket").select("mix", "path", "bytes").distinct()
    score = S.byte_score(found, X.truth(spark, sf), ["mix"]).select("mix", "byte_recall")
    every = X.blocks(spark, sf).select("session_id").distinct().select(
        "session_id", F.explode(F.array(*[F.lit(x) for x in ("hand", "no_listing", "frozen")])).alias("variant")
    )
    s = every.join(mix, ["session_id", "variant"], "left").join(score, "mix", "left").select(
        "variant", (F.col("session_id") % 3).alias("bench"), F.coalesce("byte_recall", F.lit(0.0)).alias("byte_recall")
    )
    return R.variant_report(s, ["bench"]).select("variant", "bench", "n", "no_detection", *_r(("median_recall",)))


def brace_matches(spark, sf):
    """Blocks that rules with optional and repeated characters match."""
    v = rule_variants(spark).where("variant = 'frozen'").select(
        "ord", F.col("rule").alias("name"), "pattern", F.array("target_key").alias("target_keys")
    )
    return M.matches(X.blocks(spark, sf), v).groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("match_start").alias("starts")
    )


def semantic_lift(spark, sf):
    """Tier-1 recall of each session less the recall of files named in it: quartiles by upper position."""
    truth = X.truth(spark, sf)
    t1 = S.byte_score(M.tier_files(D.fired(spark, sf), D.sizes(spark, sf), X.prior(spark, sf), 1), truth, ["session_id"])
    hot = S.byte_score(D.hot_files(spark, sf), truth, ["session_id"])
    lift = staged(R.lift(t1, hot, ["session_id"]).select("lift"), "lift")  # read by several jobs
    n = lift.agg(F.count(F.lit(1)).alias("n"))
    q = T.position_percentiles(
        lift, [], "lift", {"p25": ("quarter", 0.25), "median": ("upper_median", 0.5), "p75": ("quarter", 0.75)}
    )
    return n.crossJoin(q).select("n", *_r(("p25", "median", "p75")))


# ---- choices


def used_bytes(spark, sf):
    """Bytes and files below a hot root, and how many of the needed files are staged there."""
    f = X.files(spark, sf)
    hot = f.where("lang IN ('en', 'de')").select(P.mirror("/hot", F.col("path")).alias("path"), "bytes")
    s = N.staged_paths(X.truth(spark, sf), hot, ["/hot", "/warm"]).agg(
        F.count(F.lit(1)).alias("needed"), F.count(F.when(F.col("staged"), 1)).alias("staged")
    )
    return hot.where(P.under_root(F.col("path"), F.lit("/hot"))).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes")
    ).crossJoin(s)


def smallest_trees(spark, sf):
    """The source with the shortest tree of each of the first languages: a tree has a line for each line of its document."""
    d = X.table(spark, sf, "documents").select("lang", F.col("doc_id").alias("task"), F.coalesce("text", F.lit("")).alias("tree"))
    return N.smallest_trees(d, "lang", "task", "tree").select("lang", "task", F.col("n_lines").cast("long").alias("n_lines"))


def target_choice(spark, sf):
    """The file to measure of each session: of its opens, of those that exist, else of what was staged."""
    e = X.table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), "event_type",
        F.concat(F.lit("doc_"), F.get_json_object("props", "$.k")).alias("path")
    )
    inv = X.table(spark, sf, "documents").where("lang = 'en'").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path")
    )
    staged = e.where("event_type IN ('view', 'error')").withColumn(
        "outcome", F.when(F.col("event_type") == "view", "staged").otherwise("error")
    )
    return N.target_choice(e.where("event_type = 'signup'"), staged, inv)


def first_samples(spark, sf):
    """The first forty files of tier 1, then of tier 3, over all rules that fire."""
    f = D.rule_files(spark, sf).join(D.sizes(spark, sf).select("name", "tier"), "name").select("path", "tier")
    return N.first_samples(f, 40)


QUERIES = {
    f.__name__: f for f in (
        share_medians, slack_metrics, slack_cells, io_counters, pathfulness, compliance_report, real_run_means, rep_medians,
        campaign_runs, mount_classes, name_buckets, instance_buckets, merged_prior, command_paths, variant_recall, brace_matches,
        semantic_lift, used_bytes, smallest_trees, target_choice, first_samples
    )
}

_WALL = session_queries.SQL["wall_split"]
_MED = ", ".join(f"round(quantile_cont({c}, 0.5), 3) as {c}" for c in _SHARES)
_SLACK = f"""(with s as ({session_queries._SPLIT}), d as (select session_id, turn // 3 as turn, cast(duration_s * 1000 as decimal(18,0)) as t from fx_turns), k as (select session_id, cast(sum(m) / 1000 as double) as st from (select session_id, turn, max(t) - min(t) as m from d group by session_id, turn) group by session_id),
  w as ({session_queries.SQL['prefetch_window']})
  select s.session_id, cast(s.total_s as double) as total_s, cast(s.shell_s as double) as shell_s, k.st as streaming_s, k.st / cast(s.total_s as double) as slack_frac, w.window_s from s join k on k.session_id = s.session_id left join w on w.session_id = s.session_id)"""
_VAR = ", ".join(str(v) for v in VARIANTS)
_COMP = session_queries.SQL["path_compliance"]
_NAMED = """(select session_id, path, bool_or(a) as a from (select session_id, text, regexp_replace(ltrim(m, '/'), '[.,;:\\-/]+$', '') as path, contains(text, concat('/', regexp_replace(ltrim(m, '/'), '[.,;:\\-/]+$', ''))) as a
  from (select session_id, text, unnest(list_concat(regexp_extract_all(text, '/data/[A-Za-z0-9_./\\-]+'), regexp_extract_all(text, '(?:^|[^A-Za-z0-9_/])(data/[A-Za-z0-9_./\\-]+)', 1))) as m from fx_talk where type = 'thinking')) where regexp_matches(path, '\\.[A-Za-z0-9]{1,6}$') group by session_id, path)"""

SQL = {
    "share_medians": f"""with w as ({_WALL}), s as (select *, session_id % 4 as bench, case when session_id % 2 = 0 then 'baseline' else 'staged' end as mode, (tool_s + other_s) / total_s * 100 as tool_exec_pct, stream_s / total_s * 100 as reasoning_pct, comm_s / total_s * 100 as comm_pct, harness_s / total_s * 100 as harness_pct from w)
      select bench, mode, count(*) as n_sessions, {_MED} from s group by bench, mode""",
    "slack_metrics": f"select session_id, round(streaming_s, 4) as streaming_s, round(slack_frac, 4) as slack_frac, round(window_s, 4) as window_s from {_SLACK}",
    "slack_cells": f"select session_id % 10 as task, case when session_id % 2 = 0 then 'baseline' else 'staged' end as mode, count(*) as n, {', '.join(f'round(quantile_cont({c}, 0.5), 3) as med_{c}' for c in ('total_s', 'shell_s', 'streaming_s', 'window_s', 'slack_frac'))} from {_SLACK} group by 1, 2",
    "io_counters": "select session_id, cast(sum(floor(duration_s * 1000)) as bigint) as rchar, cast(coalesce(sum(floor(duration_s * 1000) * 4) filter (duration_s >= 20), 0) as bigint) as read_bytes, cast(0 as bigint) as wchar, count(*) as n_shell_calls, cast(sum(cast(duration_s as decimal(18,2))) as double) as shell_elapsed_total_s from fx_turns where tool_name = 'run_shell_command' group by session_id",
    "pathfulness": f"""with n as (select session_id, count(*) as c, count(*) filter (a) as b from {_NAMED} group by session_id), r as (select s.session_id % 3 as bench, coalesce(n.c, 0) as c, coalesce(n.b, 0) as b from (select distinct session_id from fx_talk) s left join n on n.session_id = s.session_id),
      o as (select *, row_number() over (partition by bench order by c) - 1 as i, count(*) over (partition by bench) as k from r)
      select bench, count(*) as n_runs, count(*) filter (c = 0) as zero_complete, count(*) filter (b = 0) as zero_abs, max(c) as most, max(c) filter (i = k // 2) as median from o group by bench""",
    "compliance_report": f"""with p as ({_COMP}), r as (select concat('m', cast(session_id % 3 as varchar)) as model, * from p union all select 'all', * from p), o as (select *, row_number() over (partition by model, compliance is null order by compliance) - 1 as i, count(compliance) over (partition by model) as k from r)
      select model, count(*) as n_runs, count(compliance) as n_with_access, cast(sum(n_named) as bigint) as total_named, count(*) filter (n_named = 0) as zero_named, max(compliance) filter (compliance is not null and i = k // 2) as median_compliance from o group by model""",
    "real_run_means": """with t as (select l_orderkey as k, count(*) * 10.0::double as j, cast(sum(l_linenumber * 0.5) as double) as p from lineitem group by 1), r as (select o_orderpriority as workload, j, p, p / j as f from t join orders on o_orderkey = k where o_orderstatus in ('F', 'O'))
      select workload, count(*) as n_runs, round(avg(j), 3) as mean_job_time, round(avg(f), 3) as mean_io_frac, round(avg(1 / greatest(1e-9, 1 - f)), 3) as mean_elim_speedup, round(avg((j - p + p * (754.5 / 35.0)) / greatest(1e-9, j - p)), 3) as mean_far_speedup from r group by workload""",
    "rep_medians": """with r as (select o_custkey % 80 as task, case when o_orderkey % 3 = 0 then 'b' else 's' end as side, cast(o_totalprice as double) as v from orders where o_orderstatus <> 'P'), o as (select *, row_number() over (partition by task, side order by v) - 1 as i, count(*) over (partition by task, side) as n from r),
      m as (select task, max(v) filter (side = 'b' and i = n // 2) as base, max(v) filter (side = 's' and i = n // 2) as other from o group by task) select task, base, other, round(base / other, 3) as speedup, round(base - other, 3) as saved from m""",
    "campaign_runs": """with r as (select concat(o_orderpriority, '/', cast(o_custkey % 7 as varchar)) as task, ['Haiku', 'Sonnet', 'Flash', 'Qwen', 'x'][o_orderkey % 5 + 1] as label, case when o_orderstatus = 'F' and o_orderpriority = '5-LOW' then 'pathful' else 'baseline' end as prompt from orders where o_custkey % 11 <> 0 and o_orderstatus <> 'P' and o_totalprice > 1000)
      select case when task like '1-%' then 'first' when task like '4-%' or task like '%MEDIUM%' then 'middle' else 'rest' end as bench, label, prompt, count(*) as n from r where task not in ('2-HIGH/3', '5-LOW/6') and label in ('Haiku', 'Sonnet') group by 1, 2, 3""",
    "mount_classes": """with s as (select s_suppkey, ['tmpfs', 'nfs4', 'fuse.s3fs', 'ext4', 'xfs', 'proc', 'overlay'][s_suppkey % 7 + 1] as fs, s_nationkey % 5 as d, s_nationkey % 3 as r from supplier)
      select s_suppkey, fs, case fs when 'tmpfs' then 'memory' when 'nfs4' then 'network' when 'fuse.s3fs' then 'object' else case when d = 4 or r = 2 then 'unknown' when r = 0 then 'hdd' when d = 0 then 'nvme' else 'ssd' end end as class from s where fs not in ('proc', 'overlay')""",
    "name_buckets": """with n as (select lang, source, bytes, case when doc_id % 9 < 3 then ['train', 'test', 'submission'][doc_id % 9 % 3 + 1] when doc_id % 9 < 6 then concat(lang, '.', cast(bytes % 50 as varchar)) else concat(lang, '-', cast(bytes % 50 as varchar)) end as stem, ['.md', '.py', '.csv', '.png'][doc_id % 4 + 1] as ending from fx_files)
      select case when ending in ('.md', '.py') then case when lang = 'en' and source = 'src1' then 'english_first' when lang = 'en' then 'english' when lang = 'de' then 'german' end end as code, case when ending = '.csv' then case stem when 'train' then 'train_csv' when 'test' then 'test_csv' when 'submission' then 'output_submission' end end as role,
      case when ending = '.csv' then concat('csv_', replace(replace(stem, '-', '_'), '.', '_')) end as csv, case when stem like 'en.%' then 'class_english' when stem like 'fr.%' then 'class_french' end as class, count(*) as n, cast(sum(bytes) as bigint) as bytes from n group by 1, 2, 3, 4""",
    "instance_buckets": """with b as (select unnest(case doc_id % 5 when 0 then [concat('band_0', cast(8 + doc_id % 2 as varchar)), concat('day_', lpad(cast(doc_id % 366 as varchar), 3, '0'))] when 1 then [concat('month_2024-', lpad(cast(doc_id % 12 + 1 as varchar), 2, '0'))] when 2 then [concat('detector_nrca', cast(doc_id % 4 + 1 as varchar))] when 3 then [concat('sample_HG', lpad(cast(doc_id % 100 as varchar), 5, '0'))] else [concat('subject_sub-', lang)] end) as bucket, bytes from fx_files)
      select bucket, count(*) as n, cast(sum(bytes) as bigint) as bytes from b group by bucket""",
    "merged_prior": """with t as (select distinct source from documents where lang = 'en'), f as (select distinct source, case lang when 'en' then 'train' else 'test' end as k from documents where lang in ('en', 'de') and source in (select source from t)), p as (select source, k, concat('/data/', source, '-a/', k, '.csv') as path from f)
      select concat(k, '_', source, '_a') as bucket, path from p union select 'all_files', path from p""",
    "command_paths": r"""with m as (select distinct session_id, rtrim(unnest(regexp_extract_all(text, '/data/[A-Za-z0-9_./\-]+')), '.,;:''")') as path from fx_talk)
      select session_id, path, case when starts_with(path, '/data/src1/') then concat('/cold/a/', substr(path, 12)) when starts_with(path, '/data/src') then concat('/cold/b', substr(path, 10)) else path end as real from m where path in (select path from fx_files)""",
    "variant_recall": f"""with v as (select * from (values {_VAR}) as v(variant, ord, rule, pattern, target)), f as (select distinct b.session_id, v.variant, v.target from fx_blocks b join v on b.type in ('thinking', 'text', 'tool_result') and (v.variant <> 'no_listing' or b.type <> 'tool_result') and regexp_matches(b.text, '(?i)' || v.pattern)),
      g as (select distinct f.session_id, f.variant, p.path, p.bytes from f join fx_prior p on p.bucket = f.target), tot as (select sum(bytes) as b from fx_truth), s as (select g.session_id, g.variant, sum(t.bytes) as hit from g left join fx_truth t on t.path = g.path group by 1, 2),
      a as (select e.session_id, x.variant, coalesce(s.hit, 0) / tot.b as r from (select distinct session_id from fx_blocks) e cross join (select distinct variant from v) x cross join tot left join s on s.session_id = e.session_id and s.variant = x.variant)
      select variant, session_id % 3 as bench, count(*) as n, count(*) filter (r = 0) as no_detection, round(quantile_cont(r, 0.5), 4) as median_recall from a group by 1, 2""",
    "brace_matches": f"""with v as (select * from (values {_VAR}) as v(variant, ord, rule, pattern, target) where variant = 'frozen'), m as (select v.rule, length(regexp_extract(b.text, '(?s)^(.*?)(?-s:(?i)' || v.pattern || ')', 1)) as s from fx_blocks b join v on b.type in ('thinking', 'text', 'tool_result') and regexp_matches(b.text, '(?i)' || v.pattern))
      select rule as name, count(*) as n, cast(sum(s) as bigint) as starts from m group by rule""",
    "semantic_lift": """with tot as (select sum(bytes) as b from fx_truth), a as (select p.session_id, coalesce(sum(t.bytes), 0) / max(tot.b) as r from (select distinct session_id, path from fx_tier where tier = 1) p cross join tot left join fx_truth t on t.path = p.path group by 1),
      h as (select p.session_id, coalesce(sum(t.bytes), 0) / max(tot.b) as r from fx_hot p cross join tot left join fx_truth t on t.path = p.path group by 1), l as (select a.r - h.r as x from a join h on h.session_id = a.session_id), o as (select x, row_number() over (order by x) - 1 as i, count(*) over () as n from l)
      select count(*) as n, round(max(x) filter (i = n // 4), 4) as p25, round(max(x) filter (i = n // 2), 4) as median, round(max(x) filter (i = 3 * n // 4), 4) as p75 from o""",
    "used_bytes": "with h as (select path, bytes from fx_files where lang in ('en', 'de')) select (select count(*) from h) as n_files, (select cast(sum(bytes) as bigint) from h) as bytes, (select count(*) from fx_truth) as needed, (select count(*) from fx_truth where path in (select path from h)) as staged",
    "smallest_trees": "with k as (select lang, doc_id as task, len(string_split(coalesce(text, ''), chr(10))) - case when coalesce(text, '') = '' or ends_with(text, chr(10)) then 1 else 0 end as n_lines from documents) select lang, task, n_lines from k qualify row_number() over (partition by lang order by n_lines, task) = 1 order by lang limit 3",
    "target_choice": """with e as (select user_id as session_id, event_id as seq, event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events), o as (select session_id, case when event_type = 'signup' then 0 else 1 end as r, seq, k from e where event_type in ('signup', 'view') and k in (select doc_id from documents where lang = 'en'))
      select session_id, concat('doc_', cast(k as varchar)) as path, case when r = 0 then 'tool' else 'staged' end as source from o qualify row_number() over (partition by session_id order by r, seq) = 1""",
    "first_samples": "with s as (select name, count(distinct path) as n from fx_hit group by name), t as (select name, case when n <= 20 then 1 when n <= 200 then 2 else 3 end as tier from s), f as (select h.path, min(t.tier) as tier from fx_hit h join t on t.name = h.name where t.tier in (1, 3) group by h.path) select path, cast(tier as integer) as tier from f order by tier, path limit 40",
}
