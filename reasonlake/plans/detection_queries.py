"""Rule firing, tiers and scores over the session views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import scoring as S
from . import fixtures as X


def fired(spark, sf):
    return M.first_fire(M.matches(X.blocks(spark, sf), X.rules(spark)))


def sizes(spark, sf):
    return M.target_sizes(X.rules(spark), X.prior(spark, sf))


def rule_files(spark, sf):
    """(name, path, bytes): files of the rules that fire in any session."""
    names = fired(spark, sf).select("name", F.explode("target_keys").alias("bucket")).distinct()
    return names.join(X.prior(spark, sf), "bucket").select("name", "path", "bytes").distinct()


def _scores(s, *keys):
    names = ["n_detected", "n_ground_truth", "n_overlap", "bytes_detected", "bytes_ground_truth", "bytes_overlap"]
    return s.select(
        *keys, *names, *[F.round(c, 4).alias(c) for c in ("byte_recall", "byte_overfetch", "file_recall", "file_precision")]
    )


def tier1_byte_score(spark, sf):
    t1 = M.tier_files(fired(spark, sf), sizes(spark, sf), X.prior(spark, sf), 1)
    return _scores(S.byte_score(t1, X.truth(spark, sf), ["session_id"]), "session_id")


def layers(spark, sf):
    """(layer, path, bytes): cumulative tiers over all sessions, files named in texts, and everything."""
    low = rule_files(spark, sf).join(
        sizes(spark, sf).select("name", "tier"), "name"
    ).groupBy("path", "bytes").agg(F.min("tier").alias("tier"))
    t = low.select(
        "path", "bytes", F.explode(F.sequence("tier", F.lit(3))).alias("layer")
    ).withColumn("layer", F.concat(F.lit("tier_"), F.col("layer").cast("string")))
    hot = hot_files(spark, sf).select("path", "bytes").distinct().withColumn("layer", F.lit("hot"))
    return t.select("layer", "path", "bytes").unionByName(hot).unionByName(
        X.files(spark, sf).select(F.lit("naive").alias("layer"), "path", "bytes").distinct()
    )


def hot_files(spark, sf):
    """(session_id, path, bytes): files that a session's text names."""
    named = S.literal_scan(X.talk(spark, sf), X.prior(spark, sf).where("bucket = 'all_files'"))
    return named.select("session_id", "path").join(X.files(spark, sf).select("path", "bytes"), "path")


def score_grid(spark, sf):
    both, full = layers(spark, sf), X.truth(spark, sf)
    first = full.join(X.prior(spark, sf).where("bucket = 'source_src1'").select("path"), "path", "left_semi")
    both = S.byte_scores(both, {"full": full, "src1": first}, ["layer"]).withColumnRenamed("truth", "flavour")
    return _scores(both, "layer", "flavour")


def rule_first_fire(spark, sf):
    return fired(spark, sf).select(
        "session_id", "name", "block_seq", "turn", F.col("type").alias("source"), "match_start",
        F.round(M.fired_at(F.col("t_first"), F.col("t_stop"), F.col("match_start"), F.length("text")), 4).alias("fired_at_ms")
    )


def rule_first_fire_transcript(spark, sf):
    f = M.first_fire(M.transcript_matches(X.blocks(spark, sf), X.rules(spark)))
    return f.select(
        "session_id", "name", "block_seq", F.col("match_start").cast("long").alias("char_offset"),
        F.col("char_base").cast("long").alias("char_base")
    )


def rule_prefix_fire(spark, sf):
    """Firing with thinking tested at every character. Java and Python dialects agree on these patterns."""
    return M.prefix_fire(X.blocks(spark, sf), X.rules(spark))


def generated_rule_fires(spark, sf):
    """First firings in talk of thousands of rules: one for the name of each document, and one for each pair of a language and a last digit."""
    d = X.files(spark, sf)
    own = d.select(
        (F.col("doc_id") + 1000).cast("int").alias("ord"), F.concat(F.lit("doc_"), "doc_id").alias("name"),
        F.concat(F.lit("doc_"), "doc_id", F.lit("[.](?:txt|csv)")).alias("pattern"), F.array(F.concat(F.lit("lang_"), "lang")).alias("target_keys")
    )
    groups = d.select("lang", (F.col("doc_id") % 10).alias("digit")).distinct().select(
        F.col("digit").cast("int").alias("ord"), F.concat("lang", F.lit("_"), "digit").alias("name"),
        F.concat(F.lit("/"), "lang", F.lit("/doc_[0-9]*"), "digit", F.lit("[.]txt")).alias("pattern"), F.array(F.concat(F.lit("lang_"), "lang")).alias("target_keys")
    )
    return M.first_fire(M.matches(X.talk(spark, sf), own.unionByName(groups))).select("session_id", "name", "block_seq", "match_start")


def activation_summary(spark, sf):
    of = lambda k: F.count(F.when(F.col("type") == k, 1))
    g = fired(spark, sf).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), of("thinking").alias("n_thinking"), of("text").alias("n_text"),
        of("tool_result").alias("n_tool_result"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("turn", "name"))), lambda x: x.turn.cast("string")), ","
        ).alias("turns"),
        F.array_join(F.sort_array(F.collect_set("name")), ",").alias("names")
    )
    return g


def tier_cumulative_files(spark, sf):
    f, z = fired(spark, sf), sizes(spark, sf)
    of = M.mixes(f, z)
    upto = lambda k: F.count(F.when(F.col("tier") <= k, 1))
    n = M.mix_files(of, X.prior(spark, sf)).groupBy("mix").agg(
        upto(1).alias("n_tier_1"), upto(2).alias("n_tier_2"), upto(3).alias("n_tier_3")
    )
    return of.join(n, "mix").join(M.tier_times(f, z), "session_id").select(
        "session_id", "n_tier_1", "n_tier_2", "n_tier_3", "t_tier_1", "t_tier_3"
    )


def live_tiers(spark, sf):
    """The live preset: fired files with repeats, bounds 10 and 200."""
    f = fired(spark, sf).select("session_id", "name", F.explode("target_keys").alias("bucket"))
    size = X.prior(spark, sf).groupBy("bucket").agg(F.count("path").alias("n"))
    from ..functions.labels import LIVE, tier

    g = f.join(size, "bucket").groupBy("session_id", "name").agg(F.sum("n").alias("n")).withColumn("tier", tier(F.col("n"), LIVE))
    return g.groupBy("name", "tier").agg(
        F.count(F.lit(1)).alias("sessions"), F.max("n").alias("files")
    ).withColumn("dispatch", F.col("tier") == 1)


def naive_overfetch(spark, sf):
    naive = X.files(spark, sf).select("path", "bytes").distinct().withColumn("layer", F.lit("naive"))
    return _scores(S.byte_score(naive, X.truth(spark, sf), ["layer"]), "layer")


def subset_metrics(spark, sf):
    """Each rule's files against what is needed and against what any session opened."""
    hit, out = rule_files(spark, sf), None
    for name, truth in (("needed", X.truth(spark, sf)), ("opened", _opens(spark, sf))):
        m = S.shared_metrics(hit, truth, ["name"]).select(
            F.lit(name).alias("truth"), "name", "hits", "predicted_size", "gt_size",
            *[F.round(c, 4).alias(c) for c in ("precision", "recall", "jaccard")]
        )
        out = m if out is None else out.unionByName(m)
    return out


def _opens(spark, sf):
    """Files that a session opened: props holds the document's number."""
    e = X.table(spark, sf, "events").where("event_type in ('click', 'signup')").select(
        F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("long").alias("doc_id"), "ts"
    )
    return e.join(X.files(spark, sf), "doc_id").select("session_id", "path", "bytes", "ts", "source")


_OPENS_SQL = "select e.user_id as session_id, f.path, f.bytes, e.ts, f.source from events e join fx_files f on f.doc_id = cast(json_extract_string(e.props, '$.k') as bigint) where e.event_type in ('click', 'signup')"


def falsepos_report(spark, sf):
    opened = _opens(spark, sf).select("session_id", "path", "bytes").distinct()
    pre = X.table(spark, sf, "events").where("event_type = 'view'").select(
        F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").cast("long").alias("doc_id")
    ).join(X.files(spark, sf), "doc_id").select("session_id", "path", "bytes").distinct()
    out = S.falsepos(S.overlap(pre, opened, ["session_id"]), ["session_id"])
    kept = [c for c in out.columns if c != "session_id"]
    return out.select(
        "session_id",
        *[F.round(c, 4).alias(c) if t == "double" else F.col(c).cast("long").alias(c) for c, t in out.dtypes if c in kept]
    )


def _loo(spark, sf):
    return S.leave_one_out(rule_files(spark, sf), X.rules(spark), X.truth(spark, sf))


def loo_rules(spark, sf):
    return _loo(spark, sf).select(
        "dropped", F.col("hits").cast("long").alias("hits"), F.round("recall", 4).alias("recall"),
        F.round("delta", 4).alias("delta"), "load_bearing"
    )


def loo_robustness(spark, sf):
    return S.robustness(_loo(spark, sf)).select(F.round("min_recall", 4).alias("min_recall"), "n_load_bearing", "robust")


def loo_top(spark, sf):
    """The five rules whose loss costs most."""
    return S.top_rules(_loo(spark, sf)).select(
        "dropped", F.round("recall", 4).alias("recall"), F.round("delta", 4).alias("delta")
    )


def rule_origin_counts(spark, sf):
    """Rules of each workload by origin: generated ones of its own, hand rules of its source and general ones, with and without those of one origin."""
    auto = _auto(spark, sf).select("workload", "origin", "name")
    hand = X.rules(spark).select("origin", "name", F.explode("target_keys").alias("key"))
    w = X.table(spark, sf, "documents").select(F.col("source").alias("workload"), F.explode(F.array(F.lit("first_file"), F.lit("all_files"), F.concat(F.lit("source_"), "source"), F.concat(F.lit("lang_"), "lang"))).alias("key")).distinct()
    own = auto.unionByName(w.join(F.broadcast(hand), "key").select("workload", "origin", "name"))
    every = M.filter_origin(own, ["fx"]).withColumn("variant", F.lit("without fx")).unionByName(own.withColumn("variant", F.lit("all")))
    return every.groupBy("workload", "variant", "origin").agg(F.count(F.lit(1)).alias("n"))


def rule_fingerprint(spark, sf):
    """Fingerprint of the rules generated for the sources."""
    return M.fingerprint(_auto(spark, sf), ("workload",))


def rule_library_fingerprint(spark, sf):
    """One fingerprint over the rules of all sources."""
    return M.library_fingerprint(_auto(spark, sf)).select("fingerprint", F.col("n_workloads").cast("long").alias("n_workloads"), F.col("n_rules").cast("long").alias("n_rules"))


def _workload_blocks(spark, sf):
    """Conversations dealt to workloads, with texts that name days, bands and a subject."""
    c, turn = F.col("session_id"), F.col("block_seq")
    day = (c * 7 + turn * 5) % 40
    text = F.concat(
        F.col("text"), F.lit(" look at day "), day.cast("string"), F.lit(" and band 0"), (turn % 8).cast("string"), F.lit(", then /"),
        F.lpad(((day + 3) % 40).cast("string"), 3, "0"), F.lit("/ of subject sub-enx.")
    )
    return X.blocks(spark, sf).select("session_id", "block_seq", "type", text.alias("text"), F.concat(F.lit("src"), (c % 30).cast("string")).alias("workload"))


def workload_scores(spark, sf):
    """All workloads at once: the rules of each over its own sessions, and the files they point to against what is needed."""
    fired = M.matches(_workload_blocks(spark, sf), _auto(spark, sf), workload="workload")
    hit = fired.select("workload", "name", F.explode("target_keys").alias("bucket")).distinct()
    d = X.table(spark, sf, "documents").select(
        F.col("source").alias("workload"), "doc_id", F.explode(_bucket_names()).alias("bucket"), X.doc_path().alias("path"), F.col("n_chars").alias("bytes")
    )
    predicted = hit.select("workload", "bucket").distinct().join(d, ["workload", "bucket"]).select("workload", "path", "bytes").distinct()
    good = X.table(spark, sf, "labels").where("quality = 1").select("doc_id")
    truth = d.join(good, "doc_id", "left_semi").select("workload", "path", "bytes").distinct()
    both = S.overlap(predicted, truth, ["workload"])
    scores = both.groupBy("workload").agg(
        F.sum("in_p").cast("long").alias("n_detected"), F.sum("in_t").cast("long").alias("n_needed"), F.sum(F.col("in_p") * F.col("in_t")).cast("long").alias("n_hits")
    )
    n = hit.groupBy("workload").agg(F.count_distinct("name").alias("n_rules"))
    return scores.join(n, "workload", "left").select("workload", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "n_detected", "n_needed", "n_hits")


_TASK = "concat('Read every csv and NetCDF file of ', source, ' and write result/report.md and out/', source, '_table.csv')"


def auto_rules(spark, sf):
    return _auto(spark, sf).select(
        "workload", "ord", "name", "pattern", F.array_join("target_keys", ",").alias("targets"), "origin"
    )


def _bucket_names():
    """Buckets of a document: a day and a band by its number, its language, and aggregates."""
    return F.array(
        F.concat(F.lit("day_"), F.lpad((F.col("doc_id") % 40).cast("string"), 3, "0")),
        F.concat(F.lit("band_0"), (F.col("doc_id") % 8).cast("string")),
        F.concat(F.lit("subject_sub-"), F.col("lang"), F.lit("x")), F.lit("all_files"), F.lit("output_csv"), F.lit("output_png")
    )


def _auto(spark, sf):
    """Rules of a workload for each source: its buckets are days by document number, languages and aggregates."""
    d = X.table(spark, sf, "documents")
    w = d.select(F.col("source").alias("workload"), F.expr(_TASK).alias("task")).distinct()
    b = d.select(F.col("source").alias("workload"), F.explode(_bucket_names()).alias("bucket")).distinct()
    b = b.withColumn("pos", F.expr("row_number() over (partition by workload order by bucket)"))
    return M.auto_rules(w, b)


_AUTO_SQL = f"""
w as (select distinct source as workload, {_TASK} as task from documents),
b as (select distinct workload, unnest([concat('day_', lpad(cast(doc_id % 40 as varchar), 3, '0')), concat('band_0', cast(doc_id % 8 as varchar)), concat('subject_sub-', lang, 'x'), 'all_files', 'output_csv', 'output_png']) as bucket from (select source as workload, doc_id, lang from documents)),
n as (select *, row_number() over (partition by workload order by bucket) as pos, regexp_extract(bucket, '^(day|band|subject)_(.*)$', 1) as cls, regexp_extract(bucket, '^(day|band|subject)_(.*)$', 2) as inst from b),
r as (
  select workload, 0 as part, 0 as pos, 'first_inspect' as name, '(?:first|one|single|sample|representative).{{0,30}}(?:NetCDF|csv|file)|\\bstart with\\b|\\bbegin with\\b|inspect.{{0,20}}(?:one|a single|first)' as pattern, 'all_files' as targets from w
  union all select workload, 1, 0, 'all_signal', '(?:all|each|every).{{0,30}}(?:NetCDF|csv|file)|iterate.{{0,40}}(?:NetCDF|csv|file)|(?:the )?(?:entire|whole|complete) (?:dataset|workspace|corpus)', 'all_files' from w
  union all select workload, 2, pos, bucket, case
      when cls = 'day' then concat('\\bday', case when inst like '0%' then concat('[- _]?0?', coalesce(nullif(ltrim(inst, '0'), ''), '0')) else concat('[- _]?', inst) end, '\\b|\\b', inst, '\\b|/', inst, '/')
      when cls = 'band' then concat('\\bband[- _]?0?', coalesce(nullif(ltrim(inst, '0'), ''), '0'), '\\b|\\b', inst, '\\b')
      else concat('\\bsubject[- _]?sub\\-', substr(inst, 5), '\\b|\\b(?:sub\\-', substr(inst, 5), '|', substr(inst, 5), ')\\b') end, bucket from n where cls <> ''
  union all select workload, 3, pos, concat(bucket, '_signal'), case bucket when 'output_csv' then concat('out/', workload, '_table\\.csv') else '\\.png\\b' end, bucket from n where bucket like 'output_%'
  union all select workload, 4, 0, 'report_out', 'report\\.md|report markdown', '' from w),
a as (select workload, cast(row_number() over (partition by workload order by part, pos) - 1 as integer) as ord, name, pattern, targets, 'auto' as origin from r)
"""


#: Fingerprints over the rules as canonical JSON.
_PRINT_SQL = """j as (select workload, ord, to_json({'name': name, 'origin': origin, 'pattern': pattern, 'target_keys': case when targets = '' then [] else string_split(targets, ',') end}) as rule from a),
prints as (select workload, sha256(concat('[', string_agg(rule, ',' order by ord), ']')) as fingerprint, count(*) as n_rules from j group by workload)"""


def enrich_policies(spark, sf):
    """Listings are what a session viewed; policies keep all, the first three a session, one extension, or names that a
    list of good documents mentions.
    """
    name = F.concat(X.doc_path(), F.when(F.col("lang") == "en", ".csv").otherwise(""))
    docs = X.table(spark, sf, "documents").select("doc_id", name.alias("path"), F.col("n_chars").alias("bytes"))
    e = X.table(spark, sf, "events").select(
        "event_type", F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").cast("long").alias("doc_id")
    ).join(docs, "doc_id")
    listed = e.where("event_type = 'view'").select("session_id", "seq", "path", "bytes")
    opens = e.where("event_type in ('click', 'signup')").select("path")
    tokens = X.table(spark, sf, "labels").where("quality = 1").select(
        F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("token")
    )
    policies = {
        "all": lambda x: x, "cap_3": S.first_listed(3), "csv": S.with_extension(".csv"),
        "mentioned": lambda x: S.mentioned(x, tokens)
    }
    kept = S.apply_policies(listed, policies)
    out = S.evaluate_policy(kept, opens, ["policy"])
    return out.select(
        "policy", "kept_files", "kept_bytes", "agent_opens", "hits",
        *[F.round(c, 4).alias(c) for c in ("recall", "precision", "byte_overfetch_vs_hits")]
    )


def staged_before_open(spark, sf):
    """Was a document staged (seen in a view) by the time a session opened it?"""
    views = X.table(spark, sf, "events").where("event_type = 'view'").select(
        F.get_json_object("props", "$.k").cast("long").alias("doc_id"), F.col("ts").alias("t_completed")
    ).join(X.files(spark, sf), "doc_id").select("path", "t_completed")
    opens = _opens(spark, sf).select("session_id", "path", F.col("ts").alias("t_open"), "bytes", "source")
    s = S.staged_in_time(opens, views)
    return s.groupBy("source").agg(
        F.count(F.lit(1)).alias("opens"), F.count(F.when(F.col("hit"), 1)).alias("hits"), F.sum("bytes").alias("bytes"),
        F.sum(F.when(F.col("hit"), F.col("bytes")).otherwise(0)).alias("hot_bytes"),
        F.sum(F.when(F.col("hit"), F.col("bytes")).otherwise(F.col("bytes") * 20)).alias("read_us")
    )


def stage_report(spark, sf):
    s = S.stage_summary(X.stage_events(spark, sf), ["tier"])
    return s.select(
        "tier", "n_events", "n_staged", "n_hits", "n_errors", "n_skipped", "total_bytes_staged",
        F.col("p50").cast("double").alias("p50"), F.col("p95").cast("double").alias("p95"), "max_ms",
        F.round("mean_ms", 4).alias("mean_ms")
    )


def hit_files_by_family(spark, sf):
    """Recall of the literal layer and of tier 1, and their difference, by language (semantic lift)."""
    t1 = layers(spark, sf).where("layer = 'tier_1'").select("path").distinct()
    hot = hot_files(spark, sf).select("path").distinct()
    truth = X.truth(spark, sf).join(
        X.files(spark, sf).select("path", "lang"), "path"
    ).join(t1.withColumn("a", F.lit(1)), "path", "left").join(hot.withColumn("b", F.lit(1)), "path", "left")
    g = truth.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("tier_1"), F.count("b").alias("hot"))
    return g.withColumn("lift", F.round((F.col("tier_1") - F.col("hot")) / F.col("n"), 4))


QUERIES = {
    f.__name__: f for f in (
        tier1_byte_score, score_grid, rule_first_fire, rule_first_fire_transcript, rule_prefix_fire, generated_rule_fires, workload_scores, rule_library_fingerprint, activation_summary,
        tier_cumulative_files, live_tiers, naive_overfetch, subset_metrics, falsepos_report, loo_rules, loo_robustness, loo_top,
        rule_origin_counts, auto_rules, rule_fingerprint, enrich_policies, staged_before_open, stage_report, hit_files_by_family
    )
}

_SCORES = """count(*) as n_detected, max(tot.n) as n_ground_truth, count(t.path) as n_overlap, cast(sum(p.bytes) as bigint) as bytes_detected, cast(max(tot.b) as bigint) as bytes_ground_truth, cast(coalesce(sum(case when t.path is not null then p.bytes end), 0) as bigint) as bytes_overlap,
 round(coalesce(sum(case when t.path is not null then p.bytes end), 0) / max(tot.b), 4) as byte_recall, round(sum(p.bytes) / max(tot.b), 4) as byte_overfetch, round(count(t.path) / max(tot.n), 4) as file_recall, round(count(t.path) / count(*), 4) as file_precision"""

_LOO_SQL = "h as (select distinct h.name, h.path from fx_hit h join fx_truth t on t.path = h.path), n as (select count(*) as n from fx_truth), f as (select count(distinct path) as full_hits from h), k as (select r.name as dropped, (select count(distinct path) from h where h.name <> r.name) as hits from fx_rules r)"

SQL = {
    "tier1_byte_score": f"with tot as (select count(*) as n, sum(bytes) as b from fx_truth) select p.session_id, {_SCORES} from (select * from fx_tier where tier = 1) p left join fx_truth t on t.path = p.path cross join tot group by p.session_id",
    "score_grid": f"""with p as (select distinct concat('tier_', cast(l as varchar)) as layer, path, bytes from fx_tier, (values (1), (2), (3)) as v(l) where l >= tier union all select distinct 'hot', f.path, f.bytes from fx_hot h join fx_files f on f.path = h.path union all select 'naive', path, bytes from fx_files),
      truth1 as (select t.path, t.bytes from fx_truth t join fx_files f on f.path = t.path where f.source = 'src1')
      select 'full' as flavour, layer, {_SCORES} from p left join fx_truth t on t.path = p.path cross join (select count(*) as n, sum(bytes) as b from fx_truth) tot group by layer
      union all select 'src1', layer, {_SCORES} from p left join truth1 t on t.path = p.path cross join (select count(*) as n, sum(bytes) as b from truth1) tot group by layer""",
    "rule_first_fire": "select session_id, name, block_seq, turn, type as source, cast(match_start as integer) as match_start, round(t_first + (t_stop - t_first) * match_start / greatest(1, length(text)), 4) as fired_at_ms from fx_first",
    "rule_first_fire_transcript": r"""with s as (select *, coalesce(sum(length(text)) over (partition by session_id order by block_seq rows between unbounded preceding and 1 preceding), 0) as char_base, string_agg(text, '') over (partition by session_id order by block_seq rows between unbounded preceding and current row) as upto from fx_blocks where type in ('thinking', 'text', 'tool_result')),
      m as (select s.session_id, s.block_seq, s.char_base, r.name, r.ord, length(regexp_extract(upto, '(?s)^(.*?)(?-s:(?i)' || r.pattern || ')', 1)) as o from s join fx_rules r on regexp_matches(upto, '(?i)' || r.pattern))
      select session_id, name, block_seq, cast(o as bigint) as char_offset, cast(char_base as bigint) as char_base from m where o >= char_base qualify row_number() over (partition by session_id, name order by block_seq, o, ord) = 1""",
    "generated_rule_fires": r"""with d as (select distinct session_id, block_seq, text, unnest(list_distinct(regexp_extract_all(text, 'doc_([0-9]+)[.](?:txt|csv)', 1))) as k from fx_talk),
      own as (select session_id, concat('doc_', k) as name, block_seq, instr(text, concat('doc_', k, '.')) - 1 as match_start from d where k in (select cast(doc_id as varchar) from documents)),
      g as (select distinct lang, cast(doc_id % 10 as varchar) as digit from documents), far as (select session_id, concat(lang, '_', digit) as name, block_seq, length(regexp_extract(text, concat('(?s)^(.*?)(?:/', lang, '/doc_[0-9]*', digit, '[.]txt)'), 1)) as match_start from fx_talk join g on regexp_matches(text, concat('/', lang, '/doc_[0-9]*', digit, '[.]txt')))
      select * from (select * from own union all select * from far) qualify row_number() over (partition by session_id, name order by block_seq) = 1""",
    "rule_prefix_fire": r"""with s as (select *, coalesce(string_agg(text, '') over (partition by session_id order by block_seq rows between unbounded preceding and 1 preceding), '') as before from fx_blocks where type in ('thinking', 'text', 'tool_result') and text <> ''),
      e as (select session_id, block_seq, turn, type, before, text, unnest(case when type = 'thinking' then range(1, length(text) + 1) else [length(text)] end) as n from s),
      m as (select e.session_id, r.name, e.block_seq, e.turn, e.type, length(before) + n as k, length(before) as base, length(regexp_extract(before || left(text, n), '(?s)^(.*?)(?-s:(?i)' || r.pattern || ')', 1)) as o from e join fx_rules r on regexp_matches(before || left(text, n), '(?i)' || r.pattern))
      select session_id, name, block_seq, turn, type, cast(k as bigint) as first_known_at from m where type = 'thinking' or o >= base qualify row_number() over (partition by session_id, name order by block_seq, k) = 1""",
    "activation_summary": "select session_id, count(*) as n, count(*) filter (type = 'thinking') as n_thinking, count(*) filter (type = 'text') as n_text, count(*) filter (type = 'tool_result') as n_tool_result, string_agg(cast(turn as varchar), ',' order by turn, name) as turns, string_agg(name, ',' order by name) as names from fx_first group by session_id",
    "tier_cumulative_files": "with n as (select session_id, count(*) filter (tier <= 1) as n_tier_1, count(*) filter (tier <= 2) as n_tier_2, count(*) filter (tier <= 3) as n_tier_3 from fx_tier group by session_id), t as (select f.session_id, cast(min(f.t_first) filter (t.tier = 1) as double) as t_tier_1, cast(min(f.t_first) filter (t.tier = 3) as double) as t_tier_3 from fx_first f join fx_rule_tier t on t.session_id = f.session_id and t.name = f.name group by f.session_id) select n.*, t_tier_1, t_tier_3 from n join t using (session_id)",
    "live_tiers": "with s as (select bucket, count(*) as n from fx_prior group by bucket), g as (select f.session_id, f.name, sum(s.n) as n from fx_first f join s on s.bucket = f.target_key group by f.session_id, f.name), k as (select *, case when n <= 10 then 1 when n <= 200 then 2 else 3 end as tier from g) select name, tier, count(*) as sessions, cast(max(n) as bigint) as files, tier = 1 as dispatch from k group by name, tier",
    "naive_overfetch": f"select 'naive' as layer, {_SCORES} from fx_files p left join fx_truth t on t.path = p.path cross join (select count(*) as n, sum(bytes) as b from fx_truth) tot",
    "subset_metrics": """with p as (select distinct name, path from fx_hit), t as (select distinct 'needed' as truth, path from fx_truth union select distinct 'opened', path from fx_opens), z as (select truth, count(*) as n from t group by truth),
      m as (select z.truth, p.name, count(t.path) as hits, count(*) as predicted_size, max(z.n) as gt_size from p cross join z left join t on t.truth = z.truth and t.path = p.path group by z.truth, p.name)
      select *, round(hits / predicted_size, 4) as precision, round(hits / gt_size, 4) as recall, round(hits / (predicted_size + gt_size - hits), 4) as jaccard from m""",
    "falsepos_report": f"""with o as (select distinct session_id, path, bytes from ({_OPENS_SQL})),
      p as (select distinct e.user_id as session_id, f.path, f.bytes from events e join fx_files f on f.doc_id = cast(json_extract_string(e.props, '$.k') as bigint) where e.event_type = 'view'),
      u as (select coalesce(p.session_id, o.session_id) as session_id, coalesce(p.bytes, 0) as pb, coalesce(o.bytes, 0) as ob, p.path is not null as i, o.path is not null as j from p full join o on o.session_id = p.session_id and o.path = p.path),
      s as (select session_id, count(*) filter (i) as prefetched, count(*) filter (j) as opened, count(*) filter (i and j) as hits, count(*) filter (i and not j) as wasted, count(*) filter (j and not i) as missed, cast(sum(pb) as bigint) as prefetched_bytes, cast(sum(ob) as bigint) as opened_bytes, cast(coalesce(sum(pb) filter (i and j), 0) as bigint) as hit_bytes, cast(coalesce(sum(pb) filter (not j), 0) as bigint) as wasted_bytes, cast(coalesce(sum(ob) filter (not i), 0) as bigint) as missed_bytes from u group by session_id)
      select *, round(hits / nullif(prefetched, 0), 4) as precision_files, round(hits / nullif(opened, 0), 4) as recall_files, round(prefetched_bytes / nullif(opened_bytes, 0), 4) as byte_overfetch, round(hit_bytes / nullif(prefetched_bytes, 0), 4) as byte_precision, round(hit_bytes / nullif(opened_bytes, 0), 4) as byte_recall, round(hits / nullif(prefetched + opened - hits, 0), 4) as jaccard_files, round(hit_bytes / nullif(prefetched_bytes + opened_bytes - hit_bytes, 0), 4) as jaccard_bytes from s""",
    "loo_rules": f"with {_LOO_SQL} select dropped, hits, round(hits / n, 4) as recall, round((full_hits - hits) / n, 4) as delta, (full_hits - hits) / n >= 0.10 as load_bearing from k, n, f",
    "loo_robustness": f"with {_LOO_SQL} select round(min(hits / n), 4) as min_recall, count(*) filter ((full_hits - hits) / n >= 0.10) as n_load_bearing, min(hits / n) >= 0.80 as robust from k, n, f",
    "loo_top": f"with {_LOO_SQL} select dropped, round(hits / n, 4) as recall, round((full_hits - hits) / n, 4) as delta from k, n, f order by (full_hits - hits) / n desc, dropped limit 5",
    "rule_origin_counts": f"""with {_AUTO_SQL}, k as (select distinct source as workload, unnest(['first_file', 'all_files', concat('source_', source), concat('lang_', lang)]) as key from documents),
      o as (select workload, origin, name from a union all select k.workload, r.origin, r.name from k join fx_rules r on r.target_key = k.key)
      select workload, variant, origin, count(*) as n from (select *, 'all' as variant from o union all select *, 'without fx' from o where origin <> 'fx') group by 1, 2, 3""",
    "auto_rules": f"with {_AUTO_SQL} select * from a",
    "rule_fingerprint": f"with {_AUTO_SQL}, {_PRINT_SQL} select * from prints",
    "rule_library_fingerprint": f"with {_AUTO_SQL}, {_PRINT_SQL} select sha256(string_agg(concat(workload, ':', fingerprint), chr(10) order by workload)) as fingerprint, count(*) as n_workloads, cast(sum(n_rules) as bigint) as n_rules from prints",
    "workload_scores": f"""with {_AUTO_SQL}, t as (select concat('src', cast(session_id % 30 as varchar)) as workload, concat(text, ' look at day ', cast((session_id * 7 + block_seq * 5) % 40 as varchar), ' and band 0', cast(block_seq % 8 as varchar), ', then /', lpad(cast(((session_id * 7 + block_seq * 5) % 40 + 3) % 40 as varchar), 3, '0'), '/ of subject sub-enx.') as text from fx_blocks where type in ('thinking', 'text', 'tool_result') and text <> ''),
      h as (select distinct a.workload, a.name, a.targets as bucket from a join t on t.workload = a.workload and regexp_matches(t.text, '(?i)' || a.pattern) where a.targets <> ''),
      f as (select f.source as workload, f.doc_id, f.path, unnest([concat('day_', lpad(cast(f.doc_id % 40 as varchar), 3, '0')), concat('band_0', cast(f.doc_id % 8 as varchar)), concat('subject_sub-', f.lang, 'x'), 'all_files', 'output_csv', 'output_png']) as bucket from fx_files f),
      p as (select distinct f.workload, f.path from f join h on h.workload = f.workload and h.bucket = f.bucket), g as (select distinct f.workload, f.path from f join labels l on l.doc_id = f.doc_id where l.quality = 1),
      m as (select coalesce(p.workload, g.workload) as workload, p.path is not null as in_p, g.path is not null as in_t from p full join g on g.workload = p.workload and g.path = p.path)
      select m.workload, coalesce(max(k.n), 0) as n_rules, count(*) filter (in_p) as n_detected, count(*) filter (in_t) as n_needed, count(*) filter (in_p and in_t) as n_hits from m left join (select workload, count(distinct name) as n from h group by 1) k on k.workload = m.workload group by 1""",
    "enrich_policies": """with d as (select doc_id, concat(path, case when lang = 'en' then '.csv' else '' end) as path, bytes from fx_files),
      e as (select e.event_type, e.user_id as session_id, e.event_id as seq, d.path, d.bytes from events e join d on d.doc_id = cast(json_extract_string(e.props, '$.k') as bigint)),
      l as (select session_id, seq, path, bytes from e where event_type = 'view'), o as (select distinct path from e where event_type in ('click', 'signup')),
      m as (select distinct p.path from (select distinct path from l) p join labels x on x.quality = 1 and contains(lower(regexp_extract(p.path, '[^/]*$')), concat('doc_', cast(x.doc_id as varchar)))),
      a as (select 'all' as policy, * from l union all (select 'cap_3', * from l qualify row_number() over (partition by session_id order by seq) <= 3) union all select 'csv', * from l where path like '%.csv' union all select 'mentioned', l.* from l where path in (select path from m)),
      k as (select policy, path, max(bytes) as bytes from a group by policy, path)
      select policy, count(*) as kept_files, cast(sum(bytes) as bigint) as kept_bytes, (select count(*) from o) as agent_opens, count(o.path) as hits, round(count(o.path) / (select count(*) from o), 4) as recall, round(count(o.path) / count(*), 4) as precision, round(sum(bytes) / sum(case when o.path is not null then bytes end), 4) as byte_overfetch_vs_hits from k left join o on o.path = k.path group by policy""",
    "staged_before_open": f"""with o as ({_OPENS_SQL}), v as (select f.path, min(e.ts) as done from events e join fx_files f on f.doc_id = cast(json_extract_string(e.props, '$.k') as bigint) where e.event_type = 'view' group by f.path)
      select source, count(*) as opens, count(*) filter (done <= ts) as hits, cast(sum(bytes) as bigint) as bytes, cast(coalesce(sum(bytes) filter (done <= ts), 0) as bigint) as hot_bytes, cast(sum(case when done <= ts then bytes else bytes * 20 end) as bigint) as read_us from o left join v on v.path = o.path group by source""",
    "stage_report": "select tier, count(*) as n_events, count(*) filter (outcome = 'staged') as n_staged, count(*) filter (outcome = 'hit') as n_hits, count(*) filter (outcome = 'error') as n_errors, cast(0 as bigint) as n_skipped, cast(coalesce(sum(size_bytes) filter (outcome = 'staged'), 0) as bigint) as total_bytes_staged, cast(quantile_cont(fetch_ms, 0.5) filter (outcome = 'staged') as double) as p50, (select cast(s2.fetch_ms as double) from (select tier, fetch_ms, row_number() over (partition by tier order by fetch_ms) - 1 as i, count(*) over (partition by tier) as n from fx_stage_events where outcome = 'staged') s2 where s2.tier = e.tier and s2.i = cast(round_even(0.95 * (s2.n - 1), 0) as bigint)) as p95, max(fetch_ms) filter (outcome = 'staged') as max_ms, round(avg(fetch_ms) filter (outcome = 'staged'), 4) as mean_ms from fx_stage_events e group by tier",
    "hit_files_by_family": "with t as (select f.lang, f.path from fx_truth t join fx_files f on f.path = t.path) select lang, count(*) as n, count(*) filter (path in (select path from fx_tier where tier = 1)) as tier_1, count(*) filter (path in (select path from fx_hot)) as hot, round((count(*) filter (path in (select path from fx_tier where tier = 1)) - count(*) filter (path in (select path from fx_hot))) / count(*), 4) as lift from t group by lang",
}
