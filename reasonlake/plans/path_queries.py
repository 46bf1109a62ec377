"""Paths, buckets, prefixes, sources and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import paths as P
from ..operators import planning as N
from ..operators import scoring as S
from . import fixtures as X

PREFIXES = [("/data/src1/", "/cold/a/"), ("/data/src", "/cold/b")]
MOUNTS = [
    ("/", "disk", 9.0, 100.0), ("/data", "nfs", 5.0, 400.0), ("/data/src1", "ssd", 0.5, 900.0),
    ("/data/src1/en", "ram", 0.05, 4000.0), ("/data/src2", "s3", 80.0, 0.0)
]
_MOUNTS = "(values " + ", ".join(str(m) for m in MOUNTS) + ") as m(mount, kind, first_byte_ms, throughput)"


def mounts(spark):
    return spark.createDataFrame(MOUNTS, "mount string, kind string, first_byte_ms double, throughput double")


def prefix_map_resolve(spark, sf):
    f = X.files(spark, sf)
    p = F.col("path")
    return f.select(
        "path", P.resolve(p, PREFIXES).alias("real"),
        P.resolve_under(
            F.concat(F.lit("/data/x/"), F.col("doc_id").cast("string")), [("/data/x/", "/y/")], "/cold"
        ).alias("mapped"),
        P.resolve_under(p, [("/data/src1/en/", "/z/")], "/cold/").alias("under"), P.mirror("/hot/", p).alias("mirror"),
        P.is_output_path(p).alias("is_output"), P.under_root(p, F.lit("/data/src1")).alias("in_root")
    )


def path_parts(spark, sf):
    p = F.col("path")
    f = X.files(spark, sf).select(
        F.concat(
            "path", F.when(F.col("doc_id") % 3 == 0, ".gz").when(F.col("doc_id") % 7 == 0, "T120000.x").otherwise("")
        ).alias("path")
    )
    return f.select(
        "path", P.basename(p).alias("base"), P.stem(p).alias("stem"), P.short_stem(p).alias("short"),
        P.child_of(F.lit("/data/"), p).alias("child"), F.size(P.ancestors(p)).alias("depth")
    )


def longest_prefix_join(spark, sf):
    return S.longest_prefix(X.files(spark, sf).select("doc_id", "path"), mounts(spark)).select("doc_id", "path", "mount", "kind")


def stage_decision(spark, sf):
    f = S.longest_prefix(X.files(spark, sf).select("doc_id", "path", "bytes"), mounts(spark))
    cost = L.stage_cost_ms(F.col("first_byte_ms"), F.col("throughput"), F.col("bytes"))
    d = f.select("doc_id", "mount", cost.alias("cost"), (F.col("doc_id") % 10).cast("double").alias("slack"))
    return d.select(
        "doc_id", "mount", F.when(F.col("cost") != float("inf"), F.round("cost", 4)).alias("cost_ms"),
        L.stage_decision(F.col("mount"), F.lit("/data/src1/en"), F.col("cost"), F.col("slack")).alias("d")
    ).select("doc_id", "mount", "cost_ms", "d.stage", "d.reason")


def tier_roles(spark, sf):
    """Roles of the mounts, with the files and bytes that each holds."""
    f = S.longest_prefix(X.files(spark, sf).select("path", "bytes"), mounts(spark)).groupBy("mount").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes")
    )
    return N.tier_roles(mounts(spark).select("mount", "first_byte_ms")).join(f, "mount", "left").select(
        "mount", "role", "rank", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("bytes", F.lit(0)).alias("bytes")
    )


def source_resolution(spark, sf):
    f = X.files(spark, sf)
    ext = F.when(F.col("doc_id") % 4 == 0, ".gz").when(F.col("doc_id") % 4 == 1, ".xz").when(F.col("doc_id") % 4 == 2, "")
    inv = f.where("doc_id % 4 < 3").select(
        F.concat("path", ext).alias("path"), "bytes", (F.col("bytes") + (F.col("doc_id") % 8) * 100 - 200).alias("trailer")
    )
    return S.source_of(f.select("path"), inv)


def companion_files(spark, sf):
    f = X.files(spark, sf)
    base = F.regexp_replace("path", "txt$", "vcf.gz")
    prim = f.select(
        F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("path", "txt$", "bam")).otherwise(base).alias("path"), "doc_id"
    )
    inv = prim.select(
        F.when(F.col("doc_id") % 4 == 0, F.concat("path", F.lit(".bai"))).when(
            F.col("doc_id") % 4 == 2, F.regexp_replace("path", "bam$", "bai")
        ).when(F.col("doc_id") % 4 == 1, F.concat("path", F.lit(".csi"))).otherwise(F.concat("path", F.lit(".zzz"))).alias("path")
    )
    return S.companions(prim, inv)


def file_buckets(spark, sf):
    n = F.element_at(
        F.array(
            *[
                F.lit(x) for x in (
                    "description.md", "sample_submission.csv", "train.csv", "test.csv", "more.csv", "train_a.zip", "Test_b.ZIP",
                    "c.zip", "d.parquet", "e.PNG", "f.txt"
                )
            ]
        ),
        (F.col("doc_id") % 11 + 1).cast("int")
    )
    f = X.files(spark, sf).withColumn("name", n)
    return f.groupBy(
        P.role_bucket(F.col("name")).alias("role"),
        P.group_bucket(
            F.concat_ws("/", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a-b."), F.col("lang"))), F.col("name"))
        ).alias("grp"),
        F.array_join(P.pattern_buckets(F.col("path"), {"source": "/(src1[0-9]*)/", "lang": "/(en|de)/"}), ",").alias("tags")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def path_tokens(spark, sf):
    return X.talk(spark, sf).select("session_id", "block_seq", F.array_join(P.path_tokens(F.col("text")), " ").alias("paths"))


def hot_literal_scan(spark, sf):
    return S.literal_scan(
        X.talk(spark, sf), X.prior(spark, sf).where("bucket = 'all_files'")
    ).select("session_id", "path", F.col("start").cast("long").alias("start"))


def listing_growth(spark, sf):
    """Files that listings in the text name and the inventory lacks."""
    line = F.concat(
        F.lit("  FILE  /data/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), (F.col("doc_id") * 2).cast("string"),
        F.when(F.col("doc_id") % 5 == 0, ".bin").otherwise(".txt"), F.lit("  ("), F.col("n_chars").cast("string"),
        F.lit(" bytes)")
    )
    text = X.table(spark, sf, "documents").select(F.concat(F.lit("Listing\n"), line, F.lit("\n  DIR   x/\n")).alias("text"))
    listed = text.select(
        F.explode(
            F.arrays_zip(P.listing_files(F.col("text")).alias("path"), P.listing_sizes(F.col("text")).alias("bytes"))
        ).alias("f")
    ).select("f.path", "f.bytes").where(P.listed_extension(F.col("path")))
    return S.new_listed(listed, X.files(spark, sf)).join(listed.groupBy("path").agg(F.max("bytes").alias("bytes")), "path")


def directory_policy(spark, sf):
    f = X.files(spark, sf).withColumn("dir", F.concat(F.lit("/data/"), "source", F.lit("/"), "lang"))
    kept = N.directory_policy(f, "dir", "path", 20, 3)
    bad = X.table(spark, sf, "labels").where("quality = 0 AND toxic = 1").select("doc_id")
    zips = f.join(bad, "doc_id", "left_semi").select(F.concat("dir", F.lit(".zip")).alias("path")).distinct()
    open_ = S.without_zip_sibling(f.select(F.col("dir").alias("path")).distinct(), zips).select(F.col("path").alias("dir"))
    return kept.groupBy("dir").agg(
        F.count(F.lit(1)).alias("kept"), F.max("n_in_dir").alias("n"), F.sum("bytes").alias("bytes")
    ).join(open_, "dir", "left_semi")


def retention_plan(spark, sf):
    e = X.table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("doc_id"), "ts")
    f = e.join(
        X.files(spark, sf).select("doc_id", "path", "bytes"), "doc_id"
    ).groupBy("user_id", "path", "bytes").agg(F.max("ts").alias("atime"))
    plan = N.retention(f, ["user_id"], ["atime", "path"], F.lit(20_000), protected=F.col("path").like("%0.txt"))
    return plan.groupBy("user_id").agg(
        F.count(F.when(F.col("evict"), 1)).alias("n_evict"),
        F.sum(F.when(F.col("evict"), F.col("bytes")).otherwise(0)).alias("freed"), F.bool_and("possible").alias("possible")
    )


def placement_plan(spark, sf):
    f = X.files(spark, sf).select("source", "lang", "doc_id", "path", "bytes")
    p = N.placement(f, ["source", "lang"], "doc_id", 8_000)
    return p.groupBy("source", "lang").agg(
        F.count(F.when(F.col("primary"), 1)).alias("n_primary"), F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("primary"), F.col("bytes")).otherwise(0)).alias("used")
    )


def cap_per_rule(spark, sf):
    """At most 40 files a rule and session half; the first rule that asks takes a file."""
    ask = X.rules(spark).select(
        "ord", F.explode("target_keys").alias("bucket")
    ).where("ord > 1").join(X.prior(spark, sf), "bucket").withColumn("half", F.length("path") % 2)
    return N.cap_per_rule(ask, ["half"], "ord", "path", 40).select(
        "half", "ord", "path", F.col("rank").cast("long").alias("rank")
    )


def accessed_top_up(spark, sf):
    e = X.table(spark, sf, "events").where("event_type = 'error'").select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("doc_id"), "ts"
    ).join(X.files(spark, sf).select("doc_id", "path", "source"), "doc_id")
    truth = X.truth(spark, sf).join(X.files(spark, sf).select("path", F.col("source").alias("key")), "path").select("key", "path")
    seen = e.select(F.col("source").alias("key"), "path", "ts")
    out = N.top_up(seen, truth, "key", "ts", 12, 5)
    return out.select("key", "path", "origin", F.col("rank").cast("long").alias("rank"))


def token_bag(spark, sf):
    t = X.blocks(spark, sf).where("type = 'thinking'").select(
        "session_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]{4,}"), 0))).alias("token")
    )
    return t.groupBy(F.lower("token").alias("token")).agg(F.count_distinct("session_id").alias("sessions"))


def source_files(spark, sf):
    """Each document's file with companions of its directory: reads by bytes descending, a top ten a source."""
    from pyspark.sql import Window

    f = X.files(spark, sf).select("source", "path", "bytes")
    return f.withColumn(
        "rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("bytes"), "path")).cast("long")
    ).where("rank <= 10")


QUERIES = {
    f.__name__: f for f in (
        prefix_map_resolve, path_parts, longest_prefix_join, stage_decision, tier_roles, source_resolution, companion_files,
        file_buckets, path_tokens, hot_literal_scan, listing_growth, directory_policy, retention_plan, placement_plan,
        cap_per_rule, accessed_top_up, token_bag, source_files
    )
}

_BEST = f"(select f.doc_id, f.path, f.bytes, arg_max(m.mount, length(m.mount)) as mount, arg_max(m.kind, length(m.mount)) as kind, arg_max(m.first_byte_ms, length(m.mount)) as fb, arg_max(m.throughput, length(m.mount)) as tp from fx_files f join {_MOUNTS} on m.mount = '/' or f.path = m.mount or starts_with(f.path, concat(m.mount, '/')) group by f.doc_id, f.path, f.bytes)"

SQL = {
    "prefix_map_resolve": "select path, case when starts_with(path, '/data/src1/') then concat('/cold/a/', substr(path, 12)) when starts_with(path, '/data/src') then concat('/cold/b', substr(path, 10)) else path end as real, concat('/y/', cast(doc_id as varchar)) as mapped, case when starts_with(path, '/data/src1/en/') then concat('/z/', substr(path, 15)) else concat('/cold/', substr(path, 7)) end as under, concat('/hot', path) as mirror, starts_with(path, '/output/') or starts_with(path, '/repo/result/') as is_output, path = '/data/src1' or starts_with(path, '/data/src1/') as in_root from fx_files",
    "path_parts": r"with f as (select concat(path, case when doc_id % 3 = 0 then '.gz' when doc_id % 7 = 0 then 'T120000.x' else '' end) as path from fx_files), b as (select path, regexp_extract(path, '[^/]*$') as base from f) select path, base, regexp_replace(base, '\.[^.]*$', '') as stem, replace(regexp_replace(base, '\.[^.]*$', ''), 'T120000', '') as short, string_split(path, '/')[3] as child, cast(len(string_split(path, '/')) as integer) as depth from b",
    "longest_prefix_join": f"select doc_id, path, mount, kind from {_BEST}",
    "stage_decision": f"with b as {_BEST}, c as (select doc_id, mount, case when tp > 0 then fb + bytes / 1024 / 1024 / tp * 1000.0 end as cost, doc_id % 10 as slack from b) select doc_id, mount, round(cost, 4) as cost_ms, not (mount = '/data/src1/en' or coalesce(cost > slack, true)) as stage, case when mount = '/data/src1/en' then 'already hot' when coalesce(cost > slack, true) then 'cost over slack' else 'ok' end as reason from c",
    "tier_roles": f"with b as {_BEST}, s as (select mount, count(*) as n_files, cast(sum(bytes) as bigint) as bytes from b group by mount), r as (select mount, cast(row_number() over (order by first_byte_ms, mount) as integer) as rank, count(*) over () as n from {_MOUNTS}) select r.mount, case rank when 1 then 'hot' when n then 'cold' else 'warm' end as role, rank, coalesce(n_files, 0) as n_files, coalesce(bytes, 0) as bytes from r left join s on s.mount = r.mount",
    "source_resolution": "select path, case doc_id % 4 when 0 then concat(path, '.gz') when 1 then concat(path, '.xz') when 2 then path end as source, case doc_id % 4 when 0 then '.gz' when 1 then '.xz' end as codec, case doc_id % 4 when 0 then (case when (doc_id % 8) * 100 > 200 then bytes + (doc_id % 8) * 100 - 200 else bytes * 4 end) when 1 then bytes * 4 when 2 then bytes end as size_bytes from fx_files",
    "companion_files": "select case when doc_id % 2 = 0 then regexp_replace(path, 'txt$', 'bam') else regexp_replace(path, 'txt$', 'vcf.gz') end as path, case doc_id % 4 when 0 then concat(regexp_replace(path, 'txt$', 'bam'), '.bai') when 2 then regexp_replace(path, 'txt$', 'bai') else concat(regexp_replace(path, 'txt$', 'vcf.gz'), '.csi') end as companion from fx_files where doc_id % 4 < 3",
    "file_buckets": """with n as (select *, ['description.md', 'sample_submission.csv', 'train.csv', 'test.csv', 'more.csv', 'train_a.zip', 'Test_b.ZIP', 'c.zip', 'd.parquet', 'e.PNG', 'f.txt'][doc_id % 11 + 1] as name from fx_files)
      select [null, 'sample_csv', 'train_csv', 'test_csv', 'extra_csv', 'train_zip', 'test_zip', 'data_zip', 'extra_data', 'media', null][doc_id % 11 + 1] as role, case when doc_id % 2 = 0 then concat('files_a_b_', lang) else 'files_root' end as grp,
      concat_ws(',', case when source like 'src1%' then concat('source_', source) end, case when lang in ('en', 'de') then concat('lang_', lang) end) as tags, count(*) as n, cast(sum(bytes) as bigint) as bytes from n group by 1, 2, 3""",
    "path_tokens": "select conv_id as session_id, turn as block_seq, concat('data/src', cast(turn % 20 as varchar), '/en/doc_', cast(conv_id * 7 % 500 as varchar), '.txt data/x/file.csv') as paths from conversations",
    "hot_literal_scan": "select session_id, path, cast(start as bigint) as start from fx_hot",
    "listing_growth": "with l as (select concat('/data/', source, '/', lang, '/doc_', cast(doc_id * 2 as varchar), '.txt') as path, n_chars as bytes from documents where doc_id % 5 <> 0) select path, max(bytes) as bytes from l where path not in (select path from fx_files) group by path",
    "directory_policy": "with f as (select *, concat('/data/', source, '/', lang) as dir, count(*) over (partition by source, lang) as n, row_number() over (partition by source, lang order by path) as r from fx_files), z as (select distinct concat('/data/', source, '/', lang) as dir from fx_files where doc_id in (select doc_id from labels where quality = 0 and toxic = 1)) select dir, count(*) as kept, max(n) as n, cast(sum(bytes) as bigint) as bytes from f where (n <= 20 or r <= 3) and dir not in (select dir from z) group by dir",
    "retention_plan": "with f as (select e.user_id, f.path, f.bytes, max(e.ts) as atime from events e join fx_files f on f.doc_id = cast(json_extract_string(e.props, '$.k') as bigint) where f.path not like '%0.txt' group by e.user_id, f.path, f.bytes), w as (select *, coalesce(sum(bytes) over (partition by user_id order by atime, path rows between unbounded preceding and 1 preceding), 0) as b, sum(bytes) over (partition by user_id) as a from f) select user_id, count(*) filter (b < 20000) as n_evict, cast(coalesce(sum(bytes) filter (b < 20000), 0) as bigint) as freed, bool_and(a >= 20000) as possible from w group by user_id",
    "placement_plan": """with recursive f as (select *, row_number() over (partition by source, lang order by doc_id) as i from fx_files),
      p as (select source, lang, i, bytes <= 8000 as prim, case when bytes <= 8000 then bytes else 0 end as used from f where i = 1
        union all select f.source, f.lang, f.i, p.used + f.bytes <= 8000, case when p.used + f.bytes <= 8000 then p.used + f.bytes else p.used end from p join f on f.source = p.source and f.lang = p.lang and f.i = p.i + 1)
      select source, lang, count(*) filter (prim) as n_primary, count(*) as n, cast(max(used) as bigint) as used from p group by source, lang""",

    "accessed_top_up": """with s as (select f.source as key, f.path, min(e.ts) as ts from events e join fx_files f on f.doc_id = cast(json_extract_string(e.props, '$.k') as bigint) where e.event_type = 'error' group by 1, 2), n as (select key, count(*) as n from s group by key),
      m as (select f.source as key, t.path, row_number() over (partition by f.source order by t.path) as rank from fx_truth t join fx_files f on f.path = t.path left join n on n.key = f.source where coalesce(n.n, 0) < 12 and not exists (select 1 from s where s.key = f.source and s.path = t.path))
      select key, path, 'seen' as origin, row_number() over (partition by key order by ts, path) as rank from s union all select key, path, 'truth', rank from m where rank <= 5""",
    "token_bag": "with t as (select distinct session_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{4,}')) as token from fx_blocks where type = 'thinking') select lower(token) as token, count(distinct session_id) as sessions from t group by lower(token)",
    "source_files": "select source, path, bytes, row_number() over (partition by source order by bytes desc, path) as rank from fx_files qualify rank <= 10",
}

SQL["cap_per_rule"] = "with k as (select length(p.path) % 2 as half, r.ord, p.path from fx_rules r join fx_prior p on p.bucket = r.target_key where r.ord > 1 qualify row_number() over (partition by length(p.path) % 2, p.path order by r.ord) = 1) select cast(half as integer) as half, ord, path, row_number() over (partition by half, ord order by path) as rank from k qualify rank <= 40"
