"""Session-shaped views over the given tables, as DataFrames and as the SQL that the oracle prefixes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [
    (0, "first_inspect", "(?i)(the|le).{0,30}one", "first_file", "general"),
    (1, "all_signal", "(?i)all|each|every", "all_files", "general"),
    (2, "lang_fr", "(?i)eau", "lang_fr", "fx"),
    (3, "lang_de", "(?i)sch", "lang_de", "fx"),
    (4, "source_src1", "(?i)ent", "source_src1", "fx"),
    (5, "never", "zzqqzz", "source_src2", "fx"),
]
TOOLS = {"view": "list_dir", "click": "open_file", "signup": "read_file", "error": "write_file"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "tool_result").when(F.col("role") == "system", "tool_use").when(F.col("turn") % 4 == 1, "thinking").otherwise("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("block_seq"), "turn", kind.alias("type"),
        (F.col("turn") * 1000.0).alias("t_first"), ((F.col("turn") + 1) * 1000.0).alias("t_stop"), "text"
    )


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns name paths: as they are, within longer names, and across the borders of turns."""
    c, turn = F.col("conv_id"), F.col("turn")
    text = F.concat(
        F.lit("txt "), F.col("text"), F.lit(" open /data/src"), (turn % 20).cast("string"), F.lit("/en/doc_"), (c * 7 % 500).cast("string"),
        F.lit(
            ".txt, then data/x/file.csv. and xdata/no.csv or mydoc_"
        ), (c % 300).cast("string"), F.lit(".txt and doc_"), (c % 90).cast("string"), F.lit("."))
    kind = F.when(turn % 4 == 1, "thinking").otherwise("text")
    return table(spark, sf_dir, "conversations").select(
        c.alias("session_id"), turn.alias("block_seq"), kind.alias("type"), text.alias("text")
    )


def doc_path(id_: str = "doc_id"):
    return F.concat(F.lit("/data/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col(id_).cast("string"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", doc_path().alias("path"), F.col("n_chars").alias("bytes"), "lang", "source"
    )


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(
        F.concat(F.lit("source_"), "source"), F.concat(F.lit("lang_"), "lang"), F.lit("all_files"),
        F.when(F.col("doc_id") == 0, "first_file")
    )
    return files(spark, sf_dir).select(F.explode(F.array_compact(names)).alias("bucket"), "path", "bytes")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return files(spark, sf_dir).join(good, "doc_id").select("path", "bytes")


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RULES, "ord int, name string, pattern string, target_key string, origin string"
    ).select("ord", "name", "pattern", F.array("target_key").alias("target_keys"), "origin")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.lit("run_shell_command")
    for k, v in TOOLS.items():
        tool = F.when(F.col("event_type") == k, v).otherwise(tool)
    rank = F.expr("row_number() over (partition by user_id order by ts) - 1")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), rank.alias("turn"), tool.alias("tool_name"), F.col("value").alias("duration_s"),
        "ts", "event_id", "props"
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "staged").when(F.col("l_returnflag") == "N", "hit").otherwise("error")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("cold_path"), F.floor("l_extendedprice").cast("long").alias("size_bytes"),
        F.col("l_quantity").alias("fetch_ms"), F.col("l_linenumber").alias("tier"), kind.alias("outcome"),
        F.col("l_shipdate").alias("t_completed")
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    price, off = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(price).alias("cold_amt"), F.sum(price * (1 - off)).alias("staged_amt"), F.count(F.lit(1)).alias("n_rows")
    )
    return o.join(items, o.o_orderkey == items.l_orderkey).select(
        F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("model"),
        "cold_amt", "staged_amt", "n_rows"
    )


_SQL = {
    "fx_blocks": "select conv_id as session_id, turn as block_seq, turn, case when role = 'user' then 'tool_result' when role = 'system' then 'tool_use' when turn % 4 = 1 then 'thinking' else 'text' end as type, turn * 1000.0 as t_first, (turn + 1) * 1000.0 as t_stop, text from conversations",
    "fx_files": "select doc_id, concat('/data/', source, '/', lang, '/doc_', cast(doc_id as varchar), '.txt') as path, n_chars as bytes, lang, source from documents",
    "fx_prior": "select concat('source_', source) as bucket, path, bytes from fx_files union all select concat('lang_', lang), path, bytes from fx_files union all select 'all_files', path, bytes from fx_files union all select 'first_file', path, bytes from fx_files where doc_id = 0",
    "fx_truth": "select f.path, f.bytes from fx_files f join labels l on f.doc_id = l.doc_id where l.quality = 1",
    "fx_rules": "select * from (values " + ", ".join(str(r) for r in RULES) + ") as r(ord, name, pattern, target_key, origin)",
    "fx_turns": "select user_id as session_id, row_number() over (partition by user_id order by ts) - 1 as turn, case event_type when 'view' then 'list_dir' when 'click' then 'open_file' when 'signup' then 'read_file' when 'error' then 'write_file' else 'run_shell_command' end as tool_name, value as duration_s, ts, event_id, props from events",
    "fx_talk": "select conv_id as session_id, turn as block_seq, case when turn % 4 = 1 then 'thinking' else 'text' end as type, concat('txt ', text, ' open /data/src', cast(turn % 20 as varchar), '/en/doc_', cast(conv_id * 7 % 500 as varchar), '.txt, then data/x/file.csv. and xdata/no.csv or mydoc_', cast(conv_id % 300 as varchar), '.txt and doc_', cast(conv_id % 90 as varchar), '.') as text from conversations",
    "fx_said": "select session_id, string_agg(text, '' order by block_seq) as text from fx_talk group by session_id",
    "fx_needles": "select path, unnest(list_distinct([path, regexp_extract(path, '[^/]*$'), regexp_replace(regexp_extract(path, '[^/]*$'), '\\.txt$', '')])) as needle from fx_files",
    "fx_hot": "select s.session_id, n.path, min(instr(s.text, n.needle)) - 1 as start from fx_said s join fx_needles n on contains(s.text, n.needle) group by s.session_id, n.path",
    "fx_opens": "select e.user_id as session_id, f.path, f.bytes, e.ts, f.source from events e join fx_files f on f.doc_id = cast(json_extract_string(e.props, '$.k') as bigint) where e.event_type in ('click', 'signup')",
    "fx_stage_events": "select l_partkey as cold_path, cast(floor(l_extendedprice) as bigint) as size_bytes, l_quantity as fetch_ms, l_linenumber as tier, case l_returnflag when 'A' then 'staged' when 'N' then 'hit' else 'error' end as outcome, l_shipdate as t_completed from lineitem",
    "fx_cells": "select o.o_orderkey as cell, o.o_orderpriority as task, o.o_orderstatus as model, sum(cast(l.l_extendedprice as decimal(12,2))) as cold_amt, sum(cast(l.l_extendedprice as decimal(12,2)) * (1 - cast(l.l_discount as decimal(4,2)))) as staged_amt, count(*) as n_rows from orders o join lineitem l on o.o_orderkey = l.l_orderkey group by o.o_orderkey, o.o_orderpriority, o.o_orderstatus",
    # what the rules of fx_rules fire at, block by block and first in the session
    "fx_fire": "select b.session_id, b.block_seq, b.turn, b.type, b.text, b.t_first, b.t_stop, r.ord, r.name, r.target_key, length(regexp_extract(b.text, '(?s)^(.*?)(?-s:(?i)' || r.pattern || ')', 1)) as match_start from fx_blocks b join fx_rules r on b.type in ('thinking', 'text', 'tool_result') and regexp_matches(b.text, '(?i)' || r.pattern)",
    "fx_first": "select * from fx_fire qualify row_number() over (partition by session_id, name order by block_seq, match_start, ord) = 1",
    "fx_hit": "select distinct f.session_id, f.name, f.turn, f.t_first as t, p.path, p.bytes from fx_first f join fx_prior p on p.bucket = f.target_key",
    "fx_rule_tier": "select session_id, name, count(distinct path) as n, case when count(distinct path) <= 20 then 1 when count(distinct path) <= 200 then 2 else 3 end as tier from fx_hit group by session_id, name",
    "fx_tier": "select h.session_id, h.path, h.bytes, min(t.tier) as tier, arg_min(h.t, t.tier * 1e9 + h.t) as t from fx_hit h join fx_rule_tier t on t.session_id = h.session_id and t.name = h.name group by h.session_id, h.path, h.bytes",
}


def sql(text: str) -> str:
    """Query text with the views it names, and those they name, in front."""
    need: list[str] = []

    def add(part: str) -> None:
        for v in re.findall(r"\bfx_\w+", part):
            if v in _SQL and v not in need:
                add(_SQL[v])
                if v not in need:
                    need.append(v)

    add(text)
    views = ", ".join(f"{v} as ({_SQL[v]})" for v in need)
    if not views:
        return text
    head = re.match(r"with (recursive )?", text)
    return f"with {head[1] or ''}{views}, {text[head.end():]}" if head else f"with {views} {text}"
