"""Streaming operators over the given tables: the tables are read as streams until they end, and the sink's table is returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.staging import shared_folder, staged
from ..streaming import live
from . import fixtures as X


#: Event time of the row that ends a stream: later than any event, and a time that pandas can hold.
END = "2261-01-01 00:00:00"


def _ended(df, time, **values):
    """A stream with one more row at ``END``, so that the watermark passes every event once the input ends. What holds
    that row itself stays open and is never emitted.
    """
    out = shared_folder(df.sparkSession, "end")
    values |= {time: END}
    df.sparkSession.range(1).select(
        *[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]
    ).write.parquet(out)
    return df.union(df.sparkSession.readStream.schema(df.schema).parquet(out))


def _drained(df, name, mode="append"):
    """Run a stream over what is there and return what it wrote. Checkpoint and sink are in the folder that the
    executors share.
    """
    spark = df.sparkSession
    out = shared_folder(spark, name)
    q = df.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/sink").option(
        "checkpointLocation", f"{out}/checkpoint"
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/sink")


def _stream(spark, sf, name):
    """A given table as a stream of its files, be it one file or a folder of them."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema).parquet(f"{sf}/{name}.parque[t]")


def stage_rollup_stream(spark, sf):
    """Events by hour and type, as a stream. The input ends, so the last windows close too."""
    e = _stream(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("event_ts"), F.col("event_type").alias("outcome"),
        F.col("user_id").alias("size_bytes"), F.col("value").alias("fetch_ms")
    )
    return _drained(
        live.stage_rollup(_ended(e, "event_ts"), window="1 hour", delay="0 seconds"), "rollup"
    ).select("start", "outcome", "n", "bytes", "max_ms")


def stage_rollup_batch(spark, sf):
    """The same rollup over the whole table at once."""
    e = X.table(spark, sf, "events").select(
        F.col("ts").alias("event_ts"), F.col("event_type").alias("outcome"), F.col("user_id").alias("size_bytes"),
        F.col("value").alias("fetch_ms")
    )
    return live.stage_rollup(e, window="1 hour").select("start", "outcome", "n", "bytes", "max_ms")


def live_rule_firing(spark, sf):
    """Rules over the conversations as streamed deltas, one a turn, in event time. The input ends, so every session
    closes. A turn's event time is its end: what is not past the first watermark, 0, would be late.
    """
    c = _stream(spark, sf, "conversations").where("role <> 'system'").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("block"),
        (F.col("turn") * 1000.0).alias("t_ms"), F.col("turn").alias("seq"), F.lit("text").alias("kind"),
        F.col("text").alias("chunk"), F.timestamp_millis(((F.col("turn") + 1) * 1000).cast("long")).alias("event_ts")
    )
    fired = live.fire_live(
        _ended(c, "event_ts", session_id="end of input", kind="text", t_ms=0.0, seq=0), [(r[1], r[2]) for r in X.RULES],
        delay="0 seconds", idle_ms=1
    )
    return _drained(fired, "fired")


def _turns(spark, sf):
    """Conversations as a stream of deltas, one a turn; a user's turn is a tool use, every fourth other one thinking."""
    kind = F.when(F.col("role") == "user", "tool_use").when(F.col("turn") % 4 == 1, "thinking").otherwise("text")
    return _stream(spark, sf, "conversations").where("role <> 'system'").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("block"),
        (F.col("turn") * 1000.0).alias("t_ms"), F.col("turn").alias("seq"), kind.alias("kind"), F.col("text").alias("chunk"),
        F.timestamp_millis(((F.col("turn") + 1) * 1000).cast("long")).alias("event_ts")
    )


def slack_stream(spark, sf):
    """Slack of each session, told at its first tool use."""
    return _drained(
        live.slack_live(
            _ended(_turns(spark, sf), "event_ts", session_id="end of input", kind="text", t_ms=0.0, seq=0), delay="0 seconds",
            idle_ms=1
        ),
        "slack"
    )


def _deltas(spark, sf, kind, text):
    """Conversations as a stream of deltas, two halves of each turn's text."""
    n = F.floor(F.length("said") / 2).cast("int")
    c = _stream(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"), text.alias("said"))
    c = c.select("*", F.posexplode(F.array(F.left("said", n), F.substring("said", n + 1, F.length("said")))).alias("i", "chunk"))
    e = c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("block"), (F.col("turn") * 1000.0).alias("t_ms"),
        (F.col("turn") * 2 + F.col("i")).alias("seq"), "kind", "chunk", F.timestamp_millis(((F.col("turn") + 1) * 1000).cast("long")).alias("event_ts")
    )
    return _ended(e, "event_ts", session_id="end of input", kind="text", t_ms=0.0, seq=0)


def literal_delta_stream(spark, sf):
    """Files that a session names, each once; names lie across deltas too."""
    c, turn = F.col("conv_id"), F.col("turn")
    text = F.concat(
        F.col("text"), F.lit(" /data/src"), (turn % 20).cast("string"), F.lit("/en/doc_"), (c * 7 % 500).cast("string"),
        F.lit(".txt, doc_"), ((c + turn) % 90).cast("string"), F.lit(".")
    )
    prior = X.prior(spark, sf).where("bucket = 'all_files'")
    out = shared_folder(spark, "literals")
    live.write_literals(
        _deltas(spark, sf, F.lit("text"), text), prior, f"{out}/named", f"{out}/checkpoint", delay="0 seconds", idle_ms=1
    ).awaitTermination()
    return live.written_literals(spark, f"{out}/named").select("session_id", "path")


def _numbered(shift):
    return F.concat(F.lit("/srv/f_"), F.lpad(((F.col("conv_id") * 3 + F.col("turn") - shift) % 40).cast("string"), 3, "0"))


def listed_literal_stream(spark, sf):
    """Files that listings show and that are named later: what is looked for grows with the session."""
    user = F.col("role") == "user"
    text = F.when(user, F.concat("text", F.lit("\n  FILE "), _numbered(0), F.lit(" (7 bytes)"))).otherwise(F.concat("text", F.lit(" see "), _numbered(1), F.lit(".")))
    c = _stream(spark, sf, "conversations").where("role <> 'system'").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("block"), (F.col("turn") * 1000.0).alias("t_ms"),
        F.col("turn").alias("seq"), F.when(user, "tool_result").otherwise("text").alias("kind"), text.alias("chunk"),
        F.timestamp_millis(((F.col("turn") + 1) * 1000).cast("long")).alias("event_ts")
    )
    e = _ended(c, "event_ts", session_id="end of input", kind="text", t_ms=0.0, seq=0)
    return _drained(live.literal_deltas(e, [], delay="0 seconds", idle_ms=1), "listed")


def tool_arguments_stream(spark, sf):
    """A user's turn as a tool call in two fragments, an assistant's as reasoning under either name, in a provider's form."""
    n = F.floor(F.length("text") / 2).cast("int")
    c = _stream(spark, sf, "conversations").where("role <> 'system'").select(
        "conv_id", "turn", "role", F.posexplode(F.array(F.left("text", n), F.substring("text", n + 1, F.length("text")))).alias("i", "part")
    )
    user = F.col("role") == "user"
    e = c.select(
        F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") * 1000.0 + F.col("i")).alias("t_ms"), (F.col("turn") * 2 + F.col("i")).alias("seq"),
        F.when(~user & (F.col("i") == 0), F.col("part")).alias("reasoning"), F.when(~user & (F.col("i") == 1), F.col("part")).alias("reasoning_content"),
        F.lit(None).cast("string").alias("content"), F.when(user, F.col("part")).alias("arguments"), F.when(user, F.col("turn")).alias("call_index")
    )
    d = live.normalise(e, "openai").withColumn("event_ts", F.timestamp_millis((F.col("t_ms") + 1000).cast("long")))
    d = _ended(d, "event_ts", session_id="end of input", kind="text", t_ms=0.0, seq=0)
    return _drained(live.tool_arguments(d, delay="0 seconds", idle_ms=1), "arguments")


def _fired(spark, sf):
    e = _ended(_turns(spark, sf), "event_ts", session_id="end of input", kind="text", t_ms=0.0, seq=0)
    return live.fire_live(e, [(r[1], r[2]) for r in X.RULES], delay="0 seconds", idle_ms=1)


def live_gate(spark, sf):
    """Live firings with the tier of their targets, and whether they are dispatched."""
    n = X.prior(spark, sf).groupBy("bucket").agg(F.count("path").alias("n"))
    sizes = X.rules(spark).select("name", F.explode("target_keys").alias("bucket")).join(n, "bucket", "left").select("name", "n")
    sizes = staged(sizes, "sizes")  # once, not for each batch of the stream
    return _drained(live.gate(_fired(spark, sf), sizes), "gate").select("session_id", "name", "n", "tier", "dispatch")


def staging_requests_stream(spark, sf):
    """What live firings ask for, each host and path once for good, over all batches of the stream."""
    host = F.concat(F.lit("h"), (F.length("path") % 3).cast("string"))
    targets = X.rules(spark).select("name", F.explode("target_keys").alias("bucket")).join(X.prior(spark, sf), "bucket").select("name", host.alias("host"), "path")
    out = shared_folder(spark, "requests")
    live.send_requests(_fired(spark, sf), f"{out}/sent", f"{out}/checkpoint", targets=targets).awaitTermination()
    return live.sent_requests(spark, f"{out}/sent").select("host", "path")


def session_slack_batch(spark, sf):
    """First thinking to first tool use by session window."""
    b = X.blocks(spark, sf).withColumns(
        {
            "kind": F.col("type"), "t_ms": F.col("t_first").cast("double"),
            "event_ts": F.timestamp_millis(F.col("t_first").cast("long"))
        }
    )
    return live.session_slack(b).select("session_id", "slack_ms")


QUERIES = {
    f.__name__: f for f in (
        stage_rollup_stream, stage_rollup_batch, live_rule_firing, slack_stream, literal_delta_stream, listed_literal_stream,
        tool_arguments_stream, live_gate, staging_requests_stream, session_slack_batch
    )
}
_ROLLUP = "select date_trunc('hour', ts) as start, event_type as outcome, count(*) as n, cast(sum(user_id) as bigint) as bytes, max(value) as max_ms from events group by 1, 2"
#: Sessions (u) and the rules (r) that their assistants' turns match: users' turns are tool uses, which aren't searched.
_FIRING = """(select conv_id, string_agg(text, '' order by turn) as text from conversations where role = 'assistant' group by conv_id) b join fx_rules r on regexp_matches(b.text, '(?i)' || r.pattern)"""
SQL = {
    "stage_rollup_stream": _ROLLUP,
    "live_rule_firing": """with u as (select conv_id, turn, string_agg(text, '') over (partition by conv_id order by turn rows between unbounded preceding and current row) as upto from conversations where role <> 'system'),
      m as (select u.conv_id, u.turn, r.name, length(regexp_extract(upto, '(?s)^(.*?)(?-s:(?i)' || r.pattern || ')', 1)) as o from u join fx_rules r on regexp_matches(upto, '(?i)' || r.pattern))
      select cast(conv_id as varchar) as session_id, cast(turn as varchar) as block, name, turn * 1000.0::double as fired_at_ms, cast(o as bigint) as match_start from m qualify row_number() over (partition by conv_id, name order by turn) = 1""",
    "slack_stream": "with k as (select conv_id, turn, case when role = 'user' then 'u' when turn % 4 = 1 then 't' end as k from conversations where role <> 'system'), g as (select conv_id, min(turn) filter (k = 'u') as u, min(turn) filter (k = 't') as t from k group by conv_id) select cast(conv_id as varchar) as session_id, u * 1000.0::double as t_ms, case when t < u then (u - t) * 1000.0::double end as slack_ms from g where u is not null",
    "literal_delta_stream": "with t as (select conv_id, string_agg(concat(text, ' /data/src', cast(turn % 20 as varchar), '/en/doc_', cast(conv_id * 7 % 500 as varchar), '.txt, doc_', cast((conv_id + turn) % 90 as varchar), '.'), '' order by turn) as text from conversations group by conv_id) select distinct cast(t.conv_id as varchar) as session_id, n.path from t join fx_needles n on contains(t.text, n.needle)",
    "listed_literal_stream": """with d as (select conv_id, turn, role, concat('/srv/f_', lpad(cast((conv_id * 3 + turn - case when role = 'user' then 0 else 1 end) % 40 as varchar), 3, '0')) as path from conversations where role <> 'system'), l as (select conv_id, path, min(turn) as at from d where role = 'user' group by 1, 2)
      select cast(l.conv_id as varchar) as session_id, cast(min(d.turn) as varchar) as block, l.path, min(d.turn) * 1000.0::double as t_ms, true as listed from l join d on d.conv_id = l.conv_id and d.path = l.path and d.turn > l.at group by l.conv_id, l.path""",
    "tool_arguments_stream": "select cast(conv_id as varchar) as session_id, concat('tool_use-', cast(turn as varchar)) as block, turn * 1000.0::double as t_ms, text as arguments from conversations where role = 'user'",
    "live_gate": f"""with n as (select bucket, count(*) as n from fx_prior group by 1)
      select distinct cast(b.conv_id as varchar) as session_id, r.name, n.n, case when coalesce(n.n, 0) <= 10 then 1 when n.n <= 200 then 2 else 3 end as tier, coalesce(n.n, 0) <= 10 as dispatch from {_FIRING} left join n on n.bucket = r.target_key""",
    "staging_requests_stream": f"select distinct concat('h', cast(length(p.path) % 3 as varchar)) as host, p.path from {_FIRING} join fx_prior p on p.bucket = r.target_key",
    "stage_rollup_batch": "select date_trunc('hour', ts) as start, event_type as outcome, count(*) as n, cast(sum(user_id) as bigint) as bytes, max(value) as max_ms from events group by 1, 2",
    "session_slack_batch": "select session_id, cast(min(t_first) filter (type = 'tool_use') - min(t_first) filter (type = 'thinking') as double) as slack_ms from fx_blocks group by session_id",
}
