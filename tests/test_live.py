"""Streams in small files, read one at a time and out of order."""

import datetime as dt
import json
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from reasonlake.operators import scoring as S
from reasonlake.streaming import live

SCHEMA = "session_id string, block string, t_ms double, seq long, kind string, chunk string, event_ts timestamp"
END = ("zz end", "0", 9e8, 0, "text", "")


def stream(spark, tmp_path, parts):
    """A stream of files, each a list of deltas (session, block, t_ms, seq, kind, chunk), and one far behind that closes
    all sessions.
    """
    src = tmp_path / uuid.uuid4().hex
    for n, part in enumerate([*parts, [END]]):
        rows = [(*d, dt.datetime.fromtimestamp(1_700_000_000 + d[2] / 1000, dt.timezone.utc)) for d in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(src / f"p{n:03}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")


def drained(df, tmp_path):
    name = "t" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / name)
    ).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect(), q


def shuffled(deltas, seed, size=4):
    r = random.Random(seed)
    deltas = list(deltas)
    r.shuffle(deltas)
    return [deltas[i : i + size] for i in range(0, len(deltas), size)]


def test_live_rules_of_any_width(spark, tmp_path):
    r = random.Random(5)
    patterns = ["ab.{0,5}c", r"\bnow\b", "x+y", "b{2}|ca{1,2}b"]
    deltas = [
        (
            f"s{s}", str(i), i * 1000.0, i, "text" if i % 3 else "thinking",
            "".join(r.choice(["a", "b", "c", "x", "y", " now ", "n", "ow", " "]) for _ in range(4))
        ) for s in range(6) for i in range(8)
    ]
    want = set()
    for s in {d[0] for d in deltas}:
        text, known = "", set()
        for d in sorted((x for x in deltas if x[0] == s), key=lambda x: x[3]):
            text += d[5]
            for p in patterns:
                m = re.search(p, text)
                if p not in known and m:
                    known.add(p)
                    want.add((s, d[1], p, d[2], m.start()))
    got, q = drained(
        live.fire_live(
            stream(spark, tmp_path, shuffled(deltas, 1, 16)), [(p, p) for p in patterns], delay="1 hour", idle_ms=1000
        ),
        tmp_path
    )
    assert {tuple(x) for x in got} == want and live.late_rows(q) == 0
    bounded, _ = drained(
        live.fire_live(
            stream(spark, tmp_path, shuffled(deltas, 2, 16)), [(p, p) for p in (patterns[0], patterns[3])], delay="1 hour",
            idle_ms=1000
        ),
        tmp_path
    )
    assert {tuple(x) for x in bounded} == {x for x in want if x[2] in (patterns[0], patterns[3])}


def test_late_deltas_are_left_out_and_counted(spark, tmp_path):
    parts = [
        [("s", "0", 100_000.0, 0, "text", "one")], [("s", "0", 200_000.0, 1, "text", "two")],
        [("s", "0", 1_000.0, 2, "text", "late"), ("s", "0", 201_000.0, 3, "text", "three")]
    ]
    got, q = drained(
        live.fire_live(stream(spark, tmp_path, parts), [(p, p) for p in ("late", "three")], delay="1 second", idle_ms=1000),
        tmp_path
    )
    assert {x["name"] for x in got} == {"three"} and live.late_rows(q) == 1


def test_literals_and_listed_files(spark, tmp_path):
    deltas = [
        ("s", "0", 0.0, 0, "text", "see al"), ("s", "1", 1000.0, 1, "text", "pha and /d/new.csv"), (
            "s", "2", 2000.0, 2, "tool_result", "  FILE  /d/new.csv  (12 bytes)\n DIR /d\n"
        ),
        (
            "s", "3", 3000.0, 3, "thinking", "then /d/ne"
        ), ("s", "4", 4000.0, 4, "text", "w.csv, alpha"), ("t", "0", 0.0, 0, "text", "/d/new.csv beta")]
    got, _ = drained(
        live.literal_deltas(
            stream(spark, tmp_path, shuffled(deltas, 3, 2)), [("alpha", "/a"), ("beta", "/b")], delay="1 hour", idle_ms=1000
        ),
        tmp_path
    )
    assert {tuple(x) for x in got} == {
        ("s", "1", "/a", 1000.0, False), ("s", "4", "/d/new.csv", 4000.0, True), ("t", "0", "/b", 0.0, False)
    }


def test_literals_of_more_needles_than_a_task_holds(spark, tmp_path, monkeypatch):
    """Needles are dealt in parts: mentions across deltas and batches, each once a session, none over the seam of two pieces."""
    monkeypatch.setattr(S, "MOST_NEEDLES", 2)
    prior = spark.createDataFrame([("k", f"/d/{x}.csv") for x in ("alpha", "beta", "gamma", "ab")], "bucket string, path string")
    parts = [
        [("s", "0", 0.0, 0, "text", "see al"), ("s", "1", 1000.0, 1, "text", "pha, ga"), ("t", "0", 0.0, 0, "text", "a")],
        [("s", "2", 90_000.0, 2, "text", "mma alpha"), ("t", "1", 90_000.0, 1, "thinking", "xb beta")],
        [("s", "3", 180_000.0, 3, "text", "alpha /d/ab.csv")]
    ]
    table = f"file://{tmp_path}/named"
    live.write_literals(
        stream(spark, tmp_path, parts), prior, table, str(tmp_path / "ck"), delay="1 second", idle_ms=1_000_000
    ).awaitTermination()
    assert sorted(tuple(r)[:4] for r in live.written_literals(spark, table).collect()) == [
        ("s", "1", "/d/alpha.csv", 1000.0), ("s", "2", "/d/gamma.csv", 90_000.0), ("s", "3", "/d/ab.csv", 180_000.0),
        ("t", "1", "/d/beta.csv", 90_000.0)
    ]


def test_literals_by_a_table_of_needles(spark, tmp_path):
    prior = spark.createDataFrame([("k", "/d/alpha.csv"), ("k", "/e/beta.txt")], "bucket string, path string")
    keyed = S.keyed_needles(S.needles_of(prior))
    kinds = keyed.agg(F.sort_array(F.collect_set(F.length("gram")))).first()[0]
    deltas = [
        ("s", "0", 0.0, 0, "text", "xalphax"), ("s", "1", 1000.0, 1, "text", "/d/alpha.csv, beta"),
        ("t", "0", 0.0, 0, "text", "none")
    ]
    got, _ = drained(live.literal_stream(stream(spark, tmp_path, [deltas]), keyed, kinds, delay="1 hour"), tmp_path)
    assert {(x["session_id"], x["path"]) for x in got} == {("s", "/d/alpha.csv"), ("s", "/e/beta.txt")} and len(got) == 2


def test_slack_at_the_first_tool_use(spark, tmp_path):
    deltas = [
        ("s", "0", 500.0, 0, "thinking", "a"), ("s", "1", 900.0, 1, "thinking", "b"), ("s", "2", 2500.0, 2, "tool_use", "{}"),
        ("s", "3", 9000.0, 3, "tool_use", "{}"), ("t", "0", 100.0, 0, "tool_use", "{}"), ("t", "1", 200.0, 1, "thinking", "x"),
        ("u", "0", 1.0, 0, "text", "x")
    ]
    got, _ = drained(live.slack_live(stream(spark, tmp_path, shuffled(deltas, 4, 3)), delay="1 hour", idle_ms=1000), tmp_path)
    assert {tuple(x) for x in got} == {("s", 2500.0, 2000.0), ("t", 100.0, None)} or {
        (x[0], x[1], None if x[2] != x[2] else x[2]) for x in got
    } == {("s", 2500.0, 2000.0), ("t", 100.0, None)}


def test_tool_arguments_are_joined_by_call(spark, tmp_path):
    raw = [
        ("s", 0, 1.0, None, None, "hi", None, None), ("s", 1, 2.0, None, None, None, '{"a"', 0),
        ("s", 2, 3.0, None, None, None, ": 1}", 0), ("s", 3, 4.0, None, None, None, "{}", 1),
        ("s", 4, 5.0, "why", None, None, None, None), ("s", 5, 6.0, None, "so", None, None, None)
    ]
    e = spark.createDataFrame(
        raw,
        "session_id string, seq long, t_ms double, reasoning string, reasoning_content string, content string, arguments string, call_index int"
    )
    norm = [tuple(x) for x in live.normalise(e, "openai").orderBy("seq").collect()]
    assert [(x[1], x[4], x[5]) for x in norm] == [
        ("text-0", "text", "hi"), ("tool_use-0", "tool_use", '{"a"'), ("tool_use-0", "tool_use", ": 1}"),
        ("tool_use-1", "tool_use", "{}"), ("thinking-0", "thinking", "why"), ("thinking-0", "thinking", "so")
    ]
    got, _ = drained(live.tool_arguments(stream(spark, tmp_path, shuffled(norm, 5, 2)), delay="1 hour", idle_ms=1000), tmp_path)
    assert sorted(
        (x["block"], x["t_ms"], json.dumps(json.loads(x["arguments"]))) for x in got
    ) == [("tool_use-0", 2.0, '{"a": 1}'), ("tool_use-1", 4.0, "{}")]


def test_providers_in_one_form(spark):
    g = spark.createDataFrame(
        [
            ("s", 0, 1.0, "thinking_delta", "a", None), ("s", 1, 2.0, "function_call", None, "{}"),
            ("s", 2, 3.0, "other", "x", None)
        ],
        "session_id string, seq long, t_ms double, event string, chunk string, args string"
    )
    assert [
        (x["kind"], x["chunk"]) for x in live.normalise(g, "gemini").orderBy("seq").collect()
    ] == [("thinking", "a"), ("tool_use", "{}")]
    a = spark.createDataFrame(
        [("s", 0, 1.0, 3, "input_json_delta", "{"), ("s", 1, 2.0, 3, "signature_delta", "x")],
        "session_id string, seq long, t_ms double, block_idx int, delta_type string, chunk string"
    )
    assert [(x["block"], x["kind"]) for x in live.normalise(a, "anthropic").collect()] == [("3", "tool_use")]


def test_only_small_targets_are_dispatched(spark):
    fired = spark.createDataFrame([("s", "few"), ("s", "many"), ("s", "none")], "session_id string, name string")
    sizes = spark.createDataFrame([("few", 10), ("many", 11)], "name string, n long")
    assert {
        (x["name"], x["tier"], x["dispatch"]) for x in live.gate(fired, sizes).collect()
    } == {("few", 1, True), ("many", 2, False), ("none", 1, True)}


def test_one_request_for_each_host_and_path(spark, tmp_path):
    d = stream(spark, tmp_path, [[("s", "0", 0.0, 0, "r1", "x"), ("t", "0", 1.0, 0, "r1", "x")], [("s", "0", 2.0, 1, "r2", "x")]])
    targets = spark.createDataFrame(
        [("r1", "h1", "/a"), ("r1", "h1", "/b"), ("r2", "h1", "/a"), ("r2", "h2", "/a")], "name string, host string, path string"
    )
    got, _ = drained(live.requests(d.withColumnRenamed("kind", "name"), targets, "event_ts", "1 hour"), tmp_path)
    assert sorted((x["host"], x["path"]) for x in got) == [("h1", "/a"), ("h1", "/b"), ("h2", "/a")]


@pytest.mark.parametrize(
    "slide,want", [(None, {(0, 2, 5), (600, 1, 3)}), ("5 minutes", {(-300, 2, 5), (0, 2, 5), (300, 1, 3), (600, 1, 3)})]
)
def test_rollups_of_tumbling_and_sliding_windows(spark, slide, want):
    at = lambda s: dt.datetime.fromtimestamp(1_700_000_400 + s, dt.timezone.utc)
    e = spark.createDataFrame(
        [(at(0), "staged", 2, 1.0), (at(299), "staged", 3, 2.0), (at(600), "staged", 3, 2.0)],
        "event_ts timestamp, outcome string, size_bytes long, fetch_ms double"
    )
    got = live.stage_rollup(e, window="10 minutes", slide=slide).select(
        (F.unix_timestamp("start") - 1_700_000_400).alias("s"), "n", "bytes"
    ).collect()
    assert {tuple(x) for x in got} == want
