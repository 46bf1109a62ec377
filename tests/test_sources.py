"""Readers and sinks on files that the tests write, odd ones included."""

import json
import math

import pytest
from pyspark.sql import functions as F

from reasonlake.functions import labels as L
from reasonlake.operators import planning as N
from reasonlake.operators import scoring as S
from reasonlake.operators import sessions as E
from reasonlake.plans import fixtures as X
from reasonlake.sources import logs


def put(root, path, value):
    at = root / path
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(
        value if isinstance(value, str) else "\n".join(
            x if isinstance(x, str) else json.dumps(x) for x in value
        ) if isinstance(value, list) else json.dumps(value)
    )


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_turn_directories_may_lack_files(spark, tmp_path):
    put(tmp_path, "r1/turns/turn_00/thinking.jsonl", [{"delta": "think "}, "broken {", {"delta": "more"}])
    put(tmp_path, "r1/turns/turn_01/thinking.jsonl", [{"delta": "again"}, {"other": 1}])
    b = logs.turn_directory(spark, f"{tmp_path}/*/turns/turn_*")
    assert rows(b, "session_id", "turn", "type", "text", "t_first", "t_stop") == [
        ("r1", 0, "thinking", "think more", 0.0, 1000.0), ("r1", 1, "thinking", "again", 1000.0, 2000.0)
    ]
    put(
        tmp_path, "r2/turns/turn_02/tool_result.jsonl",
        [
            {"content": "a"}, {"content": [{"type": "text", "text": "b"}, {"type": "image"}, {"type": "text", "text": "c"}]},
            {"content": ""}, {"content": None}
        ]
    )
    put(tmp_path, "r2/turns/turn_02/text.jsonl", [{"delta": "say"}])
    b = logs.turn_directory(spark, f"{tmp_path}/r2/turns/turn_*")
    assert rows(b, "block_seq", "turn", "type", "text", "t_first") == [
        (0, 2, "text", "say", 2000.0), (1, 2, "tool_result", "a\nb\nc", 2500.0)
    ]
    assert rows(
        logs.turn_directory(spark, f"{tmp_path}/r2/turns/turn_*", result_turn="next"), "turn", "type"
    ) == [(2, "text"), (3, "tool_result")]


def test_recorder_directories(spark, tmp_path):
    stream = [
        {"type": "content_block_start", "block_idx": 0, "block_type": "thinking", "t_ms": 5.0}, {
            "type": "content_block_delta", "block_idx": 0, "delta_type": "thinking_delta", "chunk": "a", "t_ms": 7.0
        },
        {
            "type": "content_block_delta", "block_idx": 0, "delta_type": "thinking_delta", "chunk": "b", "t_ms": 9.0
        }, {"type": "content_block_delta", "block_idx": 0, "delta_type": "text_delta", "chunk": "no", "t_ms": 9.5},
        "not json", {"type": "content_block_start", "block_idx": 1, "block_type": "text", "t_ms": 10.0}, {
            "type": "content_block_start", "block_idx": 2, "block_type": "tool_use", "t_ms": 11.0
        }]
    put(tmp_path, "r/turns/turn_00/stream.jsonl", stream)
    put(tmp_path, "r/turns/turn_00/tool_result.jsonl", [{"content": "res"}, {"content": [{"type": "text", "text": "x"}]}])
    put(
        tmp_path, "r/turns/turn_03/stream.jsonl",
        [
            {"type": "content_block_start", "block_idx": 0, "block_type": "text", "t_ms": 1.0},
            {"type": "content_block_delta", "block_idx": 0, "delta_type": "text_delta", "chunk": "later", "t_ms": 4.0}
        ]
    )
    b = logs.recorder_directory(spark, f"{tmp_path}/*/turns/turn_*")
    assert rows(b, "block_seq", "turn", "type", "text", "t_first", "t_stop") == [
        (0, 0, "thinking", "ab", 5.0, 9.5), (
            1, 1, "tool_result", "res", 500.0, 500.0
        ), (2, 1, "tool_result", "x", 500.0, 500.0), (3, 3, "text", "later", 10001.0, 10004.0)]


def test_streams_of_both_shapes(spark):
    e = [
        ("s", 0, "content_block_start", 0, 1.0, "text", None, None, None),
        ("s", 1, "content_block_delta", 0, 2.0, None, None, "text_delta", "hi"),
        ("g", 0, "other", None, 1.0, None, None, None, None), ("g", 1, "text_delta", None, 3.0, None, None, None, "yo"),
        ("none", 0, "other", None, 1.0, None, None, None, None)
    ]
    df = spark.createDataFrame(
        e,
        "session_id string, seq long, event string, block_idx int, t_ms double, block_type string, tool_name string, delta_type string, chunk string"
    )
    assert rows(logs.parse_stream(df), "session_id", "type", "text") == [("g", "text", "yo"), ("s", "text", "hi")]
    assert rows(logs.parse_stream(df, "OpenRouter"), "session_id", "type", "text") == [("s", "text", "hi")]
    assert rows(logs.parse_stream(df, "Google"), "session_id", "type", "text") == [("g", "text", "yo")]
    assert rows(logs.parse_stream(df, "unknown"), "session_id", "text") == [("g", "yo"), ("s", "hi")]
    named = logs.from_recorder(df.drop("event").withColumn("type", F.lit("content_block_stop")))
    assert "event" in named.columns and "type" not in named.columns


def test_times_from_the_start(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 8.0), ("b", 1.0)], "session_id string, t_ms double")
    assert rows(logs.rebase(df), "session_id", "t_ms") == [("a", 0.0), ("a", 3.0)]


def test_trajectories(spark):
    d = [
        ("s", 0, "text", "b", 2.0, 1, "y"), ("s", 0, "text", "b", 1.0, 0, "x"), ("s", 0, "thinking", "a", 0.5, 2, "t"),
        ("s", 1, "text", "b", 9.0, 3, None)
    ]
    df = spark.createDataFrame(
        d, "session_id string, turn int, kind string, block_id string, t_ms double, seq long, delta string"
    )
    assert rows(logs.trajectory(df), "block_seq", "kind", "text") == [(0, "thinking", "t"), (1, "text", "xy"), (2, "text", "")]


@pytest.mark.parametrize("where", [["one"], ["one", "poc/two"], ["poc/two"]])
def test_campaigns_of_one_or_two_levels(spark, tmp_path, where):
    for w in where:
        put(
            tmp_path, f"{w}/summary.json",
            {
                "task_id": "t", "elapsed_s": 3.0, "n_predicted_files": 2, "prompt_mode": "", "prompt_variant": "v",
                "per_turn": [{"turn": 0, "duration_s": 1.5, "tool_names": ["x"]}]
            }
        )
    put(tmp_path, f"{where[0]}/inner/summary.json", {"task": "below a run"})
    put(tmp_path, "a/b/c/summary.json", {"task": "too deep"})
    c = logs.campaign(spark, str(tmp_path))
    assert rows(
        c, "run", "task", "model", "turn", "seed", "planning_prompt", "via_azure", "session_elapsed_s", "n_detected_files",
        "prompt_mode"
    ) == sorted((w.split("/")[-1], "t", "", 1, 0, False, False, 3.0, 2, "v") for w in where)
    assert rows(logs.campaign_turns(c), "session_id", "turn", "duration_s") == sorted((w.split("/")[-1], 0, 1.5) for w in where)


def test_campaign_filter(spark):
    r = [
        ("a", "claude-x", "", True, 1, True, True), ("b", "claude-x", "", False, 2, True, False),
        ("c", "qwen", "", False, 1, False, True)
    ]
    df = spark.createDataFrame(
        r,
        "task string, model string, provider string, planning_prompt boolean, turn int, has_thinking boolean, has_metrics boolean"
    )
    f = lambda **k: [x[0] for x in rows(logs.filter_campaign(df, **k), "task")]
    assert f() == ["a", "b", "c"] and f(task="a") == ["a"] and f(exclude_tasks=("a", "b")) == ["c"] and f(model="claude") == ["a", "b"]
    assert f(family="oss") == ["c"] and f(planning_prompt=False) == ["b", "c"] and f(turn=1, ill_defined=("a",)) == ["c"] and f(with_thinking=False) == ["c"] and f(has_metrics=True, with_thinking=True) == ["a"]


def test_replay_cells(spark, tmp_path):
    cell = {"cell": "x", "cold_elapsed_s": 2.0, "staged_elapsed_s": 1.0}
    put(tmp_path, "c1/results.json", json.dumps([cell, {"cell": "half", "cold_elapsed_s": 1.0}]))
    put(tmp_path, "_old/results.json", json.dumps([cell]))
    assert rows(logs.replay_cells(spark, str(tmp_path)), "campaign", "cell") == [("c1", "x")]


def test_measurements(spark, tmp_path):
    put(
        tmp_path, "a/m.json",
        {
            "mode": "cold", "n_samples": 2, "aggregate": {"full_read_ms": {"p50": 1.5, "max": 2.0}, "total_bytes": 30},
            "per_file": [{"path": "p", "size_bytes": 10, "full_read_ms": 1.0}, {"path": "q", "size_bytes": 20}]
        }
    )
    whole, files = logs.measurements(spark, f"{tmp_path}/*/m.json")
    assert rows(whole, "mode", "n_samples", "full_read_ms_p50", "full_read_ms_max", "total_bytes") == [("cold", 2, 1.5, 2.0, 30)]
    assert rows(files, "path", "size_bytes", "mode") == [("p", 10, "cold"), ("q", 20, "cold")]


def test_io_reports(spark, tmp_path):
    put(
        tmp_path, "task_m_s1/r.json",
        {
            "job_time": 9.0,
            "file_name_view": [
                {"file_name": "/data/a", "posix_count_sum": 2, "posix_read_size_sum": 5},
                {"file_name": "/output/b", "posix_count_sum": 2, "posix_read_size_sum": 5}, {"file_name": "/data/c"}
            ],
            "func_name_view": [
                {"func_name": "read", "posix_time_sum": 1.0}, {"func_name": "open", "posix_time_sum": 0.5},
                {"func_name": "read", "posix_time_sum": 2.0}, {}
            ]
        }
    )
    put(tmp_path, "task_m_s2/r.json", {"file_name_view": [], "func_name_view": []})
    r = spark.read.schema(logs.IO_REPORT).option("multiLine", True).json(f"{tmp_path}/*/r.json").withColumn("file", F.col("_metadata.file_path"))
    assert rows(logs.io_reads(r), "path", "bytes_read") == [("/data/a", 5)] and len(
        rows(logs.io_reads(r, outputs=True), "path")
    ) == 2
    t = {x["job_time"]: x for x in logs.io_totals(r).collect()}
    assert t[9.0]["n_files"] == 3 and t[9.0]["posix_s"] == 3.5 and t[9.0]["by_function"] == {"read": 2.0, "open": 0.5, "?": 0.0} and t[0.0]["by_function"] == {}
    assert logs.find_report(r, "task", "m", "s1").count() == 1 and logs.find_report(r, "task", "m", "s3").count() == 0
    with pytest.raises(Exception, match="file_name_view is not a list"):
        logs.io_reads(r.withColumn("file_name_view", F.lit(None).cast(r.schema["file_name_view"].dataType))).collect()


def test_staged_and_opened_paths(spark, tmp_path):
    e = lambda **k: {"cold_path": "/a", "size_bytes": 1, "outcome": "staged", "rule_id": "r"} | k
    put(
        tmp_path, "s.json",
        {"events": [e(), e(size_bytes=2, outcome="hit"), e(cold_path="/b", rule_id="forced"), e(cold_path="/c", outcome="error")]}
    )
    r = spark.read.schema(logs.STAGING).option("multiLine", True).json(f"{tmp_path}/s.json").withColumn("file", F.col("_metadata.file_path"))
    assert rows(logs.staged_paths(r, ("forced",)), "cold_path", "size_bytes", "outcome") == [("/a", 2, "hit")]
    u = spark.createDataFrame(
        [
            ("s", 0, 0, "open_file", ("/data/x", None)), ("s", 1, 0, "read_file", ("/data/y", None)),
            ("s", 2, 0, "open_file", ("/data/x", None)), ("s", 0, 1, "list_dir", ("/data/z", None)),
            ("s", 0, 2, "open_file", (None, None))
        ],
        "session_id string, turn int, seq int, name string, parsed_input struct<path:string,cmd:string>"
    )
    assert rows(logs.opened_paths(u, [("/data/", "/real/")]), "pos", "path", "turn") == [(0, "/real/x", 0), (1, "/real/y", 1)]


def test_text_logs_and_bandwidth(spark, tmp_path):
    put(tmp_path, "logs/a/run.txt", "hello\n  [tool] list_dir x\n[tool] open_file\n")
    put(tmp_path, "logs/b/run.txt", "[tools] no\n")
    got = logs.first_tool_line(spark, f"{tmp_path}/logs/*/*.txt").collect()
    assert [(r["first_tool"], r["parts"][-2]) for r in got] == [("list_dir", "a")]
    head = "host,tier,tool,op,mib_s\n"
    put(tmp_path, "b/t_1.csv", head + "h,ssd,ior,read,5\n")
    put(tmp_path, "b/t_2.csv", head + "h,ssd,ior,read,-\nh,ssd,ior,write,7\nh,ram,dd,read,8\nh,ram,ior,read,9\n")
    assert sorted(
        ((r["tier"], r["mib_s"]) for r in logs.tier_bandwidth(spark, f"{tmp_path}/b/*.csv").collect()), key=str
    ) == [("ram", "9"), ("ssd", None)]


def test_inventories(spark, tmp_path):
    for n, t in (("d/a.csv", "12"), ("d/e/b.csv", "123"), ("d/c.txt", "1"), ("d/e/x.bin", "1234")):
        put(tmp_path, n, t)
    of = lambda *g: [(p.rsplit("/", 1)[-1], b) for p, b in rows(logs.inventory(spark, f"{tmp_path}/d", *g), "path", "bytes")]
    assert sorted(of("*.csv", "a*", "*.txt")) == [("a.csv", 2), ("b.csv", 3), ("c.txt", 1)] and len(of()) == 4
    sized = S.with_sizes(
        spark.createDataFrame([("a",), ("z",)], "path string"),
        spark.createDataFrame([("a", 3), ("a", 5)], "path string, bytes long")
    )
    assert rows(sized, "path", "bytes") == [("a", 5), ("z", 0)]


def test_reencoding_and_sinks(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv.gz").write_bytes(gzip.compress(b"x,y\n1,2\n"))
    logs.reencode(spark, f"{tmp_path}/in/*.gz", f"{tmp_path}/out", header=True)
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "x", "y") == [("1", "2")]
    fired = spark.createDataFrame(
        [("s", 1, "r", "text", 1, 4), ("s", 0, "q", "thinking", 0, 2), ("t", 0, "q", "text", 0, 0)],
        "session_id string, block_seq int, name string, type string, turn int, match_start int"
    )
    tiers = spark.createDataFrame([("s", "/b", 1), ("s", "/a", 1), ("s", "/c", 3)], "session_id string, path string, tier int")
    events = spark.createDataFrame(
        [("k", 2, "/a", 5, 1.0, "staged"), ("k", 1, "/b", 6, 3.0, "staged"), ("k", 3, "/c", 7, 9.0, "hit")],
        "key string, t_completed long, cold_path string, size_bytes long, fetch_ms double, outcome string"
    )
    logs.write_reports(
        {"detection": logs.detection_report(fired, tiers), "staging": logs.staging_report(events, ["key"])},
        f"{tmp_path}/reports", "json"
    )
    d = {r["session_id"]: r for r in spark.read.json(f"{tmp_path}/reports/detection").collect()}
    assert [
        a["name"] for a in d["s"]["activations"]
    ] == ["q", "r"] and d["s"]["tier_1"] == ["/a", "/b"] and d["s"]["tier_3"] == ["/c"] and d["t"]["tier_1"] is None
    s = spark.read.json(f"{tmp_path}/reports/staging").first()
    assert [x["cold_path"] for x in s["events"]] == ["/b", "/a", "/c"] and (
        s["summary"]["n_staged"], s["summary"]["p50"], s["summary"]["p95"], s["summary"]["total_bytes_staged"]
    ) == (2, 2.0, 3.0, 11)


def test_robust_rule_sets(spark):
    loo = spark.createDataFrame(
        [("a", 0.9, 0.05, False), ("b", 0.7, 0.25, True), ("c", 0.9, 0.05, False)],
        "dropped string, recall double, delta double, load_bearing boolean"
    )
    assert tuple(S.robustness(loo).first()) == (0.7, 1, False)
    assert [r["dropped"] for r in S.top_rules(loo, 2).collect()] == ["b", "a"]


def test_projections_and_devices(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    p = L.projections(F.lit(10.0), F.lit(5.0))
    assert one(p["io_frac"]) == 0.5 and one(p["elim_speedup"]) == 2.0 and math.isclose(
        one(p["far_speedup"]), (5 + 5 * 754.5 / 35) / 5
    )
    assert one(L.projections(F.lit(0.0), F.lit(0.0))["io_frac"]) == 0.0
    dev = lambda fs, d, r: one(L.device_class(F.lit(fs), F.lit(d), F.lit(r).cast("boolean")))
    assert [
        dev("nfs4", "x", None), dev("ext4", "/dev/nvme0n1", False), dev("ext4", "/dev/sda1", False), dev("xfs", "/dev/sdb", True),
        dev("xfs", "123", True), dev("ext4", "/dev/sda", None)
    ] == ["network", "nvme", "ssd", "hdd", "unknown", "unknown"]
    benches = [("io_", "", "IO"), ("ml_", "integrity", "ML"), ("kb_", "", "KB")]
    bench = lambda t: one(L.bench_of(F.lit(t), benches, "rest"))
    assert [bench(t) for t in ("io_1", "ml_x", "kb_integrity", "kb_1", "z")] == ["IO", "ML", "ML", "KB", "rest"]
    bucket = lambda m, v: one(L.prompt_bucket(F.lit(m).cast("string"), F.lit(v).cast("string"), ("b",), ("p",)))
    assert [bucket("b", "p"), bucket("", "p"), bucket(None, None), bucket("x", "p")] == ["baseline", "pathful", None, None]


def test_choices(spark):
    calls = spark.createDataFrame([("s", 1, "no"), ("s", 2, "x"), ("t", 1, "no")], "session_id string, seq int, path string")
    events = spark.createDataFrame(
        [("s", 1, "y", "staged"), ("t", 1, "z", "error"), ("t", 2, "y", "hit"), ("u", 1, "no", "hit")],
        "session_id string, seq int, path string, outcome string"
    )
    inv = spark.createDataFrame([("x",), ("y",), ("z",)], "path string")
    assert rows(N.target_choice(calls, events, inv), "session_id", "path", "source") == [("s", "x", "tool"), ("t", "y", "staged")]
    trees = spark.createDataFrame(
        [("b", 2, "x\ny\n"), ("b", 1, "x\ny"), ("a", 3, "x"), ("c", 4, ""), ("d", 5, "x")], "domain string, task int, tree string"
    )
    assert rows(
        N.smallest_trees(trees, "domain", "task", "tree"), "domain", "task", "n_lines"
    ) == [("a", 3, 1), ("b", 1, 2), ("c", 4, 0)]
    f = spark.createDataFrame([("c", 1), ("b", 3), ("a", 3), ("a", 1), ("d", 2)], "path string, tier int")
    assert [r["path"] for r in N.first_samples(f, 2).collect()] == ["a", "c"]
    staged = N.staged_paths(
        spark.createDataFrame([("/a",), ("/b",)], "path string"), spark.createDataFrame([("/over/a",)], "path string"),
        ["/hot", "/over/"]
    )
    assert rows(staged, "path", "staged") == [("/a", True), ("/b", False)]


def test_thinking_falls_back_to_deltas(spark):
    b = spark.createDataFrame(
        [("a", "thinking", "xyz"), ("b", "text", "x"), ("c", "thinking", "")], "session_id string, type string, text string"
    )
    d = spark.createDataFrame([("a", "no"), ("b", "12345"), ("d", "1"), ("d", None)], "session_id string, delta string")
    assert rows(E.thinking_chars(b, d), "session_id", "thinking_chars") == [("a", 3), ("b", 5), ("c", 0), ("d", 1)]


def test_literals_across_blocks_and_within_words(spark):
    b = spark.createDataFrame(
        [
            ("s", 0, "text", "see xal"), ("s", 1, "text", "ph"), ("s", 2, "thinking", "a.csv, betab"),
            ("t", 0, "tool_use", "alpha.csv"), ("t", 1, "text", "é😀beta")
        ],
        "session_id string, block_seq int, type string, text string"
    )
    p = spark.createDataFrame([("k", "/d/alpha.csv"), ("k", "/e/beta.txt"), ("k", "/e/q.txt")], "bucket string, path string")
    assert rows(S.literal_scan(b, p), "session_id", "path", "start") == [
        ("s", "/d/alpha.csv", 5), ("s", "/e/beta.txt", 16), ("t", "/e/beta.txt", 2)
    ]
    assert S.literal_scan(b, p.limit(0)).count() == 0
    assert X.RULES


def test_packed_folders_read_as_folders_do(spark, tmp_path):
    """The same files, one by one and packed: blocks, runs, reports, measurements, tool lines and inventories are the same."""
    said = lambda t: "\n".join([json.dumps({"delta": t}), "broken {", json.dumps({"delta": "more"})])
    event = lambda **k: json.dumps({"block_idx": 0, "t_ms": 1.0, **k})
    files = {
        "t/r1/turns/turn_00/thinking.jsonl": said("a "), "t/r1/turns/turn_01/tool_result.jsonl": json.dumps({"content": "x\ny"}),
        "t/r1/turns/turn_01/other.jsonl": said("no"), "t/r1/turns/turn_01/stream.jsonl": "\r\n".join(
            [event(type="content_block_start", block_type="text"), event(type="content_block_delta", delta_type="text_delta", chunk="said")]
        ),
        "c/one/summary.json": json.dumps({"task": "a"}), "c/one/two/summary.json": json.dumps({"task": "below"}), "c/set/two/summary.json": json.dumps({"task": "b"}),
        "c/_x/summary.json": json.dumps({"task": "hidden"}), "c/a/b/c/summary.json": json.dumps({"task": "deep"}),
        "m/1.json": json.dumps({"mode": "cold", "per_file": [{"path": "p", "size_bytes": 1}]}), "m/2.json": "", "g/u/run.log": "no\n  [tool] view x\n[tool] click",
        "i/d/a.csv": "12é", "i/d/b.txt": "x", "i/1c.bin": "1"
    }
    df = spark.createDataFrame([(k, v) for k, v in files.items()], "path string, content string")
    logs.write_files(df, f"file://{tmp_path}/plain")
    part = {}
    for k in "tcmgi":
        own = df.where(F.col("path").startswith(f"{k}/")).select(F.substring("path", 3, 1000).alias("path"), "content")
        logs.pack_files(own, f"file://{tmp_path}/packed-{k}")
        part[k] = logs.packed(spark, f"file://{tmp_path}/packed-{k}")
    at = f"file://{tmp_path}/plain"
    both = lambda f, a, b, *c: (rows(f(spark, a).select(*c), *c), rows(f(spark, b).select(*c), *c))
    blocks = ("session_id", "block_seq", "turn", "type", "t_first", "t_stop", "text")
    pairs = [
        both(logs.turn_directory, f"{at}/t/*/turns/turn_*", part["t"], *blocks), both(logs.recorder_directory, f"{at}/t/*/turns/turn_*", part["t"], *blocks),
        both(logs.campaign, f"{at}/c", part["c"], "run", "task"), both(lambda s, x: logs.measurements(s, x)[1], f"{at}/m/*.json", part["m"], "mode", "path", "size_bytes"),
        both(logs.first_tool_line, f"{at}/g/*/run.log", part["g"], "first_tool")
    ]
    for folder, table in pairs:
        assert folder and folder == table
    name = lambda x: sorted((r["path"].rsplit("/", 1)[-1], r["bytes"]) for r in x.collect())
    for globs in ((), ("*.csv", "1*"), ("*.{csv,txt}",), ("[ab].*",)):
        assert name(logs.inventory(spark, f"{at}/i", *globs)) == name(logs.inventory(spark, part["i"], *globs))
