"""Hand-made rows for operators whose traps the oracle tables do not show."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from reasonlake.functions import labels as L
from reasonlake.functions import paths as P
from reasonlake.functions import stats as T
from reasonlake.operators import cells as C
from reasonlake.operators import matching as M
from reasonlake.operators import planning as N
from reasonlake.operators import scoring as S
from reasonlake.operators import sessions as E
from reasonlake.sources import logs
from reasonlake.streaming import live


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_prefixes_in_order(spark):
    pairs = [("/data/a", "/one"), ("/data/a/b", "/two")]
    assert one(spark, P.resolve(F.col("p"), pairs), p="/data/a/b/c") == "/one/b/c"
    assert one(spark, P.resolve(F.col("p"), pairs), p="/else") == "/else"
    assert one(spark, P.resolve_under(F.col("p"), [("/data/w/", "/x/")], "/cold"), p="/data") == "/cold"
    assert one(spark, P.resolve_under(F.col("p"), [("/data/w/", "/x/")], "/cold"), p="/data/v/f") == "/cold/v/f"
    assert one(spark, P.resolve_under(F.col("p"), [("/data/w/", "/x/")], "/cold"), p="/data/w") == "/cold"


def test_names(spark):
    assert one(spark, P.stem(F.col("p")), p="/a/.bashrc") == ""
    assert one(spark, P.stem(F.col("p")), p="/a/x.tar.gz") == "x.tar"
    assert one(spark, P.under_root(F.col("p"), F.lit("/cold")), p="/coldX/f") is False
    assert one(
        spark, P.path_tokens(F.col("t")), t="see /data/a/b.csv, xdata/c.csv and data/d.nc; data/e"
    ) == ["data/a/b.csv", "data/d.nc"]
    assert one(
        spark, P.listing_files(F.col("t")), t="  FILE  /a/b.nc  (12 bytes)\n  DIR  /a/\nFILE x (1 bytes)"
    ) == ["/a/b.nc", "x"]
    assert one(spark, P.companion_names(F.col("p")), p="/a/x.vcf.gz")[:2] == ["/a/x.vcf.gz.tbi", "/a/x.vcf.tbi"]
    assert one(spark, P.child_of(F.lit("/data/"), F.col("p")), p="/data/w/raw") == "w"
    assert one(spark, P.child_of(F.lit("/data/w"), F.col("p")), p="/data/w") is None


def test_tiers_and_decisions(spark):
    for n, offline, live_ in ((10, 1, 1), (11, 1, 2), (20, 1, 2), (21, 2, 2), (200, 2, 2), (201, 3, 3)):
        assert one(spark, L.tier(F.lit(n))) == offline
        assert one(spark, L.tier(F.lit(n), L.LIVE)) == live_
    d = lambda *a: one(spark, L.stage_decision(*[F.lit(x) for x in a]))["reason"]
    assert d("/a", None, 1.0, None) == "no tiers"
    assert d(None, "/hot", 1.0, 0.0) == "unknown source tier"
    assert d("/hot", "/hot", 1.0, None) == "already hot"
    assert d("/a", "/hot", 5.0, 4.0) == "cost over slack"
    assert d("/a", "/hot", 5.0, None) == "ok"
    assert one(spark, L.stage_cost_ms(F.lit(1.0), F.lit(0.0), F.lit(5))) == float("inf")
    assert one(spark, L.provider_family(F.lit("azure"), F.lit("Claude-x"))) == "anthropic"


def test_rule_patterns(spark):
    def pattern(key):
        label, instance = M.class_and_instance(F.col("k"))
        return one(spark, M.instance_pattern(label, instance), k=key)

    assert pattern("band_08") == r"\bband[- _]?0?8\b|\b08\b"
    assert pattern("sample_HG00096") == r"\bsample[- _]?HG00096\b|\bHG00096\b"
    assert pattern("subject_sub-Cori") == r"\bsubject[- _]?sub\-Cori\b|\b(?:sub\-Cori|Cori)\b"
    assert pattern("day_122") == r"\bday[- _]?122\b|\b122\b|/122/"
    assert pattern("other") == r"\bother\b"
    assert one(spark, M.format_alternation(F.col("t")), t="netCDF and csv since CSV") == "netCDF|nc|CSV|file"
    assert one(spark, M.format_alternation(F.col("t")), t="nothing") == "file"


def test_generated_rules_are_ordered(spark):
    w = spark.createDataFrame([("w", "Make out.csv of all bands")], "workload string, task string")
    b = spark.createDataFrame(
        [("w", i, k) for i, k in enumerate(["all_bands", "band_01", "output_csv", "output_report"])],
        "workload string, pos int, bucket string"
    )
    r = M.auto_rules(w, b).orderBy("ord").collect()
    assert [x["name"] for x in r] == [
        "first_inspect", "all_signal", "band_01", "output_csv_signal", "output_report_signal", "report_out"
    ]
    assert r[0]["target_keys"] == ["all_bands"] and r[5]["target_keys"] == []
    assert r[3]["pattern"] == r"out\.csv" and r[4]["pattern"] == r"\.report\b"


@pytest.mark.parametrize(
    "pattern,texts",
    [
        ("all|each", ["all", "each"]),
        ("(?i)sch", ["sch"]),
        ("(a|b)c", None),
        (r"start.{0,3}with", ["start"]),
        (r"\bx\b", None),
        ("abcd{0,1} x", ["abc"]),
        (r"\x41bcd", ["abcd"]),
        (r"\0101bc", None),
        (r"\Qab.c\E", None),
        ("(?:foo|ba+r)baz?", ["ba"]),
    ],
)
def test_literals(pattern, texts):
    assert M.literals_of(pattern) == texts


def made_pattern(r, depth=3):
    """A pattern at random: words, groups, alternatives, classes and all kinds of repeats."""
    kind = r.random()
    if depth == 0 or kind < 0.35:
        return r.choice(["ab", "abc", "k", "s", "ist", "c", r"\x41", r"a\.b", "i"])
    if kind < 0.5:
        return f"(?:{made_pattern(r, depth - 1)}|{made_pattern(r, depth - 1)})"
    if kind < 0.6:
        return r.choice(["[abc]", "[^a]", ".", r"\b", r"\w", "a{0,1}", "b{2}", "(?=a)"])
    if kind < 0.75:
        return f"(?:{made_pattern(r, depth - 1)}){r.choice(['?', '*', '+', '{0,2}', '{1,3}', '{2}', '??'])}"
    return made_pattern(r, depth - 1) + made_pattern(r, depth - 1)


def test_literals_never_lose_a_match():
    r = random.Random(3)
    fixed = [
        "all|each|every", "(?i)(the|le).{0,30}one", r"iterate.{0,4}file", r"report\.md", r"colou?r data", r"x+yzz[ab]c", "eau",
        "abcd{0,1} x"
    ]
    told = 0
    for i in range(4000):
        p = fixed[i % 8] if i % 5 == 0 else made_pattern(r)
        lits = M.literals_of(p)
        for _ in range(6):
            text = "".join(
                r.choice(
                    [
                        "all", "each ", "the", "one", "iterate", "file", "report.md", "colour data", "ab", "abc", "k", "s", "ist",
                        "a.b", "A", " x", "i", "q"
                    ]
                ) for _ in range(5)
            )
            if lits is not None and re.search(p, text, re.IGNORECASE):
                told += 1
                assert any(x in text.lower() for x in lits), (p, text)
    assert told > 500


def test_no_match_is_lost_to_folding(spark):
    words = ["abc x", "\u017ftart", "m\u0131st", "M\u0130ST", "\u212aelvin", "Start", "none"]
    blocks = spark.createDataFrame(
        [("s", i, 0, "text", 0.0, 1.0, w) for i, w in enumerate(words)],
        "session_id string, block_seq int, turn int, type string, t_first double, t_stop double, text string"
    )
    rules = spark.createDataFrame(
        [(i, p, p, ["k"], "x") for i, p in enumerate(["abcd{0,1} x", "start", "mist", "kelvin"])],
        "ord int, name string, pattern string, target_keys array<string>, origin string"
    )
    found = {(r["name"], r["text"]) for r in M.matches(blocks, rules).collect()}
    all_pairs = {(r["name"], r["text"]) for r in blocks.join(rules, F.expr("text rlike concat('(?iud)', pattern)")).collect()}
    assert found == all_pairs and ("abcd{0,1} x", "abc x") in found and ("start", "\u017ftart") in found


def test_many_rules_are_matched_too(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_RULES", 3)
    blocks = spark.createDataFrame(
        [("s", i, 0, "text", 0.0, 1.0, f"word{i}") for i in range(6)],
        "session_id string, block_seq int, turn int, type string, t_first double, t_stop double, text string"
    )
    rules = spark.createDataFrame(
        [(i, f"r{i}", f"word{i}", ["k"], "x") for i in range(6)],
        "ord int, name string, pattern string, target_keys array<string>, origin string"
    )
    assert sorted((r["name"], r["block_seq"]) for r in M.matches(blocks, rules).collect()) == [(f"r{i}", i) for i in range(6)]


def test_transcript_mode_is_that_of_the_joined_text(spark):
    r = random.Random(9)
    patterns = ["band", "ab.{0,4}c", r"\bab\b", "a+b", "x$", "b{2,3}c"]
    rows = [
        (
            f"s{s}", i, r.choice(["text", "thinking", "tool_result", "tool_use"]),
            "".join(r.choice(["a", "b", "c", "ba", "nd", " ", "x"]) for _ in range(r.randint(0, 5)))
        ) for s in range(60) for i in range(6)
    ]
    blocks = spark.createDataFrame(
        [(a, b, b, c, 0.0, 1.0, d) for a, b, c, d in rows],
        "session_id string, block_seq int, turn int, type string, t_first double, t_stop double, text string"
    )
    rules = spark.createDataFrame(
        [(i, p, p, ["k"], "x") for i, p in enumerate(patterns)],
        "ord int, name string, pattern string, target_keys array<string>, origin string"
    )
    want = set()
    for s in {x[0] for x in rows}:
        text, known = "", set()
        for _, seq, kind, t in sorted(x for x in rows if x[0] == s):
            if kind == "tool_use" or not t:
                continue
            base, text = len(text), text + t
            for p in patterns:
                m = re.search(p, text)
                if p not in known and m and m.start() >= base:
                    known.add(p)
                    want.add((s, p, seq, m.start()))
    got = {
        (
            x["session_id"], x["name"], x["block_seq"], x["match_start"]
        ) for x in M.first_fire(M.transcript_matches(blocks, rules)).collect()
    }
    assert got == want


def test_fingerprints_differ_by_pattern(spark):
    rule = lambda *p: spark.createDataFrame([(i, "r", x, ["k"], "o") for i, x in enumerate(p)], "ord int, name string, pattern string, target_keys array<string>, origin string")
    prints = {M.fingerprint(rule(*p)).first()["fingerprint"] for p in (("a",), ("b",), ("a", "b"), ("b", "a"))}
    assert len(prints) == 4 and M.fingerprint(rule("a")).first()["fingerprint"] in prints


def test_transcript_mode_suppresses_straddles(spark):
    rows = [
        ("s", 0, "text", "ba"), ("s", 1, "text", "nd then band"), ("t", 0, "text", "x"), ("t", 1, "tool_use", "band"),
        ("t", 2, "thinking", "a band")
    ]
    blocks = spark.createDataFrame(
        [(a, b, b, c, 0.0, 1.0, d) for a, b, c, d in rows],
        "session_id string, block_seq int, turn int, type string, t_first double, t_stop double, text string"
    )
    rules = spark.createDataFrame(
        [(0, "r", "band", ["k"], "x")], "ord int, name string, pattern string, target_keys array<string>, origin string"
    )
    local = {(r["session_id"], r["block_seq"]) for r in M.first_fire(M.matches(blocks, rules)).collect()}
    exact = {(r["session_id"], r["block_seq"]) for r in M.first_fire(M.transcript_matches(blocks, rules)).collect()}
    assert local == {("s", 1), ("t", 2)} and exact == {("t", 2)}


def test_offsets_are_code_points(spark):
    blocks = spark.createDataFrame(
        [("s", 0, 0, "text", 0.0, 1.0, "😀é band")],
        "session_id string, block_seq int, turn int, type string, t_first double, t_stop double, text string"
    )
    rules = spark.createDataFrame(
        [(0, "r", "BAND", ["k"], "x")], "ord int, name string, pattern string, target_keys array<string>, origin string"
    )
    assert M.matches(blocks, rules).first()["match_start"] == 3


def test_byte_score_of_empty_truth(spark):
    p = spark.createDataFrame([("k", "/a", 5), ("k", "/a", 5)], "k string, path string, bytes long")
    t = spark.createDataFrame([], "path string, bytes long")
    r = S.byte_score(p, t, ["k"]).first()
    assert (r["n_detected"], r["byte_recall"], r["byte_overfetch"], r["file_precision"]) == (1, 0.0, float("inf"), 0.0)


def test_longest_mount(spark):
    m = spark.createDataFrame([("/", 1), ("/a", 2), ("/a/b", 3)], "mount string, n int")
    f = spark.createDataFrame([("/a/b/c",), ("/ab",), ("/a",)], "path string")
    assert {r["path"]: r["n"] for r in S.longest_prefix(f, m).collect()} == {"/a/b/c": 3, "/ab": 1, "/a": 2}


def test_literal_scan_needs_unique_names(spark):
    b = spark.createDataFrame(
        [("s", 0, "text", "open x.csv then /d/2/y.csv."), ("s", 1, "text", " and w")],
        "session_id string, block_seq int, type string, text string"
    )
    p = spark.createDataFrame(
        [("k", "/d/1/x.csv"), ("k", "/d/1/y.csv"), ("k", "/d/2/y.csv"), ("output_a", "/d/3/w.csv"), ("k", "/output/z.csv")],
        "bucket string, path string"
    )
    assert {(r["path"], r["start"]) for r in S.literal_scan(b, p).collect()} == {("/d/1/x.csv", 5), ("/d/2/y.csv", 16)}


def test_sources_and_companions(spark):
    inv = spark.createDataFrame(
        [("/a", 10, None), ("/b.gz", 10, 50), ("/c.gz", 10, 5), ("/c.xz", 3, None), ("/x.bam.bai", 1, None)],
        "path string, bytes long, trailer long"
    )
    got = {
        r["path"]: (r["source"], r["size_bytes"]) for r in S.source_of(
            spark.createDataFrame([("/a",), ("/b",), ("/c",), ("/d",)], "path string"), inv
        ).collect()
    }
    assert got == {"/a": ("/a", 10), "/b": ("/b.gz", 50), "/c": ("/c.gz", 40), "/d": (None, None)}
    assert [
        tuple(r) for r in S.companions(spark.createDataFrame([("/x.bam",)], "path string"), inv).collect()
    ] == [("/x.bam", "/x.bam.bai")]


def test_placement_lets_small_files_in_later(spark):
    f = spark.createDataFrame(
        [("h", 1, "a", 6), ("h", 2, "b", 5), ("h", 3, "c", 4)], "host string, ord int, path string, bytes long"
    )
    assert {r["path"]: r["primary"] for r in N.placement(f, ["host"], "ord", 10).collect()} == {"a": True, "b": False, "c": True}


def test_queue_identity(spark):
    random.seed(1)
    rows, t, last, want = [], 0.0, 0.0, {}
    for i in range(60):
        t += random.randint(0, 9)
        p = random.randint(0, 12)
        last = max(t, last) + p
        want[i] = last
        rows.append(("q", i, float(t), float(p)))
    got = C.delivery(spark.createDataFrame(rows, "q string, i int, emit double, proc double"), ["q"], "i", "emit", "proc")
    assert {r["i"]: r["recv"] for r in got.collect()} == pytest.approx(want)


def test_percentile_conventions(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(1, 11)], "g string, v double")
    r = T.position_percentiles(
        df, ["g"], "v", {"a": ("upper_median", 0.5), "b": ("nearest", 0.95), "c": ("floor_count", 0.95), "d": ("quarter", 0.75)}
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (6.0, 10.0, 10.0, 8.0)


def test_amdahl_without_shell(spark):
    cols = L.amdahl(F.lit(10.0), F.lit(5.0), F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()
    assert (r["ceiling"], r["efficiency"], r["shell_speedup"]) == (1.0, 2.0, 1.0)


def test_slack_stops_at_first_tool(spark):
    rows = [
        ("a", 0, "thinking", 5.0), ("a", 1, "tool_use", 9.0), ("b", 0, "tool_use", 1.0), ("b", 1, "thinking", 2.0),
        ("b", 2, "tool_use", 7.0)
    ]
    df = spark.createDataFrame(rows, "session_id string, block_seq int, type string, t_first double")
    assert {r["session_id"]: r["slack_ms"] for r in E.slack(df).collect()} == {"a": 4.0, "b": None}


def test_gemini_and_shape(spark):
    rows = [
        ("s", 0, "thinking_delta", 1.0, "he", None, None), ("s", 1, "text_delta", 2.0, "", None, None),
        ("s", 2, "function_call", 3.0, None, "f", "{}"), ("s", 3, "thinking_delta", 4.0, "y", None, None)
    ]
    e = spark.createDataFrame(
        rows, "session_id string, seq long, event string, t_ms double, chunk string, tool_name string, args string"
    )
    got = [(r["type"], r["text"]) for r in logs.gemini_blocks(e).orderBy("block_seq").collect()]
    assert got == [("thinking", "hey"), ("tool_use", "{}")]
    assert logs.stream_shape(e).first()["shape"] == "gemini"


def test_log_reader_skips_broken_lines(spark, tmp_path):
    d = tmp_path / "run1" / "turns" / "turn_03"
    d.mkdir(parents=True)
    (d / "thinking.jsonl").write_text('{"delta": "a"}\nnot json\n\n{"delta": "b"}\n')
    (d / "text.jsonl").write_text('{"delta": "c"}\n')
    (d / "tool_result.jsonl").write_text('{"content": "x"}\n{"content": "y"}\n')
    b = logs.turn_directory(spark, f"{tmp_path}/*/turns/*", result_turn="next").orderBy("block_seq").collect()
    assert [(r["session_id"], r["turn"], r["type"], r["text"]) for r in b] == [
        ("run1", 3, "thinking", "ab"), ("run1", 3, "text", "c"), ("run1", 4, "tool_result", "x\ny")
    ]


def test_tree(spark):
    tree = "|-- a/\n|---- x.csv\n|---- b/\n|------ y.csv\n|-- z.csv"
    df = spark.createDataFrame([(1, tree)], "id int, tree string")
    got = [(r["path"], r["is_dir"]) for r in logs.tree_paths(df).orderBy("pos").collect()]
    assert got == [("a", True), ("a/x.csv", False), ("a/b", True), ("a/b/y.csv", False), ("z.csv", False)]


def test_live_firing_does_not_depend_on_arrival(spark, tmp_path):
    deltas = [
        ("s", "0", 0.0, 0, "thinking", "ba"), ("s", "0", 1000.0, 1, "thinking", "nd 08 now"),
        ("u", "0", 500.0, 0, "text", "band 08"), ("zz", "0", 900000.0, 0, "text", "end")
    ]
    schema = "session_id string, block string, t_ms double, seq long, kind string, chunk string, event_ts timestamp"
    src = tmp_path / "in"
    for n, part in enumerate(([deltas[1]], [deltas[2], deltas[0]], [deltas[3]])):
        rows = [(*d, dt.datetime.fromtimestamp(1_700_000_000 + d[2] / 1000, dt.timezone.utc)) for d in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = live.fire_live(
        stream, [("band", r"band\s*08")], delay="100 seconds", idle_ms=1000
    ).writeStream.format("memory").queryName("fired_live").outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ck")
    ).start()
    q.awaitTermination()
    got = {(r["session_id"], r["name"], r["fired_at_ms"], r["match_start"]) for r in spark.table("fired_live").collect()}
    assert got == {("s", "band", 1000.0, 0), ("u", "band", 500.0, 0)}


def test_prefix_firing_is_that_of_every_prefix(spark):
    r = random.Random(9)
    rules = [("id", r"\bHG000\b"), ("conf", r"\bconfig\b(?!\.py)"), ("all", "all|each"), ("far", "b.{0,3}d")]
    rows = [
        (
            f"s{s}", i, i, r.choice(["thinking", "text", "tool_result"]),
            "".join(
                r.choice(["HG000", "HG0001 ", "config", ".py", "all", "eac", "h", "b", "d", " "]) for _ in range(r.randint(1, 6))
            )
        ) for s in range(40) for i in range(4)
    ]
    want = set()
    for s in {x[0] for x in rows}:
        text, known = "", set()
        for _, i, _, kind, t in sorted(x for x in rows if x[0] == s):
            for name, p in rules:
                if name not in known and kind == "thinking":
                    for e in range(1, len(t) + 1):
                        if re.search(p, text + t[:e], re.IGNORECASE):
                            want.add((s, name, i, len(text) + e))
                            known.add(name)
                            break
                elif name not in known and (m := re.search(p, text + t, re.IGNORECASE)) and m.start() >= len(text):
                    want.add((s, name, i, len(text) + len(t)))
                    known.add(name)
            text += t
    df = spark.createDataFrame(rows, "session_id string, block_seq int, turn int, type string, text string")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "ord int, name string, pattern string")
    assert {(x["session_id"], x["name"], x["block_seq"], x["first_known_at"]) for x in M.prefix_fire(df, table).collect()} == want
