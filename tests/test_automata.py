"""Text automata: resumable patterns against Python's search, dictionaries in parts, time that follows the text."""

import contextlib
import io
import random
import re
import time

import pytest

from reasonlake.operators import matching as M
from reasonlake.operators import scoring as S
from reasonlake.operators.automata import Follower, Literals, Pattern, pattern_of

BLOCK = "session_id string, block_seq int, turn int, type string, t_first double, t_stop double, text string"
RULE = "ord int, name string, pattern string, target_keys array<string>, origin string"

PATTERNS = [
    "a.*b", "foo|bar", r"\bab\b", "ab$", "^ab", "a{2,3}b?c", "(ab|ba)+", "[^a]b*a", r"a(?:b|c)*\b", r"\Bb", "(?m)^b", "(?m)a$", r"a\Z", "x*",
    "(?s)a.*b", "b+?a", "(?i:A)b", "é.", r"\w+\s\d", "a|$", r"ab\n"
]


def blocks_of(spark, rows):
    return spark.createDataFrame([(a, b, b, c, 0.0, 1.0, d) for a, b, c, d in rows], BLOCK)


def rules_of(spark, patterns):
    return spark.createDataFrame([(i, p, p, ["k"], "x") for i, p in enumerate(patterns)], RULE)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_find_what_search_finds(pattern):
    """In every prefix, and whether a match starts before a cut."""
    r, p, search = random.Random(pattern), pattern_of(pattern), re.compile(pattern, re.IGNORECASE).search
    for _ in range(1500):
        t = "".join(r.choice("abcABfoor \n1é") for _ in range(r.randint(1, 12)))
        state, gone = Pattern.START, False
        for e, c in enumerate(t, 1):
            state, accept = p.step(state, c)
            gone = gone or accept
            assert (gone or p.ends(state)) == (search(t[:e]) is not None), t[:e]
        cut = r.randint(0, len(t))
        f, m = Follower(p), search(t)
        f.feed(t[:cut])
        assert f.older(t[cut:]) == bool(m and m.start() < cut), (t, cut)


@pytest.mark.parametrize("pattern", [r"a(?=b)", r"(a)\1", "(?<!x)a", "(?:ab){2000,30000}"])
def test_patterns_without_automaton(pattern):
    assert pattern_of(pattern) is None


def test_pattern_memory_is_bounded(monkeypatch):
    from reasonlake.operators import automata

    monkeypatch.setattr(automata, "MOST_STATES", 5)
    p, f = Pattern("a.{3}b|c.{4}d"), None
    r = random.Random(1)
    for _ in range(200):
        t = "".join(r.choice("abcd") for _ in range(12))
        f = Follower(p)
        for c in t[:6]:
            f.feed(c)
            assert len(p.states) < 60
        m = re.search("a.{3}b|c.{4}d", t)
        assert f.older(t[6:]) == bool(m and m.start() < 6)


def test_literals_overlap():
    found = Literals([("abc", 1), ("bc", 2), ("bcd", 3), ("bc", 4), ("zz", 5)]).within("xabcd")
    assert found == {1, 2, 3, 4}
    assert Literals([]).within("abc") == set()


def transcript_loop(rows, patterns):
    want = set()
    for s in {x[0] for x in rows}:
        text, known = "", set()
        for _, seq, kind, t in sorted(x for x in rows if x[0] == s):
            if kind == "tool_use" or not t:
                continue
            base, text = len(text), text + t
            for p in patterns:
                m = re.search(p, text, re.IGNORECASE)
                if p not in known and m and m.start() >= base:
                    known.add(p)
                    want.add((s, p, seq, m.start(), base))
    return want


@pytest.mark.parametrize("most", [1, 4, 100])
def test_transcript_mode_keeps_all_rules(spark, monkeypatch, most):
    """Rules of bounded width, regular ones without bound and others, in one part and in many: none is lost."""
    monkeypatch.setattr(M, "MOST_RULES", most)
    r = random.Random(most)
    patterns = ["foo", "bar", "fo.*r", "o$", r"\bba", "(o|a)+r", "a(?!r)", "ba.{0,3}f", r"(o)\1", "o\n*b"]
    rows = [
        (f"s{s}", i, r.choice(["text", "thinking", "tool_result", "tool_use"]), "".join(r.choice(["f", "oo", "o", "b", "a", "r", " ", "\n"]) for _ in range(r.randint(0, 5))))
        for s in range(40) for i in range(7)
    ]
    got = M.first_fire(M.transcript_matches(blocks_of(spark, rows), rules_of(spark, patterns))).collect()
    assert {(x.session_id, x.name, x.block_seq, x.match_start, x.char_base) for x in got} == transcript_loop(rows, patterns)


@pytest.mark.parametrize("most", [2, 100])
def test_prefix_mode_in_parts(spark, monkeypatch, most):
    """Two rules of one name: the earlier firing counts. Matches that a word border ends stay in the prefix alone."""
    monkeypatch.setattr(M, "MOST_RULES", most)
    rows = [("s", 0, "thinking", "a HG000"), ("s", 1, "thinking", "1 far"), ("s", 2, "text", "x config.py"), ("s", 3, "thinking", "zz"), ("t", 0, "text", "far a"), ("t", 1, "thinking", "way")]
    rules = spark.createDataFrame([(0, "id", r"\bHG000\b"), (1, "id", "far"), (2, "cfg", r"config(?!\.py)"), (3, "way", "far.*w"), (4, "z", "z{2}")], "ord int, name string, pattern string")
    got = {(x.session_id, x.name, x.block_seq, x.first_known_at) for x in M.prefix_fire(blocks_of(spark, rows), rules).collect()}
    assert got == {("s", "id", 0, 7), ("s", "z", 3, 25), ("t", "id", 0, 5), ("t", "way", 1, 6)}


def planned(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("n", [10, 50_000])
def test_no_pairs_of_texts_and_rules_are_planned(spark, n):
    rules = spark.range(n).selectExpr("cast(id as int) as ord", "concat('r', id) as name", "concat('word', id, 'x') as pattern", "array('k') as target_keys", "'o' as origin")
    blocks = blocks_of(spark, [("s", i, "text", f"say word{i * 7}x twice") for i in range(200)])
    found = M.matches(blocks, rules)
    plan = planned(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(f"r{i * 7}", i) for i in range(200) if i * 7 < n}
    assert {(x.name, x.block_seq) for x in found.collect()} == want


def test_time_follows_the_transcript():
    """A session of 10,000 blocks: no block is searched with all that went before."""
    patterns = ["zq.*yq", r"\bqz\b", "qq{1,30}z", "q.*$"]

    def seconds(n):
        began, session = time.process_time(), M._Transcript(M.Rules([(i, p, p, ["k"]) for i, p in enumerate(patterns[:3])]))
        for i in range(n):
            assert not list(session.block(f"block {i} says nothing of note, and so on. "))
        return time.process_time() - began

    seconds(100)
    small, large = seconds(1000), seconds(10_000)
    assert large < 20 * max(small, 0.05)


def test_time_follows_the_prefixes():
    def seconds(n):
        began, session = time.process_time(), M._Prefixes(M.Rules([(0, "a", "zq.*yq", []), (1, "b", r"\bqz\b", [])]))
        for i in range(n):
            assert not list(session.block(f"thought {i} is about nothing. ", True))
        return time.process_time() - began

    seconds(100)
    small, large = seconds(500), seconds(5000)
    assert large < 20 * max(small, 0.05)


@pytest.mark.parametrize("most", [2, 100_000])
def test_needles_in_parts(spark, monkeypatch, most):
    """Paths and their names anywhere in a session's text, over several blocks too."""
    monkeypatch.setattr(S, "MOST_NEEDLES", most)
    r = random.Random(3)
    paths = [f"/d/{a}/{b}{c}.csv" for a in "xy" for b in "pq" for c in range(4)]
    prior = spark.createDataFrame([("k", p) for p in paths], "bucket string, path string")
    texts = {f"s{i}": "".join(r.choice([*paths, "p1", "q2.csv", "/d/x/", "p", "0.csv", " "]) for _ in range(r.randint(0, 6))) for i in range(40)}
    rows = []
    for s, t in texts.items():
        cuts = sorted(r.randint(0, len(t)) for _ in range(3))
        rows += [(s, i, "text", t[a:b]) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(t)], strict=True))]
    needles = {(x.path, x.needle) for x in S.needles_of(prior).collect()}
    want = {}
    for s, t in texts.items():
        for path, needle in needles:
            at = t.find(needle)
            if at >= 0:
                want[s, path] = min(at, want.get((s, path), at))
    got = {(x.session_id, x.path): x.start for x in S.literal_scan(blocks_of(spark, rows), prior).collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("most", [1, 100])
def test_rules_of_many_workloads_in_one_pass(spark, monkeypatch, most):
    """Blocks meet the rules of their own workload alone; blocks of none meet none."""
    monkeypatch.setattr(M, "MOST_RULES", most)
    rows = [("s", 0, "text", "foo bar", "a"), ("s", 1, "text", "foo bar", "b"), ("t", 0, "text", "foo bar", None), ("t", 1, "text", "foo", "c")]
    blocks = spark.createDataFrame(rows, "session_id string, block_seq int, type string, text string, workload string")
    rules = spark.createDataFrame([("a", 0, "x", "fo+", ["k"]), ("b", 0, "x", "ba.", ["k"]), ("b", 1, "y", "zzz", ["k"])], "workload string, ord int, name string, pattern string, target_keys array<string>")
    got = {(r.session_id, r.block_seq, r.workload, r.name, r.match_start) for r in M.matches(blocks, rules, workload="workload").collect()}
    assert got == {("s", 0, "a", "x", 0), ("s", 1, "b", "x", 4)}


def test_fingerprints_are_of_canonical_json(spark):
    import hashlib
    import json

    rules = [("b", 1, 'q"x', "\\bday\\b|/7/", ["k", "l"], "auto"), ("b", 0, "n", "a", [], "general"), ("a", 0, "n", "a", ["k"], "auto")]
    df = spark.createDataFrame(rules, "workload string, ord int, name string, pattern string, target_keys array<string>, origin string")
    prints = {}
    for w in "ab":
        own = [{"name": n, "pattern": p, "target_keys": t, "origin": o} for x, _, n, p, t, o in sorted(rules) if x == w]
        prints[w] = hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert {r.workload: r.fingerprint for r in M.fingerprint(df, ("workload",)).collect()} == prints
    one = M.library_fingerprint(df).first()
    assert one["fingerprint"] == hashlib.sha256("\n".join(f"{w}:{p}" for w, p in sorted(prints.items())).encode()).hexdigest() and one["n_rules"] == 3


def test_rows_meet_a_large_dictionary_once(spark, monkeypatch):
    """However many rules there are, a text is sent on once; rules without a literal, of equal entries and over chunks stay."""
    monkeypatch.setattr(M, "MOST_RULES", 100)
    words = [(i, f"r{i}", f"Word{i:04}x|say{i:04}", ["k"], "o") for i in range(2_000)]
    odd = [(5_000, "odd", "[0-9]+q", ["k"], "o"), (5_001, "twin", "word0007x", [], "o"), (5_001, "twin", "word0007x", [], "o"), (5_002, "short", "zé", [], "o")]
    rules = spark.createDataFrame(words + odd, "ord int, name string, pattern string, target_keys array<string>, origin string")
    blocks = blocks_of(spark, [("s", i, "text", f"a WORD{i * 7:04}x, ſay{i:04} 5q ZÉ") for i in range(200)])
    found = M.matches(blocks, rules)
    plan = planned(found)
    assert plan.count("(sequence(0, (__parts") == 1 and "sequence(0, 20" not in plan
    got = sorted((x.name, x.block_seq) for x in found.collect())
    want = [(f"r{i * 7}", i) for i in range(200)] + [(f"r{i}", i) for i in range(1, 200)] + [("odd", i) for i in range(200)] + [("short", i) for i in range(200)] + [("twin", 1)] * 2
    assert got == sorted(want)


def test_pieces_of_literals_are_found_in_texts():
    import numpy as np

    from reasonlake.operators import grams

    words = ["a", "né", "abc", "path", "doc_123.", "/data/a/doc_1234567.txt", "\U0001f600x\U0001f600y"]
    keys = grams.rarest(words, np.zeros(1 << grams.COUNTED, np.uint32))
    at = grams.bucket(keys, grams.SIEVE)
    sieve = np.zeros(1 << (grams.SIEVE - 6), np.uint64)
    np.bitwise_or.at(sieve, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    for word, key in zip(words, keys, strict=True):
        assert key in grams.sifted("??" + word + "!", sieve) and key in grams.sifted("q" * (grams.STEP - 2) + word, sieve)
    assert len(grams.sifted("qqqqqqqqqqqq", sieve)) == 0


def test_sessions_meet_many_needles_once(spark, monkeypatch):
    """However many needles there are, a session's text is sent on once; needles over the seam of two blocks are found."""
    monkeypatch.setattr(S, "MOST_NEEDLES", 50)
    prior = spark.createDataFrame([("k", f"/d/src{i % 7}/file_{i:04}.csv") for i in range(1_000)], "bucket string, path string")
    rows = [(f"s{i}", k, "text", t) for i in range(40) for k, t in enumerate([f"see file_{i * 9:04}", f".csv and /d/src{i % 7}/fi", f"le_{i:04}.csv"])]
    found = S.literal_scan(blocks_of(spark, rows), prior)
    plan = planned(found)
    assert plan.count("(sequence(0, (__parts") == 1 and "sequence(0, 39" not in plan
    got = {(x.session_id, x.path): x.start for x in found.collect()}
    want = {(f"s{i}", f"/d/src{i % 7}/file_{i:04}.csv"): 22 for i in range(40)}
    want |= {(f"s{i}", f"/d/src{i * 9 % 7}/file_{i * 9:04}.csv"): 4 for i in range(40)}
    assert got == want


def test_batches_are_matched_in_portions(spark):
    """Rows that many rules match are copied for a portion at a time, and none is lost."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    texts = ["x" * n for n in (5, M.PORTION_BYTES + 1, 1, 2)] + ["né"] * 2_500
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "text"]).slice(1)
    got = list(M.portions(b, 1))
    assert [i for x in got for i in x.column(0).to_pylist()] == list(range(1, len(texts))) and max(x.num_rows for x in got) == M.PORTION
    assert all(x.num_rows == 1 or sum(len(t.encode()) for t in x.column(1).to_pylist()) <= M.PORTION_BYTES for x in got)
    found = M.matches(blocks_of(spark, [("s", i, "text", "fo bar") for i in range(2_500)]), rules_of(spark, ["fo", "ba", "z"]))
    assert {(x.n, x.k) for x in found.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("block_seq").alias("k")).collect()} == {(2_500, 2_500)}
