"""Ordered scans in blocks and distributed selection, with tiny blocks, against plain loops."""

import math
import random
import statistics

import pytest

from reasonlake.functions import blocks as B
from reasonlake.functions import stats as T
from reasonlake.operators import cells as C
from reasonlake.operators import planning as N
from reasonlake.operators import sessions as S

ASKED = {f"{kind}_{int(p * 100)}": (kind, p) for kind in [*T.POSITIONS, *T.BETWEEN] for p in (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)}


def loop(values, kind, p):
    v = sorted(values)
    n = len(v)
    if kind in ("linear", "exclusive"):
        at = p * (n - 1) if kind == "linear" else max(0.0, min(n - 1.0, p * (n + 1) - 1))
        low = math.floor(at)
        high = min(low + 1, n - 1)
        return v[low] + (v[high] - v[low]) * (at - low)
    at = {
        "upper_median": n // 2, "nearest": max(0, min(n - 1, round(p * (n - 1)))), "floor_last": math.floor(p * (n - 1)),
        "floor_count": min(n - 1, math.floor(n * p)), "quarter": n // 4 if p < 0.5 else 3 * n // 4
    }[kind]
    return v[at]


@pytest.mark.parametrize("block,blocks", [(1_000_000, 1024), (7, 5), (1, 3)])
def test_percentiles_of_every_convention(spark, monkeypatch, block, blocks):
    """A large group of distinct values, one of equal ones, small ones and a null group: exact however small a block is."""
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "BLOCKS", blocks)
    r = random.Random(5)
    groups = {"big": [r.gauss(0, 100) for _ in range(400)], "same": [2.5] * 50, "one": [7.0], None: [1.0, 2.0, 2.0, 9.0], "few": [3.0, 1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("big", None), ("none", None)]
    r.shuffle(rows)
    asked = ASKED if block > 7 else {k: v for k, v in ASKED.items() if k.endswith(("_25", "_99"))}
    got = {x["g"]: x for x in T.position_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", asked).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, (kind, p) in asked.items():
            assert got[g][name] == pytest.approx(loop(vs, kind, p)), (g, name)


def test_percentiles_are_selected_in_one_round(spark, monkeypatch):
    """However many blocks of values there are, they are cut once: rounds that drop little each went on until cell numbers ran over."""
    monkeypatch.setattr(B, "BLOCK", 50)
    written = []
    staged = T.staged
    monkeypatch.setattr(T, "staged", lambda df, name: written.append(name) or staged(df, name))
    r = random.Random(6)
    groups = {g: [r.uniform(-1e6, 1e6) for _ in range(300)] for g in range(7)}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    asked = {k: ASKED[k] for k in ("nearest_25", "floor_last_50", "linear_75", "exclusive_99")}
    got = {x["g"]: x for x in T.position_percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", asked).collect()}
    assert len(written) <= 2
    for g, vs in groups.items():
        for name, (kind, p) in asked.items():
            assert got[g][name] == pytest.approx(loop(vs, kind, p)), (g, name)


def test_percentiles_without_groups(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 10)
    df = spark.range(300).selectExpr("cast(id as decimal(10, 2)) as v")
    got = T.position_percentiles(df, [], "v", {"a": ("floor_last", 0.5), "b": ("nearest", 0.99)}).first()
    assert (got["a"], got["b"]) == (149, 296)


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_running_sums(spark, monkeypatch, block):
    """Ties share a sum, or each row has its own; keys are null too."""
    monkeypatch.setattr(B, "BLOCK", block)
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 30), i, r.randint(1, 9)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, x int, i int, n int")
    for x in B.running(df, ["k"], ["x"], {"n": "n"}).collect():
        own = [q for q in rows if q[0] == x.k]
        assert (x.upto_n, x.total_n) == (sum(q[3] for q in own if q[1] <= x.x), sum(q[3] for q in own))
    for x in B.running(df, ["k"], ["x", "i"], {"n": "n"}, strict=True).collect():
        assert x.upto_n == sum(q[3] for q in rows if q[0] == x.k and (q[1], q[2]) < (x.x, x.i))


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_queues_in_blocks(spark, monkeypatch, block):
    """Blocks of three rows give the delivery times of the loop."""
    monkeypatch.setattr(B, "BLOCK", block)
    r = random.Random(7)
    rows, t = [], {}
    for i in range(150):
        q = r.choice("abc") if i < 100 else "a"
        t[q] = t.get(q, 0) + r.choice([0, 1, 5, 20])
        rows.append((q, i, float(t[q]), float(r.randint(1, 9))))
    free, want = {}, {}
    for q, i, emit, proc in rows:
        free[q] = max(emit, free.get(q, emit)) + proc
        want[i] = (free[q], free[q] - emit)
    got = C.delivery(spark.createDataFrame(rows, "q string, i int, emit double, proc double"), ["q"], "i", "emit", "proc")
    assert {x.i: (x.recv, x.delay) for x in got.collect()} == want


@pytest.mark.parametrize("block", [1_000_000, 4])
def test_retention_in_blocks(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(B, "BLOCK", block)
    r = random.Random(3)
    rows = [(r.choice("hk"), r.randint(0, 20), f"/p{i}", r.randint(1, 50)) for i in range(80)]
    got = {x.path: (x.evict, x.possible) for x in N.retention(spark.createDataFrame(rows, "h string, atime int, path string, bytes int"), ["h"], ["atime", "path"], F.lit(300)).collect()}
    for h in "hk":
        used = 0
        own = sorted((q for q in rows if q[0] == h), key=lambda q: (q[1], q[2]))
        for _, _, path, n in own:
            assert got[path] == (used < 300, sum(q[3] for q in own) >= 300)
            used += n


@pytest.mark.parametrize("block", [1_000_000, 5])
def test_distributions_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    r = random.Random(4)
    rows = [(r.choice("gh"), r.choice("xy"), r.randint(0, 40)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, side string, v int")
    for x in C.ecdf(df, ["g"], "v").collect():
        own = [q[2] for q in rows if q[0] == x.g]
        assert (x.n, x.ecdf) == (own.count(x.v), pytest.approx(sum(v <= x.v for v in own) / len(own)))
    for x in C.ks_statistic(df, ["g"], "side", "x", "y", "v").collect():
        a, b = ([q[2] for q in rows if q[:2] == (x.g, s)] for s in "xy")
        share = lambda vs, at: sum(v <= at for v in vs) / len(vs)
        assert x.ks == pytest.approx(max(abs(share(a, at) - share(b, at)) for at in range(41)))


def test_against_the_exact_median(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 5)
    rows = [("k", "base", float(i * i % 37)) for i in range(40)] + [("k", "other", 12.0)]
    got = S.against_median(spark.createDataFrame(rows, "k string, m string, v double"), ["k"], "m", "base", "v").first()
    median = statistics.median(v for _, m, v in rows if m == "base")
    assert got["base_median"] == median and got["overhead_pct"] == pytest.approx((12.0 - median) / max(1.0, median) * 100)


def test_speedups_count_values_before_sets_repeat_them(spark, monkeypatch):
    """Equal ratios come to the sets as one row with their count; cells are read once."""
    seen = []
    of = T.position_percentiles
    monkeypatch.setattr(T, "position_percentiles", lambda df, *a: seen.append(df.count()) or of(df, *a))
    rows = [("t", "m", float(2 + i % 2), 1.0) for i in range(9)] + [("t", None, 8.0, 2.0), ("u", "m", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "task string, model string, cold_amt double, staged_amt double")
    got = {(r["task"], r["model"], r["n"]): r["med"] for r in C.speedup_block(df, [["task"], ["task", "model"], []]).collect()}
    assert got == {("t", None, 10): 2.5, ("u", None, 1): 0.5, ("t", "m", 9): 2.0, ("t", None, 1): 4.0, ("u", "m", 1): 0.5, (None, None, 11): 2.0}
    assert seen == [12]
