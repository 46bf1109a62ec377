"""Periodic runs against the definition."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from reasonlake.llm import periodic
from tests.llm.test_ops import empty, odd, words


def brute_runs(w, least=6, power=4):
    found = []
    for q in range(1, len(w) // power + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, power * q):
                own = w[i : i + length]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = words(text)
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w) if n < 500 else [tuple(r) for r in periodic.find_runs([[x.encode() for x in w]])[0]]
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    drop = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()
    )


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_the_definition(letters):
    r = random.Random(letters)
    texts = []
    for _ in range(400):
        w = [r.choice("abcdefgh"[:letters]) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            piece = [r.choice("abcdefgh"[:letters]) for _ in range(r.randint(1, 9))]
            at = r.randint(0, len(w))
            w = w[:at] + (piece * r.randint(2, 7))[: r.randint(1, 60)] + w[at:]
        texts.append([x.encode() for x in w])
    for least, power in ((6, 4), (1, 3), (10, 5)):
        assert periodic.find_runs(texts, least, power) == [brute_runs(t, least, power) for t in texts]


def test_runs_do_not_cross_texts():
    assert periodic.find_runs([[b"a"] * 5, [b"a"] * 5, [], [b"a"] * 6]) == [[], [], [], [(0, 6, 1)]]


def test_time_follows_the_length():
    """A text of one word, and one of a long period."""
    for text in ([b"a"] * 400_000, [b"%d" % (i % 50_000) for i in range(400_000)]):
        began = time.process_time()
        (runs,) = periodic.find_runs([text])
        assert len(runs) == 1 and time.process_time() - began < 20


def test_collapse_keeps_the_first_period():
    w = "x a b a b a b a b y".split()
    assert periodic.collapse(w, brute_runs(w)) == ["x", "a", "b", "y"]


def test_query_rows(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abc") if r.random() < 0.5 else "d" for _ in range(r.randint(0, 120)))) for i in range(300)]
    rows += [(None, "a a a a a a b"), (None, None), (7, "a a a a a a b"), (7, "a a a a a a b"), (400, None), (401, " \n ")]
    assert sum(i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 15
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in periodic.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((brute_row(*x) for x in rows), key=str)


def test_odd_rows(spark):
    """Nulls, blanks, repeats, a very long text and clashing columns; empty tables."""
    rows = odd(spark)
    got = periodic.periodic_runs(rows)
    assert set(got.columns) == set(rows.columns) | {"runs", "collapsed"}
    for x in got.collect():
        w = words(x.text)
        assert x.n_words == len(w)
        runs = brute_runs(w) if len(w) < 500 else [(0, 60_000, 977 * 13)]  # the long text comes back after so many words
        assert [tuple(y) for y in x.runs] == runs and (runs or x.collapsed == " ".join(w))
    assert periodic.periodic_runs(empty(spark)).count() == 0
    assert periodic.periodic_runs(rows.withColumn("runs", F.lit(1)).select("text", "runs")).columns == ["text", "n_words", "runs", "collapsed"]


def test_sql_gives_the_same_rows(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = periodic.op12_periodic_runs(spark, sf)
    want = con.execute(periodic.OP12_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
