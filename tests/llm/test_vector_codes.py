"""Vector codes against plain loops over the definition."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reasonlake.llm import vector_codes
from tests.llm.test_ops import empty


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) of each (vec_id, label, vector)."""
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, kept[j][2]))[:entries]
    books = [[list(cut[j][p]) for j in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, xs in groups.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    out, sums = [], {}
    for (i, lab, _), c in zip(kept, cut, strict=True):
        got = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in got)
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, lab, "".join(f"{k:02x}" for _, k in got), error))
    print_ = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, sums[lab], print_) for i, lab, code, error in out]


def table(spark, rows, path):
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")


def same(spark, rows, path):
    rows = [(i, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    table(spark, rows, path)
    got = [tuple(r) for r in vector_codes.op13_vector_codes(spark, str(path)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("seed,spread", [(1, 0.1), (2, 0.01), (3, 30.0)])
def test_codes_equal_brute_force(spark, tmp_path, seed, spread):
    """Small spreads make many ties, and entries that nobody uses."""
    r = random.Random(seed)
    rows = [(r.randrange(400) * 2 if seed > 1 else i, r.choice([None, 1, 2]), [r.gauss(0, spread) for _ in range(32)]) for i in range(300)]
    rows += rows[:20]
    r.shuffle(rows)
    same(spark, rows, tmp_path)


def test_odd_rows(spark, tmp_path):
    """Null ids and labels, null, empty and non-finite vectors, repeats; fewer rows than entries."""
    v = [i / 7 for i in range(16)]
    rows = [(None, None, v), (1, None, v[::-1]), (1, 2, v), (1, 2, v), (3, 4, None), (4, 4, []), (5, 4, [*v[:15], None]), (6, 4, [*v[:15], float("nan")]), (7, 4, [*v[:15], float("-inf")]), (8, 4, [-x for x in v])]
    same(spark, rows, tmp_path)


def test_other_lengths_and_clashing_names(spark):
    """Vectors of another length than the first one are dropped; all columns but the vector stay."""
    rows = [(2, [0.5] * 16, 1, "x"), (1, [0.25] * 32, 2, "y"), (3, [0.25] * 32, None, None), (0, [0.25] * 7, 4, "z"), (5, [1e30] * 32, 4, "far")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int, `a b` string")
    got, books = vector_codes.vector_codes(df)
    assert got.columns == ["vec_id", "a b", "code", "error"] and books.shape == (16, 3, 2)
    assert sorted((r.vec_id, r["a b"], r.error) for r in got.collect()) == [(1, "y", 0), (3, None, 0), (5, "far", 0)]


def test_empty_tables(spark, tmp_path):
    table(spark, [], tmp_path)
    assert vector_codes.op13_vector_codes(spark, str(tmp_path)).count() == 0
    none = vector_codes.vector_codes(empty(spark).withColumn("embedding", F.array(F.lit(None).cast("float"))), id_column="doc_id")[0]
    assert none.count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bounds_hold_and_save_work(seed):
    """Bounds never exceed distances, assignments are exact after every move, and few rows are compared with all entries when entries move little."""
    r = np.random.default_rng(seed)
    x, entries = r.integers(-60, 60, (2000, 4)), r.integers(-60, 60, (64, 4))
    b, _ = vector_codes.Bounds.fresh(x, entries, 8)
    most = 0
    for _ in range(6):
        before, entries = entries, entries + r.integers(-2, 3, entries.shape)
        moved = vector_codes._high_root(((entries - before) ** 2).sum(axis=1))
        best, used, all_ = b.move(x, entries, moved)
        d = vector_codes._squares(x, entries)
        assert (b.near[:, 0] == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        kept = np.take_along_axis(d, b.near.astype(int), 1)
        assert (b.lower**2 <= kept).all() and (np.diff(b.lower, axis=1) >= 0).all() and (b.lower[:, -1] <= b.outer).all()
        np.put_along_axis(d, b.near.astype(int), 1 << 60, 1)
        assert (b.outer**2 <= d.min(axis=1)).all()
        most = max(most, all_)
        b.keep(max(4, used))
    assert most < 1500


def test_exact_roots():
    d = np.array([0, 1, 2, 3, 4, (1 << 30) ** 2, (1 << 30) ** 2 - 1, (1 << 30) ** 2 + 1, (1 << 62) - 1], np.int64)
    low, high = vector_codes._low_root(d), vector_codes._high_root(d)
    assert all(a * a <= v <= c * c for a, v, c in zip(low.tolist(), d.tolist(), high.tolist(), strict=True))


def test_sql_gives_the_same_rows(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = vector_codes.op13_vector_codes(spark, sf)
    want = con.execute(vector_codes.OP13_SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
