"""The pipeline's stages, each on its own input, against brute force; and the numbered queries against their SQL."""

import collections
import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from reasonlake.llm import bpe, toxicity
from test_ops import brute_classes, brute_hits, odd
from test_oracle import TABLES, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(c.sql(entry.oracle_sql()[name]).df())


def brute_toxic(rows, labels):
    """Ids that a model rejects which plain loops fit to the labels that are not held out."""
    marks = {}
    for i, y in labels:
        if i is not None and y is not None:
            marks[i] = max(marks.get(i, 0), y)
    train = [(t or "", marks[i]) for i, t in rows if i in marks and zlib.crc32(str(i).encode()) % 5]
    n1 = sum(y for _, y in train)
    n0 = len(train) - n1
    seen = {0: collections.Counter(), 1: collections.Counter()}
    for t, y in train:
        seen[y].update({f for w in toxicity.words(t) for f in toxicity.features(w)})

    def told(a, b):
        n = n1 + n0
        part = lambda x, of, al: x * math.log(x * n / (of * al)) if x else 0.0
        return part(a, n1, a + b) + part(b, n0, a + b) + part(n1 - a, n1, n - a - b) + part(n0 - b, n0, n - a - b)

    tried = {w: told(a, seen[0][w]) for w, a in seen[1].items() if a >= toxicity.LEAST_TEXTS and a * n0 > seen[0][w] * n1}
    cut = toxicity.least_gain(len(tried), n1, n0)
    vocabulary = {
        w: i for i, w in enumerate(sorted((w for w, g in tried.items() if g > cut), key=lambda w: (-round(tried[w], 6), w)))
    }
    bags = []
    for t, y in train:
        s = toxicity.sentences(t)
        got = [
            (i, vocabulary[f]) for i,
            (_, _, x) in enumerate(s) for w in toxicity.words(x) for f in toxicity.features(w) if f in vocabulary
        ]
        bags.append({"label": y, "n": max(1, len(s)), "row": [x for x, _ in got], "col": [x for _, x in got]})
    w, bias = toxicity.fit(bags, len(vocabulary), {0: 1.0, 1: 1.0})
    model = toxicity.Model({x: float(w[i]) for x, i in vocabulary.items()}, bias)
    return {i for i, t in rows if model.score(model.sentence_scores(t or "")) >= 0.5}


def brute_lines(rows, sites):
    """Texts of (doc_id, text, source) without lines that so many sources share, but where they come first."""
    at = collections.defaultdict(set)
    first = {}
    for d, t, s in sorted(rows):
        for i, x in enumerate((t or "").split("\n")):
            if x := x.strip(" \t\n\x0b\f\r"):
                at[x].add(s)
                first.setdefault(x, (d, i))
    out = {}
    for d, t, _ in rows:
        keep = lambda i, x: len(at[x]) < sites or first[x] == (d, i)  # noqa: B023, E731
        out[d] = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if keep(i, x.strip(" \t\n\x0b\f\r")))
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(pipeline.STAGES):
        rows_ = docs.collect()
        before = {r["doc_id"]: r["text"] for r in rows_}
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        got = docs.collect()
        after = {r["doc_id"] for r in got}
        if name != "bpe":
            assert docs.columns == pipeline.COLUMNS
        if name == "toxicity":
            labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
            gone = set(before) - after
            assert gone == brute_toxic(list(before.items()), labels)
            assert gone & {d for d, y in labels if y == 1} and not gone & {d for d, y in labels if y == 0}
        elif name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in got} == brute_lines(
                [(r["doc_id"], r["text"], r["source"]) for r in rows_], 10
            )
            assert all(r["n_chars"] == len(r["text"] or "") for r in got)
        elif name == "near_dedup":
            assert after == {d for d, (_, c) in brute_classes(list(before.items()), 5, 80).items() if c == d}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            judged = {d: brute_hits(t, items) for d, t in before.items()}
            assert after == {d for d, (n, h, _) in judged.items() if not (h and 20 * h >= n)}
        elif name == "bpe":
            known = tiktoken.Encoding(
                "t", pat_str=bpe._pattern(), mergeable_ranks=bpe.load_ranks(bpe._path("byte_bpe_multi_50k.tiktoken")),
                special_tokens={}
            )
            for r in got:
                ids = known.encode_ordinary(before[r["doc_id"]] or "")
                assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                assert r["decoded_sha256"] == hashlib.sha256((before[r["doc_id"]] or "").encode()).hexdigest()
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


@pytest.mark.parametrize("rows_", ["odd", "none"])
def test_stages_take_odd_rows(spark, tmp_path, rows_):
    """Nulls in all columns, empty, blank and long texts, repeated rows and ids, clashing columns; and no rows at all."""
    odd_rows = odd(spark).withColumns({"lang": F.when(F.col("doc_id") > 4, "en"), "n_chars": F.length("text").cast("long")})
    docs = odd_rows if rows_ == "odd" else odd_rows.limit(0)
    spark.createDataFrame(
        [(4, 1, 1), (4, None, 0), (None, 1, 1), (10, 0, 1)], "doc_id long, toxic int, quality int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(
        [(1, "one"), (2, None), (None, "")], "item_id long, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"toxicity": 14, "line_dedup": 14, "near_dedup": 11, "decontamination": 11, "bpe": 14}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert len(got) == (want[name] if rows_ == "odd" else 0), (name, sorted((r["doc_id"] is None, r["doc_id"]) for r in got))
        if name != "bpe":
            assert out.columns == pipeline.COLUMNS
            kept = collections.Counter(map(tuple, got)) if name != "line_dedup" else collections.Counter()
            assert not kept - collections.Counter(map(tuple, docs.select(*pipeline.COLUMNS).collect()))
