"""Language-model scores against a model of plain dictionaries."""

import collections
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reasonlake.llm import lm_score
from tests.llm.test_ops import corpus, empty, odd


def texts_of(seed, n):
    return [t for _, t, *_ in corpus(seed, n)]


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0d]+", low)] + [b"\n"]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 5 == 1


def brute(rows, order):
    """(held, n_tokens, n_known, N, base, score) of each (id, text)."""
    words, contexts = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, text in rows:
        if not held(i):
            words.update(tokens(text))
            b = b"\n" * order + b" ".join(tokens(text)[:-1]) + b"\n"
            for at in range(order, len(b)):
                for k in range(order + 1):
                    contexts[b[at - k : at]][b[at]] += 1
    n, v = sum(words.values()), len(words)

    def bits(context, byte):
        p, out = 1.0, set()
        for k in range(len(context), -1, -1):
            seen = contexts.get(context[len(context) - k :])
            if not seen:
                continue
            rest = {s: c for s, c in seen.items() if s not in out}
            if not rest:
                continue
            total = 2 * sum(rest.values())
            if byte in rest:
                return p * (2 * rest[byte] - 1) / total
            p, out = p * len(rest) / total, out | set(rest)
        return p / (lm_score.SYMBOLS - len(out))

    got = []
    for i, text in rows:
        t = tokens(text)
        b = b"\n" * order + b" ".join(t[:-1]) + b"\n"
        got.append((
            held(i), len(t), sum(words[w] > 0 for w in t), n, sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t),
            sum(math.log10(bits(b[at - order : at], b[at])) for at in range(order, len(b)))
        ))
    return got


def scored(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True)))
    return lm_score.score_texts(df.withColumn("own", F.col("text")), ~F.col("held_out"), **how).collect()


def same(got, rows, order):
    want = sorted(((i, t or "", *x) for (i, t), x in zip(rows, brute(rows, order), strict=True)), key=str)
    got = sorted(((r.doc_id, r.own or "", r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:6] == w[:6]
        assert g[6:] == pytest.approx(w[6:], rel=1e-6, abs=1e-5)


@pytest.mark.parametrize("order", [2, 5, 7])
def test_scores_equal_brute_force(spark, order):
    rows = [(i, t.upper() if i % 3 else t) for i, t in enumerate(texts_of(order, 80))]
    same(scored(spark, rows, order=order), rows, order)


def test_many_chunks_and_rounds(spark, monkeypatch):
    """Chunks of a few texts, merged two at a time, and buckets in copies."""
    monkeypatch.setattr(lm_score, "FAN", 2)
    monkeypatch.setattr(lm_score, "ASKERS", 2)
    rows = list(enumerate(texts_of(3, 60)))
    same(scored(spark, rows, buckets=3), rows, lm_score.ORDER)


def test_a_task_of_many_chunks():
    """A chunk is closed when it is full; the same counts come out."""
    texts = [t.encode() for t in texts_of(4, 50)]
    whole, parts = lm_score._Counts(), [lm_score._Counts() for _ in texts]
    whole.add(texts, [True] * len(texts), 4)
    for c, t in zip(parts, texts, strict=True):
        c.add([t], [True], 4)
    for kind in ("grams", "words"):
        want = lm_score.merged(getattr(whole, kind))
        got = lm_score.merged([p for c in parts for p in getattr(c, kind)])
        assert [x.tolist() for x in got] == [x.tolist() for x in want]


def test_odd_rows(spark):
    """Null ids are not learned, null and empty texts have their end alone, equal rows equal scores, clashing columns stay."""
    rows = odd(spark)
    plain = [(r.doc_id, r.text) for r in rows.collect()]
    got = lm_score.score_texts(rows.withColumn("own", F.col("text")), ~F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True)))
    assert set(rows.columns) - {"text"} < set(got.columns)
    got = [r.asDict() | {"held_out": held(r.doc_id)} for r in got.collect()]
    same([type("R", (), r) for r in got], plain, lm_score.ORDER)
    assert lm_score.score_texts(empty(spark), F.lit(True)).count() == 0


def test_nothing_learned(spark):
    got = lm_score.score_texts(spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string"), F.lit(None).cast("boolean"))
    got = {r.doc_id: r for r in got.collect()}
    assert got[1].score == pytest.approx(-5 * math.log10(lm_score.SYMBOLS)) and got[1].base_score == 0 and got[1].n_known == 0
    assert (got[2].n_tokens, got[2].train_tokens) == (1, 0) and got[2].score == pytest.approx(-math.log10(lm_score.SYMBOLS))


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    """On the given texts, over all that are held out (on a tenth of them, words that were never seen are too cheap by ``base_score``)."""
    got = lm_score.op11_lm_score(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]
