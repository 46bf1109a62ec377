"""Operator 10: toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has a logistic score of the words in it and of their beginnings, and
the text's score is their noisy-or: 1 - product(1 - p). Only texts have labels, so the
weights are trained through the noisy-or; afterwards the sentence scores tell which
sentences offend. The model is fitted on a bounded sample of labelled texts: Spark counts in how
many texts of either label each word or beginning occurs, the most telling ones become features, and their
weights are learned on the driver. All texts are scored in Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small, stage_table, using

#: Bounds of the fit: labelled texts of either label (about so many, by a hash of their ids), words that are features,
#: and texts of label 1 that a feature needs.
FIT_TEXTS, FEATURES, LEAST_TEXTS = 10_000, 2_000, 3
#: What a feature must tell of the labels (log-likelihood ratio, in nats): more than chance gives the best of all
#: candidates (at this level), and ``LEAST_GAIN``, or in samples whose labels
#: hold little this share of all that they hold.
LEVEL, LEAST_GAIN, LEAST_SHARE = 0.05, 20.0, 0.018
#: Lengths of the word beginnings that may be features, so that a stem counts whatever follows it. Words whose weight a
#: Python worker remembers.
STEMS, MEMO_WORDS = range(4, 9), 100_000
#: Steps of the fit and its penalty on weights.
STEPS, PENALTY = 600, 0.05

SENTENCE = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, sentence) in code points; a sentence has a word."""
    return [(m.start(), m.end(), m[0]) for m in SENTENCE.finditer(text) if WORD.search(m[0])]


def words(sentence: str) -> set[str]:
    return set(WORD.findall(sentence.lower()))


def features(word: str) -> list[str]:
    """The word and its beginnings, which end in a star."""
    return [word, *(word[:n] + "*" for n in STEMS if n < len(word))]


class WordWeights(dict):
    """Sums of the weights of words' features, remembered; bounded."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= MEMO_WORDS:
            self.clear()
        w = self[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def sentence_scores(self, text: str, known: WordWeights | None = None) -> list[tuple[int, int, float]]:
        look = (WordWeights(self.weights) if known is None else known).__getitem__
        return [
            (a, b, 1 / (1 + math.exp(-min(max(self.bias + sum(map(look, words(s))), -700.0), 700.0)))) for a, b,
            s in sentences(text)
        ]

    def score(self, scores: list[tuple[int, int, float]]) -> float:
        """Noisy-or of sentence scores; a text without sentences counts as one sentence without words."""
        if not scores:
            return float(1 / (1 + np.exp(-self.bias)))
        return float(-np.expm1(np.log1p(-np.minimum([p for _, _, p in scores], 1 - 1e-12)).sum()))


def _word_sets(docs: DataFrame) -> DataFrame:
    """(label, words) of (label, text): words and their beginnings."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            sets = [sorted({f for w in words(t or "") for f in features(w)}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(sets, pa.list_(pa.string()))], names=["label", "words"])

    return docs.select("label", "text").mapInArrow(batches, "label int, words array<string>")


def least_gain(candidates: int, n1: int, n0: int) -> float:
    """What a feature must tell, given how many were tried and how many texts have either label."""
    held = n1 * math.log((n1 + n0) / n1) + n0 * math.log((n1 + n0) / n0)
    return max(math.log(max(1, candidates) / LEVEL), min(LEAST_GAIN, LEAST_SHARE * held))


def telling_words(docs: DataFrame, most: int = FEATURES, least: int = LEAST_TEXTS) -> list[str]:
    """The words whose share of texts differs most between the labels (likelihood ratio), at most ``most``, of those
    that label 1 favours and ``least`` of its texts have; with beginnings.

    The cut follows the sample (``least_gain``), so that a small one has features too.
    """
    total = docs.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in total}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    by = _word_sets(docs).select("label", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("label").cast("double").alias("a"), F.sum(1 - F.col("label")).cast("double").alias("b")
    )
    part = lambda x, of, all_, rest: F.when(x > 0, x * F.log(x * (n1 + n0) / (F.lit(float(of)) * all_))).otherwise(0.0)
    a, b = F.col("a"), F.col("b")
    with_, without = a + b, (n1 + n0) - a - b
    g = part(a, n1, with_, 0) + part(b, n0, with_, 0) + part(n1 - a, n1, without, 0) + part(n0 - b, n0, without, 0)
    told = by.where((a >= least) & (a * n0 > b * n1)).select("word", F.round(g, 6).alias("g"))
    told = stage_table(told, "op10-words")
    cut = least_gain(told.count(), n1, n0)
    rows = told.where(F.col("g") > cut).orderBy(F.desc("g"), "word").limit(most).select("word").collect()
    return [r["word"] for r in rows]


def _bags(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(label, n sentences, sentence of each feature, feature) of texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            n, rows, cols = [], [], []
            for t in b.column("text").to_pylist():
                s = sentences(t or "")
                got = [
                    (i, vocabulary[f]) for i, (_, _, x) in enumerate(s) for w in words(x) for f in features(w) if f in vocabulary
                ]
                n.append(max(1, len(s)))
                rows.append([x for x, _ in got])
                cols.append([x for _, x in got])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("label"), pa.array(n, pa.int32()), pa.array(rows, pa.list_(pa.int32())),
                    pa.array(cols, pa.list_(pa.int32()))
                ],
                names=["label", "n", "row", "col"]
            )

    return docs.select("label", "text").mapInArrow(batches, "label int, n int, row array<int>, col array<int>")


def fit(bags: list, n_features: int, weight: dict[int, float]) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the likelihood of labels under the noisy-or, by Adam. Sentences without features
    share one score.
    """
    y = np.array([b["label"] for b in bags], float)
    importance = np.array([weight[b["label"]] for b in bags], float)
    importance /= importance.sum()
    doc, row, col, bare, at = [], [], [], np.zeros(len(bags)), 0
    for i, b in enumerate(bags):
        of = {r: k for k, r in enumerate(dict.fromkeys(b["row"]), at)}
        doc += [i] * len(of)
        row += [of[r] for r in b["row"]]
        col += b["col"]
        bare[i] = b["n"] - len(of)
        at += len(of)
    doc, row, col = np.array(doc, int), np.array(row, int), np.array(col, int)
    w, bias = np.zeros(n_features), -5.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, w[col], at)
        log_not = -np.logaddexp(0, z)  # log(1 - p)
        none = -np.logaddexp(0, bias)
        log_clean = np.bincount(doc, log_not, len(bags)) + bare * none
        clean = np.exp(log_clean)
        # d log-likelihood / d log(1 - P): for label 0 it is 1, for label 1 it is -(1 - P) / P
        slope = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) * importance
        each = -slope[doc] * np.exp(z + log_not) if at else np.zeros(0)  # d log(1 - p) / dz = -p
        grad = np.append(
            np.bincount(col, each[row], n_features) if at else np.zeros(n_features),
            each.sum() - (slope * bare).sum() * np.exp(bias + none)
        )
        grad[:-1] -= PENALTY / len(bags) * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w, bias = w + move[:-1], bias + move[-1]
    return w, float(bias)


def train(docs: DataFrame, weight: dict[int, float]) -> Model:
    """A model from a sample (text, label 0/1), each row of which stands for ``weight`` rows of its label.

    Without rows of both labels every score is near the only label (near 0 without rows).
    """
    n = {r["label"]: r["count"] for r in docs.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model({}, 12.0 if n.get(1) else -12.0)
    vocabulary = {w: i for i, w in enumerate(telling_words(docs))}
    bags = _bags(docs, vocabulary).collect()  # a bounded sample, of each text its features alone
    w, bias = fit(bags, len(vocabulary), weight)
    return Model({x: float(w[i]) for x, i in vocabulary.items()}, bias)


def held_out(doc: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", fit_texts: int = FIT_TEXTS
) -> tuple[DataFrame, dict[int, float]]:
    """The sample (text, label) to learn from, about ``fit_texts`` ids of either label, and how many rows one row of a
    label stands for.

    Held-out ids, null ids and null labels are left out; of several labels of an id the
    highest counts. The sample's ids are broadcast: their number is bounded.
    """
    marks = labels.where(
        F.col(label).isNotNull() & F.col(doc).isNotNull()
    ).groupBy(F.col(doc).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")).where(~held_out())
    n = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    share = {x: min(1.0, fit_texts / k) for x, k in n.items()}
    cut = F.lit(0.0)
    for x, p in share.items():
        cut = F.when(F.col("label") == x, p).otherwise(cut)
    ids = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < cut * 1_000_000)
    texts = docs.select(
        F.col(doc).alias("doc_id"), F.col(text).alias("text")
    ).join(F.broadcast(ids), "doc_id").select("text", "label")
    return texts, {x: 1 / p for x, p in share.items()}


def score_texts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (double) and ``offending``: start, end and score of the sentences that score 0.5 or more.

    Null and empty texts get the score of a sentence without words. Texts are scored whole.
    Columns of these names are replaced.
    """
    df = df.drop("score", "offending")
    at = df.columns.index(text)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordWeights(model.weights)
        using("weights", known.clear)
        for b in small(it):
            per = [model.sentence_scores(t or "", known) for t in b.column(at).to_pylist()]
            bad = [[{"start": s, "end": e, "score": float(p)} for s, e, p in x if p >= 0.5] for x in per]
            cols = [pa.array([model.score(x) for x in per], pa.float64()), pa.array(bad, span)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "score", "offending"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
    return df.mapInArrow(batches, schema + "score double, offending array<struct<start:int,end:int,score:double>>")


def model_for(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labels of documents. Null ids, labels and texts teach nothing; without labels of both kinds all
    scores are near the only one, or 0.
    """
    sample, weight = labelled(docs, labels)
    return train(stage_table(sample, "op10-sample"), weight)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = model_for(docs, read(spark, sf_dir, "labels"))
    out = score_texts(docs, model)
    return out.select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), F.size("offending").alias("n_offending")
    )
