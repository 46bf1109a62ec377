"""Operator 5: word-piece counts by a linear longest-match automaton.

A trie holds the pieces that begin a word and, under a second root, those that go on
with it. Each node has a failure link: the node of what is left after the greedy pieces
of the node's string are popped, with the number of pieces popped. One walk over the bytes of a
word then gives the number of greedy longest-match pieces; no piece is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _path, load_ranks
from .common import MEMO_WORDS, read, small, using

NONE = -1


class Automaton:
    """Counts pieces of words. ``first`` begin words, ``rest`` follow; a word without a full split counts as one unknown piece."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]) -> None:
        self.step: dict[int, int] = {}  # node * 256 + byte -> node
        self.go, self.root = 1, 0  # roots of the rest and of the first pieces
        parent, byte, end = [NONE, NONE], [0, 0], [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                node = root
                for b in piece:
                    new = self.step.get(node * 256 + b)
                    if new is None:
                        new = self.step[node * 256 + b] = len(parent)
                        parent.append(node)
                        byte.append(b)
                        end.append(False)
                    node = new
                end[node] = node > 1
        self.fail, self.popped = [NONE] * len(parent), [0] * len(parent)
        for v in self._by_depth(parent):
            if end[v]:
                self.fail[v], self.popped[v] = self.go, 1
                continue
            z, n = self.fail[parent[v]], self.popped[parent[v]]
            while z != NONE and z * 256 + byte[v] not in self.step:
                z, n = self.fail[z], n + self.popped[z]
            if z != NONE:
                self.fail[v], self.popped[v] = self.step[z * 256 + byte[v]], n

    @staticmethod
    def _by_depth(parent: list[int]) -> list[int]:
        depth = [0] * len(parent)
        for v in range(2, len(parent)):
            depth[v] = depth[parent[v]] + 1  # parents come before children
        return sorted(range(2, len(parent)), key=depth.__getitem__)

    def count(self, word: bytes) -> int:
        if not word:
            return 0
        step, fail, popped, node, n = self.step, self.fail, self.popped, self.root, 0
        for b in word:
            while (new := step.get(node * 256 + b)) is None:
                n += popped[node]
                node = fail[node]
                if node == NONE:
                    return 1
            node = new
        while node != self.go:
            n += popped[node]
            node = fail[node]
            if node == NONE:
                return 1
        return n


class Counts(dict):
    """Piece counts of words, remembered; bounded."""

    def __init__(self, automaton: Automaton, lead: bytes) -> None:
        super().__init__()
        self.automaton, self.lead = automaton, lead

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        n = self[word] = self.automaton.count(self.lead + word)
        return n


_counts: dict[str, Counts] = {}


def counts_for(ranks: str) -> Counts:
    """The worker's counts over a byte vocabulary: tokens with a leading blank begin words, the others go on with them."""
    using("pieces", _counts.clear)
    if ranks not in _counts:
        tokens = load_ranks(_path(ranks))
        _counts[ranks] = Counts(Automaton((t for t in tokens if t[:1] == b" "), (t for t in tokens if t[:1] != b" ")), b" ")
    return _counts[ranks]


def count_tokens(df: DataFrame, text: str = "text", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``df`` with ``n_words`` and ``n_tokens`` (long), the greedy longest-match pieces of its words.

    Words are cut at \\x20 and \\x09-\\x0D. Null and empty texts have 0 of both. Texts are
    counted whole. Columns of these names are replaced.
    """
    df = df.drop("n_words", "n_tokens")
    at = df.columns.index(text)
    plain = df.withColumn(text, F.col(text).cast("binary"))  # bytes are not decoded on the way

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = counts_for(ranks).__getitem__
        for b in small(it):
            words = [(t or b"").split() for t in b.column(at).to_pylist()]
            made = [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(look, w)) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "n_words", "n_tokens"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields)
    return plain.mapInArrow(batches, schema + "n_words long, n_tokens long").withColumn(text, F.col(text).cast("string"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")
