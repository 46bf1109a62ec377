"""Operator 9: byte-level BPE encoding and decoding.

A pattern cuts texts into pieces; each piece is encoded alone. Encoding starts from
the longest token at a position (an Aho-Corasick automaton over bytes written as
Latin-1) and steps back to shorter tokens, or to the token before, until each two
neighbours are *compatible*: merging their joined bytes by rank gives just these two
tokens. Whether two tokens are compatible is remembered, so the work is linear in the
piece, and the result is that of the merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small, using

#: Pieces and token pairs that a Python worker remembers before it starts afresh, and the longest piece kept.
MEMO_PIECES, MEMO_PAIRS, MEMO_BYTES = 300_000, 1_000_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one rank table, held by a Python worker.

    Ranks are in the order of training: the parts of a token come before it. Tokens without
    such parts are used for whole pieces alone.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        every = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        self.size = np.array([len(t) for t in every], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.all_bytes = np.frombuffer(b"".join(every), np.uint8)
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._learn()

    def _learn(self) -> None:
        """For each token the two tokens that its last merge joins. Tokens that no merge makes are left out of the automaton."""
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        made: set[int] = set()
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                made.add(i)
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            for cut in range(len(token) - 1, 0, -1):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a in made and b in made and self._fits(a, b, i):
                    self.parts[i], self.merged[a, b] = (a, b), i
                    made.add(i)
                    break
        self.automaton = ahocorasick.Automaton()
        for i in made:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        #: the longest shorter token that begins a token
        self.shorter: dict[int, int] = {}
        for i in made:
            token = self.bytes_of[i]
            for cut in range(len(token) - 1, 0, -1):
                if (j := self.ranks.get(token[:cut])) in made:
                    self.shorter[i] = j
                    break

    def _fits(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether merges of a rank below ``limit`` leave the border between tokens a and b standing.

        Merges are undone on both sides, the latest first. At each step the two tokens at
        the border must not have a merge that comes before the one undone last.
        """
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            left, right = self.parts.get(a), self.parts.get(b)
            if left is None and right is None:
                return True
            # of two equal ranks the left one was merged first, so the right one is undone first
            if right is None or left is not None and a > b:
                limit, a = a, left[1]  # a border merge of the same rank would come later, being further right
            else:
                limit, b = b + 1, right[0]  # one of the same rank would come first, being further left

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self._fits(a, b)
        return known

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest: dict[int, int] = {}
        for end, i in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - len(self.bytes_of[i])
            old = longest.get(start)
            if old is None or len(self.bytes_of[old]) < len(self.bytes_of[i]):
                longest[start] = i
        n, at, out, dead = len(data), 0, [], set()
        token = longest.get(0)
        while token is not None:
            end = at + len(self.bytes_of[token])
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else None
            elif (less := self.shorter.get(token)) is not None:
                token = less
            elif out:
                dead.add(at)
                token = out.pop()
                at -= len(self.bytes_of[token])
            else:
                raise ValueError("the rank table lacks single bytes")
        return out

    def _remember(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        ids = b"".join(self.packed[i] for i in self.piece(data))
        if len(data) <= MEMO_BYTES:
            if len(self.pieces) >= MEMO_PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian unsigned 32-bit integers."""
        get, make = self.pieces.get, self._remember
        return b"".join([get(x) or make(x) for x in self.find(text)])

    def decode(self, packed: bytes) -> bytes:
        """Bytes of packed ids, gathered from all tokens' bytes in one row."""
        ids = np.frombuffer(packed, "<u4")
        size = self.size[ids]
        ahead = self.place[ids] - (np.cumsum(size) - size)
        return self.all_bytes[np.repeat(ahead, size) + np.arange(int(size.sum()))].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file that every node has installed."""
    using("bpe", _codecs.clear)
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def _path(name: str) -> str:
    """The place of a vocabulary: a path stays as it is, a bare name is looked up where the vocabularies are installed."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _added(df: DataFrame, source: str, of: str, make, new: list[tuple[str, str]]) -> DataFrame:
    """``df`` with columns made from one column in Arrow batches; columns of these names are replaced."""
    df = df.drop(*(n for n, _ in new if n != source))
    at = df.columns.index(source)
    types = {"binary": pa.binary(), "long": pa.int64()}

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in small(it):
            got = [f(x) for x in b.column(at).to_pylist()]
            cols = [pa.array([g[i] for g in got], types[t]) for i, (_, t) in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *(n for n, _ in new)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(batches, schema + "".join(f", {n} {t}" for n, t in new))


def bpe_encode(df: DataFrame, text: str = "text", ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``df`` with ``token_ids`` (binary: packed little-endian unsigned 32-bit ids) and ``n_tokens``.

    Null and empty texts have no tokens. Texts of any length are encoded whole. ``ranks`` is
    the name or path of an installed vocabulary file; each node reads its own copy.
    """

    def make():
        c = codec(_path(ranks), _pattern())

        def f(t):
            ids = c.encode(t) if t else b""
            return ids, len(ids) // 4

        return f

    return _added(df, text, "string", make, [("token_ids", "binary"), ("n_tokens", "long")])


def bpe_decode(df: DataFrame, ids: str = "token_ids", ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``df`` with ``decoded`` (binary), the bytes of packed ids; null ids give no bytes."""

    def make():
        c = codec(_path(ranks), _pattern())
        return lambda x: (c.decode(x) if x else b"",)

    return _added(df, ids, "binary", make, [("decoded", "binary")])


def digest(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(bpe_decode(bpe_encode(docs).select("doc_id", "token_ids", "n_tokens")))
