"""Operator 11: language-model scores by prediction by partial matching over bytes.

The byte-context trie is a table: every learned position is one gram, the ``ORDER`` bytes before it and the byte
itself, and the grams with their counts hold all shorter contexts as suffixes. A byte is predicted in its longest known context.
Where it was never seen there, the model escapes to the context that is one byte shorter and leaves out (excludes) all symbols of the
longer one. Escapes are estimated by method D: of a context with n learned bytes of d kinds, an escape has d / 2n and a
byte seen c times (2c - 1) / 2n. Below order 0 the remaining symbols are equally likely.

Nothing of the model passes the driver but the counts of byte pairs (65,536 at most). Documents are dealt in
chunks; a chunk counts its grams and words, the counts of all chunks are merged by bucket, and a chunk asks each
bucket for its own distinct grams and words only. Contexts that end in the same two bytes share a bucket, so that a
bucket holds whole branches of the trie.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, read, small, stage_table, word_codes

#: Bytes of context. Grams of one more byte are held in 64 bits, so seven is the most.
ORDER = 5

#: Bytes that a text of words can hold: all but four kinds of white space. The blank parts words, the line feed ends a text.
SYMBOLS = 252

END = b"\n"

#: Bytes of text after which a task starts another chunk, and of a slice that is in arrays at a time.
CHUNK, SLICE = 64 << 20, 4 << 20

#: Chunks whose counts are merged at once; more are merged in rounds.
FAN = 64

#: Chunks that ask one copy of a bucket; for more the buckets are copied.
ASKERS = 1024

_U = np.uint64
_EMPTY = np.empty(0, _U)


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unpacked(x: bytes | None, kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind) if x else np.empty(0, kind)


def merged(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    parts = list(parts)
    if not parts:
        return _EMPTY, np.empty(0, np.int64)
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    at = np.argsort(keys, kind="stable")
    keys = keys[at]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[at], first) if len(first) else np.empty(0, np.int64)


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """A gram for each byte of each text and its end, and where each text's grams start."""
    pad = END * order
    b = np.frombuffer(b"".join([x for t in texts for x in (pad, t, END)]), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    g = b[: len(b) - order].astype(_U)
    for i in range(1, order + 1):
        g <<= _U(8)
        g |= b[i : len(b) - order + i]
    keep = np.repeat(np.arange(len(texts)) * order, sizes) + np.arange(sizes.sum())
    return g[keep], starts


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.copy()) % _U(buckets)).astype(np.int64)


class Trie:
    """The contexts of some grams with their counts; all contexts that end in the same two bytes, or none of them."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> None:
        """``low``: counts of all byte pairs (context of one byte, byte)."""
        self.order = order
        self.pairs, self.contexts = [], []
        for k in range(order + 1):
            from_, n = (keys, counts) if k > 1 else low
            pair, n = merged([(from_ & _mask(k + 1), n)])
            context, first = np.unique(pair >> _U(8), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else np.empty(0, np.int64)
            kinds = np.diff(np.append(first, len(pair)))
            self.pairs.append((pair, n))
            self.contexts.append([context, total, kinds, np.zeros(len(context), np.int64)])
        for k in range(1, order + 1):  # of each context: how often the symbols seen there follow the shorter one
            pair, _ = self.pairs[k]
            context = self.contexts[k][0]
            again = _found(*self.pairs[k - 1], pair & _mask(k))
            first = np.searchsorted(pair >> _U(8), context)
            if len(first):
                self.contexts[k][3] = np.add.reduceat(again, first)

    def log10(self, asked: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        out, live = np.zeros(len(asked)), np.ones(len(asked), bool)
        seen_n, seen_d = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)  # of the longer context
        for k in range(self.order, -1, -1):
            pair = asked & _mask(k + 1)
            at, known = _at(self.contexts[k][0], pair >> _U(8))
            if not known.any():
                continue
            _, total, kinds, again = self.contexts[k]
            n = np.where(known, _found(*self.pairs[k], pair), 0)
            all_n, all_d = np.where(known, total[at], 0) - seen_n, np.where(known, kinds[at], 0) - seen_d
            hit = live & (n > 0)
            out[hit] += np.log10((2 * n[hit] - 1) / (2 * all_n[hit]))
            live &= ~hit
            escape = live & known & (all_d > 0)
            out[escape] += np.log10(all_d[escape] / (2 * all_n[escape]))
            seen_n, seen_d = np.where(known, again[at], 0), np.where(known, kinds[at], 0)
        out[live] -= np.log10(SYMBOLS - len(self.pairs[0][0]))
        return out


def _mask(n: int) -> np.uint64:
    return _U((1 << 8 * n) - 1)


def _at(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at, known = _at(keys, asked)
    return np.where(known, values[at], 0) if len(keys) else np.zeros(len(asked), np.int64)


class _Counts:
    """What a chunk has counted so far: learned counts of grams and words, and those that are only asked for."""

    def __init__(self) -> None:
        self.grams: list = []
        self.words: list = []
        self.bytes = 0

    def add(self, texts: list[bytes], learn: list[bool], order: int) -> None:
        codes = word_codes()
        for learned in (True, False):
            own = [t for t, x in zip(texts, learn, strict=True) if x == learned]
            if own:
                g, w = grams(own, order)[0], codes.array([x for t in own for x in (*t.split(), END)])
                for kept, keys in ((self.grams, g), (self.words, w)):
                    keys, n = np.unique(keys, return_counts=True)
                    kept.append((keys, n * learned))
                    if len(kept) > 16:
                        kept[:] = [merged(kept)]
        self.bytes += sum(map(len, texts))

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes, bytes]]:
        """Words go to the first ``buckets`` buckets, grams to as many behind them."""
        for kept, base in ((self.words, 0), (self.grams, buckets)):
            keys, n = merged(kept)
            b = bucket_of(keys if not base else (keys >> _U(8)) & _U(0xFFFF), buckets)
            at = np.argsort(b, kind="stable")
            ends = np.searchsorted(b[at], np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(ends)):
                own = at[ends[i] : ends[i + 1]]
                yield base + int(i), packed(keys[own]), packed(n[own].astype(np.int64))


def _chunked(docs: DataFrame, text: str, learn: str, order: int, buckets: int) -> DataFrame:
    """The documents with packed texts of words, and for each chunk and bucket its keys and their learned counts."""
    names = docs.columns
    at, flag = names.index(text), names.index(learn)
    plain = docs.withColumn(text, F.col(text).cast("binary"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId() << 24, 0
        squeeze = zstandard.ZstdCompressor(level=3).compress
        counts, kinds = _Counts(), None

        def keys() -> Iterator[pa.RecordBatch]:
            for b, k, n in counts.rows(buckets):
                own = [pa.array([task + serial], pa.int64()), pa.array([b], pa.int32()), pa.array([k], pa.binary()), pa.array([n], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(1, t) for t in kinds)], names=[*_KEYS, *names])

        for b in small(it):
            kinds = [f.type for f in b.schema]
            texts = [b" ".join((t or b"").lower().split()) for t in b.column(at).to_pylist()]
            learned = b.column(flag).to_pylist()
            done, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t) + 1
                if size >= SLICE or i == len(texts) - 1:
                    counts.add(texts[done : i + 1], learned[done : i + 1], order)
                    own = b.slice(done, i + 1 - done)
                    columns = [own.column(j) if j != at else pa.array(map(squeeze, texts[done : i + 1]), pa.binary()) for j in range(len(names))]
                    n = own.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([task + serial] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), *columns], names=[*_KEYS, *names]
                    )
                    done, size = i + 1, 0
                    if counts.bytes >= CHUNK:
                        yield from keys()
                        counts, serial = _Counts(), serial + 1
        if kinds:
            yield from keys()

    return plain.mapInArrow(batches, "__chunk long, __bucket int, __keys binary, __counts binary, " + _schema(plain))


_KEYS = ["__chunk", "__bucket", "__keys", "__counts"]


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _merge(table: pa.Table) -> pa.Table:
    keys, n = merged(
        (unpacked(k), unpacked(c, np.int64)) for k, c in zip(table.column("__keys").to_pylist(), table.column("__counts").to_pylist(), strict=True)
    )
    keys, n = keys[n > 0], n[n > 0]
    return pa.table({
        "__bucket": pa.array(table.column("__bucket").slice(0, 1).to_pylist(), pa.int32()), "__chunk": pa.array(table.column("__chunk").slice(0, 1).to_pylist(), pa.int64()),
        "__keys": pa.array([packed(keys)], pa.binary()), "__counts": pa.array([packed(n)], pa.binary()),
        "n_keys": pa.array([len(keys)], pa.int64()), "n_total": pa.array([int(n.sum())], pa.int64())
    })


def _model(parts: DataFrame, chunks: int) -> DataFrame:
    """One row a bucket: its learned keys and their counts over all chunks. No merge gets more than about ``FAN`` parts."""
    schema = "__bucket int, __chunk long, __keys binary, __counts binary, n_keys long, n_total long"
    while True:
        groups = -(-chunks // FAN)
        parts = parts.withColumn("__chunk", F.pmod(F.xxhash64("__chunk", F.lit(groups)), F.lit(groups)).cast("long"))
        parts = parts.select("__bucket", "__chunk", "__keys", "__counts").groupBy("__bucket", "__chunk").applyInArrow(_merge, schema)
        if groups == 1:
            return stage_table(parts, "lm-model")
        chunks = groups


def _low(model: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of byte pairs; there are 65,536 at most."""
    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, n = merged([(unpacked(k) & _mask(2), unpacked(c, np.int64))])
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    rows = model.where(F.col("__bucket") >= buckets).select("__keys", "__counts").mapInArrow(pairs, "pair long, n long")
    got = sorted((r.pair, r.n) for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect())
    return np.array([p for p, _ in got], _U), np.array([n for _, n in got], np.int64)


def _answers(asks: DataFrame, model: DataFrame, low: tuple[np.ndarray, np.ndarray], buckets: int, order: int, copies: int) -> DataFrame:
    """For each chunk and bucket its keys with counts (of words) or log10 probabilities (of grams).

    A bucket's model comes first in its partition and its askers follow, one at a time.
    """
    copy = F.pmod(F.xxhash64("__chunk"), F.lit(copies)).cast("long")
    model = model.select("__bucket", F.explode(F.sequence(*(F.lit(c).cast("long") for c in (0, copies - 1)))).alias("copy"), F.lit(None).cast("long").alias("__chunk"), "__keys", "__counts")
    asks = asks.select("__bucket", copy.alias("copy"), "__chunk", "__keys", F.lit(None).cast("binary").alias("__counts"))
    dealt = model.unionByName(asks).repartition("__bucket", "copy").sortWithinPartitions("__bucket", "copy", F.col("__chunk").asc_nulls_first())

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, trie = None, (_EMPTY, np.empty(0, np.int64)), None
        for b in it:
            for i in range(b.num_rows):
                bucket, copy, chunk, keys, counts = (b.column(j)[i].as_py() for j in range(5))
                if (bucket, copy) != now:
                    now, words = (bucket, copy), (_EMPTY, np.empty(0, np.int64))
                    if chunk is None:
                        words = unpacked(keys), unpacked(counts, np.int64)
                    trie = Trie(*words, low, order) if bucket >= buckets else None
                if chunk is not None:
                    asked = unpacked(keys)
                    values = packed(trie.log10(asked).astype(np.float32)) if trie else packed(_found(*words, asked).astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), pa.array([keys], pa.binary()), pa.array([values], pa.binary())], names=_KEYS
                    )

    return dealt.mapInArrow(answer, "__chunk long, __bucket int, __keys binary, __counts binary")


class _Known:
    """Values of a chunk's keys."""

    def __init__(self, parts: list[tuple[bytes, bytes]], kind: type) -> None:
        keys = np.concatenate([unpacked(k) for k, _ in parts]) if parts else _EMPTY
        self.values = np.concatenate([unpacked(v, kind) for _, v in parts]) if parts else np.empty(0, kind)
        self.index = pd.Index(keys)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return self.values[self.index.get_indexer(keys)]


MADE = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score_texts(docs: DataFrame, learn: Column, text: str = "text", order: int = ORDER, buckets: int | None = None) -> DataFrame:
    """``docs`` without its text and with the scores of a model that the rows with ``learn`` teach.

    Adds n_tokens, n_known, train_tokens (long), base_score and score (double); columns of these names are
    replaced. Tokens are the words (cut at \\x20 and \\x09-\\x0D, A-Z lower-cased) and one end; null and empty texts have the end alone. ``base_score``
    is the sum over tokens of log10((c + 0.5) / (N + 0.5 * (V + 1))). ``score`` is log10 of the probability of the
    words, one blank between each two, and an end, by partial matching of ``order`` bytes (2 to 7). Words are told
    apart by 64-bit hashes. A null ``learn`` counts as false. Without learned rows all bytes are equally likely and ``base_score`` is 0. Repeated rows
    are learned as often as they occur and scored each. All other columns of ``docs`` are kept,
    but for names that begin with two underscores; give the text a second name to keep it.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7")
    spark = docs.sparkSession
    buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("__learn", F.coalesce(learn, F.lit(False))).drop(*MADE)
    dealt = stage_table(_chunked(docs, text, "__learn", order, buckets), "lm-chunks", compression="zstd")
    parts = dealt.where("__bucket is not null").select(*_KEYS)
    chunks = parts.agg(F.count_distinct("__chunk")).first()[0]
    model = _model(parts, max(1, chunks))
    low = _low(model, buckets)
    learned, distinct = model.where(F.col("__bucket") < buckets).agg(F.coalesce(F.sum("n_total"), F.lit(0)), F.coalesce(F.sum("n_keys"), F.lit(0))).first()
    answers = _answers(parts, model, low, buckets, order, -(-max(1, chunks) // ASKERS))

    names = [n for n in docs.columns if n not in (text, "__learn")]
    rows = dealt.where("__bucket is null")
    both = answers.unionByName(rows.select("__chunk", "__bucket", F.col(text).alias("__keys"), *names), allowMissingColumns=True).select(*_KEYS, *names)
    both = both.repartition("__chunk").sortWithinPartitions("__chunk", F.col("__bucket").isNull())
    below = learned + 0.5 * (distinct + 1)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        now, parts, known = None, ([], []), None

        def made(texts: list[bytes]) -> list[pa.Array]:
            codes = [t.split() for t in texts]
            n = np.fromiter((len(w) + 1 for w in codes), np.int64, len(codes))
            c = known[0].of(word_codes().array([x for w in codes for x in (*w, END)]))
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            g, starts = grams(texts, order)
            return [
                pa.array(n), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.full(len(n), learned, np.int64)),
                pa.array(np.add.reduceat(np.log10((c + 0.5) / below), first)), pa.array(np.add.reduceat(known[1].of(g).astype(np.float64), starts))
            ]

        for b in it:
            where = b.column(0).to_pylist()
            bucket = b.column(1).to_pylist()
            i = 0
            while i < b.num_rows:
                if where[i] != now:
                    now, parts, known = where[i], ([], []), None
                if bucket[i] is not None:
                    parts[bucket[i] >= buckets].append((b.column(2)[i].as_py(), b.column(3)[i].as_py()))
                    i += 1
                    continue
                known = known or (_Known(parts[0], np.int64), _Known(parts[1], np.float32))
                texts, size, j = [], 0, i
                while j < b.num_rows and where[j] == now and size < SLICE:
                    texts.append(open_(b.column(2)[j].as_py()))
                    size += len(texts[-1])
                    j += 1
                own = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns[4:], *made(texts)], names=[*names, *MADE])
                i = j

    schema = ", ".join([*filter(None, [_schema(rows.select(*names))]), "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"])
    return both.mapInArrow(score, schema)


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(True))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return score_texts(docs, ~F.col("held_out")).select("doc_id", "held_out", *MADE)
