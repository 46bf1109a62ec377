"""Helpers that the training-data operators share: tables, stage tables, words and hashes.

Word rules are stated in bytes: ``bytes.split`` cuts at \\x20 and \\x09-\\x0D, and
``bytes.lower`` changes A-Z only, whatever the locale.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java pattern: the complement of a word character.
SPACE = "[\\x20\\x09-\\x0D]+"

#: Words whose hash a Python worker remembers before it starts afresh.
MEMO_WORDS = 400_000

_U = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage_root(spark: SparkSession) -> str:
    """The folder that every executor shares. Only a local session without the setting gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        global _own
        if not (_own and os.path.isdir(_own)):
            _own = tempfile.mkdtemp(prefix="spark-reasonlake-")
        return "file://" + _own
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"


_own: str | None = None


def stage_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor need the executors that
    made it.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column, gap: str = SPACE) -> Column:
    """Words of a text, cut at ``gap``, as an array; empty for null. JVM-side.

    A gap takes all white space in a row, so only one at either end leaves an empty string.
    """
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def without(items: str, places: str) -> Column:
    """An array column without the elements at some places (from 0, ascending, each once): the slices between them, so that
    the time follows the elements. Both are columns that exist, as what a lambda holds is computed for each of its elements.
    """
    at = F.concat(F.array(F.lit(-1)), F.col(places).cast("array<int>"), F.array(F.size(items)))
    ends = F.arrays_zip(F.slice(at, F.lit(1), F.size(at) - 1).alias("a"), F.slice(at, F.lit(2), F.size(at) - 1).alias("b"))
    return F.flatten(F.transform(ends, lambda x: F.slice(F.col(items), x["a"] + 2, x["b"] - x["a"] - 1)))


class WordCodes(dict):
    """64-bit codes of words, kept for reuse while a Python worker lives; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


CODES = WordCodes()


def word_codes() -> WordCodes:
    """The worker's word codes, for the task that begins."""
    using("words", CODES.clear)
    return CODES


_memos: dict[str, Callable[[], None]] = {}


def using(name: str, clear: Callable[[], None]) -> None:
    """Say at the start of a task which memo it uses. Python workers are reused, so those of other operators are dropped first."""
    for other in [n for n in _memos if n != name]:
        _memos.pop(other)()
    _memos[name] = clear


#: Bytes of an Arrow batch of texts. Spark's own 64 MB are held some four times a task, in the JVM and in its worker.
BATCH_BYTES, _BATCH = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold ``BATCH_BYTES`` from now on, unless it has a size of its own."""
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, BATCH_BYTES)


def small(it: Iterator, rows: int = 512) -> Iterator:
    """Slices of Arrow batches, so that few texts are Python objects at a time."""
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all (a finaliser in the splitmix form)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Odd bases of the rolling hashes. Two of them give 128-bit identities where that matters.
BASE, BASE_2 = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def windows(codes: np.ndarray, k: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hashes of the k-word windows at each start; empty if there are fewer words."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    h = codes[:n].copy()
    for i in range(1, k):
        h *= base
        h += codes[i : n + i]
    return mix(h)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
