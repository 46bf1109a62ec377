"""Operator 12: periodic runs of words, found with a dictionary of basic factors.

The dictionary names every factor of 1, 2, 4, 8, ... words; two names make the name of the factor twice as long. A run with
period q holds factors of m words, m the power of two with m/2 < q <= m, that come again after q words and not sooner:
successor occurrences at distances over m/2 and up to m, which follow each other without a gap, propose the period. A proposal that
is long enough is extended word by word and kept once. Factors without another occurrence in reach are dropped from the dictionary.

Texts are taken many at a time, parted by names that occur once, so that no factor of two texts is ever equal to another.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small, words_of

#: A run has at least so many words, and so many times its period.
LEAST, POWER = 6, 4

#: Words of the texts that are searched together.
TOGETHER = 200_000

Run = tuple[int, int, int]


def _proposed(name: np.ndarray, reach: np.ndarray, least: int, power: int) -> Iterator[Run]:
    """Stretches (start, length, period) by level of the dictionary. ``reach``: the longest period at each word."""
    n, m = len(name), 1
    pos = np.flatnonzero(reach > 0)
    longest = int(reach.max()) if n else 0
    while m // 2 + 1 <= longest and len(pos):
        key = np.sort(name[pos] * n + pos)
        same = key[1:] // n == key[:-1] // n
        at, after = key[:-1] % n, key[1:] % n
        gap = after - at
        near = same & (gap <= reach[at])
        ask = near & (gap > m // 2) & (gap <= m)
        start, period = at[ask], gap[ask]
        order = np.argsort(start)
        start, period = start[order], period[order]
        if len(start):
            cut = np.flatnonzero((np.diff(start) != 1) | (np.diff(period) != 0))
            first, last = np.append(0, cut + 1), np.append(cut, len(start) - 1)
            s, q = start[first], period[first]
            length = start[last] - s + m + q
            for i in np.flatnonzero(length >= np.maximum(least, power * q)):
                yield int(s[i]), int(length[i]), int(q[i])
        keep = np.zeros(n, bool)
        keep[at[near]] = keep[after[near]] = True
        pos = np.flatnonzero(keep[: n - m] & keep[m:]) if n > m else pos[:0]
        _, twice = np.unique(name[pos] * n + name[pos + m], return_inverse=True)
        name = np.zeros(n, np.int64)
        name[pos] = twice
        m *= 2


def find_runs(texts: list[list[bytes]], least: int = LEAST, power: int = POWER) -> list[list[Run]]:
    """Of each list of words its runs (start, length, period), by start, then period.

    A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``power`` (3 or more) times q
    long, that no word beside it extends with that period. Time grows with the words times the logarithm of their number.
    """
    if power < 3:
        raise ValueError("power must be 3 or more")
    ids: defaultdict[bytes | int, int] = defaultdict(count().__next__)
    sizes = [len(t) for t in texts]
    ends = np.cumsum([n + 1 for n in sizes]) if texts else np.empty(0, np.int64)  # a text and the name that parts it from the next
    name = np.fromiter((ids[w] for k, t in enumerate(texts) for w in (*t, k)), np.int64, int(ends[-1]) if texts else 0)
    reach = np.repeat(np.array(sizes, np.int64) // power, np.array(sizes, np.int64) + 1)
    out: list[set[Run]] = [set() for _ in texts]
    for start, length, q in _proposed(name, reach, least, power):
        end = start + length
        while start and name[start - 1] == name[start - 1 + q]:
            start -= 1
        while end < len(name) and name[end] == name[end - q]:
            end += 1
        k = int(np.searchsorted(ends, start, side="right"))
        out[k].add((start - (int(ends[k - 1]) if k else 0), end - start, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats: all of it but its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, x in zip(words, np.cumsum(edge[:-1]), strict=True) if not x]


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """``df`` with n_words (long), runs (array of start, length, period; by start, then period) and collapsed (string).

    Words are cut at \\x20 and \\x09-\\x0D and compared as they are. ``collapsed`` holds the words that no run repeats, with one
    blank between. Null and empty texts have no words, no runs and an empty ``collapsed``. Texts are searched whole. Rows
    don't depend on each other; columns of these names are replaced, all others kept.
    """
    df = df.drop("n_words", "runs", "collapsed")
    at = df.columns.index(text)
    plain = df.withColumn(text, F.col(text).cast("binary"))  # bytes are not decoded on the way
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            texts = [(t or b"").split() for t in b.column(at).to_pylist()]
            done, n = 0, 0
            for i, t in enumerate(texts):
                n += len(t)
                if n < TOGETHER and i < len(texts) - 1:
                    continue
                own = texts[done : i + 1]
                runs = find_runs(own, least, power)
                ends = np.cumsum([0, *map(len, runs)])
                flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
                made = [
                    pa.array([len(t) for t in own], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(run))),
                    pa.array([b" ".join(collapse(t, r)).decode() for t, r in zip(own, runs, strict=True)], pa.string())
                ]
                yield pa.RecordBatch.from_arrays([*b.slice(done, len(own)).columns, *made], names=[*b.schema.names, "n_words", "runs", "collapsed"])
                done, n = i + 1, 0

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in plain.schema.fields)
    made = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return plain.mapInArrow(batches, schema + made).withColumn(text, F.col(text).cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of ties the one with the smallest start, then period. Null without runs."""
    return F.reduce(
        runs, F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    )


def looped(doc_id: Column, text: Column) -> Column:
    """The text, and for a tenth of the ids its words with a tail that repeats itself. Null ids leave the text as it is."""
    words = words_of(text)
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    tail = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    made = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(made, " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    best = strongest(F.col("runs"))
    found = periodic_runs(docs).select("doc_id", "runs", "collapsed", best.alias("best"))
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256")
    )


OP12_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    xor(list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint)), lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), cast(4294967295 as bigint)), 4294967295) as h from documents),
f as (select *, len(ws) as n, (h // 10) % greatest(len(ws), 1) as a from d),
g as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from f),
l as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: ws[1 + case when i < a then i else a + (i - a) % p end]) else ws end as ws from g),
u as (select doc_id, n, i, ws[i + 1] as word from (select *, unnest(range(n)) as i from l)),
e as (select x.doc_id, y.i - x.i as q, x.i as i from u x join u y on y.doc_id = x.doc_id and y.word = x.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
s as (select doc_id, q, min(i) as s, count(*) + q as n from (select *, i - row_number() over (partition by doc_id, q order by i) as part from e) group by doc_id, q, part having count(*) + q >= greatest(6, 4 * q)),
r as (select * from s where not exists (select 1 from s o where o.doc_id = s.doc_id and o.q < s.q and o.s <= s.s and o.s + o.n >= s.s + s.n)),
k as (select doc_id, count(*) as n_runs, string_agg(concat(s, ',', n, ',', q, chr(10)), '' order by s, q) as runs from r group by doc_id),
b as (select * from r qualify row_number() over (partition by doc_id order by cast(n as double) / q desc, s, q) = 1),
gone as (select distinct doc_id, unnest(range(s + q, s + n)) as i from r),
c as (select u.doc_id, string_agg(word, ' ' order by u.i) as kept from u left join gone on gone.doc_id = u.doc_id and gone.i = u.i where gone.i is null group by u.doc_id)
select l.doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.n as length, b.q as period, 1000 * b.n // b.q as exponent_milli, sha256(coalesce(runs, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from l left join k using (doc_id) left join b using (doc_id) left join c using (doc_id)
"""
