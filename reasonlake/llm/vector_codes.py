"""Operator 13: vector codes by part, assigned with adaptive bounds.

Vectors of integers are cut into equal parts; each part position has a codebook, and a part's code is the
nearest entry of it. Codebooks are moved by rounds of assigning and averaging. So that a round needn't compare each
part with each entry, every part keeps its ``b`` closest entries in order, a lower bound of the distance to each (which holds for all
later ones as well) and one outer bound for the entries that it doesn't keep. When entries move, bounds
shrink by as much; only entries whose bound doesn't exceed the distance to the last assigned entry are compared, on integers, and
only if the outer bound is passed are all of them. Parts that need fewer bounds than they have keep fewer from then on.

The rows with their bounds are written to the shared folder after each round. Only codebooks and sums by entry
pass the driver: their size follows from entries and width, not from the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small, stage_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256

#: Bounds a part begins with and keeps at least, as shares of the entries.
FIRST, FEWEST = 1 / 8, 1 / 16

#: Components are held within these limits, so that sums of squares are whole numbers of 64 bits.
LIMIT = 1 << 26

_I = np.int64


def _low_root(d: np.ndarray) -> np.ndarray:
    """The largest integer whose square isn't over ``d``, or one less."""
    r = np.sqrt(d.astype(np.float64)).astype(_I)
    return r - (r * r > d)


def _high_root(d: np.ndarray) -> np.ndarray:
    r = _low_root(d)
    r += r * r < d
    return r + (r * r < d)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to all entries."""
    out = np.zeros((len(x), len(entries)), _I)
    for j in range(x.shape[1]):
        gap = x[:, j, None] - entries[None, :, j]
        out += gap * gap
    return out


class Bounds:
    """Of some rows and one part: closest entries in order, lower bounds of the distance to each and one for all others."""

    def __init__(self, near: np.ndarray, lower: np.ndarray, outer: np.ndarray) -> None:
        self.near, self.lower, self.outer = near, lower, outer

    @classmethod
    def fresh(cls, x: np.ndarray, entries: np.ndarray, b: int) -> tuple[Bounds, np.ndarray]:
        """All entries compared; also the squared distances to the nearest ones. Ties go to the lower entry."""
        d = _squares(x, entries)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.take_along_axis(d, order[:, : b + 1], 1)
        roots = _low_root(d)
        outer = roots[:, b] if b < len(entries) else np.full(len(x), 2 * LIMIT * 256, _I)
        return cls(order[:, :b].astype(np.uint8), roots[:, :b], outer), d[:, 0]

    def move(self, x: np.ndarray, entries: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, int, int]:
        """Assign again after entry j moved by at most ``moved[j]``: squared distances, the bounds that were needed, and rows compared with all entries."""
        n, b = self.near.shape
        self.outer = np.maximum(self.outer - moved.max(), 0)
        bound = np.maximum(self.lower - moved[self.near], 0)
        bound = np.minimum.accumulate(np.column_stack([bound, self.outer])[:, ::-1], axis=1)[:, ::-1]
        self.lower, self.outer = bound[:, :b].copy(), bound[:, b].copy()
        gap = x - entries[self.near[:, 0]]
        best = (gap * gap).sum(axis=1)
        # bounds from rank i on hold for all entries behind it as well
        rank = (bound[:, 1:] * bound[:, 1:] <= best[:, None]).sum(axis=1)  # ordered, so the first ones fail
        all_ = rank == b  # the outer bound fails too
        for i in np.unique(rank[~all_ & (rank > 0)]):
            rows = np.flatnonzero(rank == i)
            ask = self.near[rows, : i + 1].astype(_I)
            gap = x[rows, None, :] - entries[ask]
            d = (gap * gap).sum(axis=2)
            order = np.lexsort((ask, d), axis=1)
            self.near[rows, : i + 1] = np.take_along_axis(ask, order, 1)
            d = np.take_along_axis(d, order, 1)
            self.lower[rows, : i + 1] = np.minimum(_low_root(d), self.lower[rows, i + 1 : i + 2] if i + 1 < b else self.outer[rows, None])
            best[rows] = d[:, 0]
        if all_.any():
            made, best[all_] = Bounds.fresh(x[all_], entries, b)
            self.near[all_], self.lower[all_], self.outer[all_] = made.near, made.lower, made.outer
        some = rank[~all_]
        return best, int(some.max()) + 1 if len(some) else b, int(all_.sum())

    def keep(self, b: int) -> None:
        """Fewer bounds: the first one that goes bounds all entries outside."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b])
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]


def _pack(bounds: list[Bounds]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """How many bounds each part keeps, and by row the entries and the bounds of all parts."""
    near = np.concatenate([x.near for x in bounds], axis=1)
    lower = np.concatenate([np.column_stack([x.lower, x.outer]) for x in bounds], axis=1).astype(np.uint64)
    return np.array([x.near.shape[1] for x in bounds], np.uint16), [r.tobytes() for r in near], [r.tobytes() for r in lower]


def _unpack(kept: bytes, near: list[bytes], lower: list[bytes]) -> list[Bounds]:
    sizes = np.frombuffer(kept, np.uint16).astype(_I)
    n = np.frombuffer(b"".join(near), np.uint8).reshape(len(near), -1)
    d = np.frombuffer(b"".join(lower), np.uint64).reshape(len(near), -1).astype(_I)
    a, c = np.cumsum([0, *sizes]), np.cumsum([0, *(sizes + 1)])
    return [Bounds(n[:, a[p] : a[p + 1]].copy(), d[:, c[p] : c[p + 1] - 1], d[:, c[p + 1] - 1]) for p in range(len(sizes))]


_STATE = ["__ints", "__code", "__error", "__kept", "__near", "__lower"]
_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
_STATE_SCHEMA = "__ints binary, __code binary, __error long, __kept binary, __near binary, __lower binary"


def _rest_schema(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _begin(usable: DataFrame, names: list[str], codebooks: np.ndarray, scale: float) -> DataFrame:
    """First assignment, all entries compared. ``codebooks``: part, entry, position."""
    parts, entries, width = codebooks.shape
    b = max(1, min(entries, round(entries * FIRST)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it, 4096):
            x = _integers(batch.column(len(names)), scale).reshape(-1, parts, width)
            made, d = zip(*(Bounds.fresh(x[:, p], codebooks[p], b) for p in range(parts)), strict=True)
            yield _batch(batch.columns[: len(names)], names, x, list(made), sum(d))

    return usable.mapInArrow(batches, _rest_schema(usable, names) + _STATE_SCHEMA)


def _batch(rest: list, names: list[str], x: np.ndarray, bounds: list[Bounds], error: np.ndarray) -> pa.RecordBatch:
    kept, near, lower = _pack(bounds)
    code = np.column_stack([o.near[:, 0] for o in bounds])
    made = [[r.tobytes() for r in x.astype(np.int32)], [r.tobytes() for r in code], error, [kept.tobytes()] * len(x), near, lower]
    return pa.RecordBatch.from_arrays([*rest, *(pa.array(m, t) for m, t in zip(made, _TYPES, strict=True))], names=[*names, *_STATE])


def _again(state: DataFrame, names: list[str], before: np.ndarray, codebooks: np.ndarray) -> DataFrame:
    """The next assignment, after the entries moved."""
    parts, entries, width = codebooks.shape
    moved = _high_root(((codebooks - before) ** 2).sum(axis=2))
    fewest = max(1, round(entries * FEWEST))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it, 4096):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            kinds = columns["__kept"].to_pylist()
            for kept in dict.fromkeys(kinds):  # rows that keep as many bounds
                at = pa.array([i for i, k in enumerate(kinds) if k == kept])
                own = {n: c.take(at) for n, c in columns.items()}
                x = np.frombuffer(b"".join(own["__ints"].to_pylist()), np.int32).reshape(-1, parts, width).astype(_I)
                bounds = _unpack(kept, own["__near"].to_pylist(), own["__lower"].to_pylist())
                error = np.zeros(len(x), _I)
                for p, o in enumerate(bounds):
                    d, used, _ = o.move(x[:, p], codebooks[p], moved[p])
                    error += d
                    o.keep(max(fewest, used))
                yield _batch([own[n] for n in names], names, x, bounds, error)

    return state.mapInArrow(batches, _rest_schema(state, names) + _STATE_SCHEMA)


def _averaged(state: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Each entry as the mean of its parts, rounded down; entries without parts stay."""
    parts, entries, width = codebooks.shape
    cells = parts * entries

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((cells, width), _I), np.zeros(cells, _I)
        for batch in small(it, 4096):
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).reshape(-1, parts, width).astype(_I)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                cell = p * entries + code[:, p].astype(_I)
                n += np.bincount(cell, minlength=cells)
                np.add.at(total, cell, x[:, p])
        used = np.flatnonzero(n)
        flat = total[used].ravel()
        where = (used[:, None] * (width + 1) + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(where, used * (width + 1) + width)), pa.array(np.append(flat, n[used]))], names=["at", "sum"])

    rows = state.select("__ints", "__code").mapInArrow(sums, "at long, sum long").groupBy("at").agg(F.sum("sum").alias("sum")).collect()
    got = np.zeros((cells, width + 1), _I)
    for r in rows:  # at most a row for each component of the codebooks and one for each entry
        got[r["at"] // (width + 1), r["at"] % (width + 1)] = r["sum"]
    used = got[:, width] > 0
    out = codebooks.reshape(cells, width).copy()
    out[used] = got[used, :width] // got[used, width:]
    return out.reshape(codebooks.shape)


def _integers(vectors: pa.ListArray, scale: float) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -LIMIT, LIMIT).astype(_I)


def vector_codes(
    df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """Codes of the usable rows with all other columns, and the codebooks (part, entry, position).

    Adds code (binary, one byte a part) and error (long, squared distances summed over parts); columns of these names are
    replaced, the vector is left out. Components become floor(scale * x), held within 2^26. Dropped are rows whose vector is
    null, empty, holds null or non-finite components or no multiple of ``parts`` of them, or has another length than the
    usable one with the smallest id. Codebooks begin as the parts of the ``entries`` (256 at most) smallest ids, null ids
    last, equal ids by their vectors; with fewer rows they are smaller. Of entries at the same distance the first is
    taken. Equal rows get equal codes. Without usable rows the result is empty and so are the codebooks.
    """
    names = [n for n in df.columns if n not in (vector, "code", "error")]
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is the largest of all numbers here
    usable = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0)).where(whole)
    first = F.col(id_column).asc_nulls_last()
    head = usable.orderBy(first, vector).limit(1).select(F.size(vector)).first()
    if head is None:
        made = df.select(*names, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False))
        return made, np.zeros((parts, 0, 0), _I)
    usable = usable.where(F.size(vector) == head[0])
    seed = usable.orderBy(first, vector).limit(min(entries, 256)).select(F.transform(vector, lambda x: x.cast("double")).alias("v")).collect()
    codebooks = np.clip(np.floor(np.array([r["v"] for r in seed]) * scale), -LIMIT, LIMIT).astype(_I).reshape(len(seed), parts, -1).transpose(1, 0, 2)

    state = stage_table(_begin(usable.select(*names, vector), names, codebooks, scale), "vector-codes", compression="zstd")
    for i in range(rounds):
        before, codebooks = codebooks, _averaged(state, codebooks)
        state = _again(state, names, before, codebooks)
        if i < rounds - 1:
            state = stage_table(state, "vector-codes", compression="zstd")
    return state.select(*names, F.col("__code").alias("code"), F.col("__error").alias("error")), codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel())).encode()).hexdigest()


#: Labels whose sums are sent to every executor; more are joined by a shuffle that splits common labels.
FEW_LABELS = 100_000


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes(read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    coded = stage_table(coded, "vector-coded")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    if sums.count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )


#: One assignment, and one move of the entries, of ``OP13_SQL``.
_ASSIGN = """a{r} as (select i, p, min(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - y[j]) * (x[j] - y[j]))) * 64 + k) as m from parts join c{r} using (p) group by i, p)"""
_MOVE = """s{n} as (select p, m % 64 as k, j, sum(x[j]) as s, count(*) as n from a{r} join parts using (i, p), unnest(range(1, len(x) + 1)) as u(j) group by 1, 2, 3),
t{n} as (select p, k, list(cast((s - ((s % n) + n) % n) // n as bigint) order by j) as y from s{n} group by 1, 2),
c{n} as (select c{r}.p, c{r}.k, coalesce(t{n}.y, c{r}.y) as y from c{r} left join t{n} on t{n}.p = c{r}.p and t{n}.k = c{r}.k)"""
OP13_SQL = f"""
with e as (
  select row_number() over (order by vec_id) - 1 as i, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select i, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as x from e, unnest(range(16)) as u(p)),
c0 as (select p, i as k, x as y from parts where i < 64),
{_ASSIGN.format(r=0)}, {_MOVE.format(r=0, n=1)},
{_ASSIGN.format(r=1)}, {_MOVE.format(r=1, n=2)},
{_ASSIGN.format(r=2)},
coded as (select i, string_agg(lpad(lower(to_hex(m % 64)), 2, '0'), '' order by p) as code, cast(sum(m // 64) as bigint) as error from a2 group by i),
books as (select sha256(string_agg(cast(y[j] as varchar), ',' order by p, k, j)) as codebooks_sha256 from c2, unnest(range(1, len(y) + 1)) as u(j))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from e join coded using (i), books
"""
