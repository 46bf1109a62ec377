"""Operator 8: repeated passages by prefix-partitioned suffix trees.

A word goes if a window of ``window`` words over it also starts in a document with a smaller id. Suffixes are
sampled by content: of every window the k-word piece with the smallest hash is its anchor
(the first of equal ones), and the suffix that starts there stands for all windows that have it.
Equal windows have equal anchors, so no repeat is lost; about one position in five is a suffix. A suffix travels
with the words of its windows, those before the anchor too. Suffixes are dealt to groups by their prefix: the words of
the anchor, and where many suffixes are counted at an anchor as many words more as would part them into groups that fit, a word for
each doubling, up to a whole window. A window that ends before its prefix does is dealt by the words before the anchor in place of those
that it lacks. The number of groups follows from the counted suffixes, so that each fits in memory.

In a group suffixes are sorted by their words, and the common prefixes of neighbours give the nodes of the tree; the
words before the anchor, read backwards, make a second one. A node of each, whose depths are
a window in all, holds the documents that repeat it: all but the smallest lose the words. All comparisons are of words;
hashes only choose anchors and groups. Longest repeats are runs of such windows (``spans``).

Most windows have an anchor that one document has alone and are left out before. What meets in one Arrow batch
is settled there by the same trees and sent once, so a passage that a third of the documents share arrives
once a batch, not once a document.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE_2, CODES, mix, read, signed, small, stage_table, windows, word_codes

#: Words of a window and of an anchor.
WINDOW, ANCHOR = 13, 5
#: Bits of an anchor's code. Fewer make the shuffle smaller; clashes only let more windows through to the exact step.
ANCHOR_BITS = 44
#: Groups for each shuffle partition at least, suffixes of a group, suffixes of a prefix from which it is split into
#: longer ones, and anchors of a group that are walked at once.
GROUPS, GROUP_ROWS, PREFIX_ROWS, GROUP_CODES = 2, 100_000, 4_000, 4_000_000


def _leftmost_min(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the first of equal ones, by doubling."""
    done, low, at = 1, x, np.arange(len(x))
    while done < width:
        step = min(done, width - done)
        n = len(low) - step
        right = low[step:] < low[:n]
        low, at = np.where(right, low[step:], low[:n]), np.where(right, at[step:], at[:n])
        done += step
    return at


def window_anchors(codes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the anchor of the window at each start."""
    if len(codes) < window:
        return np.empty(0, np.uint64), np.empty(0, int)
    pieces = windows(codes, anchor) >> np.uint64(64 - ANCHOR_BITS)
    at = _leftmost_min(pieces, window - anchor + 1)
    return pieces[at], at


#: A dealt row: what one batch has for one group, as sorted codes and their documents. Asks (0) wait for an
#: answer, answers (1) have it, marks (2) tell how many documents of the batch a code has.
DEALT = "grp int, n array<int>, codes array<binary>, docs array<binary>"
ASK, ANSWER, MARK = range(3)
#: Answers on their way to their documents, and the documents with theirs.
SENT = "grp int, n int, codes binary, docs binary"
ANSWERS = "doc_id long, codes array<long>"

Pairs = tuple[np.ndarray, np.ndarray]
#: Above the bits of a shared anchor's code stands the number of words that its prefix has more than the anchor.
LONGER = np.uint64(ANCHOR_BITS)
ONLY = np.uint64((1 << ANCHOR_BITS) - 1)
NONE: Pairs = (np.empty(0, np.uint64), np.empty(0, np.int64))


def _encode(codes: np.ndarray, docs: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted codes as the first and the gaps, and document ids; both in four bytes each where they fit."""
    if not len(codes):
        return b"", b""
    gap = np.diff(codes)
    return codes[:1].tobytes() + (gap.astype("<u4") if len(gap) and int(gap.max()) < 2**32 else gap).tobytes(), (
        docs.astype("<u4") if docs.min() >= 0 and docs.max() < 2**32 else docs
    ).tobytes()


def _decode(n: int, gaps: bytes, ids: bytes) -> Pairs:
    if not n:
        return NONE
    rest = np.frombuffer(gaps[8:], "<u4" if len(gaps) - 8 == 4 * (n - 1) else "<u8").astype(np.uint64)
    codes = np.cumsum(np.concatenate([np.frombuffer(gaps[:8], "<u8"), rest]), dtype=np.uint64)
    return codes, np.frombuffer(ids, "<u4" if len(ids) == 4 * n else "<i8").astype(np.int64)


def _pack(shift: int, *kinds: Pairs) -> pa.RecordBatch:
    """One row for each group that asks, answers or marks fall in."""
    kinds = [(c[o], d[o]) for c, d in (*kinds, *[NONE] * (3 - len(kinds))) for o in [np.lexsort((d, c))]]
    own = [(c >> np.uint64(shift)).astype(np.int32) for c, _ in kinds]
    groups = np.unique(np.concatenate(own))
    ends = [(np.searchsorted(g, groups), np.searchsorted(g, groups, "right")) for g in own]
    made = [
        [_encode(c[s[i] : e[i]], d[s[i] : e[i]]) for (c, d), (s, e) in zip(kinds, ends, strict=True)] for i in range(len(groups))
    ]
    n = [[int(e[i] - s[i]) for s, e in ends] for i in range(len(groups))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(groups, pa.int32()), pa.array(n, pa.list_(pa.int32())),
            pa.array([[x[0] for x in m] for m in made], pa.list_(pa.binary())),
            pa.array([[x[1] for x in m] for m in made], pa.list_(pa.binary()))
        ],
        names=["grp", "n", "codes", "docs"]
    )


def _concat(pairs: list[Pairs]) -> Pairs:
    codes, docs = zip(NONE, *pairs, strict=True)
    return np.concatenate(codes), np.concatenate(docs)


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each group, from batches sorted by group."""
    now, rows = None, []
    for b in it:
        for grp, *row in zip(*(b.column(c).to_pylist() for c in ("grp", "n", "codes", "docs")), strict=True):
            if grp != now and rows:
                yield rows
                rows = []
            now = grp
            rows.append(tuple(row))
    if rows:
        yield rows


def longer(n: np.ndarray, fits: int, most: int) -> np.ndarray:
    """Words by which the prefix of ``n`` suffixes grows so that groups of ``fits`` come of it, if each word parts them in two."""
    return np.minimum(np.ceil(np.log2(np.maximum(n / fits, 1.0))), most).astype(np.int64)


def _meet(dealt: DataFrame, shift: int, groups: int, most_words: int) -> DataFrame:
    """(doc_id, codes): the shared anchors of each document that has any. Each group is walked in code order, in parts
    by further bits if it is large; answers are then gathered by document.
    """
    most, common = GROUP_CODES, PREFIX_ROWS

    def part(rows: list[tuple], kind: int, extra: int, at: int) -> Pairs:
        out = []
        for n, codes, docs in rows:
            c, d = _decode(n[kind], codes[kind], docs[kind])
            if extra:
                own = (c >> np.uint64(shift - extra)) & np.uint64(2**extra - 1) == at
                c, d = c[own], d[own]
            out.append((c, d))
        return _concat(out)

    def walk(rows: list[tuple]) -> Iterator[Pairs]:
        extra = min(shift, max(0, (sum(sum(r[0]) for r in rows) - 1) // most).bit_length())
        for at in range(2**extra):
            known, asks, marks = (part(rows, kind, extra, at) for kind in (ANSWER, ASK, MARK))
            met, n = np.unique(np.concatenate([asks[0], marks[0]]), return_counts=True)
            shared = np.union1d(met[n > 1], marks[0])
            of = np.concatenate(([1.0] * len(asks[0]), marks[1]))  # documents with each code
            count = np.bincount(np.searchsorted(met, np.concatenate([asks[0], marks[0]])), of, len(met))
            flags = longer(count[np.searchsorted(met, shared)], common, most_words).astype(np.uint64) << LONGER
            for codes, docs in (known, asks):
                i = np.searchsorted(shared, codes)
                i[i == len(shared)] = 0
                yes = shared[i] == codes if len(shared) else np.zeros(len(codes), bool)
                yield codes[yes] | flags[i[yes]], docs[yes]

    def send(held: list[Pairs]) -> pa.RecordBatch:
        codes, docs = _concat(held)
        to = (mix(docs.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
        grown = codes > ONLY  # apart, as gaps between codes with and without longer prefixes don't fit four bytes
        order = np.lexsort((docs, codes, grown, to))
        codes, docs, to, grown = codes[order], docs[order], to[order], grown[order]
        heads = [*np.flatnonzero(np.append(True, (to[1:] != to[:-1]) | (grown[1:] != grown[:-1])))[: len(to)].tolist(), len(to)]
        made = [_encode(codes[s:e], docs[s:e]) for s, e in itertools.pairwise(heads)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(to[heads[:-1]], pa.int32()), pa.array(np.diff(heads), pa.int32()),
                pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())
            ],
            names=["grp", "n", "codes", "docs"]
        )

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Pairs] = []
        for rows in _groups(it):
            held += walk(rows)
            if sum(len(c) for c, _ in held) > most // 4:
                yield send(held)
                held = []
        yield send(held)

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(it):
            codes, docs = _concat([_decode(*r) for r in rows])
            order = np.argsort(docs, kind="stable")
            codes, docs = codes[order], docs[order]
            heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs[heads]),
                    pa.ListArray.from_arrays(pa.array(np.append(heads, len(docs)).astype(np.int32)), pa.array(signed(codes)))
                ],
                names=["doc_id", "codes"]
            )

    sent = dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(answer, SENT)
    return sent.repartition("grp").sortWithinPartitions("grp").mapInArrow(gather, ANSWERS)


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sorted codes where its run begins, and how long the run is."""
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.empty(0, int)
    size = np.diff(np.append(heads, len(codes)))
    return np.repeat(heads, size), np.repeat(size, size)


def _pairs(per: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of documents and the documents, sorted by both."""
    codes, docs = np.concatenate([*per, np.empty(0, np.uint64)]), np.repeat(ids, [len(x) for x in per])
    order = np.lexsort((docs, codes))
    return codes[order], docs[order]


def _shared_anchors(docs: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    """(doc_id, codes): anchors of a document that another one has too, those of many with a flag."""
    shift = ANCHOR_BITS - bits

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_codes()
        for b in it:
            per = [np.unique(window_anchors(CODES.array(t.split()), window, anchor)[0]) for t in b.column("text").to_pylist()]
            codes, own = _pairs(per, b.column("doc_id").to_numpy())
            many = _runs(codes)[1] > 1
            one, n = np.unique(codes[many], return_counts=True)
            yield _pack(shift, (codes[~many], own[~many]), (codes[many], own[many]), (one, n.astype(np.int64)))

    return _meet(docs.select("doc_id", "text").mapInArrow(deal, DEALT), shift, 2**bits, window - anchor)


class WordIds(dict):
    """Small numbers for words, one each."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


SUFFIX_ARROW = pa.schema(
    [
        ("grp", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.list_(pa.int32())),
        ("left", pa.int32()), ("n", pa.int32()), ("words", pa.binary())
    ]
)
#: A dealt suffix: its document and row, where its first window starts (in more than one place if its words repeat),
#: words before the anchor, number of windows, and their words. Marks, without words, are ``n`` windows from each start
#: that go.
SUFFIX = "grp int, doc_id long, text_hash long, starts array<int>, left int, n int, words binary"
MARKS = "doc_id long, text_hash long, start int, n int"


@dataclass
class Suffixes:
    """Columns of suffixes: group, doc, hash, start, words before the anchor, windows, words."""

    grp: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    start: np.ndarray
    left: np.ndarray
    n: np.ndarray
    words: list[bytes]

    @classmethod
    def joined(cls, parts: list[Suffixes]) -> Suffixes:
        cols = [np.concatenate([getattr(p, f) for p in parts]) for f in ("grp", "doc", "row", "start", "left", "n")]
        return cls(*cols, [w for p in parts for w in p.words])


def _nodes(side: np.ndarray) -> np.ndarray:
    """Nodes of the tree of rows of word numbers: (row, depth), the same number for rows with that many equal leading words."""
    order = np.lexsort(side.T[::-1])
    tied = side[order]
    common = np.cumprod(tied[1:] == tied[:-1], axis=1).sum(axis=1)  # of each with the one before
    out = np.empty((len(side), side.shape[1] + 1), np.int64)
    for depth in range(side.shape[1] + 1):
        out[order, depth] = np.cumsum(np.append(0, common < depth)) if len(side) else 0
    return out


def settle(s: Suffixes, window: int, anchor: int) -> np.ndarray:
    """For each window of each suffix, in a row, whether a smaller document has it too."""
    ids, size = WordIds(), s.n + window - 1
    told = [
        np.fromiter(
            map(ids.__getitem__, b" ".join(s.words[i : i + 4096]).split(b" ")), np.int64
        ) for i in range(0, len(s.words), 4096)
    ]
    words = np.concatenate([*told, np.full(1, -1)])
    first = np.cumsum(size) - size  # of each suffix's words
    at = (first + s.left)[:, None]
    right = at + np.arange(window)
    right = words[np.where(right < (first + size)[:, None], right, -1)]
    back = at - 1 - np.arange(window - anchor)
    back = words[np.where(back >= first[:, None], back, -1)]
    ahead, behind = _nodes(right), _nodes(back)
    later = np.zeros(int(s.n.sum()), bool)
    place = np.cumsum(s.n) - s.n
    for before in range(window - anchor + 1):  # windows with so many words before the anchor
        own = np.flatnonzero((before <= s.left) & (before > s.left - s.n))
        node = ahead[own, window - before] * (len(s.n) + 1) + behind[own, before]
        order = np.lexsort((s.doc[own], node))
        node, doc, own = node[order], s.doc[own][order], own[order]
        head = np.append(True, node[1:] != node[:-1])[: len(node)]
        least = doc[head][np.cumsum(head) - 1] if len(doc) else doc
        later[place[own] + s.left[own] - before] = doc > least
    return later


def _marked_runs(s: Suffixes, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of settled windows, over suffixes that follow each other in a row: the suffix that a run begins in, its
    first start, its number of windows.
    """
    of = np.repeat(np.arange(len(s.n)), s.n)
    i = np.flatnonzero(later)
    of, at = of[i], (s.start - np.cumsum(s.n) + s.n)[of[i]] + i
    new = np.append(True, (np.diff(at) != 1) | (np.diff(s.doc[of]) != 0) | (np.diff(s.row[of]) != 0))[: len(i)]
    return of[new], at[new], np.diff(np.append(np.flatnonzero(new), len(i)))


def _rest(s: Suffixes, later: np.ndarray, window: int) -> Suffixes:
    """Suffixes with windows that are not settled, cut to these."""
    place = np.cumsum(s.n) - s.n
    open_ = np.flatnonzero(~later)
    of = np.repeat(np.arange(len(s.n)), s.n)[open_]
    new = np.append(True, of[1:] != of[:-1])[: len(of)]
    own = of[new]
    low = open_[new] - place[own]
    high = open_[np.append(np.flatnonzero(new)[1:], len(open_)) - 1] - place[own] if len(own) else low
    words = [
        s.words[i] if a == 0 and b == n - 1 else b" ".join(s.words[i].split(b" ")[a : b + window]) for i, a, b,
        n in zip(own.tolist(), low.tolist(), high.tolist(), s.n[own].tolist(), strict=True)
    ]
    return Suffixes(s.grp[own], s.doc[own], s.row[own], s.start[own] + low, s.left[own] - low, high - low + 1, words)


def _places(s: Suffixes) -> tuple[np.ndarray, list[list[int]]]:
    """Of equal suffixes of a row the first, and the starts of all."""
    at: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(s.doc.tolist(), s.row.tolist(), s.left.tolist(), s.words, strict=True)):
        at.setdefault(key, []).append(i)
    return np.array([x[0] for x in at.values()], int), [s.start[x].tolist() for x in at.values()]


def _cut(
    docs: np.ndarray, rows: np.ndarray, texts: list[bytes], shared: np.ndarray, window: int, anchor: int, bits: int
) -> Suffixes | None:
    """The suffixes at shared anchors of some texts."""
    split = [t.split() for t in texts]
    flat = list(itertools.chain.from_iterable(split))
    if len(flat) < window:
        return None
    size = np.array([len(x) for x in split])
    end = np.cumsum(size)
    doc_of = np.repeat(np.arange(len(split)), size)
    codes = CODES.array(flat)
    anchors, at = window_anchors(codes, window, anchor)
    start = np.arange(len(anchors))
    known, first = np.unique(shared & ONLY, return_index=True)
    grown = (shared[first] >> LONGER).astype(np.int64)
    live = np.flatnonzero((start + window <= end[doc_of[start]]) & np.isin(anchors, known))
    more = grown[np.searchsorted(known, anchors[live])] if len(live) else np.empty(0, np.int64)  # words of the prefix behind the anchor
    lacks = np.maximum(more - (window - anchor - (at[live] - live)), 0)  # those that the window does not have
    new = np.append(True, (np.diff(live) > 1) | (at[live[1:]] != at[live[:-1]]) | (lacks[:-1] > 0))[: len(live)]
    low, n = live[new], np.diff(np.append(np.flatnonzero(new), len(live)))
    code = anchors[low] << np.uint64(64 - ANCHOR_BITS)
    more, lacks, before = more[new], lacks[new], at[low] - low
    for k in np.unique(more[more > 0]).tolist():  # a window that lacks words is dealt with those before the anchor, and by its place
        own = np.flatnonzero(more == k)
        place = at[low[own]] - lacks[own]
        h = codes[place]
        for j in range(1, anchor + k):
            h = h * BASE_2 + codes[place + j]
        code[own] = mix(h + np.where(lacks[own] > 0, before[own] + 1, 0).astype(np.uint64))
    grp = code >> np.uint64(64 - bits)
    of = doc_of[low]
    words = [b" ".join(flat[a:b]) for a, b in zip(low.tolist(), (low + n + window - 1).tolist(), strict=True)]
    return Suffixes(grp.astype(np.int32), docs[of], rows[of], low - (end - size)[of], at[low] - low, n, words)


def _repeats(docs: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    """(doc_id, text_hash, start, n): runs of windows of a row that also start in a smaller document, from (doc_id,
    text_hash, text, shared).
    """

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_codes()
        for b in it:
            cut = []
            for x in small([b], 256):
                shared = np.unique(x.column("shared").flatten().to_numpy()).view(np.uint64)
                cut.append(
                    _cut(
                        x.column("doc_id").to_numpy(), x.column("text_hash").to_numpy(), x.column("text").to_pylist(), shared,
                        window, anchor, bits
                    )
                )
            cut = [x for x in cut if x is not None]
            if not cut:
                continue
            s = Suffixes.joined(cut)
            later = settle(s, window, anchor)
            of, start, n = _marked_runs(s, later)
            r = _rest(s, later, window)
            spread = (mix(s.doc[of].view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)  # marks belong to no group
            yield pa.record_batch(
                [
                    spread, s.doc[of], s.row[of], start[:, None].tolist(), pa.nulls(len(of), pa.int32()), n,
                    pa.nulls(len(of), pa.binary())
                ],
                schema=SUFFIX_ARROW
            )
            one, starts = _places(r)
            yield pa.record_batch(
                [r.grp[one], r.doc[one], r.row[one], starts, r.left[one], r.n[one], [r.words[i] for i in one.tolist()]],
                schema=SUFFIX_ARROW
            )

    def told(doc: np.ndarray, row: np.ndarray, starts: pa.ListArray, n: np.ndarray, ahead: np.ndarray) -> pa.RecordBatch:
        """One mark for each start."""
        k = starts.value_lengths().to_numpy()
        return pa.record_batch(
            [
                np.repeat(doc, k), np.repeat(row, k), pa.array(starts.flatten().to_numpy() + np.repeat(ahead, k), pa.int32()),
                pa.array(np.repeat(n, k), pa.int32())
            ],
            names=["doc_id", "text_hash", "start", "n"]
        )

    def trees(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_group(it):
            t = pa.Table.from_batches(parts).combine_chunks()
            done, t = t.filter(pc.is_null(t["words"])), t.filter(pc.is_valid(t["words"]))
            if done.num_rows:
                yield told(
                    *[done[c].to_numpy() for c in ("doc_id", "text_hash")], done["starts"].combine_chunks(), done["n"].to_numpy(),
                    np.zeros(done.num_rows, int)
                )
            if t.num_rows:
                grp, doc, row, left, n = (t[c].to_numpy() for c in ("grp", "doc_id", "text_hash", "left", "n"))
                base = np.arange(t.num_rows) * 2 * window  # apart, so that no run goes on from one suffix to the next
                s = Suffixes(grp, doc, row, base, left, n, t["words"].to_pylist())
                of, at, k = _marked_runs(s, settle(s, window, anchor))
                yield told(doc[of], row[of], t["starts"].combine_chunks().take(pa.array(of)), k, at - base[of])

    dealt = docs.select("doc_id", "text_hash", "text", "shared").mapInArrow(deal, SUFFIX)
    return dealt.repartition("grp").sortWithinPartitions("grp").mapInArrow(trees, MARKS)


def by_group(it: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows of each group, from batches sorted by ``grp``."""
    now, held = None, []
    for b in it:
        grp = b.column("grp").to_numpy()
        for i, j in itertools.pairwise([*np.flatnonzero(np.append(True, grp[1:] != grp[:-1]))[: len(grp)].tolist(), len(grp)]):
            if grp[i] != now and held:
                yield held
                held = []
            now = grp[i]
            held.append(b.slice(i, j - i))
    if held:
        yield held


def marked(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, text, marks) of (doc_id, text_hash, text binary), ids not null: the runs of windows to
    remove, null for none.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = min(30, (parts * GROUPS - 1).bit_length())
    shared = stage_table(_shared_anchors(docs, window, anchor, bits).withColumnRenamed("codes", "shared"), "op8-anchors")
    n = shared.agg(F.coalesce(F.sum(F.size("shared")), F.lit(0))).first()[0]
    bits = min(30, max(bits, (n // GROUP_ROWS).bit_length()))
    # both joins read one exchange of the texts
    repeats = _repeats(docs.join(shared, "doc_id"), window, anchor, bits)
    marks = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("text_hash", "start", "n")).alias("marks"))
    return docs.join(marks, "doc_id", "left").select("doc_id", "text_hash", "text", "marks")


def covered(runs: list[tuple[int, int]], n: int, window: int) -> np.ndarray:
    """Which of n words lie in one of the windows of runs (first start, number)."""
    edge = np.zeros(n + 1, np.int32)
    for start, k in runs:
        edge[start] += 1
        edge[start + k - 1 + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(
    df: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_removed, spans (start and length in words of each removed run) and
    kept_text (the words left, joined by blanks).

    Words are cut at \\x20 and \\x09-\\x0D, unchanged otherwise. A word is removed if a window of
    ``window`` words over it also starts in a document with a smaller id; windows are judged on
    the input. Null, empty and shorter texts lose nothing. Ids are integers; rows with a null id
    lose nothing and make no other lose anything. Rows with the same id do not
    affect each other; each is cut by its own windows.
    """
    id_ = F.col(doc) if (doc, "bigint") in df.dtypes and doc == "doc_id" else F.col(doc).cast("long").alias("doc_id")  # a needless alias would keep the exchange from being shared
    docs = df.select(
        id_, F.xxhash64(F.col(text)).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    )
    named = marked(docs.where("doc_id is not null"), window, anchor)
    rest = docs.where("doc_id is null").select(
        "doc_id", "text_hash", "text", F.lit(None).cast("array<struct<text_hash:long,start:int,n:int>>").alias("marks")
    )
    spans = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            n_words, n_gone, runs, kept = [], [], [], []
            for t, row, marks in zip(*(b.column(c).to_pylist() for c in ("text", "text_hash", "marks")), strict=True):
                words = t.split()
                n_words.append(len(words))
                own = [(m["start"], m["n"]) for m in marks or () if m["text_hash"] == row]
                if own:
                    gone = covered(own, len(words), window)
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
                    runs.append([{"start": int(s), "n": int(e - s)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
                    n_gone.append(int(gone.sum()))
                    words = list(itertools.compress(words, (~gone).tolist()))
                else:
                    runs.append([])
                    n_gone.append(0)
                kept.append(b" ".join(words))
            cols = [
                b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(runs, spans),
                pa.array(kept, pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return named.unionByName(rest).mapInArrow(
        batches, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,n:int>>, kept_text binary"
    ).withColumn("kept_text", F.col("kept_text").cast("string"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, i, md5(array_to_string(ws[i : i + 12], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13)),
m as (select h, min(doc_id) as first from w group by h having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, p from (select w.doc_id, unnest(range(i, i + 13)) as p from w join m on w.h = m.h and w.doc_id > m.first)),
k as (
  select x.doc_id, string_agg(x.word, ' ' order by x.p) as kept, count(*) as n
  from (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d) x
  left join gone g on g.doc_id = x.doc_id and g.p = x.p where g.p is null group by x.doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (doc_id)
"""
