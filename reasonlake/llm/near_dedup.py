"""Operator 1: near-duplicate classes by MinHash and a multi-index Hamming join.

Every distinct shingle set gets a signature of 16-bit MinHash symbols, cut into chunks. If
two signatures differ in at most ``chunks * (errors + 1) - 1`` symbols, some chunk
differs in at most ``errors`` of them (pigeonhole). The allowed errors are enumerated by
leaving out each choice of ``errors`` symbols of a chunk, so the two meet in at least one key.
The number of chunks follows from the similarity asked for: a pair at the threshold is
over that distance with a chance below ``MISS``.

Keys with several members are clustered by leaders instead of by pairs: a member is tied to the
leaders within a radius from which, by the triangle inequality, any two signatures
within the distance end in the same group. Each group is then linked by its full
sets, with an inverted index of shingles, and only a spanning forest of the links is kept. In a group that is too large
for a task, all
members are first compared with one of them, and only those that it doesn't link are compared with all.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, BASE_2, CODES, mix, read, signed, small, stage_table, windows, word_codes

#: Chance that a pair at the threshold is beyond the distance that the keys guarantee.
MISS = 1e-6
#: Members of a key that one task clusters before the key is salted; shingles of a group that one task links before the
#: group is cut into blocks.
KEY_MEMBERS, GROUP_SHINGLES = 4096, 4_000_000


@dataclass(frozen=True)
class Index:
    """Chunks of ``width`` symbols, of which ``errors`` may differ."""

    chunks: int
    width: int = 5
    errors: int = 1

    @property
    def symbols(self) -> int:
        return self.chunks * self.width

    @property
    def distance(self) -> int:
        """Signatures that differ in no more symbols share a key."""
        return self.chunks * (self.errors + 1) - 1

    @classmethod
    def for_similarity(cls, similarity: float, miss: float = MISS, width: int = 5, errors: int = 1) -> Index:
        for chunks in range(2, 400):
            index = cls(chunks, width, errors)
            n, p = index.symbols, 1 - similarity
            over = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(index.distance + 1, n + 1))
            if over <= miss:
                return index
        raise ValueError("similarity too low for these chunks")

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """Keys of signatures (rows x symbols): one for each chunk and each choice of symbols left out."""
        parts = signature.reshape(len(signature), self.chunks, self.width).astype(np.uint64)
        out = []
        for c in range(self.chunks):
            for kept in itertools.combinations(range(self.width), self.width - self.errors):
                h = np.full(len(parts), hash((c, *kept)) % 2**64, np.uint64)
                for i in kept:
                    h = mix(h * BASE + parts[:, c, i] + np.uint64(i + 1))
                out.append(h)
        return np.stack(out, axis=1)


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles, A-Z lower-cased; all words as one if there are fewer; none without words."""
    codes = CODES.array(text.lower().split())
    return np.unique(windows(codes, min(words, len(codes)))) if len(codes) else np.empty(0, np.uint64)


def multipliers(symbols: int) -> np.ndarray:
    return mix(np.arange(1, symbols + 1, dtype=np.uint64) * BASE_2) | np.uint64(1)


def signature(of: np.ndarray, by: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols of a set; long sets go in slices."""
    low = np.full(len(by), 2**32 - 1, np.uint32)
    for i in range(0, len(of), 2048):
        np.minimum(low, ((of[i : i + 2048, None] * by) >> np.uint64(32)).min(axis=0).astype(np.uint32), out=low)
    return (mix(low.astype(np.uint64) + BASE) & np.uint64(0xFFFF)).astype(np.uint16)


def _sets(docs: DataFrame, words: int, index: Index) -> DataFrame:
    """(doc_id, text_hash, n, set_a, set_b, sig) of (doc_id, text_hash, text binary). set_a and set_b name a set by 128 bits."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_codes()
        by = multipliers(index.symbols)
        for b in small(it):
            n, set_a, set_b, sig = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t or b"", words)
                n.append(len(s))
                if len(s):
                    m = mix(s)
                    set_a.append(int(mix(m.sum(keepdims=True)).view(np.int64)[0]))
                    set_b.append(int((np.bitwise_xor.reduce(m * BASE) ^ np.uint64(len(s))).astype(np.uint64).view(np.int64)))
                    sig.append(signature(s, by).tobytes())
                else:
                    set_a.append(None)
                    set_b.append(None)
                    sig.append(None)
            cols = [
                b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(set_a, pa.int64()),
                pa.array(set_b, pa.int64()), pa.array(sig, pa.binary())
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n", "set_a", "set_b", "sig"])

    return docs.mapInArrow(batches, "doc_id long, text_hash long, n long, set_a long, set_b long, sig binary")


def _keys(items: DataFrame, index: Index) -> DataFrame:
    """(key, node) of (node, sig)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(b.num_rows, index.symbols)
                flat = signed(np.ascontiguousarray(index.keys(sig)).ravel())
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * (len(flat) // b.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["node", "keys"]
                )

    return items.select("node", "sig").mapInArrow(batches, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))


def _runs(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Groups of rows with equal keys, as lists of slices, from batches sorted by them."""
    now, held = None, []
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        heads = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for s, e in itertools.pairwise(heads):
            key = tuple(c[s] for c in cols)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(b.slice(s, e - s))
    if held:
        yield now, held


def _cluster(members: DataFrame, index: Index, keys: list[str], near: int, tie: int) -> DataFrame:
    """Edges (a, b) that tie each member to all leaders of its key within ``tie`` symbols; a member with no leader
    within ``near`` becomes one.

    Members come by falling ``weight``, how many members they meet over all keys, so that the
    centre of a group leads in every key that has it and a member has few leaders. A member
    has one edge, to its first leader; leaders that it ties together have one where they were not tied before, so a key has fewer
    than twice as many edges as members. Only the leaders of the current key are held. They come out as edges to
    themselves as well.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, ids, up = None, None, [], []

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for b in it:
            cols = [b.column(k).to_numpy(zero_copy_only=False).tolist() for k in keys]
            nodes = b.column("node").to_pylist()
            sigs = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(b.num_rows, index.symbols)
            made: list[tuple] = []
            for i, node in enumerate(nodes):
                own = tuple(c[i] for c in cols)
                if own != key:
                    key, heads, ids, up = own, np.empty((16, index.symbols), np.uint16), [], []
                far = (heads[: len(ids)] != sigs[i]).sum(axis=1)
                tied = np.flatnonzero(far <= tie).tolist()
                if not ids or far.min() > near:
                    if len(ids) == len(heads):
                        heads = np.concatenate([heads, np.empty_like(heads)])
                    heads[len(ids)] = sigs[i]
                    tied.append(len(ids))
                    up.append(len(ids))
                    ids.append(node)
                    made.append((*own, node, node))
                first = tied[0]
                if ids[first] != node:
                    made.append((*own, node, ids[first]))
                for j in tied[1:]:
                    x, y = find(first), find(j)
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        if ids[j] != node:
                            made.append((*own, ids[j], ids[first]))
            values = list(zip(*made, strict=True)) or [[] for _ in range(len(keys) + 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(v, b.schema.field(k).type if k in keys else pa.int64()) for v,
                    k in zip(values, [*keys, "a", "b"], strict=True)
                ],
                names=[*keys, "a", "b"]
            )

    kinds = dict(members.dtypes)
    dealt = members.select(*keys, "weight", "node", "sig").repartition(*keys).sortWithinPartitions(*keys, F.desc("weight"), "node")
    return dealt.mapInArrow(batches, "".join(f"{k} {kinds[k]}, " for k in keys) + "a long, b long")


def _tie(met: DataFrame, known: DataFrame, index: Index, key_members: int = KEY_MEMBERS) -> DataFrame:
    """Edges (a, b) by which members of a key (key, node, salt) within the index's distance of each other end in one
    group. ``known``: node, weight, sig.

    A member is within ``near`` of a leader, so one that it is within ``reach`` of is within near + reach of that leader.
    In a salted key the leaders of two such members are within 2 * near + reach, and one of the leaders of these is
    within ``near``
    of the one, so within 3 * near + reach of the other. Leaders that are too many for a task are dealt in blocks, and every two blocks
    meet in a task of their own: no two leaders fail to meet, and no task has more than ``key_members`` of them or so.
    """
    near, reach = index.distance // 2, index.distance
    tied = stage_table(_cluster(met.join(known, "node"), index, ["key", "salt"], near, near + reach), "op1-tied")
    heads = tied.where("salt >= 0 AND a = b").select("key", F.col("a").alias("node"))
    sizes = heads.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / key_members).cast("int").alias("parts"))
    blocks = F.when(F.col("parts") > 1, 2 * F.col("parts")).otherwise(1)
    own = heads.join(sizes, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    each = own.select("key", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = each.select("key", "node", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    return tied.select("a", "b").unionAll(_cluster(pairs.join(known, "node"), index, ["key", "one", "two"], near, 3 * near + reach).select("a", "b"))


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the smallest node that it reaches.

    Rounds of large-star and small-star: every node hands its larger neighbours to the
    smallest one, then its smaller neighbours and itself to the smallest. Each round is written to the shared folder;
    they end when no edge changes.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        seen = both.join(low, "a")
        if large:
            return seen.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return seen.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()

    now = stage_table(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    n = now.count()
    while n:
        was, before = now, n
        now = stage_table(star(star(was, True), False), name)
        n = now.count()
        if n == before and now.join(was, ["a", "b"], "left_anti").isEmpty():
            break
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())


def link_group(sets: list[np.ndarray], per: int, of: int, only: list[int] | None = None) -> np.ndarray:
    """Roots of the components of sets, linked where ``of * |a & b| >= per * |a | b|``: for each set the smallest index
    that it reaches.

    One set is compared with all others at a time, through postings of shingles. Sets
    of the largest component found so far need not be compared with each other, so
    only the others are looked up after the first pass. With ``only``, just these sets are compared with all.
    """
    n = len(sets)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    size = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    postings, ends = owner[order], np.cumsum(np.bincount(token))
    starts = np.append(0, ends[:-1])
    tokens = np.split(token, np.cumsum(size)[:-1])

    def compare(i: int) -> None:
        both = np.bincount(np.concatenate([postings[starts[t] : ends[t]] for t in tokens[i]]), minlength=n)
        for j in np.flatnonzero(of * both >= per * (size + size[i] - both)).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)

    if only is not None:
        for i in only:
            compare(i)
        return np.array([find(i) for i in range(n)])
    hub = int(np.argmax(np.add.reduceat(np.bincount(token)[token], np.append(0, np.cumsum(size)[:-1])) / size))  # its shingles are the most common
    compare(hub)
    for i in range(n):
        if i != hub and find(i) != find(hub):
            compare(i)
    return np.array([find(i) for i in range(n)])


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)


def _link(members: DataFrame, words: int, per: int, of: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links in each part (gid, one, two); where it has ``open`` members, of
    the links that these have.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_codes()
        ones, twos = [], []
        for _, parts in _runs(it, ["gid", "one", "two"]):
            texts, nodes, open_ = ([x for p in parts for x in p.column(c).to_pylist()] for c in ("text", "node", "open"))
            only = None if None in open_ else [i for i, x in enumerate(open_) if x]
            for i, r in enumerate(link_group([shingles(t, words) for t in texts], per, of, only).tolist()):
                if r != i:
                    ones.append(nodes[i])
                    twos.append(nodes[r])
            if len(ones) > 10_000:
                yield _linked(ones, twos)
                ones, twos = [], []
        yield _linked(ones, twos)

    by = ["gid", "one", "two"]
    return members.select(*by, "node", "text", "open").repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(batches, "a long, b long")


def _link_hub(members: DataFrame, words: int, per: int, of: int) -> DataFrame:
    """Edges (a, b) from members of parts (gid, one) to the hub of their group, which each part has (``hub``) and reads
    first. Members pass through one by one.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_codes()
        for _, parts in _runs(it, ["gid", "one"]):
            hub, name, found = None, None, []
            for p in parts:
                for node, text, first in zip(*(p.column(c).to_pylist() for c in ("node", "text", "hub")), strict=True):
                    own = shingles(text, words)
                    if first:
                        hub, name = own, node
                    elif of * (both := int(np.isin(own, hub, assume_unique=True).sum())) >= per * (len(own) + len(hub) - both):
                        found.append(node)
            yield _linked(found, [name] * len(found))

    by = ["gid", "one"]
    return members.select(*by, "node", "text", "hub").repartition(*by).sortWithinPartitions(*by, F.desc("hub")).mapInArrow(batches, "a long, b long")


def _with_texts(docs: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    return docs.join(places, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "node", *keys])  # a row may be repeated


def _link_large(docs: DataFrame, members: DataFrame, words: int, percent: int, group_shingles: int) -> DataFrame:
    """Edges of the links in groups that no task holds: members are root, node, doc_id, text_hash, n, weight and blocks.

    The member that most keys have is the hub, and all are compared with it first, block by block. Members that link with it
    are in one class, so only the others, the open ones, are compared with all: every text is sent twice, and once more
    for each further block of open members.
    """
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    hubs = members.groupBy("root").agg(
        F.max(F.struct("weight", "node", "doc_id", "text_hash", "blocks")).alias("h")
    ).select("root", "h.*")
    own = members.join(hubs.select("node"), "node", "left_anti").select(
        "node", F.col("root").alias("gid"), block.alias("one"), "doc_id", "text_hash", F.lit(False).alias("hub")
    )
    each = hubs.select(
        "node", F.col("root").alias("gid"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("one"), "doc_id",
        "text_hash", F.lit(True).alias("hub")
    )
    near = stage_table(_link_hub(_with_texts(docs, own.unionByName(each), ["one"]), words, percent, 100), "op1-hubs")
    settled = near.select(F.col("a").alias("node")).unionAll(hubs.select("node"))
    rest = stage_table(members.join(settled, "node", "left_anti").select("root", "node", "n"), "op1-open")
    cut = rest.groupBy("root").agg(F.ceil(2 * F.sum("n") / group_shingles).cast("int").alias("cuts"))
    at = members.join(cut, "root").join(rest.select("node", F.lit(True).alias("open")), "node", "left").withColumn("block", block)
    keep = ["node", F.col("root").alias("gid"), "doc_id", "text_hash"]
    part = F.pmod(F.xxhash64("node", F.lit(2)), F.col("cuts")).cast("int")
    # an open member is in its own cut, for all blocks, and in its own block, for the other cuts
    all_ = at.select(
        *keep, F.col("block").alias("one"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("two"),
        (F.coalesce("open", F.lit(False)) & (part == F.col("two"))).alias("open")
    )
    more = at.where("open").select(
        *keep, F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))).alias("one"),
        part.alias("two"), F.lit(True).alias("open")
    )
    places = all_.withColumns({c: F.col(c).cast("int") for c in ("one", "two")}).unionByName(
        more.withColumns({c: F.col(c).cast("int") for c in ("one", "two")})
    )
    return near.unionAll(_link(_with_texts(docs, places, ["one", "two"]), words, percent, 100))


def classes(
    df: DataFrame, words: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text", key_members: int = KEY_MEMBERS,
    group_shingles: int = GROUP_SHINGLES
) -> DataFrame:
    """One row per row of ``df``: doc_id, text_hash, n_shingles, component_id and kept.

    Texts are linked if ``100 * |a & b| >= percent * |a | b|`` over their distinct word shingles;
    component_id is the smallest id reachable, and kept marks that document. Null and empty
    texts and texts of white space have no shingles and link with nothing. Rows with a null
    id have a null component and are kept, and no other row is linked through them. Rows
    with the same id are classed by their own texts. Ids are integers; other columns play no part.
    """
    index = Index.for_similarity(percent / 100)
    docs = df.select(
        F.col(doc).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
        F.col(text).cast("binary").alias("text")
    )
    rows = stage_table(_sets(docs, words, index), "op1-sets")
    first = F.min(F.struct("doc_id", "text_hash", "sig", "n")).alias("f")
    items = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b").agg(first)
    items = stage_table(items.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", "f.*"), "op1-items")  # numbers hold once they are written

    keys = _keys(items, index)
    prints = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"p{i}") for i in (0, 1)]
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("m"), *prints).where("n > 1")
    shared = shared.groupBy("n", "m", "p0", "p1").agg(F.min("key").alias("key")).select("key", "n")  # of keys with the same members one is enough
    salts = F.ceil(F.col("n") / key_members)
    met = stage_table(
        keys.join(shared, "key").select(
            "key", "node", "n", F.when(salts > 1, F.pmod(F.xxhash64("node"), salts)).otherwise(-1).cast("int").alias("salt")
        ),
        "op1-members"
    )
    known = met.groupBy("node").agg(F.sum("n").alias("weight")).join(items.select("node", "sig"), "node")
    edges = _tie(met, known, index, key_members)
    groups = stage_table(connected(edges, "op1-groups"), "op1-groups")

    grouped = groups.join(items.select("node", "doc_id", "text_hash", "n"), "node").join(known.select("node", "weight"), "node")
    blocks = grouped.groupBy("root").agg(F.ceil(2 * F.sum("n") / group_shingles).cast("int").alias("blocks"))
    blocks = stage_table(blocks, "op1-blocks")
    fits = grouped.join(blocks.where("blocks <= 2").select("root"), "root", "left_semi")
    places = fits.select(
        "node", F.col("root").alias("gid"), F.lit(0).alias("one"), F.lit(0).alias("two"), "doc_id", "text_hash",
        F.lit(None).cast("boolean").alias("open")
    )
    links = _link(_with_texts(docs, places, ["one", "two"]), words, percent, 100)
    large = bool(blocks.where("blocks > 2").limit(1).count())
    if large:
        links = links.unionAll(
            _link_large(docs, grouped.join(blocks.where("blocks > 2"), "root"), words, percent, group_shingles)
        )
    links = stage_table(links, "op1-linked")
    roots = connected(links, "op1-links") if large else links.select(F.col("a").alias("node"), F.col("b").alias("root"))

    part = items.select("node", "set_a", "set_b", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = part.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = part.select("set_a", "set_b", "root").join(low, "root").drop("root")
    out = rows.drop("sig").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, without documents that a smaller id of their class stands for. Rows
    with a null id, and null, empty and blank texts, stay.
    """
    gone = classes(df, words, percent, doc, text).where("NOT kept").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    ).distinct()
    return df.join(gone, (df[doc] == gone["__id"]) & (F.xxhash64(df[text]) == gone["__hash"]), "left_anti")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(read(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
