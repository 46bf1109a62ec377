"""Text search for Spark tasks: dictionaries that reach every row once, literal automata and resumable patterns."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import grams

_sre, _compiler = re._constants, re._compiler

#: Automaton nodes of a pattern; one with more is searched in the whole text instead.
MOST_NODES = 20_000
#: Automaton states that a task remembers of a pattern before it starts afresh.
MOST_STATES = 20_000
#: Copies of each part of a large dictionary, over which the texts are dealt.
COPIES = 16
#: Characters of the texts that look up a large dictionary together.
CHUNK = 4_000_000

Work = Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

_built: dict[str, object] = {}


def dictionary_map(
    rows: DataFrame, entries: DataFrame, build: Callable[[list[tuple]], object], work: Work, schema: str, most: int,
    literals: Callable[[tuple], list[str] | None], fold: Callable[[str], str], group: str | None = None, order: str | None = None
) -> DataFrame:
    """``work(build(entries), batches of rows)`` in every task, where the entries may be too many for one task.

    Up to ``most`` entries are counted, sent to each worker once and met there by all rows. Of more, those with ``literals``, one of
    which any text (column ``text`` through ``fold``, of the whole group) that they find something in must hold, are looked up by the texts (``_looked_up``), so
    each row is sent on once, however many they are; only others are dealt in parts that each row goes to. With ``group`` the rows of a group come
    together, in ``order``. Results of a row with two parts are two rows.
    """
    few = entries.limit(most + 1).collect()
    if len(few) <= most:
        return _sent(rows, few, build, work, schema, group, order)
    fields = [f"__e{i}" for i in range(len(entries.columns))]
    keyed = _keyed(entries.toDF(*fields), literals)
    out = _looked_up(rows, keyed.where("size(__grams) > 0"), fields, build, work, schema, most, fold, group, order)
    others = keyed.where("size(__grams) = 0").select(*fields)
    few = others.limit(most + 1).collect()
    if not few:
        return out
    if len(few) <= most:
        return out.unionByName(_sent(rows, few, build, work, schema, group, order))
    parts = -(-others.count() // most)
    part, copies = F.pmod(F.xxhash64(*fields), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))
    copy = F.pmod(F.xxhash64(*([group] if group else rows.columns)), F.lit(COPIES)).cast("int")
    e = others.select(copies.alias("__chunk"), part.alias("__part"), *fields)
    r = rows.select(copy.alias("__chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"), *rows.columns)
    return out.unionByName(_dealt(r, e, fields, build, work, schema, group, order))


def _sent(rows: DataFrame, few: list, build, work: Work, schema: str, group: str | None, order: str | None) -> DataFrame:
    """Entries are sent to each worker once."""
    sent, name = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in few]), uuid.uuid4().hex

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _built:  # workers are reused, and a plan may have two dictionaries
            for old in [*_built][:-1]:
                del _built[old]
            _built[name] = build(sent.value)
        yield from work(_built[name], it)

    own = rows.repartition(group).sortWithinPartitions(group, order) if group else rows
    return own.mapInArrow(batches, schema)


def _dealt(r: DataFrame, e: DataFrame, fields: list[str], build, work: Work, schema: str, group: str | None, order: str | None) -> DataFrame:
    """Rows and entries of a (chunk, part) come together, entries first, so a task holds those of one at a time."""
    keys, names = ["__chunk", "__part", "__kind"], [c for c in r.columns if c not in ("__chunk", "__part")]
    e, r = e.withColumn("__kind", F.lit(0)), r.withColumn("__kind", F.lit(1))
    dealt = e.unionByName(r, allowMissingColumns=True).select(*keys, *fields, *names)
    dealt = dealt.repartition("__chunk", "__part").sortWithinPartitions(*keys, *([group, order] if group else []))

    def streams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple[tuple, pa.RecordBatch]]:
            for b in it:
                keys = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
                for key, own in groupby(range(b.num_rows), keys.__getitem__):
                    own = list(own)
                    yield key, b.slice(own[0], len(own))

        for _, own in groupby(pieces(), lambda p: p[0][:2]):
            told: list[tuple] = []
            for key, b in own:
                if key[2] == 0:
                    told += zip(*(b.column(3 + i).to_pylist() for i in range(len(fields))), strict=True)
                    continue
                rest = (x for x in chain([b], (x for _, x in own)))
                at = 3 + len(fields)
                yield from work(build(told), (pa.RecordBatch.from_arrays(x.columns[at:], names=names) for x in rest))

    return dealt.mapInArrow(streams, schema)


def _keyed(entries: DataFrame, literals: Callable[[tuple], list[str] | None]) -> DataFrame:
    """Entries with ``__id`` and ``__grams``, for each of their literals the piece that fewest entries have; none without literals."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            each = [literals(r) or [] for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            each = [x if all(x) else [] for x in each]  # what an empty text finds is in every text
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(each, pa.list_(pa.string()))], names=[*b.schema.names, "__literals"])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words = b.column(0).flatten().to_pylist()
            if words:
                at, n = np.unique(grams.bucket(grams.of_literals(words)[1], grams.COUNTED), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], names=["at", "n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema.fields)
    known = staged(entries.mapInArrow(read, f"{schema}, __literals array<string>").withColumn("__id", F.monotonically_increasing_id()), "literals")
    n = known.select("__literals").mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # bounded by the buckets
    counts = np.zeros(1 << grams.COUNTED, np.uint32)
    counts[n.column("at").to_numpy()] = np.minimum(n.column("n").to_numpy(), 0xFFFFFFFF)
    sent = entries.sparkSession.sparkContext.broadcast(counts)

    def chosen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = b.column(b.num_columns - 1)
            words = own.flatten().to_pylist()
            best = grams.rarest(words, sent.value).view(np.int64) if words else np.array([], np.int64)
            ends = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(best))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*b.schema.names[:-1], "__grams"])

    own = known.select("__id", *entries.columns, "__literals")
    return staged(own.mapInArrow(chosen, f"__id long, {schema}, __grams array<bigint>"), "dictionary")


def _looked_up(
    rows: DataFrame, keyed: DataFrame, fields: list[str], build, work: Work, schema: str, most: int, fold: Callable[[str], str],
    group: str | None, order: str | None
) -> DataFrame:
    """Texts are dealt into chunks, a chunk asks for the entries that have a piece of its texts, and they come to it together.
    A chunk that asks for more than ``most`` is met in parts.
    """
    bit = F.shiftrightunsigned("g", 64 - grams.SIEVE)
    wanted = keyed.select(F.explode("__grams").alias("g")).groupBy(F.shiftright(bit, 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(g, " + str(64 - grams.SIEVE) + ") & 63 as int))")).alias("bits")
    ).toArrow()  # bounded by the sieve
    sieve = np.zeros(1 << (grams.SIEVE - 6), np.uint64)
    sieve[wanted.column("at").to_numpy()] = wanted.column("bits").to_numpy().view(np.uint64)
    sent = rows.sparkSession.sparkContext.broadcast(sieve)
    size = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunks = max(COPIES, -(-size // CHUNK))
    chunked = rows.withColumn("__chunk", F.pmod(F.xxhash64(*([group] if group else rows.columns)), F.lit(chunks)).cast("int"))
    sort = [group, order] if group else []
    longest = max(grams.KINDS) - 1

    def asked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = ""  # what is found across two texts that don't belong together is only asked for in vain
        for b in it:
            chunk, text = b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            for key, own in groupby(range(b.num_rows), chunk.__getitem__):
                seen = tail + "".join(fold(text[i]) for i in own)
                tail = seen[-longest:]
                found = grams.sifted(seen, sent.value).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), key, np.int32)), pa.array(found)], names=["__chunk", "g"])

    dealt = chunked.select("__chunk", *sort, "text").repartition("__chunk").sortWithinPartitions("__chunk", *sort)
    asks = dealt.mapInArrow(asked, "__chunk int, g long").distinct()
    of = keyed.select("__id", F.explode("__grams").alias("g"), *fields)
    need = staged(asks.join(of, "g").drop("g").dropDuplicates(["__chunk", "__id"]), "entries")
    parts = need.groupBy("__chunk").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("__parts"))
    e = need.join(F.broadcast(parts), "__chunk").select("__chunk", F.pmod(F.xxhash64("__id"), "__parts").cast("int").alias("__part"), *fields)
    r = chunked.join(F.broadcast(parts), "__chunk").select(
        "__chunk", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), *rows.columns
    )
    return _dealt(r, e, fields, build, work, schema, group, order)


def folded(text: str) -> str:
    """Lower case, with the letters that match ASCII ones when case is ignored as these."""
    return text.lower().replace("ſ", "s").replace("ı", "i").replace("i̇", "i")


class Literals:
    """Which keys have one of their literals in a text, found in one pass."""

    def __init__(self, words: Iterable[tuple[str, int]]) -> None:
        of: dict[str, list[int]] = {}
        for word, key in words:
            of.setdefault(word, []).append(key)
        self.automaton = ahocorasick.Automaton()
        for word, keys in of.items():
            self.automaton.add_word(word, tuple(keys))
        if of:
            self.automaton.make_automaton()
        self.empty = not of

    def within(self, text: str) -> set[int]:
        return {k for _, keys in self.places(text) for k in keys}

    def places(self, text: str) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(last character, keys) of each place where a literal ends."""
        return iter(()) if self.empty else self.automaton.iter(text)


# ---- resumable patterns

_START, _WORD, _OTHER, _BREAK, _END = range(5)


def _kind(c: str) -> int:
    return _WORD if c.isalnum() or c == "_" else _BREAK if c == "\n" else _OTHER


class Unsupported(Exception):
    """The pattern isn't regular, or its automaton would be too large."""


class Pattern:
    """A regular expression as an automaton that is made deterministic as it meets characters, and can stop and go on anywhere.

    States are numbers; ``START`` is the state before any text. What Python's ``search`` finds in a text with case ignored,
    ``step`` and ``ends`` find character by character. Raises ``Unsupported`` for patterns with look-around, references
    or possessive parts.
    """

    START = 0

    def __init__(self, pattern: str) -> None:
        tree = re._parser.parse(pattern, re.IGNORECASE)
        self.flags, self.state = tree.state.flags, tree.state
        self.nodes: list[tuple] = [("accept",)]
        self.entry = self._add(list(tree), 0, self.flags)
        self._fresh()

    def _fresh(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: dict[tuple[int, str, bool], tuple[int, bool]] = {}
        self.end: dict[tuple[int, bool], bool] = {}
        self._id((frozenset(), _START, False))

    def _new(self, node: tuple) -> int:
        if len(self.nodes) >= MOST_NODES:
            raise Unsupported
        self.nodes.append(node)
        return len(self.nodes) - 1

    def _add(self, items: list, then: int, flags: int) -> int:
        for op, arg in reversed(items):
            if op in (_sre.LITERAL, _sre.NOT_LITERAL, _sre.ANY, _sre.IN):
                one = re._parser.SubPattern(self.state, [(op, arg)])
                then = self._new(("char", _compiler.compile(one, flags | re.IGNORECASE), then))
            elif op is _sre.AT:
                then = self._new(("at", arg, bool(flags & re.MULTILINE), then))
            elif op is _sre.BRANCH:
                then = self._new(("any", [self._add(list(x), then, flags) for x in arg[1]]))
            elif op is _sre.SUBPATTERN:
                then = self._add(list(arg[3]), then, (flags | arg[1]) & ~arg[2])
            elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT):
                least, most, body = arg[0], arg[1], list(arg[2])
                if most is _sre.MAXREPEAT:
                    loop = self._new(("any", []))
                    self.nodes[loop][1].extend([self._add(body, loop, flags), then])
                    then = loop
                else:
                    for _ in range(most - least):
                        then = self._new(("any", [self._add(body, then, flags), then]))
                for _ in range(least):
                    then = self._add(body, then, flags)
            else:
                raise Unsupported
        return then

    def _id(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
        return self.ids[state]

    def _holds(self, at, lines: bool, before: int, after: int, last: bool) -> bool:
        word = (before == _WORD) != (after == _WORD)
        if at is _sre.AT_BOUNDARY:
            return word
        if at is _sre.AT_NON_BOUNDARY:
            return not word
        if at is _sre.AT_BEGINNING_STRING or at is _sre.AT_BEGINNING:
            return before == _START or (lines and at is _sre.AT_BEGINNING and before == _BREAK)
        if at is _sre.AT_END_STRING:
            return after == _END
        if at is _sre.AT_END:
            return after == _END or (after == _BREAK and (lines or last))
        raise Unsupported

    def _reach(self, nodes: Iterable[int], before: int, after: int, last: bool = False) -> tuple[bool, list[tuple]]:
        """Whether a match ends here, and the character nodes that may go on."""
        seen, todo, chars, accept = set(), list(nodes), [], False
        while todo:
            n = todo.pop()
            if n in seen:
                continue
            seen.add(n)
            node = self.nodes[n]
            if node[0] == "accept":
                accept = True
            elif node[0] == "char":
                chars.append(node)
            elif node[0] == "any":
                todo += node[1]
            elif self._holds(node[1], node[2], before, after, last):
                todo.append(node[3])
        return accept, chars

    def step(self, state: int, c: str, begin: bool = True) -> tuple[int, bool]:
        """The state after a character, and whether a match ended before it. ``begin``: a match may start before the character."""
        found = self.next.get((state, c, begin))
        if found is None:
            nodes, before, _ = self.states[state]
            after = _kind(c)
            own = [*nodes, self.entry] if begin else nodes
            accept, chars = self._reach(own, before, after)
            last = c == "\n" and self._reach(own, before, after, last=True)[0]
            new = self._id((frozenset(n[2] for n in chars if n[1].match(c)), after, last))
            found = self.next[state, c, begin] = (new, accept)
        return found

    def ends(self, state: int, begin: bool = True) -> bool:
        """Whether a match ends where the text ends. ``begin``: it may also start there."""
        found = self.end.get((state, begin))
        if found is None:
            nodes, before, last = self.states[state]
            own = [*nodes, self.entry] if begin else nodes
            found = self.end[state, begin] = last or self._reach(own, before, _END)[0]
        return found

    def dead(self, state: int) -> bool:
        """Nothing that began earlier can still match."""
        nodes, _, last = self.states[state]
        return not nodes and not last

    def bare(self, before: str) -> tuple:
        """What is known after a text of which only the last character is, and nothing that began in it."""
        return frozenset(), _kind(before[-1]) if before else _START, False

    def number(self, known: tuple) -> int:
        """The state of what is known (``states``); states are numbered afresh once there are too many."""
        if len(self.states) > MOST_STATES:
            self._fresh()
        return self._id(known)


@lru_cache(maxsize=100_000)
def pattern_of(pattern: str) -> Pattern | None:
    try:
        return Pattern(pattern)
    except (Unsupported, re.error, OverflowError, RecursionError):
        return None


class Follower:
    """One pattern over a text that comes piece by piece. The text before a piece isn't kept, only what the automaton knows of it."""

    __slots__ = ("gone", "known", "pattern")

    def __init__(self, pattern: Pattern, before: str = "") -> None:
        self.pattern, self.known, self.gone = pattern, pattern.bare(before), False

    def older(self, text: str) -> bool:
        """Whether a match that starts before the piece lies in the text up to the piece's end. Doesn't move."""
        if self.gone:
            return True
        p = self.pattern
        state = p.number(self.known)
        for c in text:
            if p.dead(state):
                return False
            state, accept = p.step(state, c, False)
            if accept:
                return True
        return p.ends(state, False)

    def feed(self, text: str) -> None:
        """Go on over the piece. ``gone``: some match has ended for good, whatever follows."""
        if self.gone:
            return
        p = self.pattern
        state, step = p.number(self.known), p.step
        for c in text:
            state, self.gone = step(state, c)
            if self.gone:
                return
        self.known = p.states[state]

    def first_end(self, text: str) -> int | None:
        """Go on until a prefix of the text that ends in the piece has a match: the characters of the piece up to there."""
        if self.gone and text:
            return 1
        p = self.pattern
        state, step, ends = p.number(self.known), p.step, p.ends
        for i, c in enumerate(text, 1):
            state, self.gone = step(state, c)
            if self.gone or ends(state):
                return i
        self.known = p.states[state]
        return None
