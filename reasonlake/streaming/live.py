"""Live work over streams of text deltas, and rollups of staging events.

Arrival order is not event order, so a session's state holds the deltas that an earlier one may still precede, and
takes the others, in order of (t_ms, seq), once the watermark has passed them: a timer at the earliest held delta wakes the
session. What it remembers is in typed state (lists, maps and values in the state store), of which a delta touches a few
entries; nothing is rewritten whole. Deltas behind the watermark are late: Spark leaves them out and counts them
(``LateRows``). A session that is idle for long is closed by a timer and its state dropped.

The operators need the RocksDB state store and set it for the session when they are built.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from ..functions.labels import LIVE, tier
from ..operators.automata import Follower, Literals, pattern_of
from ..operators.matching import SCANNED, Rules

FIRED = "session_id string, block string, name string, fired_at_ms double, match_start long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: A delta without its session: (t_ms, seq, block, kind, chunk) and its event time in milliseconds.
Delta = tuple[float, int, str, str, str, int]


def normalise(events: DataFrame, provider: str) -> DataFrame:
    """Deltas of one provider in a common form: session_id, block, t_ms, seq, kind, chunk. Reasoning may come under
    either of two names; fragments of tool arguments have a block for each call.
    """
    c = F.col
    if provider == "openai":
        kind = F.when(
            F.coalesce(c("reasoning"), c("reasoning_content")).isNotNull(), "thinking"
        ).when(c("content").isNotNull(), "text").when(c("arguments").isNotNull(), "tool_use")
        chunk = F.coalesce(c("reasoning"), c("reasoning_content"), c("content"), c("arguments"))
        block = F.concat_ws("-", kind, F.coalesce(c("call_index").cast("string"), F.lit("0")))
    elif provider == "gemini":
        kind = F.when(
            c("event") == "thinking_delta", "thinking"
        ).when(c("event") == "text_delta", "text").when(c("event") == "function_call", "tool_use")
        chunk, block = F.coalesce(c("chunk"), c("args")), kind
    else:
        kind = F.when(c("delta_type") == "thinking_delta", "thinking").when(c("delta_type") == "text_delta", "text").when(
            c("delta_type") == "input_json_delta", "tool_use"
        )
        chunk, block = c("chunk"), c("block_idx").cast("string")
    return events.select(
        "session_id", block.alias("block"), "t_ms", "seq", kind.alias("kind"), chunk.alias("chunk")
    ).where("kind is not null")


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "array<int>": T.ArrayType(T.IntegerType())
}


def _struct(columns: str) -> T.StructType:
    """A schema of names and types; states are opened in workers, which have no session to parse one."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (c.split() for c in columns.split(", "))])


class InOrder(StatefulProcessor):
    """Gives ``take`` the deltas of each session in event order, and ends it with ``done``. Both give rows without the session.

    A subclass opens its own state in ``open`` and names it in ``parts``, so that the end of a session clears it.
    """

    columns = ""

    def __init__(self, start: str, idle_ms: int) -> None:
        self.start, self.idle_ms = start, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _struct("t double, seq long, block string, kind string, chunk string, at long"))
        self.last = handle.getValueState("last", _struct("at long"))
        self.parts: list = []
        self.open(handle)

    def open(self, handle) -> None: ...

    def take(self, delta: Delta) -> Iterator[tuple]: ...

    def done(self) -> Iterator[tuple]:
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: list[Delta] = []
        for b in rows:
            when = b[self.start].astype("datetime64[ms]").astype("int64")
            new += [
                (float(t), int(s), str(k), str(x), str(c or ""), int(w)) for t, s, k, x, c, w in zip(b.t_ms, b.seq, b.block, b.kind, b.chunk, when, strict=True)
            ]
        if new:
            self.held.appendList(new)
            last = max(d[5] for d in new)
            if self.last.exists():
                last = max(last, self.last.get()[0])
            self.last.update((last,))
            self.handle.registerTimer(min(d[5] for d in new))
            self.handle.registerTimer(last + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.last.exists():  # closed already
            return
        mark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.held.get()) if self.held.exists() else []
        ready = next((i for i, r in enumerate(rows) if r[5] > mark), len(rows))  # deltas that no earlier one can precede any more
        out = [(key[0], *x) for r in rows[:ready] for x in self.take(r)]
        if self.last.get()[0] + self.idle_ms <= mark:
            out += [(key[0], *x) for x in self.done()]
            for state in (self.held, self.last, *self.parts):
                state.clear()
        elif ready:
            self.held.clear()
            if rows[ready:]:
                self.held.put(rows[ready:])
                self.handle.registerTimer(min(r[5] for r in rows[ready:]))
        if out:
            yield pd.DataFrame(out, columns=["session_id", *(c.split()[0] for c in self.columns.split(", "))])

    def close(self) -> None: ...


def in_order(deltas: DataFrame, processor: InOrder, delay: str) -> DataFrame:
    """Rows (session_id and the processor's columns) that follow from the deltas of each session in event order.

    Rows come when the watermark has passed their delta, so the result does not depend on the order of arrival.
    """
    deltas.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    told = deltas.select(
        F.col("session_id").cast("string").alias("session_id"), "block", "t_ms", "seq", "kind", "chunk", processor.start
    ).withWatermark(processor.start, delay)
    return told.groupBy("session_id").transformWithStateInPandas(
        processor, f"session_id string, {processor.columns}", "Append", "EventTime"
    )


class LateRows(StreamingQueryListener):
    """Counts the deltas that each query left out because they came behind its watermark, from its start on:
    ``spark.streams.addListener`` it, then ask by ``query.runId``.
    """

    def __init__(self) -> None:
        self.by_run: dict[str, int] = {}

    def onQueryStarted(self, event) -> None: ...  # noqa: N802

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        late = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        self.by_run[str(p.runId)] = self.by_run.get(str(p.runId), 0) + late

    def onQueryIdle(self, event) -> None: ...  # noqa: N802

    def onQueryTerminated(self, event) -> None: ...  # noqa: N802


def late_rows(query: StreamingQuery) -> int:
    """Late deltas over a query's recent progress (the last hundred reports); a ``LateRows`` listener counts all."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


class Firing(InOrder):
    """Rules over a session's text. Of the text only the end is kept, as far as rules of bounded width reach back; other
    rules keep the state of their automaton, and the text in pieces that are read again only when such a rule fires.
    """

    columns = FIRED.split(", ", 1)[1]

    def __init__(self, rules: list[tuple[str, str]], start: str, idle_ms: int, scope: str) -> None:
        super().__init__(start, idle_ms)
        self.plain, self.scope = rules, scope

    def open(self, handle) -> None:
        self.rules = Rules([(i, n, p, []) for i, (n, p) in enumerate(self.plain)])
        self.patterns = {i: pattern_of(p) for i, (_, p) in enumerate(self.plain) if self.rules.widths[i] is None}
        self.back = max((w for w in self.rules.widths if w is not None), default=0)
        self.known = handle.getMapState("known", _struct("name string"), _struct("t double"))
        self.tails = handle.getMapState("tails", _struct("own string"), _struct("text string, size long, pieces long"))
        self.automata = handle.getMapState("automata", _struct("own string, name string"), _struct("nodes array<int>, before int, last boolean, gone boolean"))
        self.texts = handle.getMapState("texts", _struct("own string, i long"), _struct("text string"))
        self.parts = [self.known, self.tails, self.automata, self.texts]

    def take(self, delta: Delta) -> Iterator[tuple]:
        t, _, block, _, chunk, _ = delta
        own = block if self.scope == "block" else ""
        tail, size, pieces = self.tails.getValue((own,)) if self.tails.containsKey((own,)) else ("", 0, 0)
        seen = tail + chunk
        likely = set(self.rules.likely(seen))
        if self.patterns:
            self.texts.updateValue((own, pieces), (chunk,))
        for i, (name, pattern) in enumerate(self.plain):
            unbounded = i in self.patterns
            if not unbounded and i not in likely or self.known.containsKey((name,)):
                continue
            if not unbounded:
                m = self.rules.search(i)(seen, max(0, len(tail) - self.rules.widths[i]))
                start = m.start() - len(tail) + size if m else None
            else:
                start = self._whole(i, own, pieces) if self._met(i, own, chunk) else None
            if start is not None:
                self.known.updateValue((name,), (t,))
                yield block, name, t, start
        self.tails.updateValue((own,), (seen[-self.back :] if self.back else "", size + len(chunk), pieces + 1))

    def _met(self, i: int, own: str, chunk: str) -> bool:
        """Whether an unbounded rule has a match in the text so far; patterns that aren't regular are always tried."""
        pattern, key = self.patterns[i], (own, self.plain[i][0])
        if pattern is None:
            return True
        f = Follower(pattern)
        if self.automata.containsKey(key):
            nodes, before, last, f.gone = self.automata.getValue(key)
            f.known = frozenset(nodes), before, last
        f.feed(chunk)
        nodes, before, last = f.known
        self.automata.updateValue(key, (sorted(nodes), before, last, f.gone))
        return f.gone or pattern.ends(pattern.number(f.known))

    def _whole(self, i: int, own: str, pieces: int) -> int | None:
        m = self.rules.search(i)("".join(self.texts.getValue((own, k))[0] for k in range(pieces + 1)))
        return m.start() if m else None


def fire_live(
    deltas: DataFrame, rules: list[tuple[str, str]], start: str = "event_ts", delay: str = "10 seconds", idle_ms: int = 600_000,
    scope: str = "session"
) -> DataFrame:
    """Each rule (name, pattern) once a session, when its pattern is first found in the text so far.

    ``deltas``: session_id, block, t_ms, seq, kind, chunk and the event time ``start``. With scope ``block`` each block's text is
    searched alone.
    """
    return in_order(deltas.where(F.col("kind").isin(*SCANNED)), Firing(rules, start, idle_ms, scope), delay)


LISTED = re.compile(r"^\s*FILE\s+(\S+)\s+\(\d+\s+bytes\)\s*$", re.MULTILINE)


class Mentions(InOrder):
    """Needles and listed files in a session's text; mentions may lie across deltas."""

    columns = "block string, path string, t_ms double, listed boolean"

    def __init__(self, needles: list[tuple[str, str]], start: str, idle_ms: int) -> None:
        super().__init__(start, idle_ms)
        self.needles = needles

    def open(self, handle) -> None:
        self.literals = Literals((n, i) for i, (n, _) in enumerate(self.needles))
        self.longest = max((len(n) for n, _ in self.needles), default=1)
        self.seen = handle.getMapState("seen", _struct("path string"), _struct("t double"))
        self.grown = handle.getMapState("grown", _struct("path string"), _struct("t double"))
        self.tail = handle.getValueState("tail", _struct("text string, reach int"))
        self.parts = [self.seen, self.grown, self.tail]

    def take(self, delta: Delta) -> Iterator[tuple]:
        t, _, block, kind, chunk, _ = delta
        tail, reach = self.tail.get() if self.tail.exists() else ("", self.longest)
        text = tail + chunk
        found = {self.needles[i][1]: False for i in sorted(self.literals.within(text))}
        if reach:  # what listings have shown is looked for as well
            found = {p: True for (p,) in self.grown.keys() if p in text} | found
        for path, listed in found.items():
            if not self.seen.containsKey((path,)):
                self.seen.updateValue((path,), (t,))
                yield block, path, t, listed
        if kind == "tool_result":
            for path in dict.fromkeys(LISTED.findall(chunk)):
                if not self.seen.containsKey((path,)):
                    self.grown.updateValue((path,), (t,))
                    reach = max(reach, len(path))
        self.tail.update((text[-(reach - 1) :] if reach > 1 else "", reach))


def literal_deltas(
    deltas: DataFrame, needles: list[tuple[str, str]], start: str = "event_ts", delay: str = "10 seconds", idle_ms: int = 600_000
) -> DataFrame:
    """(session_id, block, path, t_ms, listed): each file once a session, when its path or another needle (needle, path)
    is first named, across deltas too.

    The files that listings in tool results show join what is looked for, by their paths, from the next delta on
    (``listed``). Needles are one automaton in each worker, so they are configuration or a table of counted size
    (``needle_list``); for more of them there is ``write_literals``.
    """
    return in_order(deltas.where(F.col("kind").isin(*SCANNED)), Mentions(needles, start, idle_ms), delay)


def needle_list(prior: DataFrame) -> list[tuple[str, str]]:
    """(needle, path) of a prior's input files, for ``literal_deltas``; raises if there are more than a worker should hold."""
    from ..operators.scoring import MOST_NEEDLES, needles_of

    rows = needles_of(prior).select("needle", "path").limit(MOST_NEEDLES + 1).collect()
    if len(rows) > MOST_NEEDLES:
        raise ValueError(f"over {MOST_NEEDLES} needles: use write_literals")
    return [tuple(r) for r in rows]


class Pieces(InOrder):
    """Each delta's text with the end of the text before it, as far as a needle may reach back, numbered within the session."""

    columns = "block string, t_ms double, n long, text string"

    def __init__(self, reach: int, start: str, idle_ms: int) -> None:
        super().__init__(start, idle_ms)
        self.reach = reach

    def open(self, handle) -> None:
        self.tail = handle.getValueState("tail", _struct("text string, n long"))
        self.parts = [self.tail]

    def take(self, delta: Delta) -> Iterator[tuple]:
        t, _, block, _, chunk, _ = delta
        tail, n = self.tail.get() if self.tail.exists() else ("", 0)
        text = tail + chunk
        yield block, t, n, text
        self.tail.update((text[-(self.reach - 1) :] if self.reach > 1 else "", n + 1))


def write_literals(
    deltas: DataFrame, prior: DataFrame, table: str, checkpoint: str, start: str = "event_ts", delay: str = "10 seconds", idle_ms: int = 600_000
) -> StreamingQuery:
    """Start writing (session_id, block, path, t_ms, batch) to the folder ``table``: each input file of a prior once a session, when
    one of its needles is first named, across deltas too.

    For needles of any number: a batch's texts look them up (``literal_scan``). What listings show does not
    join them; ``literal_deltas`` without needles finds that.
    """
    from ..operators.scoring import literal_scan, needles_of

    reach = needles_of(prior).agg(F.max(F.length("needle"))).first()[0] or 1
    of = T.StructType([T.StructField("session_id", T.StringType()), *_struct("block string, t_ms double, n long")])

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{table}-texts/batch={number}")
        told = spark.read.schema(df.schema).parquet(f"{table}-texts/batch={number}").select(
            F.to_json(F.struct(*of.names)).alias("session_id"), F.lit(0).alias("block_seq"), F.lit("text").alias("type"), "text"
        )  # a piece is searched as a session of its own
        found = literal_scan(told, prior).select(F.from_json("session_id", of).alias("of"), "path").select("of.*", "path")
        found = found.groupBy("session_id", "path").agg(F.min_by(F.struct("block", "t_ms"), "n").alias("at")).select(
            "session_id", "at.block", "path", "at.t_ms"
        )
        if number:
            found.limit(0).write.mode("ignore").parquet(f"{table}/batch=-1")  # a table to read
            found = found.join(written_literals(spark, table).where(F.col("batch") < number), ["session_id", "path"], "left_anti")
        found.write.mode("overwrite").parquet(f"{table}/batch={number}")

    pieces = in_order(deltas.where(F.col("kind").isin(*SCANNED)), Pieces(reach, start, idle_ms), delay)
    return pieces.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_literals(spark: SparkSession, table: str) -> DataFrame:
    """(session_id, block, path, t_ms, batch): all mentions that were written so far."""
    return spark.read.schema("session_id string, block string, path string, t_ms double, batch long").parquet(table)


def literal_stream(
    deltas: DataFrame, keyed: DataFrame, kinds: list[int], start: str = "event_ts", delay: str = "10 minutes"
) -> DataFrame:
    """Each file once a session, when a delta names it: a stream joined with a table of needles (path, needle, gram, as
    ``keyed_needles`` gives them; ``kinds`` are the lengths of the grams). Needles across deltas are not seen.
    """
    from ..operators.scoring import grams

    pieces = F.array_distinct(F.flatten(F.array(*[grams(F.col("chunk"), n) for n in kinds])))
    met = deltas.withWatermark(start, delay).select(
        "session_id", "block", "t_ms", start, "chunk", F.explode(pieces).alias("gram")
    ).join(keyed, "gram")
    return met.where(F.contains("chunk", F.col("needle"))).select(
        "session_id", "block", "path", "t_ms", start
    ).dropDuplicatesWithinWatermark(["session_id", "path"])


class Slack(InOrder):
    columns = "t_ms double, slack_ms double"

    def open(self, handle) -> None:
        self.thought = handle.getValueState("thought", _struct("t double"))
        self.told = handle.getValueState("told", _struct("t double"))
        self.parts = [self.thought, self.told]

    def take(self, delta: Delta) -> Iterator[tuple]:
        t, kind = delta[0], delta[3]
        if kind == "thinking" and not self.thought.exists():
            self.thought.update((t,))
        if kind == "tool_use" and not self.told.exists():
            self.told.update((t,))
            yield t, t - self.thought.get()[0] if self.thought.exists() else None


def slack_live(deltas: DataFrame, start: str = "event_ts", delay: str = "10 seconds", idle_ms: int = 600_000) -> DataFrame:
    """(session_id, t_ms, slack_ms): at the first tool use of a session, the time since its first thinking; null without
    any before.
    """
    return in_order(deltas, Slack(start, idle_ms), delay)


class Arguments(InOrder):
    columns = "block string, t_ms double, arguments string"

    def open(self, handle) -> None:
        self.call = handle.getValueState("call", _struct("block string, t double"))
        self.fragments = handle.getListState("fragments", _struct("text string"))
        self.parts = [self.call, self.fragments]

    def done(self) -> Iterator[tuple]:
        if self.call.exists():
            block, t = self.call.get()
            yield block, t, "".join(x[0] for x in self.fragments.get())
            self.call.clear()
            self.fragments.clear()

    def take(self, delta: Delta) -> Iterator[tuple]:
        t, _, block, kind, chunk, _ = delta
        if kind != "tool_use" or self.call.exists() and self.call.get()[0] != block:
            yield from self.done()
        if kind == "tool_use":
            if not self.call.exists():
                self.call.update((block, t))
            self.fragments.appendValue((chunk,))


def tool_arguments(deltas: DataFrame, start: str = "event_ts", delay: str = "10 seconds", idle_ms: int = 600_000) -> DataFrame:
    """(session_id, block, t_ms, arguments): the fragments of each tool call put together, once a delta of another call
    or kind follows, or the session ends.
    """
    return in_order(deltas, Arguments(start, idle_ms), delay)


def gate(fired: DataFrame, sizes: DataFrame) -> DataFrame:
    """Live firings with the files their targets hold (name, n) and whether they are dispatched: tier 1 alone is."""
    return fired.join(sizes, "name", "left").withColumn(
        "tier", tier(F.coalesce("n", F.lit(0)), LIVE)
    ).withColumn("dispatch", F.col("tier") == 1)


def requests(fired: DataFrame, targets: DataFrame, time: str, delay: str = "10 minutes") -> DataFrame:
    """Staging requests for each host and path, repeats within the delay left out; ``send_requests`` leaves out all others too."""
    return fired.join(targets, "name").withWatermark(time, delay).dropDuplicatesWithinWatermark(["host", "path"])


def sent_requests(spark: SparkSession, table: str) -> DataFrame:
    """(host, path, batch): all requests that were sent so far."""
    return spark.read.schema("host string, path string, batch long").parquet(table)


def send_requests(
    asked: DataFrame, table: str, checkpoint: str, send: Callable[[DataFrame, int], None] | None = None, targets: DataFrame | None = None
) -> StreamingQuery:
    """Start sending each (host, path) of a stream once for good, however much later or after how many restarts it is asked for again.

    The folder ``table`` holds what was sent, a part for each batch. A batch's new requests are those that no earlier batch has;
    they are written under the batch's number, over what a failed attempt of it left, before ``send`` gets them. So a batch
    that is run again sends the same requests again, and no others: ``send`` must bear that for its last batch.

    With ``targets`` (name, host, path) the stream has names, and asks for all that they stand for: a batch looks each name up once,
    however many rows have it.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        own = df.select("name").distinct().join(targets, "name") if targets is not None else df
        own = own.select("host", "path").distinct()
        if number:
            spark.createDataFrame([], "host string, path string").write.mode("ignore").parquet(f"{table}/batch=-1")  # a table to read
            own = own.join(sent_requests(spark, table).where(F.col("batch") < number), ["host", "path"], "left_anti")
        own.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if send:
            send(spark.read.schema("host string, path string").parquet(f"{table}/batch={number}"), number)

    return asked.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stage_rollup(
    events: DataFrame, time: str = "event_ts", window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Staging events by window and outcome: count, bytes, and approximate percentiles of the fetch time."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, delay).groupBy(w.alias("w"), "outcome").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.percentile_approx("fetch_ms", 0.5).alias("p50"),
        F.max("fetch_ms").alias("max_ms")
    ).select(F.col("w.start").alias("start"), "outcome", "n", "bytes", "p50", "max_ms")


def session_slack(deltas: DataFrame, time: str = "event_ts", gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """First thinking delta to first tool use of a session, by session window; null if either is missing."""
    s = deltas.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "session_id").agg(
        F.min(F.when(F.col("kind") == "thinking", F.col("t_ms"))).alias("a"),
        F.min(F.when(F.col("kind") == "tool_use", F.col("t_ms"))).alias("b")
    )
    return s.select("session_id", F.col("w.start").alias("start"), (F.col("b") - F.col("a")).alias("slack_ms"))
