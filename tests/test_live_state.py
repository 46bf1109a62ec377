"""State of live operators: restarts, what it holds, late rows over many batches, requests that are sent once for good."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from reasonlake.streaming import live
from tests.test_live import END, SCHEMA, drained, stream


def put(spark, folder, name, rows):
    at = [(*d, dt.datetime.fromtimestamp(1_700_000_000 + d[2] / 1000, dt.timezone.utc)) for d in rows]
    spark.createDataFrame(at, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def ran(df, where):
    df.writeStream.format("parquet").outputMode("append").option("path", f"{where}/out").option("checkpointLocation", f"{where}/ck").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{where}/out").collect()


RULES = [("bounded", "ab.{0,3}c"), ("open", "start.*stop"), ("odd", r"(z)\1(?!!)"), ("gone", "never")]


def test_rules_go_on_after_a_restart(spark, tmp_path):
    """Matches that begin before a restart and end after it: what a session knows is in the checkpoint."""
    src = tmp_path / "in"
    put(spark, src, "p0", [("s", "0", 0.0, 0, "text", "x start a"), ("t", "0", 500.0, 0, "text", "z")])
    put(spark, src, "p1", [("w", "0", 50_000.0, 0, "text", "-")])
    assert ran(live.fire_live(source(spark, src), RULES, delay="1 second", idle_ms=10_000_000), tmp_path) == []
    put(spark, src, "p2", [("s", "1", 60_000.0, 1, "thinking", "b..c"), ("t", "1", 61_000.0, 1, "text", "z?")])
    put(spark, src, "p3", [("s", "2", 70_000.0, 2, "text", " and stop"), END])
    got = ran(live.fire_live(source(spark, src), RULES, delay="1 second", idle_ms=10_000_000), tmp_path)
    assert {tuple(x) for x in got} == {("s", "1", "bounded", 60_000.0, 8), ("s", "2", "open", 70_000.0, 2), ("t", "1", "odd", 61_000.0, 0)}


class FakeMap(dict):
    def getValue(self, k):  # noqa: N802
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def containsKey(self, k):  # noqa: N802
        return k in self


class FakeValue:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


class FakeHandle:
    """Keeps states in dictionaries, so that a test can see them."""

    def getMapState(self, *_):  # noqa: N802
        return FakeMap()

    def getValueState(self, *_):  # noqa: N802
        return FakeValue()


def test_state_of_a_session_is_bounded():
    """Ten thousand deltas: the end of the text, one automaton state a rule and nothing else, however long the session."""
    p = live.Firing([("bounded", "ab.{0,3}c"), ("also", "q{1,9}z")], "event_ts", 0, "session")
    p.open(FakeHandle())
    for i in range(10_000):
        assert not list(p.take((float(i), i, "0", "text", f"text {i} of a session. ", i)))
    assert not p.texts and not p.automata and not p.known
    assert len(p.tails) == 1 and len(p.tails[("",)][0]) <= p.back
    p = live.Firing([("open", "start.*stop")], "event_ts", 0, "session")
    p.open(FakeHandle())
    for i in range(1000):
        assert not list(p.take((float(i), i, "0", "text", f"start {i} ", i)))
    assert len(p.automata) == 1 and len(p.automata[("", "open")][0]) <= 20
    assert list(p.take((1e6, 1000, "0", "text", "stop", 0))) == [("0", "open", 1e6, 0)]


def test_mentions_keep_the_end_of_the_text_only():
    p = live.Mentions([("alpha", "/a"), ("beta.csv", "/b")], "event_ts", 0)
    p.open(FakeHandle())
    p.grown.keys = lambda: iter(list(dict.keys(p.grown)))
    found = []
    for i, chunk in enumerate(["al", "pha ", "bet", "a.", "csv alpha", "FILE /x/new.nc (3 bytes)", " /x/ne", "w.nc"]):
        found += [x[1:] for x in p.take((float(i), i, "0", "tool_result" if "FILE" in chunk else "text", chunk, i))]
        assert len(p.tail.get()[0]) < max(p.longest, len("/x/new.nc"))
    assert found == [("/a", 1.0, False), ("/b", 4.0, False), ("/x/new.nc", 7.0, True)]


def test_a_listener_counts_all_late_rows(spark, tmp_path):
    listener = live.LateRows()
    spark.streams.addListener(listener)
    try:
        late = [[("s", "0", 1_000.0 + i, 2 + i, "text", "late"), ("s", "0", 201_000.0 + i, 3, "text", "x")] for i in range(3)]
        parts = [[("s", "0", 100_000.0, 0, "text", "one")], [("s", "0", 200_000.0, 1, "text", "two")], *late]
        _, q = drained(live.fire_live(stream(spark, tmp_path, parts), [("late", "late")], delay="1 second", idle_ms=1000), tmp_path)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        assert listener.by_run[str(q.runId)] == live.late_rows(q) == 3
    finally:
        spark.streams.removeListener(listener)


@pytest.mark.parametrize("restart", [False, True])
def test_requests_are_sent_once_for_good(spark, tmp_path, restart):
    """Repeats in a batch, in later ones, long after and after a restart; a batch that is run again sends the same."""
    src, sent = tmp_path / "in", []

    def send(df, number):
        sent.append((number, sorted((r.host, r.path) for r in df.collect())))

    def asked():
        d = source(spark, src)
        return d.select(F.col("block").alias("host"), F.col("chunk").alias("path"))

    table, checkpoint = f"file://{tmp_path}/table", f"file://{tmp_path}/ck"
    put(spark, src, "p0", [("s", "h1", 0.0, 0, "r", "/a"), ("s", "h1", 1.0, 0, "r", "/a"), ("s", "h1", 1.0, 0, "r", "/b")])
    if restart:
        live.send_requests(asked(), table, checkpoint, send).awaitTermination()
    put(spark, src, "p1", [("s", "h1", 9e8, 0, "r", "/a"), ("s", "h2", 9e8, 0, "r", "/a")])
    put(spark, src, "p2", [("s", "h2", 9e9, 0, "r", "/a"), ("s", "h1", 9e9, 0, "r", "/c")])
    live.send_requests(asked(), table, checkpoint, send).awaitTermination()
    assert [x for _, x in sent] == [[("h1", "/a"), ("h1", "/b")], [("h2", "/a")], [("h1", "/c")]]
    assert sorted((r.host, r.path) for r in live.sent_requests(spark, table).collect()) == [("h1", "/a"), ("h1", "/b"), ("h1", "/c"), ("h2", "/a")]
    live.send_requests(asked(), table, f"{checkpoint}-{uuid.uuid4().hex}", send).awaitTermination()  # all batches again, under their numbers
    assert [x for _, x in sent[3:]] == [x for _, x in sent[:3]]
    assert live.sent_requests(spark, table).count() == 4


def test_requests_look_each_name_up_once(spark, tmp_path):
    """What a batch's rows ask for is told by its distinct names: rows are not multiplied by their targets."""
    targets = spark.createDataFrame([("r1", "h"), ("r2", "h")], "name string, host string")
    d = source(spark, tmp_path / "in")
    put(spark, tmp_path / "in", "p0", [(f"s{i}", "r1" if i % 2 else "none", 0.0, i, "r", "x") for i in range(40)])
    table = f"file://{tmp_path}/table"
    targets = targets.crossJoin(spark.range(50)).select("name", "host", F.concat(F.lit("/"), "name", F.col("id")).alias("path"))
    q = live.send_requests(d.withColumnRenamed("block", "name"), table, f"file://{tmp_path}/ck", targets=targets)
    q.awaitTermination()
    assert sorted(r.path for r in live.sent_requests(spark, table).collect()) == sorted(f"/r1{i}" for i in range(50))
