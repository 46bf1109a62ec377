"""The streamed queries hold the whole table's rows: against the same work in batch and brute force."""

import collections
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reasonlake.plans import fixtures as X

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def fired(rows):
    """(session, block, rule, time, start) of (session, turn, role, text), each rule once over the text so far."""
    turns = collections.defaultdict(list)
    for s, turn, role, text in rows:
        if role != "system":
            turns[str(s)].append((turn, text))
    out = []
    for s, of in turns.items():
        text, known = "", set()
        for turn, t in sorted(of):
            text += t
            for _, name, pattern, *_ in X.RULES:
                if name not in known and (m := re.search(pattern, text, re.IGNORECASE)):
                    known.add(name)
                    out.append((s, str(turn), name, turn * 1000.0, m.start()))
    return sorted(out)


def rules_match(spark, sf):
    rows = [
        tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
            "conv_id", "turn", "role", F.coalesce("text", F.lit(""))
        ).collect()
    ]
    got = sorted(map(tuple, entry.queries()["live_rule_firing"](spark, sf).collect()))
    assert got and got == fired(rows)


def test_live_rule_firing_is_whole(spark):
    rules_match(spark, SF)


def test_live_rule_firing_of_sessions_that_end_together(spark, tmp_path):
    rows = [
        (
            c, t, "user" if t % 2 == 0 else "assistant", "eau" if t == c % 4 else f"all {c}" if t == 3 else "x"
        ) for c in range(12) for t in range(4)
    ]
    spark.createDataFrame(
        rows, spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").schema
    ).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    rules_match(spark, str(tmp_path))


def test_stage_rollup_stream_is_whole(spark):
    got, want = (sorted(map(tuple, entry.queries()[f"stage_rollup_{x}"](spark, SF).collect())) for x in ("stream", "batch"))
    assert got and got == want
