"""Keys that very many unlike members share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reasonlake.llm import near_dedup


@pytest.mark.parametrize("key_members", [4, 16, 4096])
def test_unlike_members_of_a_key_are_dealt_over_tasks(spark, monkeypatch, key_members):
    """Members far from each other, and some pairs within the distance: these end in one group, whatever a task may hold."""
    index = near_dedup.Index.for_similarity(0.85)
    r = np.random.default_rng(3)
    sigs = r.integers(0, 60_000, (150, index.symbols)).astype(np.uint16)
    pairs = [(i, 75 + i) for i in range(0, 60, 3)]
    for i, j in pairs:
        sigs[j] = sigs[i]
        at = r.choice(index.symbols, index.distance, replace=False)
        sigs[j, at] += 1
    salts = -(-len(sigs) // key_members)
    met = spark.createDataFrame([(7, i, len(sigs), i % salts if salts > 1 else -1) for i in range(len(sigs))], "key long, node long, n long, salt int")
    known = spark.createDataFrame([(i, 1, bytearray(s.tobytes())) for i, s in enumerate(sigs)], "node long, weight long, sig binary")
    sizes, cluster = [], near_dedup._cluster

    def seen(members, index, keys, near, tie):
        sizes.append(members.groupBy(*keys).count().agg(F.max("count")).first()[0])
        return cluster(members, index, keys, near, tie)

    monkeypatch.setattr(near_dedup, "_cluster", seen)
    roots = {x.node: x.root for x in near_dedup.connected(near_dedup._tie(met, known, index, key_members)).collect()}
    assert all(roots.get(i, i) == roots.get(j, j) and i in roots for i, j in pairs)
    if salts > 1:
        assert len(sizes) == 2 and max(sizes) <= 4 * key_members
    alone = set(range(150)) - {x for p in pairs for x in p}
    assert not alone & roots.keys()


def test_components_end_when_no_edge_changes(spark):
    """A long path and a star, with equal numbers of edges from round to round."""
    edges = [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(501, 540)] + [(260, 530)]
    got = {x.node: x.root for x in near_dedup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {200} and len(got) == 61 + 40
    assert near_dedup.connected(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_lines_of_a_long_text_go_in_time_in_proportion(spark):
    """Two hundred thousand lines, of which every second one is cut."""
    import time

    from reasonlake.llm import line_dedup

    text = "\n".join(f"common line {i}" if i % 2 else f"own {i}" for i in range(200_000))
    rows = [(0, "s0", text)] + [(1 + i, f"s{1 + i}", "\n".join(f"common line {j}" for j in range(1, 200_000, 2))) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    began = time.time()
    got = {x.doc_id: (x.n_removed, x.text) for x in line_dedup.dedup_lines(df, min_sites=3, keep_first=False).collect()}
    assert got[0] == (100_000, "\n".join(f"own {i}" for i in range(0, 200_000, 2))) and got[1] == (100_000, "")
    assert time.time() - began < 60


def test_without(spark):
    from reasonlake.llm.common import without

    rows = [(list("abcdef"), [0, 2, 5]), (list("ab"), []), (list("ab"), [0, 1]), ([], [])]
    got = spark.createDataFrame(rows, "x array<string>, at array<int>").select(without("x", "at").alias("y")).collect()
    assert [r.y for r in got] == [["b", "d", "e"], ["a", "b"], [], []]
