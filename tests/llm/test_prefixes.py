"""Suffixes at common anchors are dealt by longer prefixes."""

import random

import numpy as np
import pytest

from reasonlake.llm import common
from reasonlake.llm import substring_dedup as S
from tests.llm.test_ops import brute_removed, kept


def near_copies(seed, n=60, size=70):
    """Copies of one text that differ in a word each, and texts with one passage of it."""
    r = random.Random(seed)
    base = [f"w{r.randrange(40)}" for _ in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        w[r.randrange(size)] = f"x{r.randrange(9)}"
        rows.append((i * 2, " ".join(w if i % 3 else [f"y{j}" for j in range(9)] + base[20:50])))
    return rows


@pytest.mark.parametrize("fits", [2, 5, 11])
def test_rows_of_common_anchors(spark, monkeypatch, fits):
    monkeypatch.setattr(S, "PREFIX_ROWS", fits)
    monkeypatch.setattr(S, "GROUP_ROWS", 50)
    rows = near_copies(fits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert kept(S.dedup_substrings(df)) == brute_removed(rows)


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_meet_and_unlike_ones_part(seed):
    """Whatever number of words a prefix has more, equal windows are in one group; long prefixes spread a common anchor."""
    r = np.random.default_rng(seed)
    texts = [t.encode() for _, t in near_copies(seed)]
    ids = np.arange(len(texts))
    codes = common.CODES.array([w for t in texts for w in t.split()])
    anchors = np.unique(S.window_anchors(codes, 13, 5)[0])
    grown = r.integers(0, 9, len(anchors)).astype(np.uint64)
    s = S._cut(ids, ids, texts, anchors | grown << S.LONGER, 13, 5, 30)
    of, groups = {}, set()
    for i in range(len(s.n)):
        words = s.words[i].split(b" ")
        for k in range(int(s.n[i])):
            of.setdefault(b" ".join(words[k : k + 13]), set()).add(int(s.grp[i]))
        groups.add(int(s.grp[i]))
    assert all(len(x) == 1 for x in of.values())
    plain = S._cut(ids, ids, texts, anchors, 13, 5, 30)
    assert len(groups) > 1.5 * len(set(plain.grp.tolist()))
    starts = lambda c: sorted((int(d), int(a) + k) for d, a, n in zip(c.doc, c.start, c.n, strict=True) for k in range(int(n)))
    assert starts(s) == starts(plain)


def test_words_by_count():
    assert S.longer(np.array([0, 1, 10, 11, 20, 21, 10_000_000]), 10, 8).tolist() == [0, 0, 0, 1, 1, 2, 8]
