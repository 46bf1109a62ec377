"""The numbered operators against brute force, round trips and odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reasonlake.llm import bpe, common, decontaminate, html_text, line_dedup, near_dedup, quality, sharding, substring_dedup, token_counts, toxicity

#: Odd rows: nulls in all columns, empty and blank texts, repeats, ties, a very long text, and columns whose names
#: operators use themselves.
SCHEMA = "doc_id long, text string, source string, n_words long, shard int, score double, kept boolean, n_removed long, `a b` int, word string, sig binary, marks string"
EXTRA = (1, 2, 3.0, True, 4, 5, "w", b"s", "m")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def odd(spark):
    rows = [
        (None, None), (None, "only null id here"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"),
        (6, "same id first"), (6, "same id second text"), (7, LONG), (8, LONG), (9, "é😀 x\x00y \x1c z"),
        (10, "a b c d e f g h i j k l m n o p")
    ]
    return spark.createDataFrame(
        [(*r, None if i % 3 else "s1", *((None,) * 9 if i % 2 else EXTRA)) for i, r in enumerate(rows)], SCHEMA
    )


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def corpus(seed, n=120, vocab=60, size=60):
    """Random texts with exact copies, near copies and shared passages."""
    r = random.Random(seed)
    w = [f"{a}{b}" for a in "bcdfgh" for b in "aeiouxyzvw"][:vocab]
    passage = [r.choice(w) for _ in range(20)]
    texts = []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            t = r.choice(texts)
        elif texts and kind < 0.45:
            t = list(r.choice(texts))
            for _ in range(r.randint(1, 6)):
                if t:
                    t[r.randrange(len(t))] = r.choice(w)
        else:
            t = [r.choice(w) for _ in range(r.randint(0, size))]
        if kind > 0.9:
            at = r.randint(0, len(t))
            t = t[:at] + passage + t[at:]
        texts.append(list(t))
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


# ---- 1


def brute_classes(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = words((t or "").encode().lower().decode())
        n = min(k, len(w))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(
    "k,percent,limits", [(3, 85, {}), (5, 80, {"key_members": 3, "group_shingles": 400}), (3, 85, {"group_shingles": 60})]
)
def test_near_duplicate_classes(spark, k, percent, limits):
    rows = corpus(k)
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), k, percent, **limits).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_classes(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_links_of_large_groups(spark):
    """A chain of texts, each near the next alone: nearly all members stay open after the hub."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i + 1, " ".join(w[3 * i : 3 * i + 60])) for i in range(60)] + [
        (100 + i, " ".join(w[200:300] + [f"x{i}"])) for i in range(20)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limits in ({"group_shingles": 300}, {"group_shingles": 90, "key_members": 2}, {}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.classes(df, 3, 85, **limits).collect()}
        assert got == brute_classes(rows, 3, 85)


def test_index_guarantees_its_distance():
    index = near_dedup.Index.for_similarity(0.85)
    r = np.random.default_rng(0)
    for _ in range(200):
        a = r.integers(0, 65536, index.symbols).astype(np.uint16)
        b = a.copy()
        at = r.choice(index.symbols, index.distance, replace=False)
        b[at] = b[at] + 1
        x, y = index.keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


@pytest.mark.parametrize("similarity", [0.85, 0.8])
def test_members_of_different_salts_meet(spark, similarity):
    index = near_dedup.Index.for_similarity(similarity)
    near, reach = index.distance // 2, index.distance
    # a chain: a leader of leaders, leader 1, its member, a member of leader 2 within reach, leader 2
    ends = [0, near, 2 * near, 2 * near + reach, 3 * near + reach]
    sigs = [(np.arange(index.symbols) < e).astype(np.uint16).tobytes() for e in ends]
    met = spark.createDataFrame(
        [(7, node, 5, salt) for node, salt in enumerate([2, 0, 0, 1, 1])], "key long, node long, n long, salt int"
    )
    known = spark.createDataFrame(
        [(node, w, bytearray(x)) for node, (w, x) in enumerate(zip([9, 8, 1, 1, 8], sigs))], "node long, weight long, sig binary"
    )
    roots = {r["node"]: r["root"] for r in near_dedup.connected(near_dedup._tie(met, known, index)).collect()}
    assert roots[2] == roots[3]


def test_near_duplicates_of_odd_rows(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.classes(odd(spark), 3, 85).collect()}
    assert {(None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 4, False)} <= got
    assert {c for d, _, c, _ in got if d in (7, 8)} == {7}
    assert near_dedup.classes(odd(spark), 3, 85).count() == 14
    assert near_dedup.classes(empty(spark)).count() == 0
    kept = near_dedup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and kept.where("doc_id = 8").count() == 0 and kept.where("doc_id = 7").count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 7), (50, 51)]
    got = {r["node"]: r["root"] for r in near_dedup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 1, 101: 1, 50: 50, 51: 50}


# ---- 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies, really. Accept them, please.</div>
<div class="wrap"><article><h1>Title &amp; more</h1><p><b>First   paragraph, with&nbsp;text.<br>And a line.<p>Second one, it is longer, and has stops. Yes.</p>
<ul><li>point one.</li><li>point two.</li></ul><div class="ad">Buy this, now.</div><form>Name, please. <input></form></article>
<aside>Related, links. More.</aside><section id="comments"><p>A reader comment, quite long, with stops. And more of it here, to be sure.</p></section></div>
<footer>&copy; Footer, text.</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph, with text. And a line.\nSecond one, it is longer, and has stops. Yes.\npoint one.\npoint two."


def test_main_text_by_ratios_without_semantic_elements():
    links = "".join(f'<div><a href="/{i}">item {i}</a></div>' for i in range(20))
    body = "".join(f"<p>Sentence number {i}, which is long enough, has stops. And goes on, too.</p>" for i in range(6))
    text = html_text.main_text(f"<html><body><div class='x1'>{links}</div><div class='x2'>{body}</div></body></html>")
    assert text.split("\n") == [f"Sentence number {i}, which is long enough, has stops. And goes on, too." for i in range(6)]


ITEMS = [f"Item {i} of a list, which is long, has stops, and goes on. And on, too, for a while." for i in range(12)]


@pytest.mark.parametrize("article", ["<article{}>", "<main{}>", "<div{}>"])
@pytest.mark.parametrize(
    "inner",
    [
        "<h1>T</h1><p>intro</p><ul>" + "".join(f"<li>{x}</li>" for x in ITEMS) + "</ul>",
        "<h1>T</h1><p>intro</p><blockquote>" + "".join(f"<p>{x}</p>" for x in ITEMS) + "</blockquote>",
        "<h1>T</h1><p>intro</p><section>" + "".join(f"<p>{x}</p>" for x in ITEMS) + "</section>",
        "<h1>T</h1><p>intro</p><table>" + "".join(f"<tr><td>{x}</td></tr>" for x in ITEMS) + "</table>",
    ],
)
def test_main_text_is_not_one_part_of_the_article(article, inner):
    page = f"<html><body><nav>menu</nav>{article.format(' class=x')}{inner}</{article[1:-3]}><footer>end</footer></body></html>"
    assert html_text.main_text(page).split("\n") == ["T", "intro", *ITEMS]


def test_main_text_with_lead_beside_the_body():
    body = "".join(f"<p>{x}</p>" for x in ITEMS)
    assert html_text.main_text(
        f"<article><h1>T</h1><div class=lead>Short lead</div><div class=body>{body}</div></article>"
    ).split("\n") == ["T", "Short lead", *ITEMS]
    two = html_text.main_text(
        f"<body><h1>T</h1><article class=a><p>{ITEMS[0]}</p><div>note</div></article><article class=b>{body}</article></body>"
    )
    assert two.split("\n") == ["T", ITEMS[0], "note", *ITEMS]


def test_main_text_leaves_links_beside_a_layout_cell():
    links = "".join(f'<a href="/{i}">item {i}</a> ' for i in range(20))
    text = html_text.main_text(
        f"<body><table><tr><td class=l>{links}</td><td class=r>{''.join(f'<p>{x}</p>' for x in ITEMS)}</td></tr></table></body>"
    )
    assert text.split("\n") == ITEMS


PROSE = "".join(f"<p>{x}</p>" for x in ITEMS)


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="site no-sidebar"><article><h1>T</h1>{}</article></div>', ["T", *ITEMS]),
        ('<div class="post comments-open">{}</div>', ITEMS),
        (
            '<header><p>Site, name.</p></header><article><header><h1>Title</h1></header>{}<footer>by me, today.</footer></article>',
            ["Title", *ITEMS]
        ),
        (
            '<article>{}<p style="display: none">hid, this. den.</p><div style="visibility:hidden">And, this.</div></article>',
            ITEMS
        ),
        ('<div class="promo9"><h2>Buy, now</h2></div><h1>T</h1><div class="a">{}</div>', ["T", *ITEMS]),
        ('<div class="sidebar"><h1>T</h1>{}<div class="ad">Buy, this. Now, please.</div></div>', ["T", *ITEMS]),
        ('<div id="content">{}</div><div id="comments"><p>A long comment, with stops. And more, and more.</p></div>', ITEMS),
        (
            '<div role="navigation"><p>This, that. And more, too.</p></div><div class="cookieNotice">Cookies, here. Yes, please.</div>{}',
            ITEMS
        ),
        (
            '<div class="main-nav"><p>One, two. Three, four.</p></div><div class="entry-header"><h1>T</h1></div><div class="entry">{}</div>',
            ["T", *ITEMS]
        ),
    ],
)
def test_main_text_by_paths_and_cues(page, want):
    assert html_text.main_text(f"<html><body>{page.format(PROSE)}</body></html>").split("\n") == want


def test_ratios_of_paths_by_brute_force():
    r = random.Random(12)

    def made(path, depth):
        """A page and its blocks, each with its path as text."""
        html, blocks = "", []
        for _ in range(r.randint(1, 4)):
            tag, name = r.choice(["div", "section", "ul"]), r.choice(["", "x", "y"])
            own = f"{path}/{tag}.{name}"
            if depth and r.random() < 0.6:
                inner, more = made(own, depth - 1)
            else:
                linked = "".join(r.choice("ab .,") for _ in range(r.randint(0, 20))).strip()
                text = " ".join(r.choice(["word", "stop.", "comma,", "x"]) for _ in range(r.randint(1, 30)))
                inner, more = f"{text} <a href=z>{linked}</a>", [(own, " ".join(f"{text} {linked}".split()), len(linked))]
            html += f"<{tag}{f' class={name}' if name else ''}>{inner}</{tag}>"
            blocks += more
        return html, blocks

    for _ in range(60):
        html, want = made("", 5)
        page = html_text.Page()
        page.feed(html)
        assert [(t, k) for _, t, k in page.blocks] == [(t, k) for _, t, k in want]
        first = {}
        for p, t, k in want:
            own = [(len(t2), sum(c in ".," for c in t2), min(k2, len(t2))) for p2, t2, k2 in want if p2 == p]
            n, size = len(own), sum(x[0] for x in own)
            first[p] = size / n * (1 + sum(x[1] for x in own)) / n * (1 - sum(x[2] for x in own) / size)
        smooth = collections.defaultdict(list)
        for i, (p, _, _) in enumerate(want):
            near = [(np.exp(-((j - i) ** 2) / 2), first[want[j][0]]) for j in range(max(0, i - 2), min(len(want), i + 3))]
            smooth[p].append(sum(w * x for w, x in near) / sum(w for w, _ in near))
        got = html_text.ratios(page.blocks)
        for (node, _, _), (p, _, _) in zip(page.blocks, want):
            assert got[node] == pytest.approx((first[p] * np.mean(smooth[p])) ** 0.5)


def test_deep_and_long_pages_take_time_in_proportion():
    import time

    for page in (
        "<div>x, y." * 20_000, "<p><button>" + "<b>" * 20_000 + "<div></div>" * 20_000 + "</i>" * 20_000, "<li><div>" * 20_000,
        "<ul>" + "<li>word, and. more" * 60_000
    ):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 5
    text = html_text.main_text(f"<article>{PROSE * 3000}</article>")
    assert text.count("\n") == 36_000 - 1


def test_pages_keep_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "u", PAGE, 5, 2, "x", "y"), (2, None, None, None, None, None, None)],
        "page_id long, url string, html string, n_chars int, path int, parent string, `a b` string"
    )
    out = html_text.extract_text(df)
    assert out.columns == ["page_id", "url", "n_chars", "path", "parent", "a b", "text"]
    assert {tuple(r) for r in out.collect()} == {
        (1, "u", 5, 2, "x", "y", html_text.main_text(PAGE)), (2, None, None, None, None, None, "")
    }


def test_pages_of_any_kind(spark):
    df = spark.createDataFrame(
        [
            (1, None, "old"), (2, "", "old"), (3, "plain words only.", "old"), (4, "<p>unclosed <b>x", "old"), (5, PAGE, "old"),
            (5, PAGE, None), (None, "<nav>menu</nav>", "old"), (6, "<" * 5000, "old")
        ],
        "page_id long, html string, text string"
    )
    got = collections.Counter((r["page_id"], r["text"]) for r in html_text.extract_text(df).collect())
    assert got[1, ""] == 1 and got[2, ""] == 1 and got[3, "plain words only."] == 1 and got[4, "unclosed x"] == 1 and got[None, ""] == 1
    assert got[5, html_text.main_text(PAGE)] == 2
    assert html_text.extract_text(df.limit(0)).count() == 0


# ---- 3


@pytest.mark.parametrize("n", [1, 2, 3, 5, 63, 64, 1000])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, 7, back=True).tolist() == list(range(n))


def test_shards(spark):
    df = spark.createDataFrame([(i * 7, f"t{i % 5}") for i in range(1003)], "doc_id long, text string")
    a = sharding.shard_rows(df, ["doc_id"], 40)
    rows = a.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = {len(x) for x in by.values()}
    assert len(by) == 40 and max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard_rows(df.repartition(7), ["doc_id"], 40).collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in rows} == again  # whatever the partitions
    numbered = {r["doc_id"]: r["n"] for r in sharding.number_rows(df, ["doc_id"], "n").collect()}
    r = rows[17]
    assert sharding.row_at(r["shard"], r["slot"], 1003, 40) == numbered[r["doc_id"]]


def test_sharding_query_columns(spark, tmp_path):
    rows = [(3, "a"), (1, None), (2, ""), (5, "é😀"), (4, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op3_sharding(spark, str(tmp_path)).collect()
    want = {d: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in out} == want
    assert {
        (r["law"], r["grown_shard"]) for r in out
    } == {("rows", None)} and all(r["slot"] == 0 for r in out) and len({r["shard"] for r in out}) == 5


def test_shards_of_odd_rows(spark):
    out = sharding.shard_rows(odd(spark), ["doc_id", "text"], 4)
    assert sorted((r["shard"], r["slot"]) for r in out.collect()) == sorted((i % 4, i // 4) for i in range(14))
    assert sharding.shard_rows(empty(spark), ["doc_id"], 4).count() == 0


# ---- 4


def brute_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark):
    r = random.Random(5)
    texts = [None, "", " ", "a", "a b", "a b c", "a a a a a", "x\x1cy z", "é😀 # |\n# |\n\n \x0b\n# |", LONG[:9000]] + [
        "".join(r.choice(["a ", "b ", "c\n", "#", "\t", "é "]) for _ in range(r.randint(0, 80))) for _ in range(150)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("n_words", F.lit("clash"))
    for x in quality.base_counts(df).collect():
        assert (
            x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]
        ) == brute_counts(texts[x["i"]]), repr(texts[x["i"]])


def test_rules_find_a_planted_threshold(spark):
    r = random.Random(2)
    rows = [(x := r.random(), y := r.random(), int(x > 0.8 and y < 0.5 or y > 0.97), i % 3 > 0) for i in range(4000)]
    train = spark.createDataFrame(rows, "x double, y double, bad int, grow boolean")
    rules = quality.learn_rules(train, ["x", "y"])
    right = train.withColumn("hit", quality.list_expression(rules) > 0).where("hit = (bad = 1)").count()
    assert rules and right / 4000 > 0.97
    assert quality.learn_rules(train.limit(0), ["x", "y"]) == []
    assert quality.learn_rules(train.where("bad = 0"), ["x", "y"]) == []


def test_quality_verdicts_by_the_list(spark):
    """Base rules and the learned list against plain loops over the same list; rows that had no say tell how good it is."""
    r = random.Random(7)
    rows, labels = [], []
    for i in range(700):
        bad = i % 3 == 0
        w = [f"w{r.randint(0, 4000)}" for _ in range(r.choice([20, 60, 90]))]
        if bad:
            w = [x + ("###" if r.random() < 0.8 else "") for x in w]
        elif i % 5 == 1:
            w[3] += "$"  # one symbol is not yet bad
        if i % 11 == 0:
            w = w[:5] * 15
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad)))
    table = quality.counted(spark.createDataFrame(rows, "doc_id long, text string"))
    marked = quality.labelled(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    rules = quality.learned(marked)
    figures = {x["rule"]: (x["n"], x["n_bad"]) for x in quality.list_figures(marked, rules).collect()}
    assert rules and all(
        n == bad if k else bad == 0 for k, (n, bad) in figures.items()
    ) and sum(n for n, _ in figures.values()) > 50
    out = {
        x["doc_id"]: x for x in quality.judge_quality(
            spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
        ).collect()
    }
    for d, t in rows:
        n, _, symbols, _, repeats = brute_counts(t)
        failed = n < 50 or 100 * repeats > 50 * n
        first = next(
            (i for i, rule in enumerate(rules, 1) if all((out[d][c.stat] > c.bound) == c.above for c in rule.conditions)), 0
        )
        assert (out[d]["base_failed"], out[d]["rule"], out[d]["kept"]) == (failed, first, not failed and first == 0)
        assert failed or out[d]["kept"] == (symbols <= 1), (d, symbols)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    out = quality.judge_quality(odd(spark), labels).collect()
    assert len(out) == 14
    texts = {(r["doc_id"], r["text"]) for r in odd(spark).collect()}
    for r in out:
        own = [brute_counts(t) for d, t in texts if d == r["doc_id"]]
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got in own
        failed = got[0] < 50 or 100 * got[4] > 50 * got[0]
        assert (r["base_failed"], r["kept"]) == (failed, not failed)
    assert quality.judge_quality(empty(spark), labels).count() == 0


# ---- 5


def greedy(vocab_first, vocab_rest, word):
    n = i = 0
    while i < len(word):
        vocab = vocab_first if i == 0 else vocab_rest
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocab), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_counts_greedy_pieces():
    r = random.Random(4)
    piece = lambda: bytes(r.choice(b"abc") for _ in range(r.randint(1, 5)))
    for _ in range(60):
        first, rest = {piece() for _ in range(8)}, {piece() for _ in range(8)}
        a = token_counts.Automaton(first, rest)
        for _ in range(150):
            w = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            assert a.count(w) == greedy(first, rest, w), (first, rest, w)


def test_token_counts_of_odd_rows(spark):
    out = token_counts.count_tokens(odd(spark)).collect()
    ranks = bpe.load_ranks(bpe._path("byte_bpe_50k.tiktoken"))
    first, rest = {t for t in ranks if t[:1] == b" "}, {t for t in ranks if t[:1] != b" "}
    for r in out:
        ws = [b" " + w.encode() for w in words(r["text"])]
        once = {w: greedy(first, rest, w) for w in set(ws)}
        assert (r["n_words"], r["n_tokens"]) == (len(ws), sum(once[w] for w in ws))
    assert token_counts.count_tokens(empty(spark)).count() == 0


# ---- 6


def norm(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items, size=13):
    w, hit, which = norm(text), set(), set()
    for item, t in items:
        v = norm(t)
        n = min(size, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                which.add(str(item))
    return len(w), len(hit), sorted(which)


@pytest.mark.parametrize("limit,piece", [(0, 4096), (10_000, 4096), (10_000, 7)])
def test_contamination(spark, limit, piece, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    r = random.Random(8)
    rows = corpus(11, 60)
    items = [
        (1, " ".join(f"q{i}" for i in range(30))), (20, rows[4][1] + " zz"), (3, "Short, Item!"), (4, "solo"), (5, None),
        (6, "..."), (3, "Short, Item!"), (7, "É one two three four")
    ]
    docs = [
        (
            d,
            t + r.choice(["", " short ITEM", " solo", " q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14", " é one two three four"])
        ) for d,
        t in rows
    ] + [(900, None), (901, ""), (902, "x"), (902, "solo"), (902, "solo"), (None, "solo")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (limit,))
    got = collections.Counter(
        (
            x["doc_id"], x["n_words"], x["n_hit"], tuple(x["items"]), x["contaminated"]
        ) for x in decontaminate.contamination(df, bench).collect()
    )
    want = collections.Counter()
    for d, t in docs:
        n, h, i = brute_hits(t, items)
        want[d, n, h, tuple(i), h > 0 and 20 * h >= n] += 1
    assert got == want


def test_decontamination_keeps_rows_whole(spark):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    out = decontaminate.drop_contaminated(odd(spark), bench)
    assert out.columns == odd(spark).columns and {r["doc_id"] for r in out.collect()} == {None, 1, 2, 3, 6, 7, 8, 9, 10}
    assert decontaminate.drop_contaminated(odd(spark), bench.limit(0)).count() == 14
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(odd(spark), bench).collect()}
    assert cut[4] == "" and cut[10] == "a b c d e f g h i j k l m n o p" and cut[1] is None
    assert decontaminate.contamination(empty(spark), bench).count() == 0


# ---- 7


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n same \n\nown {i}", f"s{i % 4}") for i in range(12)] + [
        (50, "rare", "s0"), (51, "rare", "s1"), (52, "rare\nx", "s2"), (60, None, "s9"), (61, "", None), (62, "same", None),
        (63, "same\nsame", "s1")
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line_no", F.lit(1))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df, min_sites=4).collect()}
    assert got[0] == ("own 0\n same \n\nown 0", 0) and got[5] == ("own 5\n\nown 5", 1) and got[52] == ("rare\nx", 0)
    assert got[60] == (None, 0) and got[61] == ("", 0) and got[62] == ("", 1) and got[63] == ("", 2)
    none = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(df, min_sites=3, keep_first=False).collect()}
    assert none[0] == 1 and none[50] == none[52] == 1


def test_line_dedup_counts_near_the_threshold_exactly(spark):
    rows = [(d, f"line {n}", f"site{d}") for n in (38, 39, 40, 41, 42) for d in range(n)]
    df = spark.createDataFrame([(i, t, s) for i, (_, t, s) in enumerate(rows)], "doc_id long, text string, source string")
    hit = {r["line_hash"] for r in line_dedup.boilerplate(line_dedup.lines_of(df, "doc_id", "text", "source"), 40, 4).collect()}
    assert hit == {
        r["h"] for r in spark.createDataFrame(
            [(f"line {n}",) for n in (40, 41, 42)], "t string"
        ).select(F.xxhash64("t").alias("h")).collect()
    }


def test_line_dedup_of_odd_rows(spark):
    out = line_dedup.dedup_lines(odd(spark), min_sites=1)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0 and set(out.columns) == set(odd(spark).columns)
    got = collections.Counter((r["doc_id"], r["text"], r["n_removed"]) for r in out.collect())
    # one site, s1, has the lines of rows 0, 3, 6, 9 and 12; the first of equal lines by id stays
    texts = collections.Counter()
    marked = {(r["text"] or "").strip() for r in odd(spark).where("source = 's1'").collect()} - {""}
    for r in odd(spark).collect():
        t = r["text"]
        cut = t is not None and t.strip() in marked and (
            r["doc_id"] is None or any(
                o["text"] == t and o["doc_id"] is not None and o["doc_id"] < r["doc_id"] for o in odd(spark).collect()
            )
        )
        texts[r["doc_id"], "" if cut else t, int(cut)] += 1
    assert got == texts


# ---- 8


def brute_removed(rows, size=13):
    first = {}
    for d, t in rows:
        w = words(t)
        if d is not None:
            for i in range(len(w) - size + 1):
                k = tuple(w[i : i + size])
                first[k] = min(first.get(k, d), d)
    out = collections.Counter()
    for d, t in rows:
        w = words(t)
        gone = {
            p for i in range(len(w) - size + 1) if d is not None and first[tuple(w[i : i + size])] < d for p in range(i, i + size)
        }
        out[d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    return out


def kept(out):
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect())


@pytest.mark.parametrize("groups,codes,common", [(1, 50, 20_000), (16, 4_000_000, 20_000), (16, 50, 1)])
def test_substring_dedup(spark, groups, codes, common, monkeypatch):
    rows = corpus(21, 100) + [
        (500, "a " * 40), (501, "a " * 30), (502, "a " * 12), (7, "b " * 20 + "a " * 14), (None, "a " * 30), (500, "c " * 15),
        (499, "c " * 14), (503, None), (504, "")
    ]
    monkeypatch.setattr(substring_dedup, "GROUPS", groups)
    monkeypatch.setattr(substring_dedup, "GROUP_CODES", codes)
    monkeypatch.setattr(substring_dedup, "PREFIX_ROWS", common)
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", codes)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("tag", F.lit("x"))
    assert kept(substring_dedup.dedup_substrings(df)) == brute_removed(rows)


@pytest.mark.parametrize("code", [lambda w: 7, lambda w: w[0] % 3, lambda w: sum(w) * 0x9E3779B97F4A7C15 % 2**64])
def test_trees_compare_words_whatever_their_hashes(code, monkeypatch):
    """Without Spark: the suffixes of a corpus in one tree, when hashes of words clash."""
    monkeypatch.setattr(common.WordCodes, "__missing__", lambda self, w: code(w))
    monkeypatch.setattr(substring_dedup, "CODES", common.WordCodes())
    rows = [(d, t) for d, t in corpus(31, 80) if words(t)] + [
        (900, "a " * 40), (901, "a " * 30), (902, "b a a a a a a a a a a a a a")
    ]
    texts, ids = [t.encode() for _, t in rows], np.array([d for d, _ in rows])
    anchors = np.concatenate([substring_dedup.window_anchors(substring_dedup.CODES.array(t.split()), 13, 5)[0] for t in texts])
    s = substring_dedup._cut(ids, ids, texts, np.unique(anchors), 13, 5, 4)
    of, start, n = substring_dedup._marked_runs(s, substring_dedup.settle(s, 13, 5))
    gone = collections.defaultdict(list)
    for i, a, k in zip(of.tolist(), start.tolist(), n.tolist()):
        gone[int(s.doc[i])].append((a, k))
    got = collections.Counter()
    for d, t in rows:
        w = words(t)
        cut = substring_dedup.covered(gone[d], len(w), 13)
        got[d, len(w), int(cut.sum()), " ".join(x for x, c in zip(w, cut) if not c)] += 1
    assert got == brute_removed(rows)


def test_what_a_batch_settles_need_not_travel(monkeypatch):
    text = b" ".join(b"w%d" % i for i in range(60))
    ids = np.arange(5)
    anchors = substring_dedup.window_anchors(common.CODES.array(text.split()), 13, 5)[0]
    s = substring_dedup._cut(ids, ids, [text] * 4 + [text + b" x y z"], np.unique(anchors), 13, 5, 4)
    later = substring_dedup.settle(s, 13, 5)
    rest = substring_dedup._rest(s, later, 13)
    assert int(later.sum()) == 4 * 48 and dict(zip(rest.doc.tolist(), rest.n.tolist())).keys() == {0, 4} and int(rest.n[rest.doc == 0].sum()) == 48 and int(rest.n[rest.doc == 4].sum()) <= 3


def test_substring_dedup_over_many_batches(spark):
    rows = corpus(22, 80)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert kept(substring_dedup.dedup_substrings(df)) == brute_removed(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_substring_dedup_of_odd_rows(spark):
    got = kept(substring_dedup.dedup_substrings(odd(spark)))
    assert got == brute_removed([(r["doc_id"], r["text"]) for r in odd(spark).select("doc_id", "text").collect()])
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0
    spans = substring_dedup.dedup_substrings(odd(spark)).where("doc_id = 8").first()["spans"]
    assert [(s["start"], s["n"]) for s in spans] == [(0, 60_000)]


# ---- 9


def test_bpe_is_that_of_the_merges(spark):
    import tiktoken

    for name in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"):
        ranks = bpe.load_ranks(bpe._path(name))
        c, e = bpe.Codec(ranks, bpe._pattern()), tiktoken.Encoding(
            "t", pat_str=bpe._pattern(), mergeable_ranks=ranks, special_tokens={}
        )
        r, tokens = random.Random(6), list(ranks)
        for i in range(4000):
            if i % 4 == 0:
                t = "".join(r.choice("abcdeth inso") for _ in range(r.randint(0, 40)))
            elif i % 4 == 1:
                t = "".join(
                    chr(
                        r.choice([r.randint(0, 127), r.randint(0, 0x2FFF), r.randint(0x1F300, 0x1F6FF)])
                    ) for _ in range(r.randint(0, 15))
                )
            elif i % 4 == 2:
                t = b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))).decode("utf-8", "ignore")
            else:
                t = r.choice("a hn=-\n") * r.randint(0, 300)
            ids = c.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == e.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_bpe_without_some_merges():
    """Tokens that no merges make are used for whole pieces alone."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"cd": 258, b"abcd": 259, b"xyz": 260}
    import tiktoken

    c, e = bpe.Codec(ranks, r"\S+|\s+"), tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice("abcdxyz ") for _ in range(r.randint(0, 12)))
        assert np.frombuffer(c.encode(t), "<u4").tolist() == e.encode_ordinary(t), t


def test_bpe_of_odd_rows(spark):
    out = bpe.bpe_decode(bpe.bpe_encode(odd(spark))).collect()
    assert len(out) == 14 and all(
        bytes(r["decoded"]) == (r["text"] or "").encode() and len(r["token_ids"]) == 4 * r["n_tokens"] for r in out
    )
    assert bpe.bpe_encode(empty(spark)).count() == 0


# ---- 10


def toxic_corpus(n=1500):
    r = random.Random(3)
    w = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    rows, labels = [], []
    for i in range(n):
        s = [" ".join(r.choice(w) for _ in range(r.randint(3, 9))) for _ in range(r.randint(1, 12))]
        bad = r.random() < 0.2
        if bad:
            s[r.randrange(len(s))] += " " + r.choice(["Grobble", "snark", "vile"])
        rows.append((i, ". ".join(s) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_sentences_from_documents(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.model_for(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score_texts(docs, model).collect()
    truth, held = dict(labels), {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in out if r["doc_id"] in held]) > 0.97
    for r in out:
        for s in r["offending"]:
            assert re.search("grobble|snark|vile", r["text"][s["start"] : s["end"]].lower())


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (6, None), (10, 0)], "doc_id long, toxic int")
    out = toxicity.score_texts(odd(spark), toxicity.model_for(odd(spark), labels)).collect()
    assert len(out) == 14 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_texts(empty(spark), toxicity.model_for(empty(spark), labels.limit(0))).count() == 0


def test_words_and_stage_tables(spark):
    df = spark.createDataFrame([(t,) for t in (None, "", " ", " a", "a ", "\ta\x0bb\r\n", "a\x1cb c")], "t string")
    assert [
        r["w"] for r in df.select(common.words_of(F.col("t")).alias("w")).collect()
    ] == [words(t) for t in (None, "", " ", " a", "a ", "\ta\x0bb\r\n", "a\x1cb c")]
    assert common.stage_table(df, "t").count() == 7 and common.stage_root(spark).startswith("file://")
    assert hashlib.sha256(b"").hexdigest() == df.limit(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("x")).first()["x"]
