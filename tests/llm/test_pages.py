"""Main text: broken and hostile pages, what cues may and may not cut, and the selection against a plain twin."""

import random
import time

import pytest

from reasonlake.llm import html_text as H

ITEMS = [f"Item {i} of a list, which is long, has stops, and goes on. And on, too, for a while." for i in range(6)]
MORE = [x.replace("Item", "Other") for x in ITEMS]
PROSE, OTHER = ("".join(f"<p>{x}</p>" for x in y) for y in (ITEMS, MORE))
SAID = "<p>I liked this, really. It was good, and more. So much, so far.</p>"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article>{}</article><!-- note <p>hidden, text. more.</p>", ITEMS),
        ("<article>{}</article><a href='http://x", ITEMS),
        ("<article>{}</article><p title=\"x>more, of it.</p>", ITEMS),
        ("<article>{}<!--> <p>Not, a comment. So, it stays.</p></article>", [*ITEMS, "Not, a comment. So, it stays."]),
        ("<article>{}<!-- a --!><p>After, it. It stays.</p></article>", [*ITEMS, "After, it. It stays."]),
        ("<article>{}<p>Less, 1 < 2. And <3, too.</p><?php echo 'x' ?></article></", [*ITEMS, "Less, 1 < 2. And <3, too."]),
        ("<article>{}<script>var a = '<p>no, no. no.</p>';", ITEMS),
        ("<article>{}</article><section class='discussion'>" + f"<article class='comment'>{SAID}</article>" * 5 + "</section>", ITEMS),
        (f"<div class='cc-window'>{SAID}</div><article>{{}}</article>", ITEMS),
        (f"<div class=x>{{}}</div><div class='kommentare'>{SAID}</div><div class=werbung>{SAID}</div><div class='outbrain-box'>{SAID}</div>", ITEMS),
        ("<article>{}<ins class='adsbygoogle'>Buy, this. Now.</ins><p>Last, one. It is here.</p></article>", [*ITEMS, "Last, one. It is here."]),
        (f"<article>{{}}<div class='search-content'>{OTHER}</div></article>", [*ITEMS, *MORE]),
        (f"<article>{{}}<div class='story-related'>{OTHER}</div></article>", [*ITEMS, *MORE]),
        ("<div class='page-header'><h1>Title</h1></div><div class=c>{}</div>", ["Title", *ITEMS]),
        ("<div class='page-header'><h1>Site</h1></div><div class=c><h1>Title</h1>{}</div>", ["Title", *ITEMS]),
        ("<article>{}<p>We find that <math><mi>x</mi></math> is large, which is fine.</p></article>", [*ITEMS, "We find that x is large, which is fine."]),
    ],
)
def test_given_pages(page, want):
    assert H.main_text(f"<html><body>{page.format(PROSE)}" + "</body></html>" * page.endswith("</article>")).split("\n") == want


@pytest.mark.parametrize("piece", ["<a ", "<p a='", "<!-- x -->", "<!--", "</", "<a b=", "<script>", "<b c=\"x", "&amp", "<?", "<p><!", "<title>"])
def test_hostile_pages_take_time_in_proportion(piece):
    """A megabyte of each."""
    began = time.process_time()
    H.main_text(f"<article>{PROSE}" + piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 3


def test_tokens():
    got = list(H.tokens("a<B x=1 x=2 y='&lt;' z hidden=\"\">c &amp; d</b ><br/><title>&lt;p></TITLE ><svg/>"))
    assert got == [
        ("text", "a", {}, False), ("start", "b", {"x": "1", "y": "<", "z": "", "hidden": ""}, False), ("text", "c & d", {}, False), ("end", "b", {}, False),
        ("start", "br", {}, True), ("start", "title", {}, False), ("text", "&lt;p>", {}, False), ("end", "title", {}, False), ("start", "svg", {}, True)
    ]


def twin(page):
    """The selection as its definition reads, by walks to the root from each block."""
    blocks, parent, tag, marked = page.blocks, page.parent, page.tag, page.marked
    if not blocks:
        return []

    def line(p):  # from the root down
        return [*(line(parent[p]) if p else []), p]

    left = {p: max(_product(H.CUED_MILDLY if marked[q] == H.SLIGHT else H.CUED if marked[q] else 1.0 for q in line(p)), H.CUED**9) for p, _, _ in blocks}
    ratio = {p: r * left[p] for p, r in H.ratios(blocks).items()}
    mean = sum(ratio[p] * len(t) for p, t, _ in blocks) / sum(len(t) for _, t, _ in blocks)
    content = {p for p in ratio if ratio[p] >= H.LEAST_RATIO * mean}
    held = lambda q, own=True: sum(len(t) for p, t, _ in blocks if p in content and q in line(p) and (own or p != q))
    article = 0
    for p in range(1, len(parent)):
        if held(p, False) >= H.ARTICLE_SHARE * held(0) and len(line(p)) > len(line(article)):
            article = p
    around = article
    while around and tag[around] in H.PARTS:
        around = parent[around]
    outer = lambda p: next((q for q in line(p) if tag[q] in H.ARTICLE), 0)
    whole = {outer(p) for p in content} - {0} | ({article} if article and tag[article] not in ("html", "body") else set())
    off = lambda p: any(marked[q] > H.SLIGHT and not held(q) for q in line(p))

    def keep(p, t, linked, title):
        inside, few = bool(whole & set(line(p))), 2 * linked < len(t)
        if p in content:
            return inside or not whole or few
        if off(p) and tag[p] == "h1" and not title and all(marked[q] <= H.TITLE or held(q) for q in line(p)):
            return True
        holder = parent[p]
        while holder and tag[holder] in H.PARTS:
            holder = parent[holder]
        near = held(holder, False) or tag[p] == "h1" and held(parent[holder], False)
        if off(p) or not (outer(p) or near):
            return False
        return inside or tag[p] in H.HEADINGS or (around != article and around in line(p)) and (not whole or few)

    kept = [keep(*b, True) for b in blocks]
    if not any(k and tag[p] == "h1" for k, (p, _, _) in zip(kept, blocks, strict=True)):
        kept = [keep(*b, False) for b in blocks]
    return [t for k, (_, t, _) in zip(kept, blocks, strict=True) if k]


def _product(xs):
    out = 1.0
    for x in xs:
        out *= x
    return out


def test_selection_by_its_twin():
    r = random.Random(4)

    def made(depth):
        html = ""
        for _ in range(r.randint(1, 4)):
            tag = r.choice(["div", "div", "section", "article", "p", "ul", "h1", "h2"])
            name = r.choice(["", "", "", "x", "comment", "page-header", "story-related", "ad", "search-content"])
            if depth and tag not in ("p", "h1", "h2") and r.random() < 0.7:
                inner = made(depth - 1)
            else:
                inner = r.choice([r.choice(ITEMS), "Short", f"<a href=z>{r.choice(['link', 'more of it'])}</a>", "One, two. Three."])
            html += f"<{tag}{f' class={name}' if name else ''}>{inner}</{tag}>"
        return html

    several = 0
    for _ in range(300):
        page = H.Page()
        html = f"<html><body>{made(4)}</body></html>"
        page.feed(html)
        want = twin(page)
        assert H.main_text(html) == "\n".join(want), html
        several += len(want) > 3
    assert several > 50
