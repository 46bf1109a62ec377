"""Operator 2: main text of web pages by tag-path ratios.

A page is cut into text blocks, each with the path of block elements from the root to
it; the text of inline elements is part of their block. Text length and punctuation are summed for each path and divided
by its blocks;
the two ratios are fused with the smoothed ratios along the page, and paths above a
threshold are content. Names of classes, ids and parts that tell of adverts, menus, comments and the like lower a path's ratio, so
a path below them is content only if there is hardly any other text.

Paths select; the main text is what they select with the short blocks that belong to it (headings, captions, one-word
paragraphs): all that no such name marks in an article or main element with content, or in the
deepest element that holds nearly all of the content, and content outside but for links. A list, table,
quote or section is a part of an article: what stands beside it counts too, but for links. A heading outside counts if it stands
beside an element that holds content, a title (``h1``) in an element of its own too. Elements that are never main text
are left out before.

Paths are nodes of a tree, with one parent each; all sums are one pass over the tree, so the time is in
proportion to the page however deep it is nested.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small

#: Elements that end a block of text.
BLOCK = set(
    "html body head title address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul caption noscript template iframe object button textarea".split()
)
#: Elements without content, and elements that are never main text; a header is, but for one in an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set(
    "head title script style noscript template iframe object svg canvas audio video nav aside footer form button "
    "select textarea input label menu dialog fieldset option datalist map".split()
)
#: Roles of elements that are never main text.
SKIP_ROLES = set(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split()
)
#: Words in class and id names that lower a path: a name counts if it is made of these and of words that tell nothing. English ones,
#: and those of readers' comments and adverts in the corpus' other languages.
COMMENTS = set(
    "comment comments commentlist disqus respond reply replies kommentar kommentare commentaire commentaires comentario comentarios".split()
)
ADVERTS = set(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo outbrain taboola werbung anzeige anzeigen "
    "publicite publicidad anuncio anuncios".split()
)
CUES = COMMENTS | ADVERTS | set(
    "promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer foot sidebar aside widget widgets "
    "cookie cookies cc consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended pagination pager toolbar search form tags hidden toc".split()
)
NEUTRAL = set(
    "site page main global top bottom left right primary secondary box wrap wrapper container area list section block inner window "
    "outer group bar col column item items links reader user the post entry article content story body mobile desktop".split()
)
#: With one of these a header is that of the article, and what else these words name may be a part of it.
OWN = {"post", "entry", "article", "content", "story"}
MILD = {"promotion", "banner", "alert", "overlay", "share", "social", "related", "recommended", "search", "form", "tags", "hidden", "toc"}
#: An element closes open ones of these kinds when it starts, up to an element of the last kinds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that name the article, and elements that are parts of one.
ARTICLE = {"article", "main"}
PARTS = set("blockquote center dd details dl dt figure li menu ol p pre section table tbody td tfoot th thead tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
STOPS = re.compile("[.,;:!?…。，、！？；：]")
WHITE = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)

#: Share of the weighted mean ratio that a path must reach; what a cue and a mild one leave of a path's ratio; share of content text
#: that the article must hold; spread of the smoothing in blocks.
LEAST_RATIO, CUED, CUED_MILDLY, ARTICLE_SHARE, SPREAD = 0.1, 0.001, 0.3, 0.8, 1.0

#: Kinds of cues, from none to one that leaves hardly anything.
NONE, SLIGHT, TITLE, STRONG = range(4)


def cue(names: str, of: set[str] = CUES) -> int:
    """The strongest cue among class or id names; a name counts if it is made of cue words and neutral ones.

    ``SLIGHT`` if it also says that it is part of an article, ``TITLE`` if it is some header, which may hold the title.
    """
    most = NONE
    for name in names.split():
        parts = {x.lower() for x in NAME_PARTS.findall(name)}
        known = parts & of
        if not known or not parts <= of | CUES | NEUTRAL or known == {"header"} and parts & OWN:
            continue
        most = max(most, SLIGHT if parts & OWN and known <= MILD else TITLE if known == {"header"} else STRONG)
    return most


_NAME, _SPACE, _ATTRIBUTE = re.compile(r"[^\t\n\f\r />]*"), re.compile(r"[\t\n\f\r /]*"), re.compile(r"[^\t\n\f\r />][^\t\n\f\r />=]*")
_EQUALS, _PLAIN = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*"), re.compile(r"[^\t\n\f\r >]*")
_COMMENT_END = re.compile("--!?>")
#: Elements whose content is text up to their end tag, whatever it looks like.
RAW = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.IGNORECASE) for t in "script style title textarea xmp iframe noembed noframes".split()}


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """(kind, name or text, attributes, closed at once) of the start tags, end tags and texts of a page, in one pass.

    Whatever is open at the end of the page (a comment, a tag, an attribute, a script) ends there and gives no text. Of
    attributes with the same name the first counts.
    """
    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", unescape(html[at:]), {}, False
            return
        if lt > at:
            yield "text", unescape(html[at:lt]), {}, False
        after = html[lt + 1 : lt + 3]
        if html.startswith("<!--", lt):
            if html.startswith((">", "->"), lt + 4):  # an empty comment
                at = html.index(">", lt) + 1
                continue
            stop = _COMMENT_END.search(html, lt + 4)
            if not stop:
                return
            at = stop.end()
            continue
        closing = after[:1] == "/"
        first = after[1:2] if closing else after[:1]
        if not (first.isascii() and first.isalpha()):
            if after[:1] in ("!", "?") or closing and first:  # a declaration, an instruction, or what browsers take as a comment
                at = html.find(">", lt) + 1
                if not at:
                    return
            elif closing:
                return
            else:
                yield "text", "<", {}, False
                at = lt + 1
            continue
        m = _NAME.match(html, lt + 1 + closing)
        name, at, attributes = m[0].lower(), m.end(), {}
        while True:
            gap = _SPACE.match(html, at)
            at = gap.end()
            if at >= end:
                return
            if html[at] == ">":
                break
            key = _ATTRIBUTE.match(html, at)
            at, value = key.end(), ""
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at : at + 1]
                if quote in ("'", '"') and quote:
                    stop = html.find(quote, at + 1)
                    if stop < 0:
                        return
                    value, at = html[at + 1 : stop], stop + 1
                else:
                    plain = _PLAIN.match(html, at)
                    value, at = plain[0], plain.end()
            attributes.setdefault(key[0].lower(), unescape(value))
        alone = html[at - 1] == "/"
        at += 1
        if closing:
            yield "end", name, {}, False
            continue
        yield "start", name, attributes, alone
        if name in RAW:
            stop = RAW[name].search(html, at)
            if not stop:
                return
            yield "text", html[at : stop.start()], {}, False
            at = stop.start()


class Page:
    """Cuts a page into blocks (path, text, characters in links). Paths are nodes: ``parent`` and ``tag`` hold what each
    is, ``marked`` what cue names it.
    """

    def __init__(self) -> None:
        self.parent, self.tag, self.marked = [0], [""], [NONE]
        self.child: dict[tuple[int, str, int], int] = {}
        self.open: list[tuple[str, int, bool]] = []  # element, its path, skipped
        self.at: dict[str, list[int]] = defaultdict(list)  # places of open elements by kind
        self.walls: list[int] = []  # places of open block elements
        self.blocks: list[tuple[int, str, int]] = []
        self.text: list[str] = []
        self.linked = 0

    def feed(self, html: str) -> None:
        """Read a whole page."""
        for kind, name, attributes, alone in tokens(html):
            if kind == "text":
                self.handle_data(name)
            elif kind == "end":
                self.handle_endtag(name)
            else:
                self.handle_starttag(name, attributes)
                if alone and name not in VOID and (name in ("svg", "math", "path") or self.at.get("svg") or self.at.get("math")):
                    self.handle_endtag(name)
        self.flush()

    def _last(self, kinds: set[str]) -> int:
        return max((self.at[k][-1] for k in kinds if self.at.get(k)), default=-1)

    def flush(self) -> None:
        if self.text:
            text = WHITE.sub(" ", "".join(self.text)).strip()
            if text:
                self.blocks.append((self.open[-1][1] if self.open else 0, text, self.linked))
            self.text, self.linked = [], 0

    def _drop(self, i: int) -> None:
        while len(self.open) > i:
            self.at[self.open.pop()[0]].pop()
            if self.walls and self.walls[-1] == len(self.open):
                self.walls.pop()

    def _pop_to(self, i: int) -> None:
        self.flush()
        self._drop(i)

    def handle_starttag(self, tag: str, a: dict[str, str]) -> None:
        if tag in BLOCK:
            self.flush()
            if tag in ("body", "html") and self.at.get("head"):
                self._pop_to(self.at["head"][0])
            if self.walls and self.open[self.walls[-1]][0] == "p":  # a block ends an open paragraph and what is open in it
                self._pop_to(self.walls[-1])
            if tag in CLOSES:
                ends, scope = CLOSES[tag]
                while (i := self._last(ends)) > self._last(scope):
                    self._pop_to(i)
                    if tag != "tr":
                        break
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        path, above = (self.open[-1][1], self.open[-1][2]) if self.open else (0, False)
        role = a.get("role", "").lower().split()
        names = f"{a.get('class', '')} {a.get('id', '')}"
        skip = above or tag in SKIP or "hidden" in a or a.get("aria-hidden") == "true" or bool(HIDDEN.search(a.get("style", "")))
        skip = skip or tag not in BLOCK and cue(names, ADVERTS) == STRONG  # an advert within a line
        skip = skip or not SKIP_ROLES.isdisjoint(role) or tag == "header" and self._last(ARTICLE) < 0
        if tag in BLOCK:
            marked = NONE if tag in ("html", "body", "main") else cue(names, COMMENTS | ADVERTS) if tag == "article" else cue(names)
            key = path, f"{tag}.{a['class']}" if a.get("class") else tag, marked
            if key not in self.child:
                self.child[key] = len(self.parent)
                self.parent.append(path)
                self.tag.append(tag)
                self.marked.append(marked)
            path = self.child[key]
            self.walls.append(len(self.open))
        self.at[tag].append(len(self.open))
        self.open.append((tag, path, skip))

    def handle_endtag(self, tag: str) -> None:
        i = self._last({tag})
        if i < 0:
            if tag in BLOCK:
                self.flush()
        elif tag in BLOCK:
            self._pop_to(i)
        elif not self.walls or i > self.walls[-1]:  # else a stray end of an inline element
            self._drop(i)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        self.text.append(data)
        if self.at.get("a"):
            self.linked += len(data)


def ratios(blocks: list[tuple[int, str, int]]) -> dict[int, float]:
    """Fused ratio of each path, cues apart: text length a block times punctuation a block, less what is in links, and
    its smoothed neighbours.
    """
    size, stops, links, n = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text, linked in blocks:
        size[path] += len(text)
        stops[path] += len(STOPS.findall(text))
        links[path] += min(linked, len(text))
        n[path] += 1
    ratio = {p: size[p] / n[p] * (1 + stops[p]) / n[p] * (1 - links[p] / size[p]) for p in n}
    kernel = [math.exp(-((d / SPREAD) ** 2) / 2) for d in range(-2, 3)]
    near = defaultdict(float)
    for i, (path, _, _) in enumerate(blocks):
        around = [(kernel[d + 2], ratio[blocks[i + d][0]]) for d in range(-2, 3) if 0 <= i + d < len(blocks)]
        near[path] += sum(w * r for w, r in around) / sum(w for w, _ in around)
    return {p: math.sqrt(ratio[p] * near[p] / n[p]) for p in n}


def main_text(html: str | None) -> str:
    """Main text of one page: its blocks in page order, one a line."""
    page = Page()
    page.feed(html or "")
    blocks, parent, tag, marked = page.blocks, page.parent, page.tag, page.marked
    if not blocks:
        return ""
    nodes = range(1, len(parent))  # parents come before their children
    left = [1.0] * len(parent)  # what cues leave of a ratio
    for p in nodes:
        left[p] = max(left[parent[p]] * (1.0, CUED_MILDLY, CUED, CUED)[marked[p]], CUED**9)
    ratio = {p: r * left[p] for p, r in ratios(blocks).items()}
    mass = sum(len(t) for _, t, _ in blocks)
    least = LEAST_RATIO * sum(ratio[p] * len(t) for p, t, _ in blocks) / mass
    content = {p for p, r in ratio.items() if r >= least}

    below = [0] * len(parent)  # content text under each path
    own = [0] * len(parent)
    for p, t, _ in blocks:
        if p in content:
            own[p] += len(t)
    for p in reversed(nodes):
        below[parent[p]] += below[p] + own[p]
    article, depth, named = 0, [0] * len(parent), [0] * len(parent)  # named: the outermost article or main element
    for p in nodes:
        depth[p] = depth[parent[p]] + 1
        named[p] = named[parent[p]] or (p if tag[p] in ARTICLE else 0)
        if below[p] >= ARTICLE_SHARE * below[0] and depth[p] > depth[article]:
            article = p
    around = article
    while around and tag[around] in PARTS:
        around = parent[around]
    whole = {named[p] for p in content} - {0}
    if article and tag[article] not in ("html", "body"):
        whole.add(article)
    inside, beside, off, titled = ([False] * len(parent) for _ in range(4))
    beside[0], titled[0] = around == 0 != article, True
    holder = [0] * len(parent)  # the element that a block is a part of
    for p in nodes:
        inside[p] = p in whole or inside[parent[p]]
        beside[p] = beside[parent[p]] or around == p != article
        empty = not below[p] + own[p]
        off[p] = off[parent[p]] or marked[p] > SLIGHT and empty
        titled[p] = not off[p] or (titled[parent[p]] and (marked[p] <= TITLE or not empty))  # nothing but headers marks it
        holder[p] = holder[parent[p]] if tag[parent[p]] in PARTS else parent[p]

    def keep(path: int, text: str, linked: int) -> bool:
        if path in content:
            return inside[path] or not whole or 2 * linked < len(text)
        if off[path] and tag[path] == "h1" and titled[path] and not title:
            return True
        beside_content = below[holder[path]] or tag[path] == "h1" and below[parent[holder[path]]]  # a title may have an element of its own
        if off[path] or not named[path] and not beside_content:  # of a part that a cue names, or an element without content
            return False
        if inside[path] or tag[path] in HEADINGS:
            return True
        return beside[path] and (not whole or 2 * linked < len(text))

    title = True
    kept = [keep(*b) for b in blocks]
    title = any(k and tag[p] == "h1" for k, (p, _, _) in zip(kept, blocks, strict=True))
    if not title:  # some header's title is that of an article without its own
        kept = [keep(*b) for b in blocks]
    return "\n".join(t for k, (_, t, _) in zip(kept, blocks, strict=True) if k)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of ``html``: the main text, empty if there is none.

    Null and empty pages give an empty text. Pages are read whole and once, broken mark-up as far
    as browsers' rules for paragraphs, list items and cells go; a comment, tag or script that is open at the end of the page gives no text. A
    column named text is replaced.
    """
    pages = pages.drop(*({"text"} - {html}))
    at = pages.columns.index(html)
    names = [*(c for c in pages.columns if c != html), "text"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(it):
            text = pa.array([main_text(h) for h in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *b.columns[at + 1 :], text], names=names)

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.schema.fields if f.name != html)
    return pages.mapInArrow(batches, schema + "text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))
