"""Main text of web pages by tag-path ratios.

A page becomes a row of text blocks, each with the path of its block-level tags from
the root; menus, adverts, footers and comments are blocks like any other. Blocks on one
path are pooled: letters and punctuation marks for each block of the path are its two
ratios, both saturating, so that no single block outweighs the page. Their product,
less the share of links, is smoothed along the page and fused with its smoothed form.
Tags and the words of class, id and role only weigh it (`prior`), they decide nothing
alone. A path is content if its mean reaches a share of the level that the page's
average letter has. Short blocks in the content's own container, such as headings and
list items, come with it: all of them if the container holds nothing else, those
between the first and last content block, and headings just before, if it is the body.

Null html, and html without content, give an empty text. Unclosed tags, missing end
tags and pages cut short are read as browsers do, as far as paths need it: tags nested
deeper than `DEPTH` are siblings, which keeps work and memory in proportion to the page,
however long it is. Nothing is dropped from a content block. Paths that tie are all
taken or all left. Repeated rows are read alike. An empty table gives no rows. Columns
other than the three named are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of HTML: tags whose inside isn't markup, tags without an inside, tags that run within a line of text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: Fixed values of HTML: what an opening tag closes, up to the nearest of the tags that bound it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUND = {"ul", "ol", "dl", "table", "select", "body"}
#: Tags and words of class, id or role that mark what surrounds the main text.
APART = {"nav", "footer", "aside", "form", "button", "select", "template", "svg", "math", "canvas", "object", "audio", "video", "dialog", "menu", "head", *RAW}
APART_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "widget", "comment", "comments", "reply", "replies", "respond", "disqus", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "pagination", "pager", "toolbar", "masthead", "copyright", "legal", "disclaimer", "search",
    "contentinfo", "complementary", "hidden", "skip", "tags",
}
CONTENT = {"article", "main"}
CONTENT_WORDS = {"article", "articlebody", "main", "content", "post", "entry", "story"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Tags nested deeper become siblings, as browsers do.
DEPTH = 512
#: Letters and marks at which a ratio is half of its most.
LETTERS, MARKS = 200.0, 4.0
#: Weights of blocks apart, and of those outside an article where the page has one.
APART_WEIGHT, OUTSIDE_WEIGHT = 0.02, 0.4
#: Share of the page's level from which a path is content.
SHARE = 0.7

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*(?:>|$)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")


@dataclass
class Block:
    path: int  # number of the path of tags
    home: int  # number of the innermost open tag; 0 for the root
    tag: str
    apart: bool
    favoured: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass
class Page:
    blocks: list[Block]
    parents: list[int]  # of the tags by number; a parent's number is smaller
    bodies: set[int]  # root, html and body


def _words(tag: str) -> tuple[set[str], bool]:
    """Words of class, id and role of a tag, and whether it is hidden."""
    found: set[str] = set()
    hidden = False
    for name, *values in _MARK.findall(tag):
        value, name = "".join(values), name.lower()
        if name in ("class", "id", "role", "itemprop"):
            found.update(x for x in _SPLIT.split(_CAMEL.sub("-", value).lower()) if x)
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden" or value.lower() == "true":
            hidden = True
    return found, hidden


def parse(html: str) -> Page:
    """The page's blocks of text in order, with character references decoded."""
    out: list[Block] = []
    open_: list[tuple[str, int, int, bool, bool]] = []  # name, number, path, apart, favoured
    count: dict[str, int] = defaultdict(int)  # of open tags by name
    parents, bodies = [0], {0}
    paths: dict[tuple[int, str], int] = {}
    links = 0
    now: Block | None = None

    def add(raw: str) -> None:
        nonlocal now
        text = unescape(raw)
        if now is None:
            if not text.strip():
                return
            name, number, path, apart, favoured = open_[-1] if open_ else ("", 0, 0, False, False)
            now = Block(path, number, name, apart, favoured)
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len(text)

    def shut(to: int) -> None:
        for x in open_[to:]:
            count[x[0]] -= 1
        del open_[to:]

    def shut_nearest(names: set[str], bound: set[str]) -> bool:
        if any(count[x] for x in names):
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] in names:
                    shut(i)
                    return True
                if open_[i][0] in bound:
                    break
        return False

    at = 0
    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m.group()
        if tag[1] in "!?":
            if tag.startswith("<![CDATA["):
                add(tag[9:].removesuffix("]]>"))
            continue
        name = _NAME.match(tag)[1].lower()
        if tag[1] == "/":
            if name == "a":
                links = 0
            if name in INLINE:
                continue
            now = None
            if shut_nearest({name}, set()) and name not in ("p", "li"):
                links = 0
            continue
        if name == "a":
            links = 1
        if name in INLINE:
            continue
        if name in ("br", "wbr"):
            if now is not None and name == "br":
                now.parts.append(" ")
            continue
        if name == "img":
            continue
        now = None
        links = 0
        if name in RAW and not tag.endswith("/>"):
            end = re.compile(rf"</{re.escape(name)}\s*(?:>|$)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in VOID or name in ("html", "body") and count[name]:
            continue
        if name in CLOSES:
            shut_nearest(CLOSES[name], BOUND)
        while open_ and open_[-1][0] == "p":
            shut(len(open_) - 1)
        if name == "body" and open_ and open_[-1][0] == "head":
            shut(len(open_) - 1)
        words, hidden = _words(tag) if len(tag) > len(name) + 2 else (set(), False)
        if len(open_) >= DEPTH:
            shut(DEPTH - 1)
        _, parent, path, outer, inside = open_[-1] if open_ else ("", 0, 0, False, False)
        apart = hidden or name in APART or bool(words & APART_WORDS) and name not in ("html", "body", *CONTENT) or name == "header" and not any(count[x] for x in CONTENT)
        favoured = name in CONTENT or bool(words & CONTENT_WORDS) and not apart
        parents.append(parent)
        number = len(parents) - 1
        if name in ("html", "body"):
            bodies.add(number)
        open_.append((name, number, paths.setdefault((path, name), len(paths) + 1), outer or apart, inside or favoured))
        count[name] += 1
        if tag.endswith("/>") and name in ("svg", "math"):
            shut(len(open_) - 1)
    if at < len(html):
        add(html[at:])
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    return Page([b for b in out if b.text], parents, bodies)


def smoothed(x: list[float]) -> list[float]:
    """Each value with its neighbours at a distance of 1 and 2, weighted by a bell curve."""
    bell = {-2: 0.1353, -1: 0.6065, 0: 1.0, 1: 0.6065, 2: 0.1353}
    out = []
    for i in range(len(x)):
        near = [(w, x[i + d]) for d, w in bell.items() if 0 <= i + d < len(x)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_ratios(found: list[Block]) -> dict[int, float]:
    """Of each path: letters for each block times marks for each block, both saturating, times the share that isn't links."""
    size, marks, linked, n = (defaultdict(float) for _ in range(4))
    for b in found:
        size[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        linked[b.path] += min(b.linked, len(b.text))
        n[b.path] += 1
    half = lambda x, at: x / (x + at)
    return {p: half(size[p] / n[p], LETTERS) * half((marks[p] + 0.5) / n[p], MARKS) * (1 - linked[p] / size[p]) for p in n}


def prior(found: list[Block]) -> list[float]:
    """Weights of the blocks by tags, class, id and role."""
    articles = any(b.favoured and not b.apart for b in found)
    return [(APART_WEIGHT if b.apart else 1.0) * (OUTSIDE_WEIGHT if articles and not b.favoured else 1.0) for b in found]


def content_home(page: Page, chosen: list[Block]) -> tuple[int, list[bool]]:
    """The innermost tag that holds the larger part of the chosen text in two blocks or more, and whether each tag lies in it."""
    held, blocks_in = [0] * len(page.parents), [0] * len(page.parents)
    for b in chosen:
        held[b.home] += len(b.text)
        blocks_in[b.home] += 1
    for i in range(len(page.parents) - 1, 0, -1):
        held[page.parents[i]] += held[i]
        blocks_in[page.parents[i]] += blocks_in[i]
    several = min(2, len(chosen))
    home = max(i for i in range(len(held)) if 2 * held[i] > held[0] and blocks_in[i] >= several)  # those form a chain from the root
    if len(chosen) == 1:
        home = page.parents[home]
    inside = [False] * len(page.parents)
    for i in range(len(page.parents)):
        inside[i] = i == home or i > 0 and inside[page.parents[i]]
    return home, inside


def main_text(html: str | None, share: float = SHARE) -> str:
    """The main text of a page. share: of the page's level, from which a path is content."""
    if not html:
        return ""
    page = parse(html)
    found = page.blocks
    if not found:
        return ""
    ratios, weights = path_ratios(found), prior(found)
    raw = [ratios[b.path] for b in found]
    fused = [w * (r * s) ** 0.5 for w, r, s in zip(weights, raw, smoothed(raw), strict=True)]
    letters = sum(w * len(b.text) for b, w in zip(found, weights, strict=True))
    limit = share * sum(x * w * len(b.text) for x, b, w in zip(fused, found, weights, strict=True)) / letters
    by, n = defaultdict(float), defaultdict(int)
    for b, x, w in zip(found, fused, weights, strict=True):
        by[b.path, w] += x
        n[b.path, w] += 1
    content = {k for k, x in by.items() if x > 0 and x / n[k] >= limit}
    taken = [(b.path, w) in content for b, w in zip(found, weights, strict=True)]
    chosen = [b for b, t in zip(found, taken, strict=True) if t]
    if not chosen:
        return ""
    home, inside = content_home(page, chosen)
    least = max(w for w, t in zip(weights, taken, strict=True) if t) / 2
    first, last = taken.index(True), len(taken) - 1 - taken[::-1].index(True)
    while first and found[first - 1].tag in HEADINGS and inside[found[first - 1].home] and weights[first - 1] >= least:
        first -= 1
    open_home = home in page.bodies
    return " ".join(
        b.text
        for i, (b, t, w) in enumerate(zip(found, taken, weights, strict=True))
        if t or inside[b.home] and w >= least and 2 * b.linked <= len(b.text) and (not open_home or first <= i <= last)
    )


def extract_pages(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    src = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    schema = T.StructType([src.schema["page_id"], src.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), share) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(each, schema)
