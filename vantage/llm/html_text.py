"""Main text of HTML pages by tag-path ratios.

A page becomes a sequence of blocks, each with its root-to-leaf tag path (tags with their classes).  Text length, punctuation and link
share are aggregated for each path, spread over neighbouring blocks, fused into one score, and paths above ``CONTENT_SHARE`` of the
best score are content.  The article is the element that holds the content nodes: the innermost ``article`` or ``main`` around the
best path, else their lowest common ancestor (where that is the whole body: those of its parts that hold content nodes, what lies
between them, and headings right before).  Within it, paths that score below the threshold are dropped if ``LINK_SHARE`` of
their text or more is links (menus, lists of links; headings stay); all other blocks belong to the text, short ones and single links too.

Boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) is told by tag and role, and by
class and id names: a name counts if all its parts are of the lists below or if it ends with a listed word, but not names like
``no-sidebar`` or ``post-with-comments``.  A named element, or a form, that holds more than ``WHOLE_SHARE`` of the page's text is a wrapper.

Pages are read in one pass without looking back: elements point at their parents, so deep nesting and unclosed tags or quotes
cost no more than other pages.  Character references are decoded, white space within a block becomes one space, blocks are joined
by two line feeds.  Tags may be unclosed, misplaced or cut off; inline tags do not part blocks, a line break counts as white space.

Defined results: a null or empty page, and one without content, gives an empty text; script, style and comments never count;
nothing is cut, however long; of equally good paths the one with more text is best; repeated rows give equal rows; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")}
_BOILERPLATE = frozenset("aside button canvas datalist dialog footer head header iframe menu nav noscript object optgroup option script select style svg template textarea title".split())
_WORDS = frozenset(
    "ad ads adsense advert advertisement advertisements advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommendations "
    "recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: parts that may stand beside those words in a name
_NEUTRAL = frozenset(
    "area bar block bottom box button buttons col column container content fixed form global group inner item items left link links list main outer panel post posts primary region right row secondary "
    "section site slot space sticky stories text thread title top unit wrap wrapper".split()
)
#: a name with one of these tells of something else than its element
_ABOUT = frozenset("above after and before below has have hide in is no non not off on show under with without".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_KEPT = frozenset(("html", "body", "main", "article"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: an open element of these ends with the next of its kind
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_TRACKED = frozenset().union(*_ENDS.values())
_SCOPES = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "td", "th", "blockquote", "main", "body"))
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split()
)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
CONTENT_SHARE, LINK_SHARE, WHOLE_SHARE = 0.25, 0.6, 0.9


class Element:
    """An open or closed element: its parent, path number, depth, and what boilerplate tests say."""

    __slots__ = ("tag", "parent", "path", "depth", "hard", "named", "article", "inside", "weight", "nearest")

    def __init__(self, tag: str, parent: Element | None, path: int, hard: bool, named: bool):
        self.tag, self.parent, self.path, self.named, self.weight = tag, parent, path, named, 0
        self.depth = parent.depth + 1 if parent else 0
        self.hard = hard or bool(parent and parent.hard)
        self.article = self if tag in ("article", "main") else parent.article if parent else None
        self.inside = False
        #: the nearest open elements of the kinds that others end, within their scope
        self.nearest: dict[str, Element] = {} if not parent or tag in _SCOPES else parent.nearest
        if tag in _TRACKED:
            self.nearest = {**self.nearest, tag: self}


class Block:
    __slots__ = ("element", "text", "links")

    def __init__(self, element: Element, text: str, links: int):
        self.element, self.text, self.links = element, text, links


def _boilerplate_name(name: str) -> bool:
    parts = [p for p in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())]
    if not parts or _ABOUT.intersection(parts):
        return False
    listed = [p for p in parts if p in _WORDS]
    if listed and all(p in _WORDS or p in _NEUTRAL for p in parts):
        return True
    return parts[-1] in _WORDS and parts[-1] not in ("header", "footer", "title")


def _attributes(tag: str, text: str, in_article: bool) -> tuple[bool, bool, str, bool]:
    """(boilerplate for certain, boilerplate by name, class for the path, whether a link)"""
    hard, named, kind, link = False, False, "", False
    for name, *values in _ATTRIBUTE.findall(text):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style", "href"):
            continue
        value = next((v for v in values if v), "")
        if name == "href":
            link = True
        elif name == "class":
            kind = ".".join(value.split())
        if tag in _KEPT:
            continue
        if name in ("class", "id"):
            named |= any(_boilerplate_name(v) and not (in_article and v.lower() == "header") for v in value.split())
        elif name == "role":
            hard |= value.lower() in _ROLES
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            hard = True
    return hard, named, kind, link


class _Reader:
    """One pass over a page."""

    def __init__(self, page: str):
        self.page = page
        self.elements = [Element("", None, 0, False, False)]
        self.here = self.elements[0]
        self.open: dict[str, int] = {}
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.link: Element | None = None  # the element in which a link is open
        self.quotes = {'"': True, "'": True}

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.here, text, len(" ".join("".join(self.linked).split()))))
            self.parts.clear()
            self.linked.clear()

    def add(self, text: str):
        text = html.unescape(text) if "&" in text else text
        self.parts.append(text)
        if self.link:
            self.linked.append(text)

    def push(self, tag: str, kind: str, hard: bool, named: bool):
        step = (self.here.path, f"{tag}.{kind}" if kind else tag)
        self.here = Element(tag, self.here, self.paths.setdefault(step, len(self.paths) + 1), hard, named)
        self.elements.append(self.here)
        self.open[tag] = self.open.get(tag, 0) + 1

    def close(self, element: Element):
        """Ends ``element`` and all that is open inside."""
        while True:
            ended, self.here = self.here, self.here.parent
            self.open[ended.tag] -= 1
            if self.link is ended:
                self.link = None
            if ended is element:
                return

    def tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, quoted ones passed over; -1: there is none."""
        begin = at
        while m := _TAG_STOP.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if self.quotes[m[0]] and self.page[max(begin, m.start() - 16) : m.start()].rstrip().endswith("="):
                close = self.page.find(m[0], at)
                self.quotes[m[0]] = close >= 0
                at = close + 1 if close >= 0 else at
        if any(self.quotes.values()):  # a quote that swallows the rest of the page is none
            self.quotes = dict.fromkeys(self.quotes, False)
            return self.page.find(">", begin)
        return -1

    def read(self) -> _Reader:
        page, at = self.page, 0
        while at < len(page):
            begin = page.find("<", at)
            if begin < 0:
                self.add(page[at:])
                break
            if begin > at:
                self.add(page[at:begin])
            mark = page[begin + 1 : begin + 2]
            if mark in ("!", "?"):
                comment, data = page.startswith("<!--", begin), page.startswith("<![CDATA[", begin)
                end = page.find("-->" if comment else "]]>" if data else ">", begin + (4 if comment else 2))
                if end < 0:
                    break
                at = end + (3 if comment or data else 1)
                continue
            closing = mark == "/"
            name = _NAME.match(page, begin + 1 + closing)
            if not name:
                if mark == "":
                    break
                if not closing:
                    self.add("<")
                at = begin + 1 + closing
                continue
            end = self.tag_end(name.end())
            if end < 0:
                break
            tag, at = name[0].lower(), end + 1
            if closing:
                self.end(tag)
            else:
                at = self.start(tag, page[name.end() : end], at)
        self.flush()
        return self

    def end(self, tag: str):
        if tag == "a":
            self.link = None
        if self.open.get(tag):
            self.flush()
            element = self.here
            while element.tag != tag:  # each one passed is closed, so this is paid for once
                element = element.parent
            self.close(element)
        elif tag not in _INLINE:
            self.flush()

    def start(self, tag: str, attributes: str, at: int) -> int:
        if tag == "br":
            self.add("\n")
            return at
        hard = tag in _BOILERPLATE and not (tag == "header" and self.here.article)
        named, kind, link = tag == "form", "", False
        if attributes and not attributes.isspace():
            certain, by_name, kind, link = _attributes(tag, attributes, self.here.article is not None)
            hard, named = hard or certain, named or by_name
        if tag in _INLINE and not hard and not named:
            if tag == "a" and link:
                self.link = self.here
            return at
        if tag in _VOID:
            if tag == "hr":
                self.flush()
            return at
        self.flush()
        if tag in _CLOSES_P and "p" in self.here.nearest:
            self.close(self.here.nearest["p"])
        for kind_ended in _ENDS.get(tag, ()):
            while kind_ended in self.here.nearest and (tag != "body" or self.open.get(kind_ended)):
                self.close(self.here.nearest[kind_ended])
        if tag in _RAW:
            end = _RAW[tag].search(self.page, at)
            return end.end() if end else len(self.page)
        self.push(tag, kind, hard, named)
        return at


def path_scores(found: list[Block]) -> dict[int, float]:
    """Fused score of each tag path: smoothed text and punctuation per block, lessened by links."""
    total: dict[int, list[float]] = {}
    for b in found:
        t = total.setdefault(b.element.path, [0, 0, 0, 0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(_PUNCTUATION.findall(b.text))
        t[3] += b.links
    ratio = {p: math.log1p(t[1] / t[0]) * (1 + math.log1p(t[2] / t[0])) * max(0.0, 1 - t[3] / t[1]) for p, t in total.items()}
    own = [ratio[b.element.path] for b in found]
    fused: dict[int, list[float]] = {}
    for i, b in enumerate(found):
        near = [(w, own[j]) for w, j in ((0.25, i - 1), (0.5, i), (0.25, i + 1)) if 0 <= j < len(own)]
        smooth = sum(w * x for w, x in near) / sum(w for w, _ in near)
        fused.setdefault(b.element.path, []).append(math.sqrt(own[i] * smooth))
    return {p: sum(v) / len(v) for p, v in fused.items()}


def _without_boilerplate(reader: _Reader) -> list[Block]:
    """The blocks outside boilerplate; a named element that holds nearly all other text is a wrapper."""
    for b in reader.blocks:
        if not b.element.hard:
            b.element.weight += len(b.text) - b.links
    for e in reversed(reader.elements[1:]):
        e.parent.weight += e.weight
    whole = reader.elements[0].weight
    for e in reader.elements[1:]:
        e.named = e.parent.named or e.named and e.weight <= WHOLE_SHARE * whole
    return [b for b in reader.blocks if not b.element.hard and not b.element.named]


def _common(a: Element, b: Element) -> Element:
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def main_text(page: str | None) -> str:
    if not page:
        return ""
    reader = _Reader(page).read()
    found = _without_boilerplate(reader)
    if not found:
        return ""
    scores = path_scores(found)
    size, links = dict.fromkeys(scores, 0), dict.fromkeys(scores, 0)
    for b in found:
        size[b.element.path] += len(b.text)
        links[b.element.path] += b.links
    best = max(scores, key=lambda p: (scores[p] * math.log1p(size[p] - links[p]), size[p] - links[p], -p))
    if scores[best] <= 0:
        return ""
    content = {p for p in scores if scores[p] >= CONTENT_SHARE * scores[best]}
    root = max((b for b in found if b.element.path == best), key=lambda b: len(b.text)).element.article
    held = [i for i, b in enumerate(found) if b.element.path in content]
    if root is None:  # elements are numbered in page order, so the first and the last of a set have its common ancestor
        above = [found[i].element.parent or found[i].element for i in (held[0], held[-1])]
        root = _common(*above)
    whole_body = root.tag in ("", "html", "body")
    root.inside = True
    for e in reader.elements[1:]:
        e.inside = e.inside or e.parent.inside
    inside = [i for i, b in enumerate(found) if b.element.inside]
    if whole_body:
        top: dict[Element, Element] = {}
        for e in reader.elements[1:]:
            top[e] = e if e.parent is root else top.get(e.parent, e)
        parts = {top.get(found[i].element, root) for i in held} - {root}
        start = held[0]
        while start > 0 and found[start - 1].element.tag in _HEADINGS:
            start -= 1
        inside = [i for i in inside if start <= i <= held[-1] or top.get(found[i].element) in parts]
    kept = [b for b in (found[i] for i in inside) if b.element.path in content or b.element.tag in _HEADINGS or links[b.element.path] < LINK_SHARE * size[b.element.path]]
    return "\n\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    fields = [pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return pages.select("page_id", "url", "html").mapInArrow(run, T.StructType(fields))
