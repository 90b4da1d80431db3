"""HTML main text: block rules on stop words, length and links, then ambiguous blocks inherit from decided neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, without

#: Elements that start or end a block, that hold no article text, that have no content, that others close.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside button canvas datalist dialog footer form head header iframe math menu nav noscript object search select svg template textarea title".split())
RAW = frozenset("script style noscript textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED = frozenset("p li dt dd option td th tr".split())
#: Words of class, id and role that name what stands around an article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice alert popup modal overlay sidebar sidenav menu navbar nav navigation "
    "breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager skip "
    "contentinfo complementary search dialog".split()
)
#: Frequent words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were their there been has will would about if who what can all one we our she her "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis "
    "le la les de des et un une du en que qui dans il est pour pas sur au plus par avec ce ne se sont mais ou sa son elle nous vous ils leur aux cette ces être était ont comme tout "
    "el los las y del se que por un una con no para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos".split()
)
#: Link share from which a block is a menu, characters from which a block is long, shares of stop words that decide.
LINKS, SHORT, LONG, FEW, SOME = 0.5, 70, 200, 0.1, 0.25
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")


#: Words before a word of AROUND that make it say what a page has, or name a part of the article.
HAS = frozenset("has have no not with without hide show".split())
OWN = frozenset("article body chapter content entry main post section story title".split())
HIDDEN, WHOLE, PART = 3, 2, 1


class _Article:
    """An open article or main element, the one around it, and the outermost one."""

    __slots__ = ("parent", "top")

    def __init__(self, parent: _Article | None):
        self.parent, self.top = parent, parent.top if parent else self


class _Block:
    __slots__ = ("article", "inline", "linked", "parts", "tag")

    def __init__(self, article: _Article | None, tag: str, inline: bool = False):
        self.parts, self.linked, self.article, self.tag, self.inline = [], 0, article, tag, inline


class _Named:
    """An element whose class, id or role has a word of AROUND: the blocks first to last - 1 are in it.

    opens is the number of its name's tags that are open once it is: it ends when there is one less.
    """

    __slots__ = ("first", "last", "main", "opens", "since", "whole")

    def __init__(self, whole: bool, first: int, opens: int, since: int):
        self.whole, self.first, self.last, self.main, self.opens, self.since = whole, first, first, False, opens, since


class _Open:
    """The named elements that are open, by name. Only the last of a name can end at a tag, so that a tag costs the same
    however deep it lies."""

    def __init__(self, out: list[_Block]):
        self.out, self.every = out, []
        self.by_name: dict[str, list[_Named]] = {}
        self.tags: dict[str, int] = {}
        self.mains = 0

    def end(self, name: str) -> None:
        e = self.by_name[name].pop()
        e.last, e.main = len(self.out), self.mains > e.since

    def started(self, name: str) -> None:
        for x in {name if name in CLOSED else "", "p" if name in BLOCKS else ""}:
            if self.by_name.get(x) and self.by_name[x][-1].opens == self.tags[x]:
                self.end(x)
        self.tags[name] = self.tags.get(name, 0) + 1
        self.mains += name == "main"

    def closed(self, name: str) -> bool:
        """Whether a named element ends here."""
        self.tags[name] = self.tags.get(name, 0) - 1
        ends = bool(self.by_name.get(name)) and self.by_name[name][-1].opens > self.tags[name]
        if ends:
            self.end(name)
        return ends

    def add(self, name: str, whole: bool) -> None:
        e = _Named(whole, len(self.out), self.tags[name], self.mains)
        self.every.append(e)
        self.by_name.setdefault(name, []).append(e)

    def end_all(self, name: str | None = None) -> None:
        for x in list(self.by_name) if name is None else [name]:
            while self.by_name.get(x):
                self.end(x)


def _around(name: str, attrs: str, inside: bool) -> int:
    """HIDDEN, or whether a word that names what stands around an article is a WHOLE name or only PART of one, else 0."""
    if not attrs.strip():
        return 0
    found = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), next((x for x in m.groups()[1:] if x is not None), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return HIDDEN
        if key in ("class", "id", "role") and name not in ("html", "body", "main"):
            for token in value.split():
                words = [w.lower() for w in _SPLIT.split(token) if w]
                hits = [i for i, w in enumerate(words) if w in AROUND and not (i and words[i - 1] in HAS) and not (w == "header" and (inside or i and words[i - 1] in OWN))]
                if hits and len(hits) == len(words):
                    found = WHOLE
                elif hits and name != "article":
                    found = max(found, PART)
    return found


def _parsed(page: str) -> tuple[list[_Block], list[_Named]]:
    out: list[_Block] = [_Block(None, "")]
    article: _Article | None = None
    named = _Open(out)
    skip, depth, links, at = "", 0, 0, 0

    def text(piece: str) -> None:
        if piece and not skip:
            got = html.unescape(piece)
            out[-1].parts.append(got)
            if links:
                out[-1].linked += len("".join(got.split()))

    def start(tag: str, inline: bool = False) -> None:
        out.append(_Block(article, tag, inline))

    pos = page.find("<")
    text(page[:pos] if pos >= 0 else page)
    while pos >= 0:
        m = _TOKEN.match(page, pos)
        if not m:  # a bare <
            nxt = page.find("<", pos + 1)
            text(page[pos : nxt if nxt >= 0 else len(page)])
            pos = nxt
            continue
        at = m.end()
        if m[0].startswith("<![CDATA["):
            text(m[0][9:].removesuffix("]]>"))
        elif m[2]:
            name, closing = m[2].lower(), bool(m[1])
            if skip in CLOSED and skip and depth == 1 and not closing and (name == skip or name in BLOCKS and skip == "p"):
                skip, depth = "", 0
            if skip:
                if name == skip and name not in VOID:
                    depth += -1 if closing else 1
                    if depth == 0:
                        skip = ""
                        start(name)
            elif closing:
                if name in ("article", "main") and article:
                    article = article.parent
                if name == "a":
                    links = max(0, links - 1)
                if name in BLOCKS:
                    links = 0
                if named.closed(name) or name in BLOCKS:
                    start(name if name in BLOCKS else out[-1].tag, name not in BLOCKS)
            else:
                named.started(name)
                around = _around(name, m[3], article is not None) if name not in VOID else 0
                if around in (WHOLE, PART):
                    named.add(name, around == WHOLE)
                if name in BLOCKS:
                    links = 0
                    start(name)
                elif around in (WHOLE, PART):
                    start(out[-1].tag, True)
                if name in ("article", "main"):
                    article = _Article(article)
                    start(name)
                elif name not in VOID and name not in ("html", "body") and (name in DROPPED and not (name == "header" and article) or around == HIDDEN):
                    skip, depth = name, 1
                    if around in (WHOLE, PART):
                        named.end(name)
                if name == "a" and not skip:
                    links = 1
                if name == "br":
                    text(" ")
            if not closing and name in ("script", "style", *RAW):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                if skip == name:
                    skip, depth = "", 0
                named.end_all(name)
                at = end.end() if end else len(page)
        nxt = page.find("<", at)
        text(page[at : nxt if nxt >= 0 else len(page)])
        pos = nxt
    named.end_all()
    return out, named.every


def _flat(b: _Block) -> tuple[str, float]:
    t = " ".join("".join(b.parts).split())
    return t, min(1.0, b.linked / len(t.replace(" ", ""))) if t else 0.0


def _apart(found: list[_Block], named: list[_Named]) -> list[int]:
    """In how many named elements that stand around the article each block is.

    A name is no evidence where the element is the page's layout: where it holds a main element or, by the characters of
    well-formed blocks (of all blocks, if none is), more than half of the page; a name that says nothing else must hold
    the whole page, and no article or main element may hold text outside. Elements hold runs of blocks, so that sums up to
    each block tell all of this at once.
    """
    flat = [(i, b, *_flat(b)) for i, b in enumerate(found) if b.parts]
    flat = [(i, b, t, linked) for i, b, t, linked in flat if t]
    size = [len(t) if decide(t, linked) else 0 for *_, t, linked in flat]
    if not any(size):
        size = [len(t) for _, _, t, _ in flat]
    chars, texts, articles = ([0] * (len(found) + 1) for _ in range(3))
    for (i, b, *_), n in zip(flat, size, strict=True):
        chars[i + 1], texts[i + 1], articles[i + 1] = n, 1, int(b.article is not None)
    chars, texts, articles = (list(accumulate(x)) for x in (chars, texts, articles))
    total, edge = chars[-1], [0] * (len(found) + 1)
    for e in named:
        n = chars[e.last] - chars[e.first]
        if texts[e.last] == texts[e.first]:
            continue
        layout = e.main or (n == total and articles[e.last] - articles[e.first] == articles[-1] if e.whole else 2 * n > total)
        if not layout:
            edge[e.first] += 1
            edge[e.last] -= 1
    return list(accumulate(edge))


def blocks(page: str) -> list[tuple[str, float, _Article | None, str]]:
    """(text, share of linked characters, innermost article or main element around it, tag) of each block with text, in page
    order, without what stands in elements named as around the article."""
    found, named = _parsed(page)
    apart = _apart(found, named)
    out: list[_Block] = []
    for b, inside in zip(found, apart, strict=False):
        if inside:
            continue
        if b.inline and out:  # a name inside a line doesn't end it
            out[-1].parts += b.parts
            out[-1].linked += b.linked
        else:
            out.append(b)
    return [(t, linked, b.article, b.tag) for b in out for t, linked in [_flat(b)] if t]


def decide(text: str, linked: float) -> bool | None:
    """First pass: whether a block is article text, or None where its length and stop words don't tell."""
    words = _WORD.findall(text.lower())
    share = sum(w in STOP for w in words) / len(words) if words else 0.0
    if linked >= LINKS or "©" in text and len(text) < LONG:
        return False
    if len(text) >= SHORT and share >= SOME or len(text) >= LONG and share >= FEW:
        return True
    if len(text) >= LONG and words and share == 0 and linked > 0.2:
        return False
    return None


def _decided(marks: list[bool | None]) -> tuple[list[int | None], list[int | None]]:
    """The nearest decided place up to each place, and from it on."""
    n = len(marks)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if marks[i] is not None else last
        before[i] = last
    last = None
    for i in reversed(range(n)):
        last = i if marks[i] is not None else last
        after[i] = last
    return before, after


def inherit(marks: list[bool | None], headings: list[bool]) -> list[bool]:
    """Second pass: an undecided block takes the mark of its nearest decided neighbour; of two equally near ones the worse,
    a heading that of the next. Without any decided block all are kept."""
    before, after = _decided(marks)
    out = []
    for i, mark in enumerate(marks):
        b, a = before[i], after[i]
        if mark is None:
            if b is None and a is None:
                mark = True
            elif b is None or a is None:
                mark = marks[a if b is None else b]
            elif headings[i] or a - i < i - b:
                mark = marks[a]
            elif i - b < a - i:
                mark = marks[b]
            else:
                mark = marks[a] and marks[b]
        out.append(mark)
    return out


def main_text(page: str | None) -> str:
    """The article of one page, its blocks joined by newlines; empty if there is none.

    Both passes decide on all blocks. An article or main element is one more signal for the blocks that the first pass
    leaves open: inside one that holds well-formed text, or any where the page has none, they are article text; inside
    others they are not, though a part of one that holds some inherits; outside they are not where one holds any, unless they stand between well-formed blocks outside or are the heading of one. A lone block inside
    is not dropped for its links.
    """
    found = blocks(page or "")
    heads = [len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() for *_, tag in found]
    lone = sum(inside is not None for _, _, inside, _ in found) == 1
    first = [None if lone and inside and linked >= LINKS else decide(t, linked) for t, linked, inside, _ in found]
    holding = _with_outer(inside for (_, _, inside, _), mark in zip(found, first, strict=True) if mark)
    if not holding and not any(first):
        holding = _with_outer(inside for _, _, inside, _ in found)
    # an element that holds text is held by all around it, so that the outermost one tells for all
    marks = [(True if inside in holding else None if inside.top in holding else False) if mark is None and inside else mark for (_, _, inside, _), mark in zip(found, first, strict=True)]
    if holding:
        outside = [not inside for _, _, inside, _ in found]
        near = list(zip(*_decided(first), strict=True))
        # an open block outside belongs to well-formed text there if the nearest decided blocks do
        well = lambda j: j is not None and bool(first[j]) and outside[j]
        marks = [mark if mark is not None or found[i][2] else well(near[i][1]) and (heads[i] or well(near[i][0])) for i, mark in enumerate(marks)]
    return "\n".join(t for (t, *_), keep in zip(found, inherit(marks, heads), strict=True) if keep)


def _with_outer(inside: Iterable[_Article | None]) -> set[_Article]:
    """Elements and all elements around them."""
    out: set[_Article] = set()
    for e in inside:
        while e and e not in out:
            out.add(e)
            e = e.parent
    return out


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with _lx_text, the main text of html_col, whole. A null page counts as empty and has an empty text.

    Rows are independent: no shuffle, no key; repeated rows, null ids and further columns are passed on, those named
    _lx_text or _lx_chars give way to these. Broken markup never fails: what isn't a tag is text, an open element ends
    with the page.
    """
    pages = without(pages, "_lx_text", "_lx_chars")

    def run(batches):
        for batch in batches:
            for part in small_batches(batch, html_col):
                texts = [main_text(h) for h in part.column(part.schema.get_field_index(html_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "_lx_text"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("_lx_text", T.StringType())])).withColumn("_lx_chars", F.length("_lx_text").cast("long"))
