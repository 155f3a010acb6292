"""Main text of web pages by tag-path ratios.

A page is read as a tree of elements, its text as blocks. Over each root-to-leaf
tag path the text length outside links and the punctuation of its blocks are added
up and divided by the number of blocks. Both ratios are smoothed along the page and
multiplied; what markup says of the elements around (navigation, headers, footers,
asides, forms; classes and ids all of whose words name something else than the text,
as in ``cookie-notice`` but not in ``has-sidebar`` or ``related-work``) is a factor,
not a verdict. The fused ratios are held against a threshold (a share of their
standard deviation), which selects the paths with content: all blocks on these are
text. Where an ``article`` or ``main`` element holds most of them, the ratios of
what is beside it are lowered and the paths are selected anew.

Headings, lists and short lines have low ratios wherever they stand. Around the
selected blocks (in the articles, or in the least element with four fifths of
their text that is more than a part of a text) the others are taken too, unless
markup or links speak against them.

Defined results: a null or empty page, and one without blocks, has an empty
text; unclosed elements end with the element around them, an unclosed comment or
script with the page; repeated rows are extracted alike. Columns that the
operator doesn't use may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements without text of their own to read.
_SILENT = frozenset("button select option datalist dialog object canvas audio video map frameset head".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}}
#: What an element's tag, role or name says of the text inside, as a factor of its paths' ratios.
_TAGS = {"nav": 0.02, "menu": 0.02, "footer": 0.02, "aside": 0.05, "header": 0.1, "form": 0.1}
_ROLES = {
    "navigation": 0.02, "menu": 0.02, "menubar": 0.02, "toolbar": 0.02, "search": 0.02, "contentinfo": 0.02, "complementary": 0.05, "banner": 0.1, "form": 0.1,
    "dialog": 0.02, "alertdialog": 0.02, "alert": 0.05,
}
#: What all of these together leave at least, and what an article leaves to the text beside it.
LEAST_FACTOR, BESIDE = 0.02, 0.1
_CLEAR, _CLEAR_PART, _MAYBE, _MAYBE_PART = 0.02, 0.05, 0.2, 0.6
#: Words of a class or id that say clearly, or perhaps, that the text is something else than the page's own.
_CLEAR_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " masthead footer cookie cookies consent gdpr newsletter subscribe subscription signup popup modal overlay share sharing comments comment disqus replies respond"
    " pagination pager toolbar login".split()
)
_MAYBE_WORDS = frozenset("banner header notice notices disclaimer social related recommended reply widget widgets copyright aside".split())
#: Words that say where or how, and leave it to the other words of a name what.
_PLACES = frozenset(
    "site main page top bottom left right primary secondary global container wrapper wrap box area bar block list item items section link links button buttons post posts inner outer"
    " article articles row col column panel small large sticky fixed form icon icons toggle content body unit slot div gpt x".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARTS = _HEADINGS | frozenset(
    "p ul ol li dl dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr section details summary address hgroup".split()
)
_ARTICLES = frozenset(("article", "main"))
_WHOLE = _ARTICLES | {"html", "body"}
_MARKS = re.compile(r"[.,;:!?…。、！？؛،]")


class _Element:
    __slots__ = ("article", "factor", "header", "link", "parent", "path", "silent", "tag", "titled")

    def __init__(self, tag: str, parent: _Element | None, path: int = 0, factor: float = 1.0, silent: bool = False, article: bool = False):
        self.tag, self.parent, self.path, self.factor = tag, parent, path, factor
        self.silent = silent or bool(parent and parent.silent)
        self.article = (parent.article if parent else None) or (self if article else None)
        self.header = parent.header if parent else None  # the nearest one around
        self.titled = False  # whether a heading stands inside; kept for headers
        self.link = tag == "a" or bool(parent and parent.link and tag in _INLINE)


class _Block:
    __slots__ = ("chars", "element", "linked", "text")

    def __init__(self, element: _Element, text: str, linked: int):
        self.element, self.text, self.linked, self.chars = element, text, linked, len(text)


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" \t\r\n\f/") else {}


def _silent(tag: str, attributes: dict[str, str]) -> bool:
    return tag in _SILENT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def _says(name: str) -> int:
    """2 if a class or id says clearly that its text is something else, 1 if it may, 0 if not: all of its words must do so."""
    words = {w for w in re.split(r"[^a-z]+", name.lower()) if w}
    if not words <= _CLEAR_WORDS | _MAYBE_WORDS | _PLACES:
        return 0
    return 2 if not words.isdisjoint(_CLEAR_WORDS) else 1 if not words.isdisjoint(_MAYBE_WORDS) else 0


def _factor(tag: str, attributes: dict[str, str]) -> float:
    """How much less a text inside the element is likely to be the page's own; a heading's id is made of its text."""
    if tag in _WHOLE:
        return 1.0
    names = [n for k in ("class", "id") if k in attributes and not (k == "id" and tag in _HEADINGS) for n in attributes[k].split()]
    said = max(map(_says, names), default=0)
    part = tag in _PARTS or tag in _INLINE
    by_name = (1.0, _MAYBE_PART if part else _MAYBE, _CLEAR_PART if part else _CLEAR)[said]
    return min(by_name, _TAGS.get(tag, 1.0), _ROLES.get(attributes.get("role", "").lower(), 1.0))


def blocks(html: str) -> list[_Block]:
    """The blocks of a page's text in page order, each with its element."""
    found: list[_Block] = []
    paths: dict[tuple[int, str, float], int] = {}
    here = _Element("", None)
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join("".join(parts).split())):
            block = here
            while block.parent and block.tag in _INLINE:
                block = block.parent
            found.append(_Block(block, text, linked))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not here.silent:
            text = unescape(raw) if "&" in raw else raw
            parts.append(text)
            if here.link:
                linked += len(text)

    def close(tags: set[str], scope: set[str]) -> bool:
        """Closes the nearest element with one of the tags, unless one of the scope is nearer."""
        nonlocal here
        e = here
        while e.parent and e.tag not in tags:
            if e.tag in scope:
                return False
            e = e.parent
        if not e.parent:
            return False
        here = e.parent
        return True

    while m := _MARKUP.search(html, at):
        say(html[at : m.start()])
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in _INLINE:
                e = here
                while e.tag in _INLINE and e.tag != tag:
                    e = e.parent
                if e.tag == tag:
                    here = e.parent
            elif tag == "br":
                parts.append(" ")
            else:
                flush()
                close({tag}, set())
            continue
        if tag in _RAW:
            ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if m["rest"].endswith("/") and tag in ("svg", "math"):
                continue
            at = ended.end() if ended else len(html)
            if tag not in ("script", "style", "noscript", "template", "svg", "math"):
                flush()
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            continue
        attributes = _attributes(m["rest"])
        if tag not in _INLINE:
            flush()
            close({"p"}, {"article", "main", "section", "div", "li", "td", "th", "blockquote", "body", "table", "dd", "dt"})
            if tag in _CLOSES:
                close(_CLOSES[tag], _SCOPE.get(tag, {"table", "ul", "ol", "dl", "select"}))
        factor = _factor(tag, attributes)
        path = here.path
        if tag not in _INLINE:
            # A path's labels are tags with their first class; what markup says of an element parts its paths from others.
            label = tag + ("." + attributes["class"].split()[0] if attributes.get("class", "").split() else "")
            path = paths.setdefault((path, label, factor), len(paths) + 1)
        if tag in _HEADINGS:
            h = here.header
            while h and not h.titled:
                h.titled = True
                h = h.parent.header
        # Within a line of text there are no paths to weigh: what is clearly named something else isn't read.
        silent = _silent(tag, attributes) or (tag in _INLINE and factor <= _CLEAR_PART)
        here = _Element(tag, here, path, factor, silent, tag in _ARTICLES or attributes.get("role", "").lower() == "main")
        if tag == "header" or factor == _MAYBE and "header" in attributes.get("class", ""):
            here.header = here
    say(html[at:])
    flush()
    return found


def weights(found: list[_Block], tops: frozenset[int] = frozenset()) -> list[float]:
    """What markup says of each block: the product of the factors of the elements around it, below the nearest of ``tops``."""
    known: dict[int, float] = {}
    out = []
    for b in found:
        line, e = [], b.element
        while e is not None and id(e) not in tops and id(e) not in known:
            line.append(e)
            e = e.parent
        w = 1.0 if id(e) in tops else known.get(id(e), 1.0)
        for e in reversed(line):
            # The header of an article or of a part of the page names what follows; that of the page names the site.
            named = e.header is e and e.titled and e.parent.tag not in ("", "html", "body")
            w = max(LEAST_FACTOR, w * (1.0 if named else e.factor))
            known[id(e)] = w
        out.append(w)
    return out


def _smooth(values: list[float], radius: int = 1) -> list[float]:
    kernel = [math.exp(-(k * k) / (2.0 * radius * radius)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(values[i + k - radius], w) for k, w in enumerate(kernel) if 0 <= i + k - radius < len(values)]
        out.append(sum(v * w for v, w in pairs) / sum(w for _, w in pairs))
    return out


def ratios(found: list[_Block], said: list[float]) -> dict[int, float]:
    """Each tag path's fused ratio: text outside links and punctuation for each block, smoothed along the page, times what markup says."""
    sums: dict[int, list[float]] = {}
    for b, w in zip(found, said, strict=True):
        path = sums.setdefault(b.element.path, [0, 0, 0, 0.0])
        path[0] += b.chars - b.linked
        path[1] += len(_MARKS.findall(b.text))
        path[2] += 1
        path[3] = max(path[3], w)
    text = _smooth([chars / n for chars, _, n, _ in sums.values()])
    marks = _smooth([(m + 1) / n for _, m, n, _ in sums.values()])
    # A path's own ratio keeps a neighbour's text from carrying it over the threshold.
    return {
        path: t * m * min(1.0, chars / n / t) * w if t else 0.0 for t, m, (path, (chars, _, n, w)) in zip(text, marks, sums.items(), strict=True)
    }


def content_paths(found: list[_Block], said: list[float], share: float = 0.8, least: float = 1.0) -> set[int]:
    """The tag paths whose fused ratio reaches the threshold, a share of the ratios' deviation; at least the best, if that reaches ``least``."""
    fused = ratios(found, said)
    mean = sum(fused.values()) / len(fused)
    deviation = math.sqrt(sum((f - mean) ** 2 for f in fused.values()) / len(fused))
    threshold = max(least, min(max(fused.values()), share * deviation))
    return {path for path, f in fused.items() if f >= threshold}


def _around(found: list[_Block], chosen: list[bool], most: float) -> _Element:
    """The least element with at least ``most`` of the chosen text that is more than a part of a text."""
    held: dict[int, list] = {}
    total = 0
    for b, c in zip(found, chosen, strict=True):
        if c:
            total += b.chars
            entry = held.setdefault(id(b.element), [b.element, 0])
            entry[1] += b.chars
    # Sums go up the tree from the deepest elements.
    depth: dict[int, int] = {}

    def deep(e: _Element) -> int:
        line = []
        while e is not None and id(e) not in depth:
            line.append(e)
            e = e.parent
        d = depth[id(e)] if e is not None else 0
        for x in reversed(line):
            d += 1
            depth[id(x)] = d
        return d

    level: dict[int, dict[int, list]] = {}
    for e, n in held.values():
        level.setdefault(deep(e), {})[id(e)] = [e, n]
    for d in range(max(level), 0, -1):
        for e, n in level.get(d, {}).values():
            if n >= most * total or e.parent is None:
                while e.parent and (e.tag in _PARTS or e.tag in _INLINE):
                    e = e.parent
                return e
            level.setdefault(d - 1, {}).setdefault(id(e.parent), [e.parent, 0])[1] += n
    raise AssertionError


def _inside(found: list[_Block], tops: set[int]) -> list[bool]:
    known: dict[int, bool] = {}
    out = []
    for b in found:
        line, e = [], b.element
        while e is not None and id(e) not in known and id(e) not in tops:
            line.append(id(e))
            e = e.parent
        within = e is not None and known.get(id(e), True)
        known.update(dict.fromkeys(line, within))
        out.append(within)
    return out


def _filled(found: list[_Block], chosen: list[bool], inside: list[bool], said: list[float]) -> list[bool]:
    """The chosen blocks and, inside, those that neither markup nor links speak against."""
    own = [c or (i and w >= 0.5 and b.linked <= 0.7 * b.chars) for b, c, i, w in zip(found, chosen, inside, said, strict=True)]
    kept = [False] * len(found)
    stays = False
    for k in reversed(range(len(found))):
        # Links stay alone between kept blocks, and as headings of one.
        free = said[k] >= 0.5 and inside[k]
        alone = free and 0 < k < len(found) - 1 and own[k - 1] and own[k + 1]
        stays = own[k] or alone or (stays and found[k].element.tag in _HEADINGS and said[k] >= 0.5 and (inside[k] or found[k].linked == 0))
        kept[k] = stays
    return kept


def extract(html: str | None) -> str:
    found = blocks(html) if html else []
    said = weights(found)
    paths = content_paths(found, said) if found else set()
    articles: dict[int, float] = {}
    total = 0.0
    for b, w in zip(found, said, strict=True):
        if b.element.path in paths:
            total += b.chars * w
            if b.element.article:
                articles[id(b.element.article)] = articles.get(id(b.element.article), 0.0) + b.chars * w
    whole = bool(articles) and 2 * max(articles.values()) > total
    inside = [whole and id(b.element.article) in articles for b in found]
    if whole:
        said = [w if i else w * BESIDE for w, i in zip(said, inside, strict=True)]
        paths = content_paths(found, said)
    if not paths:
        return ""
    chosen = [b.element.path in paths for b in found]
    around = id(_around(found, chosen, 0.8))
    if not whole:
        inside = _inside(found, {around})
    said = weights(found, frozenset((around, *(articles if whole else ()))))
    return "\n".join(b.text for b, kept in zip(found, _filled(found, chosen, inside, said), strict=True) if kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html. Returns page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
