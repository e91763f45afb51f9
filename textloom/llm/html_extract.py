"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element. The text lengths of ``WINDOW`` neighbouring lines are summed; where such a sum
reaches the threshold for the first time the text surges, where it does so for the last time it dives, and the lines from surge to dive are kept. What a page names itself is a weight:
containers beside the article (``nav``, ``aside``, ``form``, a class such as ``ad``) weigh nothing, and a line in a marked article weighs ``SURGE`` more than its length, so that it surges
alone. Each marked article has a distribution of its own, and all that is in none has one, so text outside the articles stays where it surges by itself; of its first and last window go
the short lines at the outer end that the sum does not need, up to a heading.

Names of classes and ids are read in whole: an article's title or paragraph is not dropped because a word of its class is ``header`` or a value elsewhere says ``hidden``.

Cases: null html counts as empty, pages without text give the empty string, of a page whose every sum is under the threshold the highest sums count; cut pages, unclosed and stray tags are
read as far as they go, in time that is linear in the page; repeated rows give repeated rows; extra columns are ignored; an empty table gives no row. White space is what Unicode calls so.
Nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import work

#: Lines whose lengths are summed.
WINDOW = 3
#: A window's weight at a surge.
SURGE = 80
#: A line is short, so many times under a surge, where it may go from the ends of an unmarked run.
EDGE = 4

#: HTML element names by their role.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "select", "button", "title", "head", "canvas", "audio", "video"}
#: Those of them that HTML reads as raw text: without an end tag they reach to the page's end.
UNPARSED = {"script", "style", "noscript", "iframe", "textarea", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "output", "picture", "progress", "q", "rp", "rt", "ruby", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of class and id names of blocks beside the article.
WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "foot", "sidebar", "aside", "widget", "related",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "form", "search",
    "comment", "comments", "respond", "disqus", "discussion", "share", "sharing", "social", "pagination", "pager", "copyright", "skip", "toolbar", "paywall",
}
#: A container of these is the article whatever its class.
MAIN = {"article", "main"}
#: Elements that hold text, not other blocks: only a class or id that is such a word as a whole sets them aside, and headings none.
TEXTUAL, HEADINGS = {"p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figcaption", "caption", "summary"}, {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words that name a part of the article where they stand in it.
INNER = {"header", "masthead", "notice", "notices"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))",
    re.S,
)
ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PARTS = re.compile(r"[^a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def named(name: str, value: str, inside: bool) -> bool:
    """Whether a class or id sets an element aside."""
    if name in HEADINGS:
        return False
    for token in value.lower().split():
        if name in TEXTUAL:
            if token in WORDS:
                return True
        elif any(w in WORDS and not (inside and w in INNER) for w in _PARTS.split(token)):
            return True
    return False


def beside(name: str, attrs: str, inside: bool = False) -> bool:
    """Whether an element stands beside the article, or in the one it is inside of."""
    if name in ASIDE:
        return not (name == "header" and inside)
    if name in MAIN or name == "body" or name == "html" or len(attrs) < 4:
        return False
    for key, *values in ATTR.findall(attrs):
        value, key = next((v for v in values if v), ""), key.lower()
        if key in ("class", "id"):
            if named(name, value, inside):
                return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif (key == "aria-hidden" and value.lower() == "true") or (key == "hidden" and value.lower() != "until-found") or (key == "style" and _UNSEEN.search(value.lower())):
            return True
    return False


def lines(page: str) -> list[tuple[str, bool, int, bool]]:
    """A page's blocks: text, whether beside the article, the number of the article it is in (0: none), and whether a heading."""
    out: list[tuple[str, bool, int, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    opened: dict[str, int] = {}  # how often each name is on the stack
    side, article, articles, heading = False, 0, 0, False

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, side, article, heading))

    def push(name):
        stack.append((name, side, article))
        opened[name] = opened.get(name, 0) + 1

    def pop():
        nonlocal side, article
        name, side, article = stack.pop()
        opened[name] -= 1
        return name

    at = 0
    unclosed: set[str] = set()
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
            continue
        if name in INLINE:
            known = opened.get(name, 0) > 0  # an inline element that stands beside, or one in it
            if name in VOID or (m["close"] and not known):
                continue
            if not m["close"] and not beside(name, m["attrs"], bool(article)):
                if known:
                    push(name)
                continue
        flush()
        if m["close"]:
            heading = False
            if opened.get(name, 0):
                while pop() != name:
                    pass
            continue
        if name in VOID or m["attrs"].rstrip(">").endswith("/"):
            continue
        if name in RAW:
            if name == "head":
                at = _head_end(page, at)
                continue
            found = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if found:
                at = found.end()
            elif name in UNPARSED:
                at = len(page)
            else:  # read as if the start tag were not there
                unclosed.add(name)
            continue
        if name == "p" or name == "li" or name in ("td", "th", "tr", "dt", "dd", "option"):
            while stack and stack[-1][0] == name:  # an open one of these ends where the next begins
                pop()
        heading = name in HEADINGS
        push(name)
        if beside(name, m["attrs"], bool(article)):
            side = True
        elif name in MAIN and not side and not article:
            articles += 1
            article = articles
    flush()
    return out


_HEAD_END = re.compile(r"</head\s*>|<body\b|<(script|style|title)\b[^>]*>", re.I)


def _head_end(page: str, at: int) -> int:
    """Past the head, or its start where it has no end; scripts and styles in it may hold what looks like its end."""
    start = at
    while True:
        stop = _HEAD_END.search(page, at)
        if stop is None:
            return start
        if not stop[1]:
            return stop.end() if stop[0][1] == "/" else stop.start()
        inner = re.compile(rf"</{stop[1]}\s*>", re.I).search(page, stop.end())
        if inner is None:
            return start
        at = inner.end()


def spans(weights: list[int], heading: list[bool], least: int, open_ends: bool) -> range:
    """The lines from surge to dive: from the first window whose sum reaches ``least`` to the last.

    With ``open_ends`` the short lines at either end that the sum of their window does not need go, at the begin up to a heading.
    """
    sums = [sum(weights[k : k + WINDOW]) for k in range(len(weights))]
    high = [k for k, s in enumerate(sums) if s >= least]
    if not high:
        return range(0)
    begin, stop = high[0], min(high[-1] + WINDOW, len(weights))
    if open_ends:
        last = min(begin + WINDOW, len(weights))
        while begin + 1 < last and not heading[begin] and EDGE * weights[begin] < least <= sum(weights[begin + 1 : last]):
            begin += 1
        while stop - 1 > max(high[-1], begin) and EDGE * weights[stop - 1] < least <= sum(weights[high[-1] : stop - 1]):
            stop -= 1
    return range(begin, stop)


def main_text(page: str) -> str:
    """The blocks between surges and dives, in page order, joined by a line feed."""
    blocks = lines(page)
    # the blocks beside the article weigh nothing, but do not part it either
    runs: dict[int, list[int]] = {}
    for i, (_, side, a, _) in enumerate(blocks):
        if not side:
            runs.setdefault(a, []).append(i)
    weights = {a: [len(blocks[i][0]) + (SURGE if a else 0) for i in own] for a, own in runs.items()}
    least = min(SURGE, max((sum(w[k : k + WINDOW]) for w in weights.values() for k in range(len(w))), default=0))
    keep = sorted(own[k] for a, own in runs.items() for k in spans(weights[a], [blocks[i][3] for i in own], least, not a))
    return "\n".join(blocks[i][0] for i in keep)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in work.pieces(parts):
        ids, urls, pages = (c.to_pylist() for c in part.columns)
        yield from work.batches(_OUT, ((i, u, t, len(t)) for i, u, t in ((i, u, main_text(p)) for i, u, p in zip(ids, urls, pages, strict=True))))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    own = work.spread(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", work.text_of("html").alias("html")))
    return own.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    """The contract's query over ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
