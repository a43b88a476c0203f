"""Main text of web pages by the maximum-scoring subsequence.

A page is read as a sequence of tokens: runs of words, each with what surrounds it
(block tag, link, length of its block, whether it lies in a marked side part such as a
menu, an advert or reader comments, and in the page's article element if it has one),
and tags. Every word scores the log-odds of its surroundings, every tag a negative
weight, both learned from labelled pages: a bounded sample of pages whose article
element marks the main text. One linear scan finds the contiguous region with the
largest sum. Its blocks, without those in marked side parts, are the text; the rest of
the article element and the page's heading join it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import payloads

LABELLED_PAGES = 2_000
_TRAINING_WORDS, _SMOOTHING = 2_000.0, 20.0
_MOST = 4.0  # of a word's log-odds, either way

# Element names by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object canvas audio video".split())
# Browsers read these to the end of the file if no end tag follows; of the other raw ones the tag alone is skipped.
_TO_END = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody tfoot thead tr ul caption button".split()
)
SIDE_TAGS = frozenset("aside button dialog fieldset footer form head label menu nav search select".split())
SIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SIDE_WORDS = frozenset(
    "ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comments consent dfp disqus footer gdpr login "
    "modal nav navbar navigation newsletter notices notification outbrain pagination paywall popup promo promoted promotion "
    "replies sidebar signup sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
# Words that articles have too: they name a side part alone, or with words for what holds it.
AMBIGUOUS = frozenset("ad comment cookie cookies menu notice pager recommended related respond share sharing skip social".split())
HOLDERS = frozenset(
    "area article articles bar bottom box block button buttons container content icons inner item items left link links main message "
    "news outer overlay page pages panel post posts primary reading right row section site slot stories top unit warning wrap wrapper".split()
)
_HEADER_WORDS = frozenset(("header", "masthead"))
# Names without a separator: how a side part's name begins or ends.
_SIDE_START = ("advert", "breadcrumb", "comments", "cookie", "footer", "navbar", "newsletter", "sidebar", "sponsor")
_SIDE_END = ("banner", "comments", "footer", "menu", "navbar", "sidebar")
_NOT_ITSELF = frozenset("has hide is no not with without".split())  # has-sidebar names what holds a side part

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/]|\Z|\"|')", re.I)

_NAMED = re.compile(r"(?<![\w-])(?:class|id)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WRAPPERS = frozenset(("form", "fieldset"))
_FEW = 0.1  # of a side part's words, outside of all side parts: then it wraps the page


def _names_side(name: str, in_main: bool) -> bool:
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if not words or words[0] in _NOT_ITSELF:
        return False
    clear = (
        w in SIDE_WORDS or w not in AMBIGUOUS and (w.startswith(_SIDE_START) or w.endswith(_SIDE_END)) or not in_main and w in _HEADER_WORDS
        for w in words
    )
    return any(clear) or any(w in AMBIGUOUS for w in words) and all(w in AMBIGUOUS or w in HOLDERS for w in words)


@lru_cache(maxsize=65536)
def _is_side(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether an element is a side part by its name, role, class or id."""
    if tag in SIDE_TAGS or tag == "header" and not in_main:
        return True
    for name, value in _ATTRIBUTE.findall(attributes):
        name, given = name.lower(), value.strip("\"'")
        value = given.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in SIDE_ROLES:
            return True
        if name in ("class", "id"):
            names = re.sub(r"([a-z])([A-Z])", r"\1-\2", given).lower().split()
            if tag not in ("html", "body", "main", "article") and any(_names_side(n, in_main) for n in names):
                return True
            if tag == "article" and {"comment", "comments"} & set(names):
                return True
    return False


@lru_cache(maxsize=65536)
def _may_hold_text(tag: str, attributes: str) -> bool:
    """Whether a side part is one by its class or id only, or a form: it may wrap a page."""
    return (tag in _WRAPPERS or tag not in SIDE_TAGS and tag != "header") and not _is_side("div", _NAMED.sub("", attributes), True)


@dataclass
class Token:
    """A run of words of one block, or a tag (words = 0)."""

    tag: str  # of a tag, with / if closing; else the innermost block's
    block: int = 0
    words: int = 0
    text: str = ""
    side: bool = False
    link: bool = False
    main: bool = False  # in the page's article element


@dataclass
class Page:
    tokens: list[Token] = field(default_factory=list)
    has_main: bool = False
    block_words: Counter = field(default_factory=Counter)
    side_words: Counter = field(default_factory=Counter)  # by start of a side part that may hold text
    side_mains: Counter = field(default_factory=Counter)  # words of article elements, by the start of the side part around
    side_outer: dict[int, int | None] = field(default_factory=dict)  # start of a side part to that of the one around it


def tokens_of(page: str) -> Page:
    """The tokens of a page; markup errors and cut-off pages are read as browsers do. A form
    or a part with a side part's name that wraps the page's article, or nearly all its
    words, is none; what lies in it is marked on its own."""
    wrappers: frozenset[int] = frozenset()
    while True:
        out = _tokens(page, wrappers)
        if out.has_main or not out.side_words:
            return out
        words = sum(t.words for t in out.tokens)
        outside = sum(t.words for t in out.tokens if not t.side)
        around, most = max(out.side_mains.items(), key=lambda x: x[1], default=(None, 0))
        more: set[int] = set()
        while most > outside and around is not None:
            more.add(around)
            around = out.side_outer[around]
        more |= {p for p, n in out.side_words.items() if 2 * n > words and outside <= _FEW * n}
        if not more:
            return out
        wrappers |= more


class _Ends:
    """Where the end tags of an element are, found in one pass for each name."""

    def __init__(self, page: str, pattern: str):
        self.page, self.pattern, self.found = page, pattern, {}

    def after(self, tag: str, position: int) -> tuple[int, int] | None:
        if tag not in self.found:
            spans = [m.span() for m in re.finditer(self.pattern.format(re.escape(tag)), self.page, re.I)]
            self.found[tag] = [s for s, _ in spans], spans
        starts, spans = self.found[tag]
        at = bisect_left(starts, position)
        return spans[at] if at < len(spans) else None


def _tokens(page: str, wrappers: frozenset[int]) -> Page:
    """The tokens, read as if the elements that start at ``wrappers`` were no side parts.
    In linear time, however deep elements are nested or left open."""
    out = Page()
    raw_ends, inline_ends = _Ends(page, r"</{}(?=[\s/>])"), _Ends(page, r"</{}\s*>")
    mains = "article" if re.search(r"<article[\s>]", page, re.I) else "main"
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # name, side, main
    opened: Counter = Counter()  # names on the stack
    sides: list[tuple[int, int, int]] = []  # side parts around: depth of stack, start, words before
    held: list[tuple[int, int, int]] = []  # article elements in them: depth, start of the side part, words before
    firm = 0  # of the side parts around, those that can't hold the page
    inside = 0  # words so far in side parts that may hold it

    def closed() -> None:
        """Count the words of the parts that are no longer open."""
        nonlocal firm
        while held and held[-1][0] >= len(stack):
            _, part, before = held.pop()
            out.side_mains[part] += inside - before
        while sides and sides[-1][0] >= len(stack):
            _, part, before = sides.pop()
            firm -= before < 0
            if before >= 0 and inside > before:
                out.side_words[part] = inside - before

    def drop(depth: int) -> None:
        opened.subtract(name for name, _, _ in stack[depth:])
        del stack[depth:]
        closed()

    block, links, position = 0, 0, 0
    while match := _TOKEN.match(page, position):
        start, position = position, match.end()
        if (text := match["text"]) is not None:
            parts = [text]
            while position < len(page) and (more := _TOKEN.match(page, position)) and more["text"] is not None:
                parts.append(more["text"])
                position = more.end()
            text = "".join(parts)
            tag, side, main = stack[-1]
            words = len(text.split())
            out.tokens.append(Token(tag, block, words, html.unescape(text), side, links > 0, main))
            out.block_words[block] += words
            if side and not firm:
                inside += words
            continue
        if (tag := match["tag"]) is None:
            continue
        tag = tag.lower()
        if match["close"]:
            if tag in BLOCK:
                block += 1
                if opened[tag] > 0:
                    drop(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth][0] == tag))
            elif tag == "a":
                links = max(0, links - 1)
            out.tokens.append(Token("/" + tag, block))
            if tag in ("br", "td", "th"):
                out.tokens.append(Token(stack[-1][0], block, 0, " ", stack[-1][1], links > 0, stack[-1][2]))
            continue
        if tag in RAW:
            if not match["attributes"].rstrip().endswith("/") or tag not in ("svg", "math"):
                end = raw_ends.after(tag, position)
                position = end[0] if end else len(page) if tag in _TO_END else position
            out.tokens.append(Token(tag, block))
            continue
        _, side, main = stack[-1]
        if tag in BLOCK and tag != "hr":
            block += 1
            if tag in ("p", "li", "dd", "dt", "tr", "option") and stack[-1][0] in ({"p"} if tag == "p" else {tag, "p"}):
                drop(len(stack) - 1)  # an end tag left out
                _, side, main = stack[-1]
            elif stack[-1][0] == "p":
                drop(len(stack) - 1)
                _, side, main = stack[-1]
            if start not in wrappers and _is_side(tag, match["attributes"], main):
                side, holds = True, _may_hold_text(tag, match["attributes"])
                out.side_outer[start] = sides[-1][1] if sides else None
                firm += not holds
                sides.append((len(stack), start, inside if holds else -1))
            if tag == mains and side and not firm:
                held.append((len(stack), sides[-1][1], inside))
            is_main = tag == mains and not side
            out.has_main |= is_main
            stack.append((tag, side, main or is_main))
            opened[tag] += 1
            links = 0
        elif tag == "hr":
            block += 1
        elif tag == "a":
            links += 1
        elif tag in ("span", "label", "small", "ins") and _is_side(tag, match["attributes"], True):
            # an inline side part: skipped up to its end tag
            if end := inline_ends.after(tag, position):
                out.tokens.append(Token(tag, block))
                position = end[1]
        out.tokens.append(Token(tag, block))
        if tag in ("br", "td", "th"):
            out.tokens.append(Token(stack[-1][0], block, 0, " ", stack[-1][1], links > 0, stack[-1][2]))
    drop(1)
    return out


def _length(words: int) -> str:
    return "words " + ("1" if words < 3 else "3" if words < 7 else "7" if words < 16 else "16")


def _kind(tag: str) -> str:
    """Headings are of one kind, and so are parts that only divide a page."""
    return "h" if re.fullmatch("h[1-6]", tag) else "div" if tag in ("", "body", "section", "article", "main", "center") else tag


def features(page: Page, token: Token) -> list[str]:
    """What a word's score is added up from."""
    own = ["in " + _kind(token.tag), "link" if token.link else "no link", _length(page.block_words[token.block])]
    return own + ["main" if token.main else "not main"] * page.has_main


def counted(page: Page) -> Counter:
    """(feature, in the main text) to words, (tag, ...) to tags, of a labelled page."""
    out: Counter = Counter()
    for token in page.tokens:
        if token.words and not token.side:
            out.update({(f, token.main): token.words for f in features(page, token)})
        elif token.words:  # dropped by its mark, whatever tag it is in; of the others it teaches links and lengths
            out.update({(f, False): token.words for f in features(page, token) if not f.startswith("in ")})
        elif not token.text:
            out[f"<{token.tag}>", token.main] += 1
    return out


@dataclass(frozen=True)
class Weights:
    odds: dict[str, float]

    def word(self, page: Page, token: Token) -> float:
        return float(np.clip(sum(self.odds.get(f, 0.0) for f in features(page, token)), -_MOST, _MOST))

    def tag(self, token: Token) -> float:
        return min(-0.1, self.odds.get(f"<{token.tag}>", -1.0) / 2)


def weights(counts: dict[tuple[str, bool], float]) -> Weights:
    """Smoothed log-odds; without labelled pages, by tags alone (all words score 0 but
    for the small start of ``extracted``)."""
    odds = {}
    for kind in (False, True):  # words and tags each have their own totals
        names = {n for n, _ in counts if n.startswith("<") == kind}
        groups = {False: 1e-9, True: 1e-9}
        for name in names:
            if kind or name in ("link", "no link"):
                for side in groups:
                    groups[side] += counts.get((name, side), 0)
        for name in names:
            inside, outside = (
                counts.get((name, side), 0) / groups[side] * _TRAINING_WORDS + _SMOOTHING for side in (True, False)
            )
            odds[name] = float(np.log(inside / outside))
    return Weights(odds)


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """The first contiguous run with the largest sum, (0, 0) if none is positive."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    lowest = np.minimum.accumulate(sums)
    gains = sums - lowest
    end = int(gains.argmax())
    if gains[end] <= 0:
        return 0, 0
    start = int(np.flatnonzero(sums[: end + 1] == lowest[end])[-1])
    return start, end


def _joined(tokens: list[Token], start: int, end: int) -> tuple[int, int]:
    """The region with what belongs to it though it scores low: the rest of the article
    element it lies in, and a page's heading right before it. Side parts and tags
    between them don't count."""
    if start == end:
        return start, end

    def ours(token: Token) -> bool | None:
        return None if token.side or not token.words else token.main

    for at in range(end, len(tokens)):
        if (mine := ours(tokens[at])) is False:
            break
        end = at + 1 if mine else end
    heading = True
    for at in range(start - 1, -1, -1):
        mine, token = ours(tokens[at]), tokens[at]
        if mine is False:
            if heading and token.tag == "h1" and not token.link:
                start, heading = at, False
                continue
            break
        start = at if mine else start
    return start, end


def extracted(markup: str, learned: Weights) -> str:
    """The main text: blocks joined by an empty line, white space as single spaces."""
    page = tokens_of(markup)
    scores = np.array([
        0.0 if t.side else t.words * (0.05 + learned.word(page, t)) if t.words else learned.tag(t) if not t.text else 0.0
        for t in page.tokens
    ])
    start, end = _joined(page.tokens, *best_region(scores))
    blocks: dict[int, list[str]] = {}
    for token in page.tokens[start:end]:
        if token.text and not token.side:
            blocks.setdefault(token.block, []).append(token.text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def fit(pages: DataFrame, most: int = LABELLED_PAGES) -> Weights:
    """Weights from about ``most`` labelled pages of ``pages`` (page_id, html), those of the
    smallest hashes of their ids; pages without an article or main element label nothing."""
    labelled = pages.select(F.col("html").cast("string").alias("html"), "page_id").where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    number = labelled.count()
    draw = F.pmod(F.xxhash64("page_id", F.lit("labelled")), F.lit(1 << 30)) < int(min(1.0, most / max(number, 1)) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for markup in payloads(batch.column(0)):
                page = tokens_of(markup.decode("utf-8", "replace"))
                if page.has_main:
                    total.update(counted(page))
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in total], pa.string()), pa.array([m for _, m in total], pa.bool_()), pa.array(list(total.values()), pa.int64())],
            names=["name", "main", "n"],
        )

    parts = labelled.where(draw).select("html").mapInArrow(run, "name string, main boolean, n long")
    known = [f"<{c}{t}>" for t in BLOCK | VOID | RAW | {"a", "b", "i", "em", "strong", "span", "td", "th"} for c in ("", "/")]
    bounded = parts.where(~F.col("name").startswith("<") | F.col("name").isin(known))  # names are of fixed sets
    sums = bounded.groupBy("name", "main").agg(F.sum("n").alias("n")).collect()
    return weights({(r["name"], r["main"]): r["n"] for r in sums})


def texts(pages: DataFrame, learned: Weights) -> DataFrame:
    """(page_id, url, text, n_chars) of every row, from the whole html.

    Null and empty html give an empty text, and so does a page without a word that
    scores; plain text without markup is one block. Repeated rows, null ids and null
    urls are kept; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = shared.value
        for batch in batches:
            found = [extracted(markup.decode("utf-8", "replace"), learned) for markup in payloads(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
