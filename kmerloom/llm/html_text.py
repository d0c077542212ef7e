"""Operator 1: main text of HTML pages by line-block distribution.

The markup is cut into *lines*, one for each block element's own text. Every line has a weight, its text
length without link text. Weights are summed over a sliding window of lines. The text starts where the sums surge and
ends where they dive to nothing; what lies between a surge and its dive is the main text, lines of links alone among
it. Short stretches count as text where they stand in the same element as text that has surged.

The page's structure only changes weights, before the search. Lines of elements that look like a menu, header, footer,
sidebar, notice, advert, form or reader comments, by tag, role or the words of their names, weigh nothing, unless such an
element alone holds the page's main element, or holds the larger part of the page's text and is a form, has a name that does not end in what
it looks like, or alone holds the page's article element. Where article and main elements hold at least half of the weight, lines
outside weigh nothing. A class that names the article itself outweighs single words beside it. Outside article and main elements, short
lines of copyright and of cookie notices weigh nothing, whatever the names around them. What a reader does not see (scripts, styles, hidden elements, parts of controls) is no text at all.

A page is parsed in one pass whose time is in proportion to its length.

Defined results: null or empty html gives ''. Markup that is never closed ends with the page. Long pages are
read whole. Repeated rows give repeated results. Columns besides the id, url and html are not read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import nonempty, prepare, texts_of

# HTML element names by their part in a page.
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas button select option textarea audio video title".split())
LOOKS_LIKE_CHROME = frozenset("nav footer aside form dialog menu".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY_NEXT = {"p": BLOCKS - {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
MAIN_TAGS = frozenset({"article", "main"})
MAIN_ROLES = frozenset({"main", "article"})
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form alert".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar footer foot colophon copyright sidebar side aside widget widgets related recommended recommendations share sharing social comment comments disqus respond replies reply discussion "
    "feedback opinions guestbook bottom cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search toolbar pagination pager paywall skip tags legal disclaimer".split()
)
# Words after which a name says what a page has, not what an element is; words that end names without saying what
# they name; words of article parts, whose own headers are not the page's; what an article element is if it is not the page's
# article; and asides that are quotes from the text.
STATE_WORDS = frozenset("has with without no is show js not".split())
ENDINGS = frozenset("area bar block box container group inner item list outer panel region section slot unit wrap wrapper zone".split())
ARTICLE_WORDS = frozenset("article post entry story content main text headline".split())
OTHER_ARTICLES = frozenset("comment comments reply replies related recommended teaser ad ads advert advertisement sponsored promo promotion".split())
QUOTES = frozenset("pullquote pull quote".split())
# Class names of the page's article itself, beside which single words of chrome only say what it is about or has; and what short
# lines of notices and of copyright hold, by which they are known whatever the names around them.
ARTICLE_NAMES, POST_NAMES = frozenset({"article"}), frozenset("post entry story hentry".split())
NOTICE = re.compile(r"\bcookies?\b.*\b(?:accept|agree|consent|allow|preferences|policy)\b|\b(?:accept|agree|consent|allow)\b.*\bcookies?\b", re.I | re.S)
RIGHTS = re.compile(r"^(?:©|\(c\)|copyright)|\ball rights reserved\b|©\s*\d{4}", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|aria-label|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Lines of a window, the weight at which a window's sum is a surge, and characters of a line that may be a notice.
WINDOW, SURGE, NOTICE_CHARS = 3, 80, 300


def attributes_of(raw: str) -> list[tuple[str, str]]:
    return [(name.lower(), a or b or c) for name, a, b, c in ATTRIBUTE.findall(raw)] if raw else []


def looks_like_chrome(tag: str, attributes: list[tuple[str, str]], in_main: bool) -> str:
    """'' for an element that looks like a part of the article; else 'name' where only a part of a name says otherwise, 'other' where it
    names other articles (comments, related ones), or 'yes'."""
    parts_of = [[x.lower() for x in NAME_PART.findall(token)] for name, value in attributes if name in ("class", "id") for token in value.split()]
    if tag in LOOKS_LIKE_CHROME and not (tag == "aside" and any(QUOTES.intersection(parts) for parts in parts_of)):
        return "name" if tag == "form" else "yes"
    if tag == "header" and not in_main:
        return "yes"
    if any(name == "role" and value.lower() in CHROME_ROLES for name, value in attributes):
        return "yes"
    if tag in HEADINGS or tag in ("html", "body"):
        return ""
    # a class of the article's own: words that stand alone beside it do not make it something else
    own = {token.lower() for name, value in attributes if name == "class" for token in value.split()} if tag in BLOCKS else set()
    soft = frozenset() if not own & (ARTICLE_NAMES | POST_NAMES) else CHROME_WORDS if own & ARTICLE_NAMES else CHROME_WORDS - OTHER_ARTICLES
    found = ""
    for parts in parts_of:
        if len(parts) == 1 and parts[0] in soft:
            continue
        state = next((i for i, x in enumerate(parts) if x in STATE_WORDS), len(parts))
        parts = parts[:state]
        if tag in MAIN_TAGS:
            if OTHER_ARTICLES.intersection(parts):
                return "other"
            continue
        words = [x for x in parts if x in CHROME_WORDS]
        if words and not (words[0] == "header" and (in_main or ARTICLE_WORDS.intersection(parts))):
            ends = [x for x in parts if x not in ENDINGS]
            if ends and ends[-1] in CHROME_WORDS:
                return "other" if OTHER_ARTICLES.intersection(parts) else "yes"
            # text of a paragraph or an inline element does not go for one word in a longer name
            found = "name" if tag in BLOCKS and tag not in ("p", "blockquote", "pre", "li", "td") else found
    return found


def is_unseen(tag: str, attributes: list[tuple[str, str]]) -> bool:
    if tag in UNSEEN:
        return True
    if tag in ("html", "body"):
        return False
    return any(name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())) for name, value in attributes)


@dataclass
class Suspect:
    """An element that looks like chrome: its lines from ``start`` to ``end``."""

    start: int
    end: int
    looks: str  # as by looks_like_chrome


@dataclass
class Page:
    """The lines of a page in page order."""

    texts: list[str] = field(default_factory=list)
    own: list[int] = field(default_factory=list)  # characters outside links
    main: list[bool] = field(default_factory=list)  # within an article or main element
    box: list[object] = field(default_factory=list)  # what lines of one element have in common
    suspects: list[Suspect] = field(default_factory=list)
    mains: list[tuple[int, bool]] = field(default_factory=list)  # line at which each article or main element begins, and whether it is main


def lines(html: str) -> Page:
    out, parts, linked = Page(), [], 0
    # open elements: tag, is a block, number among the elements, is unseen, suspect's number or -1, is main or within
    stack: list[tuple[str, bool, int, bool, int, bool]] = []
    blocks: list[int] = []  # places of the blocks in the stack
    open_blocks: Counter[str] = Counter()
    open_inline: list[Counter[str]] = [Counter()]  # inline elements since each open block
    open_unseen: Counter[str] = Counter()  # inline elements that hide what they hold, blocks too
    unseen = links = number = 0
    lower: str | None = None

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                tag, parent = ("", -1)
                if blocks:
                    tag, parent = stack[blocks[-1]][0], stack[blocks[-2]][2] if len(blocks) > 1 else -1
                loose = len(blocks) < 2 or stack[blocks[-2]][0] in ("body", "html")
                out.texts.append(text)
                out.own.append(max(0, len(text) - linked))
                out.main.append(bool(stack) and stack[-1][5])
                out.box.append((parent, tag) if loose else parent)
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            parts.append(text)
            if links:
                linked += len(" ".join(html_lib.unescape(text).split()))

    def pop() -> str:
        nonlocal unseen, links
        tag, block, _, hides, suspect, _ = stack.pop()
        if block:
            blocks.pop()
            open_inline.pop()
            open_blocks[tag] -= 1
        else:
            open_inline[-1][tag] -= 1
            open_unseen[tag] -= tag in UNSEEN
            links -= tag == "a"
        unseen -= hides
        if suspect >= 0:
            out.suspects[suspect].end = len(out.texts)
        return tag

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        m = TOKEN.search(html, at) if at <= last else None
        if not m:
            opened = html.find("<", at)  # markup that is never closed
            add(html[at:] if opened < 0 or not re.match(r"</?[A-Za-z]|<!|<[?]", html[opened : opened + 3]) else html[at:opened])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[1] is not None:
            add(m[1])
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        block = tag in BLOCKS
        if m[2]:  # an end tag
            if block:
                if open_blocks[tag]:
                    if not unseen:
                        end_line()
                    # what is left open inside does not outlive the block
                    while pop() != tag:
                        pass
                elif not unseen:
                    end_line()
            elif open_inline[-1][tag] or open_unseen[tag]:
                while pop() != tag:
                    pass
            elif tag == "br":
                add(" ")
            continue
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            pop()
        if block and not unseen:
            end_line()
        if tag == "br":
            add(" ")
        if block:
            while blocks and tag in CLOSED_BY_NEXT.get(stack[blocks[-1]][0], ()):
                place = blocks[-1]
                while len(stack) > place:
                    pop()
        if tag in VOID:
            continue
        if tag in RAW:  # its content has no markup and is never text of the article
            lower = html.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == n else html.find(f"</{tag}", at)
            if end < 0:
                break
            close = html.find(">", end)
            at = n if close < 0 else close + 1
            continue
        raw = m[4] or ""
        if raw.endswith("/") and not block:
            continue
        attributes, in_main = attributes_of(raw), bool(stack) and stack[-1][5]
        hides, looks = is_unseen(tag, attributes), "" if unseen else looks_like_chrome(tag, attributes, in_main)
        is_main = not looks and (tag in MAIN_TAGS or any(name == "role" and value.lower() in MAIN_ROLES for name, value in attributes))
        suspect = -1
        if looks and not block:
            hides = True
        elif looks and not hides:
            suspect = len(out.suspects)
            out.suspects.append(Suspect(len(out.texts), -1, looks))
        if is_main and not in_main and not unseen:
            out.mains.append((len(out.texts), tag == "main"))
        if block:
            blocks.append(len(stack))
            open_inline.append(Counter())
            open_blocks[tag] += 1
        else:
            open_inline[-1][tag] += 1
            open_unseen[tag] += tag in UNSEEN
            links += tag == "a"
        unseen += hides
        number += 1
        stack.append((tag, block, number, hides, suspect, in_main or is_main))
    end_line()
    while stack:
        pop()
    return out


def weights_of(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Each line's weight, and whether it may be text at all (lines of links may, without weight)."""
    own = np.array(page.own, "i8")
    total, change = own.sum(), np.zeros(len(own) + 1, "i4")
    np.add.at(change, [s.start for s in page.suspects], 1)
    np.add.at(change, [s.end for s in page.suspects], -1)
    before, at = np.concatenate(([0], np.cumsum(own))), np.array([k for k, _ in page.mains if k < len(own)], "i8")
    # sums over the article and main elements in page order, so that a suspect is judged without looking at each of them
    whole = np.concatenate(([0], np.cumsum([w for k, w in page.mains if k < len(own)], dtype="i8")))
    bare = np.concatenate(([0], np.cumsum(np.cumsum(change)[at] == 0)))  # those in no suspect
    spans = np.searchsorted(at, [[s.start for s in page.suspects], [s.end for s in page.suspects]])
    freed = -1  # where the suspect ends that was freed first: others beyond it do not alone hold the article
    for s, lo, hi in zip(page.suspects, *spans.tolist(), strict=True):  # outer ones come first
        larger = 2 * (before[s.end] - before[s.start]) > total
        outside = bare[-1] - (bare[hi] - bare[lo])
        alone = lo < hi and s.looks != "other" and (larger or whole[hi] > whole[lo]) and outside == 0 and (freed < 0 or s.start < freed)
        if (larger and s.looks == "name") or alone:
            change[s.start] -= 1
            change[s.end] += 1
            freed = s.end if freed < 0 else freed
    pending = np.cumsum(change[:-1])
    free, main = pending == 0, np.array(page.main, bool)
    notice = np.array([not m and len(t) <= NOTICE_CHARS and (RIGHTS.search(t) or NOTICE.search(t)) is not None for t, m in zip(page.texts, page.main, strict=True)], bool)
    free &= ~notice
    # links are part of the text in the page's article
    weight = np.where(free, np.where(main, [len(t) for t in page.texts], own), 0)
    if 2 * weight[main].sum() >= weight.sum() > 0:
        free &= main
        weight[~main] = 0
    return weight, free


def kept_lines(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines lie between a surge and its dive.

    The sum at a line is over the window that starts there. A surge is a sum of at least ``surge``; its stretch
    grows both ways while sums stay above nothing, from the first to the last line of it that weighs anything. Pages whose
    largest sum is below ``surge`` take that largest sum as the surge, so short articles are found too.
    """
    n = len(weights)
    total = [0, *accumulate(weights)]
    sums = [total[min(n, k + window)] - total[k] for k in range(n)]
    top = min(surge, max(sums, default=0))
    kept = [False] * n
    if top == 0:
        return kept
    k = 0
    while k < n:
        if sums[k] == 0:
            k += 1
            continue
        end = k
        while end < n and sums[end] > 0:
            end += 1
        if max(sums[k:end]) >= top:
            held = [i for i in range(k, min(n, end + window - 1)) if weights[i]]
            for i in range(held[0], held[-1] + 1):
                kept[i] = True
        k = end
    return kept


def main_text(html: str, window: int = WINDOW, surge: int = SURGE) -> str:
    page = lines(html)
    if not page.texts:
        return ""
    weight, free = weights_of(page)
    kept = np.array(kept_lines(weight.tolist(), window, surge)) & free
    boxes = {page.box[i] for i in np.flatnonzero(kept & (weight > 0))}
    return "\n".join(t for t, k, w, f, b in zip(page.texts, kept.tolist(), weight.tolist(), free.tolist(), page.box, strict=True) if k or (f and w and b in boxes))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Row by row: no shuffle."""
    prepare(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in nonempty(batches):
            texts = [main_text(x, window, surge) for x in texts_of(b, html)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(page_id, url, html).mapInArrow(run, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars long")
