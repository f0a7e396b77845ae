"""The text blocks of an HTML page and what its markup says of each."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

#: fixed values: elements of HTML that hold no text to read, have no end tag, or begin a block
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody tfoot"
    " thead tr ul".split()
)
#: elements whose text is never the article's
ASIDE = frozenset("aside audio button canvas datalist dialog footer form head math menu nav object select svg template video".split())
#: elements ended by the start of another of their kind, and where the search for one ends
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
}
#: words in the class, id or role of what surrounds an article
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs comment commentlist comments"
    " complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation"
    " newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond"
    " search searchform share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar"
    " widget widgets".split()
)
#: beside these, a word names what a container has, not what it is
LAYOUT = frozenset("has layout no with without".split())
#: outside main content only
HEADERS = frozenset(["header", "hgroup"])

_TAG = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:{RAW})(?=[\s/>]).*?(?:</(?:{RAW})(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: what the markup says of a block
OPEN, MARKED, MAIN = 0, 1, 2


class Block(NamedTuple):
    text: str
    tag: str
    role: int


def _said(attributes: str) -> set[str]:
    """The words of an element's class, id and role; ``main`` if it says it is the main content."""
    words: set[str] = set()
    for name, *values in _NAMES.findall(attributes):
        value = "".join(values)
        found = {w.lower() for w in _WORDS.findall(value)}
        if name.lower() == "itemprop":
            found = {"main"} if value.lower() == "articlebody" else set()
        elif name.lower() != "role":
            found.discard("main")
        words |= found
    return words


def blocks(html: str) -> list[Block]:
    """The non-empty text blocks of a page in page order.

    References are decoded, runs of white space (line breaks too) are one space.  A
    block is MAIN inside ``article`` (of a page without text in one: ``main``, or what
    its markup calls so), MARKED inside an element that surrounds articles or holds
    comments, also an article inside an article, and else OPEN.  Unclosed elements end as in browsers; any text gives blocks, in time
    linear in its length but for odd nesting.
    """
    out: list[tuple[str, str, int, bool]] = []  # text, tag, level of main content, marked
    stack: list[tuple[str, int, bool]] = []  # name, level and mark outside
    open_tags: Counter[str] = Counter()
    level, marked, tag = 0, False, ""
    kept: list[str] = []
    aside: list[str] = []

    def flush() -> None:
        for pieces, mark in ((kept, marked), (aside, True)):
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    out.append((text, tag, level, mark))
                pieces.clear()

    def close(at: int) -> None:
        nonlocal level, marked
        for name, _, _ in stack[at:]:
            open_tags[name] -= 1
        _, level, marked = stack[at]
        del stack[at:]

    end = 0
    for m in _TAG.finditer(html):
        if m.start() > end:
            (aside if marked else kept).append(unescape(html[end : m.start()]))
        end = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        block = name in BLOCK
        if m[1]:
            if block:
                flush()
            if open_tags[name]:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] == name:
                        close(at)
                        break
                    if not block and stack[at][0] in BLOCK:
                        break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                (aside if marked else kept).append("\n")
            continue
        if block:
            flush()
            if open_tags["p"]:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at][0] in BLOCK:
                        if stack[at][0] == "p":
                            close(at)
                        break
            if name in IMPLIED:
                kinds, until = IMPLIED[name]
                if any(open_tags[k] for k in kinds):
                    for at in range(len(stack) - 1, -1, -1):
                        if stack[at][0] in kinds:
                            close(at)
                            break
                        if stack[at][0] in until:
                            break
            tag = name
        elif name in ("td", "th"):
            (aside if marked else kept).append(" ")
        stack.append((name, level, marked))
        open_tags[name] += 1
        said = _said(m[3]) if m[3] and _NAMES.search(m[3]) else set()
        if name == "article":
            marked = marked or level == 2 or bool(said & {"comment", "comments", "reply"})
            level = 2
        elif name == "main" or "main" in said:
            level = max(level, 1)
        elif name not in ("html", "body"):
            hinted = said & HINTS and not said & LAYOUT
            marked = marked or name in ASIDE or bool(hinted) or (name in HEADERS and not level)
    if end < len(html):
        (aside if marked else kept).append(unescape(html[end:]))
    flush()
    top = max((lev for _, _, lev, mark in out if not mark), default=0)
    return [
        Block(text, tag, MARKED if mark else MAIN if top and lev == top else OPEN) for text, tag, lev, mark in out
    ]
