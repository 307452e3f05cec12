"""Web pages as sequences of text blocks with their tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element names of the HTML standard, by what they mean for the flow of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "head title script style noscript template svg math iframe object canvas select textarea button datalist audio video".split()
)
RAW = frozenset("script style textarea title iframe noscript".split())
#: What may stand in a head; anything else, and text, ends a head that is still open.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
#: Unseen elements without an end tag of their own do not hide what comes behind them: the next of BLOCKS ends them.
LOOSE = frozenset("button select datalist svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2"
    " h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Open elements that a new element ends: a paragraph ends at any block, items and cells at their like.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: A comment, a CDATA section, a declaration or a tag. Only a quote right behind an equals sign opens a quoted value, which
#: may hold >; one that is never closed is a letter like any other. Nothing is read twice from one place.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """path: names on the way to the block, tags and parts of class, id and role; linked: code points within links."""

    path: tuple[str, ...]
    text: str
    linked: int


def ended(page: str, name: str) -> set[int]:
    """Where the names of those start tags end that have an end tag; a button or select cannot hold another."""
    out: set[int] = set()
    waiting: list[int] = []
    for tag in re.finditer(rf"<(/?){name}(?=[\s/>])", page, re.I):
        if not tag[1]:
            if name in ("button", "select"):
                waiting.clear()
            waiting.append(tag.end())
        elif waiting:
            out.add(waiting.pop())
    return out


def blocks_of(page: str | None) -> list[Block]:
    """The page's text in order, cut where block elements begin or end; character references decoded, white space
    within a block as one space. Scripts, styles, form controls, comments and markup are no text. Elements left open
    end with their parents, a head at the first thing that cannot be in it; a page may stop anywhere."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    loose: list[int] = []  # places in the stack of unseen elements without an end tag
    with_end: dict[str, set[int]] = {}
    linked = links = unseen = at = 0
    last = page.rfind(">")

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Block(tuple(n for _, names in stack for n in names), text, linked))
        pieces.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and text.strip():
            leave(len(stack) - 1)
        if text and not unseen:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text)

    def leave(upto: int) -> None:
        nonlocal unseen, links
        for name, _ in stack[upto:]:
            unseen -= name in UNSEEN
        del stack[upto:]
        while loose and loose[-1] >= upto:
            loose.pop()

    while True:
        found = _TAG.search(page, at) if at <= last else None
        if not found:
            rest = page[at:]
            take(rest if "<" not in rest or not re.search(r"<[a-zA-Z/!]", rest) else rest[: re.search(r"<[a-zA-Z/!]", rest).start()])
            break
        take(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close()
                    leave(k)
                    break
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            leave(len(stack) - 1)
        if loose and (name in BLOCKS or name == stack[loose[0]][0]):
            close()
            leave(loose[0])
        if name == "br":
            pieces.append(" ")
            continue
        if name == "a":
            links = 1
        if name == "hr":
            close()
        if name in INLINE or name in EMPTY:
            continue
        close()
        links = 0
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == "p" or stack[k][0] in ENDS.get(name, ()):
                leave(k)
                break
            if name not in ENDS or stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead"):
                break
        if found[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        parts = [p for v in _NAMES.findall(found[3]) for p in _PART.findall(v.lower())] if "=" in found[3] else []
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*+>", re.I).search(page, at) if at <= last else None
            at = end.end() if end else len(page)
            continue
        unseen += name in UNSEEN
        if name in LOOSE:
            if name not in with_end:
                with_end[name] = ended(page, name)
            if found.end(2) not in with_end[name]:
                loose.append(len(stack))
        stack.append((name, (name, *parts)))
    close()
    return out
