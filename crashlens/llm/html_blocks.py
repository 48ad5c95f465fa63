"""Leaf blocks of HTML pages: the text between block-level tags, with the open tags around it. Broken markup is taken as it comes."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Names of elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins del kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())  # fmt: skip
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())

#: Elements of raw text, which goes to their end tag or the end of the page, and those whose content is markup that is not shown.
RAW = frozenset("script style title textarea iframe".split())
HIDDEN = frozenset("svg template noscript".split())

# A quote opens a value only after "="; one that never closes is part of an unquoted value.
_ATTRIBUTES = r"(?:[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?|=)*+"
_MARKUP = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)",
    re.DOTALL,
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME_PART = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    path: tuple[str, ...]  # open tags, outermost first
    names: frozenset[str]  # parts of their classes, ids and roles
    text: str
    linked: int  # characters inside links


def _names(attributes: str) -> frozenset[str]:
    found = set()
    for values in _NAMED.findall(attributes):
        for part in _NAME_PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", "".join(values)).lower()):
            found.add(part[:-1] if len(part) > 3 and part.endswith("s") else part)
    return frozenset(found)


def _markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name (none for comments), whether it is an end tag, and attributes of all markup that counts.

    Raw text is part of its tag, and so is what a hidden element holds; one that is closed by itself or never ends at its own tag.
    """
    found, ends = [], {}
    open_at: dict[str, list[int]] = {tag: [] for tag in HIDDEN}
    place = 0
    while match := _MARKUP.search(page, place):
        place = match.end()
        tag, ending, attributes = (match[2] or "").lower(), bool(match[1]), match[3] or ""
        closed = attributes.endswith("/")
        if tag in RAW and not ending and not (closed and open_at["svg"]):
            end = _RAW_END[tag].search(page, place)
            place = end.end() if end else len(page)
            tag = ""
        elif tag in HIDDEN:
            if ending and open_at[tag]:
                ends[open_at[tag].pop()] = (len(found), place)
            elif not ending and not (closed and tag == "svg"):
                open_at[tag].append(len(found))
        found.append((match.start(), place, tag, ending, attributes))
    k = 0
    while k < len(found):
        start, end, tag, ending, attributes = found[k]
        if tag in HIDDEN:
            k, end = ends.get(k, (k, end))
            tag = ""
        yield start, end, tag, ending, attributes
        k += 1


def blocks(page: str) -> list[Block]:
    """Blocks with text in page order; character references decoded, white space made one space."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    linked, in_link, place = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                named = frozenset().union(*(names for _, names in stack))
                found.append(Block(tuple(tag for tag, _ in stack if tag not in INLINE), named, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def take(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    for start, end, tag, ending, attributes in _markup(page):
        take(page[place:start])
        place = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if ending else 1
            continue
        close()
        in_link = 0
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not attributes.endswith("/"):
            if stack and stack[-1][0] == tag and tag in CLOSES_ITSELF or stack and stack[-1][0] == "p":
                stack.pop()
            stack.append((tag, _names(attributes) if attributes else frozenset()))
    take(page[place:])
    close()
    return found
