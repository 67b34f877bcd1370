"""Tags and text of HTML in one pass, in time linear in the page whatever is broken in it.

An unclosed tag, comment or quote is given up once, not again at each `<` behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

TEXT, START, END, CDATA = range(4)

# Elements that HTML ends at nothing but their end tag or the end of the page.
TEXT_ONLY = frozenset("script style textarea title".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"[>\"']")


class Token(NamedTuple):
    """kind, tag name in lower case, and where its text or its attributes stand in the page; `to` is behind its `>`."""

    kind: int
    name: str
    begin: int
    end: int
    to: int


def tokens(page: str) -> Iterator[Token]:
    """Comments, declarations and processing instructions are left out; the content of TEXT_ONLY elements is one text."""
    at = text = 0
    n, closes, quotes = len(page), True, True
    while closes and (at := page.find("<", at)) >= 0:
        head = page[at + 1 : at + 2]
        if head in ("!", "?"):
            data = page.startswith("<![CDATA[", at)
            last = "]]>" if data else "-->" if page.startswith("<!--", at) else ">"
            to = page.find(last, at + (4 if last == "-->" else 1))
            stop = n if to < 0 else to
            if at > text:
                yield Token(TEXT, "", text, at, at)
            at, begin = (n if to < 0 else to + len(last)), at
            if data:
                yield Token(CDATA, "", begin + 9, max(stop, begin + 9), at)
            text = at
            continue
        slash = head == "/"
        m = _NAME.match(page, at + 1 + slash)
        if m is None:
            at += 1
            continue
        to = place = m.end()
        if quotes and not slash:
            # the next > outside of quotes; once quotes run to the end of the page, they no longer count
            while (q := _MARK.search(page, place)) and q[0] != ">":
                place = page.find(q[0], q.end()) + 1
                if not place:
                    q = None
                    break
            if q is None:
                quotes = False
            to = q.start() if q else page.find(">", m.end())
        else:
            to = page.find(">", m.end())
        if to < 0:
            closes = False
            break
        if at > text:
            yield Token(TEXT, "", text, at, at)
        name = m[0].lower()
        yield Token(END if slash else START, name, m.end(), to, to + 1)
        at = text = to + 1
        if not slash and name in TEXT_ONLY:
            end = re.compile(rf"</{name}(?![^\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                yield Token(TEXT, name, at, stop, stop)
            at = text = stop
    if text < n:
        yield Token(TEXT, "", text, n, n)


def self_closed(page: str, t: Token) -> bool:
    """Whether a start tag ends with a slash of its own, not one of an unquoted value."""
    inner = page[t.begin : t.end].rstrip()
    return inner.endswith("/") and (len(inner) == 1 or inner[-2] in " \t\n\f\r\"'")


def own_ends(page: str, found: list[Token], names: frozenset[str]) -> dict[int, int]:
    """For each start tag of these names, the place in `found` of its own end tag; those without one, and self-closed ones, are left out."""
    out: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for k, t in enumerate(found):
        if t.name not in names:
            continue
        if t.kind == START and not self_closed(page, t):
            open_.setdefault(t.name, []).append(k)
        elif t.kind == END and open_.get(t.name):
            out[open_[t.name].pop()] = k
    return out
