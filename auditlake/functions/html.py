"""A tolerant reader of one page's markup into rows of elements; never raises on hostile markup, linear in its length."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

from auditlake.functions.htmltree import Builder, Node

VALUE = r"""=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?"""
#: A tag, or a comment, or another declaration; each runs to the end of the page where it isn't closed.
TOKEN = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{VALUE})*+)(>|\Z)|<!--(?:-?>|.*?(?:-->|\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
#: What makes a page one of the standard's mode; others let a table stand in a paragraph.
DOCTYPE = re.compile(r"(?:\s|\ufeff|<!--(?:-?>|.*?-->))*<!doctype\s+html", re.I | re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
# Fixed values of HTML: elements with raw text, and with text and references.
RAW = frozenset("script style iframe noembed noframes noscript xmp plaintext".split())
PLAIN = frozenset("title textarea".split())
#: Elements whose text is kept, beside those with one of these attributes.
WITH_TEXT = frozenset("a button h1 h2 h3 h4 h5 h6 label legend noscript option script summary textarea title".split())
TEXT_ATTRIBUTES = ("data-reactroot", "id", "onclick", "role", "tabindex")
#: Elements whose content is no text of the body.
UNSEEN = frozenset("head noscript script style svg template title".split())
PATH_PARTS = 6


class Element(NamedTuple):
    """``pre``: place in document order; ``last``: the largest place inside; ``form`` and ``label``: the outermost ones around it.

    ``path``: up to PATH_PARTS tags from the element up, the nearest id ending it; among siblings of its tag an element
    is told by its number. ``html`` and ``body`` are left out.
    """

    pre: int
    last: int
    depth: int
    parent: int | None
    tag: str
    attrs: dict[str, str]
    text: str | None
    form: int | None
    label: int | None
    alt_inside: bool
    path: str = ""


def attributes(raw: str) -> dict[str, str]:
    """Lower-cased names to values with references resolved; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        out.setdefault(m[1].lower(), unescape(value))
    return out


def elements(page: str | None) -> list[Element]:
    """All elements in document order. Null and empty pages have none."""
    return read(page)[0]


def with_paths(found: list[Element]) -> list[Element]:
    siblings: dict[tuple[int | None, str], int] = {}
    number = []
    for e in found:
        n = siblings[e.parent, e.tag] = siblings.get((e.parent, e.tag), 0) + 1
        number.append(n)
    parts: list[list[str]] = []
    for e, n in zip(found, number):
        if e.tag in ("html", "body"):
            parts.append([])
        elif e.attrs.get("id"):
            parts.append([f"{e.tag}#{e.attrs['id']}"])
        else:
            own = e.tag + (f":nth-of-type({n})" if siblings[e.parent, e.tag] > 1 else "")
            parts.append([*(parts[e.parent][1 - PATH_PARTS :] if e.parent is not None else []), own])
    return [e._replace(path=" > ".join(p)) for e, p in zip(found, parts)]


def tree(page: str) -> Node:
    """The page's tree, under a root that is no element itself; tokens are read here, and placed by ``htmltree``."""
    builder = Builder(quirks=DOCTYPE.match(page) is None)
    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            builder.text(unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            builder.end(tag)
            continue
        open_ = builder.start(tag, attributes(m[3]), m[3].endswith("/"))
        if tag in ("pre", "listing", "textarea") and page[at : at + 1] == "\n":
            at += 1
        if open_ and (tag in RAW or tag in PLAIN) and builder.top.tag == tag and not builder.top.foreign:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at) if tag != "plaintext" else None
            stop = end.start() if end else len(page)
            if stop > at:
                builder.top.children.append(page[at:stop] if tag in RAW else unescape(page[at:stop]))
            at = stop
    if at < len(page):
        builder.text(unescape(page[at:]))
    return builder.finish()


def read(page: str | None) -> tuple[list[Element], str]:
    """All elements in document order, and the body's text without scripts, styles and the like, each of which parts the words around it.

    The tree is the one that browsers build: html, head, body and tbody are there where tags leave them out, misnested
    formatting goes on in the next element, and a table puts what it can't hold before itself. Content of ``noscript`` is
    text. Null and empty pages have no elements.
    """
    if not page:
        return [], ""
    done: list[Element | None] = []
    pieces: list[str] = []
    body: list[str] = []
    #: Open elements: (node, next child, place, form, label, unseen, first piece, an image's text inside)
    stack: list[list] = []

    def enter(node: Node) -> None:
        above = stack[-1] if stack else None
        form = above[3] if above and above[3] is not None else len(done) if node.tag == "form" else None
        label = above[4] if above and above[4] is not None else len(done) if node.tag == "label" else None
        unseen = bool(above and above[5]) or node.tag in UNSEEN
        if unseen and not (above and above[5]):
            body.append(" ")
        stack.append([node, 0, len(done), form, label, unseen, len(pieces), node.tag == "img" and bool(node.attrs.get("alt", "").strip())])
        done.append(None)

    def leave() -> None:
        node, _, pre, form, label, _, piece, alt = stack.pop()
        text = None
        if node.tag in WITH_TEXT or any(a in node.attrs for a in TEXT_ATTRIBUTES):
            text = " ".join("".join(pieces[piece:]).split())
        if alt and stack:
            stack[-1][7] = True
        done[pre] = Element(pre, len(done) - 1, len(stack), stack[-1][2] if stack else None, node.tag, node.attrs, text, form, label, alt)

    for top in tree(page).children:
        if not isinstance(top, Node):
            continue
        enter(top)
        while stack:
            here = stack[-1]
            if here[1] == len(here[0].children):
                leave()
                continue
            child = here[0].children[here[1]]
            here[1] += 1
            if isinstance(child, Node):
                enter(child)
            else:
                pieces.append(child)
                if not here[5]:
                    body.append(child)
    return with_paths([e for e in done if e is not None]), " ".join("".join(body).split())
