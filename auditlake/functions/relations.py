"""What a page's elements have to do with each other, worked out in one pass over them: labels, owners, outlines, lists, tools."""

from __future__ import annotations

import json
from typing import NamedTuple

from auditlake.functions.html import Element

#: Fixed value: the white space that browsers trim, which Python's and Java's classes lack or exceed in part.
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
EXCLUDED_TYPES = ("hidden", "submit", "button", "reset", "image")
LEVELS = {f"h{i}": i for i in range(1, 7)}


class Related(NamedTuple):
    """Null where a kind of element has no such relation.

    ``items``: li elements right below a list. ``before``: level of the heading before a heading. ``control``: (label, named,
    name, owner, submits, said) of a form control: its label's text, whether a label is there, its accessible name, the place of its
    owning form, whether that form has a submit, and what a tool would say of it. ``form_facts``: (index, heading, legend, submit, controls, searches, told, untold,
    nameless) of a form: its number among forms, the last h1 to h3 with text before it, texts of its first legend and submit, and counts of its controls.
    ``ld``: (valid, known, types) of a block of linked data.
    """

    items: int | None = None
    before: int | None = None
    control: dict | None = None
    form_facts: dict | None = None
    ld: dict | None = None


def trimmed(e: Element, name: str) -> str:
    return e.attrs.get(name, "").strip(BLANKS)


def kind_of(e: Element) -> str:
    return e.attrs.get("type", "text").lower()


def is_control(e: Element) -> bool:
    return e.tag in ("textarea", "select") or (e.tag == "input" and kind_of(e) not in EXCLUDED_TYPES)


def sends(e: Element) -> bool:
    if e.tag == "button":
        return e.attrs.get("type", "submit").lower() == "submit"
    return e.tag == "input" and e.attrs.get("type", "").lower() in ("submit", "image")


def related(found: list[Element]) -> list[Related]:
    """One row for each element; linear in their number and in the lengths of label references."""
    by_id: dict[str, Element] = {}
    labels: dict[str, Element] = {}
    forms: dict[str, Element] = {}
    items: dict[int, int] = {}
    submits: dict[int, list[Element]] = {}
    legends: dict[int, str] = {}
    for e in found:
        if "id" in e.attrs:
            by_id.setdefault(e.attrs["id"], e)
            if e.tag == "form":
                forms.setdefault(e.attrs["id"], e)
        if e.tag == "label" and "for" in e.attrs:
            labels.setdefault(e.attrs["for"], e)
        if e.tag == "li" and e.parent is not None:
            items[e.parent] = items.get(e.parent, 0) + 1
        if e.form is not None and sends(e):
            submits.setdefault(e.form, []).append(e)
        if e.form is not None and e.tag == "legend":
            legends.setdefault(e.form, e.text or "")
    controls: dict[int, list[Element]] = {}
    out: list[Related] = []
    level, heading, number = None, "", 0
    facts: dict[int, dict] = {}
    for e in found:
        r = Related()
        if e.tag in LEVELS:
            r, level = Related(before=level), LEVELS[e.tag]
            if level <= 3 and e.text:
                heading = e.text
        elif e.tag in ("ul", "ol"):
            r = Related(items=items.get(e.pre, 0))
        elif e.tag == "form":
            facts[e.pre] = {"index": number, "heading": heading, "legend": legends.get(e.pre, ""), "submit": submit_text(submits.get(e.pre, []))}
            number += 1
            r = Related(form_facts=facts[e.pre])
        elif e.tag == "script" and e.attrs.get("type", "").lower() == "application/ld+json":
            r = Related(ld=dict(zip(("valid", "known", "types"), block_types(e.text))))
        elif is_control(e):
            r = Related(control=control_facts(e, found, by_id, labels, forms, submits))
            if e.form is not None:
                controls.setdefault(e.form, []).append(e)
        out.append(r)
    for pre, f in facts.items():
        own = controls.get(pre, [])
        told = sum(bool(trimmed(c, "toolparamdescription")) for c in own)
        f |= {"controls": len(own), "searches": sum(c.attrs.get("type", "").lower() == "search" for c in own), "told": told, "untold": len(own) - told}
        f["nameless"] = sum("required" in c.attrs and not trimmed(c, "name") for c in own)
    return out


def submit_text(senders: list[Element]) -> str:
    """The first text of a submit button, else the first value of a submit input."""
    said = [e.text or "" for e in senders if e.tag == "button"] + [trimmed(e, "value") for e in senders if e.tag == "input" and e.attrs.get("type", "").lower() == "submit"]
    return next((x for x in said if x), "")


def control_facts(e: Element, found: list[Element], by_id: dict[str, Element], labels: dict[str, Element], forms: dict[str, Element], submits: dict[int, list[Element]]) -> dict:
    """A label that names the control's id comes before one around it; the first in document order counts, even an empty one. A
    ``form`` attribute decides alone; without it the outermost form around the control owns it."""
    named = labels.get(e.attrs["id"]) if e.attrs.get("id") else None
    around = found[e.label] if e.label is not None else None
    label = (named or around)
    text = (label.text or "") if label is not None else ""
    referred = [by_id[t].text or "" for t in trimmed(e, "aria-labelledby").split() if t in by_id]
    name = trimmed(e, "aria-label") or " ".join(t for t in referred if t) or text or trimmed(e, "title") or None
    owner = forms.get(e.attrs["form"]) if e.attrs.get("form") else None
    place = (owner.pre if owner else None) if e.attrs.get("form") else e.form
    said = (named.text if named else "") or (around.text if around else "") or trimmed(e, "aria-label") or trimmed(e, "placeholder")
    return {"label": text, "name": name, "owner": place, "submits": place is not None and place in submits, "said": said}


# ---- linked data --------------------------------------------------------------------------------------------------


def in_schema_context(context: object) -> bool:
    parts = [context]
    while parts:
        x = parts.pop()
        if isinstance(x, str) and "schema.org" in x.lower():
            return True
        parts += x if isinstance(x, list) else x.values() if isinstance(x, dict) else []
    return False


def refuse(constant: str) -> None:
    raise ValueError(constant)


def block_types(text: str | None) -> tuple[bool, bool, list[str]]:
    """(valid, under a schema.org context, types) of a JSON-LD block; contexts are inherited through ``@graph`` only."""
    try:
        root = json.loads(text or "", parse_constant=refuse)
    except (ValueError, RecursionError):
        return False, False, []
    if not isinstance(root, (dict, list)):
        return False, False, []
    types: list[str] = []
    known, todo = False, [(root, False)]
    while todo:
        node, inherited = todo.pop()
        if isinstance(node, list):
            todo += [(n, inherited) for n in reversed(node)]
        elif isinstance(node, dict):
            inside = inherited or in_schema_context(node.get("@context"))
            known |= inside
            named = node.get("@type")
            if inside:
                types += [t.strip() for t in (named if isinstance(named, list) else [named]) if isinstance(t, str) and t.strip()]
            if isinstance(node.get("@graph"), list):
                todo.append((node["@graph"], inside))
    return True, known, types
