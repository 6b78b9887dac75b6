"""Tree construction as HTML defines it: implied elements, misnested formatting, text and elements that tables put before themselves."""

from __future__ import annotations

from collections import Counter

# Fixed values of HTML: groups of elements that its parser treats alike.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset(
    """address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption
    figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p
    param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp""".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
BUTTON_SCOPE, LIST_SCOPE, TABLE_SCOPE = SCOPE | {"button"}, SCOPE | {"ol", "ul"}, frozenset("html table template".split())
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul
    pre listing form h1 h2 h3 h4 h5 h6 table hr xmp plaintext li dd dt""".split()
)
BLOCK_ENDS = CLOSES_P - HEADINGS - frozenset("p form table hr xmp plaintext li dd dt".split()) | {"button"}
IMPLIED = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
THOROUGHLY = IMPLIED | frozenset("caption colgroup tbody td tfoot th thead tr".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
ROWS, CELLS, SECTIONS = frozenset(["tr"]), frozenset(["td", "th"]), frozenset(["tbody", "thead", "tfoot"])
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
FOSTERING = frozenset("table tbody tfoot thead tr".split())
BREAKOUT = frozenset(
    """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup
    table tt u ul var""".split()
)
TEXT_POINTS = frozenset("mi mo mn ms mtext".split())
HTML_POINTS = frozenset("foreignobject desc title".split())
MOST_REOPENED = 50_000  # formatting elements carried on in one page; beyond, formatting ends where its parent does


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "foreign")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: bool = False):
        self.tag, self.attrs, self.parent, self.foreign = tag, attrs, None, foreign
        self.children: list[Node | str] = []


class Builder:
    """Takes tokens in their order; ``root`` holds the tree. Searches of the open elements stop early by counts of open tags."""

    def __init__(self, quirks: bool):
        self.root = Node("#document", {})
        self.open: list[Node] = []
        self.count: Counter[str] = Counter()
        self.marks: list[Node | None] = []  # formatting elements to carry on, None where a cell or the like begins
        self.head: Node | None = None
        self.form: Node | None = None
        self.mode, self.quirks, self.fostering, self.reopened = "before", quirks, False, 0
        self.frames_ok = True

    # ---- the tree and the open elements

    @property
    def top(self) -> Node:
        return self.open[-1] if self.open else self.root

    def place(self) -> tuple[Node, int | None]:
        """Where the next node goes: at the end of the current element, or before the table that can't hold it."""
        if self.fostering and self.top.tag in FOSTERING:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag == "template":
                    return self.open[i], None
                if self.open[i].tag == "table":
                    table = self.open[i]
                    if table.parent is not None:
                        return table.parent, len(table.parent.children) - 1 - table.parent.children[::-1].index(table)
                    return self.open[i - 1], None
        return self.top, None

    def put(self, node: Node | str, where: tuple[Node, int | None] | None = None) -> None:
        parent, at = where or self.place()
        if isinstance(node, Node):
            node.parent = parent
        if at is None:
            parent.children.append(node)
        else:
            parent.children.insert(at, node)

    def add(self, tag: str, attrs: dict[str, str], foreign: bool = False) -> Node:
        node = Node(tag, attrs, foreign)
        self.put(node)
        self.push(node)
        return node

    def push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.tag] += 1

    def pop(self) -> Node:
        node = self.open.pop()
        self.count[node.tag] -= 1
        return node

    def drop(self, node: Node) -> None:
        self.open.remove(node)
        self.count[node.tag] -= 1

    def pop_to(self, tags: frozenset[str]) -> None:
        while self.open and self.pop().tag not in tags:
            pass

    def clear_to(self, tags: frozenset[str]) -> None:
        while len(self.open) > 1 and self.top.tag not in tags:
            self.pop()

    def within(self, tags: frozenset[str], walls: frozenset[str] = SCOPE) -> bool:
        if not any(self.count[t] for t in tags):
            return False
        for node in reversed(self.open):
            if node.tag in tags and not node.foreign:
                return True
            if node.tag in walls or (node.foreign and node.tag in (TEXT_POINTS | HTML_POINTS)):
                return False
        return False

    def implied(self, but: str = "", tags: frozenset[str] = IMPLIED) -> None:
        while self.top.tag in tags and self.top.tag != but:
            self.pop()

    def end_p(self) -> None:
        if self.count["p"] and self.within(frozenset(["p"]), BUTTON_SCOPE):
            self.implied("p")
            self.pop_to(frozenset(["p"]))

    # ---- formatting that is carried on

    def mark(self, node: Node) -> None:
        same = []
        for m in reversed(self.marks):
            if m is None:
                break
            if m.tag == node.tag and m.attrs == node.attrs:
                same.append(m)
        if len(same) >= 3:
            self.marks.remove(same[-1])
        self.marks.append(node)

    def unmark(self) -> None:
        while self.marks and self.marks.pop() is not None:
            pass

    def reopen(self) -> None:
        """Formatting that ended with an element around it goes on in this one."""
        if not self.marks or self.marks[-1] is None or self.marks[-1] in self.open[-len(self.marks) - 64 :]:
            return
        i = len(self.marks)
        while i and self.marks[i - 1] is not None and self.marks[i - 1] not in self.open:
            i -= 1
        for j in range(i, len(self.marks)):
            if self.reopened >= MOST_REOPENED:
                self.marks.clear()
                return
            self.reopened += 1
            self.marks[j] = self.add(self.marks[j].tag, dict(self.marks[j].attrs))

    def marked(self, tag: str) -> Node | None:
        for m in reversed(self.marks):
            if m is None:
                return None
            if m.tag == tag:
                return m
        return None

    def adopt(self, tag: str) -> None:
        """An end tag of formatting: what it holds beyond its end gets a formatting element of its own."""
        if self.top.tag == tag and self.top not in self.marks:
            self.pop()
            return
        for _ in range(8):
            fmt = self.marked(tag)
            if fmt is None:
                self.end_other(tag)
                return
            if fmt not in self.open:
                self.marks.remove(fmt)
                return
            if not self.within(frozenset([tag])):
                return
            at = self.open.index(fmt)
            block = next((i for i in range(at + 1, len(self.open)) if self.open[i].tag in SPECIAL), None)
            if block is None:
                while self.pop() is not fmt:
                    pass
                self.marks.remove(fmt)
                return
            furthest, above = self.open[block], self.open[at - 1]
            spot, last, i, steps = self.marks.index(fmt), furthest, block, 0
            while True:
                i, steps = i - 1, steps + 1
                node = self.open[i]
                if node is fmt:
                    break
                if steps > 3 and node in self.marks:
                    spot -= self.marks.index(node) < spot
                    self.marks.remove(node)
                if node not in self.marks:
                    self.drop(node)
                    continue
                copy = Node(node.tag, dict(node.attrs))
                self.marks[self.marks.index(node)] = self.open[i] = copy
                if last is furthest:
                    spot = self.marks.index(copy) + 1
                self.move(last, copy)
                last = copy
            self.detach(last)
            was, self.fostering = self.fostering, above.tag in FOSTERING
            tail, self.open = self.open[self.open.index(above) + 1 :], self.open[: self.open.index(above) + 1]
            where = self.place()
            self.open += tail
            self.fostering = was
            self.put(last, where)
            copy = Node(fmt.tag, dict(fmt.attrs))
            for child in furthest.children:
                if isinstance(child, Node):
                    child.parent = copy
            copy.children, furthest.children = furthest.children, []
            self.put(copy, (furthest, None))
            spot -= self.marks.index(fmt) < spot
            self.marks.remove(fmt)
            self.marks.insert(spot, copy)
            self.drop(fmt)
            self.open.insert(self.open.index(furthest) + 1, copy)
            self.count[copy.tag] += 1

    def detach(self, node: Node) -> None:
        if node.parent is not None:
            siblings = node.parent.children
            del siblings[len(siblings) - 1 - siblings[::-1].index(node)]
            node.parent = None

    def move(self, node: Node, to: Node) -> None:
        self.detach(node)
        self.put(node, (to, None))

    # ---- tokens

    def frame(self) -> None:
        """The elements that every page has, where its tags leave them out."""
        if not self.open:
            self.add("html", {})
        if self.head is None:
            self.head = self.add("head", {})
            self.pop()
        if not self.count["body"] and not self.count["frameset"] and self.mode in ("before", "head", "after head"):
            self.add("body", {})
            self.mode = "body"

    def foreign(self) -> bool:
        t = self.top
        return t.foreign and not (t.tag in TEXT_POINTS or t.tag in HTML_POINTS)

    def text(self, text: str) -> None:
        if self.mode in ("before", "head", "after head") and not self.count["template"]:
            blank = len(text) - len(text.lstrip("\t\n\x0c\r "))
            if self.mode != "before" and blank and self.open:
                self.put(text[:blank])
            text = text[blank:]
            if not text:
                return
            self.leave_head()
            self.frame()
        if self.mode == "frames" or not text:
            return
        if self.foreign():
            self.put(text)
        elif self.top.tag in FOSTERING and text.strip("\t\n\x0c\r "):
            self.fostering = True
            self.reopen()
            self.put(text)
            self.fostering = False
        elif self.top.tag == "colgroup" and text.strip("\t\n\x0c\r "):
            self.pop()
            self.text(text)
        else:
            if self.top.tag not in FOSTERING and not self.count["select"]:
                self.reopen()
            self.put(text)

    def leave_head(self) -> None:
        while self.top.tag in ("head", "noscript") and self.mode == "head":
            self.pop()
        if self.mode == "head":
            self.mode = "after head"

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> bool:
        """Whether an element was made of the tag and is open."""
        tag = "img" if tag == "image" and not self.foreign() else tag
        if self.foreign():
            font = tag == "font" and any(a in attrs for a in ("color", "face", "size"))
            if tag not in BREAKOUT and not font:
                self.add(tag, attrs, True)
                if closed:
                    self.pop()
                return not closed
            while self.foreign():
                self.pop()
        if tag == "html":
            root = self.open[0] if self.open else self.add("html", {})
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            return False
        if tag == "body" and (self.count["body"] or self.mode == "frames"):
            for k, v in attrs.items() if self.count["body"] else ():
                self.open[1].attrs.setdefault(k, v)
            return False
        if self.mode in ("before", "head", "after head") and not self.count["template"]:
            return self.start_outside(tag, attrs)
        if self.mode == "frames":
            if tag in ("frameset", "frame"):
                self.add(tag, attrs)
                if tag == "frame":
                    self.pop()
                return tag != "frame"
            return False
        if tag in ("head", "frameset", "frame") and not self.count["template"]:
            return False
        if self.count["select"] and self.within(frozenset(["select"])):
            if tag in ("input", "keygen", "textarea", "select") or (tag in TABLE_PARTS | {"table"} and self.count["table"]):
                self.pop_to(frozenset(["select"]))
                return tag != "select" and self.start(tag, attrs, closed)
            if tag in ("option", "optgroup", "hr"):
                for inner in ("option", "optgroup") if tag != "option" else ("option",):
                    if self.top.tag == inner:
                        self.pop()
                return self.made(tag, attrs)
            return tag in ("script", "template") and self.made(tag, attrs)
        if self.top.tag in FOSTERING | {"colgroup", "caption"} or (tag in TABLE_PARTS and self.count["table"]):
            done = self.start_in_table(tag, attrs)
            if done is not None:
                return done
            if self.top.tag in FOSTERING:
                self.fostering = True
                made = self.start_in_body(tag, attrs, closed)
                self.fostering = False
                return made
        return self.start_in_body(tag, attrs, closed)

    def made(self, tag: str, attrs: dict[str, str]) -> bool:
        self.add(tag, attrs)
        if tag in VOID:
            self.pop()
            return False
        return True

    def start_outside(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag == "head":
            if self.head is None:
                if not self.open:
                    self.add("html", {})
                self.head, self.mode = self.add("head", attrs), "head"
            return False
        if tag in HEAD_ONLY or (tag == "noscript" and self.mode != "after head"):
            if not self.open:
                self.add("html", {})
            if self.head is None:
                self.head, self.mode = self.add("head", {}), "head"
            if self.mode == "after head":  # back into the head for this one
                self.push(self.head)
                made = self.made(tag, attrs)
                self.drop(self.head)
                return made
            self.mode = "head"
            return self.made(tag, attrs)
        self.leave_head()
        if tag == "frameset":
            if not self.open:
                self.add("html", {})
            if self.head is None:
                self.head = self.add("head", {})
                self.pop()
            self.add(tag, attrs)
            self.mode = "frames"
            return True
        if tag == "body":
            if not self.open:
                self.add("html", {})
            if self.head is None:
                self.head = self.add("head", {})
                self.pop()
            self.add("body", attrs)
            self.mode = "body"
            return True
        self.frame()
        return self.start(tag, attrs)

    def start_in_table(self, tag: str, attrs: dict[str, str]) -> bool | None:
        """What a table's own parts do; null for what is no part of a table."""
        if self.within(CELLS, TABLE_SCOPE) and tag in TABLE_PARTS:
            self.end_cell()
            return self.start(tag, attrs)
        if self.within(frozenset(["caption"]), TABLE_SCOPE) and tag in TABLE_PARTS:
            self.end("caption")
            return self.start(tag, attrs)
        if self.top.tag == "caption" or not self.within(frozenset(["table"]), TABLE_SCOPE):
            if tag in TABLE_PARTS and self.count["template"] and self.top.tag in FOSTERING | {"template"}:
                return self.made(tag, attrs)  # a template's rows and cells need no table
            return False if tag in TABLE_PARTS and not self.count["template"] else None
        if self.top.tag == "colgroup":
            if tag == "col":
                return self.made(tag, attrs)
            if tag == "template":
                return self.made(tag, attrs)
            self.pop()
            return self.start(tag, attrs)
        if tag in TABLE_PARTS and not (self.top.tag in FOSTERING or self.top.tag == "template"):
            self.clear_to(FOSTERING | {"template", "html"})
        if tag == "table":
            self.end("table")
            return self.start(tag, attrs)
        if tag in ("style", "script", "template"):
            return self.made(tag, attrs)
        if tag == "input" and attrs.get("type", "").lower() == "hidden":
            return self.made(tag, attrs)
        if tag == "form":
            if self.form is None and not self.count["template"]:
                self.form = self.add(tag, attrs)
                self.pop()
            return False
        if tag in ("caption", "colgroup", "col") or tag in SECTIONS:
            self.clear_to(TABLE_SCOPE)
            if tag == "caption":
                self.marks.append(None)
            if tag == "col":
                self.add("colgroup", {})
            return self.made(tag, attrs)
        if tag in ROWS | CELLS:
            if self.top.tag == "table":
                self.add("tbody", {})
            if tag in ROWS:
                self.clear_to(SECTIONS | {"template", "html"})
                return self.made(tag, attrs)
            if self.top.tag in SECTIONS:
                self.add("tr", {})
            self.clear_to(ROWS | {"template", "html"})
            self.marks.append(None)
            return self.made(tag, attrs)
        return None

    def end_cell(self) -> None:
        self.implied()
        self.pop_to(CELLS)
        self.unmark()

    def start_in_body(self, tag: str, attrs: dict[str, str], closed: bool) -> bool:
        if tag in HEAD_ONLY:
            if tag == "template":
                self.marks.append(None)
            return self.made(tag, attrs)
        if tag == "form" and self.form is not None and not self.count["template"]:
            return False
        if tag in ("li", "dd", "dt"):
            mates = frozenset(["li"]) if tag == "li" else frozenset(["dd", "dt"])
            if any(self.count[t] for t in mates):
                for node in reversed(self.open):
                    if node.tag in mates:
                        self.implied(node.tag)
                        self.pop_to(frozenset([node.tag]))
                        break
                    if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                        break
        if tag in CLOSES_P and not (tag == "table" and self.quirks):
            self.end_p()
        if tag in HEADINGS and self.top.tag in HEADINGS:
            self.pop()
        if tag == "form":
            node = self.add(tag, attrs)
            self.form = node if not self.count["template"] else self.form
            return True
        if tag == "button" and self.within(frozenset(["button"])):
            self.implied()
            self.pop_to(frozenset(["button"]))
        if tag in ("optgroup", "option") and self.top.tag == "option":
            self.pop()
        if tag in ("rb", "rtc", "rp", "rt") and self.within(frozenset(["ruby"])):
            self.implied("" if tag in ("rb", "rtc") else "rtc")
        if tag in TABLE_PARTS:
            return self.top.tag == "template" and self.made(tag, attrs)
        if tag == "a" and (old := self.marked("a")) is not None:
            self.adopt("a")
            if old in self.marks:
                self.marks.remove(old)
            if old in self.open:
                self.drop(old)
        if tag == "nobr":
            self.reopen()
            if self.within(frozenset(["nobr"])):
                self.adopt("nobr")
        if tag not in CLOSES_P and tag not in ("optgroup", "param", "source", "track", "textarea", "iframe", "noembed", "noscript", "rb", "rtc", "rp", "rt"):
            self.reopen()
        if tag in ("svg", "math"):
            self.add(tag, attrs, True)
            if closed:
                self.pop()
            return not closed
        made = self.made(tag, attrs)
        if tag in FORMATTING:
            self.mark(self.top)
        elif tag in ("applet", "marquee", "object"):
            self.marks.append(None)
        return made

    def end(self, tag: str) -> None:
        if self.top.foreign and tag not in ("p", "br"):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    while len(self.open) > i:
                        self.pop()
                    return
                if not self.open[i - 1].foreign:
                    break
        if self.mode in ("before", "head", "after head") and not self.count["template"]:
            if tag == "head" and self.mode == "head":
                self.leave_head()
            elif tag in ("noscript", "template", "script", "style", "title", "noframes") and self.top.tag == tag:
                self.pop()
            elif tag in ("body", "html", "br"):
                self.leave_head()
                self.frame()
                if tag == "br":
                    self.end(tag)
            return
        if self.mode == "frames":
            if tag == "frameset" and self.top.tag == tag and len(self.open) > 1:
                self.pop()
            return
        if tag in ("body", "html", "head"):
            return
        if tag == "br":
            self.start("br", {})
        elif tag == "p":
            if not self.within(frozenset(["p"]), BUTTON_SCOPE):
                self.start("p", {})
            self.end_p()
        elif tag == "template":
            if self.count[tag]:
                self.implied(tags=THOROUGHLY)
                self.pop_to(frozenset([tag]))
                self.unmark()
        elif tag in CELLS:
            if self.within(frozenset([tag]), TABLE_SCOPE):
                self.implied()
                self.pop_to(frozenset([tag]))
                self.unmark()
        elif tag == "caption":
            if self.within(frozenset([tag]), TABLE_SCOPE):
                self.implied()
                self.pop_to(frozenset([tag]))
                self.unmark()
        elif tag in ROWS | SECTIONS | {"table"}:
            if self.within(frozenset([tag]), TABLE_SCOPE):
                if self.within(CELLS, TABLE_SCOPE):
                    self.end_cell()
                if self.within(frozenset(["caption"]), TABLE_SCOPE):
                    self.end("caption")
                self.pop_to(frozenset([tag]))
        elif tag == "colgroup":
            if self.top.tag == tag:
                self.pop()
        elif tag == "form":
            node = self.form
            if self.count["template"]:
                node = next((n for n in reversed(self.open) if n.tag == "form"), None)
            else:
                self.form = None
            if node is not None and node in self.open and self.within(frozenset(["form"])):
                self.implied()
                self.drop(node)
        elif tag in ("li", "dd", "dt"):
            if self.within(frozenset([tag]), LIST_SCOPE if tag == "li" else SCOPE):
                self.implied(tag)
                self.pop_to(frozenset([tag]))
        elif tag in HEADINGS:
            if self.within(HEADINGS):
                self.implied()
                self.pop_to(HEADINGS)
        elif tag in BLOCK_ENDS:
            if self.within(frozenset([tag])):
                self.implied()
                self.pop_to(frozenset([tag]))
        elif tag in ("applet", "marquee", "object"):
            if self.within(frozenset([tag])):
                self.implied()
                self.pop_to(frozenset([tag]))
                self.unmark()
        elif tag == "select":
            if self.within(frozenset([tag])):
                self.pop_to(frozenset([tag]))
        elif tag in FORMATTING:
            self.adopt(tag)
        else:
            self.end_other(tag)

    def end_other(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.implied(tag)
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i].tag in SPECIAL:
                return

    def finish(self) -> Node:
        self.leave_head()
        self.frame()
        return self.root
