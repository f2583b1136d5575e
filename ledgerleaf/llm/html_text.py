"""HTML to text by a small tree builder and a layout-aware renderer.

The builder makes a tree as browsers do in outline: void elements, raw text,
end tags that start tags imply (p, li, dt, dd, options, table parts), missing
table parts, scopes that end tags don't reach out of.  The renderer emits all
visible text: blocks are parted by blank lines, list items get bullets or
numbers and indents, cells of a table are aligned in columns, preformatted text
keeps its blanks.  Invisible are elements that are never shown, those hidden by
attribute or style, and those that a simple selector in a style sheet hides for
any screen, if no later or more specific rule, simple or not, could show them.

Both walk with explicit stacks and look at each character a bounded number of
times, so deep or broken markup takes linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.common import bound_batches, dealt

# Element names of HTML by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Raw elements whose text is text with entities.
ESCAPABLE = frozenset(("textarea", "title"))
NEVER_SHOWN = frozenset("head title meta link base script style template noscript noembed noframes iframe object embed applet canvas audio video datalist map area param source track rp".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p pre search section summary table ul xmp plaintext".split())
#: Blocks with an empty line around them; other blocks begin a new line.
SPACED = frozenset("article aside blockquote dl fieldset figure footer h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul menu dir form listing xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul li dd dt xmp plaintext".split())
SCOPE = frozenset("applet button caption html marquee object table td th template select".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "rt": ("rt", "rp"), "rp": ("rt", "rp")}
#: What an li, dt or dd must not be closed through.
LIST_BARRIER = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "option": frozenset(("select", "datalist")), "optgroup": frozenset(("select", "datalist"))}
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())

#: A cell wider than this doesn't widen its column, and one spans no more columns or rows than this: its text is whole.
WIDEST_COLUMN = 40
MOST_SPAN = 100
#: Elements nested deeper than this are put beside the deepest one, as browsers do.
DEEPEST = 512

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]+")
_CSS_NOISE = re.compile(r"/\*.*?(?:\*/|$)|\"[^\"\n]*\"|'[^'\n]*'", re.S)
_CSS_BRACKETS = re.compile(r"\[[^\]]*\]|\([^()]*\)")
_ANY_SCREEN = re.compile(r"\s*(?:only\s+)?(?:all|screen)?\s*$", re.I)
#: A selector that holds only while a visitor does something, or for a part that is not an element.
_NOT_AT_REST = re.compile(r"::|:(?:hover|focus|active|target|checked|before|after|first-l)", re.I)
_HIDING = {"display": re.compile("none$"), "visibility": re.compile("(?:hidden|collapse)$"), "opacity": re.compile(r"0(?:\.0*)?$"), "font-size": re.compile("0(?:px|em|pt|%)?$")}
#: Properties that children inherit and may undo; a size in parts of nothing is still nothing.
_INHERITED = ("visibility", "font-size")
_OF_PARENT = re.compile(r"(?:[\d.]+(?:em|ex|ch|%)|inherit|smaller|larger|unset)\s*$")
_ABSOLUTE = "font-size, absolute"
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?$", re.I)
_BLANKS = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Sheet:
    """Rules of style sheets that hide or show; a weight is (important, ids, classes, names, place)."""

    def __init__(self):
        #: Weight by property, by simple selector.
        self.hides: dict[str, dict[str, tuple]] = {}
        #: What the last part of a selector needs, property and weight, by one of the needs.
        self.shows: dict[str, list[tuple[frozenset, str, tuple]]] = {}
        self.place = 0

    def __bool__(self) -> bool:
        return bool(self.hides)

    def add(self, css: str, media: str = "") -> None:
        css = _CSS_NOISE.sub(" ", css)
        #: For each open brace, whether rules in it hold (2), may hold and so may show (1), or don't (0).
        holds, at, selectors = [_any_screen(media)], 0, None
        for m in re.finditer(r"[{}]", css):
            said, at = css[at : m.start()], m.end()
            if m.group() == "{":
                said = said.rpartition(";")[2].strip()
                name = (re.match(r"@[\w-]+", said) or [""])[0].lower()
                inner = _any_screen(said[6:]) if name == "@media" else 1 if selectors is not None or name in ("@supports", "@container", "@scope") else 0 if name not in ("", "@layer") else 2
                holds.append(min(holds[-1], inner))
                selectors = None if name else said
            else:
                if selectors and holds[-1]:
                    self._rule(selectors, said, holds[-1] == 2)
                selectors = None
                if len(holds) > 1:
                    holds.pop()

    def _rule(self, selectors: str, body: str, holds: bool) -> None:
        found, relative = {}, False
        for name, value, important in _declared(body):
            found[name] = bool(_HIDING[name].match(value)), important
            relative = bool(_OF_PARENT.match(value)) if name == "font-size" else relative
        if not found:
            return
        self.place += 1
        bare = _CSS_BRACKETS.sub("()", _CSS_BRACKETS.sub("()", selectors))
        for s in bare.split(","):
            if not (s := s.strip()) or _NOT_AT_REST.search(s):
                continue
            weight = (99 if "(" in s else s.count("#"), s.count(".") + s.count(":"), len(re.findall(r"(?:^|[\s>+~])[A-Za-z]", s)), self.place)
            simple = _SIMPLE.match(s)
            last = re.split(r"[\s>+~]+", s)[-1]
            tag = re.match(r"[A-Za-z][\w-]*", last)
            needs = frozenset([tag.group().lower()] if tag else []) | frozenset(re.findall(r"[.#][\w-]+", last))
            for name, (hides, important) in found.items():
                w = (important, *weight)
                if name == "font-size" and not hides and not relative:
                    self.shows.setdefault(min(needs, default="*"), []).append((needs, _ABSOLUTE, w))
                if not hides:
                    self.shows.setdefault(min(needs, default="*"), []).append((needs, name, w))
                elif simple and holds:
                    key = (simple.group(1) or "").lower() + (simple.group(2) or "")
                    mine = self.hides.setdefault(key, {})
                    mine[name] = max(w, mine.get(name, w))

    def hiding(self, tag: str, attrs: dict[str, str]) -> set[str]:
        """The properties by which the sheets hide an element."""
        names = _names(tag, attrs)
        against: dict[str, tuple] = {}
        for x in (*names, *(tag + x for x in names[1:])):
            for name, w in self.hides.get(x, {}).items():
                against[name] = max(w, against.get(name, w))
        if not against:
            return set()
        own = {name for name, _, _ in _declared(attrs.get("style", ""))}
        # The element's own style comes before what a sheet says of a property.
        return {name for name, w in against.items() if (name not in own or w[0]) and not self.showing(names, name, w)}

    def showing(self, names: list[str], name: str, than: tuple = ()) -> bool:
        """Whether a rule of more weight ``than`` this may show an element with these names by a property."""
        have = frozenset(names)
        return any(n == name and v > than and needs <= have for x in (*have, "*") for needs, n, v in self.shows.get(x, ()))


def _names(tag: str, attrs: dict[str, str]) -> list[str]:
    return [tag, *("." + c for c in attrs.get("class", "").split()), *(["#" + attrs["id"]] if attrs.get("id") else [])]


def _declared(style: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the declarations that may hide; the last of a property counts."""
    out = {}
    for one in style.lower().split(";"):
        name, _, value = one.partition(":")
        if (name := name.strip()) in _HIDING:
            value, important, _ = value.partition("!")
            out[name] = (name, value.strip(), bool(important))
    return list(out.values())


def _any_screen(media: str) -> int:
    """2: for any screen; 1: for some; 0: for none, as print is."""
    return max(2 if _ANY_SCREEN.match(x) else 0 if re.match(r"\s*(?:only\s+)?(?:print|speech)\b", x, re.I) else 1 for x in media.split(","))


class TreeBuilder:
    """Feeds markup into a tree under ``root``; ``hidden`` gathers the rules that hide and show."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        #: Open elements by name, for each scope.
        self.open: list[dict[str, int]] = [{}]
        self.hidden = Sheet()

    def build(self, html: str) -> Node:
        at, n = 0, len(html)
        no_comment_end = False
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            nxt = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = -1 if no_comment_end else html.find("-->", lt + 4 if not html.startswith("<!-->", lt) else lt + 2)
                no_comment_end = end < 0
                at = n if end < 0 else end + 3
            elif nxt in ("!", "?"):
                end = html.find(">", lt)
                at = n if end < 0 else end + 1
            elif nxt == "/":
                m = _NAME.match(html, lt + 2)
                end = html.find(">", lt)
                if end < 0:
                    break
                if m:
                    self.end(m.group().lower())
                at = end + 1
            elif m := _NAME.match(html, lt + 1):
                at = self._start_tag(html, m.group().lower(), m.end())
            else:
                self.text("<")
                at = lt + 1
        return self.root

    def _start_tag(self, html: str, name: str, at: int) -> int:
        attrs: dict[str, str] = {}
        n = len(html)
        while True:
            m = _ATTR.match(html, at)
            if not m:
                end = html.find(">", at)
                if end < 0:
                    return n
                at = end + 1
                break
            at = m.end()
            value = ""
            if m.group(2):
                quote = html[at : at + 1]
                if quote in ("'", '"'):
                    end = html.find(quote, at + 1)
                    if end < 0:
                        return n
                    value, at = html[at + 1 : end], end + 1
                elif v := _VALUE.match(html, at):
                    value, at = v.group(), v.end()
            attrs.setdefault(m.group(1).lower(), unescape(value) if "&" in value else value)
        self.start(name, attrs)
        if name in RAW:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            body = html[at : m.start() if m else n]
            if name == "style":
                self.hidden.add(body, attrs.get("media", ""))
            elif name in ESCAPABLE or name == "xmp":
                self.text(unescape(body) if name in ESCAPABLE else body, raw=True)
            self.end(name)
            end = html.find(">", m.start()) if m else -1
            return n if end < 0 else end + 1
        return at

    # The open elements.

    def _push(self, name: str, attrs: dict[str, str]) -> None:
        node = Node(name, attrs)
        self.stack[-1].children.append(node)
        if len(self.stack) > DEEPEST:
            return
        self.stack.append(node)
        if name in SCOPE:
            self.open.append({})
        self.open[-1][name] = self.open[-1].get(name, 0) + 1

    def _pop(self) -> str:
        name = self.stack.pop().tag
        self.open[-1][name] -= 1
        if name in SCOPE:
            self.open.pop()
        return name

    def _in_scope(self, name: str) -> bool:
        return self.open[-1].get(name, 0) > 0

    def _pop_to(self, name: str) -> None:
        while self._pop() != name:
            pass

    def _in_table(self) -> bool:
        """Whether the innermost scope is a table, so that only table parts may come."""
        return len(self.open) > 1 and self._in_scope("table")

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name in ("html", "body"):
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if name == "head":
            return
        if name in TABLE_PARTS:
            self._table_part(name)
        else:
            if name in CLOSES_P and self._in_scope("p"):
                self._pop_to("p")
            for other in CLOSED_BY.get(name, ()):
                barrier = LIST_BARRIER.get(name, frozenset())
                if self._in_scope(other) and not any(self._inner(b, other) for b in barrier if self._in_scope(b)):
                    self._pop_to(other)
                    break
            if name == "a" and self._in_scope("a"):
                self._close_inline("a")
        if name in VOID:
            self.stack[-1].children.append(Node(name, attrs))
        else:
            self._push(name, attrs)

    def _inner(self, a: str, b: str) -> bool:
        """Whether the innermost open ``a`` lies within the innermost open ``b``."""
        for node in reversed(self.stack):
            if node.tag == a:
                return True
            if node.tag == b:
                return False
        return False

    def _close_inline(self, name: str) -> None:
        # Only where nothing but inline elements would be closed with it.
        for node in reversed(self.stack):
            if node.tag == name:
                self._pop_to(name)
                return
            if node.tag in BLOCK or node.tag in SCOPE:
                return

    def _table_part(self, name: str) -> None:
        """Close what a table part implies is over and open what it implies is missing."""
        if name in ("td", "th", "tr") or name in SECTIONS or name in ("caption", "colgroup", "col"):
            if self._in_scope("td"):
                self._pop_to("td")
            elif self._in_scope("th"):
                self._pop_to("th")
            elif self._in_scope("caption"):
                self._pop_to("caption")
        if not self._in_table():
            return
        if name not in ("td", "th") and self._in_scope("tr"):
            self._pop_to("tr")
        if (name in SECTIONS or name in ("caption", "colgroup", "col")) and (s := next((s for s in SECTIONS if self._in_scope(s)), None)):
            self._pop_to(s)
        if name in ("td", "th") and not self._in_scope("tr"):
            self._push("tr", {})

    def end(self, name: str) -> None:
        if name in ("html", "body", "head"):
            return
        if name == "br":
            self.stack[-1].children.append(Node("br", {}))
        elif name == "p" and not self._in_scope("p"):
            self.stack[-1].children.append(Node("p", {}))
        elif self._in_scope(name):
            self._pop_to(name)
        elif name == "table" or name in ("tr", "tbody", "thead", "tfoot") or name in SCOPE:
            # Out of a cell: its end is implied, once for each scope that can hold the name.
            while len(self.open) > 1 and not self._in_scope(name):
                if name in SCOPE and not any(name in s and s[name] for s in self.open):
                    return
                if name not in SCOPE and not (self._in_scope("td") or self._in_scope("th") or self._in_scope("caption")):
                    return
                depth = len(self.open)
                while len(self.open) == depth:
                    self._pop()
            if self._in_scope(name):
                self._pop_to(name)

    def text(self, text: str, raw: bool = False) -> None:
        self.stack[-1].children.append(text if raw or "&" not in text else unescape(text))


class _Flow:
    """Lines of a block in the making; blanks collapse, and line ends are held back until text comes."""

    __slots__ = ("lines", "line", "gap", "pending", "indent", "first", "kept")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.pending = False  # a blank before the next word
        self.gap = 0  # empty lines before the next line
        self.indent = ""
        self.first: str | None = None  # a bullet for the next line
        self.kept = False

    def words(self, text: str) -> None:
        text = text.replace("\xa0", " ") if "\xa0" in text else text
        parts = _BLANKS.split(text)
        if len(parts) > 1 and not parts[0]:
            self.pending = True
        said = " ".join(p for p in parts if p)
        if said:
            if self.line and self.pending:
                self.line.append(" ")
            self.line.append(said)
            self.pending = not parts[-1]
        elif len(parts) > 1:
            self.pending = True

    def literal(self, text: str) -> None:
        rows = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, row in enumerate(rows):
            if k:
                self.kept = True
                self.new_line(force=True)
            if row:
                self.line.append(row)

    def new_line(self, gap: int = 0, force: bool = False) -> None:
        if self.line or force:
            said = "".join(self.line)
            said = said.rstrip() if not self.kept else said.rstrip(" ")
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            lead = self.indent
            if self.first is not None:
                lead, self.first = self.first, None
            self.lines.append((lead + said).rstrip())
            self.line, self.gap = [], 0
        self.pending = False
        self.kept = False
        self.gap = max(self.gap, gap)


def _shown(node: Node, sheet: Sheet, unseen: frozenset[str]) -> frozenset[str] | None:
    """The inherited properties that hide what is in a node, of a parent with ``unseen``; None if nothing in it can be seen."""
    tag, attrs = node.tag, node.attrs
    if tag in NEVER_SHOWN:
        return None
    if not attrs and not sheet and not unseen:
        return unseen
    if "hidden" in attrs and attrs["hidden"].lower() != "until-found":
        return None
    if tag == "input" and attrs.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in attrs:
        return None
    own = {name: value for name, value, _ in _declared(attrs["style"])} if attrs.get("style") else {}
    hiding = {name for name, value in own.items() if _HIDING[name].match(value)}
    if sheet:
        hiding |= sheet.hiding(tag, attrs)
    if not hiding <= set(_INHERITED):
        return None
    if unseen:
        names = _names(tag, attrs)
        unseen = frozenset(p for p in unseen if p in hiding or not _undone(p, own, names, sheet))
    return unseen | hiding if hiding else unseen


def _undone(name: str, own: dict[str, str], names: list[str], sheet: Sheet) -> bool:
    if name in own:
        return own[name] == "visible" if name == "visibility" else not _OF_PARENT.match(own[name])
    return sheet.showing(names, _ABSOLUTE if name == "font-size" else name)


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[list[list[str]]]:
    """The cells of each row by column: a cell that spans leaves the other places that it covers empty."""
    out: list[list[list[str]]] = []
    below: dict[int, int] = {}  # by column, in how many further rows it is covered
    for cells in rows:
        row: list[list[str]] = []
        covered, below = below, {c: n - 1 for c, n in below.items() if n > 1}
        for lines, across, down in cells:
            while len(row) in covered:
                row.append([])
            for k in range(across):
                if down > 1:
                    below[len(row)] = down - 1
                row.append([] if k else lines)
        out.append(row)
    return out


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Aligned lines of a table of cells (lines, columns, rows); one column is a plain flow."""
    grid = [r for r in _grid(rows) if any(any(c) for c in r)]
    n = max(map(len, grid), default=0)
    if n == 1:
        return [x for r in grid for x in r[0]]
    width = [0] * n
    for r in grid:
        for k, c in enumerate(r):
            for x in c:
                if width[k] < len(x) <= WIDEST_COLUMN:
                    width[k] = len(x)
    out = []
    for r in grid:
        for k in range(max(map(len, r), default=0)):
            line = "  ".join((c[k] if k < len(c) else "").ljust(width[j]) for j, c in enumerate(r))
            out.append(line.rstrip())
    return out


def _span(node: Node, name: str) -> int:
    v = node.attrs.get(name, "")
    return min(max(int(v), 1), MOST_SPAN) if v.isascii() and v.isdigit() and len(v) < 6 else 1


def render(root: Node, hidden: Sheet) -> str:
    """All visible text of a tree."""
    top = _Flow()
    flow, flows = top, []  # flows: the flows outside of the cell in which we are
    tables: list[list[list[tuple[list[str], int, int]]]] = []  # rows of cells, each its lines and spans
    lists: list[list] = []  # [ordered, number, indent before]
    pre = 0
    unseen: frozenset[str] = frozenset()  # inherited properties that hide the texts here
    # A step is a node to enter, a function to call on leaving, or what was unseen around a node.
    steps: list = [root]
    while steps:
        x = steps.pop()
        if isinstance(x, frozenset):
            unseen = x
            continue
        if callable(x):
            flow, pre = x(flow, pre)
            continue
        if isinstance(x, str):
            if unseen:
                flow.pending = True
            else:
                flow.literal(x) if pre else flow.words(x)
            continue
        inside = _shown(x, hidden, unseen)
        if inside is None:
            continue
        if inside != unseen:
            steps.append(unseen)
            unseen = inside
        tag, children = x.tag, x.children
        if tag == "br":
            flow.new_line(force=True)
            continue
        if tag == "input":
            if x.attrs.get("type", "").lower() in ("submit", "button", "reset") and x.attrs.get("value") and not unseen:
                flow.words(x.attrs["value"])
            continue
        if tag == "wbr" or tag in VOID and tag != "hr":
            continue
        if tag == "details" and "open" not in x.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag == "select":
            options = [o for c in children if isinstance(c, Node) for o in ([c] if c.tag == "option" else c.children) if isinstance(o, Node) and o.tag == "option"]
            shown = options if "multiple" in x.attrs else ([o for o in options if "selected" in o.attrs] or options)[:1]
            children = shown
        if tag in ("td", "th", "caption") and (tables or tag == "caption") and not (tag == "caption" and not tables):
            flows.append(flow)
            cell = _Flow()
            flow = cell

            def leave_cell(f, p, node=x, cell=cell):
                cell.new_line()
                back = flows.pop()
                if node.tag == "caption":
                    tables[-1].append([(cell.lines, 1, 1)])
                else:
                    if not tables[-1]:
                        tables[-1].append([])
                    tables[-1][-1].append((cell.lines, _span(node, "colspan"), _span(node, "rowspan")))
                return back, p

            steps.append(leave_cell)
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag == "table":
            flow.new_line(1)
            tables.append([])

            def leave_table(f, p):
                # What stands in a table but in no cell is before it.
                f.new_line()
                for line in _table(tables.pop()):
                    f.line.append(line)
                    f.kept = True
                    f.new_line(force=True)
                f.new_line(1)
                return f, p

            steps.append(leave_table)
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.new_line(0 if lists else 1)
            start = x.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1, flow.indent, flow])

            def leave_list(f, p):
                f.new_line()
                f.indent = lists.pop()[2]
                f.new_line(0 if lists else 1)
                return f, p

            steps.append(leave_list)
        elif tag == "li":
            flow.new_line()
            own = lists[-1] if lists and lists[-1][3] is flow else None
            before = flow.indent
            outer = own[2] if own else flow.indent
            bullet = "- "
            if own and re.fullmatch(r"-?[0-9]{1,9}", x.attrs.get("value", "")):
                own[1] = int(x.attrs["value"])
            if own and own[0]:
                bullet = f"{own[1]}. "
                own[1] += 1
            flow.first = outer + bullet
            flow.indent = outer + " " * len(bullet)

            def leave_item(f, p, before=before, outer=outer):
                f.new_line()
                f.first, f.indent = None, before
                return f, p

            steps.append(leave_item)
        elif tag in ("pre", "textarea", "listing", "xmp"):
            flow.new_line(1)
            pre += 1
            children = [children[0].removeprefix("\n"), *children[1:]] if children and isinstance(children[0], str) else children

            def leave_pre(f, p):
                f.kept = True
                f.new_line(1)
                return f, p - 1

            steps.append(leave_pre)
        elif tag in ("dd", "blockquote"):
            flow.new_line(1 if tag in SPACED else 0)
            before = flow.indent
            flow.indent = before + "  "

            def leave_indent(f, p, before=before, gap=1 if tag in SPACED else 0):
                f.new_line(gap)
                f.indent = before
                return f, p

            steps.append(leave_indent)
        elif tag in BLOCK:
            gap = 1 if tag in SPACED else 0
            flow.new_line(gap)
            steps.append(lambda f, p, gap=gap: (f.new_line(gap), (f, p))[1])
        elif tag == "q" and not unseen:
            flow.words("“")
            steps.append(lambda f, p: (f.words("”"), (f, p))[1])
        steps.extend(reversed(children))
    top.new_line()
    return "\n".join(top.lines)


def html_to_text(html: str | None) -> str:
    """All visible text of a page; null or empty: an empty text."""
    if not html:
        return ""
    builder = TreeBuilder()
    root = builder.build(html)
    return render(root, builder.hidden)


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: ``id, text, n_chars, n_lines``.

    Null and empty pages give an empty text, no characters and no lines.  Null
    ids, ties and repeated rows give a row each; an empty table an empty
    result; other columns are not read.  Pages of any length are read whole;
    only the layout has bounds: a table's columns are aligned to cells of up to
    40 characters, and a cell covers 100 columns and rows at most.
    """
    bound_batches(df.sparkSession)
    id_type = df.schema[id_col].dataType.simpleString()

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([html_to_text(x.as_py()) for x in batch.column(1)], pa.string())], names=["id", "text"])

    rows = dealt(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html"))).mapInArrow(rendered, f"id {id_type}, text string")
    n_lines = F.when(F.col("text") == "", F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    return rows.select(F.col("id").alias(id_col), "text", F.length("text").cast("long").alias("n_chars"), n_lines.cast("long").alias("n_lines"))
