"""Visible text of HTML pages, laid out: block spacing, lists and aligned table cells.

A tokenizer's tags build a tree that supplies implied ends (a new `<p>`, `<li>`, `<td>`, ... ends the open
one) and ignores stray ends. Visibility follows tags that never show, `hidden`, inline styles and the rules of
the page's own style sheets that set display or visibility, the most specific and then the last one winning.
Selectors are read as tags, `.class`, `#id` and any of them together, inside others (`nav li`) or directly below
(`ul > li`); rules with attributes, states, siblings or inside other rules don't count, nor do those inside
`@media` that don't hold on a screen of `SCREEN` pixels or inside other conditions and at-rules. Descendants may
show themselves again inside an element of hidden visibility. Buttons show their values, math and drawings their
text. Rendering collapses white space except in `<pre>`, separates paragraphs by a blank line and other blocks by
a line, marks and indents list items, and pads table cells to their column, also below cells that span rows.

Defined cases: null and empty pages give an empty text, an empty table none; repeated rows stay, a column named
like the result is replaced, other columns are kept as they are; broken markup never fails; trees of any depth
and very long pages are walked once without recursion (tables nested more than `TABLE_DEPTH` deep are laid out as
plain blocks). So that padding stays linear in the page, columns are padded to `PAD`: a longer cell with cells to
its right is wrapped at spaces where the table has other rows, and a single longer word shifts the rest of its line.
"""

from __future__ import annotations

import re
import textwrap
from bisect import bisect_right
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col, fresh, map_texts, text_or_empty

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style template head title noscript iframe object canvas audio video datalist meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = SPACED | frozenset("html body div article section main nav aside header footer address li dt dd tr td th thead tbody tfoot caption form hr figcaption details summary legend center dir menu search hgroup optgroup option".split())
ENDS_P = BLOCK - frozenset("html body li dt dd tr td th thead tbody tfoot caption option optgroup legend figcaption summary".split())
#: A start tag → open tags that it ends, up to the tags that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
TABLE_DEPTH, PAD = 20, 60
SPACE = re.compile(r"[ \t\n\r\f]+")
WRAP = textwrap.TextWrapper(PAD, expand_tabs=False, replace_whitespace=False, break_long_words=False, break_on_hyphens=False)
#: Width and height of the screen that media conditions are read for.
SCREEN = {"width": 1280, "height": 800}
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.IGNORECASE)
BRACE = re.compile(r"[{};]")
STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
RANGE = re.compile(r"\(\s*(width|height)\s*([<>])=?\s*([\d.]+)\s*(px|r?em)?\s*\)")
SETTING = re.compile(r"\(\s*([a-z-]+)\s*:\s*([a-z-]+)\s*\)")
SETTINGS = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference"}
LENGTH = re.compile(r"\(\s*(min|max)-(width|height)\s*:\s*([\d.]+)\s*(px|r?em)?\s*\)")
#: Parts of a drawing that never show, and those that hold its text.
UNSEEN = frozenset("defs symbol desc metadata lineargradient radialgradient clippath mask pattern marker filter".split())
DRAWN = frozenset(["text", "foreignobject"])
#: Inputs that show a label, and the label they have without a value.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": "", "image": "Submit"}
COMPOUND = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "attrs", "children", "rules")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.rules: dict[str, tuple] = {}  # property → (rank, value) of the style sheets


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # where open tags stand in `open`
        self.styles: list[str] = []

    def _end(self, upto: int) -> None:
        for node in self.open[upto:]:
            self.places[node.tag].pop()
        del self.open[upto:]

    def _last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _end_open(self, tags, stops) -> None:
        """End the outermost open tag of `tags` that no tag of `stops` encloses."""
        stop = max(map(self._last, stops))
        found = [places[at] for t in tags if (places := self.places.get(t)) and (at := bisect_right(places, stop)) < len(places)]
        if found:
            self._end(min(found))

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P and self.places.get("p"):
            self._end_open({"p"}, {"td", "th", "table", "button"})
        if tag in IMPLIED:
            self._end_open(*IMPLIED[tag])
        elif tag not in NEVER and self.places.get("head") and tag not in ("html", "head"):
            self._end_open({"head"}, {"html"})
        node = Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("annotation", "annotation-xml") and self.places.get("math"):
            node.attrs["#never"] = ""
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash ends nothing in HTML, but elements of drawings and formulas
        foreign = (self.places.get("svg") or self.places.get("math")) and not self.places.get("foreignobject")
        if (foreign or tag == "foreignobject") and self.open[-1].tag == tag:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "p" and not self.places.get("p"):
            self.open[-1].children.append(Node("p", {}))
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        if not self.places.get(tag):
            return
        if tag in ("table", "html", "body") or self._last(tag) > self._last("table"):
            self._end(self._last(tag))

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag == "style" and on_screen(top.attrs.get("media", "")):
            self.styles.append(data)
        if top.tag == "head" and data.strip():
            self._end_open({"head"}, {"html"})
        self.open[-1].children.append(data)


def parse(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree


def on_screen(media: str) -> bool:
    """Whether a media query list holds on the screen; features other than its size count as met."""
    return any(_query_holds(q.strip()) for q in media.lower().split(",")) if media.strip() else True


def _query_holds(query: str) -> bool:
    negated = re.match(r"not\s+", query)
    query = re.sub(r"^(?:not|only)\s+", "", query)
    kind = re.match(r"[a-z-]+", query)
    holds = kind is None or kind.group() in ("all", "screen")
    bounds = [(side == "min", axis, number, unit) for side, axis, number, unit in LENGTH.findall(query)]
    bounds += [(side == ">", axis, number, unit) for axis, side, number, unit in RANGE.findall(query)]
    for least, axis, number, unit in bounds:
        n = float(number) * (16 if unit in ("em", "rem") else 1) if re.fullmatch(r"\d*\.?\d+|\d+\.", number) else 0
        holds &= SCREEN[axis] >= n if least else SCREEN[axis] <= n
    holds &= all(SETTINGS.get(name, value) == value for name, value in SETTING.findall(query))
    return holds != bool(negated)


def declared(body: str) -> dict[str, tuple[str, bool]]:
    """display and visibility of a declaration block, with whether they are important; the last one wins."""
    out: dict[str, tuple[str, bool]] = {}
    for name, value, important in DECLARED.findall(body):
        name = name.lower()
        if important or not out.get(name, ("", False))[1]:
            out[name] = (value.lower(), bool(important))
    return out


class Rules:
    """Selectors as chains of parts, each found by one name that its element must have."""

    def __init__(self):
        self.named: dict[str, list[tuple]] = {}  # name → (part, tag, classes and id, part before, directly below)
        self.parts: dict[str, int] = {}
        self.given: dict[int, dict[str, tuple]] = {}  # last part → property → (rank, value), a greater rank wins
        self.leads: set[int] = set()  # parts with a part behind them

    def add(self, selector: str, values: dict[str, tuple[str, bool]], order: int) -> None:
        words = re.sub(r"\s*>\s*", " > ", selector).split()
        links, chain = [], []
        for k, word in enumerate(words):
            if word == ">":
                if not chain or k + 1 == len(words) or words[k - 1] == ">":
                    return
                continue
            found = COMPOUND.fullmatch(word)
            if not found:
                return
            links.append(k > 0 and words[k - 1] == ">")
            chain.append((found[1].lower() if found[1] and found[1] != "*" else "", frozenset(re.findall(r"[.#][\w-]+", found[2]))))
        before, path = -1, ""
        for below, (tag, marks) in zip(links, chain):
            name = min(marks) if marks else tag or "*"
            path += f" {'>' if below else ''}{tag}{''.join(sorted(marks))}"
            if path not in self.parts:
                self.parts[path] = len(self.parts)
                self.named.setdefault(name, []).append((self.parts[path], tag, marks, before, below))
                self.leads.add(before)
            before = self.parts[path]
        if not chain:
            return
        every = [m for _, marks in chain for m in marks]
        ids = sum(m.startswith("#") for m in every)
        held = self.given.setdefault(before, {})
        for name, (value, important) in values.items():
            rank = (important, ids, len(every) - ids, sum(bool(tag) for tag, _ in chain), order)
            held[name] = max(held.get(name, (rank, value)), (rank, value))

    def apply(self, root: Node) -> None:
        """Give every element the values of the selectors that select it, in one walk from the top."""
        todo = [(root, frozenset(), frozenset())]
        while todo:
            node, above, parent = todo.pop()
            marks = {"." + c for c in node.attrs.get("class", "").split()}
            if node.attrs.get("id"):
                marks.add("#" + node.attrs["id"].strip())
            here = set()
            for name in ("*", node.tag, *marks):
                for part, tag, wanted, before, below in self.named.get(name, ()):
                    if tag in ("", node.tag) and wanted <= marks and (before < 0 or before in (parent if below else above)):
                        here.add(part)
                        for prop, value in self.given.get(part, {}).items():
                            node.rules[prop] = max(node.rules.get(prop, value), value)
            lead = frozenset(here & self.leads)
            beneath = above if lead <= above else above | lead
            todo += [(c, beneath, lead) for c in node.children if not isinstance(c, str)]


def style_rules(styles: list[str]) -> Rules:
    """The rules of all sheets that set display or visibility and hold on the screen."""
    out, order = Rules(), 0
    for sheet in styles:
        sheet = STRING.sub('""', re.sub(r"/\*.*?\*/|<!--|-->", "", sheet, flags=re.DOTALL))
        # open blocks: selectors ("" for an at-rule), whether they hold, whether inside a rule, declarations so far
        blocks, at = [("", True, False, [])], 0
        for m in BRACE.finditer(sheet):
            selectors, applies, inside, body = blocks[-1]
            if m.group() == "{":
                head = sheet[at : m.start()].strip()
                name = head.lower()
                if name.startswith("@"):
                    word = re.match(r"@[a-z-]*", name).group()
                    if word == "@media":
                        holds = on_screen(head[6:])
                    else:
                        holds = word == "@layer" or word == "@supports" and not re.match(r"@supports\s+not\b", name)
                    blocks.append(("", applies and holds, inside, []))
                else:
                    blocks.append((head, applies and not inside, True, []))
            else:
                body.append(sheet[at : m.end()].removesuffix("}"))
                if m.group() == "}":
                    if selectors and applies and (values := declared(";".join(body))):
                        for selector in map(str.strip, selectors.split(",")):
                            order += 1
                            out.add(selector, values, order)
                    if len(blocks) > 1:
                        blocks.pop()
            at = m.end()
    return out


def styled(node: Node, name: str) -> str | None:
    """The value of a property that the page gives an element itself."""
    own = declared(node.attrs["style"]).get(name) if node.attrs.get("style") else None
    best = node.rules.get(name)
    if own and (own[1] or not (best and best[0][0])):
        return own[0]
    return best and best[1]


def hidden(node: Node) -> bool:
    """Whether an element and all in it don't show."""
    tag, attrs = node.tag, node.attrs
    if tag in NEVER or "#never" in attrs or tag == "input" and attrs.get("type", "").lower().strip() not in BUTTONS:
        return True
    display = styled(node, "display")
    if display is not None:
        return display == "none"
    return "hidden" in attrs or tag == "dialog" and "open" not in attrs


def conceal(root: Node) -> None:
    """Take out what the inherited visibility hides, but not descendants that are visible again."""
    todo = [(root, True)]
    while todo:
        node, shown = todo.pop()
        value = styled(node, "visibility")
        if value in ("hidden", "collapse", "visible", "initial"):
            shown = value in ("visible", "initial")
        if not shown:
            node.children = [c for c in node.children if not isinstance(c, str)]
            node.attrs["#unseen"] = ""
        todo += [(c, shown) for c in node.children if not isinstance(c, str)]


def drawn(svg: Node) -> list[Node]:
    """The elements of a drawing that hold text, in order."""
    out, todo = [], list(reversed(svg.children))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.tag in UNSEEN or hidden(node):
            continue
        if node.tag in DRAWN:
            out.append(node)
        else:
            todo += reversed(node.children)
    return out


def label(node: Node) -> str:
    """What an image or a button shows as text."""
    if "#unseen" in node.attrs:
        return ""
    if node.tag == "img":
        return node.attrs.get("alt", "")
    kind = node.attrs.get("type", "").lower().strip()
    return node.attrs.get("alt" if kind == "image" else "value", BUTTONS[kind])


class Page:
    """Lines in the making: collapses white space, keeps blank lines to one, indents list content."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent: list[str] = [""]
        self.mark = ""
        self.space = self.blank = False

    def word(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.split("\n")
            self._put(first)
            for part in more:
                self._flush(keep=True)
                self._put(part)
            return
        parts = SPACE.sub(" ", text)
        if parts.startswith(" "):
            self.space = True
            parts = parts[1:]
        if not parts:
            return
        tail = parts.endswith(" ")
        self._put((" " if self.space and self.line else "") + parts.rstrip(" "))
        self.space = tail

    def _put(self, text: str) -> None:
        if text:
            self.line.append(text)

    def _flush(self, keep: bool = False) -> None:
        text = "".join(self.line).rstrip(" ")
        self.line, self.space = [], False
        if not text and not keep:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        # an item's mark stands before its first line only; later lines are indented as far
        lead = self.indent[-1][: -len(self.mark)] + self.mark if self.mark else self.indent[-1]
        self.lines.append((lead + text).rstrip(" "))
        self.mark = ""

    def end(self, spaced: bool = False) -> None:
        self._flush()
        self.blank |= spaced and bool(self.lines)

    def text(self) -> str:
        self._flush()
        return "\n".join(self.lines)


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int]]]:
    """Rows of (cell text, columns it spans) with an empty cell wherever a cell above reaches down; rows without text go."""
    reach: dict[int, int] = {}  # column → rows that a cell above still covers
    out = []
    for row in rows:
        placed, at, todo = [], 0, list(reversed(row))
        covered, reach = reach, {}
        last = max(covered, default=-1)
        while todo or at <= last:
            if at in covered:
                placed.append(("", 1))
                if covered[at] > 1:
                    reach[at] = covered[at] - 1
                at += 1
            elif todo:
                text, span, down = todo.pop()
                placed.append((text, span))
                for c in range(at, at + span if down > 1 else at):
                    reach[c] = max(down - 1, covered.get(c, 1) - 1)
                at += span
            else:
                placed.append(("", 1))
                at += 1
        if any(text for text, _ in placed):
            out.append(placed)
    return out


def _wrapped(row: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The row with long lines wrapped at spaces in every cell that has text to its right."""
    last = max(k for k, (text, _) in enumerate(row) if text)
    out = []
    for k, (text, span) in enumerate(row):
        if k < last and len(text) > PAD:
            lines = [[line] if len(line) <= PAD else WRAP.wrap(line) for line in text.split("\n")]
            text = "\n".join(part for parts in lines for part in parts)
        out.append((text, span))
    return out


def table_lines(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (cell text, columns and rows it spans), cells side by side and padded to their column."""
    rows = _placed(rows)
    if len(rows) > 1:
        rows = [_wrapped(row) for row in rows]
    widths: list[int] = []
    for row in rows:
        at = 0
        for text, span in row:
            while len(widths) < at + span:
                widths.append(0)
            if span == 1:
                widths[at] = max(widths[at], min(PAD, max(map(len, text.split("\n")))))
            at += span
    for row in rows:
        at = 0
        for text, span in row:
            # a cell over several columns widens the last of them
            wanted = min(PAD, max(map(len, text.split("\n")))) - sum(widths[at : at + span]) - 3 * (span - 1)
            widths[at + span - 1] += max(0, wanted) if span > 1 else 0
            at += span
    out = []
    for row in rows:
        cells = [text.split("\n") for text, _ in row]
        for k in range(max(map(len, cells), default=0)):
            parts, at = [], 0
            for cell, (_, span) in zip(cells, row):
                width = sum(widths[at : at + span]) + 3 * (span - 1)
                parts.append((cell[k] if k < len(cell) else "").ljust(width))
                at += span
            out.append(" | ".join(parts).rstrip())
    return out


def _rows(table: Node) -> tuple[list[Node], list[list[Node]], list[Node]]:
    """(captions, rows of cells, anything else) of a table, looking through its row groups only."""
    captions, rows, other, todo = [], [], [], [table]
    while todo:
        node = todo.pop(0)
        loose: list[Node] = []
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    other.append(child)
            elif hidden(child):
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                todo.append(child)
            elif child.tag == "tr":
                rows.append([c for c in child.children if not isinstance(c, str) and not hidden(c)])
                other += [c for c in child.children if isinstance(c, str) and c.strip()]
            elif child.tag in ("td", "th"):
                loose.append(child)
            elif child.tag == "caption":
                captions.append(child)
            elif child.tag not in ("colgroup", "col"):
                other.append(child)
        if loose:
            rows.append(loose)
    return captions, rows, other


def render(nodes: list, depth: int = 0) -> str:
    page, todo = Page(), [("in", n, False) for n in reversed(nodes)]
    while todo:
        step, node, pre = todo.pop()
        if step == "list end":
            page.end()
            page.indent.pop()
            page.mark = ""
            continue
        if step == "end":
            page.end(node in SPACED)
            continue
        if isinstance(node, str):
            page.word(node, pre)
            continue
        if hidden(node):
            continue
        tag = node.tag
        if tag == "br":
            page._flush(keep=bool(page.lines or page.line))
        elif tag == "hr":
            page.end(True)
        elif tag == "img":
            if label(node).strip():
                page.word(label(node), False)
        elif tag == "input":
            if label(node).strip():
                page.word(f" {label(node)} ", False)
        elif tag == "svg":
            for part in reversed(drawn(node)):
                todo += [("in", " ", False), ("in", part, False), ("in", " ", False)]
        elif tag == "table" and depth < TABLE_DEPTH:
            page.end(True)
            captions, rows, other = _rows(node)
            for part in [*captions, *other]:
                for line in filter(None, render([part], depth + 1).split("\n")):
                    page._put(line)
                    page._flush()
            cells = [[(render(c.children if c.tag in ("td", "th") else [c], depth + 1), _span(c), _span(c, "rowspan")) for c in row] for row in rows]
            for line in table_lines(cells):
                page._put(line)
                page._flush()
            page.end(True)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol") and len(page.indent) > 1
            page.end(tag in SPACED and not nested)
            todo.append(("end", "div" if nested else tag, pre))
            if tag == "ol":
                node.attrs["#next"] = int(node.attrs["start"]) if re.fullmatch(r"\d{1,9}", node.attrs.get("start", "")) else 1
            if tag == "li":
                owner, mark = node.attrs.get("#owner"), "- "
                if owner is not None and owner.tag == "ol":
                    mark = f"{owner.attrs['#next']}. "
                    owner.attrs["#next"] += 1
                todo.append(("list end", None, pre))
                page.indent.append(page.indent[-1] + " " * len(mark))
                page.mark = mark
            children = node.children
            for child in children:
                if not isinstance(child, str) and child.tag == "li":
                    child.attrs["#owner"] = node
            todo += [("in", c, pre or tag == "pre") for c in reversed(children)]
        else:
            todo += [("in", c, pre or tag == "textarea") for c in reversed(node.children)]
    return page.text()


def _span(cell: Node, name: str = "colspan") -> int:
    raw = cell.attrs.get(name, "")
    return min(max(int(raw), 1), 100) if re.fullmatch(r"\d{1,6}", raw) else 1


def visible_text(html: str) -> str:
    tree = parse(html)
    rules = style_rules(tree.styles)
    if rules.given:
        rules.apply(tree.root)
    if "visibility" in html.lower():
        conceal(tree.root)
    return render(tree.root.children)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Append the visible text of each whole page; one pass in the scan's tasks."""
    source = fresh(pages, "html_in")
    held = [col(c) for c in pages.columns if c.lower() != out.lower()]

    def run(batch: pa.RecordBatch) -> dict:
        return {out: [visible_text(h) for h in batch.column(batch.schema.names.index(source)).to_pylist()]}

    return map_texts(pages.select(*held, text_or_empty(html).alias(source)), run, T.StructType([T.StructField(out, T.StringType())]), source).drop(source)
