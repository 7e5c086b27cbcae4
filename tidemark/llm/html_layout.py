"""Layout-aware rendering of HTML: all the text that a reader would see, with the spacing of blocks, lists and tables.

A tokenizer and a tree builder with implied tags make a tree of any input, however deep; visibility rules (attributes, inline styles
and the simple selectors of style sheets, with inheritance) take out what isn't shown; a renderer writes blocks on lines of their own,
marks list items, keeps preformatted text, and puts table cells on a grid with both kinds of spans, padded to common column widths.

Not looked at: scripts, linked sheets, selectors with combinators, attributes or states, conditional media, colours and positions.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm._session import chosen
from tidemark.llm.words import sliced

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist object canvas audio video".split())
UNDRAWN = {  # what isn't drawn within these
    "svg": frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
APART = frozenset("text mtd mtr mlabeledtr mtext".split())  # drawn apart from what stands before and after
LABELLED = frozenset("button submit reset image".split())  # inputs whose label is part of the page
BLUNT = frozenset("hidden password checkbox radio range color file".split())  # inputs without text; others are text fields
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset hr".split())
CLOSES_P = BLOCK - {"body", "html", "dd", "dt", "li", "legend", "summary"} | {"dd", "dt", "li", "summary"}
#: tag -> (open elements that it ends, elements that it doesn't look beyond)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption html template object button".split())
CELLS = frozenset("table td th".split())
ROWS = frozenset("tbody thead tfoot tr".split())
TABLE_ENDS = frozenset("table tr tbody thead tfoot body html td th".split())  # end tags that close across cells
TOKEN = re.compile(
    r"<!--(?:>|.*?-->|.*\Z)"  # comments
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/><]*+)(?P<attrs2>[^><]*+)>"  # with a stray quote
    r"|<[!?/][^>]*>|<(?:/?[A-Za-z][^><]*\Z)",
    re.S,
)
IN_HEAD = frozenset("head html title meta link style script base noscript template bgsound".split())
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
SELECTOR = re.compile(r"(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:[.#][A-Za-z_-][\w-]*)*)\Z")
COMMENT = re.compile(r"/\*(?:.*?\*/|.*\Z)|<!--|-->", re.S)
ZERO = re.compile(r"[+-]?0*(?:\.0*)?(?:%|[a-z]*)\Z")
WATCHED = frozenset("display visibility opacity font-size".split())
BLOCK_DISPLAY = frozenset("block flex grid flow-root list-item".split())
# Limits of the layout alone: what goes beyond them is set more simply, and no text is lost.
MOST_INDENT = 80  # columns
MOST_NESTED = 20  # tables within tables; the cells of deeper ones stand one under another
MOST_SPANS = 1000  # open row spans in one row
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # of one cell, by the HTML standard


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(source: str) -> Node:
    """The tree of any text. Unclosed elements end with their parents; end tags without a start are passed over."""
    root = Node("#root")
    stack = [root]
    held: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements, by tag
    at = 0

    def text(part: str, unescape: bool = True) -> None:
        if part:
            if stack[-1].tag == "head" and not part.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(part) if unescape else part)

    def push(node: Node) -> None:
        held[node.tag].append(len(stack))
        stack.append(node)

    def cut(to: int) -> None:
        while len(stack) > to:
            held[stack.pop().tag].pop()

    def last(tags: set[str] | frozenset[str]) -> int:
        return max((held[t][-1] for t in tags if held.get(t)), default=0)

    def close(tags: set[str], stop: set[str] | frozenset[str]) -> None:
        while (i := last(tags)) and i > last(stop):
            cut(i)

    while at < len(source):
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if tag == "p" and not held.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif (i := last({tag})) and (tag in TABLE_ENDS or i > last(CELLS)):
                cut(i)
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag not in IN_HEAD:
            close({"head"}, {"body"})
        if tag == "a":
            close({"a"}, SCOPE)
        if tag == "tr" and stack[-1].tag == "table":
            stack[-1].children.append(body := Node("tbody"))
            push(body)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            stack[-1].children.append(row := Node("tr"))
            push(row)
        node = Node(tag, attributes(attrs))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            part = source[at : end.start() if end else len(source)]
            node.children.append(html.unescape(part) if tag in ("title", "textarea") else part)
            at = end.end() if end else len(source)
        elif tag not in VOID and not attrs.endswith("/"):
            push(node)
    return root


def declarations(css: str) -> dict[str, tuple[str, bool]]:
    """property -> (value, whether it is important), of those that decide what is seen."""
    out: dict[str, tuple[str, bool]] = {}
    for part in COMMENT.sub(" ", css).split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name in WATCHED and value:
            important = value.endswith("important") and value.rstrip().removesuffix("important").rstrip().endswith("!")
            out[name] = (value.removesuffix("important").rstrip().rstrip("!").rstrip() if important else value, important)
    return out


class Rule(NamedTuple):
    rank: tuple[int, int, int, int]  # ids, classes, tags, place
    tag: str
    names: frozenset[str]  # "#id" and ".class"
    says: dict[str, tuple[str, bool]]


class Sheet:
    """The rules of all style elements of a page, by one name that an element must have."""

    def __init__(self) -> None:
        self.rules: dict[str, list[Rule]] = defaultdict(list)
        self.count = 0

    def read(self, css: str) -> None:
        css, at = COMMENT.sub(" ", css), 0
        while (opening := css.find("{", at)) >= 0:
            head = css[at:opening].rpartition(";")[2].rpartition("}")[2].strip()
            if head.startswith("@"):
                at = opening + 1
                if not re.match(r"@media\s+(?:all|screen)\s*(?:,|\Z)|@layer\b|@supports\b", head, re.I):
                    depth = 1
                    for m in re.compile(r"[{}]").finditer(css, at):
                        depth += 1 if m[0] == "{" else -1
                        if not depth:
                            break
                    at = m.end() if css.find("}", at) >= 0 else len(css)
                continue
            closing = css.find("}", opening)
            closing = len(css) if closing < 0 else closing
            says = declarations(css[opening + 1 : closing])
            if says:
                for one in head.split(","):
                    m = SELECTOR.match(one.strip())
                    if m and m[0]:
                        tag, names = (m["tag"] or "*").lower(), frozenset(re.findall(r"[.#][^.#]+", m["rest"]))
                        ids = sum(x[0] == "#" for x in names)
                        self.count += 1
                        key = next(iter(sorted(names)), tag)
                        self.rules[key].append(Rule((ids, len(names) - ids, int(tag != "*"), self.count), tag, names, says))
            at = closing + 1

    def of(self, node: Node) -> dict[str, str]:
        """The winning declarations for an element, its own attributes among them."""
        style = node.attrs.get("style")
        names = {"." + c for c in node.attrs.get("class", "").split()}
        if "id" in node.attrs:
            names.add("#" + node.attrs["id"])
        best: dict[str, tuple[tuple, str]] = {}
        if self.count:
            for key in ("*", node.tag, *names):
                for rule in self.rules.get(key, ()):
                    if rule.tag in ("*", node.tag) and rule.names <= names:
                        for name, (value, important) in rule.says.items():
                            best[name] = max(best.get(name, ((), "")), ((important, 0, *rule.rank), value))
        if style:
            for name, (value, important) in declarations(style).items():
                best[name] = max(best.get(name, ((), "")), ((important, 1, 0, 0, 0, 0), value))
        return {name: value for name, (_, value) in best.items()}


class State(NamedTuple):
    """What an element hands down."""

    visible: bool = True
    sized: bool = True  # its font isn't of size 0
    undrawn: frozenset[str] = frozenset()

    @property
    def shows(self) -> bool:
        return self.visible and self.sized


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of output. Spaces collapse; a block asks for a line of its own, a spaced block for an empty line around it."""

    def __init__(self, indent: str = ""):
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.indent, self.mark = "", 0, False, indent, ""

    def write(self, text: str) -> None:
        parts = SPACES.split(text)
        for k, part in enumerate(parts):
            if k:
                self.space = True
            if part:
                if not self.line:
                    self.start()
                elif self.space:
                    self.line += " "
                self.line += part
                self.space = False

    def start(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap if self.lines[-1] else 0)
        self.gap = 0
        self.line = self.mark or self.indent
        self.mark, self.space = "", False

    def flush(self) -> None:
        if self.line.strip():
            self.lines.append(self.line.rstrip())
        self.line, self.space = "", False

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = max(self.gap, int(spaced))

    def whole(self, line: str) -> None:
        self.flush()
        self.start()
        self.lines.append((self.line + line).rstrip())
        self.line = ""


def run(first: Generator) -> None:
    """Run generators that yield further ones to be run first: recursion without a limit."""
    stack = [first]
    while stack:
        try:
            stack.append(next(stack[-1]))
        except StopIteration:
            stack.pop()


def nodes(root: Node) -> Iterator[Node]:
    """All elements below ``root`` in order."""
    stack = [iter(root.children)]
    while stack:
        for child in stack[-1]:
            if isinstance(child, Node):
                yield child
                stack.append(iter(child.children))
                break
        else:
            stack.pop()


def number(source: str, most: int) -> int | None:
    source = source.strip()
    return min(int(source[:9]), most) if source[:9].isascii() and source[:9].isdigit() else None


class Painter:
    def __init__(self, root: Node):
        self.sheet = Sheet()
        for n in nodes(root):
            if n.tag == "style":
                self.sheet.read("".join(c for c in n.children if isinstance(c, str)))

    def enter(self, node: Node, state: State) -> tuple[State, str] | None:
        """The state within an element and its declared display, or None if nothing of it is seen."""
        a, tag = node.attrs, node.tag
        if tag in HIDDEN or tag in state.undrawn or (tag == "input" and a.get("type", "").strip().lower() in BLUNT):
            return None
        says = self.sheet.of(node) if a or self.sheet.count else {}
        display = says.get("display", "")
        if display == "none" or not display and ("hidden" in a or tag == "dialog" and "open" not in a) or a.get("hidden", "").lower() == "until-found":
            return None
        if "opacity" in says and ZERO.match(says["opacity"]):
            return None
        visible, sized, undrawn = state
        if "visibility" in says:
            word = says["visibility"]
            visible = word == "visible" if word in ("visible", "hidden", "collapse", "initial") else visible
            visible = visible or word == "initial"
        if "font-size" in says:
            size = says["font-size"]
            relative = size.endswith(("em", "%", "ex", "ch", "smaller", "larger", "inherit")) and not size.endswith("rem")
            sized = not ZERO.match(size) and (sized or not relative)
        return State(visible, sized, UNDRAWN.get(tag, undrawn)), display

    def drawn(self, node: Node, state: State) -> list[Node | str]:
        """What a browser shows of the children of ``node``: of a drop-down list its chosen option, of a longer list all options, of a
        button its label, of a text field its value or hint, of closed details the summary, of a fraction a stroke."""
        a = node.attrs
        if node.tag == "input":
            kind = a.get("type", "").strip().lower()
            return [a.get("alt" if kind == "image" else "value", "") or ("" if kind in LABELLED else a.get("placeholder", ""))]
        if node.tag == "textarea":
            return node.children if any(isinstance(c, str) and c for c in node.children) else [a.get("placeholder", "")]
        if node.tag == "select":
            return self.choices(node, state)
        if node.tag == "details" and "open" not in a:
            return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        if node.tag == "mfrac":
            parts = [c for c in node.children if isinstance(c, Node)]
            return [parts[0], "/", *parts[1:]] if parts else node.children
        return node.children

    def choices(self, node: Node, state: State) -> list[Node | str]:
        options: list[tuple[Node, bool]] = []
        off = set()  # ids of elements in a group that can't be chosen from
        for c in nodes(node):
            if id(c) in off or c.tag == "optgroup" and "disabled" in c.attrs:
                off |= {id(x) for x in c.children}
            if c.tag == "option":
                options.append((c, id(c) in off or "disabled" in c.attrs))
            elif c.tag == "optgroup" and c.attrs.get("label") and self.enter(c, state):
                options.append((c, True))

        def label(n: Node) -> str:
            return n.attrs.get("label") or ("" if n.tag == "optgroup" else self.plain(n, state))

        size = number(node.attrs.get("size", ""), 1000)
        if "multiple" in node.attrs or size and size > 1:
            return [Node("div", {}, [label(o)]) for o, _ in options if self.enter(o, state)]
        real = [(o, off) for o, off in options if o.tag == "option"]
        shown = [o for o, _ in real if "selected" in o.attrs][-1:] or [o for o, off in real if not off][:1]
        return [label(o) for o in shown]

    def plain(self, node: Node, state: State) -> str:
        """Text as it stands, spaces and all."""
        out: list[str] = []

        def gather(n: Node, s: State) -> Generator:
            for c in self.drawn(n, s):
                if isinstance(c, str):
                    out.append(c if s.shows else "")
                elif c.tag == "br":
                    out.append("\n")
                elif inner := self.enter(c, s):
                    yield gather(c, inner[0])

        run(gather(node, state))
        return "".join(out)

    def render(self, node: Node, page: Page, state: State, tables: int = 0) -> Generator:
        count = (number(node.attrs.get("start", ""), 10**9) or 1) - 1 if node.tag == "ol" else 0
        for child in self.drawn(node, state):
            if isinstance(child, str):
                if state.shows:
                    page.write(child)
                continue
            entered = self.enter(child, state)
            if not entered:
                continue
            tag, (inner, display) = child.tag, entered
            if tag == "br":
                if page.line:
                    page.flush()
                elif page.lines and not page.gap:
                    page.gap = 1
            elif tag == "hr":
                page.block(True)
            elif tag == "img":
                if inner.shows:
                    page.write(child.attrs.get("alt", ""))
            elif tag in ("pre", "textarea"):
                page.block(True)
                whole = self.plain(child, inner).strip("\n")
                for part in whole.split("\n") if whole.strip() else ():
                    page.whole(part)
                page.block(True)
            elif tag == "table":
                page.block(True)
                yield self.table(child, page, inner, tables + 1)
                page.block(True)
            elif tag == "li":
                page.block(False)
                given = number(child.attrs.get("value", ""), 10**9) if node.tag == "ol" else None
                count = count + 1 if given is None else given
                mark = f"{count}. " if node.tag == "ol" else "- "
                held = page.indent
                page.mark, page.indent = held + mark, (held + " " * len(mark))[:MOST_INDENT]
                yield self.render(child, page, inner, tables)
                page.flush()
                page.indent, page.mark = held, ""
            elif tag in ("blockquote", "dd"):
                page.block(tag == "blockquote")
                held = page.indent
                page.indent = (held + "  ")[:MOST_INDENT]
                yield self.render(child, page, inner, tables)
                page.block(tag == "blockquote")
                page.indent = held
            elif tag in BLOCK and not display.startswith("inline") or display in BLOCK_DISPLAY:
                spaced = tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li")
                page.block(spaced)
                yield self.render(child, page, inner, tables)
                page.block(spaced)
            elif tag in APART:
                page.write(" ")
                yield self.render(child, page, inner, tables)
                page.write(" ")
            else:
                yield self.render(child, page, inner, tables)

    def rows(self, node: Node, state: State, page: Page, tables: int, out: list[list]) -> Generator:
        """Rows of (column, lines) on the table's grid into ``out``; captions and stray text go to ``page``."""
        open_spans: list[tuple[int, int, int, int]] = []  # first column, column after the last, row after the last, row group that ends it

        def row(tr: Node, inner_state: State, group: int) -> Generator:
            cells, column, new, k = [], 0, [], len(out)
            spans = sorted(x for x in open_spans if x[2] > k and x[3] == group)
            at = 0
            for c in tr.children:
                if isinstance(c, str):
                    if c.strip() and inner_state.shows:
                        page.write(c)
                    continue
                entered = self.enter(c, inner_state)
                if not entered:
                    continue
                while at < len(spans) and spans[at][0] <= column:
                    column, at = max(column, spans[at][1]), at + 1
                cell = Page()
                is_cell = c.tag in ("td", "th")
                yield self.render(c if is_cell else Node("td", {}, [c]), cell, entered[0] if is_cell else inner_state, tables)
                cell.flush()
                cells.append((column, cell.lines or [""]))
                wide = number(c.attrs.get("colspan", ""), MOST_COLUMNS) or 1
                high = number(c.attrs.get("rowspan", ""), MOST_ROWS)
                if high is not None and high != 1:
                    until = k + (high or MOST_ROWS)
                    first = new.pop()[0] if new and new[-1][1:] == (column, until, group) else column
                    new.append((first, column + wide, until, group))
                column += wide
            open_spans[:] = [*spans, *new][:MOST_SPANS]
            out.append(cells)

        group = 0
        todo = [(iter(node.children), state, 1)]
        while todo:
            children, s, in_group = todo[-1]
            for child in children:
                if isinstance(child, str):
                    if child.strip() and s.shows:
                        page.write(child)
                    continue
                entered = self.enter(child, s)
                if not entered:
                    continue
                if child.tag == "caption":
                    yield self.render(child, page, entered[0], tables)
                    page.block(False)
                elif child.tag == "tr":
                    yield row(child, entered[0], in_group)
                elif child.tag in ("select", "input", "svg", "math", "textarea", "img"):
                    yield self.render(Node("td", {}, [child]), page, s, tables)
                else:
                    group += 1
                    todo.append((iter(child.children), entered[0], group + 1 if child.tag in ("tbody", "thead", "tfoot") else in_group))
                    break
            else:
                todo.pop()

    def table(self, node: Node, page: Page, state: State, tables: int) -> Generator:
        """Rows of cells, padded to the columns' widths; a cell of several lines takes several lines of its row. A column in which no
        cell begins takes no room."""
        if tables > MOST_NESTED:
            yield self.render(Node("div", {}, [Node("div", c.attrs, c.children) if isinstance(c, Node) and c.tag in ROWS else c for c in node.children]), page, state, tables)
            return
        rows: list[list] = []
        yield self.rows(node, state, page, tables, rows)
        page.flush()
        used = {c: i for i, c in enumerate(sorted({c for r in rows for c, _ in r}))}
        widths = [0] * len(used)
        for r in rows:
            for c, lines in r:
                widths[used[c]] = max(widths[used[c]], max(map(width, lines)))
        for r in rows:
            for i in range(max((len(lines) for _, lines in r), default=0)):
                parts: list[str] = []
                for c, lines in r:
                    parts += [" " * w for w in widths[len(parts) : used[c]]]
                    part = lines[i] if i < len(lines) else ""
                    parts.append(part + " " * (widths[used[c]] - width(part)))
                page.whole(" | ".join(parts))


def extract(source: str | None) -> str:
    """The visible text of a page. Null and empty give an empty text."""
    root, page = parse(source or ""), Page()
    run(Painter(root).render(root, page, State()))
    page.flush()
    return "\n".join(page.lines)


def title(source: str | None) -> str:
    root = parse(source or "")
    found = next((n for n in nodes(root) if n.tag == "title"), None)
    return SPACES.sub(" ", "".join(c for c in found.children if isinstance(c, str)) if found else "").strip()


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_lines for every row; nulls give an empty text, broken markup what can be shown of it, extra columns are
    ignored, repeated rows stay. Pages are read whole; one page is in memory at a time beside its batch."""
    own = chosen(pages, id_col, html_col)
    name = own.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            texts = [extract(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64())], names=[name, "text", "n_lines"])

    return own.mapInArrow(run, f"`{name}` {own.schema[name].dataType.simpleString()}, text string, n_lines long")
