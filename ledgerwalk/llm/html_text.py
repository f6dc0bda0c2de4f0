"""Layout-aware text of HTML pages.

A tree builder reads tags leniently (implied end tags, implied table rows,
text that a table may not hold goes before it, void and raw elements), a
walk over the tree applies the visibility rules and lays the text out: blank
lines around paragraphs, headings and lists, a line per block, markers and
indents for list items, preformatted text as it is, table cells in aligned
columns.  Text is never dropped for its length; a column is padded to
``MAX_PAD`` characters at most.

Null or empty html gives an empty text.  Neither step recurses, so nesting may
be of any depth.  Pages are independent: no shuffle, repeated rows give equal
results, extra columns are ignored by ``extract_pages``.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

MAX_PAD = 40
CELL_GAP = " | "
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe object noembed noframes datalist audio video canvas".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
#: Blank lines around these; a line break around those of LINES.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset".split())
LINES = frozenset("html body div section article aside nav header footer main address li dt dd tr caption figcaption form "
                  "details summary dialog hr legend option optgroup center menu hgroup search".split())
INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
CLOSES_P = (SPACED | LINES) - {"html", "body", "tr", "caption", "option", "optgroup", "legend"}
#: A start tag closes open elements of its set, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"table"}), "th": ({"td", "th", "caption"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
                    r"""|</?[a-zA-Z][^>]*+>?|(?P<text>[^<]++|<)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "in_table")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent
        self.in_table = tag == "table" or parent is not None and parent.in_table


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def build_tree(source: str) -> Node:
    root = Node("html")
    stack = [root]

    def push(tag: str, attrs: dict[str, str] | None = None) -> None:
        node = Node(tag, attrs, stack[-1])
        place(node, tag in TABLE_PARTS or tag in ("td", "th", "caption", "colgroup", "col", "script", "style", "template"))
        if tag not in VOID:
            stack.append(node)

    def place(node: Node | str, allowed: bool) -> None:
        top = stack[-1]
        if allowed or top.tag not in TABLE_PARTS or (isinstance(node, str) and not node.strip()):
            top.children.append(node)
            return
        depth = max(i for i, n in enumerate(stack) if n.tag == "table")
        table = stack[depth]
        table.parent.children.insert(table.parent.children.index(table), node)  # before the table

    def close(tags: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                return
            if stack[i].tag in tags:
                del stack[i:]
                close(tags, stop)
                return

    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        at = m.end()
        if m["text"] is not None:
            if stack[-1].tag == "head" and m["text"].strip():
                stack.pop()
            place(m["text"], False)
            continue
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "br":
                push("br")
            elif tag in ("html", "body"):
                pass  # what follows still belongs to the body
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if tag in INLINE:
                            del stack[i]  # an inline end tag does not close the blocks in it
                        else:
                            del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "caption", "table") and tag not in TABLE_PARTS:
                        break
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in ("html", "body") and len(stack) > 1 or tag == "html":
            continue
        if tag in CLOSES_P:
            close({"p"}, {"td", "th", "caption", "table", "button", "object"})
        if tag in ("tr", "thead", "tbody", "tfoot") and not stack[-1].in_table:
            continue  # as browsers do
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push("tr")
        source_attrs = m["attrs"]
        push(tag, attributes(source_attrs) if source_attrs.strip(" /\n\t") else None)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            body = source[at:end.start() if end else len(source)]
            if body:
                stack[-1].children.append(body)
            stack.pop()
            at = end.end() if end else len(source)
    return root


def hidden(node: Node) -> bool:
    """Whether the element and all in it are not shown."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a and a["hidden"] != "until-found":
        return True
    if node.tag == "dialog" and "open" not in a or node.tag == "input":
        return True
    return "style" in a and re.search(r"display\s*:\s*none", a["style"], re.I) is not None


class Flow:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap = self.blank = 0  # line ends wanted before the next text; a space wanted
        self.marker = ""

    def block(self, lines: int) -> None:
        self.blank = 0
        if self.parts:
            self.gap = max(self.gap, lines)

    def write(self, text: str, indent: int) -> None:
        if self.gap or not self.parts:
            lead = " " * indent
            if self.marker:
                lead, self.marker = lead[:max(0, indent - len(self.marker))] + self.marker, ""
            self.parts.append("\n" * self.gap + lead)
            self.gap = 0
        elif self.blank:
            self.parts.append(" ")
        self.blank = 0
        self.parts.append(text)

    def text(self) -> str:
        return "".join(self.parts).rstrip()


def lay_out(rows: list[list[str]]) -> str:
    """Rows of cell texts as aligned columns; a cell may have several lines."""
    split = [[c.split("\n") for c in row] for row in rows]
    widths: list[int] = []
    for row in split:
        for i, cell in enumerate(row):
            width = min(max(map(len, cell)), MAX_PAD)
            if i == len(widths):
                widths.append(width)
            widths[i] = max(widths[i], width)
    lines = []
    for row in split:
        for k in range(max(map(len, row), default=0)):
            lines.append(CELL_GAP.join((c[k] if k < len(c) else "").ljust(widths[i]) for i, c in enumerate(row)).rstrip())
    return "\n".join(lines)


def render(root: Node) -> str:
    flow, flows, tables, lists = Flow(), [], [], []
    pre, unseen = 0, [False]
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, enter = todo.pop()
        if isinstance(node, str):
            if unseen[-1]:
                continue
            text = entities.unescape(node)
            indent = 3 * len(lists)
            if pre:
                for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
                    if i and flow.parts:
                        flow.block(min(flow.gap + 1, 2))
                    if line:
                        flow.write(line, indent)
                continue
            words = _BLANKS.sub(" ", text)
            if words[:1] == " ":
                flow.blank = 1
            if words := words.strip(" "):
                flow.write(words, indent)
                if text[-1] in " \t\n\r\f":
                    flow.blank = 1
            continue
        tag = node.tag
        edge = 2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1 if tag in SPACED or tag in LINES else 0
        if enter:
            if hidden(node):
                continue
            if tag == "br":
                flow.blank = 0
                if flow.parts:
                    flow.gap = min(flow.gap + 1, 2)
                continue
            style = node.attrs.get("style", "")
            seen = re.search(r"visibility\s*:\s*(\w+)", style, re.I) if style else None
            unseen.append(unseen[-1] if not seen else seen[1].lower() != "visible")
            if edge:
                flow.block(edge)
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append(int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None)
            elif tag == "li" and lists:
                flow.marker = "- " if lists[-1] is None else f"{lists[-1]}. "
                if lists[-1] is not None:
                    lists[-1] += 1
            elif tag in ("pre", "textarea"):
                pre += 1
            elif tag == "table":
                tables.append([])
                flows.append((flow, lists))
                flow, lists = Flow(), []
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append((flow, lists))
                flow, lists = Flow(), []
            todo.append((node, False))
            if tag == "q":
                todo.append(("”", True))
            shown = node.children
            if tag == "details" and "open" not in node.attrs:
                shown = [c for c in shown if isinstance(c, Node) and c.tag == "summary"]
            todo.extend((c, True) for c in reversed(shown))
            if tag == "q":
                todo.append(("“", True))
            continue
        unseen.pop()
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag in ("td", "th") and tables:
            cell = flow.text()
            flow, lists = flows.pop()
            tables[-1][-1].append(cell)
        elif tag == "table":
            caption = flow.text()
            rows = [r for r in tables.pop() if any(r)]
            flow, lists = flows.pop()
            body = "\n".join(x for x in (caption, lay_out(rows)) if x)
            for i, line in enumerate(body.split("\n") if body else ()):
                if i:
                    flow.block(1)
                flow.write(line, 3 * len(lists))
        if tag == "li":
            flow.marker = ""
        if edge:
            flow.block(edge)
    return flow.text()


def page_text(source: str | None) -> str:
    return render(build_tree(source)) if isinstance(source, str) else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars) of every row of ``pages`` (page_id, html)."""

    def run(batches):
        for b in batches:
            texts = [page_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "text": texts, "n_chars": [len(t) for t in texts]})

    out = pages.select(id_text("page_id"), "html").mapInPandas(run, "page_id string, text string, n_chars bigint")
    return out.withColumn("page_id", F.col("page_id").cast("bigint"))
