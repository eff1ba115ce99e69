"""HTML extraction by layout-aware rendering.

A tolerant scanner feeds a tree builder that supplies the tags HTML lets authors leave out.
The renderer walks the tree without recursion, skips what a browser would not show, and keeps
block spacing, list markers and aligned table cells.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import small_batches

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe object audio video canvas svg math".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
                   "search section summary table ul".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
LISTS = frozenset("ul ol menu dir".split())
CELLS = frozenset(("td", "th"))
ROW_GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: What an opening tag ends first, and where the search for it stops.
ENDS = {
    "li": (frozenset(["li"]), LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (CELLS, frozenset(["tr", "table"])), "th": (CELLS, frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    **{g: (ROW_GROUPS | {"caption"}, frozenset(["table"])) for g in ROW_GROUPS},
}
#: An end tag does not reach past these.
WALLS = frozenset(["table", "td", "th", "html", "template"])

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NO_SHOW = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Columns with wider cells are not padded, so padding stays in proportion to the text.
WIDEST = 60


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def hidden(self) -> bool:
        return (self.tag in HIDDEN or "hidden" in self.attrs or bool(_NO_SHOW.search(self.attrs.get("style", "")))
                or (self.tag == "dialog" and "open" not in self.attrs))


def scan(page: str):
    """Yields ("text", string), ("open", tag, attribute string) and ("close", tag)."""
    at, last = 0, page.rfind(">")
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield "text", page[at:]
            return
        if lt > at:
            yield "text", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            continue
        after = page[lt + 1:lt + 3]
        if after[:1] in "!?":
            at = page.find(">", lt) + 1
            continue
        if not (after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha()):
            yield "text", "<"
            at = lt + 1
            continue
        found = _TAG.match(page, lt, min(len(page), lt + 65536)) or _TAG.match(page[lt:page.find(">", lt) + 1].replace('"', " ").replace("'", " "))
        at = lt + (found.end() - found.start())
        tag = found[1].lower()
        if after[0] == "/":
            yield "close", tag
            continue
        yield "open", tag, found[2]
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            stop = end.start() if end else len(page)
            yield "text", page[at:stop]
            at = stop
            if not end:
                return


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(text)}


def tree(page: str) -> Node:
    """Builds the tree, closing and opening the elements that the page implies."""
    root = Node("html", {})
    stack = [root]
    open_tags: Counter = Counter()  # spares searches of a deep stack

    def cut(k: int) -> None:
        open_tags.subtract(n.tag for n in stack[k:])
        del stack[k:]

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            open_tags[tag] += 1

    def end_any(tags: frozenset, stop: frozenset) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                cut(k)
                return
            if stack[k].tag in stop:
                return

    for token in scan(page):
        kind, value = token[0], token[1]
        if kind == "text":
            stack[-1].children.append(unescape(value))
        elif kind == "open":
            if value in ("html", "body"):
                root.attrs |= {k: v for k, v in attributes(token[2]).items() if k not in root.attrs}
                if value == "body":
                    end_any(frozenset(["head"]), frozenset())
                continue
            if value in BLOCKS:
                end_any(frozenset(["head"]), frozenset(["template"]))
                end_any(frozenset(["p"]), WALLS | {"button"})
            if value in ENDS:
                end_any(*ENDS[value])
            if value in CELLS and stack[-1].tag in ROW_GROUPS | {"table"}:
                push("tr", {})
            push(value, attributes(token[2]) if token[2].strip(" /") else {})
        elif open_tags[value]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == value:
                    cut(k)
                    break
                if stack[k].tag in WALLS and not (value in ("table", "tr") or value in ROW_GROUPS):
                    break
    return root


class Flow:
    """Lines of one block container: collapsed inline text, blank lines between blocks, prefixes."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.prefix: list[str] = []
        self.marker = ""
        self.gap = False

    def text(self, value: str) -> None:
        self.inline.append(value)

    def end_line(self, keep_empty: bool = False) -> None:
        line = _SPACE.sub(" ", "".join(self.inline)).strip(" \n")
        self.inline = []
        if line or keep_empty:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.prefix)
        if self.marker:
            lead = lead[:len(lead) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((lead + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced


class Grid:
    def __init__(self):
        self.rows: list[list[str]] = []

    def lines(self) -> list[str]:
        rows = [r for r in self.rows if any(r)]
        widths = [0] * max(map(len, rows), default=0)
        for r in rows:
            for k, cell in enumerate(r):
                if len(cell) <= WIDEST:
                    widths[k] = max(widths[k], len(cell))
        return ["  ".join(c.ljust(widths[k]) if k < len(r) - 1 else c for k, c in enumerate(r)).rstrip() for r in rows]


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows, grids, counters, pre = [Flow()], [], [], 0
    work: list[tuple] = [(root, False)]
    while work:
        node, leaving = work.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if pre:
                first, *more = node.split("\n")
                flow.text(first.replace(" ", " "))
                for line in more:
                    flow.end_line(keep_empty=True)
                    flow.text(line.replace(" ", " "))
            else:
                flow.text(node)
            continue
        tag = node.tag
        if not leaving:
            if node.hidden():
                continue
            if tag == "br":
                flow.end_line(keep_empty=True)
                continue
            if tag in VOID and tag != "hr":
                continue
            work.append((node, True))
            if tag == "table":
                flow.block(True)
                grids.append(Grid())
            elif tag == "tr" and grids:
                grids[-1].rows.append([])
            elif tag in CELLS and grids and grids[-1].rows:
                flows.append(Flow())
            elif tag in BLOCKS:
                flow.block(tag in SPACED and not (tag in LISTS and counters))
                if tag in LISTS:
                    start = node.attrs.get("start", "1")
                    counters.append(int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else None if tag != "ol" else 1)
                elif tag == "li":
                    mark = "- "
                    if counters and counters[-1] is not None:
                        mark = f"{counters[-1]}. "
                        counters[-1] += 1
                    flow.prefix.append(" " * len(mark))
                    flow.marker = mark
                elif tag in ("blockquote", "dd"):
                    flow.prefix.append("    ")
                elif tag == "pre":
                    pre += 1
            work.extend((child, False) for child in reversed(node.children))
            continue
        if tag == "table":
            for line in grids.pop().lines():
                flow.put(line)
            flow.gap = True
        elif tag in CELLS and grids and grids[-1].rows and len(flows) > 1:
            flow.end_line()
            flows.pop()
            span = node.attrs.get("colspan", "1")
            span = min(int(span), 100) if re.fullmatch(r"\d{1,4}", span) else 1
            grids[-1].rows[-1] += [" ".join(x.strip() for x in flow.lines if x.strip()), *[""] * (span - 1)]
        elif tag in BLOCKS:
            flow.block(tag in SPACED and not (tag in LISTS and len(counters) > 1))
            if tag in LISTS:
                counters.pop()
            elif tag in ("li", "blockquote", "dd"):
                flow.prefix.pop()
                flow.marker = ""
            elif tag == "pre":
                pre -= 1
    flows[0].end_line()
    return "\n".join(flows[0].lines).replace(" ", " ").strip("\n")


def visible_text(page: str | None) -> str:
    return render(tree(page)) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: its id, the visible text, n_lines with text, n_chars.

    Null and empty pages give the empty text; text without tags is one paragraph.  Tags left
    open or closed twice are repaired, broken markup never fails.  Null ids and repeated rows
    are rows like others; other columns are not read.
    """
    small_batches(pages.sparkSession)

    def extract(batches):
        for batch in batches:
            texts = [visible_text(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()),
                 pa.array([sum(1 for x in t.split("\n") if x.strip()) for t in texts], pa.int64()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "text", "n_lines", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(
        extract, f"id {kind}, text string, n_lines long, n_chars long").withColumnRenamed("id", id_col)
