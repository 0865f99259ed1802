"""Visible text of web pages with the spacing of their layout.

A page becomes a tree (void elements, implied end tags of p, li, dt, dd, tr, td,
th and option, raw script and style); what the tree hides (head, script, hidden,
display:none, closed details but for their summary, ...) is left out. Paragraph
blocks stand between empty lines, other blocks on lines of their own, list items
behind `- ` or their number, two spaces deeper for each list; pre keeps its
spaces; a table's cells are padded to the width of their column, two spaces
apart.

Defined results: null and empty pages give an empty text; markup that never
closes is closed at the end; an end tag without its start is ignored; repeated
rows are rendered row by row; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Elements by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address li dt dd tr caption thead tbody tfoot details summary figcaption legend option center".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe object audio video canvas svg math".split())
RAW = frozenset("script style textarea title".split())
#: A start tag on the left ends an open element on the right, up to the nearest of the bounds.
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")), "thead": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody"), ("table",)),
    "body": (("head",), ("html",)),
}
NOT_IN_HEAD = BLOCK - {"html"}

OPENS = re.compile(r"<(?:!--|[!?]|(/?)[a-zA-Z])")
NAME = re.compile(r"[^\s/>]++")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Markup:
    """Tags, comments and declarations of a page, found in time linear in its length.

    A tag ends at the first > outside of quotes, or where a quote never closes at
    the first > at all. A search that ran into an unclosed quote remembers where
    its quotes opened, as another that opens one there would end alike.
    """

    def __init__(self, page: str):
        self.page, self.last, self.lost = page, page.rfind(">"), set()

    def ending(self, at: int) -> int:
        """The > of a tag whose attributes begin at `at`; there is one."""
        k, opened = at, []
        while q := STOP.search(self.page, k):
            p = q.start()
            if self.page[p] == ">":
                return p
            if p in self.lost:
                break
            opened.append(p)
            close = self.page.find(self.page[p], p + 1)
            if close < 0:
                break
            k = close + 1
        self.lost.update(opened)
        return self.page.find(">", at)

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it is an end tag, name and attributes of the next; comments and declarations have no name."""
        while m := OPENS.search(self.page, at):
            start = m.start()
            if m[1] is None:
                close = "-->" if m[0] == "<!--" else ">"
                end = self.page.find(close, m.end())
                return start, end + len(close) if end >= 0 else len(self.page), False, "", ""
            if start < self.last:
                name = NAME.match(self.page, m.end() - 1)
                end = self.ending(name.end())
                return start, end + 1, bool(m[1]), name[0].lower(), self.page[name.end() : end]
            at = m.end()
        return None


class Node:
    __slots__ = ("tag", "parts", "hidden", "attributes")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.parts, self.attributes = tag, [], attributes
        self.hidden = tag in HIDDEN or "hidden" in attributes or bool(NONE.search(attributes.get("style", "")))


def tree(page: str) -> Node:
    root = Node("html", {})
    open_ = [root]
    n_open = Counter()  # by tag, so that nobody looks for what isn't open

    def close_from(k: int) -> None:
        n_open.subtract(n.tag for n in open_[k:])
        del open_[k:]

    def end(tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        if not any(n_open[t] for t in tags):
            return
        found = 0
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                found = k
            elif open_[k].tag in bounds:
                break
        if found:
            close_from(found)

    markup, at = Markup(page), 0
    while at < len(page):
        start, end_, closes, tag, rest = markup.after(at) or (len(page), len(page), False, "", "")
        if start > at:
            open_[-1].parts.append(unescape(page[at:start]))
        at = end_
        if not tag:
            continue
        if closes:
            for k in range(len(open_) - 1, 0, -1) if n_open[tag] else ():
                if open_[k].tag == tag:
                    close_from(k)
                    break
                if open_[k].tag == "table" and tag not in BLOCK:
                    break
            continue
        if tag == "html":
            continue
        if tag in NOT_IN_HEAD:
            end(("head",), ())
            end(("p",), ("table", "td", "th", "li", "button", "object"))
        if tag in ENDS:
            end(*ENDS[tag])
        node = Node(tag, {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(rest)} if rest.strip() else {})
        open_[-1].parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            close = close.start() if close and close.start() < markup.last else len(page)
            node.parts.append(unescape(page[at:close]))
            at = page.find(">", close) + 1 or len(page)
        elif tag not in VOID and not rest.endswith("/") or tag in BLOCK and tag not in VOID:
            open_.append(node)
            n_open[tag] += 1
    return root


class Text:
    """Lines of text with the breaks that blocks ask for."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.indent, self.mark = "", 0, 0, ""

    def words(self, text: str, keep: bool) -> None:
        if keep:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self.line = self.line or " "
                    self.end(0)
                self.add(part)
            return
        text = SPACES.sub(" ", text)
        if not self.line or self.line.endswith(" "):
            text = text.lstrip(" ")
        self.add(text)

    def add(self, text: str) -> None:
        if text:
            if not self.line:
                if self.gap > 1 and self.lines:
                    self.lines.append("")
                self.gap = 0
            self.line += text

    def end(self, gap: int) -> None:
        """Ends the line; gap 2 asks for an empty line before the next."""
        if self.line:
            line = self.line.rstrip()
            lead = (" " * max(0, self.indent - 2) + self.mark if self.mark else " " * self.indent) if line else ""
            self.lines.append(lead + line)
            self.line, self.mark = "", ""
        self.gap = max(self.gap, gap)

    def whole(self) -> str:
        self.end(0)
        return "\n".join(self.lines)


def aligned(rows: list[list[str]]) -> list[str]:
    widths = [max((len(r[k]) for r in rows if k < len(r)), default=0) for k in range(max(map(len, rows), default=0))]
    return ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=False)).rstrip() for r in rows]


def visible_text(page: str | None) -> str:
    out, saved, numbers, pre = Text(), [], [], 0
    stack: list[tuple[object, bool]] = [(tree(page or ""), True)]
    while stack:
        x, starts = stack.pop()
        if isinstance(x, str):
            out.words(x, pre > 0)
            continue
        tag = x.tag
        if starts and x.hidden:
            continue
        gap = 2 if tag in SPACED else 1
        if starts:
            if tag == "br":
                out.line = out.line or " "
                out.end(0)
                continue
            if tag in BLOCK:
                out.end(gap if not (tag in ("ul", "ol") and numbers) else 1)
            if tag in ("ul", "ol"):
                start = x.attributes.get("start", "")
                numbers.append((int(start) if start.lstrip("-").isdecimal() and len(start) < 9 else 1) if tag == "ol" else None)
                out.indent += 2
            elif tag == "li" and numbers:
                out.mark = f"{numbers[-1]}. " if numbers[-1] is not None else "- "
                numbers[-1] = numbers[-1] + 1 if numbers[-1] is not None else None
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                saved.append((out, []))
                out = Text()
            elif tag == "tr" and saved:
                saved[-1][1].append([])
            elif tag in ("td", "th") and saved:
                if not saved[-1][1]:
                    saved[-1][1].append([])
                out.end(1)
                saved.append((out, None))
                out = Text()
            stack.append((x, False))
            parts = x.parts
            if tag == "details" and "open" not in x.attributes:
                parts = [p for p in parts if isinstance(p, Node) and p.tag == "summary"]
            stack += [(p, True) for p in reversed(parts)]
            continue
        if tag in ("td", "th") and saved and saved[-1][1] is None:
            cell, out = SPACES.sub(" ", out.whole()).strip(), saved.pop()[0]
            rows = saved[-1][1] if saved else None
            if rows:
                rows[-1].append(cell)
        elif tag == "table" and saved:
            beside, (out, rows) = out.whole(), saved.pop()
            for line in [*beside.split("\n"), *aligned([r for r in rows if any(r)])]:
                if line:
                    out.add(line)
                    out.end(1)
        elif tag == "pre":
            pre -= 1
        elif tag in ("ul", "ol"):
            out.end(1)
            numbers.pop()
            out.indent -= 2
        if tag in BLOCK:
            out.end(gap if not (tag in ("ul", "ol") and numbers) else 1)
            if tag == "li":
                out.mark = ""
    return out.whole().strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id and the visible text of every row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(h.as_py()) for h in batch.column(1)], pa.string())], names=["page_id", "text"])

    pages = pages.select(pages["page_id"].cast("long"), "html")
    return pages.mapInArrow(part, "page_id long, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
