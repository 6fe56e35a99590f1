"""HTML extraction by layout: the visible text of a page, with its block structure.

A tree builder supplies implied tags, visibility rules drop what a browser does not show, and
a renderer keeps blocks apart, marks list items and aligns table cells. Both walk with explicit
stacks, so deep nesting costs memory in proportion to the page and no recursion.

Rules. Hidden are head, scripts, styles, templates, ``noscript``, closed dialogs, elements with
the ``hidden`` attribute or with ``display:none``, and text under ``visibility:hidden`` that no inner
element makes visible again. Paragraphs, headings, quotes, lists and tables stand apart by an
empty line, other blocks by a line break; blanks collapse outside ``pre`` and ``textarea``. List items begin
with ``- `` or their number and are indented by depth. Cells of a row stand on shared lines, two
blanks apart, padded to their column's width (40 at most, so that one long cell does not blow
up all others); spans occupy the columns they cover.

Defined cases. A null page gives null, an empty one or one without visible text an empty text.
Unclosed tags, comments and quotes run to the end of the page. Repeated rows repeat. Extra
columns are kept; new columns replace those of the same name.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
BLANKS = re.compile(r"[ \t\n\r\f]+")
INVISIBLE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(\w+)", re.I)

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object datalist audio video canvas".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
BLOCKS = APART | frozenset(
    "html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup hr legend li main "
    "menu nav section summary option optgroup select tr caption textarea".split())
CLOSES_P = (BLOCKS - frozenset("html body option optgroup select legend tr caption textarea".split()))
#: A start tag closes open elements of the second set, unless one of the third stands between.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    **{x: ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, {"html"}),
}
IN_TABLE = frozenset("td th tr li thead tbody tfoot caption".split())
#: Start tags that leave an open head open; all others, and text, end it.
HEAD_CONTENT = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
TOPS = frozenset("button object template html body".split())
WALLS = frozenset("table td th caption button object template html body".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attr(self, name: str) -> str | None:
        """Value of an attribute, empty without one; None where it is absent."""
        if name not in self.attrs.lower():
            return None
        for key, value in ATTRIBUTES.findall(self.attrs):
            if key.lower() == name:
                return html.unescape(value.strip("\"'"))
        return None


def tag_end(page: str, at: int) -> int:
    """Index past the tag that starts at ``at``; quoted values may hold a closing bracket."""
    close = page.find(">", at)
    if close < 0:
        return len(page)
    i = at
    while True:
        quote = min((k for q in "\"'" if (k := page.find(q, i, close)) >= 0), default=-1)
        if quote < 0 or not page[at:quote].rstrip().endswith("="):
            return close + 1
        i = page.find(page[quote], quote + 1) + 1
        if not i:
            return close + 1
        if i > close:
            close = page.find(">", i)
            if close < 0:
                return len(page)


def build(page: str) -> Node:
    """The page's tree."""
    root = Node("#root")
    stack: list[Node] = [root]
    open_: dict[str, list[int]] = {}  # places on the stack, by tag

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        open_.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().tag].pop()

    def top(tags: set[str] | frozenset[str]) -> int:
        """Place of the nearest open element of ``tags``; 0 is the root."""
        return max((open_[t][-1] for t in tags if open_.get(t)), default=0)

    def close(tags: set[str], walls: frozenset[str] | set[str], nearest: bool = False) -> None:
        """Close the outermost open element of ``tags`` this side of a wall, or the nearest one."""
        last = top(tags)
        wall = top(walls - tags) if last else 0
        if last > wall:
            pop_to(last if nearest else min(p[bisect_right(p, wall)] for t in tags if (p := open_.get(t)) and p[-1] > wall))

    def end_head() -> None:
        while stack[-1].tag == "head":
            pop_to(len(stack) - 1)

    def text(a: int, b: int) -> None:
        if stack[-1].tag == "head" and page[a:b].strip(" \t\n\r\f"):
            end_head()
        if b > a:
            stack[-1].children.append(html.unescape(page[a:b]) if page.find("&", a, b) >= 0 else page[a:b])

    at, n, lower = 0, len(page), None
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(at, n)
            break
        if page.startswith("<!--", lt):
            text(at, lt)
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        match = NAME.match(page, lt + 1)
        if not match:
            if page[lt + 1:lt + 2] in ("!", "?", "/"):
                text(at, lt)
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:  # a lone bracket is text
                text(at, lt + 1)
                at = lt + 1
            continue
        text(at, lt)
        at = tag_end(page, match.end())
        tag = match[1].lower()
        if page[lt + 1] == "/":
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not open_.get("p"):
                stack[-1].children.append(Node("p"))
            else:
                close({tag}, {"table"} if tag in IN_TABLE else TOPS if tag == "table" else WALLS - {tag}, nearest=True)
            continue
        attrs = page[match.end():at - 1]
        if tag not in HEAD_CONTENT:
            end_head()
        if tag in CLOSES_P:
            close({"p"}, WALLS)
        if tag in CLOSED_BY:
            close(*CLOSED_BY[tag])
        node = Node(tag, attrs)
        if tag in VOID:
            stack[-1].children.append(node)
        elif tag in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == n else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
            end = lower.find(f"</{tag}", at)
            end = n if end < 0 else end
            node.children.append(html.unescape(page[at:end]) if tag == "textarea" else page[at:end])
            stack[-1].children.append(node)
            at = min(n, page.find(">", end) + 1 or n)
        else:
            push(node)
    return root


class Text:
    """Lines under construction; a gap is 1 for a new line, 2 for an empty line between."""

    def __init__(self):
        self.lines, self.gap, self.blank, self.indent, self.mark = [], 2, False, 0, ""

    def add(self, words: str) -> None:
        """Running text, blanks collapsed."""
        bare = BLANKS.sub(" ", words)
        if bare in ("", " "):
            self.blank |= bare == " "
            return
        self.blank |= bare[0] == " "
        self.put(bare.strip(" "))
        self.blank = bare[-1] == " "

    def put(self, piece: str) -> None:
        if self.gap or not self.lines:
            if self.gap > 1 and self.lines:
                self.lines.append([])
            mark, self.mark = self.mark, ""
            self.lines.append([" " * max(0, self.indent - len(mark)) + mark])
        elif self.blank:
            self.lines[-1].append(" ")
        self.lines[-1].append(piece)
        self.gap, self.blank = 0, False

    def need(self, gap: int) -> None:
        self.gap, self.blank = max(self.gap, gap), False

    def keep(self, words: str) -> None:
        """Preformatted text."""
        for i, line in enumerate(words.split("\n")):
            if i:
                if self.gap == 1 and self.lines:
                    self.lines.append([])
                self.gap = max(self.gap, 1)
            if line.strip():
                self.put(line)

    def done(self) -> list[str]:
        return ["".join(x).rstrip() for x in self.lines]


def aligned(rows: list[list[tuple[int, list[str]]]]) -> list[str]:
    """Lines of a table from rows of (column, cell lines)."""
    width: dict[int, int] = {}
    for row in rows:
        for column, lines in row:
            width[column] = max(width.get(column, 0), min(40, max(map(len, lines), default=0)))
    columns = sorted(width)
    place = {c: i for i, c in enumerate(columns)}
    out = []
    for row in rows:
        for k in range(max((len(lines) for _, lines in row), default=0)):
            line, last = [], 0
            for column, lines in row:
                line += ["".ljust(width[c]) for c in columns[last:place[column]]]
                line.append((lines[k] if k < len(lines) else "").ljust(width[column]))
                last = place[column] + 1
            out.append("  ".join(line).rstrip())
    return out


def number(value: str | None, default: int, most: int) -> int:
    match = re.match(r"\s*(-?[0-9]{1,9})", value or "")
    return min(int(match[1]), most) if match else default


def render(root: Node) -> str:
    """Visible text of a tree."""
    texts, tables, lists = [Text()], [], []
    # (node or string, leaving, shown, preformatted)
    work: list[tuple[Node | str, bool, bool, bool]] = [(root, False, True, False)]
    while work:
        node, leaving, shown, pre = work.pop()
        out = texts[-1]
        if isinstance(node, str):
            if shown:
                out.keep(node) if pre else out.add(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and tables and tables[-1]["cells"]:
                lines = texts.pop().done()
                column = tables[-1]["cells"].pop()
                tables[-1]["row"].append((column, lines))
            elif tag == "table":
                table = tables.pop()
                if table["row"]:
                    table["rows"].append(table["row"])
                for line in aligned(table["rows"]):
                    out.need(1)
                    out.put(line)
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
                out.indent -= 2
            if tag in BLOCKS:
                out.need(2 if tag in APART and not (tag in ("ul", "ol", "menu") and lists) else 1)
            continue
        style = node.attr("style") if node.attrs else None
        if tag in UNSEEN or node.attrs and (node.attr("hidden") is not None or style and INVISIBLE.search(style)) or (
                tag == "dialog" and node.attr("open") is None):
            continue
        if style and (seen := VISIBILITY.search(style)):
            shown = seen[1].lower() not in ("hidden", "collapse")
        if tag in BLOCKS:
            out.need(2 if tag in APART and not (tag in ("ul", "ol", "menu") and lists) else 1)
        if tag == "br":
            if out.gap == 0:
                out.gap = 1
            else:
                out.need(2)
            continue
        if tag in ("ul", "ol", "menu"):
            lists.append([tag == "ol", number(node.attr("start"), 1, 10**9)])
            out.indent += 2
        elif tag == "li":
            numbered = lists[-1] if lists else [False, 1]
            if numbered[0]:
                numbered[1] = number(node.attr("value"), numbered[1], 10**9)
            out.mark = f"{numbered[1]}. " if numbered[0] else "- "
            numbered[1] += 1
        elif tag == "table":
            tables.append({"rows": [], "row": [], "cells": [], "next": 0, "held": {}})
        elif tag == "tr" and tables:
            table = tables[-1]
            if table["row"]:
                table["rows"].append(table["row"])
            table["held"] = {c: n - 1 for c, n in table["held"].items() if n > 1}
            table["row"], table["next"] = [], 0
        elif tag in ("td", "th") and tables:
            table = tables[-1]
            while table["next"] in table["held"]:
                table["next"] += 1
            column = table["next"]
            over, down = number(node.attr("colspan"), 1, 1000), number(node.attr("rowspan"), 1, 65534)
            if down > 1:
                table["held"].update({c: down for c in range(column, column + max(over, 1))})
            table["next"] = column + max(over, 1)
            table["cells"].append(column)
            texts.append(Text())
        elif tag == "img" or tag == "input":
            continue
        pre = pre or tag in ("pre", "textarea", "xmp")
        work.append((node, True, shown, pre))
        work.extend((child, False, shown, pre) for child in reversed(node.children))
    return "\n".join(texts[0].done()).strip("\n")


def visible_text(page: str | None) -> str | None:
    return None if page is None else render(build(page))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """The pages with their visible text in ``out_col``."""

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([visible_text(x) for x in batch], dtype=object)

    kept = [F.col(f"`{c}`") for c in pages.columns if c != out_col]
    return pages.select(*kept, F.pandas_udf(scan, "string")(F.col(f"`{html_col}`")).alias(out_col))
