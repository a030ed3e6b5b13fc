"""A small HTML reader: a tree of elements, and the blocks of text in it, each with the path of elements around it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|$)|([^<]+|<)", re.S
)
ATTRIBUTE = re.compile(r"([A-Za-z_:@][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Fixed values of HTML: elements without content, with raw content, and those that stand within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
# Fixed values of HTML: what an opening element closes, and where that search ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
CLOSE_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p "
    "pre section table ul".split()
)
P_SCOPE = frozenset("article aside blockquote body div footer header main nav section td th li table figure form".split())


class Node:
    __slots__ = ("tag", "marks", "children")

    def __init__(self, tag: str, marks: str):
        self.tag, self.marks, self.children = tag, marks, []

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.marks}" if self.marks else self.tag


def marks_of(attributes: str) -> str:
    """What the attributes say an element is for: its class, id and role, in lower case."""
    if not attributes or "=" not in attributes:
        return " hidden" if attributes and "hidden" in attributes.lower().split() else ""
    found = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))
    words = [unescape(found[k]).lower() for k in ("class", "id", "role", "itemprop") if found.get(k)]
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        words.append("hidden")
    return " ".join(" ".join(words).split())


def parse(html: str) -> Node:
    """The tree of a page; children are nodes and strings. Raw elements are left out, mistakes are mended."""
    root = Node("html", "")
    stack, at, n = [root], 0, len(html)
    # How many elements of a tag are open, so that the stack is only searched for what is there.
    open_: Counter = Counter()

    def close(i: int) -> None:
        open_.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < n:
        m = TOKEN.match(html, at)
        if not m:
            break
        at = m.end()
        if m[5] is not None:
            stack[-1].children.append(unescape(m[5]) if "&" in m[5] else m[5])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else n
            continue
        if tag in ("html", "head", "body"):
            if tag == "body" and len(stack) > 1:
                close(1)
            continue
        if tag in CLOSE_P and open_["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in P_SCOPE:
                    break
        if tag in CLOSES:
            own, scope = CLOSES[tag]
            outermost = 0
            for i in range(len(stack) - 1, 0, -1) if any(open_[x] for x in own) else ():
                if stack[i].tag in scope:
                    break
                if stack[i].tag in own:
                    outermost = i
            if outermost:
                close(outermost)
        node = Node(tag, marks_of(m[3].strip()) if m[3] else "")
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def blocks(root: Node) -> list[tuple[str, str]]:
    """(path, text) of each block in page order. Inline elements belong to the line around them; white space is one space."""
    out: list[tuple[str, str]] = []
    line: list[str] = []
    path = ""

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append((path, text))

    todo: list = [(root, "", iter(root.children))]
    while todo:
        node, here, children = todo[-1]
        for child in children:
            if isinstance(child, str):
                line.append(child)
                path = here
            elif child.tag == "br":
                line.append(" ")
            elif child.tag in INLINE:
                todo.append((child, here, iter(child.children)))
                break
            else:
                flush()
                inner = f"{here}/{child.label}"
                todo.append((child, inner, iter(child.children)))
                break
        else:
            todo.pop()
            if node.tag not in INLINE:
                flush()
    flush()
    return out


def paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, n (from 0), path, text: the blocks of text of every page; null html has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, p, t) for i, h in zip(b["id"].tolist(), b["html"].tolist(), strict=True) for n, (p, t) in enumerate(blocks(parse(h)))]
            yield pd.DataFrame(rows, columns=["id", "n", "path", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(html_col, F.lit("")).alias("html"))
    return rows.mapInPandas(run, "id long, n long, path string, text string")


def tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, table_no, row_no, cells: the cells of every table, as text."""

    def inner(node: Node) -> list[Node]:
        return [c for c in reversed(node.children) if isinstance(c, Node)]

    def found(root: Node) -> list[Node]:
        out, todo = [], inner(root)
        while todo:
            node = todo.pop()
            if node.tag == "table":
                out.append(node)
            todo += inner(node)
        return out

    def rows_of(table: Node) -> list[list[str]]:
        out, todo = [], inner(table)
        while todo:
            node = todo.pop()
            if node.tag == "tr":
                out.append([" ".join(t for _, t in blocks(c)) for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")])
            elif node.tag != "table":
                todo += inner(node)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, k, n, cells)
                for i, h in zip(b["id"].tolist(), b["html"].tolist(), strict=True)
                for k, t in enumerate(found(parse(h)))
                for n, cells in enumerate(rows_of(t))
            ]
            yield pd.DataFrame(rows, columns=["id", "table_no", "row_no", "cells"])

    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(html_col, F.lit("")).alias("html"))
    return rows.mapInPandas(run, "id long, table_no long, row_no long, cells array<string>")
