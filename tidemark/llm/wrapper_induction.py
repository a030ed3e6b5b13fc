"""HTML extraction by wrapper induction.

Pages of a host are dealt in small groups and aligned one after the other by simple tree matching: the largest set of
matched nodes that keeps parents and order. On matched paths, a text that both pages have is a vote for template; the
rest varies, and so is a slot. The article is the deepest element that still holds most of the varying text of the
host's pages; template goes from it, and what varies elsewhere (adverts, teasers, comments) isn't in it. Tags and marks
only break ties: what an element calls itself counts where pages alone can't tell, and where a host has too few of them.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.html import INLINE, Node, parse

from .common import written

# Elements, and words in class, id or role, that say a part isn't the article.
ASIDE_TAGS = frozenset("nav footer aside form button select dialog menu svg object audio video canvas".split())
ASIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|nav|navbar|"
    r"navigation|menu|breadcrumb|breadcrumbs|sidebar|side|footer|foot|cookie|cookies|consent|gdpr|notice|banner|alert|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|"
    r"comment|comments|disqus|reply|replies|respond|widget|toolbar|pager|pagination|skip|search|hidden|complementary|"
    r"contentinfo)(?:$|[\s_-])"
)
HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|site-title)(?:$|[\s_-])")
ARTICLE_WORDS = re.compile(r"(?:^|\s)(?:articlebody|article|post-content|entry-content|article-body)(?:$|\s)")
#: Elements that hold a text themselves; what they are called says little about it.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split()) | INLINE
HEADINGS = frozenset(("h1", "h2"))
#: Longer paths are named by a digest, so that paths of deep pages don't grow with the square of the depth.
LONG_PATH = 1000


@functools.lru_cache(1 << 14)
def kind_of(tag: str, marks: str) -> str:
    """What an element says it is: aside (by its tag), marked (by its words), header, article, main, or nothing."""
    if tag in ASIDE_TAGS or marks and "hidden" in marks.split():
        return "aside"
    if tag == "article" or marks and ARTICLE_WORDS.search(marks):
        return "article"
    if tag == "header" or marks and HEADER_WORDS.search(marks):
        return "header"
    if marks and ASIDE_WORDS.search(marks):
        return "named" if tag in TEXT_TAGS else "marked"
    return "main" if tag == "main" or marks and re.search(r"(?:^|\s)main(?:$|\s)", marks) else ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


@dataclass(frozen=True, slots=True)
class Place:
    """Where a text stands. aside: within one by its tag; marked: how long the path is to the outermost element that is one
    by its words, 0 if there is none; named: its own text element is; article: number of the article element, from 1.
    """

    path: str = ""
    aside: bool = False
    marked: int = 0
    named: bool = False
    header: bool = False
    main: bool = False
    article: int = 0

    def within(self, node: Node, number: int) -> Place:
        kind = kind_of(node.tag, node.marks)
        here = self.path if len(self.path) < LONG_PATH else "/~" + hashlib.blake2b(self.path.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        path = f"{here}/{node.label.replace('/', ' ')}"
        return Place(
            path,
            self.aside or kind == "aside",
            self.marked or (len(path) if kind == "marked" else 0),
            kind == "named",
            self.header or kind == "header" and not self.article,
            self.main or kind == "main",
            self.article or (number if kind == "article" else 0),
        )


@dataclass(slots=True)
class Line:
    """A block of text of a page."""

    path: str
    text: str
    aside: bool
    marked: int
    named: bool
    header: bool
    main: bool
    article: int


def lines_of(root: Node) -> list[Line]:
    """The blocks of text in page order. Inline elements belong to the line around them; white space is one space."""
    out: list[Line] = []
    line: list[str] = []
    at, articles = Place(), 0

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(Line(at.path, text, at.aside, at.marked, at.named, at.header, at.main, at.article))

    todo = [(root, at, iter(root.children))]
    while todo:
        node, here, children = todo[-1]
        for child in children:
            if isinstance(child, str):
                line.append(child)
                if not child.isspace():
                    at = here
            elif child.tag == "br":
                line.append(" ")
            elif child.tag in INLINE and kind_of(child.tag, child.marks) != "aside":
                todo.append((child, here, iter(child.children)))
                break
            else:
                flush()
                articles += 1
                todo.append((child, here.within(child, articles), iter(child.children)))
                break
        else:
            todo.pop()
            if node.tag not in INLINE or kind_of(node.tag, node.marks) == "aside":
                flush()
    flush()
    return out


class Shape:
    """A tree for alignment: runs of like siblings are one node. path: as in lines_of(); form: equal for equal trees."""

    __slots__ = ("label", "path", "children", "form")

    def __init__(self, label: str, path: str):
        self.label, self.path, self.children, self.form = label, path, [], 0


def shape_rows(root: Node) -> list[tuple[int, str, str]]:
    """The tree of a page in order, as depth, label and path of each node."""
    out = [(0, "", "")]
    stack: list[tuple[list[Node], Place, int]] = [([root], Place(), 0)]  # runs of like siblings
    while stack:
        nodes, place, depth = stack.pop()
        if depth:
            out.append((depth, nodes[0].label, place.path))
        runs: list[list[Node]] = []
        for node in nodes:
            last = None
            for child in node.children:
                if isinstance(child, Node):
                    if last is not None and last[0].label == child.label:
                        last.append(child)
                    else:
                        last = [child]
                        runs.append(last)
        stack += [(run, place.within(run[0], 0), depth + 1) for run in reversed(runs)]
    return out


def shape_of(rows: list[tuple[int, str, str]]) -> Shape:
    """The tree that shape_rows() tells of."""
    made = [Shape(label, path) for _, label, path in rows]
    open_: list[int] = []
    for n, (depth, _, _) in enumerate(rows):
        del open_[depth:]
        if open_:
            made[open_[-1]].children.append(made[n])
        open_.append(n)
    for x in reversed(made):
        x.form = hash((x.label, *(c.form for c in x.children)))
    return made[0]


def match(a: Shape, b: Shape) -> tuple[int, list[tuple[Shape, Shape]]]:
    """Simple tree matching: the size of the largest matching of two trees with like roots, and its pairs."""
    done: dict[tuple[int, int], tuple[int, list[tuple[Shape, Shape]]]] = {}
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (id(x), id(y)) in done:
            todo.pop()
            continue
        if x.form == y.form:  # equal trees match node by node
            pairs = list(zip(x.children, y.children, strict=True))
        else:
            common = {c.label for c in x.children} & {c.label for c in y.children}
            xs, ys = [c for c in x.children if c.label in common], [c for c in y.children if c.label in common]
            pairs = [(c, d) for c in xs for d in ys if c.label == d.label]
        missing = [p for p in pairs if (id(p[0]), id(p[1])) not in done]
        if missing:
            todo += missing
            continue
        if x.form == y.form:
            chosen = pairs
        else:
            size = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for i, c in enumerate(xs):
                above, row = size[i], size[i + 1]
                for j, d in enumerate(ys):
                    most = above[j + 1] if above[j + 1] > row[j] else row[j]
                    if c.label == d.label and (n := above[j] + done[id(c), id(d)][0]) > most:
                        most = n
                    row[j + 1] = most
            chosen, i, j = [], len(xs), len(ys)
            while i and j:
                if size[i][j] == size[i - 1][j]:
                    i -= 1
                elif size[i][j] == size[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    chosen.append((xs[i], ys[j]))
        done[id(x), id(y)] = 1 + sum(done[id(c), id(d)][0] for c, d in chosen), chosen
        todo.pop()
    out, rest = [], [(a, b)]
    while rest:
        x, y = rest.pop()
        out.append((x, y))
        rest += done[id(x), id(y)][1]
    return done[id(a), id(b)][0], out


def line_key(path: str, text: str) -> str:
    """A path and a text on it."""
    return path + "\n" + hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def votes(a: Shape, b: Shape, ours: list[tuple[str, str, int, bool]], theirs: list[tuple[str, str, int, bool]]) -> list[tuple[str, str | None, int]]:
    """ours, theirs: path, key, characters and whether it may be the article's, of each line. Of the matched paths with text:
    path, no key and how many of our characters vary; and path and key of each line that both pages have there.
    Nothing from pages that differ nowhere.
    """
    if [x[1] for x in ours] == [x[1] for x in theirs]:
        return []
    mine: dict[str, dict[str, int]] = {}
    for path, key, n, free in ours:
        mine.setdefault(path, {})[key] = n if free else 0
    other = {key for _, key, _, _ in theirs}
    out: list[tuple[str, str | None, int]] = []
    for path in dict.fromkeys(x.path for x, _ in match(a, b)[1]):
        if path in mine:
            out.append((path, None, sum(n for key, n in mine[path].items() if key not in other)))
            out += [(path, key, 0) for key in mine[path] if key in other]
    return out


def content(found: list[Line], region: str | None, template: set[str]) -> tuple[str, str]:
    """The text of the article among a page's lines, and what decided: template, tags, or nothing ("all")."""
    kept = [x for x in found if not x.aside]
    if region:
        inside = [x for x in kept if x.path == region or x.path.startswith(region + "/")]
        if inside:
            around = region.split("/")
            parents = {"/".join(around[:n]) for n in range(1, len(around))}
            # A heading beside the region, or beside what it lies in, is the article's.
            picked = [
                x
                for x in kept
                if x.path == region or x.path.startswith(region + "/")
                or x.path.rpartition("/")[0] in parents and x.path.rpartition("/")[2].partition(".")[0] in HEADINGS
                and not x.header and not x.marked and line_key(x.path, x.text) not in template
            ]
            return _body([x for x in picked if x.marked <= len(region)], template), "template"
    plain = [x for x in kept if not x.marked]
    article = [x for x in plain if x.article] or [x for x in plain if x.main]
    if article:
        return _body(article, template), "tags"
    return _body([x for x in plain if not x.header], template), "all"


def _body(lines: list[Line], template: set[str]) -> str:
    """Drops template, teasers beside an article, and nothing else. Within an article element, template is what also has a
    name for it: there, alike texts of many pages are as likely to be copies of an article.
    """
    sizes: dict[int, int] = {}
    for x in lines:
        if x.article:
            sizes[x.article] = sizes.get(x.article, 0) + len(x.text)
    most = max(sizes.values(), default=0)
    whole = [x for x in lines if not x.article or 3 * sizes[x.article] >= most]
    slots = [x for x in whole if line_key(x.path, x.text) not in template or x.article and not x.named]
    return "\n".join(x.text for x in slots or whole)


def extract_main_text(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    share: float = 0.9,
    most: float = 0.6,
    least_votes: int = 5,
    group: int = 64,
) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, decided.

    text: the blocks of the article in page order, joined by a line feed. The article is the deepest element that holds at
    least `most` of what varies between aligned pages of the host, with the headings beside it. A text on a path is
    template if at least `share` of at least `least_votes` aligned pairs both have it there; it goes, but from an article
    element only if its own element is named as a menu, advert or the like. Elements that are or are named so go.
    decided: "template" where the host's pages told which element it is; "tags" where they are too few or the page lacks
    it, and an article or main element did; else "all".

    Pages are aligned in groups of about `group` of a host, which depend on the pages alone, not on how Spark deals them;
    a host of any size is so spread over tasks. On a host without article elements whose pages are mostly near copies,
    what these have in common can't be told from template and goes from the copies.

    Null html: an empty text. A null or odd url: such pages share one host. Repeated pages align without votes, as they
    differ nowhere. Of elements that hold equally much the deepest one is taken, then the first by name. Long and deep
    pages are read whole. Other columns are ignored; an empty table gives no rows.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    ).withColumn("host", host_of(F.col("url")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for html in b["html"].tolist():
                tree = parse(html)
                found = lines_of(tree)
                flags = [[x.aside, x.marked, x.named, x.header, x.main, x.article] for x in found]
                free = [not (x.aside or x.marked or x.header) for x in found]
                keys = [(x.path, line_key(x.path, x.text), len(x.text), f) for x, f in zip(found, free, strict=True)]
                shape = press.compress(json.dumps([shape_rows(tree), keys]).encode())
                out.append((shape, [x.path for x in found], [x.text for x in found], json.dumps(flags)))
            made = pd.DataFrame(out, columns=["shape", "paths", "texts", "flags"])
            yield made.assign(page_id=b["page_id"].astype("Int64"), url=b["url"], host=b["host"], h=b["h"])

    read_schema = "page_id long, url string, host string, h long, shape binary, paths array<string>, texts array<string>, flags string"
    known = written(rows.withColumn("h", F.xxhash64("html", "page_id")).mapInPandas(read, read_schema))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, before, press = None, None, zstandard.ZstdDecompressor()
        for b in batches:
            out: dict[tuple, list[int]] = {}
            for host, n, data in zip(b["host"].tolist(), b["group"].tolist(), b["shape"], strict=True):
                shape, keys = json.loads(press.decompress(data))
                now = shape_of([tuple(x) for x in shape]), [tuple(x) for x in keys]
                if at == (host, n):
                    for path, key, chars in votes(now[0], before[0], now[1], before[1]):
                        vote = out.setdefault((host, path, key), [0, 0])
                        vote[0] += 1
                        vote[1] += chars
                at, before = (host, n), now
            yield pd.DataFrame([(*k, *v) for k, v in out.items()], columns=["host", "path", "line", "n", "chars"])

    sizes = known.groupBy("host").agg(F.ceil(F.count("*") / group).cast("int").alias("groups"))
    dealt = known.select("host", "page_id", "h", "shape").join(sizes, "host").withColumn("group", F.pmod("h", "groups").cast("int"))
    dealt = dealt.repartition("host", "group").sortWithinPartitions("host", "group", "page_id", "h")
    cast = written(dealt.select("host", "group", "shape").mapInPandas(align, "host string, path string, line string, n long, chars long"))
    counted = cast.groupBy("host", "path", "line").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    pairs = F.max(F.when(F.col("line").isNull(), F.col("n"))).over(Window.partitionBy("host", "path"))
    fixed = counted.withColumn("pairs", pairs).where(F.col("line").isNotNull() & (F.col("pairs") >= least_votes) & (F.col("n") >= share * F.col("pairs")))
    template = fixed.groupBy("host").agg(F.collect_list("line").alias("template"))
    # Each element holds what varies on the paths below it, not in its own lines: a paragraph holds nothing.
    slots = counted.where("line is null and chars > 0 and n >= " + str(least_votes))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    held = slots.where(F.size(parts) > 2).select("host", "chars", F.explode(above).alias("element"))
    held = held.groupBy("host", "element").agg(F.sum("chars").alias("held"))
    total = slots.groupBy("host").agg(F.sum("chars").alias("total"))
    # Elements that hold more than half lie within each other, so the deepest is one.
    region = held.join(total, "host").where(F.col("held") >= most * F.col("total")).groupBy("host").agg(
        F.max(F.struct(F.size(F.split("element", "/")).alias("depth"), "element"))["element"].alias("region")
    )
    wrapper = written(region.join(template, "host", "full"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for paths, texts, flags, region, template in zip(b["paths"], b["texts"], b["flags"], b["region"], b["template"], strict=True):
                found = [Line(p, t, *f) for p, t, f in zip(paths, texts, json.loads(flags), strict=True)]
                out.append(content(found, region, set() if template is None else set(template)))
            texts = [t for t, _ in out]
            yield pd.DataFrame(
                {"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts], "decided": [d for _, d in out]}
            )

    known = known.drop("shape", "h").join(wrapper, "host", "left").select("page_id", "url", "paths", "texts", "flags", "region", "template")
    return known.mapInPandas(extract, "page_id long, url string, text string, n_chars long, decided string")
