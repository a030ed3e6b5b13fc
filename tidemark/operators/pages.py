"""Lines, sections and tables of product documents, from rows of lines, characters or cells with their places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines that number pages, chapters that repeat in contents, and the words that open and close contents.
PAGE_NUMBERS = (r"第\s*\d+\s*页", r"Page\s*\d+", r"共\s*\d+\s*页", r"\d+\s*/\s*\d+", r"第\s*页", r"共\s*页", r"^\d+\s+\d+$")
CHAPTERS = ("其他事项", "合同效力", "保险费", "保险金的申请及给付", "名词释义", "投保范围", "保险责任及责任免除")
CONTENTS = ("条款目录", "目录", "目 录", "CONTENTS", "Content")
BODY_STARTS = ("凡投保", "凡出生", "保险期间为", "自首次投保", "在保证续保")
# Kinds of sections, in order of priority, and their words.
SECTIONS = (
    ("health_disclosure", ("健康告知", "健康说明", "健康状况告知", "健康告知事项")),
    ("exclusion", ("责任免除", "免责条款", "不承担责任", "不承担保险责任", "责任免除条款")),
    ("notice", ("阅读指引", "重要提示", "告知事项", "客户须知", "投保须知")),
    ("rider", ("附加险", "附加条款", "附加合同", "附加险说明")),
)
# Kinds of tables, in order, and the words of their headers; what tells an appendix in its cells.
TABLES = (
    ("gene_test", ("基因检测", "产品名称", "检测产品")),
    ("drug_list", ("药品", "商品名", "通用名", "靶向药")),
    ("complication", ("并发症", "手术", "诊疗类别", "介入诊疗")),
    ("hospital", ("指定医院", "医疗机构", "医院名单", "医院名称")),
    ("appendix", ("附表", "附录", "分期", "职业类别", "分类表")),
    ("coverage", ("给付比例", "保障计划", "保险责任", "保险金额")),
    ("premium", ("费率", "保险费", "保费", "基本保险金额")),
)
STAGES = ("Ⅰ期", "Ⅱ期", "Ⅲ期", "ⅣA期", "ⅣB期", "ⅣC期")
MARGINS = ("内部资料", "严禁外传", "仅供内部使用", "保密")
CLAUSE = r"^(\d+(?:\.\d+)*)\s+(.+)$"


def _any(words: tuple[str, ...], test) -> Column:
    return reduce(lambda a, b: a | b, (test(w) for w in words))


def holds(text: Column, words: tuple[str, ...]) -> Column:
    return _any(words, lambda w: F.contains(text, F.lit(w)))


def is_page_number(line: Column, patterns: tuple[str, ...] = PAGE_NUMBERS) -> Column:
    return _any(patterns, line.rlike)


def is_chapter(line: Column, titles: tuple[str, ...] = CHAPTERS, longest: int = 20) -> Column:
    """Whether a line is a chapter's title: it ends with one, and is shorter than `longest`."""
    bare = F.trim(line)
    return (F.length(bare) < longest) & _any(titles, lambda t: F.endswith(bare, F.lit(t)))


def clean_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines that neither number a page nor are a chapter's title."""
    bare = F.trim(text)
    return lines.where(~is_page_number(bare) & ~is_chapter(bare))


def title_and_body(text: Column, longest: int = 25) -> Column:
    """struct(title, body) of a clause: a first line of its own, what comes before the first space, or a book's title in
    《》; a title has at most `longest` characters and no 。. Else all is title.
    """
    bare = F.trim(text)
    first = F.trim(F.substring_index(bare, "\n", 1))
    rest = F.trim(F.regexp_replace(bare, r"(?s)^[^\n]*\n", ""))
    has_line = F.contains(bare, F.lit("\n"))
    by_line = has_line & (F.length(first) <= longest) & (first != "") & ~F.contains(first, F.lit("。"))
    one = F.when(has_line, first).otherwise(bare)
    head, tail = F.substring_index(one, " ", 1), F.trim(F.regexp_replace(one, r"(?s)^[^ ]* ", ""))
    by_space = F.contains(one, F.lit(" ")) & F.length(head).between(2, longest) & ~F.contains(head, F.lit("。")) & (tail != "")
    book = F.regexp_extract(one, r"(?s)^(《.*?》)", 1)
    after = F.trim(F.substring(one, F.length(book) + 1, F.length(one)))
    pair = lambda a, b: F.struct(a.alias("title"), b.alias("body"))
    empty = F.lit("")
    return (
        F.when(by_line, pair(first, rest))
        .when(by_space, pair(head, tail))
        .when((book != "") & (after != ""), pair(book, after))
        .otherwise(pair(F.coalesce(one, empty), empty))
    )


def section_type(line: Column, sections: tuple = SECTIONS, longest: int = 40) -> Column:
    """The kind of section that a line opens, by priority; null for other lines.

    In a numbered line the words must make up the title: begin it, be it, end a short one, or begin or end its first word.
    Another line must be shorter than `longest` and begin or end with them.
    """
    bare = F.trim(line)
    numbered, title = bare.rlike(CLAUSE), F.regexp_extract(bare, CLAUSE, 2)
    word = F.when(F.instr(title, " ") > 1, F.substring_index(title, " ", 1))
    found = F.lit(None).cast("string")
    for kind, words in reversed(sections):
        def fits(w: str) -> Column:
            k = F.lit(w)
            pure = F.startswith(title, k) | (F.endswith(title, k) & (F.length(title) < 2 * len(w)))
            by_word = F.coalesce(F.startswith(word, k) | F.endswith(word, k), F.lit(False))
            alone = (F.length(bare) < longest) & (F.startswith(bare, k) | F.endswith(bare, k))
            return F.contains(bare, k) & F.when(numbered, pure | by_word).otherwise(alone)  # patterns only where the words are

        found = F.when(_any(words, fits), kind).otherwise(found)
    return found


def without_contents(lines: DataFrame, by: list[str], order: str, page: str, text: str = "text", pages: int = 3) -> DataFrame:
    """Lines without the table of contents, looked for on each of the first `pages` pages (page counts from 0): from a line
    with its word, which goes, to the first line of the body; numbered titles of up to 25 characters and chapter titles go.
    """
    bare = F.trim(text)
    rows = Window.partitionBy(*by, page).orderBy(order)
    opens = holds(bare, CONTENTS) & (F.col(page) < pages)
    first = F.min(F.when(opens, F.col(order))).over(Window.partitionBy(*by, page))
    title = F.regexp_extract(bare, r"^(\d+\.\d+(?:\.\d+)*)\s+(.+)$", 2)
    body = (bare != "") & (holds(bare, BODY_STARTS) | (F.length(F.trim(title)) > 40))
    entry = (bare != "") & (((title != "") & (F.length(F.trim(title)) <= 25)) | bare.rlike(r"^\d+[．.]\s*.+$"))
    begun = F.max(F.when(F.col("_after") & body, 1).otherwise(0)).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    marked = lines.withColumn("_first", first).withColumn("_after", F.coalesce(F.col(order) > F.col("_first"), F.lit(False)))
    marked = marked.withColumn("_begun", begun == 1)
    gone = F.coalesce(F.col(order) == F.col("_first"), F.lit(False)) | (F.col("_after") & ~F.col("_begun") & entry)
    return marked.where(~gone).drop("_first", "_after", "_begun")


def without_margins(
    lines: DataFrame,
    headers: tuple[str, ...] = MARGINS,
    footers: tuple[str, ...] = PAGE_NUMBERS,
    *,
    text: str = "text",
    top: str = "top",
    height: str = "page_height",
    ratio: float = 0.08,
    longest: tuple[int, int] = (60, 40),
) -> DataFrame:
    """Lines but for short ones near the top that hold a header's words, and near the bottom that match a footer's pattern."""
    bare = F.trim(text)
    head = (F.col(top) < F.col(height) * ratio) & (F.length(bare) <= longest[0]) & holds(bare, headers)
    foot = (F.col(top) > F.col(height) * (1 - ratio)) & (F.length(bare) <= longest[1]) & _any(footers, lambda p: bare.rlike("(?i)" + p))
    return lines.where((bare != "") & ~head & ~foot)


def lines_of_characters(chars: DataFrame, by: list[str], bin_height: float = 8.0) -> DataFrame:
    """by, top, text: characters (text, x0, width, top) of about the same height as a line, from left to right.

    A space goes in where the gap is over 2 points and over 0.3 of the mean width so far: the character's own width and how
    far the line has come, over the parts it has and one. A line is folded in its own row, as long as a line is.
    """
    at = F.round(F.col("top") / bin_height) * bin_height
    items = F.array_sort(F.collect_list(F.struct("x0", "width", "text")))
    rows = chars.groupBy(*by, at.alias("top")).agg(items.alias("items"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("parts"), F.lit(None).cast("double").alias("end"))

    def step(acc: Column, c: Column) -> Column:
        gap = c.x0 - acc.end
        mean = (c.width + acc.end - F.get("items", F.lit(0)).x0) / (acc.parts + 1)
        spaced = F.coalesce((gap > mean * 0.3) & (gap > 2), F.lit(False))
        return F.struct(
            F.concat(acc.text, F.when(spaced, " ").otherwise(""), c.text).alias("text"),
            (acc.parts + F.when(spaced, 2).otherwise(1)).alias("parts"),
            (c.x0 + c.width).alias("end"),
        )

    return rows.select(*by, "top", F.aggregate("items", start, step, lambda a: a.text).alias("text"))


def table_type(header: Column, tables: tuple = TABLES) -> Column:
    """The kind of a table by its header; other, if no word fits."""
    found = F.lit("other")
    for kind, words in reversed(tables):
        found = F.when(holds(header, words), kind).otherwise(found)
    return found


def real_tables(tables: DataFrame, rows: str = "rows") -> DataFrame:
    """Tables with two rows and two headers that aren't blank. rows: array<array<string>>."""
    named = F.filter(F.get(rows, F.lit(0)), lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    return tables.where((F.size(rows) >= 2) & (F.size(named) >= 2))


def typed_tables(tables: DataFrame, by: str, order: list[str], *, near_top: float = 0.15) -> DataFrame:
    """Adds kind and continues to real tables of a document: by, order, page, top, page_height, title, around, rows.

    A table near the top of a page continues the one before it, if that lies on another page and has as many columns; of a
    table that no header word fits, the kind is then that table's own, as far as the chain of continued tables goes. Else
    its title, a stage of disease in its first five rows, or a line around it that starts so tell an appendix.
    """
    rows = Window.partitionBy(by).orderBy(*order)
    width = F.size(F.get("rows", F.lit(0)))
    own = table_type(F.array_join(F.transform(F.get("rows", F.lit(0)), lambda c: F.coalesce(c, F.lit(""))), " "))
    continues = (F.col("top") < F.col("page_height") * near_top) & (F.lag("page").over(rows) != F.col("page")) & (F.lag(width).over(rows) == width)
    stages = F.exists(F.slice("rows", 1, 5), lambda r: F.exists(r, lambda c: F.coalesce(holds(c, STAGES), F.lit(False))))
    title = F.coalesce("title", F.lit(""))
    line = F.exists(F.split(F.coalesce("around", F.lit("")), "\n"), lambda x: F.trim(x).rlike("^(附表|附录)"))
    hint = F.when(holds(title, ("附表", "附录")) | stages | line, "appendix").otherwise("other")
    marked = tables.withColumn("_own", own).withColumn("continues", F.coalesce(continues, F.lit(False)))
    # A chain starts at a table that continues none; within it the last kind that a header told goes on.
    marked = marked.withColumn("_chain", F.sum((~F.col("continues")).cast("int")).over(rows)).withColumn("_hint", hint)
    told = F.when(F.col("_own") != "other", F.col("_own")).when(~F.col("continues") & (F.col("_hint") != "other"), F.col("_hint"))
    chain = Window.partitionBy(by, "_chain").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kind = F.coalesce(told, F.last(told, ignorenulls=True).over(chain), F.col("_hint"))
    return marked.withColumn("kind", kind).drop("_own", "_chain", "_hint")
