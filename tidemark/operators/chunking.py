"""From documents to chunks: front matter, headings, sections, greedy packing, windows, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import written

# Lines that are headings. Markdown ones; if a document has none of them: clauses, numbers, brackets, numerals.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
CLAUSE_HEADING = r"^第([一二三四五六七八九十百零]+)条[：:\s]"
NUMBERED = r"^(\d+(?:\.\d+)*)[.、\s]"
BRACKET = r"^[（(]([一二三四五六七八九十\d]+)[）)]"
NUMERAL = r"^([一二三四五六七八九十]+)[、.]"
# How a chunk begins that was wrongly cut from the one before it.
LIST_START = r"^[（(]\d+[）)]|^[①②③④⑤]|^[a-zA-Z]\."
TURNS = ("但", "然而", "除外", "不包括", "另有规定", "但是")


def front_matter(docs: DataFrame) -> DataFrame:
    """Adds head (the YAML between two lines of ---, or null) and body (trimmed)."""
    parts = F.split("text", "---", 3)
    has = F.startswith("text", F.lit("---")) & (F.size(parts) == 3)
    return docs.withColumn("head", F.when(has, F.get(parts, F.lit(1)))).withColumn(
        "body", F.trim(F.when(has, F.get(parts, F.lit(2))).otherwise(F.col("text")))
    )


def head_value(head: Column, key: str) -> Column:
    """A key's value in flat YAML; null without one."""
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no (from 0), line."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))


def headings(rows: DataFrame) -> DataFrame:
    """Adds level: the number of # signs; without any such heading in a document, 1 for a clause, the depth of a leading
    number, 2 for a number in brackets or a numeral.

    rows: id, line_no, line. Markdown headings win exclusively.
    """
    # A number may also be all of a line, as the line's end is white space.
    line = F.concat("line", F.lit("\n"))
    is_md = line.rlike(HEADING)
    any_md = F.max(is_md.cast("int")).over(Window.partitionBy("id")) == 1
    depth = F.size(F.split(F.regexp_extract(line, NUMBERED, 1), r"\."))
    other = F.when(line.rlike(CLAUSE_HEADING), 1).when(line.rlike(NUMBERED), depth).when(line.rlike(BRACKET) | line.rlike(NUMERAL), 2)
    return rows.withColumn("level", F.when(any_md, F.when(is_md, F.length(F.regexp_extract(line, "^(#+)", 1)))).otherwise(other))


def sections(marked: DataFrame) -> DataFrame:
    """id, section (from 1), heading, level, content: the lines up to the next heading. What comes before the first is left out."""
    before = Window.partitionBy("id").orderBy("line_no")
    at = marked.withColumn("section", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(before))
    return (
        at.where("section > 0")
        .groupBy("id", "section")
        .agg(
            F.max(F.when(F.col("level").isNotNull(), F.col("line"))).alias("heading"),
            F.max("level").alias("level"),
            F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))).alias("rows"),
        )
        .select("id", "section", "heading", "level", F.trim(F.array_join(F.transform("rows", lambda r: r.line), "\n")).alias("content"))
    )


def section_paths(marked: DataFrame, deepest: int = 32) -> DataFrame:
    """id, section (from 1), level, path: the headings above each section, from the outermost on, and its own.

    A heading lies below the last one before it with a smaller level; those of its own level or a greater one end there. Of
    every level the last heading so far is known to a line; it still holds if no smaller level came after it. marked: as
    headings() gives it; levels beyond `deepest` count as that.
    """
    level = F.least("level", F.lit(deepest))
    so_far = Window.partitionBy("id").orderBy("line_no")
    last = [F.last(F.when(level == n, F.struct("line_no", "line")), ignorenulls=True).over(so_far).alias(f"h{n}") for n in range(1, deepest + 1)]
    section = F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(so_far).cast("long")
    seen = marked.where("level is not null").select("id", section.alias("section"), level.alias("level"), *last)
    none = F.lit(None).cast("string")
    path, latest = [], F.lit(-1).cast("int")
    for n in range(1, deepest + 1):
        at = F.col(f"h{n}.line_no").cast("int")
        path.append(F.when((F.col("level") >= n) & (at > latest), F.col(f"h{n}.line")).otherwise(none))
        latest = F.greatest(latest, at)
    return seen.select("id", "section", "level", F.array_compact(F.array(*path)).alias("path"))


def greedy_pack(parts: Column, limit: int, glue: str = "\n\n") -> Column:
    """Joins parts in order while the joined length plus one stays within limit, then starts anew; as an array."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc.now) + F.length(part) + 1 <= limit
        return (
            F.when(acc.now == "", F.struct(acc.done.alias("done"), part.alias("now")))
            .when(fits, F.struct(acc.done.alias("done"), F.concat(acc.now, F.lit(glue), part).alias("now")))
            .otherwise(F.struct(F.concat(acc.done, F.array(acc.now)).alias("done"), part.alias("now")))
        )

    return F.aggregate(parts, start, step, lambda acc: F.when(acc.now == "", acc.done).otherwise(F.concat(acc.done, F.array(acc.now))))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.trim(p)), lambda p: p != "")


def windows(docs: DataFrame, id_col: str, text_col: str, size: int = 3000, overlap: int = 150, least: int = 20) -> DataFrame:
    """id, chunk (from 0), content: windows of `size` characters every size - overlap; short tails are dropped."""
    step = size - overlap
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.posexplode(starts).alias("chunk", "start"))
    cut = cut.select("id", "chunk", F.substring("t", F.col("start") + 1, F.lit(size)).alias("content"))
    return cut.where(F.length("content") >= least)


def linked(chunks: DataFrame) -> DataFrame:
    """Adds prev_chunk and next_chunk."""
    order = Window.partitionBy("id").orderBy("chunk")
    return chunks.withColumn("prev_chunk", F.lag("chunk").over(order)).withColumn("next_chunk", F.lead("chunk").over(order))


def with_overlap(chunks: DataFrame, longest: int = 150, limit: int = 3000) -> DataFrame:
    """Adds tail: what of the previous chunk's last `longest` characters follows the last sentence end, if it still fits."""
    order = Window.partitionBy("id").orderBy("chunk")
    last = F.right(F.lag("content").over(order), F.lit(longest))
    cut = F.regexp_extract(last, r"(?s)^.*[.!?。！？\n](.*)$", 1)
    tail = F.trim(F.when(last.rlike(r"[.!?。！？\n]"), cut).otherwise(last))
    return chunks.withColumn("tail", F.when(F.length(tail) + F.length("content") <= limit, tail))


def runs(lengths: Column, joined: Column, limit: float, glue: int) -> Column:
    """A number, from 0, for each of some parts in order: that of the part before while they are joined and stay within
    limit together, glue included, else the next one. Carries numbers only, never the parts themselves."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(-1).alias("n"), F.lit(0).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        stays = x.joined & (acc.n >= 0) & (acc.size + glue + x.size <= limit)
        n = F.when(stays, acc.n).otherwise(acc.n + 1)
        size = F.when(stays, acc.size + glue).otherwise(0) + x.size
        return F.struct(F.concat(acc.out, F.array(n)).alias("out"), n.alias("n"), size.alias("size"))

    both = F.zip_with(lengths, joined, lambda n, j: F.struct(n.alias("size"), j.alias("joined")))
    return F.aggregate(both, start, step, lambda acc: acc.out)


def packed_parts(rows: DataFrame, limit: int, glue: str) -> DataFrame:
    """rows: id, parts. id, chunk (from 0), content: parts in order, joined by glue while that fits limit."""
    numbered = rows.withColumn("n", runs(F.transform("parts", F.length), F.transform("parts", lambda p: F.lit(True)), limit, len(glue)))
    each = numbered.select("id", F.posexplode(F.arrays_zip("parts", "n")).alias("pos", "x"))
    return each.groupBy("id", F.col("x.n").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x.parts"))), lambda r: r.parts), glue).alias("content")
    )


def sentence_chunks(docs: DataFrame, id_col: str, text_col: str, *, limit: int = 3000, overlap: int = 150, least: int = 20, force: int = 10_000) -> DataFrame:
    """id, chunk (from 0), content: whole sentences joined while they fit limit; a longer one is a chunk of its own. Texts of
    over `force` characters are cut in windows of `limit` instead, each `limit - overlap` on from the last, of `least` at least.
    """
    t = F.col(text_col)
    short = docs.where(F.length(t) <= force).select(
        F.col(id_col).alias("id"), F.regexp_extract_all(t, F.lit("[^。；！？.!?]*[。；！？.!?]|[^。；！？.!?]+"), 0).alias("parts")
    )
    packed = packed_parts(short, limit, "")
    long = windows(docs.where(F.length(t) > force), id_col, text_col, limit, overlap, least)
    packed = packed.withColumn("content", F.trim("content")).where("content <> ''")
    return packed.unionByName(long.select("id", "chunk", "content"))


def belongs_together(before: Column, after: Column) -> Column:
    """Whether two neighbouring chunks were wrongly cut: the first ends with a colon or semicolon, or the second begins as an
    item of a list or with a word that turns against what came before."""
    a, b = F.trim(before), F.trim(after)
    return a.rlike("[:：;；]$") | b.rlike(LIST_START) | b.rlike("^(" + "|".join(TURNS) + ")")


def merged_neighbours(chunks: DataFrame, *, limit: int = 3000, oversize: float = 1.5, glue: str = "\n\n") -> DataFrame:
    """chunks: id, chunk, content. Wrongly cut neighbours as one, joined by glue, while that has at most oversize x limit."""
    items = F.array_sort(F.collect_list(F.struct("chunk", "content")))
    rows = chunks.groupBy("id").agg(items.alias("items"))
    text = F.transform("items", lambda x: x.content)
    joined = F.transform(text, lambda c, i: F.when(i == 0, F.lit(False)).otherwise(belongs_together(F.get(text, i - 1), c)))
    rows = rows.withColumn("n", runs(F.transform(text, F.length), joined, limit * oversize, len(glue)))
    each = rows.select("id", F.posexplode(F.arrays_zip("items", "n")).alias("pos", "x"))
    return each.groupBy("id", F.col("x.n").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x.items.content"))), lambda r: r.content), glue).alias("content")
    )


#: Rows that a task sorts, about.
ROWS_PER_TASK = 1 << 19


def numbered(rows: DataFrame, by: str, order: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """by, keep, i: the number of each row, from 1, among those with its `by`, in order. However few values `by` has, rows are dealt
    by ranges of by and order; what comes before a range is summed from counts of ranges, which are as few as tasks."""
    tasks = max(1, -(-rows.count() // ROWS_PER_TASK))
    cols = [by, *order]
    ranges = rows.repartitionByRange(tasks, *cols).sortWithinPartitions(*cols)
    # The place of a row is the number of its range, and below 33 bits that within the range.
    placed = written(ranges.select(by, *keep, F.monotonically_increasing_id().alias("_at")))
    span = F.shiftright("_at", 33).alias("_span")
    counts = placed.groupBy(F.col(by).alias("_by"), span).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_by", "_span", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = placed[by].eqNullSafe(F.col("_by")) & (F.shiftright("_at", 33) == F.col("_span"))
    return placed.join(F.broadcast(starts), same).select(by, *keep, (F.col("_at") + F.col("_shift")).alias("i"))
