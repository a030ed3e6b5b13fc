"""Checklists kept as sheets: where the header and the data begin, which regulation a row belongs to, and the clauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The mark of the layout that has a line of owners above its header, the header's own first cell, the columns
# that say what a clause applies to, by their place (from 0), and the value that says nothing.
OWNER = "产品开发责任人"
FIRST_HEADER = "序号"
APPLIES = {3: "险种大类", 4: "险种类型", 5: "险种分型", 6: "保险期限", 7: "主附险"}
ANY = "全部"


def _cell(n: int) -> Column:
    return F.trim(F.coalesce(F.get("cells", F.lit(n)), F.lit("")))


def _name(cell: Column) -> Column:
    """Without the remarks in brackets that follow on a line of their own."""
    return F.regexp_replace(cell, r"\n[（(][^）)]*[）)]", "")


def sheet_layouts(rows: DataFrame) -> DataFrame:
    """sheet, layout (standard or with_owner), header_row, data_row, regulation_name. rows: sheet, row_no (from 1), cells.

    The header is in the second row, or, below a line of owners, in the third; the name of the regulation follows it, and where
    that cell is empty the sheet's first cell stands for it.
    """
    owner = F.max(F.when(F.col("row_no") == 2, F.exists("cells", lambda c: F.coalesce(F.contains(c, F.lit(OWNER)), F.lit(False)))))
    at = lambda n: F.max(F.when(F.col("row_no") == n, _cell(0)))
    found = rows.where("row_no <= 4").groupBy("sheet").agg(F.coalesce(owner, F.lit(False)).alias("o"), at(1).alias("title"), at(3).alias("r3"), at(4).alias("r4"))
    below = F.when(F.col("o"), F.col("r4")).otherwise(F.col("r3"))
    # Without a row for the name there is none; an empty cell in it is filled from the title.
    name = F.when(below.isNull(), "").when(below == "", F.coalesce("title", F.lit(""))).otherwise(below)
    shift = F.col("o").cast("int")
    return found.select(
        "sheet", F.when(F.col("o"), "with_owner").otherwise("standard").alias("layout"), (shift + 2).alias("header_row"), (shift + 4).alias("data_row"), _name(name).alias("regulation_name")
    )


def sheet_clauses(rows: DataFrame) -> DataFrame:
    """sheet, layout, regulation_name, sub_regulation, row_no, sequence, content, applies: the clauses of checklists.

    A row whose first cell is a whole number and whose second isn't empty is a clause. One with another first cell begins a
    sub-regulation, which the clauses below it belong to; those before the first belong to the regulation itself.
    sub_regulation is null where nothing but the regulation itself has rows. applies: what a clause is limited to.
    """
    layouts = sheet_layouts(rows)
    data = rows.join(layouts, "sheet").where(F.col("row_no") >= F.col("data_row"))
    first = _cell(0)
    number = F.coalesce(first.rlike(r"^\d+(\.0+)?$"), F.lit(False))
    begins = F.get("cells", F.lit(0)).isNotNull() & ~number & (first != FIRST_HEADER)
    marked = data.withColumn("begins", begins).withColumn("name", F.when(F.col("begins"), _name(first)))
    order = Window.partitionBy("sheet").orderBy("row_no")
    all_ = Window.partitionBy("sheet")
    so_far = F.last("name", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    at = F.when(F.col("begins"), F.col("row_no"))
    following = F.first(at, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    # Groups with a name and rows of their own; the last one may be without.
    kept = F.col("begins") & (F.col("name") != "") & (F.col("following").isNull() | (F.col("following") != F.col("row_no") + 1))
    own = (F.col("regulation_name") != "") & (F.coalesce(F.min(at).over(all_), F.lit(0)) != F.col("data_row"))
    marked = marked.withColumn("group", F.coalesce(so_far, "regulation_name")).withColumn("following", following)
    names = F.collect_set(F.when(kept, F.col("name"))).over(all_)
    marked = marked.withColumn("n", F.count_if(kept).over(all_) + own.cast("int")).withColumn("one", F.get(names, F.lit(0)))
    alone = (F.col("n") == 1) & (own | (F.col("one") == F.col("regulation_name")))
    limits = [F.when(~F.coalesce(_cell(i), F.lit("")).isin("", ANY), F.struct(F.lit(c).alias("k"), _cell(i).alias("v"))) for i, c in APPLIES.items()]
    return marked.where(number & (_cell(1) != "")).select(
        "sheet", "layout", "regulation_name", F.when(~alone, F.nullif("group", F.lit(""))).alias("sub_regulation"), "row_no",
        first.cast("double").cast("long").alias("sequence"), _cell(1).alias("content"), F.map_from_entries(F.array_compact(F.array(*limits))).alias("applies"),
    )
