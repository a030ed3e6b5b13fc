"""Checklists by hand, in both layouts."""

from __future__ import annotations

from tidemark.operators import sheets as sh

ROWS = {
    "plain": [
        ["检查清单"], ["序号", "内容", None, "险种大类"], ["保险法\n（2015修订）"], ["1", " 第一条 ", None, "寿险", "全部", None, "长期"], ["2", "第二条"], ["民法典\n(2020)"], ["3", "第三条", None, "全部"],
        ["序号", "内容"], ["4", ""], [None, "note"], ["空法"], ["条例"], ["5.0", "第五条"],
    ],
    "owned": [["名称"], [None, "产品开发责任人：甲"], ["序号"], [""], ["7", "七"], ["x", "y"]],
    "single": [["t"], ["序号"], ["办法"], ["1", "一"], ["2", "二"]],
    "renamed": [["t"], ["序号"], ["办法"], ["办法"], ["1", "一"]],
    "short": [["t"], ["序号"]],
}


def test_sheets(spark):
    rows = [(s, n, cells) for s, lines in ROWS.items() for n, cells in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "sheet string, row_no int, cells array<string>").repartition(4)
    layouts = {r.sheet: tuple(r)[1:] for r in sh.sheet_layouts(df).collect()}
    assert layouts == {
        "plain": ("standard", 2, 4, "保险法"), "owned": ("with_owner", 3, 5, "名称"), "single": ("standard", 2, 4, "办法"), "renamed": ("standard", 2, 4, "办法"), "short": ("standard", 2, 4, ""),
    }
    got = {(r.sheet, r.sequence): (r.sub_regulation, r.row_no, r.content, r.applies) for r in sh.sheet_clauses(df).collect()}
    assert got == {
        ("plain", 1): ("保险法", 4, "第一条", {"险种大类": "寿险", "保险期限": "长期"}),
        ("plain", 2): ("保险法", 5, "第二条", {}),
        ("plain", 3): ("民法典", 7, "第三条", {}),
        ("plain", 5): ("条例", 13, "第五条", {}),
        ("owned", 7): ("名称", 5, "七", {}),
        ("single", 1): (None, 4, "一", {}),
        ("single", 2): (None, 5, "二", {}),
        ("renamed", 1): (None, 5, "一", {}),
    }
    none = spark.createDataFrame([], df.schema)
    assert sh.sheet_clauses(none).count() == 0
