"""Tables as array<array<string>> grids: acceptance, titles and reading out (FL13-FL15, SF47, SF48, TK6, CP6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import lexicons as L
from lectern.functions import text as X
from lectern.operators import layout

MOST_COLUMNS, MOST_ROWS, TITLE_CHARS = 4, 25, 180
UNTITLED = "untitled table"
YEAR_CELL = r"^\W*(?:FY ?)?(?:19|20)\d\d\W*$"
ORDINAL = r"^\s*\d{1,2}[.)]?\s*$"
BLANK = r"^[\s_.…-]*$"


def n_columns(grid: str) -> Column:
    return F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))


def conversion_table(grid: str) -> Column:
    """FL14."""
    head = F.transform(F.get(F.col(grid), F.lit(0)), lambda c: F.lower(F.trim(c)))
    pairs = F.lit(False)
    for a, b in L.CONVERSION_HEADERS:
        pairs = pairs | (head == F.array(F.lit(a), F.lit(b)))
    return (n_columns(grid) == 2) & (F.size(grid) > 1) & F.coalesce(pairs, F.lit(False))


def text_table(grid: str) -> Column:
    """FL13: whether a table can be read out as text. Header years, or digits in a quarter of the cells, speak against it."""
    years = F.size(F.filter(F.coalesce(F.get(F.col(grid), F.lit(0)), F.expr("cast(array() AS array<string>)")), lambda c: c.rlike(YEAR_CELL)))
    # The first column's ordinals and blanks are no data.
    cells = F.flatten(F.transform(grid, lambda r: F.filter(r, lambda c, i: ~((i == 0) & c.rlike(ORDINAL)) & ~c.rlike(BLANK))))
    digits = F.size(F.filter(cells, lambda c: c.rlike(r"\d")))
    small = (n_columns(grid) <= MOST_COLUMNS) & (F.size(grid) <= MOST_ROWS) & (F.size(grid) > 0)
    return (small & (years < 2) & (F.size(cells) > 0) & (digits * 4 < F.size(cells))) | conversion_table(grid)


def table_title(grid: str) -> Column:
    """TK6: the first cell that says something, without ``.:;`` at its end, TITLE_CHARS characters at most."""
    cells = F.filter(F.transform(F.flatten(F.col(grid)), lambda c: X.sub(X.fold_space(c), r"[.:;]+$", "")), lambda c: c != "")
    return F.substring(F.coalesce(F.get(cells, F.lit(0)), F.lit(UNTITLED)), 1, TITLE_CHARS)


def generic_title(title: Column) -> Column:
    """FL15: a title with a digit, or one that is only a column's name."""
    return title.rlike(r"\d") | F.trim(X.sub(F.lower(title), "[^a-z ]", "")).isin(*L.GENERIC_TITLES)


def linearize(grid: str) -> Column:
    """SF47: rows as sentences; merged cells are read once, blank ones not at all; conversions as equations."""

    def row(r):
        cells = F.filter(F.transform(r, X.fold_space), lambda c: ~c.rlike(r"^_*$"))
        # Neighbours that are equal are one merged cell.
        once = F.filter(cells, lambda c, i: (i == 0) | (c != F.coalesce(F.get(cells, i - 1), F.lit(""))))
        return F.when(F.size(once) > 0, F.concat(X.sub(F.array_join(once, " "), r"[.]+$", ""), F.lit("."))).otherwise(F.lit(""))

    clauses = F.filter(F.transform(grid, row), lambda s: s != "")
    pairs = F.filter(F.slice(grid, 2, F.greatest(F.lit(1), F.size(grid))), lambda r: F.size(r) == 2)
    equations = F.transform(pairs, lambda r: F.concat(X.strip(F.get(r, F.lit(0))), F.lit(" equals "), X.strip(F.get(r, F.lit(1))), F.lit(".")))
    return F.concat(F.lit("Table contents. "), F.array_join(F.when(conversion_table(grid), equations).otherwise(clauses), " "))


def table_blocks(tables: DataFrame, page_dims: DataFrame, mode: str = "smart") -> DataFrame:
    """CP6: a note block for each table outside the margins, with `narrated`.

    smart reads text tables out and mentions the others; skip mentions all; linearize reads all.
    """
    t = tables.join(page_dims, ["doc_id", "page"])
    read = {"smart": text_table("grid"), "skip": F.lit(False), "linearize": F.lit(True)}[mode]
    title = table_title("grid")
    page = F.col("page").cast("string")
    notice = F.when(generic_title(title), F.concat(F.lit("Table omitted page "), page, F.lit("."))).otherwise(F.concat(F.lit("Table omitted: "), title, F.lit(", page "), page, F.lit(".")))
    body = t.withColumn("narrated", read).withColumn("text", F.when(F.col("narrated"), linearize("grid")).otherwise(notice)).withColumn("label", F.lit("note"))
    return body.where(~layout.in_margin()).select("doc_id", "table_no", "text", "label", "page", "left", "top", "right", "bottom", "page_width", "page_height", "narrated")
