"""Table cells: grids with merged cells, ranges, directional ranges, banding, text layout, tabular text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldloom.functions.values import parse_number


def aggregates(x: Column) -> dict[str, Column]:
    """The aggregate functions with their values for empty input."""
    return {
        "sum_v": F.coalesce(F.sum(x), F.lit(0.0)), "product_v": F.coalesce(F.product(x), F.lit(1.0)), "average_v": F.coalesce(F.avg(x), F.lit(0.0)), "count_v": F.count(x),
        "min_v": F.coalesce(F.min(x), F.lit(0.0)), "max_v": F.coalesce(F.max(x), F.lit(0.0)), "and_v": F.coalesce(F.min((x != 0).cast("int")), F.lit(1)), "or_v": F.coalesce(F.max((x != 0).cast("int")), F.lit(0)),
    }


def column_index(letters: str) -> int:
    """A is 1, Z 26, AA 27."""
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def parse_range(text: str) -> tuple[int, int, int, int] | None:
    """First row, first column, last row, last column from 0 of ``A1`` or ``A1:C3``, put in order; None if it is neither."""
    ends = [re.fullmatch(r"([A-Za-z]+)(\d+)", p) for p in text.split(":")]
    if not 1 <= len(ends) <= 2 or not all(ends):
        return None
    rows, cols = ([int(m[2]) - 1 for m in ends], [column_index(m[1]) - 1 for m in ends])
    return None if min(rows) < 0 else (min(rows), min(cols), max(rows), max(cols))


def grid(df: DataFrame, table: list[str], row: str, order: str, span: str | None = None, continues: str | None = None, columns: str | None = None) -> DataFrame:
    """Lays cells out: adds col (from 0), col_span, row_span, is_covered.

    ``span`` is the number of columns of a cell (at least 1), ``continues`` marks a cell that goes on with the one above,
    ``columns`` the width of the table (else the widest row). Cells right of the table are left out; a span ends with the
    table. A cell that goes on with nothing above it is one of its own.
    """
    line = Window.partitionBy(*table, row).orderBy(order)
    size = F.lit(1) if span is None else F.greatest(F.coalesce(F.col(span), F.lit(1)), F.lit(1))
    out = df.withColumn("_size", size).withColumn("_go", F.lit(False) if continues is None else F.coalesce(F.col(continues), F.lit(False)))
    out = out.withColumn("col", (F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")).cast("int"))
    whole = Window.partitionBy(*table)
    out = out.withColumn("_wide", F.max(F.col("col") + F.col("_size")).over(whole) if columns is None else F.col(columns)).filter("col < _wide")
    out = out.withColumn("col_span", F.least(F.col("_size"), F.col("_wide") - F.col("col")).cast("int"))
    down = Window.partitionBy(*table, "col").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    master = F.sum(F.when(F.col("_go"), 0).otherwise(1)).over(down)
    out = out.withColumn("_master", master)
    first = F.row_number().over(Window.partitionBy(*table, "col", "_master").orderBy(row))
    out = out.withColumn("is_covered", F.col("_go") & ((F.col("_master") > 0) | (first > 1)))
    return out.withColumn("row_span", F.when(F.col("is_covered"), 1).otherwise(F.count("*").over(Window.partitionBy(*table, "col", "_master"))).cast("int")).drop("_size", "_go", "_wide", "_master")


def widest(df: DataFrame, table: list[str], row: str, span: str) -> DataFrame:
    """The number of columns of ragged tables: the greatest sum of spans of a row."""
    return df.groupBy(*table, row).agg(F.sum(F.greatest(F.coalesce(F.col(span), F.lit(1)), F.lit(1))).alias("n")).groupBy(*table).agg(F.max("n").alias("columns"))


def range_numbers(df: DataFrame, table: list[str], row: str, col: str, text: str, area: str, covered: str | None = None, name: str = "numbers") -> DataFrame:
    """One row per table: the numbers of an area like ``A1:C3`` in reading order; covered and non-numeric cells don't count.
    An area that is none, or holds no number, gives an empty array."""
    spot = parse_range(area)
    inside = F.lit(False) if spot is None else F.col(row).between(spot[0], spot[2]) & F.col(col).between(spot[1], spot[3])
    if covered is not None:
        inside &= ~F.coalesce(F.col(covered), F.lit(False))
    value = F.when(inside, parse_number(F.col(text).cast("string")))
    cells = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(row).alias("r"), F.col(col).alias("c"), value.alias("v")))))
    return df.groupBy(*table).agg(F.transform(cells, lambda x: x["v"]).alias(name))


def as_scalar(numbers: Column) -> Column:
    """A range used as a number: the sum, 0 of none."""
    return F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b)


def directional(df: DataFrame, table: list[str], across: str, along: str, value: str) -> DataFrame:
    """Adds the sums ``before`` and ``after`` the cell along one axis: ABOVE and BELOW for rows along a column (``across``),
    LEFT and RIGHT for columns along a row. Both are running sums, one over each order."""
    keys, zero = [*table, *([across] if across else [])], F.lit(0.0)
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(along).asc(), F.col(along).desc()))
    return df.withColumn("before", F.coalesce(F.sum(value).over(up), zero)).withColumn("after", F.coalesce(F.sum(value).over(down), zero))


def banding(df: DataFrame, table: list[str], row: str) -> DataFrame:
    """Adds the condition of a table style that holds for a row: first, last, else odd and even bands."""
    w = Window.partitionBy(*table)
    out = df.withColumn("_at", F.row_number().over(w.orderBy(row))).withColumn("_n", F.count("*").over(w))
    band = F.when(F.col("_at") == 1, "firstRow").when(F.col("_at") == F.col("_n"), "lastRow").when(F.col("_at") % 2 == 0, "band1Horz").otherwise("band2Horz")
    return out.withColumn("condition", band).drop("_at", "_n")


#: Flags of a table's look that switch conditions on, and their order of precedence from weak to strong.
LOOK = ("firstRow", "lastRow", "firstColumn", "lastColumn", "hBand", "vBand")


def conditions(df: DataFrame, table: list[str], row: str, col: str, look: tuple[str, ...] = ("firstRow", "firstColumn", "hBand"), name: str = "conditions") -> DataFrame:
    """Adds the conditions of a table style that hold for a cell, from weak to strong: the whole table, vertical and
    horizontal bands (first and last rows and columns that are on don't count), columns, rows, corners."""
    w = Window.partitionBy(*table)
    on = dict.fromkeys(look, True)
    out = df.withColumn("_last_row", F.max(row).over(w)).withColumn("_last_col", F.max(col).over(w))
    r, c = F.col(row), F.col(col)
    first_row, last_row = (F.lit(bool(on.get("firstRow"))) & (r == 0), F.lit(bool(on.get("lastRow"))) & (r == F.col("_last_row")))
    first_col, last_col = (F.lit(bool(on.get("firstColumn"))) & (c == 0), F.lit(bool(on.get("lastColumn"))) & (c == F.col("_last_col")))
    row_band, col_band = r - int(bool(on.get("firstRow"))), c - int(bool(on.get("firstColumn")))
    held = [
        (F.lit(True), "wholeTable"),
        (F.lit(bool(on.get("vBand"))) & ~first_col & ~last_col & (col_band % 2 == 0), "band1Vert"),
        (F.lit(bool(on.get("vBand"))) & ~first_col & ~last_col & (col_band % 2 == 1), "band2Vert"),
        (F.lit(bool(on.get("hBand"))) & ~first_row & ~last_row & (row_band % 2 == 0), "band1Horz"),
        (F.lit(bool(on.get("hBand"))) & ~first_row & ~last_row & (row_band % 2 == 1), "band2Horz"),
        (first_col, "firstCol"), (last_col, "lastCol"), (first_row, "firstRow"), (last_row, "lastRow"),
        (first_row & first_col, "nwCell"), (first_row & last_col, "neCell"), (last_row & first_col, "swCell"), (last_row & last_col, "seCell"),
    ]
    return out.withColumn(name, F.array_compact(F.array(*(F.when(test, label) for test, label in held)))).drop("_last_row", "_last_col")


def database_text(df: DataFrame, group: list[str], order: str, columns: list[str], headings: bool = False, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of each group as lines of tab-separated values; null values are empty. ``first`` and ``last`` choose records,
    from 1. ``headings`` puts the columns' names above."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    start = max(1, first or 1)
    if first or last:
        rows = F.slice(rows, F.lit(start), F.greatest(F.lit(0), F.least(F.size(rows), F.lit(last or 2**31 - 1)) - start + 1))
    lines = F.transform(rows, lambda r: r["l"])
    if headings:
        lines = F.concat(F.array(F.lit("\t".join(columns))), lines)
    return df.groupBy(*group).agg(F.array_join(lines, "\n").alias("body"))


def ascii_table(df: DataFrame, table: list[str], row: str, col: str, text: str, header: Column | None = None, name: str = "body") -> DataFrame:
    """Each table as text: cells padded to their column's width (short rows filled), ``|`` between them, a rule below header
    rows (the first one if ``header`` is None). ``col`` counts from 0."""
    lines = F.split(F.replace(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    cell = F.array_join(F.filter(F.transform(lines, lambda t: F.trim(t)), lambda t: F.length(t) > 0), " ")
    held = df.withColumn("_cell", cell).withColumn("_head", (F.col(row) == F.min(row).over(Window.partitionBy(*table))) if header is None else header)
    widths = held.groupBy(*table, col).agg(F.max(F.length("_cell")).alias("_width")).groupBy(*table).agg(F.map_from_entries(F.collect_list(F.struct(col, "_width"))).alias("_widths"), F.max(col).alias("_last"))
    rows = held.groupBy(*table, row).agg(F.max("_head").alias("_head"), F.map_from_entries(F.collect_list(F.struct(col, "_cell"))).alias("_cells"))
    rows = rows.join(widths, table)
    spots = F.sequence(F.lit(0), F.col("_last"))
    width = lambda i: F.coalesce(F.try_element_at(F.col("_widths"), i), F.lit(0))
    line = F.array_join(F.transform(spots, lambda i: F.rpad(F.coalesce(F.try_element_at(F.col("_cells"), i), F.lit("")), width(i), " ")), " | ")
    rule = F.array_join(F.transform(spots, lambda i: F.repeat(F.lit("-"), F.greatest(width(i), F.lit(3)))), "-+-")
    shown = F.when(F.col("_head"), F.concat(line, F.lit("\n"), rule)).otherwise(line)
    stacked = F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), shown.alias("l"))))
    return rows.groupBy(*table).agg(F.array_join(F.transform(stacked, lambda x: x["l"]), "\n").alias(name))


#: Fixed value: from so many columns on a result is tabbed text instead of a table.
MOST_COLUMNS = 62


def structured_rows(df: DataFrame, columns: list[str], headings: bool = False) -> Column:
    """A record as the cells of a table row, or None from MOST_COLUMNS columns on, where it stays text."""
    return F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)) if len(columns) < MOST_COLUMNS else None


def html_table(df: DataFrame, table: list[str], row: str, col: str, text: str, col_span: str = "col_span", row_span: str = "row_span", covered: str = "is_covered", header: Column | None = None, name: str = "html") -> DataFrame:
    """Each grid as an HTML table; covered cells are left out, spans above 1 are attributes, header rows have ``th``."""
    tag = F.when(F.lit(False) if header is None else header, "th").otherwise("td")
    span = lambda key, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {key}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<"), tag, span("rowspan", row_span), span("colspan", col_span), F.lit(">"), F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("</"), tag, F.lit(">"))
    kept = df.filter(~F.coalesce(F.col(covered), F.lit(False)))
    pick = lambda key, c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), c.alias("t")))), lambda x: x["t"])
    rows = kept.groupBy(*table, row).agg(F.array_join(pick(col, cell), "").alias("cells"))
    line = F.concat(F.lit("<tr>"), F.col("cells"), F.lit("</tr>"))
    return rows.groupBy(*table).agg(F.concat(F.lit("<table>"), F.array_join(pick(row, line), ""), F.lit("</table>")).alias(name))
