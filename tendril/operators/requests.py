"""Requests for quotation: table cells or plain text to items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell a header's columns, and defaults.
NAME_WORD, UNIT_DEFAULT = "наимен", "шт."
HEADER_WORDS = {"number": ["№", "п/п", "номер"], "name": ["наимен"], "unit": ["ед.", "ед ", "единиц"], "quantity": ["кол-во", "колич", "кол."], "specs": ["характер", "описан", "требован"]}


def column_map(header: Column) -> dict[str, Column]:
    """0-based positions by header words; defaults are the first column, and
    the two after the name."""
    low = F.transform(header, F.lower)

    def find(words: list[str]) -> Column:
        hit = F.transform(low, lambda c: F.greatest(*[c.contains(w) for w in words]) if len(words) > 1 else c.contains(words[0]))
        at = F.array_position(hit, F.lit(True))
        return F.when(at > 0, at - 1)

    name = find(HEADER_WORDS["name"])
    return {
        "name": name,
        "number": F.coalesce(find(HEADER_WORDS["number"]), F.lit(0)),
        "unit": F.coalesce(find(HEADER_WORDS["unit"]), name + 1),
        "quantity": F.coalesce(find(HEADER_WORDS["quantity"]), name + 2),
        "specs": find(HEADER_WORDS["specs"]),
    }


def request_items(rows: DataFrame, cells: str = "cells", at: dict[str, Column] | None = None) -> DataFrame:
    """Rows with a number as items; a bad quantity is 1, a blank unit the
    default.  Adds number, name, unit, quantity, specifications."""
    at = at or {"number": F.lit(0), "name": F.lit(1), "unit": F.lit(2), "quantity": F.lit(3), "specs": F.lit(None).cast("int")}
    cell = lambda k: F.trim(F.coalesce(F.get(F.col(cells), at[k].cast("int")), F.lit("")))
    number = F.regexp_replace(cell("number"), r"\.+$", "")
    found = rows.withColumns(
        {
            "_number": number,
            "name": cell("name"),
            "unit": F.when(cell("unit") == "", UNIT_DEFAULT).otherwise(cell("unit")),
            "quantity": F.coalesce(F.replace(cell("quantity"), F.lit(","), F.lit(".")).try_cast("double"), F.lit(1.0)),
            "specifications": F.coalesce(F.get(F.col(cells), at["specs"].cast("int")), F.lit("")),
        }
    )
    found = found.filter(F.col("_number").rlike(r"(?U)^\d+$") & (F.col("name") != ""))
    return found.withColumn("number", F.col("_number").try_cast("int")).drop("_number")


def cell_tables(rows: DataFrame, by: list[str]) -> DataFrame:
    """Items of tables of cells (row_idx, cells): the first row of a table with
    a name column is its header, rows with a number below it are items."""
    whole = Window.partitionBy(*by).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_header = F.exists("cells", lambda c: F.coalesce(F.lower(c).contains(NAME_WORD), F.lit(False)))
    head = F.first(F.when(F.col("_header"), F.col("cells")), ignorenulls=True).over(whole)
    below = rows.withColumn("_header", is_header).withColumn("_head", head).filter("_head IS NOT NULL AND NOT _header")
    blank = F.transform("_head", lambda c: F.coalesce(c, F.lit("")))
    return request_items(below, "cells", column_map(blank)).drop("_head", "_header", "cells", "numbers")


def split_line(line: Column) -> Column:
    """Cells by tab, else by two spaces and more if that makes four, else by
    any space."""
    wide = F.split(F.trim(line), r"\s{2,}")
    return F.when(line.contains("\t"), F.split(line, "\t")).when(F.size(wide) >= 4, wide).otherwise(F.split(F.trim(line), r"\s+"))


def text_tables(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items of the tables in plain text: a header line starts a table, rows
    before its first data row are skipped, the first other line ends it."""
    lines = texts.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    # All windows have one order, so lines are sorted once, and as lines only.
    so_far = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("is_header", F.lower("line").contains(NAME_WORD)).withColumn("_head", F.when(F.col("is_header"), split_line(F.col("line"))))
    at = F.struct(*[v.cast("int").alias(k) for k, v in column_map(F.col("_head")).items()])
    lines = lines.withColumn("_at", F.when(F.col("is_header"), at)).drop("_head")
    lines = lines.withColumns({"table": F.sum(F.col("is_header").cast("int")).over(so_far), "_at": F.last("_at", ignorenulls=True).over(so_far)})
    data = ~F.col("is_header") & F.regexp_replace(F.trim(split_line(F.col("line"))[0]), r"\.$", "").rlike(r"(?U)^\d+$")
    lines = lines.filter("table > 0").withColumn("is_data", data)
    # The table of the last data row before, and of the last row that ended one.
    lines = lines.withColumn("_seen", F.coalesce(F.last(F.when(F.col("is_data"), F.col("table")), ignorenulls=True).over(before) == F.col("table"), F.lit(False)))
    ends = F.when(F.col("_seen") & ~F.col("is_data"), F.col("table"))
    lines = lines.withColumn("_ended", F.coalesce(F.last(ends, ignorenulls=True).over(so_far) == F.col("table"), F.lit(False)))
    kept = lines.filter("is_data AND NOT _ended").withColumn("cells", split_line(F.col("line")))
    return request_items(kept, "cells", {k: F.col("_at")[k] for k in ("number", "name", "unit", "quantity", "specs")}).drop("_at", "_seen", "_ended", "is_header", "is_data", "line", "cells")
