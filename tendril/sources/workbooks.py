"""Workbooks and word documents as DataFrames, by Spark's binary reader.

``.xlsx`` and ``.docx`` are zipped XML; a file is read whole by one task, files
are spread over tasks (``tendril.sources.xlsx`` gives each sheet a task).  ``.xls``, ``.pdf`` and pictures need programs that Spark
lacks: give their text to the ``text_tables`` operator instead.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ROWS = "path string, sheet string, sheet_no int, row_idx int, cells array<string>, numbers array<double>"

# Sheets that price lists leave out, and column places.
SKIPPED_SHEETS = ["Лист1", "ПРОСМОТР ЗАКАЗА"]
CATALOG_COLUMNS = {"name": 0, "price": 1, "stock": 2, "cost": 3, "unit": 4, "markup": 5}
GOODS_COLUMNS = {"name": 0, "supplier": 1, "purchase_date": 2, "cost": 3, "price": 4, "unit": 5}
REGISTRY_COLUMNS = {"name": 0, "quantity": 1, "condition": 3, "link": 7}
PROCUREMENT = "отчет по закупкам"
PRICE_COLUMNS = {"code": 0, "name": 1, "recommended_qty": 2, "price": 3, "order_qty": 4, "order_sum": 5}


def _texts(data: bytes) -> list[str]:
    root = ElementTree.fromstring(data)
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in root.findall(f"{_MAIN}si")]


def sheet_places(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, place in the archive) of each sheet, in the workbook's order."""
    links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = [(s.get("name"), links[s.get(_REL)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    return [(name, target if target.startswith("xl/") else f"xl/{target}") for name, target in found]


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    return _texts(book.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in book.namelist() else []


def sheet_rows(book: zipfile.ZipFile, place: str, shared: list[str]) -> Iterator[tuple[int, list[str | None], list[float | None]]]:
    """(row number, cells as text, cells as numbers), a row at a time."""
    with book.open(place) as data:
        for _, row in ElementTree.iterparse(data):
            if row.tag != f"{_MAIN}row":
                continue
            cells: dict[int, tuple[str | None, float | None]] = {}
            for cell in row.findall(f"{_MAIN}c"):
                column = 0
                for letter in re.match("[A-Z]+", cell.get("r", "A"))[0]:
                    column = column * 26 + ord(letter) - 64
                value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                if kind == "inlineStr":
                    cells[column - 1] = ("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")), None)
                elif value is not None and value.text is not None:
                    number = kind in (None, "n", "b")
                    text = shared[int(value.text)] if kind == "s" else value.text
                    cells[column - 1] = (text, float(value.text) if number else None)
            both = [cells.get(k, (None, None)) for k in range(max(cells, default=-1) + 1)]
            yield int(row.get("r", 0)), [b[0] for b in both], [b[1] for b in both]
            row.clear()


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None], list[float | None]]]:
    """(sheet, row number, cells as text, cells as numbers)."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = shared_texts(book)
        for name, place in sheet_places(book):
            for row in sheet_rows(book, place, shared):
                yield name, *row


def document_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(table, row number, cells) of a word document's tables."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        root = ElementTree.fromstring(book.read("word/document.xml"))
    for k, table in enumerate(root.iter(f"{_WORD}tbl")):
        for n, row in enumerate(table.findall(f"{_WORD}tr")):
            cells = ["\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in c.iter(f"{_WORD}p")) for c in row.findall(f"{_WORD}tc")]
            yield str(k), n, cells


def kind_of(content: Column, media_type: Column) -> Column:
    """File kind by first bytes, else by media type."""
    head = F.hex(F.substring(content, 1, 4))
    media = F.lower(F.coalesce(media_type, F.lit("")))
    return (
        F.when(head == "25504446", "pdf").when(head == "D0CF11E0", "xls")
        .when((head == "504B0304") & (F.instr(F.decode(content, "ISO-8859-1"), "word/") > 0), "docx").when(head == "504B0304", "xlsx")
        .when(media.contains("pdf"), "pdf").when(media.contains("wordprocessing"), "docx").when(media.contains("spreadsheet") | media.contains("excel"), "xlsx")
    )


def read_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every row of every sheet (.xlsx) or table (.docx) of the files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if path.lower().endswith(".docx"):
                    found = [(s, n, c, [None] * len(c)) for s, n, c in document_rows(content)]
                elif path.lower().endswith(".xlsx"):
                    found = list(workbook_rows(content))
                else:
                    raise ValueError(f"{path}: only .xlsx and .docx can be read; give the text of others to text_tables")
                places = {name: k for k, name in enumerate(dict.fromkeys(r[0] for r in found))}
                out += [(path, r[0], places[r[0]], *r[1:]) for r in found]
            yield pd.DataFrame(out, columns=["path", "sheet", "sheet_no", "row_idx", "cells", "numbers"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(rows, ROWS)


def fields(rows: DataFrame, columns: dict[str, int], numbers: list[str]) -> DataFrame:
    """Positional cells by name: text, or a number or null."""
    text = lambda k: F.nullif(F.trim(F.get("cells", F.lit(k))), F.lit(""))
    return rows.select("path", "sheet", "row_idx", *[(F.get("numbers", F.lit(k)) if c in numbers else text(k)).alias(c) for c, k in columns.items()])


def read_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Catalog workbooks: rows of the first sheet from the second with a name,
    with their kind and the components' group they stand in."""
    from tendril.operators.catalog import classify

    rows = fields(first_sheets(read_rows(spark, paths)).filter("row_idx >= 2"), CATALOG_COLUMNS, ["price", "stock", "cost", "markup"])
    named = rows.filter("name IS NOT NULL").withColumn("unit", F.coalesce("unit", F.lit("шт")))
    return classify(named, ["path"])


def first_sheets(rows: DataFrame) -> DataFrame:
    return rows.filter("sheet_no = 0").drop("sheet_no")


def is_procurement(rows: DataFrame) -> DataFrame:
    """(path, procurement): whether one of the first three cells of a file's
    first twelve rows tells a purchase report of two-row records."""
    told = F.exists(F.slice("cells", 1, 3), lambda c: F.coalesce(F.lower(c).contains(PROCUREMENT), F.lit(False)))
    return rows.groupBy("path").agg(F.bool_or((F.col("row_idx") <= 12) & told).alias("procurement"))


def read_goods(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Purchase reports of both layouts: path, row_idx, name, supplier,
    purchase_date, cost, price, unit, procurement."""
    from tendril.operators.catalog import procurement_items, report_period

    rows = first_sheets(read_rows(spark, paths))
    kinds = is_procurement(rows)
    plain = fields(rows.filter("row_idx >= 2").join(kinds.filter("NOT procurement"), "path"), GOODS_COLUMNS, ["cost", "price"]).filter("name IS NOT NULL")
    two = fields(rows.join(kinds.filter("procurement"), "path"), {"name": 0, "quantity": 1, "unit": 2, "price": 3}, ["quantity", "price"])
    two = procurement_items(two, ["path"]).join(report_period(two), "path", "left")
    columns = ["path", "row_idx", "name", "supplier", "purchase_date", "cost", "price", "unit"]
    return plain.select(*columns, F.lit(False).alias("procurement")).unionByName(two.select(*columns, F.lit(True).alias("procurement")))


def read_registry(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stock registers: name, quantity (0 for what is no number), condition,
    link ("None" is nothing), and the row's place for its pictures."""
    rows = fields(first_sheets(read_rows(spark, paths)).filter("row_idx >= 2"), REGISTRY_COLUMNS, ["quantity"]).filter("name IS NOT NULL")
    told = lambda c: F.when(F.col(c) != "None", F.col(c))
    return rows.select("path", "row_idx", "name", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), told("condition").alias("condition"), told("link").alias("link"), (F.col("row_idx") - 2).alias("row_pos"))


def read_requests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Items of request documents (.docx and .xlsx): in every table the first
    header row names the columns, and rows with a number follow."""
    from tendril.operators.requests import cell_tables

    return cell_tables(read_rows(spark, paths), ["path", "sheet_no", "sheet"])


def _path(c: str = "path") -> Column:
    """A path without its scheme, as it was named."""
    return F.regexp_replace(F.try_url_decode(c), "^file:/*", "/")


def read_price_lists(spark: SparkSession, paths: str | list[str], suppliers: dict[str, str] | None = None) -> DataFrame:
    """Price lists: all sheets but two; the supplier is the one that is named
    for a path, else the file's stem.

    ``source_idx`` is the file's place in ``paths`` (0 for a folder): files are
    one table, in the order in which they were registered.
    """
    from tendril.functions.text import optional_number
    from tendril.operators.catalog import price_rows

    rows = fields(read_rows(spark, paths).filter(~F.col("sheet").isin(SKIPPED_SHEETS)), PRICE_COLUMNS, ["price"])
    stem = F.regexp_extract(F.try_url_decode("path"), r"([^/]+)\.[^./]+$", 1)
    supplier, place = stem, F.lit(0)
    for path, name in (suppliers or {}).items():
        supplier = F.when(_path() == path, name).otherwise(supplier)
    for k, path in enumerate(paths if isinstance(paths, list) else []):
        place = F.when(_path() == path, k).otherwise(place)
    return price_rows(rows).withColumns({"supplier": supplier, "source_idx": place, **{c: optional_number(F.col(c)) for c in ("recommended_qty", "order_qty", "order_sum")}})


# Why a price list is refused.
REFUSED = {"kind": "Допустимы только файлы .xls и .xlsx", "unread": "Не удалось прочитать прайс: ", "empty": "В файле не найдено позиций с ценами"}


def check_price_list(spark: SparkSession, path: str, supplier: str) -> tuple[int, str | None]:
    """How many prices a file holds, and why it can't be used, if so."""
    if not path.lower().endswith((".xls", ".xlsx")):
        return 0, REFUSED["kind"]
    try:
        n = read_price_lists(spark, [path], {path: supplier}).count()
    except Exception as error:
        return 0, f"{REFUSED['unread']}{error}"
    return n, None if n else REFUSED["empty"]


#: Rows that a sheet of the format holds.
MOST_ROWS = 1_048_576


def book_bytes(sheets: list[tuple[str, list[str], list[list]]]) -> bytes:
    """A workbook of (name, header, rows); a cell is None, a number or text."""
    def cell(v: object) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    ns = f'xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:-3]}"'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook {ns}><sheets>' + "".join(f'<sheet name="{escape(name)}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, *_) in enumerate(sheets, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (name, header, rows) in enumerate(sheets, 1):
            if len(rows) >= MOST_ROWS:
                raise ValueError(f"sheet {name} has more than {MOST_ROWS - 1} rows")
            letters = [_letters(c) for c in range(len(header))]
            with book.open(f"xl/worksheets/sheet{k}.xml", "w") as out:
                out.write(f'<?xml version="1.0"?><worksheet {ns}><sheetData>'.encode())
                for n, row in enumerate([header, *rows], 1):
                    out.write(_row(n, letters, row, cell))
                out.write(b"</sheetData></worksheet>")
    return held.getvalue()


def workbooks(sheets: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """(keys, content): a workbook for each request, made where its rows are.

    Each sheet has the keys, ``row`` (its order) and its columns.  A task gets
    one request's lines, which the format bounds; more are an error.
    """
    cells, headers = None, {}
    for place, (name, df) in enumerate(sheets.items()):
        shown = [c for c in df.columns if c not in (*by, "row")]
        headers[name] = shown
        kinds = dict(df.dtypes)
        number = lambda c, kinds=kinds: F.col(c).cast("double") if kinds[c] in ("int", "bigint", "smallint", "tinyint", "float", "double") or kinds[c].startswith("decimal") else F.lit(None).cast("double")
        rows = df.select(*by, F.lit(place).alias("_sheet"), F.col("row").cast("long").alias("_row"), F.array(*[F.struct(number(c).alias("n"), F.col(c).cast("string").alias("s")) for c in shown]).alias("_cells"))
        cells = rows if cells is None else cells.unionByName(rows)
    names = list(sheets)

    def write(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values(["_sheet", "_row"], kind="stable")
        value = lambda c: c["s"] if c["n"] is None else int(c["n"]) if c["n"] == int(c["n"]) else c["n"]
        parts = {k: [[value(c) for c in row] for row in part["_cells"]] for k, part in lines.groupby("_sheet")}
        content = book_bytes([(name, headers[name], parts.get(k, [])) for k, name in enumerate(names)])
        return pd.DataFrame([[*key, content]], columns=[*by, "content"])

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema if f.name in by)
    return cells.groupBy(*by).applyInPandas(write, f"{keys}, content binary")


def write_workbook(sheets: dict[str, DataFrame], path: str, most: int = 1_000_000) -> None:
    """One workbook of a few small tables at a local path; one with more than
    ``most`` rows is an error, before anything is written.  Results of many
    requests are for ``workbooks``."""
    for name, df in sheets.items():
        if df.limit(most + 1).count() > most:
            raise ValueError(f"sheet {name} has more than {most} rows")
    content = book_bytes([(name, df.columns, [list(r) for r in df.collect()]) for name, df in sheets.items()])
    with open(path, "wb") as out:
        out.write(content)


def _letters(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def _row(n: int, letters: list[str], row: object, cell) -> bytes:
    cells = "".join(cell(v).replace("<c", f'<c r="{a}{n}"', 1) for a, v in zip(letters, row, strict=True))
    return f'<row r="{n}">{cells}</row>'.encode()
