"""``spark.read.format("quote_xlsx")``: workbooks with a task for each sheet.

Partitions are the sheets of the files at ``path`` (one, or several as a JSON list
in ``paths``; a folder stands for its workbooks), so a workbook of many sheets is
read by many tasks, a row at a time.  A filter on ``sheet`` or ``sheet_no`` prunes
partitions before any sheet is opened.  Files are opened through Arrow's file
systems (local or shared paths, and urls that it knows); what only Spark's readers
can open is for ``workbooks.read_rows``, which gives the same rows.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tendril.sources.workbooks import ROWS, shared_texts, sheet_places, sheet_rows


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _files(path: str) -> list[str]:
    """The workbooks that a path stands for."""
    system, place = _system(path)
    if system.get_file_info(place).type != fs.FileType.Directory:
        return [path]
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(place)) if i.path.lower().endswith(".xlsx"))
    return [path[: len(path) - len(place)] + p for p in found]


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str
    sheet_no: int
    place: str


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths, self.wanted = paths, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("sheet",), ("sheet_no",)):
                self.wanted.append((f.attribute[0], (f.value,) if isinstance(f, EqualTo) else tuple(f.value)))
            else:
                yield f

    def partitions(self) -> list[Sheet]:
        out = []
        for path in (file for p in self.paths for file in _files(p)):
            system, place = _system(path)
            with system.open_input_file(place) as data, zipfile.ZipFile(data) as book:
                out += [Sheet(path, name, k, target) for k, (name, target) in enumerate(sheet_places(book))]
        return [s for s in out if all(getattr(s, name) in values for name, values in self.wanted)]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        system, place = _system(partition.path)
        with system.open_input_file(place) as data, zipfile.ZipFile(data) as book:
            for n, texts, numbers in sheet_rows(book, partition.place, shared_texts(book)):
                yield partition.path, partition.sheet, partition.sheet_no, n, texts, numbers


class QuoteXlsx(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quote_xlsx"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: object) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return _Reader(paths)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(QuoteXlsx)
