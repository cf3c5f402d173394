"""A Spark data source for spreadsheets (xlsx): one partition a sheet, one row a line of cells.

    spark.dataSource.register(Workbook)
    spark.read.format("workbook").load("/data/series.xlsx")  # cidade (the sheet's name), linha, celulas

A cell has a tipo (numero, data, texto or vazia) and its texto; dates are told by the number format of their style. Sheets are
parsed as streams, so a task holds a line at a time and the file's table of shared texts.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "cidade string, linha int, celulas array<struct<tipo:string,texto:string>>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Built-in number formats of dates.
_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class Sheet(InputPartition):
    def __init__(self, name: str, member: str):
        self.name, self.member = name, member


def _texts(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.iter(f"{_MAIN}si")]


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    dates = _DATES | {k for k, code in own.items() if re.search("[dmyDMY]", code)}
    cells = root.find(f"{_MAIN}cellXfs")
    return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _column(reference: str) -> int:
    """B7 is column 1."""
    n = 0
    for c in reference.rstrip("0123456789"):
        n = 26 * n + ord(c) - 64
    return n - 1


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Sheet]:
        with zipfile.ZipFile(self.path) as z:
            links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")
            return [Sheet(s.get("name"), links[s.get(_LINK)].lstrip("/") if links[s.get(_LINK)].startswith("/") else f"xl/{links[s.get(_LINK)]}") for s in sheets]

    def read(self, partition: Sheet) -> Iterator[tuple]:
        with zipfile.ZipFile(self.path) as z:
            texts, dates = _texts(z), _date_styles(z)
            with z.open(partition.member) as f:
                line = 0
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    line = int(row.get("r", line + 1))
                    cells: list[dict] = []
                    for c in row.iter(f"{_MAIN}c"):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [{"tipo": "vazia", "texto": None}] * (at - len(cells))
                        cells.append(_cell(c, texts, dates))
                    yield partition.name, line, cells
                    row.clear()


def _cell(c: ElementTree.Element, texts: list[str], dates: set[int]) -> dict:
    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return {"tipo": "texto", "texto": "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))}
    if value is None or value.text is None:
        return {"tipo": "vazia", "texto": None}
    if kind == "n" and int(c.get("s", 0)) in dates:
        return {"tipo": "data", "texto": (datetime(1899, 12, 30) + timedelta(days=float(value.text))).strftime("%Y-%m-%d")}
    if kind == "n":
        return {"tipo": "numero", "texto": value.text}
    return {"tipo": "texto", "texto": texts[int(value.text)] if kind == "s" else value.text}


class Workbook(DataSource):
    """Option path: a file that the driver and the executors can open."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"].removeprefix("file://"))
