"""Workbooks read from their zipped XML, and a Spark data source over them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillon.config import InputError

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

#: The built-in number formats that show dates or times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
_NOT_FORMAT = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|[_*].')


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or time: y, m, d, h or s outside quotes, brackets and escapes."""
    return bool(re.search(r"[ymdhs]", _NOT_FORMAT.sub("", code.split(";")[0]).lower().replace("general", "")))


def serial_text(serial: float, from_1904: bool = False) -> str:
    """A day number as ISO text, with a time of day if it has one; times alone (below 1) as times."""
    days = serial + 1462 if from_1904 else serial
    at = datetime(1899, 12, 30) + timedelta(seconds=round((days + (days < 60 and days >= 1)) * 86400))
    if 0 <= serial < 1 and not from_1904:
        return at.strftime("%H:%M:%S")
    return at.strftime("%Y-%m-%d" if at.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class Workbook:
    """A workbook's sheets; shared texts and styles are read once, sheets when they are asked for."""

    def __init__(self, content: bytes | str | Path) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content)
        names = set(self.zip.namelist())
        part = lambda name: ElementTree.fromstring(self.zip.read(name)) if name in names else ElementTree.Element("none")
        self.shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in part("xl/sharedStrings.xml").iter(f"{_MAIN}si")]
        styles = part("xl/styles.xml")
        own = {int(f.get("numFmtId")): is_date_format(f.get("formatCode") or "") for f in styles.iter(f"{_MAIN}numFmt")}
        cells = styles.find(f"{_MAIN}cellXfs")
        ids = [int(x.get("numFmtId") or 0) for x in cells] if cells is not None else []
        self.dates = {i for i, f in enumerate(ids) if own.get(f, f in DATE_FORMATS)}
        book = part("xl/workbook.xml")
        mark = book.find(f"{_MAIN}workbookPr")
        self.from_1904 = mark is not None and mark.get("date1904") in ("1", "true")
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in part("xl/_rels/workbook.xml.rels")}
        places = {s.get("name"): targets[s.get(f"{_REL}id")] for s in book.iter(f"{_MAIN}sheet")}
        self.sheets = {name: t if t.startswith("xl/") else f"xl/{t}" for name, t in places.items()}

    def _text(self, c: ElementTree.Element) -> str:
        value, kind = c.find(f"{_MAIN}v"), c.get("t")
        text = value.text or "" if value is not None else "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
        if kind == "s" and text:
            return self.shared[int(text)]
        if kind == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(text, text)
        if text and kind in (None, "n") and int(c.get("s") or 0) in self.dates:
            return serial_text(float(text), self.from_1904)
        return text

    def rows(self, sheet: str) -> Iterator[list[str]]:
        """A sheet's rows as text cells; rows that the file leaves out are empty."""
        at = 0
        with self.zip.open(self.sheets[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                number = int(row.get("r", at + 1)) - 1
                yield from ([] for _ in range(number - at))
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    i = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (i - len(cells))
                    cells.append(self._text(c))
                at = max(at, number) + 1
                yield cells
                row.clear()


_BROKEN = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError, AttributeError, OverflowError)


def each_row(content: bytes | str | Path, name: str, sheet: str | None = None) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row index, cells) of all sheets or one, in order; a file that is no workbook is an InputError."""
    try:
        book = Workbook(content)
        for s in book.sheets:
            if sheet in (None, s):
                yield from ((s, i, cells) for i, cells in enumerate(book.rows(s)))
    except _BROKEN as e:
        raise InputError(f"{name} cannot be read as a workbook: {e}") from e


def read_sheets(path: str | Path) -> dict[str, list[list[str]]]:
    """All sheets of a local file as rows of text cells of one width, empty cells as empty text."""
    try:
        out: dict[str, list[list[str]]] = {s: [] for s in Workbook(path).sheets}
    except _BROKEN as e:
        raise InputError(f"{Path(path).name} cannot be read as a workbook: {e}") from e
    for s, _, cells in each_row(path, Path(path).name):
        out[s].append(cells)
    width = {s: max(map(len, rows), default=0) for s, rows in out.items()}
    return {s: [r + [""] * (width[s] - len(r)) for r in rows] for s, rows in out.items()}


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str) -> None:
        self.path, self.sheet = path, sheet


class XlsxDataSource(DataSource):
    """``spark.read.format("xlsx").load(path)``: (sheet, row_idx, cells), a partition a sheet; option ``sheet`` for one.

    For paths that every machine mounts; ``readers.sheet_rows`` reads from any file system.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "sheet string, row_idx int, cells array<string>"

    def reader(self, schema):
        return _XlsxReader(self.options.get("path", ""), self.options.get("sheet"))


class _XlsxReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None) -> None:
        self.path, self.sheet = path, sheet

    def partitions(self) -> list[InputPartition]:
        return [_Sheet(self.path, s) for s in Workbook(self.path).sheets if self.sheet in (None, s)]

    def read(self, partition: InputPartition):
        yield from each_row(partition.path, partition.path, partition.sheet)
