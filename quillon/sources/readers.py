"""Reading and writing tables: delimited text with sniffing, spreadsheets, raw grids, JSON, file hashes."""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.config import InputError
from quillon.functions.exprs import stamp
from quillon.runtime import ship_package, stash
from quillon.sources.headers import choose_date_field, choose_main_table, header_row, unique_names
from quillon.sources.xlsx import each_row

SUFFIXES = (".csv", ".tsv", ".xlsx", ".xlsm")
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk")
DELIMITERS = ",\t;|"
SNIFF_BYTES, HEAD_ROWS = 65_536, 20


@dataclass(frozen=True)
class Source:
    """A table with where it came from: sheet, header row (from 1) and what was odd in reading it."""

    frame: DataFrame
    sheet: str
    header_row: int
    notices: tuple[str, ...] = field(default=())


class File:
    """A file on any file system that Spark reads, or a local one where there is no session."""

    def __init__(self, path: str, spark: SparkSession | None = None) -> None:
        self.path, self.spark = path, spark
        name = path.rstrip("/").rsplit("/", 1)[-1]
        self.name, dot, end = (name, "", "") if "." not in name else (name, *name.rpartition(".")[1:])
        self.stem, self.suffix = (name[: -len(end) - 1] if dot else name), (dot + end).lower()
        if spark is not None:
            self._at = spark._jvm.org.apache.hadoop.fs.Path(path)
            self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return Path(self.path).exists() if self.spark is None else self._fs.exists(self._at)

    def is_folder(self) -> bool:
        return Path(self.path).is_dir() if self.spark is None else self._fs.getFileStatus(self._at).isDirectory()

    def size(self) -> int:
        return Path(self.path).stat().st_size if self.spark is None else self._fs.getFileStatus(self._at).getLen()

    def head(self, most: int) -> bytes:
        if self.spark is None:
            with open(self.path, "rb") as f:
                return f.read(most)
        stream = self._fs.open(self._at)
        try:
            return bytes(stream.readNBytes(most))
        finally:
            stream.close()


def ensure_readable(path: str, spark: SparkSession | None = None) -> File:
    f = File(path, spark)
    if not f.exists():
        raise InputError(f"no such file: {path}")
    if f.is_folder():
        raise InputError(f"a folder, not a file: {path}")
    if f.suffix not in SUFFIXES:
        raise InputError(f"{f.suffix or 'no suffix'} is not one of {', '.join(SUFFIXES)}")
    if not f.size():
        raise InputError(f"empty file: {path}")
    return f


def sniff(file: File) -> tuple[str, str, dict[int, list[str]]]:
    """(encoding, delimiter, first records that are not blank, by number) from the first bytes."""
    head = file.head(SNIFF_BYTES)
    whole = file.size() <= len(head)
    for encoding in ENCODINGS:
        try:
            text = head.decode(encoding)
        except UnicodeDecodeError as e:
            if whole or e.start < len(head) - 4:
                continue
            text = head[: e.start].decode(encoding)
        break
    else:
        raise InputError(f"{file.name} is in none of {', '.join(ENCODINGS)}")
    delimiter = "\t"
    if file.suffix != ".tsv":
        try:
            delimiter = csv.Sniffer().sniff(text, delimiters=DELIMITERS).delimiter
        except csv.Error:
            delimiter = ","
    records = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    return encoding, delimiter, dict(itertools.islice(((i, r) for i, r in enumerate(records) if any(c.strip() for c in r) or len(r) > 1), HEAD_ROWS))


def sheet_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(sheet, row_idx, cells): the cells of a workbook or a delimited file as text, nothing typed or dropped.

    A file is parsed by one task wherever it is stored, and kept as a scratch table; the driver sees its first bytes only.
    """
    file = ensure_readable(path, spark)
    ship_package(spark)
    name, stem, book = file.name, file.stem, file.suffix in (".xlsx", ".xlsm")
    encoding, delimiter = ("", "") if book else sniff(file)[:2]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                if book:
                    found = each_row(bytes(content), name, sheet)
                else:
                    lines = io.TextIOWrapper(io.BytesIO(bytes(content)), encoding=encoding, errors="replace", newline="")
                    found = ((stem, i, r) for i, r in enumerate(csv.reader(lines, delimiter=delimiter)))
                while part := list(itertools.islice(found, 10_000)):
                    yield pd.DataFrame(part, columns=["sheet", "row_idx", "cells"])

    raw = spark.read.format("binaryFile").load(path).select("content")
    try:
        return stash(raw.mapInPandas(parsed, "sheet string, row_idx int, cells array<string>"))
    except PySparkException as e:
        if "cannot be read as a workbook" in str(e):
            raise InputError(f"{name} cannot be read as a workbook") from e
        raise


def read_grid(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """(row_idx, cells): all cells as text, nothing typed or dropped; of a workbook the named or the fullest sheet."""
    rows = sheet_rows(spark, path)
    filled = F.size(F.filter("cells", lambda c: c != ""))
    full = {r["sheet"]: r["n"] for r in rows.groupBy("sheet").agg(F.sum(filled).alias("n")).collect()}
    if sheet is not None and sheet not in full:
        raise InputError(f"no sheet {sheet!r}; there are {', '.join(sorted(full))}")
    name = sheet or max(sorted(full), key=full.get, default="")
    return rows.where(F.col("sheet") == name).select("row_idx", "cells")


def read_delimited(spark: SparkSession, path: str) -> Source:
    """A CSV or TSV file of any of the encodings, wherever it is stored.

    Line breaks inside quotes are looked for in all of the file: without any, in UTF-8 and with the header on top, the file is
    read in parallel; else in one task, record by record. Quotes are doubled inside quotes. Cells stay text but for columns that are
    numbers in four of five cells. Rows with cells beyond the header's are told of, and keep their first cells; rows
    without any text are left out, and no other row is.
    """
    file = ensure_readable(path, spark)
    encoding, delimiter, head = sniff(file)
    records = list(head.values())
    at = header_row(records)
    names = unique_names(records[at] if records else [])
    if encoding.startswith("utf-8"):
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_extra", T.StringType())])
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        whole = at > 0 or not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
        raw = spark.read.csv(path, schema=schema, sep=delimiter, encoding="utf-8", quote='"', escape='"', header=at == 0, multiLine=whole, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        if at:
            # one task reads the file, so its records are numbered in order
            raw = raw.withColumn("_record", F.monotonically_increasing_id()).where(F.col("_record") > at).drop("_record")
    else:
        # Spark's own reader has no such encoding
        below = sheet_rows(spark, path).where(F.col("row_idx") > list(head)[at])
        raw = below.select(*(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)), F.get("cells", F.lit(len(names))).alias("_extra"))
    cells = [F.when(F.trim(F.col(f"`{n}`")) != "", F.trim(F.col(f"`{n}`"))).alias(n) for n in names]
    body = raw.select(*cells, F.col("_extra")).na.drop("all", subset=names)
    odd = not body.where(F.col("_extra").isNotNull()).isEmpty()
    return Source(_typed(body.drop("_extra")), file.stem, at + 1, ("rows with more cells than the header: the rest of them is not read",) if odd else ())


def _typed(df: DataFrame) -> DataFrame:
    """Columns that are numbers in at least four of five cells, and two cells, become doubles."""
    if not df.columns:
        return df
    tried = {c: F.col(f"`{c}`").try_cast("double") for c in df.columns}
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(x).alias(f"c{i}") for i, x in enumerate(tried.values()))).first()
    return df.select(*(x.alias(c) if row[f"c{i}"] >= 2 and row[f"c{i}"] >= 0.8 * row["n"] else F.col(f"`{c}`") for i, (c, x) in enumerate(tried.items())))


def load_tables(spark: SparkSession, path: str) -> dict[str, Source]:
    """All tables of a file by name: each sheet of a workbook, or the one of a text file."""
    file = ensure_readable(path, spark)
    if file.suffix in (".csv", ".tsv"):
        return {file.stem: read_delimited(spark, path)}
    rows, out = sheet_rows(spark, path), {}
    heads: dict[str, list[list[str]]] = {}
    for r in rows.where(F.col("row_idx") < HEAD_ROWS).orderBy("sheet", "row_idx").collect():
        heads.setdefault(r["sheet"], []).append(r["cells"])
    for name, head in heads.items():
        at = header_row(head)
        names = unique_names(head[at])
        if not names:
            continue
        cell = lambda i: F.get("cells", F.lit(i))
        body = rows.where((F.col("sheet") == name) & (F.col("row_idx") > at)).select(*(F.when(cell(i) != "", cell(i)).alias(n) for i, n in enumerate(names)))
        out[name] = Source(_typed(body.na.drop("all")), name, at + 1)
    return out


def load_frame(spark: SparkSession, path: str, config: dict | None = None) -> tuple[DataFrame, str]:
    """(table, name): the sheet that ``config`` names, or the main table: daily, dated and numeric ones come first."""
    tables = load_tables(spark, path)
    name = (config or {}).get("sheet")
    if name is None:
        stats = {}
        for n, source in tables.items():
            df, kinds = source.frame, dict(source.frame.dtypes)
            numeric = [c for c, k in kinds.items() if k == "double"]
            date = choose_date_field(date_rates(df), numeric)
            day = F.to_date(stamp(date)) if date else F.lit(None).cast("date")
            row = df.agg(F.count(F.lit(1)).alias("rows"), F.count(day).alias("dated"), F.count_distinct(day).alias("days")).first()
            stats[n] = {"date_field": date, "unique_day_ratio": row["days"] / max(1, row["dated"]), "rows": row["rows"], "numeric_columns": len(numeric)}
        name = choose_main_table(stats)
    if name not in tables:
        raise InputError(f"no sheet {name!r}; there are {', '.join(sorted(tables))}")
    return tables[name].frame, name


def source_ref(sheet: str, header_row: int, row: int | None = None) -> dict[str, Any]:
    """Where data come from as a reader of the sheet counts: header row from 1, and the row of data row ``row`` (from 0)."""
    out: dict[str, Any] = {"sheet": sheet, "header_row": header_row}
    return out if row is None else out | {"data_row": row + header_row + 1}


def date_rates(df: DataFrame) -> dict[str, float]:
    """The share of each text or date column's cells that parse as dates."""
    cols = [c for c, k in df.dtypes if k in ("string", "date", "timestamp", "timestamp_ntz")]
    if not cols:
        return {}
    row = df.agg(*(F.avg(stamp(c).isNotNull().cast("double")).alias(f"c{i}") for i, c in enumerate(cols))).first()
    return {c: row[f"c{i}"] or 0.0 for i, c in enumerate(cols)}


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def strict(value: Any) -> Any:
    """JSON values without NaN and infinity, which become null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): strict(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [strict(v) for v in value]
    if value is None or isinstance(value, (bool, int, str)):
        return value
    return str(value)


def write_json(path: str, document: Any) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(strict(document), ensure_ascii=False, allow_nan=False, indent=2), encoding="utf-8")


def read_json(path: str, default: Any = None) -> Any:
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else default


def document(tables: dict[str, DataFrame], most: int = 10_000) -> dict[str, Any]:
    """Result tables as plain JSON rows; for tables of a few rows, a larger one is an InputError."""
    out = {}
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise InputError(f"{name} has over {most} rows: write it as a table")
        out[name] = [strict(r.asDict(recursive=True)) for r in rows]
    return out
