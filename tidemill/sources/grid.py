"""Grids: CSV and XLSX sheets and folder listings as DataFrames of text."""

from __future__ import annotations

import posixpath
import re
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.numbers import format_decimals
from tidemill.operators.outputs import free_name
from tidemill.operators.strict_load import csv_record

ORDER, SURPLUS = "row_number", "surplus"


def read_csv(spark: SparkSession, path: str | Path) -> DataFrame:
    """Text columns named by the header; rows numbered from 0; short rows padded with ''.

    A long row keeps its further cells in `surplus` (numbered if a header has that name), an array
    that is empty in all others.
    """
    reader = spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    names = reader.csv(str(path)).columns
    if not names:
        raise ValueError(f"{path}: an empty file")
    odd = free_name("record", names)
    # the reader sets aside the text of records that have other than the header's number of cells
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*names, odd])
    df = reader.option("columnNameOfCorruptRecord", odd).schema(schema).csv(str(path))
    held = lambda c: F.col(f"`{c.replace('`', '``')}`")
    cells = csv_record(F.regexp_replace(held(odd), r"\r?\n\z", ""))["cells"]
    more = F.when(F.size(cells) > len(names), F.slice(cells, len(names) + 1, F.size(cells)))
    return df.select(
        F.monotonically_increasing_id().alias(ORDER), *[F.coalesce(held(c), F.lit("")).alias(c) for c in names],
        F.coalesce(more, F.array().cast("array<string>")).alias(free_name(SURPLUS, names)),
    )


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_cells(path: str | Path, sheet: str | None = None) -> list[list[str]]:
    """The cells of a sheet as shown: numbers follow the decimal places of their format."""
    with zipfile.ZipFile(path) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        rels = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        sheets = {s.get("name"): rels[s.get(f"{_REL}id")] for s in tree("xl/workbook.xml").iter(f"{_MAIN}sheet")}
        name = sheet or next(iter(sheets))
        if name not in sheets:
            raise ValueError(f"{path}: no sheet {name!r}; there are {', '.join(sheets)}")
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        formats: list[str] = []
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            own = {f.get("numFmtId"): f.get("formatCode") for f in styles.iter(f"{_MAIN}numFmt")} | {"1": "0", "2": "0.00", "3": "#,##0", "4": "#,##0.00"}
            formats = [own.get(x.get("numFmtId"), "") for x in styles.iterfind(f"{_MAIN}cellXfs/{_MAIN}xf")]
        target = sheets[name]
        where = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
        out = []
        for row in tree(where).iter(f"{_MAIN}row"):
            cells: dict[int, str] = {}
            for c in row:
                value = c.findtext(f"{_MAIN}v")
                kind = c.get("t")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif kind == "s":
                    value = shared[int(value)]
                elif value is not None and kind in (None, "n"):
                    places = format_decimals(formats[int(c.get("s", 0))]) if formats else None
                    value = f"{float(value):.{places}f}" if places is not None else re.sub(r"\.0$", "", value)
                cells[_column(c.get("r"))] = value or ""
            out.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        return out


def read_xlsx(spark: SparkSession, path: str | Path, sheet: str | None = None) -> DataFrame:
    """A sheet by name (or the first), text columns named by its first row. Read on the driver: a workbook is one small file."""
    rows = sheet_cells(path, sheet)
    if not rows:
        raise ValueError(f"{path}: an empty sheet")
    head = rows[0]
    body = [(i, *(r + [""] * len(head))[: len(head)]) for i, r in enumerate(rows[1:])]
    return spark.createDataFrame(body, ", ".join([f"{ORDER} long", *(f"`{h.replace('`', '``')}` string" for h in head)]))


def shown_size(count: Column) -> Column:
    """Bytes as whole numbers, and from 1,024 on as kilobytes or megabytes to one decimal."""
    mega = F.format_string("%.1f MB", count / 1048576)
    return F.when(count < 1024, F.concat(F.format_number(count, 0), F.lit(" B"))).when(count < 1048576, F.format_string("%.1f KB", count / 1024)).otherwise(mega)


def list_folder(spark: SparkSession, path: str | Path, pattern: str = "*", sort: str = "name") -> DataFrame:
    """(name, type, size, modified, bytes) of a folder's files, by name or by size from the largest; contents are not read.

    type is the ending in capitals, size as a file manager shows it, modified the day.
    """
    # asked of the file system, as the file reader passes over empty files
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(str(path))
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        raise FileNotFoundError(path)
    held = [s for s in system.globStatus(hadoop.Path(folder, pattern)) or [] if s.isFile()]
    rows = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in held]
    files = spark.createDataFrame(rows, "file string, length long, at long").withColumn("modificationTime", F.timestamp_millis("at"))
    name = F.col("file")
    suffix = F.regexp_extract(name, r".\.([^.]+)$", 1)
    out = files.select(
        name.alias("name"), F.when(suffix == "", F.lit("file")).otherwise(F.upper(suffix)).alias("type"), shown_size(F.col("length")).alias("size"),
        F.date_format("modificationTime", "yyyy-MM-dd").alias("modified"), F.col("length").alias("bytes"),
    )
    if sort not in ("name", "size"):
        raise ValueError(f"sort by name or size, not {sort!r}")
    return out.orderBy("name") if sort == "name" else out.orderBy(F.desc("bytes"), "name")


def read_table(spark: SparkSession, path: str | Path, sheet: str | None = None) -> DataFrame:
    """By suffix: .csv and .tsv (both comma-separated) or .xlsx."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(path)
    if path.suffix in (".csv", ".tsv"):
        return read_csv(spark, path)
    if path.suffix == ".xlsx":
        return read_xlsx(spark, path, sheet)
    raise ValueError(f"{path}: no reader for {path.suffix!r}, only .csv, .tsv and .xlsx")
