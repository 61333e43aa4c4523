"""Feeds: CSV files and tables of canonical cells as rows for the pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import tidy
from tidemill.profile import FIELDS, Profile


class UnreadableInput(ValueError):
    """The input is missing, not UTF-8, or holds no rows."""


@dataclass(frozen=True)
class Feed:
    """rows: line, raw, extra, original; headers as written; mapped fields; headers not mapped."""

    rows: DataFrame
    headers: list[str]
    mapped: list[str]
    unmapped: list[str]


def _schema(n: int) -> str:
    return ", ".join(f"c{i} string" for i in range(n))


def check_utf8(spark: SparkSession, path: str) -> None:
    """Raise if a file is missing or is not UTF-8, which the CSV reader would pass over.

    Lines are looked at where they are read, so a file of any size is checked in parts.
    """
    from pyspark.errors import AnalysisException

    try:
        bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).collect()
    except AnalysisException as e:
        raise UnreadableInput(f"{path}: there is no such file") from e
    if bad:
        raise UnreadableInput(f"{path}: not UTF-8 text")


def read_feed(spark: SparkSession, path: str | Path, profile: Profile) -> Feed:
    """One CSV file: comma, doubled quotes, line breaks in cells.

    The first record is the header. line is the number of the record, the header being 1; a blank
    line is no record. Missing cells are empty, surplus ones are dropped. Of several columns for
    one field the last counts, even if it is blank; of several equal headers too. Line breaks in
    cells come out as \\n.
    """
    path = str(path)
    check_utf8(spark, path)
    reader = spark.read.options(header=False, multiLine=True, escape='"', quote='"', inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")
    first = reader.csv(path).limit(1).collect()
    if not first:
        raise UnreadableInput(f"{path}: nothing in it")
    headers = [h or "" for h in first[0]]
    if headers and headers[0].startswith("﻿"):
        headers[0] = headers[0][1:]
    # one file is one task, so the ids are the record numbers
    records = reader.schema(_schema(len(headers))).csv(path).withColumn("__at", F.monotonically_increasing_id())
    feed = from_cells(records.where(F.col("__at") > 0).withColumn("line", F.col("__at") + 1).drop("__at"), headers, profile)
    if feed.rows.isEmpty():
        raise UnreadableInput(f"{path}: a header but no rows")
    return feed


def from_cells(records: DataFrame, headers: Sequence[str], profile: Profile) -> Feed:
    """A Feed of `records`, which have line and then one column c0, c1, ... per header."""
    place = {h: i for i, h in enumerate(headers)}  # the last of equal headers
    cell = lambda i: F.coalesce(F.col(f"c{i}"), F.lit(""))
    by_field, unmapped = {}, []
    for h in dict.fromkeys(headers):
        f = profile.field_of(h)
        if f is None:
            unmapped.append(h)
        else:
            by_field[f] = max(place[h], by_field.get(f, -1))
    empty = F.create_map().cast("map<string,string>")
    pairs = lambda hs, fn: F.create_map(*[x for h in hs for x in (F.lit(h), fn(cell(place[h])))]) if hs else empty
    raw = F.struct(*[(cell(by_field[f]) if f in by_field else F.lit("")).alias(f) for f in FIELDS])
    unique = list(dict.fromkeys(headers))
    rows = records.select(F.col("line").cast("bigint"), raw.alias("raw"), pairs(unmapped, tidy).alias("extra"), pairs(unique, lambda c: c).alias("original"))
    return Feed(rows, unique, sorted(by_field), unmapped)


def from_table(rows: DataFrame, profile: Profile, line: str = "line") -> Feed:
    """A Feed of a table with columns of the canonical names; other columns are not carried along."""
    have = [f for f in FIELDS if f in rows.columns]
    raw = F.struct(*[(F.coalesce(F.col(f), F.lit("")) if f in have else F.lit("")).alias(f) for f in FIELDS])
    empty = F.create_map().cast("map<string,string>")
    return Feed(rows.select(F.col(line).cast("bigint").alias("line"), raw.alias("raw"), empty.alias("extra"), empty.alias("original")), have, have, [])
