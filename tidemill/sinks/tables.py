"""CSV files and terminal tables."""

from __future__ import annotations

import shutil
import tempfile
import textwrap
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.functions.numbers import looks_numeric
from tidemill.functions.text import clip, tidy

_FORMAT = {"header": True, "escape": '"', "lineSep": "\r\n", "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv_parts(df: DataFrame, folder: str) -> None:
    """One file per partition, in order; the way to write at scale."""
    df.write.mode("overwrite").options(**_FORMAT).csv(folder)


def _header(columns: Sequence[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\r\n') else c for c in columns) + "\r\n"


def write_csv(df: DataFrame, path: str | Path) -> int:
    """One UTF-8 file with CRLF line ends and always a header; the number of rows.

    Each partition becomes a file in a folder beside the target, which has to lie where executors
    and driver both see it, as the target has; they are then joined in the order of the rows. The rows are counted
    while they are written. See write_csv_parts for tables that are to stay in parts.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    seen = Observation()
    with tempfile.TemporaryDirectory(dir=path.parent) as folder:
        target = f"{folder}/out"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.options(**{**_FORMAT, "header": False}).csv(Path(target).as_uri())
        with path.open("wb") as out:
            out.write(_header(df.columns).encode())
            for part in sorted(Path(target).glob("part-*.csv"), key=lambda p: int(p.name.split("-")[1])):
                with part.open("rb") as rows:
                    shutil.copyfileobj(rows, out)
    return seen.get["n"]


def _wrapped(text: str, width: int) -> list[str]:
    """A cell in lines of at most `width`, cut at spaces where there are any."""
    return textwrap.wrap(text, width, break_long_words=True) or [""]


def terminal_table(df: DataFrame, columns: Sequence[str], limit: int = 13, width: int = 28, wrap: str | None = None) -> str:
    """The first rows as fixed-width text, and how many more there are.

    A column is set to the right if all its filled cells are numbers. Cells are cut to `width`, but
    those of the column `wrap` run on in further lines.
    """
    missing = [c for c in (*columns, *([wrap] if wrap else ())) if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    texts = [F.col(f"`{c}`").cast("string") for c in columns]
    cells = [F.coalesce(tidy(t) if c == wrap else clip(t, width), F.lit("")) for c, t in zip(columns, texts)]
    # one row more than is shown tells whether there is a need to count
    found = df.select(F.array(*cells).alias("t"), F.array(*[looks_numeric(t) for t in texts]).alias("n")).limit(limit + 1).collect()
    shown = found[:limit]
    more = df.count() - limit if len(found) > limit else 0
    right = [any(r["t"][i] for r in shown) and all(r["n"][i] or not r["t"][i] for r in shown) for i in range(len(columns))]
    lines_of = [[_wrapped(t, width) if c == wrap else [t] for c, t in zip(columns, r["t"])] for r in shown]
    widths = [max([len(c), *(len(x) for row in lines_of for x in row[i])]) for i, c in enumerate(columns)]
    put = lambda i, x: x.rjust(widths[i]) if right[i] else x.ljust(widths[i])
    out = ["  ".join(put(i, c) for i, c in enumerate(columns)).rstrip(), "  ".join("-" * w for w in widths)]
    for row in lines_of:
        for k in range(max(map(len, row))):
            out.append("  ".join(put(i, x[k] if k < len(x) else "") for i, x in enumerate(row)).rstrip())
    if more > 0:
        out.append(f"... and {more} more")
    return "\n".join(out) + "\n"
