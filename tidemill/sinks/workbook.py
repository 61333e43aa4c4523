"""An .xlsx of several tables, written with the standard library; equal tables give equal bytes."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Mapping
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame

from tidemill.functions.text import column_letters
from tidemill.operators.outputs import FLAG

# Columns written as numbers, those of them with two decimals, and widths.
NUMERIC = ("price", "cost", "compare_at", "weight_g", "length_mm", "width_mm", "height_mm", "quantity", "line")
MONEY = ("price", "cost", "compare_at")
WIDTHS = {"title": 34, "description": 40, "issues": 46, "reason": 46, "image_url": 30, "tags": 26, "note": 30}
WIDTH = 15
#: Rows a sheet can have, its header included.
MAX_ROWS = 1_048_576

_CLOCK = (1980, 1, 1, 0, 0, 0)
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
# cell styles: 0 plain, 1 header, 2 money, 3 flagged, 4 flagged money
_STYLES = (
    f"{_HEAD}<styleSheet {_MAIN}>"
    '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><color rgb="FFFFFFFF"/><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="4"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FF37474F"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFECB3"/></patternFill></fill></fills>'
    '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    '<cellXfs count="5"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf numFmtId="2" applyNumberFormat="1"/>'
    '<xf fillId="3" applyFill="1"/><xf numFmtId="2" fillId="3" applyNumberFormat="1" applyFill="1"/></cellXfs></styleSheet>'
)
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _number(text: str) -> str | None:
    return text if re.fullmatch(r"-?\d+(\.\d+)?", text) else None


def _cell(ref: str, column: str, value, flagged: bool) -> str:
    text = "" if value is None else str(value)
    number = _number(text) if column in NUMERIC else None
    style = (4 if column in MONEY and number else 3) if flagged else (2 if column in MONEY and number else 0)
    if number is not None:
        return f'<c r="{ref}" s="{style}"><v>{number}</v></c>'
    if not text:
        return f'<c r="{ref}" s="{style}"/>' if style else ""
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(_NO_XML.sub("", text))}</t></is></c>'


def write_workbook(tables: Mapping[str, DataFrame], path: str | Path) -> int:
    """One sheet per table in the given order; the number of rows of all.

    Header bold and frozen, filter on sheets with rows, flagged rows tinted (column `flagged`,
    which is not written). Rows stream from the cluster one partition at a time.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    total = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:

        def member(name: str):
            info = zipfile.ZipInfo(name, _CLOCK)
            info.compress_type = zipfile.ZIP_DEFLATED
            return info

        def put(name: str, text: str) -> None:
            z.writestr(member(name), text)

        names = list(tables)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        put(
            "[Content_Types].xml",
            f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        )
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
        put("_rels/.rels", f'{_HEAD}<Relationships {package}><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        put("xl/workbook.xml", f'{_HEAD}<workbook {_MAIN} xmlns:r="{rel}"><sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        put("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships {package}>{rels}<Relationship Id="rId{len(names) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        put("xl/styles.xml", _STYLES)
        for i, name in enumerate(names, 1):
            df = tables[name]
            columns = [c for c in df.columns if c != FLAG]
            letters = [column_letters(k) for k in range(len(columns))]
            at = [df.columns.index(c) for c in columns]
            flag = df.columns.index(FLAG) if FLAG in df.columns else None
            widths = "".join(f'<col min="{k}" max="{k}" width="{WIDTHS.get(c, WIDTH)}" customWidth="1"/>' for k, c in enumerate(columns, 1))
            with z.open(member(f"xl/worksheets/sheet{i}.xml"), "w") as out:
                write = lambda s: out.write(s.encode("utf-8"))  # noqa: B023, E731
                write(f'{_HEAD}<worksheet {_MAIN}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData><row r="1">')
                write("".join(f'<c r="{x}1" s="1" t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for x, c in zip(letters, columns)) + "</row>")
                n = 0
                for r in df.toLocalIterator():
                    n += 1
                    if n >= MAX_ROWS:
                        raise ValueError(f"{name}: more rows than a sheet can hold; write CSV instead")
                    tint = bool(flag is not None and r[flag])
                    write(f'<row r="{n + 1}">' + "".join(_cell(f"{x}{n + 1}", c, r[k], tint) for x, c, k in zip(letters, columns, at)) + "</row>")
                write("</sheetData>" + (f'<autoFilter ref="A1:{letters[-1]}{n + 1}"/>' if n else "") + "</worksheet>")
            total += n
    return total
