"""The three tables a run gives: clean rows, rejected rows, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.normalize import EDGES, REJECT, UNRESOLVED

# Columns of the outputs.
CLEAN = (
    "sku", "title", "vendor", "product_type", "price", "currency", "cost", "compare_at", "barcode", "weight_g", *EDGES,
    "quantity", "stock_status", "published", "taxable", "image_url", "description", "tags", "handle", "updated_at",
)
CHANGES = ("line", "sku", "field", "rule", "outcome", "before", "after", "note")
FLAG = "flagged"


def free_name(name: str, taken: Sequence[str]) -> str:
    """`name`, numbered if a column of that name (in any case) is there already."""
    low, n, out = {t.lower() for t in taken}, 1, name
    while out.lower() in low:
        n += 1
        out = f"{name} ({n})"
    return out


def _with_cells(columns: list[Column], taken: list[str], source: str, headers: Sequence[str]) -> list[Column]:
    for h in headers:
        name = free_name(h, taken)
        taken.append(name)
        columns.append(F.coalesce(F.try_element_at(F.col(source), F.lit(h)), F.lit("")).alias(name))
    return columns


def _issue_text(issues: Column) -> Column:
    said = F.transform(issues, lambda x: F.when(x["field"] == "", x["message"]).otherwise(F.concat_ws(": ", x["field"], x["message"])))
    return F.array_join(said, "; ")


def is_clean() -> Column:
    return (F.col("role") != "dropped") & ~F.col("rejected")


def clean_table(rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Canonical columns, unmapped ones, needs_review, issues, and whether the row is flagged; by line."""
    last = ["needs_review", "issues", FLAG, "line"]
    columns = [F.coalesce(F.col(f"v.{c}"), F.lit("")).alias(c) for c in CLEAN]
    columns = _with_cells(columns, [*CLEAN, *last], "extra", extra)
    review = F.when(F.col("needs_review"), F.lit("yes")).otherwise(F.lit("no"))
    kept = rows.where(is_clean()).orderBy("line")
    return kept.select(*columns, review.alias("needs_review"), _issue_text(F.col("issues")).alias("issues"), F.col("needs_review").alias(FLAG))


def rejects_table(rows: DataFrame, headers: Sequence[str] = ()) -> DataFrame:
    """line, sku, reject_rules, reason, then the original cells; by line."""
    bad = F.filter("issues", lambda x: x["severity"] == REJECT)
    rules = F.array_join(F.array_sort(F.array_distinct(F.transform(bad, lambda x: x["rule"]))), " ")
    columns = [F.col("line"), F.col("sku"), rules.alias("reject_rules"), _issue_text(bad).alias("reason")]
    columns = _with_cells(columns, ["line", "sku", "reject_rules", "reason", FLAG], "original", headers)
    return rows.where(F.col("rejected")).orderBy("line").select(*columns, F.lit(True).alias(FLAG))


def changes_table(rows: DataFrame) -> DataFrame:
    """Every change of every row, dropped ones too; by line, field and rule."""
    each = rows.select("line", "sku", F.posexplode("changes").alias("seq", "c"))
    return each.orderBy("line", "c.field", "c.rule", "seq").select(
        *[F.col(c) if c in ("line", "sku") else F.col(f"c.{c}") for c in CHANGES], (F.col("c.outcome") == UNRESOLVED).alias(FLAG)
    )
