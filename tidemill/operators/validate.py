"""Rules on kept rows: what is missing, unusable or too long. No value is edited.

Rules about prices, stock and eligibility are business rules and not part of this engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import let
from tidemill.operators.normalize import REJECT, REVIEW, issue
from tidemill.profile import Profile


def _value(f: str) -> Column:
    # weight and dimensions are held in their common units
    return F.coalesce(F.col(f"v.{ {'weight': 'weight_g', 'dimensions': 'length_mm'}.get(f, f) }"), F.lit(""))


def _of(field: str) -> tuple[str, ...]:
    return {"weight": ("weight", "weight_g")}.get(field, (field,))


def _require(issues: Column, field: str) -> Column:
    """Issues with the field's absence told once: by a rejection there is, a promoted review, or a new rejection."""

    def told(xs: Column) -> Column:
        mine = lambda x, severity: x["field"].isin(*_of(field)) & (x["severity"] == severity)
        promoted = F.transform(xs, lambda x: F.when(mine(x, REVIEW), x.withField("severity", F.lit(REJECT))).otherwise(x))
        added = F.concat(xs, F.array(issue(f"missing_{field}", field, F.lit(f"there is no {field}"), REJECT)))
        return (
            F.when(_value(field) != "", xs)
            .when(F.exists(xs, lambda x: mine(x, REJECT)), xs)
            .when(F.exists(xs, lambda x: mine(x, REVIEW)), promoted)
            .otherwise(added)
        )

    return let(issues, told)


def validate(rows: DataFrame, profile: Profile) -> DataFrame:
    """`rows` (deduplicated) with all issues, `rejected` and `needs_review`; dropped rows are left as they are."""
    long = lambda f, cap, severity: F.when(
        F.char_length(_value(f)) > cap,
        issue(f"{f}_too_long", f, F.concat(F.char_length(_value(f)).cast("string"), F.lit(f" characters, at most {cap} are allowed")), severity),
    )
    first = F.array_compact(
        F.array(
            F.when(F.col("v.barcode_error").isNotNull(), issue("barcode_invalid", "barcode", F.col("v.barcode_error"), REJECT)),
            F.when(
                F.col("v.image_error").isNotNull() & (_value("image_url") == ""), issue("image_unusable", "image_url", F.col("v.image_error"), REJECT)
            ),
        )
    )
    issues = F.concat("issues", first)
    for f in profile.required:
        issues = _require(issues, f)
    last = F.array_compact(F.array(long("description", profile.description_max, REJECT), long("title", profile.title_max, REVIEW)))
    whole = F.array_distinct(F.concat(issues, last))
    judged = rows.withColumn("issues", F.when(F.col("role") == "dropped", F.col("issues")).otherwise(whole))
    has = lambda s: F.exists("issues", lambda x: x["severity"] == s)
    return judged.withColumns({"rejected": has(REJECT) & (F.col("role") != "dropped"), "needs_review": has(REVIEW)})
