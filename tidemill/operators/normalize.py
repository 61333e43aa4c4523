"""Rows in canonical form, with every edit and every refusal recorded (field normalisers).

Input: line, raw struct<20 fields>, extra and original maps. Added: v (struct of canonical values
as text, null where there is none), changes and issues (arrays of structs). Parsers run once per
row, each into a column of its own; values, changes and issues only refer to these columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.casing import title_case
from tidemill.functions.codes import parse_barcode, parse_url
from tidemill.functions.numbers import money_text, parse_money, parse_quantity, plain_decimal
from tidemill.functions.text import all_lower, all_upper, fold, plain_text, quoted, strip_space, tidy
from tidemill.functions.units import parse_dimensions, parse_weight
from tidemill.profile import Profile

CHANGE = "struct<field:string,rule:string,outcome:string,before:string,after:string,note:string>"
ISSUE = "struct<rule:string,field:string,message:string,severity:string>"
REVIEW, REJECT = "review", "reject"
CHANGED, UNRESOLVED, DROPPED = "changed", "unresolved", "dropped"

TIDIED = ("sku", "handle", "product_type", "tags", "updated_at")
MONEY = ("price", "cost", "compare_at")
EDGES = ("length_mm", "width_mm", "height_mm")
#: Values that are counted for completeness but not written out.
HIDDEN = ("price_currency", "cost_currency", "compare_at_currency", "weight_unit", "vendor_unmapped", "barcode_error", "image_error")


def change(field: str, rule: Column | str, outcome: str, before: Column, after: Column, note: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.lit(field).alias("field"), lit(rule).alias("rule"), F.lit(outcome).alias("outcome"), before.alias("before"),
        F.coalesce(after, F.lit("")).alias("after"), lit(note).alias("note"),
    ).cast(CHANGE)


def issue(rule: Column | str, field: str, message: Column, severity: str = REVIEW) -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(rule.alias("rule"), F.lit(field).alias("field"), message.alias("message"), F.lit(severity).alias("severity")).cast(ISSUE)


def _moved(field: str, rule: Column | str, before: Column, after: Column, note: Column | str = "") -> Column:
    """A change, if the text did change."""
    return F.when(F.coalesce(after, F.lit("")) != before, change(field, rule, CHANGED, before, after, note))


def _refused(field: str, rule: str, before: Column, error: Column) -> tuple[Column, Column]:
    return F.when(error.isNotNull(), change(field, rule, UNRESOLVED, before, F.lit(""), error)), F.when(error.isNotNull(), issue(rule, field, error))


def _lookup(pairs, key: Column) -> Column:
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def normalize(rows: DataFrame, profile: Profile, image_base: str = "") -> DataFrame:
    """Add v, changes and issues; see the module. Null raw cells count as empty."""
    raw = lambda f: F.coalesce(F.col(f"raw.{f}"), F.lit(""))
    title, vendor = plain_text(raw("title")), plain_text(raw("vendor"))
    staged = rows.withColumns({"__title": title, "__vendor": vendor, "__description": plain_text(raw("description"))})
    cased = lambda c: title_case(c, profile.acronyms, profile.minor_words)
    recased = lambda c: (c != "") & (all_upper(c) | all_lower(c))
    t, w = F.col("__title"), F.col("__vendor")
    staged = staged.withColumns(
        {
            **{f"__t_{f}": tidy(raw(f)) for f in TIDIED},
            "__title_case": F.when(recased(t), cased(t)),
            "__vendor_known": _lookup(profile.vendors, fold(w)),
            "__vendor_case": F.when(recased(w), cased(w)).otherwise(w),
            **{f"__{f}": parse_money(raw(f)) for f in MONEY},
            "__weight": parse_weight(raw("weight"), raw("weight_unit")),
            "__quantity": parse_quantity(raw("quantity")),
            "__dimensions": parse_dimensions(raw("dimensions")),
            **{f"__w_{f}": tidy(raw(f)) for f in ("weight", "weight_unit", "dimensions", "quantity", "stock_status", "published", "taxable", "barcode", "image_url")},
            "__stock_status": _lookup(profile.stock_status, fold(raw("stock_status"))),
            "__published": _lookup(profile.booleans, fold(raw("published"))),
            "__taxable": _lookup(profile.booleans, fold(raw("taxable"))),
            "__barcode": parse_barcode(raw("barcode")),
            "__image_url": parse_url(raw("image_url"), image_base),
        }
    )
    values: dict[str, Column] = {}
    changes: list[Column] = []
    issues: list[Column] = []
    for f in TIDIED:
        values[f] = F.col(f"__t_{f}")
        changes.append(_moved(f, f"{f}.whitespace", raw(f), values[f]))
    values["title"] = F.coalesce("__title_case", "__title")
    rule = F.when(F.col("__title_case").isNotNull(), F.lit("title.case")).otherwise(F.lit("title.whitespace"))
    changes.append(_moved("title", rule, raw("title"), values["title"]))
    known, unmapped = F.col("__vendor_known"), (w != "") & F.col("__vendor_known").isNull()
    values["vendor"] = F.coalesce(known, F.col("__vendor_case"))
    rule = F.when(known.isNotNull(), F.lit("vendor.canonical")).otherwise(F.lit("vendor.whitespace"))
    changes.append(_moved("vendor", rule, raw("vendor"), values["vendor"], F.when(unmapped, F.lit("no alias of a known vendor")).otherwise(F.lit(""))))
    values["vendor_unmapped"] = F.when(unmapped, F.lit("true"))
    for f in MONEY:
        m = F.col(f"__{f}")
        values[f] = money_text(m["amount"])
        values[f"{f}_currency"] = F.when(m["amount"].isNotNull(), F.coalesce(m["currency"], F.lit(profile.currency)))
        changes.append(F.when(m["amount"].isNotNull(), _moved(f, f"{f}.format", raw(f), values[f])))
        refused = _refused(f, f"{f}.format", raw(f), m["error"])
        changes.append(refused[0])
        issues.append(refused[1])
        other = m["currency"] != profile.currency
        issues.append(F.when(other, issue(f"{f}.currency_mismatch", f, F.concat(m["currency"], F.lit(f" in a feed of {profile.currency}; amounts are not converted")))))
    values["currency"] = F.coalesce(values["price_currency"], F.lit(profile.currency))
    grams = F.col("__weight")
    values["weight_unit"] = F.col("__w_weight_unit")
    values["weight_g"] = plain_decimal(grams["value"])
    shown = F.when(raw("weight_unit") == "", raw("weight")).otherwise(F.concat_ws(" ", "__w_weight", "__w_weight_unit"))
    read = (F.col("__w_weight") != "") & grams["error"].isNull()
    changes.append(F.when(read, _moved("weight_g", "weight.unit", shown, values["weight_g"])))
    refused = _refused("weight_g", "weight.unit", raw("weight"), grams["error"])
    changes.append(refused[0])
    issues.append(refused[1])
    dims = F.col("__dimensions")
    for i, f in enumerate(EDGES):
        values[f] = plain_decimal(F.get(dims["value"], F.lit(i)))
    after = F.when(dims["value"].isNotNull(), F.array_join(F.transform(dims["value"], plain_decimal), " x "))
    in_mm = F.coalesce(F.concat(after, F.lit(" mm")), F.lit(""))
    read = (F.col("__w_dimensions") != "") & dims["error"].isNull()
    changes.append(F.when(read & (F.coalesce(after, F.lit("")) != F.col("__w_dimensions")), change("dimensions", "dimensions.unit", CHANGED, raw("dimensions"), in_mm)))
    refused = _refused("dimensions", "dimensions.unit", raw("dimensions"), dims["error"])
    changes.append(refused[0])
    issues.append(refused[1])
    q = F.col("__quantity")
    values["quantity"] = q["value"].cast("string")
    changes.append(F.when((F.col("__w_quantity") != "") & q["error"].isNull(), _moved("quantity", "quantity.format", raw("quantity"), values["quantity"])))
    refused = _refused("quantity", "quantity.format", raw("quantity"), q["error"])
    changes.append(refused[0])
    issues.append(refused[1])
    for f, what in (("stock_status", "no stock state of this profile"), ("published", "neither yes nor no"), ("taxable", "neither yes nor no")):
        text, hit = F.col(f"__w_{f}"), F.col(f"__{f}")
        values[f] = F.when(text != "", hit)
        error = F.when((text != "") & hit.isNull(), F.concat(quoted(text), F.lit(f" is {what}")))
        changes.append(F.when(values[f].isNotNull(), _moved(f, f"{f}.vocabulary", raw(f), values[f])))
        refused = _refused(f, f"{f}.vocabulary", raw(f), error)
        changes.append(refused[0])
        issues.append(refused[1])
    for f, bad_rule, good_rule, hidden in (
        ("barcode", "barcode.check", "barcode.format", "barcode_error"),
        ("image_url", "image_url.scheme", "image_url.scheme", "image_error"),
    ):
        x = F.col(f"__{f}")
        values[f], values[hidden] = x["value"], x["error"]
        changes.append(F.when((F.col(f"__w_{f}") != "") & x["error"].isNull(), _moved(f, good_rule, raw(f), x["value"])))
        changes.append(_refused(f, bad_rule, raw(f), x["error"])[0])
    values["description"] = F.col("__description")
    changes.append(_moved("description", "description.html", raw("description"), values["description"]))
    out = staged.select(
        *rows.columns,
        F.struct(*[c.cast("string").alias(k) for k, c in values.items()]).alias("v"),
        F.array_compact(F.array(*changes)).alias("changes"),
        F.array_distinct(F.array_compact(F.array(*issues))).alias("issues"),
    )
    effective = F.coalesce(F.nullif(F.col("v.sku"), F.lit("")), strip_space(raw("sku")))
    return out.withColumn("sku", effective)
