"""A synthetic feed: dirty cells and the values they were made from, side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VENDORS = {"Quillmark Tools": ["quillmark", "quill mark tools"], "Oster & Vale": ["oster and vale", "oster vale"], "Tarn Paper Co": ["tarn paper"]}
PROFILE = {
    "name": "synthetic",
    "currency": "USD",
    "columns": {
        "sku": ["Item No"], "handle": ["Handle"], "title": ["Title"], "vendor": ["Brand"], "product_type": ["Type"], "price": ["Price"],
        "cost": ["Cost"], "compare_at": ["Was"], "barcode": ["EAN"], "weight": ["Weight"], "weight_unit": ["Unit"], "dimensions": ["Size"],
        "quantity": ["Qty"], "stock_status": ["Stock"], "published": ["Live"], "taxable": ["Taxed"], "image_url": ["Image"],
        "description": ["Text"], "tags": ["Tags"], "updated_at": ["Changed"],
    },
    "vendors": VENDORS,
    "stock_status": {"in_stock": ["in stock", "available"], "out_of_stock": ["sold out", "oos"]},
    "booleans": {"true": ["yes", "y", "1"], "false": ["no", "n", "0"]},
    "acronyms": ["USB-C", "LED"],
    "minor_words": ["of", "and", "for", "with"],
    "required": ["sku", "title", "price"],
    "limits": {"description_max": 200, "title_max": 60},
}


def rotated(values: list[Column], by: Column) -> Column:
    """The value whose turn it is."""
    return F.element_at(F.array(*values), (by % len(values) + 1).cast("int"))


def dirty_price(cents: Column, turn: Column) -> Column:
    """A whole number of cents, written in one of six ways that all mean the same."""
    whole, rest = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    us = F.concat(F.format_number(whole, 0), F.lit("."), rest)
    eu = F.concat(F.translate(F.format_number(whole, 0), ",", "."), F.lit(","), rest)
    plain = F.concat(whole.cast("string"), F.lit("."), rest)
    return rotated(
        [F.concat(F.lit("$"), us), plain, F.concat(F.lit("  "), F.translate(plain, ".", ","), F.lit(" ")), F.concat(F.lit("USD "), plain), eu, F.concat(plain, F.lit(" US$"))], turn
    )


def ean(body: Column) -> Column:
    """A 13-digit code from a number of up to 12 digits."""
    digits = F.lpad(body.cast("string"), 12, "0")
    total = sum((F.substring(digits, i + 1, 1).cast("int") * (1 if i % 2 == 0 else 3) for i in range(12)), F.lit(0))
    return F.concat(digits, ((10 - total % 10) % 10).cast("string"))


def synthetic(spark: SparkSession, n: int, twins: int = 7) -> DataFrame:
    """n rows of canonical cells with line; every `twins`-th sku is sent twice, the later row newer and without a brand.

    truth_cents, truth_grams and truth_mm hold what price, weight and dimensions mean.
    """
    i = F.col("id")
    group = F.when(i % twins == 1, i - 1).otherwise(i)
    cents = 500 + (i * 7919) % 90000
    grams = 50 + (i * 31) % 2000
    mm = 10 + (i * 13) % 400
    later = F.when(i % twins == 1, F.lit("2026-02-03T10:00:00Z")).otherwise(F.lit("2026-01-15"))
    title = F.concat(F.lit("led lamp of oak no "), group.cast("string"))
    return spark.range(n).select(
        (i + 2).alias("line"),
        F.concat(F.lit("SKU-"), group.cast("string")).alias("sku"),
        F.concat(F.lit("lamp-"), group.cast("string")).alias("handle"),
        rotated([title, F.upper(title), F.initcap(title)], i).alias("title"),
        F.when(i % twins == 1, F.lit("")).otherwise(rotated([F.lit("quillmark"), F.lit("OSTER AND VALE"), F.lit(" Tarn  Paper "), F.lit("Nobody Ltd")], i)).alias("vendor"),
        F.lit("Lamps").alias("product_type"),
        dirty_price(cents, i).alias("price"),
        ean(F.lit(200000000000) + group).alias("barcode"),
        rotated([F.concat(grams.cast("string"), F.lit(" g")), F.concat(grams.cast("string"), F.lit("GRAMS.")), grams.cast("string")], i).alias("weight"),
        F.lit("g").alias("weight_unit"),
        F.concat(mm.cast("string"), F.lit(" x 20 x 30 mm")).alias("dimensions"),
        rotated([F.lit("12"), F.lit("1,200"), F.lit("lots")], i).alias("quantity"),
        rotated([F.lit("In Stock"), F.lit("sold-out"), F.lit("ask us")], i).alias("stock_status"),
        rotated([F.lit("Y"), F.lit("no"), F.lit("TRUE")], i).alias("published"),
        F.lit("yes").alias("taxable"),
        F.lit("//img.example/a.jpg").alias("image_url"),
        F.lit("<p>Oak &amp; brass</p>").alias("description"),
        F.lit("lamp, oak").alias("tags"),
        later.alias("updated_at"),
        cents.alias("truth_cents"),
        grams.alias("truth_grams"),
        mm.alias("truth_mm"),
    )
