"""Rows that fail to parse, set apart with the reason (problem 3).

The strict load keeps only records that conform in quoting, column count, price and barcode.
Their offsets are subtracted from the raw offsets by an anti-join, and only what remains is
diagnosed, so the reasons can be as slow and wordy as they like. A record that is not loaded is
always in the remainder, whatever made it fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.codes import parse_barcode
from tidemill.functions.numbers import parse_money
from tidemill.functions.text import PLACEHOLDERS, fold, let, tidy
from tidemill.session import small_side

# a cut, and the two marks that stand for a mark of the text itself while it is cut
_CUT, _KEEP = "\x01", "\x02"

#: Rules in the order they are reported; the first two exclude the others.
RULES = ("broken_quoting", "column_count", "missing_price", "price.format", "price_not_positive", "barcode_invalid")


def _plain_cells(text: Column) -> Column:
    return F.split(text, ",", -1)


def _quoted_record(text: Column) -> Column:
    """`csv_record` of a text with quotes in it."""

    def read(parts: Column) -> Column:
        last = F.size(parts) - 1

        def fits(p: Column, i: Column) -> Column:
            opens = (i == 0) | F.startswith(p, F.lit(","))
            closes = (i == last) | F.endswith(p, F.lit(","))
            return F.when(p == "", F.lit(True)).otherwise(opens & closes)

        # an empty first or last piece is the start or end of the record
        sound = (last % 2 == 0) & F.forall(F.transform(parts, lambda p, i: (i % 2 == 1) | fits(p, i)), lambda ok: ok)
        outside = F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.translate(p, ",", _CUT)).otherwise(p))
        cells = F.transform(
            F.split(F.array_join(outside, '"'), _CUT, -1),
            lambda x: F.when(
                F.startswith(x, F.lit('"')), F.replace(F.substring(x, 2, F.length(x) - 2), F.lit('""'), F.lit('"'))
            ).otherwise(x),
        )
        return F.struct(sound.alias("sound"), F.when(sound, cells).alias("cells"))

    def kept(record: Column) -> Column:
        put_back = lambda x: F.replace(F.replace(x, F.lit(_KEEP + "a"), F.lit(_CUT)), F.lit(_KEEP + "b"), F.lit(_KEEP))
        return F.struct(record["sound"].alias("sound"), F.transform(record["cells"], put_back).alias("cells"))

    cut = lambda c: let(F.split(c, '"', -1), read)
    marked = F.contains(text, F.lit(_CUT)) | F.contains(text, F.lit(_KEEP))
    spelt = F.replace(F.replace(text, F.lit(_KEEP), F.lit(_KEEP + "b")), F.lit(_CUT), F.lit(_KEEP + "a"))
    return F.when(marked, let(cut(spelt), kept)).otherwise(cut(text))


def csv_record(text: Column) -> Column:
    """struct<sound boolean, cells array<string>> of one CSV record (comma, doubled quotes).

    A text without a quote is cut at its commas and no more. Any other is cut at its quotes: pieces
    at even places lie outside quoted cells, and a doubled quote is an empty one of these. Quoting
    is sound if the number of quotes is even and every outside piece touches a quote only with a
    comma or as a doubled quote. No regex with nested repetition is run, so a record of any length
    is read in linear time and constant stack. Cells come out as delivered, whatever characters
    they hold. An empty record has one empty cell; null gives null.
    """
    unquoted = F.struct(F.lit(True).alias("sound"), _plain_cells(text).alias("cells"))
    return F.when(text.isNull(), F.lit(None)).when(F.contains(text, F.lit('"')), _quoted_record(text)).otherwise(unquoted)


def header_positions(files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(feed_id, width, positions map<field, index>) of each file's header record.

    Of several headers for one field the last counts, as when cells are stored by field.
    """
    heads = files.where(F.col("header").isNotNull()).select("feed_id", csv_record(F.col("header"))["cells"].alias("heads"))
    cells = heads.select("feed_id", F.size("heads").alias("width"), F.posexplode("heads").alias("at", "head"))
    known = aliases.select(fold(F.col("header")).alias("__key"), "field").distinct()
    named = cells.join(small_side(known), fold(F.col("head")) == F.col("__key"), "left")
    # the rows of one header come together here: as many as a file has columns
    by_field = named.groupBy("feed_id", "width", "field").agg(F.max("at").alias("at"))
    entry = F.when(F.col("field").isNotNull(), F.struct("field", "at"))
    return by_field.groupBy("feed_id", "width").agg(F.map_from_entries(F.collect_list(entry)).alias("positions"))


def _read(records: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    heads = header_positions(files, aliases).withColumnRenamed("feed_id", "__feed")
    needed = records.select("record_id", "feed_id", "line", "raw_text")
    joined = needed.join(small_side(heads), F.col("feed_id") == F.col("__feed"), "left").drop("__feed")
    return joined.withColumn("__rec", csv_record(F.col("raw_text")))


def _cell(field: str) -> Column:
    at = F.try_element_at(F.col("positions"), F.lit(field))
    return F.when(at.isNotNull(), F.get(F.col("__rec.cells"), at))


def _is_empty(c: Column) -> Column:
    return tidy(c).isin("", *PLACEHOLDERS)


def _price_rule(c: Column) -> Column:
    def rule(m: Column) -> Column:
        return F.when(m["amount"].isNull(), F.lit("price.format")).when(m["amount"] <= 0, F.lit("price_not_positive"))

    # only rows are filtered by this, and a filter would draw steps laid out over columns into itself
    return F.when(c.isNotNull(), F.when(_is_empty(c), F.lit("missing_price")).otherwise(let(parse_money(c), rule)))


def _barcode_rule(c: Column) -> Column:
    stated = c.isNotNull() & ~_is_empty(c) & (tidy(c) != "0")
    return F.when(stated & parse_barcode(c)["value"].isNull(), F.lit("barcode_invalid"))


def _conforms() -> Column:
    shape = F.col("__rec.sound") & (F.size("__rec.cells") == F.col("width"))
    return F.coalesce(shape & _price_rule(_cell("price")).isNull() & _barcode_rule(_cell("barcode")).isNull(), F.lit(False))


def load(records: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """The strict load: (record_id, feed_id, line, cells) of the conforming records only.

    A record whose file or header is not known does not conform. A header without a price or
    barcode column puts no rule on these. Null ids and repeated records are loaded as they are.
    """
    return _read(records, files, aliases).where(_conforms()).select("record_id", "feed_id", "line", F.col("__rec.cells").alias("cells"))


def reject(records: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """(record_id, feed_id, line, rule, raw_text): one row per failing record and rule.

    `no_header` is the rule of a record whose file has no header record; a null text counts as
    one empty cell. Nothing is diagnosed but what the strict load left out.
    """
    loaded = load(records, files, aliases).select(F.col("record_id").alias("__id"))
    rest = records.join(loaded, records["record_id"] == loaded["__id"], "left_anti")
    rest = _read(rest.withColumn("raw_text", F.coalesce("raw_text", F.lit(""))), files, aliases)
    by_cell = F.array_compact(F.array(_price_rule(_cell("price")), _barcode_rule(_cell("barcode"))))
    rules = (
        F.when(F.col("width").isNull(), F.array(F.lit("no_header")))
        .when(~F.col("__rec.sound"), F.array(F.lit("broken_quoting")))
        .when(F.size("__rec.cells") != F.col("width"), F.array(F.lit("column_count")))
        .otherwise(by_cell)
    )
    return rest.select("record_id", "feed_id", "line", F.explode(rules).alias("rule"), "raw_text")
