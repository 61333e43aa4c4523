"""Queries of the feed-cleaning operators over the driver's tables, with SQL that states the truth.

Dirty text is made from known clean values, so the SQL needs no parser: it says what the value was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import casing, codes, numbers, text, units
from tidemill.functions.staged import with_columns
from tidemill.operators import view
from tidemill.operators.dedupe import deduplicate
from tidemill.operators.normalize import normalize
from tidemill.operators.outputs import CLEAN, changes_table, clean_table, rejects_table
from tidemill.operators.summary import reasons, rule_counts, top_rules, totals, unmapped_vendors
from tidemill.operators.validate import validate
from tidemill.plans.pipeline import judge
from tidemill.profile import build_profile
from tidemill.session import table
from tidemill.sources.feed import from_cells, from_table
from tidemill.testfeed import dirty_price, ean, rotated

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _turn() -> Column:
    return F.col("l_orderkey") + F.col("l_linenumber")


# ------------------------------------------------------------------ scalars
@query(f"SELECT l_orderkey, l_linenumber, {_CENTS} AS cents, CASE (l_orderkey + l_linenumber) % 6 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE 'USD' END AS currency FROM lineitem")
def money_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = with_columns(li.select("l_orderkey", "l_linenumber", dirty_price(_cents(), _turn()).alias("cell")), {"m": (numbers.MONEY, {"c": F.col("cell")})})
    return p.select("l_orderkey", "l_linenumber", (F.col("m.amount") * 100).cast("bigint").alias("cents"), F.col("m.currency").alias("currency"))


@query("SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'several amounts' WHEN 1 THEN 'no amount' WHEN 2 THEN 'an amount beside' WHEN 3 THEN 'decimals or thousands' ELSE NULL END AS problem FROM lineitem")
def money_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    whole = F.floor(F.col("l_extendedprice")).cast("bigint").cast("string")
    cell = rotated([F.concat(F.lit("$"), whole, F.lit(" / $"), whole), F.lit("TBC"), F.concat(whole, F.lit(" per pair")), F.concat(whole, F.lit(".1234")), F.lit("n/a")], _turn())
    p = with_columns(li.select("l_orderkey", "l_linenumber", cell.alias("cell")), {"m": (numbers.MONEY, {"c": F.col("cell")})})
    kinds = F.regexp_extract("m.error", "(several amounts|no amount|an amount beside|decimals or thousands)", 1)
    return p.select("l_orderkey", "l_linenumber", F.nullif(kinds, F.lit("")).alias("problem"))


@query(f"SELECT l_orderkey, l_linenumber, {_CENTS} AS cents FROM lineitem")
def number_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cents = _cents()
    whole, rest = F.floor(cents / 100).cast("bigint"), F.lpad((cents % 100).cast("string"), 2, "0")
    us = F.concat(F.format_number(whole, 0), F.lit("."), rest)
    plain = F.concat(whole.cast("string"), F.lit(","), rest)
    cell = rotated([us, F.translate(us, ".,", ",."), plain], _turn())
    p = with_columns(li.select("l_orderkey", "l_linenumber", cell.alias("cell")), {"n": (numbers.NUMBER, {"c": F.col("cell")})})
    return p.select("l_orderkey", "l_linenumber", (F.col("n.value") * 100).cast("bigint").alias("cents"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 10 WHEN 1 THEN p_size * 10000
WHEN 2 THEN CAST(round_even(p_size * 453.59237, 1) * 10 AS BIGINT) ELSE CAST(round_even(p_size * 28.349523125, 1) * 10 AS BIGINT) END AS tenths FROM part""")
def weight_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = F.col("p_size").cast("string")
    cell = rotated([F.concat(n, F.lit(" g")), F.concat(n, F.lit("KG.")), n, F.concat(n, F.lit("  oz"))], F.col("p_partkey"))
    grams = units.parse_weight(cell, F.lit("lbs"))["value"]
    return p.select("p_partkey", (grams * 10).cast("bigint").alias("tenths"))


@query("""SELECT p_partkey, CAST(round_even(p_size * f, 1) * 10 AS BIGINT) AS length_tenths, CAST(round_even((p_size + 1) * f, 1) * 10 AS BIGINT) AS width_tenths,
CAST(round_even((p_size + 2) * f, 1) * 10 AS BIGINT) AS height_tenths FROM (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN 25.4 WHEN 1 THEN 1.0 WHEN 2 THEN 10.0 ELSE 304.8 END AS f FROM part)""")
def dimensions_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a, b, c = ((F.col("p_size") + k).cast("string") for k in range(3))
    cell = rotated([F.concat_ws(" x ", a, b, F.concat(c, F.lit(" in"))), F.concat(F.concat_ws("mm × ", a, b, c), F.lit("MM")), F.concat_ws("*", F.concat(a, F.lit("cm")), b, c), F.concat(F.concat_ws(" X ", a, b, c), F.lit("'"))], F.col("p_partkey"))
    mm = units.parse_dimensions(cell)["value"]
    return p.select("p_partkey", *[(F.get(mm, F.lit(i)) * 10).cast("bigint").alias(n) for i, n in enumerate(("length_tenths", "width_tenths", "height_tenths"))])


@query("SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 4 WHEN 3 THEN -1 ELSE CAST(l_quantity AS BIGINT) * 1000 END AS quantity, (l_orderkey + l_linenumber) % 4 = 3 AS refused FROM lineitem")
def quantity_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("bigint").cast("string")
    cell = rotated([F.concat(q, F.lit(",000")), F.concat(q, F.lit("000")), F.concat(F.lit(" "), q, F.lit(" 000 ")), F.concat(q, F.lit(" pcs"))], _turn())
    p = with_columns(li.select("l_orderkey", "l_linenumber", cell.alias("cell")), {"p": (numbers.QUANTITY, {"c": F.col("cell")})})
    return p.select("l_orderkey", "l_linenumber", F.coalesce("p.value", F.lit(-1)).alias("quantity"), F.col("p.error").isNotNull().alias("refused"))


_EAN_SQL = "(10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(lpad(CAST(200000000000 + p_partkey AS VARCHAR), 12, '0'), CAST(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10"


@query(f"SELECT p_partkey, CAST({_EAN_SQL} AS BIGINT) AS digit FROM part")
def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", codes.gtin_check_digit((F.lit(200000000000) + F.col("p_partkey")).cast("string")).cast("bigint").alias("digit"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 4 IN (0, 1) THEN CAST(200000000000 + p_partkey AS VARCHAR) || CAST({_EAN_SQL} AS BIGINT) END AS barcode,
CASE p_partkey % 4 WHEN 2 THEN 'its other digits' WHEN 3 THEN 'power of ten' END AS problem FROM part""")
def barcode_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    good = ean(F.lit(200000000000) + F.col("p_partkey"))
    wrong = F.concat(F.left(good, F.lit(12)), ((F.right(good, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    spaced = F.concat(F.left(good, F.lit(1)), F.lit("-"), F.substring(good, 2, 6), F.lit(" "), F.substring(good, 8, 6))
    b = codes.parse_barcode(rotated([good, spaced, wrong, F.lit("2.01E+12")], F.col("p_partkey")))
    r = p.select("p_partkey", b.alias("b"))
    return r.select("p_partkey", F.col("b.value").alias("barcode"), F.nullif(F.regexp_extract("b.error", "(its other digits|power of ten)", 1), F.lit("")).alias("problem"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://img.example/' || p_partkey || '.jpg' WHEN 1 THEN 'HTTP://img.example/' || p_partkey WHEN 2 THEN 'https://cdn.example/a/' || p_partkey || '.png' END AS url,
p_partkey % 4 = 3 AS refused FROM part""")
def url_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    cell = rotated([F.concat(F.lit("//img.example/"), k, F.lit(".jpg")), F.concat(F.lit(" HTTP://img.example/"), k), F.concat(F.lit("/a/"), k, F.lit(".png")), F.concat(F.lit("ftp://x/"), k)], F.col("p_partkey"))
    u = p.select("p_partkey", codes.parse_url(cell, "https://cdn.example/").alias("u"))
    return u.select("p_partkey", F.col("u.value").alias("url"), F.col("u.error").isNotNull().alias("refused"))


_SPACES = r"'[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{200b}\x{feff}]+'"
_TIDY_SQL = f"trim(regexp_replace(text, {_SPACES}, ' ', 'g'))"


@query(f"SELECT doc_id, {_TIDY_SQL} AS tidied FROM documents")
def tidy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.tidy(F.col("text")).alias("tidied"))


@query(f"SELECT doc_id, trim(regexp_replace(lower({_TIDY_SQL}), '[^a-z0-9]+', ' ', 'g')) AS folded FROM documents")
def fold_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


_PLAIN_SQL = "replace(replace(replace(replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '&ndash;', '–'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(f"SELECT row_id, trim(regexp_replace({_PLAIN_SQL}, {_SPACES}, ' ', 'g')) AS shown FROM feed_row")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feed_row").select("row_id", text.plain_text(F.col("description")).alias("shown"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS cased FROM part")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = rotated([F.upper("p_name"), F.lower("p_name")], F.col("p_partkey"))
    return p.select("p_partkey", casing.title_case(name).alias("cased"))


@query("""SELECT doc_id, CASE WHEN length(t) > 40 THEN left(t, 39) || '…' ELSE t END AS shown, CAST(length(text) AS BIGINT) AS n, length(text) > 500 AS too_long
FROM (SELECT doc_id, text, """ + _TIDY_SQL + " AS t FROM documents)")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = F.char_length("text").cast("bigint")
    return d.select("doc_id", text.clip(F.col("text"), 40).alias("shown"), n.alias("n"), (n > 500).alias("too_long"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) WHEN 1 THEN CAST(epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) AS BIGINT) ELSE -1 END AS seconds FROM events")
def iso_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamp = F.col("ts").cast("timestamp_ntz")
    cell = rotated([F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), F.date_format(stamp, "yyyy-MM-dd"), F.date_format(stamp, "dd/MM/yyyy")], F.col("event_id"))
    since = codes.iso_seconds(cell) - 719162 * 86400
    return e.select("event_id", F.coalesce(since, F.lit(-1)).alias("seconds"))


# ------------------------------------------------------------------- lookups
@query("""SELECT p_brand AS brand, CASE WHEN count(*) > 0 THEN 'Brand No ' || substr(p_brand, 7) END AS vendor, count(*) AS n FROM part GROUP BY p_brand""")
def vendor_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    spelt = rotated([F.col("p_brand"), F.upper("p_brand"), F.concat(F.lit("  "), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" - ")))], F.col("p_partkey"))
    vendors = {f"Brand No {n}": [f"brand {n}"] for n in range(1, 26)}
    prof = build_profile({"columns": {"sku": []}, "vendors": vendors})
    known = F.create_map(*[F.lit(x) for kv in prof.vendors.items() for x in kv])
    r = p.select(F.col("p_brand").alias("brand"), F.try_element_at(known, text.fold(spelt)).alias("vendor"))
    return r.groupBy("brand", "vendor").agg(F.count(F.lit(1)).alias("n"))


_LOOKUPS = {"stock_status": {"in_stock": ["r"], "out_of_stock": ["a"], "backorder": ["n"]}, "booleans": {"true": ["f", "yes"], "false": ["o"]}, "columns": {"sku": []}}


@query("""SELECT l_returnflag, l_linestatus, CASE l_returnflag WHEN 'R' THEN 'in_stock' WHEN 'A' THEN 'out_of_stock' ELSE 'backorder' END AS stock_status,
CASE l_linestatus WHEN 'F' THEN 'true' ELSE 'false' END AS published, count(*) AS n FROM lineitem GROUP BY ALL""")
def stock_and_bool_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = build_profile(_LOOKUPS)
    li = table(spark, sf_dir, "lineitem")
    get = lambda m, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), text.fold(c))
    return li.groupBy("l_returnflag", "l_linestatus", get(prof.stock_status, F.col("l_returnflag")).alias("stock_status"), get(prof.booleans, F.concat(F.lit(" "), F.col("l_linestatus"))).alias("published")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey AS line, CAST(n_nationkey AS VARCHAR) AS sku, n_name AS title, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def header_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = build_profile({"columns": {"sku": ["Nation Key"], "title": ["NAME", "Name 2"]}})
    n = table(spark, sf_dir, "nation")
    cells = n.select(F.col("n_nationkey").alias("line"), F.col("n_nationkey").cast("string").alias("c0"), F.lit("no").alias("c1"), F.concat(F.lit("  "), F.col("n_regionkey").cast("string")).alias("c2"), F.col("n_name").alias("c3"))
    rows = from_cells(cells, ["nation_key", "Name", "Region", "name-2"], prof).rows
    return rows.select(F.col("line").cast("int").alias("line"), F.col("raw.sku").alias("sku"), F.col("raw.title").alias("title"), F.try_element_at("extra", F.lit("Region")).alias("region"))


# --------------------------------------------------------------- duplicates
_ORDER_PROFILE = build_profile({"columns": {"sku": []}, "required": ["sku"]})
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of customers: title missing for every third, the date ambiguous for every fifth."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        k.alias("line"),
        F.concat(F.lit("C-"), F.col("o_custkey").cast("string")).alias("sku"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Order of "), F.col("o_orderpriority"))).alias("title"),
        F.col("o_orderstatus").alias("tags"),
        F.when(k % 5 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("updated_at"),
    )
    return deduplicate(normalize(from_table(rows, _ORDER_PROFILE).rows, _ORDER_PROFILE))


_LADDER_SQL = f"""WITH r AS (SELECT o_orderkey AS line, 'C-' || o_custkey AS sku, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Order of ' || o_orderpriority END AS title, o_orderstatus AS tags,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders),
g AS (SELECT *, count(*) OVER w AS n, min(title || '|' || tags) OVER w = max(title || '|' || tags) OVER w AS same, min(line) OVER w AS first_line,
max(coalesce(day, DATE '0001-01-01')) OVER w AS top_day FROM r WINDOW w AS (PARTITION BY sku)),
a AS (SELECT *, sum(CASE WHEN coalesce(day, DATE '0001-01-01') = top_day THEN 1 ELSE 0 END) OVER (PARTITION BY sku) AS n_day,
max(CASE WHEN coalesce(day, DATE '0001-01-01') = top_day THEN (title <> '')::INT END) OVER (PARTITION BY sku) AS top_core FROM g),
b AS (SELECT *, coalesce(day, DATE '0001-01-01') = top_day AND (title <> '')::INT = top_core AS lead FROM a),
c AS (SELECT *, sum(lead::INT) OVER (PARTITION BY sku) AS n_core FROM b)"""


@query(_LADDER_SQL + """ SELECT line, CASE WHEN n = 1 THEN 'single' WHEN same THEN CASE WHEN line = first_line THEN 'kept' ELSE 'dropped' END
WHEN n_day = 1 THEN CASE WHEN coalesce(day, DATE '0001-01-01') = top_day THEN 'kept' ELSE 'dropped' END WHEN n_core = 1 THEN CASE WHEN lead THEN 'kept' ELSE 'dropped' END ELSE 'tied' END AS role FROM c""")
def dedupe_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("line", "role")


@query(_LADDER_SQL + """ SELECT CASE WHEN same THEN 'identical' WHEN n_day = 1 THEN 'newest updated_at' WHEN n_core = 1 THEN 'more complete' ELSE 'unresolved tie' END AS reason,
count(DISTINCT sku) AS n FROM c WHERE n > 1 GROUP BY 1""")
def dedupe_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasons(_orders(spark, sf_dir))


@query(_LADDER_SQL + """, w AS (SELECT *, CASE WHEN same THEN line = first_line WHEN n_day = 1 THEN coalesce(day, DATE '0001-01-01') = top_day ELSE n_core = 1 AND lead END AS won FROM c WHERE n > 1),
f AS (SELECT sku, arg_min(title, line) AS filler, min(line) AS filler_line FROM r WHERE title <> '' GROUP BY sku)
SELECT w.line, f.filler AS title, f.filler_line FROM w JOIN f USING (sku) WHERE won AND w.title = ''""")
def dedupe_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _orders(spark, sf_dir).select("line", F.inline("changes")).where(F.col("rule") == "dedupe.backfill")
    return changes.select("line", F.col("after").alias("title"), F.regexp_extract("note", r"line (\d+)$", 1).cast("bigint").alias("filler_line"))


# ------------------------------------------------------------- the whole run
_FEED_PROFILE = build_profile(
    {
        "columns": {f: [f] for f in ("sku", "title", "vendor", "price", "quantity", "barcode", "image_url", "description", "stock_status")},
        "vendors": {"Maker One": ["manufacturer#1"], "Maker Two": ["manufacturer#2"]},
        "stock_status": {"in_stock": ["here"], "out_of_stock": ["gone"]},
        "required": ["sku", "title", "price"],
        "limits": {"description_max": 40, "title_max": 30},
    }
)
_FEED_TRUTH = """WITH t AS (SELECT p_partkey + 1 AS line, p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'P-' || p_partkey END AS sku, p_name AS title,
p_partkey % 4 AS maker, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, CASE WHEN p_partkey % 13 = 0 THEN 'missing' WHEN p_partkey % 11 = 0 THEN 'bad' ELSE 'good' END AS price,
p_partkey % 9 = 0 AS bad_code, p_partkey % 7 = 0 AS bad_image, p_partkey % 5 = 0 AS odd_stock, p_partkey % 19 = 0 AS long_text FROM part),
j AS (SELECT *, sku = '' OR price <> 'good' OR bad_code OR bad_image OR long_text AS rejected, odd_stock OR length(title) > 30 AS review FROM t)"""


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a feed in which known parts of the rows go wrong in known ways."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return p.select(
        (k + 1).alias("line"),
        F.when(k % 17 == 0, F.lit(" ")).otherwise(F.concat(F.lit("P-"), k.cast("string"))).alias("sku"),
        F.concat(F.lit(" "), F.col("p_name"), F.lit("  ")).alias("title"),
        rotated([F.lit("MANUFACTURER 1"), F.lit("manufacturer#2"), F.lit(""), F.lit("Nobody")], k).alias("vendor"),
        F.when(k % 13 == 0, F.lit("n/a")).when(k % 11 == 0, F.lit("ask us")).otherwise(dirty_price(cents, k)).alias("price"),
        F.when(k % 9 == 0, F.lit("123")).otherwise(F.lit("")).alias("barcode"),
        F.when(k % 7 == 0, F.lit("img/a.jpg")).otherwise(F.lit("//img.example/a.jpg")).alias("image_url"),
        F.when(k % 5 == 0, F.lit("maybe")).otherwise(F.lit("Here ")).alias("stock_status"),
        F.when(k % 19 == 0, F.repeat(F.lit("<b>ab</b> "), 20)).otherwise(F.lit("<p>fine</p>")).alias("description"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(from_table(_parts(spark, sf_dir), _FEED_PROFILE), _FEED_PROFILE)


@query(_FEED_TRUTH + """ SELECT sku, array_to_string(list_transform(string_split(title, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title, CASE maker WHEN 0 THEN 'Maker One' WHEN 1 THEN 'Maker Two' WHEN 2 THEN '' ELSE 'Nobody' END AS vendor,
CASE WHEN cents % 100 < 10 THEN (cents // 100) || '.0' || (cents % 100) ELSE (cents // 100) || '.' || (cents % 100) END AS price, CASE WHEN odd_stock THEN '' ELSE 'in_stock' END AS stock_status,
CASE WHEN review THEN 'yes' ELSE 'no' END AS needs_review FROM j WHERE NOT rejected""")
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_table(_judged(spark, sf_dir)).select("sku", "title", "vendor", "price", "stock_status", "needs_review")


@query(_FEED_TRUTH + """ SELECT line, sku, array_to_string(list_sort(list_filter([CASE WHEN sku = '' THEN 'missing_sku' END, CASE price WHEN 'missing' THEN 'missing_price' WHEN 'bad' THEN 'price.format' END,
CASE WHEN bad_code THEN 'barcode_invalid' END, CASE WHEN bad_image THEN 'image_unusable' END, CASE WHEN long_text THEN 'description_too_long' END], lambda x: x IS NOT NULL)), ' ') AS reject_rules FROM j WHERE rejected""")
def reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects_table(_judged(spark, sf_dir)).select("line", "sku", "reject_rules")


_CHANGE_COUNTS = """SELECT 'title.case' AS rule, 'changed' AS outcome, count(*) AS n FROM j UNION ALL SELECT 'sku.whitespace', 'changed', count(*) FROM j WHERE sku = ''
UNION ALL SELECT 'vendor.canonical', 'changed', count(*) FROM j WHERE maker IN (0, 1) UNION ALL SELECT 'price.format', 'unresolved', count(*) FROM j WHERE price = 'bad'
UNION ALL SELECT 'price.format', 'changed', count(*) FROM j WHERE price = 'good' AND k % 6 <> 1 UNION ALL SELECT 'barcode.check', 'unresolved', count(*) FROM j WHERE bad_code
UNION ALL SELECT 'image_url.scheme', 'unresolved', count(*) FROM j WHERE bad_image UNION ALL SELECT 'image_url.scheme', 'changed', count(*) FROM j WHERE NOT bad_image
UNION ALL SELECT 'stock_status.vocabulary', 'unresolved', count(*) FROM j WHERE odd_stock UNION ALL SELECT 'stock_status.vocabulary', 'changed', count(*) FROM j WHERE NOT odd_stock
UNION ALL SELECT 'description.html', 'changed', count(*) FROM j"""


@query(f"{_FEED_TRUTH} SELECT * FROM ({_CHANGE_COUNTS}) WHERE n > 0")
def change_log_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_table(_judged(spark, sf_dir)).groupBy("rule", "outcome").agg(F.count(F.lit(1)).alias("n"))


_HISTOGRAM = f"""SELECT CASE outcome WHEN 'changed' THEN 'normalized' ELSE 'unresolved' END AS kind, rule, n FROM ({_CHANGE_COUNTS})
UNION ALL SELECT 'reject', 'missing_sku', count(*) FROM j WHERE sku = '' UNION ALL SELECT 'reject', 'missing_price', count(*) FROM j WHERE price = 'missing'
UNION ALL SELECT 'reject', 'price.format', count(*) FROM j WHERE price = 'bad' UNION ALL SELECT 'reject', 'barcode_invalid', count(*) FROM j WHERE bad_code
UNION ALL SELECT 'reject', 'image_unusable', count(*) FROM j WHERE bad_image UNION ALL SELECT 'reject', 'description_too_long', count(*) FROM j WHERE long_text
UNION ALL SELECT 'flag', 'stock_status.vocabulary', count(*) FROM j WHERE odd_stock AND NOT rejected UNION ALL SELECT 'flag', 'title_too_long', count(*) FROM j WHERE length(title) > 30 AND NOT rejected"""


@query(f"{_FEED_TRUTH} SELECT * FROM ({_HISTOGRAM}) WHERE n > 0")
def rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_counts(_judged(spark, sf_dir)).select("kind", "rule", "n")


@query(f"{_FEED_TRUTH} SELECT rule, n FROM ({_HISTOGRAM}) WHERE kind = 'reject' AND n > 0 ORDER BY n DESC, rule LIMIT 2")
def top_reject_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_rules(rule_counts(_judged(spark, sf_dir)), "reject", 2)


@query(_FEED_TRUTH + """ SELECT count(*) AS rows_in, count(*) FILTER (NOT rejected) AS clean, count(*) FILTER (rejected) AS rejected, count(*) FILTER (NOT rejected AND review) AS flagged,
0::BIGINT AS dropped, 0::BIGINT AS tied, 0::BIGINT AS groups, 0::BIGINT AS rows_involved, 0::BIGINT AS backfills, count(*) AS rows_changed FROM j""")
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(_judged(spark, sf_dir)).withColumn("backfills", F.col("backfills").cast("bigint"))


@query(_FEED_TRUTH + " SELECT DISTINCT 'Nobody' AS vendor FROM j WHERE maker = 3 AND NOT rejected")
def vendors_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmapped_vendors(_judged(spark, sf_dir))


@query("SELECT count(*) AS rows_in, count(*) AS rows_out FROM orders")
def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, rejected and dropped rows are all rows."""
    judged = validate(_orders(spark, sf_dir), _ORDER_PROFILE)
    return totals(judged).select("rows_in", (F.col("clean") + F.col("rejected") + F.col("dropped")).alias("rows_out"))


@query()
def feed_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run over feed_row, each file's rows deduplicated on their own."""
    # a sku without a key stays as it is: with the file in it, it would have one
    own = F.concat_ws(" in file ", "sku", F.col("feed_id").cast("string"))
    rows = table(spark, sf_dir, "feed_row").withColumn("sku", F.when(text.fold(F.col("sku")) != "", own).otherwise(F.col("sku")))
    numbered = rows.withColumn("line", F.col("row_id"))
    prof = build_profile({"columns": {c: [c] for c in CLEAN if c in rows.columns} | {"sku": ["sku"]}, "stock_status": {"in_stock": ["in stock", "available", "yes"], "out_of_stock": ["sold out", "oos"]}, "booleans": {"true": ["yes", "y", "1", "t"], "false": ["no", "n", "0", "f"]}})
    judged = judge(from_table(numbered, prof), prof)
    return judged.select("line", "sku", "role", "reason", "backfills", "rejected", "needs_review", F.size("changes").alias("n_changes"), F.size("issues").alias("n_issues"))


# ------------------------------------------- fields and rungs that the runs above do not reach
_FIELDS_PROFILE = build_profile({"columns": {"sku": []}, "booleans": {"true": ["yes", "on"], "false": ["no"]}, "required": ["sku"]})
_ODD = "p_partkey % 5 = 0"


@query(f"""SELECT p_partkey AS line, CASE WHEN {_ODD} THEN NULL ELSE p_size || '000' END AS weight_g, CASE WHEN {_ODD} THEN NULL ELSE p_size || '0 x ' || (p_size + 1) || '0 x ' || (p_size + 2) || '0' END AS edges,
CASE WHEN {_ODD} THEN NULL ELSE p_size || '000' END AS quantity, CASE WHEN {_ODD} THEN NULL WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS published, CASE WHEN p_partkey % 2 = 0 THEN 'true' END AS taxable,
CASE WHEN {_ODD} THEN NULL ELSE p_size || '.50' END AS cost, CASE WHEN {_ODD} THEN 'cost.format dimensions.unit published.vocabulary quantity.format weight.unit' ELSE 'cost.currency_mismatch' END AS rules,
CASE WHEN {_ODD} THEN 'heavy' ELSE p_size || ' KG' END AS weight_before, CASE WHEN {_ODD} THEN '' ELSE p_size || '000' END AS weight_after FROM part""")
def fields_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, dimensions, counts, flags and costs through the whole normaliser, and what it says of those it refuses."""
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    odd = lambda bad, good: F.when(k % 5 == 0, F.lit(bad)).otherwise(good)
    later = lambda i: (F.col("p_size") + i).cast("string")
    rows = p.select(
        k.alias("line"), F.concat(F.lit("P"), k.cast("string")).alias("sku"), odd("heavy", F.concat(n, F.lit(" KG"))).alias("weight"), odd("big", F.concat_ws(" x ", n, later(1), F.concat(later(2), F.lit("cm")))).alias("dimensions"),
        odd("lots", F.concat(n, F.lit(",000"))).alias("quantity"), odd("perhaps", F.when(k % 2 == 0, F.lit(" Yes")).otherwise(F.lit("NO"))).alias("published"), F.when(k % 2 == 0, F.lit("on")).otherwise(F.lit("")).alias("taxable"),
        odd("ask", F.concat(F.lit("EUR "), n, F.lit(",50"))).alias("cost"),
    )
    done = normalize(from_table(rows, _FIELDS_PROFILE).rows, _FIELDS_PROFILE)
    edges = F.nullif(F.concat_ws(" x ", "v.length_mm", "v.width_mm", "v.height_mm"), F.lit(""))
    weighed = F.get(F.filter("changes", lambda c: c["rule"] == "weight.unit"), F.lit(0))
    return done.select(
        F.col("line").cast("bigint").alias("line"), "v.weight_g", edges.alias("edges"), "v.quantity", "v.published", "v.taxable", "v.cost",
        F.array_join(F.array_sort(F.transform("issues", lambda x: x["rule"])), " ").alias("rules"), weighed["before"].alias("weight_before"), weighed["after"].alias("weight_after"),
    )


@query("""SELECT p_partkey, 'USB-C Plug-in' || CASE WHEN p_partkey % 2 = 0 THEN ' Lamp of ' || p_size || 'mm (LED)' ELSE ' Ip' || p_size || '/B4' END AS cased FROM part""".replace("' Ip' ||", "' IP' ||"))
def title_compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acronyms, minor words, measurements and compounds in titles."""
    n = F.col("p_size").cast("string")
    tail = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" LAMP OF "), n, F.lit("MM (LED)"))).otherwise(F.concat(F.lit(" IP"), n, F.lit("/B4")))
    cased = casing.title_case(F.concat(F.lit("USB-C PLUG-IN"), tail), {"usb-c": "USB-C", "led": "LED"}, ["of", "in"])
    return table(spark, sf_dir, "part").select("p_partkey", cased.alias("cased"))


@query(_LADDER_SQL + """, j AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN same THEN CASE WHEN line = first_line THEN 'kept' ELSE 'dropped' END WHEN n_day = 1 THEN CASE WHEN coalesce(day, DATE '0001-01-01') = top_day THEN 'kept' ELSE 'dropped' END
WHEN n_core = 1 THEN CASE WHEN lead THEN 'kept' ELSE 'dropped' END ELSE 'tied' END AS role, bool_or(title <> '') OVER (PARTITION BY sku) AS filler FROM c)
SELECT count(*) AS rows_in, count(*) FILTER (role = 'dropped') AS dropped, count(*) FILTER (role = 'tied') AS tied, count(DISTINCT sku) FILTER (n > 1) AS groups, count(*) FILTER (n > 1) AS rows_involved,
count(*) FILTER (role = 'kept' AND title = '' AND filler) AS backfills, count(*) FILTER (role = 'tied') AS rejected FROM j""")
def summary_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of a run in which most skus are sent more than once."""
    t = totals(validate(_orders(spark, sf_dir), _ORDER_PROFILE))
    return t.select("rows_in", "dropped", "tied", "groups", "rows_involved", F.col("backfills").cast("bigint").alias("backfills"), "rejected")


@query("""WITH r AS (SELECT c_custkey AS line, 'N' || c_nationkey || ' ' || c_mktsegment AS sku, (c_acctbal < 0)::INT + (c_custkey % 3 = 0)::INT AS filled FROM customer),
g AS (SELECT *, count(*) OVER w AS n, max(filled) OVER w AS top FROM r WINDOW w AS (PARTITION BY sku)), h AS (SELECT *, sum((filled = top)::INT) OVER (PARTITION BY sku) AS level FROM g)
SELECT line, CASE WHEN n = 1 THEN 'single' WHEN level > 1 THEN 'tied' WHEN filled = top THEN 'kept' ELSE 'dropped' END AS role, CASE WHEN n > 1 THEN CASE WHEN level > 1 THEN 'unresolved tie' ELSE 'more columns populated' END END AS reason,
CASE WHEN n > 1 AND level > 1 THEN 'title' END AS differs FROM h""")
def dedupe_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that only the count of all filled cells can decide, and what a tie is said to differ in."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(
        F.col("c_custkey").alias("line"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit(" "), F.col("c_mktsegment")).alias("sku"), F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("title"),
        F.when(F.col("c_acctbal") < 0, F.lit("x")).otherwise(F.lit("")).alias("tags"), F.when(F.col("c_custkey") % 3 == 0, F.lit("y")).otherwise(F.lit("")).alias("product_type"),
    )
    done = deduplicate(normalize(from_table(rows, _ORDER_PROFILE).rows, _ORDER_PROFILE))
    message = F.get(F.filter("issues", lambda x: x["rule"] == "duplicate_unresolved"), F.lit(0))["message"]
    return done.select("line", "role", "reason", F.nullif(F.regexp_extract(message, "^(title) Customer [0-9]+ vs Customer [0-9]+", 1), F.lit("")).alias("differs"))


# -------------------------------------------------------------------- views
@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS was FROM events) WHERE was IS NULL OR event_type <> was")
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.collapse_repeats(table(spark, sf_dir, "events"), "event_id", ["event_type"]).select("event_id", "event_type")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0")
def rows_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a value and by a condition of a column."""
    some = view.rows_where(table(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING")
    return view.rows_where(some, "c_acctbal", lambda c: c < 0).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 13")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named columns of the first rows."""
    return view.view(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], "o_orderkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN false ELSE true END AS numeric, c_custkey % 4 <> 0 AS same FROM customer""")
def numbers_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells a table sets to the right, and a decimal in fixed notation."""
    k = F.col("c_custkey")
    cell = rotated([F.concat(F.lit("$"), k.cast("string")), F.concat(F.lit("-"), k.cast("string"), F.lit(".5")), F.concat(k.cast("string"), F.lit(",000")), F.concat(F.lit("+"), k.cast("string"))], k)
    plain = numbers.plain_decimal((k.cast("decimal(20,6)") / 4).cast("decimal(20,6)"))
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.looks_numeric(cell).alias("numeric"), F.contains(plain, F.lit(".")).alias("same"))


@query("""SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 'warn' END AS tint FROM (SELECT * FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5)
OR c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 50)""")
def rows_where_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    picked = view.head_and(c, "c_custkey", 5, F.col("c_mktsegment") == "BUILDING", 50)
    return view.tinted(picked, {"warn": F.col("c_acctbal") < 0}).select("c_custkey", "c_name", "tint")


@query("SELECT a.vec_id, round(list_avg(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))), 6) AS mad FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("__id"), F.col("embedding").alias("__other"))
    return e.join(nxt, F.col("vec_id") == F.col("__id")).select("vec_id", F.round(view.mean_abs_difference(F.col("embedding"), F.col("__other")), 6).alias("mad"))
