"""Queries of the general training-data problems, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import column_profile, schema_drift, strict_load, unit_graph
from tidemill.profile import FIELDS
from tidemill.session import table

# ------------------------------------------------------------------ 1: units
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_graph.converted(table(spark, sf_dir, "feed_row")).where(~F.col("was_common")).select("row_id", "measure", "tenths")


def p1_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_graph.converted(table(spark, sf_dir, "feed_row")).select("row_id", "measure", "tenths", "was_common")


def p1_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_graph.unusable(table(spark, sf_dir, "feed_row"))


# ------------------------------------------------------- 3: records that fail
def _raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = table(spark, sf_dir, "feed_file").where(F.col("kind") == "raw").select("feed_id", "header")
    return table(spark, sf_dir, "raw_record"), files, table(spark, sf_dir, "header_alias")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.reject(*_raw(spark, sf_dir)).select("record_id", "rule")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load.load(*_raw(spark, sf_dir)).select("record_id", "feed_id", "line", F.size("cells").alias("n_cells"))


# -------------------------------------------------------------- 4: profiles
LOG_COLUMNS = ("rule", "outcome", "field")
LOG_FORMS = {"rule": r"[a-z_]+\.[a-z_]+", "outcome": "changed|unresolved|dropped", "field": "|".join(FIELDS)}


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "change_log"), column_profile.load_pairs(table(spark, sf_dir, "feed_file"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, pairs = _log(spark, sf_dir)
    curves = column_profile.curves(column_profile.value_counts(log, LOG_COLUMNS, "feed_id"), pairs)
    return column_profile.findings(curves, LOG_FORMS).select(F.col("load").alias("feed_id"), "field_name", "finding")


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, _ = _log(spark, sf_dir)
    p = column_profile.profile(log, LOG_COLUMNS, "feed_id", LOG_FORMS)
    return p.select(
        F.col("load").alias("feed_id"), "field_name", "rows", "blanks", "distinct_values", "min_value", "max_value", "bad_form",
        *[F.get("quantiles", F.lit(i)).alias(f"quartile_{i + 1}") for i in range(3)],
    )


def p4_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, pairs = _log(spark, sf_dir)
    d = column_profile.distances(column_profile.curves(column_profile.value_counts(log, LOG_COLUMNS, "feed_id"), pairs))
    return d.select(F.col("load").alias("feed_id"), "field_name", F.round("ks", 6).alias("ks"), F.round("shift", 6).alias("shift"))


# ---------------------------------------------------------- 5: schema drift
def _originals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = table(spark, sf_dir, "feed_file").where(F.col("kind") == "original").select("feed_id", "series_id", "received_at")
    return table(spark, sf_dir, "feed_original"), files, table(spark, sf_dir, "header_alias")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.drift(*_originals(spark, sf_dir)).where(F.col("drift").isNotNull()).select("feed_id", "header", "drift")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, files, aliases = _originals(spark, sf_dir)
    return schema_drift.unified(rows, schema_drift.drift(rows, files, aliases), FIELDS).withColumns(
        {"extra": F.to_json("extra"), "odd": F.to_json("odd")}
    )



QUERIES = {f.__name__: f for f in (p1_found, p1_converted, p1_unusable, p3_found, p3_loaded, p4_found, p4_profile, p4_distances, p5_found, p5_unified)}

_LISTED = ", ".join(f"'{f}'" for f in FIELDS)
_COUNTS = """WITH u AS (SELECT feed_id, 'rule' AS field_name, rule AS value FROM change_log UNION ALL SELECT feed_id, 'outcome', outcome FROM change_log UNION ALL SELECT feed_id, 'field', field FROM change_log),
v AS (SELECT feed_id, field_name, CASE WHEN trim(value) = '' THEN NULL ELSE value END AS value FROM u),
c AS (SELECT feed_id, field_name, value, count(*) AS n FROM v GROUP BY ALL),
t AS (SELECT feed_id, field_name, sum(n) AS n_rows, coalesce(sum(n) FILTER (value IS NULL), 0) AS blanks FROM c GROUP BY ALL),
p AS (SELECT feed_id, lag(feed_id) OVER (PARTITION BY series_id ORDER BY received_at, feed_id) AS before FROM feed_file),
s AS (SELECT c.feed_id, c.field_name, value, n / (n_rows - blanks) AS share FROM c JOIN t ON c.feed_id = t.feed_id AND c.field_name = t.field_name WHERE value IS NOT NULL),
d AS (SELECT feed_id, field_name, value, sum(part) AS step, max(part > 0) AS new, max(part < 0) AS old FROM
(SELECT feed_id, field_name, value, share AS part FROM s UNION ALL SELECT p.feed_id, field_name, value, -share FROM s JOIN p ON s.feed_id = p.before) GROUP BY ALL),
k AS (SELECT feed_id, field_name FROM d GROUP BY ALL HAVING max(new) AND max(old)),
e AS (SELECT feed_id, field_name, max(abs(upto)) AS ks, sum(abs(step)) / 2 AS shift FROM (SELECT *, sum(step) OVER (PARTITION BY feed_id, field_name ORDER BY value) AS upto FROM d SEMI JOIN k USING (feed_id, field_name)) GROUP BY ALL)"""
_QUARTILES = ", ".join(f"list_sort(list(value) FILTER (value IS NOT NULL))[CAST(greatest(ceil(count(value) * {q}), 1) AS BIGINT)] AS quartile_{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75)))
_BROKEN = f"""NOT CASE field_name WHEN 'rule' THEN regexp_full_match(value, '[a-z_]+[.][a-z_]+') WHEN 'outcome' THEN value IN ('changed', 'unresolved', 'dropped') ELSE value IN ({_LISTED}) END"""
# the CSV grammar has no look-around, so RE2 can state it; a money cell is what is left once its currency is taken out
_CELL = """("([^"]|"")*"|[^",]*)"""
_FOLDED = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_DIGIT = "(10 - list_sum(list_transform(range(1, length(b)), lambda i: CAST(substr(b, CAST(length(b) - i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10"
_P3 = f"""WITH h AS (SELECT feed_id, list_transform(regexp_extract_all(',' || header, ',{_CELL}', 1), lambda c: {_FOLDED.format('c')}) AS heads FROM feed_file WHERE kind = 'raw'),
a AS (SELECT list({_FOLDED.format('header')}) FILTER (field = 'price') AS prices, list({_FOLDED.format('header')}) FILTER (field = 'barcode') AS barcodes FROM header_alias),
w AS (SELECT feed_id, len(heads) AS width, list_max(list_filter(range(1, len(heads) + 1), lambda i: list_contains(prices, heads[i]))) AS at_price,
list_max(list_filter(range(1, len(heads) + 1), lambda i: list_contains(barcodes, heads[i]))) AS at_code FROM h, a),
r AS (SELECT record_id, w.*, regexp_full_match(raw_text, '{_CELL}(,{_CELL})*') AS sound,
list_transform(regexp_extract_all(',' || raw_text, ',{_CELL}', 1), lambda c: CASE WHEN starts_with(c, '"') THEN replace(substr(c, 2, length(c) - 2), '""', '"') ELSE c END) AS cells FROM raw_record JOIN w USING (feed_id)),
g AS (SELECT record_id, trim(cells[at_price]) AS price, trim(cells[at_code]) AS code FROM r WHERE sound AND len(cells) = width),
m AS (SELECT record_id, price, code, regexp_replace(upper(price), '(^|[^A-Z])(USD|EUR|GBP|JPY|CAD|AUD|NZD|CHF|SEK)($|[^A-Z])', '\\1 \\3') AS u, replace(replace(code, '-', ''), ' ', '') AS b FROM g),
s AS (SELECT *, trim(CASE WHEN contains(u, 'US$') THEN replace(u, 'US$', ' ') WHEN contains(u, 'C$') THEN replace(u, 'C$', ' ') WHEN contains(u, 'A$') THEN replace(u, 'A$', ' ')
WHEN contains(u, '$') THEN replace(u, '$', ' ') WHEN contains(u, '£') THEN replace(u, '£', ' ') WHEN contains(u, '€') THEN replace(u, '€', ' ') ELSE replace(u, '¥', ' ') END) AS x FROM m),
n AS (SELECT *, regexp_replace(ltrim(CASE WHEN starts_with(x, '-') THEN substr(x, 2) ELSE x END), '([0-9]) ([0-9][0-9][0-9])($|[^0-9])', '\\1\\2\\3', 'g') AS d, starts_with(x, '-') AS minus FROM s),
q AS (SELECT *, regexp_full_match(d, '[0-9]+|[0-9]+[.,][0-9][0-9]?[0-9]?|[0-9]+([.][0-9]+)([.][0-9]+)+|[0-9]+(,[0-9]+)(,[0-9]+)+|[0-9]+(,[0-9]+)+[.][0-9]+|[0-9]+([.][0-9]+)+,[0-9]+') AS readable FROM n)
SELECT record_id, 'broken_quoting' AS rule FROM r WHERE NOT sound UNION ALL SELECT record_id, 'column_count' FROM r WHERE sound AND len(cells) <> width
UNION ALL SELECT record_id, CASE WHEN price IN ('', '-', '--', 'n/a', 'N/A') THEN 'missing_price' WHEN NOT readable THEN 'price.format' ELSE 'price_not_positive' END FROM q
WHERE price IN ('', '-', '--', 'n/a', 'N/A') OR NOT readable OR minus OR regexp_full_match(d, '[0.,]+')
UNION ALL SELECT record_id, 'barcode_invalid' FROM q WHERE code NOT IN ('', '-', '--', 'n/a', 'N/A', '0')
AND NOT (regexp_full_match(b, '[0-9]+') AND length(b) IN (8, 12, 13, 14) AND CASE WHEN regexp_full_match(b, '[0-9]+') THEN {_DIGIT} = CAST(right(b, 1) AS INTEGER) ELSE false END)"""
_TIDIED = "trim(regexp_replace({}, '[\\s\\x{{a0}}\\x{{200b}}\\x{{feff}}]+', ' ', 'g'))"
_KEY = f"coalesce(nullif({_FOLDED.format('h')}, ''), h)"
# no series here has two rivals for one header, so no score has to decide
_P5 = f"""WITH f AS (SELECT feed_id, lag(feed_id) OVER (PARTITION BY series_id ORDER BY received_at, feed_id) AS before FROM feed_file WHERE kind = 'original' AND feed_id IN (SELECT feed_id FROM feed_original)),
al AS (SELECT {_FOLDED.format('header')} AS key, min(field) AS field FROM header_alias GROUP BY 1),
c0 AS (SELECT feed_id, line, extra, unnest(map_keys(original)) AS h, unnest(map_values(original)) AS v FROM feed_original),
c AS (SELECT feed_id, line, h, {_KEY} AS key, {_TIDIED.format('v')} AS v, len(map_extract(extra, h)) > 0 AS in_extra FROM c0),
t AS (SELECT c.*, al.field, CASE WHEN coalesce(v, '') = '' OR NOT in_extra THEN NULL WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'whole' WHEN regexp_full_match(v, '[+-]?[0-9]*[.,][0-9]+') THEN 'decimal'
WHEN lower(v) IN ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f', 'on', 'off') THEN 'truth' WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9:.]+(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?') THEN 'date' ELSE 'text' END AS kind FROM c LEFT JOIN al USING (key)),
n0 AS (SELECT feed_id, key, kind, count(*) AS n FROM t WHERE kind IS NOT NULL GROUP BY feed_id, key, kind), n AS (SELECT *, sum(n) OVER (PARTITION BY feed_id, key) AS filled FROM n0),
y AS (SELECT feed_id, key, max(kind) FILTER (n >= 0.9 * filled) AS type FROM n GROUP BY feed_id, key),
e AS (SELECT feed_id, key, min(h) AS header, bool_or(in_extra) AS in_extra, min(field) AS field FROM t GROUP BY feed_id, key),
g AS (SELECT f.feed_id, f.before, e.* EXCLUDE (feed_id) FROM f JOIN e ON e.feed_id = f.before WHERE NOT EXISTS (FROM e x WHERE x.feed_id = f.feed_id AND x.key = e.key)),
w AS (SELECT f.feed_id, f.before, e.* EXCLUDE (feed_id) FROM f JOIN e ON e.feed_id = f.feed_id WHERE f.before IS NOT NULL AND NOT EXISTS (FROM e x WHERE x.feed_id = f.before AND x.key = e.key)),
s AS (SELECT feed_id, sku, min(line) AS line FROM (SELECT feed_id, line, max({_FOLDED.format('v')}) AS sku FROM t WHERE field = 'sku' AND v <> '' GROUP BY feed_id, line) WHERE sku <> '' GROUP BY feed_id, sku),
a AS (SELECT t.feed_id, s.sku, t.key, t.v FROM t JOIN s USING (feed_id, line) WHERE t.v <> ''),
p AS (SELECT w.feed_id, g.key AS old_key, w.key AS new_key, avg((x.v = z.v)::INT) AS share FROM w JOIN g ON g.feed_id = w.feed_id AND (g.field IS NULL OR w.field IS NULL)
JOIN a x ON x.feed_id = g.before AND x.key = g.key JOIN a z ON z.feed_id = w.feed_id AND z.key = w.key AND z.sku = x.sku GROUP BY w.feed_id, g.key, w.key),
m AS (SELECT feed_id, old_key, new_key FROM p WHERE share >= 0.8 - 1e-9 UNION SELECT w.feed_id, g.key, w.key FROM w JOIN g ON g.feed_id = w.feed_id AND g.field = w.field)
SELECT feed_id, header, CASE WHEN EXISTS (FROM m WHERE m.feed_id = w.feed_id AND m.new_key = w.key) THEN 'renamed' ELSE 'added' END AS drift FROM w
UNION ALL SELECT feed_id, header, 'removed' FROM g WHERE NOT EXISTS (FROM m WHERE m.feed_id = g.feed_id AND m.old_key = g.key)
UNION ALL SELECT f.feed_id, e.header, 'retyped' FROM f JOIN e ON e.feed_id = f.feed_id JOIN y ON y.feed_id = f.feed_id AND y.key = e.key JOIN y b ON b.feed_id = f.before AND b.key = e.key WHERE e.in_extra AND y.type <> b.type"""
SQL: dict[str, str] = {
    "p3_found": _P3,
    "p3_loaded": f"""WITH bad AS ({_P3}), h AS (SELECT feed_id, CAST(len(regexp_extract_all(',' || header, ',{_CELL}', 1)) AS INTEGER) AS n_cells FROM feed_file WHERE kind = 'raw')
SELECT record_id, feed_id, line, n_cells FROM raw_record JOIN h USING (feed_id) WHERE record_id NOT IN (SELECT record_id FROM bad)""",
    "p5_found": _P5,
    "p4_profile": f"""{_COUNTS} SELECT feed_id, field_name, count(*) AS rows, count(*) - count(value) AS blanks, count(DISTINCT value) AS distinct_values, min(value) AS min_value, max(value) AS max_value,
count(*) FILTER (value IS NOT NULL AND {_BROKEN}) AS bad_form, {_QUARTILES} FROM v GROUP BY feed_id, field_name""",
    "p4_distances": f"{_COUNTS} SELECT feed_id, field_name, round(ks, 6) AS ks, round(shift, 6) AS shift FROM e WHERE feed_id IN (SELECT feed_id FROM p WHERE before IS NOT NULL)",
    "p4_found": f"""{_COUNTS} SELECT DISTINCT feed_id, field_name, 'bad_form' AS finding FROM c WHERE value IS NOT NULL AND NOT CASE field_name WHEN 'rule' THEN regexp_full_match(value, '[a-z_]+[.][a-z_]+')
WHEN 'outcome' THEN value IN ('changed', 'unresolved', 'dropped') ELSE value IN ({_LISTED}) END
UNION ALL SELECT t.feed_id, t.field_name, 'blank_rise' FROM t JOIN p ON t.feed_id = p.feed_id JOIN t b ON b.feed_id = p.before AND b.field_name = t.field_name WHERE t.blanks / t.n_rows - b.blanks / b.n_rows >= 0.1 - 1e-9
UNION ALL SELECT feed_id, field_name, 'value_shift' FROM e WHERE shift >= 0.25 - 1e-9""",
}
