"""Queries of the language-model data problems, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import language, mixing, packing, survivors, vocab_match
from tidemill.llm.tokens import token_counts
from tidemill.profile import FIELDS
from tidemill.session import table

# The fields the survivor ladder uses.
LADDER = survivors.Ladder(
    fields=FIELDS,
    compare=[f for f in FIELDS if f not in ("sku", "updated_at")],
    core=["title", "price", "image_url", "barcode", "stock_status", "vendor"],
    backfill=["title", "vendor", "product_type", "barcode", "weight", "dimensions", "image_url", "description", "tags", "handle"],
)


# ------------------------------------------------------------- 2: vocabulary
def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = table(spark, sf_dir, "vocab_entry")
    wordings = vocab_match.learned_wordings(table(spark, sf_dir, "change_log"), vocabulary)
    return vocab_match.matched(table(spark, sf_dir, "feed_row"), vocabulary, ("vendor", "stock_status", "published"), wordings=wordings)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("row_id", "field", "entry_id")


def p2_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that mean none of the list, with the number of cells that hold them."""
    return _matched(spark, sf_dir).where(F.col("entry_id") == -1).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_cells"))


# -------------------------------------------------------------- 6: survivors
def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(survivors.sku_groups(table(spark, sf_dir, "feed_row")), ["feed_id", "sku_key"], LADDER)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).where(~F.col("tied")).select("feed_id", F.col("survivor").alias("row_id"), "backfills")


def p6_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of each group, built field by field."""
    return _groups(spark, sf_dir).drop("identical")


# ---------------------------------------------------------------- 7: packing
def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[int, int]]:
    sizes = {r["pack_id"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_size").collect()}  # a fixed, small table
    return packing.pack(token_counts(table(spark, sf_dir, "documents")), sizes), sizes


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, sizes = _packed(spark, sf_dir)
    return packing.fill(packed, sizes).withColumn("fill", F.round("fill", 6))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the packing whatever it is: per capacity, texts packed whole, and what went wrong."""
    tokens = token_counts(table(spark, sf_dir, "documents"))
    packed, sizes = _packed(spark, sf_dir)
    capacity = F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for pc in sorted(sizes.items()) for x in pc]), F.col("pack_id"))
    size = packed.withColumn("capacity", capacity)
    texts = size.groupBy("pack_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("cuts"), F.max("n_tokens").alias("longest"))
    held = tokens.select(F.col("doc_id").alias("__d"), "n_tokens")
    each = texts.join(held, F.col("doc_id") == F.col("__d"), "full")
    lost = F.count_if(~F.col("packed").eqNullSafe(F.col("n_tokens")))
    # a text is cut as seldom as it can be, so one that fits is whole
    needless = F.count_if(F.col("cuts") != F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1)))
    whole = each.groupBy("pack_id", "capacity").agg(F.count(F.lit(1)).alias("texts"), lost.alias("lost"), needless.alias("needless_cuts"))
    least = F.ceil(F.sum("t") / F.first("capacity"))
    filled = size.groupBy("pack_id", "capacity", "container_id").agg(F.sum("n_tokens").alias("t")).groupBy(F.col("pack_id").alias("__p")).agg(
        F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), (F.count(F.lit(1)) <= least * 1.02 + 1).alias("nearly_full")
    )
    return whole.join(filled, F.col("pack_id") == F.col("__p")).drop("__p")


# ----------------------------------------------------------------- 8: mixing
def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {r["source"]: mixing.Target(r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_target").collect()}  # fixed and small
    return mixing.mixture(token_counts(table(spark, sf_dir, "documents"), keep=("source",)), targets)[0]


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_target")).withColumn("actual_share", F.round("actual_share", 6))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mixture: per target, shares within a hundredth, repeats within the cap, only its own documents."""
    mixed = _mixed(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_target")
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"))
    strays = mixed.join(own, (F.col("doc_id") == F.col("__d")) & (F.col("source") == F.col("__s")), "left_anti").groupBy(F.col("source").alias("__of")).agg(F.count(F.lit(1)).alias("strays"))
    reached = mixing.shares(mixed, targets).join(strays, F.col("source") == F.col("__of"), "left")
    return reached.select(
        "source", (F.abs(F.col("actual_share") - F.col("target_share")) <= 0.01).alias("share_reached"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"),
        F.coalesce("strays", F.lit(0)).alias("strays"), (F.col("documents") > 0).alias("used"),
    )


# -------------------------------------------------------------- 9: languages
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(language.languages(table(spark, sf_dir, "documents"))).select("doc_id", "lang")


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    return language.segments(table(spark, sf_dir, "documents")).select(
        "doc_id", "segment", "n_sentences", "lang", F.round("confidence", 4).alias("confidence"), "chars"
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_misses, p6_found, p6_golden, p7_packed, p7_fill, p7_invariants, p8_mixture, p8_shares, p8_invariants, p9_found, p9_segments)}

_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?\\s*(Z|[+-][0-9]{2}:?[0-9]{2})?$".replace("\\\\", "\\")
_FULL = lambda f: f"({f} IS NOT NULL AND trim({f}) NOT IN ('', '-', '--', 'n/a', 'N/A'))::INT"
_SAME = " || chr(1) || ".join(f"CASE WHEN {f} IS NULL OR trim({f}) = '' THEN '' ELSE {f} END" for f in LADDER.compare)
_RANKED = f"""WITH r AS (SELECT *, trim(regexp_replace(lower(sku), '[^a-z0-9]+', ' ', 'g')) AS k, {_SAME} AS sig,
CASE WHEN regexp_matches(trim(updated_at), '{_ISO}') THEN try_cast(replace(left(trim(updated_at), 10) || ' ' || CASE WHEN substr(trim(updated_at), 14, 1) = ':' THEN substr(trim(updated_at), 12, 5)
|| CASE WHEN substr(trim(updated_at), 17, 1) = ':' THEN substr(trim(updated_at), 17, 3) ELSE ':00' END ELSE '00:00:00' END, 'T', ' ') AS TIMESTAMP) END AS stamp,
{" + ".join(map(_FULL, LADDER.core))} AS core, {" + ".join(map(_FULL, FIELDS))} AS filled, {", ".join(f"{_FULL(f)} AS has_{f}" for f in FIELDS)} FROM feed_row),
g AS (SELECT *, count(*) OVER w AS n, min(sig) OVER w = max(sig) OVER w AS same, min(line) OVER w AS first_line, {", ".join(f"max(has_{f}) OVER w AS any_{f}" for f in LADDER.backfill)},
rank() OVER (PARTITION BY feed_id, k ORDER BY stamp DESC NULLS LAST, core DESC, filled DESC) AS place FROM r WHERE k <> '' WINDOW w AS (PARTITION BY feed_id, k)),
b AS (SELECT *, count(*) FILTER (place = 1) OVER (PARTITION BY feed_id, k) AS level, ({" + ".join(f"any_{f} - has_{f}" for f in LADDER.backfill)})::BIGINT AS backfills,
CASE WHEN same THEN line = first_line ELSE place = 1 AND level = 1 END AS won FROM g WHERE n > 1)"""
_BEST = lambda f: f"first({f} ORDER BY place, line, row_id) FILTER (has_{f} = 1)"
_LOOSE = [f for f in FIELDS if f not in LADDER.compare]
SQL: dict[str, str] = {
    # no SQL counts tokens; these state what has to hold of any right packing and mixture
    "p7_invariants": """SELECT pack_id, capacity_tokens AS capacity, (SELECT count(*) FROM documents) AS texts, 0::BIGINT AS lost, 0::BIGINT AS needless_cuts, 0::BIGINT AS overfull, true AS nearly_full FROM pack_size""",
    "p8_invariants": """SELECT source, true AS share_reached, true AS within_cap, 0::BIGINT AS strays, true AS used FROM mix_target""",
    "p6_found": f"{_RANKED} SELECT feed_id, row_id, backfills FROM b WHERE won",
    "p6_golden": f"""{_RANKED} SELECT feed_id, k AS sku_key, count(*) AS n_rows, NOT bool_or(won) AS tied, max(row_id) FILTER (won) AS survivor, max(backfills) FILTER (won) AS backfills,
{", ".join(f"{_BEST(f)} AS {f}" for f in LADDER.compare)},
{", ".join(f"coalesce(CASE WHEN bool_and(same) THEN max({f}) FILTER (won AND has_{f} = 1) END, {_BEST(f)}) AS {f}" for f in _LOOSE)} FROM b GROUP BY feed_id, k""",
}
