"""One row per sku by a ladder of reasons, empty cells filled from the rows that lost.

Skus are counted first, and only rows of repeated ones climb the ladder. It is decided in one
aggregation per sku with partial sums before the shuffle, and its outcome, a row per repeated sku, is
joined back to the rows, so a sku with a third of all rows costs no task more than its share. Rows
without a sku key take no part in any join. Whether the best row is alone at a rung shows in the
highest and the lowest line that reach the same best rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.codes import iso_seconds
from tidemill.functions.text import fold
from tidemill.operators.normalize import CHANGE, CHANGED, DROPPED, EDGES, HIDDEN, REJECT, change, issue
from tidemill.operators.groups import SALT, repeated_rows, salt_of, smallest
from tidemill.session import BROADCAST_LIMIT_BYTES, checkpointed, measured_bytes

# Fields that must agree, those counted first, and those filled from other rows.
COMPARE = (
    "title", "vendor", "product_type", "price", "currency", "cost", "compare_at", "barcode", "weight_g", *EDGES,
    "quantity", "stock_status", "published", "taxable", "image_url", "description", "tags", "handle",
)
CORE = ("title", "price", "image_url", "barcode", "stock_status", "vendor")
BACKFILL = ("title", "vendor", "product_type", "barcode", "weight_g", *EDGES, "image_url", "description", "tags", "handle")
REASONS = ("identical", "newest updated_at", "more complete", "more columns populated", "unresolved tie")
#: Fields that disagree which a tie's message names; values of each, and lines of a group, that are told. What is more is counted.
SHOWN = 3
VALUES_SHOWN = 5
LINES_SHOWN = 10
#: Bits for the count of filled cells, and for the line number, in a packed rank.
LINE_BITS = (20, 53)


def _text(f: str) -> Column:
    return F.coalesce(F.col(f"v.{f}"), F.lit(""))


def _count(columns) -> Column:
    cs = [(c != "").cast("int") for c in columns]
    return sum(cs[1:], cs[0])


def ladder(rows: DataFrame, key: str = "sku_key") -> DataFrame:
    """One row per key held by two rows or more: n_rows, reason, winner (line, null if tied), first and
    last line, conflicts (fields that disagree, in order), filled struct<line, value> per field to fill from.

    Lines are 0 to 2**53 - 1.
    """
    every = [*COMPARE, "sku", "updated_at", *HIDDEN]
    at = F.coalesce(iso_seconds(F.col("v.updated_at")), F.lit(-1)) + 1
    whole = _count(_text(f) for f in every) + F.coalesce(F.size(F.filter(F.map_values("extra"), lambda x: x != "")), F.lit(0))
    extras = F.to_json(F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.struct(e["key"], e["value"]))))
    # a field's cells are told apart by 64-bit hashes, whole rows by two hashes of all cells, made apart from these
    hashes = {f: F.xxhash64(_text(f)) for f in COMPARE}
    cells = [*[_text(f) for f in COMPARE], F.coalesce(extras, F.lit(""))]
    # rank and line in one number: what is highest also says where; sums of powers of two keep the order of their parts
    ranks = {"a": at, "b": at * 2**3 + _count(_text(f) for f in CORE)}
    ranks["c"] = ranks["b"] * 2**LINE_BITS[0] + F.least(whole, F.lit(2 ** LINE_BITS[0] - 1))
    placed = {n: r.cast("decimal(38,0)") * F.lit(2 ** LINE_BITS[1]).cast("decimal(20,0)") for n, r in ranks.items()}
    base = rows.where(F.col(key) != "").select(
        key, "line", *[h.alias(f"__h_{f}") for f, h in hashes.items()],
        F.xxhash64(*cells).alias("__h1"), F.xxhash64(F.lit("second"), *reversed(cells)).alias("__h2"),
        *[(p + F.col("line")).cast("decimal(38,0)").alias(f"__up_{n}") for n, p in placed.items()],
        *[(p - F.col("line")).cast("decimal(38,0)").alias(f"__down_{n}") for n, p in placed.items()],
        *[F.when(_text(f) != "", F.struct("line", F.col(f"v.{f}").alias("value"))).alias(f"__f_{f}") for f in BACKFILL],
    )
    compared = [f"__h_{f}" for f in COMPARE]
    one = base.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        *[f(h).alias(f"{h}_{n}") for h in ("__h1", "__h2", *compared) for n, f in (("min", F.min), ("max", F.max))],
        *[F.max(f"__{way}_{n}").alias(f"__{way}_{n}") for n in ranks for way in ("up", "down")],
        *[F.min(f"__f_{f}").alias(f"__f_{f}") for f in BACKFILL],
    )
    one = one.where(F.col("n_rows") > 1)
    identical = (F.col("__h1_min") == F.col("__h1_max")) & (F.col("__h2_min") == F.col("__h2_max"))
    scale = F.lit(2 ** LINE_BITS[1]).cast("decimal(20,0)")
    # of the rows at the highest rank: the highest line, and the lowest
    high = {n: (F.col(f"__up_{n}") % scale).cast("bigint") for n in ranks}
    low = {n: F.when(F.col(f"__down_{n}") % scale == 0, F.lit(0)).otherwise((scale - F.col(f"__down_{n}") % scale).cast("bigint")) for n in ranks}
    alone = {n: high[n] == low[n] for n in ranks}
    reason = F.when(identical, REASONS[0]).when(alone["a"], REASONS[1]).when(alone["b"], REASONS[2]).when(alone["c"], REASONS[3]).otherwise(REASONS[4])
    conflicts = F.array_compact(F.array(*[F.when(F.col(f"__h_{f}_min") != F.col(f"__h_{f}_max"), F.lit(f)) for f in COMPARE]))
    return one.select(
        key, "n_rows", reason.alias("reason"),
        F.when(identical, F.col("first_line")).when(alone["c"], high["c"]).alias("winner"),
        "first_line", "last_line", conflicts.alias("conflicts"), F.struct(*[F.col(f"__f_{f}").alias(f) for f in BACKFILL]).alias("filled"),
    )


def told(rows: DataFrame, groups: DataFrame, key: str = "sku_key") -> DataFrame:
    """`groups` with lines, the first LINES_SHOWN of each group, and of tied groups disagreements, text of the values that differ."""
    # only the first of each task reach the sort of a key
    numbered = rows.select(key, "line").withColumn("__at", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where(F.col("__at") <= LINES_SHOWN)
    lines = numbered.groupBy(F.col(key).alias("__of_lines")).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    tied = groups.where(F.col("winner").isNull()).select(F.col(key).alias("__tied"), F.slice("conflicts", 1, SHOWN).alias("__fields"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.nullif(_text(f), F.lit("")), F.lit("(empty)")).alias("value")) for f in COMPARE])
    wanted = rows.join(tied, F.col(key) == F.col("__tied")).select(key, F.inline(F.filter(cells, lambda c: F.array_contains("__fields", c["field"]))))
    values = smallest(wanted, [key, "field"], "value", VALUES_SHOWN, "values")
    more = F.when(F.col("n_values") > VALUES_SHOWN, F.concat(F.lit(" vs "), (F.col("n_values") - VALUES_SHOWN).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    at = F.array_position(F.array(*[F.lit(f) for f in COMPARE]), F.col("field"))
    said = F.concat("field", F.lit(" "), F.array_join("values", " vs "), more)
    by_group = values.groupBy(F.col(key).alias("__of_values")).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), said.alias("said")))).alias("__said"))
    joined = groups.join(lines, F.col(key) == F.col("__of_lines"), "left").join(by_group, F.col(key) == F.col("__of_values"), "left")
    return joined.withColumn("disagreements", F.array_join(F.transform("__said", lambda x: x["said"]), "; ")).drop("__of_lines", "__of_values", "__said")


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """`rows` left-joined with their group: a broadcast if the groups are small as measured, else in salted parts; blank keys are kept out."""
    if measured_bytes(groups) <= BROADCAST_LIMIT_BYTES:
        return rows.join(F.broadcast(groups), F.col("sku_key") == F.col("__key"), "left")
    spread = groups.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    keyed = rows.where(F.col("sku_key") != "").withColumn("__salt", salt_of("line"))
    met = keyed.join(spread, (F.col("sku_key") == F.col("__key")) & (F.col("__salt") == F.col("__part")), "left").drop("__salt", "__part")
    return met.unionByName(rows.where(F.col("sku_key") == ""), allowMissingColumns=True)


def deduplicate(rows: DataFrame, backfill: bool = True) -> DataFrame:
    """`rows` (normalised) with role, reason and backfills; winners filled, everything recorded.

    role is nosku, single, kept, dropped or tied. A row whose sku folds to nothing is never
    merged. Tied rows stay and carry a rejection. Two rows of one line number and sku are tied at
    best. A null sku is an empty one.
    """
    # read by the count, the ladder and the join; parsing again would cost more than reading back
    keyed = checkpointed(rows.withColumn("sku_key", F.coalesce(fold(F.col("sku")), F.lit(""))))
    some = keyed.where(F.col("sku_key") != "")
    repeated = repeated_rows(some, ["sku_key"], "line")
    # of repeated skus only: read by the ladder, and for what is told of the groups
    repeated = repeated.select("sku_key", "line", "v", "extra")
    groups = checkpointed(told(repeated, ladder(repeated)).withColumnRenamed("sku_key", "__key"))
    joined = with_groups(keyed, groups)
    grouped, won = F.col("__key").isNotNull(), F.col("winner") == F.col("line")
    role = (
        F.when(F.col("sku_key") == "", F.lit("nosku")).when(~grouped, F.lit("single")).when(F.col("winner").isNull(), F.lit("tied"))
        .when(won, F.lit("kept")).otherwise(F.lit("dropped"))
    )
    joined = joined.withColumn("role", role)
    kept, tied = F.col("role") == "kept", F.col("role") == "tied"
    fills = {f: kept & (_text(f) == "") & F.col(f"filled.{f}").isNotNull() if backfill else F.lit(False) for f in BACKFILL}
    line = F.col("winner").cast("string")
    count = F.col("n_rows").cast("string")

    def listed(lines: Column, left: Column) -> Column:
        more = F.when(left > 0, F.concat(F.lit(" and "), left.cast("string"), F.lit(" more"))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(lines, lambda n: n.cast("string")), ", "), more)

    # the lines of the group but one; as they are sorted, at most one of those told is left out
    but = lambda n: listed(F.array_remove("lines", n), F.greatest(F.col("n_rows") - 1 - F.size(F.array_remove("lines", n)), F.lit(0)))
    every = listed(F.col("lines"), F.col("n_rows") - F.size("lines"))
    events = [
        F.when(F.col("role") == "dropped", change("sku", "dedupe.drop", DROPPED, F.col("sku"), F.lit(""), F.concat(F.lit("line "), line, F.lit(" stays ("), F.col("reason"), F.lit(")")))),
        F.when(kept, change("sku", "dedupe.keep", CHANGED, F.col("sku"), F.col("sku"), F.concat(F.lit("best of "), count, F.lit(" rows ("), F.col("reason"), F.lit("), without lines "), but(F.col("winner"))))),
        F.when(tied, change("sku", "dedupe.unresolved", DROPPED, F.col("sku"), F.lit(""), F.concat(F.lit("tied with lines "), but(F.col("line"))))),
        *[
            F.when(on, change(f, "dedupe.backfill", CHANGED, F.lit(""), F.col(f"filled.{f}.value"), F.concat(F.lit("was empty, from line "), F.col(f"filled.{f}.line").cast("string"))))
            for f, on in fills.items()
        ],
    ]
    further = F.when(F.size("conflicts") > SHOWN, F.concat(F.lit("; "), (F.size("conflicts") - SHOWN).cast("string"), F.lit(" more fields"))).otherwise(F.lit(""))
    message = F.concat(F.col("disagreements"), further, F.lit(": none of "), count, F.lit(" rows is newer or fuller (lines "), every, F.lit(")"))
    clash = F.when(tied, issue("duplicate_unresolved", "", message, REJECT))
    v = F.col("v")
    for f in BACKFILL:
        if backfill:
            v = v.withField(f, F.when(fills[f], F.col(f"filled.{f}.value")).otherwise(F.col(f"v.{f}")))
    counted = sum((on.cast("int") for on in fills.values()), F.lit(0))
    return joined.select(
        *[c for c in rows.columns if c not in ("v", "changes", "issues")],
        v.alias("v"),
        F.concat("changes", F.array_compact(F.array(*events)).cast(f"array<{CHANGE}>")).alias("changes"),
        F.concat("issues", F.array_compact(F.array(clash))).alias("issues"),
        "sku_key",
        "role",
        F.when(grouped, F.col("reason")).alias("reason"),
        counted.alias("backfills"),
    )
