"""Best representative of each duplicate group (problem 6).

Field-by-field survivorship in one aggregation: every attribute takes the maximum of a composite
struct (present, source priority, freshness, completeness, line, value, row), so the surviving record
may be built from several rows, and the row that wins outright is the maximum of the same composite
without a value. Which cells were filled from other rows shows in the rows the maxima come from.
Keys are counted first and only the rows of repeated ones aggregated, so a row alone in its group
crosses no shuffle but as a key. Partial aggregation runs before both shuffles: a group that holds
a third of all rows reaches its reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.codes import iso_seconds
from tidemill.functions.text import fold, is_blank, is_filled
from tidemill.operators.groups import repeated_rows


@dataclass(frozen=True)
class Ladder:
    """What decides: fields compared for identity, counted first, counted next, filled from others."""

    fields: Sequence[str]
    compare: Sequence[str]
    core: Sequence[str]
    backfill: Sequence[str]
    updated: str = "updated_at"


#: Groups' keys are broadcast up to this size, measured; beyond it rows meet them in a salted join.
KEYS_LIMIT_BYTES = 32 * 1024 * 1024


def rank(ladder: Ladder) -> Column:
    """Freshness, core and all filled cells in one number that orders as they do.

    A form of `updated` that is not ISO counts as no time, below every time.
    """
    filled = {f: is_filled(F.col(f)).cast("bigint") for f in {*ladder.fields, *ladder.core}}
    total = lambda names: sum((filled[f] for f in names[1:]), filled[names[0]])
    at = F.coalesce(iso_seconds(F.col(ladder.updated)), F.lit(-1)) + 1
    return (at * (len(ladder.core) + 1) + total(list(ladder.core))) * (len(ladder.fields) + 1) + total(list(ladder.fields))


def survivors(
    rows: DataFrame, group: Sequence[str], ladder: Ladder, line: str = "line", row: str = "row_id", priority: Column | None = None
) -> DataFrame:
    """One row per group of two or more: the group columns and

    n_rows, tied, identical, survivor (row id, null if tied), backfills, and each of the ladder's
    fields with its surviving value (null where no row of the group fills it).

    If all compared fields are equal, blanks among themselves too, the lowest line survives and
    the group is `identical`. Otherwise the highest priority, the newest time, the most core
    cells and the most cells decide in this order; groups still level are `tied` and have no
    survivor. A blank or placeholder cell is not filled. The surviving row's own cells come first;
    a cell it lacks is taken from the best row that fills it, the lower line of equals. A tied group
    is marked so; its cells are taken in the same order. Backfills are the fields whose value is not the
    survivor's own, none in an identical group. Rows with a null in a group column belong to no
    group. Repeated rows are identical.
    """
    keys = [f"__g{i}" for i in range(len(group))]
    text = [F.when(is_blank(F.col(f)), F.lit("")).otherwise(F.col(f)) for f in ladder.compare]
    keyed = rows.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], "*")
    # only groups of two or more have anything to decide, so all else stays where it is
    chosen = repeated_rows(keyed, keys, row, KEYS_LIMIT_BYTES)
    base = chosen.select(
        *keys, F.col(row).alias("__row"), F.coalesce(F.col(line), F.lit(2**62)).alias("__line"),
        (priority if priority is not None else F.lit(0)).alias("__priority"), rank(ladder).alias("__rank"),
        # two independent 64-bit hashes of all compared cells stand for their equality
        F.xxhash64(*text).alias("__h1"), F.xxhash64(F.lit("second"), *reversed(text)).alias("__h2"),
        *[F.when(is_filled(F.col(f)), F.col(f)).alias(f"__v_{f}") for f in ladder.fields],
    )
    here = [F.col("__priority"), F.col("__rank"), (-F.col("__line")).alias("__up"), (-F.col("__row")).alias("__first")]
    first = [(-F.col("__line")).alias("__up"), (-F.col("__row")).alias("__first")]
    value = lambda f: F.col(f"__v_{f}")
    # in an identical group only these can differ, and the lowest line's own come first
    loose = [f for f in ladder.fields if f not in ladder.compare]
    one = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        # the same rank reached by two rows shows as two different ids, lowest and highest
        F.max(F.struct("__priority", "__rank", F.col("__row").alias("row"))).alias("__high"),
        F.max(F.struct("__priority", "__rank", (-F.col("__row")).alias("row"))).alias("__low"),
        F.max(F.struct(*first, F.col("__row").alias("row"), *[value(f).alias(f) for f in loose])).alias("__lowest"),
        *[f(h).alias(f"{h}_{n}") for h in ("__h1", "__h2") for n, f in (("a", F.min), ("b", F.max))],
        # (non-null, priority, time, completeness, lower line; the value and the row it is from)
        *[F.max(F.when(value(f).isNotNull(), F.struct(*here, F.col("__row").alias("row"), value(f).alias("value")))).alias(f"__a_{f}") for f in ladder.fields],
    )
    identical = (F.col("__h1_a") == F.col("__h1_b")) & (F.col("__h2_a") == F.col("__h2_b"))
    tied = ~identical & ~F.col("__high.row").eqNullSafe(-F.col("__low.row"))
    judged = one.withColumns({"identical": identical, "tied": tied})
    borrowed = [(~F.col(f"__a_{f}.row").eqNullSafe(F.col("__high.row")) & F.col(f"__a_{f}").isNotNull()).cast("bigint") for f in ladder.backfill]

    def kept(f: str) -> Column:
        best = F.col(f"__a_{f}.value")
        return F.when(F.col("identical"), F.coalesce(F.col(f"__lowest.{f}"), best)).otherwise(best) if f in loose else best

    return judged.select(
        *[F.col(k).alias(g) for g, k in zip(group, keys)],
        "n_rows", "tied", "identical",
        F.when(F.col("identical"), F.col("__lowest.row")).when(~F.col("tied"), F.col("__high.row")).alias("survivor"),
        F.when(F.col("identical"), F.lit(0)).when(~F.col("tied"), sum(borrowed[1:], borrowed[0])).cast("bigint").alias("backfills"),
        *[kept(f).alias(f) for f in ladder.fields],
    )


def sku_groups(rows: DataFrame) -> DataFrame:
    """`rows` with sku_key, the folded sku; rows whose sku folds to nothing are left out."""
    return rows.withColumn("sku_key", fold(F.col("sku"))).where(F.col("sku_key") != "")
