"""Column-level profiles of loads and the distances between them (problem 4).

Values are unpivoted and counted per (column, load, value) first, so repeated values cross the
shuffle once per map task whatever their share of the rows. The counts of a load and of the load
before are merged into one step per value and range-sorted by (column, load, value), blanks first.
Running sums inside each range, with the sums of the earlier ranges added on, make two cumulative
curves per column and load. Everything is read off these curves: rows, blanks and distinct values
off their ends, quantiles where a curve reaches a rank, the exact Kolmogorov-Smirnov distance as
the largest gap between the two, and the shift of shares as half the summed change of that gap.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemill.functions.text import is_blank
from tidemill.session import checkpointed, small_side

#: Slack for thresholds on shares: sums of fractions are exact to far less than this.
EPSILON = 1e-9


def value_counts(rows: DataFrame, columns: Sequence[str], load: str) -> DataFrame:
    """(field_name, load, value, n): rows per value; all blank cells of a load are one null value."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("field_name"), F.when(~is_blank(F.col(c).cast("string")), F.col(c).cast("string")).alias("value"))
        for c in columns
    ])
    long = rows.select(F.col(load).alias("load"), F.inline(cells))
    return long.groupBy("field_name", "load", "value").agg(F.count(F.lit(1)).alias("n"))


def steps(counts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(field_name, load, value, n, n_before): rows of each value in a load and in the load before.

    `pairs` has (load, before); a load is before at most one other. Values that only the load
    before holds have n 0. Null loads are before none.
    """
    own = F.struct(F.col("load"), F.col("n"), F.lit(0).cast("bigint").alias("n_before"))
    if pairs is None:
        return counts.select("field_name", "load", "value", "n", F.lit(0).cast("bigint").alias("n_before"))
    after = pairs.select(F.col("before").alias("__before"), F.col("load").alias("__next"))
    linked = counts.join(small_side(after), F.col("load") == F.col("__before"), "left")
    next_ = F.when(F.col("__next").isNotNull(), F.struct(F.col("__next").alias("load"), F.lit(0).cast("bigint").alias("n"), F.col("n").alias("n_before")))
    both = linked.select("field_name", "value", F.inline(F.array_compact(F.array(own, next_))))
    return both.groupBy("field_name", "load", "value").agg(F.sum("n").alias("n"), F.sum("n_before").alias("n_before"))


_SUMMED = ("n", "n_before")


def _running(keys: Sequence[str]):
    """For mapInPandas over sorted ranges: `<amount>_in`, the running sums inside the range and key, and the range's number."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, dict.fromkeys(_SUMMED, 0)
        for batch in batches:
            if not len(batch):
                continue
            parts = []
            # equal keys lie together; a null key equals a null
            marks = batch[keys].astype(object).where(batch[keys].notna(), None)
            new = (marks != marks.shift()).any(axis=1) & ~(marks.isna() & marks.shift().isna()).all(axis=1)
            new.iloc[0] = True
            bounds = [*np.flatnonzero(new.to_numpy()), len(batch)]
            for a, b in zip(bounds, bounds[1:]):
                key = tuple(marks.iloc[a])
                if key != last:
                    last, carried = key, dict.fromkeys(_SUMMED, 0)
                chunk = batch.iloc[a:b].copy()
                for amount in _SUMMED:
                    sums = chunk[amount].to_numpy().cumsum() + carried[amount]
                    chunk[f"{amount}_in"] = sums
                    carried[amount] = int(sums[-1])
                parts.append(chunk)
            out = pd.concat(parts)
            out["part"] = part
            yield out

    return run


def curves(counts: DataFrame, pairs: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """The two cumulative curves of each column and load, a row per value in order, blanks (null) first:

    (field_name, load, value, n, n_before, rows_upto, before_upto, rows, before, blanks,
    blanks_before, upto, upto_before). rows_upto and before_upto are counts up to and with the
    value, rows and before those of the whole load; upto and upto_before are shares of the filled
    cells, null where there are none.

    A range sort by column, load and value; no task holds more than a range, so a column or load
    with most of the rows is spread over as many tasks as it has ranges.
    """
    merged = steps(counts, pairs)
    keys = ["field_name", "load"]
    n = partitions or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = merged.repartitionByRange(n, *keys, "value").sortWithinPartitions(*keys, "value")
    more = [StructField(x, LongType()) for x in ("n_in", "n_before_in", "part")]
    summed = ranged.mapInPandas(_running(keys), StructType([*merged.schema.fields, *more]))
    # written once: range bounds come from a sample, so a second evaluation could cut elsewhere
    local = checkpointed(summed)
    blank = F.col("value").isNull()
    by_range = local.groupBy("part", *keys).agg(
        F.max("n_in").alias("__n"), F.max("n_before_in").alias("__b"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("__n0"), F.sum(F.when(blank, F.col("n_before")).otherwise(0)).alias("__b0"),
    )
    # one row per range that a key reaches into
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_range.select(
        F.col("part").alias("__part"), *[F.col(k).alias(f"__{k}") for k in keys],
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n_carried"), F.coalesce(F.sum("__b").over(earlier), F.lit(0)).alias("__b_carried"),
        F.sum("__n").over(whole).alias("rows"), F.sum("__b").over(whole).alias("before"),
        F.sum("__n0").over(whole).alias("blanks"), F.sum("__b0").over(whole).alias("blanks_before"),
    )
    same = F.col("part") == F.col("__part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = local.join(carried, same).withColumns({"rows_upto": F.col("n_in") + F.col("__n_carried"), "before_upto": F.col("n_before_in") + F.col("__b_carried")})
    return out.select(
        *keys, "value", "n", "n_before", "rows_upto", "before_upto", "rows", "before", "blanks", "blanks_before",
        F.try_divide(F.col("rows_upto") - F.col("blanks"), F.col("rows") - F.col("blanks")).alias("upto"),
        F.try_divide(F.col("before_upto") - F.col("blanks_before"), F.col("before") - F.col("blanks_before")).alias("upto_before"),
    )


def _gap() -> tuple[Column, Column]:
    """The gap between the curves at a value, and its change from the value before; null unless both loads have filled cells."""
    filled, filled_before = F.col("rows") - F.col("blanks"), F.col("before") - F.col("blanks_before")
    # the curves as they were before this value
    own, old = F.col("rows_upto") - F.col("n") - F.col("blanks"), F.col("before_upto") - F.col("n_before") - F.col("blanks_before")
    was = F.try_divide(own, filled) - F.try_divide(old, filled_before)
    here = F.col("upto") - F.col("upto_before")
    is_value = F.col("value").isNotNull()
    return F.when(is_value, F.abs(here)), F.when(is_value, F.abs(here - was))


def breaks_form(patterns: Mapping[str, str]) -> Column:
    """Whether `value` of `field_name` is filled and breaks the whole-value pattern of its column."""
    broken = F.lit(False)
    for column, shape in patterns.items():
        broken = F.when(F.col("field_name") == column, ~F.col("value").rlike(rf"\A(?:{shape})\z")).otherwise(broken)
    return F.col("value").isNotNull() & broken


def profile(
    rows: DataFrame,
    columns: Sequence[str],
    load: str,
    patterns: Mapping[str, str] | None = None,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    partitions: int | None = None,
) -> DataFrame:
    """One row per column and load: rows, blanks, blank_share, distinct_values, min_value, max_value,
    bad_form (rows that break the column's pattern) and quantiles (exact, of the values in order).

    A load without any row has no profile; a column of blanks has null ranges and quantiles.
    """
    curve = curves(value_counts(rows, columns, load), None, partitions)
    reached = [
        # the first value at which the curve reaches the rank
        F.min(F.when(F.col("rows_upto") - F.col("blanks") >= F.greatest(F.ceil((F.col("rows") - F.col("blanks")) * F.lit(q)), F.lit(1)), F.col("value")))
        for q in quantiles
    ]
    listed = F.array(*reached) if quantiles else F.array().cast("array<string>")
    return curve.groupBy("field_name", "load").agg(
        F.max("rows").alias("rows"), F.max("blanks").alias("blanks"), (F.max("blanks") / F.max("rows")).alias("blank_share"),
        F.count("value").alias("distinct_values"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.sum(F.when(breaks_form(patterns or {}), F.col("n")).otherwise(0)).alias("bad_form"), listed.alias("quantiles"),
    )


def distances(curve: DataFrame) -> DataFrame:
    """(field_name, load, ks, shift): exact Kolmogorov-Smirnov distance and half the summed share
    differences between each load and the one before; only where both hold a filled value."""
    gap, change = _gap()
    return curve.groupBy("field_name", "load").agg(F.max(gap).alias("ks"), (F.sum(change) / 2).alias("shift")).where(F.col("ks").isNotNull())


def findings(curve: DataFrame, patterns: Mapping[str, str], blank_rise: float = 0.10, value_shift: float = 0.25) -> DataFrame:
    """(load, field_name, finding): bad_form, blank_rise and value_shift, one row each, off `curves`.

    A load without a load before can only have bad_form; a load before that holds no row is none.
    Loads of no rows have no finding.
    """
    _, change = _gap()
    share = F.try_divide(F.max("blanks"), F.max("rows")) - F.try_divide(F.max("blanks_before"), F.max("before"))
    ends = curve.groupBy("field_name", "load").agg(
        F.max(breaks_form(patterns) & (F.col("n") > 0)).alias("__bad"), share.alias("__rise"), (F.sum(change) / 2).alias("__shift"), F.max("rows").alias("__rows")
    )
    found = F.array_compact(
        F.array(
            F.when(F.col("__bad"), F.lit("bad_form")),
            F.when(F.col("__rise") >= blank_rise - EPSILON, F.lit("blank_rise")),
            F.when(F.col("__shift") >= value_shift - EPSILON, F.lit("value_shift")),
        )
    )
    return ends.where(F.col("__rows") > 0).select("load", "field_name", F.explode(found).alias("finding"))


def load_pairs(files: DataFrame) -> DataFrame:
    """(load, before) of the files of each series in the order of received_at."""
    w = Window.partitionBy("series_id").orderBy("received_at", "feed_id")
    return files.select(F.col("feed_id").alias("load"), F.lag("feed_id").over(w).alias("before")).where(F.col("before").isNotNull())
