"""Looking at tables: pick, filter, mark, and leave out repeated rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import clip
from tidemill.session import checkpointed


def _check(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def view(df: DataFrame, columns: Sequence[str], order: str, limit: int = 13) -> DataFrame:
    """The named columns of the first rows."""
    _check(df, [*columns, order])
    return df.orderBy(order).limit(limit).select(*columns)


def rows_where(df: DataFrame, column: str, wanted: object | Callable[[Column], Column]) -> DataFrame:
    """Rows whose cell equals a value, or for which a condition of the column holds; null never does."""
    _check(df, [column])
    return df.where(wanted(F.col(column)) if callable(wanted) else F.col(column) == F.lit(wanted))


def head_and(df: DataFrame, order: str, head: int, chosen: Column, limit: int) -> DataFrame:
    """The first `head` rows and the chosen ones, in order, at most `limit`."""
    first = df.orderBy(order).limit(head)
    rest = df.where(chosen).join(first.select(F.col(order).alias("__o")), F.col(order) == F.col("__o"), "left_anti")
    return first.unionByName(rest).orderBy(order).limit(limit)


def tinted(df: DataFrame, kinds: Mapping[str, Column], name: str = "tint") -> DataFrame:
    """A column with the first kind whose condition holds, else null."""
    out = F.lit(None).cast("string")
    for kind, condition in reversed(list(kinds.items())):
        out = F.when(condition, F.lit(kind)).otherwise(out)
    return df.withColumn(name, out)


def collapse_repeats(df: DataFrame, order: str, columns: Sequence[str], width: int | None = None, partitions: int | None = None) -> DataFrame:
    """Rows whose shown cells differ from those of the row before, in the order of a unique column.

    Ranges of the order are compared inside themselves, and the first row of each with the last row
    of the range before it, so the whole order is never in one task. With `width`, cells are
    compared as clipped. Nulls equal nulls.
    """
    _check(df, [order, *columns])
    shown = lambda c: clip(F.col(c).cast("string"), width) if width else F.col(c)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__sig", F.struct(*[shown(c).alias(f"s{i}") for i, c in enumerate(columns)]))
    # written once: another evaluation could cut the ranges elsewhere
    ranged = checkpointed(keyed.repartitionByRange(n, order).withColumn("__part", F.spark_partition_id()))
    lasts = ranged.groupBy("__part").agg(F.max_by("__sig", order).alias("__last"))
    carried = lasts.select(F.col("__part").alias("__p"), F.lag("__last").over(Window.partitionBy(F.lit(0)).orderBy("__part")).alias("__carry"))  # a row per range
    inside = Window.partitionBy("__part").orderBy(order)
    joined = ranged.withColumn("__before", F.lag("__sig").over(inside)).join(F.broadcast(carried), F.col("__part") == F.col("__p"), "left")
    before = F.coalesce("__before", "__carry")
    return joined.where(before.isNull() | ~before.eqNullSafe(F.col("__sig"))).select(*df.columns)


def mean_abs_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length; null if they are empty or differ in length."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    total = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a))
