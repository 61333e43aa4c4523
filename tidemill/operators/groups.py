"""Rows of keys that occur more than once, found without moving all the others.

Keys are counted with partial sums; only those of two rows or more go on. They are broadcast if they
are small as measured; beyond that their rows meet them in parts, so a key with a third of all rows
is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import BROADCAST_LIMIT_BYTES, checkpointed, measured_bytes

#: Parts a key's rows are spread over when its join is not a broadcast.
SALT = 32


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of two rows or more; rows with a null in a key are left out."""
    counted = rows.select(*keys).dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") > 1).select(*keys)


def salt_of(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALT)).cast("int")


def rows_of(rows: DataFrame, keys: DataFrame, spread_by: Column | str, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """The rows whose key is one of the written table `keys`. `spread_by` differs between the rows of a key."""
    names = keys.columns
    on = keys.select(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(names)])
    same = [F.col(k) == F.col(f"__key_{i}") for i, k in enumerate(names)]
    if measured_bytes(on) <= limit:
        return rows.join(F.broadcast(on), same, "left_semi")
    spread = on.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("__salt", salt_of(spread_by)).join(spread, [*same, F.col("__salt") == F.col("__part")], "left_semi").drop("__salt")


def repeated_rows(rows: DataFrame, keys: Sequence[str], spread_by: Column | str, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """The rows whose key occurs more than once."""
    return rows_of(rows, checkpointed(repeated_keys(rows, keys)), spread_by, limit)


def smallest(rows: DataFrame, keys: Sequence[str], value: str, k: int, name: str) -> DataFrame:
    """(keys, name array of the k smallest different values in order, n_<name> how many there are).

    Values are made distinct with partial sums, and only the k smallest of each task reach the sort of a key.
    """
    different = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    counts = different.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    ranked = different.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("__at") <= k)
    first = ranked.groupBy(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keys)]).agg(F.array_sort(F.collect_list(value)).alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(keys)]
    return counts.join(first, same).drop(*[f"__{i}" for i in range(len(keys))])
