"""What depends on the session: the shared folder, checked broadcasts, table loading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: A side may be broadcast up to this size as the optimizer estimates it.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the cluster's shared checkpoint folder, its lineage cut.

    The folder is spark.checkpoint.dir of the session; only where none is set (tests, one
    machine) a temporary one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemill-"))
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of `df`; huge when it knows nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast if the estimate is within `limit`; else leave the join to Spark (sort-merge, AQE skew handling)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def measured_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of `df` hold, counted; for tables that are written already and cheap to read again."""
    simple = lambda t: not isinstance(t, ArrayType | MapType | StructType)
    text = [F.col(f.name).cast("string") if simple(f.dataType) else F.to_json(F.struct(f.name)) for f in df.schema.fields]
    width = F.lit(16 + 8 * len(text))
    for c in text:
        width = width + F.coalesce(F.length(c), F.lit(0))
    return df.agg(F.sum(width)).first()[0] or 0


def measured_side(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Hint a broadcast of a written table if it is within `limit` as counted, whatever the optimizer thinks of it."""
    return F.broadcast(df) if measured_bytes(df) <= limit else df
