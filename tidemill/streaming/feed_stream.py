"""The pipeline over a stream of canonical rows.

Normalising is a projection and runs on the stream as it is. Duplicates are a matter of one
delivery, so the ladder runs on each micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.normalize import normalize
from tidemill.plans.pipeline import judge
from tidemill.profile import Profile
from tidemill.sources.feed import from_table


def normalized_stream(rows: DataFrame, profile: Profile, image_base: str = "") -> DataFrame:
    """A streaming DataFrame of line, v, changes and issues."""
    return normalize(from_table(rows, profile).rows, profile, image_base).select("line", "sku", "v", "changes", "issues")


def run_stream(rows: DataFrame, profile: Profile, target: str, checkpoint: str, image_base: str = "", available_now: bool = True) -> StreamingQuery:
    """Judge each micro-batch and append it to parquet at `target`, with batch_id.

    A batch that is run again after a failure replaces its own output.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        judged = judge(from_table(df, profile), profile, image_base)
        judged.drop("raw", "extra", "original").write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
