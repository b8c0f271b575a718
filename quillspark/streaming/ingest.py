"""Incremental refresh: files that arrive as Parquet are taken up with Structured Streaming.

Every batch names the repositories it touches, and only those are refreshed. With AvailableNow the
query takes what is there, then stops; the checkpoint folder remembers what has been taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

FILES = "repo string, branch string, path string, content string"


def refresh_on_arrival(spark: SparkSession, landing: str, checkpoint: str, refresh: Callable[[str], object]) -> StreamingQuery:
    """Call refresh(repo) for each repository with new files in the landing folder."""

    def take(batch: DataFrame, number: int) -> None:
        for row in batch.select("repo").distinct().toLocalIterator():
            refresh(row["repo"])

    stream = spark.readStream.schema(FILES).parquet(landing)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
