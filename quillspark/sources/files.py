"""Documentation files as a table: repo, branch, path, content, size_bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read_checkouts(spark: SparkSession, root: str) -> DataFrame:
    """Markdown below root, laid out as root/owner/repo/branch/path; names of branches have no slash.
    The scan lists and reads files in parallel; binary files and bad UTF-8 are left to size_filter."""
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,mdx,markdown,MD,MDX,MARKDOWN}").load(root)
    tail = F.split_part(F.col("path"), F.lit("/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"), F.lit(-1))
    parts = F.split(tail, "/", 4)
    return held.select(
        F.concat_ws("/", parts[0], parts[1]).alias("repo"), parts[2].alias("branch"), tx.clean_path(parts[3]).alias("path"),
        F.try_validate_utf8(F.decode("content", "UTF-8")).alias("content"), F.col("length").alias("size_bytes"),
    )
