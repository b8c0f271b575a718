"""Folders of Parquet in buckets of a key, which joins on the key read without a shuffle."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


def _name(path: str, n: int) -> str:
    return "quillspark_" + hashlib.sha1(f"{path} {n}".encode()).hexdigest()


def read(spark: SparkSession, path: str, schema: str, key: str, n: int) -> DataFrame:
    """The rows under path, in n buckets. Buckets are known to tables alone, so the session gets one over the
    folder; its files keep bloom filters of the key."""
    name, place = _name(path, n), path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet OPTIONS ('parquet.bloom.filter.enabled#{key}' 'true') CLUSTERED BY ({key}) INTO {n} BUCKETS LOCATION '{place}'")
    spark.catalog.refreshTable(name)  # other drivers may have written
    return spark.table(name)


def append(rows: DataFrame, path: str, schema: str, key: str, n: int) -> None:
    """Add rows, one file for each bucket that gets any."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]
    read(rows.sparkSession, path, schema, key, n)
    rows.select(*names).repartition(n, key).write.insertInto(_name(path, n))


def forget(spark: SparkSession, path: str, n: int) -> None:
    """Drop the session's table; the files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(path, n)}")
