"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: the installed package's, else the folder's."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(TOKENIZER_DIR, name)
    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only on a single machine (a local master,
    as in tests) may it be unset: then a temporary folder is made and remembered in the session."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillspark.shared.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("quillspark.shared.dir", where)
    return where.rstrip("/")


_held = threading.local()
_left: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. It goes at the end of the innermost temporary(), else when
    the driver ends, since what is lazy may still read it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_held, "scopes", None)
    if scopes:
        scopes[-1].append(path)
    else:
        if not _left:
            atexit.register(release, spark)
        _left.append(path)
    return path


@contextmanager
def noted(paths: list[str]):
    """Adds to `paths` what scratch() names inside and outside of temporary()."""
    before = set(_left)
    try:
        yield
    finally:
        paths += [p for p in _left if p not in before]


@contextmanager
def temporary(spark: SparkSession):
    """Deletes what scratch() and materialize() made inside; what is to stay must be written to a path
    taken outside."""
    scopes = _held.scopes = getattr(_held, "scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        delete(spark, scopes.pop())


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that scratch() named."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        if path in _left:
            _left.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all that scratch() named outside of temporary(): once the results have been read."""
    try:
        delete(spark, list(_left))
    except Exception:  # the session has ended before the driver
        _left.clear()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here, the rows are
    computed once, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out() -> F.Column:
    """True on the rows that no model learns from: crc32(doc_id as text) mod 4 is 2; false for null."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column: operators never overwrite one."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def encode(texts) -> list[bytes]:
    """UTF-8 of each text; null counts as empty, lone surrogates are replaced."""
    return [b"" if not isinstance(t, str) else t.encode("utf-8", "replace") for t in texts]


def batches(sizes: list[int], most: int):
    """Ranges (from, to) of neighbours whose sizes sum to at most `most`; a larger one stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def offsets(sizes) -> np.ndarray:
    """Exclusive prefix sums with the total at the end."""
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(np.asarray(sizes, np.int64), out=out[1:])
    return out


def sample(rows: DataFrame, key: str, text: str, by: str, most_rows: int, most_bytes: int) -> pd.DataFrame:
    """Whole texts to learn from: key, by and text of a bounded number of rows of each value of `by`.

    Of the distinct (key, text) of each value of `by`, those with the smallest hashes are taken in
    turn, `most_rows` at most, while their texts sum to at most `most_bytes` bytes; a text that does
    not fit any more is passed over whole. Rows with a null in any of the three, and empty texts, take
    no part. Repeated rows count once, and the hash is of key and text, so neither a repeated key nor
    equal rows swell the sample; where rows lie has no say in it. What reaches the driver is bounded
    by the two parameters for each value of `by` (labels or languages: few).
    """
    own = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(by).alias("by")).where("key IS NOT NULL AND by IS NOT NULL AND text != ''")
    narrow = own.select("by", "key", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("of"))
    narrow = narrow.withColumn("draw", F.xxhash64("key", "of", F.lit(17)))
    counts = {r["by"]: r["n"] for r in narrow.groupBy("by").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pd.DataFrame({"key": [], "by": [], "text": []})
    # Repeats only make fewer of them distinct, so the first cut takes four times as many as are
    # wanted; where that leaves too few, all are ranked.
    share = F.create_map(*(F.lit(x) for v, n in counts.items() for x in (v, min(1.0, 4 * most_rows / n))))[F.col("by")]
    order = Window.partitionBy("by").orderBy("draw", "key", "of")

    def first(some: DataFrame) -> pd.DataFrame:
        ranked = some.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_rows)
        return ranked.toPandas()

    got = first(narrow.where(F.pmod(F.xxhash64("key", "of", F.lit(18)), F.lit(1 << 30)) < share * float(1 << 30)))
    if any(n > 4 * most_rows and (got["by"] == v).sum() < most_rows for v, n in counts.items()):
        got = first(narrow)
    keep = []
    for _, part in got.sort_values("rank").groupby("by"):
        left = most_bytes
        for row in part.itertuples():
            if row.bytes <= left:
                left -= row.bytes
                keep.append((row.by, row.key, row.of))
    if not keep:
        return pd.DataFrame({"key": [], "by": [], "text": []})
    kinds = dict(narrow.dtypes)
    chosen = rows.sparkSession.createDataFrame(keep, f"by {kinds['by']}, key {kinds['key']}, of long")
    found = own.withColumn("of", F.xxhash64("text")).join(F.broadcast(chosen), ["by", "key", "of"])
    found = found.groupBy("by", "key", "of").agg(F.first("text").alias("text")).toPandas()
    return found.sort_values(["by", "key", "of"], kind="stable", ignore_index=True)[["key", "by", "text"]]
