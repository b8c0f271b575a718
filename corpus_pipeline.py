"""A corpus pipeline of five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, decontaminate, language, packing, simhash, suffixes

#: Share of confidence that a document's language needs.
LEAST_SCORE = 0.5


#: Bytes of row numbers that may be broadcast; beyond it the rows to drop are joined by a shuffle.
MOST_BROADCAST = 64 << 20


_held = threading.local()


def stage(number: int) -> Callable:
    """A stage begins by deleting what the one before it wrote on its way: stages are run in order, each
    result is written, and docs is read from there. What docs still reads, if it was not, stays; so does
    what the last stage wrote, and what a stage wrote that the next one doesn't follow."""

    def add(run: Callable) -> Callable:
        @functools.wraps(run)
        def with_a_clean_start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            held = _held.paths = getattr(_held, "paths", {})
            if paths := held.pop(number - 1, None):
                read = docs.inputFiles()
                common.delete(spark, [p for p in paths if not any(p.rsplit("/", 1)[1] in f for f in read)])
            with common.noted(held.setdefault(number, [])):
                return run(spark, docs, sf_dir)

        return with_a_clean_start

    return add


@stage(0)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the classifier tells: no und (null, or without letters) and a
    score of at least LEAST_SCORE. It learns from the labelled rows of docs."""
    told = common.fresh(docs, "language")
    found = language.identify(docs, language.train(docs), told)
    kept = (F.col(f"{told}.lang_pred") != language.UNKNOWN) & (F.col(f"{told}.score") >= LEAST_SCORE)
    return found.where(kept).select(*docs.columns)


@stage(1)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates one row: that with the smallest doc_id, null last; of
    several rows with it, that with the smallest hash of the text, then any. Only the numbers of the
    rows that go are joined with the texts, which stay where they are if these numbers are few."""
    row, salt = common.fresh(docs, "row"), common.fresh(docs, "salt")
    rows = common.materialize(docs.withColumns({row: F.monotonically_increasing_id(), salt: F.xxhash64("text")}), "rows")
    found = common.materialize(simhash.near_duplicates(rows, carry=(row, salt)), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(salt).alias("salt"), F.col(row).alias("row"))).alias("first")
    kept = found.groupBy("class").agg(first).select(F.col("first.row").alias(row))
    dropped = common.materialize(found.select(row).join(kept, row, "left_anti"), "dropped")
    if dropped.count() * 16 <= MOST_BROADCAST:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


@stage(2)
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages of 50 bytes and more that also stand in a document with a smaller doc_id. A
    character goes with any of its bytes; a document of which nothing is left goes."""
    return suffixes.cut_documents(docs)


@stage(3)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a passage of the benchmark."""
    told = common.fresh(docs, "found")
    found = decontaminate.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=told)
    return found.where(F.size(f"{told}.hit") == 0).select(*docs.columns)


@stage(4)
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: one row a piece, with its ids and its place."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read back, and what a stage wrote on the
    way, its input among it, goes when its result stands."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, function in STAGES[:-1]:
        path = common.scratch(spark, name.replace(" ", "-"))
        with common.temporary(spark):
            made = function(spark, docs, sf_dir)
            made.write.parquet(path)
        common.delete(spark, before)
        docs, before = spark.read.schema(made.schema).parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
