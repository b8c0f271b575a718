"""The cache in buckets: look-up and join without moving it, growth, the older layout, crashes."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import cache
from quillspark.sources import store as stores
from quillspark.sources.store import CACHE, Store


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def vectors(spark, lo, hi):
    n = F.col("id").cast("string")
    return spark.range(lo, hi).select(F.sha2(n, 256).alias("content_hash"), n.alias("content"), F.array(F.col("id").cast("float")).alias("embedding"))


def held(store):
    return sorted((r["model"], r["content_hash"], r["embedding"][0], r["dimensions"]) for r in store.cache().collect())


def test_the_cache_is_not_shuffled(spark, tmp_path, no_broadcast):
    store = Store(spark, f"file://{tmp_path}/s")
    store.append_cache(vectors(spark, 0, 50), "m")
    incoming = vectors(spark, 40, 60).unionAll(vectors(spark, 40, 60))
    misses = cache.cache_misses(incoming, store.cache(), "m", store.buckets())
    plan = misses._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    known = plan[plan.index("quillspark_") :] if plan.rindex("Bucketed") > plan.rindex("Exchange hashpartitioning") else ""
    assert known and plan.count("Exchange hashpartitioning") == 2  # the incoming texts alone: merged, then dealt to the buckets
    assert sorted(int(r["content"]) for r in misses.collect()) == list(range(50, 60))
    got = store.vectors_of(incoming, "m")
    assert sorted(r["embedding"][0] for r in got.collect()) == list(range(40, 50))
    assert store.vectors_of(incoming, "other").collect() == []


def test_only_what_is_new_is_added_and_buckets_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "BUCKET_ROWS", 10)
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.cache().collect() == [] and store.buckets() == 8
    store.append_cache(vectors(spark, 0, 30).unionAll(vectors(spark, 0, 30)), "m")
    store.append_cache(vectors(spark, 20, 40), "n")
    first = held(store)
    assert len(first) == 50 and store.buckets() == 8
    store.append_cache(vectors(spark, 20, 70), "m")
    assert store.buckets() == 32 and len(held(store)) == 90 and set(first) < set(held(store))
    again = Store(spark, f"file://{tmp_path}/s")
    assert held(again) == held(store) and again.set_aside == []


def test_a_cache_by_model_becomes_one_of_buckets(spark, tmp_path):
    root = f"{tmp_path}/s"
    Store(spark, f"file://{root}")
    rows = vectors(spark, 0, 20).select("content_hash", "embedding", F.lit(1).alias("dimensions"), F.current_timestamp().alias("created_at"), F.when(F.col("content") < "5", "m").otherwise("n").alias("model"))
    rows.write.partitionBy("model").parquet(f"file://{root}/cache")
    (tmp_path / "s/version=5").rename(tmp_path / "s/version=3")
    (tmp_path / "s/cache").rename(tmp_path / "s/cache.old")  # and a crash between two renames
    store = Store(spark, f"file://{root}")
    assert len(held(store)) == 20 and {m for m, *_ in held(store)} == {"m", "n"} and store.buckets() == 8
    assert (tmp_path / "s/version=5").exists() and not (tmp_path / "s/version=3").exists()
    assert store.cache().schema == spark.createDataFrame([], CACHE).schema
    store._rebucket(store.cache(), 2)
    (tmp_path / "s/cache").rename(tmp_path / "s/cache.old")
    assert len(held(Store(spark, f"file://{root}"))) == 20
