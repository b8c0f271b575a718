import duckdb
import pytest

from quillspark.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        assert rows == sorted(con.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall(), key=key)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())


def test_counts_of_a_hot_user_are_whole(spark, tmp_path):
    events = spark.sql("select 1L user_id, if(id < 150, 'error', 'signup') event_type, timestamp_ntz'2024-01-01 00:00:00' ts from range(270)")
    events.write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("select 1L c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["q_compare_status"](spark, f"{tmp_path}").first()
    assert (found["open_issues"], found["open_pull_requests"]) == (150, 120)
    total = QUERIES["q_compare_summary"](spark, f"{tmp_path}").first()
    assert (total["open_issues"], total["open_pull_requests"]) == (150, 120)
