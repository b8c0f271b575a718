"""Operator 12 against brute force and, as registered, against SQL."""

import os

import duckdb
import numpy as np
import pytest

from quillspark.llm import negatives, registry

KIND = "vec_id long, embedding array<float>, label int"


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def plain(rows, k=5):
    held = set()
    for v, e, label in rows:
        if v is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            held.add((v, (label + 1) % 10 if v % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in e)))
    for v, label, q in held:
        if v % 100:
            continue
        others = sorted((-sum(a * b for a, b in zip(q, p)), w, other) for w, other, p in held if w != v and len(p) == len(q))
        for score, pos, _ in [x for x in others if x[2] == label][:k]:
            found = [x for x in others if x[2] != label and 80 * -score <= 100 * -x[0] <= 100 * -score]
            yield from ((v, pos, r, w, -score, -s) for r, (s, w, _) in enumerate(found[:k], 1))


def table(spark, rows):
    return spark.createDataFrame(rows, KIND).selectExpr("*", "'own' AS q", "1 AS wide", "2 AS block", "'x' AS asked").repartition(3)


@pytest.mark.parametrize("case", ["spread", "clustered", "ties", "hostile", "one"])
def test_against_brute_force(spark, case):
    r = np.random.default_rng(len(case))
    wide = 6
    if case == "clustered":
        centre = r.normal(size=(12, wide))
        rows = [(i * 5, (centre[i % 12] + r.normal(size=wide) * 0.05).tolist(), int(i % 3)) for i in range(900)]
    elif case == "ties":  # few vectors, one of them a third of all rows
        some = r.integers(-1, 2, size=(9, wide)).astype(float)
        rows = [(i, (some[0] if i % 3 == 0 else some[i % 9]).tolist(), int(i % 4)) for i in range(1200)]
    elif case == "one":
        rows = [(100, [1.0] * wide, 1)]
    else:
        rows = [(i, r.normal(size=wide).tolist(), int(r.integers(0, 5))) for i in range(700)]
    if case == "hostile":
        rows += [rows[3], rows[100], (200, [0.5] * wide, 2), (200, [0.5] * wide, 3), (None, [1.0] * wide, 1), (900, None, 1), (1000, [1.0] * wide, None), (1100, [None] * wide, 1)]
        rows += [(1200, [float("nan")] * wide, 1), (1300, [float("inf")] * wide, 1), (1400, [1.0], 1), (1401, [2.0], 2), (1402, [3.0], 1), (1500, [], 1), (1501, [], 1), (1502, [], 4), (1600, [0.0] * wide, 1), (1700, [3e6] * wide, 2), (-100, [1.0] * wide, 9)]
    assert by_text(negatives.mine(table(spark, rows), block=64).collect()) == by_text(plain(rows))


def test_empty_table(spark):
    assert negatives.mine(table(spark, [(1, [1.0], 1)]).where("false")).collect() == []


def test_lists_are_left_unread(spark):
    """On tight clusters, an anchor scores a part of a block only."""
    r = np.random.default_rng(3)
    centre = r.normal(size=(40, 4)) * 3
    rows = [(i, (centre[i % 40] + r.normal(size=4) * 0.1).tolist(), int(i % 2)) for i in range(8000)]
    visited = spark.sparkContext.accumulator(0)
    assert by_text(negatives.mine(table(spark, rows), block=2048, visited=visited).collect()) == by_text(plain(rows))
    assert visited.value < 0.5 * 80 * 12000, visited.value


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_registered_against_sql(spark, folder):
    got = registry.QUERIES["op12_hard_negatives"](spark, folder).collect()
    con = duckdb.connect()
    path = f"{folder}/embeddings.parquet"
    con.execute(f"create view embeddings as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    assert got and by_text(got) == by_text(con.execute(f"select {', '.join(got[0].__fields__)} from ({registry.ORACLES['op12_hard_negatives']})").fetchall())
