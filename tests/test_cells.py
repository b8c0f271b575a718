"""Stored cells of vectors against all products, what stays closed, and hostile vectors."""

import numpy as np
import pytest

from quillspark.operators import cells, nearest

VECTORS = "chunk_id long, embedding array<double>"
QUERIES = "query_id long, q array<double>"


def clustered(n=3000, groups=30, wide=8, seed=2):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, wide))
    v = centers[rng.integers(0, groups, n)] + rng.normal(size=(n, wide)) * 0.03
    return v / np.sqrt((v**2).sum(1))[:, None]


def frame(spark, v, extra=()):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + list(extra), VECTORS).repartition(4)


def asked(spark, q, extra=()):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + list(extra), QUERIES)


def order_of(v, q):
    scores = np.round(v @ q.T, 9) + 0.0
    return scores, [sorted(range(len(v)), key=lambda j: (-scores[j, i], j)) for i in range(len(q))]


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_clustered_vectors_open_few_cells(spark, tmp_path):
    v = clustered()
    q = v[:6] + 0.01
    held = cells.build(frame(spark, v), f"file://{tmp_path}/c")
    scores, order = order_of(v, q)
    best, told = cells.top(asked(spark, q), held, 5)
    assert rows(best, "query_id", "rank", "chunk_id") == [(i, r + 1, order[i][r]) for i in range(6) for r in range(5)]
    assert sum(r["opened"] for r in told.collect()) < 0.4 * sum(r["cells"] for r in told.collect())
    hits = [(i, j, float(scores[j, i])) for i in range(6) for j in (i, 40, 2999)]
    ranked, told = cells.ranks(asked(spark, q), held, spark.createDataFrame(hits, "query_id long, chunk_id long, semantic double"))
    assert rows(ranked, "query_id", "chunk_id", "semantic_rank") == sorted((i, j, order[i].index(j) + 1) for i, j, _ in hits)
    assert sum(r["opened"] for r in told.collect()) < 0.5 * sum(r["cells"] for r in told.collect())


@pytest.mark.parametrize("part", [1 << 26, 100])
def test_any_vectors_any_norms_ties_and_copies(spark, tmp_path, monkeypatch, part):
    """A third of the rows is one vector, others are zero, long, null, not finite or of another dimension;
    in parts, each few queries are sent at a time."""
    monkeypatch.setattr(nearest, "MOST_BROADCAST", part)
    monkeypatch.setattr(cells, "FILE", 16)
    rng = np.random.default_rng(5)
    v = np.concatenate([np.tile([1.0, 0.5, -1.0], (100, 1)), np.zeros((5, 3)), rng.normal(size=(150, 3)).round(1), 90 * rng.normal(size=(45, 3)).round(1)])
    extra = [(900, None), (901, [float("nan"), 0.0, 1.0]), (902, [1.0, None, 0.0]), (903, []), (904, [2.0]), (905, [3.0]), (None, [1.0, 1.0, 1.0])]
    q = np.concatenate([rng.normal(size=(5, 3)).round(1), np.zeros((1, 3)), [[1.0, 0.5, -1.0]]])
    ask = asked(spark, q, [(70, [2.0]), (71, [1.0, 1.0]), (72, None), (None, [1.0, 0.0, 0.0])])
    held = cells.build(frame(spark, v, extra), f"file://{tmp_path}/c")
    scores, order = order_of(v, q)
    for k in (1, 8, 400):
        want = [(i, r + 1, order[i][r]) for i in range(7) for r in range(min(k, len(v)))] + [(70, r + 1, c) for r, c in enumerate([905, 904][:k])]
        assert rows(cells.top(ask, held, k)[0], "query_id", "rank", "chunk_id") == want
    hits = [(i, j, float(scores[j, i])) for i in range(7) for j in (0, 57, 102, 260, 299)] + [(70, 904, 4.0), (71, 0, 1.0), (0, 900, None)]
    ranked = cells.ranks(ask, held, spark.createDataFrame(hits, "query_id long, chunk_id long, semantic double"))[0]
    assert rows(ranked, "query_id", "chunk_id", "semantic_rank") == sorted([(i, j, order[i].index(j) + 1) for i, j, _ in hits[:35]] + [(70, 904, 2)])


def test_only_opened_partitions_are_read(spark, tmp_path):
    v = clustered(600, 6)
    cells.build(frame(spark, v), f"file://{tmp_path}/c")
    held = cells.Cells.read(spark, f"file://{tmp_path}/c")
    assert held.table.agg({"n": "sum"}).first()[0] == 600 == held.vectors.count()
    files = {f.split("cell=")[1].split("/")[0] for f in held.vectors.where("cell = 3").inputFiles()}
    plan = held.vectors.where("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "3" in files


def test_no_vectors(spark, tmp_path):
    held = cells.build(frame(spark, np.zeros((0, 3))), f"file://{tmp_path}/c")
    best, told = cells.top(asked(spark, np.ones((2, 3))), held, 3)
    assert best.collect() == [] and rows(told, "query_id", "cells", "opened") == [(0, 0, 0), (1, 0, 0)]
    assert cells.ranks(asked(spark, np.ones((1, 3))), held, spark.createDataFrame([(0, 1, 0.5)], "query_id long, chunk_id long, semantic double"))[0].collect() == []
