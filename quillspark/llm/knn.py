"""Exact top-k search by inner product, as a Voronoi kNN join.

Vectors are grouped by the nearest of some pivots, whose number grows with the square root of theirs,
and a group is cut into rings by the distance from its pivot. A summary of each ring bounds every score
that a query can reach in it. With p the pivot, u its direction, c a vector of the ring:

    q.c = q.p + q.(c - p) <= q.p + |q| |c - p|
    q.c <= q.p + (q.u) a + |q - (q.u) u| b       a, b: what c - p measures along u and across it
    2 q.c = |q|^2 + |c|^2 - |q - c|^2, and |q - c| >= | |q - p| - |c - p| |

Each query is first solved in its own group, which gives the score that a hit must reach; then it is
sent to just those rings whose least bound reaches it. Rings are cut into blocks, and so are the
queries sent to one, so no group stays in one task. Of equal vectors only the k + 1 smallest ids can
be hits, so the others are left out beforehand, and a frequent vector makes no large group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 5
STEP = 256
EVERY = 50
#: Pivots: half the square root of the number of vectors, within these bounds.
PIVOTS = (16, 4096)
#: Vectors, and queries, in a block that one task solves; and rings of a group, before small ones join.
BLOCK = 4096
RINGS = 64
EXACT = float(1 << 53)
RESULT = "query_id long, rank int, vec_id long, score long"


def quantize(vectors: DataFrame, step: int = STEP) -> DataFrame:
    """vec_id, q (array<long>): floor(step * x) of each component as double. Left out are vectors
    that are null or have null or non-finite components, and rows without a vec_id. Vectors may be
    of any length, also empty."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), x.alias("embedding")).where(x.isNotNull() & good & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("embedding", lambda v: F.floor(v * float(step))).alias("q")
    )


def _matrix(q: pd.Series, wide: int) -> np.ndarray:
    return np.stack(q.to_numpy()).astype(np.int64).reshape(len(q), wide) if len(q) else np.zeros((0, wide), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows; in doubles where all sums stay exact, else in integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _best(queries: pd.DataFrame, rows: pd.DataFrame, k: int, wide: int) -> pd.DataFrame:
    """The k best rows of each query that reach its floor, rows of its own id left out; ties to the
    smaller vec_id."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, own, asked = rows["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64), queries["asked"].to_numpy(np.int64)
    floor = queries["floor"].to_numpy(np.int64)
    c, qs = _matrix(rows["q"], wide), _matrix(queries["q"], wide)
    parts = [[np.zeros(0, np.int64)] * 3]
    for lo in range(0, len(own), 256):
        score = _products(qs[lo : lo + 256], c)
        for i, line in enumerate(score, lo):
            at = np.flatnonzero((ids != own[i]) & (line >= floor[i]))
            if len(at) > k:
                # All that reach the k-th score, in order of vec_id, then the first k of a stable sort.
                least = np.partition(line[at], len(at) - k)[len(at) - k]
                at = at[line[at] >= least]
            at = at[np.argsort(-line[at], kind="stable")[:k]]
            parts.append([np.full(len(at), asked[i]), ids[at], line[at]])
    return pd.DataFrame(dict(zip(("asked", "vec_id", "score"), map(np.concatenate, zip(*parts)))))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Pivots:
    """Pivots of one dimension and what is measured against them."""

    def __init__(self, p: np.ndarray):
        self.p = p
        self.norm = (p * p).sum(1)
        self.unit = p / np.maximum(np.sqrt(self.norm), 1e-300)[:, None]

    def place(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """cell, distance from its pivot, what the difference measures along the pivot's direction and
        across it, and the squared norm, of each row."""
        out = {n: np.zeros(len(x)) for n in ("distance", "along", "across", "square")} | {"cell": np.zeros(len(x), np.int64)}
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            cell = np.argmin(self.norm - 2 * (part @ self.p.T), axis=1)
            off = part - self.p[cell]
            along, square = (off * self.unit[cell]).sum(1), (off * off).sum(1)
            values = {"cell": cell, "distance": np.sqrt(square), "along": along, "across": np.sqrt(np.maximum(square - along * along, 0)), "square": (part * part).sum(1)}
            for n, v in values.items():
                out[n][lo : lo + 2048] = v
        return out


def _bound(q: np.ndarray, of: Pivots, rings: dict[str, np.ndarray], who: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The most that query `who` may score in ring `at`, for pairs of them."""
    cell = rings["cell"][at]
    dots, square = q @ of.p.T, (q * q).sum(1)
    qp, length = dots[who, cell], np.sqrt(square[who])
    along = qp / np.maximum(np.sqrt(of.norm[cell]), 1e-300)
    across = np.sqrt(np.maximum(square[who] - along * along, 0))
    apart = np.sqrt(np.maximum(square[who] - 2 * qp + of.norm[cell], 0))
    gap = np.maximum(0, np.maximum(apart - rings["high"][at], rings["low"][at] - apart))
    bound = np.minimum.reduce([
        qp + length * rings["high"][at],
        qp + np.maximum(along * rings["along_low"][at], along * rings["along_high"][at]) + across * rings["across"][at],
        (square[who] + rings["square"][at] - gap * gap) / 2,
    ])
    return bound + 1e-9 * (np.abs(bound) + square[who] + rings["square"][at]) + 1  # rounding


def _rings(placed: DataFrame, block: int) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """placed with ring and block, and the rings' summaries: one row for each group and for each `block`
    vectors at least, which is what the driver sees and the tasks are sent."""
    spark = placed.sparkSession
    radius = placed.groupBy("cell").agg(F.max("distance").alias("radius"))
    thin = placed.join(F.broadcast(radius), "cell").withColumn("thin", F.least(F.lit(RINGS - 1), F.floor(F.lit(RINGS) * F.col("distance") / F.greatest("radius", F.lit(1e-300))).cast("int"))).drop("radius")
    counts = thin.groupBy("cell", "thin").agg(F.count("*").alias("n")).toPandas().sort_values(["cell", "thin"])
    rows, ring, before, held = [], -1, None, 0
    for cell, part, n in zip(counts["cell"].tolist(), counts["thin"].tolist(), counts["n"].tolist()):
        if cell != before or held + n > block:
            ring, before, held = ring + 1, cell, 0
        held += n
        rows.append((cell, part, ring))
    turn = spark.createDataFrame(rows, "cell int, thin int, ring int")
    ringed = thin.join(F.broadcast(turn), ["cell", "thin"]).drop("thin")
    told = ringed.groupBy("ring").agg(
        F.first("cell").alias("cell"), F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.min("along").alias("along_low"),
        F.max("along").alias("along_high"), F.max("across").alias("across"), F.max("square").alias("square"),
    ).toPandas().sort_values("ring")
    rings = {c: told[c].to_numpy() for c in told}
    blocks = spark.createDataFrame([(r, -(-n // block)) for r, n in zip(told["ring"].tolist(), told["n"].tolist())], "ring int, blocks int")
    # A row's block depends on vec_id alone, so its size is near `block` without sorting the ring.
    held = ringed.join(F.broadcast(blocks), "ring").select("vec_id", "q", "ring", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"))
    return held, rings | {"blocks": -(-rings["n"] // block)}


def knn_join(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: tuple[int, int] = PIVOTS, block: int = BLOCK, visited=None) -> DataFrame:
    """vectors and queries (vec_id, q array<long>) -> query_id, rank, vec_id, score.

    Candidates are the vectors of the query's dimension with another vec_id. Rows that repeat vec_id
    and vector count once; of rows that repeat a vec_id with other vectors each is a candidate and a
    query with a ranking of its own. Fewer than k candidates give fewer rows, empty tables none; other
    columns are left out. Exact: a ring is left out only if its bound lies below a score that k
    candidates reach. There is one join for each dimension that queries have, so these should be few
    (one for each model). `visited`, an accumulator, counts the pairs whose product was taken.
    """
    spark = vectors.sparkSession
    vectors, queries = vectors.select("vec_id", "q"), queries.select("vec_id", "q")
    same = Window.partitionBy("q").orderBy("vec_id")
    some = vectors.distinct().withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r")
    some = common.materialize(some.withColumn("wide", F.size("q")), "vectors")
    asked = common.materialize(queries.distinct().select("vec_id", "q", F.size("q").alias("wide")), "asked")
    asked = common.materialize(asked.withColumn("asked", F.monotonically_increasing_id()), "queries")
    sizes = {r["wide"]: r["n"] for r in some.groupBy("wide").agg(F.count("*").alias("n")).collect()}
    wides = sorted(sizes.keys() & {r["wide"] for r in asked.select("wide").distinct().collect()})
    if not wides:
        return spark.createDataFrame([], RESULT)
    parts = [_join_one(some.where(F.col("wide") == w), asked.where(F.col("wide") == w), w, sizes[w], k, pivots, block, visited) for w in wides]
    found = reduce(DataFrame.unionByName, parts).join(asked.select("asked", F.col("vec_id").alias("query_id")), "asked")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _join_one(vectors: DataFrame, asked: DataFrame, wide: int, n: int, k: int, pivots: tuple[int, int], block: int, visited) -> DataFrame:
    """asked, rank, vec_id, score for vectors and queries of one dimension."""
    spark = vectors.sparkSession
    m = min(pivots[1], max(pivots[0], int(n**0.5 / 2)))
    sample = vectors.orderBy(F.xxhash64("q", F.lit(5)), "vec_id").limit(m).collect()
    rows = np.array([r["q"] for r in sample], np.int64).reshape(len(sample), wide)
    of = Pivots((np.unique(rows, axis=0) if wide else rows[:1]).astype(np.float64))

    @F.pandas_udf("struct<cell: int, distance: double, along: double, across: double, square: double>")
    def place(q: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(of.place(_matrix(q, wide).astype(np.float64)))[["cell", "distance", "along", "across", "square"]]

    placed = common.materialize(vectors.select("vec_id", "q", place("q").alias("at")).select("vec_id", "q", "at.*"), "cells")
    held, rings = _rings(placed, block)
    data = common.materialize(held, "rings")
    of_cell = np.searchsorted(rings["cell"], np.arange(len(of.p) + 1))  # rings of a cell are neighbours

    def solve(sent: DataFrame) -> DataFrame:
        """sent (asked, vec_id, q, floor, ring), written: each query against all blocks of the ring."""
        asking = sent.groupBy("ring").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        blocks = spark.createDataFrame(list(zip(range(len(rings["blocks"])), rings["blocks"].tolist())), "ring int, blocks int")
        shares = F.broadcast(asking.join(F.broadcast(blocks), "ring"))  # one row a ring
        turn = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = sent.join(shares, "ring").select("asked", "vec_id", "q", "floor", "ring", turn("blocks").alias("block"), F.pmod(F.xxhash64("asked", F.lit(3)), F.col("parts")).cast("int").alias("part"))
        right = data.join(shares, "ring").select("vec_id", "q", "ring", "block", turn("parts").alias("part"))

        def local(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if visited is not None:
                visited.add(len(left) * len(right))
            return _best(left, right, k, wide)

        pairs = left.groupBy("ring", "block", "part").cogroup(right.groupBy("ring", "block", "part"))
        return pairs.applyInPandas(local, "asked long, vec_id long, score long")

    @F.pandas_udf("array<int>")
    def home_rings(q: pd.Series) -> pd.Series:
        cell = of.place(_matrix(q, wide).astype(np.float64))["cell"]
        return pd.Series([np.arange(of_cell[c], of_cell[c + 1], dtype=np.int32) for c in cell])

    least = F.lit(-(1 << 63)).cast("long")
    first = common.materialize(asked.select("asked", "vec_id", "q", least.alias("floor"), home_rings("q").alias("home")), "home-rings")
    home = common.materialize(_ranked(solve(first.withColumn("ring", F.explode("home")).drop("home")), k), "home")
    floors = home.where(F.col("rank") == k).select("asked", F.col("score").alias("reached"))

    @F.pandas_udf("array<int>")
    def reach(q: pd.Series, home: pd.Series, floor: pd.Series) -> pd.Series:
        x, low = _matrix(q, wide).astype(np.float64), floor.to_numpy(np.int64).astype(np.float64)
        out = []
        count = len(rings["cell"])
        step = max(1, (1 << 20) // max(1, count))
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            who, at = np.repeat(np.arange(len(part)), count), np.tile(np.arange(count), len(part))
            go = (_bound(part, of, rings, who, at) >= low[lo : lo + step][who]).reshape(len(part), count)
            for i, line in enumerate(go, lo):
                line[np.asarray(home.iloc[i], np.int64)] = False
                out.append(np.flatnonzero(line).astype(np.int32))
        return pd.Series(out)

    sent = first.drop("floor").join(floors, "asked", "left").withColumn("floor", F.coalesce("reached", least))
    sent = sent.select("asked", "vec_id", "q", "floor", F.explode(reach("q", "home", "floor")).alias("ring"))
    found = home.select("asked", "vec_id", "score").unionByName(solve(common.materialize(sent, "sent")))
    return _ranked(found, k).select("asked", "rank", "vec_id", "score")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for those whose vec_id is divisible by 50."""
    vectors = quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return knn_join(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


# Every step stays in integers, so both engines agree to the last digit.
OP9_SQL = """
WITH good AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM good
),
s AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
