"""Hard negatives by Fagin's threshold algorithm.

Vectors of integers are stored in blocks, in the order of their labels, and each block with one sorted
list of its candidates for every dimension. An anchor reads these lists side by side, from the end that
its own component's sign makes the better one, and takes the score of every vector it meets for the
first time by random access. What the lists still hide scores at most the threshold, the sum of the
anchor's components times the values last read. An anchor has windows of scores, each of which wants
its k best; it stops once the threshold lies strictly below the k-th score of every window (so all ties
have been met), or below the window itself.

It runs twice: for an anchor's positives, with one open window over the blocks of its label, and for
the negatives, with a window below each positive over the vectors of other labels. Every block gives
its own k best, of which Spark ranks the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .merkle import ranked

K = 5
STEP, EVERY, MOVED, LABELS = 256, 100, 7, 10
#: A negative scores at least so many hundredths of the positive.
LEAST = 80
#: Vectors of a block, anchors that one task solves against it, and depth of the first reading.
BLOCK, ANCHORS, FIRST = 4096, 1024, 64
EXACT = float(1 << 53)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "asked long, place int, vec_id long, score long"
LISTS = "wide int, block long, n int, kind string, ids binary, labels binary, flat binary, lists binary"


def prepare(embeddings: DataFrame, moved: int = MOVED, labels: int = LABELS) -> DataFrame:
    """vec_id, label, q (array<long>): floor(256 x) of each component as double, and the label moved on by
    one (modulo `labels`) where `moved` divides vec_id. Rows with a null vec_id, label, vector or component
    and those with a component that is not finite are left out; rows that repeat all three count once."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & good)
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return held.select("vec_id", label.alias("label"), F.transform("embedding", lambda v: F.floor(v * float(STEP))).alias("q")).distinct()


def _narrow(a: np.ndarray) -> np.ndarray:
    """Integers in as few bytes as hold them."""
    most = max(abs(int(a.min())), abs(int(a.max()))) if a.size else 0
    return a.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def _listed(part: pd.DataFrame) -> pd.DataFrame:
    """One block: ids ascending, labels, the vectors, and for each dimension the rows by ascending value."""
    part = part.sort_values("vec_id", kind="stable")
    wide, n = int(part["wide"].iloc[0]), len(part)
    q = np.stack(part["q"].to_numpy()).astype(np.int64).reshape(n, wide)
    flat = _narrow(q)
    lists = np.argsort(q, axis=0, kind="stable").T.astype("<u2" if n <= 1 << 16 else "<u4")
    row = [wide, int(part["block"].iloc[0]), n, flat.dtype.str, *(x.tobytes() for x in (part["vec_id"].to_numpy("<i8"), part["label"].to_numpy("<i8"), flat, np.ascontiguousarray(lists)))]
    return pd.DataFrame([row], columns=[c.split(" ")[0] for c in LISTS.split(", ")])


def lists_of(rows: DataFrame, block: int = BLOCK, keep: int = K + 1) -> tuple[DataFrame, DataFrame]:
    """(written blocks, labels: wide, label, first and last block) of the rows of prepare(). Of rows with
    one vector and label only the `keep` smallest ids can be among the best, so the others are left
    out, and a frequent vector makes no large group."""
    same = Window.partitionBy("q", "label").orderBy("vec_id")
    held = rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= keep).drop("_r").withColumn("wide", F.size("q"))
    order = [F.col(c) for c in ("wide", "label", "vec_id")] + [F.xxhash64("q")]
    placed = ranked(held, order, "at").select("vec_id", "label", "q", "wide", F.floor(F.col("at") / block).alias("block"))
    placed = common.materialize(placed, "placed")
    labels = placed.groupBy("wide", "label").agg(F.min("block").alias("first"), F.max("block").alias("last"))
    lists = placed.groupBy("wide", "block").applyInPandas(_listed, LISTS)
    return common.materialize(lists, "lists"), common.materialize(labels, "labels")


class Lists:
    """A block in memory."""

    def __init__(self, row):
        n, self.wide = row.n, row.wide
        self.ids, self.labels = (np.frombuffer(x, "<i8") for x in (row.ids, row.labels))
        self.flat = np.frombuffer(row.flat, row.kind).reshape(n, self.wide).astype(np.int64)
        self.most = float(np.abs(self.flat).max()) if self.flat.size else 0.0
        self.double = self.flat.astype(np.float64)
        self.lists = np.frombuffer(row.lists, "<u2" if n <= 1 << 16 else "<u4").reshape(self.wide, n)

    def best(self, anchor: np.ndarray, free: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[list[np.ndarray], np.ndarray, int]:
        """For each window (lowest and highest score) the places of its k best among the free rows, best
        first; the scores; and how many rows were scored.

        anchor: integers; free: the rows that may be found."""
        n = len(self.ids)
        exact = self.most * float(np.abs(anchor).max(initial=0)) * self.wide < EXACT
        rows, own = (self.double, anchor.astype(np.float64)) if exact else (self.flat, anchor)
        score, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        up, down = np.flatnonzero(anchor < 0), np.flatnonzero(anchor > 0)
        open_, depth, step = list(range(len(windows))), 0, FIRST
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(windows)
        if not len(up) and not len(down):  # every score is zero, and no list tells more
            depth, seen = n, ~seen
        while open_:
            if depth < n:
                # Sorted access: as far again in every list, from its better end.
                to = min(depth + step, n)
                met = np.concatenate([self.lists[up, depth:to].ravel(), self.lists[down, n - to : n - depth].ravel()])
                new = np.zeros(n, bool)
                new[met] = True
                new = np.flatnonzero(new & ~seen)
                seen[new] = True
                score[new] = rows[new] @ own  # random access
                depth, step = to, 2 * step
            if depth >= n:
                threshold = None  # nothing is hidden
            else:
                last = np.concatenate([self.flat[self.lists[up, depth - 1], up], self.flat[self.lists[down, n - depth], down]])
                threshold = sum(map(int.__mul__, last.tolist(), np.concatenate([anchor[up], anchor[down]]).tolist()))
            for w in list(open_):
                low, high = windows[w]
                if threshold is not None and threshold >= high:
                    continue
                at = np.flatnonzero(seen & free & (score >= low) & (score <= high))
                if len(at) > k:
                    least = np.partition(score[at], len(at) - k)[len(at) - k]
                    at = at[score[at] >= least]
                if threshold is None or threshold < low or (len(at) >= k and threshold < int(score[at].min())):
                    found[w] = at[np.argsort(-score[at], kind="stable")[:k]]  # rows ascend by id
                    open_.remove(w)
        return found, score, int(seen.sum())


def solve(sent: DataFrame, lists: DataFrame, parts: int, k: int, visited=None) -> DataFrame:
    """sent (asked, own, label, other, q, wide, block, lows, highs), lists -> asked, place (of the window),
    vec_id, score: each block's k best in every window, among vectors of the anchor's label, or of other
    labels where `other`. `visited`, an accumulator, counts the vectors that were scored."""
    part = F.pmod(F.xxhash64("asked", F.lit(7)), F.lit(parts)).cast("int")
    left = sent.withColumn("part", part)
    right = lists.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def local(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in held.itertuples(index=False):
            block = Lists(row)
            for a in asked.itertuples(index=False):
                free = ((block.labels != a.label) if a.other else (block.labels == a.label)) & (block.ids != a.own)
                if not free.any():
                    continue
                windows = list(zip(np.asarray(a.lows).tolist(), np.asarray(a.highs).tolist()))
                found, score, n = block.best(np.asarray(a.q, np.int64), free, windows, k)
                if visited is not None:
                    visited.add(n)
                out += [(a.asked, w, block.ids[i], score[i]) for w, at in enumerate(found) for i in at]
        return pd.DataFrame(out, columns=["asked", "place", "vec_id", "score"])

    pairs = left.groupBy("wide", "block", "part").cogroup(right.groupBy("wide", "block", "part"))
    return pairs.applyInPandas(local, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, every: int = EVERY, k: int = K, least: int = LEAST, block: int = BLOCK, visited=None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the prepared rows whose vec_id `every` divides; their positives the k best others of
    their label, the negatives of each the k best of other labels that score between `least` hundredths
    of the positive and the positive; ties go to the smaller vec_id, fewer rows give fewer. A positive
    of negative score has no such window. Others are rows of another vec_id and of the anchor's
    dimension. Rows that repeat a vec_id with another vector or label stand for themselves: each is a
    candidate and an anchor of its own. Scores must fit 64 bits. Empty tables give no rows; other
    columns are left out.
    """
    spark = embeddings.sparkSession
    rows = common.materialize(prepare(embeddings), "vectors")
    anchors = common.materialize(rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("asked"), F.col("vec_id").alias("own"), "label", "q", F.size("q").alias("wide")), "anchors")
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    parts = -(-n // ANCHORS)
    lists, labels = lists_of(rows, block, k + 1)
    end = F.lit((1 << 63) - 1)
    turn = lambda a, b: F.explode(F.sequence(F.col(a), F.col(b))).alias("block")
    # One row for each label: its blocks lie side by side.
    asking = anchors.join(labels, ["wide", "label"]).select("asked", "own", "label", F.lit(False).alias("other"), "q", "wide", turn("first", "last"), F.array(-end).alias("lows"), F.array(end).alias("highs"))
    positives = common.materialize(_first(solve(asking, lists, parts, k, visited), k).select("asked", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most k windows for each anchor, in the order of their ids.
    wanted = positives.where("positive_score >= 0").groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("positive_id", "positive_score"))).alias("w"))
    # Hundredths, rounded up, without large products.
    low = F.expr(f"transform(w.positive_score, s -> (s div 100) * {least} + ((s % 100) * {least} + 99) div 100)")
    every_block = labels.groupBy("wide").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    asking = anchors.join(wanted, "asked").join(every_block, "wide").select("asked", "own", "label", F.lit(True).alias("other"), "q", "wide", turn("first", "last"), low.alias("lows"), F.col("w.positive_score").alias("highs"))
    found = _first(solve(asking, lists, parts, k, visited), k)
    named = wanted.select("asked", F.posexplode("w").alias("place", "p")).join(anchors.select("asked", F.col("own").alias("anchor_id")), "asked")
    return found.join(named, ["asked", "place"]).select(
        "anchor_id", F.col("p.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        F.col("p.positive_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector, for each of its five positives."""
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


# Every step stays in integers, so both engines agree to the last digit.
OP12_SQL = """
WITH good AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, a.q, a.label, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, q, label, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id, q, label ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id, q, label) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, q, label, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
