"""Vectors stored in cells with a table of bounds: exact nearest and exact ranks that read few cells.

A cell is the vectors nearest to one of some sampled pivots, and a partition of the stored table. For a
query q, a cell of radius r about its pivot c, and norms between a and b, no score v.q lies above
    min(c.q + |q| r, (|q|^2 + b^2 - max(0, |q - c| - r)^2) / 2)
nor below
    max(c.q - |q| r, (|q|^2 + a^2 - (|q - c| + r)^2) / 2).
A cell below a query's k-th best score is not read, and for a rank, which counts the vectors with a better
score, neither is one that lies above that score as a whole: its vectors are counted by the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import vectors as vx
from . import nearest

#: Pivots for each dimension at most; they grow with the root of the vectors until then.
MOST_CELLS = 4096
#: Vectors of a cell in one file; a cell of more (copies of one vector, say) is spread over several.
FILE = 1 << 18
#: Far above the error of a bound in doubles, for vectors of a norm of up to a thousand.
SLACK = 1e-7
TABLE = "cell int, center array<double>, radius double, low double, high double, n long"


@dataclass
class Cells:
    """vectors: chunk_id, embedding, cell (a partition each). table: cell, center, radius, low and high (the
    norms), n; at most MOST_CELLS rows for each dimension."""

    vectors: DataFrame
    table: DataFrame

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Cells":
        return cls(spark.read.schema("chunk_id long, embedding array<double>, cell int").parquet(f"{path}/vectors"), spark.read.schema(TABLE).parquet(f"{path}/table"))


def _matrix(lists) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in lists])


def build(vectors: DataFrame, path: str) -> Cells:
    """Write vectors (chunk_id, embedding) in cells under path. Those that are null, empty or hold what is
    not finite take no part. Pivots are those of the least hashed ids, of each dimension its own."""
    held = vectors.where(F.col("chunk_id").isNotNull() & vx.is_valid(F.col("embedding")))
    held = held.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    many = {r["w"]: min(math.ceil(math.sqrt(r["n"])), MOST_CELLS) for r in held.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).collect()}  # a row a dimension
    order = Window.partitionBy(F.size("embedding")).orderBy(F.xxhash64("chunk_id"), "chunk_id")
    drawn = held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(many.values(), default=1))
    pivots: dict[int, list] = {}
    for r in drawn.orderBy("place").collect():
        some = pivots.setdefault(len(r["embedding"]), [])
        if len(some) < many[len(r["embedding"])]:
            some.append(r["embedding"])
    first, told = 0, {}
    for wide, some in sorted(pivots.items()):
        told[wide] = (first, _matrix(some))
        first += len(some)
    sent = held.sparkSession.sparkContext.broadcast(told)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for wide, part in frame.groupby(frame["embedding"].map(len)):
                base, centers = sent.value[wide]
                v = _matrix(part["embedding"])
                near = np.argmax(v @ centers.T - (centers**2).sum(1) / 2, axis=1)
                away = np.sqrt(((v - centers[near]) ** 2).sum(1))
                yield part.assign(cell=(base + near).astype(np.int32), away=away, norm=np.sqrt((v**2).sum(1)))

    placed = shared.materialize(held.mapInPandas(assign, "chunk_id long, embedding array<double>, cell int, away double, norm double"), "placed")
    sizes = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"))
    centers = pd.DataFrame([(base + i, c) for base, some in told.values() for i, c in enumerate(some.tolist())], columns=["cell", "center"])
    centers = held.sparkSession.createDataFrame(centers, "cell int, center array<double>")
    table = sizes.join(centers, "cell").select("cell", "center", "radius", "low", "high", "n")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/table")
    counts = held.sparkSession.read.schema(TABLE).parquet(f"{path}/table").select("cell", "n")
    spread = F.pmod(F.xxhash64("chunk_id"), F.ceil(F.col("n") / FILE))
    dealt = placed.join(F.broadcast(counts), "cell").repartition("cell", spread)
    dealt.select("chunk_id", "embedding", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    return Cells.read(held.sparkSession, path)


class Bounds:
    """The table of one dimension as arrays."""

    def __init__(self, rows: list):
        self.cell, self.n = (np.array([r[c] for r in rows], np.int64) for c in ("cell", "n"))
        self.center = _matrix(r["center"] for r in rows)
        self.radius, self.low, self.high = (np.array([r[c] for r in rows], np.float64) for c in ("radius", "low", "high"))

    def of(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that a vector of each cell can have."""
        along, length = self.center @ q, math.sqrt(q @ q)
        apart = np.sqrt(((self.center - q) ** 2).sum(1))
        low = np.maximum(along - length * self.radius, (length**2 + self.low**2 - (apart + self.radius) ** 2) / 2)
        high = np.minimum(along + length * self.radius, (length**2 + self.high**2 - np.maximum(apart - self.radius, 0) ** 2) / 2)
        return low, high


def _bounds(cells: Cells):
    by: dict[int, list] = {}
    for r in cells.table.collect():  # at most MOST_CELLS rows a dimension
        by.setdefault(len(r["center"]), []).append(r)
    return cells.table.sparkSession.sparkContext.broadcast({wide: Bounds(rows) for wide, rows in by.items()})


def _parts(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts that may be broadcast."""
    size = queries.agg(F.sum(8 * F.size("q") + 24)).first()[0] or 0
    n = max(math.ceil(size / nearest.MOST_BROADCAST), 1)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def _opened(cells: Cells, pairs: DataFrame, use: Callable, kind: str) -> DataFrame:
    """use(rows of pairs that ask for the cell, their vectors as a matrix, ids, scores (vector, row)) for each
    Arrow batch of an opened cell. pairs: query_id, q, cells and more; they are broadcast, and only the
    partitions of cells that somebody asks for are read."""
    by: dict[int, list] = {}
    rows = pairs.where(F.size("cells") > 0).collect()  # part of the queries, see _parts
    for i, r in enumerate(rows):
        for c in r["cells"]:
            by.setdefault(c, []).append(i)
    sent = pairs.sparkSession.sparkContext.broadcast((rows, by))

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, by = sent.value
        for frame in frames:
            for cell, part in frame.groupby("cell"):
                asked = [rows[i] for i in by[cell]]
                scores = np.round(_matrix(part["embedding"]) @ _matrix(r["q"] for r in asked).T, 9) + 0.0
                yield use(asked, part["chunk_id"].to_numpy(np.int64), scores)

    return cells.vectors.where(F.col("cell").isin(list(by))).mapInPandas(meet, kind)


def _usable(queries: DataFrame) -> DataFrame:
    held = queries.where(F.col("query_id").isNotNull() & vx.is_valid(F.col("q")))
    return held.withColumns({"query_id": F.col("query_id").cast("long"), "q": F.col("q").cast("array<double>")})


def top(queries: DataFrame, cells: Cells, k: int) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, q) -> query_id, rank, chunk_id, semantic (to nine decimals), as nearest.top has
    them, and query_id, cells (of its dimension), opened.

    The cells that can have the best scores are opened first, as many as hold k vectors; the k-th score
    in them closes all others but those that can reach it."""
    bounds = _bounds(cells)

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                b = bounds.value.get(len(r.q))
                if b is None:
                    out.append((r.query_id, r.q, 0, [], [], []))
                    continue
                high = b.of(np.asarray(r.q))[1]
                order = np.lexsort((b.cell, -high))
                seeds = int(np.searchsorted(np.cumsum(b.n[order]), k)) + 1
                out.append((r.query_id, r.q, len(order), b.cell[order[:seeds]], b.cell[order[seeds:]], high[order[seeds:]]))
            yield pd.DataFrame(out, columns=["query_id", "q", "all", "cells", "later", "high"])

    def best(asked: list, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        at, who = nearest._best(ids, scores, k)
        return pd.DataFrame({"query_id": np.array([r["query_id"] for r in asked], np.int64)[who], "chunk_id": ids[at], "semantic": scores[at, who]})

    order = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "chunk_id")
    kind = "query_id long, chunk_id long, semantic double"
    hits, told = [], []
    for part in _parts(_usable(queries)):
        planned = part.select("query_id", "q").mapInPandas(plan, "query_id long, q array<double>, all long, cells array<int>, later array<int>, high array<double>")
        planned = shared.materialize(planned, "planned")
        seen = shared.materialize(_opened(cells, planned.select("query_id", "q", "cells"), best, kind), "seen")
        last = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("semantic").alias("last"))
        able = F.filter(F.arrays_zip("later", "high"), lambda c: F.col("last").isNull() | (c["high"] >= F.col("last") - SLACK))
        others = planned.join(last, "query_id", "left").select("query_id", "q", F.transform(able, lambda c: c["later"]).alias("cells"))
        others = shared.materialize(others, "others")
        hits.append(seen.unionByName(_opened(cells, others, best, kind)))
        more = others.select("query_id", F.size("cells").alias("more"))
        told.append(planned.join(more, "query_id").select("query_id", F.col("all").alias("cells"), (F.size("cells") + F.col("more")).cast("long").alias("opened")))
    ranked = _union(hits).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "chunk_id", "semantic"), _union(told)


def ranks(queries: DataFrame, cells: Cells, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, q; ids unique) and hits (query_id, chunk_id, semantic, to nine decimals) ->
    query_id, chunk_id, semantic_rank: one more than the vectors of the query's dimension with a better
    score, or an equal one and a smaller chunk_id; and query_id, cells, opened. Each query should have a
    bounded number of hits, as from a keyword search."""
    bounds = _bounds(cells)
    own = hits.where("semantic IS NOT NULL").groupBy("query_id").agg(F.collect_list(F.struct(F.col("semantic").alias("s"), "chunk_id")).alias("own"))
    asked = _usable(queries).select("query_id", "q").join(own, "query_id").select("query_id", "q", F.col("own.s").alias("scores"), F.col("own.chunk_id").alias("ids"))

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                b, s = bounds.value.get(len(r.q)), np.asarray(r.scores)
                if b is None:
                    continue
                low, high = b.of(np.asarray(r.q))
                above = low[:, None] > s + SLACK
                some = ~above & (high[:, None] >= s - SLACK)
                opened = some.any(1)
                # Of cells that are opened for another hit, all are counted there.
                out.append((r.query_id, r.q, r.scores, r.ids, len(low), b.cell[opened], (b.n[:, None] * (above & ~opened[:, None])).sum(0)))
            yield pd.DataFrame(out, columns=["query_id", "q", "scores", "ids", "all", "cells", "whole"])

    def better(asked: list, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        out = []
        for i, r in enumerate(asked):
            order = np.lexsort((ids, -scores[:, i]))
            line, sorted_ids, own = -scores[order, i], ids[order], -np.asarray(r["scores"])
            low, high = np.searchsorted(line, own, "left"), np.searchsorted(line, own, "right")
            n = low + [np.searchsorted(sorted_ids[x:y], c) for x, y, c in zip(low, high, r["ids"])]
            out.append(pd.DataFrame({"query_id": r["query_id"], "chunk_id": r["ids"], "n": n}))
        return pd.concat(out)

    found, told = [], []
    for part in _parts(asked):
        planned = part.mapInPandas(plan, "query_id long, q array<double>, scores array<double>, ids array<long>, all long, cells array<int>, whole array<long>")
        planned = shared.materialize(planned, "planned")
        whole = planned.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("chunk_id"), F.col("whole").alias("n"))))
        found.append(whole.unionByName(_opened(cells, planned.select("query_id", "q", "scores", "ids", "cells"), better, "query_id long, chunk_id long, n long")))
        told.append(planned.select("query_id", F.col("all").alias("cells"), F.size("cells").cast("long").alias("opened")))
    counted = _union(found).groupBy("query_id", "chunk_id").agg((F.sum("n") + 1).alias("semantic_rank"))
    return counted, _union(told)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
