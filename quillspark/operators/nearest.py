"""A stated set of queries against all vectors, as products of blocks.

Every Arrow batch of vectors meets every block of queries where it lies, without a shuffle, and a pair of
blocks is one matrix product. What leaves a task is bounded by the queries and not by the pairs: each
query's best, or counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of queries, with what comes along, that are broadcast; beyond it the packed blocks of both sides meet by a join.
MOST_BROADCAST = 64 << 20
#: Queries in a block.
QUERIES = 1024
BLOCK = "wide int, ids array<long>, flat array<double>, sizes array<long>, own_scores array<double>, own_ids array<long>"


@dataclass
class Asked:
    """A block of queries of one dimension: ids, vectors, and for each query its own hits (cut: where they
    lie in scores and hits)."""

    ids: np.ndarray
    q: np.ndarray
    cut: np.ndarray
    scores: np.ndarray
    hits: np.ndarray

    @classmethod
    def of(cls, row) -> "Asked":
        array = lambda x, kind: np.asarray(x, kind)
        q = array(row.flat, np.float64).reshape(len(row.ids), row.wide)
        return cls(array(row.ids, np.int64), q, np.concatenate([[0], np.cumsum(array(row.sizes, np.int64))]), array(row.own_scores, np.float64), array(row.own_ids, np.int64))


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows query_id, q, own_scores, own_ids in blocks of one dimension."""
    for frame in frames:
        for wide, part in frame.groupby(frame["q"].map(len)):
            for lo in range(0, len(part), QUERIES):
                some = part.iloc[lo : lo + QUERIES]
                flat = lambda c, kind: np.concatenate([np.asarray(v, kind) for v in some[c]])  # noqa: B023, E731
                yield pd.DataFrame({
                    "wide": wide, "ids": [some["query_id"].to_numpy(np.int64)], "flat": [flat("q", np.float64)], "sizes": [some["own_ids"].map(len).to_numpy(np.int64)],
                    "own_scores": [flat("own_scores", np.float64)], "own_ids": [flat("own_ids", np.int64)],
                })


def _products(queries: DataFrame, vectors: DataFrame, use: Callable, kind: str) -> DataFrame:
    """use(block of queries, vector ids, scores to nine decimals (vector, query)) for each pair of blocks of
    one dimension."""
    spark = queries.sparkSession
    size = queries.agg(F.sum(8 * F.size("q") + 16 * F.size("own_ids") + 24)).first()[0] or 0
    packed = queries.where("query_id IS NOT NULL AND q IS NOT NULL").select(F.col("query_id").cast("long"), F.col("q").cast("array<double>").alias("q"), "own_scores", "own_ids").mapInPandas(_packed, BLOCK)
    held = vectors.where("chunk_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def meet(frame: pd.DataFrame, blocks: dict[int, list[Asked]]) -> Iterator[pd.DataFrame]:
        for wide, part in frame.groupby(frame["embedding"].map(len)):
            if wide in blocks:
                v = np.concatenate([np.asarray(x, np.float64) for x in part["embedding"]]).reshape(len(part), wide)
                for asked in blocks[wide]:
                    yield use(asked, part["chunk_id"].to_numpy(np.int64), np.round(v @ asked.q.T, 9) + 0.0)

    if size <= MOST_BROADCAST:
        told: dict[int, list[Asked]] = {}
        for row in packed.collect():  # `size` bytes, about
            told.setdefault(row.wide, []).append(Asked.of(row))
        shared = spark.sparkContext.broadcast(told)

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield from meet(frame, shared.value)

        return held.mapInPandas(near, kind)

    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                part = pd.DataFrame({"chunk_id": list(row.v_ids), "embedding": list(np.asarray(row.v_flat).reshape(len(row.v_ids), -1))})
                yield from meet(part, {row.wide: [Asked.of(row)]})

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for wide, part in frame.groupby(frame["embedding"].map(len)):
                yield pd.DataFrame({"v_wide": wide, "v_ids": [part["chunk_id"].to_numpy(np.int64)], "v_flat": [np.concatenate(part["embedding"].to_list())]})

    both = held.mapInPandas(blocks, "v_wide int, v_ids array<long>, v_flat array<double>").join(packed, F.col("wide") == F.col("v_wide"))
    return both.mapInPandas(pair, kind)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of each query's k best, ties to the smaller id."""
    least = -np.partition(-scores, min(k, len(ids)) - 1, axis=0)[min(k, len(ids)) - 1]
    at, who = np.nonzero(scores >= least)
    order = np.lexsort((ids[at], -scores[at, who], who))
    at, who = at[order], who[order]
    first = np.arange(len(who)) - np.searchsorted(who, who) < k
    return at[first], who[first]


def with_hits(queries: DataFrame, vectors: DataFrame, k: int, hits: DataFrame) -> DataFrame:
    """queries (query_id, q), vectors (chunk_id, embedding), hits (query_id, chunk_id, semantic, to nine
    decimals) -> query_id, chunk_id, semantic (of the nearest), semantic_rank for each query's k nearest
    vectors and for its hits, in one pass over the vectors.

    Only vectors of the query's dimension count; ties go to the smaller chunk_id. A hit's rank is one
    more than the vectors with a better score, or an equal one and a smaller chunk_id, which are counted
    block by block. Each query should have a bounded number of hits."""
    own = hits.groupBy("query_id").agg(F.collect_list(F.struct(F.col("semantic").alias("s"), "chunk_id")).alias("own"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    asked = queries.select("query_id", "q").join(own, "query_id", "left")
    asked = asked.select("query_id", "q", F.coalesce("own.s", none("double")).alias("own_scores"), F.coalesce("own.chunk_id", none("long")).alias("own_ids"))

    def both(block: Asked, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        at, who = _best(ids, scores, k)
        better = np.zeros(len(block.hits), np.int64)
        for i in np.flatnonzero(np.diff(block.cut)):
            a, b = block.cut[i], block.cut[i + 1]
            order = np.lexsort((ids, -scores[:, i]))
            line, sorted_ids = -scores[order, i], ids[order]
            low, high = (np.searchsorted(line, -block.scores[a:b], side) for side in ("left", "right"))
            better[a:b] = low + [np.searchsorted(sorted_ids[x:y], c) for x, y, c in zip(low, high, block.hits[a:b])]
        n, m = len(at), len(better)  # the nearest, then the hits
        return pd.DataFrame({
            "query_id": np.concatenate([block.ids[who], np.repeat(block.ids, np.diff(block.cut))]), "chunk_id": np.concatenate([ids[at], block.hits]),
            "semantic": np.concatenate([scores[at, who], np.zeros(m)]), "better": np.concatenate([np.zeros(n, np.int64), better]),
        }).assign(near=np.arange(n + m) < n)

    found = _products(asked, vectors, both, "query_id long, chunk_id long, semantic double, better long, near boolean")
    each = found.groupBy("query_id", "chunk_id").agg(F.max(F.when(F.col("near"), F.col("semantic"))).alias("semantic"), (F.sum(F.when(~F.col("near"), F.col("better"))) + 1).alias("counted"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("semantic"), "chunk_id")
    ranked = each.withColumn("rank", F.when(F.col("semantic").isNotNull(), F.row_number().over(order)))
    kept = ranked.where(F.col("counted").isNotNull() | (F.col("rank") <= k))
    return kept.select("query_id", "chunk_id", "semantic", F.coalesce("counted", F.col("rank").cast("long")).alias("semantic_rank"))


def top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """queries (query_id, q), vectors (chunk_id, embedding) -> query_id, rank, chunk_id, semantic: the k
    best of the query's dimension; ties to the smaller chunk_id."""

    def best(block: Asked, ids: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        at, who = _best(ids, scores, k)
        return pd.DataFrame({"query_id": block.ids[who], "chunk_id": ids[at], "semantic": scores[at, who]})

    asked = queries.select("query_id", "q", F.array().cast("array<double>").alias("own_scores"), F.array().cast("array<long>").alias("own_ids"))
    found = _products(asked, vectors, best, "query_id long, chunk_id long, semantic double")
    order = Window.partitionBy("query_id").orderBy(F.desc("semantic"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
