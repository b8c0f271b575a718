"""Exact best keyword hits from postings in blocks, most of which are never opened.

Chunks lie in blocks of about SIZE, of one scope and of like length, and a row of the index holds the
postings of a term in a block, with the largest weighted frequency and the least length among them. A
score grows with the one and falls with the other, so the two bound what any chunk of the block can
have from the term, whatever the mean length is by then, and the sum over a question's terms bounds
the block. The blocks with the best bounds are opened first; the score of the last place that they fill
rules out every block whose bound is lower. No list of postings is read for these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from . import search

#: Chunks of a block, on average.
SIZE = 32
#: Sums in another order differ far less than this, and ranks go by nine decimals.
SLACK = 1e-7
ENTRIES = "array<struct<chunk_id: bigint, wtf: double, tf: bigint, dl: bigint>>"


@dataclass
class Found:
    """hits: query_id, chunk_id, keyword_rank, bm25 and the columns of the scope. blocks: for each query with
    any term in the index query_id, blocks (that have a term of it) and opened."""

    hits: DataFrame
    blocks: DataFrame


def blocks_of(postings: DataFrame, near: tuple[str, ...] = ()) -> DataFrame:
    """postings (term, chunk_id, wtf, tf, dl, and columns `near`: chunks that differ in them share no block)
    -> term, scope (hash of `near`), block, most (largest wtf), least (smallest dl), hits, entries.

    postings are read twice, so they should be a written table. A chunk's shares tf / dl add up to one,
    which counts the chunks of a class of lengths where the postings lie."""
    scope = F.xxhash64(*near) if near else F.lit(0).cast("long")
    kind = F.floor(4 * F.log2(F.greatest(F.col("dl"), F.lit(1)).cast("double")))
    keyed = postings.select("term", "chunk_id", "wtf", "tf", "dl", scope.alias("scope"), kind.alias("kind"))
    sizes = shared.materialize(keyed.groupBy("scope", "kind").agg(F.round(F.sum(F.col("tf") / F.col("dl"))).cast("long").alias("n")), "classes")
    sizes = search.small(sizes)
    spread = F.pmod(F.xxhash64("chunk_id"), F.greatest(F.ceil(F.col("n") / SIZE), F.lit(1)))
    dealt = keyed.join(sizes, ["scope", "kind"]).withColumn("block", F.xxhash64("scope", "kind", spread))
    entry = F.struct("chunk_id", "wtf", "tf", "dl")
    each = dealt.groupBy("term", "scope", "block").agg(F.max("wtf").alias("most"), F.min("dl").alias("least"), F.count("*").alias("hits"), F.array_sort(F.collect_list(entry)).alias("entries"))
    return each.withColumn("entries", F.col("entries").cast(ENTRIES))


def postings_of(blocks: DataFrame) -> DataFrame:
    """The single postings: term, scope, chunk_id, wtf, tf, dl."""
    return blocks.select("term", "scope", F.inline("entries"))


def top(queries: DataFrame, blocks: DataFrame, index: search.Index, scope: DataFrame, limit: int = search.KEYWORD_LIMIT) -> Found:
    """The `limit` best chunks of the scope (chunk_id and what is to come along) for each query, exactly as
    search.keyword_ranks has them. Statistics are those of the index; of blocks, those that can hold
    chunks of the scope will do.

    A query whose first blocks hold fewer than `limit` chunks of the scope rules nothing out. Every step
    groups by query and block or query and chunk, so no frequent term fills one task; a window sees at
    most `limit` blocks and hits of a query from each task."""
    terms, impact = search.asked_terms(queries, index)
    terms = search.small(shared.materialize(terms, "asked"))
    met = blocks.join(terms, "term")
    best = impact(F.col("most"), F.col("least"))
    # Of a block's hits those count whose word adds the most: they fill places with scores worth having.
    bounds = shared.materialize(met.groupBy("query_id", "block").agg(F.sum(best).alias("bound"), F.max_by("hits", best).alias("hits")), "bounds")

    def scores(some: DataFrame) -> DataFrame:
        held = met.join(search.small(some.select("query_id", "block")), ["query_id", "block"])
        each = held.select("query_id", "times", "idf", F.inline("entries"))
        return each.groupBy("query_id", "chunk_id").agg(F.sum(impact(F.col("wtf"), F.col("dl"))).alias("bm25"))

    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    before = F.coalesce(F.sum("hits").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)  # a block has a hit at least
    first = shared.materialize(first.withColumn("before", before).where(F.col("before") < limit).select("query_id", "block"), "first")
    seen = shared.materialize(scores(first), "seen")
    last = search.keyword_ranks(seen, scope.select("chunk_id"), limit).where(F.col("keyword_rank") == limit)
    last = last.select("query_id", F.round("bm25", 9).alias("last"))
    others = bounds.join(search.small(first), ["query_id", "block"], "left_anti").join(last, "query_id", "left")
    others = shared.materialize(others.where("last IS NULL OR bound >= last - " + str(SLACK)).select("query_id", "block"), "others")
    hits = search.keyword_ranks(seen.unionByName(scores(others)), scope, limit)
    opened = first.unionByName(others).groupBy("query_id").agg(F.count("*").alias("opened"))
    return Found(hits, bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(opened, "query_id"))
