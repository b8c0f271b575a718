"""Uniform shuffle into shards of exact sizes, with DataFrame functions only.

The driver draws the small matrix of counts; rows never meet Python.

Rows lie in source partitions of known sizes. How many rows each partition sends to each shard is
drawn beforehand: the communication matrix of a uniform permutation follows the multivariate
hypergeometric law, so each partition draws from what the shards still lack. Then every partition
permutes its rows, deals them out by its row of the matrix, and every shard permutes what it got.

A row is known by where it is stored, its file and its place in it, and its random keys are hashes of
that, so equal rows are dealt out apart like any others. Sizes, permutations and counts are worked out
on the keys alone; of a source partition only the keys at its cuts are kept, by which a row then finds
its shard where it is read. So the texts cross the network once, each to its shard and range of slots.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 16
SEED = 20_26


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Number of good ones among `draws` without replacement, for any size.

    Probabilities relative to the mode are products of exact ratios of neighbours; they are taken
    twelve standard deviations to either side, beyond which less than 1e-30 is left, added up and
    inverted. So no large logarithms cancel, the probabilities sum to one by construction, and a draw
    is as fine as the uniform number it is made of.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    spread = math.sqrt(draws * share * (1 - share) * ((total - draws) / max(1, total - 1)))
    reach = int(12 * spread) + 40
    up = np.arange(mode, min(high, mode + reach), dtype=np.float64)  # from k to k + 1
    down = np.arange(mode, max(low, mode - reach), -1, dtype=np.float64)  # from k to k - 1
    rise = np.cumprod((good - up) / (up + 1) * ((draws - up) / (bad - draws + up + 1)))
    fall = np.cumprod(down / (good - down + 1) * ((bad - draws + down) / (draws - down + 1)))
    sums = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    return mode - len(fall) + int(np.searchsorted(sums, rng.random() * sums[-1], side="right").clip(0, len(sums) - 1))


def communication_matrix(sizes: list[int], shards: int, rng: random.Random) -> list[list[int]]:
    """For each source partition, the rows it sends to each shard. Shard sizes differ by one at most."""
    total = sum(sizes)
    lack = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in sizes:
        row, rest, left = [], n, sum(lack)
        for s in range(shards):
            k = hypergeometric(lack[s], left - lack[s], rest, rng)
            left -= lack[s]
            rest -= k
            row.append(k)
        lack = [a - b for a, b in zip(lack, row)]
        matrix.append(row)
    return matrix


def shard_uniform(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, stored: bool = False) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (gapless from 0 in each shard), written: files of a shard
    lie in its folder, each a range of its slots in order.

    The law is `rows`: counts of shards differ by one at most. Rows are placed one by one, so equal rows,
    equal texts, or rows of one key, are neither kept together nor dealt out alike. With `stored`, rows
    is a Parquet table of which columns and rows were only selected; it is read four times, three of them
    without any column. Other rows are written first, to have a place. An empty table gives no rows.
    Where rows has a column shard or slot, the new one gets underscores in front.
    """
    spark = rows.sparkSession
    if not stored:
        rows = common.materialize(rows, "rows")
    names = ("shard", "slot", "_part", "_rank", "_cut", "_cuts", "_none", "_fine", "_base", "_range", "_one", "_two", "_three", "_more")
    shard, slot, part, rank, cut, cuts, none, fine, base, range_, one, two, three, more = (common.fresh(rows, x) for x in names)
    n, ranges = max(256, 2 * common.parallelism(spark)), max(1, common.parallelism(spark) // shards)
    place = (F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    keyed = rows.withColumns({c: F.xxhash64(*place, F.lit(seed), F.lit(k)) for k, c in enumerate((one, two, three, more), 1)})
    keyed = keyed.withColumns({part: F.pmod(one, F.lit(n)).cast("int"), fine: F.pmod(F.shiftrightunsigned(three, 20), F.lit(ranges)).cast("int")})
    narrow = keyed.select(part, fine, two, more)
    # One number for each of n source partitions reaches the driver, and n rows of `shards` numbers go back.
    sizes = dict(narrow.groupBy(part).agg(F.count("*").alias("n")).collect())
    matrix = communication_matrix([sizes.get(p, 0) for p in range(n)], shards, random.Random(seed))
    ends = [(p, sum(row[: s + 1])) for p, row in enumerate(matrix) for s in range(shards)]
    before = spark.createDataFrame([(p, sum(e == 0 for e in of)) for p in range(n) for of in [[e for _, e in ends[p * shards : (p + 1) * shards]]]], f"{part} int, {none} int")
    ends = spark.createDataFrame([x for x in ends if x[1]], f"{part} int, {cut} long")
    # Each source partition is permuted by its second key; two hashes, so that no two rows share it.
    ranked = narrow.withColumn(rank, F.row_number().over(Window.partitionBy(part).orderBy(two, more)))
    held = ranked.join(F.broadcast(ends.withColumnRenamed(part, base)), (F.col(part) == F.col(base)) & (F.col(rank) == F.col(cut)))
    held = held.groupBy(part).agg(F.collect_list(F.struct(F.col(two).alias("two"), F.col(more).alias("more"))).alias(cuts))
    held = common.materialize(before.join(held, part, "left").select(part, none, F.coalesce(cuts, F.array()).alias(cuts)), "cuts")

    def send(df: DataFrame) -> DataFrame:
        """With the shard: how many of its source partition's cuts lie below the row."""
        own = F.struct(F.col(two).alias("two"), F.col(more).alias("more"))
        below = F.col(none) + F.size(F.filter(cuts, lambda c: c < own))
        return df.join(F.broadcast(held), part).withColumn(shard, below.cast("int")).drop(part, none, cuts)

    counts = {(r[0], r[1]): r[2] for r in send(narrow).groupBy(shard, fine).agg(F.count("*")).collect()}
    starts = []
    for s in range(shards):
        held_before = common.offsets([counts.get((s, f), 0) for f in range(ranges)]).tolist()
        starts += [(s * ranges + f, held_before[f]) for f in range(ranges)]
    starts = spark.createDataFrame(starts, f"{range_} int, {base} long")  # one row for each range of slots
    # The exchange: one task for each range of a shard, which permutes it by the third key.
    sent = send(keyed).withColumn(range_, F.col(shard) * ranges + F.col(fine)).select(*rows.columns, shard, range_, three, more)
    sent = sent.repartitionById(shards * ranges, range_)
    turn = F.row_number().over(Window.partitionBy(range_).orderBy(three, more))
    placed = sent.withColumn(rank, turn).join(F.broadcast(starts), range_).select(*rows.columns, shard, (F.col(base) + F.col(rank) - 1).alias(slot))
    path = common.scratch(spark, "shards")
    placed.write.partitionBy(shard).parquet(path)
    return spark.read.schema(placed.schema).parquet(path).select(*placed.columns)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; size and checksum are those of the texts in the shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = shard_uniform(docs, stored=True)
    text = F.coalesce("text", F.lit(""))
    return placed.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
