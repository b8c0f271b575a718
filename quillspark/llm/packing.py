"""Best-fit packing of token sequences by minimum bin slack.

Lengths lie between 1 and the capacity, so all that the packing needs to know is how many pieces of
each length there are: at most `capacity` numbers, however large the corpus. For that histogram the
bins are built one after another: a bin takes the longest length left, and a bitset subset-sum
dynamic programme over the lengths still available finds the combination that leaves the least
slack. The combination is removed as often as the counts allow, since until a length runs short the
programme would find the same one again; so the number of programmes is bounded by the capacity
and not by the corpus. Spark counts the lengths, ranks the pieces within their length and maps
(length, rank) to its place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0


def fullest(counts: list[int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to room, as length -> copies.

    One bitset holds the reachable sums; each length is added by binary splitting of its copies,
    longest first, so that among equally full combinations long pieces are used up early. It stops
    once the room can be filled exactly.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in range(min(room, len(counts) - 1), 0, -1):
        left = min(counts[n], room // n)
        part = 1
        while left > 0:
            k = min(part, left)
            wider = (reach | reach << (n * k)) & full
            if wider != reach:
                steps.append((n, k, reach))
                reach = wider
            left -= k
            part *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            used[n] = used.get(n, 0) + k
            total -= n * k
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, length -> copies in each of them) until nothing is left. Empty input: []."""
    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        counts[n] = c
    made, longest = [], capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return made
        counts[longest] -= 1
        used = fullest(counts, capacity - longest) if longest < capacity else {}
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        made.append((times, used))


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of each document: doc_id, piece, start, length and ids (binary: little-endian
    unsigned ids of 2 bytes if all ids of the vocabulary fit, else 4: its size over length tells). Null and empty texts have the end id alone; a text of more than `capacity`
    ids is cut into pieces of that length, the last one shorter. Other columns are left out."""
    path = common.tokenizer_path(tokenizer)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(path)
        for frame in frames:
            texts = ["" if not isinstance(t, str) else t for t in frame["text"]]
            for lo, hi in common.batches([len(t) for t in texts], 2_000_000):
                out = []
                for doc, ids in zip(frame["doc_id"].iloc[lo:hi], encoder.ids(texts[lo:hi])):
                    ids = np.append(ids, END_ID).astype(encoder.kind)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        out.append((doc, piece, start, len(part), part.tobytes()))
                made = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids"])
                yield made.astype({"doc_id": "Int64"})

    kind = "doc_id long, piece int, start long, length long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, kind)


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` between 1 and capacity.

    Rows of one length are interchangeable; their ranks come from a window over (length, salt),
    where the salt spreads a frequent length over all partitions, plus prefix sums of the counts.
    Rows are read twice, so the input should be a written table. Full pieces fill a sequence each.
    All columns come along; where rows has a column sequence_id or offset, the new one gets underscores
    in front.
    """
    salt, row, base, rank, at_, sequence, offset = (common.fresh(rows, x) for x in ("_salt", "_row", "_base", "_rank", "_at", "sequence_id", "offset"))
    spark = rows.sparkSession
    salts = 8 * common.parallelism(spark)
    order = [c for c in ("doc_id", "piece", "start") if c in rows.columns]
    salted = rows.withColumn(salt, F.pmod(F.xxhash64(*order, F.lit(11)), F.lit(salts)).cast("int"))
    sums = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counted = salted.groupBy("length", salt).agg(F.count("*").alias("n"))
    bases = common.materialize(counted.withColumn(base, F.coalesce(F.sum("n").over(sums), F.lit(0))), "length-counts")
    # At most `capacity` rows reach the driver.
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = plan(histogram, capacity)
    place = spark.sparkContext.broadcast(_places(made))
    within = Window.partitionBy("length", salt).orderBy(*order)
    ranked = (
        salted.withColumn(row, F.row_number().over(within))
        .join(bases.select("length", salt, base), ["length", salt])
        .withColumn(rank, F.col(base) + F.col(row) - 1)
    )

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def at(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, first, copies, bin_, inside = place.value
        key = length.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64)
        i = np.searchsorted(lengths << 44 | first, key, side="right") - 1
        r, n = rank.to_numpy(np.int64) - first[i], length.to_numpy(np.int64)
        return pd.DataFrame({"sequence_id": bin_[i] + r // copies[i], "offset": inside[i] + r % copies[i] * n})

    put = ranked.withColumn(at_, at("length", rank))
    return put.select(*rows.columns, F.col(f"{at_}.sequence_id").alias(sequence), F.col(f"{at_}.offset").alias(offset))


def _places(made: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, ...]:
    """Sorted by length and first rank: length, first rank, copies a bin, first bin, offset in it."""
    rows, bins, seen = [], 0, {}
    for times, used in made:
        inside = 0
        for n, k in sorted(used.items(), reverse=True):
            rows.append((n, seen.get(n, 0), k, bins, inside))
            seen[n] = seen.get(n, 0) + k * times
            inside += n * k
        bins += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack: the columns of pieces(), ids among them, with sequence_id and offset. An
    empty table gives no rows; repeated rows are packed as often as they occur; a null doc_id stays
    null; other columns of docs, whatever their names, are left out."""
    return pack(common.materialize(pieces(docs, tokenizer, capacity), "pieces"), capacity)


@F.pandas_udf(T.LongType())
def ids_crc32(ids: pd.Series, length: pd.Series) -> pd.Series:
    """Checksum of packed ids as unsigned 32-bit integers."""
    return pd.Series([zlib.crc32(np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes()) for x, n in zip(ids, length)], dtype="int64")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; the checksum is that of the packed ids."""
    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", ids_crc32("ids", "length").alias("ids_crc32"), "sequence_id", "offset")
