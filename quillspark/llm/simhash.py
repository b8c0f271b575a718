"""Near duplicates by SimHash fingerprints and a self-join of binary tries.

Two fingerprints that differ in at most `budget` bits agree wholly in all but `budget` of `blocks`
blocks. For each choice of blocks that may agree, fingerprints are dealt out by those blocks: they
form the upper levels of a trie whose subtries meet in one task each. There the trie is joined with
itself: pairs of nodes are followed level by level, differing bits add up, and a pair is pruned when
they exceed the budget. A task keeps only what connects its fingerprints, not all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components

BITS = 64
#: Fingerprints of a bucket that one task joins; a fuller bucket is split.
BUCKET = 200_000
#: Shingle hashes held before they are added up, bytes of a text whose words are taken at a time, and texts
#: taken out of an Arrow batch.
SHINGLES, RUN, ROWS = 1 << 18, 1 << 20, 256
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _runs(text: bytes, words: int) -> Iterator[list[bytes]]:
    """The words of a text in runs that overlap by words - 1, so that every shingle lies in one of them; one
    run of all words if there are fewer. bytes.lower() changes A-Z only, bytes.split() cuts at x20 and
    x09 to x0D."""
    held, at, some = [], 0, False
    while at < len(text):
        gap = _GAP.search(text, at + RUN) if len(text) - at > RUN else None
        end = gap.start() if gap else len(text)
        held += text[at:end].lower().split()
        at = end
        if len(held) >= words:
            yield held
            held, some = held[len(held) - words + 1 :], True
    if held and not some:
        yield held


def fingerprints(texts: list[bytes], words: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: word shingles hashed by XXH64 with seed 42, repeats included; a
    bit is set if over half of the hashes have it. No words: zero. However long a text is, SHINGLES
    hashes and the words of RUN bytes are held."""
    over, count = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    hashes, sizes, owner = [], [], []

    def flush() -> None:
        if hashes:
            flat = np.array(hashes, np.uint64)
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = common.offsets(sizes)
            # Sums of at most 255 rows stay in bytes, so long texts are added up in two steps.
            cut = np.unique(np.concatenate([starts[:-1], np.arange(0, len(flat), 255)]))
            part = np.add.reduceat(bits, cut, axis=0, dtype=np.uint8)
            total = np.add.reduceat(part, np.searchsorted(cut, starts[:-1]), axis=0, dtype=np.int64)
            np.add.at(over, owner, total)
            np.add.at(count, owner, sizes)
            hashes.clear(), sizes.clear(), owner.clear()

    for i, text in enumerate(texts):
        for w in _runs(text, words):
            shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
            before = len(hashes)
            hashes.extend([digest(s, 42) for s in shingles])
            sizes.append(len(hashes) - before)
            owner.append(i)
            if len(hashes) > SHINGLES:
                flush()
    flush()
    return np.packbits(over * 2 > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


@F.arrow_udf(T.LongType())
def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield pa.array(fingerprints(common.encode(batch.slice(at, ROWS).to_pylist())).view(np.int64))


#: Pairs of nodes that are followed at a time.
PAIRS = 1 << 17


def trie_forest(values: np.ndarray, depth: int, budget: int = 3) -> np.ndarray:
    """For each of sorted distinct values that share all bits above `depth`, in groups, the smallest
    index that it reaches over links of at most budget bits. Nodes of the trie are ranges of values.

    Pairs of nodes lie on a stack and are followed in bounded pieces; links are united as they are
    found, and a pair of nodes whose values are known to be connected already is dropped. So neither
    pairs of values nor of nodes pile up, however many are close together.
    """
    n = len(values)
    forest = _Forest(n)
    if n < 2:
        return forest.root
    top = values >> np.uint64(depth) if depth < 64 else np.zeros(n, np.uint64)
    start = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
    end = np.append(start[1:], n)
    stack = [(depth - 1, start, end, start, end, np.zeros(len(start), np.int64))]
    while stack:
        level, *pairs = stack.pop()
        if len(pairs[0]) > PAIRS:
            stack.append((level, *(x[PAIRS:] for x in pairs)))
            pairs = [x[:PAIRS] for x in pairs]
        open_ = ~forest.connected(*pairs[:4])
        a0, a1, b0, b1, err = (x[open_] for x in pairs)
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            forest.unite(i[near], j[near])
            a0, a1, b0, b1, err = (x[~single] for x in (a0, a1, b0, b1, err))
        if not len(a0) or level < 0:
            continue
        am, bm = (_half(values, x0, x1, level) for x0, x1 in ((a0, a1), (b0, b1)))
        off = np.flatnonzero(a0 != b0)
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), tuple(x[off] for x in (am, a1, b0, bm, err + 1))]
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts))
        keep = (a1 > a0) & (b1 > b0) & (err <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        stack.append((level - 1, *(x[keep] for x in (a0, a1, b0, b1, err))))
    return forest.root


def _half(values: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
    """Where the bit at `level` turns to one in each range of values, by bisection."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        one = (values[np.minimum(mid, len(values) - 1)] >> np.uint64(level) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


class _Forest:
    """Components of indexes, with a quick test whether ranges are connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self._turns = None

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Only the roots of what is linked meet; then every index takes its root's new one."""
        a, b = self.root[a], self.root[b]
        apart = a != b
        if apart.any():
            a, b = a[apart], b[apart]
            met = np.unique(np.concatenate([a, b]))
            new = np.arange(len(self.root))
            new[met] = met[spanning(len(met), np.searchsorted(met, a), np.searchsorted(met, b))]
            self.root = new[self.root]
            self._turns = None

    def connected(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Whether all values of both ranges are in one component."""
        if self._turns is None:
            self._turns = common.offsets(self.root[1:] != self.root[:-1])
        even = (self._turns[a1 - 1] == self._turns[a0]) & (self._turns[b1 - 1] == self._turns[b0])
        return even & (self.root[a0] == self.root[b0])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over links (a, b), by repeated halving."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _gather(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The fingerprints with the given bits, from the highest, in front order."""
    out = np.zeros(len(values), np.uint64)
    for b in bits:
        out = out << np.uint64(1) | (values >> np.uint64(b) & np.uint64(1))
    return out


def _choices(bits: list[int], blocks: int, budget: int) -> list[list[int]]:
    """The bits (highest first) of each choice of blocks of `bits` that may agree wholly."""
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    return [[b for k in kept for b in bits[edges[k] : edges[k + 1]]] for kept in combinations(range(blocks), blocks - budget)]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits) - ((1 << 64) if BITS - 1 in bits else 0)


def link_fingerprints(prints: DataFrame, budget: int = 3, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """prints (fp long, distinct) -> links (a, b) whose components are those of all pairs within
    budget bits.

    More blocks give more copies (blocks choose budget) with longer keys; by default there are as many
    as the number of fingerprints asks for. A bucket of more than `bucket` fingerprints is dealt out
    once more by blocks of the bits that its key lacks, which loses no link for the same reason. Tasks take
    buckets one after another, and there are as many tasks as the fingerprints ask for.
    """
    if blocks is None:
        n = prints.count()
        blocks = budget + (1 if n <= 1 << 24 else 2 if n <= 1 << 32 else 3)
    every = list(range(BITS - 1, -1, -1))
    fronts = _choices(every, blocks, budget)
    finer = [_choices([b for b in every if b not in front], budget + 1, budget) for front in fronts]
    key = lambda c, bits: F.struct(F.lit(c).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("key"))
    copies = prints.select("fp", F.explode(F.array(*(key(c, front) for c, front in enumerate(fronts)))).alias("k")).select("k.choice", "k.key", "fp")
    # Full buckets: map-side counts, one row for each; few, as each has over `bucket` of the copies.
    full = copies.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
    full = common.materialize(full.select("choice", "key", F.lit(True).alias("full")), "full-buckets")
    split, lists = [], list(fronts)
    for c, front in enumerate(fronts):
        for more in finer[c]:
            split.append((c, len(lists)))
            lists.append(front + more)
    if full.limit(1).count():
        marked = copies.join(full, ["choice", "key"], "left")
        turned = F.array(*(F.when(F.col("choice") == c, key(to, lists[to])) for c, to in split))
        again = marked.where("full").select("fp", F.explode(F.filter(turned, lambda x: x.isNotNull())).alias("k")).select("k.choice", "k.key", "fp")
        copies = marked.where("full IS NULL").select("choice", "key", "fp").unionByName(again)

    def linked(choice: int, prints: np.ndarray) -> pd.DataFrame:
        values = np.unique(prints.view(np.uint64))
        front = lists[choice]
        rest = [b for b in every if b not in front]
        turned = _gather(values, front + rest)
        order = np.argsort(turned)
        values, turned = values[order], turned[order]
        root = trie_forest(turned, len(rest), budget)
        moved = np.flatnonzero(root != np.arange(len(values)))
        return pd.DataFrame({"a": values[moved].view(np.int64), "b": values[root[moved]].view(np.int64)})

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Buckets come one after another; those of one choice are joined together, up to `bucket` prints of
        them, or one fuller bucket."""
        choice, held, size = -1, [], 0
        for frame in frames:
            c, k, fp = (frame[x].to_numpy(np.int64) for x in ("choice", "key", "fp"))
            cut = np.flatnonzero((c[1:] != c[:-1]) | (k[1:] != k[:-1])) + 1  # where a bucket begins
            for at, to in zip([0, *cut], [*cut, len(c)]):
                new = not held or (c[at], k[at]) != last
                if held and new and (c[at] != choice or size + to - at > bucket):
                    yield linked(choice, np.concatenate(held))
                    held, size = [], 0
                choice, last = c[at], (c[at], k[at])
                held.append(fp[at:to])
                size += to - at
        if held:
            yield linked(choice, np.concatenate(held))

    n = max(2 * common.parallelism(prints.sparkSession), prints.count() * len(fronts) // (4 * bucket))
    return copies.repartition(n, "choice", "key").sortWithinPartitions("choice", "key").mapInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = 3, blocks: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, fp (long), component_id (smallest doc_id reachable over links of
    at most `budget` bits, itself included).

    Null and empty texts have fingerprint zero, which links like any other. A null doc_id gets the
    smallest non-null doc_id of its component, null if there is none. Equal rows stay separate. With
    names of columns to carry, these and `class` (one fingerprint for each component) come too.
    Copies meet in a map-side aggregate; a frequent fingerprint is split by Spark's skew join.
    """
    rows = common.materialize(docs.select(F.col("doc_id").cast("long"), fingerprint(F.col("text").cast("string")).alias("fp"), *carry), "fingerprints")
    prints = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(link_fingerprints(prints.select("fp"), budget, blocks)).withColumnRenamed("node", "fp")
    linked = common.materialize(prints.join(roots, "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(least, "root").select("fp", "least", "root")
    classes = common.materialize(prints.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("class")), "classes")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id", *((*carry, "class") if carry else ()))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the component it is in."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
