"""Quality classifier with supervised subword embeddings, in numpy.

Every word, every pair of neighbouring words and every character n-gram (within a word and its borders)
are hashed to rows of an embedding table; pairs of a word with itself share one row, whichever word it
is. A document is the average of its rows, and a softmax layer over it gives the label.
Rows and layer are trained together by stochastic gradient descent. Average and layer are linear, so
a text is scored by one number for each row: its share of the difference of the two logits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .language import softmax

BUCKETS = 1 << 17
DIMENSION = 8
GRAMS = (3, 4, 5)
#: Bounds of what is learned from: documents of each label, and bytes of their whole texts.
SAMPLE = 2000
SAMPLE_BYTES = 3_000_000
EPOCHS = 5
THRESHOLD = 0.7

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Stands for any pair of equal words.
REPEAT = np.uint32(0x51ED270B)
_PRIME = np.uint32(0x01000193)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows, places in the joined texts, ascending) of n-grams of each size, of words
    and of word pairs; the last pair holds the bounds of the texts, twice. Texts are framed by spaces."""
    line = np.frombuffer(b" " + b"  ".join(texts) + b" " * 8, np.uint8)
    space = _SPACE[line]
    bounds = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])]) if texts else np.zeros(1, np.int64)
    flat = np.where(space, np.uint8(32), line).astype(np.uint32) + np.uint32(1)
    out = []
    h = (flat[:-1] * _PRIME ^ flat[1:]) * np.uint32(0x9E3779B1)
    have = 2
    for n in GRAMS:
        while have < n:
            h = (h[:-1] ^ flat[have:]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            have += 1
        m = len(h)
        inner = space[1 : m + 1].copy()
        for k in range(2, n - 1):
            inner |= space[k : k + m]
        at = np.flatnonzero(~inner)
        out.append(((h[at] ^ np.uint32(n * 0x51ED27)) * np.uint32(0xC2B2AE35) >> np.uint32(15), at))
    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if len(start):
        begin = np.zeros(len(line), np.int64)
        begin[start] = start
        place = np.arange(len(line)) - np.maximum.accumulate(begin)
        mixed = np.where(space, np.uint32(0), flat * ((place.astype(np.uint32) * np.uint32(2) + np.uint32(1)) * np.uint32(0x27D4EB2F)))
        mixed ^= mixed >> np.uint32(16)
        total = np.add.reduceat(mixed * np.uint32(0x165667B1), start, dtype=np.uint32)
        word = (total ^ total >> np.uint32(13)) * np.uint32(0xC2B2AE35)
        out.append((word >> np.uint32(15), start))
        # Word pairs, within one text.
        doc = np.searchsorted(bounds, start, side="right")
        pair = (word[:-1] * np.uint32(0x85EBCA6B) ^ word[1:]) * np.uint32(0x9E3779B1)
        pair[word[1:] == word[:-1]] = REPEAT
        inside = doc[1:] == doc[:-1]
        out.append((((pair ^ pair >> np.uint32(15)) * np.uint32(0xC2B2AE35) >> np.uint32(15))[inside], start[:-1][inside]))
    out.append((bounds, bounds))
    return out


class Classifier:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rows = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
        self.out = np.zeros((DIMENSION, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.weight = np.zeros(BUCKETS, np.float32)

    @staticmethod
    def _bag(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all features and the text of each."""
        *parts, (bounds, _) = features(texts)
        at = np.concatenate([p for _, p in parts])
        return np.concatenate([r for r, _ in parts]).astype(np.int64), np.searchsorted(bounds, at, side="right") - 1

    def train(self, texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, step: float = 8.0, batch: int = 16, seed: int = 5) -> "Classifier":
        rng = np.random.default_rng(seed)
        done, total = 0, epochs * len(texts)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(texts), batch):
                rows = order[lo : lo + batch]
                ids, doc = self._bag([texts[i] for i in rows])
                count = np.maximum(np.bincount(doc, minlength=len(rows)), 1).astype(np.float32)
                kinds, place = np.unique(ids, return_inverse=True)
                # Documents by distinct rows: how much of a document's average each row makes up.
                share = np.bincount(doc * len(kinds) + place, minlength=len(rows) * len(kinds)).reshape(len(rows), -1).astype(np.float32) / count[:, None]
                held = self.rows[kinds]
                mean = share @ held
                p = softmax(mean @ self.out + self.bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                pace = step * (1 - done / total)
                back = p @ self.out.T
                self.out -= pace * (mean.T @ p)
                self.bias -= pace * 0.1 * p.sum(0)
                self.rows[kinds] = held - pace * 20 * (share.T @ back)
                done += len(rows)
        return self.prepare()

    def prepare(self) -> "Classifier":
        self.weight = self.rows @ (self.out[:, 1] - self.out[:, 0])
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1; a text without words gets that of the bias alone."""
        out = np.empty(len(texts))
        for lo, hi in common.batches([len(t) for t in texts], 1 << 20):
            *parts, (bounds, _) = features(texts[lo:hi])
            total, count = np.zeros(hi - lo), np.zeros(hi - lo)
            for rows, at in parts:
                cut = np.searchsorted(at, bounds)
                sums = np.zeros(len(rows) + 1)
                np.cumsum(self.weight[rows], dtype=np.float64, out=sums[1:])
                total += np.diff(sums[cut])
                count += np.diff(cut)
            logit = total / np.maximum(count, 1) + float(self.bias[1] - self.bias[0])
            out[lo:hi] = 1 / (1 + np.exp(-logit))
        return out


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, size: int = SAMPLE_BYTES) -> Classifier:
    """Learn from the whole texts of up to `rows` labelled documents and `size` bytes of each label
    (see common.sample), held-out ones and those without a doc_id left out. Labels other than 0 and 1
    are left out; a classifier without labels gives 0.5. Only ids of the sample are broadcast."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    own = own.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~common.held_out()).distinct()
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    chosen = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * rows).drop("rank")
    chosen = docs.sparkSession.createDataFrame(chosen.toPandas(), own.schema)  # 4 * rows at most
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    got = common.sample(read, "doc_id", "text", "quality", rows, size)
    if not len(got):
        return Classifier()
    return Classifier().train(common.encode(got["text"]), got["by"].to_numpy(np.int64))


def score(docs: DataFrame, model: Classifier, into: str = "score") -> DataFrame:
    """docs, whose columns stay, with a column `into`: the probability of label 1, of each whole text. If there is one of
    that name, the new one gets underscores in front (common.fresh). Null counts as empty; a text without words
    gets the score of the bias. Rows keep their places."""
    into = common.fresh(docs, into)
    told = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    @F.pandas_udf("double")
    def look(text: pd.Series) -> pd.Series:
        model = Classifier.__new__(Classifier)
        model.weight, model.bias = told.value
        return pd.Series(model.scores(common.encode(text)))

    return docs.withColumn(into, look(F.col("text").cast("string")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, with whether it was held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model)
    return found.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
