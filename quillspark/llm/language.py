"""Language identification by a byte convolutional network, in numpy.

A text is cut into windows of WINDOW bytes that cover all of it. Filters of several widths run over
the bytes of a window; each keeps its largest response, and a softmax layer gives the languages. A
filter is a table of one weight for each byte class and place, so a response is a sum of table
entries; for use, entries of neighbouring bytes are added up beforehand. A document's score is the
mean of its windows' log-probabilities, weighted by their bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bounds of what is learned from: documents of each language, and bytes of their whole texts.
SAMPLE = 800
SAMPLE_BYTES = 1_500_000
EPOCHS = 5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter; the pattern also finds numbers such as \u00bd, so what it finds
    first is looked at, and only if that is none the whole text."""
    found = _LETTER.search(text) if isinstance(text, str) else None
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def _classes() -> np.ndarray:
    """Byte -> class: 0 padding, letters without case, space, digit, other ASCII, lead bytes, the
    rest one class each."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b < 128:
            out[b] = 1 + ord(c.lower()) - 97 if c.isalpha() else 27 if c.isspace() else 28 if c.isdigit() else 29
        else:
            out[b] = 30 + b - 128 if b < 192 else 94 + (b - 192) // 4
    return out


CLASS = _classes()
CLASSES = 110


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (window, place), the text of each window and its number of bytes. No bytes, no window."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = -(-sizes // WINDOW)
    flat = np.zeros((int(n.sum()), WINDOW), np.uint8)
    at = common.offsets(n) * WINDOW
    line = flat.reshape(-1)
    for t, a in zip(texts, at):
        if t:
            line[a : a + len(t)] = CLASS[np.frombuffer(t, np.uint8)]
    owner = np.repeat(np.arange(len(texts)), n)
    used = np.minimum(WINDOW, sizes[owner] - (np.arange(len(flat)) - common.offsets(n)[owner]) * WINDOW)
    return flat, owner, used


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0] = -4  # padding never wins the pooling
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)
        self.tables = None

    def _responses(self, x: np.ndarray) -> list[np.ndarray]:
        """x (place, window) -> for each width (place, window, filter)."""
        return [sum(f[j][x[j : len(x) - w + 1 + j]] for j in range(w)) for w, f in zip(WIDTHS, self.filters)]

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, step: float = 0.05, batch: int = 64, seed: int = 11) -> None:
        """Adagrad on the cross entropy. x (window, place), y labels' indexes."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.bias, self.out, self.out_bias]
        past = [np.full(p.shape, 1e-6, np.float32) for p in params]
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                xb = x[rows].T
                got = self._responses(xb)
                best = [r.argmax(0) for r in got]  # window, filter
                pooled = np.concatenate([r.max(0) for r in got], axis=1) + self.bias
                act = np.maximum(pooled, 0)
                p = softmax(act @ self.out + self.out_bias)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                d_act = (p @ self.out.T) * (pooled > 0)
                grads = []
                column = np.arange(FILTERS)
                for k, (w, place) in enumerate(zip(WIDTHS, best)):
                    g = d_act[:, k * FILTERS : (k + 1) * FILTERS]
                    part = np.empty((w, CLASSES, FILTERS), np.float32)
                    for j in range(w):
                        seen = xb[place + j, np.arange(len(rows))[:, None]].astype(np.int64)
                        part[j] = np.bincount((seen * FILTERS + column).ravel(), g.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS)
                    part[:, 0] = 0
                    grads.append(part)
                grads += [d_act.sum(0), act.T @ p, p.sum(0)]
                for param, g, h in zip(params, grads, past):
                    h += g * g
                    param -= step * g / np.sqrt(h)

    def prepare(self) -> "Network":
        """Tables for pairs of classes: widths 2, 3 and 4 as one or two look-ups each."""
        two, three, four = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        self.tables = (np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1), three[2], pair(four[2], four[3]))
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """x (window, place) of classes -> (window, label)."""
        front, third, back = self.tables
        out = np.empty((len(x), len(self.labels)), np.float32)
        for lo in range(0, len(x), 32):
            xb = np.ascontiguousarray(x[lo : lo + 32].T).astype(np.int32)
            pair = xb[:-1] * CLASSES + xb[1:]
            f = front[pair]
            a = f[:, :, :FILTERS].max(0)
            b = (f[:-1, :, FILTERS : 2 * FILTERS] + third[xb[2:]]).max(0)
            c = (f[:-2, :, 2 * FILTERS :] + back[pair[2:]]).max(0)
            act = np.maximum(np.concatenate([a, b, c], axis=1) + self.bias, 0)
            out[lo : lo + 32] = np.log(softmax(act @ self.out + self.out_bias) + 1e-12)
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Label index and probability of each text; empty texts get -1 and 0."""
        label, score = np.full(len(texts), -1), np.zeros(len(texts))
        for lo, hi in common.batches([len(t) for t in texts], 2 << 20):
            x, owner, used = windows(texts[lo:hi])
            if not len(x):
                continue
            total = np.zeros((hi - lo, len(self.labels)))
            np.add.at(total, owner, self.log_probabilities(x) * used[:, None])
            size = np.bincount(owner, used, hi - lo)
            some = size > 0
            p = softmax(total[some] / size[some, None])
            at = lo + np.flatnonzero(some)
            label[at], score[at] = p.argmax(1), p.max(1)
        return label, score


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, rows: int = SAMPLE, size: int = SAMPLE_BYTES) -> Network | None:
    """Learn from the whole texts of up to `rows` labelled documents and `size` bytes of each language
    (see common.sample), held-out ones and those without a doc_id left out: every window of theirs,
    also the short ones. None without labelled texts."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    got = common.sample(own.where(~common.held_out()), "doc_id", "text", "lang", rows, size)
    if not len(got):
        return None
    labels = sorted(got["by"].unique())
    x, owner, _ = windows(common.encode(got["text"]))
    net = Network(labels)
    net.train(x, np.searchsorted(labels, got["by"].to_numpy())[owner])
    return net.prepare()


def identify(docs: DataFrame, net: Network | None, into: str = "language") -> DataFrame:
    """docs, whose columns stay, with a column `into`: (lang_pred, score). If there is one of
    that name, the new one gets underscores in front (common.fresh). Null texts and texts without a letter get und and 0, and so does
    every text if there was nothing to learn from. Rows keep their places; each whole text is read."""
    into = common.fresh(docs, into)
    told = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def look(text: pd.Series) -> pd.DataFrame:
        net = told.value
        plain = [t if has_letter(t) else "" for t in text]
        if net is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(plain), "score": 0.0})
        label, score = net.predict(common.encode(plain))
        return pd.DataFrame({"lang_pred": [net.labels[i] if i >= 0 else UNKNOWN for i in label], "score": score})

    return docs.withColumn(into, look(F.col("text").cast("string")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, with whether it was held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select(F.col("doc_id").cast("long"), "text"), train(docs))
    return found.select("doc_id", common.held_out().alias("held_out"), "language.*")
