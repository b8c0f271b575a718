"""Compute-once embeddings: a cache keyed by model and content hash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EmbeddingsUnavailable, RateLimited
from ..functions import vectors as vx


def content_hash(column: str = "content"):
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)


def cache_misses(incoming: DataFrame, cache: DataFrame, model: str, buckets: int | None = None) -> DataFrame:
    """One row for each distinct hash that the model's cache lacks. Equal texts become one where they lie;
    with the number of a bucketed cache's buckets they go to the buckets, and the cache stays where it is."""
    known = cache.where(F.col("model") == model).select("content_hash")
    texts = incoming.groupBy("content_hash").agg(F.first("content").alias("content"))
    if buckets:
        texts = texts.repartition(buckets, "content_hash")
    return texts.join(known, "content_hash", "left_anti")


#: Errors after which the provider is asked no more.
FATAL = (RateLimited, EmbeddingsUnavailable)


def _vectors(provider: Callable[[list[str]], np.ndarray], texts: list[str]) -> list[np.ndarray]:
    got = np.asarray(provider(texts), np.float32)
    if got.ndim != 2 or len(got) != len(texts) or not got.shape[1] or not np.isfinite(got).all():
        raise ValueError("the embedding provider gave an empty or non-finite vector")
    return list(got)


def embed(texts: DataFrame, provider: Callable[[list[str]], np.ndarray], batch: int = 16) -> DataFrame:
    """texts (content_hash, content) -> content_hash, embedding (array<float>), error and fatal, through a
    provider that takes lists of texts.

    No text fails another: a batch that fails is asked for text by text, and a text that fails alone,
    or has an empty or non-finite vector, has a null embedding and its error. A rate limit, or a provider
    that can't be reached, is told as `fatal` (the error's name) by every text from there on, without
    another call in this task; nothing is raised, so Spark repeats no task for it."""

    @F.pandas_udf("struct<embedding: array<float>, error: string, fatal: string>")
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        stopped: Exception | None = None

        def ask(some: list[str]) -> list[tuple]:
            nonlocal stopped
            try:
                if stopped:
                    raise stopped
                return [(v, None, None) for v in _vectors(provider, some)]
            except FATAL as e:
                stopped = e
                return [(None, str(e), type(e).__name__)] * len(some)
            except Exception as e:
                if len(some) > 1:
                    return [x for t in some for x in ask([t])]
                return [(None, str(e) or type(e).__name__, None)]

        for content in frames:
            rows = [x for i in range(0, len(content), batch) for x in ask(content.iloc[i : i + batch].tolist())]
            yield pd.DataFrame(rows, columns=["embedding", "error", "fatal"])

    return texts.select("content_hash", run("content").alias("_v")).select("content_hash", "_v.*")


def stop_if_fatal(embedded: DataFrame) -> None:
    """Raises what stopped the provider, if anything did."""
    told = embedded.where("fatal IS NOT NULL").select("fatal", "error").first()
    if told:
        raise {k.__name__: k for k in FATAL}[told["fatal"]](told["error"])


def with_vectors(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """chunks with their normalized vectors; chunks without one go."""
    known = cache.where(F.col("model") == model).select("content_hash", "embedding")
    return chunks.join(known, "content_hash").withColumn("embedding", vx.normalized(F.col("embedding")).cast("array<float>"))


def first_occurrence_counts(chunks: DataFrame, order: list[str], by: list[str]) -> DataFrame:
    """For each of the groups `by`: chunks, embedded (hashes that occur there first in the given
    order) and reused (the other distinct hashes of the group)."""
    first = chunks.groupBy("content_hash").agg(F.min(F.struct(*order, *by)).alias("_f"))
    embedded = first.groupBy(*(F.col(f"_f.{b}").alias(b) for b in by)).agg(F.count("*").alias("embedded"))
    held = chunks.groupBy(*by, "content_hash").agg(F.count("*").alias("_n"))
    totals = held.groupBy(*by).agg(F.sum("_n").alias("chunks"), F.count("*").alias("_hashes"))
    n = F.coalesce("embedded", F.lit(0))
    return totals.join(embedded, by, "left").select(*by, "chunks", n.alias("embedded"), (F.col("_hashes") - n).alias("reused"))


# The words whose presence makes up the deterministic provider's vector.
WORDS = "turno agenda reserva pago tarjeta login token aviso correo error deploy base indice busqueda rama commit api tabla cache".split()


def word_provider(texts: list[str]) -> np.ndarray:
    """Deterministic provider without a model: a text has a word or not, plus a constant."""
    return np.array([[float(w in (t or "").lower()) for w in WORDS] + [0.01] for t in texts], np.float32)
