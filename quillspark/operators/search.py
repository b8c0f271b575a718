"""Hybrid retrieval: cosine and field-weighted BM25, one hit for each text, fused by reciprocal rank.

All of it works on a set of queries at once. chunks: chunk_id, repo, alias, branch, path, heading,
content, and for the semantic side embedding (normalized). queries: query_id, query and, for the
semantic side, q (normalized vector). The keyword side reads an Index, the semantic side Texts; the
store keeps both, and without one they are built for the queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as tx
from ..functions import vectors as vx
from . import nearest

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
WEIGHTS = {"heading": 3.0, "path": 1.0, "content": 1.0}
KEYWORD_LIMIT = 200
RRF_K = 60
#: Rows of query terms that are broadcast; more of them meet the postings by a shuffle.
MOST_TERMS = 1 << 19
#: Chunks whose postings and scores one task adds up, where their number is known.
CHUNKS = 2048


@dataclass
class Index:
    """postings: term, chunk_id, wtf (weighted frequency), tf, dl (words of the chunk); terms: term, df
    (chunks that have it); stats: one row with n (all chunks) and avgdl."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def in_scope(df: DataFrame, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """Rows of a repository and branch; an absent or empty one does not restrict."""
    for name, value in (("repo", repo), ("branch", branch)):
        if value:
            df = df.where(F.col(name) == value)
    return df


def _words(column: str):
    return tx.tokens(F.coalesce(F.col(column), F.lit("")))


def _weighted(words: str, weight: float):
    return F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))


def _tokenized(chunks: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, dl and one array of words for each field."""
    held = chunks.select("chunk_id", *carry, *(_words(c).alias(f"_{c}") for c in WEIGHTS))
    return held.withColumn("dl", sum((F.size(f"_{c}") for c in WEIGHTS), F.lit(0)).cast("long"))


def postings(chunks: DataFrame, only: DataFrame | None = None, carry: tuple[str, ...] = (), n: int | None = None) -> DataFrame:
    """The postings of an index, with the chunks' columns `carry`; with `only` (term), of these terms. A chunk's length comes from its own
    row, so lengths need no join, and words that nobody asks for go no further. Rows are dealt out by
    chunk, which is how scores add up too; with `n`, the number of chunks or more, to tasks of so many
    chunks (CHUNKS) that neither postings nor scores in a task grow with their number."""
    parts = [_weighted(f"_{c}", w) for c, w in WEIGHTS.items()]
    tasks = [] if n is None else [max(1, -(-n // CHUNKS), min(chunks.sparkSession.sparkContext.defaultParallelism, n // 256))]
    dealt = _tokenized(chunks.select("chunk_id", *WEIGHTS, *carry).repartition(*tasks, "chunk_id"), carry)
    each = dealt.select("chunk_id", "dl", *carry, F.explode(F.concat(*parts)).alias("t")).select("chunk_id", "dl", *carry, "t.*")
    if only is not None:
        each = each.join(small(only.select("term").distinct()), "term", "left_semi")
    return each.groupBy("term", "chunk_id").agg(F.sum("w").alias("wtf"), F.count("*").alias("tf"), F.first("dl").alias("dl"), *(F.first(c).alias(c) for c in carry))


def term_counts(chunks: DataFrame) -> DataFrame:
    """term, df (chunks that have it), cf (times it occurs), n (all chunks), avgdl. Counts are summed where the
    chunks lie, whole rows at a time, so a task holds its distinct terms and no pairs of term and chunk;
    what belongs to no term is counted in the same pass, under null."""
    count = lambda words, df, cf: F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(df).alias("df"), F.lit(cf).alias("cf")))
    words = F.concat(*(f"_{c}" for c in WEIGHTS))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).alias("df"), F.size("words").alias("cf")))
    each = _tokenized(chunks).select(words.alias("words")).select(F.explode(F.concat(whole, count(F.array_distinct("words"), 1, 0), count("words", 0, 1))).alias("t"))
    counts = shared.materialize(each.groupBy("t.term").agg(F.sum("t.df").alias("df"), F.sum("t.cf").alias("cf")), "term-counts")
    stats = counts.where("term IS NULL").select(F.col("df").alias("n"), (F.col("cf") / F.col("df")).alias("avgdl"))
    return counts.where("term IS NOT NULL").join(F.broadcast(stats), how="cross")


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n (all chunks), avgdl."""
    return _tokenized(chunks).agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def index_of(chunks: DataFrame, only: DataFrame | None = None, posted: DataFrame | None = None) -> Index:
    """An index that is not stored. Document frequencies, the number of chunks and their mean length are
    counted in one pass, written; counts are summed where the chunks lie. With `posted`, some of the
    chunks, only these have postings."""
    words = F.array_distinct(F.concat(*(f"_{c}" for c in WEIGHTS)))
    none = F.array(F.lit(None).cast("string"))  # stands for the chunk itself
    each = _tokenized(chunks).select("dl", F.explode(F.concat(none, words)).alias("term"))
    if only is not None:
        only = shared.materialize(only.select("term").distinct(), "asked-terms")
        asked = only.withColumn("_asked", F.lit(True))
        each = each.join(F.broadcast(asked) if asked.count() <= MOST_TERMS else asked, "term", "left").where("_asked OR term IS NULL")
    counts = shared.materialize(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl")), "terms")
    whole = counts.where("term IS NULL").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    n = (whole.first() or {"n": 0})["n"]
    return Index(postings(chunks if posted is None else posted, only, n=n), counts.where("term IS NOT NULL").select("term", "df"), whole)


def terms_of(queries: DataFrame) -> DataFrame:
    """query_id, term, times: terms that fold to one word count once each."""
    raw = queries.select("query_id", F.explode(tx.query_terms(F.col("query"))).alias("raw"))
    return raw.groupBy("query_id", tx.fold(F.col("raw")).alias("term")).agg(F.count("*").alias("times"))


def small(rows: DataFrame) -> DataFrame:
    """Rows of a written table, broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= MOST_TERMS else rows


def asked_terms(queries: DataFrame, index: Index) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """query_id, term, times, idf of terms that the index has, and what a posting of such a row adds to
    its chunk's score, as a function of wtf and dl."""
    whole = index.stats.first()
    n, avgdl = (whole["n"], whole["avgdl"]) if whole else (0, None)
    raw_idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw_idf <= 0, F.lit(LEAST_IDF)).otherwise(raw_idf)
    asked = terms_of(queries).join(index.terms, "term").select("query_id", "term", "times", idf.alias("idf"))

    def impact(wtf: Column, dl: Column) -> Column:
        return F.col("times") * F.col("idf") * wtf * (K1 + 1) / (wtf + K1 * (1 - B + B * dl / F.lit(avgdl)))

    return asked, impact


def bm25(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, chunk_id, bm25 for chunks with any query term. Statistics are those of all chunks."""
    asked, impact = asked_terms(queries, index)
    part = impact(F.col("wtf"), F.col("dl"))
    return index.postings.join(small(asked), "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def keyword_ranks(scored: DataFrame, scope: DataFrame, limit: int = KEYWORD_LIMIT, within: bool = False) -> DataFrame:
    """scope (chunk_id and what is to come along) -> query_id, chunk_id, keyword_rank of the best chunks in
    it. Sums in another order may differ in the last digits, so ranks go by nine decimals, then
    chunk_id. If all that is scored lies in the scope (`within`), only the best `limit` look for it there."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "chunk_id")
    if within:
        scored = scored.withColumn("keyword_rank", F.row_number().over(order)).where(F.col("keyword_rank") <= limit).drop("keyword_rank")
    return scored.join(scope, "chunk_id").withColumn("keyword_rank", F.row_number().over(order)).where(F.col("keyword_rank") <= limit)


MEMBER = "struct<chunk_id: bigint, branch: string, alias: string, heading: string>"


def texts_of(chunks: DataFrame) -> DataFrame:
    """One row for each (repo, path, content): content_hash, members (a struct for each chunk that holds the
    text, of which there is one a branch as a rule) and the vector of the first of them, since chunks
    of one text have one vector. Texts are grouped by their hash, so the shuffle carries no text."""
    keyed = chunks if "content_hash" in chunks.columns else chunks.withColumn("content_hash", F.sha2("content", 256))
    member = F.struct("chunk_id", "branch", "alias", "heading").cast(MEMBER)
    return keyed.groupBy("repo", "path", "content_hash").agg(F.array_sort(F.collect_list(member)).alias("members"), F.min_by("embedding", "chunk_id").alias("embedding"))


def scoped(texts: DataFrame, repo: str | None = None, branch: str | None = None) -> DataFrame:
    """text_id (its first chunk in the scope), repo, path, members in the scope, embedding."""
    held = in_scope(texts, repo)
    if branch:
        held = held.withColumn("members", F.filter("members", lambda m: m["branch"] == branch)).where(F.size("members") > 0)
    return held.select(F.col("members")[0]["chunk_id"].alias("text_id"), "repo", "path", "members", "embedding")


def hybrid_search(queries: DataFrame, chunks: DataFrame | None = None, limit: int = 5, repo: str | None = None, branch: str | None = None, index: Index | None = None, texts: DataFrame | None = None) -> DataFrame:
    """query_id, position, repo, alias, branches, path, heading, score (5 places), semantic_score (4
    places), keyword_rank, matched_by, chunk_id. Ties go to the smaller chunk_id. index and texts are
    those of a store; without them they are built from chunks, texts once, in a written table.

    A text without a vector (null) is found by its words alone; one of another dimension is of another
    model and no hit. A text without a keyword rank can only be among the best `limit` if its semantic
    rank is, so candidates are the nearest `limit` and the texts of the keyword ranks; the semantic
    ranks of the latter are counted, in the same pass over the vectors, without ranking all texts.
    """
    queries = shared.materialize(queries.select("query_id", "query", "q"), "queries")
    built = index is None  # then for the scope alone
    index = index or index_of(chunks, terms_of(queries), in_scope(chunks, repo, branch))
    if texts is None:
        texts = shared.materialize(texts_of(chunks), "texts")
    held = scoped(texts, repo, branch)
    asked = queries.select("query_id", "q")
    members = held.select("text_id", F.explode("members.chunk_id").alias("chunk_id"))
    by_word = keyword_ranks(bm25(queries, index), members, within=built).groupBy("query_id", "text_id").agg(F.min("keyword_rank").alias("keyword_rank"))
    by_word = by_word.join(held.select("text_id", "embedding"), "text_id").join(asked, "query_id")
    by_word = by_word.where(F.col("embedding").isNull() | (F.size("embedding") == F.size("q")))
    by_word = by_word.select("query_id", F.col("text_id").alias("chunk_id"), "keyword_rank", F.round(vx.dot(F.col("embedding"), F.col("q")), 9).alias("semantic"))
    by_word = shared.materialize(by_word, "by-word")  # KEYWORD_LIMIT rows a query at most
    vectors = held.where("embedding IS NOT NULL").select(F.col("text_id").alias("chunk_id"), "embedding")
    near = nearest.with_hits(asked, vectors, limit, by_word.where("semantic IS NOT NULL").select("query_id", "chunk_id", "semantic"))
    hits = by_word.select("query_id", "chunk_id", "keyword_rank", F.col("semantic").alias("own")).join(near, ["query_id", "chunk_id"], "full")
    hits = hits.select("query_id", "chunk_id", "keyword_rank", F.coalesce("own", "semantic").alias("semantic"), "semantic_rank")
    score = F.coalesce(1 / (RRF_K + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce(1 / (RRF_K + F.col("keyword_rank")), F.lit(0.0))
    matched = F.when(F.col("keyword_rank").isNull(), "semantic").when(F.col("semantic").isNull(), "keyword").otherwise("both")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.desc("semantic"), "chunk_id")
    best = hits.withColumn("score", score).withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    first = F.col("members")[0]
    told = held.select(F.col("text_id").alias("chunk_id"), "repo", "path", tx.in_branch_order(F.col("members.branch")).alias("branches"), first["alias"].alias("alias"), first["heading"].alias("heading"))
    return best.join(told, "chunk_id").select(
        "query_id", "position", "repo", "alias", "branches", "path", "heading", F.round("score", 5).alias("score"),
        F.round("semantic", 4).alias("semantic_score"), "keyword_rank", matched.alias("matched_by"), "chunk_id",
    )


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """Pure vector search: query_id, rank, chunk_id, score (4 places)."""
    best = nearest.top(queries.select("query_id", "q"), vectors.select("chunk_id", vx.normalized(F.col("embedding")).alias("embedding")), k)
    return best.select("query_id", "rank", "chunk_id", F.round("semantic", 4).alias("score"))
