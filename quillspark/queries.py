"""Registered queries over the given tables, and their SQL.

Documents stand for files of repositories: source is the repository, lang the heading, every document
is on branch main and those that are not English on dev too, so texts repeat across branches. Vectors
belong to documents of the same id; benchmark items are the questions, asked with the vector of their
number. Events stand for branch activity, conversations for commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .functions import text as tx
from .functions import vectors as vx
from .operators import blockmax, cache, cells, chunker, reports, search
from .plans import refresh_plan as plan
from .sources import projects

NOW = "2024-02-01 00:00:00"
MODEL = "words-v1"
PATTERNS = [("README.md",), ("docs/en/**",), ("*.md",), ("docs/fr/17.md",)]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def stamp(column: str):
    """Timestamps without a zone are taken as UTC."""
    return F.col(column).cast("timestamp_ntz").cast("timestamp")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    branches = F.when(F.col("lang") == "en", F.array(F.lit("main"))).otherwise(F.array(F.lit("main"), F.lit("dev")))
    each = docs.select("doc_id", "text", "lang", "source", F.posexplode(branches).alias("ord", "branch"))
    return each.select(
        (F.col("doc_id") * 10 + F.col("ord")).alias("chunk_id"), "doc_id", F.concat(F.lit("org/"), "source").alias("repo"), F.col("source").alias("alias"),
        "branch", "ord", F.concat(F.lit("docs/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("lang").alias("heading"), F.col("text").alias("content"),
    )


CORPUS = """
b AS (SELECT 0 AS ord, 'main' AS branch UNION ALL SELECT 1, 'dev'),
corpus AS (
  SELECT d.doc_id * 10 + b.ord AS chunk_id, d.doc_id, 'org/' || source AS repo, source AS alias, branch, b.ord AS ord,
         'docs/' || lang || '/' || d.doc_id || '.md' AS path, lang AS heading, text AS content
  FROM documents d JOIN b ON b.ord = 0 OR lang IS DISTINCT FROM 'en' WHERE text IS NOT NULL
)
"""


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_vectors(spark, sf_dir, corpus(spark, sf_dir))


def with_vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), vx.normalized(F.col("embedding")).alias("embedding"))
    return chunks.join(vectors, "doc_id", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), vx.normalized(F.col("embedding")).alias("q"))
    return asked.join(vectors, "query_id")


@query(f"WITH {CORPUS} SELECT repo, branch, count(*) AS n FROM corpus GROUP BY ALL")
def q_scope_count(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("repo", "branch").agg(F.count("*").alias("n"))


@query(f"WITH {CORPUS} SELECT branch, count(*) AS n, count(DISTINCT sha256(content)) AS texts FROM corpus GROUP BY branch")
def q_distinct_hashes(spark, sf_dir):
    each = corpus(spark, sf_dir).groupBy("branch", F.sha2("content", 256).alias("h")).agg(F.count("*").alias("c"))
    return each.groupBy("branch").agg(F.sum("c").alias("n"), F.count("*").alias("texts"))


@query(f"""WITH {CORPUS},
f AS (SELECT sha256(content) AS h, repo, branch,
        row_number() OVER (PARTITION BY sha256(content) ORDER BY repo, ord, path) AS rn FROM corpus),
t AS (SELECT repo, branch, count(*) AS chunks, count(DISTINCT h) AS hashes, count(*) FILTER (rn = 1) AS embedded FROM f GROUP BY ALL)
SELECT repo, branch, chunks, embedded, hashes - embedded AS reused FROM t""")
def q_embed_first_occurrence(spark, sf_dir):
    held = corpus(spark, sf_dir).select("repo", "branch", "ord", "path", F.sha2("content", 256).alias("content_hash"))
    return cache.first_occurrence_counts(held.withColumns({"o_repo": F.col("repo"), "o_ord": F.col("ord")}), ["o_repo", "o_ord", "path"], ["repo", "branch"])


@query(r"""WITH s AS (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 1200 THEN [0] ELSE range(0, length(text), 1050) END) AS pos FROM documents),
p AS (SELECT doc_id, CAST(floor(pos / 1050) AS INTEGER) AS chunk_index, regexp_replace(substr(text, pos + 1, 1200), '^\s+|\s+$', '', 'g') AS piece FROM s)
SELECT doc_id, chunk_index, length(piece) AS n_chars, md5(piece) AS digest FROM p WHERE piece <> ''""")
def q_chunk_stride(spark, sf_dir):
    pieces = chunker.stride_slices(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pieces.select("doc_id", "chunk_index", F.length("piece").cast("long").alias("n_chars"), F.md5("piece").alias("digest"))


# Sections of q_chunk_markdown: the first has the source as heading and the first line as its second
# paragraph, the others are of one paragraph each, as long as no line of a text is a heading or a fence.
WS = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
CHUNK_SQL = rf"""
WITH t AS (SELECT doc_id, source, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(160), ' '), chr(10)) AS lines
           FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
l AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM t),
s AS (SELECT doc_id, k, CASE WHEN k = 1 THEN source ELSE 'part' END AS heading, '# ' || source AS head, regexp_replace(line, '{WS}$', '') AS line,
        regexp_replace(CASE WHEN k = 1 THEN '# ' || source || chr(10) || chr(10) || line ELSE '## part' || chr(10) || line END, '{WS}$', '') AS body FROM l),
p AS (SELECT doc_id, k, 0 AS j, heading, body AS piece FROM s WHERE length(body) <= 1200
  UNION ALL SELECT doc_id, k, -1, heading, head FROM s WHERE length(body) > 1200 AND k = 1
  UNION ALL SELECT doc_id, k, 0, heading, head || chr(10) || chr(10) || line FROM s WHERE length(body) > 1200 AND k = 1 AND length(line) <= 1200
  UNION ALL SELECT doc_id, k, j, heading, substr(whole, j + 1, 1200) FROM (
    SELECT doc_id, k, heading, CASE WHEN k = 1 THEN line ELSE body END AS whole,
      unnest(range(0, length(CASE WHEN k = 1 THEN line ELSE body END), 1050)) AS j
    FROM s WHERE length(body) > 1200 AND (k > 1 OR length(line) > 1200))),
c AS (SELECT doc_id, k, j, heading, regexp_replace(piece, '^{WS}|{WS}$', '', 'g') AS piece FROM p)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INTEGER) AS chunk_index, heading, length(piece) AS n_chars, md5(piece) AS digest
FROM c WHERE piece <> ''"""


@query(CHUNK_SQL)
def q_chunk_markdown(spark, sf_dir):
    """The full chunker, on documents whose lines become sections."""
    docs = table(spark, sf_dir, "documents")
    source = F.concat(F.lit("# "), "source", F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n## part\n"))
    found = chunker.chunks(docs.select("doc_id", source.alias("content")))
    return found.select("doc_id", "chunk_index", "heading", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query(CHUNK_SQL)
def q_chunk_lateral(spark, sf_dir):
    """The chunker as a table function that SQL calls for each document."""
    chunker.register_udtf(spark)
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n## part\n")).alias("content"))
    found = "SELECT d.doc_id, c.chunk_index, c.heading, CAST(length(c.text) AS BIGINT) AS n_chars, md5(c.text) AS digest FROM {docs} d, LATERAL chunk_markdown(d.content) c WHERE c.error IS NULL"
    return spark.sql(found, docs=docs)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 1)) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v)
SELECT vec_id, round(n, 6) AS norm, round(e[1] / n, 6) AS first, round(list_sum(e) / n, 6) AS total FROM n""")
def q_normalize_l2(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    held = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("e")).withColumn("u", vx.normalized(F.col("e")))
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    return held.select("vec_id", F.round(vx.norm(F.col("e")), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"), F.round(total, 6).alias("total"))


UNIT = """
u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings),
v AS (SELECT vec_id, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS e FROM u)
"""


@query(f"""WITH {UNIT},
s AS (SELECT item_id AS query_id, v.vec_id AS chunk_id, list_dot_product(v.e, q.e) AS score
      FROM benchmark JOIN v q ON q.vec_id = item_id CROSS JOIN v),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, chunk_id, round(score, 4) AS score FROM r WHERE rank <= 5""")
def q_cosine_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return search.cosine_topk(questions(spark, sf_dir), vectors)


ALL_SCORES = f"""{UNIT},
s AS (SELECT item_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(v.e, q.e), 9) AS score
      FROM benchmark JOIN v q ON q.vec_id = item_id CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)
"""


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), vx.normalized(F.col("embedding")).alias("embedding"))


@query(f"WITH {ALL_SCORES} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 4) AS score FROM r WHERE rank <= 20")
def q_cells_topk(spark, sf_dir):
    """The nearest vectors of each question, from stored cells."""
    held = cells.build(unit_vectors(spark, sf_dir), shared.scratch(spark, "cells"))
    best, _ = cells.top(questions(spark, sf_dir), held, 20)
    return best.select("query_id", "rank", "chunk_id", F.round("semantic", 4).alias("score"))


@query(f"""WITH {ALL_SCORES}, f AS (SELECT min(vec_id) AS chunk_id FROM embeddings GROUP BY label)
SELECT query_id, chunk_id, rank AS semantic_rank FROM r JOIN f USING (chunk_id)""")
def q_cells_ranks(spark, sf_dir):
    """Where the first vector of every label stands among all vectors, for each question."""
    vectors = unit_vectors(spark, sf_dir)
    held = cells.build(vectors, shared.scratch(spark, "cells"))
    firsts = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("chunk_id")).join(vectors, "chunk_id")
    asked = shared.materialize(questions(spark, sf_dir).select("query_id", "q"), "asked")
    hits = asked.join(F.broadcast(firsts), how="cross")  # a row a label
    hits = hits.select("query_id", "chunk_id", F.round(vx.dot(F.col("embedding"), F.col("q")), 9).alias("semantic"))
    return cells.ranks(asked, held, hits)[0]


@query("""SELECT label, count(*) AS kept FROM embeddings WHERE CASE WHEN label = 3 THEN 32 ELSE len(embedding) END = 64 GROUP BY label""")
def q_dimension_guard(spark, sf_dir):
    cut = F.when(F.col("label") == 3, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("label", cut.alias("e")).where(F.size("e") == 64).groupBy("label").agg(F.count("*").alias("kept"))


STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TERMS = rf"""
words AS (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM benchmark),
terms AS (SELECT query_id, strip_accents(w) AS term, count(*) AS times
          FROM (SELECT DISTINCT query_id, w FROM words WHERE length(w) >= 3 AND w NOT IN ({STOP})) GROUP BY ALL)
"""


@query(f"WITH {TERMS} SELECT query_id, count(DISTINCT w) AS n_terms, string_agg(DISTINCT w, ' ' ORDER BY w) AS terms FROM words WHERE length(w) >= 3 AND w NOT IN ({STOP}) GROUP BY query_id")
def q_terms(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tx.query_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    return held.select("query_id", F.size("t").cast("long").alias("n_terms"), F.array_join(F.array_sort("t"), " ").alias("terms"))


INDEX = rf"""
tok AS (
  SELECT chunk_id, unnest(regexp_extract_all(strip_accents(lower(heading)), '[\p{{L}}\p{{N}}]+')) AS term, 3.0 AS w FROM corpus
  UNION ALL SELECT chunk_id, unnest(regexp_extract_all(strip_accents(lower(path)), '[\p{{L}}\p{{N}}]+')), 1.0 FROM corpus
  UNION ALL SELECT chunk_id, unnest(regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+')), 1.0 FROM corpus),
post AS (SELECT term, chunk_id, CAST(sum(w) AS DOUBLE) AS wtf, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT chunk_id, sum(tf) AS dl FROM post GROUP BY chunk_id),
st AS (SELECT (SELECT count(*) FROM corpus) AS n, (SELECT sum(dl) FROM len) / (SELECT count(*) FROM corpus) AS avgdl)
"""


@query(f"""WITH {CORPUS}, {INDEX}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, any_value(n) AS n, round(any_value(avgdl), 4) AS avgdl FROM post, st GROUP BY term""")
def q_bm25_stats(spark, sf_dir):
    return search.term_counts(corpus(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 4))


def bm25_sql(scope: str) -> str:
    return f"""
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sc AS (SELECT t.query_id, p.chunk_id, sum(t.times * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END)
         * p.wtf * 2.2 / (p.wtf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
       FROM post p JOIN terms t USING (term) JOIN df USING (term) JOIN len USING (chunk_id) CROSS JOIN st GROUP BY ALL),
kw AS (SELECT * FROM (SELECT sc.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS INTEGER) AS keyword_rank
       FROM sc JOIN corpus USING (chunk_id) WHERE {scope}) WHERE keyword_rank <= 200)
"""


@query(f"WITH {CORPUS}, {INDEX}, {TERMS}, {bm25_sql('true')} SELECT query_id, chunk_id, keyword_rank, round(bm25, 5) AS score FROM kw")
def q_bm25_topk(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    best = search.keyword_ranks(search.bm25(asked, search.index_of(chunks, search.terms_of(asked))), chunks.select("chunk_id"), within=True)
    return best.select("query_id", "chunk_id", "keyword_rank", F.round("bm25", 5).alias("score"))


@query(f"""WITH {CORPUS}, {INDEX}, {TERMS}, {bm25_sql("branch = 'dev'")} SELECT query_id, chunk_id, keyword_rank, path, round(bm25, 5) AS score FROM kw JOIN corpus USING (chunk_id)""")
def q_blockmax_topk(spark, sf_dir):
    """The best keyword hits of a branch from blocks of its postings, weighed as in all branches."""
    chunks = corpus(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    index = search.index_of(chunks, search.terms_of(asked))
    mine = search.in_scope(chunks, branch="dev")
    whole = index.stats.first()
    posted = shared.materialize(search.postings(mine, search.terms_of(asked), ("repo",), whole["n"] if whole else 0), "postings")
    blocks = shared.materialize(blockmax.blocks_of(posted, ("repo",)).sortWithinPartitions("term"), "blocks")
    found = blockmax.top(asked, blocks, index, mine.select("chunk_id", "path"))
    return found.hits.select("query_id", "chunk_id", "keyword_rank", "path", F.round("bm25", 5).alias("score"))


@query(f"""WITH {CORPUS} SELECT repo, path, sha256(content) AS content_hash, string_agg(branch, ',' ORDER BY ord) AS branches, count(*) AS copies
FROM corpus GROUP BY repo, path, sha256(content)""")
def q_dedup_branches(spark, sf_dir):
    held = corpus(spark, sf_dir).groupBy("repo", "path", F.sha2("content", 256).alias("content_hash"))
    return held.agg(F.array_join(tx.ordered_branches(F.col("branch")), ",").alias("branches"), F.count("*").alias("copies"))


def hybrid_sql(scope: str) -> str:
    return f"""WITH {CORPUS}, {INDEX}, {TERMS}, {bm25_sql(scope)}, {UNIT},
asked AS (SELECT item_id AS query_id, v.e FROM benchmark JOIN v ON v.vec_id = item_id),
sem AS (SELECT query_id, c.*, list_dot_product(v.e, asked.e) AS semantic FROM asked CROSS JOIN corpus c JOIN v ON v.vec_id = c.doc_id WHERE {scope}
        UNION ALL SELECT query_id, c.*, NULL FROM asked JOIN kw USING (query_id) JOIN corpus c USING (chunk_id) WHERE c.doc_id NOT IN (SELECT vec_id FROM v)),
grp AS (SELECT s.query_id, repo, path, sha256(content) AS h, max(semantic) AS semantic, min(keyword_rank) AS keyword_rank
        FROM sem s LEFT JOIN kw ON kw.query_id = s.query_id AND kw.chunk_id = s.chunk_id GROUP BY ALL),
txt AS (SELECT repo, path, sha256(content) AS h, string_agg(branch, ',' ORDER BY ord) AS branches, min(chunk_id) AS chunk_id FROM corpus WHERE {scope} GROUP BY ALL),
rk AS (SELECT *, CASE WHEN semantic IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 9) DESC NULLS LAST, chunk_id) END AS sr
       FROM grp JOIN txt USING (repo, path, h)),
fu AS (SELECT *, coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0) AS score FROM rk),
po AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, round(semantic, 9) DESC NULLS LAST, chunk_id) AS INTEGER) AS position FROM fu)
SELECT query_id, position, repo, path, branches, round(score, 5) AS score, round(semantic, 4) AS semantic_score, keyword_rank,
       CASE WHEN keyword_rank IS NULL THEN 'semantic' WHEN semantic IS NULL THEN 'keyword' ELSE 'both' END AS matched_by
FROM po WHERE position <= 5"""


def _hybrid(spark, sf_dir, branch=None):
    """Documents without a vector are found by their words alone. Vectors meet hashes of texts; the words are
    read where the texts lie."""
    chunks = corpus(spark, sf_dir)
    hashed = search.in_scope(chunks, branch=branch).withColumn("content_hash", F.sha2("content", 256)).drop("content")
    texts = shared.materialize(search.texts_of(with_vectors(spark, sf_dir, hashed)), "texts")
    hits = search.hybrid_search(questions(spark, sf_dir), chunks, branch=branch, texts=texts)
    return hits.select("query_id", "position", "repo", "path", F.array_join("branches", ",").alias("branches"), "score", "semantic_score", "keyword_rank", "matched_by")


@query(hybrid_sql("true"))
def q_hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir)


@query(hybrid_sql("branch = 'dev'"))
def q_hybrid_scoped(spark, sf_dir):
    return _hybrid(spark, sf_dir, "dev")


@query(f"""WITH {CORPUS} SELECT DISTINCT repo, path FROM corpus
WHERE path = 'README.md' OR path = 'docs/fr/17.md' OR (path LIKE 'docs/en/%' AND regexp_matches(path, '\\.(md|mdx|markdown)$'))
   OR (path NOT LIKE '%/%' AND regexp_matches(path, '\\.(md|mdx|markdown)$'))""")
def q_pattern_match(spark, sf_dir):
    tree = corpus(spark, sf_dir).select("repo", "path")
    every = tree.select("repo").distinct()
    patterns = every.withColumn("pattern", F.explode(F.array(*(F.lit(p) for (p,) in PATTERNS))))
    return plan.match_paths(tree, patterns)


ACTIVITY = "act AS (SELECT 'user/' || user_id AS repo, event_type AS branch, max(ts) AS seen FROM events GROUP BY ALL)"


def activity(spark, sf_dir):
    held = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("at"))
    return held.select(F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("repo"), F.col("event_type").alias("branch"), stamp("at").alias("last_commit_at"))


@query(f"""WITH {ACTIVITY}, repos AS (SELECT DISTINCT repo FROM act),
cfg AS (SELECT repo, branch, ord FROM repos, (VALUES ('view', 0), ('release', 1)) t(branch, ord)),
a AS (SELECT act.*, row_number() OVER (PARTITION BY repo ORDER BY seen DESC, branch) - 1 AS ord FROM act
      WHERE branch NOT IN ('view', 'release') AND seen >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS)
SELECT cfg.repo, cfg.branch, CASE WHEN act.branch IS NULL THEN 'missing' ELSE 'configured' END AS state, CAST(ord AS INTEGER) AS ordinal
FROM cfg LEFT JOIN act USING (repo, branch)
UNION ALL SELECT repo, branch, 'active', CAST(ord AS INTEGER) FROM a WHERE ord < 2""")
def q_branch_plan(spark, sf_dir):
    held = activity(spark, sf_dir)
    catalog = held.select("repo").distinct().withColumn("branches", F.array(F.lit("view"), F.lit("release")))
    return plan.plan_branches(held, catalog, now(), days=7, most=2)


@query(f"""WITH r AS (SELECT DISTINCT 'user/' || user_id AS repo FROM events),
n AS (SELECT 'user/' || user_id AS repo, max(ts) AS newest FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT repo, CAST(round(epoch(newest)) AS BIGINT) AS newest_s FROM r LEFT JOIN n USING (repo) WHERE newest IS NULL OR newest < TIMESTAMP '{NOW}' - INTERVAL 96 HOURS""")
def q_stale_repos(spark, sf_dir):
    runs = activity(spark, sf_dir).select("repo", F.col("branch").alias("model"), F.date_format("last_commit_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("indexed_at"))
    stale = plan.stale_repos(runs.select("repo"), runs, "view", now(), 96)
    return stale.select("repo", F.round(F.unix_micros("newest") / 1e6).cast("long").alias("newest_s"))


@query(f"""WITH {CORPUS} SELECT repo, branch, count(*) AS pruned FROM corpus WHERE branch = 'dev' AND repo <> 'org/src3' GROUP BY ALL""")
def q_prune(spark, sf_dir):
    chunks = corpus(spark, sf_dir)
    keep = chunks.select("repo").distinct().where("repo <> 'org/src3'").withColumn("branch", F.lit("main"))
    return plan.prunable(chunks, keep).groupBy("repo", "branch").agg(F.count("*").alias("pruned"))


@query("""WITH d AS (SELECT sha256(text) AS h, lang FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT h AS content_hash FROM d WHERE lang <> 'en' AND h NOT IN (SELECT h FROM d WHERE lang = 'en')""")
def q_cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("content_hash"), F.col("text").alias("content"), "lang")
    known = docs.where("lang = 'en'").select(F.lit(MODEL).alias("model"), "content_hash").distinct()
    return cache.cache_misses(docs.where("lang <> 'en'"), known, MODEL).select("content_hash")


@query(r"""WITH c AS (SELECT role AS repo, sha1(conv_id || ':' || turn) AS sha, conv_id AS seen, turn, text FROM conversations),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY seen DESC, sha) AS INTEGER) AS position FROM c)
SELECT repo, position, substr(sha, 1, 7) AS short_sha, CASE WHEN turn = 0 THEN 'opener' WHEN turn = 1 THEN 'login' ELSE 'unknown' END AS author,
       seen AS date, regexp_replace(split_part(text, chr(10), 1), '^\s+|\s+$', '', 'g') AS message
FROM r WHERE position <= 10""")
def q_recent_commits(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    commits = turns.select(
        F.col("role").alias("repo"), F.sha1(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("sha"),
        F.when(F.col("turn") == 0, "opener").alias("author"), F.when(F.col("turn") == 1, "login").alias("login"), F.col("conv_id").alias("date"), F.col("text").alias("message"),
    )
    return reports.recent_commits(commits, 10)


def status(spark, sf_dir):
    """Users as repositories: sign-ups are their pull requests, errors their issues, purchases commits."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("repo"), "event_type", stamp("ts").alias("date"))
    meta = events.groupBy("repo").agg(F.max("date").alias("last_activity"))
    commits = events.where("event_type = 'purchase'").withColumn("sha", F.lit(None).cast("string"))
    pulls = events.where("event_type = 'signup'").withColumn("state", F.lit("open"))
    issues = events.where("event_type = 'error'").withColumns({"state": F.lit("open"), "is_pull": F.lit(False)})
    held = reports.project_status(meta, commits, pulls, issues)
    return held.select("repo", "last_activity", F.col("last_commit.date").alias("last_commit_at"), "open_pull_requests", "open_issues")


STATUS = f"""
s AS (SELECT CAST(user_id AS VARCHAR) AS repo, max(ts) AS a, max(ts) FILTER (event_type = 'purchase') AS c,
        count(*) FILTER (event_type = 'signup') AS open_pull_requests, count(*) FILTER (event_type = 'error') AS open_issues
      FROM events GROUP BY user_id),
d AS (SELECT *, greatest(0, CAST(floor(epoch(TIMESTAMP '{NOW}' - a) / 86400) AS BIGINT)) AS da,
        CASE WHEN c IS NOT NULL THEN greatest(0, CAST(floor(epoch(TIMESTAMP '{NOW}' - c) / 86400) AS BIGINT)) END AS dc FROM s),
cmp AS (SELECT CAST(c_custkey AS VARCHAR) AS repo, d.repo IS NOT NULL AS ok, open_pull_requests, open_issues, da AS days_since_activity, dc AS days_since_commit,
          CASE WHEN da IS NOT NULL AND dc IS NOT NULL THEN greatest(0, dc - da) END AS commit_gap_days
        FROM customer LEFT JOIN d ON d.repo = CAST(c_custkey AS VARCHAR))
"""


def compared(spark, sf_dir):
    requested = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("repo"))
    return reports.compare_status(requested, status(spark, sf_dir), now())


@query(f"WITH {STATUS} SELECT * FROM cmp")
def q_compare_status(spark, sf_dir):
    return compared(spark, sf_dir)


@query(f"""WITH {STATUS} SELECT count(*) AS requested, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
CAST(coalesce(sum(open_pull_requests), 0) AS BIGINT) AS open_pull_requests, CAST(coalesce(sum(open_issues), 0) AS BIGINT) AS open_issues FROM cmp""")
def q_compare_summary(spark, sf_dir):
    return reports.compare_summary(compared(spark, sf_dir))


@query(f"""WITH {ACTIVITY}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY seen DESC NULLS LAST, branch) AS INTEGER) AS position, count(*) OVER (PARTITION BY repo) AS total FROM act)
SELECT repo, position, total, branch, branch IN ('view', 'click') AS indexed FROM r WHERE position <= 3""")
def q_list_branches(spark, sf_dir):
    held = activity(spark, sf_dir)
    runs = held.where(F.col("branch").isin("view", "click")).select("repo", "branch", F.col("last_commit_at").alias("indexed_at"))
    return reports.list_branches(held, runs, 3).drop("last_commit_at", "indexed_at")


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_type AS branch, count(*) AS files FROM events WHERE event_type <> 'error' GROUP BY ALL),
n AS (SELECT repo, string_agg(branch || ':' || files, ',' ORDER BY branch) AS b FROM r GROUP BY repo)
SELECT CAST(c_custkey AS VARCHAR) AS repo, c_mktsegment AS description, coalesce(b, '') AS indexed_branches FROM customer LEFT JOIN n ON n.repo = CAST(c_custkey AS VARCHAR)""")
def q_list_projects(spark, sf_dir):
    catalog = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("repo"), F.col("c_mktsegment").alias("description"))
    runs = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("branch"))
    runs = runs.agg(F.count("*").alias("files"), F.count("*").alias("chunks"), F.max(stamp("ts")).alias("indexed_at"))
    listed = F.array_join(F.transform("indexed_branches", lambda b: F.concat_ws(":", b["branch"], b["files"].cast("string"))), ",")
    return reports.list_projects(catalog, runs).select("repo", "description", listed.alias("indexed_branches"))


@query("""WITH f AS (SELECT source AS repo, text, lang, doc_id, CASE lang WHEN 'es' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 4 END AS o FROM documents WHERE lang <> 'en'),
g AS (SELECT repo, o, text, row_number() OVER (PARTITION BY repo ORDER BY o, doc_id) AS rn FROM f)
SELECT repo, ['README.md', 'readme.md', 'README.MD', 'README'][o] AS path, substr(text, 1, 2000) AS excerpt, length(text) > 2000 AS truncated FROM g WHERE rn = 1""")
def q_readme_fallback(spark, sf_dir):
    name = F.when(F.col("lang") == "es", "README.md").when(F.col("lang") == "fr", "readme.md").when(F.col("lang") == "de", "README")
    files = table(spark, sf_dir, "documents").where("lang <> 'en'").groupBy(F.col("source").alias("repo"), name.alias("path"))
    return reports.readme_excerpt(files.agg(F.min_by("text", "doc_id").alias("content")))


@query("""SELECT source, count(*) AS files, count(*) FILTER (strlen(coalesce(text, '')) > 5000) AS skipped, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY source""")
def q_size_filter(spark, sf_dir):
    held = plan.size_filter(table(spark, sf_dir, "documents"), 5000, "text")
    return held.groupBy("source").agg(F.count("*").alias("files"), F.count("skipped").alias("skipped"), F.sum("size_bytes").alias("bytes"))


@query(f"""WITH {CORPUS},
f AS (SELECT sha256(content) AS h, repo, branch, path, row_number() OVER (PARTITION BY sha256(content) ORDER BY repo, ord, path) AS rn FROM corpus),
t AS (SELECT repo, branch, count(DISTINCT path) AS files, count(*) AS chunks, count(*) FILTER (rn = 1) AS embedded, count(DISTINCT h) - count(*) FILTER (rn = 1) AS reused,
        CASE WHEN repo = 'org/src5' AND branch = 'dev' THEN 'rate limit' END AS error FROM f GROUP BY ALL)
SELECT count(DISTINCT repo) AS repos, count(*) FILTER (error IS NULL) AS branches,
  CAST(sum(files) FILTER (error IS NULL) AS BIGINT) AS files, CAST(sum(chunks) FILTER (error IS NULL) AS BIGINT) AS chunks,
  CAST(sum(embedded) FILTER (error IS NULL) AS BIGINT) AS embedded, CAST(sum(reused) FILTER (error IS NULL) AS BIGINT) AS reused,
  count(DISTINCT CASE WHEN error IS NOT NULL THEN repo END) AS failed FROM t""")
def q_refresh_summary(spark, sf_dir):
    counts = q_embed_first_occurrence(spark, sf_dir)
    files = corpus(spark, sf_dir).groupBy("repo", "branch").agg(F.countDistinct("path").alias("files"))
    error = F.when((F.col("repo") == "org/src5") & (F.col("branch") == "dev"), "rate limit")
    return reports.refresh_summary(counts.join(files, ["repo", "branch"]).withColumn("error", error))


@query("""WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL),
r AS (SELECT ' ' || upper(source) || ' ' AS reference, source AS alias FROM s UNION ALL SELECT 'ORG/' || source, source FROM s UNION ALL SELECT source || '?', NULL FROM s)
SELECT reference, alias FROM r""")
def q_resolve(spark, sf_dir):
    known = table(spark, sf_dir, "documents").where("source IS NOT NULL").groupBy(F.col("source").alias("alias")).agg(F.min("doc_id").alias("ordinal"))
    catalog = known.select("alias", F.concat(F.lit("repo-"), "alias").alias("repo"), F.concat(F.lit("org/"), "alias").alias("full_name"), "ordinal")
    spelled = F.array(F.concat(F.lit(" "), F.upper("alias"), F.lit(" ")), F.concat(F.lit("ORG/"), "alias"), F.concat("alias", F.lit("?")))
    return plan.resolve(known.select(F.explode(spelled).alias("reference")), catalog)


@query("""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS repo, CAST(event_id AS VARCHAR) AS sha, event_type, CAST(ts AS VARCHAR) AS seen FROM events),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY seen DESC, sha) AS INTEGER) AS position FROM r)
SELECT repo, position, substr(sha, 1, 7) AS short_sha, event_type AS author, event_type AS message FROM n WHERE position <= 3""")
def q_source_commits(spark, sf_dir):
    """Events read as commits by the data source of projects."""
    commits = projects.read(spark, "commits", path=f"{sf_dir}/events.parquet", repo="user_id", field_sha="event_id", field_login="event_type", field_date="ts", field_message="event_type")
    return reports.recent_commits(commits, 3).drop("date")
