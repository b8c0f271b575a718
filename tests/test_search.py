"""Keyword scores against SQLite's own full-text index; ranks, scopes and ties of hybrid search."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import vectors as vx
from quillspark.operators import search

ROWS = [
    (1, "o/a", "a", "main", "README.md", "Pagos", "El pago con tarjeta se hace en la página", [1.0, 0.0]),
    (2, "o/a", "a", "dev", "README.md", "Pagos", "El pago con tarjeta se hace en la página", [1.0, 0.0]),
    (3, "o/a", "a", "main", "docs/x.md", "Turnos", "reserva de turnos, pago de señas y más", [0.6, 0.8]),
    (4, "o/b", "b", "main", "docs/y.md", "Login", "token de acceso pago", [0.0, 1.0]),
    (5, "o/b", "b", "main", "docs/z.md", "Otros", "nada que ver aquí", [0.0, 0.0]),
]
SCHEMA = "chunk_id long, repo string, alias string, branch string, path string, heading string, content string, embedding array<double>"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ask(spark, text, q=(1.0, 0.0)):
    return spark.createDataFrame([(0, text, list(q))], "query_id long, query string, q array<double>")


def test_bm25_is_that_of_fts5(spark, chunks):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(heading, path, content, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into f(rowid, heading, path, content) values (?, ?, ?, ?)", [(r[0], r[5], r[4], r[6]) for r in ROWS])
    want = dict(con.execute("select rowid, -bm25(f, 3.0, 1.0, 1.0) from f where f match '\"pago\" OR \"tarjeta\" OR \"docs\"'").fetchall())
    got = {r["chunk_id"]: r["bm25"] for r in search.bm25(ask(spark, "pago tarjeta docs"), search.index_of(chunks)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_words_are_folded_as_fts5_folds_them(spark):
    """Letters of the Latin blocks, and letters followed by combining marks."""
    letters = [chr(c) for c in (*range(0x41, 0x250), *range(0x1E00, 0x1F00)) if chr(c).isalpha()]
    texts = [*(f"x{c}y" for c in letters), "pa\u0301gina tie\u0302\u0301ng", "tiếng página Ñandú"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize='unicode61 remove_diacritics 2')")
    con.execute("create virtual table v using fts5vocab(f, 'instance')")
    con.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(texts, 1)))
    want: dict[int, list[str]] = {}
    for term, doc in con.execute("select term, doc from v order by doc, offset"):
        want.setdefault(doc, []).append(term)
    rows = spark.createDataFrame(list(enumerate(texts, 1)), "n int, t string")
    got = {r["n"]: r["w"] for r in rows.select("n", tx.tokens(F.col("t")).alias("w")).collect()}
    assert got[len(texts) - 1] == ["pagina", "tieng"] and got[len(texts)] == ["tieng", "pagina", "nandu"]
    other = [(texts[n - 1], got[n], want.get(n)) for n in got if got[n] != want.get(n)]
    assert other == []


def test_semantic_ranks_are_counted(spark, monkeypatch):
    import numpy as np

    from quillspark.operators import nearest

    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 5)).round(1)
    q = rng.normal(size=(7, 5)).round(1)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, [1.0]), (901, None)], "chunk_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, q array<double>")
    scores = np.round(v @ q.T, 9)
    order = [sorted(range(300), key=lambda j: (-scores[j, i], j)) for i in range(7)]
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in nearest.top(asked, vectors, 4).collect()}
    assert got == {(i, r + 1): order[i][r] for i in range(7) for r in range(4)}
    hits = spark.createDataFrame([(i, j, float(v[j] @ q[i])) for i in range(7) for j in (0, 17, 150)] + [(0, 900, None)], "query_id long, chunk_id long, semantic double")
    hits = hits.selectExpr("query_id", "chunk_id", "round(semantic, 9) AS semantic").where("semantic IS NOT NULL")
    want = {(i, j): order[i].index(j) + 1 for i in range(7) for j in (0, 17, 150)} | {(i, order[i][r]): r + 1 for i in range(7) for r in range(4)}
    for most in (nearest.MOST_BROADCAST, 0):  # queries broadcast, and met by a join
        monkeypatch.setattr(nearest, "MOST_BROADCAST", most)
        assert {(r["query_id"], r["chunk_id"]): r["semantic_rank"] for r in nearest.with_hits(asked, vectors, 4, hits).collect()} == want
        assert {(r["query_id"], r["rank"]): r["chunk_id"] for r in nearest.top(asked, vectors, 4).collect()} == got
    assert {r["semantic_rank"] for r in nearest.with_hits(asked, vectors, 1, hits.limit(0)).collect()} == {1}


def test_hits_of_one_text_are_one(spark, chunks):
    hits = search.hybrid_search(ask(spark, "como se hace el pago"), chunks).orderBy("position").collect()
    assert hits[0]["branches"] == ["main", "dev"] and hits[0]["matched_by"] == "both"
    assert [h["position"] for h in hits] == [1, 2, 3, 4]
    assert hits[-1]["keyword_rank"] is None and hits[-1]["matched_by"] == "semantic"


def test_scope_and_dimension(spark, chunks):
    hits = search.hybrid_search(ask(spark, "pago"), chunks, repo="o/b").collect()
    assert {h["repo"] for h in hits} == {"o/b"}
    assert search.hybrid_search(ask(spark, "pago", (1.0, 0.0, 0.0)), chunks).collect() == []
    assert len(search.hybrid_search(ask(spark, "pago"), chunks, repo="", branch="").collect()) == 4


def test_chunks_without_vector_are_found_by_their_words(spark):
    rows = [*ROWS, (6, "o/c", "c", "main", "docs/w.md", "Pago", "pago pago pago tarjeta", None), (7, "o/c", "c", "main", "docs/v.md", "Otros", "nada", None)]
    held = spark.createDataFrame(rows, SCHEMA)
    hits = {h["chunk_id"]: h for h in search.hybrid_search(ask(spark, "pago tarjeta"), held, limit=9).collect()}
    assert set(hits) == {1, 3, 4, 5, 6}
    assert (hits[6]["matched_by"], hits[6]["keyword_rank"], hits[6]["semantic_score"], hits[6]["score"]) == ("keyword", 1, None, round(1 / 61, 5))
    assert hits[1]["matched_by"] == "both" and hits[5]["matched_by"] == "semantic"


def test_no_terms_leaves_meaning_alone(spark, chunks):
    assert {h["matched_by"] for h in search.hybrid_search(ask(spark, "de la el"), chunks).collect()} == {"semantic"}


def test_query_terms(spark):
    rows = [("pagos con tarjeta",), ("como se hace el pago",), ("cómo \"AND\" (x OR pago*) pago",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "q string").select(tx.query_terms(F.col("q"))).collect()]
    assert got == [["pagos", "tarjeta"], ["pago"], ["cómo", "pago"], [], []]


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), ([float("nan")],)]
    got = spark.createDataFrame(rows, "v array<double>").select(vx.normalized(F.col("v")), vx.is_valid(F.col("v"))).collect()
    assert got[0][0] == [0.6, 0.8] and got[1][0] == [0.0, 0.0]
    assert [r[1] for r in got] == [True, True, False, False]


def test_paths(spark):
    rows = [("/docs/a.md",), ("docs/../x",), ("  ",), ("a.md",)]
    assert [r[0] for r in spark.createDataFrame(rows, "p string").select(tx.clean_path(F.col("p"))).collect()] == ["docs/a.md", None, None, "a.md"]
    cases = [("a.MDX", "**", True), ("x/a.md", "*.md", False), ("a.md", "*.md", True), ("docs/x/a.md", "docs/**", True), ("docs/a.ts", "docs/**", False), ("a.ts", "a.ts", True)]
    got = spark.createDataFrame(cases, "p string, g string, w boolean").select(tx.matches_pattern(F.col("p"), F.col("g")).alias("m"), "w").collect()
    assert all(r["m"] == r["w"] for r in got)


def test_term_counts_hold_no_pairs_of_term_and_chunk(spark, chunks, monkeypatch):
    from quillspark.queries import QUERIES

    want: dict[str, list] = {}
    for r in ROWS:
        words = [w for t in (r[5], r[4], r[6]) for w in spark.range(1).select(tx.tokens(F.lit(t))).first()[0]]
        for w in words:
            held = want.setdefault(w, [set(), 0])
            held[0].add(r[0])
            held[1] += 1
    got = {r["term"]: r for r in search.term_counts(chunks).collect()}
    assert {t: (r["df"], r["cf"]) for t, r in got.items()} == {t: (len(ids), n) for t, (ids, n) in want.items()}
    total = sum(n for _, n in want.values())
    assert {(r["n"], round(r["avgdl"], 9)) for r in got.values()} == {(len(ROWS), round(total / len(ROWS), 9))}
    assert search.term_counts(chunks.limit(0)).collect() == []
    monkeypatch.delattr(search, "postings")
    assert QUERIES["q_bm25_stats"](spark, "/root/testdata/sf0.001").count() > 0


def test_chunks_are_dealt_to_tasks_of_a_size(spark, monkeypatch):
    rows = [(i, f"h{i % 3}", f"p/{i}.md", f"pago {'tarjeta ' * (i % 5)} x{i % 7}") for i in range(2000)]
    held = spark.createDataFrame(rows, "chunk_id long, heading string, path string, content string")
    terms = search.terms_of(ask(spark, "pago tarjeta"))
    monkeypatch.setattr(search, "CHUNKS", 20)
    index = search.index_of(held, terms)
    assert index.postings.rdd.getNumPartitions() == 100
    asked = ask(spark, "pago tarjeta")
    want = [r for r in search.keyword_ranks(search.bm25(asked, index), held.select("chunk_id")).collect()]
    some = search.index_of(held, terms, held.where("chunk_id < 900"))
    assert {r["chunk_id"] for r in some.postings.select("chunk_id").distinct().collect()} == set(range(900))
    assert sorted(some.terms.collect()) == sorted(index.terms.collect()) and some.stats.collect() == index.stats.collect()
    got = search.keyword_ranks(search.bm25(asked, index), held.select("chunk_id"), within=True).collect()
    key = lambda r: (r["query_id"], r["keyword_rank"], r["chunk_id"], round(r["bm25"], 9))
    assert len(want) == search.KEYWORD_LIMIT and sorted(map(key, got)) == sorted(map(key, want))


def test_only_the_scope_has_postings(spark, chunks, monkeypatch):
    seen, whole = [], search.index_of
    monkeypatch.setattr(search, "index_of", lambda *a: seen.append(whole(*a)) or seen[-1])
    hits = search.hybrid_search(ask(spark, "pago tarjeta"), chunks, branch="dev").collect()
    assert [(h["chunk_id"], h["keyword_rank"], h["branches"]) for h in hits] == [(2, 1, ["dev"])]
    assert {r["chunk_id"] for r in seen[0].postings.collect()} == {2}
    assert {r["term"]: r["df"] for r in seen[0].terms.collect()} == {"pago": 4, "tarjeta": 2} and seen[0].stats.first()["n"] == 5


def test_texts_stay_where_they_lie_when_vectors_come(spark, monkeypatch):
    from quillspark import queries

    seen, joined = [], queries.with_vectors
    monkeypatch.setattr(queries, "with_vectors", lambda s, d, c: seen.append(c.columns) or joined(s, d, c))
    assert queries.QUERIES["q_hybrid_scoped"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 1 and "content" not in seen[0] and "content_hash" in seen[0]
