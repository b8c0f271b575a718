"""Keyword hits from blocks against full scoring, and how many blocks stay closed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import shared
from quillspark.operators import blockmax, search

SCHEMA = "chunk_id long, repo string, heading string, path string, content string"


def texts(n, seed=3, repos=3, words=60):
    """Texts of very different lengths with words of very different frequencies; some repeat."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        some = rng.zipf(1.4, size=int(rng.integers(1, 90))) % words
        rows.append((i * 7, f"r{i % repos}" if i % 11 else None, "cabeza" if i % 5 else None, f"docs/{i % 4}.md", " ".join(f"palabra{w}" for w in some)))
    return rows + [(10**6 + i, *rows[i % 9][1:]) for i in range(20)] + [(10**7, "r0", None, None, ""), (10**7 + 1, "r0", None, None, None)]


def built(spark, rows, near=("repo",)):
    chunks = spark.createDataFrame(rows, SCHEMA)
    index = search.index_of(chunks)
    posted = shared.materialize(search.postings(chunks, carry=near), "postings")
    return chunks, index, shared.materialize(blockmax.blocks_of(posted, near), "blocks")


def ask(spark, *questions):
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")


def rows_of(df):
    return sorted((r["query_id"], r["keyword_rank"], r["chunk_id"], round(r["bm25"], 9)) for r in df.collect())


QUESTIONS = ["palabra1 palabra2", "palabra30", "palabra1 palabra17 palabra41 cabeza docs", "nunca", "", None, "de la el"]


@pytest.mark.parametrize("near, limit", [((), 7), (("repo",), 1), (("repo",), 400)])
def test_hits_are_those_of_full_scoring(spark, monkeypatch, near, limit):
    monkeypatch.setattr(blockmax, "SIZE", 4)
    chunks, index, blocks = built(spark, texts(300), near)
    asked = ask(spark, *QUESTIONS)
    for scope in (chunks, chunks.where("repo = 'r1' OR repo IS NULL"), chunks.limit(0)):
        scope = scope.select("chunk_id", "path")
        want = search.keyword_ranks(search.bm25(asked, index), scope, limit)
        found = blockmax.top(asked, blocks, index, scope, limit)
        assert rows_of(found.hits) == rows_of(want)
        assert set(found.hits.columns) == set(want.columns)
        for r in found.blocks.collect():
            assert 0 < r["opened"] <= r["blocks"] and r["query_id"] in (0, 1, 2)


def test_joins_in_place_of_broadcasts(spark, monkeypatch):
    chunks, index, blocks = built(spark, texts(120))
    asked, scope = ask(spark, *QUESTIONS), chunks.select("chunk_id")
    want = rows_of(search.keyword_ranks(search.bm25(asked, index), scope, 5))
    monkeypatch.setattr(search, "MOST_TERMS", 0)
    assert rows_of(blockmax.top(asked, blocks, index, scope, 5).hits) == want


def test_blocks_hold_every_posting_once(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "SIZE", 5)
    chunks, _, blocks = built(spark, texts(200))
    key = ["term", "chunk_id", "wtf", "tf", "dl"]
    assert sorted(map(tuple, blockmax.postings_of(blocks).select(key).collect())) == sorted(map(tuple, search.postings(chunks).select(key).collect()))
    for r in blocks.collect():
        assert (r["most"], r["least"], r["hits"]) == (max(e["wtf"] for e in r["entries"]), min(e["dl"] for e in r["entries"]), len(r["entries"]))
        assert len(r["entries"]) <= 20 and max(e["dl"] for e in r["entries"]) <= 1.2 * r["least"]


def test_empty_index(spark):
    chunks, index, blocks = built(spark, [])
    found = blockmax.top(ask(spark, "pago"), blocks, index, chunks.select("chunk_id"))
    assert found.hits.collect() == [] and found.blocks.collect() == []


def test_blocks_without_the_rare_word_stay_closed(spark):
    """A frequent word is in every block; a rare one, in few. The best ten have both."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(6000):
        filler = " ".join(f"w{x}" for x in rng.integers(0, 400, size=20))
        rows.append((i, f"r{i // 300}", "t", "p", f"comun {filler}" + (" rara" if 900 <= i < 930 else "")))
    chunks, index, blocks = built(spark, rows)
    asked, scope = ask(spark, "comun rara"), chunks.select("chunk_id")
    found = blockmax.top(asked, blocks, index, scope, 10)
    assert rows_of(found.hits) == rows_of(search.keyword_ranks(search.bm25(asked, index), scope, 10))
    told = found.blocks.first()
    assert told["blocks"] >= 150 and told["opened"] < 0.1 * told["blocks"]
