"""Operator 11 against a plain tree and, as registered, against SQL."""

import hashlib
import os
import random
import zlib

import duckdb
import pytest

from quillspark.llm import merkle, registry

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level):
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
    return levels


def climb(levels, place, own):
    """Siblings and the folded hash of a node of the lowest level."""
    siblings = []
    for level in levels[:-1]:
        run = level[place & ~1 : (place & ~1) + 2]
        siblings += [x for k, x in enumerate(run) if k != place & 1]
        own = h("".join(own if k == place & 1 else x for k, x in enumerate(run)))
        place //= 2
    return siblings, own


def plain(rows):
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = {}
    for d, s, lang, n, t in rows:
        more = n is not None and d is not None and zlib.crc32(str(d).encode()) % 7 == 0
        groups.setdefault(lang, []).append((order(d), leaf((d, s, lang, n, t)), leaf((d, s, lang, n + 1 if more else n, t)), d))
    trees = []
    for lang in sorted(groups, key=order):
        groups[lang].sort(key=lambda x: x[:2])
        trees.append(tree([x[1] for x in groups[lang]]))
    top = tree([t[-1][0] for t in trees])
    for g, lang in enumerate(sorted(groups, key=order)):
        for place, (_, own, changed, d) in enumerate(groups[lang]):
            a, folded = climb(trees[g], place, changed)
            b, folded = climb(top, g, folded)
            yield d, own, trees[g][-1][0], top[-1][0], h("".join(a + b)), folded, folded == top[-1][0]


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("n,langs", [(0, 1), (1, 1), (2, 2), (17, 1), (300, 4), (2500, 300)])
def test_against_a_plain_tree(spark, n, langs):
    """Nulls in every column, repeated ids and rows, a null id, clashing names, many and few groups."""
    r = random.Random(n)
    names = [None, "en", "", "é", *(f"l{k}" for k in range(langs))][-langs:]
    rows = [(r.choice([None, *range(40), 2**62]), r.choice(["a", None]), names[0] if r.random() < 0.5 else r.choice(names), r.choice([None, 5, 2**63 - 1]), r.choice([None, "", "long " * 2000, f"t{i}"])) for i in range(n)]
    rows += rows[: n // 10]
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "'x' AS page", "7 AS row", "'own' AS leaf", "1 AS level").repartition(3)
    got = merkle.verify(docs).collect()
    assert by_text(got) == by_text(plain(rows))
    if n > 100:
        assert 0 < sum(x["verified"] for x in got) < len(got)


def test_one_row_makes_most_of_the_table(spark):
    rows = [(3, "s", "en", 1, "same")] * 700 + [(i, "s", "en", 1, "t") for i in range(700)]
    assert by_text(merkle.verify(spark.createDataFrame(rows, KIND)).collect()) == by_text(plain(rows))


def test_pages_are_linked_and_chunks_bounded(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'s' AS source", "if(id < 4900, 'a', 'b') AS lang", "1L AS n_chars", "'t' AS text")
    leaves, pages = merkle.build(merkle.leaves_of(docs))
    rows = pages.collect()
    held = {(p["tree"], p["chunk"], p["level"], p["page"]) for p in rows}
    assert len(held) == len(rows)
    assert all(p["up"] is None or (p["tree"], p["chunk"], p["level"] + 1, p["up"]) in held for p in rows)
    assert leaves.groupBy("tree", (leaves["at"] / 1024).cast("int")).count().agg({"count": "max"}).first()[0] <= 1024
    assert sum(p["up"] is None for p in rows) == len({(p["tree"], p["chunk"]) for p in rows})


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_registered_against_sql(spark, folder):
    got = registry.QUERIES["op11_merkle_manifest"](spark, folder).collect()
    con = duckdb.connect()
    path = f"{folder}/documents.parquet"
    con.execute(f"create view documents as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    assert got and by_text(got) == by_text(con.execute(f"select {', '.join(got[0].__fields__)} from ({registry.ORACLES['op11_merkle_manifest']})").fetchall())
