"""Each operator against plain Python, with nulls, empty and long texts, ties, repeats, empty tables
and columns whose names clash."""

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import common, components, decontaminate, html, knn, language, packing, quality, sharding, simhash, suffixes, token_files, tokens

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards pack a box with jugs of liquor; "
TEXTS = [
    None, "", "a", " \n ", PASSAGE * 3, PASSAGE * 3, "start " + PASSAGE * 2 + "end", "x" * 300, "x" * 120, "é" * 70, "naïve ñandú " * 40,
    "long " * 9000, "long " * 9000 + "tail", PASSAGE[:49], PASSAGE[:50], "a <|endoftext|> b\t\nc ’tis 12 ½ 日本 <|EndOfText|>", "😀" * 30,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, None, 7, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], 1, "g", None, "y"), (3, TEXTS[3], 1, "g", None, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, length long, g string, piece int, found string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def raw(text):
    return (text or "").encode()


def listed(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# --- tokens, packing, files


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_whole_texts(name):
    encoder, plain = tokens.Encoder(common.tokenizer_path(name)), Tokenizer.from_file(common.tokenizer_path(name))
    check = lambda t: [x.tolist() for x in encoder.ids(t)] == [plain.encode(x, add_special_tokens=False).ids for x in t]
    special = plain.token_to_id("<|endoftext|>")
    assert special in encoder.ids(["a <|endoftext|> b"])[0].tolist()
    assert check([t or "" for t in TEXTS])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet="aBé1 \n\t'_.,$ßſµ²ª  –€İ\x1c\x85日", max_size=30), max_size=4))
    def some(texts):
        assert check(texts)
        assert check([f"{t}<|endoftext|>{t}" for t in texts])

    some()


def test_fullest_is_fullest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        room = int(rng.integers(1, 30))
        counts = [0, *rng.integers(0, 3, int(rng.integers(1, 15))).tolist()]
        reach = {0}
        for n, c in enumerate(counts):
            for _ in range(c):
                reach |= {r + n for r in reach}
        used = packing.fullest(counts, room)
        assert all(k <= counts[n] for n, k in used.items())
        assert sum(n * k for n, k in used.items()) == max(r for r in reach if r <= room)


def test_packing(docs, empty):
    got = packing.pack_documents(docs, capacity=256).toPandas()
    plain = Tokenizer.from_file(common.tokenizer_path(packing.TOKENIZER))
    whole = {i: plain.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(TEXTS)}
    for i, part in got[got["doc_id"].notna() & (got["doc_id"] != 3)].groupby("doc_id"):
        part = part.sort_values("piece")
        assert np.frombuffer(b"".join(part["ids"]), "<u2").tolist() == whole[i]
        assert (part["length"].iloc[:-1] == 256).all() and [len(x) // 2 for x in part["ids"]] == part["length"].tolist()
    assert (got["doc_id"] == 3).sum() == 2 and got["doc_id"].isna().sum() == 1
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() <= 256
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 256) + 1
    assert packing.pack_documents(empty).count() == 0


def test_token_files_round_trip(spark, docs, empty):
    folder = common.scratch(spark, "t")
    got = token_files.read_tokens(token_files.write_tokens(docs, folder, parts=4), folder).toPandas().sort_values("start")
    plain = Tokenizer.from_file(common.tokenizer_path(token_files.TOKENIZER))
    held = sorted(listed(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc, text), row in zip(held, got.itertuples()):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(held)
    folder = common.scratch(spark, "t")
    assert token_files.read_tokens(token_files.write_tokens(empty, folder), folder).count() == 0


# --- sharding


def test_sharding(docs, empty):
    got = sharding.shard_uniform(docs, 4)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert sorted(listed(got), key=str) == sorted(listed(docs), key=str)
    got = got.toPandas()
    sizes = got.groupby("shard")["slot"].agg(list)
    assert sorted(map(len, sizes)) == [4, 5, 5, 5] and all(sorted(s) == list(range(len(s))) for s in sizes)
    assert sharding.shard_uniform(docs.limit(0), 4).count() == 0
    clash = sharding.shard_uniform(docs.withColumns({"Shard": F.lit(-1), "_rank": F.lit("r")}), 4)
    assert clash.columns[-4:] == ["Shard", "_rank", "_shard", "slot"] and {(r["Shard"], r["_rank"]) for r in clash.collect()} == {(-1, "r")}


def test_communication_matrix():
    import random

    rng = random.Random(1)
    for sizes in ([], [0, 0], [1], [5, 0, 7, 100, 3]):
        m = sharding.communication_matrix(sizes, 4, rng)
        assert [sum(r) for r in m] == sizes and (not m or max(map(sum, zip(*m))) - min(map(sum, zip(*m))) <= 1)
    for good, bad, draws in ((10**12 // 16, 10**12 * 15 // 16, 10**9), (7 * 10**10, 10**6, 10**7)):
        mean = draws * good / (good + bad)
        var = mean * bad / (good + bad) * (good + bad - draws) / (good + bad - 1)
        got = [sharding.hypergeometric(good, bad, draws, rng) for _ in range(1500)]
        assert abs(np.mean(got) - mean) < 5 * (var / 1500) ** 0.5 and 0.8 < np.var(got) / var < 1.2
    draws = [sharding.hypergeometric(30, 70, 20, rng) for _ in range(20_000)]
    assert abs(np.mean(draws) - 6) < 0.06 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.15


# --- simhash, components


def plain_fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(text))) if x]
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = [t for t in TEXTS] + ["A b\x0bC d", "é  x y"]
    assert simhash.fingerprints([raw(t) for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("blocks, bucket", [(4, 1 << 20), (5, 1 << 20), (None, 3)])
def test_links_connect_what_is_near(spark, blocks, bucket):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(x) for x in rng.integers(0, 64, int(rng.integers(0, 6))))) for b in base for _ in range(8)]
    values = np.unique(np.concatenate([base, np.array(near, np.uint64), [np.uint64(0), np.uint64(7), np.uint64(2**64 - 1)]]))
    a, b = np.nonzero(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3, 1))
    want = simhash.spanning(len(values), a, b)
    links = simhash.link_fingerprints(spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp long"), 3, blocks, bucket).toPandas()
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    got = simhash.spanning(len(values), np.array([at[x] for x in links["a"]]), np.array([at[x] for x in links["b"]]))
    assert (got == want).all()


def test_many_near_ones_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 64)
    near = np.unique(np.array([(1 << a | 1 << b) ^ (1 << 40) for a in range(30) for b in range(30)] + [15 << 55, 255 << 50], np.uint64))
    a, b = np.nonzero(np.triu(np.bitwise_count(near[:, None] ^ near[None, :]) <= 3, 1))
    root = simhash.trie_forest(near, 64, 3)
    assert (root == simhash.spanning(len(near), a, b)).all() and len(set(root)) == 3


def test_near_duplicates(docs, empty):
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(4, 4), (5, 4), (None, 4), (0, 0), (1, 0), (3, 0)} <= got and len(got) == len(TEXTS) + 1
    assert simhash.near_duplicates(empty).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffixes


def plain_spans(held, size):
    first = {}
    for doc, text in held:
        b, own = raw(text), suffixes.NO_ID if doc is None else doc
        for k in range(len(b) - size + 1):
            first[b[k : k + size]] = min(own, first.get(b[k : k + size], own))
    out = []
    for doc, text in held:
        b, own = raw(text), suffixes.NO_ID if doc is None else doc
        covered = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < own:
                covered[k : k + size] = True
        out.append((doc, len(b), int(covered.sum()), bytes(np.frombuffer(b, np.uint8)[~covered])))
    return sorted(out, key=str)


def removed(got):
    return sorted([(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) for r in got], key=str)


@pytest.mark.parametrize("pack_bytes, starts", [(200, 300), (1 << 20, 1 << 20)])
def test_substrings(docs, empty, pack_bytes, starts):
    got = suffixes.dedup_substrings(docs, pack_bytes=pack_bytes, starts=starts).collect()
    assert removed(got) == plain_spans(listed(docs), 50)
    assert suffixes.dedup_substrings(empty).count() == 0


def test_substrings_at_every_distance(spark, monkeypatch):
    """Passages at all places modulo 3, edited copies, a common phrase, repeated and extreme doc_ids."""
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    passages = [word(int(n)) for n in rng.integers(45, 140, 12)]
    rows = []
    for i in range(240):
        text = word(int(rng.integers(0, 90)))
        for _ in range(int(rng.integers(0, 3))):
            text += passages[int(rng.integers(12))] + word(int(rng.integers(0, 60)))
        if i % 5 == 0 and rows:
            other = rows[int(rng.integers(len(rows)))][1]
            at = int(rng.integers(len(other) + 1))
            text = other[:at] + word(int(rng.integers(0, 4))) + other[at:]
        rows.append((i if i % 11 else 7, text + " one phrase that stands in all of them " + word(i % 40)))
    rows += [((1 << 63) - 1, passages[0] * 2), (-5, passages[1] * 3), (None, passages[0] * 3)]
    held = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_spans(rows, 50)
    assert sum(x[2] > 0 for x in want) > 80
    for pack_bytes, starts in ((2000, 400), (1 << 20, 1 << 20), (8000, 50)):
        assert removed(suffixes.dedup_substrings(held, pack_bytes=pack_bytes, starts=starts).collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=5, max_size=7), min_size=1, max_size=40))
def test_merge_sorts_all_classes(strings):
    """Strings of five characters, their ranks those of the three in the middle or at either end."""
    names = {x: i for i, x in enumerate(sorted({s[k : k + 3] for s in strings for k in range(3)}))}
    classes = [[], [], []]
    for i, s in enumerate(strings):
        s = s[:5]
        r = [names[s[k : k + 3]] for k in range(3)]
        kept = {0: (0, r[1], r[2]), 1: (r[0], r[1], 0), 2: (r[0], 0, r[2])}[i % 3]
        classes[i % 3].append((ord(s[0]), ord(s[1]), ord(s[3]), ord(s[4]), *kept, s))
    zero, one, two = ([np.array([row[k] for row in c], np.int64) for k in range(7)] for c in classes)
    text = [row[7] for c in (1, 2, 0) for row in classes[c]]
    order, new = suffixes.merge(one, two, zero)
    line = [text[i] for i in order]
    assert line == sorted(text) and new.tolist() == [k == 0 or line[k] != line[k - 1] for k in range(len(line))]


@pytest.mark.parametrize("wide, classes", [(18, False), (48, False), (50, True)])
def test_ranges_part_a_common_prefix(wide, classes):
    """Strings with one prefix of 16 bytes go to many ranges, in order, and equal ones to one range."""
    rng = np.random.default_rng(3)
    texts = ["sixteen bytes .." + "".join(rng.choice(list("ab"), 40)) for _ in range(120)]
    text = np.frombuffer("".join(t + t[:43] for t in texts).encode(), np.uint8)
    held = suffixes.Left(suffixes._squeeze(np.arange(120) * 200, np.full(120, 50), np.arange(120) % 7, text), 50)
    place, owner = held.starts(wide, False)
    string = [text[p : p + wide].tobytes() for p in place]
    picked = sorted(string)[40::100]
    splits = suffixes.Left.words(type("", (), {"text": np.frombuffer(b"".join(picked), np.uint8)}), np.arange(len(picked)) * wide, wide)
    keys = held.names(place, wide)
    own = suffixes.Distinct(held, place, wide, [place % 3, *keys] if classes else keys, owner, splits, classes)
    seen = set()
    for b, part in own.parts():
        mine = [text[p : p + wide].tobytes() for p in own.at[part]]
        assert all((b == 0 or x >= picked[b - 1]) and (b == len(picked) or x < picked[b]) for x in mine)
        kinds = (own.at[part] % 3).tolist() if classes else [0] * len(mine)
        assert list(zip(kinds, mine)) == sorted(set(zip(kinds, mine)))
        seen.update(mine)
    assert seen == set(string) and sum(len(p) for _, p in own.parts()) == len(own.at)
    assert len([b for b, p in own.parts() if any(text[x : x + 16].tobytes() == b"sixteen bytes .." for x in own.at[p])]) > (1 if wide > 18 else 0)
    least = {}
    for x, p, o in zip(string, place, owner):
        least[x, p % 3 if classes else 0] = min(o, least.get((x, p % 3 if classes else 0), o))
    assert all(own.low[k] == least[text[p : p + wide].tobytes(), p % 3 if classes else 0] for k, p in enumerate(own.at))


def test_cut_documents_keeps_columns(docs, empty):
    held = docs.withColumn("n_chars", F.length("text").cast("long"))
    got = suffixes.cut_documents(held, pack_bytes=500)
    assert got.columns == held.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert 5 not in rows and None not in rows and 12 in rows and rows[12]["n_chars"] == len(rows[12]["text"]) < len(TEXTS[12])
    assert rows[0]["text"] is None and rows[4]["text"] == TEXTS[4]
    assert suffixes.cut_documents(empty).count() == 0


# --- classifiers


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(0)
    word = lambda n: ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n)]
    rows = [(i, " ".join(word(60)) if i % 3 else " ".join(w + "###" for w in word(60)), int(i % 3 > 0)) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    got = quality.score(table, model).where(common.held_out()).collect()
    assert np.mean([(r["score"] >= 0.7) == r["quality"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(empty, quality.train(empty.select("doc_id", "text"), table.select("doc_id", "quality").limit(0))).count() == 0


def test_quality_scores_are_those_of_averages():
    model = quality.Classifier()
    model.out = np.random.default_rng(1).normal(size=(quality.DIMENSION, 2)).astype(np.float32)
    model.prepare()
    texts = [b"one two two ###", b"", b"x", b"some words here and there"]
    for text, got in zip(texts, model.scores(texts)):
        ids, _ = model._bag([text])
        mean = model.rows[ids].mean(0) if len(ids) else np.zeros(quality.DIMENSION)
        assert abs(got - 1 / (1 + np.exp(-(mean @ (model.out[:, 1] - model.out[:, 0]))))) < 1e-5


def test_language(spark, docs, empty):
    rng = np.random.default_rng(0)
    parts = {"aa": ["tion", "the", "ing", "wh"], "bb": ["é", "eaux", "oi", "le"], "cc": ["ß", "ung", "sch", "ie"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(80)), k if i % 10 else None) for i, k in enumerate(list(parts) * 150)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(table)
    got = language.identify(table, net).where(common.held_out() & F.col("lang").isNotNull()).collect()
    assert np.mean([r["language"]["lang_pred"] == r["lang"] for r in got]) > 0.98
    edge = {r["doc_id"]: r["language"]["lang_pred"] for r in language.identify(docs, net).collect()}
    assert edge[0] == edge[1] == edge[3] == edge[16] == "und" and edge[4] in parts
    none = language.identify(docs, language.train(table.limit(0)))
    assert {r["language"]["lang_pred"] for r in none.collect()} == {"und"}
    assert language.identify(empty, net).count() == 0


def test_has_letter():
    assert [language.has_letter(t) for t in (None, "", "12 _ !", "\u00bd \u00b2 \u2167", "\u00bd a", "\u044f", "\u4e2d")] == [False] * 4 + [True] * 3


def test_windows_cover_all_and_tables_agree():
    x, owner, used = language.windows([b"a" * 300, b"", b"b"])
    assert owner.tolist() == [0, 0, 2] and used.tolist() == [256, 44, 1]
    net = language.Network(["a", "b"]).prepare()
    pooled = np.concatenate([r.max(0) for r in net._responses(x.T)], axis=1)
    want = np.log(language.softmax(np.maximum(pooled + net.bias, 0) @ net.out + net.out_bias))
    assert np.abs(net.log_probabilities(x) - want).max() < 1e-3


# --- html

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav>'
    '<!-- c --><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>First <i>one</i>.<br>Still&nbsp;first\n line.<p>Second &eacute;.</p></article>'
    '<section class="comments"><p>I disagree with that one.</p></section><footer>&copy; all</footer></body></html>'
)


def test_html_blocks():
    found = html.blocks(PAGE)
    assert found[3][0].path == ("html", "body", "article", "p") and found[1][0].path == ("html", "body", "div", ".ad")
    assert [t for _, t, _ in found] == ["Menu", "Buy now", "Head & line", "First one. Still first line.", "Second é.", "I disagree with that one.", "© all"]
    assert [html.weak_label(*b) for b in found] == [0, 0, 1, 1, 1, 0, 0]
    assert html.blocks("") == html.blocks("<script>x") == [] and html.blocks("a < b")[0][1] == "a < b"


def test_html_elements_that_hide_no_text():
    told = lambda page: [t for _, t, _ in html.blocks(page)]
    assert told('<article><p>A <svg class="i"/> b</p><p>rest</p></article>') == ["A b", "rest"]
    assert told('<p>a<svg data-x="1>2"/>b</p><p>c<svg><title>t</title><path d="x"/></svg>d</p>') == ["ab", "cd"]
    assert told("<p>a<svg><path></p><p>rest</p>") == ["a", "rest"]
    for name in ("title-bar", "svg-icon", "template-card", "script-box", "svg:x"):
        assert told(f"<p>a <{name}>b</{name}> c</p><p>rest</p>") == ["a b c", "rest"], name
    assert told("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p><object data='f'>fallback</object></p><p>u <math/> v</p>") == ["so x=2 holds", "fallback", "u v"]
    assert told("<script>a</script-x>b</script ><p>c</p><title>d</title x><p>e</p><TEMPLATE>f</template>") == ["c", "e"]


def test_html_extraction(spark):
    bodies = ["Short.", "A longer paragraph of text that goes on for a while, as they do.", "Middle sized words, here."]
    rows = [(i, PAGE.replace("Second &eacute;.", "</p><p>".join(bodies[(i + k) % 3] for k in range(1 + i % 5)))) for i in range(120)]
    pages = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "<p>")], "page_id long, html string").withColumn("text", F.lit("clash")).withColumn("found", F.lit(1))
    model = html.train(pages)
    got = {r["page_id"]: r["main_text"] for r in html.extract(pages, model).collect()}
    for i, source in rows:
        assert got[i] == "\n".join(t for p, t, k in html.blocks(source) if html.weak_label(p, t, k))
    assert got[900] == got[901] == got[902] == ""
    assert html.extract(pages.limit(0), html.train(pages.limit(0))).count() == 0


# --- decontamination


def test_decontamination(spark, empty):
    item = " ".join(f"w{i}" for i in range(14))
    items = [(1, item), (2, "Short ONE, here"), (3, None), (4, "..."), (5, item), (None, "null id text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", f"aa {item.upper().replace(' ', '--')} bb", " ".join(item.split()[2:12]), " ".join(item.split()[:9]), "a short-one: HERE short one here", "null id text é", "xshort one here"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hit", F.lit(1)).withColumn("found0", F.lit(2))
    for part_bytes in (1 << 25, 10):
        got = {r["doc_id"]: r for r in decontaminate.find(table, bench, part_bytes=part_bytes).collect()}
        assert [len(got[i]["found"]["hit"]) for i in range(8)] == [0, 0, 14, 10, 0, 6, 3, 0]
        assert got[2]["found"]["items"] == ["1", "5"] and got[5]["found"]["items"] == ["2"] and got[6]["found"]["items"] == []
        spans = [texts[5].encode()[s["start"] : s["end"]] for s in got[5]["found"]["spans"]]
        assert spans == [b"short-one: HERE short one here"] and got[5]["found"]["n_words"] == 7
    assert {len(r["found"]["hit"]) for r in decontaminate.find(table, bench.limit(0)).collect()} == {0}
    assert decontaminate.find(empty, bench).count() == 0
    both = decontaminate.find(table.withColumn("found", F.lit("own")), bench).where("doc_id = 2").first()
    assert both["found"] == "own" and len(both["_found"]["hit"]) == 14


def test_the_automaton_of_many_items():
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(rng.choice(["a", "bb", "c", "dd", "e"], n))
    items = [word(int(rng.integers(0, 16))).encode() for _ in range(150)]
    texts = [word(int(rng.integers(0, 400))).encode() for _ in range(20)] + [b"", b"..", items[0]]
    _, auto = decontaminate.build(items, 4)
    got = list(decontaminate.found_in(decontaminate.Words(texts), [(0, auto | {"items": len(items)})]))
    for text, (n, hit, found) in zip(texts, got):
        w, want, own = text.replace(b".", b" ").split(), set(), set()
        for i, item in enumerate(items):
            v = item.split()
            size = min(4, len(v))
            for k in range(len(v) - size + 1) if v else ():
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == v[k : k + size]:
                        want.update(range(at, at + size))
                        own.add(i)
        assert (n, hit.tolist(), found.tolist()) == (len(w), sorted(want), sorted(own))


# --- kNN


def test_knn(spark):
    rng = np.random.default_rng(1)
    v = [rng.normal(size=6).round(2).tolist() for _ in range(300)] + [[0.5] * 6] * 40 + [[1.5, 2.0] + [0.0] * 4]
    rows = [(i, x) for i, x in enumerate(v)] + [(900, None), (901, [1.0] * 5 + [None]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    held = knn.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)))
    q = np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)
    want = []
    for i in range(0, len(v), 7):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(len(v)) if j != i)[:5]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for block in (50, 7):  # the smaller one also cuts the queries of a group
        got = knn.knn_join(held, held.where("vec_id % 7 = 0"), 5, pivots=(8, 8), block=block).collect()
        assert sorted(tuple(r) for r in got) == sorted(want)
    few = held.where("vec_id < 3")
    assert sorted((r["query_id"], r["rank"]) for r in knn.knn_join(few, few, 5).collect()) == [(i, r) for i in range(3) for r in (1, 2)]
    assert knn.knn_join(held.limit(0), held.limit(0)).count() == 0
    big = _big = np.array([[1 << 40, -(1 << 20)]])
    assert knn._products(big, _big)[0, 0] == ((1 << 80) + (1 << 40)) % (1 << 64)


def test_registry_digests(spark, tmp_path):
    """The registered queries' digest columns come from the operators' own outputs."""
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in suffixes.op3_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest() and got[5]["n_removed"] == got[5]["n_bytes"] and got[5]["n_spans"] == 1
    hit = {r["doc_id"]: r for r in decontaminate.op8_benchmark_decontamination(spark, str(tmp_path)).collect()}
    assert hit[4]["contaminated"] and hit[4]["items_sha256"] == hashlib.sha256(b"0").hexdigest() and not hit[0]["contaminated"]


# --- blobs for many ranges


def test_columns_of_many_ranges_are_packed_once(monkeypatch):
    """What a packed row does for each range is only to compress, so many ranges cost little."""
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 6000).astype(np.uint8)
    held = suffixes.Left(suffixes._squeeze(np.zeros(1, np.int64), np.array([5951]), np.zeros(1, np.int64), text), 50)
    place, owner = held.starts(18, False)
    narrow, calls = suffixes._narrow, []
    monkeypatch.setattr(suffixes, "_narrow", lambda x: calls.append(len(x)) or narrow(x))
    some = np.sort(text[: 18 * 300].reshape(300, 18).copy().view("S18").ravel()).view(np.uint8)
    splits = suffixes.Left.words(type("", (), {"text": some}), np.arange(300) * 18, 18)
    own = suffixes.Distinct(held, place, 18, held.names(place, 18), owner, splits)
    told = own.rows(3, [own.at])
    assert len(told) > 200 and len(calls) == 3
    got = [suffixes._unsqueeze(x) for x in told["blob"]]
    for (b, part), (at, low, several), k in zip(own.parts(), got, told["b"]):
        assert b == k and at.tolist() == own.at[part].tolist() and not low.any() and not several.any()


def test_wide_keys_sort_like_rows():
    rng = np.random.default_rng(6)
    some = rng.integers(1 << 60, 1 << 63, 40).astype(np.uint64)
    keys = [some[rng.integers(40, size=5000)], some[rng.integers(40, size=5000)], rng.integers(0, 9, 5000)]
    kind, first = suffixes._kinds(keys)
    order = np.lexsort(keys[::-1])
    rows = list(zip(*(k[order].tolist() for k in keys)))
    assert kind[order].tolist() == np.cumsum([i > 0 and r != rows[i - 1] for i, r in enumerate(rows)]).tolist()
    assert all((k[first][kind] == k).all() for k in keys)


@pytest.mark.parametrize("frequent", [0, 6000, 20_000])
def test_wide_keys_in_portions_sort_like_rows(monkeypatch, frequent):
    """Portions of 500 rows, also where one first key, or the first two, have many or all of the rows."""
    monkeypatch.setattr(suffixes, "PORTION", 500)
    rng = np.random.default_rng(7)
    some = rng.integers(1 << 60, 1 << 63, 300).astype(np.uint64)
    keys = [some[rng.integers(300, size=20_000)], some[rng.integers(300, size=20_000)], some[rng.integers(40, size=20_000)]]
    keys[0][:frequent], keys[1][: frequent // 2] = some[0], some[1]
    kind, first = suffixes._kinds(keys)
    order = np.lexsort(keys[::-1])
    rows = list(zip(*(k[order].tolist() for k in keys)))
    assert kind[order].tolist() == np.cumsum([i > 0 and r != rows[i - 1] for i, r in enumerate(rows)]).tolist()
    assert all((k[first][kind] == k).all() for k in keys)


def test_a_range_is_named_in_little_memory(monkeypatch):
    """The names are the ranks, with the marks, at less than 55 bytes a record beside the blobs."""
    monkeypatch.setattr(suffixes, "PORTION", 1 << 14)
    rng, n = np.random.default_rng(8), 400_000
    some = rng.integers(1 << 60, 1 << 63, 600).astype(np.uint64)
    keys = [some[rng.integers(600, size=n)], some[rng.integers(600, size=n)], rng.integers(0, 3, n).astype(np.uint8)]
    low, several = rng.integers(0, 3000, n).astype(np.uint16), (rng.random(n) < 0.01).astype(np.uint8)
    blobs = [suffixes._squeeze(*(x[a : a + 20_000] for x in (*keys, low, several))) for a in range(0, n, 20_000)]
    table = pa.table({"b": pa.array([5] * 20, pa.int32()), "g": list(range(20)), "blob": pa.array(blobs, pa.binary())})
    tracemalloc.start()
    told = suffixes._name((5,), table)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 55 * n
    names, many = (np.concatenate(x) for x in zip(*(suffixes._unsqueeze(x) for x in told["blob"].to_pylist())))
    order = np.lexsort(keys[::-1])
    new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])])
    assert names[order].tolist() == np.cumsum(new).tolist() and set(told["n"].to_pylist()) == {int(new.sum())}
    head = np.flatnonzero(new)
    apart = (np.minimum.reduceat(low[order], head) != np.maximum.reduceat(low[order], head)) | (np.maximum.reduceat(several[order], head) > 0)
    assert many[order].tolist() == apart[np.cumsum(new) - 1].tolist()
