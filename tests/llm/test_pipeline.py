"""The pipeline's stages on the smallest tables: each one's decisions take effect on what it is given."""

import re

import corpus_pipeline as cp
from quillspark.llm import common, decontaminate, language, simhash
from test_operators import plain_fingerprint, raw
from test_registered import components, ids_of

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in cp.STAGES[:-1]:
        after = common.materialize(stage(spark, docs, DATA), "stage")
        assert after.columns == columns, name
        kept.append((docs, after))
        docs = after
    before, after = kept[0]
    told = language.identify(before, language.train(before)).where("language.lang_pred != 'und' AND language.score >= 0.5")
    assert {r["doc_id"] for r in told.collect()} == {r["doc_id"] for r in after.collect()}
    before, after = kept[1]
    classes = {r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == classes
    before, after = kept[2]
    held = [(r["doc_id"], r["text"].encode()) for r in before.collect()]
    first = {}
    for doc, b in sorted(held):
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], doc)
    got = {r["doc_id"]: r["text"] for r in after.collect()}
    for doc, b in held:
        touched = any(first[b[k : k + 50]] < doc for k in range(len(b) - 49))
        assert touched == (got.get(doc, "") != b.decode()), doc
    before, after = kept[3]
    found = decontaminate.find(before, spark.read.parquet(f"{DATA}/benchmark.parquet"))
    assert {r["doc_id"] for r in found.where("size(found.hit) = 0").collect()} == {r["doc_id"] for r in after.collect()}
    packed = cp.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert set(packed["doc_id"]) == {r["doc_id"] for r in docs.collect()}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert cp.run(spark, DATA).count() == len(packed)


def test_a_stage_clears_up_after_the_one_before(spark):
    docs = common.materialize(spark.read.parquet(f"{DATA}/documents.parquet").limit(50), "docs")
    deduped = cp.near_dedup(spark, docs, DATA)
    used = [p for p in cp._held.paths[1]]
    again = cp.near_dedup(spark, docs, DATA)
    assert deduped.count() == again.count()  # another call of the same stage takes nothing away
    here = lambda: sum(spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in used)
    assert used and here() == len(used)
    cp.substring_dedup(spark, deduped, DATA).count()  # not written: what docs reads stays
    assert 0 < here() < len(used)


def test_the_whole_against_plain_python(spark):
    """All rows of run() from the stages' rules in plain Python; of the language network only its answers
    for single texts are taken."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = language.train(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    label, score = net.predict([raw(t) if language.has_letter(t) else b"" for _, t in rows])
    rows = [x for x, k, s in zip(rows, label, score) if k >= 0 and s >= cp.LEAST_SCORE]
    prints = [plain_fingerprint(t) for _, t in rows]
    root = components(prints)
    kept = {min((rows[i][0], i) for i in range(len(rows)) if root[i] == r)[1] for r in root}
    rows = [x for i, x in enumerate(rows) if i in kept]
    first: dict = {}
    for doc, t in rows:
        b = raw(t)
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(doc, first.get(b[k : k + 50], doc))
    cut = []
    for doc, t in rows:
        b = raw(t)
        gone = set()
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < doc:
                gone.update(range(k, k + 50))
        left = bytes(c for i, c in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        if not gone or left.strip():
            cut.append((doc, left if gone else t))
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw(t)))
    windows: dict = {}
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r["text"])
        for k in range(max(0, len(w) - 10) + 1) if w else ():
            windows.setdefault(min(10, len(w)), set()).add(tuple(w[k : k + 10]))
    clean = lambda w: not any(tuple(w[k : k + n]) in held for n, held in windows.items() for k in range(len(w) - n + 1))
    ids = ids_of("word_bpe_49k.json", 0)
    want = [(d, k // 2048, k, ids(t)[k : k + 2048].astype("<u2").tobytes()) for d, t in cut if clean(words(t)) for k in range(0, len(ids(t)), 2048)]
    got = cp.run(spark, DATA).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got) == sorted(want)


def test_one_row_of_each_class_stays(spark):
    one, two, three = ("%s " % w * 9 + "and the end of it" for w in ("alpha", "beta", "gamma"))
    rows = [(1, one), (1, one), (2, one), (None, two), (None, two), (None, three), (1, three), (4, three), (5, "only this"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = cp.near_dedup(spark, docs, DATA)
    assert got.columns == docs.columns
    held = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str)
    assert held == sorted([(1, one), (None, two), (1, three), (5, "only this"), (None, "")], key=str)
