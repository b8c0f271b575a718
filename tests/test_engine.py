"""Store, refresh, planning and the served operations, end to end on small tables."""

import datetime as dt
import http.server
import json
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillspark import __main__ as command
from quillspark import api, errors, settings
from quillspark.api import Engine
from quillspark.operators import cache, chunker, reports, search
from quillspark.plans import refresh_plan as plan
from quillspark.refresh import Indexer
from quillspark.sources.catalog import parse_catalog
from quillspark.sources import lease
from quillspark.sources.http_embeddings import http_provider
from quillspark.sources.files import read_checkouts
from quillspark.sources.store import VERSION, Store
from quillspark.streaming.ingest import refresh_on_arrival

CONFIG = {
    "org": "o",
    "defaultDocs": ["README.md", "docs/**"],
    "activeBranchDays": 30,
    "maxActiveBranches": 1,
    "repos": [{"alias": "turnos", "repo": "turnos"}, {"alias": "tramites", "repo": "tramites", "branches": ["main"]}],
}
NOW = dt.datetime.now()
SHARED = "# Turnos\n\nreserva de turno y agenda\n\n## Pago\n\npago con tarjeta"
FILES = [
    ("o/turnos", "main", "README.md", SHARED),
    ("o/turnos", "dev", "README.md", SHARED),
    ("o/turnos", "feat/new", "docs/login.md", "# Login\n\ntoken de login"),
    ("o/turnos", "feat/old", "docs/old.md", "# Old\n\nviejo"),
    ("o/turnos", "main", "src/app.ts", "# never"),
    ("o/tramites", "main", "README.md", "# Tramites\n\nindice y busqueda"),
]
BRANCHES = [
    ("o/turnos", "main", NOW), ("o/turnos", "dev", NOW), ("o/turnos", "feat/new", NOW - dt.timedelta(days=2)),
    ("o/turnos", "feat/newish", NOW - dt.timedelta(days=3)), ("o/turnos", "feat/old", NOW - dt.timedelta(days=400)), ("o/tramites", "main", NOW),
]


@pytest.fixture
def engine(spark, tmp_path):
    files = lambda: spark.createDataFrame(FILES, "repo string, branch string, path string, content string")
    branches = lambda: spark.createDataFrame(BRANCHES, "repo string, branch string, last_commit_at timestamp")
    sources = {
        "meta": spark.createDataFrame([("o/turnos", "d", "main", "2026-02-01T00:00:00Z"), ("o/tramites", "d", "main", None)], "repo string, description string, default_branch string, last_activity string"),
        "commits": spark.createDataFrame([("o/turnos", "abcdef123", None, "ana", NOW, "one\ntwo"), ("o/turnos", "bbbbbbbbb", "Bo", "bo", NOW - dt.timedelta(days=1), " x ")], "repo string, sha string, author string, login string, date timestamp, message string"),
        "pulls": spark.createDataFrame([("o/turnos", "open"), ("o/turnos", "open"), ("o/turnos", "closed")], "repo string, state string"),
        "issues": spark.createDataFrame([("o/turnos", "open", False), ("o/turnos", "open", True)], "repo string, state string, is_pull boolean"),
    }
    return Engine(Indexer(Store(spark, f"file://{tmp_path}/index"), parse_catalog(json.dumps(CONFIG)), files, branches), sources)


def test_refresh_and_search(engine, spark):
    report = engine.refresh_index()
    assert (report["repos"], report["branches"], report["files"], report["chunks"], report["failed"]) == (2, 4, 4, 6, 0)
    assert (report["embedded"], report["reused"]) == (4, 2)
    held = engine.store.chunks()
    assert {r["branch"] for r in held.select("branch").collect()} == {"main", "dev", "feat/new"}  # one active branch at most
    assert held.where("path = 'src/app.ts'").count() == 0
    hit = engine.search_project_docs("como hago un pago con tarjeta", limit=1).first()
    assert hit["heading"] == "Pago" and hit["branches"] == ["main", "dev"]
    assert engine.search_project_docs("token login", "turnos", "feat/new").first()["heading"] == "Login"
    again = engine.refresh_index("TURNOS")
    assert again["embedded"] == 0 and again["chunks"] == 5 and engine.store.chunks().count() == 6
    assert engine.store.cache().count() == 4 and [r["branch"] for r in engine.store.stats("o/turnos").collect()] == ["dev", "feat/new", "main"]
    assert [r["repo"] for r in engine.store.stats().collect()] == ["o/tramites"] + ["o/turnos"] * 3
    assert engine.indexer.stale(12) == [] and engine.indexer.stale(0) == []
    with pytest.raises(errors.NotFound, match="feat/zzz"):
        engine.search_project_docs("pago", "turnos", "feat/zzz")
    engine.indexer.model = "other"
    with pytest.raises(errors.ModelMismatch):
        engine.search_project_docs("pago")
    assert engine.indexer.stale(12) == ["o/tramites", "o/turnos"]


def test_reports(engine):
    with pytest.raises(errors.NotFound, match="empty"):
        engine.search_project_docs("pago")
    with pytest.raises(errors.NotFound, match="tramites, turnos"):
        engine.get_project_status("nope")
    row = engine.get_project_status("o/turnos").first()
    assert (row["open_pull_requests"], row["open_issues"], row["last_commit"]["sha"]) == (2, 1, "abcdef123")
    assert [(r["short_sha"], r["author"], r["message"]) for r in engine.get_recent_commits("turnos", 5).orderBy("position").collect()] == [("abcdef1", "ana", "one"), ("bbbbbbb", "Bo", "x")]
    assert [r["branch"] for r in engine.list_branches("turnos", 2).orderBy("position").collect()] == ["dev", "main"]
    summary = engine.get_project_summary("turnos", 200).first()
    assert summary["path"] == "README.md" and not summary["truncated"]
    assert engine.get_file_content("turnos", "/docs/login.md", "feat/new").first()["size_bytes"] == 23
    with pytest.raises(errors.ConfigError):
        engine.get_file_content("turnos", "docs/../x")
    with pytest.raises(errors.NotFound):
        engine.get_file_content("turnos", "none.md")
    compared, total = engine.compare_status(["turnos", "tramites", "unknown"])
    assert total.columns[-1] == "checked_at" and total.drop("checked_at").first().asDict() == {"requested": 3, "succeeded": 2, "failed": 1, "open_pull_requests": 2, "open_issues": 1}
    assert [r["repo"] for r in compared.where("NOT ok").collect()] == ["unknown"]
    listed = engine.list_projects().collect()
    assert [(r["alias"], r["error"]) for r in listed] == [("turnos", None), ("tramites", None)]
    engine.sources["meta"] = engine.sources["meta"].where("repo = 'o/turnos'")
    assert "o/tramites" in engine.list_projects().collect()[1]["error"]


def test_large_and_binary_files_are_refused(engine, spark):
    rows = [("o/turnos", "main", "big.md", "x" * 400_001), ("o/turnos", "main", "bin.md", "a\0b"), ("o/turnos", "main", "ok.md", "x" * 400_000)]
    engine.indexer.files = lambda: spark.createDataFrame(rows, "repo string, branch string, path string, content string")
    for name, why in (("big.md", "too large: 400001"), ("bin.md", "binary")):
        with pytest.raises(errors.Unreadable, match=why):
            engine.get_file_content("turnos", name)
    assert engine.get_file_content("turnos", "ok.md").first()["size_bytes"] == 400_000


def test_failures_stay_where_they_are(engine, spark):
    assert engine.refresh_index()["failed"] == 0
    schema = "repo string, branch string, path string, content string"
    bad = [("o/turnos", "dev", "README.md", "# Turnos\n\nfail here"), ("o/turnos", "main", "docs/big.md", "y" * 300_001), ("o/turnos", "main", "README.md", "# New\n\ntexto nuevo")]
    engine.indexer.files = lambda: spark.createDataFrame([*bad, FILES[-1]], schema)

    def provider(texts):
        if any("fail here" in t for t in texts):
            raise ValueError("no vector today")
        return cache.word_provider(texts)

    engine.indexer.provider = provider
    report = engine.refresh_index()
    turnos = report["results"][0]
    by_name = {b["branch"]: b for b in turnos["branches"]}
    # One text without a vector is left out; its branch stands.
    assert by_name["dev"]["error"] is None and by_name["dev"]["skipped"] == ["README.md (1 chunks without a vector: no vector today)"] and report["failed"] == 0
    assert by_name["main"]["skipped"] == ["docs/big.md (too large: 300001)"] and by_name["main"]["chunks"] == 1 and by_name["feat/new"]["active"]
    assert report["results"][1]["branches"][0]["error"] is None and report["first_error"] is None
    held = {(r["branch"], r["heading"]) for r in engine.store.chunks().where("repo = 'o/turnos'").collect()}
    assert held == {("main", "New")}

    def limited(texts):
        raise errors.RateLimited("come back later")

    engine.indexer.provider = limited
    engine.indexer.files = lambda: spark.createDataFrame([("o/turnos", "main", "README.md", "# Other\n\nunseen"), ("o/tramites", "main", "README.md", "# Unseen")], schema)
    report = engine.refresh_index()
    assert report["failed"] == 2 and all("come back later" in b["error"] for r in report["results"] for b in r["branches"])
    assert engine.store.chunks().count() == 2
    said = []
    engine.indexer.model = "other"
    assert all("come back later" in x for x in engine.indexer.refresh_stale("1", said.append).values()) and "failed 1" in said[0]


def test_a_bad_file_is_skipped_alone(engine, spark, monkeypatch):
    rows = [("o/turnos", "main", "README.md", "# Fine\n\ntexto", None), ("o/turnos", "main", "docs/cut.md", "# Bad\n\nexplode", None), ("o/turnos", "main", "docs/gone.md", None, "no route to host"), ("o/turnos", "dev", "README.md", "# Dev", None)]
    engine.indexer.files = lambda: spark.createDataFrame(rows, "repo string, branch string, path string, content string, error string")
    whole = chunker.cut

    def cut(files):
        bad = F.col("content").contains("explode")
        return whole(files.where(~bad)).unionByName(whole(files.where(bad), most=None))  # no limit at all: an error

    monkeypatch.setattr(chunker, "cut", cut)
    report = engine.refresh_index("turnos")
    branches = {b["branch"]: b for b in report["results"][0]["branches"]}
    assert report["failed"] == 0 and branches["main"]["files"] == 1 and branches["dev"]["skipped"] == []
    assert [x.split(" (")[0] for x in branches["main"]["skipped"]] == ["docs/cut.md", "docs/gone.md"] and "no route to host" in branches["main"]["skipped"][1]


def test_the_command(spark, tmp_path, capsys):
    at = tmp_path / "files" / "o" / "turnos" / "main"
    at.mkdir(parents=True)
    (at / "README.md").write_text(SHARED)
    (tmp_path / "catalog.json").write_text(json.dumps(CONFIG))
    env = {f"QUILLSPARK_{k}": f"{tmp_path}/{v}" for k, v in (("CATALOG", "catalog.json"), ("FILES", "files"), ("STORE", "store"))}
    held = settings.Settings.from_env(env)
    assert command.main(spark, held, "search", "pago con tarjeta") == 1 and "refresh it first" in capsys.readouterr().out
    assert command.main(spark, held, "refresh") == 0 and "main: 2 chunks" in capsys.readouterr().out
    assert command.main(spark, held, "search", "pago con tarjeta", "turnos") == 0
    told = json.loads(capsys.readouterr().out)
    assert told["scope"] == {"repo": "o/turnos", "branch": "all indexed branches"} and told["model"] == "words-v1" and told["note"] == api.HITS_NOTE
    assert told["results"][0]["heading"] == "Pago" and told["results"][0]["content"].endswith("tarjeta")
    spark.createDataFrame([("o/turnos", "main", "x.md", "# x")], "repo string, branch string, path string, content string").write.parquet(f"{tmp_path}/landing")
    assert command.main(spark, held, "listen", f"{tmp_path}/landing", f"{tmp_path}/check") == 0
    assert command.main(spark, held, "stale") == 0 and command.main(spark, held) == 2


def test_a_broken_source_of_branches(engine, spark):
    whole = engine.indexer.branches()

    def broken():
        fail = F.when(F.col("repo") == "o/turnos", F.raise_error(F.lit("no such host"))).otherwise(F.col("branch"))
        return whole.withColumn("branch", fail.cast("string"))

    engine.indexer.branches = broken
    report = engine.refresh_index()
    assert "no such host" in report["results"][0]["error"] and report["results"][1]["error"] is None and report["chunks"] == 1


def spoil(folder):
    for path, _, names in os.walk(folder.removeprefix("file://")):
        for name in names:
            if name.endswith(".parquet"):
                with open(f"{path}/{name}", "wb") as f:
                    f.write(b"no parquet at all")
            if name.endswith(".crc"):
                os.remove(f"{path}/{name}")


def test_the_store_after_a_crash(engine, spark, monkeypatch):
    engine.refresh_index()
    store, root = engine.store, engine.store.root
    before, index, number = sorted(map(str, store.chunks().collect())), whole(store.index()), store.snapshot().number
    # A refresh breaks off at each of its steps: nobody sees any of it, and the next one clears it away.
    others = store.chunks().where("branch = 'main'").withColumn("heading", F.lit("h"))
    for step in ("_index", "_commit", "_mark", "_move"):
        with monkeypatch.context() as m:
            m.setattr(Store, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                store.replace_branches(others, [("o/turnos", "main"), ("o/turnos", "dev")], "m")
        again = Store(spark, root)
        assert again.snapshot().number == number and sorted(map(str, again.chunks().collect())) == before and whole(again.index()) == index
    again.replace_branches(others, [("o/turnos", "main"), ("o/turnos", "dev")], "m")
    assert {(r["branch"], r["heading"]) for r in again.chunks().where("repo = 'o/turnos'").collect()} == {("main", "h"), ("feat/new", "Login")}
    assert {(r["branch"], r["model"], r["chunks"]) for r in again.runs().where("repo = 'o/turnos'").collect()} == {("main", "m", 2), ("dev", "m", 0), ("feat/new", "words-v1", 1)}
    # Tables that can't be read are set aside on opening; what the chunks tell is made anew.
    index = whole(again.index())
    spoil(f"{root}/postings")
    opened = Store(spark, root)
    assert len(opened.set_aside) == 1 and "postings.corrupt" in opened.set_aside[0] and whole(opened.index()) == index
    spoil(f"{root}/chunks")
    opened = Store(spark, root)
    assert "chunks.corrupt" in opened.set_aside[0] and opened.chunks().count() == opened.runs().count() == opened.texts().count() == 0


def test_readers_see_a_refresh_as_a_whole(engine, spark, tmp_path):
    """Who holds a snapshot goes on reading it, files and all, while others commit and clear away; who asks anew
    sees chunks, texts, index and runs of one state only."""
    store = Store(spark, f"file://{tmp_path}/s")
    scopes = [("o/a", "main"), ("o/a", "dev"), ("o/b", "main")]

    def write(k, some=scopes):
        rows = [(k * 100 + i, r, b, f"state{k}") for i, (r, b) in enumerate(some)]
        chunks = spark.createDataFrame(rows, "chunk_id long, repo string, branch string, content string")
        chunks = chunks.selectExpr("*", "'p' AS path", "repo AS alias", "0 AS chunk_index", "'h' AS heading", "sha2(content, 256) AS content_hash", "array(1F, 2F) AS embedding", "2 AS dimensions", "current_timestamp() AS indexed_at")
        store.replace_branches(chunks, some, f"m{k}")

    write(0)
    held, seen, stop = store.snapshot(), [], threading.Event()
    chunks, texts = held.chunks(), held.texts()

    def read():
        while not stop.is_set():
            now = Store(spark, store.root).snapshot()
            told = {r["content"] for r in now.chunks().select("content").collect()}, {r["term"] for r in now.index().terms.where("term LIKE 'state%'").collect()}, {r["model"].replace("m", "state") for r in now.runs().collect()}
            seen.append((now.number, now.chunks().count(), now.texts().count(), told))

    reader = threading.Thread(target=read)
    reader.start()
    for k in (1, 2, 3):
        write(k)
    stop.set()
    reader.join()
    assert len(seen) > 1
    for _, n, m, (contents, terms, models) in seen:
        assert n == 3 and m == 2 and len(contents) == 1 and contents == terms == models
    assert {r["content"] for r in chunks.collect()} == {"state0"} and texts.count() == 2  # planned before, read after
    assert {r["content"] for r in held.chunks().collect()} == {"state0"}
    late = Store(spark, store.root, retain=0)
    late.prune({"o/a": ["main"]})
    assert {(r["repo"], r["branch"]) for r in late.runs().collect()} == {(r["repo"], r["branch"]) for r in late.live().collect()} == {("o/a", "main"), ("o/b", "main")}
    assert late.texts().where("repo = 'o/a'").first()["members"][0]["branch"] == "main" and late.texts().count() == 2
    late.prune({"o/a": ["x"], "o/b": ["main"]})
    now = late.snapshot()
    assert late.chunks().count() == late.texts().count() == 1 and len(late._commits()) <= 3
    late._sweep()
    assert late._commits() == [now.number] and late._segments() == {*now.live_segments, *now.home_segments}


def test_counts_are_taken_by_the_job_that_writes(engine, spark, monkeypatch):
    """What a refresh counted as none on its way is not looked for again."""
    told, counted = [], Store.counted
    monkeypatch.setattr(Store, "counted", lambda *a, **k: told.append((a[1], counted(*a, **k))) or told[-1][1])
    engine.refresh_index()
    first = {name: c for name, (_, c) in told if c}
    assert first == {"files": {"skipped": 0}, "cut": {"skipped": 0}, "vectors": {"skipped": 0, "fatal": 0, "fresh": 4}}
    told.clear()
    monkeypatch.setattr(Indexer, "_skipped", None)
    monkeypatch.setattr(Indexer, "_first_of", None)
    assert engine.refresh_index()["failed"] == 0 and {name: c for name, (_, c) in told}["vectors"]["fresh"] == 0


def whole(index):
    return [sorted(map(tuple, df.select(*sorted(df.columns)).collect())) for df in (index.postings, index.terms, index.stats)]


def test_the_index_grows_by_segments(engine, spark):
    """After random replacements the index and the texts are those that a full rebuild gives, only replaced
    branches were tokenized, and segments were merged."""
    store, r = Store(spark, engine.store.root, retain=0), random.Random(4)
    words = [f"word{k}" for k in range(30)]
    branches = [(f"o/r{k}", b) for k in range(4) for b in ("main", "dev", "x")]
    seen = set()
    for step in range(14):
        some = branches if step == 0 else r.sample(branches, r.choice([1, 1, 2]))
        rows = []
        for repo, branch in some:
            for path in range(r.choice([0, 1, 4]) if step else 5):
                text = " ".join(r.choice(words) for _ in range(r.choice([1, 20])))
                rows.append((r.getrandbits(60), repo, branch, f"{path}.md", text))
        chunks = spark.createDataFrame(rows, "chunk_id long, repo string, branch string, path string, content string")
        chunks = chunks.selectExpr("*", "repo AS alias", "0 AS chunk_index", "'h' AS heading", "sha2(content, 256) AS content_hash", "array(1F, 2F) AS embedding", "2 AS dimensions", "current_timestamp() AS indexed_at")
        store.replace_branches(chunks, some)
        seen.add(len({x["segment"] for x in store.live().collect()}))
        newest = store.postings().where(f"segment = {max(store._segments())}")
        assert {(x["repo"], x["branch"]) for x in store.live().collect()} == {(x["repo"], x["branch"]) for x in store.chunks().select("repo", "branch").distinct().collect()}
        if step in (1, 2):
            assert {x["scope"] for x in newest.select("scope").distinct().collect()} <= {x["scope"] for x in store.live().where(F.concat_ws("@", "repo", "branch").isin([f"{a}@{b}" for a, b in some])).collect()}
    assert max(seen) < 10 and len(seen) > 1
    grown, texts = whole(store.index()), sorted(map(str, store.texts().select("repo", "path", "content_hash", "members").collect()))
    some_terms = whole(store.index(["word3", "word4"]))[1]
    store.rebuild_postings()
    assert whole(store.index()) == grown and len({x["segment"] for x in store.live().collect()}) == 1
    assert sorted(map(str, store.texts().select("repo", "path", "content_hash", "members").collect())) == texts
    assert whole(search.index_of(store.chunks())) == grown and some_terms == [x for x in grown[1] if x[1] in ("word3", "word4")]
    store.replace_branches(store.chunks().limit(0), [branches[0]])
    assert len(store._segments()) < 4  # dead segments went


def test_a_store_of_an_older_version(engine, spark):
    """Version 2 had other tables for its keyword index; chunks, runs and the cache are kept, and no text is
    embedded anew."""
    engine.refresh_index()
    store = engine.store
    before = whole(store.index())
    chunks, runs = sorted(map(str, store.chunks().collect())), sorted(map(str, store.runs().collect()))

    def aged(version):
        """The store as that version kept it."""
        store.chunks().write.partitionBy("repo", "branch").parquet(f"{store.root}/of-old")
        store.runs().write.parquet(f"{store.root}/runs")
        for name in ("chunks", "postings", "terms", "lengths", "texts", "snapshots", "commits"):
            store._drop_table(name)
        store._move(f"{store.root}/of-old", f"{store.root}/chunks")
        spark.range(1).write.parquet(f"{store.root}/{'stats' if version == 2 else 'live'}")
        store._move(f"{store.root}/version={VERSION}", f"{store.root}/version={version}")

    for version in (4, 2):
        aged(version)
        if version == 4:  # broken off between the renames
            store._move(f"{store.root}/chunks", f"{store.root}/chunks.v4")
            store._move(f"{store.root}/runs", f"{store.root}/runs.old")
        engine.indexer.store = engine.store = again = Store(spark, store.root)
        assert whole(again.index()) == before and again.cache().count() == 4
        assert (sorted(map(str, again.chunks().collect())), sorted(map(str, again.runs().collect()))) == (chunks, runs)
        assert not any(again._exists(f"{store.root}/{name}") for name in ("stats", "live", "runs", "chunks.v4"))
    assert engine.search_project_docs("token login").first()["heading"] == "Login"
    assert engine.refresh_index()["embedded"] == 0
    # Branches that were being replaced have no run any more, so they are refreshed.
    aged(4)
    spark.createDataFrame([("o/turnos", "dev")], "repo string, branch string").write.parquet(f"{store.root}/chunks.scopes")
    again = Store(spark, store.root)
    assert again.runs().count() == 3 and again.chunks().count() == 6 and not again._exists(f"{store.root}/chunks.scopes")
    again._move(f"{store.root}/version={VERSION}", f"{store.root}/version=99")
    assert Store(spark, store.root).chunks().count() == 0  # unknown: starts anew


def test_results_as_json(engine):
    ok, told = api.guarded(lambda: engine.get_recent_commits("turnos", 1))
    assert ok and json.loads(told)[0]["short_sha"] == "abcdef1" and json.loads(told)[0]["date"][:4] == str(NOW.year)
    assert api.guarded(lambda: engine.get_recent_commits("nope")) == (False, "unknown repository 'nope'; known: tramites, turnos")
    assert api.guarded(lambda: 1 / 0) == (False, "unexpected error: division by zero")


def test_settings():
    assert settings.read("A", "x", {"A": "  "}) == "x" and settings.read("A", "x", {"A": " y "}) == "y"
    with pytest.raises(errors.ConfigError, match="QUILLSPARK_STORE"):
        settings.Settings.from_env({"QUILLSPARK_CATALOG": "secret", "QUILLSPARK_FILES": "f"})
    held = settings.Settings.from_env({"QUILLSPARK_CATALOG": "c", "QUILLSPARK_STORE": "s", "QUILLSPARK_FILES": "f"})
    assert held.model == "words-v1" and held.providers() == (cache.word_provider, cache.word_provider)


def test_older_servers_and_missing_models():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["content-length"])))
            seen.append(self.path)
            lost = asked["model"] == "lost"
            self.send_response(404 if lost or self.path == "/api/embed" else 200)
            self.end_headers()
            self.wfile.write(b'{"error": "model lost not found"}' if lost else json.dumps({"embedding": [1.0, len(asked.get("prompt", ""))]}).encode() if self.path != "/api/embed" else b"no such page")

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    provide = http_provider(url, "m")
    assert provide(["a", "bcd"]).tolist() == [[1, 1], [1, 3]] and provide(["ab"]).tolist() == [[1, 2]]
    assert seen == ["/api/embed"] + ["/api/embeddings"] * 3  # found out once
    with pytest.raises(errors.EmbeddingsUnavailable, match="pull it"):
        http_provider(url, "lost")(["a"])
    server.shutdown()
    server.server_close()


def test_http_provider():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, json.loads(self.rfile.read(int(self.headers["content-length"])))))
            texts = seen[-1][1]["input"]
            body = {"bad": b"<html>"}.get(texts[0]) or json.dumps({"embeddings": [[1.0, len(t)] for t in texts if t != "lost"]}).encode()
            self.send_response(500 if texts[0] == "fail" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}//"
    assert http_provider(url, "m")(["a", "bcd"]).tolist() == [[1, 1], [1, 3]] and seen[0][0] == "/api/embed"
    http_provider(url, "nomic-embed-text", "search_query")(["a"])
    assert seen[-1][1]["input"] == ["search_query: a"] and http_provider(url, "m")([]).size == 0
    for text, why in (("fail", "answered 500"), ("bad", "no JSON"), ("lost", "0 vectors for 1")):
        with pytest.raises(errors.EmbeddingsUnavailable, match=why):
            http_provider(url, "m")([text])
    server.shutdown()
    server.server_close()
    with pytest.raises(errors.EmbeddingsUnavailable, match="can't be reached"):
        http_provider(url, "m", timeout=5)(["a"])


def test_single_flight_and_failures(engine):
    calls, go = [], threading.Event()

    def run(repo):
        calls.append(repo)
        go.wait(5)
        return {"n": len(calls)}

    engine.indexer._run = run
    out = []
    threads = [threading.Thread(target=lambda: out.append(engine.indexer.refresh("o/turnos"))) for _ in range(3)]
    for t in threads:
        t.start()
    while len(calls) < 1:
        pass
    threading.Event().wait(0.2)
    go.set()
    for t in threads:
        t.join()
    assert calls == ["o/turnos"] and out == [{"n": 1}] * 3

    def fail(repo):
        raise errors.RateLimited("later")

    engine.indexer._run = fail
    with pytest.raises(errors.RateLimited):
        engine.indexer.refresh("o/turnos")
    said = []
    assert engine.indexer.refresh_stale("whenever", said.append) == {"o/tramites": "later", "o/turnos": "later"}
    assert "whenever" in said[0]
    assert engine.indexer.refresh_stale("0") == {}


def test_two_drivers_take_turns(engine, spark):
    """Of two stores on one folder, each writes alone; who is gone gives way, who works does not."""
    root, said, started = engine.store.root, [], threading.Event()

    def other():
        with Store(spark, root).writing(ttl=2, every=0.1):
            said.append("in")
            started.set()
            threading.Event().wait(3)  # longer than the lease lasts without a touch
            said.append("out")

    thread = threading.Thread(target=other)
    thread.start()
    started.wait(20)
    with engine.store.writing(ttl=2, every=0.1):
        said.append("next")
    thread.join()
    assert said == ["in", "out", "next"]
    path = f"{root}.lease".removeprefix("file://")
    with open(path, "wb") as f:  # of a driver that died long ago
        f.write(b"\0\x04gone")
    os.utime(path, (1, 1))
    assert engine.refresh_index()["failed"] == 0 and not os.path.exists(path)
    with pytest.raises(lease.LeaseLost):
        with engine.store.writing(ttl=60):
            os.remove(path)
    with open(path, "wb") as f:
        f.write(b"\0\x04busy")
    with pytest.raises(errors.EngineError, match="held by another"):
        with engine.store.writing(wait=0.3, every=0.1):
            pass
    os.remove(path)


def test_store_replaces_also_by_nothing(engine, spark):
    engine.refresh_index()
    none = engine.store.chunks().limit(0)
    engine.store.replace_branches(none, [("o/turnos", "feat/new")])
    assert engine.store.chunks().where("branch = 'feat/new'").count() == 0
    assert engine.store.prune({}) == {}
    assert engine.store.prune({"o/turnos": ["main"]}) == {"o/turnos": 1}
    assert {(r["repo"], r["branch"]) for r in engine.store.runs().collect()} == {("o/turnos", "main"), ("o/tramites", "main")}
    assert engine.store.quarantine("chunks") is None


def test_arrivals_refresh_their_repositories(spark, tmp_path):
    seen = []
    spark.createDataFrame(FILES, "repo string, branch string, path string, content string").write.parquet(f"{tmp_path}/in")
    refresh_on_arrival(spark, f"{tmp_path}/in", f"{tmp_path}/check", seen.append).awaitTermination(60)
    assert sorted(set(seen)) == ["o/tramites", "o/turnos"]


def test_checkouts(spark, tmp_path):
    at = tmp_path / "root" / "o" / "turnos" / "main" / "docs"
    at.mkdir(parents=True)
    (at / "a.md").write_text("# a")
    (at / "b.ts").write_text("x")
    assert [tuple(r) for r in read_checkouts(spark, str(tmp_path / "root")).collect()] == [("o/turnos", "main", "docs/a.md", "# a", 3)]


def test_staleness_is_strict(spark):
    now = F.lit("2026-08-29 12:00:00").cast("timestamp")
    runs = [("a", "m", "2026-08-28T23:00:00Z"), ("b", "m", "2026-08-29T01:00:00Z"), ("c", "m", "2026-08-29T00:00:00Z"), ("d", "other", "2026-08-29T11:00:00Z"), ("e", "m", "whenever")]
    catalog = spark.createDataFrame([(r,) for r in "abcdef"], "repo string")
    held = spark.createDataFrame(runs, "repo string, model string, indexed_at string")
    assert sorted(r["repo"] for r in plan.stale_repos(catalog, held, "m", now, 12).collect()) == ["a", "d", "e", "f"]
    assert plan.stale_repos(catalog, held, "m", now, 0).count() == 0


def test_compare_days(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    status = spark.createDataFrame([("a", t("2026-02-01T12:00:00"), t("2026-02-03T00:00:00"), 1, 2), ("b", None, t("2026-02-01T12:00:00"), 0, 0)], "repo string, last_activity timestamp, last_commit_at timestamp, open_pull_requests long, open_issues long")
    got = reports.compare_status(spark.createDataFrame([("a",), ("b",), ("x",)], "repo string"), status, F.lit("2026-02-04 12:00:00").cast("timestamp")).orderBy("repo").collect()
    assert (got[0]["days_since_activity"], got[0]["days_since_commit"], got[0]["commit_gap_days"]) == (3, 1, 0)
    assert got[1]["days_since_activity"] is None and got[1]["commit_gap_days"] is None and not got[2]["ok"]


def test_provider_faults(spark):
    texts = spark.createDataFrame([("h", "x")], "content_hash string, content string")
    told = cache.embed(texts, lambda t: [[float("nan")]] * len(t)).first()
    assert told["embedding"] is None and "non-finite" in told["error"] and told["fatal"] is None
    many = spark.range(40).selectExpr("CAST(id AS STRING) content_hash", "CAST(id AS STRING) content").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def picky(some):
        calls.add(1)
        if "17" in some:
            raise ValueError("not this one")
        return [[1.0]] * len(some)

    got = {r["content_hash"]: r["error"] for r in cache.embed(many, picky).collect()}
    assert [h for h, e in got.items() if e] == ["17"] and got["17"] == "not this one" and calls.value == 3 + 16

    def down(some):
        calls.add(1)
        raise errors.EmbeddingsUnavailable("no answer")

    calls.value = 0
    held = cache.embed(many, down)
    assert {r["fatal"] for r in held.collect()} == {"EmbeddingsUnavailable"} and calls.value == 1
    with pytest.raises(errors.EmbeddingsUnavailable, match="no answer"):
        cache.stop_if_fatal(held)
    assert cache.embed(texts.limit(0), cache.word_provider).collect() == []


@pytest.mark.parametrize("change", [{"org": ""}, {"defaultDocs": []}, {"repos": []}, {"activeBranchDays": 366}, {"maxActiveBranches": 0}, {"repos": [{"alias": "A", "repo": "x"}]}, {"repos": CONFIG["repos"][:1] * 2}])
def test_bad_catalogs(change):
    with pytest.raises(errors.ConfigError):
        parse_catalog(json.dumps(CONFIG | change))


def test_http_errors():
    assert isinstance(errors.from_status(404), errors.NotFound)
    assert isinstance(errors.from_status(401), errors.NotPermitted)
    assert isinstance(errors.from_status(403, "no"), errors.NotPermitted)
    assert errors.from_status(403, "x", {"x-ratelimit-remaining": "0", "x-ratelimit-reset": "5"}).reset_at == 5
    assert isinstance(errors.from_status(429), errors.RateLimited)
    assert type(errors.from_status(500, "boom")) is errors.EngineError
