"""The data source of projects over Parquet tables and over HTTP."""

import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from quillspark.operators import reports
from quillspark.sources import projects


@pytest.fixture(scope="module")
def service():
    asked = []
    commit = lambda k: {"sha": f"{k:040d}", "commit": {"author": {"name": None if k == 1 else "Ana", "date": f"2026-01-{k % 28 + 1:02d}T00:00:00Z"}, "message": f"m{k}\nbody"}, "author": {"login": "ana"}}
    told = {
        "o/a": {"description": "A", "default_branch": "main", "pushed_at": "2026-02-01T00:00:00Z", "html_url": "u", "private": False, "archived": True},
        "o/a/commits": [commit(k) for k in range(230)], "o/a/pulls": [{"state": "open"}] * 2, "o/a/issues": [{"state": "open"}, {"state": "open", "pull_request": {}}],
        "o/a/branches": [{"name": "main", "commit": {"sha": "s1"}}, {"name": "x", "commit": {"sha": "lost"}}], "o/a/commits/s1": commit(3),
        "o/a/git/trees/main": {"tree": [{"type": "blob", "path": "README.md", "sha": "b", "size": 5}, {"type": "tree", "path": "docs"}]},
        "o/b": {"default_branch": "main"}, "o/b/commits": [], "o/b/pulls": [], "o/b/issues": [],
    }

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            at = urllib.parse.urlparse(self.path)
            path, query = at.path.removeprefix("/repos/"), dict(urllib.parse.parse_qsl(at.query))
            asked.append((path, query.get("page"), self.headers.get("authorization")))
            limited = path.startswith("o/limited")
            found = told.get(path)
            self.send_response(403 if limited else 200 if found is not None else 404)
            if limited:
                self.send_header("x-ratelimit-remaining", "0")
                self.send_header("x-ratelimit-reset", "1700000000")
            self.end_headers()
            if isinstance(found, list):
                k, n = int(query["page"]), int(query["per_page"])
                found = found[(k - 1) * n : k * n]
            self.wfile.write(json.dumps(found if found is not None else {"message": "no"}).encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()
    server.server_close()


def test_over_http(spark, service, monkeypatch):
    url, asked = service
    monkeypatch.setenv("A_TOKEN", "secret")
    read = lambda kind, repos: projects.read(spark, kind, url=url, repos=repos, token_env="A_TOKEN")
    commits = read("commits", "o/a, o/b")
    assert "secret" not in commits._jdf.queryExecution().toString()
    assert commits.count() == 230 and {a for _, _, a in asked} == {"Bearer secret"}
    assert [r["author"] for r in reports.recent_commits(commits, 100).where("message = 'm1'").collect()] in ([], ["ana"])
    assert [tuple(r)[:7] for r in read("meta", "o/a").collect()] == [("o/a", "A", "main", "2026-02-01T00:00:00Z", "u", False, True)]
    got = {r["branch"]: (r["last_commit_at"], r["is_default"]) for r in read("branches", "o/a").collect()}
    assert got == {"main": ("2026-01-04T00:00:00Z", True), "x": (None, False)}  # the date of x is lost, the branch is not
    assert [(r["path"], r["size_bytes"]) for r in read("tree", "o/a").collect()] == [("README.md", 5)]
    status = reports.project_status(*(projects.sources(spark, url=url, repos="o/a,o/b")[k] for k in ("meta", "commits", "pulls", "issues")))
    assert {r["repo"]: (r["open_pull_requests"], r["open_issues"]) for r in status.collect()} == {"o/a": (2, 1), "o/b": (0, 0)}


def test_refusals_are_rows(spark, service):
    url, asked = service
    asked.clear()
    read = projects.read(spark, "commits", url=url, repos="o/none,o/limited,o/a,o/b", tasks="1")
    rows = {r["repo"]: r for r in read.where("error IS NOT NULL").collect()}
    assert "not found" in rows["o/none"]["error"] and rows["o/none"]["reset_at"] is None
    # After the rate limit nothing is asked any more.
    assert all("rate limit" in rows[r]["error"] and rows[r]["reset_at"] == 1700000000 for r in ("o/limited", "o/a", "o/b"))
    assert {p.split("/")[1] for p, _, _ in asked} == {"none", "limited"} and set(rows) == {"o/none", "o/limited", "o/a", "o/b"}


def test_filters_are_pushed_down(spark, service, tmp_path):
    url, asked = service
    asked.clear()
    one = projects.read(spark, "pulls", url=url, repos="o/a,o/b,o/none").where("repo = 'o/a'")
    assert one.count() == 2 and {p for p, _, _ in asked} == {"o/a/pulls"} and one.rdd.getNumPartitions() == 1
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"user": list(range(1000)), "what": [f"w{k}" for k in range(1000)], "at": [None if k == 5 else k for k in range(1000)]})
    pq.write_table(table, f"{tmp_path}/t.parquet", row_group_size=100)
    held = projects.read(spark, "commits", path=f"{tmp_path}/t.parquet", repo="user", field_message="what", field_date="at")
    assert held.rdd.getNumPartitions() == 10 and held.count() == 1000
    few = held.where(F.col("repo").isin("5", "730", "no number"))
    assert few.rdd.getNumPartitions() == 2
    assert sorted((r["repo"], r["message"], r["date"], r["sha"]) for r in few.collect()) == [("5", "w5", None, None), ("730", "w730", "730", None)]
    assert held.where("repo = '5' AND repo = '6'").count() == 0 and held.where("message = 'w7'").count() == 1


def test_bad_options(spark):
    for options in ({"kind": "other", "path": "x"}, {"kind": "meta"}):
        with pytest.raises(Exception, match="must be one of|needs the option"):
            projects.read(spark, **options).collect()
