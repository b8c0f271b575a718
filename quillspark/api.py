"""The served operations over a store and a catalog, each a DataFrame or a small dict."""

from __future__ import annotations

import datetime as dt
import json
import logging
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .errors import ConfigError, EngineError, ModelMismatch, NotFound, Unreadable
from .functions import text as tx
from .operators import reports, search
from .plans import refresh_plan as plan
from .refresh import Indexer
from .sources.store import Snapshot

MAX_READ_BYTES = 400_000
HITS_NOTE = "As of the last refresh, not of this moment. A text that is on a feature branch alone is not released yet: see branches."
NO_HITS_NOTE = "Nothing was found: the documents do not cover it, or the index is out of date and wants a refresh."


def _within(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ConfigError(f"{name} must be from {low} to {high}")
    return value


class Engine:
    """sources: name -> DataFrame for meta, commits, pulls, issues (see operators.reports)."""

    def __init__(self, indexer: Indexer, sources: dict[str, DataFrame]):
        self.indexer, self.store, self.sources = indexer, indexer.store, sources
        self.spark = self.store.spark
        self.catalog = indexer.catalog.frame(self.spark)

    def _resolve(self, reference: str) -> tuple[str, str]:
        """Alias and full name of a reference."""
        asked = self.spark.createDataFrame([(reference,)], "reference string")
        alias = plan.resolve(asked, self.catalog).first()["alias"]
        if alias is None:
            known = ", ".join(sorted(r["alias"] for r in self.catalog.select("alias").collect()))
            raise NotFound(f"unknown repository {reference!r}; known: {known}")
        return alias, self.catalog.where(F.col("alias") == alias).first()["full_name"]

    def list_projects(self) -> DataFrame:
        """All projects of the catalog, in its order; one without metadata has an error instead."""
        meta = self.sources["meta"].drop("description").withColumn("_known", F.lit(True))
        held = self.catalog.select(F.col("full_name").alias("repo"), "alias", "description", "ordinal").join(meta, "repo", "left")
        error = F.when(F.col("_known").isNull(), F.concat(F.lit("not found, or not visible to the token: "), "repo"))
        return reports.list_projects(held.withColumn("error", error).drop("_known"), self.store.runs()).orderBy("ordinal").drop("ordinal")

    def _status(self) -> DataFrame:
        s = self.sources
        return reports.project_status(s["meta"], s["commits"], s["pulls"], s["issues"])

    def get_project_status(self, repo: str) -> DataFrame:
        return self._status().where(F.col("repo") == self._resolve(repo)[1])

    def get_recent_commits(self, repo: str, limit: int = 10) -> DataFrame:
        name = self._resolve(repo)[1]
        return reports.recent_commits(self.sources["commits"].where(F.col("repo") == name), _within("limit", limit, 1, 100))

    def list_branches(self, repo: str, limit: int = 20) -> DataFrame:
        name = self._resolve(repo)[1]
        return reports.list_branches(self.indexer.branches().where(F.col("repo") == name), self.store.runs(), _within("limit", limit, 1, 100))

    def search_project_docs(self, query: str, repo: str | None = None, branch: str | None = None, limit: int = 5) -> DataFrame:
        """Hybrid search in a scope. An empty scope and an index of another model are errors."""
        return self._found(self.store.snapshot(), query, repo, branch, limit)

    def _found(self, held: Snapshot, query: str, repo: str | None, branch: str | None, limit: int) -> DataFrame:
        """All of a search reads one state of the store."""
        _within("limit", limit, 1, 20)
        if len(query) < 3:
            raise ConfigError("a query has three characters or more")
        name = self._resolve(repo)[1] if repo else None
        if not search.in_scope(held.live(), name, branch).take(1):
            raise NotFound(self._empty(name, branch))
        models = sorted(r["model"] for r in search.in_scope(held.runs(), name).select("model").distinct().collect())
        if models != [self.indexer.model]:
            raise ModelMismatch(f"indexed with {', '.join(models)}, asked with {self.indexer.model}; refresh the index")
        q = np.asarray(self.indexer.ask([query])[0], float)
        norm = float(np.sqrt((q * q).sum()))
        asked = self.spark.createDataFrame([(0, query, [float(x) for x in (q / norm if norm > 0 and np.isfinite(norm) else q)])], "query_id long, query string, q array<double>")
        terms = [r["term"] for r in search.terms_of(asked).select("term").collect()]  # those of one question
        with shared.temporary(self.spark):
            found = search.hybrid_search(asked, None, limit, name, branch, held.index(terms), held.texts()).drop("query_id")
            return self.spark.createDataFrame(sorted(found.collect(), key=lambda r: r["position"]), found.schema)  # at most 20 rows

    def search(self, query: str, repo: str | None = None, branch: str | None = None, limit: int = 5) -> dict:
        """What search_project_docs finds, as it is served: with the scope, the model, the hits' texts and a
        word on what they are."""
        now = self.store.snapshot()
        found = self._found(now, query, repo, branch, limit)
        held = now.chunks().select("chunk_id", "content", "indexed_at")
        # At most 20 hits.
        hits = [r.asDict(True) for r in found.join(held, "chunk_id").orderBy("position").drop("position", "chunk_id", "keyword_rank").collect()]
        scope = {"repo": self._resolve(repo)[1] if repo else "all repositories", "branch": branch or "all indexed branches"}
        return {"query": query, "scope": scope, "model": self.indexer.model, "results": hits, "note": HITS_NOTE if hits else NO_HITS_NOTE}

    def _empty(self, repo: str | None, branch: str | None) -> str:
        found = [r["branch"] for r in search.in_scope(self.store.runs(), repo).select("branch").distinct().orderBy("branch").collect()]
        if not found:
            return f"nothing is indexed for {repo} yet; refresh it first" if repo else "the index is empty; refresh it first"
        if branch:
            return f"branch {branch!r} is not indexed{f' for {repo}' if repo else ''}; indexed: {', '.join(found)}"
        return f"nothing is indexed{f' for {repo}' if repo else ''}; refresh first"

    def refresh_index(self, repo: str | None = None) -> dict:
        return self.indexer.refresh(self._resolve(repo)[1] if repo else None)

    def get_project_summary(self, repo: str, readme_chars: int = 2000) -> DataFrame:
        name = self._resolve(repo)[1]
        _within("readme_chars", readme_chars, 200, 10_000)
        status = self._status().where(F.col("repo") == name)
        files = self.indexer.files().where(F.col("repo") == name).join(status.select("repo", F.col("default_branch").alias("branch")), ["repo", "branch"], "left_semi")
        return status.join(reports.readme_excerpt(files, readme_chars), "repo", "left")

    def get_file_content(self, repo: str, path: str, branch: str | None = None) -> DataFrame:
        name = self._resolve(repo)[1]
        clean = self.spark.range(1).select(tx.clean_path(F.lit(path)).alias("p")).first()["p"]
        if clean is None:
            raise ConfigError(f"not a path inside the repository: {path!r}")
        held = self.indexer.files().where((F.col("repo") == name) & (F.col("path") == clean))
        if branch:
            held = held.where(F.col("branch") == branch)
        else:
            held = held.join(self.sources["meta"].select("repo", F.col("default_branch").alias("branch")), ["repo", "branch"], "left_semi")
        held = plan.size_filter(held, MAX_READ_BYTES)
        told = held.select("skipped").first()
        if told is None:
            raise NotFound(f"{name}/{clean}")
        if told["skipped"]:
            raise Unreadable(f"{name}/{clean} is not read: {told['skipped']}")
        return held.drop("skipped")

    def compare_status(self, repos: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(projects, newest activity first and unknown names failed, summary)."""
        if repos is None:
            requested = self.catalog.select(F.col("full_name").alias("repo"))
        else:
            asked = self.spark.createDataFrame([(r,) for r in repos], "reference string")
            named = plan.resolve(asked, self.catalog).join(self.catalog.select("alias", "full_name"), "alias", "left")
            requested = named.select(F.coalesce("full_name", "reference").alias("repo"))
        status = self._status().select("repo", F.try_to_timestamp("last_activity").alias("last_activity"), F.col("last_commit.date").alias("last_commit_at"), "open_pull_requests", "open_issues")
        compared = reports.compare_status(requested, status, F.current_timestamp())
        return compared.orderBy(F.asc_nulls_last("days_since_activity"), "repo"), reports.compare_summary(compared).withColumn("checked_at", F.current_timestamp())


def as_json(result: DataFrame | dict | tuple) -> str:
    """A result of the operations as JSON text: rows become objects, times ISO text. For served results,
    which are small; tables are written by Spark."""
    plain = lambda r: [x.asDict(True) for x in r.collect()] if isinstance(r, DataFrame) else r
    held = [plain(r) for r in result] if isinstance(result, tuple) else plain(result)
    return json.dumps(held, ensure_ascii=False, indent=2, default=lambda x: x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else str(x))


def guarded(run: Callable[[], DataFrame | dict | tuple]) -> tuple[bool, str]:
    """(whether it went well, JSON text or the error's message). Unexpected errors are logged whole."""
    try:
        return True, as_json(run())
    except EngineError as e:
        return False, str(e)
    except Exception as e:
        logging.getLogger(__name__).exception("unexpected error")
        return False, f"unexpected error: {e}"
