"""Refreshing the index: one job for all repositories and branches of a scope."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import errors
from .operators import cache, chunker
from .plans import refresh_plan as plan
from .sources.catalog import Catalog
from .sources.store import Store

MAX_FILE_BYTES = 300_000
DEFAULT_MAX_AGE_HOURS = 12


@dataclass
class Indexer:
    """files: function that gives the table repo, branch, path, content; branches: repo, branch,
    last_commit_at."""

    store: Store
    catalog: Catalog
    files: Callable[[], DataFrame]
    branches: Callable[[], DataFrame]
    provider: Callable = cache.word_provider
    model: str = "words-v1"
    ask_provider: Callable | None = None  # for questions, where it is another
    _queue: threading.Lock = field(default_factory=threading.Lock)
    _running: dict = field(default_factory=dict)
    _guard: threading.Lock = field(default_factory=threading.Lock)

    def ask(self, questions: list[str]):
        """Vectors of questions."""
        return (self.ask_provider or self.provider)(questions)

    def refresh(self, repo: str | None = None) -> dict:
        """Refresh all or one repository (full name). Callers of a scope that is being refreshed get
        that run's result; different scopes wait for each other."""
        with self._guard:
            mine = repo not in self._running
            future = self._running.setdefault(repo, Future())
        if not mine:
            return future.result()
        try:
            with self._queue, self.store.writing():
                result = self._run(repo)
            future.set_result(result)
            return result
        except BaseException as e:
            future.set_exception(e)
            raise
        finally:
            with self._guard:
                self._running.pop(repo, None)

    def _run(self, repo: str | None) -> dict:
        """All branches of the scope in one job. If that fails, repositories are tried one by one, and the
        branches of one that fails too; what fails alone is reported and keeps its old chunks. A rate
        limit ends the run: what is left is reported as skipped."""
        spark = self.store.spark
        known = self.catalog.frame(spark)
        if repo:
            known = known.where(F.col("full_name") == repo)
        named = known.select(F.col("full_name").alias("repo"), "alias", "doc_patterns", "branches", "ordinal")
        states, results = [], {}
        # A few branches for each repository of the catalog.
        try:
            states = self._planned(named)
        except Exception as e:
            for r in named.collect():
                one = named.where(F.col("repo") == r["repo"])
                try:
                    if not errors.is_rate_limit(e):
                        states += self._planned(one)
                        continue
                except Exception as own:
                    e = own
                results[r["repo"], None] = _failed(e)
        chosen = [(r["repo"], r["branch"]) for r in states if r["state"] != "missing"]
        results |= self._indexed(named, chosen)
        done = [c for c in chosen if results[c]["error"] is None]
        keep: dict[str, list[str]] = {}
        for r in states:  # planned branches stay, also those that failed or are missing for now
            keep.setdefault(r["repo"], []).append(r["branch"])
        pruned = self.store.prune({r: keep[r] for r in {r for r, _ in done}})
        return self._report(named, states, results, pruned)

    def _planned(self, named: DataFrame) -> list:
        """The planned branches, in the order of the catalog, configured ones first."""
        planned = plan.plan_branches(self.branches(), named.select("repo", "branches"), F.current_timestamp(), self.catalog.active_branch_days, self.catalog.max_active_branches)
        order = F.col("state") == "active", "ordinal"
        return planned.join(named.select("repo", F.col("ordinal").alias("_r")), "repo").orderBy("_r", *order).collect()

    def _indexed(self, named: DataFrame, chosen: list[tuple[str, str]]) -> dict[tuple[str, str], dict]:
        """(repo, branch) -> files, chunks, embedded, reused, skipped, error."""
        out: dict[tuple[str, str], dict] = {}
        waiting, stopped = [chosen] if chosen else [], None
        while waiting:
            scope = waiting.pop(0)
            try:
                if stopped:
                    raise stopped
                out |= self._index(named, scope)
            except Exception as e:
                repos = sorted({r for r, _ in scope}, key=[r for r, _ in scope].index)
                if errors.is_rate_limit(e):
                    stopped = stopped or errors.RateLimited(f"skipped: {errors.short(e)}", getattr(e, "reset_at", None))
                    out |= {c: _failed(e) for c in scope}
                elif len(repos) > 1:
                    waiting = [[c for c in scope if c[0] == r] for r in repos] + waiting
                elif len(scope) > 1:
                    waiting = [[c] for c in scope] + waiting
                else:
                    out[scope[0]] = _failed(e)
        return out

    def _index(self, named: DataFrame, chosen: list[tuple[str, str]]) -> dict[tuple[str, str], dict]:
        """One job for the given branches; chunks are cut once and written before they are read."""
        spark, store = self.store.spark, self.store
        scope = spark.createDataFrame([(*c, i) for i, c in enumerate(chosen)], "repo string, branch string, ord int")
        mine = named.join(scope.select("repo").distinct(), "repo", "left_semi")
        files = self.files().join(F.broadcast(scope), ["repo", "branch"])
        wanted = plan.match_paths(files.select("repo", "path").distinct(), mine.select("repo", F.explode("doc_patterns").alias("pattern")))
        sized, refused = store.counted("files", plan.size_filter(files.join(wanted, ["repo", "path"], "left_semi"), MAX_FILE_BYTES), skipped=F.count("skipped"))
        cut = chunker.cut(sized.where("skipped IS NULL").select("repo", "branch", "ord", "path", "content"))
        tried, broken = store.counted("cut", cut.withColumnRenamed("text", "content").withColumn("content_hash", cache.content_hash()), skipped=F.count("error"))
        cut = tried.where("error IS NULL").drop("error")
        # The provider runs once for each text that the cache lacks, before anything reads the vectors.
        misses = cache.cache_misses(cut, store.cache(), self.model, store.buckets())
        asked, got = store.counted("vectors", cache.embed(misses, self.provider), skipped=F.count("error"), fatal=F.count("fatal"), fresh=F.count_if(F.col("error").isNull()))
        if got["fatal"] != 0:
            cache.stop_if_fatal(asked)
        # What was counted as none while it was written is not read again.
        fresh, new_texts, skipped = asked.where("error IS NULL"), {}, {}
        if got["fresh"] != 0:
            new_texts = {(r["repo"], r["branch"]): r["n"] for r in self._first_of(cut, fresh).collect()}
            store.append_cache(fresh.select("content_hash", "embedding"), self.model)
        rows = cache.with_vectors(cut.join(mine.select("repo", "alias"), "repo"), store.vectors_of(cut, self.model), self.model)
        key = F.xxhash64("repo", "branch", "path", "chunk_index")
        held = store.replace_branches(rows.withColumns({"chunk_id": key, "dimensions": F.size("embedding"), "indexed_at": F.current_timestamp()}), chosen, self.model)
        if any(x["skipped"] != 0 for x in (refused, broken, got)):
            skipped = {(r["repo"], r["branch"]): r["s"] for r in self._skipped(sized, tried, cut, asked).collect()}
        out = {}
        for r in held:
            c = r["repo"], r["branch"]
            new = new_texts.get(c, 0)
            out[c] = {"files": r["files"], "chunks": r["chunks"], "embedded": new, "reused": r["texts"] - new, "skipped": skipped.get(c, []), "error": None}
        return out

    def _report(self, named: DataFrame, states: list, results: dict, pruned: dict[str, int]) -> dict:
        """Totals, and under results each repository with its branches and what was skipped."""
        nested = []
        for r in named.orderBy("ordinal").collect():
            name, own = r["repo"], [s for s in states if s["repo"] == r["repo"]]
            branches = [{"branch": s["branch"], "active": s["state"] == "active", **results[name, s["branch"]]} for s in own if s["state"] != "missing"]
            sums = {k: sum(b[k] for b in branches) for k in COUNTS}
            missing = [s["branch"] for s in own if s["state"] == "missing"]
            error = results.get((name, None), {}).get("error")
            nested.append({"repo": name, "alias": r["alias"], "branches": branches, **sums, "missing": missing, "pruned": pruned.get(name, 0), "error": error})
        bad = [b["error"] for n in nested for b in ({"error": n["error"]}, *n["branches"]) if b["error"]]
        return {
            "model": self.model, "indexed_at": dt.datetime.now(dt.timezone.utc).isoformat(), "repos": len(nested),
            "branches": sum(b["error"] is None for n in nested for b in n["branches"]), **{k: sum(n[k] for n in nested) for k in COUNTS},
            "failed": len({n["repo"] for n in nested if n["error"] or any(b["error"] for b in n["branches"])}), "first_error": bad[0] if bad else None,
            "missing": [f"{n['repo']}@{b}" for n in nested for b in n["missing"]], "pruned": sum(n["pruned"] for n in nested), "results": nested,
        }

    @staticmethod
    def _skipped(sized: DataFrame, tried: DataFrame, cut: DataFrame, asked: DataFrame) -> DataFrame:
        """repo, branch, s: each file that is not indexed, or not whole, with the reason: its source or size,
        the chunker, or texts for which the provider has no vector."""
        bad = asked.where("error IS NOT NULL").select("content_hash", "error")
        texts = cut.join(bad, "content_hash").groupBy("repo", "branch", "path").agg(F.count("*").alias("n"), F.min("error").alias("e"))
        texts = texts.select("repo", "branch", "path", F.concat(F.col("n").cast("string"), F.lit(" chunks without a vector: "), "e").alias("why"))
        files = sized.where("skipped IS NOT NULL").select("repo", "branch", "path", F.col("skipped").alias("why"))
        pieces = tried.where("error IS NOT NULL").select("repo", "branch", "path", F.col("error").alias("why"))
        told = files.unionByName(pieces).unionByName(texts)
        return told.groupBy("repo", "branch").agg(F.array_sort(F.collect_list(F.concat("path", F.lit(" ("), "why", F.lit(")")))).alias("s"))

    @staticmethod
    def _first_of(cut: DataFrame, misses: DataFrame) -> DataFrame:
        """How many of the missing texts occur first in each branch."""
        first = cut.join(misses.select("content_hash"), "content_hash", "left_semi").groupBy("content_hash").agg(F.min(F.struct("ord", "repo", "branch")).alias("f"))
        return first.groupBy("f.repo", "f.branch").agg(F.count("*").alias("n"))

    def stale(self, max_age_hours: float) -> list[str]:
        known = self.catalog.frame(self.store.spark).select(F.col("full_name").alias("repo"))
        runs = self.store.runs().withColumn("indexed_at", F.col("indexed_at").cast("string"))
        return sorted(r["repo"] for r in plan.stale_repos(known, runs, self.model, F.current_timestamp(), max_age_hours).collect())

    def refresh_stale(self, setting: str | None, log: Callable[[str], None] = print) -> dict[str, str]:
        """Refresh what is older than the setting (hours; bad values count as the default, 0 turns it
        off). One repository's failure does not stop the others: repo -> ok or its first error, be it
        of a branch."""
        try:
            hours = float(setting) if setting not in (None, "") else DEFAULT_MAX_AGE_HOURS
            if not 0 <= hours < float("inf"):
                raise ValueError
        except ValueError:
            log(f"{setting!r} is no number of hours; {DEFAULT_MAX_AGE_HOURS} is used")
            hours = DEFAULT_MAX_AGE_HOURS
        out = {}
        for repo in self.stale(hours):
            try:
                report = self.refresh(repo)
                out[repo] = "ok" if not report.get("first_error") else report["first_error"]
                log(", ".join(f"{k} {report[k]}" for k in ("files", "chunks", "embedded", "reused", "failed", "first_error") if k in report).join((f"{repo}: ", "")))
            except Exception as e:
                out[repo] = str(e)
                log(f"{repo}: {e}")
        return out


COUNTS = ("files", "chunks", "embedded", "reused")


def _failed(error: BaseException) -> dict:
    return dict.fromkeys(COUNTS, 0) | {"skipped": [], "error": errors.short(error)}
