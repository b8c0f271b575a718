"""Relational reports: commits, branches, projects, comparison, refresh summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Names under which a README is looked for, in order.
README_NAMES = ("README.md", "readme.md", "README.MD", "README")


def recent_commits(commits: DataFrame, limit: int = 10) -> DataFrame:
    """The newest commits (repo, sha, author, login, date, message) of each repository: author falls
    back to login, then unknown; message is the first line. limit is held within 1 and 100."""
    limit = max(1, min(100, limit))
    order = Window.partitionBy("repo").orderBy(F.desc_nulls_last("date"), "sha")
    best = commits.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return best.select(
        "repo", "position", F.substring("sha", 1, 7).alias("short_sha"), F.coalesce("author", "login", F.lit("unknown")).alias("author"),
        "date", tx.first_line(F.col("message")).alias("message"),
    )


def project_status(meta: DataFrame, commits: DataFrame, pulls: DataFrame, issues: DataFrame, cap: int | None = None) -> DataFrame:
    """meta with its latest commit and the numbers of open pull requests and issues, capped if asked."""
    capped = (lambda c: F.least(c, F.lit(cap))) if cap else (lambda c: c)
    latest = commits.groupBy("repo").agg(F.max_by(F.struct("sha", "date"), "date").alias("last_commit"))
    n_pulls = pulls.where("state = 'open'").groupBy("repo").agg(capped(F.count("*")).alias("open_pull_requests"))
    n_issues = issues.where("state = 'open' AND NOT is_pull").groupBy("repo").agg(capped(F.count("*")).alias("open_issues"))
    out = meta.join(latest, "repo", "left").join(n_pulls, "repo", "left").join(n_issues, "repo", "left")
    return out.fillna(0, ["open_pull_requests", "open_issues"])


def compare_status(requested: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """requested (repo) against status (repo, last_activity, last_commit_at, open_pull_requests,
    open_issues): ok, days since either date, and the days by which commits lag behind activity.
    A repository without status fails; a null date gives null days."""
    both = requested.join(status.withColumn("_ok", F.lit(True)), "repo", "left")
    activity, commit = tx.days_since(F.col("last_activity"), now), tx.days_since(F.col("last_commit_at"), now)
    lag = F.when(activity.isNotNull() & commit.isNotNull(), F.greatest(F.lit(0), commit - activity))
    return both.select(
        "repo", F.coalesce("_ok", F.lit(False)).alias("ok"), "open_pull_requests", "open_issues",
        activity.alias("days_since_activity"), commit.alias("days_since_commit"), lag.alias("commit_gap_days"),
    )


def compare_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("requested"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(F.sum("open_pull_requests"), F.lit(0)).alias("open_pull_requests"), F.coalesce(F.sum("open_issues"), F.lit(0)).alias("open_issues"),
    )


def list_branches(branches: DataFrame, runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest branches of each repository, undated last, with the number of all, whether each is
    indexed and when."""
    limit = max(1, min(100, limit))
    order = Window.partitionBy("repo").orderBy(F.desc_nulls_last("last_commit_at"), "branch")
    total = F.count("*").over(Window.partitionBy("repo"))
    best = branches.withColumns({"position": F.row_number().over(order), "total": total}).where(F.col("position") <= limit)
    held = best.join(runs.select("repo", "branch", "indexed_at"), ["repo", "branch"], "left")
    return held.select("repo", "position", "total", "branch", "last_commit_at", F.col("indexed_at").isNotNull().alias("indexed"), "indexed_at")


def list_projects(catalog: DataFrame, runs: DataFrame) -> DataFrame:
    """catalog (repo, description) with its indexed branches as an array of structs, empty if none."""
    entry = F.struct(tx.branch_order(F.col("branch")).alias("_o"), "branch", "files", "chunks", "indexed_at")
    nested = runs.groupBy("repo").agg(F.array_sort(F.collect_list(entry)).alias("_b"))
    plain = F.transform("_b", lambda e: F.struct(e["branch"].alias("branch"), e["files"].alias("files"), e["chunks"].alias("chunks"), e["indexed_at"].alias("indexed_at")))
    return catalog.join(nested, "repo", "left").withColumn("indexed_branches", F.coalesce(plain, F.array().cast("array<struct<branch:string,files:bigint,chunks:bigint,indexed_at:timestamp>>"))).drop("_b")


def readme_excerpt(files: DataFrame, chars: int = 2000) -> DataFrame:
    """repo, path, excerpt, truncated: the first README name that a repository has."""
    names = F.array(*map(F.lit, README_NAMES))
    held = files.withColumn("_o", F.array_position(names, F.col("path"))).where("_o > 0")
    best = held.groupBy("repo").agg(F.min_by(F.struct("path", F.substring("content", 1, chars).alias("excerpt"), F.length("content").alias("_n")), "_o").alias("r"))
    return best.select("repo", "r.path", "r.excerpt", (F.col("r._n") > chars).alias("truncated"))


def refresh_summary(results: DataFrame) -> DataFrame:
    """results (repo, branch, files, chunks, embedded, reused, error) -> totals of the run."""
    good = F.col("error").isNull()
    total = lambda c: F.coalesce(F.sum(F.when(good, F.col(c))), F.lit(0)).alias(c)
    per_repo = results.groupBy("repo").agg(
        F.count_if(good).alias("_ok"), *(total(c) for c in ("files", "chunks", "embedded", "reused")), F.bool_or(~good).alias("_bad")
    )
    names = ("files", "chunks", "embedded", "reused")
    return per_repo.agg(
        F.count("*").alias("repos"), F.coalesce(F.sum("_ok"), F.lit(0)).alias("branches"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), F.count_if("_bad").alias("failed"),
    )
