"""Planners over metadata: branches, document paths, references, stale repositories, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def plan_branches(branches: DataFrame, catalog: DataFrame, now: Column, days: int = 0, most: int = 5) -> DataFrame:
    """branches (repo, branch, last_commit_at), catalog (repo, branches) -> repo, branch, state, ordinal.

    state: configured (exists), missing (configured, does not exist) or active (not configured, its
    last commit within `days`, the newest `most` of each repository; 0 days: none). Ties by name."""
    wanted = catalog.select("repo", F.posexplode("branches").alias("ordinal", "branch"))
    found = branches.select("repo", "branch", F.lit(True).alias("_found")).distinct()
    configured = wanted.join(found, ["repo", "branch"], "left")
    configured = configured.select("repo", "branch", F.when(F.col("_found"), "configured").otherwise("missing").alias("state"), "ordinal")
    order = Window.partitionBy("repo").orderBy(F.desc("last_commit_at"), "branch")
    others = branches.join(catalog.select("repo"), "repo", "left_semi").join(wanted.select("repo", "branch"), ["repo", "branch"], "left_anti")
    fresh = others.where(F.lit(days > 0) & (F.col("last_commit_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")))
    active = fresh.withColumn("ordinal", F.row_number().over(order) - 1).where(F.col("ordinal") < most)
    return configured.unionByName(active.select("repo", "branch", F.lit("active").alias("state"), "ordinal"))


def match_paths(tree: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of tree (with repo, path) that any of the repository's patterns (repo, pattern) matches.
    Exact names meet by equality; a repository's globs travel as one short array."""
    exact = patterns.where(~tx.is_glob(F.col("pattern"))).select("repo", F.col("pattern").alias("path")).distinct()
    by_name = tree.join(exact, ["repo", "path"], "left_semi")
    globs = patterns.where(tx.is_glob(F.col("pattern"))).groupBy("repo").agg(F.collect_set("pattern").alias("_globs"))
    by_glob = tree.join(globs, "repo").where(F.exists("_globs", lambda g: tx.matches_pattern(F.col("path"), g))).drop("_globs")
    return by_name.unionByName(by_glob).distinct()


def resolve(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """references (reference) -> reference, alias: the first catalog entry (ordinal) whose alias, repo
    or full name it is, without regard to case and outer blanks; null if none."""
    keys = F.explode(F.array_distinct(F.array(*(F.lower(c) for c in ("alias", "repo", "full_name"))))).alias("_key")
    known = catalog.select("alias", "ordinal", keys).groupBy("_key").agg(F.min_by("alias", "ordinal").alias("alias"))
    asked = references.withColumn("_key", F.lower(tx.squeeze_ends(F.col("reference"))))
    return asked.join(known, "_key", "left").select("reference", "alias")


def stale_repos(catalog: DataFrame, runs: DataFrame, model: str, now: Column, max_age_hours: float) -> DataFrame:
    """repo, newest: repositories without a run of the model, or whose newest is older than the age;
    equal age is fresh, an age of 0 or less turns it off. Runs with an unreadable time do not count."""
    newest = runs.where(F.col("model") == model).select("repo", F.try_to_timestamp("indexed_at").alias("_at"))
    newest = newest.where("_at IS NOT NULL").groupBy("repo").agg(F.max("_at").alias("newest"))
    cutoff = now - F.expr(f"INTERVAL {int(max_age_hours * 3600)} SECONDS")
    held = catalog.select("repo").distinct().join(newest, "repo", "left")
    return held.where(F.lit(max_age_hours > 0) & (F.col("newest").isNull() | (F.col("newest") < cutoff)))


def prunable(chunks: DataFrame, keep: DataFrame) -> DataFrame:
    """Chunks of repositories in keep (repo, branch) whose branch is not kept; a repository that keeps
    nothing is left alone."""
    return chunks.join(keep.select("repo").distinct(), "repo", "left_semi").join(keep, ["repo", "branch"], "left_anti")


def size_filter(files: DataFrame, most: int = 300_000, content: str = "content") -> DataFrame:
    """files with size_bytes and skipped: the reason a file is not indexed, or null. Where the source tells
    an error for a file (a column `error`), that is the reason."""
    size = F.octet_length(F.coalesce(F.col(content), F.lit("")))
    reason = F.when(size > most, F.concat(F.lit("too large: "), size.cast("string"))).when(F.locate("\0", F.col(content)) > 0, F.lit("binary"))
    if "error" in files.columns:
        reason = F.coalesce(F.col("error"), reason)
    return files.withColumns({"size_bytes": size.cast("long"), "skipped": reason})
