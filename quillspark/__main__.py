"""python -m quillspark COMMAND: the index and its served operations.

Where things are comes from the environment: QUILLSPARK_CATALOG, QUILLSPARK_FILES (checkouts) and
QUILLSPARK_STORE; QUILLSPARK_EMBEDDINGS_URL and QUILLSPARK_MODEL name an embedding server,
QUILLSPARK_MAX_AGE_HOURS when an index is stale.

    refresh [REPO]               refresh all or one repository and print the report
    stale                        refresh what is older than the setting
    search QUERY [REPO [BRANCH]] hits as JSON
    listen LANDING CHECKPOINT    refresh repositories whose files arrive as Parquet
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .refresh import Indexer
from .settings import Settings
from .sources.catalog import load_catalog
from .sources.files import read_checkouts
from .sources.store import Store
from .streaming.ingest import refresh_on_arrival


def indexer(spark: SparkSession, settings: Settings) -> Indexer:
    files = lambda: read_checkouts(spark, settings.files)
    branches = lambda: files().groupBy("repo", "branch").agg(F.lit(None).cast("timestamp").alias("last_commit_at"))
    provider, ask = settings.providers()
    return Indexer(Store(spark, settings.store), load_catalog(settings.catalog), files, branches, provider, settings.model, ask)


def refresh(held: Indexer, repo: str | None = None) -> int:
    report = held.refresh(repo)
    for name, value in report.items():
        if name != "results":
            print(f"{name}: {value}")
    for result in report["results"]:
        print(f"{result['repo']}: {result['error'] or 'ok'}")
        for b in result["branches"]:
            print(f"  {b['branch']}: {b['error'] or str(b['chunks']) + ' chunks'}", *(f"\n    skipped {x}" for x in b["skipped"]))
    return int(report["failed"] > 0)


def main(spark: SparkSession, settings: Settings, command: str = "", *rest: str) -> int:
    held = indexer(spark, settings)
    if command == "refresh":
        return refresh(held, *rest)
    if command == "stale":
        return int(any(x != "ok" for x in held.refresh_stale(settings.max_age_hours).values()))
    if command == "search":
        ok, told = api.guarded(lambda: api.Engine(held, {}).search(*rest))
        print(told)
        return int(not ok)
    if command == "listen":
        refresh_on_arrival(spark, *rest, held.refresh).awaitTermination()
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(SparkSession.builder.appName("quillspark").getOrCreate(), Settings.from_env(), *sys.argv[1:]))
