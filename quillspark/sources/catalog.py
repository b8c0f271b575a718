"""The catalog of repositories: a small JSON file, validated, as a DataFrame."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError

SCHEMA = "ordinal int, alias string, owner string, repo string, full_name string, description string, doc_patterns array<string>, branches array<string>"
ALIAS = re.compile(r"[a-z0-9][a-z0-9-]*")
PLACEHOLDER = re.compile(r"REPLACE-ME|REEMPLAZAR", re.I)


@dataclass
class Catalog:
    rows: list[tuple]
    active_branch_days: int = 0
    max_active_branches: int = 5
    warnings: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)


def _text(held: dict, key: str, default: str | None = None) -> str:
    value = held.get(key, default)
    if not isinstance(value, str) or not value and default is None:
        raise ConfigError(f"{key} must be a text that is not empty")
    return value


def _texts(held: dict, key: str, default: list[str] | None, least: int = 1) -> list[str]:
    value = held.get(key, default)
    if not isinstance(value, list) or len(value) < least or not all(isinstance(x, str) and x for x in value):
        raise ConfigError(f"{key} must be a list of at least {least} texts")
    return value


def _number(held: dict, key: str, low: int, high: int, default: int) -> int:
    value = held.get(key, default)
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ConfigError(f"{key} must be a whole number from {low} to {high}")
    return value


def parse_catalog(source: str) -> Catalog:
    """Read the JSON text of a catalog; an entry's org, docs and branches go before the global ones."""
    try:
        held = json.loads(source)
    except ValueError as e:
        raise ConfigError(f"not JSON: {e}") from e
    if not isinstance(held, dict) or not isinstance(held.get("repos"), list) or not held["repos"]:
        raise ConfigError("repos must be a list that is not empty")
    org, docs = _text(held, "org"), _texts(held, "defaultDocs", None)
    branches = _texts(held, "defaultBranches", ["main", "dev"])
    rows, seen = [], set()
    for i, entry in enumerate(held["repos"]):
        alias, repo = _text(entry, "alias"), _text(entry, "repo")
        if not ALIAS.fullmatch(alias):
            raise ConfigError(f"alias {alias!r} must be lower-case words joined by hyphens")
        if alias in seen:
            raise ConfigError(f"alias {alias!r} occurs twice")
        seen.add(alias)
        owner = _text(entry, "org") if "org" in entry else org
        own = _texts(entry, "docs", docs, 0), _texts(entry, "branches", branches, 0)
        rows.append((i, alias, owner, repo, f"{owner}/{repo}", _text(entry, "description", ""), *own))
    out = Catalog(rows, _number(held, "activeBranchDays", 0, 365, 0), _number(held, "maxActiveBranches", 1, 50, 5))
    out.warnings = [r[4] for r in rows if PLACEHOLDER.search(r[4])]
    return out


def load_catalog(path: str) -> Catalog:
    with open(path, encoding="utf-8") as f:
        return parse_catalog(f.read())
