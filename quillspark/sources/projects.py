"""Repositories' metadata as a Spark data source: format("quillspark_projects").

Option `kind` says what is read: meta, commits, branches, pulls, issues or tree. With `url` it comes from
a REST service, one partition for some of the repositories (option `repos`, full names), whose pages are
read one after another; `token` is what it asks for. With `path` it comes from
Parquet files of any layout, which is how fixtures and archives are read: one partition for each row
group, `repo` names the column of repositories and `field.<name>` that of a field.

Filters on repo are pushed down: repositories that are not asked for make no request, row groups that
can't hold them no partition. What a repository's source refuses is told as a row: its name, error and,
for a rate limit, reset_at; after a rate limit a partition asks no more, and says so for each repository
that is left.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..errors import ConfigError, EngineError, RateLimited, from_status

NAME = "quillspark_projects"
FIELDS = {
    "meta": "description string, default_branch string, last_activity string, html_url string, private boolean, archived boolean",
    "commits": "sha string, author string, login string, date string, message string",
    "branches": "branch string, sha string, last_commit_at string, is_default boolean",
    "pulls": "state string",
    "issues": "state string, is_pull boolean",
    "tree": "path string, sha string, size_bytes long",
}
PAGE, TASKS, TIMEOUT = 100, 16, 60.0


class Source(Protocol):
    """What a source of repositories offers, all of it read-only."""

    def partitions(self, kind: str, wanted: set[str] | None) -> list[InputPartition]:
        """Parts that can be read apart; `wanted`: the repositories asked for, None for all."""

    def rows(self, kind: str, part: InputPartition, wanted: set[str] | None) -> Iterator[tuple]:
        """repo, the fields of the kind, error, reset_at."""


def names(kind: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in FIELDS[kind].split(", ")]


@dataclass
class Repositories(InputPartition):
    repos: tuple[str, ...]


@dataclass
class RestSource:
    """A service that speaks the REST dialect of code hosts."""

    url: str
    repos: tuple[str, ...]
    token: str = ""
    tasks: int = TASKS

    def partitions(self, kind: str, wanted: set[str] | None) -> list[InputPartition]:
        asked = [r for r in self.repos if wanted is None or r in wanted]
        n = min(self.tasks, len(asked))
        return [Repositories(tuple(asked[k::n])) for k in range(n)]

    def rows(self, kind: str, part: Repositories, wanted: set[str] | None) -> Iterator[tuple]:
        none, stopped = (None,) * len(names(kind)), None
        for repo in part.repos:
            try:
                if stopped:
                    raise stopped
                for row in getattr(self, f"_{kind}")(repo):
                    yield (repo, *row, None, None)
            except RateLimited as e:
                stopped = e
                yield (repo, *none, str(e), e.reset_at)
            except EngineError as e:
                yield (repo, *none, str(e), None)

    def _get(self, path: str, **query):
        where = f"{self.url.rstrip('/')}/repos/{path}" + ("?" + urllib.parse.urlencode(query) if query else "")
        headers = {"accept": "application/json"} | ({"authorization": f"Bearer {self.token}"} if self.token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(where, headers=headers), timeout=TIMEOUT) as got:
                return json.loads(got.read())
        except urllib.error.HTTPError as e:
            raise from_status(e.code, e.read(300).decode(errors="replace"), {k.lower(): v for k, v in e.headers.items()}, path) from e
        except (urllib.error.URLError, TimeoutError, ValueError) as e:
            raise EngineError(f"{path}: {getattr(e, 'reason', e)}") from e

    def _pages(self, path: str, **query) -> Iterator[dict]:
        number = 1
        while True:
            got = self._get(path, per_page=PAGE, page=number, **query)
            yield from got
            if len(got) < PAGE:
                return
            number += 1

    def _meta(self, repo: str) -> Iterator[tuple]:
        m = self._get(repo)
        yield m.get("description"), m.get("default_branch"), m.get("pushed_at"), m.get("html_url"), bool(m.get("private")), bool(m.get("archived"))

    def _commits(self, repo: str) -> Iterator[tuple]:
        for c in self._pages(f"{repo}/commits"):
            told = c.get("commit") or {}
            author, committer = told.get("author") or {}, told.get("committer") or {}
            yield c.get("sha"), author.get("name"), (c.get("author") or {}).get("login"), author.get("date") or committer.get("date"), told.get("message")

    def _branches(self, repo: str) -> Iterator[tuple]:
        default = self._get(repo).get("default_branch")
        for b in self._pages(f"{repo}/branches"):
            sha = (b.get("commit") or {}).get("sha")
            try:  # a head whose date can't be told is a branch without one
                told = self._get(f"{repo}/commits/{sha}").get("commit") or {}
                date = (told.get("committer") or told.get("author") or {}).get("date")
            except RateLimited:
                raise
            except EngineError:
                date = None
            yield b.get("name"), sha, date, b.get("name") == default

    def _pulls(self, repo: str) -> Iterator[tuple]:
        for p in self._pages(f"{repo}/pulls", state="open"):
            yield (p.get("state"),)

    def _issues(self, repo: str) -> Iterator[tuple]:
        for i in self._pages(f"{repo}/issues", state="open"):
            yield i.get("state"), i.get("pull_request") is not None

    def _tree(self, repo: str) -> Iterator[tuple]:
        ref = self._get(repo).get("default_branch")
        for t in self._get(f"{repo}/git/trees/{urllib.parse.quote(ref or '', safe='')}", recursive=1).get("tree", []):
            if t.get("type") == "blob" and t.get("path"):
                yield t["path"], t.get("sha"), t.get("size") or 0


@dataclass
class RowGroup(InputPartition):
    path: str
    number: int


@dataclass
class TableSource:
    """Parquet files: `repo` is the column of repositories, `fields` those of the fields; without a column a
    field is null."""

    path: str
    repo: str
    fields: dict[str, str]

    def _where(self, wanted: set[str] | None, kind) -> ds.Expression | None:
        """The pushed filter, in the type of the column."""
        if wanted is None:
            return None
        import pyarrow as pa

        values = []
        for w in wanted:
            try:
                values.append(pa.scalar(w).cast(kind).as_py())
            except pa.ArrowInvalid:
                pass  # no such value in the column
        return ds.field(self.repo).isin(pa.array(values, kind))

    def _dataset(self, path: str | None = None) -> ds.Dataset:
        uri = path or self.path
        store, at = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
        return ds.dataset(at, filesystem=store, format="parquet")

    def partitions(self, kind: str, wanted: set[str] | None) -> list[InputPartition]:
        held = self._dataset()
        where = self._where(wanted, held.schema.field(self.repo).type)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [RowGroup(scheme + f.path, g.id) for whole in held.get_fragments() for f in whole.split_by_row_group(where) for g in f.row_groups]

    def rows(self, kind: str, part: RowGroup, wanted: set[str] | None) -> Iterator[tuple]:
        held = self._dataset(part.path)
        where = self._where(wanted, held.schema.field(self.repo).type)
        columns = [self.fields.get(n) for n in names(kind)]
        fragment = next(iter(held.get_fragments())).subset(row_group_ids=[part.number])
        texts = [f.endswith(" string") for f in FIELDS[kind].split(", ")]
        for batch in fragment.to_batches(columns=sorted({self.repo, *filter(None, columns)}), filter=where, schema=held.schema):
            cells = [batch.column(c).to_pylist() if c else [None] * len(batch) for c in (self.repo, *columns)]
            plain = [[None if x is None else str(x) for x in c] if text else c for text, c in zip(texts, cells[1:])]
            yield from zip(map(str, cells[0]), *plain, [None] * len(batch), [None] * len(batch))


def source_of(options: Mapping[str, str]) -> Source:
    if options.get("url"):
        repos = tuple(r.strip() for r in options.get("repos", "").split(",") if r.strip())
        return RestSource(options["url"], repos, options.get("token", ""), int(options.get("tasks", TASKS)))
    if options.get("path"):
        return TableSource(options["path"], options.get("repo", "repo"), {k.removeprefix("field."): v for k, v in options.items() if k.startswith("field.")})
    raise ConfigError("a source of projects needs the option url or path")


class ProjectReader(DataSourceReader):
    def __init__(self, kind: str, source: Source):
        self.kind, self.source, self.wanted = kind, source, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Those on repo are taken over whole; the others stay with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and tuple(f.attribute) == ("repo",):
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return self.source.partitions(self.kind, self.wanted)

    def read(self, part: InputPartition) -> Iterator[tuple]:
        return iter(self.source.rows(self.kind, part, self.wanted)) if part is not None else iter(())


class ProjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _kind(self) -> str:
        kind = self.options.get("kind", "")
        if kind not in FIELDS:
            raise ConfigError(f"kind must be one of {', '.join(FIELDS)}")
        return kind

    def schema(self) -> str:
        return f"repo string, {FIELDS[self._kind()]}, error string, reset_at double"

    def reader(self, schema: StructType) -> ProjectReader:
        return ProjectReader(self._kind(), source_of(self.options))


def read(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """Rows of a kind, errors among them. Options as above; field_<name> stands for field.<name>, and
    token_env names a variable of the driver that holds the token."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProjectSource)
    token = {"token": os.environ.get(options.pop("token_env"), "")} if "token_env" in options else {}
    told = token | {k.replace("field_", "field.", 1) if k.startswith("field_") else k: v for k, v in options.items()}
    return spark.read.format(NAME).options(kind=kind, **told).load()


def sources(spark: SparkSession, **options: str) -> dict[str, DataFrame]:
    """The tables that api.Engine serves, without the rows of errors."""
    return {k: read(spark, k, **options).where("error IS NULL").drop("error", "reset_at") for k in ("meta", "commits", "pulls", "issues")}
