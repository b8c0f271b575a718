"""The index on shared storage: chunks and what search reads (postings, terms, lengths, texts) in segments,
snapshots that name them, and a cache of vectors.

A segment is written once and never changed: a refresh writes the chunks of the branches it replaced, their
postings, term counts and lengths, and the texts of the repositories they belong to, as a new one. A
snapshot says what is to be read: `live` the segment of each branch, `homes` that of each repository's
texts, `runs` which run each branch stands for. It counts once its mark stands under commits, one small
file that names the segments and comes by a rename, so readers see a refresh as a whole or not at all, and
one that holds a Snapshot sees the same state however often others commit. Segments of like size are
merged, without tokenizing, by copying what lives.

What no snapshot names that is the last one, or was the last one within `retain` seconds, is deleted when
the next write starts; so is what a crash left half written. The index is derived data; a store of an older
version is brought up step by step, its cache kept, one of an unknown version makes it start anew, an
unreadable table is set aside when the store is opened, and what can be made from the chunks is made anew.
The cache is read by writers alone, who take turns, and stands outside of the snapshots.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import search
from . import buckets
from .lease import lease

VERSION = 5
CHUNKS = (
    "chunk_id long, alias string, path string, chunk_index int, heading string, content string, content_hash string, "
    "embedding array<float>, dimensions int, indexed_at timestamp, repo string, branch string"
)
RUNS = "repo string, branch string, model string, files long, chunks long, indexed_at timestamp"
CACHE = "content_hash string, embedding array<float>, dimensions int, created_at timestamp, model string"
POSTINGS = "term string, chunk_id long, wtf double, tf long, dl long, scope long"
TERMS = "term string, scope long, df long"
LENGTHS = "repo string, branch string, scope long, n long, words long, files long, texts long"
LIVE = "repo string, branch string, scope long, segment int"
HOMES = "repo string, segment int"
TEXTS = "path string, content_hash string, members array<struct<chunk_id: long, branch: string, alias: string, heading: string>>, embedding array<float>, repo string"
#: Tables in segments, and by what a segment's folder is parted; tables of a snapshot.
SEGMENTED = {"chunks": CHUNKS, "postings": POSTINGS, "terms": TERMS, "lengths": LENGTHS, "texts": TEXTS}
PARTED = {"chunks": ("repo", "branch"), "texts": ("repo",)}
STATE = {"live": LIVE, "homes": HOMES, "runs": RUNS}
#: By what rows of a segment are known to live.
LIVING = {"chunks": ("repo", "branch"), "postings": ("scope",), "terms": ("scope",), "lengths": ("scope",)}
#: Segments of one tier (sizes by powers of FANOUT) that are merged into one.
FANOUT = 4
#: Seconds for which readers may go on with a snapshot that is no longer the last one.
RETAIN = 3600.0
#: Buckets of a new cache, and the vectors of a bucket above which there are four times as many.
BUCKETS = 8
BUCKET_ROWS = 1 << 18
SCOPES = "repo string, branch string"


@dataclass
class Snapshot:
    """One state of a store; `live` and `homes` are the segments it names, `last` the largest number that a
    segment ever had."""

    store: "Store"
    number: int = 0
    live_segments: list[int] = field(default_factory=list)
    home_segments: list[int] = field(default_factory=list)
    last: int = 0

    def _state(self, name: str) -> DataFrame:
        return self.store._read(f"snapshots/{self.number}/{name}", STATE[name])

    def live(self) -> DataFrame:
        return self._state("live")

    def homes(self) -> DataFrame:
        return self._state("homes")

    def runs(self) -> DataFrame:
        return self._state("runs")

    def stats(self, repo: str | None = None) -> DataFrame:
        """The runs of all or one repository, in order."""
        return search.in_scope(self.runs(), repo).orderBy("repo", "branch")

    def rows(self, name: str) -> DataFrame:
        """The living rows of chunks, postings, terms or lengths, with their segment."""
        return self.store._living(name, self.live_segments, self.live())

    def chunks(self) -> DataFrame:
        return self.rows("chunks").drop("segment")

    def postings(self) -> DataFrame:
        return self.rows("postings")

    def texts(self) -> DataFrame:
        """One row for each text of a repository, with all living chunks that hold it."""
        return self.store._segments_read("texts", self.home_segments).join(self.homes(), ["repo", "segment"], "left_semi").drop("segment").select(*StructType.fromDDL(TEXTS).names)

    def index(self, terms: list[str] | None = None) -> search.Index:
        """The keyword index; with terms, only their rows are read, which lie together in each segment."""
        own = lambda df: df if terms is None else df.where(F.col("term").isin(terms))
        counts = own(self.rows("terms")).groupBy("term").agg(F.sum("df").alias("df"))
        whole = self.rows("lengths").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl"))
        return search.Index(own(self.rows("postings")).drop("scope", "segment"), counts, whole)


class Store:
    def __init__(self, spark: SparkSession, root: str, retain: float = RETAIN):
        self.spark, self.root, self.retain = spark, root.rstrip("/"), retain
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._bring_up()
        self._old_cache_back()
        self.set_aside = [aside for name in (*SEGMENTED, *STATE, "cache") if (aside := self.quarantine(name))]
        lost = {x.removeprefix(f"{self.root}/").split(".corrupt-")[0].split("/")[-1] for x in self.set_aside}
        if lost & {"chunks", "live"}:
            self._mark(self.snapshot(), self._empty(LIVE), self._empty(HOMES), self._empty(RUNS))
        elif lost & {"postings", "terms", "lengths", "texts", "homes"}:
            self.rebuild_postings()

    def _bring_up(self) -> None:
        """From the version that the store has to this one, step by step; each step is marked when it is
        done, so one that broke off is done once more."""
        marker = lambda v: f"{self.root}/version={v}"
        if self._exists(self.root) and not self._exists(marker(VERSION)):
            own = next((v for v in range(VERSION - 1, 0, -1) if self._exists(marker(v))), None)
            if own not in MIGRATIONS:
                self._move(self.root, f"{self.root}.old-{int(time.time() * 1000)}")
            else:
                for v in range(own, VERSION):
                    MIGRATIONS[v](self)
                    self._fs.mkdirs(self._path(marker(v + 1)))
                    self._fs.delete(self._path(marker(v)), True)
        self._fs.mkdirs(self._path(marker(VERSION)))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _move(self, a: str, b: str) -> None:
        self._fs.rename(self._path(a), self._path(b))

    def _names(self, name: str) -> list[str]:
        at = self._path(f"{self.root}/{name}")
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(at) if self._exists(at) else self._empty(schema)

    def _segments_read(self, name: str, segments: list[int]) -> DataFrame:
        """All rows of a table's segments. Only their folders are listed, so others may come and go."""
        schema, at = f"{SEGMENTED[name]}, segment int", f"{self.root}/{name}"
        held = [p for p in (f"{at}/segment={s}" for s in segments) if self._exists(p)]
        return self.spark.read.schema(schema).option("basePath", at).parquet(*held) if held else self._empty(schema)

    def _living(self, name: str, segments: list[int], live: DataFrame) -> DataFrame:
        keys = [*LIVING[name], "segment"]
        return self._segments_read(name, segments).join(live.select(*keys), keys, "left_semi")

    def _whole(self, name: str) -> bool:
        return self._exists(f"{self.root}/{name}/_SUCCESS")

    def _drop_table(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _put(self, name: str) -> None:
        """What was written beside a table takes its place: the old one is set aside first."""
        at = f"{self.root}/{name}"
        if self._exists(at):
            self._drop_table(f"{name}.old")
            self._move(at, f"{at}.old")
        self._move(f"{at}.new", at)
        self._drop_table(f"{name}.old")

    def writing(self, **options: float):
        """Inside, no other driver writes this store; they wait."""
        return lease(self.spark, f"{self.root}.lease", **options)

    def _commits(self) -> list[int]:
        return sorted(int(x) for x in self._names("commits") if x.isdigit())

    def _marked(self, number: int) -> Snapshot:
        held = self._fs.open(self._path(f"{self.root}/commits/{number}"))
        try:
            told = json.loads(held.readUTF())
        finally:
            held.close()
        return Snapshot(self, number, told["live"], told["homes"], told["last"])

    def snapshot(self) -> Snapshot:
        """The state of the store as of now."""
        commits = self._commits()
        return self._marked(commits[-1]) if commits else Snapshot(self)

    def chunks(self) -> DataFrame:
        return self.snapshot().chunks()

    def runs(self) -> DataFrame:
        return self.snapshot().runs()

    def live(self) -> DataFrame:
        return self.snapshot().live()

    def postings(self) -> DataFrame:
        return self.snapshot().postings()

    def texts(self) -> DataFrame:
        return self.snapshot().texts()

    def index(self, terms: list[str] | None = None) -> search.Index:
        return self.snapshot().index(terms)

    def stats(self, repo: str | None = None) -> DataFrame:
        return self.snapshot().stats(repo)

    def cache(self) -> DataFrame:
        """The vectors, in buckets() buckets of their text's hash."""
        n = self._held_buckets()
        return buckets.read(self.spark, self._cache_at("cache", n), CACHE, "content_hash", n) if n else self.spark.createDataFrame([], CACHE)

    def buckets(self) -> int:
        return self._held_buckets() or BUCKETS

    def _held_buckets(self) -> int | None:
        at = self._path(f"{self.root}/cache")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return next((int(x[3:]) for x in names if x.startswith("of-")), None)

    def _cache_at(self, name: str, n: int) -> str:
        return f"{self.root}/{name}/of-{n}"

    def _rebucket(self, rows: DataFrame, n: int) -> None:
        """Put rows, in n buckets, in place of the cache."""
        old = self._held_buckets()
        self._drop_table("cache.new")
        buckets.forget(self.spark, self._cache_at("cache.new", n), n)
        buckets.append(rows, self._cache_at("cache.new", n), CACHE, "content_hash", n)
        buckets.forget(self.spark, self._cache_at("cache.new", n), n)
        if old:
            buckets.forget(self.spark, self._cache_at("cache", old), old)
        self._put("cache")

    def _old_cache_back(self) -> None:
        """After a crash between the two renames of _rebucket."""
        if self._exists(f"{self.root}/cache.old") and not self._exists(f"{self.root}/cache"):
            self._move(f"{self.root}/cache.old", f"{self.root}/cache")

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """df written as a table of the run, to be read more than once."""
        return self.counted(name, df)[0]

    def counted(self, name: str, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int | None]]:
        """The same, and counts that the job which writes it takes on its way. A stage that is done once more
        for a lost executor may count twice, so use them for whether there is any; None is not known."""
        seen = Observation()
        if counts:
            df = df.observe(seen, *(v.alias(k) for k, v in counts.items()))
        df.write.mode("overwrite").parquet(f"{self.root}/run.{name}")
        told = seen.get if counts else {}
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/run.{name}"), {k: told.get(k) for k in counts}

    def quarantine(self, name: str) -> str | None:
        """Set a table aside if it can't be read; the path it went to, or None if it is sound."""
        now = self.snapshot()
        at = f"snapshots/{now.number}/{name}" if name in STATE else name
        try:
            if name == "cache":
                self._read(name, CACHE).limit(1).collect()
            elif name in STATE:
                now._state(name).limit(1).collect()
            else:
                self._segments_read(name, now.home_segments if name == "texts" else now.live_segments).limit(1).collect()
            return None
        except Exception as e:
            if not any(x in str(e) for x in ("CANNOT_READ", "is not a Parquet file", "FAILED_READ_FILE", "FAILED_TO_READ")):
                raise
        aside = f"{self.root}/{at}.corrupt-{int(time.time() * 1000)}"
        self._move(f"{self.root}/{at}", aside)
        return aside

    def append_cache(self, vectors: DataFrame, model: str) -> None:
        """vectors (content_hash, embedding): those that the cache lacks are added, raw."""
        n = self.buckets()
        known = self.cache().where(F.col("model") == model).select("content_hash")
        fresh = vectors.dropDuplicates(["content_hash"]).repartition(n, "content_hash").join(known, "content_hash", "left_anti")
        fresh = fresh.select("content_hash", "embedding", F.size("embedding").alias("dimensions"), F.current_timestamp().alias("created_at"), F.lit(model).alias("model"))
        buckets.append(self.stage("fresh", fresh), self._cache_at("cache", n), CACHE, "content_hash", n)
        self._grow()

    def _grow(self) -> None:
        """Four times the buckets, as often as it takes: each vector so moves a logarithm of times in all."""
        n, held = self.buckets(), self.cache().count()
        if held > n * BUCKET_ROWS:
            self._rebucket(self.cache(), _enough(n, held))

    def vectors_of(self, hashes: DataFrame, model: str) -> DataFrame:
        """Of the cache, the vectors of the given texts (content_hash, repeated at will), written: the cache
        itself is read bucket by bucket and not shuffled, and how often a text occurs does not matter."""
        wanted = hashes.select("content_hash").distinct().repartition(self.buckets(), "content_hash")
        return self.stage("known", wanted.join(self.cache().where(F.col("model") == model), "content_hash"))

    def replace_branches(self, chunks: DataFrame, scopes: list[tuple[str, str]], model: str | None = None) -> list:
        """Put chunks in place of all chunks of the given (repo, branch) pairs, also where none are left, with
        their index, texts and, where a model is named, runs: readers see all of it or nothing. Only these
        chunks are tokenized; those of other branches are left out. Returns repo, branch, files, chunks and texts of each pair."""
        base, segment = self._begin()
        asked = self.spark.createDataFrame(scopes, SCOPES)
        self._add("chunks", chunks.join(F.broadcast(asked), ["repo", "branch"], "left_semi"), segment)
        self._index(segment)
        lengths = self._segments_read("lengths", [segment])
        told = asked.join(lengths.select("repo", "branch", "files", F.col("n").alias("chunks"), "texts"), ["repo", "branch"], "left").fillna(0, ["files", "chunks", "texts"])
        runs = base.runs()
        if model is not None:
            fresh = told.select("repo", "branch", F.lit(model).alias("model"), "files", "chunks", F.current_timestamp().alias("indexed_at"))
            runs = runs.join(asked, ["repo", "branch"], "left_anti").unionByName(fresh)
        live = base.live().join(asked, ["repo", "branch"], "left_anti").unionByName(lengths.select("repo", "branch", "scope", "segment"))
        self._commit(base, segment, live, asked.select("repo").distinct(), runs)
        self._merge()
        return told.collect()

    def prune(self, keep: dict[str, list[str]]) -> dict[str, int]:
        """Drop branches that are not kept, with their runs; how many branches went, by repository. Only the
        given repositories are looked at, and one that would keep nothing is left alone."""
        pairs = [(repo, b) for repo, kept in keep.items() for b in kept]
        if not pairs:
            return {}
        kept = self.spark.createDataFrame(pairs, SCOPES)
        repos = kept.select("repo").distinct()
        now = self.snapshot()
        dead = lambda df: df.join(repos, "repo", "left_semi").join(kept, ["repo", "branch"], "left_anti")
        gone = [(r["repo"], r["branch"]) for r in dead(now.live()).select("repo", "branch").collect()]
        if gone or dead(now.runs()).take(1):
            base, segment = self._begin()
            going = self.spark.createDataFrame(gone, SCOPES)
            runs = base.runs().join(repos, "repo", "left_anti").unionByName(base.runs().join(kept, ["repo", "branch"], "left_semi"))
            self._commit(base, segment, base.live().join(going, ["repo", "branch"], "left_anti"), going.select("repo").distinct(), runs)
            self._merge()
        out: dict[str, int] = {}
        for repo, _ in gone:
            out[repo] = out.get(repo, 0) + 1
        return out

    def rebuild_postings(self) -> None:
        """All chunks, and the index made from them anew, in one segment."""
        base, segment = self._begin()
        self._add("chunks", base.chunks(), segment)
        self._index(segment)
        live = self._segments_read("lengths", [segment]).select("repo", "branch", "scope", "segment")
        self._commit(base, segment, live, base.live().select("repo").unionByName(base.homes().select("repo")).distinct(), base.runs())

    def _begin(self) -> tuple[Snapshot, int]:
        """The state to start from and the number of a new segment; before that, what is not needed goes."""
        self._sweep()
        base = self.snapshot()
        return base, max([base.last, *self._segments()]) + 1

    def _index(self, segment: int) -> None:
        """Postings, terms and lengths of a segment from its chunks."""
        chunks = self._segments_read("chunks", [segment]).withColumn("scope", F.xxhash64("repo", "branch"))
        self._add("postings", search.postings(chunks, carry=("scope",)).sort("term"), segment)
        posted = self._segments_read("postings", [segment])
        self._add("terms", posted.groupBy("term", "scope").agg(F.count("*").alias("df")).sort("term"), segment)
        counted = chunks.groupBy("repo", "branch", "scope").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"), F.countDistinct("content_hash").alias("texts"))
        words = posted.groupBy("scope").agg(F.sum("tf").alias("words"))
        self._add("lengths", counted.join(words, "scope", "left").fillna(0, ["words"]), segment)

    def _add(self, name: str, rows: DataFrame, segment: int) -> None:
        out, parts = _as(SEGMENTED[name], rows), PARTED.get(name, ())
        if parts:  # few files for each part, several for a large one
            out = out.hint("rebalance", *(F.col(c) for c in parts))
        out.write.mode("overwrite").partitionBy(*parts).parquet(f"{self.root}/{name}/segment={segment}")

    def _commit(self, base: Snapshot, segment: int, live: DataFrame, repos: DataFrame, runs: DataFrame) -> None:
        """The state after base: what lives, and in `segment` the texts of the repositories that changed."""
        live = self._keep(base.number + 1, "live", live)
        chunks = self._living("chunks", _numbers(live), live)
        self._add("texts", search.texts_of(chunks.join(repos, "repo", "left_semi")), segment)
        own = self._segments_read("texts", [segment]).select("repo", "segment").distinct()
        self._mark(base, live, base.homes().join(repos, "repo", "left_anti").unionByName(own), runs, kept=True)

    def _keep(self, number: int, name: str, df: DataFrame) -> DataFrame:
        at = f"{self.root}/snapshots/{number}/{name}"
        _as(STATE[name], df).write.mode("overwrite").parquet(at)
        return self.spark.read.schema(STATE[name]).parquet(at)

    def _mark(self, base: Snapshot, live: DataFrame, homes: DataFrame, runs: DataFrame, kept: bool = False) -> None:
        """Write the state after base (live, unless that was kept) and then its mark."""
        number = base.number + 1
        if not kept:
            live = self._keep(number, "live", live)
        homes = self._keep(number, "homes", homes)
        self._keep(number, "runs", runs)
        told = {"live": _numbers(live), "homes": _numbers(homes), "last": max([base.last, *self._segments()], default=0)}
        at = f"{self.root}/commits/{number}"
        out = self._fs.create(self._path(f"{at}.new"), True)
        out.writeUTF(json.dumps(told))
        out.close()
        self._move(f"{at}.new", at)

    def _segments(self) -> set[int]:
        return {int(x.split("=")[1]) for name in SEGMENTED for x in self._names(name) if x.startswith("segment=")}

    def _sweep(self) -> None:
        """Delete what no snapshot names that is the last one, or was it within `retain` seconds."""
        commits = self._commits()
        since = {n: self._fs.getFileStatus(self._path(f"{self.root}/commits/{n}")).getModificationTime() / 1000 for n in commits}
        kept = [n for n, after in zip(commits, [*commits[1:], None]) if after is None or since[after] > time.time() - self.retain]
        named = {s for n in kept for held in (self._marked(n),) for s in (*held.live_segments, *held.home_segments)}
        for n in set(commits) - set(kept):
            self._drop_table(f"commits/{n}")
        for x in self._names("snapshots"):
            if not (x.isdigit() and int(x) in kept):
                self._drop_table(f"snapshots/{x}")
        for segment in self._segments() - named:
            for name in SEGMENTED:
                self._drop_table(f"{name}/segment={segment}")

    def _merge(self) -> None:
        """Merge the segments of a tier once there are FANOUT of them; every posting so moves as often as
        there are tiers."""
        while True:
            now = self.snapshot()
            sizes = dict.fromkeys(now.home_segments, 0)
            sizes |= {r["segment"]: r["words"] for r in now.rows("lengths").groupBy("segment").agg(F.sum("words").alias("words")).collect()}  # one row a segment
            tiers: dict[int, list[int]] = {}
            for segment, words in sizes.items():
                tiers.setdefault(int(math.log(max(words, 1), FANOUT)), []).append(segment)
            full = next((held for _, held in sorted(tiers.items()) if len(held) >= FANOUT), None)
            if full is None:
                return
            base, segment = self._begin()
            inside = F.col("segment").isin(full)
            for name in LIVING:
                held = self._living(name, full, base.live())
                self._add(name, held.sort("term") if name in ("postings", "terms") else held, segment)
            self._add("texts", self._segments_read("texts", full).join(base.homes(), ["repo", "segment"], "left_semi"), segment)
            moved = lambda df: df.withColumn("segment", F.when(inside, F.lit(segment)).otherwise(F.col("segment")))  # noqa: B023, E731
            self._mark(base, moved(base.live()), moved(base.homes()), base.runs())


def _as(schema: str, df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields))


def _numbers(df: DataFrame) -> list[int]:
    """The segments that rows of a state name; merging keeps them few."""
    return sorted(r["segment"] for r in df.select("segment").distinct().collect())


def _from_2(store: Store) -> None:
    """Version 3 had another keyword index; it is made from the chunks once they are in a segment."""
    for name in ("postings", "stats"):
        store._drop_table(name)


def _enough(n: int, rows: int) -> int:
    while rows > n * BUCKET_ROWS:
        n *= 4
    return n


def _from_3(store: Store) -> None:
    """Version 4 has its cache in buckets; it was a folder a model. What was done already is not done again."""
    store._old_cache_back()
    if store._exists(f"{store.root}/cache") and not store._held_buckets():
        held = store.spark.read.schema(CACHE).parquet(f"{store.root}/cache")
        store._rebucket(held, _enough(BUCKETS, held.count()))


def _from_4(store: Store) -> None:
    """Version 5 has its chunks in segments and its runs in a snapshot. The folder of chunks becomes the first
    segment as it is. Branches whose chunks were being replaced lose their runs, so they count as stale."""
    root, at = store.root, f"{store.root}/chunks"
    if store._exists(f"{root}/runs.old") and not store._exists(f"{root}/runs"):
        store._move(f"{root}/runs.old", f"{root}/runs")
    if not store._exists(f"{at}.v4") and store._exists(at) and not store._exists(f"{at}/segment=1"):
        store._move(at, f"{at}.v4")
    if store._exists(f"{at}.v4"):
        store._fs.mkdirs(store._path(at))
        store._move(f"{at}.v4", f"{at}/segment=1")
    for name in ("postings", "terms", "lengths", "texts", "live", "index.pending", "snapshots", "commits"):
        store._drop_table(name)
    if store._exists(f"{at}/segment=1"):
        store._index(1)
        live = store._segments_read("lengths", [1]).select("repo", "branch", "scope", "segment")
        runs = store._read("runs", RUNS)
        if store._whole("chunks.scopes"):
            runs = runs.join(store._read("chunks.scopes", SCOPES), ["repo", "branch"], "left_anti")
        store._commit(Snapshot(store), 1, live, live.select("repo").distinct(), runs)
    for name in ("runs", "runs.new", "chunks.new", "chunks.scopes"):
        store._drop_table(name)


#: From a version to the next one.
MIGRATIONS = {2: _from_2, 3: _from_3, 4: _from_4}
