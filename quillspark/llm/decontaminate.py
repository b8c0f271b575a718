"""Benchmark decontamination with one Aho-Corasick automaton over words.

Normalising is byte-wise: A-Z become a-z, and every ASCII byte that is no letter or digit separates
words; bytes of other characters belong to words. Items give windows of ten words (shorter items one
window). The words of the benchmark are numbered, and the windows' trie with its failure links is held
in flat sorted arrays, 17 bytes a node. The driver writes them to the shared folder once, and workers,
also those of executors that come later, map the file there into memory: what a worker holds does not
grow with the benchmark. A batch of documents is scanned once: its words run
through the automaton side by side in strips, each opened by the nine words before it.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_files import mapped, store_of

WINDOW = 10
#: Item bytes whose automaton the driver builds at a time; a larger benchmark has several in its file,
#: and the one scan of a document goes through each.
PART_BYTES = 24 << 20
#: Words in a strip, and words that are hashed at a time.
STRIP, WORDS = 64, 1 << 18

_TO = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SPACE = np.frombuffer(_TO, np.uint8) == 32
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_M = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of some texts one after another: `start` and `size` of each in the normalised bytes
    (`line`), its text (`doc`), and `cut`, the bounds of the texts among the words."""

    def __init__(self, texts: list[bytes]):
        self.line = np.frombuffer(b" " + b" ".join(texts).translate(_TO) + b" ", np.uint8)
        gap = _SPACE[self.line]
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.size = np.flatnonzero(~gap[:-1] & gap[1:]) + 1 - self.start
        self.text_at = common.offsets([len(t) + 1 for t in texts]) + 1
        self.cut = np.searchsorted(self.start, self.text_at)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word, some words at a time."""
        parts = [self._hashes(seed, a, min(a + WORDS, len(self.start))) for a in range(0, len(self.start), WORDS)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _hashes(self, seed: int, first: int, last: int) -> np.ndarray:
        start = self.start[first:last] - self.start[first]
        line = self.line[self.start[first] : self.start[last - 1] + self.size[last - 1]]
        begin = np.zeros(len(line), np.int64)
        begin[start] = start
        place = (np.arange(len(line)) - np.maximum.accumulate(begin)).astype(np.uint64)
        mixed = (line.astype(np.uint64) + np.uint64(1) + place * np.uint64(0x632BE59BD9B4E019)) * _M
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed[_SPACE[line]] = 0
        total = np.add.reduceat(mixed, start) ^ (self.size[first:last].astype(np.uint64) + np.uint64(seed)) * _M
        total = (total ^ total >> np.uint64(30)) * np.uint64(0x94D049BB133111EB)
        return total ^ total >> np.uint64(31)

    def joined(self, first: int, last: int) -> bytes:
        """Words first to last, separated by single spaces."""
        a, b = self.start[first], self.start[last] + self.size[last]
        return b" ".join(self.line[a:b].tobytes().split())


ARRAYS = ("vocabulary", "root", "key", "fail", "depth", "out", "end", "item_at", "item", "window_at", "window")


def build(texts: list[bytes], size: int = WINDOW) -> tuple[int, dict[str, np.ndarray]]:
    """(seed of the word hash, arrays) of the automaton of the items' windows.

    Words have numbers from 0, the places of their hashes in `vocabulary`. Nodes have numbers from 1, by
    level; 0 is the root. `key` holds (node before, word) of each node from 1, ascending, so a step is a
    binary search; `root` is the root's step for each word. `out` is the nearest node on a node's way of
    failure links, itself included, where a window ends (0: none). `end` lists these nodes; for each of
    them `item` has the items, `window` the bytes, against which a finding is checked.
    """
    words = Words(texts)
    for seed in range(64):
        h = words.hashes(seed)
        order = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        if all(words.joined(a, a) == words.joined(b, b) for a, b in zip(order[same], order[same + 1])):
            break
    else:
        raise ValueError("no hash parts the words of the benchmark")
    vocabulary, word = np.unique(h, return_inverse=True)
    word = word.astype(np.uint64)
    cut, n = words.cut, np.diff(words.cut)
    # Windows: where each starts, how many words it has, its item.
    many = np.where(n == 0, 0, np.maximum(n - size, 0) + 1)
    own = np.repeat(np.arange(len(texts)), many)
    begin = cut[own] + np.arange(len(own)) - np.repeat(common.offsets(many)[:-1], many)
    wide = np.minimum(n[own], size)
    node = np.zeros(len(begin), np.uint64)
    keys, level, total = [], [0], 0
    for d in range(size):
        on = np.flatnonzero(wide > d)
        if not len(on):
            break
        step = node[on] << np.uint64(32) | word[begin[on] + d]
        held, place = np.unique(step, return_inverse=True)
        node[on] = (total + 1 + place).astype(np.uint64)
        keys.append(held)
        total += len(held)
        level.append(total)
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    root = np.zeros(len(vocabulary) + 1, np.uint32)
    if keys:
        root[keys[0].astype(np.int64)] = np.arange(1, len(keys[0]) + 1)
    depth = np.repeat(np.arange(len(level) - 1), np.diff(level)).astype(np.uint8) + 1 if total else np.zeros(0, np.uint8)
    depth = np.concatenate([[np.uint8(0)], depth])
    fail, out = np.zeros(total + 1, np.uint32), np.zeros(total + 1, np.uint32)
    end = np.unique(node).astype(np.int64)
    is_end = np.zeros(total + 1, bool)
    is_end[end] = True
    auto = {"key": key, "root": root, "fail": fail}
    for a, b in zip(level[:-1], level[1:]):
        at = np.arange(a + 1, b + 1)
        before = (key[at - 1] >> np.uint64(32)).astype(np.int64)
        if a:  # nodes of the first level fail to the root
            fail[at] = advance(auto, fail[before], (key[at - 1] & np.uint64(0xFFFFFFFF)).astype(np.int64))
        out[at] = np.where(is_end[at], at, out[fail[at]])
    # Items and bytes of each window, by the number of its end.
    order = np.lexsort((own, node))
    pair_new = np.concatenate([[True], (node[order][1:] != node[order][:-1]) | (own[order][1:] != own[order][:-1])])[: len(order)]
    order = order[pair_new]
    ends, first = np.unique(node[order], return_index=True)
    texts_of = [words.joined(begin[i], begin[i] + wide[i] - 1) for i in order[first]]
    auto |= {"vocabulary": vocabulary, "depth": depth, "out": out, "end": ends.astype(np.uint32), "item": own[order].astype(np.uint32)}
    auto |= {"item_at": np.append(first, len(order)).astype(np.int64), "window_at": common.offsets([len(t) for t in texts_of])}
    return seed, auto | {"window": np.frombuffer(b"".join(texts_of), np.uint8)}


def advance(auto: dict[str, np.ndarray], node: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The nodes after reading `word` (len(vocabulary) or more: unknown) at `node`, side by side: a step,
    or failure links until there is one."""
    key, root, fail = auto["key"], auto["root"], auto["fail"]
    known = np.minimum(word, len(root) - 1)
    out = root[known].astype(np.int64)
    on = np.flatnonzero((node > 0) & (word < len(root) - 1))
    node = node.astype(np.int64)[on]
    while len(on):
        step = node.astype(np.uint64) << np.uint64(32) | word[on].astype(np.uint64)
        at = np.minimum(np.searchsorted(key, step), len(key) - 1)
        found = key[at] == step
        out[on[found]] = at[found] + 1
        node, on = fail[node[~found]].astype(np.int64), on[~found]
        node, on = node[node > 0], on[node > 0]
    return out


def scan(words: Words, seed: int, auto: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word, node): places where windows end in the texts' words, and the ends of these windows."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words.start) or not len(auto["key"]):
        return none
    h = words.hashes(seed)
    word = np.minimum(np.searchsorted(auto["vocabulary"], h), len(auto["vocabulary"]) - 1)
    word = np.where(auto["vocabulary"][word] == h, word, len(auto["vocabulary"]))
    size = int(auto["depth"].max())
    # Strips of texts; each begins size - 1 words earlier, where the text has them.
    cut = words.cut
    many = -(-np.diff(cut) // STRIP)
    own = np.repeat(np.arange(len(many)), many)
    low = cut[own] + (np.arange(len(own)) - np.repeat(common.offsets(many)[:-1], many)) * STRIP
    high = np.minimum(low + STRIP, cut[own + 1])
    at = np.maximum(low - (size - 1), cut[own])
    order = np.argsort(at - high, kind="stable")  # the longest first, so that the busy ones stay in front
    low, high, at = low[order], high[order], at[order]
    left = high - at
    node = np.zeros(len(at), np.int64)
    places, nodes = [], []
    for t in range(int(left.max(initial=0))):
        n = np.searchsorted(-left, -t, "left")
        node = advance(auto, node[:n], word[at[:n] + t])
        hit = np.flatnonzero((auto["out"][node] > 0) & (at[:n] + t >= low[:n]))
        places.append(at[hit] + t)
        nodes.append(auto["out"][node[hit]].astype(np.int64))
    place, node = np.concatenate(places), np.concatenate(nodes)
    every = []
    while len(place):  # all windows that end there: shorter ones lie on the way of failure links
        every.append((place, node))
        node = auto["out"][auto["fail"][node]].astype(np.int64)
        place, node = place[node > 0], node[node > 0]
    return tuple(np.concatenate(x) for x in zip(*every)) if every else none


def found_in(words: Words, parts: list[tuple[int, dict[str, np.ndarray]]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text (number of words, indexes of hit words, indexes of items found)."""
    n = len(words.cut) - 1
    first, last, item, doc = [], [], [], []
    base = 0
    for seed, auto in parts:
        place, node = scan(words, seed, auto)
        wide = auto["depth"][node].astype(np.int64)
        end, at, window = np.searchsorted(auto["end"], node), auto["window_at"], auto["window"]
        # Equal hashes of words are likely, not certain, to be equal words.
        sure = np.array([window[at[k] : at[k + 1]].tobytes() == words.joined(p - w + 1, p) for p, k, w in zip(place, end, wide)], bool)
        place, end, wide = place[sure], end[sure], wide[sure]
        of = np.searchsorted(words.cut, place, side="right") - 1
        first.append(place - wide + 1)
        last.append(place)
        # Items by text, each pair of text and window once.
        pair = np.unique(np.stack([of, end]), axis=1) if len(end) else np.zeros((2, 0), np.int64)
        many = auto["item_at"][pair[1] + 1] - auto["item_at"][pair[1]]
        rows = np.repeat(auto["item_at"][pair[1]] - common.offsets(many)[:-1], many) + np.arange(many.sum())
        item.append(auto["item"][rows].astype(np.int64) + base)
        doc.append(np.repeat(pair[0], many))
        base += int(auto["items"])
    edge = np.zeros(len(words.start) + 1, np.int64)
    if first:
        np.add.at(edge, np.concatenate(first), 1)
        np.add.at(edge, np.concatenate(last) + 1, -1)
    hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
    hit_at = np.searchsorted(hit, words.cut)
    item, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, doc))
    order = np.argsort(doc, kind="stable")
    item, item_cut = item[order], np.searchsorted(doc[order], np.arange(n + 1))
    for i in range(n):
        yield int(words.cut[i + 1] - words.cut[i]), hit[hit_at[i] : hit_at[i + 1]] - words.cut[i], np.unique(item[item_cut[i] : item_cut[i + 1]])


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the original text from the first to the last word of each run of hit words."""
    if not len(hit):
        return []
    place = [m.span() for m in _WORD.finditer(text.translate(_TO))]
    cut = np.flatnonzero(np.diff(hit) > 1)
    return [(place[a][0], place[b][1]) for a, b in zip(hit[np.append(0, cut + 1)], hit[np.append(cut, len(hit) - 1)])]


# --- the file of the automaton ----------------------------------------------------------------


def _items(benchmark: DataFrame, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in parts of about `most` bytes; the driver holds one at a time."""
    part, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        text = (row["text"] or "").encode("utf-8", "replace")
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append((row["item_id"], text))
        size += len(text)
    if part:
        yield part


def publish(benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> str:
    """Build the automaton on the driver and write it to the shared folder; returns the file's place, where
    it must stay while rows are looked at. Layout: for each part the seed, the number of items and the arrays, each
    with its type and length, from a place divisible by 8; then the items' ids."""
    spark = benchmark.sparkSession
    folder = common.scratch(spark, "automaton")
    name = f"automaton-{uuid.uuid4().hex}.bin"
    store, at = store_of(f"{folder}/{name}")
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as out:
        for part in _items(benchmark, part_bytes):
            seed, auto = build([t for _, t in part], size)
            ids = [b"" if i is None else b"+" + i.encode() for i, _ in part]
            auto |= {"id_at": common.offsets([len(i) for i in ids]), "id": np.frombuffer(b"".join(ids), np.uint8)}
            out.write(np.array([seed, len(part)], "<i8").tobytes())
            for a in (*ARRAYS, "id_at", "id"):
                raw = np.ascontiguousarray(auto[a])
                out.write(raw.dtype.str.encode().ljust(8) + np.array([len(raw)], "<i8").tobytes())
                out.write(raw.tobytes() + bytes(-raw.nbytes % 8))
    return f"{folder}/{name}"


_mapped: dict[str, list] = {}


def load(path: str) -> list[tuple[int, dict[str, np.ndarray]]]:
    """The parts of the file, mapped into memory; where the shared folder is not mounted, a worker reads
    it once."""
    if path not in _mapped:
        _mapped.clear()
        raw = mapped(*store_of(path), np.uint8)
        parts, at = [], 0
        while at < len(raw):
            seed, items = raw[at : at + 16].view("<i8").tolist()
            at += 16
            auto: dict = {"items": items}
            for a in (*ARRAYS, "id_at", "id"):
                kind, n = np.dtype(raw[at : at + 8].tobytes().decode().strip()), int(raw[at + 8 : at + 16].view("<i8")[0])
                at += 16
                auto[a] = raw[at : at + n * kind.itemsize].view(kind)
                at += n * kind.itemsize + -(n * kind.itemsize) % 8
            parts.append((seed, auto))
        _mapped[path] = parts
    return _mapped[path]


def _names(parts: list, items: np.ndarray) -> list[str]:
    """Ids of items, sorted as strings, each once; null ones are left out."""
    out, base = set(), 0
    for _, auto in parts:
        at = auto["id_at"]
        for i in items[(items >= base) & (items < base + auto["items"])] - base:
            raw = auto["id"][at[i] : at[i + 1]].tobytes()
            if raw:
                out.add(raw[1:].decode())
        base += auto["items"]
    return sorted(out)


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES, into: str = "found") -> DataFrame:
    """Adds to docs, whose columns stay, a column `into`: n_words, hit (word indexes), items (ids as
    strings, sorted, null ones left out) and spans (byte ranges in the original UTF-8 text).

    If docs has one of that name, the new
    one gets underscores in front (common.fresh). Documents keep their order and are not
    shuffled; repeated rows are told alike. Null and empty texts have no words. An empty benchmark
    finds nothing. Items that repeat an id count as one, those that repeat a text each by its id.
    """
    into = common.fresh(docs, into)
    path = publish(benchmark, size, part_bytes)

    @F.pandas_udf("struct<n_words: long, hit: array<int>, items: array<string>, spans: array<struct<start: int, end: int>>>")
    def look(text: pd.Series) -> pd.DataFrame:
        parts, rows = load(path), []
        raw = common.encode(text)
        for lo, hi in common.batches([len(t) for t in raw], 2 << 20):
            for t, (n, hit, items) in zip(raw[lo:hi], found_in(Words(raw[lo:hi]), parts)):
                rows.append((n, hit.astype(np.int32), _names(parts, items), [{"start": a, "end": b} for a, b in spans(t, hit)]))
        return pd.DataFrame(rows, columns=["n_words", "hit", "items", "spans"])

    return docs.withColumn(into, look(F.col("text").cast("string")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the benchmark occurs in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "found.*")
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


# Windows of the items are looked for among the runs of as many words of the documents.
_WORDS = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(text="text")}, []) AS w FROM documents
),
i AS (SELECT row_number() OVER () AS r, CAST(item_id AS VARCHAR) AS item, {_WORDS.format(text="text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)
),
starts AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
hits AS (
  SELECT s.r, s.k, x.n, x.item
  FROM (SELECT DISTINCT n FROM windows) AS size
  JOIN starts AS s ON s.k + size.n - 1 <= len(s.w)
  JOIN windows AS x ON x.n = size.n AND x.words = array_to_string(s.w[s.k : s.k + size.n - 1], ' ')
),
places AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT r, k, unnest(range(0, n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits WHERE item IS NOT NULL GROUP BY r)
SELECT CAST(d.doc_id AS BIGINT) AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
