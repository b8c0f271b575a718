"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as a byte-to-text
state machine.

Text comes in chunks of any size. It is split into pieces as the vocabulary says (contractions, runs of
letters, of digits, of other signs, of white space), and a piece's bytes are merged by the merge list.
Nothing waits for the end of a text or of a piece: a piece is known once the two after it have begun,
and within a long piece a token is emitted once it is stable, that is, once no later byte can change it.

When a token is stable follows from the merge list. Let two texts share the bytes u, and let q be the
place in u up to which their tokens agree after all merges of rank r and below. At first q is the end
of u. It moves left only when a merge (a, x) joins the last common token a with a token x that begins at
q in one text and not in the other; then it moves by |a|. The next such merge (b, y) has a higher rank,
and y begins where a did, so a lies on the left edge of y: y is a, or made of a left part that does. So
the merges that move q form a chain, and the longest chain, by the bytes of its left parts, is a bound
for the lookahead: in a prefix of a piece, all tokens that end so many bytes before its end stand. For
lists in which every merge makes a new token of older ones, as training does, the chains are found in
one pass over the list. What a stream holds is so bounded by the vocabulary and not by the text.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
import struct
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
#: Characters of a text that are split at a time, and bytes of a piece merged beyond the lookahead.
CHUNK, STEP = 1 << 16, 1 << 11
#: Pieces a worker keeps the ids of, and characters up to which a piece is kept.
CACHE, SHORT = 200_000, 48
#: Rows that are taken out of an Arrow batch at a time.
ROWS = 128

# The split pattern of the vocabulary.
CONTRACTIONS = "'(?:[stmd]|re|ve|ll)"
SPLIT = CONTRACTIONS + r"| ?{letters}+| ?{digits}+| ?{others}+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones of Latin-1 stand for
    themselves, the others, in order, for those from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which a token stands, by the longest chain of merges that move the first difference
    of two texts to the left (see above). The list must be proper: each merge makes a new token of bytes
    or of tokens made before."""
    left: dict[bytes, bytes] = {}  # made token -> its left part
    reach: dict[bytes, int] = {}  # token -> longest chain so far whose last left part it is
    most = 0
    for a, x in merges:
        if a + x in left or any(len(t) > 1 and t not in left for t in (a, x)):
            raise ValueError(f"the merge list is not proper at {a!r} {x!r}")
        edge, before = x, reach.get(x, 0)
        while edge in left:
            edge = left[edge]
            before = max(before, reach.get(edge, 0))
        left[a + x] = a
        reach[a] = max(reach.get(a, 0), len(a) + before)
        most = max(most, reach[a])
    return most


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out: list[list[int]] = []
    for c in points:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@functools.lru_cache
def newer_letters(path: str) -> tuple[int, ...]:
    """Code points that the regex module takes for letters or digits and the vocabulary's library, with
    older tables of characters, does not. Only those unknown to Python's own tables are asked about."""
    from tokenizers import Tokenizer

    told = regex.compile(r"[\p{L}\p{N}]").match
    doubtful = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" and told(chr(c))]
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    known: set[int] = set()
    for lead in "x1":  # such a letter or digit stays with the one before it
        pieces = split("\n".join(lead + chr(c) for c in doubtful))
        known.update(at for _, (at, to) in pieces if to == at + 2)
    return tuple(c for k, c in enumerate(doubtful) if 3 * k not in known)


def _told(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def byte_table(path: str) -> dict[int, bytes]:
    """The bytes of every id; an added token is written out as bytes where all of its characters stand for
    some, else as it is."""
    told, byte = _told(path), byte_letters()
    tokens = {i: t for t, i in told["model"]["vocab"].items()} | {t["id"]: t["content"] for t in told["added_tokens"]}
    return {i: bytes(map(byte.__getitem__, t)) if all(c in byte for c in t) else t.encode() for i, t in tokens.items()}


class Vocabulary:
    """Merges, ids and split of a byte-level vocabulary file; `newer` is newer_letters() of it."""

    def __init__(self, path: str, newer: tuple[int, ...]):
        told, byte = _told(path), byte_letters()
        model, split = told["model"], told["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or told["normalizer"] or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that look at what is around them")
        raw = lambda token: bytes(map(byte.__getitem__, token))
        ids = {raw(t): i for t, i in model["vocab"].items()}
        merges = [tuple(raw(t) for t in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        self.lookahead = lookahead(merges)
        self.byte = [ids[bytes([b])] for b in range(256)]
        self.rank = {(ids[a], ids[x]): r for r, (a, x) in enumerate(merges)}
        self.made = [ids[a + x] for a, x in merges]
        self.size = {i: len(t) for t, i in ids.items()}
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        inside = _ranges(list(newer))
        self.newest = regex.compile(f"[\\U{min(newer):08x}-\\U{sys.maxunicode:08x}]").search if newer else lambda text: None
        self.runs = {}
        for exact in (False, True):
            less = f"--[{inside}]" if exact else ""
            kinds = {"letters": rf"[\p{{L}}{less}]", "digits": rf"[\p{{N}}{less}]", "others": rf"(?:[^\s\p{{L}}\p{{N}}]|[{inside}])" if exact else r"[^\s\p{L}\p{N}]"}
            flag = "(?V1)" if exact else ""
            self.runs[exact] = regex.compile(flag + SPLIT.format(**kinds)).findall, {k: regex.compile(f"{flag}{v}*").match for k, v in kinds.items()}
        self.white = regex.compile(r"\s*").match
        self.cache: dict[str, bytes] = {}

    def split(self, text: str):
        """(findall of the split, matchers of runs by kind); characters of doubtful kind take longer."""
        return self.runs[not text.isascii() and self.newest(text) is not None]

    def merge(self, piece: bytes) -> list[int]:
        """The tokens of all of `piece`: the pair of the lowest rank, the leftmost first, until none is left."""
        ids = [self.byte[b] for b in piece]
        return self._short(ids) if len(ids) <= 2 * SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), none)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank((ids[i], ids[j])) != r:
                continue  # one of the two has changed meanwhile
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            before[after[i]] = i
            if after[i] < n and (s := rank((ids[i], ids[after[i]]))) is not None:
                heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := rank((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (s, before[i]))
        return [i for i in ids if i >= 0]

    def encoded(self, pieces: list[str]) -> bytes:
        """Ids of whole short pieces, from the cache where it has them."""
        known = self.cache
        new = set(pieces).difference(known)
        for p in new:
            known[p] = pack(self.merge(p.encode("utf-8", "replace")))
        out = b"".join(map(known.__getitem__, pieces))
        full = len(known) > CACHE
        for p in new:
            if full or len(p) > SHORT:
                del known[p]
        return out


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """A stream: feed() takes text and gives the ids that have become stable, as little-endian unsigned
    32-bit integers; finish() gives the rest and makes it ready for another text."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.tail = ""  # what may begin an added token
        self._begin()

    def _begin(self) -> None:
        self.carry = ""  # what may belong to a piece that is not known yet
        self.run = None  # kind of the piece that is under way
        self.bytes = bytearray()  # its bytes without a stable token

    def feed(self, text: str) -> bytes:
        text, at, out = self.tail + text, 0, []
        for token, i in self.v.added.items() if len(self.v.added) == 1 else ():
            while (found := text.find(token, at)) >= 0:
                out += [self._feed(text[at:found]), self._end(), pack([i])]
                at = found + len(token)
        if len(self.v.added) > 1:
            for m in regex.finditer("|".join(map(regex.escape, sorted(self.v.added, key=len, reverse=True))), text):
                out += [self._feed(text[at : m.start()]), self._end(), pack([self.v.added[m.group()]])]
                at = m.end()
        keep = next((k for k in range(min(max(map(len, self.v.added), default=1) - 1, len(text) - at), 0, -1) if any(t.startswith(text[-k:]) for t in self.v.added)), 0)
        self.tail = text[len(text) - keep :]
        return b"".join([*out, self._feed(text[at : len(text) - keep])])

    def finish(self) -> bytes:
        tail, self.tail = self.tail, ""
        return self._feed(tail) + self._end()

    def _feed(self, text: str) -> bytes:
        if not text:
            return b""
        text, at, out = self.carry + text, 0, []
        self.carry = ""
        if self.run:
            at = self._goes_on(text, out)
            if self.run:
                return b"".join(out)
        pieces = self.v.split(text)[0](text, at)
        # All but the last two are known; the last but one is too, unless it may begin a contraction.
        known = pieces[:-1] if len(pieces) > 1 and (pieces[-2] != "'" or len(pieces[-1]) > 1) else pieces[:-2]
        out.append(self.v.encoded(known))
        held = pieces[len(known) :]
        self.carry = "".join(held)
        if held and len(self.carry) > CHUNK:
            self._opens(held[-1], out)
        return b"".join(out)

    def _opens(self, piece: str, out: list[bytes]) -> None:
        """The last piece is long: its bytes are merged while it goes on."""
        self.carry = ""
        if piece.isspace() and self.v.white(piece).end() == len(piece):
            self.run, self.carry = "white", piece[-1]  # its last character may belong to the next piece
            out.append(self._merge(piece[:-1]))
            return
        runs = self.v.split(piece)[1]
        self.run = next(k for k, match in runs.items() if match(piece, 1).end() > 1)
        out.append(self._merge(piece))

    def _goes_on(self, text: str, out: list[bytes]) -> int:
        """Takes what continues the open piece; where the next one begins."""
        end = (self.v.white if self.run == "white" else self.v.split(text)[1][self.run])(text).end()
        if end < len(text):
            stop = end - 1 if self.run == "white" else end
            out += [self._merge(text[:stop]), self._close()]
            return stop
        if self.run == "white":
            self.carry, end = text[-1], end - 1
        out.append(self._merge(text[:end]))
        return end

    def _merge(self, text: str) -> bytes:
        """Stable tokens of the open piece: those that end `lookahead` bytes before what is known of it."""
        out, more = [], text.encode("utf-8", "replace")
        for at in range(0, len(more), STEP):
            self.bytes += more[at : at + STEP]
            if len(self.bytes) >= self.v.lookahead + STEP:
                out.append(self._stable(len(self.bytes) - self.v.lookahead))
        return b"".join(out)

    def _stable(self, limit: int) -> bytes:
        ids, end, n = self.v.merge(bytes(self.bytes)), 0, 0
        for i in ids:
            if end + self.v.size[i] > limit:
                break
            end, n = end + self.v.size[i], n + 1
        del self.bytes[:end]
        return pack(ids[:n])

    def _close(self) -> bytes:
        ids = self.v.merge(bytes(self.bytes))
        self.run = None
        self.bytes.clear()
        return pack(ids)

    def _end(self) -> bytes:
        """Of the text, or of what lies before an added token."""
        if self.run == "white":
            out = self._merge(self.carry) + self._close()  # no other character follows
        elif self.run:
            out = self._close()
        else:
            out = self.v.encoded(self.v.split(self.carry)[0](self.carry)) if self.carry else b""
        self._begin()
        return out


class Decoder:
    """A stream the other way: feed() takes ids and gives the text whose bytes are complete, at most three
    are held back; finish() gives what stands for an unfinished character. Bytes that are no UTF-8
    become U+FFFD, one for each part that no character begins with; ids out of the vocabulary are left
    out."""

    def __init__(self, table: dict[int, bytes]):
        self.bytes = table
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        known = self.bytes
        try:
            raw = b"".join(map(known.__getitem__, memoryview(ids).cast("I") if sys.byteorder == "little" else struct.unpack(f"<{len(ids) // 4}I", ids)))
        except KeyError:
            raw = b"".join(known.get(i, b"") for i in struct.unpack(f"<{len(ids) // 4}I", ids))
        return self.state.decode(raw)

    def finish(self) -> str:
        out = self.state.decode(b"", True)
        self.state.reset()
        return out


_held: dict[str, Vocabulary] = {}
_tables: dict[str, dict[int, bytes]] = {}


def vocabulary(path: str, newer: tuple[int, ...]) -> Vocabulary:
    """One a worker process; its cache outlives the task."""
    if path not in _held:
        _held[path] = Vocabulary(path, newer)
    return _held[path]


def _slices(batches: Iterator[pa.Array]) -> Iterator[list]:
    """A few rows at a time, so that of an Arrow batch only these are Python objects, and what comes out of
    them leaves at once."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS).to_pylist()


def encode(docs: DataFrame, text: str = "text", into: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds the ids of whole texts: binary, little-endian unsigned 32-bit integers, those of the tokenizers
    library without its truncation, padding and template tokens; the string of an added token in a text
    is that token. Null and empty texts have none (empty binary). Rows stay where they are, repeated ones
    too; where docs has a column `into`, the new one gets underscores in front. Texts go through the
    transducer CHUNK characters at a time."""
    path = common.tokenizer_path(tokenizer)
    newer = newer_letters(path)

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stream = Encoder(vocabulary(path, newer))
        for texts in _slices(batches):
            out = []
            for t in texts:
                t = t or ""
                out.append(b"".join([stream.feed(t[k : k + CHUNK]) for k in range(0, len(t), CHUNK)] + [stream.finish()]))
            yield pa.array(out, pa.binary())

    return docs.withColumn(common.fresh(docs, into), ids(F.col(text).cast("string")))


def decode(rows: DataFrame, ids: str = "ids", into: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """Adds the text of a column of ids as encode() writes them, special tokens included; null and no ids
    give an empty text. Where rows has a column `into`, the new one gets underscores in front."""
    path = common.tokenizer_path(tokenizer)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _tables:
            _tables[path] = byte_table(path)
        stream = Decoder(_tables[path])
        for each in _slices(batches):
            out = []
            for raw in each:
                raw = raw or b""
                out.append("".join([stream.feed(raw[k : k + 4 * CHUNK]) for k in range(0, len(raw), 4 * CHUNK)] + [stream.finish()]))
            yield pa.array(out, pa.string())

    return rows.withColumn(common.fresh(rows, into), text(F.col(ids)))


def op13_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text that they decode to, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    told = decode(encode(docs))
    return told.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
