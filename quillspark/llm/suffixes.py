"""Substrings that repeat across documents, by a distributed difference-cover suffix sort.

Texts are packed into compressed rows of some megabytes, and what rows exchange are blobs for ranges of
keys, so that no step moves one record for each document or position.

1. What can't matter is left out first. Texts are cut into segments at places that their content names;
   of equal segments (128-bit digests) only one of the smallest doc_id is sorted, since all strings of
   the others start in that document too. A string of `size` bytes that occurs in two documents has the
   same minimizer in both (the smallest of the hashes of its `part`-byte parts), so strings whose
   minimizer occurs in one document only are not sorted. Neither loses a repeat.
2. What is left is sorted. Positions 1 and 2 modulo 3 are the sample. A triple of blocks covers `short`
   bytes; the sampled triples of all rows are sorted, range by range, and get names: ranks, made global
   by prefix sums over the ranges. The same is done once more on the names: triples of names cover
   `size` - 2 bytes. Strings none of whose sampled triples occurs in several documents are dropped on
   the way, for two equal strings share a sampled triple at one place or another.
3. The remaining suffixes are merged in: in each range of strings those at position 0 modulo 3 are
   compared by their first byte or two and the sample's rank behind. Adjacent suffixes with equal
   prefixes of `size` bytes then give each string's smallest doc_id. All comparisons are exact.
4. Each row marks the bytes covered by strings that start in a document with a smaller doc_id.

Ranges are parted by sampled strings and compare all `size` bytes, so a frequent phrase with many
continuations fills many ranges; a row sends a string once, so a frequent string has at most one record a
row. A row sends nothing to ranges in which it has no records, so blobs never outnumber records.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeated string (32 at least), of the parts whose hashes are minimized, and of a packed row.
SIZE = 50
PART = 20
PACK_BYTES = 4 << 20
BLOCK_BYTES = 64 << 10
HASH_BITS = 48
#: Segments have about so many string starts, and at most SEGMENT_MOST.
SEGMENT, SEGMENT_MOST = 128, 4096
#: Bytes of text whose segments, or minimizers, make up a range; string starts that make up one.
SEGMENT_RANGE, HASH_RANGE, STARTS = 1 << 30, 1 << 26, 2_000_000
#: Strings drawn for each range, of which one parts it from the next.
DRAWN = 24
#: Rows of wide keys that are sorted at a time.
PORTION = 1 << 18
NO_ID = (1 << 63) - 1  # a null doc_id counts as the largest, as 2^63 - 1

_MIX = np.uint64(0x9E3779B97F4A7C15)
_KINDS = {k.str.encode(): k for k in map(np.dtype, ("u1", "<u2", "<u4", "<u8", "i1", "<i2", "<i4", "<i8"))}


# --- minimizers -------------------------------------------------------------------------------


class Minimizers:
    """Of the strings of `size` bytes in some documents: each minimizer's position (`at`), hash
    (`hash`), document index (`doc`), and the range of string starts it stands for (`low`, `high`)."""

    def __init__(self, data: np.ndarray, cut: np.ndarray, size: int, part: int):
        got = []
        # Blocks of whole documents small enough for the processor's cache.
        for a, b in common.batches(np.diff(cut).tolist(), BLOCK_BYTES):
            at, h, doc, low, high = self._block(data[cut[a] : cut[b]], cut[a : b + 1] - cut[a], size, part)
            got.append((at + cut[a], h, doc + a, low + cut[a], high + cut[a]))
        none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        self.at, self.hash, self.doc, self.low, self.high = (np.concatenate(x) for x in zip(none, *got))

    @staticmethod
    def _block(data: np.ndarray, cut: np.ndarray, size: int, part: int) -> tuple[np.ndarray, ...]:
        lengths = np.diff(cut)
        if lengths.max(initial=0) < size:
            none = np.zeros(0, np.int64)
            return none, np.zeros(0, np.uint64), none, none, none
        # Hash of every k-byte part, from hashes of parts of half the length.
        h, have = (data.astype(np.uint64) + np.uint64(1)) * _MIX, 1
        while have < part:
            more = min(have, part - have)
            h = (h[: len(h) - more] ^ (h[more:] << np.uint64(23) | h[more:] >> np.uint64(41))) * _MIX
            h ^= h >> np.uint64(29)
            have += more
        low = ((h * _MIX) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        wide, have = size - part + 1, 1
        while have < wide:
            more = min(have, wide - have)
            low = np.minimum(low[: len(low) - more], low[more:])
            have += more
        # Strings that cross the end of a document do not count.
        count = np.maximum(lengths - size + 1, 0)
        begin = np.repeat(cut[:-1], count) + (np.arange(count.sum()) - np.repeat(common.offsets(count)[:-1], count))
        doc = np.repeat(np.arange(len(lengths)), count)
        at = (low[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
        return at[new], h[at[new]] & np.uint64((1 << HASH_BITS) - 1), doc[new], begin[new], begin[np.append(new[1:], len(begin)) - 1]


# --- packed rows ------------------------------------------------------------------------------


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _planes(a: np.ndarray) -> np.ndarray:
    """The bytes of numbers, a line for each place of a byte in them."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)


def _head(kinds: list[bytes], sizes: list[int]) -> bytes:
    return struct.pack("<q" + "8sq" * len(kinds), len(kinds), *(x for pair in zip(kinds, sizes) for x in pair))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers, byte planes apart, compressed."""
    head = _head([a.dtype.str.encode() for a in arrays], [len(a) for a in arrays])
    return _ZIP.compress(b"".join([head, *(a.tobytes() if a.itemsize == 1 else _planes(a).tobytes() for a in arrays)]))


def _squeezed(columns: list[np.ndarray], cut: np.ndarray) -> list[bytes]:
    """_squeeze of each stretch of columns of one length, whose planes are taken once."""
    kinds, planes = [c.dtype.str.encode() for c in columns], np.concatenate([_planes(c) for c in columns])
    return [_ZIP.compress(_head(kinds, [b - a] * len(kinds)) + np.ascontiguousarray(planes[:, a:b]).tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _unsqueeze(blob: bytes | pa.Buffer) -> list[np.ndarray]:
    raw = _UNZIP.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    told, at, out = struct.unpack_from("<" + "8sq" * n, raw, 8), 8 + 16 * n, []
    for kind, size in zip(told[::2], told[1::2]):
        kind = _KINDS[kind.rstrip(b"\0")]
        if kind.itemsize == 1:
            out.append(np.frombuffer(raw, kind, size, at))
        else:
            out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size).T).view(kind).ravel())
        at += size * kind.itemsize
    return out


def _shape(blob: bytes | pa.Buffer) -> tuple[list[np.dtype], list[int]]:
    """Kinds and lengths of squeezed arrays, of which no more than the head is read."""
    with _UNZIP.stream_reader(blob) as raw:
        n = int.from_bytes(raw.read(8), "little")
        told = struct.unpack("<" + "8sq" * n, raw.read(16 * n))
    return [_KINDS[kind.rstrip(b"\0")] for kind in told[::2]], list(told[1::2])


def pack_texts(docs: DataFrame, most: int = PACK_BYTES) -> DataFrame:
    """Rows (g, size, blob): some megabytes of documents each, with all their columns, as compressed Arrow
    streams in no special order."""
    names = docs.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(names.index("text"))), 0).to_pylist()
            for lo, hi in common.batches(sizes, most):
                sink = pa.BufferOutputStream()
                part = batch.slice(lo, hi - lo)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                values = [pa.array([g], pa.int64()), pa.array([sum(sizes[lo:hi])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(values, ["g", "size", "blob"])
                g += 1

    return common.materialize(docs.mapInArrow(pack, "g long, size long, blob binary"), "texts")


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, bounds and bytes of a packed row's texts."""
    held = _table(blob)
    doc = pc.fill_null(held["doc_id"], NO_ID).to_numpy().astype(np.int64)
    text = pc.fill_null(held["text"], "").cast(pa.large_string()).combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    cut = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    line = np.frombuffer(data, np.uint8)[cut[0] : cut[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return doc, cut - cut[0], line


def _distinct(m: Minimizers, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, whether they are in several documents here, and each minimizer's place among them."""
    held, place = np.unique(m.hash, return_inverse=True)
    low, high = np.full(len(held), NO_ID), np.full(len(held), -NO_ID)
    np.minimum.at(low, place, doc[m.doc])
    np.maximum.at(high, place, doc[m.doc])
    return held, low != high, place


def _dealt(held: np.ndarray, n: int) -> np.ndarray:
    """Bounds in sorted hashes of n equal ranges of hashes."""
    return np.searchsorted(held, (np.arange(n + 1, dtype=np.uint64) * np.uint64((1 << HASH_BITS) // n)))


def _bounds(held: np.ndarray, n: int) -> np.ndarray:
    out = _dealt(held, n)
    out[-1] = len(held)
    return out


# --- segments ---------------------------------------------------------------------------------


class Segments:
    """Ranges of string starts of a packed row's texts: `start`, `end`, document index (`doc`), and `kind`,
    the place among the row's distinct ones; of these the digest (`high`, `low`, sorted) and the
    smallest doc_id (`least`)."""

    def __init__(self, doc: np.ndarray, cut: np.ndarray, data: np.ndarray, size: int):
        lengths = np.maximum(np.diff(cut) - size + 1, 0)
        some = np.flatnonzero(lengths)
        begin, stop = cut[:-1][some], cut[:-1][some] + lengths[some]
        word = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
        at = np.flatnonzero((word * _MIX) >> np.uint64(64 - SEGMENT.bit_length() + 1) == 0)
        of = np.searchsorted(begin, at, side="right") - 1
        inside = (of >= 0) & (at < stop[of]) if len(begin) else np.zeros(len(at), bool)
        start = np.unique(np.concatenate([begin, at[inside]]))
        of = np.searchsorted(begin, start, side="right") - 1
        end = np.minimum(np.append(start[1:], stop[-1:]), stop[of]) if len(start) else start
        many = -(-(end - start) // SEGMENT_MOST)
        more = _ranges(np.zeros(len(many), np.int64), many) * SEGMENT_MOST
        self.start = np.repeat(start, many) + more
        self.end = np.minimum(self.start + SEGMENT_MOST, np.repeat(end, many))
        self.doc = some[np.repeat(of, many)] if len(some) else np.zeros(0, np.int64)
        view, digest = memoryview(np.ascontiguousarray(data)), partial(hashlib.blake2b, digest_size=16)
        raw = b"".join([digest(view[a:b]).digest() for a, b in zip(self.start.tolist(), (self.end + size - 1).tolist())])
        keys = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
        self.kind, first = _kinds([keys[:, 0], keys[:, 1]])
        self.high, self.low = keys[first, 0], keys[first, 1]
        self.least = np.full(len(first), NO_ID)
        np.minimum.at(self.least, self.kind, doc[self.doc])

    def packed(self) -> bytes:
        """What later steps need, so that digests are taken once."""
        return _squeeze(*map(_narrow, (np.diff(self.start, prepend=0), self.end - self.start, np.diff(self.doc, prepend=0), self.kind)))

    @classmethod
    def again(cls, told: pd.DataFrame) -> "Segments":
        """start, end, doc and kind as packed, and for each distinct one the smallest doc_id anywhere
        (`least`): the answers for ranges of digests follow one another."""
        out = cls.__new__(cls)
        state, answers = told["blob"][told["what"] == 2], told[told["what"] == 0].sort_values("b")["blob"]
        none = [np.zeros(0, np.int64)]
        start, size, doc, kind = (x.astype(np.int64) for x in _unsqueeze(state.iloc[0])) if len(state) else none * 4
        out.start, out.doc, out.kind = np.cumsum(start), np.cumsum(doc), kind
        out.end = out.start + size
        out.least = np.concatenate(none + [_unsqueeze(x)[0].astype(np.int64) for x in answers])
        return out

    def bounds(self, n: int) -> np.ndarray:
        """Bounds among the distinct ones of n ranges of digests."""
        return np.searchsorted((self.high >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def _kinds(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For rows of keys (not negative), the first key first: each one's place among the distinct ones in
    order, and where one of each is. Narrow neighbours are joined into one number before sorting; if
    the rows' numbers fit behind it, plain numbers are sorted, which is several times faster."""
    packed, room, wides = [], 0, [int(k.max(initial=0)).bit_length() for k in keys]
    if len(keys) > 1 and sum(wides) > 64:  # wide ones by their ranks, since plain numbers sort faster than rows
        if len(keys[0]) > PORTION:
            return _kinds_apart(keys)
        least = len(keys[0]).bit_length()
        keys = [_kinds([k])[0] if w > least else k for k, w in zip(keys, wides)]
        while len(keys) > 2:
            keys = [_kinds(keys[:2])[0], *keys[2:]]
    for k in keys:
        wide = int(k.max(initial=0)).bit_length()
        if packed and wide <= room:
            packed[-1] = packed[-1] << np.uint64(wide) | k.astype(np.uint64)
        else:
            packed.append(k.astype(np.uint64))
            room = 64
        room -= wide
    n = len(packed[0])
    place = np.uint64(n.bit_length())
    if len(packed) == 1 and n.bit_length() <= room:
        line = np.sort(packed[0] << place | np.arange(n, dtype=np.uint64))
        order, new = (line & np.uint64((1 << n.bit_length()) - 1)).astype(np.int64), _new([line >> place])
    else:
        order = np.argsort(packed[0]) if len(packed) == 1 else np.lexsort(packed[::-1])
        new = _new([k[order] for k in packed])
    kind = np.empty(n, np.int32)
    kind[order] = np.cumsum(new) - 1
    return kind, order[new]


def _kinds_apart(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """_kinds of many rows: those between two values of the first key at a time, then those with the
    value, whose other keys tell them apart. So sorting takes little memory beside the keys."""
    lead, n = keys[0], len(keys[0])
    some, parts = np.sort(lead[:: max(1, n >> 12)]), n // PORTION + 1
    edges = np.unique(some[np.arange(1, parts + 1) * len(some) // (parts + 1)])
    kind, first, base = np.empty(n, np.int32), [], 0
    for i in range(len(edges) + 1):
        between = np.ones(n, bool) if i == 0 else lead > edges[i - 1]
        if i < len(edges):
            between &= lead < edges[i]
        for rows, own in ((between, keys), *(((lead == edges[i], keys[1:]),) if i < len(edges) else ())):
            at = np.flatnonzero(rows)
            if len(at):
                told, one = _kinds([k[at] for k in own])
                kind[at] = told + base
                first.append(at[one])
                base += len(one)
    return kind, np.concatenate(first)


def _new(keys: list[np.ndarray]) -> np.ndarray:
    """Which sorted rows differ from the one before."""
    same = np.ones(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        same &= k[1:] == k[:-1]
    return np.concatenate([[True], ~same])[: len(keys[0])]


# --- the strings that are sorted --------------------------------------------------------------


class Plan:
    """The sizes of the two levels of names for strings of `size` bytes."""

    def __init__(self, size: int):
        if size < 32:
            raise ValueError("strings of 32 bytes at least")
        self.size, self.long = size, size - 2
        self.short = -(-self.long // 3)
        self.short += (self.long - self.short) % 3
        back = self.long - self.short
        self.middle, self.last = 3 * ((back // 3 + 1) // 2), back


class Left:
    """The strings of a packed row that are left to be sorted, as runs of their starts: bytes (`text`),
    and for each run where it starts here (`at`) and in the row (`of`), how many starts it has (`count`)
    and whose it is (`owner`)."""

    def __init__(self, blob: bytes, size: int):
        self.of, self.count, self.owner, self.text = _unsqueeze(blob)
        self.of, self.count, self.size = self.of.astype(np.int64), self.count.astype(np.int64), size
        self.at = common.offsets(self.count + size - 1)[:-1]

    def starts(self, wide: int, sample: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of strings of `wide` bytes, all or those of the sample, and their owners."""
        many = self.count + self.size - wide
        place, owner = _ranges(self.at, many).astype(np.int32), np.repeat(self.owner, many)
        if sample:
            keep = place % 3 > 0
            place, owner = place[keep], owner[keep]
        return place, owner

    def names(self, place: np.ndarray, wide: int) -> list[np.ndarray]:
        """Two keys that sort like the strings at these places: names, within this row, of strings half as
        long. Those of a few characters are numbers themselves, and names of two strings side by side,
        or over each other, make those of a longer one."""
        symbols = np.flatnonzero(np.bincount(self.text, minlength=256))
        code = np.zeros(256, np.uint64)
        code[symbols] = np.arange(1, len(symbols) + 1, dtype=np.uint64)
        bits = len(symbols).bit_length()
        have = max(1, min(wide // 2, (64 - len(self.text).bit_length()) // bits))
        line = np.concatenate([code[self.text], np.zeros(wide, np.uint64)])
        key = np.zeros(len(self.text), np.uint64)
        for k in range(have):
            key = key << np.uint64(bits) | line[k : k + len(key)]
        kind, _ = _kinds([key])
        kind = np.concatenate([kind, np.zeros(wide, np.int32)])
        del line
        while 2 * have < wide:
            kind[: len(key)], _ = _kinds([kind[: len(key)], kind[have : have + len(key)]])
            have *= 2
        return [kind[place], kind[place + wide - have]]

    def words(self, place: np.ndarray, wide: int) -> list[np.ndarray]:
        """The strings at these places as numbers that sort like them."""
        view = np.ndarray(max(0, len(self.text) - 7), ">u8", np.ascontiguousarray(self.text), strides=(1,))
        return [view[place + k].astype(np.uint64) for k in (*range(0, wide - 8, 8), wide - 8)]


def _smaller(words: list[np.ndarray], splits: list[np.ndarray]) -> np.ndarray:
    """Whether each string sorts before its split."""
    out, on = np.zeros(len(splits[0]), bool), np.arange(len(splits[0]))
    for w, s in zip(words, splits):  # only ties look at the next word
        out[on] = w[on] < s[on]
        on = on[w[on] == s[on]]
    return out


class Distinct:
    """The distinct ones of a row's strings of `wide` bytes at `place`: `kind`, each string's place among
    them; `at`, where one of each is; `low`, the smallest owner, and `several`, whether there are more.
    `turn` is their order by range, `bound` the bounds of the ranges in it.

    keys must sort like the strings, within each class if there are classes, which come one after
    another. So the ranges' bounds are found by bisection, and no string is compared for its own range."""

    def __init__(self, held: Left, place: np.ndarray, wide: int, keys: list[np.ndarray], owner: np.ndarray, splits: list[np.ndarray], classes: bool = False):
        self.kind, first = _kinds(keys)
        self.at = place[first]
        self.owner = owner
        ends = np.searchsorted(self.at % 3, np.arange(4)) if classes else np.array([0, len(first)])
        cuts = []
        for a, z in zip(ends, ends[1:]):
            low, high = np.full(len(splits[0]), a), np.full(len(splits[0]), z)
            while (on := np.flatnonzero(low < high)).size:
                mid = (low[on] + high[on]) // 2
                less = _smaller(held.words(self.at[mid], wide), [s[on] for s in splits])
                low[on[less]] = mid[less] + 1
                high[on[~less]] = mid[~less]
            cuts.append(np.concatenate([[a], low, [z]]))
        cuts = np.array(cuts)
        sizes = np.diff(cuts, axis=1).T
        self.turn = _ranges(cuts[:, :-1].T.ravel(), sizes.ravel())
        self.bound = common.offsets(sizes.sum(1))

    @cached_property
    def low(self) -> np.ndarray:
        out = np.full(len(self.at), NO_ID)
        np.minimum.at(out, self.kind, self.owner)
        return out

    @cached_property
    def several(self) -> np.ndarray:
        high = np.full(len(self.at), -NO_ID)
        np.maximum.at(high, self.kind, self.owner)
        return self.low != high

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each range that has some, and which of the distinct ones these are."""
        for b in np.flatnonzero(np.diff(self.bound)):
            yield int(b), self.turn[self.bound[b] : self.bound[b + 1]]

    def rows(self, g: int, columns: list[np.ndarray]) -> pd.DataFrame:
        """Rows (b, g, blob): for each range that has some of the distinct ones, these: columns, smallest
        owner and whether there are several."""
        some = np.flatnonzero(np.diff(self.bound))
        blobs = _squeezed([_narrow(c[self.turn]) for c in (*columns, self.low, self.several.view(np.uint8))], np.append(self.bound[some], self.bound[-1]))
        return pd.DataFrame({"b": some, "g": g, "blob": blobs})


def _narrow(x: np.ndarray) -> np.ndarray:
    """In as few bytes as the values need."""
    if x.dtype.kind == "i" and len(x) and x.min() >= 0:
        top = int(x.max())
        return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
    return x


def _gathered(blobs: list[bytes | pa.Buffer]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each blob's records lie in the columns of all, and these, filled with one blob at a time."""
    kinds, sizes = zip(*map(_shape, blobs))
    cut = common.offsets([x[0] for x in sizes])
    columns = [np.empty(cut[-1], np.result_type(*set(x))) for x in zip(*kinds)]
    for a, z, blob in zip(cut.tolist(), cut[1:].tolist(), blobs):
        for column, own in zip(columns, _unsqueeze(blob)):
            column[a:z] = own
    return cut, columns


def _blobs(table: pa.Table) -> list[pa.Buffer]:
    """A group's blobs where they lie, without a copy."""
    return [x.as_buffer() for x in table["blob"]]


def _answered(table: pa.Table, blobs: list[bytes], **more: pa.Array) -> pa.Table:
    """For each row of a group an answer to where it came from."""
    return pa.table({"g": table["g"], "b": table["b"], **more, "blob": pa.array(blobs, pa.binary())})


def _name(key: tuple, table: pa.Table) -> pa.Table:
    """One range of sorted triples: named by their rank, from 1, with the mark "in several documents".
    `n` is the number of names."""
    cut, (*keys, low, several) = _gathered(_blobs(table))
    kind, first = _kinds(keys)
    del keys
    low = low.astype(np.int64)
    least, most, many = np.full(len(first), NO_ID), np.full(len(first), -NO_ID), np.zeros(len(first), bool)
    np.minimum.at(least, kind, low)
    np.maximum.at(most, kind, low)
    many[kind[several > 0]] = True
    many |= least != most
    del least, most, low, several
    return _answered(table, _squeezed([_narrow(kind + 1), many[kind].view(np.uint8)], cut), n=pa.array([len(first)] * len(table), pa.int64()))


def _names_of(told: pd.DataFrame, base: np.ndarray, own: Distinct) -> tuple[np.ndarray, np.ndarray]:
    """Global names of a row's distinct triples, and which of them occur in several documents."""
    name, several = np.zeros(len(own.at), np.int64), np.zeros(len(own.at), bool)
    if len(told):  # every range that has some of them has answered, and these follow one another
        told = told.sort_values("b")
        cut, (local, many) = _gathered(told["blob"].tolist())
        name[own.turn] = local.astype(np.int64) + np.repeat(base[told["b"]], np.diff(cut))
        several[own.turn] = many > 0
    return name, several


def merge(one: list[np.ndarray], two: list[np.ndarray], zero: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings of a range (numbers into one, two, zero end to end) and which differ
    from the one before. Each class has t0, t1 (first bytes), y, z (last bytes), r0, r1, r2: the
    sample's ranks at the string's first three places, of which class one lacks r2, two r1, zero r0."""
    t0, t1, y, z, r0, r1, r2 = (np.concatenate(x) for x in zip(one, two, zero))
    n1, n2, n0 = len(one[0]), len(two[0]), len(zero[0])
    sampled = np.lexsort((z[: n1 + n2], y[: n1 + n2], r0[: n1 + n2]))
    rest = n1 + n2 + np.lexsort((z[n1 + n2 :], r1[n1 + n2 :], t0[n1 + n2 :]))
    by_one, by_two = (t0, r1, z), (t0, t1, r2)
    first, second = sampled[sampled < n1], sampled[sampled >= n1]
    before = _below([k[first] for k in by_one], [k[rest] for k in by_one]) + _below([k[second] for k in by_two], [k[rest] for k in by_two])
    order = np.empty(n1 + n2 + n0, np.int64)
    at = np.arange(n0) + before
    taken = np.zeros(len(order), bool)
    taken[at] = True
    order[at], order[~taken] = rest, sampled
    kind = np.repeat([1, 2, 0], [n1, n2, n0])[order]
    a, b = order[:-1], order[1:]
    same = lambda *keys: np.logical_and.reduce([k[a] == k[b] for k in keys])
    none, two_in = (kind[:-1] == 0) | (kind[1:] == 0), (kind[:-1] == 2) | (kind[1:] == 2)
    equal = np.where(~none, same(r0, y, z), np.where(two_in, same(t0, t1, r2), same(t0, r1, z)))
    return order, np.concatenate([[True], ~equal])[: len(order)]


def _below(sorted_keys: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """For each of sorted keys, how many of sorted_keys are smaller."""
    n = len(sorted_keys[0])
    every = [np.concatenate([b, a]) for a, b in zip(sorted_keys, keys)]
    order = np.lexsort(every[::-1])  # stable: of equal ones, those of keys come first
    return np.flatnonzero(order < len(keys[0])) - np.arange(len(keys[0])) if n else np.zeros(len(keys[0]), np.int64)


def _owners(key: tuple, table: pa.Table) -> pa.Table:
    """One range of strings: sorted, and each one's smallest owner told where it is another."""
    cut, (kind, t0, t1, y, z, ra, rb, low, _) = _gathered(_blobs(table))
    low, none = low.astype(np.int64), np.zeros(len(kind), np.uint8)
    of = [np.flatnonzero(kind == c) for c in range(3)]
    ranks = (none, ra, rb), (ra, rb, none), (ra, none, rb)
    zero, one, two = ([x[at] for x in (t0, t1, y, z, *r)] for at, r in zip(of, ranks))
    del kind, t0, t1, y, z, ra, rb, none, ranks
    order, new = merge(one, two, zero)
    del zero, one, two
    order, head = np.concatenate([of[1], of[2], of[0]])[order], np.flatnonzero(new)
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], head), np.diff(np.append(head, len(order))))
    less = np.flatnonzero(least < low)
    bound = np.searchsorted(less, cut)
    blobs = _squeezed([_narrow(less - np.repeat(cut[:-1], np.diff(bound))), _narrow(least[less])], bound)
    return _answered(table, blobs)


def _sort_strings(left: DataFrame, total: int, plan: Plan, starts: int) -> DataFrame:
    """left (g, blob, drawn) -> g, blob with the runs (start in the row, length) of string starts that a
    smaller doc_id has too."""
    spark = left.sparkSession
    ranges = max(common.parallelism(spark), -(-total // starts))
    rate = min(1.0, DRAWN * ranges / max(1, total))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g, blob in zip(frame["g"], frame["blob"]):
                held = Left(blob, plan.size)
                place, _ = held.starts(plan.size, False)
                place = np.sort(np.random.default_rng(g & 0xFFFFFFFF).choice(place, min(len(place), max(1, int(len(place) * rate))), replace=False))
                yield pd.DataFrame({"string": [held.text[p : p + plan.size].tobytes() for p in place]})

    drawn = sorted(bytes(r["string"]) for r in left.select("g", "blob").mapInPandas(draw, "string binary").collect())
    picked = np.frombuffer(b"".join(drawn[len(drawn) * k // ranges] for k in range(1, ranges)) if drawn else b"", np.uint8)
    told = Left.__new__(Left)
    told.text = picked
    told_at = np.arange(0, len(picked), plan.size)
    splits = {wide: told.words(told_at, wide) for wide in (plan.short, plan.long, plan.size)}
    sent, reply = "b int, g long, blob binary", "g long, b int, n long, blob binary"
    base: dict[str, np.ndarray] = {}

    def bases(names: DataFrame) -> np.ndarray:
        """Prefix sums of the ranges' numbers of names: one number a range."""
        out = np.zeros(ranges, np.int64)
        for r in names.groupBy("b").agg(F.first("n").alias("n")).collect():
            out[r["b"]] = r["n"]
        return common.offsets(out)

    def short_triples(held: Left) -> tuple[np.ndarray, Distinct]:
        place, owner = held.starts(plan.short, True)
        return place, Distinct(held, place, plan.short, held.names(place, plan.short), owner, splits[plan.short])

    def used(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the two sampled triples lie that a string's place is compared by."""
        kind = place % 3
        return np.where(kind == 0, place + 1, place), np.where(kind == 1, place + 1, place + 2)

    def long_triples(held: Left, told: pd.DataFrame) -> tuple[np.ndarray, Distinct, Callable]:
        """Names of the short triples in place; then the long triples of strings that may repeat."""
        place, own = short_triples(held)
        name, several = _names_of(told, base["short"], own)
        local, many = np.zeros(len(held.text), np.int32), np.zeros(len(held.text), bool)
        local[place], many[place] = own.kind, several[own.kind]
        place, owner = held.starts(plan.long, True)
        may = np.zeros(len(held.text), bool)
        may[place] = many[place] & many[place + plan.middle] & many[place + plan.last]
        a, b = used(held.starts(plan.size, False)[0])
        open_ = may[a] | may[b]
        need = np.zeros(len(held.text), bool)
        need[a[open_]] = need[b[open_]] = True
        keep = need[place]
        place, owner = place[keep], owner[keep]
        # Names are in the order of the row's own distinct triples, whose places are smaller numbers.
        triple = [local[place], local[place + plan.middle], local[place + plan.last]]
        pair, _ = _kinds(triple[:2])
        triple_names = lambda own: [name[local[own.at + k]] for k in (0, plan.middle, plan.last)]
        return place, Distinct(held, place, plan.long, [pair, triple[2]], owner, splits[plan.long]), triple_names

    def strings(held: Left, told: pd.DataFrame):
        place, own, _ = long_triples(held, told[told["level"] == 1])
        name, several = _names_of(told[told["level"] == 2], base["long"], own)
        local, many = np.zeros(len(held.text), np.int32), np.zeros(len(held.text), bool)
        local[place], many[place] = own.kind, several[own.kind]
        place, owner = held.starts(plan.size, False)
        a, b = used(place)
        keep = many[a] | many[b]
        place, owner, ra, rb = place[keep], owner[keep], local[a[keep]], local[b[keep]]
        kind = place % 3
        t0, y, z = (held.text[place + k].astype(np.int32) for k in (0, plan.size - 2, plan.size - 1))
        # What tells strings of a class apart: the sample's rank and the bytes that it does not cover.
        keys = [kind << 8 | np.where(kind == 0, t0, 0), ra, np.where(kind == 0, 0, y) << 8 | z]
        own = Distinct(held, place, plan.size, keys, owner, splits[plan.size], classes=True)
        a, b = used(own.at)
        ends = [held.text[own.at + k].astype(np.int64) for k in (0, 1, plan.size - 2, plan.size - 1)]
        return place, owner, own, [own.at % 3, *ends, name[local[a]], name[local[b]]]

    def send_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("b", pa.int32()), ("g", pa.int64()), ("blob", pa.binary())])
        for batch in batches:
            for g, blob in zip(batch["g"].to_pylist(), batch["blob"]):
                held = Left(blob.as_buffer(), plan.size)
                _, own = short_triples(held)
                *words, last = held.words(own.at, plan.short)
                new = np.uint64((1 << 8 * (plan.short - 8 * len(words))) - 1)  # what is not in the word before
                yield pa.RecordBatch.from_pandas(own.rows(g, [*words, (last & new).astype(np.int64)]), kind, preserve_index=False)

    def send_long(left: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        _, own, names = long_triples(Left(left["blob"].iloc[0], plan.size), told)
        return own.rows(int(left["g"].iloc[0]), names(own))

    def send_strings(left: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        *_, own, columns = strings(Left(left["blob"].iloc[0], plan.size), told)
        return own.rows(int(left["g"].iloc[0]), columns)

    def runs(left: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        held = Left(left["blob"].iloc[0], plan.size)
        place, owner, own, _ = strings(held, told[told["level"] < 3])
        least, found = own.low.copy(), told[told["level"] == 3]
        if len(found):
            cut, (less, to) = _gathered(found["blob"].tolist())
            least[own.turn[less.astype(np.int64) + np.repeat(own.bound[found["b"]], np.diff(cut))]] = to
        hit = place[least[own.kind] < owner]
        run = np.searchsorted(held.at, hit, side="right") - 1
        start = np.sort(hit - held.at[run] + held.of[run])
        new = np.flatnonzero(np.concatenate([[True], np.diff(start) > 1])[: len(start)])
        return pd.DataFrame({"g": [int(left["g"].iloc[0])], "blob": [_squeeze(_narrow(start[new]), _narrow(np.diff(np.append(new, len(start)))))]})

    short = common.materialize(left.select("g", "blob").mapInArrow(send_short, sent).groupBy("b").applyInArrow(_name, reply), "short-names")
    base["short"] = bases(short)
    pair = lambda told, f, kind: left.select("g", "blob").groupBy("g").cogroup(told.groupBy("g")).applyInPandas(f, kind)
    long = pair(short, send_long, sent).groupBy("b").applyInArrow(_name, reply)
    long = common.materialize(long, "long-names")
    base["long"] = bases(long)
    told = short.select("g", "b", "blob", F.lit(1).alias("level")).unionByName(long.select("g", "b", "blob", F.lit(2).alias("level")))
    found = common.materialize(pair(told, send_strings, sent).groupBy("b").applyInArrow(_owners, "g long, b int, blob binary"), "owners")
    return pair(told.unionByName(found.withColumn("level", F.lit(3))), runs, "g long, blob binary")


# --- packed rows to marks ---------------------------------------------------------------------


def repeated_spans(docs: DataFrame, size: int, part: int, pack_bytes: int, starts: int = STARTS):
    """(packed texts, findings by g, function that marks a packed row's bytes); see dedup_substrings."""
    spark = docs.sparkSession
    plan = Plan(size)
    packed = pack_texts(docs, pack_bytes)
    total = packed.agg(F.sum("size")).first()[0] or 0
    n_segments, n_hashes = (max(common.parallelism(spark), -(-total // one)) for one in (SEGMENT_RANGE, HASH_RANGE))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Digests of segments, and hashes of minimizers with the mark "in several documents"."""
        for frame in frames:
            for g, blob in zip(frame["g"], frame["blob"]):
                doc, cut, data = _unpack(blob)
                rows, own = [], Segments(doc, cut, data, size)
                bound = own.bounds(n_segments)
                for b in np.flatnonzero(np.diff(bound)):
                    a, z = bound[b], bound[b + 1]
                    rows.append((0, b, g, _squeeze(np.diff(own.high[a:z], prepend=np.uint64(0)), own.low[a:z], _narrow(own.least[a:z]))))
                rows.append((2, g % (1 << 31), g, own.packed()))  # comes back as it is
                m = Minimizers(data, cut, size, part)
                held, several, _ = _distinct(m, doc)
                bound = _bounds(held, n_hashes)
                for b in np.flatnonzero(np.diff(bound)):
                    a, z = bound[b], bound[b + 1]
                    rows.append((1, b, g, _squeeze(np.diff(held[a:z], prepend=np.uint64(0)), np.packbits(several[a:z]))))
                yield pd.DataFrame(rows, columns=["what", "b", "g", "blob"])

    def answer(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] == 2:
            return frame[["g", "what", "b", "blob"]]
        got = [_unsqueeze(x) for x in frame["blob"]]
        cut = common.offsets([len(x[0]) for x in got])
        first = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
        if key[0] == 0:
            kind, one = _kinds([first, np.concatenate([x[1] for x in got])])
            least = np.full(len(one), NO_ID)
            np.minimum.at(least, kind, np.concatenate([x[2].astype(np.int64) for x in got]))
            blobs = [_squeeze(_narrow(least[kind[a:b]])) for a, b in zip(cut, cut[1:])]
        else:
            several = np.concatenate([np.unpackbits(x[1])[: len(x[0])] for x in got]).astype(bool)
            _, place, count = np.unique(first, return_inverse=True, return_counts=True)
            # Rows are cut between documents, so two rows with a hash are two documents, unless a
            # doc_id occurs twice; that only has strings sorted in vain.
            again = count > 1
            again[place[several]] = True
            blobs = [np.packbits(again[place[a:b]]).tobytes() for a, b in zip(cut, cut[1:])]
        return pd.DataFrame({"g": frame["g"], "what": frame["what"], "b": frame["b"], "blob": blobs})

    sent = packed.select("g", "blob").mapInPandas(send, "what int, b int, g long, blob binary")
    told = common.materialize(sent.groupBy("what", "b").applyInPandas(answer, "g long, what int, b int, blob binary"), "told")

    def remaining(left: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """The strings that are left to be sorted, as runs of starts within a document."""
        doc, cut, data = _unpack(left["blob"].iloc[0])
        own = Segments.again(told)
        mine = np.flatnonzero(doc[own.doc] == own.least[own.kind])
        _, first = np.unique(own.kind[mine], return_index=True)
        mine = mine[first]
        m = Minimizers(data, cut, size, part)
        held, place = np.unique(m.hash, return_inverse=True)
        bound, again = _bounds(held, n_hashes), np.zeros(len(held), bool)
        for b, blob in zip(told["b"][told["what"] == 1], told["blob"][told["what"] == 1]):
            again[bound[b] : bound[b + 1]] = np.unpackbits(np.frombuffer(blob, np.uint8))[: bound[b + 1] - bound[b]]
        keep = np.flatnonzero(again[place])
        live = _covered(len(data), own.start[mine], own.end[mine]) & _covered(len(data), m.low[keep], m.high[keep] + 1)
        at = np.flatnonzero(live)
        whose = np.searchsorted(cut, at, side="right") - 1
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(whose) > 0)])[: len(at)])
        of, count = at[new], np.diff(np.append(new, len(at)))
        text = data[_ranges(of, count + size - 1)]
        return pd.DataFrame({"g": left["g"], "starts": [len(at)], "blob": [_squeeze(_narrow(of), _narrow(count), doc[whose[new]], text)]})

    left = packed.select("g", "blob").groupBy("g").cogroup(told.groupBy("g")).applyInPandas(remaining, "g long, starts long, blob binary")
    left = common.materialize(left, "left").where("starts > 0")
    count = left.agg(F.sum("starts")).first()[0] or 0
    runs = told.where("what != 1")
    if count:
        found = _sort_strings(left.select("g", "blob"), count, plan, starts)
        runs = runs.unionByName(common.materialize(found.select("g", F.lit(3).alias("what"), F.lit(0).alias("b"), "blob"), "runs"))

    def mark(blob: bytes, told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, bounds and bytes of a row, and which bytes are covered."""
        doc, cut, data = _unpack(blob)
        own = Segments.again(told)
        here = doc[own.doc] == own.least[own.kind]
        start = _covered(len(data), own.start[~here], own.end[~here])
        for blob in told["blob"][told["what"] == 3]:
            at, n = (x.astype(np.int64) for x in _unsqueeze(blob))
            start |= _covered(len(data), at, at + n)
        # Segments that one document has twice: what holds for the first holds for the others.
        mine = np.flatnonzero(here)
        kinds, first = np.unique(own.kind[mine], return_index=True)
        others = np.setdiff1d(mine, mine[first])
        for i, j in zip(others, mine[first][np.searchsorted(kinds, own.kind[others])]):
            start[own.start[i] : own.end[i]] |= start[own.start[j] : own.end[j]]
        turn = _turns(start)
        return doc, cut, data, _covered(len(data), turn[::2], turn[1::2] + size - 1)

    return packed.select("g", "blob"), runs, mark


def _covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    out = np.zeros(n + 1, np.int32)
    np.add.at(out, start, 1)
    np.add.at(out, end, -1)
    return np.cumsum(out, out=out)[:-1] > 0


def _turns(on: np.ndarray) -> np.ndarray:
    """Where runs of marked places begin and end, in turn."""
    return np.flatnonzero(np.concatenate([on, [False]]) != np.concatenate([[False], on]))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the given ranges, one after another."""
    return np.repeat(starts - common.offsets(sizes)[:-1], sizes) + np.arange(sizes.sum())


def dedup_substrings(docs: DataFrame, size: int = SIZE, part: int = PART, pack_bytes: int = PACK_BYTES, starts: int = STARTS) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: the maximal runs of covered bytes), kept (binary:
    the remaining bytes of the UTF-8 text).

    A byte is covered if a string of `size` bytes over it also starts in a document with a smaller
    doc_id; strings are judged on the input. Null and empty texts and those shorter than `size` keep
    all. Rows with one doc_id do not cover each other; a null doc_id counts as the largest, beside
    2^63 - 1. Other columns are left out; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed, told, mark = repeated_spans(docs, size, part, pack_bytes, starts)

    def out(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"doc_id": [], "n_bytes": [], "spans": [], "kept": []})
        blob = left["blob"].iloc[0]
        doc, cut, data, covered = mark(blob, right)
        ids = _table(blob)["doc_id"].to_pylist()
        rows, turn = [], _turns(covered)
        first, last = np.searchsorted(turn, cut[:-1], side="right"), np.searchsorted(turn, cut[1:])
        for a, b, i, j in zip(cut.tolist(), cut[1:].tolist(), first.tolist(), last.tolist()):
            own = (turn[i:j] - a).tolist()
            if b > a and covered[a]:
                own.insert(0, 0)
            if len(own) % 2:
                own.append(b - a)
            spans = [{"start": s, "end": e} for s, e in zip(own[::2], own[1::2])]
            rows.append((b - a, spans, (data[a:b][~covered[a:b]] if spans else data[a:b]).tobytes()))
        frame = pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])
        return frame.assign(doc_id=pd.array(ids, "Int64"))[["doc_id", "n_bytes", "spans", "kept"]]

    kind = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return packed.groupBy("g").cogroup(told.groupBy("g")).applyInPandas(out, kind)


def cut_documents(docs: DataFrame, size: int = SIZE, part: int = PART, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """docs with their columns, without the covered bytes of dedup_substrings in text, and with
    n_chars, if they have it, counted anew where bytes went. A character goes if a byte of it does;
    a document of which only white space is left goes, if it lost bytes."""
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    packed, told, mark = repeated_spans(docs, size, part, pack_bytes)
    names = docs.columns

    def out(left: pa.Table, right: pa.Table) -> pa.Table:
        blob = left["blob"][0].as_py()
        held = _table(blob)
        doc, cut, data, covered = mark(blob, right.to_pandas())
        text, stay = held["text"].to_pylist(), []
        count = held["n_chars"].to_pylist() if "n_chars" in names else None
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            own = covered[a:b]
            if own.any():
                text[i] = data[a:b][~own].tobytes().decode("utf-8", "ignore")
                if count is not None:
                    count[i] = len(text[i])
            stay.append(not own.any() or bool(text[i].strip()))
        for name, values in (("text", text), ("n_chars", count)):
            if values is not None:
                at = names.index(name)
                held = held.set_column(at, held.schema.field(at), pa.chunked_array([pa.array(values, held.schema.field(at).type)]))
        return held.filter(pa.array(stay, pa.bool_()))

    # Each packed row is a group; those without any finding pass through the same way.
    return packed.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(out, docs.schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document also starts in one with a smaller doc_id, and the digest of the rest."""
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
