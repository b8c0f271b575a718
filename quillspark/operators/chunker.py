"""Markdown to heading-aware chunks."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 1200, 150
# White space as a browser's script counts it.
_WS = "\t\n\x0b\x0c\r    -     　﻿"
_INLINE = _WS.replace("\n", "")
#: Fence markers, and headings that fill their line.
_MARK = re.compile(rf"^(?:(?P<fence>[{_INLINE}]*+(?:```|~~~))|#{{1,6}}[{_INLINE}]++(?P<title>[^\n\r\u2028\u2029]*+)$)", re.M)
_PARAGRAPH = re.compile(r"\n{2,}")
_ENDS = re.compile(rf"\A[{_WS}]+|[{_WS}]+\Z")


def _strip(text: str) -> str:
    return _ENDS.sub("", text)


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, body) pairs; the body of a section has its heading line. A section begins at a heading
    with an even number of fence markers before it, since any marker closes an open fence."""
    fences, heads = 0, [(0, "")]
    for m in _MARK.finditer(text):
        if m["fence"] is not None:
            fences += 1
        elif fences % 2 == 0:
            heads.append((m.start(), _strip(m["title"])))
    ends = [at for at, _ in heads[1:]] + [len(text)]
    return [(title, body) for (at, title), end in zip(heads, ends) if (body := _strip(text[at:end]))]


def ranges(ends: list[int], starts: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Where the pieces of a text lie, given where its paragraphs start and end. A piece runs over as
    many paragraphs as fit, one at least, and reaches back over the end of the piece before; paragraphs
    of more than `most` are cut into strides, and pieces do not reach over them."""
    out: list[tuple[int, int]] = []
    long = [i for i in range(len(ends)) if ends[i] - starts[i] > most] + [len(ends)]
    at = 0
    for stop in long:
        back = None
        while at < stop:
            first = starts[at] if back is None else max(back, out[-1][0])
            at = max(at + 1, bisect_right(ends, first + most, at, stop))
            out.append((first, ends[at - 1]))
            back = ends[at - 1] - overlap if overlap else None
        if stop < len(ends):
            out += [(i, min(i + most, ends[stop])) for i in range(starts[stop], ends[stop], max(1, most - overlap))]
        at = stop + 1
    return out


def split_body(body: str, most: int, overlap: int) -> list[str]:
    """Pieces of a section: whole if it fits, else by ranges over its paragraphs, which two line breaks
    part."""
    if len(body) <= most:
        return [body]
    paragraphs = _PARAGRAPH.split(body)
    ends = [n - 2 for n in accumulate(len(p) + 2 for p in paragraphs)]
    joined = "\n\n".join(paragraphs)
    return [joined[a:b] for a, b in ranges(ends, [e - len(p) for e, p in zip(ends, paragraphs)], most, overlap)]


def chunk_markdown(source: str | None, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str, str]]:
    """(index, heading, text); null and blank sources have none. Lengths count code points."""
    overlap = min(max(0, overlap), most - 1)
    text = (source or "").removeprefix("﻿").replace("\r\n", "\n").replace(" ", " ")
    found = [(h, piece) for h, body in sections(text) for raw in split_body(body, most, overlap) if (piece := _strip(raw))]
    return [(i, h, piece) for i, (h, piece) in enumerate(found)]


def _told(source: str | None, most: int, overlap: int) -> list[dict]:
    """The chunks of a document, or its error."""
    try:
        return [dict(zip(("chunk_index", "heading", "text"), c)) for c in chunk_markdown(source, most, overlap)]
    except Exception as e:
        return [{"error": str(e) or type(e).__name__}]


def cut(files: DataFrame, content: str = "content", most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """files with one row for each chunk instead: content goes, chunk_index, heading, text and error come. A
    file that can't be cut has one row with its error and no chunk; the others are not touched."""

    @F.pandas_udf("array<struct<chunk_index: int, heading: string, text: string, error: string>>")
    def run(source: pd.Series) -> pd.Series:
        return source.map(lambda s: _told(s, most, overlap))

    return files.withColumn("_c", F.explode(run(content))).select(*(c for c in files.columns if c != content), "_c.*")


def chunks(files: DataFrame, content: str = "content", most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """files with one row for each chunk instead: content goes, chunk_index, heading and text come."""
    return cut(files, content, most, overlap).where("error IS NULL").drop("error")


UDTF_KIND = "chunk_index int, heading string, text string, error string"


def register_udtf(spark: SparkSession, name: str = "chunk_markdown") -> None:
    """The chunker for SQL, as a table function. Documents reach it one by one, so a worker holds one
    with its chunks, however many and long they are; Arrow would hand it ten thousand at once:

        SELECT d.path, c.* FROM files d, LATERAL chunk_markdown(d.content) c

    gives a row for each chunk of a document, and one with its error for one that can't be cut."""

    @F.udtf(returnType=UDTF_KIND, useArrow=False)
    class ChunkMarkdown:
        def eval(self, content: str) -> Iterator[tuple]:
            for r in _told(content, MAX_CHARS, OVERLAP):
                yield r.get("chunk_index"), r.get("heading"), r.get("text"), r.get("error")

    spark.udtf.register(name, ChunkMarkdown)


def stride_slices(docs: DataFrame, key: str, text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """What chunks() gives for texts of one paragraph, without Python: key, chunk_index, piece."""
    last = F.greatest(F.length(text) - 1, F.lit(0))
    starts = F.when(F.length(text) <= most, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(most - overlap)))
    each = docs.select(key, text, F.posexplode(starts).alias("chunk_index", "_start"))
    piece = F.regexp_replace(F.substring(F.col(text), F.col("_start") + 1, F.lit(most)), r"^\s+|\s+$", "")
    return each.select(key, "chunk_index", piece.alias("piece")).where("piece != ''")
