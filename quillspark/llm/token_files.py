"""Token ids in flat binary files, in the order of the documents.

Format of a corpus: for each part a file of little-endian unsigned integers (2 bytes each if all ids
of the vocabulary and the end id fit, else 4; the manifest tells) and an index of little-endian 64-bit integers: number n of documents, their
n ids, and n + 1 offsets, counted in tokens from the start of the part. What the parts before hold
is the part's base; bases are prefix sums over the manifest, one row a part. A reader maps the file
into memory and slices.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
NO_ID = -(1 << 63)  # stands for a null doc_id in an index


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Encode whole texts (null: empty), end each with end_id and write them in ascending doc_id
    order into `parts` parts of folder, which driver and executors must share. Returns the manifest:
    part, path, width (bytes of an id), n_docs, n_tokens, base.

    Equal doc_ids lie beside each other, in any order, a null doc_id comes first, an empty table has
    no parts. A null or empty text is the end id alone. Other columns are left out.
    A task that runs twice writes files of other names; the manifest names those that count.
    """
    spark = docs.sparkSession
    path = common.tokenizer_path(tokenizer)
    dealt = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = dealt.repartitionByRange(parts or 2 * common.parallelism(spark), "doc_id").sortWithinPartitions("doc_id")
    store_of(folder)[0].create_dir(store_of(folder)[1], recursive=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        encoder = tokens.encoder(path)
        width = np.dtype(tokens.id_kind(max(len(encoder.edge), end_id + 1))).itemsize
        store, at = store_of(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}")
        ids_of, sizes, file = [], [], None
        for frame in frames:
            texts = ["" if not isinstance(t, str) else t for t in frame["text"]]
            ids_of += [NO_ID if pd.isna(d) else int(d) for d in frame["doc_id"]]
            for lo, hi in common.batches([len(t) for t in texts], 2_000_000):
                file = file or store.open_output_stream(at + ".bin")
                for ids in encoder.ids(texts[lo:hi]):
                    out = np.append(ids, end_id).astype(f"<u{width}")
                    sizes.append(len(out))
                    file.write(out.tobytes())
        if file is None:
            return
        file.close()
        with store.open_output_stream(at + ".idx") as index:
            index.write(np.concatenate([[len(sizes)], ids_of, common.offsets(sizes)]).astype("<i8").tobytes())
        yield pd.DataFrame({"part": [part], "path": [os.path.basename(at)], "width": width, "n_docs": [len(sizes)], "n_tokens": [sum(sizes)]})

    # The write happens once, when its manifest is stored.
    manifest = common.materialize(dealt.mapInPandas(write, "part int, path string, width int, n_docs long, n_tokens long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of a written corpus: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned
    32-bit integers). Each task maps the files of its manifest rows into memory; where the folder is
    no mounted one, it reads them whole, one part at a time."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, width, base in zip(frame["path"], frame["width"], frame["base"]):
                store, at = store_of(f"{folder}/{path}")
                ids, index = (mapped(store, at + end, kind) for end, kind in ((".bin", f"<u{width}"), (".idx", "<i8")))
                n = int(index[0])
                doc, cut = np.array(index[1 : n + 1]), np.array(index[n + 1 :])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut, cut[1:])]
                doc = pd.Series(doc, dtype="Int64").mask(doc == NO_ID)
                yield pd.DataFrame({"doc_id": doc, "start": cut[:-1] + base, "n_tokens": np.diff(cut), "ids_crc32": crc})

    spread = manifest.repartition(common.parallelism(manifest.sparkSession) * 2, "part")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def mapped(store: fs.FileSystem, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where it is mounted, else read whole."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def op2_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as token files and read back: doc_id, start, n_tokens, ids_crc32."""
    folder = common.scratch(spark, "tokens")
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
