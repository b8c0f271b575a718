"""Operator 13 against the tokenizers library, on hostile texts in chunks of every size."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import common, registry, transducer

PATH = common.tokenizer_path(transducer.TOKENIZER)
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", " ", "'", "'s", "'re", "'ll", "'r", "l", "1", "23", "٣", "½", "!", "?!", "-", "_", "é", "é", "漢", "한국", "\U0001f600"]
PARTS += ["<|endoftext|>", "<|end", "<|", "|>", "՘", "࢏", "\U000323b0", " ", "\x1c", "\x85", "​", "ſ", "Ġ", "�", "\x00", "aaaa", "    ", "\r\n", "के"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return transducer.Vocabulary(PATH, transducer.newer_letters(PATH))


@pytest.fixture(scope="module")
def table():
    return transducer.byte_table(PATH)


def streamed(vocabulary, text, sizes):
    stream, out, at, held = transducer.Encoder(vocabulary), [], 0, 0
    while at < len(text):
        n = sizes()
        out.append(stream.feed(text[at : at + n]))
        held = max(held, len(stream.bytes) + len(stream.carry.encode()) + len(stream.tail))
        at += n
    return np.frombuffer(b"".join([*out, stream.finish()]), "<u4").tolist(), held


def test_encodes_like_the_library(vocabulary, library, monkeypatch):
    r = random.Random(5)
    for _ in range(1200):
        monkeypatch.setattr(transducer, "CHUNK", r.choice([4, 16, 1 << 16]))
        monkeypatch.setattr(transducer, "STEP", r.choice([1, 8, 64, 2048]))
        text = "".join(r.choice(PARTS) for _ in range(r.choice([0, 1, 3, 10, 40, 200])))
        if r.random() < 0.3:
            text += r.choice(["a", "the", " ", "é", "1", "!", "漢", "ab", "x "]) * r.choice([10, 300, 2000]) + r.choice(["", "x", " x", "'re"])
        assert streamed(vocabulary, text, lambda: r.choice([1, 2, 3, 7, 50, 400]))[0] == library.encode(text, add_special_tokens=False).ids


def test_tokens_before_the_lookahead_stand(vocabulary, table):
    """Whatever follows a prefix of a piece, the tokens that end `lookahead` bytes before its end stay."""
    r = random.Random(6)
    letters = [t for t in table.values() if t.isalpha()]
    for _ in range(100):
        whole = b"".join(r.choice(letters) for _ in range(200))
        cut = r.randrange(vocabulary.lookahead, len(whole))
        end, first = 0, vocabulary.merge(whole[:cut])
        stable = []
        for i in first:
            end += vocabulary.size[i]
            if end > cut - vocabulary.lookahead:
                break
            stable.append(i)
        assert vocabulary.merge(whole)[: len(stable)] == stable


def test_memory_is_constant(vocabulary, library):
    for unit in ("a", " ", "ab", "漢", "word "):
        held = [streamed(vocabulary, unit * (n // len(unit)), lambda: 5000)[1] for n in (200_000, 400_000)]
        assert held[1] <= max(held[0], 4 * transducer.CHUNK + 5000)


def test_lookahead_of_small_lists():
    look = lambda *merges: transducer.lookahead([tuple(m.split()) for m in merges])
    assert look() == 0 and look("a b") == 1
    assert look("b c", "a b") == 2  # abc: without c it is ab
    assert look("a b", "a bc".replace("bc", "c")) == 1
    for bad in (["ab c"], ["a b", "b c", "a b"]):
        with pytest.raises(ValueError):
            look(*bad)


def test_decodes_like_the_library(vocabulary, table, library):
    r = random.Random(7)
    for _ in range(2000):
        ids = [r.randrange(50_300) for _ in range(r.choice([0, 1, 5, 50]))] if r.random() < 0.5 else [r.choice([*vocabulary.byte, 50_256]) for _ in range(r.choice([1, 3, 20]))]
        stream, raw, out, at = transducer.Decoder(table), transducer.pack(ids), "", 0
        while at < len(raw):
            n = 4 * r.choice([1, 2, 9])
            out += stream.feed(raw[at : at + n])
            at += n
        assert out + stream.finish() == library.decode(ids, skip_special_tokens=False)


def test_as_registered(spark, library, tmp_path):
    """Nulls, empty and very long texts, repeated rows, an empty table, columns of clashing names."""
    texts = [None, "", "don't <|endoftext|> stop", "".join(PARTS), "x" * 150_000, " " * 150_000 + "y", "many words and 123 signs!? " * 20_000, "\x00"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'own' AS ids", "'own' AS decoded", "'own' AS n_tokens")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    op13 = registry.QUERIES["op13_bpe_transducer"]

    def want(d, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        return d, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode())

    got = op13(spark, f"{tmp_path}/a").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted((want(*row) for row in rows), key=str)
    assert op13(spark, f"{tmp_path}/b").count() == 0
    told = transducer.encode(docs.selectExpr("doc_id", "text", "'own' AS ids"))
    assert told.columns == ["doc_id", "text", "ids", "_ids"] and transducer.decode(told, ids="_ids", into="text").columns[-1] == "_text"
