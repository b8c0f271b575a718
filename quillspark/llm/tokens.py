"""Token ids of whole texts, piece by piece.

Both public vocabularies split a text by a fixed pattern and then encode each piece alone. So the
pieces of a batch are looked up in a bounded cache, and only new distinct ones go through the
tokenizers library; a test compares the ids with those of whole-text calls.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

# The split patterns of the two public vocabulary files, in the syntax of Python's re.
BYTE_PIECES = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
WORD_PIECES = r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
#: Pieces kept by a worker; beyond it, new ones are encoded again when they come up again.
CACHE = 500_000

_encoders: dict[str, "Encoder"] = {}


def id_kind(ids: int) -> str:
    """Type of numbers for so many ids."""
    return "<u2" if ids <= 1 << 16 else "<u4"


class Encoder:
    """ids(texts) gives each text's ids as an array: those of Tokenizer.from_file(path).encode(text,
    add_special_tokens=False), so the string of an added token in a text is that token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        # A text that may hold an added token is not cut into pieces.
        added = [re.escape(t["content"]) for t in told.get("added_tokens", ())]
        self.added = re.compile("|".join(added), re.I).search if added else lambda text: None
        self.words = told["normalizer"] is not None
        self.find = re.compile(WORD_PIECES if self.words else BYTE_PIECES).findall
        self.cache: dict[str, bytes] = {}
        # Tokens that open a piece with a space, or close a word: they part words encoded in one go.
        vocabulary = self.tokenizer.get_vocab()
        self.kind = id_kind(max(vocabulary.values()) + 1)
        self.wide = np.dtype(self.kind).itemsize
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.words else t.startswith("\u0120"))]] = True

    def _plain(self, text: str) -> bool:
        """Whether re's classes split this text as the vocabulary's pattern does: they agree on
        ASCII and on letters up to U+024F; any other text, and one with the string of an added
        token, is encoded whole."""
        return _KNOWN(text) is None and self.added(text) is None

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces. Words with their space are encoded end to end, the rest one by one."""
        plain = [p for p in pieces if (p if self.words else p[1:]).isalpha() and (self.words or p[0] == " ")]
        new = {}
        if plain:
            text = (" " if self.words else "").join(plain)
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(plain):
                raise ValueError("the vocabulary does not part words as expected")
            cut = np.append(0, at + 1) if self.words else np.append(at, len(ids))
            raw, cut = ids.tobytes(), (cut * self.wide).tolist()
            new = {p: raw[cut[i] : cut[i + 1]] for i, p in enumerate(plain)}
        rest = [p for p in pieces if p not in new]
        if rest:
            got = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            of = np.asarray([-1 if w is None else w for w in got.word_ids], np.int64)
            raw, cut = np.asarray(got.ids, self.kind).tobytes(), (np.searchsorted(of, np.arange(len(rest) + 1)) * self.wide).tolist()
            new |= {p: raw[cut[i] : cut[i + 1]] for i, p in enumerate(rest)}
        if len(self.cache) + len(new) <= CACHE:
            self.cache.update(new)
        return new

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        known = self.cache
        split: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if not self._plain(text):
                split.append(None)
                continue
            if self.words:
                text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
            pieces = self.find(text)
            split.append(pieces)
            new.update(pieces)
        new = new.difference(known) if len(new) > 64 else {p for p in new if p not in known}
        extra = self._learn(list(new)) if new else {}
        whole = known if len(known) and all(p in known for p in extra) else None
        out = []
        for text, pieces in zip(texts, split):
            if pieces is None:
                out.append(np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind))
            elif whole is not None:
                out.append(np.frombuffer(b"".join(map(known.__getitem__, pieces)), self.kind))
            else:
                out.append(np.frombuffer(b"".join([known[p] if p in known else extra[p] for p in pieces]), self.kind))
        return out


# Anything but ASCII, Latin letters to U+024F without U+00AA, U+00B2, U+00B3, U+00B9, U+00BA and
# U+00BC to U+00BE (numbers of other kinds), and general punctuation that is no space.
_KNOWN = re.compile("[^\\x00-\\x1b\\x20-\\x7f¡-©«-±´-¸»¿-įĲ-ɏ‐-‧‰-⁞₠-₿]").search


def encoder(path: str) -> Encoder:
    """One encoder a worker process, whose cache outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
