"""Token ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit ids.

The ids are those of the tokenizers library, which adds no special tokens but takes the string
of one in a text for that token. Its byte-level splitter never joins text across a single
space, so a text is cut at spaces and each cut piece is encoded once per process: common words
are looked up, not merged again. Texts where a space stands between white space, and texts that
hold the string of an added token, are given to the library as a whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

from ledgerline.llm.common import process_cache

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2

# Pieces remembered per process; later ones are encoded each time they occur.
MEMORY = 600_000

# A space next to white space on both sides, or before the end after white space: there the
# splitter takes several white space characters together.
JOINED = re.compile(r" (?<=\s )(?:(?=\s)|\Z)")
PLAIN = re.compile(r"[ -~\nÀ-ÖØ-öø-ɏ]*")


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Visible Latin-1 characters stand for themselves, the other bytes for letters from 256 on.
    """
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in visible]
    return {**{b: b for b in visible}, **{b: 256 + n for n, b in enumerate(others)}}


class _Words(dict):
    """Ids of a splitter word; the library's model merges words it has not seen."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.merge = tokenizer.model.tokenize
        self.letters = byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = word.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.merge(letters)]).tobytes()
        if len(self) < MEMORY and len(word) < 64:
            self[word] = ids
        return ids


class _Chunks(dict):
    """Ids of what stands between two spaces, with the space before it."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.words = _Words(tokenizer)
        self.split = regex.compile(public_tokenizers.PATTERN).findall

    def of(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.of(" " + chunk)
        if len(self) < MEMORY and len(chunk) < 64:
            self[chunk] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.chunks = _Chunks(self.tokenizer)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if JOINED.search(text) or (self.added and self.added.search(text)):
            return self.chunks.whole(text)
        first, *rest = text.split(" ")
        return (self.chunks.of(first) if first else b"") + b"".join(map(self.chunks.__getitem__, rest))


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def encoder(path: str) -> Encoder:
    """The encoder of this process."""
    cache = process_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def document_ids(tool: Encoder, text: str | None) -> bytes:
    """Ids of a document with the end id behind them."""
    return tool.encode(text) + END_ID.to_bytes(4, "little")
