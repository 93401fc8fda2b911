"""Exact, cached BPE encoding of whole texts inside Python workers.

Both encoders cut a text only where the tokenizer itself always cuts, encode each distinct chunk once per worker
with the tokenizer library, and join the chunks' ids. Ids travel as packed little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

#: Distinct chunks a worker keeps, and the longest one (in characters) worth keeping.
CACHE_CHUNKS = 600_000
CACHE_CHARS = 48

#: A single space between two characters that are not white space: no pre-token of the byte-level pattern spans it,
#: and the space always opens the pre-token that follows.
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


class _Uneven(Exception):
    """A chunk that plain splitting at spaces must not cut off."""


def pack(ids) -> bytes:
    return array("I", ids).tobytes()


def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class _Chunks(dict):
    """chunk -> value of " " + chunk, filled on demand; emptied when full, so memory stays bounded."""

    def __init__(self, make, limit: int = CACHE_CHUNKS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, chunk: str):
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Uneven
        value = self.make(" " + chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[chunk] = value
        return value


class ByteEncoder:
    """Byte-level BPE of a ``tokenizers`` JSON file; ``ranks`` names the same vocabulary as a rank file, which
    encodes chunks without special strings faster and to the same ids."""

    def __init__(self, path: str = BYTE_BPE, ranks: str | None = BYTE_RANKS):
        self.library = _library(path)
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.chunks = _Chunks(self.encode_piece)

    def ids_of(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode_piece(self, text: str) -> bytes:
        return pack(self.ids_of(text))

    def encode(self, text: str | None) -> bytes:
        """Packed ids of the whole text."""
        if not text:
            return b""
        head, *rest = text.split(" ")
        if not rest:
            return self.encode_piece(text)
        try:
            if not head or head[-1].isspace():
                raise _Uneven
            return self.encode_piece(head) + b"".join(map(self.chunks.__getitem__, rest))
        except _Uneven:
            head, *rest = _BOUNDARY.split(text)
            return self.encode_piece(head) + b"".join([self.encode_piece(" " + x) for x in rest])

    @cached_property
    def token_bytes(self) -> list[bytes]:
        return _token_bytes(self.library.to_str())

    def decode(self, packed: bytes) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


def _token_bytes(source: str) -> list[bytes]:
    """The bytes that each id stands for under the byte-level alphabet."""
    alphabet = {letter: b for b, letter in _byte_letters().items()}
    model = json.loads(source)
    out = [b""] * (1 + max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]))
    for token, i in model["model"]["vocab"].items():
        out[i] = bytes(alphabet[c] for c in token)
    for t in model["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


#: Words that the word-end tokenizer's normaliser and pattern cut in one way only: Latin letters, then plain marks.
_PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|]*)")


class _Words(dict):
    """word -> packed ids, filled on demand; emptied when full."""

    def __init__(self, make, limit: int = CACHE_CHUNKS):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word: str) -> bytes:
        value = self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


class WordEncoder:
    """BPE with word ends of a ``tokenizers`` JSON file that drops white space and so never joins across it.

    New words are encoded by the library's BPE model alone where its normaliser and pattern have one outcome, so that
    "Word," and "word" share the work on their letters; all others by the whole tokenizer.
    """

    def __init__(self, path: str = WORD_BPE):
        self.library = _library(path)
        self.model = self.library.model
        self.letters = _byte_letters()
        self.words, self.stems = _Words(self._word), _Words(self._stem)

    def encode_piece(self, text: str) -> bytes:
        return pack(self.library.encode(text, add_special_tokens=False).ids)

    def _stem(self, stem: str) -> bytes:
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(self.letters)
        return pack([t.id for t in self.model.tokenize(stem)])

    def _word(self, word: str) -> bytes:
        m = _PLAIN_WORD.fullmatch(word)
        if not m:
            return self.encode_piece(word)
        return self.stems[m[1].lower()] + (self.stems[m[2]] if m[2] else b"")

    def encode(self, text: str | None) -> bytes:
        """Packed ids of the whole text."""
        if not text:
            return b""
        if _NOT_SPACE.search(text):
            return self.encode_piece(text)
        return b"".join(map(self.words.__getitem__, text.split()))


#: White space to Python, but not to the tokenizer.
_NOT_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the byte-level alphabet."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=4)
def byte_encoder(path: str = BYTE_BPE, ranks: str | None = BYTE_RANKS) -> ByteEncoder:
    """One encoder per worker process; its cache outlives the task."""
    return ByteEncoder(path, ranks)


@lru_cache(maxsize=2)
def word_encoder(path: str = WORD_BPE) -> WordEncoder:
    return WordEncoder(path)
