"""Byte-level BPE encoding and decoding by forced boundaries.

A merge can only build vocabulary tokens, so two neighbouring bytes that stand
next to each other inside no token can never be merged across: between them is
a certain cut, and what lies left and right of it is encoded independently.

Cuts are made on two levels. Before a run of ASCII white space that follows a
character which isn't white space, the tokenizer's own splitting pattern
always ends a piece; texts fall into short fragments there, most of which
recur and come from a bounded cache. A fragment seen for the first time is
split by the tokenizer's pattern, each piece is cut at every byte pair that
occurs inside no token, and the parts are merged by the tokenizer's model on
their own; their ids are concatenated.

Texts with other Unicode white space, where the first level doesn't hold, go
to the second level whole. Special token strings in a text are that token, as
in the library.

Edge cases: a null or empty text has no ids and decodes to an empty text.
Repeated rows are encoded alike; other columns pass through ``encode`` (see
there).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, no_cycle_search

CACHE = 1 << 16  # entries of each of the two caches, about 250 bytes each
PART_BYTES = 1 << 20  # text that is encoded before its ids are handed on
FRAGMENT = re.compile("[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
PLAIN = re.compile(f"[\t-\r -~{LETTER}]*")
PRINTABLE = re.compile("[!-~]+")  # these stand for themselves in the byte alphabet
PLAIN_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTER}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level alphabet: printable bytes stand for themselves,
    the others take the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        added = spec["added_tokens"]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens that strip, or match words or normalized text, are not supported")
        self._tok = Tokenizer.from_file(path)
        self._pre, self._model = self._tok.pre_tokenizer, self._tok.model
        vocab = spec["model"]["vocab"]
        self._inside = {t[i:i + 2] for t in vocab for i in range(len(t) - 1)}
        of = byte_alphabet()
        self._bytes = {i: bytes(of[c] for c in t) for t, i in vocab.items()}
        self._special = {a["content"]: a["id"] for a in added}
        self._bytes |= {i: s.encode() for s, i in self._special.items()}
        names = sorted(self._special, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self._alphabet = {b: c for c, b in of.items()}
        self._blank = self._alphabet[0x20]
        self._merged = Cache(self._merge, CACHE)
        self._fragments = Cache(self._new, CACHE)

    def _pieces(self, fragment: str) -> list[str]:
        """The pre-tokenizer's pieces in the byte alphabet."""
        if fragment.isascii():
            word = fragment[1:] if fragment[0] == " " else fragment
            letters = word.rstrip(".,")
            if letters.isalpha():  # a word, its blank and a run of marks
                first = self._blank + letters if fragment[0] == " " else letters
                return [first, word[len(letters):]] if len(letters) < len(word) else [first]
        if PLAIN.fullmatch(fragment):  # its pattern, for ASCII and Latin-1 letters
            if PRINTABLE.fullmatch(fragment):
                return PLAIN_PIECE.findall(fragment)
            return [p.encode().decode("latin-1").translate(self._alphabet) for p in PLAIN_PIECE.findall(fragment)]
        return [p for p, _ in self._pre.pre_tokenize_str(fragment)]

    def _merge(self, piece: str) -> bytes:
        """Cut a piece at the byte pairs that no token holds; merge each part on its own."""
        out: list[int] = []
        start = 0
        for i in range(1, len(piece)):
            if piece[i - 1:i + 1] not in self._inside:
                out += [t.id for t in self._model.tokenize(piece[start:i])]
                start = i
        out += [t.id for t in self._model.tokenize(piece[start:])]
        return struct.pack(f"={len(out)}i", *out)

    def _new(self, fragment: str) -> bytes:
        return b"".join(map(self._merged.__getitem__, self._pieces(fragment)))

    def _plain(self, text: str) -> bytes:
        if OTHER_SPACE.search(text):
            return self._new(text)
        return b"".join(map(self._fragments.__getitem__, FRAGMENT.findall(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, 32-bit integers."""
        if not text:
            return np.empty(0, np.int32)
        if self._split is None or not any(s in text for s in self._special):
            return np.frombuffer(self._plain(text), np.int32)
        parts = [struct.pack("=i", self._special[p]) if p in self._special else self._plain(p)
                 for p in self._split.split(text)]
        return np.frombuffer(b"".join(parts), np.int32)

    def forget(self) -> None:
        """Give the caches' memory back; a worker that waits for other work holds none."""
        self._fragments.clear()
        self._merged.clear()
        pa.default_memory_pool().release_unused()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> ForcedBoundaryBPE:
    """One encoder a process: later tasks find its tables loaded."""
    return ForcedBoundaryBPE(path)


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about PART_BYTES of text, a row at least."""
    size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // PART_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for lo, hi in zip(edges, edges[1:]):
        if hi > lo:
            yield b.slice(lo, hi - lo)


def _encoded(path: str, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch], bpe: ForcedBoundaryBPE) -> Iterator[pa.RecordBatch]:
        decimal: dict[int, str] = {i: str(i) for i in bpe._bytes}
        for b in (part for whole in batches for part in _parts(whole)):
            n, ids_sha, text_sha, all_ids = [], [], [], []
            with no_cycle_search():
                for text in b.column("text"):
                    packed = bpe.encode(text.as_py())
                    ids = packed.tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(packed)
            cols = {"_row": b.column("_row"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()),
                    "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                cols["token_ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer_of(path)
        try:
            yield from rows(batches, bpe)
        finally:
            bpe.forget()
    return run


def encode(docs: DataFrame, path: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids.

    A kept column named like a result gives way to the result.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids
    keep = [c for c in keep if c not in new]
    rows = docs.select(F.struct(*keep).alias("_row"), "text")
    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = rows.mapInArrow(_encoded(path, with_ids), schema + ", token_ids array<int>" * with_ids)
    return out.select("_row.*", *new)
