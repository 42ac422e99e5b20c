"""Token-id files of patched frame-of-reference blocks.

A file holds consecutive documents in ascending doc_id order. Their ids form
one stream, cut into blocks of 256:

    block    least id u32 | ids u16 | width u8 | exceptions u8 (of 0..255)
             packed ids minus least, ``width`` bits each, little-endian
             exception positions u8, exception values u32 (minus least)
    index    offset of every block, u64
    docs     doc_id i64, null flag u8, first id's place in the stream u64
    footer   offsets of index and docs u64, blocks, docs and ids u64, magic

The width is the 90th percentile of the bits that a block's ids need, so at
most a tenth of the ids, 25 of 256, are exceptions.

Writers are tasks over a range partitioning by doc_id. Each file gets a name
of its own, and a manifest row, written by Spark, says which files count: a
task that is run again leaves at most a file that no manifest lists.

Edge cases: a null or empty text is the end id alone. Null doc_ids come first.
Repeated doc_ids follow one another in any order. An empty table writes no
files and reads back as no rows. Other columns are not read.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import Cache, materialize, no_cycle_search, shared_dir, small_enough

BLOCK = 256
PERCENTILE = 0.9
FILE_IDS = 1 << 24  # a file ends at the first document end after so many ids
CHUNK = 1 << 10  # blocks packed at a time
CACHE = 1 << 19  # entries of each of the two caches, about 140 bytes each
MAGIC = b"PFORv001"


# --- blocks -----------------------------------------------------------------

def _word(width: int) -> str:
    """The smallest of the two integer types that holds so many bits."""
    return "<u2" if width <= 16 else "<u4"


def _pack(deltas: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers, the low ``width`` bits of each one after the other."""
    kind = np.dtype(_word(width))
    bits = np.unpackbits(deltas.astype(kind).view(np.uint8).reshape(-1, BLOCK, kind.itemsize), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(deltas), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    kind = np.dtype(_word(width))
    bits = np.zeros((len(packed), BLOCK, 8 * kind.itemsize), np.uint8)
    bits[:, :, :width] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    return np.packbits(bits.reshape(len(packed), -1), axis=1, bitorder="little").view(kind)


def _bits_needed(deltas: np.ndarray) -> np.ndarray:
    return np.frexp(deltas.astype(np.float32 if int(deltas.max()) < 1 << 24 else np.float64))[1].astype(np.uint8)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of a stream of unsigned 32-bit ids; all but the last hold BLOCK ids."""
    out: list[bytes] = []
    rank = int(np.ceil(PERCENTILE * BLOCK)) - 1
    for at in range(0, len(ids), CHUNK * BLOCK):
        part = ids[at:at + CHUNK * BLOCK]
        n = -(-len(part) // BLOCK)
        full = np.concatenate([part, np.full(n * BLOCK - len(part), part[-1], part.dtype)]).reshape(n, BLOCK)
        least = full.min(axis=1)
        deltas = (full - least[:, None]).astype(np.uint32)
        need = _bits_needed(deltas)
        width = np.partition(need, rank, axis=1)[:, rank]
        body: list[bytes] = [b""] * n
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            packed, size = _pack(deltas[rows], int(w)).tobytes(), BLOCK // 8 * int(w)
            for i, r in enumerate(rows.tolist()):
                body[r] = packed[i * size:(i + 1) * size]
        over = need > width[:, None]
        exc = over.sum(axis=1)
        where, values = np.nonzero(over)[1].astype(np.uint8).tobytes(), deltas[over].astype("<u4").tobytes()
        head = np.zeros(n, [("least", "<u4"), ("n", "<u2"), ("width", "u1"), ("exc", "u1")])
        head["least"], head["width"], head["exc"] = least, width, exc
        head["n"] = np.minimum(BLOCK, len(part) - np.arange(n) * BLOCK)
        heads, ends = head.tobytes(), np.cumsum(exc).tolist()
        first = 0
        for r, end in enumerate(ends):
            out.append(heads[8 * r:8 * r + 8] + body[r] + where[first:end] + values[4 * first:4 * end])
            first = end
    return out


def decode_blocks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``offsets`` of ``data`` (a byte array)."""
    if not len(offsets):
        return np.empty(0, np.uint32)
    head = data[offsets[:, None] + np.arange(8)]
    least = head[:, :4].copy().view("<u4").ravel()
    count = head[:, 4:6].copy().view("<u2").ravel()
    width, exc = head[:, 6].astype(np.int64), head[:, 7].astype(np.int64)
    full = np.zeros((len(offsets), BLOCK), np.uint32)
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        for i in range(0, len(same), CHUNK):
            rows = same[i:i + CHUNK]
            if w:
                full[rows] = _unpack(data[offsets[rows, None] + 8 + np.arange(BLOCK // 8 * int(w))], int(w))
    row = np.repeat(np.arange(len(offsets)), exc)  # one entry an exception
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exc) - exc, exc)
    start = (offsets + 8 + BLOCK // 8 * width)[row]
    values = data[(start + exc[row] + 4 * nth)[:, None] + np.arange(4)]
    full[row, data[start + nth]] = values.copy().view("<u4").ravel()
    full += least[:, None]
    return full[np.arange(BLOCK)[None, :] < count[:, None]]


# --- files ------------------------------------------------------------------

class FileWriter:
    """Collects documents and writes one file."""

    def __init__(self):
        self.body, self.offsets, self.docs, self.starts = io.BytesIO(), [], [], []
        self.pending: list[bytes] = []
        self.pending_ids = self.ids = 0
        self.body.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.ids)
        self.pending.append(ids)
        self.ids += len(ids) // 4
        self.pending_ids += len(ids) // 4
        if self.pending_ids >= CHUNK * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:cut]):
            self.offsets.append(self.body.tell())
            self.body.write(block)
        self.pending, self.pending_ids = [ids[cut:].tobytes()], len(ids) - cut

    def bytes(self) -> bytes:
        self._flush(True)
        index = self.body.tell()
        self.body.write(np.array(self.offsets, "<u8").tobytes())
        docs = self.body.tell()
        self.body.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.body.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.body.write(np.array(self.starts, "<u8").tobytes())
        self.body.write(np.array([index, docs, len(self.offsets), len(self.docs), self.ids], "<u8").tobytes() + MAGIC)
        return self.body.getvalue()


class FileReader:
    """Reads a file's bytes; ids of any range of the stream come from their blocks alone."""

    def __init__(self, content: bytes):
        self.data = np.frombuffer(content, np.uint8)
        if content[:8] != MAGIC or content[-8:] != MAGIC:
            raise ValueError("not a whole token file")
        index, docs, blocks, n, self.n_ids = (int(x) for x in np.frombuffer(content[-48:-8], "<u8"))
        self.offsets = np.frombuffer(content, "<u8", blocks, index).astype(np.int64)
        self.doc_ids = np.frombuffer(content, "<i8", n, docs)
        self.nulls = np.frombuffer(content, np.uint8, n, docs + 8 * n).astype(bool)
        self.starts = np.frombuffer(content, "<u8", n, docs + 9 * n).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        first = start // BLOCK
        got = decode_blocks(self.data, self.offsets[first:-(-stop // BLOCK)])
        return got[start - first * BLOCK:stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start within the file, ids) of every document, a bounded group of blocks at a time."""
        ends = np.append(self.starts[1:], self.n_ids)
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(ends, self.starts[i] + CHUNK * BLOCK, "right")))
            base = int(self.starts[i])
            got = self.ids(base, int(ends[j - 1]))
            for k in range(i, j):
                yield (None if self.nulls[k] else int(self.doc_ids[k]), int(self.starts[k]),
                       got[self.starts[k] - base:ends[k] - base])
            i = j


LETTER = "a-z\xdf-\xf6\xf8-\xff"
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
PLAIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^0-9{LETTER}]+")


class WordIds(Cache):
    """Little-endian ids of each word between ASCII white space.

    The tokenizer's normalizer and pattern never join characters across ASCII
    white space, and drop it, so a text's ids are its words' ids in order. A
    word of ASCII characters and Latin-1 letters is split by the tokenizer's
    pattern here, and its pieces go to the tokenizer's model; any other word,
    and one that may hold a special token, goes to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(self._word, CACHE)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        self.pieces = Cache(self._piece, CACHE)
        self.alphabet = {b: c for c, b in byte_alphabet().items()}

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return struct.pack(f"<{len(t)}I", *[x.id for x in t]) if (t := self.model.tokenize(spelled)) else b""

    def _word(self, word: bytes) -> bytes:
        letters = word.rstrip(b".,")
        if letters.isalpha():  # ASCII letters, and a run of marks
            ids = self.pieces[letters.lower().decode()]
            return ids + self.pieces[word[len(letters):].decode()] if len(letters) < len(word) else ids
        text = word.decode("utf-8")
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, PLAIN_PIECE.findall(text.lower())))
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache a process, so that later tasks find it filled."""
    return WordIds(path)


def _write(path: str, folder: str, end_id: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        words = word_ids(path)
        end = np.array([end_id], "<u4").tobytes()
        where, root = fs.FileSystem.from_uri(folder)
        part, seq, out = TaskContext.get().partitionId(), 0, None

        def close(w: FileWriter) -> pa.RecordBatch:
            name = f"{part:06d}-{seq:04d}-{uuid.uuid4().hex}.pfor"
            with where.open_output_stream(f"{root}/{name}") as f:
                f.write(w.bytes())
            return pa.RecordBatch.from_pydict({
                "file": [name], "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                "n_docs": pa.array([len(w.docs)], pa.int64()), "n_ids": pa.array([w.ids], pa.int64())})

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                out = out or FileWriter()
                with no_cycle_search():
                    out.add(doc_id.as_py(), b"".join(map(words.__getitem__, (text.as_py() or b"").split())) + end)
                if out.ids >= file_ids:
                    yield close(out)
                    seq, out = seq + 1, None
        if out is not None:
            yield close(out)
    return run


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every document with the tokenizer file at ``path`` into files of ``folder``.

    ``folder`` is a URI (or path) that the driver and all executors share.
    Returns the manifest: file, part, seq, n_docs, n_ids; files in order of
    (part, seq) hold ascending doc_ids.
    """
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(ordered.mapInArrow(_write(path, folder, end_id, file_ids),
                                          "file string, part int, seq int, n_docs long, n_ids long"), "token-manifest")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for file, base, content in zip(frame["file"], frame["base"], frame["content"], strict=True):
            rows = [(doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for doc_id, start, ids in FileReader(content).documents()]
            p = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
            yield p.astype({"doc_id": "Int64"})


def read_digests(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start in the whole stream, n_tokens, ids_crc32."""
    order = Window.orderBy("part", "seq")  # one row a file
    based = manifest.select("file", F.coalesce(F.sum("n_ids").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
             .select(F.element_at(F.split("path", "/"), -1).alias("_name"), "content"))
    side = F.broadcast(based) if small_enough(manifest.count(), 128) else based
    wanted = files.join(side, F.col("_name") == F.col("file")).select("file", "base", "content")
    return wanted.mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digests(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    if folder.startswith("file:/") and not folder.startswith("file://"):  # as Hadoop prints it
        folder = "file://" + folder.removeprefix("file:")
    return read_digests(spark, folder, write_tokens(docs, path, folder, end_id))
