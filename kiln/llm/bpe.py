"""Byte-level BPE encoding and decoding (operator 3).

The rank file becomes a sentencepiece BPE model directly: each token's bytes
are mapped to the characters U+0100..U+01FF, a piece's score is its negative
rank, and the normaliser is the identity.  sentencepiece merges the best
scored adjacent pair first, leftmost on ties - the order of the ranks.  Text is
cut by the tokenizer's pattern first and each match is encoded by itself; a
match that is a token as a whole is that token.  Ids are the ranks; the
model's one extra piece (unknown, never produced) stands after them.

Decoding maps ids back to their bytes.

Edge cases: null and empty texts have no ids; texts of any length are encoded
whole; equal rows give equal results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import utf8

CACHE_ENTRIES = 200_000
SLICE_BYTES = 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[i] for i in range(len(tokens))]


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def byte_chars(data: bytes) -> str:
    """Bytes as the characters U+0100..U+01FF, none of which is white space."""
    return data.decode("latin-1").translate(_TO_PIECE)


_TO_PIECE = {b: 0x100 + b for b in range(256)}


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model with the given tokens as BPE pieces."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, byte_chars(t).encode()) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, normal))
        for rank, t in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown)))
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(tokens))
    identity = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class ByteBpe:
    """Encoder and decoder of one vocabulary; built on the worker from the token list."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.split = regex.compile(pattern).findall
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.cache: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        missing = [w for w in words if w not in self.cache]
        if len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.cache.clear()
            missing = list(words)
        raw = [w.encode() for w in missing]
        merged = []
        for word, data in zip(missing, raw):
            ids = self.whole.get(data)
            if ids is None:
                merged.append((word, data))
            else:
                self.cache[word] = ids
        coded = self.sp.encode([byte_chars(d) for _, d in merged], out_type=int, num_threads=1) if merged else []
        for (word, _), ids in zip(merged, coded):
            self.cache[word] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.split(t) for t in texts]
        self._learn(set(chain.from_iterable(words)))
        get = self.cache.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_BUILT: dict[tuple, ByteBpe] = {}


def worker_bpe(tokens: list[bytes], pattern: str) -> ByteBpe:
    """One encoder per worker process and vocabulary."""
    key = (pattern, hashlib.sha256(b"".join(struct.pack("<I", len(t)) + t for t in tokens)).digest())
    if key not in _BUILT:
        _BUILT[key] = ByteBpe(tokens, pattern)
    return _BUILT[key]


def slices(values: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes of text each."""
    start = used = 0
    for i, v in enumerate(values):
        used += len(v)
        if used >= limit:
            yield start, i + 1
            start, used = i + 1, 0
    if start < len(values):
        yield start, len(values)


def cut(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list]]:
    """Ranges of about ``limit`` bytes of a text column with their values; only one range is a list at a time."""
    start = used = 0
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for i, size in enumerate(sizes):
        used += size
        if used >= limit or i + 1 == len(sizes):
            yield start, i + 1, column.slice(start, i + 1 - start).to_pylist()
            start, used = i + 1, 0


def encode_documents(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and decoded (bytes) of every row."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(tokens.value, pattern)
        for batch in batches:
            for lo, hi, data in cut(batch.column("b")):
                ids = bpe.encode([d.decode() for d in data])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.binary()),
                     pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows."""
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
