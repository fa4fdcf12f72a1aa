"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

The vocabulary (token bytes and their ranks) becomes a sentencepiece BPE model: every byte
is mapped to a printable character, each token is one piece scored by its negative rank, and
normalisation is the identity. Merging the best scored adjacent pair first is then the same
rule as merging the lowest rank first, so pieces have the rank as their id. Each match of the
pre-token pattern is encoded on its own; decoding is the inverse mapping.

Defined results: a null or empty text has no ids and decodes to empty bytes; repeated rows
give repeated rows; other columns are carried along unless they clash with the added one, in
which case the added column replaces them; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import slices, trimmed

#: Bytes of the pre-tokens that a worker keeps encoded, after which it starts anew, and characters of the longest one it keeps.
CACHE_BYTES, LONGEST = 64 << 20, 64
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 200
#: Characters whose pre-tokens are looked up together.
AT_ONCE = 1 << 20


def byte_chars() -> list[str]:
    """A printable character for each byte value: itself if it is printable Latin-1, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from lines of base64 bytes and decimal rank."""
    pairs = []
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                pairs.append((int(rank), base64.b64decode(token)))
    pairs.sort()
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without holes")
    return [token for _, token in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialize_model(tokens: list[bytes]) -> bytes:
    """The sentencepiece model (protobuf wire format) whose piece ids are the ranks.

    Fields: 1 pieces (1 text, 2 score, 3 type), 2 trainer (3 model type 2 = BPE, 40 unknown id,
    41, 42 and 43 absent), 3 normaliser (1 name, 3 dummy prefix, 4 extra spaces, 5 escaping).
    """
    chars = byte_chars()
    pieces = []
    for rank, token in enumerate(tokens):
        text = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -rank)))
    # the one unknown piece that a model must have holds a space, which mapped text never does
    pieces.append(_field(1, _field(1, b" unknown") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    absent = (1 << 64) - 1
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(n, absent) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder(dict):
    """Maps pre-tokens to their ids, packed as 32-bit integers."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = dict(enumerate(byte_chars()))
        self.held = 0

    def pack(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each list of pre-tokens in order; those not held yet are encoded in one call."""
        if self.held >= CACHE_BYTES:
            self.clear()
            self.held = 0
        new = [token for token in set().union(*texts) if token not in self]
        long: dict[str, bytes] = {}  # of these texts only
        if new:
            mapped = [token.encode().decode("latin-1").translate(self.table) for token in new]
            for token, ids in zip(new, self.processor.encode(mapped, num_threads=1)):
                packed = struct.pack(f"={len(ids)}i", *ids)
                if len(token) > LONGEST:
                    long[token] = packed
                else:
                    self[token] = packed
                    self.held += ENTRY_BYTES + len(token) + len(packed)
        if not long:
            return [b"".join(map(self.__getitem__, tokens)) for tokens in texts]
        return [b"".join(long[token] if token in long else self[token] for token in tokens) for tokens in texts]


#: The encoder of a worker, by the digest of its model.
_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(model) -> Encoder:
    key = hashlib.sha256(model.value).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model.value)
    return _ENCODERS[key]


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the column ``ids`` (array of int): the token ids of ``text``, each match of ``pattern`` encoded separately.

    With a name for ``decoded``, that column is added too, as ``decode`` makes it of the ids: one
    worker a task does both then.
    """
    spark = df.sparkSession
    ranks = read_ranks(ranks_path)
    model = spark.sparkContext.broadcast(serialize_model(ranks))
    tokens = spark.sparkContext.broadcast(ranks) if decoded is not None else None
    kept = [f for f in df.schema.fields if f.name not in (ids, decoded)]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *([T.StructField(decoded, T.BinaryType())] if decoded is not None else [])]
    schema = T.StructType([*kept, *added])
    place = [f.name for f in kept].index(text) if text in [f.name for f in kept] else None
    source = df.select(*(F.col(f"`{f.name}`") for f in kept), *([] if place is not None else [F.col(f"`{text}`").alias("_text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, known = regex.compile(pattern).findall, _encoder(model)
        for batch in slices(batches):
            column = batch.column(len(kept) if place is None else place)
            packed: list[bytes] = []
            waiting: list[list[str]] = []
            size = 0
            for value in column:
                text = value.as_py() or ""
                waiting.append(split(text))
                size += len(text)
                if size >= AT_ONCE:
                    packed += known.pack(waiting)
                    waiting, size = [], 0
            packed += known.pack(waiting)
            offsets = [0, *itertools.accumulate(len(row) // 4 for row in packed)]
            at = offsets[-1]
            flat = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(packed))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            made = [lists]
            if tokens is not None:
                bytes_of = tokens.value.__getitem__
                made.append(pa.array([b"".join(map(bytes_of, array("i", row))) for row in packed], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=schema.names)

    return source.mapInArrow(trimmed(run), schema)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the column ``decoded`` (binary): the bytes that ``ids`` stand for."""
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kept = [f for f in df.schema.fields if f.name != decoded]
    schema = T.StructType([*kept, T.StructField(decoded, T.BinaryType())])
    place = [f.name for f in kept].index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokens.value
        for batch in slices(batches):
            column = batch.column(place)
            out = [b"".join(map(table.__getitem__, value.values.to_pylist() if value.is_valid else ())) for value in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*(f.name for f in kept), decoded])

    return df.select(*(F.col(f"`{f.name}`") for f in kept)).mapInArrow(run, schema)


def digests(df: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Count and hex digests of the ids and of the decoded bytes."""
    return df.select(
        F.col(key),
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
