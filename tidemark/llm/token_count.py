"""Token counts of a sentencepiece BPE vocabulary, without making the tokens.

Byte-pair merging over a linked list of symbols with a heap of adjacent pairs: the pair whose
joined piece ranks lowest is merged first, the leftmost of equals. Every merge removes one
symbol, so the count is the number of initial symbols minus the number of merges; a character
the vocabulary lacks starts as its UTF-8 bytes.

No piece of the vocabulary may hold a space mark behind another character (checked when the
model is read), so merges never cross from a word into the mark that follows it, and each
``marks + word`` segment is counted on its own and remembered, up to a number of bytes; long
segments, as in texts without spaces, are counted anew each time.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated
rows; an empty table gives an empty table; all other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Bytes of the segments that a worker keeps counted, after which it starts anew, and characters of the longest one it keeps.
CACHE_BYTES, LONGEST = 64 << 20, 64
#: What an entry takes besides its characters.
ENTRY_BYTES = 160


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-size values as raw bytes."""
    at, end = 0, len(blob)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < end:
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            size = varint() if size is None else size
            yield tag >> 3, blob[at : at + size]
            at += size


def read_model(path: str) -> tuple[dict[str, int], bool]:
    """Ranks of the mergeable pieces (0 is merged first), and whether a space mark is put before the text.

    Raises ValueError for models this counter would count wrongly.
    """
    import struct

    with open(path, "rb") as f:
        model = list(_fields(f.read()))
    scores: dict[str, float] = {}
    fallback, kind, prefix, trim, name = False, 1, True, True, b""
    for number, value in model:
        if number == 1:
            piece = dict(_fields(value))
            sort = piece.get(3, 1)
            if sort in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
            if sort == 1:
                scores[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
        elif number == 2:
            trainer = dict(_fields(value))
            fallback, kind = bool(trainer.get(35, 0)), trainer.get(3, 1)
        elif number == 3:
            normal = dict(_fields(value))
            prefix, trim, name = bool(normal.get(3, 1)), bool(normal.get(4, 1)), normal.get(1, b"")
    if kind != 2 or not fallback or trim or name != b"identity":
        raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
    if any(MARK in piece[1:] and piece.strip(MARK) for piece in scores):
        raise ValueError("a piece holds a space mark behind another character")
    order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
    return {piece: order[score] for piece, score in scores.items()}, prefix


class Counter(dict):
    """Maps a segment to its number of tokens; counts what it does not hold yet."""

    def __init__(self, ranks: dict[str, int]):
        self.ranks = {piece.replace(MARK, " "): rank for piece, rank in ranks.items()}
        self.held = 0

    def __missing__(self, segment: str) -> int:
        count = self.merged(segment)
        if len(segment) <= LONGEST:
            if self.held >= CACHE_BYTES:
                self.clear()
                self.held = 0
            self[segment] = count
            self.held += ENTRY_BYTES + len(segment)
        return count

    def merged(self, segment: str) -> int:
        rank_of, push, pop = self.ranks.get, heapq.heappush, heapq.heappop
        symbols: list[str] = list(segment)
        size = len(symbols)
        shift = size.bit_length()
        mask = (1 << shift) - 1
        # a heap entry is the rank of a pair, then the place of its left symbol
        heap = [rank << shift | i for i, rank in enumerate(map(rank_of, map(str.__add__, symbols, symbols[1:]))) if rank is not None]
        heapq.heapify(heap)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        merges = 0
        while heap:
            top = pop(heap)
            left = top & mask
            right = after[left]
            if right >= size or not symbols[left]:
                continue
            joined = symbols[left] + symbols[right]
            if rank_of(joined) != top >> shift:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = joined, ""
            merges += 1
            following = after[left] = after[right]
            if following < size:
                before[following] = left
                rank = rank_of(joined + symbols[following])
                if rank is not None:
                    push(heap, rank << shift | left)
            previous = before[left]
            if previous >= 0:
                rank = rank_of(symbols[previous] + joined)
                if rank is not None:
                    push(heap, rank << shift | previous)
        if segment.isascii():
            return size - merges
        return sum(1 if c in self.ranks else len(c.encode()) for c in segment) - merges


_SEGMENTS = re.compile(r" *[^ ]+| +").findall
#: The counter of a worker, by the digest of its model.
_COUNTERS: dict[str, Counter] = {}


def count_text(text: str, counter: Counter, prefix: bool) -> int:
    """Tokens of one text."""
    if not text:
        return 0
    text = text.replace(MARK, " ")
    return sum(map(counter.__getitem__, _SEGMENTS(" " + text if prefix else text)))


def token_counts(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row."""
    with open(model_path, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    read = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    field = read.schema.fields[0]
    schema = T.StructType([field, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, prefix = model.value
        if digest not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[digest] = Counter(ranks)
        counter = _COUNTERS[digest]
        for batch in batches:
            counts = [count_text(value.as_py(), counter, prefix) for value in batch.column(1)]
            n_bytes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(counts, pa.int64())], names=[field.name, "n_bytes", "n_tokens"])

    return read.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
