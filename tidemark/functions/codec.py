"""Canonical values, key tuples and changesets as bytes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type tags, and the polynomial of CRC-64/ECMA in reflected form.
NULL, INT, REAL, TEXT, BLOB = range(5)
ECMA = 0xC96C5795D7870F42


def canonical(value: Column, declared: str) -> Column:
    """``tag:text`` of a value by its declared type: integers and booleans, floats, bytes, and all else as text."""
    kind = declared.lower()
    if kind in ("smallint", "integer", "int", "bigint"):
        return F.concat(F.lit(f"{INT}:"), value.cast("string"))
    if kind in ("boolean", "bool"):
        return F.concat(F.lit(f"{INT}:"), value.cast("int").cast("string"))
    if kind in ("real", "double precision", "double"):
        return F.concat(F.lit(f"{REAL}:"), value.cast("double").cast("string"))
    if kind in ("bytea", "blob"):
        return F.concat(F.lit(f"{BLOB}:"), F.lower(F.hex(value)))
    return F.concat(F.lit(f"{TEXT}:"), value.cast("string"))


def encode_tuple(columns: Sequence[tuple[str, Column]]) -> Column:
    """Key bytes of integer columns: for each its 16-byte id, tag, length and big-endian value."""
    parts = [F.unhex(F.concat(F.md5(F.lit(name).cast("binary")), F.lit("0108"), F.lpad(F.hex(value.cast("long")), 16, "0"))) for name, value in columns]
    return F.concat(*parts)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _write_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def range_tuple(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(column id, tag, value bytes) of key bytes."""
    at = 0
    while at < len(data):
        column, tag = data[at : at + 16], data[at + 16]
        size, at = _read_varint(data, at + 17)
        yield column, tag, data[at : at + size]
        at += size


@F.pandas_udf(T.StringType())
def decode_tuple(blobs: pd.Series) -> pd.Series:
    """The values of integer key tuples, joined by commas."""
    return blobs.map(lambda blob: ",".join(str(struct.unpack(">q", value)[0]) for _, _, value in range_tuple(bytes(blob))))


def _remainders() -> np.ndarray:
    """The remainders of all bytes."""
    values = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        values = values >> np.uint64(1) ^ np.where(values & np.uint64(1), np.uint64(ECMA), np.uint64(0))
    return values


_TABLE = _remainders()
_ROWS = _TABLE.tolist()
_ALL = (1 << 64) - 1


def crc64(data: bytes) -> int:
    value = _ALL
    for byte in data:
        value = _ROWS[(value ^ byte) & 255] ^ value >> 8
    return value ^ _ALL


def crc64_many(values: Sequence[bytes]) -> list[int]:
    """The checksums of many values at once: one step for each place, over all values that are that long."""
    order = sorted(range(len(values)), key=lambda i: -len(values[i]))
    sizes = np.array([len(values[i]) for i in order], np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(values[i] for i in order), np.uint8)
    state = np.full(len(values), _ALL, np.uint64)
    for place in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -place, side="left"))  # values longer than this place come first
        state[:n] = _TABLE[(state[:n] ^ flat[starts[:n] + place]) & np.uint64(255)] ^ state[:n] >> np.uint64(8)
    out = [0] * len(values)
    for i, value in zip(order, (state ^ np.uint64(_ALL)).tolist()):
        out[i] = value
    return out


class Cell(NamedTuple):
    """A value of a column on the wire; null has no bytes."""

    column: bytes
    tag: int
    value: bytes = b""
    format: int = 0


class Record(NamedTuple):
    """A record on the wire: cells of inserts and updates, ranges (offset, bytes) of one column of patches."""

    op: str
    table: bytes
    pk: bytes
    cl: int
    cells: tuple[Cell, ...] = ()
    column: bytes = b""
    ranges: tuple[tuple[int, bytes], ...] = ()


class Changeset(NamedTuple):
    """One transaction of one writer; deps are (chain, seq) in order of their chain."""

    origin: int
    seq: int
    hlc: int
    records: tuple[Record, ...] = ()
    deps: tuple[tuple[int, int], ...] = ()
    cluster: bytes = bytes(16)


#: Fixed values of the wire: versions (the first is only read), the codes of operations, sizes of the header and of a dep, and the tag of null in the first version.
V1, V2 = 1, 2
OPS = {"I": 1, "U": 2, "D": 3, "P": 4}
HEADER, DEP, V1_NULL = 42, 10, 5


def frame(change: Changeset) -> tuple[bytes, bytes]:
    """What stands before the checksum, and what stands behind it."""
    if len(change.deps) > 255:
        raise ValueError("too many deps")
    head = struct.pack(">BQQQ16sB", V2, change.origin, change.seq, change.hlc, change.cluster, len(change.deps))
    head += b"".join(struct.pack(">HQ", *dep) for dep in sorted(change.deps))
    body = bytearray()
    for record in change.records:
        body.append(OPS[record.op])
        body += record.table + _write_varint(len(record.pk)) + record.pk + _write_varint(record.cl)
        if record.op == "P":
            body += record.column + _write_varint(len(record.ranges))
            for offset, data in record.ranges:
                body += _write_varint(offset) + _write_varint(len(data)) + data
            continue
        body += _write_varint(len(record.cells))
        for cell in record.cells:
            body += cell.column + struct.pack(">IB", cell.tag, cell.format)
            if cell.tag != NULL:
                body += _write_varint(len(cell.value)) + cell.value
    return head, _write_varint(len(body)) + bytes(body)


def encode(change: Changeset) -> bytes:
    head, tail = frame(change)
    return head + struct.pack(">Q", crc64(head + tail)) + tail


class _Reader:
    """Bytes read in order; running out of them is a ValueError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        found = self.data[self.at : self.at + n]
        if len(found) < n:
            raise ValueError("the bytes end early")
        self.at += n
        return found

    def numbers(self, layout: str) -> tuple:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))

    def varint(self) -> int:
        value = shift = 0
        while True:
            (byte,) = self.take(1)
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    def sized(self) -> bytes:
        return self.take(self.varint())


def _covered(data: bytes) -> tuple[bytes, int]:
    """The bytes that the checksum of a changeset is over, and that checksum."""
    if len(data) < HEADER + 8:
        raise ValueError("the bytes end early")
    at = HEADER + DEP * data[HEADER - 1]
    if len(data) < at + 8:
        raise ValueError("the bytes end early")
    return data[:at] + data[at + 8 :], struct.unpack(">Q", data[at : at + 8])[0]


def _cell(read: _Reader, version: int) -> Cell:
    column = read.take(16)
    if version == V1:
        (tag,) = read.take(1)
        if tag == V1_NULL:
            return Cell(column, NULL)
        if tag not in (INT, REAL, TEXT, BLOB):
            raise ValueError("unknown type")
        return Cell(column, tag, read.sized())
    tag, form = read.numbers(">IB")
    return Cell(column, tag, b"" if tag == NULL else read.sized(), form)


def decode(data: bytes, checksum: int | None = None) -> Changeset:
    """The changeset of these bytes; ValueError if they are damaged, cut off, of another version or too many. ``checksum``: what their checksum is, if known."""
    if not data or data[0] not in (V1, V2):
        raise ValueError("unknown version")
    covered, expected = _covered(data)
    if (crc64(covered) if checksum is None else checksum) != expected:
        raise ValueError("checksum does not match")
    read = _Reader(covered)
    version, origin, seq, hlc, cluster, count = read.numbers(">BQQQ16sB")
    deps = tuple(read.numbers(">HQ") for _ in range(count))
    body = _Reader(read.sized())
    if read.at != len(covered):
        raise ValueError("bytes behind the payload")
    names, records = {code: op for op, code in OPS.items()}, []
    while body.at < len(body.data):
        (code,) = body.take(1)
        if code not in names:
            raise ValueError("unknown operation")
        op, table, pk = names[code], body.take(16), body.sized()
        cl = body.varint()
        if op == "P":
            column = body.take(16)
            records.append(Record(op, table, pk, cl, (), column, tuple((body.varint(), body.sized()) for _ in range(body.varint()))))
            continue
        cells = tuple(_cell(body, version) for _ in range(body.varint()))
        if op == "D" and cells:
            raise ValueError("a delete carries no columns")
        records.append(Record(op, table, pk, cl, cells))
    return Changeset(origin, seq, hlc, tuple(records), deps, cluster)


def identity(name: str) -> bytes:
    """The 16-byte id of a column, table or cluster by its name."""
    return hashlib.md5(name.encode()).digest()


def _texts(names: Sequence[str], values: Sequence[str | None]) -> tuple[Cell, ...]:
    return tuple(Cell(identity(name), NULL) if value is None else Cell(identity(name), TEXT, value.encode()) for name, value in zip(names, values))


def pack_changeset(head: tuple[int, int, int], records: Sequence[tuple]) -> bytes:
    """The bytes of a changeset (origin, seq, hlc) with records (pk, cl, op, text cells by position)."""
    made = tuple(Record(op, identity("t"), struct.pack(">q", pk), cl, _texts([str(i) for i in range(len(cells))], cells)) for pk, cl, op, cells in records)
    return encode(Changeset(*head, made))


def unpack_changeset(data: bytes) -> tuple[tuple[int, int, int], list[tuple]]:
    """Head and records of :func:`pack_changeset`."""
    change = decode(data)
    text = lambda cell: None if cell.tag == NULL else cell.value.decode()
    return tuple(change[:3]), [(struct.unpack(">q", r.pk)[0], r.cl, r.op, tuple(map(text, r.cells))) for r in change.records]


def encode_changesets(log: DataFrame, table: str = "t", cluster: str = "cluster") -> DataFrame:
    """(origin, seq, hlc, payload): one changeset for each dot of records (pk, cl, op, a, b, n).

    Registers are carried as :func:`merge.carries` says; a column ``required_schema_seq`` becomes the dep on chain 0.
    """
    from tidemark.operators.merge import carries

    names = ("a", "b", "n")
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), ((F.col("op") != "D") & carries(log, c)).alias("there")) for c in names))
    need = F.col("required_schema_seq").cast("long") if "required_schema_seq" in log.columns else F.lit(None).cast("long")
    record = F.struct("pk", "cl", "op", F.filter(cells, lambda c: c["there"]).alias("cells"))
    grouped = log.groupBy("origin", "seq", "hlc").agg(F.max(need).alias("need"), F.array_sort(F.collect_list(record)).alias("records"))
    table_id, cluster_id = identity(table), identity(cluster)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            frames = []
            for origin, seq, hlc, need, records in rows.itertuples(index=False):
                made = tuple(Record(r["op"], table_id, struct.pack(">q", r["pk"]), r["cl"], _texts([c["name"] for c in r["cells"]], [c["value"] for c in r["cells"]])) for r in records)
                frames.append(frame(Changeset(origin, seq, hlc, made, () if pd.isna(need) else ((0, int(need)),), cluster_id)))
            sums = crc64_many([head + tail for head, tail in frames])
            yield rows[["origin", "seq", "hlc"]].assign(payload=[head + struct.pack(">Q", crc) + tail for (head, tail), crc in zip(frames, sums)])

    return grouped.mapInPandas(run, "origin long, seq long, hlc long, payload binary")


def decode_changesets(payloads: DataFrame) -> DataFrame:
    """(origin, seq, hlc, need, pk, cl, op, a, b, n, intact) of every record; damaged payloads give one row that is not intact."""
    names = {identity(c): c for c in ("a", "b", "n")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["origin", "seq", "hlc", "need", "pk", "cl", "op", "a", "b", "n", "intact"]
        for rows in batches:
            out, parts = [], []
            for payload in rows["payload"]:
                try:
                    parts.append(_covered(bytes(payload))[0])
                except ValueError:
                    parts.append(b"")
            for (origin, seq, hlc, payload), crc in zip(rows.itertuples(index=False), crc64_many(parts)):
                try:
                    change = decode(bytes(payload), crc)
                except ValueError:
                    out.append((origin, seq, hlc, *[None] * 7, False))
                    continue
                for r in change.records:
                    values = {names[c.column]: None if c.tag == NULL else c.value.decode() for c in r.cells if c.column in names}
                    out.append((change.origin, change.seq, change.hlc, dict(change.deps).get(0), struct.unpack(">q", r.pk)[0], r.cl, r.op, values.get("a"), values.get("b"), values.get("n"), True))
            yield pd.DataFrame(out, columns=columns).astype({"pk": "Int64", "cl": "Int64", "need": "Int64"})

    kinds = "origin long, seq long, hlc long, need long, pk long, cl long, op string, a string, b string, n string, intact boolean"
    return payloads.select("origin", "seq", "hlc", "payload").mapInPandas(run, kinds)
