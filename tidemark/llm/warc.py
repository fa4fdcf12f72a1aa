"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id and payload digest. Prefix sums of their payload bytes (see
``placing``) cut the sorted records into shards of equal bytes, so the same table gives the same
shards on any cluster, however its ids lie. Each shard is sorted and written by one task, one
gzip member for each record, and rolls to a new file when the compressed size passes
``roll_bytes``. Headers and digests are made anew from the payload; a record whose payload
another record with a smaller id has is a revisit of it.

Files are written under temporary names of their own task attempt. The written files, their
sizes and digests are the rows of a manifest table; the commit renames the files that the
manifest lists, removes all other temporary ones, and last puts the manifest in place. A file
that has its name already must have the size and digest of the manifest. Readers take the
files that the manifest lists and no others, stream them, and check their sizes and digests.

The archive folder must be one that ``pyarrow.fs`` can write (a shared mount, HDFS, S3, GCS).

Defined results: a null html is an empty payload; a null page id sorts first; of repeated rows
with equal id and payload one is the response and the others revisit it; an empty table gives
an archive without files, which reads as an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.placing import running

from .spread import lookup
from .store import materialize, new_dir, slices

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
#: Payloads below this size are never revisits.
LEAST = 100
#: Payload bytes of a shard, and how many shards there are at most; larger tables get larger shards.
SHARD_BYTES, SHARDS = 8 << 20, 20_000
#: A shard goes on in a new file after this part of its payload bytes, unless a size is given.
ROLL_PART = 3
#: What a record has in bytes besides its payload.
HEAD_BYTES = 500


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _url(url: str | None) -> str:
    """A URL that keeps a header line whole."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record."""
    digest = hashlib.sha256(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": _url(url),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to)}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _ordered(page_id: Column, digest: Column) -> Column:
    return F.struct(page_id.isNotNull().alias("known"), F.coalesce(page_id, F.lit(0)).cast("long").alias("id"), digest.alias("digest"))


def _shards(thin: DataFrame, shard_bytes: int) -> tuple[Column, int, int]:
    """The shard of a row by its ``at``, the number of shards, and the payload bytes of one. At most ``SHARDS`` bounds reach the driver."""
    (total,) = thin.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    goal = max(shard_bytes, -(-total // SHARDS))
    placed = running(thin.select("at", "size"), ["at"], {"ahead": "size"})
    starts = placed.groupBy(F.floor(F.col("ahead") / goal).alias("s")).agg(F.min("at").alias("at")).select("at").distinct().sort("at").collect()
    bounds = [(r["at"]["known"], r["at"]["id"], r["at"]["digest"]) for r in starts]
    if len(bounds) < 2:
        return F.lit(0), 1, goal
    # a constant array, searched by halving: how many bounds are at or below a row
    kind = "array<struct<known:boolean,id:bigint,digest:string>>"
    table = F.from_json(F.lit(json.dumps([dict(zip(("known", "id", "digest"), b)) for b in bounds])), kind)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    found = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda below, step: F.when((below + step <= len(bounds)) & (F.get(table, below + step - 1) <= F.col("at")), below + step).otherwise(below),
    )
    return F.greatest(found - 1, F.lit(0)), len(bounds), goal


def write(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``folder``; returns the manifest."""
    content = F.coalesce(F.col("html"), F.lit(""))
    digest = F.sha2(content, 256)
    facts = pages.select("page_id", F.octet_length(content).alias("bytes"), digest.alias("digest"))
    thin = materialize(facts.select("*", _ordered(F.col("page_id"), F.col("digest")).alias("at"), (F.col("bytes") + HEAD_BYTES).cast("long").alias("size")), "warc-thin")
    known = F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))
    large = thin.filter(F.col("bytes") >= LEAST)
    firsts = large.groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).filter("n > 1")
    refers = lookup(large.select("page_id", "digest").distinct(), firsts, ["digest"], "n", thin.count())

    shard, shards, goal = _shards(thin, shard_bytes)
    roll = roll_bytes or max(1, goal // ROLL_PART)
    nothing = F.lit(None)
    rows = pages.select("page_id", "url", content.alias("html"), digest.alias("digest"), nothing.cast("long").alias("first"), F.lit(1).alias("kind"))
    rows = rows.unionByName(refers.select("page_id", nothing.cast("string").alias("url"), nothing.cast("string").alias("html"), "digest", "first", F.lit(0).alias("kind")))
    rows = rows.withColumn("at", _ordered(F.col("page_id"), F.col("digest"))).withColumn("shard", shard.cast("int")).drop("at")
    rows = rows.repartitionById(shards, "shard")
    rows = rows.sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    pending = f"{folder}/_pending"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(pending)
        place.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        files: list[tuple] = []
        out = None
        state: dict = {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                files.append((f"pages-{state['shard']:05d}-{state['part']:04d}.warc.gz", state["name"], state["size"], state["sha"].hexdigest(), state["records"]))
                out = None

        # rows of one id and digest follow each other, what they refer to comes before them
        current, original, written = None, None, False
        for batch in slices(batches):
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                page_id, url, html, digest, first, kind, number = row
                if current != (page_id, digest):
                    current, original, written = (page_id, digest), None, False
                if kind == 0:
                    original = first
                    continue
                smallest = None if original is None or original == -(1 << 63) else original
                revisit = original is not None and (smallest != page_id or written)
                written = True
                data = _member(record(page_id, url, html.encode(), smallest, revisit))
                if out is not None and (state["shard"] != number or state["size"] + len(data) > roll):
                    close()
                if out is None:
                    part = state["part"] + 1 if state.get("shard") == number else 0
                    name = f"{attempt}-{number:05d}-{part:04d}.tmp"
                    state = {"shard": number, "part": part, "name": name, "size": 0, "records": 0, "sha": hashlib.sha256()}
                    out = place.open_output_stream(f"{root}/{name}")
                out.write(data)
                state["size"] += len(data)
                state["records"] += 1
                state["sha"].update(data)
        close()
        columns = list(zip(*files)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "pending", "bytes", "sha256", "records"])

    manifest = materialize(rows.mapInArrow(run, "file string, pending string, bytes long, sha256 string, records long"), "warc-manifest")
    commit(manifest, folder)
    return manifest.drop("pending")


def _digest(path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file."""
    from pyarrow import fs

    place, root = fs.FileSystem.from_uri(path)
    size, digest = 0, hashlib.sha256()
    with place.open_input_stream(root, compression=None) as stream:
        while data := stream.read(1 << 20):
            size += len(data)
            digest.update(data)
    return size, digest.hexdigest()


def commit(manifest: DataFrame, folder: str) -> None:
    """Give the files of the manifest their names, drop other pending ones, then put the manifest in place."""
    spark = manifest.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    home = path(folder)
    files = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(home)
    lines = io.StringIO()
    for number, row in enumerate(manifest.orderBy("file").toLocalIterator()):
        target = path(f"{folder}/{row['file']}")
        if files.exists(target):
            if _digest(f"{folder}/{row['file']}") != (row["bytes"], row["sha256"]):
                raise OSError(f"{row['file']} is there with other content")
        elif not files.rename(path(f"{folder}/_pending/{row['pending']}"), target):
            raise OSError(f"cannot commit {row['file']}")
        lines.write(json.dumps({"number": number} | {k: row[k] for k in ("file", "bytes", "sha256", "records")}) + "\n")
    files.delete(path(f"{folder}/_pending"), True)
    pending = path(f"{folder}/.manifest.tmp")
    stream = files.create(pending, True)
    stream.write(bytearray(lines.getvalue().encode()))
    stream.close()
    if not files.rename(pending, path(f"{folder}/MANIFEST.jsonl")):
        raise OSError("cannot commit the manifest")


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped archive; one record is held at a time."""
    import gzip

    with gzip.GzipFile(fileobj=stream) as data:
        while line := data.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a record: {line[:40]!r}")
            head = {}
            while (line := data.readline().rstrip(b"\r\n")) != b"":
                name, _, value = line.decode().partition(":")
                head[name.strip()] = value.strip()
            yield head, data.read(int(head["Content-Length"]))


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


class _Checked(io.RawIOBase):
    """A stream that knows the size and digest of what was read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.digest = stream, 0, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        self.size += len(data)
        self.digest.update(data)
        return len(data)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record of the committed archive.

    Files must have the sizes, digests and numbers of records that the manifest says. Digests of
    response payloads are taken from the payload and must agree with the header.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path(f"{folder}/MANIFEST.jsonl")):
        raise FileNotFoundError(f"{folder} has no manifest")
    listed = spark.read.schema("number long, file string, bytes long, sha256 string, records long").json(f"{folder}/MANIFEST.jsonl")
    count = listed.count()
    if not count:
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    parts = min(count, SHARDS)
    source = listed.repartitionById(parts, (F.col("number") % parts).cast("int")).select("file", "bytes", "sha256", "records")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=names)

        for batch in batches:
            for name, size, sha256, records in zip(*(column.to_pylist() for column in batch.columns)):
                found = 0
                with place.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    checked = _Checked(stream)
                    for head, block in parse(io.BufferedReader(checked, 1 << 20)):
                        rows.append(_row(head, block))
                        found += 1
                        if len(rows) >= 4096:
                            yield made()
                            rows = []
                    while stream_left := stream.read(1 << 20):
                        checked.size += len(stream_left)
                if (checked.size, checked.digest.hexdigest(), found) != (size, sha256, records):
                    raise ValueError(f"{name} is not what the manifest says")
        yield made()

    return source.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _row(head: dict[str, str], block: bytes) -> tuple:
    """What :func:`read` gives for one record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
    if hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    size = len(payload)
    if kind != "response":
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    elif hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], size, digest, kind, _page(head.get("WARC-Refers-To"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into a new folder below the shared one and read the archive back."""
    folder = new_dir(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
