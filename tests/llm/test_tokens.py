import base64
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, token_count

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = [None, "", " ", "  \n\t x", "a▁b  c▁", "\x00\U0001f600ﬁé<s></s><unk> unknown <0x41>", "日本語テキスト" * 50, "x" * 50000, "don't  we'll 123 ---\r\n\r\n", " lead", "trail  "]


def texts(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(10000 + i, t) for i, t in enumerate(ODD)] + [(10001, "")]


def test_byte_bpe_equals_the_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = texts(spark)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    back = byte_bpe.decode(encoded, path).collect()
    found = sorted((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in back)
    assert found == sorted((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)


def test_decoding_in_the_same_pass(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame(texts(spark)[-60:], SCHEMA).withColumn("decoded", F.lit("clash"))
    both = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    apart = byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    rows = lambda df: sorted((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in df.collect())
    assert rows(both) == rows(apart)


def test_digests(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], SCHEMA)
    found = {r["doc_id"]: r for r in byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path, public_tokenizers.PATTERN), path)).collect()}
    ids = byte_bpe.encode(docs, path, public_tokenizers.PATTERN).filter("doc_id = 1").first()["ids"]
    assert found[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert (found[2]["n_tokens"], found[2]["ids_sha256"], found[2]["decoded_sha256"]) == (0, *[hashlib.sha256(b"").hexdigest()] * 2)


def test_model_bytes_read_as_written():
    model = byte_bpe.serialize_model([bytes([i]) for i in range(256)] + [b"ab", b" a"])
    assert struct.unpack("<f", dict(token_count._fields(next(v for n, v in token_count._fields(model) if n == 1)))[2])[0] == 0.0
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert processor.get_piece_size() == 259 and processor.encode("aab") == [97, 256]


def test_counts_equal_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = texts(spark)
    found = token_count.token_counts(spark.createDataFrame(rows, SCHEMA).withColumn("n_bytes", F.lit("clash")), path).collect()
    sizes = {t: len(reference.encode(t or "")) for _, t in rows}
    assert sorted(map(tuple, found)) == sorted((i, len((t or "").encode()), sizes[t], sizes[t] > 4096) for i, t in rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_count.token_counts(empty, public_tokenizers.path("piece_bpe_32k.model")).collect() == []
    assert byte_bpe.encode(empty, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect() == []


def test_caches_are_bounded_by_bytes(monkeypatch):
    counter = token_count.Counter({"a": 0, "aa": 1, "▁a": 2})
    for n in range(1, 400):
        assert token_count.count_text("a" * n, counter, False) == len(range(0, n, 2))
    assert all(len(segment) <= token_count.LONGEST for segment in counter) and counter.held < token_count.CACHE_BYTES
    monkeypatch.setattr(token_count, "CACHE_BYTES", 2000)
    for n in range(200):
        counter[f"x{n}"]
    assert len(counter) * token_count.ENTRY_BYTES <= 2000 + token_count.ENTRY_BYTES

    encoder = byte_bpe.Encoder(byte_bpe.serialize_model([bytes([i]) for i in range(256)] + [b"ab", b" a"]))
    texts = [["ab", "x" * 1000], ["ab", "y" * 500, " a"]]
    expected = [struct.pack("=1001i", 256, *[120] * 1000), struct.pack("=502i", 256, *[121] * 500, 257)]
    assert encoder.pack(texts) == expected and set(encoder) == {"ab", " a"}
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 1)
    assert encoder.pack(texts) == expected and encoder.held <= 2 * (byte_bpe.ENTRY_BYTES + 8)


def test_counts_of_two_models_are_kept_apart(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa ab")], SCHEMA).coalesce(1)
    counts = []
    for name, extra in (("one", [b"aa"]), ("two", [b"ab", b"aa", b" ab"])):
        model = byte_bpe.serialize_model([bytes([i]) for i in range(256)] + extra)
        path = tmp_path / name
        with open(path, "wb") as f:  # the counter asks for byte fallback, trainer field 35
            f.write(b"".join(byte_bpe._field(n, v) for n, v in token_count._fields(model) if n == 1))
            f.write(byte_bpe._field(2, byte_bpe._number(3, 2) + byte_bpe._number(35, 1)))
            f.write(byte_bpe._field(3, byte_bpe._field(1, b"identity") + byte_bpe._number(3, 0) + byte_bpe._number(4, 0)))
        counts.append(token_count.token_counts(docs, str(path)).first()["n_tokens"])
    assert counts[0] != counts[1]
