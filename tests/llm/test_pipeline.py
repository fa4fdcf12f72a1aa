"""The stages and the whole run against brute force on a small corpus."""

import collections
import hashlib
import re

import pytest

import corpus_pipeline
from tidemark.llm import mixing, quality

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def stage(spark, number, docs):
    return corpus_pipeline.STAGES[number][1](spark, docs, SF)


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def test_stages_in_order(spark, documents, tmp_path):
    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    before = rows(documents)
    assessed = rows(quality.assess(documents))
    docs = keep(stage(spark, 0, documents), "quality")
    found = rows(docs)
    assert docs.columns == documents.columns
    assert {i: r["text"] for i, r in found.items()} == {i: r["cleaned"] for i, r in assessed.items() if r["kept"]}
    assert all(r["n_chars"] == len(r["text"]) and r["source"] == before[i]["source"] for i, r in found.items())

    same = collections.defaultdict(list)
    for i, r in found.items():
        same[r["text"].translate(LOWER)].append(i)
    docs = keep(stage(spark, 1, docs), "exact")
    found = rows(docs)
    assert docs.columns == documents.columns and set(found) == {max(g) for g in same.values()}

    sets = {i: shingles(r["text"]) for i, r in found.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = keep(stage(spark, 2, docs), "near")
    found = rows(docs)
    assert docs.columns == documents.columns and set(found) == {i for i in sets if root(i) == i}

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    docs = keep(stage(spark, 3, docs), "mix")
    assert docs.columns == documents.columns
    assert collections.Counter(r["doc_id"] for r in docs.collect()) == {i: n for i, n in copies.items() if n}
    assert sum(copies.values()) > len(copies)

    last = stage(spark, 4, docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(last) == docs.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] > 0 for r in last)
    whole = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert whole == sorted(map(tuple, last))


def test_last_stage_takes_one_worker_a_task(spark, documents):
    plan = stage(spark, 4, documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_empty_documents(spark, documents):
    docs = documents.limit(0)
    for number in range(5):
        docs = stage(spark, number, docs)
    assert docs.collect() == []
