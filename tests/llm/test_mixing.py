import collections
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, spread

SCHEMA = "doc_id long, text string, source string, lang string"


def by_rounds(sizes, weights, share=1.5, most=2):
    """Targets as the contract words them: share out, cut at the cap, share the excess again."""
    total = share * sum(sizes)
    fixed = {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight > most * sizes[i]]
        if not over:
            return [fixed.get(i, left * weights[i] / weight if i in free else 0) for i in range(len(sizes))]
        for i in over:
            fixed[i] = most * sizes[i]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 50, 7, 300], [0, 5, 0, 9], [1000, 1, 1, 1, 1, 1, 1], [3]])
def test_targets(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    expected = by_rounds(sizes, [[5, 2, 1][i % 3] for i in range(len(sizes))])
    assert [found[n] for n in names] == pytest.approx(expected)


def test_mix_meets_targets_and_limits(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), None if i % 3 == 0 else f"s{i % 3}", "x") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs, bucket_rows=16).collect()
    assert len(mixed) == 600
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in mixed)
    source = {r[0]: r[2] for r in rows}
    for name in {None, "s1", "s2"}:
        own = [r for r in mixed if source[r["doc_id"]] == name]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 7
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    assert sum({source[r["doc_id"]]: r["target"] for r in mixed}.values()) == pytest.approx(1.5 * sum(r["size"] for r in mixed))
    again = mixing.mix(docs.repartition(7), bucket_rows=500).collect()
    assert {r["doc_id"]: r["copies"] for r in again} == {r["doc_id"]: r["copies"] for r in mixed}
    taken = mixing.mixed_rows(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in taken} == {r["doc_id"]: r["copies"] for r in mixed if r["copies"]}


def test_defined_results(spark):
    rows = [(None, None, None, "x"), (1, "", "a", "x"), (2, "one two", "a", "x"), (2, "one two", "a", "x"), (3, "x" * 100000, "b", None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.lit(1)).withColumn("target", F.lit(2))
    found = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in found) == [(0, 0), (1, 0), (2, 2), (2, 2), (3, 1)]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mixing.mixed_rows(spark.createDataFrame([], SCHEMA)).columns == ["doc_id", "text", "source", "lang"]


def test_mixed_rows_of_repeated_and_null_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(["w"] * rng.randint(1, 3)), rng.choice([None, "a", "b"]), rng.choice("xy")) for _ in range(120)]
    rows += [(7, "the same row", "a", "x")] * 50 + [(i, f"text {i}", "c", "x") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs).collect()
    found = mixing.mixed_rows(docs)
    taken = collections.Counter(tuple(r) for r in found.collect())
    by_id = collections.Counter()
    for row, n in taken.items():
        by_id[row[0]] += n
    expected = collections.Counter()
    for r in mixed:
        expected[r["doc_id"]] += r["copies"]
    assert found.columns == docs.columns and by_id == +expected
    assert all(n <= 2 * rows.count(row) for row, n in taken.items())
    words = collections.Counter()
    for row, n in taken.items():
        words[row[2]] += n * len(row[1].split())
    targets = {r["source_size"]: r["target"] for r in mixed}
    sizes = collections.Counter()
    for row in rows:
        sizes[row[2]] += len(row[1].split())
    assert all(abs(words[s] - targets[sizes[s]]) <= 3 for s in sizes)


def test_mixed_rows_with_clashing_names_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(spread, "MOST_HOT", 1)
    monkeypatch.setattr(spread, "LEAST_HOT", 3)
    rows = [(i, "w " * (1 + i % 5), f"s{i % 40 if i % 3 else 0}", "x") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_copies", F.lit(1)).withColumn("_copy", F.lit(1)).withColumn("mine", F.lit(1)).withColumn("at", F.lit(1)).withColumn("name", F.lit(1))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    found = mixing.mixed_rows(docs)
    assert found.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in found.collect()) == {i: n for i, n in copies.items() if n}


def test_repeated_rows_take_part_of_an_entry(spark):
    rows = [(1, "same", "a", "x"), (1, "same", "a", "x"), (1, "same", "a", "x"), (2, "more words", "b", "x")]
    found = mixing.mixed_rows(spark.createDataFrame(rows, SCHEMA))
    taken = collections.Counter(r["doc_id"] for r in found.collect())
    targets = {r["source_size"]: r["target"] for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert abs(taken[1] - targets[3]) <= 0.5 and abs(2 * taken[2] - targets[2]) <= 1


def test_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "a", "x") for i in range(30)], SCHEMA)
    plan = mixing.mixed_rows(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
