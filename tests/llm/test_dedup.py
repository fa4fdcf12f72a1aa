import collections
import hashlib
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, ngram_join, spread, store, warc
from tidemark.llm.components import components
from tidemark.sources import workspace

SCHEMA = "doc_id long, text string"
LOWER = {c: c + 32 for c in range(65, 91)}


def test_exact_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["Alpha", "alpha", "beta", "É", "é", "ß" * 200]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "A" * 500 + "x"), (303, "a" * 500 + "X"), (304, "a" * 500 + "y")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("bytes", F.lit(2))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    expected = [(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g]
    assert sorted(map(tuple, exact_dedup.mark_duplicates(docs).collect())) == sorted(expected)
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(max(g) for g in groups.values())


def test_exact_dedup_ties_and_nulls(spark):
    rows = [(5, "Same"), (5, "same"), (4, "SAME"), (None, "same"), (None, "alone"), (None, None)]
    found = exact_dedup.mark_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    same = [r for r in found if r["group_size"] == 4]
    assert len(same) == 4 and {r["keep_id"] for r in same} == {5} and sum(r["kept"] for r in same) == 1
    assert all(r["kept"] and r["keep_id"] is None for r in found if r["group_size"] == 1)
    assert exact_dedup.mark_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_dedup_stage_decides_by_row(spark):
    rows = [(None, "copied"), (9, "Copied"), (None, "alone"), (None, None), (None, ""), (5, "one"), (5, "two"), (8, "ONE"), (4, "again"), (4, "Again"), (4, "again"), (3, "again"), (7, "own"), (7, "own")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("x")).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    kept = exact_dedup.without_duplicates(docs)
    found = collections.Counter((r["doc_id"], (r["text"] or "").translate(LOWER)) for r in kept.collect())
    assert kept.columns == docs.columns
    assert found == {(9, "copied"): 1, (None, "alone"): 1, (None, ""): 1, (5, "two"): 1, (8, "one"): 1, (4, "again"): 1, (7, "own"): 1}
    assert exact_dedup.without_duplicates(docs.limit(0)).collect() == []


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def joined(rows):
    """Components and links by comparing every pair."""
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for y in range(len(rows)):
        for x in range(y):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                parent[root(x)] = root(y)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    return sorted((key, len(sets[i]), least[root(i)], links[i]) for i, (key, _) in enumerate(rows))


def corpus(seed, families=6):
    """Families of edited copies that drift away from their first text, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(12)]
    texts = [None, "", " \n", "a", "A", "a b c", "A  B\tc", "a b c d"]
    for _ in range(families):
        text = [word() for _ in range(rng.randint(20, 80))] + passage
        for _ in range(rng.randint(1, 14)):
            texts.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = word()
    texts += [" ".join([word() for _ in range(8)] + passage) for _ in range(20)]
    keys = rng.sample(range(1000), len(texts))
    return list(zip(keys, texts))


@pytest.mark.parametrize("seed,settings", [(1, {}), (2, {"FREQUENT": 2}), (3, {"FREQUENT": 2, "BLOCK_SETS": 3}), (4, {"LONG": 2, "FREQUENT": 3, "BLOCK_SETS": 4})])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, seed, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("sig", F.lit("clash"))
    found = ngram_join.near_duplicates(docs)
    assert sorted(map(tuple, found.collect())) == joined(rows)


def test_frequent_shingles_are_as_many_as_fit(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 12)
    counts = {token: 1 for token in range(10_000)} | {token: 70 for token in range(10_000, 10_010)} | {7: 63, 8: 64}
    parts = [(0, list(counts), list(counts.values())), (0, [5], [1])]
    rows = [(part, bytearray(np.array(tokens, np.int64).tobytes()), bytearray(np.array(n, np.int32).tobytes())) for part, tokens, n in parts]
    packed = spark.createDataFrame(rows, "part int, tokens binary, counts binary")
    # a twelfth of all that were counted is 900, yet eleven shingles were counted 64 times or more
    assert ngram_join._frequent(packed).tolist() == [8, *range(10_000, 10_010)]
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 10)
    assert ngram_join._frequent(packed).tolist() == list(range(10_000, 10_010))
    monkeypatch.setattr(ngram_join, "MOST_FREQUENT", 9)
    assert ngram_join._frequent(packed).tolist() == []


@pytest.mark.parametrize("run", [ngram_join.near_duplicates, ngram_join.one_of_each])
def test_ngram_join_leaves_no_large_tables(spark, run):
    before = set(workspace._MADE)
    found = run(spark.createDataFrame(corpus(5), SCHEMA))
    made = [path for path in workspace._MADE if path not in before]
    left = {path.rpartition("/")[2].rpartition("-")[0] for path in made if os.path.exists(path.removeprefix("file://"))}
    assert len(made) > 10 and not left & {"ngram-survey", "ngram-often", "ngram-prefixes", "ngram-groups", "ngram-members", "ngram-lists", "ngram-pairs", "ngram-long", "ngram-ties", "ngram-expanded"}
    assert found.count() > 0


def test_scratch_tables_keep_no_shuffle_files(spark):
    files = lambda: {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    table = store.materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    assert table.count() == 7 and spark.conf.get(store._CLEANUP, "false") == "false"
    deadline = time.time() + 20
    while (left := {f for f in files() - before if f.endswith(".data")}) and time.time() < deadline:
        time.sleep(0.2)
    assert len(left) <= 1  # that of the count


def test_ngram_join_defined_results(spark):
    rows = [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, "A B C D E"), (9, None), (8, "z " * 30000)]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["n_links"]))
    assert by == {None: [(2, None, 0)], 7: [(2, 3, 2)] * 2, 3: [(2, 3, 2)], 9: [(0, 9, 0)], 8: [(1, 8, 0)]}
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    kept = ngram_join.one_of_each(spark.createDataFrame([(1, "a b"), (2, "A b"), (3, "c")], SCHEMA))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_ngram_join_of_an_id_with_several_texts(spark):
    long = lambda name, more: " ".join([f"{name}{i}" for i in range(60)] + more)
    rows = [(7, long("a", [])), (7, long("b", [])), (3, long("a", ["x"])), (5, long("b", ["y"])), (7, ""), (2, long("c", [])), (9, long("c", [])), (9, long("d", []))]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found)) == [(2, 57, 2, 1), (3, 58, 3, 1), (5, 58, 3, 1), (7, 0, 3, 0), (7, 57, 3, 1), (7, 57, 3, 1), (9, 57, 2, 0), (9, 57, 2, 1)]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(500, 500 + i) for i in range(1, 40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in parent} and len(found) == len(parent)


@pytest.mark.parametrize("path", [(1, 5, 3, 6, 2), (1, 5, 2, 6, 3), (2, 7, 4, 8, 1, 6, 3, 5)])
def test_components_of_a_path_alone(spark, path):
    found = components(spark.createDataFrame(list(zip(path, path[1:])), "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(x, min(path)) for x in sorted(path)]


def test_ngram_join_of_a_chain_alone(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(key, " ".join(words[8 * at : 8 * at + 103])) for at, key in enumerate((1, 5, 3, 6, 2))]
    expected = joined(rows)
    assert {r[2] for r in expected} == {1} and {r[0]: r[3] for r in expected} == {1: 1, 5: 2, 3: 2, 6: 2, 2: 1}
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.collect())) == expected


PAGES = "page_id long, url string, html string"


@pytest.fixture
def all_paths(monkeypatch):
    """Tables are too large to broadcast, and keys of two rows are hot."""
    monkeypatch.setattr(spread, "MOST_HOT", 1)
    monkeypatch.setattr(spread, "LEAST_HOT", 2)


def test_lookup_of_hot_and_cold_keys(spark, all_paths):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 9), (2, 1), (3, 2), (4, 30)) for i in range(n)], "k long, i long")
    table = spark.createDataFrame([(1, 9, "a"), (2, 1, "b"), (4, 30, "d")], "k long, n long, name string")
    expected = sorted((k, i, {1: "a", 2: "b", 4: "d"}.get(k)) for k, i in (tuple(r) for r in rows.collect()))
    found = spread.lookup(rows, table, ["k"], "n", 9, "left").select("k", "i", "name").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    inner = spread.lookup(rows, table, ["k"], "n", 9).select("k", "i", "name").collect()
    assert sorted(map(tuple, inner)) == [r for r in expected if r[2]]


def test_bitmap_lets_members_through(spark):
    rows = spark.range(2000).withColumn("h", F.xxhash64("id"))
    words = spread.bitmap(rows.filter("id % 40 = 0"), F.col("h"))
    found = spread.flagged(rows.withColumn("_slot", F.lit(1)), F.col("h"), words, "hit")
    assert found.columns == ["id", "h", "_slot", "hit"] and words.count() <= 50
    hits = {r["id"] for r in found.filter("hit").collect()}
    assert hits >= set(range(0, 2000, 40)) and len(hits) < 60


def test_components_with_hot_nodes(spark, all_paths):
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 130)] + [(130, 59), (300, 301)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, found)) == sorted([(i, 0) for i in range(60)] + [(i, 0) for i in range(100, 131)] + [(300, 300), (301, 300)])


@pytest.mark.parametrize("seed,settings", [(5, {"FREQUENT": 2, "LONG": 2, "BLOCK_GROUPS": 3, "BLOCK_SETS": 3}), (6, {"FREQUENT": 1, "LONG": 1, "BLOCK_GROUPS": 50}), (7, {"MOST_FREQUENT": 1})])
def test_ngram_join_by_its_other_paths(spark, monkeypatch, all_paths, seed, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed, families=4)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.collect())) == joined(rows)


def test_forest_connects_what_may_link():
    texts = [t for _, t in corpus(9, families=8) if len(shingles(t)) > 3]
    sets = [ngram_join.np.array(sorted({int.from_bytes(hashlib.sha256(repr(s).encode()).digest()[:8], "big") for s in shingles(t)}), ngram_join.np.uint64) for t in texts]
    prefixes = [ngram_join._ordered_prefix(s, ngram_join.np.empty(0, ngram_join.np.uint64), 85) for s in sets]
    shorts = [(p >> ngram_join.np.uint64(48)).astype(ngram_join.np.uint16) for p in prefixes]
    sizes = ngram_join.np.array([len(s) for s in sets])
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in ngram_join._forest(list(range(len(sets))), sizes, shorts, ngram_join.np.full(len(sets), 2), 85):
        parent[root(a)] = root(b)
    exact = [set(s.tolist()) for s in sets]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(exact[a] & exact[b]) >= 85 * len(exact[a] | exact[b])]
    assert linked and all(root(a) == root(b) for a, b in linked)
    assert len({root(x) for x in range(len(sets))}) >= 8  # the families stay apart


def test_ngram_join_of_ids_that_are_no_numbers(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("b", text), ("a", text + " x"), ("c", "other words of its own"), (None, text)]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [("b", 57, "a", 1), ("a", 58, "a", 1), ("c", 2, "c", 0), (None, 57, None, 0)]))


def test_near_stage_decides_by_row(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, "a b"), (1, "a b"), (1, "a b"), (2, "A b"), (7, base), (3, base + " x"), (7, other), (7, ""), (None, base), (4, None), (9, other + " y"), (9, other + " y")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_mine", F.lit(1)).withColumn("sig", F.lit("clash")).withColumn("Stays", F.lit("clash")).withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == sorted([("1", "a b"), ("3", base + " x"), ("7", other), ("7", ""), ("None", base), ("4", "")])
    assert ngram_join.one_of_each(docs.limit(0)).collect() == []


def test_exact_stage_with_clashing_names_and_hot_groups(spark, all_paths):
    rows = [(i % 5, f"Text {i % 3}") for i in range(60)] + [(None, "text 0")] * 3 + [(8, "alone")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("_mine", F.lit(1)).withColumn("_its", F.lit(1)).withColumn("key", F.lit(2)).withColumn("sha", F.lit(3))
    kept = exact_dedup.without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(4, "Text 0"), (4, "Text 1"), (4, "Text 2"), (8, "alone")]
    marked = exact_dedup.mark_duplicates(docs).collect()
    assert len(marked) == 64 and sum(r["kept"] for r in marked) == 4 and {r["group_size"] for r in marked} == {1, 20, 23}


def test_exact_dedup_shuffles_no_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(30)], SCHEMA)
    plan = exact_dedup.mark_duplicates(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan  # the last steps only read keys and hashes


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 200
    rows = [(5, "http://a/?b=c d\r\nX: y", big), (2, "http://b", big), (9, None, big), (1, "u", None), (3, "u", ""), (4, "v", "short"), (6, "v", "short"), (7, "w", "\r\n\r\nWARC/1.1\r\n" + "y" * 300), (8, "w", "z" * 400000)]
    rows += [(100 + i, "p", f"page {i} " * 50) for i in range(60)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("kind", F.lit("clash"))
    folder = warc.new_dir(spark, "warc-test")
    manifest = warc.write(pages, folder, shard_bytes=4000, roll_bytes=1000)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    found = sorted(tuple(r) for r in warc.read(spark, folder).drop("url").collect())
    sizes = {i: len((h or "").encode()) for i, _, h in rows}
    sums = {i: hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in rows}
    assert found == sorted((i, sizes[i], sums[i], "revisit" if i in (5, 9) else "response", 2 if i in (5, 9) else None) for i in sizes) or sorted(found, key=str) == sorted(
        ((i, sizes[i], sums[i], "revisit" if i in (5, 9) else "response", 2 if i in (5, 9) else None) for i in sizes), key=str
    )


def test_warc_is_deterministic(spark):
    rows = [(i, f"u{i}", f"page {i % 7} " * 40) for i in range(80)]
    sums = []
    for parts in (1, 5):
        manifest = warc.write(spark.createDataFrame(rows, PAGES).repartition(parts), warc.new_dir(spark, "warc-same"), shard_bytes=5000, roll_bytes=600)
        sums.append(sorted(tuple(r) for r in manifest.collect()))
    assert sums[0] == sums[1]


def test_warc_defined_results(spark):
    text = "same payload " * 20
    rows = [(1, "a", text), (1, "a", text), (None, "n", "q" * 150), (None, "n", "q" * 150), (2, "b", text)]
    found = warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in found)
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 1, (2, "revisit", 1): 1, (None, "response", None): 1, (None, "revisit", None): 1}
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_warc_shards_by_bytes_whatever_the_ids(spark):
    rows = [(i, f"u{i}", f"page {i} " * 60) for i in range(200)] + [(10**17, "far", "x" * 300), (None, "n", "y" * 300), (None, "n", "z" * 300)]
    manifest = warc.write(spark.createDataFrame(rows, PAGES), warc.new_dir(spark, "warc-far"), shard_bytes=10_000)
    shards = collections.Counter()
    for r in manifest.collect():
        shards[r["file"].split("-")[1]] += r["records"]
    assert len(shards) > 10 and max(shards.values()) < 40 and sum(shards.values()) == len(rows)


def test_warc_rolls_by_its_own_defaults(spark):
    rng = random.Random(1)
    rows = [(i, f"u{i}", "".join(chr(rng.randint(33, 126)) for _ in range(2000))) for i in range(100)]
    manifest = warc.write(spark.createDataFrame(rows, PAGES), warc.new_dir(spark, "warc-roll"), shard_bytes=100_000).collect()
    assert len({r["file"].split("-")[1] for r in manifest}) == 3 and len(manifest) > 6


def test_warc_reads_what_the_manifest_lists(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * 60) for i in range(9)]
    folder = f"file://{tmp_path}/a"
    warc.write(spark.createDataFrame(rows, PAGES), folder)
    (tmp_path / "a" / "stray.warc.gz").write_bytes(b"no archive")
    assert sorted(r["page_id"] for r in warc.read(spark, folder).collect()) == list(range(9))
    (name,) = (f for f in (tmp_path / "a").iterdir() if f.name.startswith("pages-"))
    data = name.read_bytes()
    name.write_bytes(data + warc._member(b""))
    with pytest.raises(Exception, match="not what the manifest says"):
        warc.read(spark, folder).collect()


def test_warc_commit_keeps_no_other_content(spark, tmp_path):
    (tmp_path / "pages-00000-0000.warc.gz").write_bytes(b"older")
    with pytest.raises(OSError, match="other content"):
        warc.write(spark.createDataFrame([(1, "u", "text")], PAGES), f"file://{tmp_path}")


def test_uncommitted_archives_are_not_read(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(b"")
    with pytest.raises(FileNotFoundError):
        warc.read(spark, f"file://{tmp_path}")
