"""Codec, predicates, ids, clocks and the schema log file backend."""

import random
import struct
import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.engine import MergeEngine
from tidemark.functions import clock, codec, ids, predicate
from tidemark.operators import audit, capture, catalog, frontier, placing, ranges, unique


def test_crc64_of_the_usual_check_text():
    assert codec.crc64(b"123456789") == 0x995DC9BBDF1939FA


def test_changeset_round_trip_and_damage():
    records = [(-5, 3, "U", ("é", None, "")), (7, 300, "D", ())]
    data = codec.pack_changeset((4, 1 << 40, 9), records)
    assert codec.unpack_changeset(data) == ((4, 1 << 40, 9), records)
    for i in range(len(data)):
        with pytest.raises(ValueError):
            codec.unpack_changeset(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])


def test_damaged_payload_is_one_marked_row(spark):
    good = codec.pack_changeset((1, 2, 3), [(1, 1, "I", ("a", "b", None))])
    rows = spark.createDataFrame([(1, 2, 3, bytearray(good)), (1, 3, 4, bytearray(good[:-1]))], "origin long, seq long, hlc long, payload binary")
    assert [r["intact"] for r in codec.decode_changesets(rows).orderBy("seq").collect()] == [True, False]


@pytest.mark.parametrize("text", ["a = 1 OR b IS NOT NULL AND NOT (c < 'x')", "a NOT IN (1, NULL, 2.5)", "((a <> 'it''s'))"])
def test_predicates_parse_and_render(text):
    tree = predicate.parse(text)
    assert predicate.parse(predicate.render(tree).replace("\\'", "''")) == tree


@pytest.mark.parametrize("text", ["a = b", "a", "a = 1 b", "lower(a) = 'x'", "a = 1 OR", "a BETWEEN 1 AND 2", "(a = 1"])
def test_other_predicates_are_refused(text):
    with pytest.raises(ValueError):
        predicate.parse(text)


def test_predicate_size_is_limited():
    with pytest.raises(ValueError):
        predicate.parse(" AND ".join(["a = 1"] * 200))


def test_nocase_is_ascii_only(spark):
    (row,) = spark.sql("SELECT 'ÀB' AS x").select(predicate.collate(F.col("x"), "NOCASE").alias("y")).collect()
    assert row["y"] == "Àb"


def test_uuid7(spark):
    found = [uuid.UUID(r["id"]) for r in ids.with_uuid7(spark.range(500).coalesce(1), "id").collect()]
    assert len(set(found)) == 500 and {u.version for u in found} == {7} and {u.variant for u in found} == {uuid.RFC_4122}
    assert [u.int >> 64 for u in found] == sorted(u.int >> 64 for u in found)


def test_clock_out_of_range_raises(spark):
    with pytest.raises(Exception, match="clock out of range"):
        spark.range(1).select(clock.pack(F.lit(-1), F.lit(0), checked=True)).collect()


def test_stamps_are_a_total_order():
    rng = random.Random(1)
    stamps = [(rng.randint(0, 3), rng.randint(0, 3), rng.randint(1, 3)) for _ in range(200)]
    packed = [((w << 16) + l, o) for w, l, o in stamps]
    assert [s for _, s in sorted(zip(packed, stamps))] == sorted(stamps)


def test_schema_log_is_compare_and_swap(spark, tmp_path):
    folder = f"file://{tmp_path}"
    event = {"kind": "create_table", "object_id": "t1", "name": "t"}
    assert catalog.append(spark, folder, 0, event)
    assert not catalog.append(spark, folder, 0, event)
    assert not catalog.append(spark, folder, 5, event)
    assert catalog.append(spark, folder, 1, event | {"kind": "drop_table"})
    log = catalog.read_log(spark, folder)
    assert [(r["schema_seq"], r["parent_seq"], r["kind"]) for r in log.collect()] == [(1, 0, "create_table"), (2, 1, "drop_table")]
    assert catalog.append(spark, folder, 2, event | {"kind": "explode_table"})
    with pytest.raises(Exception, match="unknown schema event"):
        catalog.read_log(spark, folder).collect()


def test_overlay_equals_bytes_written_one_by_one(spark):
    rng = random.Random(4)
    patches = []
    for _ in range(60):
        start = rng.randint(0, 40)
        patches.append((rng.randint(1, 2), start, start + rng.randint(1, 12), rng.randint(1, 30), rng.randint(1, 3)))
    expected = {}
    for pk, start, end, hlc, origin in patches:
        for i in range(start, end):
            expected[pk, i] = max(expected.get((pk, i), (0, 0)), (hlc, origin))
    rows = ranges.overlay(spark.createDataFrame(patches, "pk long, start long, end long, hlc long, origin long")).collect()
    found = {(r["pk"], i): (r["hlc"], r["origin"]) for r in rows for i in range(r["start"], r["end"])}
    assert found == expected
    ends = {(r["pk"], r["end"]): (r["hlc"], r["origin"]) for r in rows}
    assert all(ends.get((r["pk"], r["start"])) != (r["hlc"], r["origin"]) for r in rows)


def test_engine_surface(spark):
    log = spark.createDataFrame(
        [(1, 1, 10, 1, 1, "I", 1.0, "x", 2, 0), (1, 1, 10, 1, 1, "I", 1.0, "x", 2, 0), (2, 1, 20, 1, 1, "U", 5.0, None, 3, 1), (2, 3, 30, 2, 1, "U", 5.0, "q", None, 9)],
        "origin long, seq long, hlc long, pk long, cl long, op string, a double, b string, n long, required_schema_seq long",
    )
    engine = MergeEngine(spark, log, group="cell", schema_seq=5)
    engine.view("engine_rows")
    assert [tuple(r) for r in spark.sql("SELECT pk, a, b FROM engine_rows").collect()] == [(1, 5.0, "x")]
    assert [(r["pk"], r["total"]) for r in engine.counters().collect()] == [(1, 5)]
    assert engine.held.count() == 1
    tips = spark.createDataFrame([(1, 1), (2, 4)], "origin long, tip long")
    assert sorted((r["origin"], r["lo"], r["hi"]) for r in engine.missing(tips).collect()) == [(2, 2, 4)]
    assert {r["origin"]: r["lag"] for r in engine.health(tips).collect()} == {1: 0, 2: 3}
    with pytest.raises(ValueError):
        MergeEngine(spark, log, group="table")


@pytest.mark.parametrize("most", [2, None])
def test_quarantine_over_the_cap_halts_the_origin(spark, most):
    rows = [(o, seq, seq % 2 == 0) for o in (1, None) for seq in range(1, 301)] + [(2, 1, False), (2, 2, True), (2, 3, False)]
    records = spark.createDataFrame(rows, "origin long, seq long, bad boolean")
    outputs = audit.quarantine(records, F.when(F.col("bad"), "bad"), *([] if most is None else [most]))
    applied, aside, halted = (sorted(((r["origin"], r["seq"]) for r in df.collect()), key=str) for df in outputs)
    halt = 2 * ((most or 128) + 1)
    assert applied == sorted(((o, s) for o, s, bad in rows if not bad and (o == 2 or s < halt)), key=str)
    assert aside == sorted(((o, s) for o, s, bad in rows if bad and (o == 2 or s < halt)), key=str)
    assert halted == sorted(((o, s) for o, s, _ in rows if o != 2 and s >= halt), key=str)


def serial(claims, taken, held, fenced, servable, now):
    """The registry as one actor: transactions in order, each against the state the ones before left."""
    state, out = dict(taken), {}
    for txn in sorted({c[0] for c in claims}):
        batch, said = {}, "granted"
        for _, _, key, val, owner, prev in sorted(c for c in claims if c[0] == txn):
            hold = held.get(val)
            if key not in servable:
                said = "not serving"
            elif val in fenced or batch.get(val, owner) != owner:
                said = "conflict"
            elif val in state:
                said = said if state[val] in (owner, prev) else "conflict"
            elif hold and hold[0] != owner and hold[1] > now:
                said = "conflict"
            if said != "granted":
                break
            batch[val] = owner
        if said == "granted":
            state |= batch
        out[txn] = said
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reservations_equal_a_serial_registry(spark, seed):
    rng = random.Random(seed)
    claims = [(t, o, rng.choice("kkkx"), rng.randint(0, 12), rng.randint(1, 4), rng.choice([None, 1, 2])) for t in range(40) for o in range(rng.randint(1, 3))]
    # two transactions, then two owners in one, ask for a value that is free
    claims += [(100, 0, "k", 50, 1, None), (101, 0, "k", 50, 2, None), (102, 0, "k", 50, 2, 1), (103, 0, "k", 51, 1, None), (103, 1, "k", 51, 2, None), (104, 0, "k", 51, 4, None)]
    taken, held, fenced = {0: 1, 1: 2}, {2: (1, 500), 3: (2, 50)}, {4}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = unique.reserve(
        frame(claims, "txn long, ord int, key string, val long, owner long, prev long"),
        frame(list(taken.items()), "val long, owner long"),
        frame([(v, *h) for v, h in held.items()], "val long, owner long, until long"),
        frame([(v,) for v in fenced], "val long"),
        frame([("k",)], "key string"),
        now=100,
    ).collect()
    expected = serial(claims, taken, held, fenced, {"k"}, 100)
    assert {r["txn"]: r["outcome"] for r in found} == expected and all(r["granted"] == (r["outcome"] == "granted") for r in found)
    assert [expected[t] for t in range(100, 105)] == ["granted", "conflict", "granted", "conflict", "granted"]


def test_running_and_scan_equal_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), i, rng.choice([None, rng.randint(0, 99)]), rng.randint(1, 9)) for i in range(200)] + [(None, 500, 1, 1), (None, 501, 2, 2)]
    df = spark.createDataFrame(rows, "g string, at long, v long, n long").repartition(3)
    placed = placing.running(df, ["g", "at"], {"ahead": "n"}, ranges=7)
    expected, total = [], 0
    for place, (g, at, _, n) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])), 1):
        expected.append((at, place, total))
        total += n
    assert sorted((r["at"], r["place"], r["ahead"]) for r in placed.collect()) == sorted(expected)
    few = placing.running(df, ["g", "at"], {"ahead": "n"}, most=len(rows))
    assert sorted((r["at"], r["place"], r["ahead"]) for r in few.collect()) == sorted(expected)

    found = placing.scan(df, ["g"], ["at"], lags={"was": "v"}, maxes={"top": "v"}, sums={"ahead": "n"}, ranges=9)
    expected = []
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for i, r in enumerate(own):
            values = [x[2] for x in own[:i] if x[2] is not None]
            expected.append((r[1], own[i - 1][2] if i else None, max(values, default=None), sum(x[3] for x in own[:i])))
    assert sorted(map(str, ((r["at"], r["was"], r["top"], r["ahead"]) for r in found.collect()))) == sorted(map(str, expected))


def test_checksums_of_many_values():
    rng = random.Random(1)
    values = [rng.randbytes(rng.choice([0, 1, 5, 9, 300])) for _ in range(60)] + [b"123456789"]
    assert codec.crc64_many(values) == [codec.crc64(v) for v in values] and codec.crc64_many([]) == []


def test_rendered_predicates_are_sql(spark):
    rows = spark.createDataFrame([("", 1), ("'a'", 2), ("it's", 3), (None, 4)], "c string, i int")
    for text in ("", "'a'", "it's"):
        tree = ("=", "c", text)
        assert predicate.parse(predicate.render(tree)) == tree
        assert [r["i"] for r in predicate.participating(rows, tree).collect()] == [r["i"] for r in rows.collect() if r["c"] == text]
        assert duckdb.sql(f"SELECT {predicate.render(tree)} FROM (SELECT $1 AS c)", params=[text]).fetchall() == [(True,)]
    assert predicate.participating(rows, ("in", "c", ())).count() == 0 and predicate.participating(rows, ("not_in", "c", ())).count() == 4


def test_overlay_of_many_patches_on_one_key(spark):
    rng = random.Random(9)
    rows = [(1, s := rng.randint(0, 300), s + rng.randint(1, 80), rng.randint(0, 50), rng.randint(1, 3)) for _ in range(150)] + [(2, 5, 6, 1, 1)]
    found = ranges.overlay(spark.createDataFrame(rows, "pk long, start long, end long, hlc long, origin long")).collect()
    cover = {}
    for pk, start, end, hlc, origin in rows:
        for i in range(start, end):
            cover[pk, i] = max(cover.get((pk, i), (0, 0)), (hlc, origin))
    assert {(r["pk"], i): (r["hlc"], r["origin"]) for r in found for i in range(r["start"], r["end"])} == cover
    by = sorted((r["pk"], r["start"], r["end"], r["hlc"], r["origin"]) for r in found)
    assert all(not (a[0] == b[0] and a[2] == b[1] and a[3:] == b[3:]) for a, b in zip(by, by[1:]))


def test_fetch_plan_has_a_cap_for_each_kind(spark):
    held = spark.createDataFrame([(1, 1, 5), (2, 2, 3), (2, 6, 7), (2, 10, 11), (3, 1, 2)], "origin long, lo long, hi long")
    tips = spark.createDataFrame([(1, 9), (2, 20), (3, 9), (4, 3)], "origin long, tip long")
    coverage = spark.createDataFrame([(2, 1, 1), (2, 12, 13), (3, 50, 60)], "origin long, lo long, hi long")
    plan = lambda *more, **named: sorted((r["serveable"], r["place"], r["origin"], r["lo"], r["hi"]) for r in frontier.plan(held, tips, *more, **named).collect())
    assert plan(coverage, 10, own=1) == [(False, 1, 2, 4, 5), (False, 2, 2, 8, 9), (False, 3, 3, 3, 9), (False, 4, 4, 1, 3), (True, 1, 2, 1, 1), (True, 2, 2, 12, 20)]
    assert plan(coverage, 1, own=1) == [(False, 1, 2, 4, 5), (True, 1, 2, 1, 1)]
    assert all(r[0] for r in plan(None, 10)) and len(plan(None, 10)) == 7


def test_wire_format():
    column, table = codec.identity("c"), codec.identity("t")
    cells = (codec.Cell(column, codec.INT, struct.pack(">q", -3)), codec.Cell(codec.identity("d"), codec.NULL), codec.Cell(codec.identity("e"), 99, b"delta", 2))
    records = (codec.Record("I", table, b"key", 1, cells), codec.Record("D", table, b"", 300), codec.Record("P", table, b"k", 1, (), column, ((5, b"ab"), (1 << 40, b""))))
    change = codec.Changeset(7, 1 << 50, 9, records, ((0, 12), (3, 1)), codec.identity("cluster"))
    data = codec.encode(change)
    assert codec.decode(data) == change
    assert data[:42] == b"\x02" + struct.pack(">QQQ", 7, 1 << 50, 9) + codec.identity("cluster") + b"\x02" and data[42:62] == struct.pack(">HQHQ", 0, 12, 3, 1)
    for i in range(len(data)):
        with pytest.raises(ValueError):
            codec.decode(data[:i] + bytes([data[i] ^ 64]) + data[i + 1 :])
        with pytest.raises(ValueError):
            codec.decode(data[:i])
    # the first version: one byte of type, no format, 5 for null
    payload = b"\x01" + table + b"\x01k\x01\x02" + column + b"\x03\x02hi" + column + b"\x05"
    head, tail = b"\x01" + struct.pack(">QQQ", 1, 2, 3) + bytes(17), bytes([len(payload)]) + payload
    old = codec.decode(head + struct.pack(">Q", codec.crc64(head + tail)) + tail)
    assert old.records == (codec.Record("I", table, b"k", 1, (codec.Cell(column, codec.TEXT, b"hi"), codec.Cell(column, codec.NULL))),)


@pytest.fixture
def unlucky_ties(monkeypatch):
    """Rows that are equal in the order of a sort come out with those that begin nothing new first."""
    monkeypatch.setattr(ranges, "running", lambda df, order, **named: placing.running(df, [*order, "_new"], **named))


def test_equal_ranges_coalesce_in_any_order_of_the_sort(spark, unlucky_ties):
    rows = [(1, 0, 5), (1, 10, 15), (1, 10, 15), (1, 10, 15), (1, 20, 22), (1, 20, 22), (2, 10, 15), (2, 10, 15)]
    found = ranges.coalesce_ranges(spark.createDataFrame(rows, "pk long, start long, end long"), ["pk"])
    assert sorted((r["pk"], r["start"], r["end"]) for r in found.collect()) == [(1, 0, 5), (1, 10, 15), (1, 20, 22), (2, 10, 15)]


def test_discovered_coverage_holds_equal_files_in_any_order_of_the_sort(spark, unlucky_ties):
    files = spark.createDataFrame([(1, 1, 4), (1, 8, 9), (1, 8, 9), (1, 20, 30), (1, 20, 30), (2, 8, 9)], "origin long, lo long, hi long")
    tips, coverage = frontier.discover(files)
    assert sorted(map(tuple, coverage.collect())) == [(1, 1, 4), (1, 8, 9), (1, 20, 30), (2, 8, 9)]
    assert sorted(map(tuple, tips.collect())) == [(1, 30), (2, 9)]


def test_equal_intervals_merge_in_any_order_of_the_sort(spark, unlucky_ties):
    rows = [(1, 1, 4), (1, 5, 6), (1, 5, 6), (1, 8, 9), (1, 8, 9), (1, 8, 9), (1, 12, 12), (1, 12, 12)]
    found = frontier.merge_intervals(spark.createDataFrame(rows, "origin long, lo long, hi long"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 6), (1, 8, 9), (1, 12, 12)]


def records_shuffled(spark):
    context, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def layouts(columns, touches):
    found = []
    for touch in {t[0] for t in touches}:
        pairs = [(o, c) for _, tbl, seq in (t for t in touches if t[0] == touch) for t2, c, o, made, gone in columns if t2 == tbl and seq is not None and made <= seq and (gone is None or gone > seq)]
        found += [(touch, c, i) for i, (_, c) in enumerate(sorted(pairs), 1)]
    return sorted(found)


def test_layouts_of_touches(spark, monkeypatch):
    monkeypatch.setattr(capture, "PIECE", 3, raising=False)
    rng = random.Random(4)
    columns = [(rng.choice("ab"), i, 50 - i, rng.randint(0, 9), rng.choice([None, 5, 12])) for i in range(40)]
    # 30 and 31 touch twice, in one table and in two
    touches = [(i, rng.choice("abc"), rng.choice([None, -1, *range(12)])) for i in range(30)] + [(30, "a", 6), (30, "a", 6), (31, "a", 6), (31, "b", 3)]
    found = capture.layout_at(spark.createDataFrame(columns, "tbl string, col long, ordinal long, create_seq int, drop_seq int"), spark.createDataFrame(touches, "touch_id long, tbl string, schema_seq int"))
    assert sorted(map(tuple, found.collect())) == layouts(columns, touches)


def test_layouts_shuffle_no_pairs(spark):
    columns = spark.range(400).selectExpr("'a' AS tbl", "id AS col", "id AS ordinal", "0 AS create_seq", "cast(NULL AS INT) AS drop_seq")
    touches = spark.range(400).selectExpr("id AS touch_id", "'a' AS tbl", "1 AS schema_seq")
    before = records_shuffled(spark)
    assert len(capture.layout_at(columns, touches).collect()) == 160_000
    assert records_shuffled(spark) - before < 10_000


def test_a_chain_of_reservations_is_folded_in_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(unique, "CHUNK", 4, raising=False)
    monkeypatch.setattr(unique, "BLOCK", 20, raising=False)
    # each transaction asks for a value of the one before, so it is granted if that one is not
    claims = [(t, o, "k", t + o + 2, t, None) for t in range(30) for o in range(2)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    before = records_shuffled(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = unique.reserve(
            frame(claims, "txn long, ord int, key string, val long, owner long, prev long"),
            frame([(1, 9)], "val long, owner long"),
            frame([], "val long, owner long, until long"),
            frame([], "val long"),
            frame([("k",)], "key string"),
            now=100,
        ).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["txn"]: r["outcome"] for r in found} == serial(claims, {1: 9}, {}, set(), {"k"}, 100)
    assert records_shuffled(spark) - before < 1_500
