"""Merges do not depend on order or repetition, and equal a sequential model of the rules."""

import random

import pandas as pd
import pytest

from tidemark.operators import audit, merge, storage
from tidemark.streaming import feed, hooks

SCHEMA = "origin long, seq long, hlc long, pk long, cl long, op string, a double, b string, n long"


def random_log(seed, origins=3, keys=3, records=40):
    rng = random.Random(seed)
    rows, seq = [], dict.fromkeys(range(1, origins + 1), 0)
    for _ in range(records):
        origin = rng.randint(1, origins)
        seq[origin] += 1
        cl = rng.randint(1, 4)
        op = "D" if cl % 2 == 0 else rng.choice("IU")
        a = float(rng.randint(0, 9)) if op != "D" and rng.random() < 0.6 else None
        b = rng.choice("xyz") if op != "D" and rng.random() < 0.6 else None
        n = rng.randint(-5, 5) if op != "D" and rng.random() < 0.6 else None
        # clocks of one origin advance, so stamps are unique
        rows.append((origin, seq[origin], (rng.randint(0, 5) + seq[origin] * 3) << 16, rng.randint(1, keys), cl, op, a, b, n))
    return rows


def model(rows):
    """One record after the other, as a replica applies them."""
    state, seen = {}, set()
    for origin, seq, hlc, pk, cl, _, a, b, n in rows:
        if (origin, seq) in seen:
            continue
        seen.add((origin, seq))
        row = state.setdefault(pk, {"cl": 0})
        if cl > row["cl"]:
            row = state[pk] = {"cl": cl}
        if cl < row["cl"]:
            continue
        for name, value in (("a", a), ("b", b)):
            if value is not None and (hlc, origin) > row.get(name, ((-1, -1), None))[0]:
                row[name] = ((hlc, origin), value)
        if n is not None:
            row["n"] = row.get("n", 0) + n
    return {pk: (r["cl"], r.get("a", (0, None))[1], r.get("b", (0, None))[1], r.get("n")) for pk, r in state.items() if r["cl"] % 2 == 1}


def merged(spark, rows):
    log = merge.once(spark.createDataFrame(rows, SCHEMA))
    cells = {r["pk"]: r for r in merge.merge_cells(log).collect()}
    totals = {r["pk"]: r for r in merge.merge_counters(log).collect()}
    return {pk: (r["cl"], r["a"], r["b"], None if totals[pk]["total"] is None else int(totals[pk]["total"])) for pk, r in cells.items()}


@pytest.mark.parametrize("seed", range(6))
def test_cells_and_counters_equal_the_model_in_any_order(spark, seed):
    rows = random_log(seed)
    rng = random.Random(seed)
    shuffled = rows + rng.sample(rows, 10)
    rng.shuffle(shuffled)
    assert model(rows) == model(shuffled) == merged(spark, shuffled)


def test_rows_keep_the_largest_generation_then_stamp(spark):
    rows = [(1, 1, 5, 1, 1, "I", 1.0, "x", None), (2, 1, 4, 1, 3, "I", 2.0, "y", None), (3, 1, 9, 1, 2, "D", None, None, None), (1, 2, 7, 2, 2, "D", None, None, None), (2, 2, 7, 3, 1, "I", 3.0, "z", None), (1, 3, 7, 3, 1, "U", 4.0, "w", None)]
    found = {r["pk"]: (r["cl"], r["a"], r["b"]) for r in merge.merge_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: (3, 2.0, "y"), 3: (1, 3.0, "z")}


def test_counter_overflow_is_found_in_any_order(spark):
    top = (1 << 63) - 1
    for rows in ([top, 5, -7], [5, -7, top], [top, 5]):
        log = spark.createDataFrame([(1, i, i, 1, 1, "U", None, None, n) for i, n in enumerate(rows)], SCHEMA)
        (row,) = merge.checked_counters(log).collect()
        assert row["outcome"] == ("merged" if sum(rows) <= top else "quarantined")
        assert row["total"] == (sum(rows) if sum(rows) <= top else None)


def test_stream_state_equals_batch(spark, tmp_path):
    rows = random_log(11, records=60)
    random.Random(3).shuffle(rows)
    late = rows + rows[:15]
    for i in range(4):
        spark.createDataFrame(late[i::4], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = []
    query = (
        feed.merged_stream(stream)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: out.extend(batch.collect()))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    last = {r["pk"]: (r["cl"], r["a"], r["b"], r["n"]) for r in out}
    assert {pk: row for pk, row in last.items() if row[0] % 2 == 1} == model(rows)


def test_incremental_versions_equal_batch(spark, tmp_path):
    rows = random_log(5, records=60)
    for i in range(3):
        spark.createDataFrame(rows[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    feed.incremental(spark, str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "checkpoint"), files_per_batch=1)
    last = sorted(p.name for p in (tmp_path / "state").iterdir())[-1]
    found = {r["pk"]: (r["a"], r["b"]) for r in merge.merge_cells(spark.read.parquet(str(tmp_path / "state" / last))).collect()}
    assert found == {pk: row[1:3] for pk, row in model(rows).items()}


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merge.merge_rows(empty).collect() == merge.merge_cells(empty).collect() == merge.merge_counters(empty).collect() == []


def test_upsert_writes_nulls(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(merge.upsert(now, new, "k", ["v"]).collect()) == [(1, "a"), (2, None), (3, "c")]


def test_pandas_na_is_not_a_value():
    assert not pd.notna(None)


def test_null_writes_win_like_any_value(spark):
    schema = "origin long, seq long, hlc long, tbl string, id long, cl long, op string, a double, a_present boolean, b string, b_present boolean, n long"
    rows = [
        (1, 1, 1, "t", 1, 1, "I", 1.0, True, "x", True, 5),
        (2, 1, 2, "t", 1, 1, "U", None, True, None, False, None),
        (1, 2, 1, "u", 1, 1, "I", 7.0, True, None, True, 1),
        (2, 2, 3, "u", 1, 2, "D", None, False, None, False, None),
        (3, 1, 1, "u", 2, 1, "I", 8.0, True, "z", True, 2),
    ]
    log, key = spark.createDataFrame(rows, schema), ["tbl", "id"]
    assert sorted(map(tuple, merge.merge_cells(log, key=key).collect())) == [("t", 1, 1, None, "x"), ("u", 2, 1, 8.0, "z")]
    states = {(r["tbl"], r["id"]): (r["cl"], r["base_hlc"], [tuple(c) for c in r["cells"]]) for r in merge.row_states(log, key=key).collect()}
    assert states == {("t", 1): (1, 1, [("a", 2, 2)]), ("u", 1): (2, 3, []), ("u", 2): (1, 1, [])}
    assert sorted(map(tuple, merge.merge_counters(log, key=key).select("tbl", "id", "total").collect())) == [("t", 1, 5), ("u", 2, 2)]


def test_conflicts_name_the_stamp_that_rules(spark):
    insert = (1, 1, 1, 1, 1, "I", 1.0, "x", None)
    disjoint = [insert, (2, 1, 5, 1, 1, "U", 2.0, None, None), (3, 1, 6, 1, 1, "U", None, "y", None)]
    lost = lambda rows, **more: sorted(tuple(r) for r in audit.conflicts(spark.createDataFrame(rows, SCHEMA), **more).collect())
    # both updates survive; the insert's cells are overruled by one writer each
    assert lost(disjoint) == [(1, 1, 1, "I", 2, 1, "concurrent", "a"), (1, 1, 1, "I", 3, 1, "concurrent", "b")]
    assert lost(disjoint[1:]) == []
    assert (1, 2, 1, "U", 3, 1, "concurrent", "a") in lost(disjoint, group="row")
    gone = [insert, (2, 1, 5, 1, 2, "D", None, None, None), (3, 1, 4, 1, 2, "D", None, None, None), (1, 2, 9, 1, 1, "U", 3.0, None, None)]
    assert lost(gone) == [(1, 1, 1, "I", 2, 1, "superseded", "a,b"), (1, 1, 2, "U", 2, 1, "superseded", "a"), (1, 3, 1, "D", 2, 1, "concurrent", "")]


def test_incremental_counters_equal_the_model(spark, tmp_path):
    rows = random_log(8, records=50)
    late = rows + rows[:20]
    for i in range(3):
        spark.createDataFrame(late[i::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    feed.incremental(spark, str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "checkpoint"), files_per_batch=1)
    last = sorted(p.name for p in (tmp_path / "state").iterdir())[-1]
    totals = {r["pk"]: r["total"] for r in merge.merge_counters(spark.read.parquet(str(tmp_path / "state" / last))).collect()}
    assert totals == {pk: row[3] for pk, row in model(rows).items()}
    dots = spark.read.parquet(str(tmp_path / "state-dots" / last)).collect()
    assert sorted((r["origin"], r["lo"], r["hi"]) for r in dots) == [(o, 1, max(r[1] for r in rows if r[0] == o)) for o in sorted({r[0] for r in rows})]


def test_batches_that_are_not_published_are_not_seen(spark, tmp_path):
    rows, journal = random_log(2), f"{tmp_path}/journal"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    told = []
    feed.drain(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")), journal, str(tmp_path / "cp"), lambda number, batch: told.append((number, batch.count())))
    spark.createDataFrame(rows[:3], SCHEMA).write.parquet(f"{journal}/batch=000007")
    assert told == [(0, len(rows))] and feed.published(spark, journal, SCHEMA).count() == len(rows)
    assert feed.published(spark, f"{tmp_path}/nothing", SCHEMA).collect() == []


def test_hooks_and_barriers(spark, tmp_path):
    import time

    rows = random_log(4)
    log = spark.createDataFrame(rows, SCHEMA)
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    calls = []
    listener = hooks.ApplyHooks(lambda name: calls.append(("start", name)), lambda name, batch, n: calls.append(("applied", name, batch, n)), lambda name, error: calls.append(("end", name, error)))
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log")).writeStream.queryName("apply").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        hooks.wait_applied(query)
        applied = lambda: spark.read.schema(SCHEMA).parquet(str(tmp_path / "out"))
        assert hooks.wait_replicated(applied, log, timeout=5)
        assert not hooks.wait_replicated(lambda: log.filter("seq <> 2"), log, timeout=0.1)
        query.stop()
        until = time.monotonic() + 20
        while len(calls) < 3 and time.monotonic() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert calls == [("start", "apply"), ("applied", "apply", 0, len(rows)), ("end", "apply", None)]


def test_journal_reads_only_what_is_asked_for(spark, tmp_path):
    log = spark.createDataFrame(random_log(6, records=80), SCHEMA)
    storage.write_epochs(log, str(tmp_path / "journal"), span=10)
    found = storage.read_epochs(spark, str(tmp_path / "journal"), origins=[2], low=5, high=12)
    assert sorted(map(tuple, found.select(*log.columns).collect())) == sorted(map(tuple, log.filter("origin = 2 AND seq BETWEEN 5 AND 12").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(origin" in plan or "PartitionFilters: [origin" in plan or "PartitionFilters: [(origin" in plan
    assert "GreaterThanOrEqual(seq,5)" in plan and "LessThanOrEqual(seq,12)" in plan
