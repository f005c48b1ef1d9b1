"""Jobs that go on in a second run: late rows, repeated keys, older updates."""

import datetime as dt

from pyspark.sql import functions as F

from panelscope.streaming import jobs as T
from panelscope.streaming.parts import Parts

EVENTS = "id bigint, request_time timestamp, machine_no string, ai_judgment string, pnl_id string"


def at(hour, minute=0):
    return dt.datetime(2026, 4, 1 + hour // 24, hour % 24, minute, tzinfo=dt.timezone.utc)


def land(spark, folder, no, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{no}")


def source(spark, folder, schema=EVENTS):
    return spark.readStream.schema(schema).parquet(f"{folder}/*")


def test_shifts_go_on_and_count_late_rows(spark, tmp_path):
    data, job = str(tmp_path / "in"), str(tmp_path / "job")
    land(spark, data, 1, [(1, at(9), "m", "OK", "a"), (2, at(10), "m", "NG", "b")])
    T.run_state(T.stream_shift(source(spark, data)), "t", ["shift_start"], job)
    land(spark, data, 2, [(3, at(11), "m", "ERR:x", "c"), (4, at(40), "m", "OK", "d")])
    T.run_state(T.stream_shift(source(spark, data)), "t", ["shift_start"], job)
    land(spark, data, 3, [(5, at(1), "m", "NG", "late"), (6, at(41), "m", "OK", "e")])
    done = T.run_state(T.stream_shift(source(spark, data)), "t", ["shift_start"], job)
    rows = {r["shift_start"].hour + 24 * (r["shift_start"].day - 1): (r["total"], r["ng"], r["err"]) for r in T.latest_state(spark, done).collect()}
    assert rows == {8: (3, 1, 1), 32: (2, 0, 0)} and done.late == 1


def test_import_ignores_stored_keys_for_ever(spark, tmp_path):
    data, job = str(tmp_path / "in"), str(tmp_path / "job")
    land(spark, data, 1, [(2, at(9), "m", "OK", "a"), (1, at(9), "m", "NG", "a"), (3, at(9), "m", "OK", "b")])
    T.run_import(source(spark, data), "t", folder=job)
    land(spark, data, 2, [(4, at(9), "m", "OK", "a"), (5, at(90), "m", "OK", "a")])
    T.run_import(source(spark, data), "t", folder=job)
    land(spark, data, 3, [(6, at(90), "m", "OK", "a"), (7, at(2), "m", "OK", "old but new")])
    done = T.run_import(source(spark, data), "t", folder=job)
    assert sorted(r["id"] for r in T.table_of(spark, f"{done.folder}/rows").collect()) == [1, 3, 5, 7]


def test_upsert_keeps_the_last_change_and_all_history(spark, tmp_path):
    schema = "key bigint, change_no bigint, value double, deleted int"
    data, job = str(tmp_path / "in"), str(tmp_path / "job")
    target = spark.createDataFrame([(1, 0.5), (2, 0.7)], "key bigint, value double")
    run = lambda: T.run_upsert(source(spark, data, schema), "t", target, ["key"], "value", job)
    land(spark, data, 1, [(1, 1, 1.0, 0), (1, 2, 2.0, 0), (3, 3, 3.0, 0)], schema)
    run()
    land(spark, data, 2, [(1, 4, 2.0, 0), (2, 5, 0.0, 1)], schema)
    done = run()
    assert sorted(map(tuple, T.latest_state(spark, done).select("key", "value").collect())) == [(1, 2.0), (3, 3.0)]
    history = {r["change_no"]: (r["key"], r["old_value"], r["new_value"]) for r in T.table_of(spark, f"{job}/history").collect()}
    assert history == {1: (1, 0.5, 1.0), 2: (1, 1.0, 2.0), 3: (3, None, 3.0), 4: (1, 2.0, 2.0), 5: (2, 0.7, None)}


def test_duplicates_look_at_all_files_of_a_panel(spark, tmp_path):
    schema = "dir string, name string, mtime bigint"
    data, job = str(tmp_path / "in"), str(tmp_path / "job")
    land(spark, data, 1, [("p", "G0_000001.tif", 1), ("p", "W0_000001.tif", 1), ("q", "G0_000001.tif", 1)], schema)
    T.run_duplicates(source(spark, data, schema), "t", 3, job)
    land(spark, data, 2, [("p", "G0_000002.tif", 2), ("p", "W0_000002.tif", 2)], schema)
    done = T.run_duplicates(source(spark, data, schema), "t", 3, job)
    assert sorted(map(tuple, T.latest_panels(spark, done).select("dir", "name", "duplicated").collect())) == [
        ("p", "G0_000002.tif", True), ("p", "W0_000002.tif", True), ("q", "G0_000001.tif", False)
    ]


def test_requests_keep_bad_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("AOI@G1;M;MACH1401;1920,1080;OK;//srv/x\nrubbish\n")
    done = T.run_append(T.stream_requests(spark, str(tmp_path / "in")), "t", str(tmp_path / "job"))
    rows = T.table_of(spark, f"{done.folder}/rows").collect()
    assert sorted((r["glass_id"] or "", r["error"] or "") for r in rows) == [("", "bad_prefix"), ("G1", "")]


def test_no_table_before_the_first_batch(spark, tmp_path):
    assert T.table_of(spark, str(tmp_path / "none")) is None


def test_late_rows_are_a_table(spark, tmp_path):
    data, job = str(tmp_path / "in"), str(tmp_path / "job")
    for no, rows in enumerate([[(1, at(40), "m", "OK", "a")], [(2, at(1), "m", "NG", "late"), (3, None, "m", "OK", "no time")], [(4, at(39), "m", "NG", "b"), (5, at(2), "n", "OK", "late")]]):
        land(spark, data, no, rows)
        done = T.run_state(T.stream_machines(source(spark, data)), "t", ["hour", "machine_no"], job)
    assert sorted((r["id"], r["pnl_id"]) for r in T.late_rows(spark, done).collect()) == [(2, "late"), (5, "late")] and done.late == 1
    assert sorted(r["n"] for r in T.latest_state(spark, done).collect()) == [1, 1]


def test_many_batches_lose_no_late_row(spark, tmp_path):
    """More than the hundred batches that a query keeps its progress of."""
    data, job = str(tmp_path / "in"), str(tmp_path / "job")
    for no in range(104):
        rows = [(no, at(40 + no), "m", "OK", "a"), (1000 + no, at(1), "m", "NG", "late")][: 2 if no else 1]
        land(spark, data, f"{no:03}", rows)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{data}/*")
    done = T.run_state(T.stream_machines(stream), "t", ["hour", "machine_no"], job)
    assert done.late == 103 and T.late_rows(spark, done).select("id").distinct().count() == 103
    assert T.latest_state(spark, done).selectExpr("sum(n)").first()[0] == 104


CHANGES = "key bigint, change_no bigint, value double, deleted int"


def test_rows_stay_deleted(spark, tmp_path):
    data, job = str(tmp_path / "in"), str(tmp_path / "job")
    target = spark.createDataFrame([(1, 0.5), (2, 0.7)], "key bigint, value double")
    states = []
    for no, rows in enumerate([[(3, 1, 3.0, 0)], [(1, 2, 0.0, 1), (2, 3, 0.0, 1), (3, 4, 0.0, 1)], [(4, 5, 4.0, 0)], [(4, 6, 0.0, 1)], [(2, 7, 2.0, 0)]]):
        land(spark, data, no, rows, CHANGES)
        done = T.run_upsert(source(spark, data, CHANGES), "t", target, ["key"], "value", job)
        states.append(sorted(r["key"] for r in T.latest_state(spark, done).collect()))
    assert states == [[1, 2, 3], [], [4], [], [2]]


def test_a_batch_touches_the_parts_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    parts = Parts(spark, path, ["key"], 16)
    replace = lambda old, new: old.join(new.select("key"), "key", "left_anti").unionByName(new)
    parts.merge(spark.range(200).selectExpr("id AS key", "0 AS v"), 0, replace)
    before = parts._note(None)[0]
    one = spark.createDataFrame([(7, 1)], "key bigint, v int")
    assert 0 < parts.stored(one, 1).count() < 40
    parts.merge(one, 1, replace)
    after = parts._note(None)[0]
    assert sum(before[p] != after[p] for p in before) == 1
    assert {r["key"]: r["v"] for r in parts.table().collect()} == {i: int(i == 7) for i in range(200)}


def test_a_batch_that_failed_runs_again(spark, tmp_path):
    parts = Parts(spark, str(tmp_path / "t"), ["key"], 4)
    rows = lambda *r: spark.createDataFrame(list(r), "key bigint, v int")
    add = lambda old, new: old.unionByName(new).groupBy("key").agg(F.sum("v").cast("int").alias("v"))
    parts.merge(rows((1, 1), (2, 1), (3, 1)), 0, add, 5)
    # rows of batch 1 are written, its note is not
    parts._write(rows((1, 99), (9, 99)), 1)
    assert {r["key"]: r["v"] for r in parts.table().collect()} == {1: 1, 2: 1, 3: 1}
    for _ in range(2):
        parts.merge(rows((1, 1), (4, 1)), 1, add, 6)
    assert {r["key"]: r["v"] for r in parts.table().collect()} == {1: 2, 2: 1, 3: 1, 4: 1} and parts.note(2) == 6
    parts.merge(rows(), 2, add, 7)
    assert parts.table().count() == 4 and parts.note(3) == 7
