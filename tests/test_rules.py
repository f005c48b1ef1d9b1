"""Literal cases of rules that are easy to get wrong."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelscope.operators import components as C
from panelscope.operators import learn as L
from panelscope.operators import maintain as R
from panelscope.operators import regions
from panelscope.operators import search as S
from panelscope.operators import verdict as V
from panelscope.operators.accuracy import miss_report
from panelscope.sources import manifests, store

PANEL = "found boolean, has_error boolean, is_duplicate boolean, dusty int, bombs int, max_score double, n_gt int, gt_in_tile int"


@pytest.mark.parametrize("panel, reason", [
    ((False, False, False, 1, 1, 0.9, 0, 0), "PANEL_NOT_FOUND"), ((True, True, True, 1, 1, 0.9, 0, 0), "INFERENCE_ERROR"),
    ((True, False, True, 1, 1, 0.9, 0, 0), "DUPLICATE_PANEL"), ((True, False, False, 1, 1, 0.9, 0, 0), "FILTERED_BY_DUST_AND_BOMB"),
    ((True, False, False, 2, 0, 0.9, 0, 0), "FILTERED_BY_DUST"), ((True, False, False, 0, 1, 0.1, 0, 0), "FILTERED_BY_BOMB"),
    ((True, False, False, 0, 0, 0.29, 1, 0), "MODEL_UNDETECTABLE"), ((True, False, False, 0, 0, 0.3, 1, 0), "THRESHOLD_TOO_HIGH"),
    ((True, False, False, 0, 0, 0.6, 1, 0), "GT_OUTSIDE_TILES"), ((True, False, False, 0, 0, 0.6, 1, 1), "THRESHOLD_TOO_HIGH"), ((True, False, False, 0, 0, 0.6, 0, 0), "THRESHOLD_TOO_HIGH"),
])
def test_miss_reason(spark, panel, reason):
    assert V.miss_reason(spark.createDataFrame([panel], PANEL)).first()["reason"] == reason


def test_miss_report_leaves_out_panels_not_found(spark):
    panels = [(True, 0.0), (True, 0.55), (True, 0.6), (False, 0.9)]
    df = spark.createDataFrame(panels, "found boolean, max_score double").withColumn("reason", F.lit("r"))
    got = {r["band"]: (r["panels"], r["at_50"], r["at_60"]) for r in miss_report(df).collect()}
    assert got == {"0": (1, 0, 0), "<.6": (1, 1, 0), ">=.6": (1, 1, 1)}


def test_manifest_is_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿label,sample_id,unknown\ntrue_ng,s1,x\n"two\nlines",s2,y\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("sample_id,status,label\ns1,ok,later\n", encoding="utf-8")
    rows = {r["sample_id"]: r for r in manifests.read_manifest(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()}
    assert rows["s1"]["label"] == "later" and rows["s1"]["status"] == "ok" and rows["s2"]["label"] == "two\nlines" and rows["s2"]["crop_path"] == ""


def test_error_text(spark):
    rows = spark.createDataFrame([(True, "ERR:X"), (True, "OK"), (False, "ERR:X"), (False, "NG")], "d boolean, j string")
    got = [r[0] for r in rows.select(store.error_text(F.col("d"), F.col("j"))).collect()]
    assert got == [f"{store.DUPLICATE_NOTE}\nERR:X", store.DUPLICATE_NOTE, "ERR:X", ""]


def test_many_children_keep_their_ids(spark):
    nested = spark.createDataFrame(
        [(1, "OK", False, [("i", 0, [(k, 0.5) for k in range(1200)], [])]), (2, "OK", False, [("i", 0, [(0, 0.5)], [])])],
        "id bigint, ai_judgment string, is_duplicate boolean, images array<struct<image_name:string,is_ng:int,tiles:array<struct<tile_id:int,score:double>>,edges:array<struct<side:string,area:int>>>>",
    )
    tiles = store.persist(nested)["tiles"]
    assert tiles.count() == tiles.select("id").distinct().count() == 1201


def test_parameter_history(spark):
    params = spark.createDataFrame([("a", "1", "int")], "name string, value string, tag string")
    changes = spark.createDataFrame([(1, "a", "2", "r"), (2, "a", "2", "again"), (3, "b", "true", ""), (4, "b", "1.5", "")], "change_no int, name string, value string, reason string")
    table, history = R.set_params(params, changes)
    assert sorted(map(tuple, table.collect())) == [("a", "2", "int"), ("b", "1.5", "bool")]
    assert [(r["change_no"], r["old_value"], r["new_value"]) for r in history.orderBy("change_no").collect()] == [(1, "1", "2"), (2, "2", "2"), (3, "", "true"), (4, "true", "1.5")]


def test_folds_fall_back_and_fail(spark):
    rows = [(f"g{i}", "x" if i % 2 else "y", "p" if i else "rare", "t") for i in range(20)]
    names = "glass string, label string, prefix string, source_type string"
    assert {r["stratum"] for r in L.group_folds(spark.createDataFrame(rows, names), 5).collect()} == {"x|t", "y|t"}
    with pytest.raises(ValueError):
        L.group_folds(spark.createDataFrame(rows[:6], names), 5)


def test_large_glasses_are_dealt_by_size(spark):
    from functools import reduce

    glasses = [spark.range((1 << 20) + 10 * i).selectExpr(f"'g{i}' AS glass", "'x' AS label", "'p' AS prefix", "'t' AS source_type") for i in range(6)]
    got = {r["glass"]: r["fold"] for r in L.group_folds(reduce(lambda a, b: a.union(b), glasses), 5).collect()}
    assert got == {"g5": 0, "g4": 1, "g3": 2, "g2": 3, "g1": 4, "g0": 0}


def test_rules_hold_for_their_model_only(spark):
    rules = spark.createDataFrame([(1, "m1", "G0", "c1", "point", [(10, 10)]), (2, "m2", "G0", "c2", "line", [(10, 0), (10, 100)])],
                                  "rule_no int, model_id string, image_prefix string, code string, kind string, coords array<struct<x:int,y:int>>")
    points = spark.createDataFrame([(1, "m1", "G0_1", 12, 12, True), (2, "m2", "G0_1", 12, 50, True), (3, "m2", "G0_1", 12, 50, False), (4, "m1", "G01", 12, 12, True), (5, "m3", "G0", 12, 12, True)],
                                   "id int, model_id string, stem string, px int, py int, is_line boolean")
    for name, v in (("rx1", 0), ("ry1", 0), ("rx2", 100), ("ry2", 100), ("pw", 100), ("ph", 100)):
        points = points.withColumn(name, F.lit(v))
    assert {r["id"]: r["bomb"] for r in regions.bomb_match(points, rules, 5).collect()} == {1: "c1", 2: "c2", 3: None, 4: None, 5: None}


def test_dust_without_response_is_real(spark):
    tiles = spark.createDataFrame([(1, 0, 5, False, False), (2, 0, 5, True, False), (3, 0, 5, True, True), (4, 1, 5, True, True), (5, 0, 0, True, True)],
                                  "id int, panel_overexposed int, tile_dust int, has_map boolean, has_positive boolean")
    regions_ = spark.createDataFrame([(3, 1, 0, -1, -1)], "id int, regions int, real_regions int, real_x int, real_y int")
    stages = spark.createDataFrame([], "id int, clean_features int, best_x int, best_y int")
    got = {r["id"]: r["decision"] for r in C.dust_decision(tiles, regions_, stages, ["id"]).collect()}
    assert got == {1: "dust:no_map", 2: "real:no_response", 3: "dust", 4: "real:overexposed", 5: "real:no_dust"}


def test_limits_are_refused_not_bent(spark):
    df = spark.createDataFrame([], "machine_judgment string, created_at timestamp_ntz, id bigint, model_id string")
    with pytest.raises(ValueError):
        S.ok_panels(df, "2026-04-30 00:00:00", days=9)
    with pytest.raises(ValueError):
        S.paged(df, limit=0)
    with pytest.raises(ValueError):
        R.set_threshold(df, "a", "b", 11)


def test_edits_by_line_leave_other_rows_of_a_sample_alone(spark):
    rows = [(1, "s", "over_surface_dirt", "g", "a/1.png"), (2, "s", "true_ng", "g", "a/2.png"), (3, "s", "over_other", "g", "a/3.png")]
    manifest = spark.createDataFrame(rows, "line_no long, sample_id string, label string, prefix string, crop_path string")
    edits = spark.createDataFrame([(1, "over_bubble"), (2, "nonsense"), (3, None)], "line_no long, new_label string")
    got = V.relabel(manifest, edits, ["over_bubble", "true_ng"], "line_no").collect()
    assert sorted((r["line_no"], r["label"], r["crop_path"]) for r in got) == [(1, "over_bubble", "over_bubble/g/crop/1.png"), (2, "true_ng", "a/2.png")]


def test_relabel_where_sample_ids_repeat(spark, tmp_path):
    """Two records of one customer whose numbers differ by 240 000 share their sample ids."""
    source = "/root/testdata/sf0.001"
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        table = spark.read.parquet(f"{source}/{name}.parquet")
        moved = table.withColumn(key, F.col(key) + 240_000)
        if name == "lineitem":  # other parts, so that labels differ
            moved = moved.withColumn("l_partkey", F.col("l_partkey") + 23).withColumn("l_returnflag", F.when(F.col("l_returnflag") == "A", "N").otherwise("A"))
        table.unionByName(moved).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()["V22_relabel"])
    columns = [c[0] for c in cur.description]
    got = entry.queries()["V22_relabel"](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_a_listing_is_not_broadcast(spark):
    rows = spark.createDataFrame([("s1", "b1", 1, "crop/1.png"), ("s2", "b1", 2, "crop/9.png")], "sample_id string, batch string, line_no long, crop_path string")
    files = spark.range(20).selectExpr("explode(array(concat('b1/crop/', cast(id % 5 AS string), '.png'), concat('b2/crop/', cast(id AS string), '.png'))) AS path")
    kept = manifests.merge_rows(rows, files)
    assert [r["sample_id"] for r in kept.collect()] == ["s1"]
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_marks_named_twice_are_made_once(spark):
    tiles = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "id long, scratch_filtered int")
    review = spark.createDataFrame([(2, 2, 1, "")], "id long, tile_result_id long, is_misrescue int, note string")
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "tile_result_id long")
    marked = R.mark(review, tiles, ids)
    assert sorted(r["tile_result_id"] for r in marked.collect()) == [1, 2]
    assert "Aggregate" not in marked._jdf.queryExecution().optimizedPlan().toString()


def test_manifest_rows_are_moved_once_and_read_narrow(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "x", "n1"), ("a", 2, "y", "n2"), ("b", 3, "z", "n3")], "sample_id string, line_no long, label string, glass_id string")
    last = manifests.last_rows(manifests.by_sample(rows), ["line_no"])
    assert last.orderBy("sample_id")._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    manifests.write_manifest(last, f"{tmp_path}/m")
    back = manifests.read_manifest(spark, f"{tmp_path}/m", ["sample_id", "label", "status"])
    assert sorted(map(tuple, back.collect())) == [("a", "y", ""), ("b", "z", "")] and back.columns == ["sample_id", "label", "status"]
    assert "glass_id" not in back._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_manifest_rows_are_moved_once(spark, tmp_path):
    """Ranges of the sample id serve the last row per id and the order of the files, packed or not."""
    rows = [(f"s{n % 40}" if n % 41 else None, n, f'a "{n}"\nb' if n % 3 else "") for n in range(120)]
    df = spark.createDataFrame(rows, "sample_id string, line_no int, label string")
    last = manifests.in_file_order(manifests.last_rows(manifests.by_sample(df), ["line_no"]))
    last.collect()
    plan = last._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    want = {}
    for sample, _, label in rows:
        want[sample] = label
    want.pop(None)
    for kind in ("none", "gzip"):
        manifests.write_manifest(manifests.last_rows(manifests.by_sample(df), ["line_no"]), str(tmp_path / kind), kind)
        back = manifests.read_manifest(spark, str(tmp_path / kind), ["sample_id", "label", "crop_path"]).collect()
        assert {r["sample_id"]: r["label"] for r in back} == want and len(back) == len(want) and {r["crop_path"] for r in back} == {""}
