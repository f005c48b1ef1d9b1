import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope.functions import geometry as G
from panelscope.functions import text as T
from panelscope.operators import regions as R
from panelscope.sources import requests as Q

QUAD = [(37.0, 20.0), (301.0, 44.0), (280.0, 250.0), (25.0, 231.0)]


def test_clip_area_matches_fine_raster(spark):
    step = 0.25
    y, x = np.mgrid[step / 2 : 320 : step, step / 2 : 320 : step]
    inside = np.ones(x.shape, bool)
    for i in range(4):
        (ax, ay), (bx, by) = QUAD[i], QUAD[(i + 1) % 4]
        inside &= (bx - ax) * (y - ay) - (by - ay) * (x - ax) > 0
    rects = [(0, 0, 64, 64), (30, 15, 94, 79), (100, 100, 164, 164), (250, 200, 314, 264), (0, 0, 320, 320), (310, 0, 320, 20)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rects], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(G.clip_area(G.polygon(*QUAD), F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    for (a, b, c, d), area in zip(rects, got):
        want = (inside & (x > a) & (x < c) & (y > b) & (y < d)).sum() * step * step
        assert area == pytest.approx(want, abs=20)


def test_deep_inside_needs_no_shift(spark):
    df = spark.createDataFrame([(1000, 1000), (200, 1000), (10, 1000), (-5, 1000)], "x int, y int").withColumn(
        "p", G.polygon((0, 0), (2000, 0), (2000, 2000), (0, 2000))
    )
    rows = G.with_roi_shift(df, "x", "y", "p").collect()
    assert (rows[0]["dx"], rows[0]["dy"], rows[0]["d"]) == (0, 0, 1000.0)
    assert (rows[1]["dx"], rows[1]["dy"]) == (96, 0)
    assert (rows[2]["dx"], rows[3]["dx"]) == (0, 0)  # too far out to move; outside


def test_zone_of_tiles_on_a_slanted_panel(spark):
    df = spark.createDataFrame([(100, 100, 64), (0, 0, 64), (270, 200, 64), (25, 60, 64)], "tx int, ty int, size int").withColumn("polygon", G.polygon(*QUAD))
    assert [r["zone"] for r in R.classify_zone(df).select("zone").collect()] == ["inner", "outside", "outside", "edge"]


def test_text_functions(spark):
    df = spark.createDataFrame([("WGF50500,OK;STANDARD,NG;R0F00000,NG;W0F00000,OK;4;", "WGF_0001_2026.bmp")], "d string, n string")
    r = df.select(
        T.ric_judgment("d").alias("j"), T.ric_per_prefix("d").alias("m"), T.image_prefix("n").alias("p"),
        T.image_prefix(F.lit("STANDARD.png")).alias("q"), T.sample_id(F.lit("G"), F.lit("A_1.tif"), "tile", F.lit(3)).alias("s"),
        T.sample_filename(F.lit("G"), F.lit("A_1.tif"), F.lit("tile3"), F.lit("2026-04-08 10:00:00")).alias("f"),
    ).first()
    assert r["j"] == "NG" and r["m"]["STANDARD"] == "NG" and len(r["m"]) == 4
    assert (r["p"], r["q"], r["s"], r["f"]) == ("WGF_0001", "STANDARD", "G_A_1_tile3", "20260408_G_A_1_tile3.png")
    with pytest.raises(ValueError):
        T.check_date("2026-4-1")


def test_request_lines(spark):
    lines = [
        (r"AOI@GLS1;GN140JCAL010S;MACH1401;1920,1080;NG;\\srv\d\x",), ("INVALID DATA",), ("AOI@a;b;c",),
        ("AOI@G;M;C;1920,1080;OK;W0F00000;(350/174;1465/363;x/1);/dir",), ("AOI@G;M;C;1920,1080;OK;W0F;(1/2/3/4);/d",),
        ("AOI@A;m;c;1,2;OK;/pAOI@B;m;c;1,2;OK;/q",),
    ]
    rows = Q.read_requests(spark.createDataFrame(lines, "value string")).collect()
    assert len(rows) == 7
    by = {r["line"]: r for r in rows}
    assert by["INVALID DATA"]["error"] == "bad_prefix" and by["AOI@a;b;c"]["error"] == "too_few_fields"
    assert by[lines[0][0]]["image_dir"] == r"\\srv\d\x"
    bomb = by[lines[3][0]]["bomb"]
    assert bomb["kind"] == "point" and [(c["x"], c["y"]) for c in bomb["coords"]] == [(350, 174), (1465, 363)]
    line = spark.createDataFrame([("(1/2/3/4)",), ("(1/x)",)], "r string").select(Q.parse_bomb(F.col("r")).alias("b")).collect()
    assert line[0]["b"]["kind"] == "line" and line[1]["b"] is None
    assert {"A", "B"} <= {r["glass_id"] for r in rows}
