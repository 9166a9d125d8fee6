"""Projection, quantiles, road geometry."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajrisk.functions import geo, labels
from trajrisk.functions.quantiles import exact_quantiles, ranked_ranges
from trajrisk.operators import roads


def test_projection_of_known_points(spark):
    """On the central meridian, and one degree east of it on the equator and at 40 degrees north."""
    df = spark.createDataFrame([(117.0, 0.0), (117.0, 40.0), (118.0, 0.0), (118.0, 40.0), (116.5, 39.75)], "lon double, lat double")
    rows = geo.add_utm50n(df, F.col("lon"), F.col("lat"), "x", "y").collect()
    assert (rows[0]["x"], rows[0]["y"]) == pytest.approx((500000.0, 0.0))
    assert rows[1]["x"] == pytest.approx(500000.0) and rows[1]["y"] == pytest.approx(4427757.218, abs=2e-3)
    assert rows[2]["x"] - 500000 == pytest.approx(111280.65, abs=0.05) and rows[2]["y"] == pytest.approx(0.0, abs=1e-6)
    back = geo.add_wgs84(geo.add_utm50n(df, F.col("lon"), F.col("lat"), "x", "y"), F.col("x"), F.col("y"), "lon2", "lat2").collect()
    for r in back:
        assert (r["lon2"], r["lat2"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-10)
    scale = 0.9996 * (1 + (np.radians(0.001) * np.cos(np.radians(40))) ** 2 / 2)
    near = geo.add_utm50n(spark.createDataFrame([(117.001, 40.0)], "lon double, lat double"), F.col("lon"), F.col("lat"), "x", "y").first()["x"] - 500000
    radius = 6378137.0 / np.sqrt(1 - 0.00669437999 * np.sin(np.radians(40)) ** 2)
    assert near == pytest.approx(scale * radius * np.cos(np.radians(40)) * np.radians(0.001), abs=1e-4)


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=500), "b": np.round(rng.exponential(size=301), 1), "c": np.array([4.0]), "d": np.full(50, 2.5)}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    qs = (0.0, 0.15, 0.5, 0.95, 1.0)
    got = {r["k"]: r for r in exact_quantiles(df, "v", qs, ("k",), small=20).collect()}
    assert set(got) == set(values)
    for k, x in values.items():
        assert got[k]["n"] == len(x) and got[k]["q"] == pytest.approx(np.quantile(x, qs).tolist()), k
    assert exact_quantiles(df.where("k = 'e'"), "v", qs).first()["n"] == 0


def test_quantiles_beside_an_outlier(spark):
    """Ranges shrink to few rows whatever lies far away, or stands in most rows."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=100_000), [1e9, -1e12, np.inf]])
    tied = np.concatenate([np.full(40_000, 1.0), np.full(40_000, 2.0), 1 + rng.random(5_000)])
    df = spark.createDataFrame(pd.DataFrame({"k": ["x"] * len(x) + ["t"] * len(tied), "v": np.concatenate([x, tied])})).repartition(5)
    qs = (0.0, 0.15, 0.5, 0.85, 0.999)
    ranges = ranked_ranges(df.select("k", F.col("v").alias("_v")), qs, ["k"], small=500).collect()
    assert all(r["_value"] is not None or r["_size"] <= 500 for r in ranges) and len(ranges) > 10
    got = {r["k"]: r["q"] for r in exact_quantiles(df, "v", qs, ("k",), small=500).collect()}
    for k, values in (("x", x), ("t", tied)):
        assert got[k] == pytest.approx(np.quantile(values, qs).tolist())


def test_bearings(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0.0), (1.0, 0.0, 90.0), (0.0, -1.0, 180.0), (-1.0, 0.0, 270.0), (0.0, 0.0, None)], "dx double, dy double, want double")
    for r in df.withColumns({"b": geo.bearing_deg(F.col("dx"), F.col("dy")), "r": geo.reverse_bearing(F.col("want")), "d": geo.angdiff(F.col("want"), F.lit(10.0))}).collect():
        assert r["b"] == (None if r["want"] is None else pytest.approx(r["want"]))
        assert r["want"] is None or (r["r"] == (r["want"] + 180) % 360 and r["d"] == abs((r["want"] - 10 + 180) % 360 - 180))


def road(osm_id, *lines, fclass="primary", oneway="F"):
    return osm_id, fclass, oneway, None, None, [[(x, y) for x, y in line] for line in lines]


def test_road_edges(spark):
    rows = [
        road(1, [(116.50, 39.75), (116.501, 39.75)], [(116.501, 39.75), (116.502, 39.751), (116.503, 39.75)]), road(2, [(116.50, 39.75), (116.501, 39.75)], oneway="t"),
        road(3, [(116.501, 39.75), (116.50, 39.75)], oneway=None), road(4, [(116.5, 39.75)]), road(5, [(116.5, 39.75), (116.5, 39.75)]), road(6, [(116.5, 39.75), (116.500001, 39.75)], fclass="steps"),
        road(7, [(116.5, 39.75), (116.51, 39.75)], fclass="other"),
    ]
    edges = {r["edge_id"]: r for r in roads.road_edges(spark.createDataFrame(rows, roads.ROAD_SCHEMA)).collect()}
    # A short line whose ends are different centimetres stays, as in a multigraph; one without length goes.
    assert set(edges) == {1000, 1001, 2000, 3000, 6000, 7000}
    assert [edges[i]["k"] for i in (1000, 2000, 3000)] == [0, 1, 2] and edges[1000]["u"] == edges[3000]["v"]
    assert [edges[i]["oneway"] for i in (1000, 2000, 3000)] == ["F", "T", "B"]
    assert edges[7000]["road_level"] == "unknown" and not edges[7000]["matchable"] and not edges[6000]["matchable"] and edges[1000]["matchable"]
    parts = {(r["edge_id"], r["part"]): r for r in roads.edge_parts(roads.road_edges(spark.createDataFrame(rows, roads.ROAD_SCHEMA))).collect()}
    first = parts[1001, 0]
    assert parts[1001, 1]["along0"] == pytest.approx(np.hypot(first["bx"] - first["ax"], first["by"] - first["ay"]))
    assert first["bearing"] == pytest.approx(37.6, abs=1) and parts[1001, 1]["bearing"] == pytest.approx(142.4, abs=1)


def test_whole_roads_that_touch_the_box(spark):
    """Through the box without an end in it, along its edge, beside it, and beside its corner."""
    rows = [
        road(1, [(116.4, 39.75), (116.6, 39.75)]), road(2, [(116.455, 39.6), (116.455, 39.705)]), road(3, [(116.4, 39.6), (116.44, 39.9)]),
        road(4, [(116.45, 39.83), (116.46, 39.8285)]), road(5, [(116.3, 39.7), (116.31, 39.7)], [(116.5, 39.75), (116.5, 39.75)]), road(6, [(116.5, 39.75)]),
    ]
    assert sorted(r["osm_id"] for r in roads.clip_edges_bbox(spark.createDataFrame(rows, roads.ROAD_SCHEMA)).collect()) == [1, 2, 5]


def test_labels(spark):
    rows = [("high", 2.6, 0.0, "red"), ("high", 2.0, 3.0, "yellow"), ("medium", 2.0, 0.0, "blue"), ("low", 1.3, 9.0, None)]
    df = spark.createDataFrame(rows, "risk string, z double, t double, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", labels.alert_level(F.col("risk"), F.col("z"), F.col("t"))).collect())
    df = spark.createDataFrame([("2024-06-05 07:59 ~ 09:00", "早高峰（7:00-9:00）"), ("2024-06-05 09:00 ~ 09:00", "全天"), ("2024-06-05 22:10 ~ 23:00", "夜间平峰（21:00-23:00）"), ("", "全天")], "s string, want string")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", labels.high_risk_period(F.col("s"))).collect())
    one = spark.range(1).select(labels.split_lines(F.lit(" a \n\n b")).alias("x"), labels.join_items(F.array(F.lit("a"), F.lit("b"))).alias("y")).first()
    assert one["x"] == ["a", "b"] and one["y"] == "a；b"
