"""Disk that a step takes at size: what is shuffled and stored on the way; and results that differed from SQL on larger tables."""

from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_matching import lattice, points
from trajrisk.jobs.analysis import Analysis
from trajrisk.operators import governance, matching, overspeed_v1, roads
from trajrisk.params import DEFAULTS
from trajrisk.sources.tables import stored


@pytest.fixture(scope="module")
def walk(spark):
    """Random drives over a lattice, some of them with points far from all roads, and the paths between all nodes."""
    rng = np.random.default_rng(3)
    chains = []
    for _ in range(12):
        places = np.array([116.503, 39.753]) + np.cumsum(rng.normal(scale=0.0003, size=(int(rng.integers(1, 30)), 2)), axis=0)
        places[rng.random(len(places)) < 0.1] += 0.02
        chains.append(places.round(6).tolist())
    drives, edges = stored(points(spark, chains), "points"), stored(lattice(spark), "edges")
    return drives, edges, stored(matching.bounded_shortest_paths(edges, matching.nodes_near(drives, edges)), "paths")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_ways_of_candidates_without_a_shuffle_of_pairs(spark, walk):
    """one shuffle of points, whatever the number of pairs; the same ways as by joins, batches that cut sub-chains included."""
    drives, edges, paths = walk
    keys = ("vehicle_id", "segment_seq", "point_order", "i", "j")
    rows = lambda df: {tuple(r[k] for k in keys): (r["straight_m"], r["path_m"]) for r in df.collect()}
    want = rows(matching.candidate_path_length(matching.transition_pairs(matching.match_candidates(drives, edges)), paths))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("10000", "7", "1"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            ways = matching.candidate_ways(matching.chain_candidates(drives, edges), paths)
            got = rows(ways)
            assert len(got) == ways.count() and got.keys() == want.keys() and len(got) > 1000
            assert all(v == pytest.approx(want[k]) for k, v in got.items()) and any(v[1] is None for v in want.values()) == any(v[1] is None for v in got.values())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert shuffles(ways.groupBy("vehicle_id").agg(F.count("*"))) == 3  # of points, of road parts by cell, of a row a vehicle and task


def on_bounds(spark):
    """Cells, and for each an event exactly on the left and on the right bound of its box, one just outside either, in
    micro-degrees."""
    rows = []
    for gx in range(25870, 25900):
        centre = gx * 4500 + 2250
        rows += [(gx * 10 + k, (centre + d) / 1e6, 39.72) for k, d in enumerate((-1600, 1600, -1601, 1601))]
    events = spark.createDataFrame(rows, "order_id long, lon double, lat double")
    middles = events.where("order_id % 10 = 0").select("order_id", ((F.floor(F.col("order_id") / 10) * 4500 + 2250) / 1e6).alias("lon"), "lat")
    points = middles.select("order_id", "lon", "lat", F.lit(30.0).alias("speed_kmh"), F.lit(1).alias("is_overspeed"), F.lit("2024-01-05 08:00:00").cast("timestamp_ntz").alias("event_time"))
    return overspeed_v1.v1_grid(points), events


def test_events_on_the_bounds_of_a_box(spark):
    """bounds are included, also where a sum of doubles is beside them."""
    cells, events = on_bounds(spark)
    cells = cells.withColumn("center_lat", F.lit(39.72))
    got = governance.events_in_grid_box(events, governance.exact_centres(cells)).collect()
    assert sorted(r["order_id"] for r in got) == [gx * 10 + k for gx in range(25870, 25900) for k in (0, 1)]
    assert all(r["grid_id"].startswith(f"G{r['order_id'] // 10}_") for r in got)


def test_rates_count_events_on_bounds(spark):
    """two events of a cell, on both bounds of its box, are counted before a check and after it."""
    cells, events = on_bounds(spark)
    day = date(2024, 1, 10)
    dated = events.withColumn("day", F.date_add(F.lit(day), F.when(F.col("order_id") % 2 == 0, -2).otherwise(13).cast("int")))
    cells = cells.withColumn("center_lat", F.lit(39.72))
    checks = cells.select("grid_id", F.lit(day).alias("handled_at"))
    got = governance.event_rate_change(checks, governance.events_in_grid_box(dated, governance.exact_centres(cells))).collect()
    assert len(got) == 30 and day + timedelta(days=13) == date(2024, 1, 23)
    assert {(r["n_before"], r["n_after"], r["status"], r["pct"]) for r in got} == {(1, 1, "ok", 0.0)}


def test_equal_distances_are_told_apart_as_in_sql(spark):
    """two edges that meet at a node, a point 76.248592499 m from either; rounded to a millionth both distances are
    equal, unless a nanometre of a northing is lost on the way, and the lower edge comes first."""
    at = lambda i, j: (116.4583 + 0.000975 * i, 39.714 + 0.00075 * j)
    lines = [(2005420050, at(27, 25), at(28, 25)), (2005220050, at(26, 25), at(27, 25))]
    edges = roads.road_edges(spark.createDataFrame([(k, "primary", "B", None, None, [[tuple(round(c, 6) for c in q) for q in line]]) for k, *line in lines], roads.ROAD_SCHEMA))
    point = matching.with_metres(spark.createDataFrame([(1, 116.484625, 39.733437)], "event_id long, lon double, lat double"))
    cands = matching.match_candidates(point, edges, replace(DEFAULTS, far_m=100.0)).first()["cands"]
    assert [c["osm_id"] for c in cands] == [2005220050, 2005420050] and [c["rank_d"] for c in cands] == [76.248592] * 2
    assert [c["d"] for c in cands] == pytest.approx([76.248592499440] * 2, abs=1e-10)


def test_points_are_matched_in_one_shuffle(spark, walk, monkeypatch):
    """F6 to F14: all their cells come from matched points, for which pairs, candidates and points with them were shuffled;
    the same rows as by joins, as with many paths."""
    drives, edges, paths = walk
    lean = drives.drop("x_m", "y_m")
    one = matching.match_points(lean, edges, paths)
    assert shuffles(one) == 2  # of points, of road parts by cell
    got = {r["event_id"]: r.asDict() for r in one.collect()}
    monkeypatch.setattr(matching, "BROADCAST_PATHS", 0)
    want = {r["event_id"]: r.asDict() for r in matching.match_points(lean, edges, paths).collect()}
    assert len(got) == drives.count() and got.keys() == want.keys() and {r["matched"] for r in got.values()} == {0, 1}
    for k, r in got.items():
        assert all(r[c] == want[k][c] for c in r), k


def test_an_analysis_stores_no_candidates(spark):
    """F6 to F14: what lies on disk for a grid holds neither candidates nor columns that follow from others."""
    a = Analysis(spark, "/root/testdata/sf0.001")
    try:
        assert a.grid().count() > 10
        assert "candidates" not in a.tables and a.tables["clipped"].columns == ["col", "row", "vehicle_id", "segment_seq", "part_m"]
        for name in ("points", "matched"):
            assert not {"speed_kmh", "speed_mps", "calc_speed_mps", "x_m", "y_m", "proj_lon", "proj_lat"} & {*a.tables[name].columns}
        assert {"speed_kmh", "x_m", "proj_lon", "travel_dir", "quality_flag"} <= {*a.matched().columns}
    finally:
        a.close()
