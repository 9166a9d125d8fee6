"""Boundary cases of the trajectory operators."""

from datetime import datetime, timedelta

import pytest

import dataclasses

import numpy as np
from pyspark.sql import functions as F

from trajrisk.operators import behavior, ingest, matching, overspeed_v1, scoring
from trajrisk.params import DEFAULTS


def chain(spark, kmh, dt, mps=None):
    t, rows = datetime(2024, 6, 5, 8), []
    for i, v in enumerate(kmh):
        rows.append(("V1", 1, "S1", i, t, 116.5 + i * 1e-5, 39.75, v, v / 3.6 if mps is None else mps[i], float(dt) if i else None))
        t += timedelta(seconds=dt)
    names = "vehicle_id string, segment_seq int, segment_id string, point_order int, time timestamp_ntz, lon double, lat double, speed_kmh double, speed_mps double, dt_s double"
    return spark.createDataFrame(rows, names)


def test_overspeed_is_strict_and_keeps_its_minimum(spark):
    assert behavior.overspeed_events(chain(spark, [19.99, 20.0, 20.0, 20.0], 5)).count() == 0
    rows = behavior.overspeed_events(chain(spark, [10.0, 20.01, 20.01, 20.01, 10.0], 5)).collect()
    assert [(r["duration_s"], r["start_time"].second) for r in rows] == [(10.0, 5)]
    assert behavior.overspeed_events(chain(spark, [20.01] * 3, 4)).count() == 0


def test_rapid_interval_and_start(spark):
    limits = spark.createDataFrame([(100, 99.0, -0.01)], "n_motion long, p85 double, p15 double")
    assert behavior.rapid_events(chain(spark, [36.0, 18.0], 6), limits).count() == 1
    assert behavior.rapid_events(chain(spark, [36.0, 18.0], 7), limits).count() == 0
    slow = spark.createDataFrame([(100, 0.5, -99.0)], "n_motion long, p85 double, p15 double")
    assert behavior.rapid_events(chain(spark, [0.3 * 3.6, 18.0], 5), slow).count() == 0


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="POSITIONTIME"):
        ingest.resolve_columns(spark.createDataFrame([(1,)], "lon int"))


def test_gap_of_180_seconds_stays(spark):
    t = datetime(2024, 1, 1)
    rows = [("V1", t, 1, 0), ("V1", t + timedelta(seconds=180), 2, 0), ("V1", t + timedelta(seconds=361), 3, 0), ("V1", t + timedelta(seconds=362), 4, 1)]
    df = spark.createDataFrame(rows, "vehicle_id string, time timestamp_ntz, event_id long, segment_flag int")
    out = {r["event_id"]: r["segment_seq"] for r in ingest.segment_trajectories(df).collect()}
    assert out == {1: 1, 2: 1, 3: 2, 4: 3}


def test_overspeed_bounds(spark):
    loose = dataclasses.replace(DEFAULTS, overspeed_s=0.0, overspeed_points=1)
    rows = behavior.overspeed_events(chain(spark, [19.99, 20.0, 20.01, 20.01], 5), loose).collect()
    assert [r["start_time"] for r in rows] == [datetime(2024, 6, 5, 8, 0, 10)]
    for dt, n in ((4.95, 0), (5.0, 1), (5.05, 1)):
        assert behavior.overspeed_events(chain(spark, [20.01] * 3, dt)).count() == n, dt
    mixed = chain(spark, [10.0, 30.0, 5.0, 22.0, 22.0, 22.0], 5)
    assert behavior.overspeed_events(mixed).count() == 1
    limits = spark.createDataFrame([(100, 0.5, -0.5)], "n_motion long, p85 double, p15 double")
    assert "rapid_decel" in {r["event_type"] for r in behavior.rapid_events(mixed, limits).collect()}


def test_rapid_bounds(spark):
    limits = spark.createDataFrame([(100, 99.0, -0.01)], "n_motion long, p85 double, p15 double")
    for dt, n in ((5.9, 1), (6.0, 1), (6.1, 0)):
        assert behavior.rapid_events(chain(spark, [36.0, 18.0], dt, [10.0, 5.0]), limits).count() == n, dt
    slow = spark.createDataFrame([(100, 0.5, -99.0)], "n_motion long, p85 double, p15 double")
    assert behavior.rapid_events(chain(spark, [1.0, 20.0], 5, [0.3, 5.0]), slow).count() == 0


def test_acceleration_quantiles(spark):
    mps = np.abs(np.random.default_rng(7).normal(5, 1, 1000)).tolist()
    r = behavior.accel_thresholds(chain(spark, [v * 3.6 for v in mps], 5, mps)).first()
    a = np.diff(mps) / 5
    assert r["n_motion"] == 999 and r["p85"] > 0 > r["p15"]
    assert (r["p85"], r["p15"]) == (pytest.approx(np.quantile(a, 0.85), abs=6e-4), pytest.approx(np.quantile(a, 0.15), abs=6e-4))
    assert behavior.accel_thresholds(chain(spark, [1.0], 5)).first()["n_motion"] == 0


def test_wrong_way_angles(spark):
    rows = [("F", 134.9, False), ("F", 135.0, True), ("F", 180.0, True), ("F", 225.0, True), ("F", 225.1, False), ("T", 0.0, True), ("t", 180.0, False), (None, 90.0, True), (None, 270.0, False), ("B", 180.0, False)]
    df = spark.createDataFrame([(o, b, 0.0, w) for o, b, w in rows], "oneway string, obs_bearing double, seg_bearing double, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", matching.is_reverse_point()).collect())
    assert df.withColumn("obs_bearing", F.lit(None).cast("double")).select(matching.is_reverse_point().alias("w")).where("w IS NOT NULL").count() == 0


def test_wrong_way_share_is_strict(spark):
    t = datetime(2024, 6, 5, 8)
    names = "vehicle_id string, segment_seq int, segment_id string, point_order int, time timestamp_ntz, matched int, oneway string, obs_bearing double, seg_bearing double, road_level string, lon double, lat double"
    for n, events in ((499, 0), (500, 0), (501, 1)):
        rows = [("V1", 1, "S1", i, t, 1, "B", 90.0 if i < n else 270.0, 0.0, "branch", 116.5, 39.75) for i in range(1000)]
        assert matching.reverse_events(spark.createDataFrame(rows, names)).count() == events, n


def test_each_coordinate_has_its_own_range(spark):
    rows = [(datetime(2024, 1, 1), 200.0, None, "coord_out_of_range"), (datetime(2024, 1, 1), None, 39.75, "invalid_coord"), (None, 200.0, 1.0, "invalid_time"), (datetime(2024, 1, 1), 116.5, 39.75, None), (datetime(2024, 1, 1), None, None, "invalid_coord")]
    df = spark.createDataFrame(rows, "time timestamp_ntz, lon double, lat double, want string")
    assert all(r["want"] == r["isolate_reason"] for r in ingest.tag_invalid(df).collect())
    with pytest.raises(ValueError, match="rows are rejected"):
        ingest.assert_isolated_ratio(ingest.tag_invalid(df))


def test_first_rows_are_kept(spark):
    schema = "order_id long, event_time timestamp_ntz, lon double, lat double, source_row long, speed_kmh double"
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([(1, t, 0.0, 0.0, 5, 1.0), (1, t, 0.0, 0.0, 4, 2.0)], schema)
    new = spark.createDataFrame([(1, t, 0.0, 0.0, 1, 3.0), (2, t, 0.0, 0.0, 2, 4.0), (2, t, 0.0, 0.0, 1, 5.0)], schema)
    assert sorted(r["speed_kmh"] for r in overspeed_v1.append_points_dedup(old, new).collect()) == [2.0, 5.0]


def test_points_of_the_degree_line(spark):
    rows = [("1", "2024-01-01 08:00:00", "116.5", "39.7", None, "x"), ("2", "bad", "116.5", "39.7", "30", "x"), ("3", "2024-01-01 08:00:01", "116.5", "39.7", "20", None)]
    out = ingest.normalize_points_v1(spark.createDataFrame(rows, "ID string, Time string, x string, y string, SpeedKM string, age string"), "B-1", "f").collect()
    assert [(r["order_id"], r["speed_kmh"], r["is_overspeed"], r["gender"], r["age"]) for r in out] == [("1", 0.0, 0, "未知", -1), ("3", 20.0, 1, "未知", -1)]
    with pytest.raises(ValueError, match="lon"):
        ingest.normalize_points_v1(spark.createDataFrame([("1",)], "id string"), "B", "f")


def grid_of(spark, rows):
    return spark.createDataFrame(rows, "grid_id string, quality_flag string, overspeed_rate double, reverse_rate double, rapid_rate double")


def test_weights_of_constant_columns_are_zero(spark):
    grid = grid_of(spark, [(f"G{i}", "valid", 10.0 * (i + 1), 0.0, 5.0) for i in range(4)])
    many = spark.createDataFrame([(100, 1.0, -1.0)], "n_motion long, p85 double, p15 double")
    weights = scoring.entropy_weights(grid)
    assert list(weights.first()) == pytest.approx([1.0, 0.0, 0.0])
    scores = {r["grid_id"]: r for r in scoring.risk_scores(grid, many).collect()}
    assert [scores[f"G{i}"]["overspeed_index"] for i in range(4)] == [25.0, 50.0, 75.0, 100.0] and scores["G3"]["reverse_index"] == 0.0
    assert [scores[f"G{i}"]["cri"] for i in range(4)] == sorted(scores[f"G{i}"]["cri"] for i in range(4)) and scores["G3"]["cri_available"]
    same = grid.select(*(F.lit(1 / 3).alias(f"w_{c}") for c in scoring.RATES)).limit(1)
    close = [r["closeness"] for r in scoring.topsis(grid, same).orderBy("grid_id").collect()]
    assert close == sorted(close) and close[0] == 0 and close[3] == 1


def test_gates_of_scores(spark):
    few = spark.createDataFrame([(29, 1.0, -1.0)], "n_motion long, p85 double, p15 double")
    many = spark.createDataFrame([(30, 1.0, -1.0)], "n_motion long, p85 double, p15 double")
    grid = grid_of(spark, [("G0", "valid", 1.0, 2.0, 3.0), ("G1", "valid", 4.0, 1.0, 9.0), ("G2", "low_exposure", None, None, None)])
    rows = {r["grid_id"]: r for r in scoring.risk_scores(grid, few).collect()}
    assert rows["G1"]["cri"] is None and rows["G1"]["rapid_index"] == 0.0 and rows["G1"]["overspeed_index"] == 100.0 and not rows["G1"]["cri_available"]
    rows = {r["grid_id"]: r for r in scoring.risk_scores(grid, many).collect()}
    assert rows["G1"]["cri"] is not None and rows["G2"]["cri"] is None and rows["G2"]["overspeed_index"] is None
    one = {r["grid_id"]: r for r in scoring.risk_scores(grid.where("grid_id <> 'G1'"), many).collect()}
    assert one["G0"]["cri"] is None and one["G0"]["overspeed_index"] is None and not one["G0"]["cri_available"]


def test_mann_kendall(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(hours=i), i) for i in range(10)] + [("b", t + timedelta(hours=i), 3) for i in range(5)] + [("c", t, 1)]
    got = {r["key"]: r for r in overspeed_v1.mann_kendall(spark.createDataFrame(rows, "key string, bucket_ts timestamp_ntz, value long")).collect()}
    assert (got["a"]["s"], got["a"]["tau"], got["a"]["trend"]) == (45, 1.0, "increasing")
    assert (got["b"]["s"], got["b"]["z"], got["b"]["p"]) == (0, 0.0, 1.0) and got["c"]["n"] == 1
    x = np.random.default_rng(1).integers(0, 6, 200)
    assert overspeed_v1.sign_sum(x) == int(np.sign(x[None, :] - x[:, None])[np.triu_indices(200, 1)].sum())
