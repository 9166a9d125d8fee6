"""Readers and writers there and back; streams against their batch forms; ledger and advice rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trajrisk.operators import advice, governance, ingest, overspeed_v1, roads
from trajrisk.sources import files
from trajrisk.streaming import run, streams

T = datetime(2024, 6, 5, 8)


def test_trajectory_files(spark, tmp_path):
    for sep in (",", "\t", ";"):
        path = tmp_path / f"f{ord(sep)}.csv"
        path.write_text(f"\ufeffPOSITIONTIME{sep} X_position {sep}Y_position{sep}ID\n2024-06-05 08:00:00{sep}116.5{sep}39.7{sep}V1\n", encoding="utf-8")
        raw = files.read_trajectory_csv(spark, f"file://{path}")
        row = ingest.coerce_types(ingest.resolve_columns(raw)).first()
        assert (row["time"], row["lon"], row["vehicle_id"], row["segment_flag"]) == (T, 116.5, "V1", 0)


def test_batches_do_not_change(spark, tmp_path):
    points = spark.createDataFrame([("V1", 1, "V1-1", 0, T, 116.5, 39.7)], "vehicle_id string, segment_seq int, segment_id string, point_order int, time timestamp_ntz, lon double, lat double")
    files.write_batch(points, f"file://{tmp_path}/b", "B-1")
    files.write_batch(points, f"file://{tmp_path}/b", "B-2")
    back = files.load_batch(spark, f"file://{tmp_path}/b", "B-1")
    assert back.count() == 1 and set(files.BATCH_COLUMNS) == set(back.columns)
    assert "PartitionFilters" in back._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_batch(points, f"file://{tmp_path}/b", "B-1")
    assert not files.write_isolated(points.limit(0), f"file://{tmp_path}/i", "B-1")


def test_roads_as_features(spark, tmp_path):
    rows = [(1, "primary", "F", "A", 60.0, [[(116.5, 39.7), (116.6, 39.7)], [(1.0, 2.0), (3.0, 4.0)]]), (2, "steps", None, None, None, [[(0.0, 0.0), (1.0, 1.0)]])]
    df = spark.createDataFrame(rows, roads.ROAD_SCHEMA)
    files.road_features(df).write.text(f"file://{tmp_path}/r.json")
    assert sorted(map(str, files.read_road_edges(spark, f"file://{tmp_path}/r.json").collect())) == sorted(map(str, df.collect()))
    (tmp_path / "one.json").write_text('{"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"osm_id": 7}}\nnot json\n')
    found = files.read_road_edges(spark, f"file://{tmp_path}/one.json").collect()
    assert len(found) == 1 and found[0]["osm_id"] == 7 and len(found[0]["lines"][0]) == 2


def test_ledger(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"feedback_id": "a", "conclusion": "成立", "measures": ["x", "y"], "handled_at": "2024-01-02"}\n\n{broken\n{"feedback_id": "b", "handled_at": "2024-01-03"}\n', encoding="utf-8")
    back = files.read_feedback_jsonl(spark, f"file://{tmp_path}/l.jsonl")
    assert sorted(r["feedback_id"] for r in back.collect()) == ["a", "b"]
    assert governance.feedback_export_rows(back).where("feedback_id = 'a'").first()["measures"] == "x；y"
    assert governance.filter_feedback(back, date_from="2024-01-03").count() == 1 and governance.filter_feedback(back, conclusion="成立").count() == 1
    assert [r["feedback_id"] for r in governance.feedback_ledger(back, 1).collect()] == ["b"]


def test_forms(spark):
    schema = "feedback_id string, conclusion string, handled_at string, scene_issues string, measures string, responsible_unit string, reporter string, note string, photos array<string>"
    rows = [("1", " 成立 ", "2024-02-29", "a\n\n b ", None, None, "", None, None), ("2", "x", "2024-02-30", None, None, None, "r", None, ["p"] * 4), ("3", None, None, None, None, None, None, None, [])]
    got = {r["feedback_id"]: r for r in governance.validate_feedback(spark.createDataFrame(rows, schema)).collect()}
    assert got["1"]["problems"] == [] and got["1"]["scene_issues"] == ["a", "b"] and got["1"]["reporter"] == governance.REPORTER and got["1"]["conclusion"] == "成立"
    assert got["2"]["problems"] == ["conclusion", "handled_at", "photos"] and got["3"]["problems"] == ["conclusion", "handled_at"]


def test_history_and_streak(spark):
    rows = [("1", "2024-01-01T00:00:10Z", None), ("2", None, "1704067300.7"), ("3", "soon", None), ("4", None, None)]
    got = {r["feedback_id"]: r["timestamp"] for r in governance.feedback_history(spark.createDataFrame(rows, "feedback_id string, timestamp string, created_at string")).collect()}
    assert got == {"1": 1704067210, "2": 1704067300, "3": 0, "4": 0}
    f, h = governance.FAILS, governance.HOLDS
    rows = [("a", d, c) for d, c in enumerate([h, f, f, f])] + [("b", 1, f), ("b", 2, h)] + [("c", 1, f), ("c", 2, f)]
    df = spark.createDataFrame([(g, f"2024-01-0{d + 1}", i, c) for i, (g, d, c) in enumerate(rows)], "grid_id string, handled_at string, feedback_id int, conclusion string")
    assert {r["grid_id"]: (r["streak"], r["flagged"]) for r in governance.false_streak(df).collect()} == {"a": (3, True), "b": (0, False), "c": (2, False)}


def test_boxes_include_their_bounds(spark):
    grids = spark.createDataFrame([("g", 116.5, 39.75)], "grid_id string, center_lon double, center_lat double")
    events = spark.createDataFrame([(116.5 + 0.0016 - 1e-9, 39.75), (116.5016001, 39.75), (116.5, 39.75 - 0.0012 + 1e-9), (116.5, 39.7487)], "lon double, lat double")
    assert governance.events_in_grid_box(events, grids).count() == 2


def test_advice_documents(spark):
    good = '{"risk_summary": "s", "field_actions": [{"when": "a", "where": "b", "deployment": "c", "action": "d", "completion": "e"}], "road_env": [], "enterprise": [{"trigger": "a", "measure": "b", "owner": "c"}], "education": [], "basis_ids": ["x"]}'
    rows = [
        (good, []), (good.replace('"s"', "3"), ["risk_summary"]), (good.replace('"completion": "e"', '"completion": " "'), ["field_actions[0]"]), (good.replace('"owner": "c"', '"owner": 5'), ["enterprise[0]"]),
        (good.replace('"road_env": []', '"road_env": {}'), ["road_env"]), (good.replace('["x"]', "[1]"), ["basis_ids"]), ("[]", ["document"]), ("{", ["document"]), (None, ["document"]),
        ("{}", ["risk_summary", "field_actions", "road_env", "enterprise", "education", "basis_ids"]),
    ]
    for r in spark.createDataFrame(rows, "t string, want array<string>").withColumn("got", advice.validate_advice_json(F.col("t"))).collect():
        assert r["got"] == r["want"], r["t"]


def test_rules_of_one_version(spark):
    rules = advice.default_rules(spark)
    old = rules.withColumn("version", F.lit("KB-0.9"))
    off = rules.withColumn("enabled", F.when(F.col("rule_id") == "KB-F01", False))
    assert advice.enabled_rules(old.unionByName(off)).count() == 14 and advice.enabled_rules(old.unionByName(off), "KB-0.9").count() == 15


def stream_points(spark, tmp_path):
    rows = [(i % 7, T + timedelta(minutes=25 * i), 116.5, 39.7, float(i % 40), int(i % 40 >= 20)) for i in range(120)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "order_id long, event_time timestamp, lon double, lat double, speed_kmh double, is_overspeed int")
    df.repartition(3).write.parquet(f"file://{tmp_path}/p")
    return df, spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/p")


def test_streams_equal_batches(spark, tmp_path):
    batch, stream = stream_points(spark, tmp_path)
    hours = {r["bucket_ts"]: r["value"] for r in run.available_now(streams.stream_hourly_overspeed(stream), "complete").collect()}
    want = {r["bucket_ts"]: r["value"] for r in overspeed_v1.hourly_series(batch).collect()}
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in hours.items() if v}
    assert run.available_now(streams.stream_point_dedup(stream, "30 days"), "append").count() == batch.dropDuplicates(["order_id", "event_time", "lon", "lat"]).count() == 120
    renamed = stream.select(F.lit("V").alias("vehicle_id"), F.col("event_time").alias("time"), "speed_kmh")
    # In append mode the last points wait for the watermark.
    assert run.available_now(streams.stream_segments(renamed), "append").count() == 119


def test_a_batch_from_files(spark, tmp_path):
    """A few vehicles along a small lattice of roads, from files to a stored analysis."""
    from trajrisk.jobs.batch import run_batch

    lines = ["BICYCLEID,POSITIONTIME,X_position,Y_position"]
    for v in range(8):
        for k in range(60):
            t = T + timedelta(seconds=5 * k)
            lines.append(f"V{v},{t:%Y-%m-%d %H:%M:%S},{116.50 + 0.0004 * k + v * 1e-5:.6f},{39.75 + 0.00001 * (v % 3):.6f}")
    lines.append("V9,never,116.5,39.75")
    (tmp_path / "t.csv").write_text("\n".join(lines))
    rows = [(i, "secondary", "F" if i % 2 else "B", None, None, [[(116.495 + 0.002 * i, 39.75), (116.497 + 0.002 * i, 39.75)]]) for i in range(20)]
    files.road_features(spark.createDataFrame(rows, roads.ROAD_SCHEMA)).write.text(f"file://{tmp_path}/roads.json")
    out = f"file://{tmp_path}/out"
    run_batch(spark, f"file://{tmp_path}/t.csv", f"file://{tmp_path}/roads.json", out, "B-1", "RN-1", "AV-1")
    assert files.load_batch(spark, f"{out}/batches", "B-1").count() == 480 and spark.read.parquet(f"{out}/isolated").count() == 1
    assert spark.read.parquet(f"{out}/matched").where("matched = 1").count() == 480
    grid = spark.read.parquet(f"{out}/grid")
    length = spark.read.parquet(f"{out}/matched").agg(F.max("proj_x") - F.min("proj_x")).first()[0] / 1000
    assert grid.agg(F.sum("exposure_km")).first()[0] == pytest.approx(8 * length, rel=0.02)
    assert grid.agg(F.sum("total_events")).first()[0] == spark.read.parquet(f"{out}/events").count() > 0
    assert spark.read.json(f"{out}/summary/AV-1").first()["grid_count"] == grid.count()
    assert spark.read.json(f"{out}/advice/AV-1").count() == grid.count()
