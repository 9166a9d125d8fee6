"""Jobs with a log: broken off and run again, unfinished versions, growing stores, a database, a vehicle with most points."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajrisk.jobs import batch
from trajrisk.operators import advice, behavior, ingest, overspeed_v1, roads, spatial
from trajrisk.sources import commits, files

T = datetime(2024, 6, 5, 8)


def inputs(spark, tmp_path):
    lines = ["BICYCLEID,POSITIONTIME,X_position,Y_position"]
    for v in range(8):
        for k in range(60):
            t = T + timedelta(seconds=5 * k)
            lines.append(f"V{v},{t:%Y-%m-%d %H:%M:%S},{116.50 + 0.0004 * k + v * 1e-5:.6f},{39.75 + 0.00001 * (v % 3):.6f}")
    (tmp_path / "t.csv").write_text("\n".join(lines))
    rows = [(i, "secondary", "F" if i % 2 else "B", None, None, [[(116.495 + 0.002 * i, 39.75), (116.497 + 0.002 * i, 39.75)]]) for i in range(20)]
    files.road_features(spark.createDataFrame(rows, roads.ROAD_SCHEMA)).write.text(f"file://{tmp_path}/roads.json")
    return f"file://{tmp_path}/t.csv", f"file://{tmp_path}/roads.json", f"file://{tmp_path}/out"


def test_a_batch_that_breaks_off_is_run_again(spark, tmp_path, monkeypatch):
    trajectories, road_file, out = inputs(spark, tmp_path)
    go = lambda: batch.run_batch(spark, trajectories, road_file, out, "B-1", "RN-1", "AV-1")

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(files, "write_grid", broken)
        with pytest.raises(RuntimeError, match="lost"):
            go()
    # The batch and the network are finished, the analysis is not there, whatever it has written.
    assert files.latest_batch(commits.rows(spark, out, "batch")).first()["batch_id"] == "B-1"
    assert commits.rows(spark, out, "network").first()["n_edges"] == 20 and commits.rows(spark, out, "analysis").count() == 0
    with pytest.raises(ValueError, match="not finished"):
        files.load_finished_batch(spark, out, "B-2")
    go()
    made = {k: commits.rows(spark, out, k).collect() for k in ("batch", "network", "analysis")}
    assert [len(x) for x in made.values()] == [1, 1, 1] and made["analysis"][0]["n_points"] == 480 and made["analysis"][0]["batch_id"] == "B-1"
    assert made["batch"][0]["rows_total"] == 480 and made["batch"][0]["source_name"] == "t.csv" and made["batch"][0]["time_min"] == T
    assert files.latest_analysis(commits.rows(spark, out, "analysis")).first()[0] == "AV-1" and files.latest_network(commits.rows(spark, out, "network")).first()[0] == "RN-1"
    assert files.load_finished_batch(spark, out, "B-1").count() == 480
    events = spark.read.parquet(f"{out}/events").collect()
    assert sorted(r["event_id"] for r in events) == [f"EV-{i + 1:06d}" for i in range(len(events))] and events
    assert commits.rows(spark, out, "analysis").first()["moran_i"] is not None
    before = sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    go()  # finished: nothing is written
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.parquet")) == before


def v1_points(spark, n, first, day):
    rows = [(str(first + i), T + timedelta(days=day, minutes=7 * i), 116.5 + 0.005 * (i % 5), 39.7 + 0.005 * (i % 3), float(10 + i % 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "order_id string, event_time timestamp_ntz, lon double, lat double, speed_kmh double")
    return ingest.normalize_points_v1(df, "B", "f")


def test_the_degree_line_as_a_job(spark, tmp_path):
    out = f"file://{tmp_path}/v1"
    batch.run_v1(spark, v1_points(spark, 200, 0, 0), out, "B-1", "20240605")
    batch.run_v1(spark, v1_points(spark, 200, 100, 0).unionByName(v1_points(spark, 50, 900, 3)), out, "B-2", "20240608")
    batch.run_v1(spark, v1_points(spark, 10, 5000, 9), out, "B-2", "20240608")  # finished already
    held = spark.read.parquet(f"{out}/points")
    assert held.count() == 200 + 200 + 50 and held.select("day").distinct().count() == 3
    rows = {r["batch_id"]: r for r in commits.rows(spark, out, "v1").collect()}
    assert set(rows) == {"B-1", "B-2"} and rows["B-2"]["grid_count"] == 15 and rows["B-2"]["hotspot_count"] > 0
    assert spark.read.parquet(f"{out}/lisa").where("analysis_version = 'B-2'").count() == 15
    with pytest.raises(ValueError, match="at least 3"):
        batch.run_v1(spark, v1_points(spark, 2, 0, 0), f"{out}-few", "B-1", "x")
    few = spark.createDataFrame([("a", T + timedelta(hours=i), i) for i in range(4)], "key string, bucket_ts timestamp_ntz, value long")
    r = overspeed_v1.mann_kendall(few, least=overspeed_v1.TREND_BUCKETS).first()
    assert (r["n"], r["s"], r["p"], r["trend"]) == (4, 0, 1.0, "no trend")


def test_a_growing_store_rewrites_touched_days_only(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    days = [v1_points(spark, 20, 0, d).withColumn("source_row", F.monotonically_increasing_id()) for d in range(4)]
    for d in days:
        overspeed_v1.merge_points(d, path)
    files_of = lambda: {str(p) for p in (tmp_path / "store").rglob("*.parquet")}
    before = files_of()
    again = days[2].unionByName(v1_points(spark, 25, 0, 2).withColumn("source_row", F.monotonically_increasing_id() + 100))
    overspeed_v1.merge_points(again, path)
    changed = {p.split("day=")[1][:10] for p in files_of() ^ before}
    assert changed == {"2024-06-07"}
    whole = spark.read.parquet(path)
    assert whole.count() == 85 and whole.dropDuplicates(list(overspeed_v1.POINT_KEY)).count() == 85
    plan = whole.where(F.col("day").isin([T.date()]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(day" in plan or "day#" in plan.split("PartitionFilters")[1][:60]


def test_feedback_of_a_database(spark):
    """The Derby database that comes with Spark, in memory."""
    url, driver = "jdbc:derby:memory:feedback;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(f"F{i:03d}", f"c{i}", f"A{i % 4}", "public", 116.5, 39.7, "", f"2024-01-{1 + i % 9:02d} 08:00:{i % 60:02d}") for i in range(90)]
    schema = "feedback_id string, content string, area_id string, user_type string, lon double, lat double, photo_path string, created_at string"
    df = spark.createDataFrame(rows, schema)
    types = ", ".join(f"{c} VARCHAR(64)" for c in schema.replace("lon double, lat double, ", "").replace(" string", "").split(", "))
    df.write.mode("overwrite").option("createTableColumnTypes", types).jdbc(url, "feedbacks", properties=driver)
    got = files.read_feedback_jdbc(spark, url, limit=7, **driver)
    want = sorted(rows, key=lambda r: (r[-1], r[0]), reverse=True)[:7]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "FETCH FIRST 7 ROWS ONLY" in got._jdf.queryExecution().toString() or "newest" in got._jdf.queryExecution().toString()
    some = files.read_feedback_days_jdbc(spark, url, ["2024-01-02", "2024-01-05"], **driver)
    near = some.where("area_id = 'A1'")
    assert some.rdd.getNumPartitions() == 2 and some.count() == 20 and near.count() == sum(r[2] == "A1" and r[-1][:10] in ("2024-01-02", "2024-01-05") for r in rows)
    assert "EqualTo(area_id,A1)" in near._jdf.queryExecution().toString()


def test_one_vehicle_with_all_points(spark):
    """Its slices are dealt to all tasks; numbers are those of the plain scan."""
    rnd, t, rows = random.Random(8), T, []
    for i in range(3000):
        t += timedelta(seconds=rnd.choice([0, 5, 5, 30, 179, 180, 181, 4000]))
        rows.append(("V", t, i, int(rnd.random() < 0.02), 116.5 + i * 1e-5, 39.7))
    rows += [("W", T + timedelta(days=9), 5000, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "vehicle_id string, time timestamp_ntz, event_id long, segment_flag int, lon double, lat double").repartition(5)
    want, last, seq, order = {}, None, 0, 0
    for v, t, i, flag, lon, lat in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        new = last is None or last[0] != v or flag == 1 or (t - last[1]).total_seconds() > 180
        seq, order = (1 if last is None or last[0] != v else seq + 1, 0) if new else (seq, order + 1)
        want[i] = (seq, order, None if new else (last[1], last[2], last[3]))
        last = (v, t, lon, lat)
    for seconds in (600, 6 * 3600, 10**9):
        out = ingest.segment_trajectories(df, slice_s=seconds)
        got = {r["event_id"]: (r["segment_seq"], r["point_order"], tuple(r["before"]) if r["before"] else None) for r in out.collect()}
        assert got == want, seconds
    spread = ingest.segment_trajectories(df, slice_s=600).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(spread) >= 4 and max(r["n"] for r in spread) < 2000
    old = ingest.point_kinematics(ingest.segment_trajectories(df).drop("before")).select("event_id", "dt_s", "dist_m")
    new = ingest.point_kinematics(ingest.segment_trajectories(df)).select("event_id", "dt_s", "dist_m")
    assert sorted(map(str, old.collect())) == sorted(map(str, new.collect()))


def test_trend_by_blocks(spark):
    rng = np.random.default_rng(3)
    series = {"a": rng.integers(0, 9, 300), "b": np.arange(50), "c": np.zeros(20, int), "d": rng.integers(0, 10**6, 500), "e": np.array([1, 2])}
    rows = [(k, T + timedelta(hours=int(i)), int(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key string, bucket_ts timestamp_ntz, value long").repartition(3)
    for blocks in (1, 7, 64):
        got = {r["key"]: r["s"] for r in overspeed_v1.mann_kendall(df, blocks=blocks).collect()}
        assert got == {k: int(sum(np.sign(x[i + 1 :] - x[i]).sum() for i in range(len(x)))) for k, x in series.items()}


def test_orders_days_and_knowledge_base(spark, tmp_path):
    rows = [("V2", T, 1, 0), ("V1", T + timedelta(seconds=5), 1, 1), ("V1", T, 1, 0)]
    df = spark.createDataFrame(rows, "vehicle_id string, time timestamp_ntz, segment_seq int, point_order int")
    assert [(r["vehicle_id"], r["point_order"]) for r in ingest.order_points(df).collect()] == [("V1", 0), ("V1", 1), ("V2", 0)]
    events = spark.createDataFrame([("b", T, "s", 1.0), ("a", T, "s", 2.0), ("a", T, "s", 1.0)], "event_type string, start_time timestamp_ntz, segment_id string, value_main double")
    assert [(r["event_type"], r["value_main"]) for r in behavior.order_events(events).collect()] == [("a", 1.0), ("a", 2.0), ("b", 1.0)]
    days = spark.createDataFrame([(T.replace(hour=0) + timedelta(hours=h),) for h in (-1, 0, 23, 24, 47, 48)], "event_time timestamp_ntz")
    assert ingest.filter_days(days, "2024-06-05", "2024-06-05").count() == 2 and ingest.filter_days(days, None, "2024-06-06").count() == 5 and ingest.filter_days(days, "2024-06-06").count() == 3
    rule = '{"rule_id": "R", "title": "t", "applicable_behavior": "overspeed", "risk_condition": "", "action_text": "x", "basis_id": "B1", "caution": "c", "priority": 3, "enabled": true}'
    (tmp_path / "kb.json").write_text('{"version": "KB-2.0",\n "rules": [' + rule + '], "basis": {"B1": {"name": "n", "content": "text", "source": "s"}}}')
    rules, basis = advice.read_knowledge_base(spark, f"file://{tmp_path}/kb.json")
    assert rules.first()["priority"] == 3 and advice.enabled_rules(rules).count() == 1 and basis.first()["content"] == "text"
    grid = spark.createDataFrame([(i,) for i in range(3)], "grid_id int")
    assert spatial.assert_min_cells(grid) is grid
