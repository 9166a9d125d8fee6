"""Streams in append mode: late rows, bounded state, restarts; sub-chains of a stream against those of a batch."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trajrisk.operators import ingest
from trajrisk.streaming import run, streams

T = datetime(2024, 6, 5, 8)
POINT = "order_id long, event_time timestamp, is_overspeed int"


def put(spark, folder, name, rows, schema):
    """One file, as one micro-batch reads it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"file://{folder}/{name}")


def read(spark, folder, schema):
    os.makedirs(folder, exist_ok=True)
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def test_hours_are_given_once_and_late_rows_dropped(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    stream = streams.stream_hourly_overspeed(read(spark, src, POINT))
    states = []
    for k in range(6):  # six hours, a run of the query for each: it is restarted from its checkpoint
        rows = [(100 * k + i, T + timedelta(hours=k, minutes=i), 1) for i in range(60)]
        if k == 4:
            rows.append((999, T + timedelta(minutes=5), 1))  # its hour has long been given
            rows.append((998, T + timedelta(hours=3, minutes=55), 1))  # out of order, but in time
        put(spark, src, f"f{k}", rows, POINT)
        progress = run.run_stream(stream, "append", out)
        states += [o["numRowsTotal"] for p in progress for o in p["stateOperators"]]
    got = [(r["bucket_ts"], r["value"]) for r in run.result(stream, out).collect()]
    assert len(got) == len(dict(got)) == 5  # the last hour is open
    assert dict(got) == {T + timedelta(hours=k): 60 + (k == 3) for k in range(5)}
    assert max(states) <= 3  # open hours, not all hours


def chains(rows):
    """Plain definition: runs of a vehicle's points by time and id."""
    out = []
    for v in sorted({r[0] for r in rows}):
        last = None
        for _, t, _, flag, speed in sorted((r for r in rows if r[0] == v), key=lambda r: (r[1], r[2])):
            if last is None or flag == 1 or (t - last[2]).total_seconds() > 180:
                last = [v, t, t, 0, speed]
                out.append(last)
            last[2], last[3], last[4] = t, last[3] + 1, max(last[4], speed)
    return sorted(map(tuple, out))


def test_segments_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Flags, gaps, rows out of order, and runs over several files; the query is restarted for each file."""
    rnd, rows = random.Random(4), []
    for v in range(6):
        t = T
        for i in range(150):
            t += timedelta(seconds=rnd.choice([5, 5, 5, 60, 180, 181, 400]))
            rows.append((f"V{v}", t, 1000 * v + i, int(rnd.random() < 0.05), float(rnd.randint(0, 60))))
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rnd.randint(0, 240)))  # up to four minutes out of order
    end = max(r[1] for r in rows) + timedelta(hours=2)
    parts = [rows[:300], rows[300:301], rows[301:700], rows[700:], [("Z", end, 1, 0, 1.0)]]  # the last one moves the watermark on
    schema = "vehicle_id string, time timestamp, event_id long, segment_flag int, speed_kmh double"
    src, out = f"{tmp_path}/in", f"file://{tmp_path}/out"
    stream = streams.stream_segments(read(spark, src, schema))
    counts, states = [], []
    for k, part in enumerate(parts):
        put(spark, src, f"f{k}", part, schema)
        progress = run.run_stream(stream, "append", out)
        counts.append(run.result(stream, out).count())
        states += [o["numRowsTotal"] for p in progress for o in p["stateOperators"]]
    got = sorted(tuple(r) for r in run.result(stream, out).collect())
    assert got == chains(rows) and counts[0] > 0 and counts == sorted(counts)
    assert max(states) < 300  # points that wait and open runs, not all points
    # The batch operator on the same points.
    df = spark.createDataFrame(rows, schema.replace("timestamp", "timestamp_ntz")).withColumns({"lon": F.lit(1.0), "lat": F.lit(1.0)})
    batch = ingest.segment_trajectories(df).groupBy("vehicle_id", "segment_seq").agg(F.min("time").alias("a"), F.max("time").alias("b"), F.count("*").alias("n"), F.max("speed_kmh").alias("m"))
    assert sorted(tuple(r) for r in batch.drop("segment_seq").collect()) == got
