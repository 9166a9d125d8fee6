"""Streaming forms of three batch operators; each takes and gives a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params
from .segments import OUTPUT, Segments


def stream_hourly_overspeed(points: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``bucket_ts, value``: overspeeds by hour; hours end when the watermark has passed them, later rows are dropped.

    In append mode an hour is given once, when it has ended, and only the hours that have not are in the state.
    """
    hours = points.withWatermark("event_time", late).groupBy(F.window("event_time", "1 hour"))
    return hours.agg(F.sum("is_overspeed").alias("value")).select(F.col("window.start").alias("bucket_ts"), "value")


def stream_point_dedup(points: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first of points with one (order_id, event_time, lon, lat), as long as the watermark keeps it in the state."""
    return points.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["order_id", "event_time", "lon", "lat"])


def stream_segments(points: DataFrame, late: str = "10 minutes", p: Params = DEFAULTS) -> DataFrame:
    """``vehicle_id, start_time, end_time, n_points, max_speed`` of the sub-chains of ``segment_trajectories``: a new one at
    a flagged row (``segment_flag`` 1) and after a gap of more than ``gap_s``; rows of one time follow ``event_id``.

    Rows wait until the watermark has passed them, so that rows up to ``late`` out of order take their place; a sub-chain
    is given once, in append mode, when the watermark has passed its end by the gap or its next one has begun. Without
    the columns ``segment_flag`` or ``event_id`` no row is flagged, and equal times stand in any order. The state needs
    Spark's RocksDB store, which ``run.available_now`` sets.
    """
    extra = {n: F.lit(0).cast(t) for n, t in (("segment_flag", "int"), ("event_id", "long")) if n not in points.columns}
    rows = points.withColumns(extra) if extra else points
    rows = rows.select("vehicle_id", "time", F.col("event_id").cast("long").alias("event_id"), F.col("segment_flag").cast("int").alias("segment_flag"), "speed_kmh")
    runs = rows.withWatermark("time", late).groupBy("vehicle_id")
    return runs.transformWithStateInPandas(Segments(p.gap_s), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
