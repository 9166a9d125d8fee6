"""Risk events of single trajectories: overspeed, hard acceleration and braking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..params import DEFAULTS, Params
from ..sources.tables import stored
from .ingest import seconds_between
from .numbering import numbered

CHAIN = ("vehicle_id", "segment_seq")


def without_drift(points: DataFrame) -> DataFrame:
    """Speeds of drift points as unknown, so that such a point is no event and breaks those around it."""
    fine = F.coalesce(F.col("quality_flag") != "drift", F.lit(True))
    return points.withColumns({c: F.when(fine, F.col(c)) for c in ("speed_kmh", "speed_mps") if c in points.columns})


def overspeed_events(points: DataFrame, p: Params = DEFAULTS, skip_drift: bool = False) -> DataFrame:
    """Maximal runs of speeds strictly over the limit, of enough seconds and points; a null speed breaks a run."""
    points = without_drift(points) if skip_drift else points
    chain = Window.partitionBy(*CHAIN).orderBy("point_order")
    over = F.coalesce(F.col("speed_kmh") > p.overspeed_kmh, F.lit(False))
    run = F.sum(F.when(~over, 1).otherwise(0)).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    runs = points.withColumn("run", run).where(over)
    peak = F.max_by(F.struct("speed_kmh", "lon", "lat"), F.struct("speed_kmh", -F.col("point_order")))
    out = runs.groupBy(*CHAIN, "segment_id", "run").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("n_points"), peak.alias("peak")
    )
    out = out.withColumn("duration_s", seconds_between(F.col("start_time"), F.col("end_time")))
    out = out.where((F.col("duration_s") >= p.overspeed_s) & (F.col("n_points") >= p.overspeed_points))
    peak_kmh = F.bround("peak.speed_kmh", 2)
    detail = F.to_json(F.struct(peak_kmh.alias("peak_kmh"), F.lit(p.overspeed_kmh).alias("threshold_kmh"), "n_points"))
    return out.select(
        F.lit("overspeed").alias("event_type"), *CHAIN, "segment_id", "start_time", "end_time", F.bround("duration_s", 1).alias("duration_s"),
        peak_kmh.alias("value_main"), F.col("peak.lon").alias("lon"), F.col("peak.lat").alias("lat"), detail.alias("detail"),
    )


def motion_pairs(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Consecutive points with both speeds and 0 < dt <= ``rapid_dt_s``: acceleration ``a`` and start speed ``v0``."""
    chain = Window.partitionBy(*CHAIN).orderBy("point_order")
    v0 = F.lag("speed_mps").over(chain)
    pairs = points.withColumns({"v0": v0, "t0": F.lag("time").over(chain)})
    pairs = pairs.where((F.col("dt_s") > 0) & (F.col("dt_s") <= p.rapid_dt_s) & F.col("v0").isNotNull() & F.col("speed_mps").isNotNull())
    return pairs.withColumn("a", (F.col("speed_mps") - F.col("v0")) / F.col("dt_s"))


def accel_thresholds(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """P85 and P15 of accelerations between moving points; one row."""
    moving = motion_pairs(points, p).where((F.col("v0") >= p.moving_mps) & (F.col("speed_mps") >= p.moving_mps))
    moving = stored(moving.select("a"), "moving")  # read several times, and made by a shuffle of the points
    out = exact_quantiles(moving, "a", (0.85, 0.15))
    return out.select(F.col("n").alias("n_motion"), F.bround(F.get("q", F.lit(0)), 3).alias("p85"), F.bround(F.get("q", F.lit(1)), 3).alias("p15"))


def rapid_events(points: DataFrame, thresholds: DataFrame, p: Params = DEFAULTS, skip_drift: bool = False) -> DataFrame:
    """Hard accelerations (from a moving start) and brakings, at the second point of a pair."""
    points = without_drift(points) if skip_drift else points
    pairs = motion_pairs(points, p).crossJoin(F.broadcast(thresholds))  # thresholds: one row
    kind = F.when((F.col("a") > F.col("p85")) & (F.col("v0") >= p.moving_mps), "rapid_accel").when(F.col("a") < F.col("p15"), "rapid_decel")
    kmh = lambda c: F.bround(F.col(c) * 3.6, 2)
    detail = F.to_json(F.struct(F.bround("a", 3).alias("a_mps2"), kmh("v0").alias("from_kmh"), kmh("speed_mps").alias("to_kmh"), F.bround("dt_s", 1).alias("dt_s")))
    return pairs.withColumn("event_type", kind).where("event_type IS NOT NULL").select(
        "event_type", *CHAIN, "segment_id", F.col("t0").alias("start_time"), F.col("time").alias("end_time"),
        F.bround("dt_s", 1).alias("duration_s"), F.bround("a", 3).alias("value_main"), "lon", "lat", detail.alias("detail"),
    )


def union_events(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def event_ids(events: DataFrame) -> DataFrame:
    """Dense ids ``EV-000001`` and so on in the order (type, start, segment, value)."""
    out = numbered(events, ["event_type", "start_time", "segment_id", "value_main"], "__number")
    return out.withColumn("event_id", F.format_string("EV-%06d", F.col("__number") + 1)).drop("__number")


def order_events(events: DataFrame) -> DataFrame:
    """Sorted for export."""
    return events.orderBy("event_type", "start_time", "segment_id", "value_main")


def event_counts(events: DataFrame) -> DataFrame:
    """Events by type, and in all under ``total``."""
    return events.rollup("event_type").agg(F.count("*").alias("n"), F.grouping("event_type").alias("g")).select(
        F.when(F.col("g") == 1, "total").otherwise(F.col("event_type")).alias("event_type"), "n"
    )
