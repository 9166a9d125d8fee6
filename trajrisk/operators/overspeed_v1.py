"""The degree-grid line: flags, cells, hot spots, hourly and daily series, trend, alerts, dashboard tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import mercator_mid_lat
from ..functions.labels import alert_level, alert_type, control_suggestions, control_text, evolution_pattern, high_risk_period, pattern_color, time_slice
from ..params import DEFAULTS, Params
from ..sources.tables import delete, stored
from .numbering import numbered


#: Blocks of time in which the signs of a series are counted.
BLOCKS = 64
#: A trend is tested for series of more buckets than this.
TREND_BUCKETS = 4


def overspeed_flag(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return points.withColumn("is_overspeed", (F.col("speed_kmh") >= p.overspeed_kmh).cast("int"))


POINT_KEY = ("order_id", "event_time", "lon", "lat")


def append_points_dedup(existing: DataFrame, new: DataFrame, order: str = "source_row") -> DataFrame:
    """Both, one row for each (order_id, event_time, lon, lat): an existing one before a new one, then the first by ``order``."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    first = Window.partitionBy(*POINT_KEY).orderBy("__new", order)
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__new")


def merge_points(new: DataFrame, path: str, order: str = "source_row") -> DataFrame:
    """Append to a growing store of points below ``path``, partitioned by ``day``; what was merged.

    Equal points have one time, so only the days of ``new`` are read, merged and written anew; all others stay as they
    are. The merged days are stored before they replace the old ones, so that a failure leaves the store as it was.
    """
    spark = new.sparkSession
    fresh = stored(new.withColumn("day", F.to_date("event_time")), "new_points")
    try:
        held = spark.read.parquet(path)
    except AnalysisException:  # the first points of the store
        held = None
    days = [r["day"] for r in fresh.select("day").distinct().collect()]  # of one batch
    old = fresh.limit(0) if held is None else held.where(F.col("day").isin(days)).select(*fresh.columns)
    merged = stored(append_points_dedup(old, fresh, order), "merged_points")
    merged.repartition("day").write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    delete(fresh)
    return merged


def v1_grid(points: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Cells of ``v1_cell_deg``: corner, centre, counts, mean speed, first and last time, time slice."""
    c = p.v1_cell_deg
    cells = points.withColumns({"gx": F.floor(F.col("lon") / c), "gy": F.floor(F.col("lat") / c)})
    out = cells.groupBy("gx", "gy").agg(
        F.sum("is_overspeed").alias("overspeed_count"), F.count("order_id").alias("trajectory_count"),
        F.avg("speed_kmh").alias("mean_speed"), F.min("event_time").alias("time_min"), F.max("event_time").alias("time_max"),
    )
    lon, lat = F.col("gx") * c, F.col("gy") * c
    return out.withColumns({
        "grid_id": F.concat(F.lit("G"), F.col("gx"), F.lit("_"), F.col("gy")), "lon_min": lon, "lat_min": lat, "center_lon": lon + c / 2,
        "center_lat": mercator_mid_lat(lat, lat + c), "time_slice": time_slice(F.col("time_min"), F.col("time_max")),
    })


def v1_hotspot_fallback(grid: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The cells of most overspeeds; z is 2.1 from their median on and 1.7 below."""
    top = grid.orderBy(F.desc("overspeed_count"), "grid_id").limit(p.fallback_n)
    half = top.agg(F.median("overspeed_count").alias("half"))  # of at most ``fallback_n`` rows
    z = F.when(F.col("overspeed_count") >= F.col("half"), 2.1).otherwise(1.7)
    level = F.when(F.col("gi_z") >= 2.58, "high").when(F.col("gi_z") >= 1.96, "medium").otherwise("low")
    return top.crossJoin(half).withColumn("gi_z", z).withColumn("risk_level", level).drop("half")  # one row


def hotspot_ids(hotspots: DataFrame) -> DataFrame:
    """``area_id`` HS-0001 and so on by score, the highest first."""
    out = numbered(hotspots, [F.desc("gi_z"), F.col("grid_id")], "__number")
    return out.withColumn("area_id", F.format_string("HS-%04d", F.col("__number") + 1)).drop("__number")


def alert_ids(alerts: DataFrame, stamp: str) -> DataFrame:
    out = numbered(alerts, ["area_id"], "__number")
    return out.withColumn("alert_id", F.format_string(f"ALERT-{stamp}-%04d", F.col("__number") + 1)).drop("__number")


def top_hotspots(hotspots: DataFrame, n: int = 10) -> DataFrame:
    return hotspots.orderBy(F.desc("gi_z"), "area_id").limit(n)


def filter_hotspots(hotspots: DataFrame, level: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Of one level (``all`` or none: of any), and with a time span that overlaps the given one."""
    out = hotspots if level in (None, "all") else hotspots.where(F.col("risk_level") == level)
    if start is None:
        return out
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end or start).cast("timestamp_ntz")
    apart = (F.col("time_max") < a) | (F.col("time_min") > b)
    return out.where(F.coalesce(~apart, F.lit(True)))


def tag_evolution(hotspots: DataFrame, trend: DataFrame) -> DataFrame:
    """``evolution_pattern`` and ``pattern_color`` from the level, the score and the trend's z (one row)."""
    rows = hotspots.crossJoin(F.broadcast(trend.select(F.col("z").alias("trend_z"))))
    rows = rows.withColumn("evolution_pattern", evolution_pattern(F.col("risk_level"), F.col("gi_z"), F.col("trend_z")))
    return rows.withColumn("pattern_color", pattern_color(F.col("evolution_pattern"))).drop("trend_z")


def hotspot_export_rows(hotspots: DataFrame, level: str | None = None) -> DataFrame:
    out = filter_hotspots(hotspots, level).withColumn("control", control_text(F.col("risk_level")))
    return out.select("area_id", "grid_id", "risk_level", "time_slice", "gi_z", "trajectory_count", "center_lon", "center_lat", "control")


def generate_alerts(hotspots: DataFrame, trend: DataFrame, stamp: str) -> DataFrame:
    """One pending alert for each hot spot of medium or high risk."""
    rows = hotspots.crossJoin(F.broadcast(trend.select(F.col("z").alias("trend_z"))))  # one row
    rows = rows.withColumn("alert_level", alert_level(F.col("risk_level"), F.col("gi_z"), F.col("trend_z"))).where("alert_level IS NOT NULL")
    rows = rows.withColumns({
        "alert_type": alert_type(F.col("alert_level")), "expected_period": high_risk_period(F.col("time_slice")),
        "control_suggestions": control_suggestions(F.col("alert_level")), "status": F.lit("pending"),
    })
    return alert_ids(rows, stamp).select(
        "alert_id", "area_id", "grid_id", "alert_level", "alert_type", "risk_level", "gi_z", "center_lon", "center_lat", "time_slice", "trajectory_count",
        "expected_period", "control_suggestions", "status",
    )


def filter_alerts(alerts: DataFrame, level: str | None = None, status: str | None = None) -> DataFrame:
    out = alerts if level is None else alerts.where(F.col("alert_level") == level)
    return out if status is None else out.where(F.col("status") == status)


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """Counts by level, by status and in all, in one pass."""
    return alerts.sparkSession.sql("SELECT alert_level, status, count(*) AS n FROM {a} GROUP BY GROUPING SETS ((alert_level), (status), ())", a=alerts)


def risk_distribution(hotspots: DataFrame) -> DataFrame:
    return hotspots.agg(*(F.count_if(F.col("risk_level") == x).alias(x) for x in ("high", "medium", "low")))


def dashboard_metrics(grid: DataFrame, hotspots: DataFrame, moran: DataFrame, trend: DataFrame) -> DataFrame:
    """One row: cells, hot spots, Moran's I and p, trend, hot spots by level."""
    one = grid.agg(F.count("*").alias("grid_count")).crossJoin(hotspots.agg(F.count("*").alias("hotspot_count")))
    return one.crossJoin(moran.select("moran_i", F.col("p").alias("moran_p"))).crossJoin(trend.select(F.col("z").alias("trend_z"), "trend")).crossJoin(risk_distribution(hotspots))


def hourly_distribution(points: DataFrame, by: str | None = None) -> DataFrame:
    """By hour of the day (of each area ``by``), with a mark at the hour of most overspeeds (the first of equals)."""
    key = [by] if by else []
    hours = points.groupBy(*key, F.hour("event_time").alias("hour")).agg(F.sum("is_overspeed").alias("overspeed"), F.count("*").alias("n"))
    peak = hours.groupBy(*key).agg(F.max_by("hour", F.struct("overspeed", -F.col("hour"))).alias("peak"))
    both = hours.join(peak, key) if by else hours.crossJoin(F.broadcast(peak))  # one row
    return both.select(*key, "hour", "overspeed", "n", (F.col("hour") == F.col("peak")).alias("is_peak"))


def daily_trend(points: DataFrame, day: str | None = None, by: str | None = None) -> DataFrame:
    """By day; of one ``day`` by hour; of each area ``by``."""
    key = F.to_date("event_time").alias("day") if day is None else F.hour("event_time").alias("hour")
    rows = points if day is None else points.where(F.to_date("event_time") == F.lit(day).cast("date"))
    keys = [by, key] if by else [key]
    return rows.groupBy(*keys).agg(F.sum("is_overspeed").alias("overspeed"), F.count("*").alias("n"), F.bround(F.avg("speed_kmh"), 6).alias("mean_speed"))


#: Names of the gender, and the ages, of the riders that education is for.
MALE, YOUNG = ("男", "male", "m"), (18, 30)


def young_male_share(points: DataFrame, by: str = "grid_id") -> DataFrame:
    """``by, young_male``: the share of points of young men in all points whose gender and age are known; null without such."""
    gender, age = F.lower(F.trim("gender")), F.col("age")
    known = gender.isNotNull() & (gender != "未知") & (age >= 0)
    return points.groupBy(by).agg(F.avg(F.when(known, (gender.isin(*MALE) & age.between(*YOUNG)).cast("double"))).alias("young_male"))


def gap_fill_hours(hours: DataFrame) -> DataFrame:
    """``bucket_ts, value`` with empty hours as 0, from the first hour to the last."""
    span = hours.agg(F.min("bucket_ts").alias("a"), F.max("bucket_ts").alias("b")).where("a IS NOT NULL")
    calendar = span.select(F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("bucket_ts"))
    return calendar.join(hours, "bucket_ts", "left").select("bucket_ts", F.coalesce("value", F.lit(0)).alias("value"))


def hourly_series(points: DataFrame) -> DataFrame:
    bucket = F.date_trunc("hour", "event_time").cast("timestamp_ntz").alias("bucket_ts")
    return gap_fill_hours(points.groupBy(bucket).agg(F.sum("is_overspeed").alias("value")))


def sign_sum(values: np.ndarray) -> int:
    """Sum of the signs of later minus earlier values over all pairs, by merging sorted halves."""
    total = 0
    blocks = [values[i : i + 1] for i in range(len(values))]
    while len(blocks) > 1:
        merged = []
        for a, b in zip(blocks[::2], blocks[1::2], strict=False):
            lower, upper = np.searchsorted(a, b, "left"), np.searchsorted(a, b, "right")
            total += int(lower.sum() - (len(a) - upper).sum())
            merged.append(np.sort(np.concatenate([a, b]), kind="stable"))
        if len(blocks) % 2:
            merged.append(blocks[-1])
        blocks = merged
    return total


def mann_kendall(series: DataFrame, key: str = "key", alpha: float = 0.05, least: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """``key, n, s, var_s, z, p, tau, trend`` of each key's series (``bucket_ts, value``): tie-corrected variance, continuity
    correction, two-sided test. Series of ``least`` or fewer buckets have no trend, S and z 0 and p 1.

    A key's time is cut into ``blocks`` of equal length. Signs inside a block are counted in its own task; those between
    blocks come from the blocks' value histograms: for each value of a block, how many values of earlier blocks are less
    and how many are greater, by running sums over blocks and then over values.
    """
    kind = series.schema[key].dataType.simpleString()
    span = series.groupBy(key).agg(F.min("bucket_ts").alias("t0"), F.max("bucket_ts").alias("t1"))
    step = lambda a, b: F.timestamp_diff("MICROSECOND", F.col(a).cast("timestamp_ntz"), F.col(b).cast("timestamp_ntz"))
    block = F.floor(step("t0", "bucket_ts") / (step("t0", "t1") + 1) * blocks).cast("int")
    rows = series.join(span, key).select(key, block.alias("block"), "bucket_ts", F.col("value").cast("double").alias("value"))

    def inside(group: pa.Table) -> pa.Table:
        x = group.sort_by("bucket_ts").column("value").to_numpy()
        return pa.table({key: group.column(key).slice(0, 1), "s": pa.array([sign_sum(x)], pa.int64())})

    own = rows.groupBy(key, "block").applyInArrow(inside, f"{key} {kind}, s long").groupBy(key).agg(F.sum("s").alias("s"))
    counts = rows.groupBy(key, "block", "value").agg(F.count("*").alias("h"))
    there = counts.select(key, "block").distinct().join(counts.select(key, "value").distinct(), key)  # blocks x distinct values
    full = there.join(counts, [key, "block", "value"], "left").withColumn("h", F.coalesce("h", F.lit(0)))
    earlier = Window.partitionBy(key, "value").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("before", F.coalesce(F.sum("h").over(earlier), F.lit(0)))
    within = Window.partitionBy(key, "block")
    less = F.coalesce(F.sum("before").over(within.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    full = full.withColumns({"less": less, "all": F.sum("before").over(within)})
    cross = full.groupBy(key).agg(F.sum(F.col("h") * (F.col("less") - (F.col("all") - F.col("less") - F.col("before")))).alias("between"))
    ties = rows.groupBy(key, "value").agg(F.count("*").alias("t")).groupBy(key)
    t = F.col("t").cast("double")
    facts = ties.agg(F.sum("t").alias("n"), F.sum(t * (t - 1) * (2 * t + 5)).alias("tied"))
    one = facts.join(own, key).join(cross, key).select(key, "n", (F.col("s") + F.col("between")).alias("s"), "tied")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, s, tied in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                var = (n * (n - 1) * (2 * n + 5) - tied) / 18
                s = s if n > least else 0
                z = (s - (s > 0) + (s < 0)) / math.sqrt(var) if s and var > 0 else 0.0
                p = math.erfc(abs(z) / math.sqrt(2))
                trend = "no trend" if p >= alpha else "increasing" if z > 0 else "decreasing"
                out.append((n, s, round(var, 4), round(float(z), 6), round(p, 6), round(s / (n * (n - 1) / 2), 6) if n > 1 else 0.0, trend))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.string()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "n", "s", "var_s", "z", "p", "tau", "trend"])

    return one.mapInArrow(test, f"{key} {kind}, n long, s long, var_s double, z double, p double, tau double, trend string")


def mean_slope_trend(series: DataFrame, key: str = "key") -> DataFrame:
    """Sign of the mean difference of consecutive values; it is that of the last value against the first."""
    order = F.struct("bucket_ts")
    out = series.groupBy(key).agg(F.count("*").alias("n"), F.max_by("value", order).alias("last"), F.min_by("value", order).alias("first"))
    slope = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)).otherwise(0.0)
    trend = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("no trend")
    return out.select(key, "n", F.bround(slope, 6).alias("slope")).withColumn("trend", trend)
