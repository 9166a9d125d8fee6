"""Raw trajectory rows to standard points: types, quarantine, segments, kinematics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.quantiles import exact_quantiles
from ..params import DEFAULTS, Params

#: Seconds of a slice of time, by which a vehicle's points are dealt out.
SLICE_S = 6 * 3600
#: Accepted column names by standard name, the first that exists is taken.
REQUIRED = {
    "time": ["POSITIONTIME", "position_time", "Time", "时间", "定位时间"],
    "lon": ["X_position", "longitude", "lon", "x", "经度"],
    "lat": ["Y_position", "latitude", "lat", "y", "纬度"],
    "vehicle_id": ["BICYCLEID", "bicycle_id", "bike_id", "vehicle_id", "ID"],
}
OPTIONAL = {
    "device_id": ["NEW_BICYCLEID", "device_id"], "company_id": ["COMPANYID", "company_id"], "lock_id": ["LOCKID", "lock_id"],
    "lock_status": ["LOCKSTATUS", "lock_status"], "segment_flag": ["TID", "tid"], "raw_speed_mps": ["Speed", "speed"],
    "raw_distance": ["Distance", "distance"], "raw_duration": ["Time_consuming", "time_consuming"], "ts_raw": ["TS"],
}


def resolve_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Standard columns by case-insensitive alias; missing required ones are an error, missing optional ones null."""
    there = {}
    for c in df.columns:
        there.setdefault(c.strip().lower(), c)
    pick = {name: next((there[a.lower()] for a in aliases if a.lower() in there), None) for name, aliases in (REQUIRED | OPTIONAL).items()}
    if missing := [f"{n} (one of {', '.join(REQUIRED[n])})" for n in REQUIRED if pick[n] is None]:
        raise ValueError("missing columns: " + "; ".join(missing))
    return df.select(*keep, *(F.lit(None).cast("string").alias(n) if c is None else F.col(f"`{c}`").cast("string").alias(n) for n, c in pick.items()))


def coerce_types(df: DataFrame) -> DataFrame:
    """Text to time and numbers; what does not parse is null, flags default to 0."""
    return df.withColumns({
        "time": F.expr("try_cast(time AS timestamp_ntz)"), "lon": F.expr("try_cast(lon AS double)"), "lat": F.expr("try_cast(lat AS double)"),
        "raw_speed_mps": F.expr("try_cast(raw_speed_mps AS double)"), "segment_flag": F.expr("coalesce(try_cast(segment_flag AS int), 0)"),
        "lock_status": F.expr("coalesce(try_cast(lock_status AS int), 0)"),
    })


def tag_invalid(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``isolate_reason``: null for good rows; each coordinate that exists is tested against its own range."""
    x0, y0, x1, y1 = p.bbox
    outside = lambda c, a, b: F.col(c).isNotNull() & ~F.col(c).between(a - p.margin, b + p.margin)
    out, both = outside("lon", x0, x1) | outside("lat", y0, y1), F.col("lon").isNotNull() & F.col("lat").isNotNull()
    reason = F.when(F.col("time").isNull(), "invalid_time").when(out, "coord_out_of_range").when(~both, "invalid_coord")
    return df.withColumn("isolate_reason", reason)


def split_valid(df: DataFrame) -> DataFrame:
    return df.where("isolate_reason IS NULL").drop("isolate_reason")


def split_isolated(df: DataFrame) -> DataFrame:
    return df.where("isolate_reason IS NOT NULL")


def isolated_ratio(df: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.count("isolate_reason")
    return df.agg(n.alias("rows_total"), bad.alias("rows_isolated"), F.bround(F.try_divide(bad, n), 4).alias("ratio"))


def assert_isolated_ratio(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Fails when more than ``max_isolated`` of the rows are rejected."""
    row = isolated_ratio(df).first()
    if row["rows_total"] and row["rows_isolated"] > p.max_isolated * row["rows_total"]:
        raise ValueError(f"{row['rows_isolated']} of {row['rows_total']} rows are rejected")
    return df


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def segment_trajectories(df: DataFrame, tie: str = "event_id", p: Params = DEFAULTS, slice_s: int = SLICE_S) -> DataFrame:
    """Sub-chains ``segment_seq, segment_id, point_order``: a new one at a vehicle's first row, a flagged row, or a gap of
    more than ``gap_s``; and ``before``, the time and place (if points have one) of the point before in the sub-chain.

    A segmented scan: points are dealt out by vehicle and slice of time, so that one vehicle's history spreads over
    tasks. A slice is folded to a row (points, breaks, first and last point); running sums over a vehicle's slices give
    what each one carries on, and its points add their own.
    """
    rows = df.withColumn("slice", F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("time")) / slice_s))
    key, point = ["vehicle_id", "slice"], F.struct(*(c for c in ("time", "lon", "lat") if c in df.columns))
    here = Window.partitionBy(*key).orderBy("time", tie)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"own": F.lag(point).over(here), "at": F.row_number().over(here) - 1})
    breaks = F.coalesce((F.col("segment_flag") == 1) | (seconds_between(F.col("own.time"), F.col("time")) > p.gap_s), F.lit(False)) & (F.col("at") > 0)
    rows = rows.withColumn("inner", breaks)
    folded = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.count_if("inner").alias("breaks"), F.max(F.when(F.col("inner"), F.col("at"))).alias("last_break"),
        F.min_by(F.struct("time", "segment_flag"), "at").alias("first"), F.max_by(point, "at").alias("last"),
    )
    slices = Window.partitionBy("vehicle_id").orderBy("slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumns({"carried": F.lag("last").over(slices), "base": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
    head = F.col("carried").isNull() | F.coalesce(F.col("first.segment_flag") == 1, F.lit(False)) | (seconds_between(F.col("carried.time"), F.col("first.time")) > p.gap_s)
    folded = folded.withColumn("head", head)
    folded = folded.withColumn("broken", F.col("base") + F.coalesce("last_break", F.when(F.col("head"), F.lit(0))))
    folded = folded.select(
        *key, "carried", "base", "head", F.coalesce(F.sum(F.col("breaks") + F.col("head").cast("int")).over(earlier), F.lit(0)).alias("seq_base"),
        F.max("broken").over(earlier).alias("broken"),
    )
    rows = rows.join(folded, key).withColumn("new", F.when(F.col("at") == 0, F.col("head")).otherwise(F.col("inner")))
    place = F.col("base") + F.col("at")
    begun = F.coalesce(F.max(F.when(F.col("new"), place)).over(so_far), F.col("broken"))
    rows = rows.withColumns({
        "segment_seq": F.col("seq_base") + F.sum(F.col("new").cast("int")).over(so_far), "point_order": (place - begun).cast("int"),
        "before": F.when(~F.col("new"), F.coalesce("own", "carried")),
    })
    rows = rows.drop("slice", "own", "at", "inner", "carried", "base", "head", "seq_base", "broken", "new")
    return rows.withColumn("segment_id", F.concat_ws("-", "vehicle_id", F.col("segment_seq").cast("string")))


def point_kinematics(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Time, distance and speed from the previous point of the sub-chain; null at its first point and where dt is 0.

    The previous point is ``before``, if the points have it, else it is looked up.
    """
    if "before" in df.columns:
        before = [F.col(f"before.{c}") for c in ("time", "lon", "lat")]
    else:
        chain = Window.partitionBy("vehicle_id", "segment_seq").orderBy("point_order")
        before = [F.lag(c).over(chain) for c in ("time", "lon", "lat")]
    dt = seconds_between(before[0], F.col("time"))
    return with_speeds(df.withColumns({"dt_s": dt, "dist_m": haversine_m(before[1], before[2], F.col("lon"), F.col("lat"))}), p)


#: Columns that ``with_speeds`` makes of time and distance, so that they needn't be stored.
SPEEDS = ("calc_speed_mps", "speed_mps", "speed_kmh", "quality_flag")


def with_speeds(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    out = df.withColumn("calc_speed_mps", F.when(F.col("dt_s") > 0, F.col("dist_m") / F.col("dt_s")))
    return out.withColumns({
        "speed_mps": F.col("calc_speed_mps"), "speed_kmh": F.col("calc_speed_mps") * 3.6,
        "quality_flag": F.when(F.col("calc_speed_mps") > p.drift_mps, "drift").otherwise("ok"),
    })


def batch_meta(tagged: DataFrame, points: DataFrame) -> DataFrame:
    kept = points.agg(
        F.count_distinct("vehicle_id").alias("n_vehicles"), F.count_distinct("vehicle_id", "segment_seq").alias("n_segments"),
        F.min("time").alias("time_min"), F.max("time").alias("time_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"),
    )
    return isolated_ratio(tagged).crossJoin(kept)


def speed_unit_check(points: DataFrame) -> DataFrame:
    """Median relative difference of raw and recomputed speed where the latter exceeds 0.3 m/s."""
    both = points.where("raw_speed_mps IS NOT NULL AND calc_speed_mps > 0.3")
    rel = F.abs(F.col("raw_speed_mps") - F.col("calc_speed_mps")) / F.col("calc_speed_mps")
    out = exact_quantiles(both.withColumn("rel", rel), "rel", (0.5,))
    return out.select("n", F.bround(F.get("q", F.lit(0)), 6).alias("median_rel"))


#: Accepted column names of the degree-grid line, the first that exists is taken.
V1_COLUMNS = {
    "order_id": ["order_id", "id", "record_id", "轨迹id"], "event_time": ["event_time", "time", "timestamp"],
    "lon": ["lon", "longitude", "x_position", "x", "经度"], "lat": ["lat", "latitude", "y_position", "y", "纬度"],
    "speed_kmh": ["speed_kmh", "speedkm", "speed"], "is_overspeed": ["is_overspeed", "overspeed", "overspeeding"], "gender": ["gender", "sex"],
    "age": ["age", "年龄"],
}
UNKNOWN_GENDER = "未知"


def normalize_points_v1(df: DataFrame, batch_id: str, source: str, p: Params = DEFAULTS) -> DataFrame:
    """Points of the degree-grid line: missing ids ``batch-n`` (by row), speed 0, flag by speed, gender unknown, age -1;
    rows without time or place are left out. Time, place and speed columns are required."""
    there = {}
    for c in df.columns:
        there.setdefault(c.strip().lower(), c)
    pick = {n: next((there[a] for a in names if a in there), None) for n, names in V1_COLUMNS.items()}
    if missing := [n for n in ("event_time", "lon", "lat", "speed_kmh") if pick[n] is None]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = {n: F.lit(None).cast("string") if c is None else F.col(f"`{c}`").cast("string") for n, c in pick.items()}
    if pick["order_id"] is None:  # numbered where rows are read, without gaps only inside a partition
        text["order_id"] = F.concat(F.lit(f"{batch_id}-"), (F.monotonically_increasing_id() + 1).cast("string"))
    speed = F.coalesce(text["speed_kmh"].try_cast("double"), F.lit(0.0))
    flag = F.coalesce(text["is_overspeed"].try_cast("double"), (speed >= p.overspeed_kmh).cast("double"))
    out = df.select(
        text["order_id"].alias("order_id"), text["event_time"].try_cast("timestamp_ntz").alias("event_time"), text["lon"].try_cast("double").alias("lon"),
        text["lat"].try_cast("double").alias("lat"), speed.alias("speed_kmh"), flag.cast("int").alias("is_overspeed"),
        (F.lit(UNKNOWN_GENDER) if pick["gender"] is None else text["gender"]).alias("gender"), F.coalesce(text["age"].try_cast("double"), F.lit(-1.0)).cast("int").alias("age"),
        F.lit(batch_id).alias("batch_id"), F.lit(source).alias("source_file"),
    )
    return out.dropna(subset=["event_time", "lon", "lat"])


def filter_time_range(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``event_time`` from ``start`` to ``end``, both included."""
    out = df if start is None else df.where(F.col("event_time") >= F.lit(start).cast("timestamp_ntz"))
    return out if end is None else out.where(F.col("event_time") <= F.lit(end).cast("timestamp_ntz"))


def filter_recent_days(df: DataFrame, days: int, now: str) -> DataFrame:
    """The last ``days`` days before ``now``; 0 for all."""
    return df if not days else df.where(F.col("event_time") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS"))


def filter_days(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Points from the day ``start`` to the day ``end``, both whole days."""
    out = df if start is None else df.where(F.col("event_time") >= F.lit(start).cast("date").cast("timestamp_ntz"))
    return out if end is None else out.where(F.col("event_time") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))


def order_points(df: DataFrame) -> DataFrame:
    """Sorted for export."""
    return df.orderBy("vehicle_id", "time", "segment_seq", "point_order")
