"""Metric grid: exposure links cut at cells, event counts, rates and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import add_utm50n, add_wgs84, cell_of, grid_id
from ..params import DEFAULTS, Params
from .ingest import seconds_between

CHAIN = ("vehicle_id", "segment_seq")
KINDS = {"overspeed": "overspeed_count", "reverse": "reverse_count", "rapid_accel": "rapid_accel_count", "rapid_decel": "rapid_decel_count"}


def grid_origin(matched: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One row ``x0, y0``: the corner of the cell that holds the smallest projected coordinates of the matched points."""
    low = lambda c: F.floor(F.min(c) / p.cell_m) * p.cell_m
    return matched.where("matched = 1").agg(low("proj_x").alias("x0"), low("proj_y").alias("y0"))


def exposure_links(matched: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Links between the projections of consecutive matched points of a sub-chain, neither too long nor too slow."""
    chain = Window.partitionBy(*CHAIN).orderBy("point_order")
    rows = matched.where("matched = 1").select(*CHAIN, "point_order", "time", F.col("proj_x").alias("x"), F.col("proj_y").alias("y"))
    rows = rows.withColumns({"px": F.lag("x").over(chain), "py": F.lag("y").over(chain), "pt": F.lag("time").over(chain)})
    rows = rows.withColumns({"dt": seconds_between(F.col("pt"), F.col("time")), "d": F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))})
    rows = rows.where((F.col("dt") > 0) & (F.col("dt") <= p.link_s) & (F.col("d") > 0) & (F.col("d") <= p.link_m))
    return rows.select(*CHAIN, "point_order", "px", "py", "x", "y", "d")


def clip_links_to_cells(links: DataFrame, origin: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``col, row`` and the link's length inside that cell, for all cells that it touches."""
    c = p.cell_m
    rows = links.crossJoin(F.broadcast(origin))  # one row
    for name in ("px", "x"):
        rows = rows.withColumn(name, F.col(name) - F.col("x0"))
    for name in ("py", "y"):
        rows = rows.withColumn(name, F.col(name) - F.col("y0"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / c), F.floor(F.greatest(a, b) / c)))
    rows = rows.withColumn("col", span("px", "x")).withColumn("row", span("py", "y"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")

    def enter(o, d, k):  # where along the link the strip of a cell begins and ends
        a, b = (k * c - o) / d, ((k + 1) * c - o) / d
        still = F.abs(d) < 1e-9
        return F.when(still, 0.0).otherwise(F.least(a, b)), F.when(still, 1.0).otherwise(F.greatest(a, b))

    (x0, x1), (y0, y1) = enter(F.col("px"), dx, F.col("col")), enter(F.col("py"), dy, F.col("row"))
    share = F.least(F.lit(1.0), x1, y1) - F.greatest(F.lit(0.0), x0, y0)
    return rows.withColumn("part_m", F.col("d") * share).where("part_m >= 0").drop("x0", "y0")


def grid_exposure(clipped: DataFrame) -> DataFrame:
    return clipped.groupBy("col", "row").agg(F.sum("part_m").alias("exposure_m"))


def event_cells(events: DataFrame, origin: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    events = add_utm50n(events, F.col("lon"), F.col("lat"), "x_m", "y_m").crossJoin(F.broadcast(origin))  # one row
    return events.withColumns({"col": cell_of(F.col("x_m"), F.col("x0"), p.cell_m), "row": cell_of(F.col("y_m"), F.col("y0"), p.cell_m)}).drop("x0", "y0")


def grid_event_counts(events: DataFrame) -> DataFrame:
    rapid = F.count_if(F.col("event_type").isin("rapid_accel", "rapid_decel", "rapid"))
    return events.groupBy("col", "row").agg(*(F.count_if(F.col("event_type") == k).alias(c) for k, c in KINDS.items()), rapid.alias("rapid_count"))


def grid_distincts(clipped: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct vehicles (of links and events) and distinct sub-chains (of links) of each cell.

    Each cell and vehicle, or sub-chain, is one row before anything is counted.
    """
    vehicles = clipped.select("col", "row", "vehicle_id").union(events.select("col", "row", "vehicle_id")).distinct()
    chains = clipped.select("col", "row", *CHAIN).distinct()
    return vehicles.groupBy("col", "row").agg(F.count("vehicle_id").alias("vehicle_count")).join(
        chains.groupBy("col", "row").agg(F.count("*").alias("segment_count")), ["col", "row"], "left"
    )


def grid_full_outer(exposure: DataFrame, counts: DataFrame) -> DataFrame:
    """Cells with exposure or with events; what is missing is 0."""
    return exposure.join(counts, ["col", "row"], "full").na.fill(0)


def grid_quality(km, segments, events, p: Params = DEFAULTS):
    return F.when((km >= p.valid_km) & (segments >= p.valid_segments), "valid").when((km > 0) | (events > 0), "low_exposure").otherwise("insufficient_data")


def grid_metrics(clipped: DataFrame, events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Counts, exposure and quality of cells; rates per 100 km for valid cells only, null elsewhere."""
    out = grid_full_outer(grid_exposure(clipped), grid_event_counts(events)).join(grid_distincts(clipped, events), ["col", "row"], "left").na.fill(0)
    km = F.col("exposure_m") / 1000
    total = F.col("overspeed_count") + F.col("reverse_count") + F.col("rapid_count")
    out = out.withColumns({"grid_id": grid_id(F.col("col"), F.col("row")), "total_events": total, "quality_flag": grid_quality(km, F.col("segment_count"), total, p)})
    rate = lambda c: F.when(F.col("quality_flag") == "valid", F.bround(F.col(c) / km * 100, 2))
    out = out.withColumns({f"{k}_rate": rate(f"{k}_count") for k in ("overspeed", "reverse", "rapid")})
    return out.withColumn("exposure_km", F.bround(km, 3)).drop("exposure_m")


def cell_box_wgs84(grid: DataFrame, origin: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``center_lon, center_lat, min_lon, min_lat, max_lon, max_lat`` of cells, to six decimals."""
    rows = grid.crossJoin(F.broadcast(origin))  # one row
    for name, step in (("center", 0.5), ("min", 0.0), ("max", 1.0)):
        x, y = F.col("x0") + (F.col("col") + step) * p.cell_m, F.col("y0") + (F.col("row") + step) * p.cell_m
        rows = add_wgs84(rows, x, y, f"{name}_lon", f"{name}_lat")
        rows = rows.withColumns({f"{name}_{c}": F.bround(f"{name}_{c}", 6) for c in ("lon", "lat")})
    return rows.drop("x0", "y0")


def grid_meta(grid: DataFrame) -> DataFrame:
    """One row: cells, cells by quality, kilometres and events."""
    return grid.agg(
        F.count("*").alias("n_grids"), *(F.count_if(F.col("quality_flag") == q).alias(f"n_{q}") for q in ("valid", "low_exposure", "insufficient_data")),
        F.bround(F.sum("exposure_km"), 2).alias("total_exposure_km"), F.sum("total_events").alias("total_events"),
        *(F.sum(f"{k}_count").alias(f"{k}_events") for k in ("overspeed", "reverse", "rapid")),
    )
