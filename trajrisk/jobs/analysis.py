"""The risk analysis of a batch as one chain of operators; every step is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice, behavior, governance, grid, ingest, matching, overspeed_v1, roads, scoring, spatial
from ..params import DEFAULTS, Params
from ..sources.tables import delete, delete_folder, new_folder, stored, within
from ..sources.walk import raw_points, road_lines


class Analysis:
    """Steps of one analysis; those that several others read are stored once.

    Over the ``events`` table of ``sf_dir``, or over ``raw`` rows as of a trajectory file, with a column ``event_id``
    that orders rows of one time, and ``lines`` of roads.
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None, p: Params = DEFAULTS, raw: DataFrame | None = None, lines: DataFrame | None = None):
        self.spark, self.dir, self.p, self.lines = spark, sf_dir, p, lines
        self.tables: dict[str, DataFrame] = {} if raw is None else {"raw": raw}
        self.folder = new_folder(spark, "analysis")

    def close(self) -> None:
        """Delete the stored steps, and what operators stored on the way to them."""
        if "raw" in self.tables:
            delete(self.tables["raw"])
        delete_folder(self.spark, self.folder)
        self.tables.clear()

    def once(self, name: str, build) -> DataFrame:
        if name not in self.tables:
            with within(self.folder):
                self.tables[name] = stored(build(), name)
        return self.tables[name]

    def raw(self) -> DataFrame:
        return self.once("raw", lambda: raw_points(self.spark, self.dir))

    def tagged(self) -> DataFrame:
        return ingest.tag_invalid(ingest.coerce_types(ingest.resolve_columns(self.raw(), ("event_id",))), self.p)

    def chains(self) -> DataFrame:
        """Points with kinematics and bearings: one exchange of the points by vehicle and slice of time, and windows inside it."""
        points = ingest.segment_trajectories(ingest.split_valid(self.tagged()), p=self.p)
        return matching.obs_bearings(matching.with_metres(ingest.point_kinematics(points, self.p)))

    def lean_points(self) -> DataFrame:
        """Points without the columns that follow from others."""
        return self.once("points", lambda: self.chains().drop(*ingest.SPEEDS, "x_m", "y_m"))

    def points(self) -> DataFrame:
        return matching.with_metres(ingest.with_speeds(self.lean_points(), self.p))

    def road_lines(self) -> DataFrame:
        return road_lines(self.spark, self.raw()) if self.lines is None else self.lines

    def edges(self) -> DataFrame:
        return self.once("edges", lambda: roads.road_edges(self.road_lines()))

    def candidates(self) -> DataFrame:
        return self.once("candidates", lambda: matching.match_candidates(self.points(), self.edges(), self.p))

    def paths(self) -> DataFrame:
        """Paths between all nodes near points."""
        return self.once("paths", lambda: matching.bounded_shortest_paths(self.edges(), matching.nodes_near(self.points(), self.edges(), self.p), self.p))

    def matched(self) -> DataFrame:
        points, edges, paths = self.lean_points(), self.edges(), self.paths()
        rows = self.once("matched", lambda: matching.match_points(points, edges, paths, p=self.p).select(*points.columns, *matching.MATCH))
        return matching.with_degrees(matching.with_metres(ingest.with_speeds(rows, self.p)))

    def thresholds(self) -> DataFrame:
        return self.once("thresholds", lambda: behavior.accel_thresholds(self.points(), self.p))

    def events(self) -> DataFrame:
        points = self.points()
        parts = (
            behavior.overspeed_events(points, self.p), behavior.rapid_events(points, self.thresholds(), self.p), matching.reverse_events(self.matched(), self.p),
        )
        return self.once("events", lambda: behavior.union_events(*parts))

    def origin(self) -> DataFrame:
        return self.once("origin", lambda: grid.grid_origin(self.matched(), self.p))

    def clipped(self) -> DataFrame:
        parts = lambda: grid.clip_links_to_cells(grid.exposure_links(self.matched(), self.p), self.origin(), self.p)
        return self.once("clipped", lambda: parts().select("col", "row", *grid.CHAIN, "part_m"))

    def grid(self) -> DataFrame:
        events = grid.event_cells(self.events(), self.origin(), self.p)
        return self.once("grid", lambda: grid.cell_box_wgs84(grid.grid_metrics(self.clipped(), events, self.p), self.origin(), self.p))

    def weights(self) -> DataFrame:
        return scoring.entropy_weights(scoring.gate_rapid(self.grid(), self.thresholds(), self.p))

    def scores(self) -> DataFrame:
        return self.once("scores", lambda: scoring.risk_scores(self.grid(), self.thresholds(), self.p))

    def layers(self) -> tuple[DataFrame, DataFrame]:
        if "spots" not in self.tables:
            scores = self.scores()
            with within(self.folder):
                self.tables["spots"], self.tables["facts"] = spatial.hotspot_layers(scores, self.p)
        return self.tables["spots"], self.tables["facts"]

    def cells(self, value: str = "overspeed_rate") -> DataFrame:
        """Valid cells with a rate as ``value``, and their centres in metres ``x, y`` from the grid's origin."""
        size = self.p.cell_m
        rows = scoring.valid_grids(self.scores(), value)
        return rows.select(
            "grid_id", "col", "row", F.col(value).alias("value"), ((F.col("col") + 0.5) * size).alias("x"), ((F.col("row") + 0.5) * size).alias("y")
        )

    def neighbours(self) -> DataFrame:
        return self.once("neighbours", lambda: spatial.knn_neighbors(self.cells(), self.p))

    def advised(self) -> DataFrame:
        context = advice.advice_context(self.scores(), self.layers()[0], self.events(), self.p)
        return self.once("advised", lambda: advice.advice_rules(context, advice.enabled_rules(advice.default_rules(self.spark))))

    def v1_points(self) -> DataFrame:
        raw = self.raw().select(
            F.col("event_id").alias("order_id"), F.col("ts").alias("event_time"), (F.col("lon_u") / 1e6).alias("lon"), (F.col("lat_u") / 1e6).alias("lat"),
            (F.col("Speed") * 3.6).alias("speed_kmh"), "event_type", "user_id", F.col("event_id").alias("source_row"),
            F.when(F.col("user_id") % 7 == 0, "女").otherwise("男").alias("gender"), (F.col("user_id") % 20 + 15).cast("int").alias("age"),
        )
        return overspeed_v1.overspeed_flag(raw, self.p)

    def v1_cells(self) -> DataFrame:
        return self.once("v1_cells", lambda: overspeed_v1.v1_grid(self.v1_points(), self.p))

    def v1_values(self) -> DataFrame:
        return self.v1_cells().select(
            "grid_id", F.col("gx").alias("col"), F.col("gy").alias("row"), F.col("overspeed_count").cast("double").alias("value"), F.col("center_lon").alias("x"),
            F.col("center_lat").alias("y"),
        )

    def v1_neighbours(self) -> DataFrame:
        return self.once("v1_neighbours", lambda: spatial.knn_neighbors(self.v1_values(), self.p))

    def v1_hotspots(self) -> DataFrame:
        """Cells with a score; the fallback where no cell has one."""

        def found() -> DataFrame:
            gi = spatial.getis_ord_gi_star(self.v1_values(), self.v1_neighbours()).where("risk_level <> 'insignificant'")
            gi = self.v1_cells().join(gi, "grid_id")
            return overspeed_v1.hotspot_ids(overspeed_v1.v1_hotspot_fallback(self.v1_cells(), self.p) if gi.isEmpty() else gi)

        return self.once("v1_hotspots", found)

    def trend(self) -> DataFrame:
        series = overspeed_v1.hourly_series(self.v1_points()).withColumn("key", F.lit("all"))
        return self.once("trend", lambda: overspeed_v1.mann_kendall(series))

    def v1_moran(self) -> DataFrame:
        return spatial.global_moran(self.v1_values(), self.v1_neighbours())

    def log(self) -> DataFrame:
        return self.v1_points().select(
            F.col("event_type").alias("operation_type"), F.col("user_id").cast("string").alias("user"), F.col("event_time").alias("timestamp")
        )

    def feedback(self) -> DataFrame:
        """Checks on site, one for every event, in its degree cell; the conclusion and the day are those of the event."""
        c = self.p.v1_cell_deg
        kind = F.col("event_type")
        name = F.when(kind == "error", governance.FAILS).when(kind == "signup", governance.PARTLY).otherwise(governance.HOLDS)
        return self.raw().select(
            F.col("event_id").alias("feedback_id"), F.concat(F.lit("G"), F.floor(F.col("lon_u") / 1e6 / c), F.lit("_"), F.floor(F.col("lat_u") / 1e6 / c)).alias("grid_id"),
            F.to_date("ts").alias("handled_at"), name.alias("conclusion"), F.col("ts").alias("created_at"), F.concat(F.lit("about "), kind).alias("content"),
            F.col("lon_u").alias("lon"), F.col("lat_u").alias("lat"),
        )

    def v1_overspeeds(self) -> DataFrame:
        return self.v1_points().where("is_overspeed = 1").select("order_id", "lon", "lat", F.to_date("event_time").alias("day"))
