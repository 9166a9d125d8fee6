"""Files to stored results as jobs: the main line from a trajectory and a road file, and the degree-grid line.

Every part is written below a folder and then entered into its log (``sources.commits``), so that a job that broke off
is simply run again: parts that are finished are read, the others are written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice, behavior, ingest, matching, overspeed_v1, roads, spatial
from ..params import DEFAULTS, Params
from ..sources import commits, files
from ..sources.tables import delete, stored, within
from .analysis import Analysis

#: Properties of a hot spot's feature.
SPOT = [
    "grid_id", "layer_value", "gi_z", "risk_level", "vehicle_count", "exposure_km", "overspeed_count", "reverse_count", "rapid_count", "cri", "quality_flag", "selection_type",
]


def run_batch(spark: SparkSession, trajectories: str, road_file: str, out: str, batch_id: str, net_id: str, version: str, p: Params = DEFAULTS) -> None:
    """Write below ``out``: ``batches, isolated, networks, matched, events, grid, lisa``, hot spots as GeoJSON lines by layer
    (``hotspots/<version>/<layer>``), advice and the summary as JSON lines; and a row each for the batch, the network and
    the analysis in the log. Too many rejected rows are an error. An analysis that is finished is left as it is."""
    if commits.is_finished(spark, out, "analysis", version):
        return
    raw = files.read_trajectory_csv(spark, trajectories)
    if "event_id" not in raw.columns:  # rows of one time keep the order of the file
        raw = raw.withColumn("event_id", F.monotonically_increasing_id())
    a = Analysis(spark, p=p, raw=stored(raw, "raw"), lines=roads.clip_edges_bbox(files.read_road_edges(spark, road_file), p))
    ingest.assert_isolated_ratio(a.tagged(), p)

    def batch() -> None:
        files.write_batch(a.points(), f"{out}/batches", batch_id, "overwrite")
        files.write_isolated(ingest.split_isolated(a.tagged()), f"{out}/isolated", batch_id, "overwrite")

    def batch_facts() -> DataFrame:
        units = ingest.speed_unit_check(a.points()).withColumnRenamed("n", "speed_checked")
        return ingest.batch_meta(a.tagged(), a.points()).crossJoin(units).withColumn("source_name", F.lit(trajectories.rsplit("/", 1)[-1]))  # one row each

    commits.publish(spark, out, "batch", batch_id, batch, batch_facts)
    commits.publish(
        spark, out, "network", net_id, lambda: files.write_road_edges(a.edges(), f"{out}/networks", net_id),
        lambda: roads.network_summary(a.edges()).withColumn("source_name", F.lit(road_file.rsplit("/", 1)[-1])),
    )
    with within(a.folder):
        moran = moran_of(a)
        commits.publish(spark, out, "analysis", version, lambda: write_analysis(a, out, version, moran), lambda: analysis_facts(a, moran, batch_id, net_id))
    a.close()


def moran_of(a: Analysis) -> tuple[DataFrame, DataFrame] | None:
    """Global and local autocorrelation of the index over valid cells that have it; none with less than ``min_cells``."""
    cells = spatial.layer_cells(a.scores()).where("layer = 'comprehensive'").drop("layer")
    if cells.limit(a.p.min_cells).count() < a.p.min_cells:
        return None
    near = stored(spatial.knn_neighbors(cells, a.p), "moran_neighbours")
    return spatial.global_moran(cells, near), spatial.lisa_permutations(spatial.local_moran(cells, near), a.p)


def write_analysis(a: Analysis, out: str, version: str, moran: tuple[DataFrame, DataFrame] | None) -> None:
    files.write_matched(a.matched(), out, version)
    files.write_events(behavior.event_ids(a.events()), out, version)
    files.write_grid(a.scores(), out, version)
    if moran:  # the significant cells by label
        significant = moran[1].where(F.col("lisa_p") < a.p.lisa_p).join(a.scores().select("grid_id", "cri"), "grid_id")
        files.write_stage(significant.select("grid_id", "cri", "label", "lisa_z", "lisa_p"), f"{out}/lisa", version)
    spots, facts = a.layers()
    cells = spots.join(a.scores(), "grid_id")
    box = files.box_geometry(*(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))
    for r in facts.collect():  # four layers
        rows = files.to_geojson_features(cells.where(F.col("layer") == r["layer"]), box, SPOT)
        rows.write.mode("overwrite").text(f"{out}/hotspots/{version}/{r['layer']}")
    period = a.points().agg(F.min("time").cast("string").alias("a"), F.max("time").cast("string").alias("b")).first()
    texts = advice.fallback_advice_text(a.advised(), f"{period['a']}/{period['b']}")
    files.export_report(texts, f"{out}/advice/{version}", "json")
    files.export_report(advice.analysis_summary(a.scores(), a.events(), a.weights(), facts), f"{out}/summary/{version}", "json")


def analysis_facts(a: Analysis, moran: tuple[DataFrame, DataFrame] | None, batch_id: str, net_id: str) -> DataFrame:
    match = matching.match_summary(a.matched(), matching.chain_dt_mode(a.points())).select("n_points", "match_rate")
    cells = a.scores().agg(F.count("*").alias("grid_count"), F.bround(F.avg("cri"), 1).alias("cri_mean"))
    row = match.crossJoin(cells)  # one row each
    row = row.crossJoin(moran[0].select("moran_i", F.col("p").alias("moran_p"))) if moran else row
    return row.withColumns({"batch_id": F.lit(batch_id), "net_id": F.lit(net_id)})


def run_v1(spark: SparkSession, points: DataFrame, out: str, batch_id: str, stamp: str, p: Params = DEFAULTS) -> None:
    """The degree-grid line: new ``points`` (as of ``ingest.normalize_points_v1``) are merged into the store below
    ``out``; then cells, hot spots, LISA labels, trend, alerts and the dashboard's row of the whole store are written.

    Less than three cells are an error; series of up to four hours have no trend. A batch that is finished is left out.
    """
    if commits.is_finished(spark, out, "v1", batch_id):
        return
    order = {} if "source_row" in points.columns else {"source_row": F.monotonically_increasing_id()}
    delete(overspeed_v1.merge_points(points.withColumns(order), f"{out}/points"))
    held = overspeed_v1.overspeed_flag(spark.read.parquet(f"{out}/points"), p)
    grid = spatial.assert_min_cells(stored(overspeed_v1.v1_grid(held, p), "v1_grid"))
    cells = grid.select("grid_id", F.col("gx").alias("col"), F.col("gy").alias("row"), F.col("overspeed_count").cast("double").alias("value"))
    near = stored(spatial.knn_neighbors(cells, p), "v1_neighbours")
    found = grid.join(spatial.getis_ord_gi_star(cells, near).where("risk_level <> 'insignificant'"), "grid_id")
    spots = stored(overspeed_v1.hotspot_ids(overspeed_v1.v1_hotspot_fallback(grid, p) if found.isEmpty() else found), "v1_spots")
    moran = stored(spatial.global_moran(cells, near), "v1_moran")
    series = overspeed_v1.hourly_series(held).withColumn("key", F.lit("all"))
    trend = stored(overspeed_v1.mann_kendall(series, least=overspeed_v1.TREND_BUCKETS), "v1_trend")
    dashboard = stored(overspeed_v1.dashboard_metrics(grid, spots, moran, trend), "v1_dashboard")

    def write() -> None:
        results = {
            "grid": grid, "spots": spots, "trend": trend, "dashboard": dashboard, "alerts": overspeed_v1.generate_alerts(spots, trend, stamp),
            "lisa": spatial.lisa_permutations(spatial.local_moran(cells, near), p),
        }
        for name, rows in results.items():
            files.write_stage(rows, f"{out}/{name}", batch_id)

    commits.publish(spark, out, "v1", batch_id, write, lambda: dashboard)
    for t in (grid, near, spots, moran, trend, dashboard):
        delete(t)
