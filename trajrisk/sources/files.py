"""Readers and writers: trajectories, batches, roads, analysis results, exports, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.governance import FEEDBACK_SCHEMA, feedback_export_rows
from ..operators.roads import ROAD_SCHEMA
from . import commits

#: Columns of a stored batch, in order.
BATCH_COLUMNS = (
    "batch_id", "vehicle_id", "device_id", "company_id", "lock_id", "segment_id", "segment_seq", "point_order", "time", "lon", "lat", "speed_mps", "speed_kmh",
    "dist_m", "dt_s", "calc_speed_mps", "quality_flag", "segment_flag", "lock_status", "ts_raw", "raw_speed_mps", "raw_distance", "raw_duration",
)
#: Columns of the feedback table of a database.
FEEDBACK_TABLE = ("feedback_id", "content", "area_id", "user_type", "lon", "lat", "photo_path", "created_at")
SEPARATORS = ",\t;|"
#: Head of the ledger export.
LEDGER_HEAD = ("反馈编号", "分析版本", "网格编号", "处置时间", "核查结论", "现场情况", "已采取措施", "责任单位", "反馈人", "补充说明", "照片", "提交时间")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that the first line has most of, a comma without any."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    return max(SEPARATORS, key=line.count)


def read_trajectory_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """All columns as text, names trimmed and without a byte order mark; lines that don't fit are left out."""
    rows = spark.read.csv(path, header=True, sep=sep or sniff_separator(spark, path), mode="DROPMALFORMED", enforceSchema=False)
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def write_batch(points: DataFrame, path: str, batch_id: str, mode: str = "errorifexists") -> None:
    """Standard points of one batch, partitioned by batch; a batch that is there is an error, as batches don't change
    (``mode`` overwrite is for one that was left unfinished)."""
    rows = points.withColumn("batch_id", F.lit(batch_id))
    rows = rows.select(*(c if c in rows.columns else F.lit(None).cast("string").alias(c) for c in BATCH_COLUMNS))
    rows = rows.withColumn("time", F.date_trunc("second", "time").cast("timestamp_ntz")).drop("batch_id")
    rows.write.mode(mode).parquet(f"{path}/batch_id={batch_id}")


def write_isolated(isolated: DataFrame, path: str, batch_id: str, mode: str = "errorifexists") -> bool:
    """Rejected rows, only if there are any."""
    if isolated.isEmpty():
        return False
    isolated.write.mode(mode).parquet(f"{path}/batch_id={batch_id}")
    return True


def load_batch(spark: SparkSession, path: str, batch_id: str) -> DataFrame:
    """One batch; only its partition is read."""
    return spark.read.parquet(path).where(F.col("batch_id") == batch_id)


def load_finished_batch(spark: SparkSession, root: str, batch_id: str) -> DataFrame:
    """A batch that a job below ``root`` has finished; any other is an error, whatever files of it lie there."""
    if not commits.is_finished(spark, root, "batch", batch_id):
        raise ValueError(f"batch {batch_id} is not finished")
    return load_batch(spark, f"{root}/batches", batch_id)


def batch_catalog(metas: DataFrame) -> DataFrame:
    """Batches, the newest first."""
    return metas.orderBy(F.desc("created_at"), F.desc("batch_id"))


def latest(metas: DataFrame, key: str, at: str) -> DataFrame:
    """One row: the ``key`` of the newest row by ``at``."""
    return metas.agg(F.max_by(key, F.struct(at, key)).alias(key))


def latest_batch(metas: DataFrame) -> DataFrame:
    return latest(metas, "batch_id", "created_at")


def latest_analysis(metas: DataFrame) -> DataFrame:
    """The newest analysis that is finished."""
    return latest(metas.where("status = 'completed'"), "analysis_version", "generated_at")


def latest_network(metas: DataFrame) -> DataFrame:
    return latest(metas, "net_id", "built_at")


def read_road_edges(spark: SparkSession, path: str) -> DataFrame:
    """Road lines from GeoJSON lines (one Feature a line, LineString or MultiLineString), or from Parquet as it is."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    schema = (
        "type string, geometry struct<type: string, coordinates: string>, properties struct<osm_id: long, fclass: string, oneway: string, name: string, maxspeed: double>"
    )
    rows = spark.read.schema(schema).json(path).where("geometry.coordinates IS NOT NULL")
    one = F.when(F.col("geometry.type") == "LineString", F.array(F.from_json("geometry.coordinates", "array<array<double>>")))
    lines = F.coalesce(one, F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    point = lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"))
    return rows.select("properties.*", F.transform(lines, lambda line: F.transform(line, point)).alias("lines")).where("lines IS NOT NULL")


def road_features(roads: DataFrame) -> DataFrame:
    """Roads as GeoJSON lines."""
    pair = lambda q: F.array(q["lon"], q["lat"])
    geometry = F.struct(F.lit("MultiLineString").alias("type"), F.transform("lines", lambda line: F.transform(line, pair)).alias("coordinates"))
    names = [c.split()[0] for c in ROAD_SCHEMA.split(", ")[:5]]
    return roads.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*names).alias("properties"))).alias("value"))


def write_road_edges(edges: DataFrame, path: str, net_id: str) -> None:
    """The edges of one network, written anew without touching the others."""
    edges.withColumn("net_id", F.lit(net_id)).write.partitionBy("net_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_stage(rows: DataFrame, path: str, analysis_version: str) -> None:
    """The result of a stage; one directory an analysis, written anew without touching the others."""
    rows.withColumn("analysis_version", F.lit(analysis_version)).write.partitionBy("analysis_version").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def write_matched(matched: DataFrame, path: str, analysis_version: str) -> None:
    write_stage(matched, f"{path}/matched", analysis_version)


def write_events(events: DataFrame, path: str, analysis_version: str) -> None:
    write_stage(events, f"{path}/events", analysis_version)


def write_grid(grid: DataFrame, path: str, analysis_version: str) -> None:
    write_stage(grid, f"{path}/grid", analysis_version)


def box_geometry(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Polygon of a box, counter-clockwise."""
    ring = F.array(F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0), F.array(x1, y0))
    return F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))


def to_geojson_features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON Feature a row as ``value``; times are ISO texts, numbers stay numbers."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def export_hotspots_csv(spots: DataFrame, grid: DataFrame, layer: str, path: str) -> DataFrame:
    """The hot spots of one layer with the facts and centre of their cells, written as CSV."""
    rows = spots.where(F.col("layer") == layer).drop("layer").join(
        grid.select("grid_id", "vehicle_count", "exposure_km", "overspeed_count", "reverse_count", "rapid_count", "cri", "quality_flag", F.col("center_lon").alias("lon"), F.col("center_lat").alias("lat")), "grid_id"
    )
    rows.write.mode("overwrite").csv(path, header=True)
    return rows


def export_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Cells as CSV, or a summary as JSON lines."""
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)


def read_feedback_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The ledger; blank and broken lines are left out."""
    return spark.read.schema(FEEDBACK_SCHEMA).json(path, mode="DROPMALFORMED").where("feedback_id IS NOT NULL")


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.select(*(c.split()[0] for c in FEEDBACK_SCHEMA.split(", "))).write.mode("append").json(path)


def export_feedback_csv(feedback: DataFrame, path: str) -> None:
    """The ledger under its titles, as CSV; the first title of each file begins with a byte order mark, for spreadsheets."""
    rows = feedback_export_rows(feedback).toDF("\ufeff" + LEDGER_HEAD[0], *LEDGER_HEAD[1:])
    rows.write.mode("overwrite").csv(path, header=True)


def read_feedback_jdbc(spark: SparkSession, url: str, table: str = "feedbacks", limit: int = 200, quote: str = '"', **options: str) -> DataFrame:
    """The newest ``limit`` rows of a feedback table. Columns, order and limit are part of the query that the database
    answers (``FETCH FIRST``, as the SQL standard has it), so that no more rows than these come over."""
    name = lambda c: f"{quote}{c}{quote}"
    query = f"SELECT {', '.join(map(name, FEEDBACK_TABLE))} FROM {table} ORDER BY {name('created_at')} DESC, {name('feedback_id')} DESC FETCH FIRST {int(limit)} ROWS ONLY"
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) newest", **options).load().select(*FEEDBACK_TABLE)


def read_feedback_days_jdbc(spark: SparkSession, url: str, days: list[str], table: str = "feedbacks", quote: str = '"', **options: str) -> DataFrame:
    """The whole feedback of some days, a task and a query of the database for each day. Columns and further filters are
    pushed to it."""
    at = f"{quote}created_at{quote}"
    one = [f"{at} >= '{d}' AND {at} < '{d} 99'" for d in days]
    rows = spark.read.jdbc(url, table, predicates=one, properties=options)
    return rows.select(*FEEDBACK_TABLE)


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def export_operation_log_csv(rows: DataFrame, path: str) -> None:
    """The rows of ``log_with_feedback``, by time."""
    rows.orderBy("timestamp", "operation_type").write.mode("overwrite").csv(path, header=True)
