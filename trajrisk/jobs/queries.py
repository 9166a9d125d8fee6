"""Queries over the given tables; ``oracle.py`` has the same results as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import alert_level, control_suggestions, interpret_analysis, recommendation_rules, recommendation_template
from ..operators import advice, behavior, governance, grid, ingest, matching, overspeed_v1, roads, scoring, spatial
from ..sources import commits, files
from ..sources.tables import new_folder, stored
from ..streaming import run as streaming_run
from ..streaming import streams
from .analysis import Analysis

STAMP, VERSION, PERIOD = "20240605", "AV-1", "2024-06-05"


def _half_even(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.bround(c, digits) for c in columns})


def _points(a: Analysis) -> DataFrame:
    return _half_even(a.points(), 4, "dist_m", "calc_speed_mps", "speed_kmh").select(
        "event_id", "segment_id", "point_order", "dt_s", "dist_m", "calc_speed_mps", "speed_kmh", "quality_flag"
    )


def _events(df: DataFrame) -> DataFrame:
    return df.select("event_type", "segment_id", "start_time", "end_time", "duration_s", "value_main", "lon", "lat")


def _edges(a: Analysis) -> DataFrame:
    return _half_even(a.edges(), 1, "length_m", "forward_bearing", "reverse_bearing").select(
        "edge_id", "fclass", "road_level", "matchable", "oneway", "k", F.size("geometry").alias("n_points"), "length_m", "forward_bearing", "reverse_bearing"
    )


def _parts(a: Analysis) -> DataFrame:
    rows = roads.edge_parts(a.edges())
    return _half_even(rows, 1, "along0", "bearing").select("edge_id", "part", "along0", "bearing")


def _clipped_roads(a: Analysis) -> DataFrame:
    return roads.clip_edges_bbox(a.road_lines(), a.p).groupBy("fclass").agg(F.count("*").alias("n"))


def _paths(a: Analysis) -> DataFrame:
    sources = matching.transition_pairs(a.candidates()).select(F.explode(F.array("a.u", "a.v")).alias("n1")).distinct()
    paths = matching.bounded_shortest_paths(a.edges(), sources, a.p)
    return paths.agg(F.count("*").alias("n_paths"), F.count_distinct("n1").alias("n_sources"), F.bround(F.max("path_m"), 1).alias("longest_m"), F.bround(F.avg("path_m"), 2).alias("mean_m"))


def _ways(a: Analysis) -> DataFrame:
    if matching.few_paths(a.paths()):
        points = a.lean_points().select(*matching.LAYER, "lon", "lat")
        ways = matching.candidate_ways(matching.chain_candidates(points, a.edges(), a.p), a.paths())
    else:
        ways = matching.candidate_path_length(matching.transition_pairs(a.candidates()), a.paths())
    return ways.groupBy("vehicle_id").agg(
        F.count("*").alias("n_pairs"), F.count("path_m").alias("n_paths"), F.bround(F.avg("path_m"), 2).alias("mean_path_m"), F.bround(F.avg("straight_m"), 2).alias("mean_straight_m")
    )


def _matched(a: Analysis) -> DataFrame:
    rows = a.matched().where("matched = 1")
    return rows.select("event_id", "edge_id", F.bround("proj_dist_m", 2).alias("proj_dist_m"), "travel_dir", "proj_lon", "proj_lat")


def _reverse_ratio(a: Analysis) -> DataFrame:
    return matching.reverse_ratio(a.matched(), a.p).where("n_judged > 0").select("segment_id", "n_judged", "n_reverse", F.bround("ratio", 4).alias("ratio"))


def _details(a: Analysis) -> DataFrame:
    return a.events().groupBy("event_type").agg(
        F.count(F.from_json("detail", "map<string,string>")).alias("n"), F.max(F.get_json_object("detail", "$.n_points").cast("long")).alias("most_points"),
        F.max(F.get_json_object("detail", "$.n_judged").cast("long")).alias("most_judged"), F.bround(F.max(F.get_json_object("detail", "$.from_kmh").cast("double")), 1).alias("most_from_kmh"),
    )


def _exposure(a: Analysis) -> DataFrame:
    return grid.grid_exposure(a.clipped()).where("exposure_m > 0.01").select("col", "row", F.bround("exposure_m", 1).alias("exposure_m"))


def _distincts(a: Analysis) -> DataFrame:
    return grid.grid_distincts(a.clipped().where("part_m > 0.01"), grid.event_cells(a.events(), a.origin(), a.p)).na.fill(0)


def _metrics(a: Analysis) -> DataFrame:
    rows = a.grid().where("exposure_km > 0 OR total_events > 0")
    return rows.select("grid_id", F.bround("exposure_km", 2).alias("exposure_km"), "overspeed_count", "reverse_count", "rapid_count", "total_events", "quality_flag", "overspeed_rate", "reverse_rate", "rapid_rate")


def _gated(a: Analysis) -> DataFrame:
    return scoring.gate_rapid(a.grid(), a.thresholds(), a.p)


def _z(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, F.bround("gi_z", 3).alias("gi_z"), "risk_level")


def _lisa(a: Analysis) -> DataFrame:
    rows = spatial.local_moran(a.cells(), a.neighbours())
    return rows.select("grid_id", F.bround("local_i", 3).alias("local_i"), "quadrant", "label")


def _permuted(a: Analysis) -> DataFrame:
    return spatial.lisa_permutations(spatial.local_moran(a.cells(), a.neighbours()), a.p)


def _v1_grid(a: Analysis) -> DataFrame:
    return a.v1_cells().select(
        "grid_id", "overspeed_count", "trajectory_count", F.bround("mean_speed", 4).alias("mean_speed"), "time_min", "time_max", "time_slice",
        F.bround("center_lon", 6).alias("center_lon"), F.bround("center_lat", 6).alias("center_lat"),
    )


def _normalized(a: Analysis) -> DataFrame:
    raw = a.raw().select(F.col("POSITIONTIME").alias("Time"), F.col("X_position").alias("x"), F.col("Y_position").alias("y"), F.col("Speed").cast("string").alias("Speed"), F.col("event_id").cast("string").alias("ID"))
    return ingest.normalize_points_v1(raw, "B-1", "events", a.p)


def _dedup(a: Analysis) -> DataFrame:
    """Points of one place and hour are one; the earlier row wins, and rows of the first half of the month win over later ones."""
    rows = a.v1_points().select(F.col("user_id").alias("order_id"), F.date_trunc("hour", "event_time").cast("timestamp_ntz").alias("event_time"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"), "source_row", "speed_kmh")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    # Existing rows come from the later half in the order of rows, so that "existing first" is not the order of time.
    return overspeed_v1.append_points_dedup(rows.where(F.col("event_time") >= half), rows.where(F.col("event_time") < half).unionByName(rows.withColumn("source_row", -F.col("source_row")))).select(
        "order_id", "event_time", "source_row", F.bround("speed_kmh", 3).alias("speed_kmh")
    )


def _alerts(a: Analysis) -> DataFrame:
    """Alerts for the cells of most overspeeds, as those have medium risks."""
    return overspeed_v1.generate_alerts(overspeed_v1.hotspot_ids(overspeed_v1.v1_hotspot_fallback(a.v1_cells(), a.p)), a.trend(), STAMP)


def _series(a: Analysis) -> DataFrame:
    """Hourly series of every kind of event."""
    hours = a.v1_points().groupBy(F.col("event_type").alias("key"), F.date_trunc("hour", "event_time").cast("timestamp_ntz").alias("bucket_ts"))
    return hours.agg(F.sum("is_overspeed").alias("value"))


def _near(a: Analysis) -> DataFrame:
    return governance.events_in_grid_box(a.v1_overspeeds(), governance.exact_centres(a.v1_cells(), a.p), a.p)


def _boxes(a: Analysis) -> DataFrame:
    return _near(a).groupBy("grid_id").agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days"))


def _rates(a: Analysis) -> DataFrame:
    return governance.event_rate_change(a.feedback(), _near(a))


def _feedback_text(a: Analysis) -> DataFrame:
    """The ledger as texts and lists."""
    return a.feedback().select(
        F.col("feedback_id").cast("string").alias("feedback_id"), F.lit(VERSION).alias("analysis_version"), "grid_id", F.col("handled_at").cast("string").alias("handled_at"), "conclusion",
        F.array("content", F.lit("seen")).alias("scene_issues"), F.array().cast("array<string>").alias("measures"), F.lit("unit").alias("responsible_unit"),
        F.lit(governance.REPORTER).alias("reporter"), F.lit("").alias("note"), F.array(F.lit("p.jpg")).alias("photos"), F.col("created_at").cast("string").alias("created_at"),
    )


def _forms(a: Analysis) -> DataFrame:
    """Forms of which some are bad, by the columns of their event."""
    kind = F.col("operation_type")
    forms = a.log().select(
        F.concat_ws("-", "user", "timestamp").alias("feedback_id"), F.when(kind == "click", "maybe").otherwise(F.concat(F.lit(" "), F.lit(governance.HOLDS))).alias("conclusion"),
        F.when(kind == "view", "5 June").when(kind == "error", "2024-02-31").otherwise(F.date_format("timestamp", "yyyy-MM-dd")).alias("handled_at"),
        F.concat(F.lit(" a\n\n b"), kind).alias("scene_issues"), F.lit(None).cast("string").alias("measures"), F.lit(None).cast("string").alias("responsible_unit"),
        F.lit(" ").alias("reporter"), F.lit(None).cast("string").alias("note"),
        F.when(kind == "signup", F.array_repeat(F.lit("p.jpg"), 4)).otherwise(F.array(F.lit("p.jpg"))).alias("photos"),
    )
    rows = governance.validate_feedback(forms)
    return rows.groupBy(F.concat_ws(",", "problems").alias("problems"), F.concat_ws("|", "scene_issues").alias("issues"), "reporter").agg(F.count("*").alias("n"))


def _logs(a: Analysis) -> DataFrame:
    return governance.filter_operation_log(a.log(), "2024-01-05", "2024-01-20", ("purchase", "view"))


def _payloads(a: Analysis) -> DataFrame:
    layers = advice.default_risk_layer(a.scores(), a.layers()[0])
    rows = advice.advice_payload(a.advised(), layers, PERIOD, VERSION).select("payload.*")
    return rows.select(
        "grid_id", "risk_level", "selection_type", "composite_risk_index", F.col("indicators.overspeed.index").alias("overspeed_index"),
        F.col("indicators.suspected_reverse.events").alias("reverse_events"), F.bround("indicators.rapid_speed_change.rate_per_100km", 0).alias("rapid_rate"),
        F.bround("exposure.distance_km", 1).alias("distance_km"), F.col("exposure.trajectory_segments").alias("segments"), F.col("location_hint.lon").alias("lon"), F.col("location_hint.lat").alias("lat"),
    )


def _fallback(a: Analysis) -> DataFrame:
    return advice.fallback_advice_text(a.advised(), PERIOD)


def _fallback_rows(a: Analysis) -> DataFrame:
    return _fallback(a).select(
        "grid_id", "risk_summary", "field_action", F.size("road_env").alias("n_road_env"), F.size("enterprise").alias("n_enterprise"), F.size("education").alias("n_education"),
        F.concat_ws(",", "basis_ids").alias("basis_ids"),
    )


def _advice_json(a: Analysis) -> DataFrame:
    """Advice as JSON documents, with a part left out where a cell has no good quality."""
    rows = _fallback(a).join(a.scores().select("grid_id", "quality_flag"), "grid_id")
    entry = lambda c: F.transform(c, lambda x: F.struct(x["trigger"].alias("trigger"), x["measure"].alias("measure"), F.lit("owner").alias("owner")))
    action = F.struct(*(F.lit("x").alias(k) for k in ("when", "where", "deployment", "action")), F.when(F.col("quality_flag") == "valid", "x").alias("completion"))
    text = F.to_json(F.struct("risk_summary", F.array(action).alias("field_actions"), entry("road_env").alias("road_env"), entry("enterprise").alias("enterprise"), F.when(F.col("quality_flag") == "valid", entry("education")).alias("education"), "basis_ids"))
    return rows.withColumn("problems", F.concat_ws(",", advice.validate_advice_json(text))).select("grid_id", "problems")


def _basis(a: Analysis) -> DataFrame:
    basis = a.spark.createDataFrame([(b, f"clause {b}", "", "") for b in sorted({r[2] for r in advice.RULES} - {"BASIS-PATENT"})], "basis_id string, name string, content string, source string")
    return advice.advice_basis(_fallback(a), basis).select("grid_id", "place", "basis_id", "name")


def _detail(a: Analysis) -> DataFrame:
    """Advice exists for valid cells."""
    made = a.scores().where("quality_flag = 'valid'").select("grid_id", F.concat(F.lit("AD-"), "grid_id").alias("advice_id"))
    return advice.grid_detail(a.scores(), made).select("grid_id", "quality_flag", "advice_id", "advice_available")


def _cache_keys(a: Analysis) -> DataFrame:
    layers = advice.default_risk_layer(a.scores(), a.layers()[0])
    key = advice.advice_cache_key(F.lit(VERSION), F.col("grid_id"), F.col("layer"), F.lit("KB-1.0"), F.lit("rule_fallback"))
    return layers.select("grid_id", key.alias("cache_key"))


def _summary(a: Analysis) -> DataFrame:
    rows = advice.analysis_summary(a.scores(), a.events(), a.weights(), a.layers()[1])
    return rows.select("grid_count", "n_valid", "n_low_exposure", "n_insufficient_data", "cri_count", "cri_mean", "cri_max", "events", "layers")


def _interpreted(a: Analysis) -> DataFrame:
    one = overspeed_v1.dashboard_metrics(a.v1_cells(), a.v1_hotspots(), a.v1_moran(), a.trend())
    told = one.select(interpret_analysis(F.col("hotspot_count"), F.col("moran_i"), F.col("trend")).alias("t")).select("t.*")
    return told.select("hotspot_level", "moran_pattern", "trend_level", F.concat_ws(",", "instructions").alias("instructions"), F.concat_ws(",", "recommendations").alias("recommendations"))


def _v1_placed(a: Analysis) -> DataFrame:
    return governance.events_in_grid_cell(a.v1_points(), a.p)


def _recommended(a: Analysis) -> DataFrame:
    """Rules and, by the alert level of a hot spot, the number of suggestions."""
    rows = a.v1_hotspots().join(overspeed_v1.young_male_share(_v1_placed(a)), "grid_id", "left")
    rules = recommendation_rules(F.col("risk_level"), F.col("time_slice"), F.col("mean_speed"), F.col("young_male"))
    return rows.select(
        "grid_id", recommendation_template(F.col("risk_level"), F.col("gi_z")).alias("template"), F.concat_ws(",", rules).alias("rules"),
        F.size(control_suggestions(alert_level(F.col("risk_level"), F.col("gi_z"), F.lit(0.0)))).alias("n_suggestions"),
    )


# Writing and reading back.


def _csv(a: Analysis) -> DataFrame:
    """Raw points written as a file with another separator, read back and judged."""
    path = new_folder(a.spark, "csv")
    a.raw().select("event_id", "POSITIONTIME", "X_position", "Y_position", "BICYCLEID", "TID", "Speed").write.csv(path, header=True, sep="\t")
    tagged = ingest.tag_invalid(ingest.coerce_types(ingest.resolve_columns(files.read_trajectory_csv(a.spark, path))), a.p)
    return tagged.groupBy(F.coalesce("isolate_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _batches(a: Analysis) -> DataFrame:
    """Points of each company as a batch of its own, and the rejected rows; the batch of company 3 read back."""
    path = new_folder(a.spark, "batches")
    for company in range(5):
        files.write_batch(a.points().where(F.col("company_id") == str(company)), f"{path}/points", f"B-{company}")
    files.write_isolated(ingest.split_isolated(a.tagged()), f"{path}/isolated", "B-0")
    back = files.load_batch(a.spark, f"{path}/points", "B-3")
    return back.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_distinct("segment_id").alias("n_segments"), F.min("time").alias("time_min"), F.max("time").alias("time_max"))


def _metas(a: Analysis) -> DataFrame:
    """A batch, an analysis and a network for each user, made at the time of the user's last event; errors aren't finished."""
    return a.v1_points().groupBy("user_id").agg(
        F.concat(F.lit("B-"), F.col("user_id")).alias("batch_id"), F.max("event_time").alias("created_at"), F.concat(F.lit("AV-"), F.col("user_id")).alias("analysis_version"),
        F.when(F.max_by("event_type", "event_time") == "error", "failed").otherwise("completed").alias("status"), F.max("event_time").alias("generated_at"),
        F.concat(F.lit("RN-"), F.col("user_id")).alias("net_id"), F.min("event_time").alias("built_at"),
    )


def _latest(a: Analysis) -> DataFrame:
    metas = stored(_metas(a), "metas")
    return files.latest_batch(metas).crossJoin(files.latest_analysis(metas)).crossJoin(files.latest_network(metas))  # one row each


def _road_files(a: Analysis) -> DataFrame:
    """Roads as GeoJSON lines and edges by network, read back."""
    path = new_folder(a.spark, "roads")
    files.road_features(a.road_lines()).write.text(f"{path}/roads.json")
    edges = roads.road_edges(files.read_road_edges(a.spark, f"{path}/roads.json"))
    files.write_road_edges(edges, f"{path}/edges", "RN-1")
    return a.spark.read.parquet(f"{path}/edges").where("net_id = 'RN-1'").groupBy("road_level").agg(F.count("*").alias("n"))


def _stage_files(a: Analysis) -> DataFrame:
    """Results of two analyses; the first is written anew and the second stays."""
    path = new_folder(a.spark, "stages")
    for version, rows in (("AV-1", a.grid()), ("AV-2", a.grid().where("quality_flag = 'valid'")), ("AV-1", a.grid().where("quality_flag <> 'valid'"))):
        files.write_grid(rows, path, version)
    files.write_events(a.events(), path, "AV-1")
    files.write_matched(a.matched(), path, "AV-1")
    return a.spark.read.parquet(f"{path}/grid").groupBy("analysis_version", "quality_flag").agg(F.count("*").alias("n"))


def _geojson(a: Analysis) -> DataFrame:
    rows = a.scores().where("quality_flag = 'valid'")
    box = files.box_geometry(*(F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")))
    found = files.to_geojson_features(rows, box, ["grid_id", "cri", "overspeed_count", "quality_flag"])
    get = lambda p: F.get_json_object("value", p)
    return found.select(
        get("$.type").alias("type"), get("$.geometry.type").alias("geometry"), get("$.properties.grid_id").alias("grid_id"), get("$.properties.cri").cast("double").alias("cri"),
        get("$.geometry.coordinates[0][0][0]").cast("double").alias("first_lon"), get("$.properties.overspeed_count").cast("long").alias("overspeed_count"),
    )


def _hotspot_csv(a: Analysis) -> DataFrame:
    path = new_folder(a.spark, "hotspots")
    files.export_hotspots_csv(a.layers()[0], a.scores(), "rapid", path)
    back = a.spark.read.csv(path, header=True, inferSchema=True)
    return back.select("grid_id", "risk_level", "selection_type", F.col("rapid_count").cast("long").alias("rapid_count"), F.col("lon").cast("double").alias("lon"))


def _report(a: Analysis) -> DataFrame:
    path = new_folder(a.spark, "report")
    files.export_report(a.scores(), f"{path}/csv")
    files.export_report(grid.grid_meta(a.grid()), f"{path}/json", "json")
    cells = a.spark.read.csv(f"{path}/csv", header=True).agg(F.count("*").alias("n_rows"))
    return cells.crossJoin(a.spark.read.json(f"{path}/json").select("n_grids", "n_valid", "total_events"))  # one row each


def _ledger(a: Analysis) -> DataFrame:
    """The ledger appended in two parts with broken lines between, read back and filtered."""
    path = new_folder(a.spark, "ledger")
    rows = _feedback_text(a)
    files.append_feedback(rows.where("handled_at < '2024-01-15'"), path)
    files.append_feedback(rows.where("handled_at >= '2024-01-15'"), path)
    a.raw().groupBy("event_type").agg(F.count("*")).select(F.concat(F.lit('{"feedback_id": "x", '), "event_type").alias("value")).write.mode("append").text(path)
    back = governance.filter_feedback(files.read_feedback_jsonl(a.spark, path), VERSION, None, governance.FAILS, "2024-01-10", "2024-01-20")
    return back.groupBy("handled_at").agg(F.count("*").alias("n"), F.min("feedback_id").alias("first_id"))


def _ledger_csv(a: Analysis) -> DataFrame:
    path = new_folder(a.spark, "ledger_csv")
    files.export_feedback_csv(_feedback_text(a), path)
    back = a.spark.read.csv(path, header=True)
    return back.groupBy(F.col("核查结论").alias("conclusion"), F.col("现场情况").alias("issues")).agg(F.count("*").alias("n"))


def _alert_file(a: Analysis) -> DataFrame:
    path, alerts = new_folder(a.spark, "alerts"), _alerts(a)
    for _ in range(2):
        files.append_alerts(alerts, path)
    return overspeed_v1.alert_statistics(a.spark.read.schema(alerts.schema).json(path))


def _log_csv(a: Analysis) -> DataFrame:
    path = new_folder(a.spark, "log")
    files.export_operation_log_csv(governance.log_with_feedback(_logs(a), a.feedback()), path)
    back = a.spark.read.csv(path, header=True)
    return back.groupBy("operation_type").agg(F.count("*").alias("n"), F.count("feedback_id").alias("n_feedback"))


# Streams over the stored points, run until the files are read.


def _stream(a: Analysis) -> DataFrame:
    points = stored(a.v1_points().withColumn("event_time", F.col("event_time").cast("timestamp")).select("order_id", "event_time", "lon", "lat", "speed_kmh", "is_overspeed", F.concat(F.lit("V"), "user_id").alias("vehicle_id")), "stream")
    return a.spark.readStream.schema(points.schema).parquet(points.inputFiles()[0].rsplit("/", 1)[0])


def _arrivals(a: Analysis, rows: DataFrame, slices: int = 6) -> DataFrame:
    """A stream of ``rows``, a micro-batch for each value of ``arrival``, in that order."""
    rows, path = stored(rows, "arrivals"), new_folder(a.spark, "stream")
    for k in range(slices):
        rows.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.parquet(f"{path}/{k}")
    schema = rows.drop("arrival").schema
    return a.spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)


def _slice(time: str) -> Column:
    """Five days each."""
    return F.floor(F.date_diff(F.col(time), F.lit("2024-01-01").cast("date")) / 5).cast("int")


def _stream_hours(a: Analysis) -> DataFrame:
    """Points arrive by five days; some come ten days late, of which those behind the watermark are dropped."""
    rows = a.v1_points().select(F.col("event_time").cast("timestamp").alias("event_time"), "is_overspeed", "order_id")
    late = F.when(F.col("order_id") % 50 == 0, 2).otherwise(0)
    rows = rows.withColumn("arrival", F.least(_slice("event_time") + late, F.lit(5))).drop("order_id")
    hours = streaming_run.available_now(streams.stream_hourly_overspeed(_arrivals(a, rows)), "append")
    return hours.select(F.col("bucket_ts").cast("timestamp_ntz").alias("bucket_ts"), "value")


def _stream_dedup(a: Analysis) -> DataFrame:
    twice = _stream(a).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = streaming_run.available_now(streams.stream_point_dedup(twice, "31 days"), "append")
    return rows.groupBy("vehicle_id").agg(F.count("*").alias("n"))


def _stream_segments(a: Analysis) -> DataFrame:
    rows = a.raw().select(
        F.concat(F.lit("V"), "user_id").alias("vehicle_id"), F.col("ts").cast("timestamp").alias("time"), "event_id", F.col("TID").cast("int").alias("segment_flag"),
        (F.col("Speed") * 3.6).alias("speed_kmh"), _slice("ts").alias("arrival"),
    )
    runs = streaming_run.available_now(streams.stream_segments(_arrivals(a, rows)), "append")
    return runs.select("vehicle_id", F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("end_time").cast("timestamp_ntz").alias("end_time"), "n_points", F.bround("max_speed", 3).alias("max_speed"))


# A log of finished work, a growing store, a database.


def _finished(a: Analysis) -> DataFrame:
    """Points of each company as a batch; that of company 4 breaks off before its row is in the log, that of company 1 is
    published twice."""
    root = new_folder(a.spark, "work")
    for company in (0, 1, 1, 2, 3):
        mine = a.points().where(F.col("company_id") == str(company))
        facts = lambda mine=mine: mine.agg(F.count("*").alias("rows_total"), F.count_distinct("vehicle_id").alias("n_vehicles"), F.min("time").alias("time_min"))
        commits.publish(a.spark, root, "batch", f"B-{company}", lambda mine=mine, c=company: files.write_batch(mine, f"{root}/batches", f"B-{c}", "overwrite"), facts)
    files.write_batch(a.points().where("company_id = '4'"), f"{root}/batches", "B-4")
    log = commits.rows(a.spark, root, "batch")
    held = a.spark.read.parquet(f"{root}/batches").join(F.broadcast(log.select("batch_id")), "batch_id").groupBy("batch_id").agg(F.count("*").alias("n"))  # a row a batch
    return files.batch_catalog(log).join(held, "batch_id").select("batch_id", "status", "rows_total", "n_vehicles", "time_min", "n")


def _merged(a: Analysis) -> DataFrame:
    """A store of points that grows by five days at a time, each of which brings the last day again."""
    path = new_folder(a.spark, "store")
    points = stored(a.v1_points().select("order_id", "event_time", "lon", "lat", "speed_kmh", "source_row"), "v1_points")
    for k in range(6):
        again = F.to_date("event_time") == F.date_add(F.lit("2024-01-01").cast("date"), 5 * k - 1)
        new = points.where(_slice("event_time") == k).unionByName(points.where(again).withColumn("source_row", F.col("source_row") + 1_000_000_000))
        overspeed_v1.merge_points(new, path)
    back = a.spark.read.parquet(path)
    return back.groupBy("day").agg(F.count("*").alias("n"), F.sum("source_row").alias("rows_sum"), F.bround(F.sum("speed_kmh"), 3).alias("speed_sum"))


def _database(a: Analysis) -> DataFrame:
    """The feedback in a database, in memory, as where one is not at hand; its newest rows."""
    url, driver = f"jdbc:derby:memory:f{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = a.feedback().select(text("feedback_id"), "content", F.col("grid_id").alias("area_id"), "conclusion", (F.col("lon") / 1e6).alias("lon"), (F.col("lat") / 1e6).alias("lat"), text("created_at"))
    rows = rows.withColumns({"user_type": F.col("conclusion"), "photo_path": F.lit("")}).drop("conclusion")
    types = ", ".join(f"{c} VARCHAR(64)" for c in ("feedback_id", "content", "area_id", "user_type", "photo_path", "created_at"))
    rows.write.option("createTableColumnTypes", types).jdbc(url, "feedbacks", properties=driver)
    newest = files.read_feedback_jdbc(a.spark, url, limit=200, **driver)
    return newest.select("feedback_id", "area_id", "user_type", F.bround("lon", 6).alias("lon"), F.bround("lat", 6).alias("lat"))


STEPS: dict[str, Callable[[Analysis], DataFrame]] = {
    "isolated_rows": lambda a: ingest.split_isolated(a.tagged()).groupBy("isolate_reason").agg(F.count("*").alias("n")),
    "isolated_ratio": lambda a: ingest.isolated_ratio(ingest.assert_isolated_ratio(a.tagged(), a.p)),
    "batch_meta": lambda a: ingest.batch_meta(a.tagged(), a.points()),
    "point_kinematics": _points,
    "speed_unit_check": lambda a: ingest.speed_unit_check(a.points()),
    "obs_bearings": lambda a: a.points().select("event_id", F.bround("obs_bearing", 2).alias("obs_bearing")),
    "overspeed_events": lambda a: _events(behavior.overspeed_events(a.points(), a.p)),
    "accel_thresholds": lambda a: behavior.accel_thresholds(a.points(), a.p),
    "rapid_events": lambda a: _events(behavior.rapid_events(a.points(), a.thresholds(), a.p)),
    "clip_edges_bbox": _clipped_roads,
    "road_edges": _edges,
    "edge_parts": _parts,
    "network_summary": lambda a: roads.network_summary(a.edges()),
    "match_candidates": lambda a: _half_even(matching.nearest_k_candidates(a.candidates()), 2, "proj_dist_m").select("event_id", "edge_id", "proj_dist_m", "rank"),
    "chain_dt_mode": lambda a: matching.chain_dt_mode(a.points()),
    "transition_pairs": lambda a: matching.transition_pairs(a.candidates()).groupBy("vehicle_id", "segment_seq").agg(F.count("*").alias("n_pairs")),
    "bounded_shortest_paths": _paths,
    "candidate_path_length": _ways,
    "viterbi_match": _matched,
    "match_summary": lambda a: matching.match_summary(a.matched(), matching.chain_dt_mode(a.points())),
    "match_offset_quantiles": lambda a: matching.match_offset_quantiles(a.matched()),
    "reverse_ratio": _reverse_ratio,
    "reverse_events": lambda a: _events(matching.reverse_events(a.matched(), a.p)),
    "event_counts": lambda a: behavior.event_counts(a.events()),
    "event_ids": lambda a: behavior.event_ids(a.events()).where("event_type = 'overspeed'").select("event_id", "segment_id", "start_time"),
    "event_detail_json": _details,
    "grid_exposure": _exposure,
    "grid_distincts": _distincts,
    "grid_metrics": _metrics,
    "cell_box_wgs84": lambda a: a.grid().select("col", "row", "center_lon", "center_lat", "min_lon", "min_lat", "max_lon", "max_lat"),
    "grid_meta": lambda a: _half_even(grid.grid_meta(a.grid()), 1, "total_exposure_km"),
    "entropy_weights": lambda a: _half_even(a.weights(), 4, *(f"w_{c}" for c in scoring.RATES)),
    "topsis": lambda a: scoring.topsis(_gated(a), a.weights()).select("grid_id", F.bround("closeness", 3).alias("closeness")),
    "danger_indices": lambda a: scoring.danger_indices(_gated(a)),
    "risk_scores": lambda a: a.scores().select("grid_id", "overspeed_index", "reverse_index", "rapid_index", "cri", "cri_available"),
    "knn_neighbors": lambda a: a.neighbours(),
    "radius_neighbors": lambda a: spatial.radius_neighbors(a.cells(), 600.0).groupBy("i").agg(F.count("*").alias("n")),
    "getis_ord_gi_star": lambda a: _z(spatial.getis_ord_gi_star(a.cells(), a.neighbours()), "grid_id"),
    "getis_ord_gi_star_ord": lambda a: _z(spatial.getis_ord_gi_star(a.cells(), a.neighbours(), "ord_getis"), "grid_id"),
    "zscore_hotspots": lambda a: _z(spatial.zscore_hotspots(a.cells()), "grid_id"),
    "hotspot_layers": lambda a: _half_even(a.layers()[0], 1, "layer_value").select("layer", "grid_id", "layer_value", F.bround("gi_z", 2).alias("gi_z"), "risk_level", "selection_type"),
    "hotspot_facts": lambda a: a.layers()[1],
    "top_risk_fallback": lambda a: _z(spatial.top_risk_fallback(a.cells(), a.p), "grid_id", "value"),
    "global_moran": lambda a: spatial.global_moran(a.cells(), a.neighbours()),
    "global_moran_radius": lambda a: spatial.global_moran_radius(a.cells(), 600.0),
    "local_moran": _lisa,
    "local_moran_radius": lambda a: _half_even(spatial.local_moran_radius(a.cells(), 600.0), 3, "local_i"),
    "lisa_permutations": lambda a: _permuted(a).select("grid_id", F.bround("lisa_z", 3).alias("lisa_z"), F.bround("lisa_p", 3).alias("lisa_p"), "quadrant"),
    "lisa_label_counts": lambda a: spatial.lisa_label_counts(_permuted(a), a.p),
    "hotspot_hull": lambda a: spatial.hotspot_hull(a.v1_points().withColumn("risk_level", F.col("event_type"))).select("risk_level", F.size("hull").alias("n_corners")),
    "analysis_summary": _summary,
    "normalize_points_v1": lambda a: _half_even(_normalized(a), 4, "speed_kmh").select("order_id", "event_time", "lon", "lat", "speed_kmh", "is_overspeed", "gender", "age"),
    "filter_time_range": lambda a: ingest.filter_time_range(a.v1_points(), "2024-01-05 06:00:00", "2024-01-07 18:30:00").groupBy("event_type").agg(F.count("*").alias("n")),
    "filter_recent_days": lambda a: ingest.filter_recent_days(a.v1_points(), 7, "2024-01-29 00:00:00").groupBy("event_type").agg(F.count("*").alias("n")),
    "append_points_dedup": _dedup,
    "v1_grid": _v1_grid,
    "v1_hotspot_fallback": lambda a: overspeed_v1.v1_hotspot_fallback(a.v1_cells(), a.p).select("grid_id", "overspeed_count", "gi_z", "risk_level"),
    "v1_hotspots": lambda a: _z(a.v1_hotspots(), "area_id", "grid_id"),
    "top_hotspots": lambda a: _z(overspeed_v1.top_hotspots(a.v1_hotspots(), 3), "area_id", "grid_id"),
    "filter_hotspots": lambda a: overspeed_v1.filter_hotspots(a.v1_hotspots(), "all", "2024-01-01 00:00:00", "2024-01-01 12:00:00").select("area_id", "grid_id"),
    "tag_evolution": lambda a: overspeed_v1.tag_evolution(a.v1_hotspots(), a.trend()).select("grid_id", "evolution_pattern", "pattern_color"),
    "hotspot_export_rows": lambda a: overspeed_v1.hotspot_export_rows(a.v1_hotspots(), "low").select("area_id", "grid_id", "risk_level", "time_slice", "trajectory_count", "control"),
    "generate_alerts": lambda a: _alerts(a).select("alert_id", "grid_id", "alert_level", "alert_type", "expected_period", F.size("control_suggestions").alias("n_suggestions"), "status"),
    "filter_alerts": lambda a: overspeed_v1.filter_alerts(_alerts(a), "blue", "pending").select("alert_id", "grid_id"),
    "alert_statistics": _alert_file,
    "risk_distribution": lambda a: overspeed_v1.risk_distribution(a.v1_hotspots()),
    "dashboard_metrics": lambda a: _half_even(overspeed_v1.dashboard_metrics(a.v1_cells(), a.v1_hotspots(), a.v1_moran(), a.trend()), 4, "moran_i", "trend_z"),
    "interpret_analysis": _interpreted,
    "recommendation_template": _recommended,
    "hourly_distribution": lambda a: overspeed_v1.hourly_distribution(a.v1_points()),
    "daily_trend": lambda a: overspeed_v1.daily_trend(a.v1_points()),
    "daily_trend_hours": lambda a: overspeed_v1.daily_trend(a.v1_points(), "2024-01-09"),
    "hourly_series": lambda a: overspeed_v1.hourly_series(a.v1_points()),
    "mann_kendall": lambda a: overspeed_v1.mann_kendall(_series(a)),
    "mean_slope_trend": lambda a: overspeed_v1.mean_slope_trend(_series(a)),
    "index_quantiles": lambda a: advice.index_quantiles(a.scores()),
    "hotspot_context": lambda a: advice.hotspot_context(a.layers()[0]).select("grid_id", *(F.col(f"{k}.risk_level").alias(k) for k in spatial.LAYERS)),
    "default_risk_layer": lambda a: advice.default_risk_layer(a.scores(), a.layers()[0]),
    "reverse_oneway_ratio": lambda a: _half_even(advice.reverse_oneway_ratio(a.events(), a.scores(), a.p), 4, "oneway_ratio"),
    "advice_rule_ids": lambda a: a.advised().select("grid_id", F.concat_ws(",", "rule_ids").alias("rule_ids")),
    "advice_rules": lambda a: a.advised().select("grid_id", F.concat_ws(",", F.transform("rules", lambda r: r["rule_id"])).alias("by_priority"), advice.distinct_rule_notes(F.col("rules"))[1].alias("cautions")),
    "advice_payload": _payloads,
    "fallback_advice_text": _fallback_rows,
    "validate_advice_json": _advice_json,
    "advice_basis": _basis,
    "advice_cache_key": _cache_keys,
    "grid_detail": _detail,
    "feedback_status": lambda a: governance.feedback_status(a.feedback()),
    "false_streak": lambda a: governance.false_streak(a.feedback()),
    "events_in_grid_box": _boxes,
    "event_rate_change": _rates,
    "validate_feedback": _forms,
    "feedback_ledger": lambda a: governance.feedback_ledger(a.feedback(), 50).select("feedback_id", "handled_at", "conclusion"),
    "feedback_history": lambda a: governance.feedback_history(a.feedback().select("feedback_id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(None).cast("string").alias("created_at"))),
    "log_statistics": lambda a: governance.log_statistics(a.log()),
    "filter_operation_log": lambda a: _logs(a).groupBy("operation_type", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n")),
    "log_feedback_same_day": lambda a: governance.log_feedback_same_day(_logs(a), a.feedback()).select("timestamp", "user", "feedback_id", "content", "place"),
    "feedback_without_log": lambda a: governance.feedback_without_log(a.feedback(), _logs(a)).select("feedback_id", "handled_at"),
    "log_with_feedback": lambda a: governance.log_with_feedback(_logs(a), a.feedback()).groupBy("operation_type", F.to_date("timestamp").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("feedback_id").alias("n_feedback")),
    "read_trajectory_csv": _csv,
    "load_batch": _batches,
    "batch_catalog": lambda a: files.batch_catalog(_metas(a)).select("batch_id", "created_at", "status"),
    "latest_batch": _latest,
    "read_road_edges": _road_files,
    "write_stages": _stage_files,
    "to_geojson_features": _geojson,
    "export_hotspots_csv": _hotspot_csv,
    "export_report": _report,
    "read_feedback_jsonl": _ledger,
    "export_feedback_csv": _ledger_csv,
    "export_operation_log_csv": _log_csv,
    "overspeed_without_drift": lambda a: _events(behavior.overspeed_events(a.points(), a.p, skip_drift=True)),
    "daily_trend_by_area": lambda a: overspeed_v1.daily_trend(_v1_placed(a), by="grid_id"),
    "hourly_distribution_by_area": lambda a: overspeed_v1.hourly_distribution(_v1_placed(a), "grid_id"),
    "events_in_grid_cell": lambda a: governance.events_in_grid_cell(a.v1_overspeeds(), a.p).groupBy("grid_id").agg(F.count("*").alias("n"), F.count_distinct("day").alias("n_days")),
    "young_male_share": lambda a: _half_even(overspeed_v1.young_male_share(_v1_placed(a)), 4, "young_male"),
    "finished_batches": _finished,
    "merge_points": _merged,
    "filter_days": lambda a: ingest.filter_days(a.v1_points(), "2024-01-05", "2024-01-07").groupBy("event_type").agg(F.count("*").alias("n")),
    "read_feedback_jdbc": _database,
    "stream_hourly_overspeed": _stream_hours,
    "stream_point_dedup": _stream_dedup,
    "stream_segments": _stream_segments,
}


_SHARED: dict[tuple[str, ...], Analysis] = {}


def shared(spark: SparkSession, sf_dir: str) -> Analysis:
    """The analysis of a folder, as its events are now, in this session and checkpoint folder, so that queries share its
    stored steps."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").inputFiles()
    where = spark._jvm.org.apache.hadoop.fs.Path(events[0]) if events else None
    state = str(where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()) if where else ""
    key = spark.sparkContext.applicationId, sf_dir, spark.conf.get("spark.checkpoint.dir", ""), str(len(events)), state
    if key not in _SHARED:
        _SHARED[key] = Analysis(spark, sf_dir)
        # Storing the first step may have set the folder.
        _SHARED[(*key[:2], spark.conf.get("spark.checkpoint.dir", ""), *key[3:])] = _SHARED[key]
    return _SHARED[key]


def forget() -> None:
    """Queries begin anew, as where each is timed for itself; the stored steps are deleted."""
    for a in {id(a): a for a in _SHARED.values()}.values():
        a.close()
    _SHARED.clear()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(shared(spark, sf_dir))) for name, f in STEPS.items()}
