"""Advice for cells: thresholds, context of hot spots, rules that a cell meets, and the texts and records made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..params import DEFAULTS, Params
from .governance import events_in_grid_box
from .spatial import LAYERS

#: Identifiers, order of priority, basis and section (none: only traced) of the rules.
RULES = [
    ("KB-G01", 1, "BASIS-BJ22", "field_actions"), ("KB-G02", 2, "BASIS-BJ40", "field_actions"), ("KB-S01", 3, "BASIS-NPC58", "field_actions"),
    ("KB-S02", 4, "BASIS-BJ26", "field_actions"), ("KB-R01", 5, "BASIS-BJ22", "field_actions"), ("KB-R02", 6, "BASIS-NPC57", "road_env"),
    ("KB-A01", 7, "BASIS-BJ22", "field_actions"), ("KB-A02", 8, "BASIS-BJ22", "road_env"), ("KB-A03", 9, "BASIS-BJ25", "road_env"),
    ("KB-E01", 10, "BASIS-BJ41", "enterprise"), ("KB-E02", 11, "BASIS-SAMR2021", "education"), ("KB-D01", 12, "BASIS-METHOD", None),
    ("KB-D02", 13, "BASIS-METHOD", None), ("KB-Q01", 14, "BASIS-PATENT", None), ("KB-F01", 15, "BASIS-METHOD", None),
]
SIGNIFICANT_Z, DOMINANT_RATIO, FREQUENT, VEHICLES, EVENTS = 1.28, 1.5, 10, 3, 5
PROMPT_VERSION = "P-2.0"
KINDS = ("overspeed", "reverse", "rapid")
KIND_LABELS = {"overspeed": "超速", "reverse": "逆行", "rapid": "急变速"}
RULE_SCHEMA = (
    "rule_id string, title string, applicable_behavior string, risk_condition string, action_text string, basis_id string, caution string, priority int, enabled boolean"
)


def read_knowledge_base(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """``version`` and rules, and ``version, basis_id, name, content, source``, of JSON files ``{version, rules, basis}``."""
    schema = f"version string, rules array<struct<{', '.join(x.replace(' ', ': ') for x in RULE_SCHEMA.split(', '))}>>, basis map<string, struct<name: string, content: string, source: string>>"
    base = spark.read.schema(schema).json(path, multiLine=True)
    return base.select("version", F.explode("rules").alias("r")).select("version", "r.*"), base.select("version", F.explode("basis").alias("basis_id", "b")).select("version", "basis_id", "b.*")


def default_rules(spark) -> DataFrame:
    """The fixed part of the rules, with their identifier as text, where no knowledge base is read."""
    rows = [("KB-1.0", i, i, "", i, f"do {i}", b, f"check {b}", n, True) for i, n, b, _ in RULES]
    return spark.createDataFrame(rows, f"version string, {RULE_SCHEMA}")


def enabled_rules(rules: DataFrame, version: str | None = None) -> DataFrame:
    """Enabled rules of one version, the newest if none is named."""
    newest = rules.agg(F.max("version").alias("version")) if version is None else rules.sparkSession.createDataFrame([(version,)], "version string")
    return rules.join(F.broadcast(newest), "version").where(F.coalesce("enabled", F.lit(True)))  # one row


def index_quantiles(scored: DataFrame) -> DataFrame:
    """One row: P75 and P90 of the three indices over all cells (missing as 0), P75 of the index of all, to four places."""
    names = [*(f"{k}_index" for k in KINDS), "cri"]
    stack = F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', coalesce({n}, 0D)" for n in names) + ") AS (name, v)")
    q = exact_quantiles(scored.select(stack), "v", (0.75, 0.9), ("name",))
    pick = lambda n, i: F.max(F.when(F.col("name") == n, F.bround(F.get("q", F.lit(i)), 4)))
    return q.agg(
        *(pick(f"{k}_index", i).alias(f"{k}_{p}") for k in KINDS for i, p in enumerate(("p75", "p90"))), pick("cri", 0).alias("cri_p75")
    )


def hotspot_context(spots: DataFrame) -> DataFrame:
    """``grid_id`` and a struct ``gi_z, selection_type, risk_level`` for each layer, null where the cell is no hot spot."""
    return spots.groupBy("grid_id").pivot("layer", list(LAYERS)).agg(F.first(F.struct("gi_z", "selection_type", "risk_level")))


def default_risk_layer(grids: DataFrame, spots: DataFrame) -> DataFrame:
    """``grid_id, layer``: the layer of highest z, the first in the alphabet of equals, ``none`` without one."""
    best = spots.groupBy("grid_id").agg(F.min_by("layer", F.struct(-F.col("gi_z"), F.col("layer"))).alias("layer"))
    return grids.select("grid_id").join(best, "grid_id", "left").select("grid_id", F.coalesce("layer", F.lit("none")).alias("layer"))


def reverse_oneway_ratio(events: DataFrame, grids: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``grid_id, oneway_ratio``: share of wrong-way events around a cell that are on one-way roads."""
    wrong = events.where("event_type = 'reverse'")
    near = events_in_grid_box(wrong, grids, p)
    oneway = F.upper(F.get_json_object("detail", "$.oneway")).isin("F", "T")
    return near.groupBy("grid_id").agg(F.avg(F.coalesce(oneway, F.lit(False)).cast("int")).alias("oneway_ratio"))


def advice_rule_ids() -> Column:
    """Identifiers of the rules that a row meets, sorted: cell columns, ``hotspot_context``, ``index_quantiles``, ``oneway_ratio``."""
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    index = {k: num(f"{k}_index") for k in KINDS}
    top = F.greatest(*index.values())
    dominant = F.when(top > 0, F.when(index["overspeed"] == top, "overspeed").when(index["reverse"] == top, "reverse").otherwise("rapid"))
    n_high = sum((((index[k] > 0) & (index[k] >= F.col(f"{k}_p75"))).cast("int") for k in KINDS), F.lit(0))
    layers = [F.col(k) for k in LAYERS]
    some = lambda f: F.coalesce(F.greatest(*(F.coalesce(f(x), F.lit(False)) for x in layers)), F.lit(False))
    acc, dec = num("rapid_accel_count"), num("rapid_decel_count")
    ratio = F.when((acc > 0) & (dec > 0), F.greatest(acc, dec) / F.least(acc, dec))
    rapid = (
        F.when(ratio < DOMINANT_RATIO, "KB-A03").when(ratio.isNotNull() & (acc > dec), "KB-A01").when(ratio.isNotNull(), "KB-A02")
        .when(acc > 0, "KB-A01").when(dec > 0, "KB-A02")
    )
    high = sum((((index[k] > 0) & (index[k] >= F.col(f"{k}_p90"))).cast("int") for k in KINDS), F.lit(0)) > 0
    quality = F.coalesce("quality_flag", F.lit("valid"))
    significant = F.coalesce(F.col("comprehensive")["gi_z"] >= SIGNIFICANT_Z, F.lit(False)) & (index["overspeed"] + index["reverse"] + index["rapid"] > 0)
    return F.array_compact(F.array(
        F.when((dominant == "rapid"), rapid), F.when(quality != "valid", "KB-D01"), F.when(some(lambda x: x["selection_type"] == "top_risk_fallback"), "KB-D02"),
        F.when((num("vehicle_count") >= VEHICLES) & (num("total_events") >= EVENTS), "KB-E01"), F.when(high | some(lambda x: x["risk_level"] == "high"), "KB-E02"),
        F.lit("KB-F01"), F.when(significant & F.coalesce(F.col("cri") >= F.col("cri_p75"), F.lit(False)), "KB-G01"), F.when(n_high >= 2, "KB-G02"),
        F.when(quality == "insufficient_data", "KB-Q01"),
        F.when(dominant == "reverse", F.when(F.coalesce(F.col("oneway_ratio") >= 0.5, F.lit(False)), "KB-R01").otherwise("KB-R02")),
        F.when(dominant == "overspeed", "KB-S01"), F.when(num("overspeed_count") >= FREQUENT, "KB-S02"),
    ))


def advice_context(scored: DataFrame, spots: DataFrame, events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Cells with all that rules look at, and ``rule_ids``."""
    rows = scored.join(hotspot_context(spots), "grid_id", "left").join(reverse_oneway_ratio(events, scored, p), "grid_id", "left")
    return rows.crossJoin(F.broadcast(index_quantiles(scored))).withColumn("rule_ids", advice_rule_ids())  # one row


def advice_rules(context: DataFrame, rules: DataFrame) -> DataFrame:
    """``context`` with ``rules``: the texts of its rules in the order of priority."""
    known = rules.select("rule_id", F.struct("priority", "rule_id", "title", "risk_condition", "action_text", "basis_id", "caution").alias("rule"))
    hit = context.select("grid_id", F.explode("rule_ids").alias("rule_id")).join(known, "rule_id")
    return context.join(hit.groupBy("grid_id").agg(F.array_sort(F.collect_list("rule")).alias("rules")), "grid_id", "left")


def distinct_rule_notes(rules: Column) -> tuple[Column, Column]:
    """Basis identifiers, and cautions as one text, each once and in order."""
    filled = lambda name: F.array_distinct(F.filter(F.transform(rules, lambda r: r[name]), lambda x: x.isNotNull() & (x != "")))
    return filled("basis_id"), F.array_join(filled("caution"), "；")


def advice_basis(advice: DataFrame, basis: DataFrame) -> DataFrame:
    """One row a basis identifier of an advice, in its order, with the clause if it is known."""
    rows = advice.select("grid_id", F.posexplode("basis_ids").alias("place", "basis_id"))
    return rows.join(basis.select("basis_id", "name", "content", "source"), "basis_id", "left")


def advice_payload(context: DataFrame, layers: DataFrame, period: str, version: str) -> DataFrame:
    """``grid_id, payload``: a record of chosen fields only, the place to three decimals, no vehicles."""
    rows = context.join(layers, "grid_id", "left")
    at_layer = F.coalesce(*(F.when(F.col("layer") == k, F.col(k)) for k in LAYERS))
    num = lambda c, d: F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), d)
    kind = lambda k: F.struct(num(f"{k}_index", 1).alias("index"), F.col(f"{k}_count").alias("events"), F.bround(f"{k}_rate", 2).alias("rate_per_100km"))
    payload = F.struct(
        F.lit(version).alias("analysis_version"), "grid_id", F.lit(period).alias("period"), F.coalesce(at_layer["risk_level"], F.lit("unknown")).alias("risk_level"),
        F.coalesce(at_layer["selection_type"], F.lit("statistical_hotspot")).alias("selection_type"), F.bround("cri", 1).alias("composite_risk_index"),
        F.struct(kind("overspeed").alias("overspeed"), kind("reverse").alias("suspected_reverse"), kind("rapid").alias("rapid_speed_change")).alias("indicators"),
        F.struct(num("exposure_km", 2).alias("distance_km"), F.coalesce("segment_count", F.lit(0)).alias("trajectory_segments")).alias("exposure"),
        F.struct(num("center_lat", 3).alias("lat"), num("center_lon", 3).alias("lon")).alias("location_hint"), F.col("rule_ids").alias("retrieved_rules"),
    )
    return rows.select("grid_id", payload.alias("payload"))


def fallback_advice_text(advised: DataFrame, period: str) -> DataFrame:
    """Advice made of the texts of a cell's rules: summary, field action, three lists, basis and cautions."""
    section = F.create_map(*(F.lit(x) for i, _, _, s in RULES for x in (i, s or "")))
    of = lambda name: F.filter("rules", lambda r: section[r["rule_id"]] == name)
    index = {k: F.coalesce(F.col(f"{k}_index"), F.lit(0.0)) for k in KINDS}
    top = F.greatest(*index.values())
    label = F.when(top > 0, F.when(index["overspeed"] == top, KIND_LABELS["overspeed"]).when(index["reverse"] == top, KIND_LABELS["reverse"]).otherwise(KIND_LABELS["rapid"])).otherwise("综合风险")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    num = lambda c: F.format_string("%.1f", F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 1))
    summary = F.format_string(
        "该网格" + period.replace("%", "%%") + "共记录超速%d起、逆行%d起、急变速%d起，暴露里程%s公里，综合风险指数%s，以%s最突出。",
        count("overspeed_count"), count("reverse_count"), count("rapid_count"), num("exposure_km"), num("cri"), label,
    )
    entry = lambda r: F.struct(r["risk_condition"].alias("trigger"), r["action_text"].alias("measure"))
    basis, caution = distinct_rule_notes(F.col("rules"))
    return advised.select(
        "grid_id", summary.alias("risk_summary"), F.array_join(F.transform(of("field_actions"), lambda r: r["action_text"]), "；").alias("field_action"),
        *(F.transform(of(s), entry).alias(s) for s in ("road_env", "enterprise", "education")), basis.alias("basis_ids"), caution.alias("caution_note"),
    )


def validate_advice_json(text: Column) -> Column:
    """Problems of an advice document, as an array of texts; what is no JSON object has one."""
    v = F.try_parse_json(text)
    kind = lambda x: F.schema_of_variant(x)
    at = lambda x, path, t="variant": F.try_variant_get(x, path, t)
    filled = lambda x, name: F.coalesce((kind(at(x, f"$.{name}")) == "STRING") & (F.trim(at(x, f"$.{name}", "string")) != ""), F.lit(False))
    items = lambda name: at(v, f"$.{name}", "array<variant>")

    def bad_items(name: str, keys: tuple[str, ...]) -> Column:
        def one(x: Column, i: Column) -> Column:
            ok = filled(x, keys[0])
            for k in keys[1:]:
                ok = ok & filled(x, k)
            return F.when(~ok, F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]")))

        return F.coalesce(F.array_compact(F.transform(items(name), one)), F.array().cast("array<string>"))

    is_list = lambda name: F.coalesce(kind(at(v, f"$.{name}")).startswith("ARRAY"), F.lit(False))
    none = F.array().cast("array<string>")
    parts = [
        F.when(filled(v, "risk_summary"), none).otherwise(F.array(F.lit("risk_summary"))),
        F.when(~is_list("field_actions") | (F.size(items("field_actions")) == 0), F.array(F.lit("field_actions"))).otherwise(
            bad_items("field_actions", ("when", "where", "deployment", "action", "completion"))
        ),
        *(F.when(~is_list(s), F.array(F.lit(s))).otherwise(bad_items(s, ("trigger", "measure", "owner"))) for s in ("road_env", "enterprise", "education")),
        F.when(is_list("basis_ids") & F.forall(items("basis_ids"), lambda x: kind(x) == "STRING"), none).otherwise(F.array(F.lit("basis_ids"))),
    ]
    whole = F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))
    return F.when(whole, F.concat(*parts)).otherwise(F.array(F.lit("document")))


def advice_cache_key(version: Column, grid_id: Column, layer: Column, kb_version: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", version, grid_id, layer, kb_version, F.lit(PROMPT_VERSION), model).cast("binary"), 256)


def grid_detail(grids: DataFrame, advice: DataFrame) -> DataFrame:
    """Cells with ``advice_id`` and whether there is one."""
    rows = grids.join(advice.select("grid_id", "advice_id"), "grid_id", "left")
    return rows.withColumn("advice_available", F.col("advice_id").isNotNull())


def analysis_summary(grid: DataFrame, events: DataFrame, weights: DataFrame, layers: DataFrame) -> DataFrame:
    """One row: cells, cells by quality, the index (count, mean, most), events by type, weights, layers; the last three as JSON."""
    cells = grid.agg(
        F.count("*").alias("grid_count"), *(F.count_if(F.col("quality_flag") == q).alias(f"n_{q}") for q in ("valid", "low_exposure", "insufficient_data")),
        F.count("cri").alias("cri_count"), F.bround(F.avg("cri"), 1).alias("cri_mean"), F.bround(F.max("cri"), 1).alias("cri_max"),
    )
    facts = lambda df, *c: F.to_json(F.array_sort(F.collect_list(F.struct(*c))))
    kinds = events.groupBy("event_type").agg(F.count("*").alias("n")).agg(facts(events, "event_type", "n").alias("events"))
    names = layers.agg(facts(layers, "layer", "selection_type", "n_significant").alias("layers"))
    w = weights.select(F.to_json(F.struct(*(F.bround(c, 4).alias(c) for c in weights.columns))).alias("weights"))
    return cells.crossJoin(kinds).crossJoin(w).crossJoin(names)  # one row each
