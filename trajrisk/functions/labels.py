"""Classes, texts and small JSON values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of alert levels, alert types, periods and suggestions.
RED, YELLOW, BLUE = "red", "yellow", "blue"
ALERT_TYPES = {RED: "加强的热点", YELLOW: "新增热点", BLUE: "持续的热点"}
PERIODS = ((7, 9, "早高峰（7:00-9:00）"), (17, 19, "晚高峰（17:00-19:00）"), (12, 14, "午间小高峰（12:00-14:00）"), (21, 23, "夜间平峰（21:00-23:00）"))
ALL_DAY = "全天"
PATTERN_COLORS = {"振荡热点": "#9c27b0", "新增热点": "#ff9800", "加强的热点": "#d32f2f", "逐渐减少的热点": "#f06292", "持续的热点": "#1976d2"}
LISA_LABELS = {"HH": "高-高", "LL": "低-低", "HL": "高-低", "LH": "低-高"}
CONTROL_TEXT = {"high": "一级管控：固定警力2名+AI抓拍", "medium": "二级管控：加强巡逻"}
CONTROL_OTHER = "三级管控：常态化巡查"
#: Suggestions by alert level: a parameter of ``control_suggestions``.
SUGGESTIONS = {
    RED: ["fixed post and camera", "temporary speed bumps", "campaign within 24 hours, review after 3 days"],
    YELLOW: ["mobile patrol", "check of crossings and stops", "review for 7 days"],
    BLUE: ["routine patrol", "monthly review"],
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def time_slice(start: Column, end: Column) -> Column:
    """``YYYY-MM-DD HH:MM ~ HH:MM``."""
    return F.concat(F.date_format(start, "yyyy-MM-dd HH:mm"), F.lit(" ~ "), F.date_format(end, "HH:mm"))


def high_risk_period(slice_: Column) -> Column:
    """Named period of the hour with which a time slice begins, or the whole day."""
    hour = F.regexp_extract(slice_, r"(\d+):", 1).try_cast("int")
    out = F.when(F.lit(False), "")
    for a, b, name in PERIODS:
        out = out.when((hour >= a) & (hour < b), name)
    return out.otherwise(ALL_DAY)


def alert_level(risk: Column, z: Column, trend_z: Column) -> Column:
    """Red, yellow or blue; null for low risks."""
    return F.when((risk == "high") & (z >= 2.58), RED).when((risk == "high") & (F.abs(trend_z) > 2.58), YELLOW).when(risk.isin("medium", "high"), BLUE)


def alert_type(level: Column) -> Column:
    return _lookup(level, ALERT_TYPES)


def control_suggestions(level: Column, table: dict[str, list[str]] = SUGGESTIONS) -> Column:
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for name, texts in table.items():
        out = out.when(level == name, F.array(*map(F.lit, texts)))
    return out.otherwise(F.array().cast("array<string>"))


def evolution_pattern(risk: Column, z: Column, trend_z: Column) -> Column:
    strong = (risk == "high") & (z >= 2.58)
    return (
        F.when(strong & (F.abs(trend_z) > 2.58) & (trend_z > 0), "新增热点").when(strong & (F.abs(trend_z) > 2.58), "逐渐减少的热点")
        .when(strong, "加强的热点").when(risk == "high", "持续的热点").otherwise("振荡热点")
    )


def pattern_color(pattern: Column) -> Column:
    return _lookup(pattern, PATTERN_COLORS)


def control_text(risk: Column) -> Column:
    return F.coalesce(_lookup(risk, CONTROL_TEXT), F.lit(CONTROL_OTHER))


def recommendation_template(risk: Column, z: Column) -> Column:
    """Key of the strategy template of a hot spot."""
    return (
        F.when((risk == "high") & (z >= 2.58), "new_hotspot").when(risk == "high", "oscillating_hotspot")
        .when(risk == "medium", "medium_risk").otherwise("low_risk")
    )


def recommendation_rules(risk: Column, slice_: Column, mean_speed: Column, young_male: Column) -> Column:
    """Names of the rules that a hot spot meets, in order; ``routine`` if none."""
    hour = F.regexp_extract(slice_, r"(\d{1,2}):", 1).try_cast("int")
    found = F.array_compact(F.array(
        F.when(risk == "high", "inspect"), F.when((hour >= 21) | (hour < 6), "night_patrol"), F.when(mean_speed > 20, "speed_display"),
        F.when(young_male > 0.6, "education"), F.when(risk == "high", "joint_high"), F.when(risk == "medium", "joint_medium"),
    ))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("routine")))


def interpret_analysis(hotspots: Column, moran: Column, trend: Column) -> Column:
    """Levels and patterns that an analysis summary is told with, and the instruction levels it calls for."""
    level = F.when(hotspots > 10, RED).when(hotspots > 5, YELLOW).otherwise(BLUE)
    pattern = F.when(moran > 0.3, "high").when(moran > 0.1, "medium").when(moran > -0.1, "random").when(moran.isNotNull(), "dispersed")
    trend_level = F.when(trend == "increasing", RED).when(trend == "decreasing", BLUE).otherwise(YELLOW)
    calls = F.array_compact(F.array(
        F.when((hotspots > 10) | F.coalesce(moran > 0.3, F.lit(False)) | (trend == "increasing"), RED),
        F.when(((hotspots > 5) & (hotspots <= 10)) | F.coalesce((moran > 0.1) & (moran <= 0.3), F.lit(False)) | (trend == "no trend"), YELLOW),
        F.when((hotspots <= 5) | (trend == "decreasing"), BLUE),
    ))
    advice = F.array_compact(F.array(F.when(hotspots > 0, "patrol"), F.when(moran > 0.1, "facilities"), F.when(trend == "increasing", "campaign")))
    return F.struct(
        level.alias("hotspot_level"), pattern.alias("moran_pattern"), trend_level.alias("trend_level"), calls.alias("instructions"), advice.alias("recommendations"),
    )


def split_lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def join_items(items: Column) -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), "；")
