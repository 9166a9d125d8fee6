"""Feedback ledger, operation log, and the effect of checks on site."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import join_items, split_lines
from ..params import DEFAULTS, Params

#: Conclusions of a check on site, default reporter, photos at most.
HOLDS, PARTLY, FAILS = "成立", "部分成立", "不成立"
REPORTER, MAX_PHOTOS = "值班民警", 3
#: A ledger row; lists are arrays.
FEEDBACK_SCHEMA = (
    "feedback_id string, analysis_version string, grid_id string, handled_at string, conclusion string, scene_issues array<string>, measures array<string>, "
    "responsible_unit string, reporter string, note string, photos array<string>, created_at string"
)


def validate_feedback(forms: DataFrame) -> DataFrame:
    """Forms as ledger rows with ``problems``, empty for good ones: conclusion of three, day as YYYY-MM-DD, three photos at
    most; issues and measures are lines of text, the reporter has a default."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    day = text("handled_at")
    problems = F.array_compact(F.array(
        F.when(~text("conclusion").isin(HOLDS, PARTLY, FAILS), "conclusion"),
        F.when(~day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | day.try_cast("date").isNull(), "handled_at"),
        F.when(F.coalesce(F.size("photos"), F.lit(0)) > MAX_PHOTOS, "photos"),
    ))
    return forms.withColumns({
        "conclusion": text("conclusion"), "handled_at": day, "scene_issues": split_lines(F.col("scene_issues")), "measures": split_lines(F.col("measures")),
        "responsible_unit": text("responsible_unit"), "reporter": F.coalesce(F.nullif(text("reporter"), F.lit("")), F.lit(REPORTER)), "note": text("note"),
        "photos": F.coalesce("photos", F.array().cast("array<string>")), "problems": problems,
    })


def filter_feedback(
    feedback: DataFrame, version: str | None = None, grid_id: str | None = None, conclusion: str | None = None, date_from: str | None = None, date_to: str | None = None
) -> DataFrame:
    """By version, cell, conclusion and day of the check, both ends included."""
    out = feedback
    for column, value in (("analysis_version", version), ("grid_id", grid_id), ("conclusion", conclusion)):
        out = out if value is None else out.where(F.col(column) == value)
    out = out if date_from is None else out.where(F.coalesce("handled_at", F.lit("")) >= date_from)
    return out if date_to is None else out.where(F.coalesce("handled_at", F.lit("")) <= date_to)


def feedback_ledger(feedback: DataFrame, limit: int = 500) -> DataFrame:
    """The newest ``limit`` rows."""
    return feedback.orderBy(F.desc("handled_at"), F.desc("created_at"), F.desc("feedback_id")).limit(limit)


def feedback_history(records: DataFrame) -> DataFrame:
    """``feedback_id, timestamp``: seconds since 1970 of ISO texts and of numbers, 0 for others; newest first."""
    t = F.coalesce("timestamp", "created_at")
    iso = F.unix_seconds(F.when(t.contains("T"), F.regexp_replace(t, "Z$", "+00:00")).try_cast("timestamp"))
    number = F.when(~t.contains("T"), F.floor(t.try_cast("double"))).cast("long")
    return records.select("feedback_id", F.coalesce(iso, number, F.lit(0)).cast("long").alias("timestamp")).orderBy(F.desc("timestamp"), "feedback_id")


def feedback_export_rows(feedback: DataFrame) -> DataFrame:
    """Ledger rows with lists as one text."""
    return feedback.select(
        "feedback_id", "analysis_version", "grid_id", "handled_at", "conclusion", join_items(F.col("scene_issues")).alias("scene_issues"),
        join_items(F.col("measures")).alias("measures"), "responsible_unit", "reporter", "note", join_items(F.col("photos")).alias("photos"), "created_at",
    )


def feedback_status(feedback: DataFrame) -> DataFrame:
    newest = F.struct("handled_at", "feedback_id")
    return feedback.groupBy("grid_id").agg(F.count("*").alias("n"), F.max_by("conclusion", newest).alias("latest"), F.max("handled_at").alias("latest_at"))


def false_streak(feedback: DataFrame) -> DataFrame:
    """Leading newest records of a grid that say the finding does not hold; flagged from three on.

    They are those after the newest record that says otherwise: two aggregations, no grid is sorted.
    """
    other = F.max(F.when(F.col("conclusion") != FAILS, F.struct("handled_at", "feedback_id")))
    last = feedback.groupBy("grid_id").agg(other.alias("other"))
    rows = feedback.join(last, "grid_id")
    lead = F.count_if(F.col("other").isNull() | (F.struct("handled_at", "feedback_id") > F.col("other")))
    return rows.groupBy("grid_id").agg(lead.alias("streak")).withColumn("flagged", F.col("streak") >= 3)


def events_in_grid_box(events: DataFrame, grids: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Events with the ``grid_id`` of every grid within whose box around ``center_lon, center_lat`` they lie, bounds included.

    Boxes are listed in the blocks of twice their half sides that they touch; an equi-join on blocks precedes the test.
    Bounds of decimal centres are exact (``exact_centres``), those of doubles are sums of doubles.
    """
    sides = {c: F.lit(Decimal(str(side))) for c, side in (("lon", p.box_lon), ("lat", p.box_lat))}
    block = lambda v, c: F.floor(v.cast("double") / (2 * sides[c]).cast("double"))
    span = lambda c: F.sequence(block(F.col(f"center_{c}") - sides[c], c), block(F.col(f"center_{c}") + sides[c], c))
    boxes = grids.select("grid_id", "center_lon", "center_lat").withColumn("bx", F.explode(span("lon"))).withColumn("by", F.explode(span("lat")))
    placed = events.drop("grid_id").withColumns({"bx": block(F.col("lon"), "lon"), "by": block(F.col("lat"), "lat")})
    inside = lambda c: F.col(c).between(F.col(f"center_{c}") - sides[c], F.col(f"center_{c}") + sides[c])
    return placed.join(boxes, ["bx", "by"]).where(inside("lon") & inside("lat")).drop("bx", "by", "center_lon", "center_lat")


def exact_centres(cells: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Degree cells (``gx``) with ``center_lon`` as a decimal, so that a box's bounds are the very numbers which longitudes
    of six decimals are compared with. (The latitude in the middle is none that decimals have.)"""
    side = Decimal(str(p.v1_cell_deg))
    return cells.withColumn("center_lon", F.col("gx") * F.lit(side) + F.lit(side / 2))


def events_in_grid_cell(events: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Events with the ``grid_id`` of the degree cell in which they lie, instead of a box around its centre."""
    place = lambda c: F.floor(F.col(c) / p.v1_cell_deg)
    return events.withColumn("grid_id", F.concat(F.lit("G"), place("lon"), F.lit("_"), place("lat")))


def event_rate_change(feedback: DataFrame, events: DataFrame, days: int = 14) -> DataFrame:
    """Events a day of a grid in the ``days`` before and from its latest check on (``events``: ``grid_id, day``).

    ``status`` is ``ok`` where the days after are covered to their end, else ``insufficient``. Events are counted by
    grid and day before they meet the checks.
    """
    latest = feedback.groupBy("grid_id").agg(F.max("handled_at").alias("t"))
    daily = events.where("day IS NOT NULL").groupBy("grid_id", "day").agg(F.count("*").alias("c"))
    last = daily.groupBy("grid_id").agg(F.max("day").alias("last_day"))
    gap = F.date_diff("day", "t")
    near = daily.join(latest, "grid_id").where((gap >= -days) & (gap < days)).groupBy("grid_id").agg(
        F.sum(F.when(gap < 0, F.col("c"))).alias("b"), F.sum(F.when(gap >= 0, F.col("c"))).alias("a")
    )
    rows = latest.join(near, "grid_id", "left").join(last, "grid_id", "left")
    b, a = F.coalesce("b", F.lit(0)), F.coalesce("a", F.lit(0))
    covered = (a > 0) & (F.col("last_day") >= F.date_add("t", days - 1))
    ok = F.coalesce(covered, F.lit(False))
    return rows.select(
        "grid_id", "t", b.alias("n_before"), a.alias("n_after"), F.when(ok, "ok").otherwise("insufficient").alias("status"),
        F.when(F.col("last_day").isNotNull(), F.bround(b / days, 2)).alias("before_per_day"), F.when(ok, F.bround(a / days, 2)).alias("after_per_day"),
        F.when(ok & (b > 0), F.bround((a - b) / b * 100, 1)).alias("pct"),
    )


def filter_operation_log(logs: DataFrame, start: str | None = None, end: str | None = None, types: tuple[str, ...] | None = None) -> DataFrame:
    """By time as text, both ends included, and by type."""
    out = logs if start is None else logs.where(F.col("timestamp").cast("string") >= start)
    out = out if end is None else out.where(F.col("timestamp").cast("string") <= end)
    return out if types is None else out.where(F.col("operation_type").isin(*types))


def log_statistics(logs: DataFrame) -> DataFrame:
    """Counts by type, by user, by day and in all, in one pass."""
    view = logs.select("operation_type", "user", F.to_date("timestamp").alias("day"))
    return view.sparkSession.sql(
        "SELECT operation_type, user, day, count(*) AS n FROM {v} GROUP BY GROUPING SETS ((operation_type), (user), (day), ())", v=view
    )


def _first_of_day(feedback: DataFrame) -> DataFrame:
    """The first feedback of every day: ``day`` and its columns."""
    row = F.struct("feedback_id", "content", "lon", "lat")
    return feedback.groupBy(F.to_date("created_at").alias("day")).agg(F.min_by(row, F.struct("created_at", "feedback_id")).alias("f"))


def _place(f: str = "") -> Column:
    """The place as one text; what is missing is empty."""
    return F.concat_ws(",", *(F.coalesce(F.col(f + c).cast("string"), F.lit("")) for c in ("lon", "lat")))


def log_feedback_same_day(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Logs with the first feedback of their day, if there is one."""
    day = F.to_date("timestamp")
    rows = logs.withColumn("day", day).join(_first_of_day(feedback), "day", "left")
    return rows.select(
        "timestamp", "operation_type", "user", "f.feedback_id", F.coalesce("f.content", F.lit("")).alias("content"),
        F.when(F.col("f").isNotNull(), _place("f.")).otherwise("").alias("place"),
    )


def feedback_without_log(feedback: DataFrame, logs: DataFrame) -> DataFrame:
    """Feedback of days without any log."""
    days = logs.select(F.to_date("timestamp").alias("day")).distinct()
    return feedback.withColumn("day", F.to_date("created_at")).join(days, "day", "left_anti").drop("day")


def log_with_feedback(logs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Logs with the feedback of their day, and feedback of days without a log as rows of their own."""
    alone = feedback_without_log(feedback, logs).select(
        F.col("created_at").alias("timestamp"), F.lit("feedback").alias("operation_type"), F.lit("anonymous").alias("user"), "feedback_id",
        F.coalesce("content", F.lit("")).alias("content"), _place().alias("place"),
    )
    return log_feedback_same_day(logs, feedback).unionByName(alone)
