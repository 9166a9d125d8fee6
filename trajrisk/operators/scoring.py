"""Entropy weights, TOPSIS closeness and danger indices of valid cells. Each needs a few global sums, one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULTS, Params

RATES = ("overspeed_rate", "reverse_rate", "rapid_rate")


def valid_grids(grid: DataFrame, value: str | None = None) -> DataFrame:
    """Cells of good quality, with ``value`` if one is named: only these take part in statistics."""
    out = grid.where(F.col("quality_flag") == "valid")
    return out if value is None else out.where(F.col(value).isNotNull())


def gate_rapid(grid: DataFrame, thresholds: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``rapid_available`` is false with less than ``min_motion`` motion samples; the rapid rate then counts as 0."""
    one = thresholds.select((F.col("n_motion") >= p.min_motion).alias("rapid_available"))
    rows = grid.crossJoin(F.broadcast(one))  # one row
    return rows.withColumn("rapid_rate", F.when(F.col("rapid_available") | F.col("rapid_rate").isNull(), F.col("rapid_rate")).otherwise(0.0))


def entropy_weights(grid: DataFrame, columns: tuple[str, ...] = RATES) -> DataFrame:
    """One row of weights ``w_<column>``; a constant or empty column weighs 0, and all alike if every one does."""
    rows = valid_grids(grid).select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))
    totals = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("s", F.sum), ("lo", F.min), ("hi", F.max))))
    p = {c: F.try_divide(F.col(c), F.col(f"s_{c}")) for c in columns}
    terms = [F.sum(F.when(p[c] > 0, p[c] * F.ln(p[c])).otherwise(0.0)).alias(f"h_{c}") for c in columns]
    keep = [F.first(x).alias(x) for x in totals.columns]
    one = rows.crossJoin(F.broadcast(totals)).agg(*terms, *keep)  # totals: one row
    usable = lambda c: (F.col(f"s_{c}") > 0) & (F.col(f"lo_{c}") < F.col(f"hi_{c}")) & (F.col("n") > 1)
    d = {c: F.when(usable(c), 1 + F.try_divide(F.col(f"h_{c}"), F.ln("n"))).otherwise(0.0) for c in columns}
    total = reduce(lambda a, b: a + b, d.values())
    return one.select(*(F.when(total > 0, d[c] / total).otherwise(1 / len(columns)).alias(f"w_{c}") for c in columns))


def topsis(grid: DataFrame, weights: DataFrame, columns: tuple[str, ...] = RATES) -> DataFrame:
    """``grid_id, closeness`` of valid cells: nearness to the worst ideal over the sum of both distances, 0 without any."""
    rows = valid_grids(grid).select("grid_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))
    totals = rows.agg(*(f.alias(f"{k}_{c}") for c in columns for k, f in (("q", F.sqrt(F.sum(F.col(c) * F.col(c)))), ("hi", F.max(c)), ("lo", F.min(c)))))
    one = F.broadcast(totals.crossJoin(weights))  # one row
    scaled = lambda x, c: F.when(F.col(f"q_{c}") > 0, F.col(x) / F.col(f"q_{c}")).otherwise(0.0) * F.col(f"w_{c}")
    far = lambda k: F.sqrt(reduce(lambda a, b: a + b, [F.pow(scaled(c, c) - scaled(f"{k}_{c}", c), 2) for c in columns]))
    rows = rows.crossJoin(one).withColumns({"best": far("hi"), "worst": far("lo")})
    both = F.col("best") + F.col("worst")
    return rows.select("grid_id", F.when(both > 0, F.col("worst") / both).otherwise(0.0).alias("closeness"))


def danger_indices(grid: DataFrame, columns: tuple[str, ...] = RATES) -> DataFrame:
    """Share of the largest rate x 100 for valid cells; 0 if the largest is not above 0."""
    rows = valid_grids(grid).select("grid_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in columns))
    one = rows.agg(*(F.max(c).alias(f"hi_{c}") for c in columns))
    index = lambda c: F.when(F.col(f"hi_{c}") > 0, F.bround(F.col(c) / F.col(f"hi_{c}") * 100, 1)).otherwise(0.0)
    return rows.crossJoin(F.broadcast(one)).select("grid_id", *(index(c).alias(c.replace("_rate", "_index")) for c in columns))  # one row


def risk_scores(grid: DataFrame, thresholds: DataFrame, p: Params = DEFAULTS, columns: tuple[str, ...] = RATES) -> DataFrame:
    """All cells with indices, ``cri`` (closeness x 100) and ``cri_available``.

    They are null for cells that are not valid, and for all with less than two valid ones; ``cri`` also without enough
    motion samples.
    """
    gated = gate_rapid(grid, thresholds, p)
    scored = danger_indices(gated, columns).join(topsis(gated, entropy_weights(gated, columns), columns), "grid_id")
    enough = valid_grids(grid).agg((F.count("*") >= 2).alias("enough"))
    rows = gated.select("grid_id", "rapid_available").join(scored, "grid_id", "left").crossJoin(F.broadcast(enough))  # one row
    names = [c.replace("_rate", "_index") for c in columns]
    both = F.col("rapid_available") & F.col("enough")
    rows = rows.select(
        "grid_id", *(F.when(F.col("enough"), F.col(n)).alias(n) for n in names), F.when(both, F.bround(F.col("closeness") * 100, 1)).alias("cri"),
        both.alias("cri_available"), "rapid_available",
    )
    return grid.join(rows, "grid_id")
