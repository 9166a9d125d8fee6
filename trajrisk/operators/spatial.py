"""Neighbours on the cell lattice, local hot spots in layers, global and local autocorrelation, hulls."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import risk_level
from ..functions.labels import LISA_LABELS
from ..params import DEFAULTS, Params
from ..sources.tables import delete, stored
from .numbering import numbered

#: Numbers that are drawn for each permutation, of which the first distinct ones are taken.
DRAWN = 64
#: Coefficients of the fit of the complementary error function.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Layers of hot spots and the column that each is made of.
LAYERS = {"comprehensive": "cri", "overspeed": "overspeed_rate", "reverse": "reverse_rate", "rapid": "rapid_rate"}


def normal_p(z: Column) -> Column:
    """Two-sided p value under the normal distribution, to some 1e-7 of itself: a Chebyshev fit of the complementary
    error function."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    series = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        series = F.lit(c) + t * series
    return t * F.exp(series - x * x)


def knn_neighbors(cells: DataFrame, p: Params = DEFAULTS, by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, i, j, d2``: the nearest other cells of every cell (``grid_id, col, row``), by (distance, grid_id).

    Cells look into the 3 x 3 blocks around their own; what is no farther than a block's side is certain. A cell with
    enough certain neighbours, or that has seen all others of its group, is done; the rest look again into blocks of
    twice the side. The first side is such that blocks hold about as many cells as are asked for. Every round is an
    equi-join on blocks of those that are not done.
    """
    by = list(by)
    k = p.neighbours
    here = stored(cells.select(*by, "grid_id", "col", "row"), "cells")
    size = here.groupBy(*by).agg(F.count("*").alias("size"), F.max("col").alias("c1"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.min("row").alias("r0"))
    wide, high = F.col("c1") - F.col("c0") + 1, F.col("r1") - F.col("r0") + 1
    facts = size.agg(F.max(F.greatest(wide, high)).alias("e"), F.max(wide * high * k / F.col("size")).alias("area")).first()
    extent = facts["e"]
    others = size.select(*by, (F.col("size") - 1).alias("others"))  # a row a group
    open_ = here
    found, side = [], 1 << max(0, math.ceil(math.log2(max(1.0, math.sqrt(float(facts["area"] or 1))))))
    while True:
        block = lambda c: F.floor(F.col(c) / side)  # noqa: B023, E731
        steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
        mine = open_.select(*by, F.col("grid_id").alias("i"), F.col("col").alias("c"), F.col("row").alias("r"), F.explode(steps).alias("s"))
        mine = mine.select(*by, "i", "c", "r", (F.floor(F.col("c") / side) + F.col("s.x")).alias("bc"), (F.floor(F.col("r") / side) + F.col("s.y")).alias("br"))
        other = here.select(*by, F.col("grid_id").alias("j"), F.col("col").alias("c2"), F.col("row").alias("r2"), block("col").alias("bc"), block("row").alias("br"))
        near = mine.join(other, [*by, "bc", "br"]).where("i <> j").select(*by, "i", "j", F.expr("(c - c2) * (c - c2) + (r - r2) * (r - r2)").cast("long").alias("d2"))
        one = Window.partitionBy(*by, "i")
        near = near.withColumns({"rank": F.row_number().over(one.orderBy("d2", "j")), "sure": F.count_if(F.col("d2") <= side * side).over(one), "seen": F.count("*").over(one)})
        last = extent is None or side >= extent  # the blocks hold all
        near = near.join(F.broadcast(others), by) if by else near.crossJoin(F.broadcast(others))  # a row a group
        near = near.where(f"rank <= {k}" if last else f"rank <= {k} AND (sure >= {k} OR seen = others)").select(*by, "i", "j", "d2")
        near = stored(near, "neighbours")
        found.append(near)
        if last:
            break
        left = open_.join(near.select(*by, F.col("i").alias("grid_id")).distinct(), [*by, "grid_id"], "left_anti")
        left = stored(left.join(F.broadcast(others.where("others > 0")), by) if by else left.crossJoin(F.broadcast(others.where("others > 0"))), "open")
        left, before = left.drop("others"), open_
        if before is not here:
            delete(before)
        open_ = left
        if open_.isEmpty():
            break
        side *= 2
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def radius_neighbors(cells: DataFrame, radius: float) -> DataFrame:
    """``i, j``: other cells whose centres ``x, y`` are not farther than ``radius``, in the unit of these. Equi-join on blocks."""
    b = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    mine = cells.select(F.col("grid_id").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.explode(steps).alias("s"))
    mine = mine.select("i", "x1", "y1", (F.floor(F.col("x1") / radius) + F.col("s.x")).alias("bx"), (F.floor(F.col("y1") / radius) + F.col("s.y")).alias("by"))
    other = cells.select(F.col("grid_id").alias("j"), "x", "y", b("x").alias("bx"), b("y").alias("by"))
    d = F.hypot(F.col("x") - F.col("x1"), F.col("y") - F.col("y1"))
    return mine.join(other, ["bx", "by"]).where((d > 0) & (d <= radius)).select("i", "j")


def getis_ord_gi_star(cells: DataFrame, neighbours: DataFrame, variance: str = "reference", by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, grid_id, gi_z, risk_level`` of all cells with ``value``: the mean of a cell and its neighbours against the mean.

    ``variance`` is that of single cells (``reference``) or of means under randomisation (``ord_getis``).
    """
    by = list(by)
    value = cells.select(*by, F.col("grid_id").alias("j"), "value")
    pairs = neighbours.select(*by, "i", "j").unionByName(cells.select(*by, F.col("grid_id").alias("i"), F.col("grid_id").alias("j")))
    local = pairs.join(value, [*by, "j"]).groupBy(*by, "i").agg(F.avg("value").alias("m"), F.count("*").alias("w"))
    one = cells.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    rows = local.join(F.broadcast(one), by) if by else local.crossJoin(F.broadcast(one))  # a row a layer
    spread = F.col("sd")
    if variance == "ord_getis":
        spread = spread * F.sqrt((F.col("n") / F.col("w") - 1) / (F.col("n") - 1))
    z = F.when(spread > 0, (F.col("m") - F.col("mean")) / spread).otherwise(0.0)
    return rows.select(*by, F.col("i").alias("grid_id"), z.alias("gi_z")).withColumn("risk_level", risk_level(F.round("gi_z", 9)))


def zscore_hotspots(cells: DataFrame) -> DataFrame:
    """``grid_id, gi_z, risk_level``: plain z-scores with the sample deviation (1 if that is 0)."""
    one = cells.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return cells.crossJoin(F.broadcast(one)).select("grid_id", z.alias("gi_z")).withColumn("risk_level", risk_level(F.round("gi_z", 9)))  # one row


def top_risk_fallback(cells: DataFrame, p: Params = DEFAULTS, by: tuple[str, ...] = ()) -> DataFrame:
    """The cells of highest value (of each group), with z-scores among themselves."""
    order = Window.partitionBy(*by).orderBy(F.desc("value"), "grid_id") if by else None
    top = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.fallback_n).drop("rank") if by else cells.orderBy(F.desc("value"), "grid_id").limit(p.fallback_n)
    one = top.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    rows = top.join(F.broadcast(one), list(by)) if by else top.crossJoin(F.broadcast(one))  # a row a group
    return rows.select(*by, "grid_id", "value", z.alias("gi_z")).withColumn("risk_level", risk_level(F.round("gi_z", 9)))


def assert_min_cells(grid: DataFrame, n: int = 3) -> DataFrame:
    """Fails with less than ``n`` cells."""
    if (found := grid.limit(n).count()) < n:
        raise ValueError(f"{found} cells, at least {n} are needed")
    return grid


def layer_cells(scored: DataFrame) -> DataFrame:
    """``layer, grid_id, col, row, value`` of valid cells with a value; the comprehensive layer only where the index is
    available, the rapid one only with enough motion samples."""
    stack = F.expr(f"stack({len(LAYERS)}, " + ", ".join(f"'{k}', {c}" for k, c in LAYERS.items()) + ") AS (layer, value)")
    rows = scored.where("quality_flag = 'valid'").select("grid_id", "col", "row", "cri_available", "rapid_available", stack)
    open_ = F.when(F.col("layer") == "comprehensive", F.col("cri_available")).when(F.col("layer") == "rapid", F.col("rapid_available")).otherwise(F.lit(True))
    return rows.where(F.col("value").isNotNull() & open_).select("layer", "grid_id", "col", "row", "value")


def hotspot_layers(scored: DataFrame, p: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Hot spots of all layers in one job, and one row of facts for each layer.

    ``layer, grid_id, layer_value, gi_z, risk_level, selection_type``: cells with z >= 1.28 (``hotspot_gi``); without one
    the cells of highest value (``top_risk_fallback``); none with less than ``min_cells`` valid cells
    (``insufficient_data``) or without a value above 0 (``no_risk``).
    """
    cells = stored(layer_cells(scored), "layers")
    names = cells.sparkSession.createDataFrame([(k,) for k in LAYERS], "layer string")
    facts = names.join(cells.groupBy("layer").agg(F.count("*").alias("n_valid"), F.max("value").alias("top")), "layer", "left")
    state = F.when(F.coalesce("n_valid", F.lit(0)) < p.min_cells, "insufficient_data").when(F.col("top") <= 0, "no_risk").otherwise("open")
    facts = facts.select("layer", F.coalesce("n_valid", F.lit(0)).alias("n_valid"), state.alias("state"))
    open_ = cells.join(F.broadcast(facts.where("state = 'open'").select("layer")), "layer")  # a row a layer
    gi = getis_ord_gi_star(open_, knn_neighbors(open_, p, ("layer",)), by=("layer",)).where("risk_level <> 'insignificant'")
    gi = stored(gi, "gi")
    rest = open_.join(F.broadcast(gi.select("layer").distinct()), "layer", "left_anti")
    fallback = top_risk_fallback(rest, p, ("layer",)).drop("value").withColumn("selection_type", F.lit("top_risk_fallback"))
    both = gi.withColumn("selection_type", F.lit("hotspot_gi")).unionByName(fallback)
    spots = both.join(cells, ["layer", "grid_id"]).select(
        "layer", "grid_id", F.bround("value", 2).alias("layer_value"), F.bround("gi_z", 3).alias("gi_z"), "risk_level", "selection_type"
    )
    spots = stored(spots, "spots")
    kinds = spots.groupBy("layer").agg(F.count("*").alias("n_significant"), F.first("selection_type").alias("selection_type"))
    facts = facts.join(kinds, "layer", "left").select(
        "layer", "n_valid", F.coalesce("n_significant", F.lit(0)).alias("n_significant"), F.coalesce("selection_type", "state").alias("selection_type")
    )
    return spots, facts


def _moran(cells: DataFrame, w: DataFrame) -> DataFrame:
    """One row: ``n, i, e, var`` for weights ``i, j, w``; the variance under normality."""
    one = cells.agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    dev = cells.crossJoin(F.broadcast(one)).select("grid_id", (F.col("value") - F.col("mean")).alias("x"), "n")  # one row
    lag = w.join(dev.select(F.col("grid_id").alias("j"), F.col("x").alias("xj")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("xj")).alias("lag"))
    part = dev.withColumnRenamed("grid_id", "i").join(lag, "i", "left").agg(
        F.sum(F.col("x") * F.coalesce("lag", F.lit(0.0))).alias("a"), F.sum(F.col("x") * F.col("x")).alias("b"), F.count("*").alias("n")
    )
    both = w.select("i", "j", "w", F.lit(0.0).alias("back")).unionByName(w.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("w"), F.col("w").alias("back")))
    s1 = both.groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("back").alias("back")).agg((F.sum(F.pow(F.col("w") + F.col("back"), 2)) / 2).alias("s1"))
    s2 = both.groupBy("i").agg((F.sum("w") + F.sum("back")).alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("s2"))
    s0 = w.agg(F.sum("w").alias("s0"))
    out = part.crossJoin(s0).crossJoin(s1).crossJoin(s2)  # one row each
    n, e = F.col("n").cast("double"), F.when(F.col("n") > 1, -1.0 / (F.col("n") - 1)).otherwise(0.0)
    var = (n * n * F.col("s1") - n * F.col("s2") + 3 * F.col("s0") * F.col("s0")) / ((n * n - 1) * F.col("s0") * F.col("s0")) - e * e
    i = F.when((F.col("b") > 0) & (F.col("s0") > 0), n / F.col("s0") * F.col("a") / F.col("b")).otherwise(0.0)
    return out.select("n", i.alias("i"), e.alias("e"), var.alias("var"))


def global_moran(cells: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Moran's I with row-standardised weights, its expectation, z and p under normality; less than two cells give 0 and p 1."""
    k = neighbours.groupBy("i").agg(F.count("*").alias("k"))
    w = neighbours.select("i", "j").join(k, "i").select("i", "j", (1.0 / F.col("k")).alias("w"))
    enough = F.col("n") >= 2
    z = F.when(enough & (F.col("var") > 0), (F.col("i") - F.col("e")) / F.sqrt("var")).otherwise(0.0)
    out = _moran(cells, w).withColumn("z", z)
    return out.select(
        "n", F.round("i", 6).alias("moran_i"), F.round("e", 6).alias("expected"), F.round("z", 4).alias("z"), F.round(normal_p(F.col("z")), 4).alias("p")
    )


def global_moran_radius(cells: DataFrame, radius: float) -> DataFrame:
    """Moran's I with weight 1 for cells within ``radius``; no test."""
    w = radius_neighbors(cells, radius).withColumn("w", F.lit(1.0))
    return _moran(cells, w).select("n", F.round("i", 6).alias("moran_i"), F.round("e", 6).alias("expected"))


def lisa_quadrant(x: Column, lag: Column) -> Column:
    """Own value and that of the neighbours, above the mean (H) or not (L)."""
    return F.concat(F.when(F.round(x, 9) > 0, "H").otherwise("L"), F.when(F.round(lag, 9) > 0, "H").otherwise("L"))


def lisa_label(quadrant: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in LISA_LABELS.items() for x in kv))[quadrant]


def local_moran(cells: DataFrame, neighbours: DataFrame) -> DataFrame:
    """``grid_id, x, lag, k, local_i, quadrant, label``: local I with row-standardised weights."""
    one = cells.agg(F.avg("value").alias("mean"), F.var_pop("value").alias("m2"))
    dev = cells.crossJoin(F.broadcast(one)).select("grid_id", (F.col("value") - F.col("mean")).alias("x"), "m2")  # one row
    lag = neighbours.join(dev.select(F.col("grid_id").alias("j"), F.col("x").alias("xj")), "j").groupBy(F.col("i").alias("grid_id"))
    lag = lag.agg(F.avg("xj").alias("lag"), F.count("*").alias("k"))
    local = F.when(F.col("m2") > 0, F.col("x") * F.col("lag") / F.col("m2")).otherwise(0.0)
    out = dev.join(lag, "grid_id").select("grid_id", "x", "lag", "k", "m2", local.alias("local_i"), lisa_quadrant(F.col("x"), F.col("lag")).alias("quadrant"))
    return out.withColumn("label", lisa_label(F.col("quadrant")))


def local_moran_radius(cells: DataFrame, radius: float) -> DataFrame:
    """``grid_id, local_i, quadrant, label, p`` with weight 1 for cells within ``radius``; p is 1, as nothing is permuted."""
    one = cells.agg(F.avg("value").alias("mean"), F.var_pop("value").alias("m2"))
    dev = cells.crossJoin(F.broadcast(one)).select("grid_id", (F.col("value") - F.col("mean")).alias("x"), "m2")  # one row
    lag = radius_neighbors(cells, radius).join(dev.select(F.col("grid_id").alias("j"), F.col("x").alias("xj")), "j").groupBy(F.col("i").alias("grid_id"))
    rows = dev.join(lag.agg(F.sum("xj").alias("lag")), "grid_id", "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))
    local = F.when(F.col("m2") > 0, F.col("x") * F.col("lag") / F.col("m2")).otherwise(0.0)
    rows = rows.select("grid_id", local.alias("local_i"), lisa_quadrant(F.col("x"), F.col("lag")).alias("quadrant"), F.lit(1.0).alias("p"))
    return rows.withColumn("label", lisa_label(F.col("quadrant")))


def shared_draws(others: int, k: int, permutations: int, seed: int) -> np.ndarray:
    """For each permutation ``k`` distinct numbers below ``others``: the first of those that digests of the seed, the
    permutation and 0, 1, 2 and so on give; -1 where ``DRAWN`` digests have less."""
    out = np.full((permutations, k), -1, np.int64)
    for i in range(permutations):
        numbers = (int(hashlib.md5(f"{seed}-{i}-{j}".encode()).hexdigest()[:15], 16) % others for j in range(DRAWN))
        found = list(itertools.islice(dict.fromkeys(numbers), k))
        out[i, : len(found)] = found
    return out


def lisa_permutations(local: DataFrame, p: Params = DEFAULTS, seed: int = 1) -> DataFrame:
    """``local`` with ``lisa_z`` and ``lisa_p`` against conditional permutations: the neighbours' values are drawn from all
    other cells.

    Cells are numbered in the order of their ids. All cells share one table of draws, of a size that does not depend on
    the number of cells: ranks among the others. A rank is the number of a cell, or of the next one for cells that stand
    before it, so that the values of these few numbers are all that is sent to the tasks.
    """
    cells = stored(numbered(local, ["grid_id"], "__n"), "numbered")
    n, k = cells.agg(F.count("*"), F.coalesce(F.max("k"), F.lit(0))).first()
    others, k = n - 1, int(min(k, max(n - 1, 0)))
    draws = shared_draws(others, k, p.permutations, seed) if others > 0 else np.zeros((p.permutations, 0), np.int64)
    wanted = np.unique(np.concatenate([draws[draws >= 0], draws[draws >= 0] + 1]))  # at most 2 * permutations * k
    table = cells.sparkSession.createDataFrame([(int(i),) for i in wanted], "__n long")
    known = {r["__n"]: r["x"] for r in cells.select("__n", "x").join(F.broadcast(table), "__n").collect()}
    here = np.array([[known.get(d, np.nan) for d in row] for row in draws.tolist()]).reshape(draws.shape)
    after = np.array([[known.get(d + 1, np.nan) for d in row] for row in draws.tolist()]).reshape(draws.shape)
    shared = cells.sparkSession.sparkContext.broadcast((draws, here, after))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws, here, after = shared.value
        for batch in batches:
            z, q = np.zeros(batch.num_rows), np.ones(batch.num_rows)
            columns = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("__n", "x", "local_i", "k", "m2"))
            for row, (number, own, i, size, m2) in enumerate(zip(*columns, strict=True)):
                if others < 1 or not m2:
                    continue
                size = min(int(size), draws.shape[1])
                values = np.where(draws[:, :size] >= number, after[:, :size], here[:, :size])
                some = draws[:, :size] >= 0
                sims = own * np.where(some, values, 0.0).sum(axis=1) / some.sum(axis=1) / m2
                sd = sims.std()
                z[row] = (i - sims.mean()) / sd if sd > 0 else 0.0
                larger = int((np.round(sims, 9) >= round(i, 9)).sum())
                q[row] = (min(larger, p.permutations - larger) + 1) / (p.permutations + 1)
            at = batch.schema.get_field_index("__n")
            kept = [c for c in range(batch.num_columns) if c != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(z), pa.array(q)], [*(batch.schema.names[c] for c in kept), "lisa_z", "lisa_p"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in local.schema) + ", lisa_z double, lisa_p double"
    return cells.mapInArrow(run, schema)


def lisa_label_counts(lisa: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Significant cells by label."""
    return lisa.where(F.col("lisa_p") < p.lisa_p).groupBy("label").agg(F.count("*").alias("n"))


def hotspot_hull(points: DataFrame, by: str = "risk_level") -> DataFrame:
    """``by, hull``: corners of the convex hull of each group's points ``lon, lat``, counter-clockwise from the leftmost.

    Only corners travel: every task folds its points of a group to their hull first, then the hulls are folded.
    """

    def corners(xy: np.ndarray) -> list[tuple[float, float]]:
        pts = sorted(set(map(tuple, xy.tolist())))
        if len(pts) < 3:
            return pts

        def half(seq) -> list:
            out: list = []
            for q in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]

        return half(pts) + half(reversed(pts))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, g in batch.groupby(by):
                held[key] = corners(np.array([*held.get(key, []), *g[["lon", "lat"]].to_numpy().tolist()]))
        yield pd.DataFrame([(k, *q) for k, pts in held.items() for q in pts], columns=[by, "lon", "lat"])

    kind = points.schema[by].dataType.simpleString()
    part = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(by, "lon", "lat").mapInPandas(fold, f"{by} {kind}, lon double, lat double")

    def join(g: pd.DataFrame) -> pd.DataFrame:
        pts = corners(g[["lon", "lat"]].to_numpy())
        return pd.DataFrame({by: [g[by].iloc[0]], "hull": [[{"lon": x, "lat": y} for x, y in pts]]})

    return part.groupBy(by).applyInPandas(join, f"{by} {kind}, hull array<struct<lon:double,lat:double>>")
