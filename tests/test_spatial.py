"""Neighbours, hot spots, autocorrelation."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajrisk.operators import spatial
from trajrisk.params import DEFAULTS

CELL = "grid_id string, col long, row long, value double, x double, y double"


def cells(spark, places, values):
    return spark.createDataFrame([(f"G{i:03d}", int(c), int(r), float(v), float(c), float(r)) for i, ((c, r), v) in enumerate(zip(places, values, strict=True))], CELL)


def test_neighbours_of_scattered_cells(spark):
    rng = np.random.default_rng(4)
    dense = list(itertools.product(range(6), range(6)))
    for places in (dense, [tuple(p) for p in rng.integers(-300, 300, (40, 2)).tolist()] + dense[:9], dense[:4], dense[:1]):
        places = sorted(set(places))
        got = {}
        for r in spatial.knn_neighbors(cells(spark, places, [1.0] * len(places))).collect():
            got.setdefault(int(r["i"][1:]), set()).add(int(r["j"][1:]))
        for i, (c, r) in enumerate(places):
            order = sorted((j for j in range(len(places)) if j != i), key=lambda j: ((places[j][0] - c) ** 2 + (places[j][1] - r) ** 2, j))
            assert got.get(i, set()) == set(order[:5])


def test_permutations_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    df = cells(spark, list(itertools.product(range(7), range(7))), rng.gamma(2, size=49) + np.repeat(np.arange(7), 7))
    local = spatial.local_moran(df, spatial.knn_neighbors(df))
    one, many = ({r["grid_id"]: r for r in spatial.lisa_permutations(local.repartition(n)).collect()} for n in (1, 8))
    assert one == many and all(1 / 1000 <= r["lisa_p"] <= 1 for r in one.values())
    # The plain definition: every cell draws its neighbours' values from all others, by the shared numbers.
    names = sorted(one)
    draws = spatial.shared_draws(len(names) - 1, 5, DEFAULTS.permutations, 1)
    assert draws.min() == 0 and draws.max() == 47 and all(len(set(row)) == 5 for row in draws.tolist())
    for i, name in enumerate(names):
        r, others = one[name], [one[m]["x"] for m in names if m != name]
        sims = np.array([r["x"] * np.mean([others[d] for d in row]) / r["m2"] for row in draws.tolist()])
        larger = int((np.round(sims, 9) >= round(r["local_i"], 9)).sum())
        assert r["lisa_p"] == (min(larger, 999 - larger) + 1) / 1000 and r["lisa_z"] == pytest.approx((r["local_i"] - sims.mean()) / sims.std())
    assert sum(r["n"] for r in spatial.lisa_label_counts(spatial.lisa_permutations(local)).collect()) == sum(r["lisa_p"] < 0.05 for r in one.values())
    assert {r["label"] for r in one.values()} <= {"高-高", "低-低", "高-低", "低-高"}


def test_moran_against_numpy(spark):
    rng = np.random.default_rng(6)
    places, values = list(itertools.product(range(5), range(4))), rng.random(20)
    df = cells(spark, places, values)
    x = values - values.mean()
    w = np.zeros((20, 20))
    for r in spatial.knn_neighbors(df).collect():
        w[int(r["i"][1:]), int(r["j"][1:])] = 0.2
    r = spatial.global_moran(df, spatial.knn_neighbors(df)).first()
    assert r["moran_i"] == pytest.approx(20 / w.sum() * (x @ w @ x) / (x @ x), abs=1e-6) and 0 <= r["p"] <= 1
    near = np.array([[0 < np.hypot(a[0] - b[0], a[1] - b[1]) <= 1.5 for b in places] for a in places], float)
    assert spatial.global_moran_radius(df, 1.5).first()["moran_i"] == pytest.approx(20 / near.sum() * (x @ near @ x) / (x @ x), abs=1e-6)
    local = {r["grid_id"]: r["local_i"] for r in spatial.local_moran_radius(df, 1.5).collect()}
    assert [local[f"G{i:03d}"] for i in range(20)] == pytest.approx(((near @ x) * x / x.var()).tolist())
    one = cells(spark, [(0, 0)], [1.0])
    r = spatial.global_moran(one, spatial.knn_neighbors(one)).first()
    assert (r["moran_i"], r["z"], r["p"]) == (0.0, 0.0, 1.0)


def scored(spark, ghost=False, cri=True):
    """Nine cells, and perhaps one of low exposure with an enormous rate."""
    rows = [(f"G{c}{r}", c, r, "valid", (c + r) * 10.0, 0.0, 10.0, (90.0 if (c, r) == (2, 2) else 10.0 + 5 * c) if cri else None) for c in range(3) for r in range(3)]
    rows += [("GHOST", 3, 3, "low_exposure", 62516.0, 62516.0, 62516.0, None)] if ghost else []
    df = spark.createDataFrame(rows, "grid_id string, col long, row long, quality_flag string, overspeed_rate double, reverse_rate double, rapid_rate double, cri double")
    return df.withColumns({"cri_available": F.lit(cri), "rapid_available": F.lit(True)})


def test_layers(spark):
    spots, facts = spatial.hotspot_layers(scored(spark, ghost=True))
    kinds = {r["layer"]: r for r in facts.collect()}
    assert kinds["reverse"]["selection_type"] == "no_risk" and all(r["n_valid"] == 9 for r in kinds.values())
    assert all(kinds[k]["selection_type"] in ("hotspot_gi", "top_risk_fallback") for k in ("comprehensive", "overspeed", "rapid"))
    assert "GHOST" not in {r["grid_id"] for r in spots.collect()} and "reverse" not in {r["layer"] for r in spots.collect()}
    assert all(r["n_significant"] == spots.where(F.col("layer") == k).count() for k, r in kinds.items())
    none = {r["layer"]: r["selection_type"] for r in spatial.hotspot_layers(scored(spark, cri=False))[1].collect()}
    assert none["comprehensive"] == "insufficient_data"
    closed = scored(spark).withColumn("rapid_available", F.lit(False))
    assert {r["layer"]: r["selection_type"] for r in spatial.hotspot_layers(closed)[1].collect()}["rapid"] == "insufficient_data"


def test_hot_cells_are_found(spark):
    values = [100.0 if c < 2 and r < 3 else 1.0 for c in range(8) for r in range(8)]
    df = cells(spark, list(itertools.product(range(8), range(8))), values)
    got = {r["grid_id"]: r for r in spatial.getis_ord_gi_star(df, spatial.knn_neighbors(df)).collect()}
    assert got["G001"]["risk_level"] == "high" and got["G063"]["risk_level"] == "insignificant"
    top = spatial.top_risk_fallback(df).collect()
    assert len(top) == DEFAULTS.fallback_n and {r["grid_id"] for r in top if r["value"] == 100.0} == {"G000", "G001", "G002", "G008", "G009", "G010"}
    with pytest.raises(ValueError, match="at least 3"):
        spatial.assert_min_cells(df.limit(2))


def test_hull(spark):
    rows = [("a", x, y) for x in range(5) for y in range(5)] + [("b", 1, 1), ("b", 1, 1), ("c", 0, 0), ("c", 1, 1), ("c", 2, 2), ("a", None, 3)]
    df = spark.createDataFrame([(k, None if x is None else float(x), float(y)) for k, x, y in rows], "risk_level string, lon double, lat double").repartition(5)
    got = {r["risk_level"]: [(p["lon"], p["lat"]) for p in r["hull"]] for r in spatial.hotspot_hull(df).collect()}
    assert got["a"] == [(0, 0), (4, 0), (4, 4), (0, 4)] and got["b"] == [(1, 1)] and got["c"] == [(0, 0), (2, 2)]
