"""Paths and Viterbi matching against brute force."""

import itertools
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajrisk.operators import ingest, matching, roads
from trajrisk.params import DEFAULTS


def lattice(spark, n=7, step=0.001):
    rows = []
    for i, j, vertical in itertools.product(range(n), range(n), (0, 1)):
        a, b = (116.5 + i * step, 39.75 + j * step), (116.5 + (i + 1 - vertical) * step, 39.75 + (j + vertical) * step)
        rows.append((i * 100 + j * 10 + vertical, "secondary", "B", None, None, [[a, b]]))
    return roads.road_edges(spark.createDataFrame(rows, roads.ROAD_SCHEMA))


def points(spark, chains):
    t, rows = datetime(2024, 6, 5, 8), []
    for v, places in enumerate(chains):
        for k, (lon, lat) in enumerate(places):
            rows.append((v * 1000 + k, f"V{v}", t + timedelta(seconds=5 * k), float(lon), float(lat), 0))
    df = spark.createDataFrame(rows, "event_id long, vehicle_id string, time timestamp_ntz, lon double, lat double, segment_flag int").withColumn("raw_speed_mps", F.lit(None).cast("double"))
    return matching.obs_bearings(matching.with_metres(ingest.point_kinematics(ingest.segment_trajectories(df))))


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(5)
    for n in range(1, 7):
        sizes = rng.integers(1, 5, n)
        scores = [rng.normal(size=k) for k in sizes]
        moves = [rng.random((a, b)) for a, b in itertools.pairwise(sizes)]
        total = lambda p: sum(s[i] for s, i in zip(scores, p, strict=True)) + sum(m[a, b] for m, a, b in zip(moves, p, p[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product(*map(range, sizes)), key=total)
        assert matching.best_path(scores, moves) == list(best)
    assert matching.best_path([np.zeros(3), np.zeros(2)], [np.zeros((3, 2))]) == [0, 0]


def test_paths_over_tile_borders(spark):
    """Paths in tiles of any side against a search of the whole graph; most of them cross borders of small tiles."""
    edges = lattice(spark)
    sources = edges.where("osm_id % 7 = 0").select(F.col("u_key").alias("n1")).distinct()
    rows = [(r["u_key"], r["v_key"], r["length_m"]) for r in edges.collect()]
    near = {}
    for a, b, w in rows + [(b, a, w) for a, b, w in rows]:
        near.setdefault(a, []).append((b, w))
    want = {}
    for (source,) in sources.collect():
        best, open_ = {source: 0.0}, [source]
        while open_:
            n = open_.pop()
            for m, w in near[n]:
                if best[n] + w <= DEFAULTS.path_m and best[n] + w < best.get(m, 1e9) - 1e-9:
                    best[m] = best[n] + w
                    open_.append(m)
        want |= {(source, m): d for m, d in best.items()}
    assert len(want) > 300
    for side in (90.0, 250.0, matching.TILE_M):
        got = [((r["n1"], r["n2"]), r["path_m"]) for r in matching.bounded_shortest_paths(edges, sources, tile_m=side).collect()]
        assert len(got) == len(dict(got)) and dict(got).keys() == want.keys() and all(d == pytest.approx(want[k]) for k, d in got)
    lone = matching.bounded_shortest_paths(edges, spark.createDataFrame([(5,)], "n1 long")).collect()
    assert [tuple(r) for r in lone] == [(5, 5, 0.0)]


def test_points_on_edges_return_these_edges(spark):
    """A drive along the lattice, a little beside the roads; a point far from all roads stays unmatched."""
    route = [(116.5 + 0.0002 * k, 39.752 + 0.00002) for k in range(1, 10)] + [(116.502 + 0.00002, 39.752 + 0.0002 * k) for k in range(1, 10)]
    df = matching.match_candidates(points(spark, [route, [*route[:3], (116.49, 39.74), *route[3:6]]]), lattice(spark))
    edges = lattice(spark)
    found = {r["event_id"]: r for r in matching.attach_projection(df, matching.viterbi_match(df, edges)).collect()}
    assert len(found) == len(route) + 7
    for k in range(9):
        i = int((0.0002 * (k + 1)) / 0.001 - 1e-9)
        assert found[k]["osm_id"] == i * 100 + 20, k
        assert found[9 + k]["osm_id"] == 200 + (2 + int((0.0002 * (k + 1)) / 0.001 - 1e-9)) * 10 + 1, k
    assert found[1003]["matched"] == 0 and found[1003]["proj_lon"] is None and found[1004]["matched"] == 1
    assert found[5]["travel_dir"] == "forward" and found[0]["travel_dir"] is None
    assert found[5]["proj_lat"] == pytest.approx(39.752, abs=1e-6)


def test_viterbi_against_brute_force_on_roads(spark):
    """All paths through the candidates of short chains, scored by the plain definition."""
    rng = np.random.default_rng(3)
    chains = [[(116.503 + x, 39.753 + y) for x, y in np.cumsum(rng.normal(0, 0.0003, (5, 2)), axis=0)] for _ in range(4)]
    df, edges = matching.match_candidates(points(spark, chains), lattice(spark)), lattice(spark)
    nodes = edges.select(F.explode(F.array("u_key", "v_key")).alias("n1")).distinct()
    sp = {(r["n1"], r["n2"]): r["path_m"] for r in matching.bounded_shortest_paths(edges, nodes).collect()}
    got = {r["event_id"]: r["choice"] for r in matching.viterbi_match(df, edges).collect()}

    def way(a, b):
        if a["edge_id"] == b["edge_id"]:
            return abs(a["along"] - b["along"])
        ends = lambda c: ((c["u"], c["along"]), (c["v"], c["length_m"] - c["along"]))
        return min((x + sp[m, n] + y for m, x in ends(a) for n, y in ends(b) if (m, n) in sp), default=None)

    for v in range(4):
        rows = [r for r in df.where(F.col("vehicle_id") == f"V{v}").orderBy("point_order").collect() if r["cands"]]

        def total(path):
            score = 0.0
            for k, (r, i) in enumerate(zip(rows, path, strict=True)):  # noqa: B023
                c = r["cands"][i]
                score += max(-0.5 * (c["d"] / 10) ** 2, np.log(1e-12))
                if k:
                    p = rows[k - 1]["cands"][path[k - 1]]  # noqa: B023
                    w, straight = way(p, c), np.hypot(p["px"] - c["px"], p["py"] - c["py"])
                    score += 0.17 * (0 if w is None else np.exp(-max(w - straight, 0) / 10)) + 0.83 * 0.5 * (1 + np.cos(np.radians(r["obs_bearing"] - c["seg_bearing"])))
            return score

        best = max(total(p) for p in itertools.product(*(range(len(r["cands"])) for r in rows)))
        assert total([got[r["event_id"]] for r in rows]) == pytest.approx(best, abs=1e-5)


def test_interval_modes(spark):
    rows = [("V", 1, d) for d in (None, 0.0, 5.0, 12.0, 12.0, 5.0)] + [("V", 2, None), ("W", 1, 30.0)]
    got = {(r["vehicle_id"], r["segment_seq"]): (r["dt_mode"], r["beta"]) for r in matching.chain_dt_mode(spark.createDataFrame(rows, "vehicle_id string, segment_seq int, dt_s double")).collect()}
    assert got == {("V", 1): (5.0, 10.0), ("V", 2): (0.0, 10.0), ("W", 1): (30.0, 8.0)}
