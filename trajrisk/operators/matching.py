"""Map matching: candidate edges, bounded shortest paths, a Viterbi path through the candidates of each sub-chain."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.geo import add_utm50n, add_wgs84, angdiff, bearing_deg, obs_log_score, transition_score, travel_dir
from ..functions.quantiles import exact_quantiles
from ..params import DEFAULTS, Params
from ..sources.tables import stored
from .roads import edge_parts, matchable_edges

CHAIN = ("vehicle_id", "segment_seq")
#: What the path of a sub-chain depends on besides candidates.
LAYER = (*CHAIN, "point_order", "dt_s", "obs_bearing")
#: Up to this many road parts are sent to every executor; more are joined by shuffle.
BROADCAST_PARTS = 500_000
#: Side of the tiles in which paths are searched.
TILE_M = 2400.0
#: Up to this many paths are sent to every executor: pairs of candidates, by far the most rows, then stay where their sub-chain is.
BROADCAST_PATHS = 2_000_000
#: Few paths as ``node_pairs`` has them.
Known = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Limits of the projection distance in metres by road level, at its 95th and 99th percentile.
OFFSET_LIMITS = {
    "expressway_ramp": (None, 30.0), "arterial": (25.0, 35.0), "arterial_link": (25.0, 35.0), "sub_arterial": (20.0, 30.0),
    "sub_arterial_link": (20.0, 30.0), "branch": (15.0, 20.0),
}


def with_metres(points: DataFrame) -> DataFrame:
    return add_utm50n(points, F.col("lon"), F.col("lat"), "x_m", "y_m")


def match_candidates(points: DataFrame, edges: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``points`` with ``cands``: the ``candidates`` nearest matchable edges within ``radius_m``, by (distance, edge);
    none if the nearest is beyond ``far_m``.

    Road parts are listed in every cell of side ``radius_m`` that their box, widened by the radius, touches; a point
    has all its parts in the list of its own cell, and they are ranked inside the row, without a shuffle of points.
    """
    r = p.radius_m
    listed = _listed_parts(edges, p)
    fields = [c for c in listed.columns if c not in ("cx", "cy")]
    cells = listed.groupBy("cx", "cy").agg(F.collect_list(F.struct(*fields)).alias("parts"))  # a cell has as many as fit in it
    if _few_parts(edges):
        cells = F.broadcast(cells)
    rows = _placed(points, p).join(cells, ["cx", "cy"], "left")
    x, y = F.col("x_m"), F.col("y_m")

    def foot(q: Column) -> Column:
        dx, dy = q["bx"] - q["ax"], q["by"] - q["ay"]
        size = F.sqrt(dx * dx + dy * dy)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - q["ax"]) * dx + (y - q["ay"]) * dy) / (size * size)))
        # What separates point and foot, from differences of near numbers: those of whole northings lose the last nanometre.
        off = F.struct((x - q["ax"] - t * dx).alias("x"), (y - q["ay"] - t * dy).alias("y"))
        return F.struct(q.alias("q"), t.alias("t"), (q["ax"] + t * dx).alias("px"), (q["ay"] + t * dy).alias("py"), size.alias("size"), off.alias("off"))

    def candidate(f: Column) -> Column:
        d, q = F.sqrt(f["off"]["x"] * f["off"]["x"] + f["off"]["y"] * f["off"]["y"]), f["q"]
        return F.struct(
            F.round(d, 6).alias("rank_d"), q["edge_id"].alias("edge_id"), q["part"].alias("part"), d.alias("d"), f["px"].alias("px"), f["py"].alias("py"),
            (q["along0"] + f["t"] * f["size"]).alias("along"), q["bearing"].alias("seg_bearing"), q["length_m"].alias("length_m"), q["u_key"].alias("u"),
            q["v_key"].alias("v"), q["k"].alias("k"), q["osm_id"].alias("osm_id"), q["road_level"].alias("road_level"), q["oneway"].alias("oneway"),
        )

    near = F.array_sort(F.filter(F.transform(F.transform("parts", foot), candidate), lambda c: c["d"] <= r))
    rows = rows.withColumn("near", near).drop("parts", "cx", "cy")
    once = F.filter("near", lambda c, i: F.array_position(F.transform("near", lambda o: o["edge_id"]), c["edge_id"]) == i + 1)  # nearest part of an edge
    best = F.when(F.element_at(once, 1)["d"] <= p.far_m, F.slice(once, 1, p.candidates))
    none = F.slice("near", 1, 0)
    return rows.withColumn("cands", F.when(F.size("near") > 0, F.coalesce(best, none)).otherwise(none)).drop("near")


def _few_parts(edges: DataFrame) -> bool:
    return edges.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS


def _listed_parts(edges: DataFrame, p: Params) -> DataFrame:
    """Parts of matchable edges in every cell ``cx, cy`` of side ``radius_m`` that their box, widened by the radius, touches."""
    r = p.radius_m
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - r) / r), F.floor((F.greatest(a, b) + r) / r))
    return edge_parts(matchable_edges(edges)).withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))


def _placed(points: DataFrame, p: Params) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col("x_m") / p.radius_m), "cy": F.floor(F.col("y_m") / p.radius_m)})


def nodes_near(points: DataFrame, edges: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``n1``: ends of all edges that are listed in a cell with points; the ends of their candidates are among them.

    Points are folded to their cells before anything is shuffled.
    """
    cells = _placed(points, p).select("cx", "cy").distinct()
    ends = _listed_parts(edges, p).select("cx", "cy", F.explode(F.array("u_key", "v_key")).alias("n1")).distinct()
    return ends.join(cells, ["cx", "cy"], "left_semi").select("n1").distinct()


def nearest_k_candidates(matched: DataFrame, id_col: str = "event_id") -> DataFrame:
    """One row a candidate, numbered ``rank`` from 1."""
    return matched.select(id_col, F.posexplode("cands").alias("at", "c")).select(
        id_col, (F.col("at") + 1).alias("rank"), "c.osm_id", "c.edge_id", F.col("c.d").alias("proj_dist_m")
    )


def chain_dt_mode(points: DataFrame) -> DataFrame:
    """Most frequent positive interval of each sub-chain, the smallest of equals, 0 without one; and ``beta`` for it."""
    mode = F.coalesce(F.mode(F.when(F.col("dt_s") > 0, F.col("dt_s")), True), F.lit(0.0))
    out = points.groupBy(*CHAIN).agg(mode.alias("dt_mode"))
    return out.withColumn("beta", F.when(F.col("dt_mode") < 10, 10.0).otherwise(8.0))


def obs_bearings(points: DataFrame) -> DataFrame:
    """``obs_bearing`` from the point before; null at the first point of a sub-chain and without a move. The point before
    is ``before``, if the points have it (it is dropped), else it is looked up."""
    if "before" in points.columns:
        rows = add_utm50n(points, F.col("before.lon"), F.col("before.lat"), "before_x", "before_y")
        rows = rows.withColumn("obs_bearing", bearing_deg(F.col("x_m") - F.col("before_x"), F.col("y_m") - F.col("before_y")))
        return rows.drop("before", "before_x", "before_y")
    chain = Window.partitionBy(*CHAIN).orderBy("point_order")
    return points.withColumn("obs_bearing", bearing_deg(F.col("x_m") - F.lag("x_m").over(chain), F.col("y_m") - F.lag("y_m").over(chain)))


def transition_pairs(points: DataFrame) -> DataFrame:
    """All pairs of candidates of consecutive layers (points with candidates): ``*CHAIN, point_order, a, b``, both
    candidates and their numbers ``i, j``. A layer looks back with a window, there is no self-join."""
    chain = Window.partitionBy(*CHAIN).orderBy("point_order")
    layers = points.where(F.size("cands") > 0).withColumn("before", F.lag("cands").over(chain)).where("before IS NOT NULL")
    pairs = layers.select(*CHAIN, "point_order", "obs_bearing", "cands", F.posexplode("before").alias("i", "a"))
    return pairs.select(*CHAIN, "point_order", "obs_bearing", "i", "a", F.posexplode("cands").alias("j", "b"))


def bounded_shortest_paths(edges: DataFrame, sources: DataFrame, p: Params = DEFAULTS, tile_m: float = TILE_M) -> DataFrame:
    """``n1, n2, path_m``: undirected distances of at most ``path_m`` from the nodes ``n1`` of ``sources``.

    The plane is cut into tiles of side ``tile_m``. A path of at most ``path_m`` never leaves the halo of that width
    around its source's tile, so each tile is searched by itself: its sources against the edges whose ends are both in
    the tile or its halo. A task holds one tile's roads, whatever the size of the network.
    """
    halo = p.path_m + 1  # nodes are rounded to centimetres, lengths to millimetres
    x, y = lambda c: F.shiftright(c, 32) / 100, lambda c: F.col(c).bitwiseAND(0xFFFFFFFF) / 100
    lines = edges.select(F.col("u_key").alias("a"), F.col("v_key").alias("b"), F.col("length_m").alias("w")).where(f"a <> b AND w <= {p.path_m}")
    lines = lines.groupBy("a", "b").agg(F.min("w").alias("w"))

    def tiles(at) -> Column:
        low, high = F.least(at("a"), at("b")), F.greatest(at("a"), at("b"))
        return F.explode(F.sequence(F.ceil((high - halo) / tile_m) - 1, F.floor((low + halo) / tile_m)))

    near = lines.withColumn("tx", tiles(x)).withColumn("ty", tiles(y))
    asked = sources.select("n1", F.floor(x("n1") / tile_m).alias("tx"), F.floor(y("n1") / tile_m).alias("ty"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _within(*(right[c].to_numpy() for c in ("a", "b", "w")), left["n1"].to_pylist(), p.path_m) if len(left) else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["n1", "n2", "path_m"])

    return asked.groupBy("tx", "ty").cogroup(near.groupBy("tx", "ty")).applyInArrow(search, "n1 long, n2 long, path_m double")


def _within(a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: list[int], limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each source the nodes within ``limit`` and their distances, over the undirected edges ``a, b`` of lengths ``w``."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    start, other = np.concatenate([ends[: len(a)], ends[len(a) :]]), np.concatenate([ends[len(a) :], ends[: len(a)]])
    order = np.argsort(start, kind="stable")
    first = np.searchsorted(start[order], np.arange(len(nodes) + 1)).tolist()
    other, length = other[order].tolist(), np.concatenate([w, w])[order].tolist()
    place = {n: i for i, n in enumerate(nodes.tolist())}
    n1, n2, far = [], [], []
    for source in sources:
        if source not in place:  # a node without edges
            n1.append(np.array([source]))
            n2.append(np.array([source]))
            far.append(np.zeros(1))
            continue
        done: dict[int, float] = {}
        heap = [(0.0, place[source])]
        while heap:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done[n] = d
            for e in range(first[n], first[n + 1]):
                if other[e] not in done and d + length[e] <= limit:
                    heapq.heappush(heap, (d + length[e], other[e]))
        n1.append(np.full(len(done), source))
        n2.append(nodes[list(done)])
        far.append(np.fromiter(done.values(), np.float64, len(done)))
    return np.concatenate(n1), np.concatenate(n2), np.concatenate(far)


def candidate_path_length(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """Length of the way between the two candidates of each pair, by the nodes at the ends of their edges; null without.

    On one edge it is the difference of the places along it. The four ways between the ends of two edges are looked up
    for the pairs of edges that occur, and these are joined with the pairs of candidates, one row each.
    (``candidate_ways`` has the same without a shuffle of pairs, where paths are few.)
    """
    a, b = F.col("a"), F.col("b")
    ends = lambda c, side: ((c["u"], c["along"]), (c["v"], c["length_m"] - c["along"]))[side]
    keys = [*CHAIN, "point_order", "obs_bearing", "i", "j"]
    facts = [
        *keys, F.hypot(a["px"] - b["px"], a["py"] - b["py"]).alias("straight_m"), b["seg_bearing"].alias("seg_bearing"),
        F.when(a["edge_id"] == b["edge_id"], F.abs(a["along"] - b["along"])).alias("same_m"),
    ]
    sides = [(s, t) for s in (0, 1) for t in (0, 1)]
    edges = [a["edge_id"].alias("ea"), b["edge_id"].alias("eb")]
    nodes = [x.alias(f"{c}{s}") for c, e in (("a", a), ("b", b)) for s in (0, 1) for x in (ends(e, s)[0],)]
    off = [(ends(a, s)[1] + ends(b, t)[1]).alias(f"off{s}{t}") for s, t in sides]
    ways = pairs.select(*edges, *nodes).distinct()
    for s, t in sides:
        ways = ways.join(paths.select(F.col("n1").alias(f"a{s}"), F.col("n2").alias(f"b{t}"), F.col("path_m").alias(f"way{s}{t}")), [f"a{s}", f"b{t}"], "left")
    rows = pairs.select(*facts, *edges, *off).join(ways, ["ea", "eb"])
    least = F.least(*(F.col(f"off{s}{t}") + F.col(f"way{s}{t}") for s, t in sides))  # nulls are left out
    return rows.select(*keys, "straight_m", "seg_bearing", F.coalesce("same_m", least).alias("path_m"))


def best_path(scores: list[np.ndarray], moves: list[np.ndarray]) -> list[int]:
    """Viterbi: of each layer the candidate on the best path; the first of equals (to a millionth)."""
    total, back = scores[0], []
    for score, move in zip(scores[1:], moves, strict=True):
        ways = total[:, None] + move
        k = np.argmax(np.round(ways, 6), axis=0)
        back.append(k)
        total = ways[k, np.arange(len(k))] + score
    at = int(np.argmax(np.round(total, 6)))
    out = [at]
    for k in reversed(back):
        at = int(k[at])
        out.append(at)
    return out[::-1]


def few_paths(paths: DataFrame) -> bool:
    return paths.count() <= BROADCAST_PATHS


def by_chain(points: DataFrame) -> DataFrame:
    """Points dealt out so that a sub-chain lies in one task."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *CHAIN)


def _along_chains(points: DataFrame, paths: DataFrame, of: Callable[[pa.Table, Known], pa.Table], schema: StructType | str) -> DataFrame:
    """``of`` whole sub-chains of ``points`` (``by_chain``), sorted, and of the few ``paths``, which are sent to every task.

    Nothing is shuffled: a task goes through its sub-chains, as many at once as a batch holds; only a sub-chain that a
    batch's end cuts is kept for the next batch.
    """
    known = paths.select("n1", "n2", "path_m").toArrow()  # at most BROADCAST_PATHS
    shared = points.sparkSession.sparkContext.broadcast(node_pairs(*(known.column(c).to_numpy() for c in ("n1", "n2", "path_m"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [open_[-1].slice(open_[-1].num_rows - 1)] if open_ else []
            begun = np.flatnonzero(_begins(pa.Table.from_batches([*last, batch])))
            cut = int(begun[-1]) - len(last)
            if cut < 0 or (not open_ and cut == 0):  # all of one sub-chain
                open_.append(batch)
                continue
            yield from of(pa.Table.from_batches([*open_, batch.slice(0, cut)]), shared.value).to_batches()
            open_ = [batch.slice(cut)]
        if open_:
            yield from of(pa.Table.from_batches(open_), shared.value).to_batches()

    return points.sortWithinPartitions(*CHAIN, "point_order").mapInArrow(run, schema)


def candidate_ways(points: DataFrame, paths: DataFrame) -> DataFrame:
    """``*CHAIN, point_order, i, j, straight_m, path_m`` of all ``transition_pairs`` of ``points`` (``by_chain``, with
    ``cands``), as ``candidate_path_length`` has them, for few paths."""
    kept = [*CHAIN, "point_order"]

    def of(table: pa.Table, known: Known) -> pa.Table:
        t = Transitions(table, known)
        rows = table.select(kept).take(pa.array(np.repeat(t.here, t.count)))
        for name, values in (("i", (t.at // t.wide).astype(np.int32)), ("j", (t.at % t.wide).astype(np.int32)), ("straight_m", t.straight)):
            rows = rows.append_column(name, pa.array(values))
        return rows.append_column("path_m", pa.array(t.path, mask=np.isnan(t.path)))

    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in kept)
    return _along_chains(points.select(*LAYER, "cands"), paths, of, f"{kinds}, i int, j int, straight_m double, path_m double")


def best_candidates(points: DataFrame, paths: DataFrame) -> DataFrame:
    """``points`` (``by_chain``, with ``cands``) with ``choice``, the number of the candidate on the best path of its
    sub-chain, and that candidate ``c`` in the place of ``cands``; null without candidates. For few paths."""
    kept = [c for c in points.columns if c != "cands"]
    fields = [points.schema[c] for c in kept] + [StructField("choice", IntegerType()), StructField("c", points.schema["cands"].dataType.elementType)]

    def of(table: pa.Table, known: Known) -> pa.Table:
        t = Transitions(table, known)
        choice = t.choices()
        out = table.select(kept).append_column("choice", pa.array(choice, pa.int32(), mask=choice < 0))
        return out.append_column("c", t.flat.take(pa.array(np.where(choice < 0, 0, t.start + choice), mask=choice < 0)))

    return _along_chains(points, paths, of, StructType(fields))


def node_pairs(n1: np.ndarray, n2: np.ndarray, path_m: np.ndarray) -> Known:
    """Nodes, and for pairs of them (place of ``n1`` x nodes + place of ``n2``, ascending) their distance."""
    nodes = np.unique(np.concatenate([n1, n2]))
    pair = np.searchsorted(nodes, n1) * len(nodes) + np.searchsorted(nodes, n2)
    order = np.argsort(pair)
    return nodes, pair[order], path_m[order]


def _look_up(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the ascending ``known``, and whether they are there."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def _begins(chains: pa.Table) -> np.ndarray:
    """Whether a row begins a sub-chain."""
    out = np.zeros(chains.num_rows, bool)
    out[:1] = True
    for c in CHAIN:
        names = chains.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= names[1:] != names[:-1]
    return out


def _betas(chain: np.ndarray, dt: np.ndarray) -> np.ndarray:
    """``beta`` of each sub-chain, as ``chain_dt_mode`` has it."""
    mode = np.zeros(chain[-1] + 1)
    moved = dt > 0
    order = np.lexsort((dt[moved], chain[moved]))
    c, t = chain[moved][order], dt[moved][order]
    first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])]) if len(c) else np.zeros(0, int)
    times = np.diff(np.r_[first, len(c)])
    best = np.lexsort((-t[first], times, c[first]))  # the last of a sub-chain is the most frequent, the smallest of equals
    mode[c[first][best]] = t[first][best]
    return np.where(mode < 10, 10.0, 8.0)


class Transitions:
    """Pairs of candidates of consecutive layers of whole, sorted sub-chains, flat: their numbers ``a, b`` among all
    candidates, which layer ``here`` of ``count`` pairs they lead to, and ``straight`` and ``path`` between them."""

    def __init__(self, points: pa.Table, known: Known):
        number = lambda c: points.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)
        self.chain, self.dt, self.obs = np.cumsum(_begins(points)) - 1, np.nan_to_num(number("dt_s")), number("obs_bearing")
        cands = points.column("cands").combine_chunks()
        self.size = size = np.nan_to_num(pc.list_value_length(cands).to_numpy(zero_copy_only=False)).astype(np.int64)
        self.start, self.flat = np.cumsum(size) - size, cands.flatten()
        col = dict(zip((f.name for f in self.flat.type), self.flat.flatten(), strict=True))
        self.d, px, py, along, self.seg, length = (col[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("d", "px", "py", "along", "seg_bearing", "length_m"))
        u, v, edge = (col[c].to_numpy(zero_copy_only=False) for c in ("u", "v", "edge_id"))
        self.rows = np.flatnonzero(size)
        joined = np.flatnonzero(self.chain[self.rows[1:]] == self.chain[self.rows[:-1]]) + 1
        self.here, before = self.rows[joined], self.rows[joined - 1]
        self.count = size[before] * size[self.here]
        self.first = np.cumsum(self.count) - self.count
        self.at = np.arange(self.count.sum()) - np.repeat(self.first, self.count)
        self.wide = np.repeat(size[self.here], self.count)
        self.a = np.repeat(self.start[before], self.count) + self.at // self.wide
        self.b = np.repeat(self.start[self.here], self.count) + self.at % self.wide
        self.path = _ways(self.a, self.b, u, v, edge, along, length, known)
        self.straight = np.hypot(px[self.a] - px[self.b], py[self.a] - py[self.b])

    def scores(self) -> np.ndarray:
        """``obs_log_score`` of each candidate."""
        beta = np.repeat(_betas(self.chain, self.dt)[self.chain], self.size)
        return np.maximum(-0.5 * (self.d / beta) ** 2, -27.631021115928547)

    def moves(self) -> np.ndarray:
        """``transition_score`` of each pair."""
        turn = 0.5 * (1 + np.cos(np.radians(np.abs(np.mod(np.repeat(self.obs[self.here], self.count) - self.seg[self.b] + 180, 360.0) - 180))))
        return 0.17 * np.exp(-np.fmax(self.path - self.straight, 0.0) / 10) + 0.83 * np.where(np.isnan(turn), 0.5, turn)

    def choices(self) -> np.ndarray:
        """The candidate of each row on the best path of its sub-chain, -1 without candidates."""
        out = np.full(len(self.size), -1, np.int64)
        score, move = self.scores(), self.moves()
        moves = {int(r): move[f : f + n] for r, f, n in zip(self.here, self.first, self.count, strict=True)}
        for layers in np.split(self.rows, np.flatnonzero(np.diff(self.chain[self.rows])) + 1):
            if len(layers):
                own = [score[self.start[r] : self.start[r] + self.size[r]] for r in layers]
                out[layers] = best_path(own, [moves[int(r)].reshape(len(x), len(y)) for r, x, y in zip(layers[1:], own, own[1:], strict=False)])
        return out


def _ways(a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, edge: np.ndarray, along: np.ndarray, length: np.ndarray, known: Known) -> np.ndarray:
    """``candidate_path_length`` of pairs of candidates, by their places; each pair of edges is looked up once."""
    if not len(a):
        return np.zeros(0)
    nodes, pairs, far = known
    names, place = np.unique(edge, return_inverse=True)
    _, one, back = np.unique(place[a] * len(names) + place[b], return_index=True, return_inverse=True)
    ends = [(_look_up(nodes, n), off) for n, off in ((u, along), (v, length - along))]
    best = np.full(len(a), np.nan)
    for (at_a, there_a), off_a in ends:
        for (at_b, there_b), off_b in ends:
            x, y = a[one], b[one]
            at, there = _look_up(pairs, at_a[x] * len(nodes) + at_b[y])
            way = np.where(there & there_a[x] & there_b[y], far[at] if len(far) else np.nan, np.nan)
            best = np.fmin(best, (off_a[a] + off_b[b]) + way[back])
    return np.where(edge[a] == edge[b], np.abs(along[a] - along[b]), best)


def viterbi_match(points: DataFrame, edges: DataFrame, id_col: str = "event_id", p: Params = DEFAULTS) -> DataFrame:
    """``id_col, choice``: the candidate (from 0) of each point with candidates on the best path of its sub-chain.

    Few paths are sent to every task, and sub-chains are shuffled once (``best_candidates``). With more, scores are
    columns; only the recursion over a sub-chain's layers runs in Python, one sub-chain at a time.
    """
    sources = points.select(F.explode("cands").alias("c")).select(F.explode(F.array("c.u", "c.v")).alias("n1")).distinct()
    paths = stored(bounded_shortest_paths(edges, sources, p), "paths")
    if few_paths(paths):
        rows = points.select(id_col, *(c for c in LAYER if c != id_col), "cands")
        return best_candidates(by_chain(rows), paths).where("choice IS NOT NULL").select(id_col, "choice")
    pairs = transition_pairs(points)
    ways = candidate_path_length(pairs, paths)
    move = transition_score(F.col("path_m"), F.col("straight_m"), F.col("obs_bearing"), F.col("seg_bearing"))
    moves = ways.groupBy(*CHAIN, "point_order").agg(F.array_sort(F.collect_list(F.struct("i", "j", move.alias("s")))).alias("moves"))
    moves = moves.withColumn("moves", F.transform("moves", lambda m: m["s"]))  # row by row of the layer before
    layers = points.where(F.size("cands") > 0).join(chain_dt_mode(points), list(CHAIN))
    layers = layers.select(id_col, *CHAIN, "point_order", F.transform("cands", lambda c: obs_log_score(c["d"], F.col("beta"))).alias("scores"))
    layers = layers.join(moves, [*CHAIN, "point_order"], "left")
    kind = points.schema[id_col].dataType.simpleString()

    def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
        whole = column.combine_chunks()
        flat, sizes = whole.flatten().to_numpy(zero_copy_only=False), np.nan_to_num(pc.list_value_length(whole).to_numpy(zero_copy_only=False)).astype(int)
        return np.split(flat, np.cumsum(sizes)[:-1])

    def run(chain: pa.Table) -> pa.Table:
        chain = chain.sort_by("point_order")
        scores = lists(chain.column("scores"))
        moves = [m.reshape(len(a), len(b)) for a, b, m in zip(scores, scores[1:], lists(chain.column("moves"))[1:], strict=False)]
        return pa.table({id_col: chain.column(id_col), "choice": pa.array(best_path(scores, moves), pa.int32())})

    return layers.groupBy(*CHAIN).applyInArrow(run, f"{id_col} {kind}, choice int")


def attach_projection(points: DataFrame, chosen: DataFrame, id_col: str = "event_id") -> DataFrame:
    """All points with their chosen edge, its projection and ``matched`` 0/1; without one these are null."""
    rows = points.join(chosen, id_col, "left").withColumn("c", F.when(F.col("choice").isNotNull(), F.element_at("cands", F.col("choice") + 1)))
    return _projected(rows, [c for c in points.columns if c != "cands"])


def match_points(points: DataFrame, edges: DataFrame, paths: DataFrame, id_col: str = "event_id", p: Params = DEFAULTS) -> DataFrame:
    """``points`` as ``attach_projection`` has them, with the ``paths`` between all ``nodes_near`` them.

    Few paths: points are shuffled once, as they are; their candidates never leave the task. Else candidates are stored.
    """
    if not few_paths(paths):
        rows = stored(match_candidates(_in_metres(points), edges, p), "candidates")
        return attach_projection(rows, viterbi_match(rows, edges, id_col, p), id_col)
    return _projected(best_candidates(chain_candidates(points, edges, p).select(*points.columns, "cands"), paths), points.columns)


def _in_metres(points: DataFrame) -> DataFrame:
    return points if {"x_m", "y_m"} <= {*points.columns} else with_metres(points)


def chain_candidates(points: DataFrame, edges: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``match_candidates`` of points dealt out ``by_chain``: before they have candidates, unless these take a shuffle."""
    return match_candidates(_in_metres(by_chain(points)), edges, p) if _few_parts(edges) else by_chain(match_candidates(_in_metres(points), edges, p))


def _projected(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` columns and what a chosen candidate ``c`` tells."""
    rows = rows.select(
        *kept, F.col("c").isNotNull().cast("int").alias("matched"), F.col("c.edge_id").alias("edge_id"),
        F.col("c.osm_id").alias("osm_id"), F.col("c.u").alias("matched_u"), F.col("c.v").alias("matched_v"), F.col("c.k").alias("matched_k"),
        F.col("c.road_level").alias("road_level"), F.col("c.oneway").alias("oneway"), F.col("c.d").alias("proj_dist_m"),
        F.col("c.seg_bearing").alias("seg_bearing"), F.col("c.px").alias("proj_x"), F.col("c.py").alias("proj_y"),
    )
    return with_degrees(rows)


#: What a match adds to a point.
MATCH = ("matched", "edge_id", "osm_id", "matched_u", "matched_v", "matched_k", "road_level", "oneway", "proj_dist_m", "seg_bearing", "proj_x", "proj_y")


def with_degrees(rows: DataFrame) -> DataFrame:
    """And what follows from these, so that it needn't be stored."""
    rows = rows.withColumn("travel_dir", travel_dir(F.col("obs_bearing"), F.col("seg_bearing")))
    rows = add_wgs84(rows, F.col("proj_x"), F.col("proj_y"), "proj_lon", "proj_lat")
    return rows.withColumns({"proj_lon": F.bround("proj_lon", 7), "proj_lat": F.bround("proj_lat", 7)})


def is_reverse_point(p: Params = DEFAULTS) -> Column:
    """Against the legal direction; on two-way roads heading to the right of the drawn direction; null without bearings."""
    obs, seg = F.col("obs_bearing"), F.col("seg_bearing")
    oneway = F.upper(F.coalesce("oneway", F.lit("B")))
    turn = F.round(F.sin(F.radians(obs - seg)), 9)
    legal = F.when(oneway == "F", seg).otherwise(F.pmod(seg + 180, F.lit(360.0)))
    rule = F.when(oneway == "B", turn > 0).otherwise(F.round(angdiff(obs, legal), 9) >= p.reverse_deg)
    return F.when(obs.isNotNull() & seg.isNotNull(), rule)


def reverse_ratio(matched: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Per sub-chain: judged and wrong points, their share, first and last time, the row in the middle, the first row's road."""
    chain = Window.partitionBy(*CHAIN)
    rows = matched.withColumns({"wrong": is_reverse_point(p), "n": F.count("*").over(chain)})
    judged = F.count_if(F.col("wrong").isNotNull() & (F.col("matched") == 1))
    bad = F.count_if(F.col("wrong") & (F.col("matched") == 1))
    middle = F.max(F.when(F.col("point_order") == F.floor(F.col("n") / 2), F.struct("lon", "lat")))
    out = rows.groupBy(*CHAIN, "segment_id").agg(
        judged.alias("n_judged"), bad.alias("n_reverse"), F.min("time").alias("start_time"), F.max("time").alias("end_time"), middle.alias("mid"),
        F.min_by(F.struct("oneway", "road_level"), "point_order").alias("road"),
    )
    return out.withColumn("ratio", F.try_divide(F.col("n_reverse"), F.col("n_judged")))


def reverse_events(matched: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One event for each sub-chain with more than ``reverse_ratio`` of its judged points in the wrong direction."""
    out = reverse_ratio(matched, p).where(F.col("n_reverse") > p.reverse_ratio * F.col("n_judged"))
    seconds = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time")) / 1e6
    detail = F.to_json(F.struct(F.bround("ratio", 4).alias("ratio"), "n_reverse", "n_judged", "road.oneway", "road.road_level"))
    return out.select(
        F.lit("reverse").alias("event_type"), *CHAIN, "segment_id", "start_time", "end_time", F.bround(seconds, 1).alias("duration_s"),
        F.bround("ratio", 4).alias("value_main"), F.col("mid.lon").alias("lon"), F.col("mid.lat").alias("lat"), detail.alias("detail"),
    )


def match_summary(matched: DataFrame, modes: DataFrame) -> DataFrame:
    """Points, matched points, their share; and how many sub-chains are fast or slow (``chain_dt_mode``)."""
    one = matched.agg(F.count("*").alias("n_points"), F.sum("matched").alias("n_matched"), F.bround(F.avg("matched"), 4).alias("match_rate"))
    return one.crossJoin(modes.agg(F.count_if(F.col("dt_mode") < 10).alias("n_fast"), F.count_if(F.col("dt_mode") >= 10).alias("n_slow")))  # one row each


def match_offset_quantiles(matched: DataFrame) -> DataFrame:
    """Per road level the number of matched points, quantiles of their distance, and whether these keep the limits."""
    rows = matched.where("matched = 1").withColumn("d", F.bround("proj_dist_m", 2))
    q = exact_quantiles(rows, "d", (0.5, 0.95, 0.99), ("road_level",)).select(
        "road_level", "n", *(F.bround(F.get("q", F.lit(i)), 1).alias(c) for i, c in enumerate(("p50", "p95", "p99")))
    )
    limit = lambda i: F.create_map(*(F.lit(x) for k, v in OFFSET_LIMITS.items() for x in (k, v[i] if v[i] is not None else float("inf"))))[F.col("road_level")]
    return q.withColumn("passes", (F.col("p95") <= limit(0)) & (F.col("p99") <= limit(1)))
