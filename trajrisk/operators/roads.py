"""Road lines to an undirected multigraph in metres: edges with directed attributes, and their straight parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import add_utm50n, bearing_deg, reverse_bearing
from ..params import DEFAULTS, Params

#: Road level by class, and the levels that points can be matched to.
LEVELS = {
    "motorway": "expressway", "motorway_link": "expressway_ramp", "trunk": "expressway", "trunk_link": "expressway_ramp",
    "primary": "arterial", "primary_link": "arterial_link", "secondary": "sub_arterial", "secondary_link": "sub_arterial_link",
    "tertiary": "branch", "tertiary_link": "branch", "unclassified": "branch", "residential": "branch", "living_street": "branch",
    "road": "branch", "busway": "branch", "service": "service_road", "track": "track", "track_grade1": "track", "track_grade2": "track",
    "track_grade3": "track", "track_grade4": "track", "track_grade5": "track", "path": "non_motor", "footway": "non_motor",
    "pedestrian": "non_motor", "steps": "non_motor", "cycleway": "non_motor", "bridleway": "non_motor",
}
MATCHABLE = ("expressway", "expressway_ramp", "arterial", "arterial_link", "sub_arterial", "sub_arterial_link", "branch", "service_road", "track")
#: Lines as a road file has them.
ROAD_SCHEMA = "osm_id long, fclass string, oneway string, name string, maxspeed double, lines array<array<struct<lon:double,lat:double>>>"


def road_level(fclass: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[fclass], F.lit("unknown"))


def node_id(x: Column, y: Column) -> Column:
    """Ends within the same centimetre are one node."""
    return F.format_string("%.2f,%.2f", x, y)


def node_key(x: Column, y: Column) -> Column:
    """The same as one number: centimetres of x in the upper half, of y in the lower."""
    return F.shiftleft(F.round(x * 100).cast("long"), 32) + F.round(y * 100).cast("long")


def explode_lines(roads: DataFrame) -> DataFrame:
    """One row a line, numbered ``line`` within its road; lines of less than two points are left out."""
    rows = roads.select("*", F.posexplode("lines").alias("line", "points")).drop("lines")
    return rows.where(F.size("points") >= 2)


def clip_edges_bbox(roads: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Whole roads of which a part touches the box of degrees; nothing is cut."""
    x0, y0, x1, y1 = map(F.lit, p.bbox)

    def touches(a: Column, b: Column) -> Column:
        # Where along the part the strips of the box begin and end.
        def span(o: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
            s, e = (lo - o) / d, (hi - o) / d
            still = d == 0
            return (
                F.when(still, F.lit(0.0)).otherwise(F.least(s, e)), F.when(still, F.lit(1.0)).otherwise(F.greatest(s, e)),
                ~still | ((o >= lo) & (o <= hi)),
            )

        sx, ex, okx = span(a["lon"], b["lon"] - a["lon"], x0, x1)
        sy, ey, oky = span(a["lat"], b["lat"] - a["lat"], y0, y1)
        return okx & oky & (F.greatest(F.lit(0.0), sx, sy) <= F.least(F.lit(1.0), ex, ey))

    def line_touches(line: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: touches(F.element_at(line, i), F.element_at(line, i + 1)))
        return F.when(F.size(line) >= 2, F.exists(pairs, lambda t: t)).otherwise(F.lit(False))

    return roads.where(F.exists("lines", line_touches))


def road_edges(roads: DataFrame) -> DataFrame:
    """``edge_id, osm_id, line, fclass, road_level, matchable, oneway, name, maxspeed, u, v, k, u_key, v_key, length_m,
    forward_bearing, reverse_bearing, geometry`` (array of x, y in metres). A missing ``oneway`` is B."""
    lines = explode_lines(roads)
    keep = [c for c in lines.columns if c != "points"]
    points = lines.select(*keep, F.posexplode("points").alias("place", "point"))
    points = add_utm50n(points, F.col("point.lon"), F.col("point.lat"), "x", "y")
    edges = points.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("place", "x", "y"))).alias("g"))
    edges = edges.withColumn("geometry", F.transform("g", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))).drop("g")
    step = lambda i: F.hypot(
        F.element_at("geometry", i + 1)["x"] - F.element_at("geometry", i)["x"], F.element_at("geometry", i + 1)["y"] - F.element_at("geometry", i)["y"]
    )
    length = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("geometry") - 1), step), F.lit(0.0), lambda a, b: a + b)
    edges = edges.withColumns({"a": F.element_at("geometry", 1), "b": F.element_at("geometry", -1), "exact": length})
    ends = [F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")]
    forward = bearing_deg(ends[2] - ends[0], ends[3] - ends[1])
    edges = edges.withColumns({
        "edge_id": F.col("osm_id") * 1000 + F.col("line"), "road_level": road_level(F.col("fclass")), "oneway": F.upper(F.coalesce("oneway", F.lit("B"))),
        "u": node_id(*ends[:2]), "v": node_id(*ends[2:]), "u_key": node_key(*ends[:2]), "v_key": node_key(*ends[2:]),
        "length_m": F.bround("exact", 3), "forward_bearing": forward, "reverse_bearing": reverse_bearing(forward),
    })
    # Lines without length, and single parts of less than half a metre back to the same node, are no edges.
    degenerate = (F.col("u") == F.col("v")) & (F.size("geometry") == 2) & (F.col("exact") < 0.5)
    edges = edges.where((F.col("exact") > 0) & ~degenerate).withColumn("matchable", F.col("road_level").isin(*MATCHABLE)).drop("a", "b", "exact")
    return parallel_edge_key(edges)


def parallel_edge_key(edges: DataFrame) -> DataFrame:
    """``k``: 0, 1, 2 and so on among the edges between the same two nodes."""
    pair = Window.partitionBy(F.least("u", "v"), F.greatest("u", "v")).orderBy("edge_id")
    return edges.withColumn("k", F.row_number().over(pair) - 1)


def matchable_edges(edges: DataFrame) -> DataFrame:
    return edges.where("matchable")


def edge_parts(edges: DataFrame) -> DataFrame:
    """Straight parts of the edges: ``part, ax, ay, bx, by``, the length ``along0`` before each, and its bearing."""
    g = F.col("geometry")
    rows = edges.select("edge_id", "osm_id", "u_key", "v_key", "k", "road_level", "oneway", "length_m", "geometry", F.posexplode(F.expr("slice(geometry, 1, size(geometry) - 1)")).alias("part", "a"))
    rows = rows.withColumn("b", F.element_at(g, F.col("part") + 2))
    before = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.col("part")), lambda i: F.when(i > 0, F.hypot(F.element_at(g, i + 1)["x"] - F.element_at(g, F.greatest(i, F.lit(1)))["x"], F.element_at(g, i + 1)["y"] - F.element_at(g, F.greatest(i, F.lit(1)))["y"])).otherwise(0.0)),
        F.lit(0.0), lambda x, y: x + y,
    )
    rows = rows.select(
        "edge_id", "osm_id", "u_key", "v_key", "k", "road_level", "oneway", "length_m", "part", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"),
        F.col("b.x").alias("bx"), F.col("b.y").alias("by"), before.alias("along0"),
    )
    rows = rows.withColumn("bearing", bearing_deg(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    return rows.where("bearing IS NOT NULL")


def network_summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, kilometres, edges by level and by direction."""
    nodes = edges.select(F.col("u").alias("n")).union(edges.select("v")).agg(F.count_distinct("n").alias("n_nodes"))
    levels = sorted({*LEVELS.values(), "unknown"})
    return edges.agg(
        F.count("*").alias("n_edges"), F.bround(F.sum("length_m") / 1000, 2).alias("total_km"), F.count_if("matchable").alias("n_matchable"),
        *(F.count_if(F.col("road_level") == x).alias(f"level_{x}") for x in levels),
        *(F.count_if(F.col("oneway") == x).alias(f"oneway_{x.lower()}") for x in ("B", "F", "T")),
    ).crossJoin(nodes)  # one row each
