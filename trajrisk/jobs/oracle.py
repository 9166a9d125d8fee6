"""The results of the queries as SQL over the same tables, written from what the operators mean and not from their code.

The projection is that of the classic series in powers of the longitude difference, the fixture is laid over ``events``
anew, and tables of fixed values are spelled out.
"""

from __future__ import annotations

import re


def _utm(source: str, lon: str, lat: str, x: str = "x_m", y: str = "y_m") -> str:
    """Rows of ``source`` with metres of UTM zone 50."""
    psi = "(nu / rho)"
    return f"""SELECT * EXCLUDE (s, c, t2, w, nu, rho, m), 500000 + 0.9996 * nu * w * c * (1 + pow(w * c, 2) / 6 * ({psi} - t2)
          + pow(w * c, 4) / 120 * (4 * pow({psi}, 3) * (1 - 6 * t2) + pow({psi}, 2) * (1 + 8 * t2) - {psi} * 2 * t2 + t2 * t2)
          + pow(w * c, 6) / 5040 * (61 - 479 * t2 + 179 * t2 * t2 - pow(t2, 3))) AS {x},
        0.9996 * (m + nu * s * w * w * c / 2 * (1 + pow(w * c, 2) / 12 * (4 * pow({psi}, 2) + {psi} - t2)
          + pow(w * c, 4) / 360 * (8 * pow({psi}, 4) * (11 - 24 * t2) - 28 * pow({psi}, 3) * (1 - 6 * t2) + pow({psi}, 2) * (1 - 32 * t2) - {psi} * 2 * t2 + t2 * t2)
          + pow(w * c, 6) / 20160 * (1385 - 3111 * t2 + 543 * t2 * t2 - pow(t2, 3)))) AS {y}
      FROM (SELECT *, 6378137.0 / sqrt(1 - 0.006694379990141317 * s * s) AS nu, 6378137.0 * (1 - 0.006694379990141317) / pow(1 - 0.006694379990141317 * s * s, 1.5) AS rho FROM (
        SELECT *, sin(radians({lat})) AS s, cos(radians({lat})) AS c, pow(tan(radians({lat})), 2) AS t2, radians({lon} - 117) AS w, {_arc(f"radians({lat})")} AS m FROM ({source})))"""


_N = 0.0016792203863837047


def _arc(phi: str) -> str:
    """Length of the meridian from the equator."""
    n = _N
    terms = (
        (1 + n**2 / 4 + n**4 / 64, phi), (-1.5 * (n - n**3 / 8), f"sin(2 * {phi})"), (15 / 16 * (n**2 - n**4 / 4), f"sin(4 * {phi})"),
        (-35 / 48 * n**3, f"sin(6 * {phi})"), (315 / 512 * n**4, f"sin(8 * {phi})"),
    )
    return f"{6378137.0 / (1 + n)!r} * (" + " + ".join(f"({k!r}) * {f}" for k, f in terms) + ")"


def _degrees(source: str, x: str, y: str, lon: str, lat: str) -> str:
    """Rows of ``source`` with degrees of UTM metres."""
    n = _N
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    foot = f"sg + {3 * n / 2 - 27 * n**3 / 32!r} * sin(2 * sg) + {21 * n**2 / 16 - 55 * n**4 / 32!r} * sin(4 * sg) + {151 * n**3 / 96!r} * sin(6 * sg) + {1097 * n**4 / 512!r} * sin(8 * sg)"
    return f"""SELECT * EXCLUDE (sg, ph, nu, rho, t, q, u), degrees(ph - t / (0.9996 * rho) * ({x} - 500000) * q / 2 * (1 - q * q / 12 * (-4 * u * u + 9 * u * (1 - t * t) + 12 * t * t)
          + pow(q, 4) / 360 * (8 * pow(u, 4) * (11 - 24 * t * t) - 12 * pow(u, 3) * (21 - 71 * t * t) + 15 * u * u * (15 - 98 * t * t + 15 * pow(t, 4)) + 180 * u * (5 * t * t - 3 * pow(t, 4)) + 360 * pow(t, 4)))) AS {lat},
        117 + degrees((q - pow(q, 3) / 6 * (u + 2 * t * t) + pow(q, 5) / 120 * (-4 * pow(u, 3) * (1 - 6 * t * t) + u * u * (9 - 68 * t * t) + 72 * u * t * t + 24 * pow(t, 4))) / cos(ph)) AS {lon}
      FROM (SELECT *, tan(ph) AS t, ({x} - 500000) / (0.9996 * nu) AS q, nu / rho AS u FROM (
        SELECT *, 6378137.0 / sqrt(1 - 0.006694379990141317 * pow(sin(ph), 2)) AS nu, 6378137.0 * (1 - 0.006694379990141317) / pow(1 - 0.006694379990141317 * pow(sin(ph), 2), 1.5) AS rho FROM (
          SELECT *, {foot} AS ph FROM (SELECT *, {y} / 0.9996 / {radius!r} AS sg FROM ({source})))))"""


def _bearing(dx: str, dy: str) -> str:
    return f"CASE WHEN {dx} <> 0 OR {dy} <> 0 THEN (degrees(atan2({dx}, {dy})) + 360) % 360 END"


_HAVERSINE = (
    "2 * 6371000.0 * asin(sqrt(least(1.0, greatest(0.0, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))))"
)
_MOD = lambda a, b: f"((({a}) % {b} + {b}) % {b})"
_LEVEL = "CASE WHEN {z} >= 2.58 THEN 'high' WHEN {z} >= 1.96 THEN 'medium' WHEN {z} >= 1.28 THEN 'low' ELSE 'insignificant' END"
_LABEL = "CASE quadrant WHEN 'HH' THEN '高-高' WHEN 'LL' THEN '低-低' WHEN 'HL' THEN '高-低' ELSE '低-高' END"


def _gi(cells: str, knn: str, part: str = "", spread: str = "s") -> str:
    """``grid_id, gi_z`` (and ``layer``) of cells: mean with neighbours against the mean."""
    p = f"{part}, " if part else ""
    on = f" AND v.{part} = p.{part}" if part else ""
    one = f"JOIN (SELECT {p}avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM {cells}{' GROUP BY ' + part if part else ''}) o ON {f'o.{part} = p.{part}' if part else 'true'}"
    pp = f"p.{part}, " if part else ""
    return f"""SELECT {pp}i AS grid_id, round(avg(value), 12) AS own, any_value(CASE WHEN s > 0 THEN 1 END) AS fine, (avg(value) - any_value(m)) / any_value({spread}) AS gi_z
      FROM (SELECT {p}i, j FROM {knn} UNION ALL SELECT {p}grid_id, grid_id FROM {cells}) p JOIN {cells} v ON v.grid_id = p.j{on} {one} GROUP BY {pp}i"""


def _knn(cells: str, part: str = "") -> str:
    d = "(a.col - b.col) * (a.col - b.col) + (a.row - b.row) * (a.row - b.row)"
    p, on = (f"a.{part}, ", f" AND a.{part} = b.{part}") if part else ("", "")
    q = f"{part}, " if part else ""
    return f"""SELECT {q}i, j, d2 FROM (SELECT {p}a.grid_id AS i, b.grid_id AS j, {d} AS d2, row_number() OVER (PARTITION BY {p}a.grid_id ORDER BY {d}, b.grid_id) AS rk
      FROM {cells} a, {cells} b WHERE a.grid_id <> b.grid_id{on}) WHERE rk <= 5"""


def _moran(cells: str, pairs: str, weight: str) -> str:
    """``n, i, e, var`` with weights of the pairs."""
    return f"""SELECT n, n / s0 * a / b AS i, -1.0 / (n - 1) AS e, (1.0 * n * n * s1 - n * s2 + 3 * s0 * s0) / ((1.0 * n * n - 1) * s0 * s0) - 1.0 / ((n - 1.0) * (n - 1)) AS var FROM (
      SELECT (SELECT count(*) FROM {cells}) AS n, (SELECT sum(pow(value - m, 2)) FROM {cells}, (SELECT avg(value) AS m FROM {cells})) AS b,
        (SELECT sum({weight} * (x.value - m) * (y.value - m)) FROM {pairs} JOIN {cells} x ON x.grid_id = i JOIN {cells} y ON y.grid_id = j, (SELECT avg(value) AS m FROM {cells})) AS a,
        (SELECT sum({weight}) FROM {pairs}) AS s0, (SELECT sum(pow(w, 2)) / 2 FROM (SELECT x, y, sum(w) AS w FROM (SELECT i AS x, j AS y, {weight} AS w FROM {pairs} UNION ALL SELECT j, i, {weight} FROM {pairs}) GROUP BY 1, 2)) AS s1,
        (SELECT sum(pow(w, 2)) FROM (SELECT x, sum(w) AS w FROM (SELECT i AS x, {weight} AS w FROM {pairs} UNION ALL SELECT j, {weight} FROM {pairs}) GROUP BY 1)) AS s2)"""


def _erfc(x: str) -> str:
    """Two-sided p value of a normal z by Simpson's rule over its density."""
    return f"(1 - (SELECT sum(CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * pow(abs({x}) * k / 400.0, 2))) FROM range(401) r(k)) * abs({x}) / 1200.0 * 0.7978845608028654)"


#: Common table expressions in the order in which they build on each other.
PARTS = {
    "walk": """SELECT *, rn // 12 AS leg, (user_id + rn // 12) % 4 AS h, 2 + user_id % 6 AS dt, CASE WHEN event_id % 89 = 0 THEN 150 ELSE 4 + CAST(floor(value * 100) AS BIGINT) % 50 END AS step,
        (event_id * 7919) % 21 - 10 AS jit FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)""",
    "raw": """SELECT *, 116470000 + user_id * 37 % 10 * 2925 + CAST(sum(CASE h WHEN 0 THEN step WHEN 2 THEN -step ELSE 0 END) OVER u AS BIGINT) * 12 + CASE WHEN h % 2 = 1 THEN jit * 12 ELSE 0 END AS lon_u,
        39720000 + user_id * 53 % 10 * 2250 + CAST(sum(CASE h WHEN 1 THEN step WHEN 3 THEN -step ELSE 0 END) OVER u AS BIGINT) * 9 + CASE WHEN h % 2 = 0 THEN jit * 9 ELSE 0 END + CASE WHEN event_id % 53 = 11 THEN 40000 ELSE 0 END AS lat_u
        FROM walk WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "typed": """SELECT event_id, user_id, CASE WHEN event_id % 41 <> 3 THEN TIMESTAMP '2024-06-05 07:00:00' + to_seconds(leg * 600 + rn % 12 * dt) END AS time,
        CASE WHEN event_id % 43 <> 5 THEN (lon_u + CASE WHEN event_id % 47 = 7 THEN 1000000 ELSE 0 END) / 1e6 END AS lon, lat_u / 1e6 AS lat, 'V' || user_id AS vehicle_id,
        rn % 30 = 17 AS flag, CAST(step AS DOUBLE) / dt AS raw_speed FROM raw""",
    "tagged": """SELECT *, CASE WHEN time IS NULL THEN 'invalid_time' WHEN lon NOT BETWEEN 116.255 AND 116.792 OR lat NOT BETWEEN 39.505 AND 40.028 THEN 'coord_out_of_range'
        WHEN lon IS NULL OR lat IS NULL THEN 'invalid_coord' END AS isolate_reason FROM typed""",
    "seq": """SELECT *, sum(head) OVER (PARTITION BY vehicle_id ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS sq FROM (
        SELECT *, CASE WHEN flag OR lag(time) OVER v IS NULL OR date_diff('second', lag(time) OVER v, time) > 180 THEN 1 ELSE 0 END AS head
        FROM tagged WHERE isolate_reason IS NULL WINDOW v AS (PARTITION BY vehicle_id ORDER BY time, event_id))""",
    "moves": """SELECT * REPLACE (CAST(sq AS BIGINT) AS sq), vehicle_id || '-' || CAST(CAST(sq AS BIGINT) AS VARCHAR) AS segment_id, CAST(row_number() OVER c - 1 AS INTEGER) AS point_order,
        CAST(date_diff('second', lag(time) OVER c, time) AS DOUBLE) AS dt_s, lag(lon) OVER c AS lon0, lag(lat) OVER c AS lat0
        FROM seq WINDOW c AS (PARTITION BY vehicle_id, sq ORDER BY time, event_id)""",
    "kin": f"SELECT *, {_HAVERSINE} AS dist_m, CASE WHEN dt_s > 0 THEN {_HAVERSINE} / dt_s END AS mps FROM moves",
    "over": """SELECT 'overspeed' AS event_type, vehicle_id, segment_id, min(time) AS start_time, max(time) AS end_time, CAST(date_diff('second', min(time), max(time)) AS DOUBLE) AS duration_s,
        round_even(max(mps * 3.6), 2) AS value_main, arg_max(lon, mps * 3.6 - point_order * 1e-9) AS lon, arg_max(lat, mps * 3.6 - point_order * 1e-9) AS lat, count(*) AS n_points, NULL AS oneway
        FROM (SELECT *, sum(CASE WHEN mps * 3.6 > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id, sq ORDER BY point_order ROWS UNBOUNDED PRECEDING) AS run FROM kin)
        WHERE mps * 3.6 > 20 GROUP BY vehicle_id, segment_id, run HAVING date_diff('second', min(time), max(time)) >= 10 AND count(*) >= 2""",
    "pairs": """SELECT *, (mps - v0) / dt_s AS a FROM (SELECT *, lag(mps) OVER c AS v0, lag(time) OVER c AS t0 FROM kin WINDOW c AS (PARTITION BY vehicle_id, sq ORDER BY point_order))
        WHERE dt_s > 0 AND dt_s <= 6 AND v0 IS NOT NULL AND mps IS NOT NULL""",
    "limits": """SELECT count(*) AS n_motion, round_even(quantile_cont(a, 0.85), 3) AS p85, round_even(quantile_cont(a, 0.15), 3) AS p15 FROM pairs WHERE v0 >= 0.5 AND mps >= 0.5""",
    "rapid": """SELECT event_type, vehicle_id, segment_id, t0 AS start_time, time AS end_time, dt_s AS duration_s, round_even(a, 3) AS value_main, lon, lat, v0 FROM (
        SELECT *, CASE WHEN a > p85 AND v0 >= 0.5 THEN 'rapid_accel' WHEN a < p15 THEN 'rapid_decel' END AS event_type FROM pairs, limits) WHERE event_type IS NOT NULL""",
    "roadlines": f"""SELECT (i + 10000) * 200000 + (j + 10000) * 2 + vertical AS osm_id, i, j, vertical,
        ['primary', 'secondary', 'tertiary', 'residential', 'footway', 'service', 'trunk_link'][{_MOD('i + 2 * j', 7)} + 1] AS fclass,
        CASE {_MOD('3 * i + j', 5)} WHEN 0 THEN 'F' WHEN 1 THEN 'T' ELSE 'B' END AS oneway, {_MOD('i + 3 * j + vertical', 11)} = 0 AS bent
        FROM (SELECT DISTINCT v.i + di AS i, v.j + dj AS j FROM (SELECT CAST(floor((lon_u - 116458300) / 975.0) AS BIGINT) AS i, CAST(floor((lat_u - 39714000) / 750.0) AS BIGINT) AS j FROM raw GROUP BY 1, 2 HAVING count(*) >= 2) v,
          (VALUES (-1), (0), (1)) a(di), (VALUES (-1), (0), (1)) b(dj)), (VALUES (0), (1)) c(vertical)""",
    "vertices": _utm(
        """SELECT osm_id, 0 AS place, (116458300 + 975 * i) / 1e6 AS vlon, (39714000 + 750 * j) / 1e6 AS vlat FROM roadlines
        UNION ALL SELECT osm_id, 1, (116458300 + 975 * i + CASE vertical WHEN 0 THEN 487 ELSE 20 END) / 1e6, (39714000 + 750 * j + CASE vertical WHEN 0 THEN 20 ELSE 375 END) / 1e6 FROM roadlines WHERE bent
        UNION ALL SELECT osm_id, 2, (116458300 + 975 * (i + 1 - vertical)) / 1e6, (39714000 + 750 * (j + vertical)) / 1e6 FROM roadlines""", "vlon", "vlat", "x", "y",
    ),
    "parts": f"""SELECT *, {_bearing("bx - ax", "by_ - ay")} AS dir, coalesce(sum(len) OVER (PARTITION BY osm_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS along0 FROM (
        SELECT *, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM (SELECT osm_id, CAST(row_number() OVER w - 1 AS INTEGER) AS part, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM vertices
          WINDOW w AS (PARTITION BY osm_id ORDER BY place)) WHERE bx IS NOT NULL)""",
    "edges": f"""SELECT *, row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY osm_id) - 1 AS k FROM (
        SELECT r.osm_id, r.fclass, r.oneway, round_even(e.len, 3) AS len, n_points, CAST(round(ux, 2) AS VARCHAR) || ',' || CAST(round(uy, 2) AS VARCHAR) AS u, CAST(round(vx, 2) AS VARCHAR) || ',' || CAST(round(vy, 2) AS VARCHAR) AS v,
          {_bearing("vx - ux", "vy - uy")} AS fwd, CASE r.fclass WHEN 'primary' THEN 'arterial' WHEN 'secondary' THEN 'sub_arterial' WHEN 'tertiary' THEN 'branch' WHEN 'residential' THEN 'branch'
            WHEN 'footway' THEN 'non_motor' WHEN 'service' THEN 'service_road' WHEN 'trunk_link' THEN 'expressway_ramp' END AS road_level
        FROM roadlines r JOIN (SELECT osm_id, sum(len) AS len, count(*) + 1 AS n_points, arg_min(ax, part) AS ux, arg_min(ay, part) AS uy, arg_max(bx, part) AS vx, arg_max(by_, part) AS vy FROM parts GROUP BY 1) e USING (osm_id))""",
    "metric": _utm("SELECT * FROM kin", "lon", "lat"),
    "seen": f"""SELECT *, {_bearing("x_m - bx_m", "y_m - by_m")} AS obs FROM (SELECT *, lag(x_m) OVER c AS bx_m, lag(y_m) OVER c AS by_m FROM metric WINDOW c AS (PARTITION BY vehicle_id, sq ORDER BY point_order))""",
    "foot": """SELECT event_id, vehicle_id, sq, point_order, osm_id, part, ax + t * (bx - ax) AS px, ay + t * (by_ - ay) AS py, along0 + t * len AS along, dir, sqrt(pow(x_m - ax - t * (bx - ax), 2) + pow(y_m - ay - t * (by_ - ay), 2)) AS d FROM (
        SELECT p.*, e.*, greatest(0.0, least(1.0, ((x_m - ax) * (bx - ax) + (y_m - ay) * (by_ - ay)) / (len * len))) AS t
        FROM (SELECT *, CAST(floor(x_m / 200) AS BIGINT) AS cx, CAST(floor(y_m / 200) AS BIGINT) AS cy FROM metric) p
        JOIN (SELECT *, unnest(range(CAST(floor((least(ax, bx) - 101) / 200) AS BIGINT), CAST(floor((greatest(ax, bx) + 101) / 200) AS BIGINT) + 1)) AS cx FROM (
          SELECT q.*, unnest(range(CAST(floor((least(ay, by_) - 101) / 200) AS BIGINT), CAST(floor((greatest(ay, by_) + 101) / 200) AS BIGINT) + 1)) AS cy
          FROM parts q JOIN edges g USING (osm_id) WHERE g.fclass <> 'footway')) e USING (cx, cy))""",
    "cand": """SELECT c.*, e.u, e.v, e.k, e.len, e.road_level, e.oneway FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(d, 6), osm_id) AS rank, min(d) OVER (PARTITION BY event_id) AS best FROM (
        SELECT * FROM foot WHERE d <= 100 QUALIFY row_number() OVER (PARTITION BY event_id, osm_id ORDER BY round(d, 6), part) = 1)) c JOIN edges e USING (osm_id) WHERE rank <= 5 AND best <= 45""",
    "modes": """SELECT vehicle_id, sq, coalesce(arg_max(dt_s, (n, -dt_s)) FILTER (dt_s > 0), 0) AS dt_mode FROM (SELECT vehicle_id, sq, dt_s, count(*) AS n FROM kin GROUP BY ALL) GROUP BY 1, 2""",
    "layer": """SELECT c.*, s.obs, dense_rank() OVER (PARTITION BY c.vehicle_id, c.sq ORDER BY c.point_order) AS lay, greatest(-0.5 * pow(d / CASE WHEN dt_mode < 10 THEN 10.0 ELSE 8.0 END, 2), ln(1e-12)) AS lg
        FROM cand c JOIN seen s USING (event_id) JOIN modes m ON m.vehicle_id = c.vehicle_id AND m.sq = c.sq""",
    "pair": """SELECT b.vehicle_id, b.sq, b.lay, b.point_order, b.obs, b.dir, b.lg, a.rank AS i, b.rank AS j, sqrt(pow(a.px - b.px, 2) + pow(a.py - b.py, 2)) AS straight, a.osm_id AS e1, b.osm_id AS e2,
        a.u AS u1, a.v AS v1, b.u AS u2, b.v AS v2, a.along AS al1, b.along AS al2, a.len AS len1, b.len AS len2 FROM layer a JOIN layer b ON a.vehicle_id = b.vehicle_id AND a.sq = b.sq AND b.lay = a.lay + 1""",
    "steps": """SELECT a, b, min(w) AS w FROM (SELECT u AS a, v AS b, len AS w FROM edges UNION ALL SELECT v, u, len FROM edges) WHERE a <> b GROUP BY 1, 2""",
    "grown": """SELECT n1, n1 AS n2, 0.0::DOUBLE AS d, 0 AS k FROM (SELECT DISTINCT unnest([u1, v1]) AS n1 FROM pair)
        UNION ALL SELECT n1, b, min(d + w), min(k) + 1 FROM grown JOIN steps ON a = n2 WHERE d + w <= 600 GROUP BY n1, b""",
    "sp": "SELECT n1, n2, min(d) AS d FROM grown GROUP BY 1, 2",
    "ways": """SELECT p.*, CASE WHEN e1 = e2 THEN abs(al1 - al2) ELSE m END AS path FROM pair p LEFT JOIN (SELECT vehicle_id, sq, lay, i, j, min(off1 + off2 + d) AS m FROM (
          SELECT vehicle_id, sq, lay, i, j, unnest([u1, u1, v1, v1]) AS n1, unnest([u2, v2, u2, v2]) AS n2, unnest([al1, al1, len1 - al1, len1 - al1]) AS off1, unnest([al2, len2 - al2, al2, len2 - al2]) AS off2 FROM pair)
        JOIN sp USING (n1, n2) GROUP BY ALL) w USING (vehicle_id, sq, lay, i, j)""",
    "trans": """SELECT *, 0.17 * coalesce(exp(-greatest(path - straight, 0) / 10), 0) + 0.83 * coalesce(0.5 * (1 + cos(radians(obs - dir))), 0.5) AS move FROM ways""",
    "best": """SELECT vehicle_id, sq, lay, rank, lg AS total, [rank] AS path FROM layer WHERE lay = 1
        UNION ALL SELECT t.vehicle_id, t.sq, t.lay, t.j, arg_max(total + move, (round(total + move, 6), -i)) + any_value(lg), list_append(arg_max(path, (round(total + move, 6), -i)), t.j)
        FROM best b JOIN (SELECT vehicle_id, sq, lay, i, j, move, lg FROM trans) t ON t.vehicle_id = b.vehicle_id AND t.sq = b.sq AND t.lay = b.lay + 1 AND t.i = b.rank GROUP BY t.vehicle_id, t.sq, t.lay, t.j""",
    "chosen": """SELECT l.* FROM (SELECT vehicle_id, sq, unnest(path) AS rank, generate_subscripts(path, 1) AS lay FROM (
        SELECT vehicle_id, sq, arg_max(path, (round(total, 6), -rank)) AS path FROM best JOIN (SELECT vehicle_id, sq, max(lay) AS lay FROM layer GROUP BY 1, 2) USING (vehicle_id, sq, lay) GROUP BY 1, 2)) c JOIN layer l USING (vehicle_id, sq, lay, rank)""",
    "matched": """SELECT s.*, c.osm_id, c.road_level, c.oneway, c.dir, c.d AS off_m, c.px, c.py FROM seen s LEFT JOIN chosen c USING (event_id)""",
    "judged": """SELECT *, count(*) OVER (PARTITION BY vehicle_id, sq) AS n, CASE WHEN osm_id IS NOT NULL AND obs IS NOT NULL THEN
        CASE WHEN oneway = 'B' THEN round(sin(radians(obs - dir)), 9) > 0 ELSE round(cos(radians(obs - dir - CASE WHEN oneway = 'T' THEN 180 ELSE 0 END)), 12) <= round(cos(radians(135)), 12) END END AS wrong FROM matched""",
    "ratios": """SELECT vehicle_id, segment_id, min(time) AS start_time, max(time) AS end_time, count(wrong) AS judged, count(*) FILTER (wrong) AS bad, max(lon) FILTER (point_order = n // 2) AS lon,
        max(lat) FILTER (point_order = n // 2) AS lat, any_value(oneway) FILTER (point_order = 0) AS oneway FROM judged GROUP BY vehicle_id, segment_id""",
    "reverse": """SELECT 'reverse' AS event_type, vehicle_id, segment_id, start_time, end_time, CAST(date_diff('second', start_time, end_time) AS DOUBLE) AS duration_s, round_even(bad / judged, 4) AS value_main, lon, lat, judged, oneway
        FROM ratios WHERE judged > 0 AND bad > 0.5 * judged""",
    "all_events": """SELECT *, NULL AS judged, NULL AS v0 FROM over UNION ALL BY NAME SELECT *, NULL AS oneway, NULL AS n_points FROM rapid UNION ALL BY NAME SELECT *, NULL AS v0, NULL AS n_points FROM reverse""",
    "origin": "SELECT floor(min(px) / 250) * 250 AS x0, floor(min(py) / 250) * 250 AS y0 FROM matched",
    "links": """SELECT * FROM (SELECT *, sqrt(pow(x - px, 2) + pow(y - py, 2)) AS d, date_diff('second', pt, time) AS gap FROM (
        SELECT vehicle_id, sq, px - x0 AS x, py - y0 AS y, time, lag(px) OVER c - x0 AS px, lag(py) OVER c - y0 AS py, lag(time) OVER c AS pt FROM matched, origin WHERE osm_id IS NOT NULL
        WINDOW c AS (PARTITION BY vehicle_id, sq ORDER BY point_order))) WHERE gap > 0 AND gap <= 1800 AND d > 0 AND d <= 200""",
    "cut": """SELECT col, row, vehicle_id, sq, d * (least(1.0, x1, y1) - greatest(0.0, xa, ya)) AS part FROM (
        SELECT *, CASE WHEN abs(x - px) < 1e-9 THEN 0.0 ELSE least((col * 250 - px) / (x - px), (col * 250 + 250 - px) / (x - px)) END AS xa,
          CASE WHEN abs(x - px) < 1e-9 THEN 1.0 ELSE greatest((col * 250 - px) / (x - px), (col * 250 + 250 - px) / (x - px)) END AS x1,
          CASE WHEN abs(y - py) < 1e-9 THEN 0.0 ELSE least((row * 250 - py) / (y - py), (row * 250 + 250 - py) / (y - py)) END AS ya,
          CASE WHEN abs(y - py) < 1e-9 THEN 1.0 ELSE greatest((row * 250 - py) / (y - py), (row * 250 + 250 - py) / (y - py)) END AS y1
        FROM (SELECT *, unnest(range(CAST(floor(least(py, y) / 250) AS BIGINT), CAST(floor(greatest(py, y) / 250) AS BIGINT) + 1)) AS row FROM (
          SELECT *, unnest(range(CAST(floor(least(px, x) / 250) AS BIGINT), CAST(floor(greatest(px, x) / 250) AS BIGINT) + 1)) AS col FROM links))) WHERE least(1.0, x1, y1) >= greatest(0.0, xa, ya)""",
    "placed": "SELECT *, CAST(floor((ex - x0) / 250) AS BIGINT) AS col, CAST(floor((ey - y0) / 250) AS BIGINT) AS row FROM (" + _utm("SELECT * FROM all_events", "lon", "lat", "ex", "ey") + "), origin",
    "cells": """SELECT *, coalesce(m, 0) / 1000 AS km FROM (SELECT col, row, sum(part) AS m, count(DISTINCT vehicle_id || ':' || CAST(sq AS VARCHAR)) AS segs FROM cut GROUP BY col, row) x
        FULL JOIN (SELECT col, row, count(*) FILTER (event_type = 'overspeed') AS o, count(*) FILTER (event_type = 'reverse') AS r, count(*) FILTER (event_type LIKE 'rapid%') AS q,
          count(*) FILTER (event_type = 'rapid_accel') AS acc, count(*) FILTER (event_type = 'rapid_decel') AS dece FROM placed GROUP BY 1, 2) y USING (col, row)
        LEFT JOIN (SELECT col, row, count(DISTINCT vehicle_id) AS vehs FROM (SELECT col, row, vehicle_id FROM cut UNION ALL SELECT col, row, vehicle_id FROM placed) GROUP BY 1, 2) z USING (col, row)""",
    "boxed": _degrees(_degrees(_degrees(
        """SELECT col, row, x0 + col * 250.0 AS ax, y0 + row * 250.0 AS ay, x0 + col * 250.0 + 125 AS mx, y0 + row * 250.0 + 125 AS my, x0 + col * 250.0 + 250 AS bx, y0 + row * 250.0 + 250 AS by_ FROM cells, origin""",
        "ax", "ay", "lon_a", "lat_a"), "mx", "my", "lon_m", "lat_m"), "bx", "by_", "lon_b", "lat_b"),
    "rated": """SELECT *, CASE WHEN flag = 'valid' THEN round_even(o / km * 100, 2) END AS ro, CASE WHEN flag = 'valid' THEN round_even(r / km * 100, 2) END AS rr, CASE WHEN flag = 'valid' THEN round_even(q / km * 100, 2) END AS rq FROM (
        SELECT printf('G%04d_%04d', col, row) AS grid_id, col, row, km, coalesce(o, 0) AS o, coalesce(r, 0) AS r, coalesce(q, 0) AS q, coalesce(acc, 0) AS acc, coalesce(dece, 0) AS dece, coalesce(segs, 0) AS segs, coalesce(vehs, 0) AS vehs,
        CASE WHEN km >= 1 AND segs >= 5 THEN 'valid' WHEN km > 0 OR coalesce(o, 0) + coalesce(r, 0) + coalesce(q, 0) > 0 THEN 'low_exposure' ELSE 'insufficient_data' END AS flag FROM cells)""",
    "valid": "SELECT grid_id, col, row, ro AS value, ro, rr, CASE WHEN n_motion >= 30 THEN rq ELSE 0 END AS rq, (col + 0.5) * 250 AS x, (row + 0.5) * 250 AS y FROM rated, limits WHERE flag = 'valid'",
    "weights": """SELECT CASE WHEN t > 0 THEN d1 / t ELSE 1.0 / 3 END AS w1, CASE WHEN t > 0 THEN d2 / t ELSE 1.0 / 3 END AS w2, CASE WHEN t > 0 THEN d3 / t ELSE 1.0 / 3 END AS w3 FROM (SELECT *, d1 + d2 + d3 AS t FROM (SELECT """
    + ", ".join(
        f"CASE WHEN max(s{i}) > 0 AND min(r{i}) < max(r{i}) THEN 1 + sum(CASE WHEN r{i} > 0 THEN r{i} / s{i} * ln(r{i} / s{i}) ELSE 0 END) / ln(count(*)) ELSE 0.0 END AS d{i}" for i in (1, 2, 3)
    )
    + " FROM (SELECT ro AS r1, rr AS r2, rq AS r3, sum(ro) OVER () AS s1, sum(rr) OVER () AS s2, sum(rq) OVER () AS s3 FROM valid)))",
    "close": """SELECT *, CASE WHEN b + w > 0 THEN w / (b + w) ELSE 0 END AS closeness FROM (
        SELECT *, sqrt(pow(w1 * (h1 - ro) / q1, 2) + pow(CASE WHEN q2 > 0 THEN w2 * (h2 - rr) / q2 ELSE 0 END, 2) + pow(w3 * (h3 - rq) / q3, 2)) AS b,
          sqrt(pow(w1 * (ro - l1) / q1, 2) + pow(CASE WHEN q2 > 0 THEN w2 * (rr - l2) / q2 ELSE 0 END, 2) + pow(w3 * (rq - l3) / q3, 2)) AS w FROM (
          SELECT *, count(*) OVER () AS n, max(ro) OVER () AS h1, max(rr) OVER () AS h2, max(rq) OVER () AS h3, min(ro) OVER () AS l1, min(rr) OVER () AS l2, min(rq) OVER () AS l3,
            sqrt(sum(ro * ro) OVER ()) AS q1, sqrt(sum(rr * rr) OVER ()) AS q2, sqrt(sum(rq * rq) OVER ()) AS q3 FROM valid), weights)""",
    "scored": """SELECT r.*, CASE WHEN n >= 2 THEN CASE WHEN h1 > 0 THEN round_even(c.ro / h1 * 100, 1) ELSE 0 END END AS io, CASE WHEN n >= 2 THEN CASE WHEN h2 > 0 THEN round_even(c.rr / h2 * 100, 1) ELSE 0 END END AS ir,
        CASE WHEN n >= 2 THEN CASE WHEN h3 > 0 THEN round_even(c.rq / h3 * 100, 1) ELSE 0 END END AS iq, CASE WHEN n >= 2 AND n_motion >= 30 THEN round_even(closeness * 100, 1) END AS cri,
        n_motion >= 30 AND (SELECT count(*) FROM valid) >= 2 AS available, n_motion >= 30 AS rapid_ok FROM rated r LEFT JOIN close c USING (grid_id), limits""",
    "knn": _knn("valid"),
    "near": "SELECT a.grid_id AS i, b.grid_id AS j FROM valid a, valid b WHERE a.grid_id <> b.grid_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 360000",
    "lcells": """SELECT grid_id, col, row, 'comprehensive' AS layer, cri AS value FROM scored WHERE flag = 'valid' AND available AND cri IS NOT NULL UNION ALL SELECT grid_id, col, row, 'overspeed', ro FROM scored WHERE flag = 'valid'
        UNION ALL SELECT grid_id, col, row, 'reverse', rr FROM scored WHERE flag = 'valid' UNION ALL SELECT grid_id, col, row, 'rapid', rq FROM scored WHERE flag = 'valid' AND rapid_ok""",
    "lopen": "SELECT * FROM lcells WHERE layer IN (SELECT layer FROM lcells GROUP BY 1 HAVING count(*) >= 5 AND max(value) > 0)",
    "lknn": _knn("lopen", "layer"),
    "lgi": "SELECT layer, grid_id, gi_z, " + _LEVEL.format(z="round(gi_z, 9)") + " AS risk_level FROM (" + _gi("lopen", "lknn", "layer") + ") WHERE fine = 1 AND round(gi_z, 9) >= 1.28",
    "spots": f"""SELECT s.*, value FROM (SELECT *, 'hotspot_gi' AS selection_type FROM lgi UNION ALL SELECT layer, grid_id, z, {_LEVEL.format(z="round(z, 9)")}, 'top_risk_fallback' FROM (
        SELECT layer, grid_id, (value - avg(value) OVER l) / CASE WHEN stddev_samp(value) OVER l > 0 THEN stddev_samp(value) OVER l ELSE 1 END AS z FROM (
          SELECT * FROM lopen WHERE layer NOT IN (SELECT layer FROM lgi) QUALIFY row_number() OVER (PARTITION BY layer ORDER BY value DESC, grid_id) <= 8) WINDOW l AS (PARTITION BY layer))) s JOIN lcells USING (layer, grid_id)""",
    "facts": """SELECT layer, coalesce(n_valid, 0) AS n_valid, coalesce(n, 0) AS n_significant, coalesce(st, CASE WHEN coalesce(n_valid, 0) < 5 THEN 'insufficient_data' ELSE 'no_risk' END) AS selection_type
        FROM (VALUES ('comprehensive'), ('overspeed'), ('reverse'), ('rapid')) l(layer) LEFT JOIN (SELECT layer, count(*) AS n_valid FROM lcells GROUP BY 1) USING (layer)
        LEFT JOIN (SELECT layer, count(*) AS n, any_value(selection_type) AS st FROM spots GROUP BY 1) USING (layer)""",
    "lisa_cells": """SELECT *, CASE WHEN round(x, 9) > 0 THEN 'H' ELSE 'L' END || CASE WHEN round(lag, 9) > 0 THEN 'H' ELSE 'L' END AS quadrant, x * lag / m2 AS i, row_number() OVER (ORDER BY grid_id) - 1 AS n, count(*) OVER () AS cells FROM (
        SELECT a.grid_id, any_value(a.value - m) AS x, avg(b.value - m) AS lag, any_value(m2) AS m2, count(*) AS k FROM knn JOIN valid a ON a.grid_id = i JOIN valid b ON b.grid_id = j, (SELECT avg(value) AS m, var_pop(value) AS m2 FROM valid) GROUP BY 1)""",
    "lisa_draws": """SELECT perm, number, row_number() OVER (PARTITION BY perm ORDER BY first) AS place FROM (SELECT perm, number, min(j) AS first FROM (SELECT perm, j, CAST('0x' || substr(md5('1-' || perm || '-' || j), 1, 15) AS BIGINT) % (SELECT count(*) - 1 FROM lisa_cells) AS number
        FROM range(999) a(perm), range(64) b(j)) GROUP BY 1, 2)""",
    "v1": """SELECT event_id AS order_id, ts AS event_time, lon_u / 1e6 AS lon, lat_u / 1e6 AS lat, CAST(step AS DOUBLE) / dt * 3.6 AS speed_kmh, CASE WHEN CAST(step AS DOUBLE) / dt * 3.6 >= 20 THEN 1 ELSE 0 END AS is_overspeed, event_type, user_id,
        CAST(floor(lon_u / 1e6 / 0.0045) AS BIGINT) AS gx, CAST(floor(lat_u / 1e6 / 0.0045) AS BIGINT) AS gy FROM raw""",
    "v1g": "SELECT *, 'G' || gx || '_' || gy AS grid_id FROM v1",
    "v1c": """SELECT grid_id, gx AS col, gy AS row, CAST(sum(is_overspeed) AS BIGINT) AS o, CAST(sum(is_overspeed) AS DOUBLE) AS value, count(*) AS n, avg(speed_kmh) AS speed, min(event_time) AS a, max(event_time) AS b,
        strftime(min(event_time), '%Y-%m-%d %H:%M') || ' ~ ' || strftime(max(event_time), '%H:%M') AS slice, gx * 0.0045 + 0.00225 AS clon,
        degrees(atan(sinh((asinh(tan(radians(gy * 0.0045))) + asinh(tan(radians(gy * 0.0045 + 0.0045)))) / 2))) AS clat FROM v1g GROUP BY grid_id, gx, gy""",
    "young": "SELECT grid_id, avg(CASE WHEN user_id % 7 <> 0 AND user_id % 20 + 15 BETWEEN 18 AND 30 THEN 1.0 ELSE 0.0 END) AS share FROM v1g GROUP BY 1",
    "v1knn": _knn("v1c"),
    "v1gi": "SELECT grid_id, gi_z, " + _LEVEL.format(z="round(gi_z, 9)") + " AS risk_level FROM (" + _gi("v1c", "v1knn") + ") WHERE fine = 1 AND round(gi_z, 9) >= 1.28",
    "v1top": """SELECT grid_id, CASE WHEN o >= median(o) OVER () THEN 2.1 ELSE 1.7 END AS gi_z, CASE WHEN o >= median(o) OVER () THEN 'medium' ELSE 'low' END AS risk_level, o FROM (SELECT * FROM v1c ORDER BY o DESC, grid_id LIMIT 8)""",
    "v1hot": """SELECT *, printf('HS-%04d', row_number() OVER (ORDER BY gi_z DESC, grid_id)) AS area_id FROM (SELECT * FROM v1gi UNION ALL SELECT grid_id, gi_z, risk_level FROM v1top WHERE NOT EXISTS (SELECT 1 FROM v1gi)) JOIN v1c USING (grid_id)""",
    "v1fb": "SELECT *, printf('HS-%04d', row_number() OVER (ORDER BY gi_z DESC, grid_id)) AS area_id FROM (SELECT grid_id, gi_z, risk_level FROM v1top) JOIN v1c USING (grid_id)",
    "hours": """SELECT h AS bucket_ts, CAST(coalesce(v, 0) AS BIGINT) AS value FROM (SELECT unnest(generate_series(min(date_trunc('hour', event_time)), max(date_trunc('hour', event_time)), INTERVAL 1 HOUR)) AS h FROM v1)
        LEFT JOIN (SELECT date_trunc('hour', event_time) AS h, sum(is_overspeed) AS v FROM v1 GROUP BY 1) USING (h)""",
    "kinds": "SELECT event_type AS key, date_trunc('hour', event_time) AS bucket_ts, sum(is_overspeed) AS value FROM v1 GROUP BY 1, 2",
    "mk": f"""SELECT *, {_erfc("z")} AS p FROM (SELECT *, CASE WHEN s = 0 OR var_s <= 0 THEN 0.0 ELSE (s - sign(s)) / sqrt(var_s) END AS z FROM (SELECT key, n, s, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS var_s FROM (SELECT key, count(*) AS n FROM series GROUP BY 1)
        JOIN (SELECT a.key, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s FROM series a JOIN series b ON a.key = b.key AND a.bucket_ts < b.bucket_ts GROUP BY 1) USING (key)
        JOIN (SELECT key, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT key, count(*) AS t FROM series GROUP BY key, value) GROUP BY 1) USING (key)))""",
    "feedback": """SELECT order_id AS feedback_id, grid_id, CAST(event_time AS DATE) AS handled_at, event_time AS created_at, event_type, CASE event_type WHEN 'error' THEN '不成立' WHEN 'signup' THEN '部分成立' ELSE '成立' END AS conclusion,
        CAST(round(lon * 1e6) AS BIGINT) AS lon_u, CAST(round(lat * 1e6) AS BIGINT) AS lat_u FROM v1g""",
    "logs": "SELECT event_type AS operation_type, CAST(user_id AS VARCHAR) AS usr, event_time AS timestamp FROM v1 WHERE event_type IN ('purchase', 'view') AND event_time >= TIMESTAMP '2024-01-05' AND event_time <= TIMESTAMP '2024-01-20'",
    "firsts": "SELECT CAST(created_at AS DATE) AS day, arg_min(feedback_id, (created_at, feedback_id)) AS feedback_id FROM feedback GROUP BY 1",
    "boxes": """SELECT c.grid_id, v.order_id, CAST(v.event_time AS DATE) AS day FROM v1 v JOIN v1c c ON v.lon BETWEEN clon - 0.0016 AND clon + 0.0016 AND v.lat BETWEEN clat - 0.0012 AND clat + 0.0012 WHERE is_overspeed = 1""",
    "wrongways": """SELECT grid_id, avg(CASE WHEN oneway IN ('F', 'T') THEN 1.0 ELSE 0.0 END) AS ratio FROM rated JOIN boxed USING (col, row) JOIN reverse e ON e.lon BETWEEN round_even(lon_m, 6) - 0.0016 AND round_even(lon_m, 6) + 0.0016
        AND e.lat BETWEEN round_even(lat_m, 6) - 0.0012 AND round_even(lat_m, 6) + 0.0012 GROUP BY 1""",
    "cuts": """SELECT round_even(quantile_cont(coalesce(io, 0), 0.75), 4) AS o75, round_even(quantile_cont(coalesce(io, 0), 0.9), 4) AS o90, round_even(quantile_cont(coalesce(ir, 0), 0.75), 4) AS r75, round_even(quantile_cont(coalesce(ir, 0), 0.9), 4) AS r90,
        round_even(quantile_cont(coalesce(iq, 0), 0.75), 4) AS q75, round_even(quantile_cont(coalesce(iq, 0), 0.9), 4) AS q90, round_even(quantile_cont(coalesce(cri, 0), 0.75), 4) AS c75 FROM scored""",
    "hits": """SELECT s.*, list_filter([
          CASE WHEN top = 'q' THEN CASE WHEN acc > 0 AND dece > 0 THEN CASE WHEN greatest(acc, dece) < 1.5 * least(acc, dece) THEN 'KB-A03' WHEN acc > dece THEN 'KB-A01' ELSE 'KB-A02' END WHEN acc > 0 THEN 'KB-A01' WHEN dece > 0 THEN 'KB-A02' END END,
          CASE WHEN flag <> 'valid' THEN 'KB-D01' END, CASE WHEN fb THEN 'KB-D02' END, CASE WHEN vehs >= 3 AND o + r + q >= 5 THEN 'KB-E01' END,
          CASE WHEN (i1 > 0 AND i1 >= o90) OR (i2 > 0 AND i2 >= r90) OR (i3 > 0 AND i3 >= q90) OR hi THEN 'KB-E02' END, 'KB-F01', CASE WHEN gz >= 1.28 AND i1 + i2 + i3 > 0 AND cri >= c75 THEN 'KB-G01' END,
          CASE WHEN (CASE WHEN i1 > 0 AND i1 >= o75 THEN 1 ELSE 0 END) + (CASE WHEN i2 > 0 AND i2 >= r75 THEN 1 ELSE 0 END) + (CASE WHEN i3 > 0 AND i3 >= q75 THEN 1 ELSE 0 END) >= 2 THEN 'KB-G02' END,
          CASE WHEN flag = 'insufficient_data' THEN 'KB-Q01' END, CASE WHEN top = 'r' THEN CASE WHEN ratio >= 0.5 THEN 'KB-R01' ELSE 'KB-R02' END END, CASE WHEN top = 'o' THEN 'KB-S01' END, CASE WHEN o >= 10 THEN 'KB-S02' END
        ], lambda x: x IS NOT NULL) AS ids FROM (SELECT *, CASE WHEN greatest(i1, i2, i3) > 0 THEN CASE WHEN i1 >= greatest(i2, i3) THEN 'o' WHEN i2 >= i3 THEN 'r' ELSE 'q' END END AS top FROM (
          SELECT g.*, coalesce(io, 0) AS i1, coalesce(ir, 0) AS i2, coalesce(iq, 0) AS i3, ratio, coalesce(fb, false) AS fb, coalesce(hi, false) AS hi, gz, c.* FROM scored g LEFT JOIN wrongways USING (grid_id)
          LEFT JOIN (SELECT grid_id, bool_or(selection_type = 'top_risk_fallback') AS fb, bool_or(risk_level = 'high') AS hi, round_even(max(gi_z) FILTER (layer = 'comprehensive'), 3) AS gz FROM spots GROUP BY 1) USING (grid_id), cuts c)) s""",
    "kb": """SELECT * FROM (VALUES ('KB-G01', 1, 'BASIS-BJ22', 'f'), ('KB-G02', 2, 'BASIS-BJ40', 'f'), ('KB-S01', 3, 'BASIS-NPC58', 'f'), ('KB-S02', 4, 'BASIS-BJ26', 'f'), ('KB-R01', 5, 'BASIS-BJ22', 'f'), ('KB-R02', 6, 'BASIS-NPC57', 'r'),
        ('KB-A01', 7, 'BASIS-BJ22', 'f'), ('KB-A02', 8, 'BASIS-BJ22', 'r'), ('KB-A03', 9, 'BASIS-BJ25', 'r'), ('KB-E01', 10, 'BASIS-BJ41', 'e'), ('KB-E02', 11, 'BASIS-SAMR2021', 'd'), ('KB-D01', 12, 'BASIS-METHOD', ''),
        ('KB-D02', 13, 'BASIS-METHOD', ''), ('KB-Q01', 14, 'BASIS-PATENT', ''), ('KB-F01', 15, 'BASIS-METHOD', '')) k(rule_id, priority, basis_id, section)""",
    "ruled": "SELECT grid_id, rule_id, priority, basis_id, section FROM (SELECT grid_id, unnest(ids) AS rule_id FROM hits) JOIN kb USING (rule_id)",
    "bases": "SELECT grid_id, basis_id, row_number() OVER (PARTITION BY grid_id ORDER BY min(priority)) - 1 AS place FROM ruled GROUP BY 1, 2",
    "best_layer": "SELECT r.grid_id, coalesce(l, 'none') AS layer FROM rated r LEFT JOIN (SELECT grid_id, arg_min(layer, (-round_even(gi_z, 3), layer)) AS l FROM spots GROUP BY 1) USING (grid_id)",
}
_EVENT = "event_type, segment_id, start_time, end_time, duration_s, value_main, lon, lat"
_QUALITY = "count(*) FILTER (flag = 'valid') AS n_valid, count(*) FILTER (flag = 'low_exposure') AS n_low_exposure, count(*) FILTER (flag = 'insufficient_data') AS n_insufficient_data"
_CLIP = """SELECT osm_id, fclass FROM (SELECT r.osm_id, r.fclass, vlon AS x1, vlat AS y1, lead(vlon) OVER w AS x2, lead(vlat) OVER w AS y2 FROM vertices JOIN roadlines r USING (osm_id) WINDOW w AS (PARTITION BY osm_id ORDER BY place))
    WHERE x2 IS NOT NULL AND greatest(x1, x2) >= 116.455 AND least(x1, x2) <= 116.592 AND greatest(y1, y2) >= 39.705 AND least(y1, y2) <= 39.828"""
#: The last SELECT of each query.
FINAL = {
    "isolated_rows": "SELECT isolate_reason, count(*) AS n FROM tagged WHERE isolate_reason IS NOT NULL GROUP BY 1",
    "isolated_ratio": "SELECT count(*) AS rows_total, count(isolate_reason) AS rows_isolated, round_even(count(isolate_reason) / count(*), 4) AS ratio FROM tagged",
    "batch_meta": """SELECT t.*, k.* FROM (SELECT count(*) AS rows_total, count(isolate_reason) AS rows_isolated, round_even(count(isolate_reason) / count(*), 4) AS ratio FROM tagged) t,
        (SELECT count(DISTINCT vehicle_id) AS n_vehicles, count(DISTINCT segment_id) AS n_segments, min(time) AS time_min, max(time) AS time_max, min(lon) AS lon_min, max(lon) AS lon_max,
        min(lat) AS lat_min, max(lat) AS lat_max FROM kin) k""",
    "point_kinematics": """SELECT event_id, segment_id, point_order, dt_s, round_even(dist_m, 4) AS dist_m, round_even(mps, 4) AS calc_speed_mps, round_even(mps * 3.6, 4) AS speed_kmh,
        CASE WHEN mps > 30 THEN 'drift' ELSE 'ok' END AS quality_flag FROM kin""",
    "speed_unit_check": "SELECT count(*) AS n, round_even(quantile_cont(abs(raw_speed - mps) / mps, 0.5), 6) AS median_rel FROM kin WHERE mps > 0.3 AND raw_speed IS NOT NULL",
    "obs_bearings": "SELECT event_id, round_even(obs, 2) AS obs_bearing FROM seen",
    "overspeed_events": f"SELECT {_EVENT} FROM over",
    "accel_thresholds": "SELECT * FROM limits",
    "rapid_events": f"SELECT {_EVENT} FROM rapid",
    "clip_edges_bbox": f"SELECT fclass, count(DISTINCT osm_id) AS n FROM ({_CLIP}) GROUP BY 1",
    "road_edges": """SELECT osm_id * 1000 AS edge_id, fclass, road_level, fclass <> 'footway' AS matchable, oneway, CAST(k AS INTEGER) AS k, CAST(n_points AS INTEGER) AS n_points, round_even(len, 1) AS length_m, round_even(fwd, 1) AS forward_bearing, round_even((fwd + 180) % 360, 1) AS reverse_bearing FROM edges""",
    "edge_parts": "SELECT osm_id * 1000 AS edge_id, part, round_even(along0, 1) AS along0, round_even(dir, 1) AS bearing FROM parts",
    "network_summary": "SELECT count(*) AS n_edges, round_even(sum(len) / 1000, 2) AS total_km, count(*) FILTER (fclass <> 'footway') AS n_matchable, "
    + ", ".join(f"count(*) FILTER (road_level = '{x}') AS level_{x}" for x in ("arterial", "arterial_link", "branch", "expressway", "expressway_ramp", "non_motor", "service_road", "sub_arterial", "sub_arterial_link", "track", "unknown"))
    + ", " + ", ".join(f"count(*) FILTER (oneway = '{x}') AS oneway_{x.lower()}" for x in "BFT") + ", (SELECT count(DISTINCT n) FROM (SELECT unnest([u, v]) AS n FROM edges)) AS n_nodes FROM edges",
    "match_candidates": "SELECT event_id, osm_id * 1000 AS edge_id, round_even(d, 2) AS proj_dist_m, CAST(rank AS INTEGER) AS rank FROM cand",
    "chain_dt_mode": "SELECT vehicle_id, sq AS segment_seq, dt_mode, CASE WHEN dt_mode < 10 THEN 10.0::DOUBLE ELSE 8.0::DOUBLE END AS beta FROM modes",
    "transition_pairs": "SELECT vehicle_id, sq AS segment_seq, count(*) AS n_pairs FROM pair GROUP BY 1, 2",
    "bounded_shortest_paths": "SELECT count(*) AS n_paths, count(DISTINCT n1) AS n_sources, round_even(max(d), 1) AS longest_m, round_even(avg(d), 2) AS mean_m FROM sp",
    "candidate_path_length": "SELECT vehicle_id, count(*) AS n_pairs, count(path) AS n_paths, round_even(avg(path), 2) AS mean_path_m, round_even(avg(straight), 2) AS mean_straight_m FROM ways GROUP BY 1",
    "viterbi_match": "SELECT event_id, osm_id * 1000 AS edge_id, round_even(off_m, 2) AS proj_dist_m, CASE WHEN obs IS NOT NULL THEN CASE WHEN cos(radians(obs - dir)) >= 0 THEN 'forward' ELSE 'backward' END END AS travel_dir, round_even(plon, 7) AS proj_lon, round_even(plat, 7) AS proj_lat FROM ("
    + _degrees("SELECT * FROM matched WHERE osm_id IS NOT NULL", "px", "py", "plon", "plat") + ")",
    "match_summary": """SELECT count(*) AS n_points, count(osm_id) AS n_matched, round_even(count(osm_id) / count(*), 4) AS match_rate, (SELECT count(*) FROM modes WHERE dt_mode < 10) AS n_fast, (SELECT count(*) FROM modes WHERE dt_mode >= 10) AS n_slow FROM matched""",
    "match_offset_quantiles": """SELECT *, p95 <= CASE road_level WHEN 'arterial' THEN 25 WHEN 'sub_arterial' THEN 20 WHEN 'branch' THEN 15 WHEN 'expressway_ramp' THEN 1e9 END AND p99 <= CASE road_level WHEN 'arterial' THEN 35 WHEN 'sub_arterial' THEN 30 WHEN 'branch' THEN 20 WHEN 'expressway_ramp' THEN 30 END AS passes FROM (
        SELECT road_level, count(*) AS n, round_even(quantile_cont(round_even(off_m, 2), 0.5), 1) AS p50, round_even(quantile_cont(round_even(off_m, 2), 0.95), 1) AS p95, round_even(quantile_cont(round_even(off_m, 2), 0.99), 1) AS p99 FROM matched WHERE osm_id IS NOT NULL GROUP BY 1)""",
    "reverse_ratio": "SELECT segment_id, judged AS n_judged, bad AS n_reverse, round_even(bad / judged, 4) AS ratio FROM ratios WHERE judged > 0",
    "reverse_events": f"SELECT {_EVENT} FROM reverse",
    "event_counts": "SELECT event_type, count(*) AS n FROM all_events GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM all_events",
    "event_ids": "SELECT event_id, segment_id, start_time FROM (SELECT *, printf('EV-%06d', row_number() OVER (ORDER BY event_type, start_time, segment_id, value_main)) AS event_id FROM all_events) WHERE event_type = 'overspeed'",
    "event_detail_json": "SELECT event_type, count(*) AS n, max(n_points)::BIGINT AS most_points, max(judged)::BIGINT AS most_judged, round_even(max(round_even(v0 * 3.6, 2)), 1) AS most_from_kmh FROM all_events GROUP BY 1",
    "grid_exposure": "SELECT col, row, round_even(sum(part), 1) AS exposure_m FROM cut GROUP BY 1, 2 HAVING sum(part) > 0.01",
    "grid_distincts": """SELECT col, row, count(DISTINCT vehicle_id) AS vehicle_count, count(DISTINCT s) AS segment_count FROM (SELECT col, row, vehicle_id, vehicle_id || ':' || CAST(sq AS VARCHAR) AS s FROM cut WHERE part > 0.01 UNION ALL SELECT col, row, vehicle_id, NULL FROM placed) GROUP BY 1, 2""",
    "grid_metrics": """SELECT grid_id, round_even(round_even(km, 3), 2) AS exposure_km, o AS overspeed_count, r AS reverse_count, q AS rapid_count, o + r + q AS total_events, flag AS quality_flag, ro AS overspeed_rate, rr AS reverse_rate, rq AS rapid_rate
        FROM rated WHERE round_even(km, 3) > 0 OR o + r + q > 0""",
    "cell_box_wgs84": "SELECT col, row, " + ", ".join(f"round_even({c}_{k}, 6) AS {n}_{c}" for k, n in (("m", "center"), ("a", "min"), ("b", "max")) for c in ("lon", "lat")) + " FROM boxed",
    "grid_meta": f"""SELECT count(*) AS n_grids, {_QUALITY}, round_even(round_even(sum(round_even(km, 3)), 2), 1) AS total_exposure_km, CAST(sum(o + r + q) AS BIGINT) AS total_events, CAST(sum(o) AS BIGINT) AS overspeed_events,
        CAST(sum(r) AS BIGINT) AS reverse_events, CAST(sum(q) AS BIGINT) AS rapid_events FROM rated""",
    "entropy_weights": "SELECT round_even(w1, 4) AS w_overspeed_rate, round_even(w2, 4) AS w_reverse_rate, round_even(w3, 4) AS w_rapid_rate FROM weights",
    "topsis": "SELECT grid_id, round_even(closeness, 3) AS closeness FROM close",
    "danger_indices": """SELECT grid_id, CASE WHEN h1 > 0 THEN round_even(ro / h1 * 100, 1) ELSE 0 END AS overspeed_index, CASE WHEN h2 > 0 THEN round_even(rr / h2 * 100, 1) ELSE 0 END AS reverse_index, CASE WHEN h3 > 0 THEN round_even(rq / h3 * 100, 1) ELSE 0 END AS rapid_index FROM close""",
    "risk_scores": "SELECT grid_id, io AS overspeed_index, ir AS reverse_index, iq AS rapid_index, cri, available AS cri_available FROM scored",
    "knn_neighbors": "SELECT i, j, d2 FROM knn",
    "radius_neighbors": "SELECT i, count(*) AS n FROM near GROUP BY 1",
    "getis_ord_gi_star": f"SELECT grid_id, round_even(gi_z, 3) AS gi_z, {_LEVEL.format(z='round(gi_z, 9)')} AS risk_level FROM ({_gi('valid', 'knn')})",
    "getis_ord_gi_star_ord": f"SELECT grid_id, round_even(gi_z, 3) AS gi_z, {_LEVEL.format(z='round(gi_z, 9)')} AS risk_level FROM ({_gi('valid', 'knn', '', 's) / sqrt((any_value(n) / 6.0 - 1) / (any_value(n) - 1)')})",
    "zscore_hotspots": f"SELECT grid_id, round_even(z, 3) AS gi_z, {_LEVEL.format(z='round(z, 9)')} AS risk_level FROM (SELECT grid_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM valid)",
    "hotspot_layers": "SELECT layer, grid_id, round_even(round_even(value, 2), 1) AS layer_value, round_even(round_even(gi_z, 3), 2) AS gi_z, risk_level, selection_type FROM spots",
    "hotspot_facts": "SELECT * FROM facts",
    "top_risk_fallback": f"SELECT grid_id, value, round_even(z, 3) AS gi_z, {_LEVEL.format(z='round(z, 9)')} AS risk_level FROM (SELECT grid_id, value, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS z FROM (SELECT grid_id, value FROM valid ORDER BY value DESC, grid_id LIMIT 8))",
    "global_moran": f"SELECT n, round(i, 6) AS moran_i, round(e, 6) AS expected, round(z, 4) AS z, round({_erfc('z')}, 4) AS p FROM (SELECT *, (i - e) / sqrt(var) AS z FROM ({_moran('valid', 'knn', '0.2')}))",
    "global_moran_radius": f"SELECT n, round(i, 6) AS moran_i, round(e, 6) AS expected FROM ({_moran('valid', 'near', '1.0')})",
    "local_moran": f"""SELECT *, {_LABEL} AS label FROM (SELECT grid_id, round_even(x * lag / m2, 3) AS local_i, CASE WHEN round(x, 9) > 0 THEN 'H' ELSE 'L' END || CASE WHEN round(lag, 9) > 0 THEN 'H' ELSE 'L' END AS quadrant FROM (
        SELECT a.grid_id, any_value(a.value - m) AS x, avg(b.value - m) AS lag, any_value(m2) AS m2 FROM knn JOIN valid a ON a.grid_id = i JOIN valid b ON b.grid_id = j, (SELECT avg(value) AS m, var_pop(value) AS m2 FROM valid) GROUP BY 1))""",
    "local_moran_radius": f"""SELECT *, {_LABEL} AS label, 1.0::DOUBLE AS p FROM (SELECT grid_id, round_even(x * lag / m2, 3) AS local_i, CASE WHEN round(x, 9) > 0 THEN 'H' ELSE 'L' END || CASE WHEN round(lag, 9) > 0 THEN 'H' ELSE 'L' END AS quadrant FROM (
        SELECT a.grid_id, any_value(a.value - m) AS x, coalesce(sum(b.value - m), 0) AS lag, any_value(m2) AS m2 FROM valid a LEFT JOIN near ON a.grid_id = i LEFT JOIN valid b ON b.grid_id = j, (SELECT avg(value) AS m, var_pop(value) AS m2 FROM valid) GROUP BY 1))""",
    "analysis_summary": f"""SELECT count(*) AS grid_count, {_QUALITY}, count(cri) AS cri_count, round_even(avg(cri), 1) AS cri_mean, round_even(max(cri), 1) AS cri_max,
        (SELECT '[' || string_agg('{{"event_type":"' || event_type || '","n":' || n || '}}', ',' ORDER BY event_type) || ']' FROM (SELECT event_type, count(*) AS n FROM all_events GROUP BY 1)) AS events,
        (SELECT '[' || string_agg('{{"layer":"' || layer || '","selection_type":"' || selection_type || '","n_significant":' || n_significant || '}}', ',' ORDER BY layer) || ']' FROM facts) AS layers FROM scored""",
    "normalize_points_v1": "SELECT CAST(event_id AS VARCHAR) AS order_id, time AS event_time, lon, lat, round_even(raw_speed, 4) AS speed_kmh, CASE WHEN raw_speed >= 20 THEN 1 ELSE 0 END AS is_overspeed, '未知' AS gender, -1 AS age FROM typed WHERE time IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL",
    "filter_time_range": "SELECT event_type, count(*) AS n FROM v1 WHERE event_time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-07 18:30:00' GROUP BY 1",
    "filter_recent_days": "SELECT event_type, count(*) AS n FROM v1 WHERE event_time >= TIMESTAMP '2024-01-22' GROUP BY 1",
    "append_points_dedup": """SELECT order_id, event_time, source_row, round_even(speed_kmh, 3) AS speed_kmh FROM (SELECT user_id AS order_id, date_trunc('hour', event_time) AS event_time, CASE WHEN date_trunc('hour', event_time) >= TIMESTAMP '2024-01-16' THEN order_id ELSE -order_id END AS source_row, speed_kmh FROM v1)
        QUALIFY row_number() OVER (PARTITION BY order_id, event_time ORDER BY source_row) = 1""",
    "v1_grid": "SELECT grid_id, o AS overspeed_count, n AS trajectory_count, round_even(speed, 4) AS mean_speed, a AS time_min, b AS time_max, slice AS time_slice, round_even(clon, 6) AS center_lon, round_even(clat, 6) AS center_lat FROM v1c",
    "v1_hotspot_fallback": "SELECT grid_id, o AS overspeed_count, gi_z::DOUBLE AS gi_z, risk_level FROM v1top",
    "v1_hotspots": "SELECT area_id, grid_id, round_even(gi_z, 3) AS gi_z, risk_level FROM v1hot",
    "top_hotspots": "SELECT area_id, grid_id, round_even(gi_z, 3) AS gi_z, risk_level FROM v1hot ORDER BY gi_z DESC, area_id LIMIT 3",
    "filter_hotspots": "SELECT area_id, grid_id FROM v1hot WHERE NOT (b < TIMESTAMP '2024-01-01' OR a > TIMESTAMP '2024-01-01 12:00:00')",
    "tag_evolution": """SELECT grid_id, evolution_pattern, CASE evolution_pattern WHEN '新增热点' THEN '#ff9800' WHEN '逐渐减少的热点' THEN '#f06292' WHEN '加强的热点' THEN '#d32f2f' WHEN '持续的热点' THEN '#1976d2' ELSE '#9c27b0' END AS pattern_color FROM (
        SELECT grid_id, CASE WHEN risk_level = 'high' AND gi_z >= 2.58 THEN CASE WHEN abs(z) > 2.58 THEN CASE WHEN z > 0 THEN '新增热点' ELSE '逐渐减少的热点' END ELSE '加强的热点' END WHEN risk_level = 'high' THEN '持续的热点' ELSE '振荡热点' END AS evolution_pattern FROM v1hot, mk)""",
    "hotspot_export_rows": "SELECT area_id, grid_id, risk_level, slice AS time_slice, n AS trajectory_count, '三级管控：常态化巡查' AS control FROM v1hot WHERE risk_level = 'low'",
    "risk_distribution": "SELECT count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium, count(*) FILTER (risk_level = 'low') AS low FROM v1hot",
    "hourly_distribution": "SELECT hour, overspeed, n, hour = arg_max(hour, (overspeed, -hour)) OVER () AS is_peak FROM (SELECT CAST(hour(event_time) AS INTEGER) AS hour, CAST(sum(is_overspeed) AS BIGINT) AS overspeed, count(*) AS n FROM v1 GROUP BY 1)",
    "daily_trend": "SELECT CAST(event_time AS DATE) AS day, CAST(sum(is_overspeed) AS BIGINT) AS overspeed, count(*) AS n, round_even(avg(speed_kmh), 6) AS mean_speed FROM v1 GROUP BY 1",
    "daily_trend_hours": "SELECT CAST(hour(event_time) AS INTEGER) AS hour, CAST(sum(is_overspeed) AS BIGINT) AS overspeed, count(*) AS n, round_even(avg(speed_kmh), 6) AS mean_speed FROM v1 WHERE CAST(event_time AS DATE) = DATE '2024-01-09' GROUP BY 1",
    "hourly_series": "SELECT bucket_ts, value FROM hours",
    "mann_kendall": "SELECT key, n, s, round(var_s, 4) AS var_s, round(z, 6) AS z, round(p, 6) AS p, round(s / (n * (n - 1) / 2), 6) AS tau, CASE WHEN abs(z) <= 1.959963984540054 THEN 'no trend' WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM mk",
    "mean_slope_trend": "SELECT *, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'no trend' END AS trend FROM (SELECT key, count(*) AS n, round_even(avg(d), 6) AS slope FROM (SELECT key, value - lag(value) OVER (PARTITION BY key ORDER BY bucket_ts) AS d FROM kinds) GROUP BY 1)",
    "index_quantiles": "SELECT o75 AS overspeed_p75, o90 AS overspeed_p90, r75 AS reverse_p75, r90 AS reverse_p90, q75 AS rapid_p75, q90 AS rapid_p90, c75 AS cri_p75 FROM cuts",
    "hotspot_context": "SELECT grid_id, " + ", ".join(f"max(risk_level) FILTER (layer = '{k}') AS {k}" for k in ("comprehensive", "overspeed", "reverse", "rapid")) + " FROM spots GROUP BY 1",
    "default_risk_layer": "SELECT * FROM best_layer",
    "reverse_oneway_ratio": "SELECT grid_id, round_even(ratio, 4) AS oneway_ratio FROM wrongways",
    "advice_rule_ids": "SELECT grid_id, array_to_string(ids, ',') AS rule_ids FROM hits",
    "advice_rules": "SELECT grid_id, string_agg(rule_id, ',' ORDER BY priority) AS by_priority, (SELECT string_agg('check ' || basis_id, '；' ORDER BY place) FROM bases b WHERE b.grid_id = r.grid_id) AS cautions FROM ruled r GROUP BY 1",
    "advice_basis": "SELECT grid_id, CAST(place AS INTEGER) AS place, basis_id, CASE WHEN basis_id <> 'BASIS-PATENT' THEN 'clause ' || basis_id END AS name FROM bases",
    "advice_payload": """SELECT g.grid_id, coalesce(risk_level, 'unknown') AS risk_level, coalesce(selection_type, 'statistical_hotspot') AS selection_type, cri AS composite_risk_index, coalesce(io, 0) AS overspeed_index, r AS reverse_events, round_even(rq, 0) AS rapid_rate,
        round_even(round_even(round_even(km, 3), 2), 1) AS distance_km, segs AS segments, round_even(round_even(lon_m, 6), 3) AS lon, round_even(round_even(lat_m, 6), 3) AS lat FROM scored g JOIN boxed USING (col, row) JOIN best_layer l ON l.grid_id = g.grid_id LEFT JOIN spots s ON s.grid_id = g.grid_id AND s.layer = l.layer""",
    "fallback_advice_text": """SELECT h.grid_id, '该网格2024-06-05共记录超速' || o || '起、逆行' || r || '起、急变速' || q || '起，暴露里程' || printf('%.1f', round_even(round_even(km, 3), 1)) || '公里，综合风险指数' || printf('%.1f', coalesce(cri, 0)) || '，以' || CASE top WHEN 'o' THEN '超速' WHEN 'r' THEN '逆行' WHEN 'q' THEN '急变速' ELSE '综合风险' END || '最突出。' AS risk_summary,
        coalesce(f, '') AS field_action, CAST(coalesce(nr, 0) AS INTEGER) AS n_road_env, CAST(coalesce(ne, 0) AS INTEGER) AS n_enterprise, CAST(coalesce(nd, 0) AS INTEGER) AS n_education, (SELECT string_agg(basis_id, ',' ORDER BY place) FROM bases b WHERE b.grid_id = h.grid_id) AS basis_ids
        FROM hits h LEFT JOIN (SELECT grid_id, string_agg('do ' || rule_id, '；' ORDER BY priority) FILTER (section = 'f') AS f, count(*) FILTER (section = 'r') AS nr, count(*) FILTER (section = 'e') AS ne, count(*) FILTER (section = 'd') AS nd FROM ruled GROUP BY 1) USING (grid_id)""",
    "validate_advice_json": "SELECT grid_id, CASE WHEN flag <> 'valid' THEN 'field_actions[0],education' ELSE '' END AS problems FROM rated",
    "advice_cache_key": "SELECT grid_id, sha256('AV-1|' || grid_id || '|' || layer || '|KB-1.0|P-2.0|rule_fallback') AS cache_key FROM best_layer",
    "grid_detail": "SELECT grid_id, flag AS quality_flag, CASE WHEN flag = 'valid' THEN 'AD-' || grid_id END AS advice_id, flag = 'valid' AS advice_available FROM rated",
    "feedback_status": "SELECT grid_id, count(*) AS n, arg_max(conclusion, (handled_at, feedback_id)) AS latest, max(handled_at) AS latest_at FROM feedback GROUP BY 1",
    "false_streak": """SELECT grid_id, CAST(sum(lead) AS BIGINT) AS streak, sum(lead) >= 3 AS flagged FROM (SELECT grid_id, min(CASE WHEN conclusion = '不成立' THEN 1 ELSE 0 END) OVER (
        PARTITION BY grid_id ORDER BY handled_at DESC, feedback_id DESC ROWS UNBOUNDED PRECEDING) AS lead FROM feedback) GROUP BY 1""",
    "events_in_grid_box": "SELECT grid_id, count(*) AS n, count(DISTINCT day) AS n_days FROM boxes GROUP BY 1",
    "event_rate_change": """SELECT grid_id, t, n_before, n_after, CASE WHEN ok THEN 'ok' ELSE 'insufficient' END AS status, CASE WHEN last_day IS NOT NULL THEN round_even(n_before / 14, 2) END AS before_per_day, CASE WHEN ok THEN round_even(n_after / 14, 2) END AS after_per_day,
        CASE WHEN ok AND n_before > 0 THEN round_even((n_after - n_before) / n_before * 100, 1) END AS pct FROM (SELECT *, coalesce(n_after > 0 AND last_day >= t + 13, false) AS ok FROM (
          SELECT grid_id, t, count(*) FILTER (day - t BETWEEN -14 AND -1) AS n_before, count(*) FILTER (day - t BETWEEN 0 AND 13) AS n_after, max(day) AS last_day FROM (SELECT grid_id, max(handled_at) AS t FROM feedback GROUP BY 1) LEFT JOIN boxes USING (grid_id) GROUP BY 1, 2))""",
    "validate_feedback": """SELECT array_to_string(list_filter([CASE WHEN event_type = 'click' THEN 'conclusion' END, CASE WHEN event_type IN ('view', 'error') THEN 'handled_at' END, CASE WHEN event_type = 'signup' THEN 'photos' END], lambda x: x IS NOT NULL), ',') AS problems,
        'a|b' || event_type AS issues, '值班民警' AS reporter, count(*) AS n FROM v1 GROUP BY event_type""",
    "feedback_ledger": "SELECT feedback_id, handled_at, conclusion FROM feedback ORDER BY handled_at DESC, created_at DESC, feedback_id DESC LIMIT 50",
    "feedback_history": "SELECT feedback_id, CAST(floor(epoch(created_at)) AS BIGINT) AS timestamp FROM feedback",
    "log_statistics": """SELECT event_type AS operation_type, CAST(user_id AS VARCHAR) AS "user", CAST(event_time AS DATE) AS day, count(*) AS n FROM v1 GROUP BY GROUPING SETS ((event_type), (user_id), (CAST(event_time AS DATE)), ())""",
    "filter_operation_log": "SELECT operation_type, CAST(timestamp AS DATE) AS day, count(*) AS n FROM logs GROUP BY 1, 2",
    "log_feedback_same_day": """SELECT timestamp, usr AS "user", f.feedback_id, coalesce('about ' || b.event_type, '') AS content, coalesce(b.lon_u || ',' || b.lat_u, '') AS place FROM logs LEFT JOIN firsts f ON f.day = CAST(timestamp AS DATE) LEFT JOIN feedback b ON b.feedback_id = f.feedback_id""",
    "feedback_without_log": "SELECT feedback_id, handled_at FROM feedback WHERE handled_at NOT IN (SELECT CAST(timestamp AS DATE) FROM logs)",
    "log_with_feedback": """SELECT operation_type, day, count(*) AS n, count(DISTINCT feedback_id) AS n_feedback FROM (SELECT operation_type, CAST(timestamp AS DATE) AS day, f.feedback_id FROM logs LEFT JOIN firsts f ON f.day = CAST(timestamp AS DATE)
        UNION ALL SELECT 'feedback', handled_at, feedback_id FROM feedback WHERE handled_at NOT IN (SELECT CAST(timestamp AS DATE) FROM logs)) GROUP BY 1, 2""",
    "read_trajectory_csv": "SELECT coalesce(isolate_reason, 'kept') AS reason, count(*) AS n FROM tagged GROUP BY 1",
    "load_batch": "SELECT 'B-3' AS batch_id, count(*) AS n, count(DISTINCT segment_id) AS n_segments, min(time) AS time_min, max(time) AS time_max FROM kin WHERE user_id % 5 = 3",
    "batch_catalog": "SELECT 'B-' || user_id AS batch_id, max(event_time) AS created_at, CASE WHEN arg_max(event_type, event_time) = 'error' THEN 'failed' ELSE 'completed' END AS status FROM v1 GROUP BY user_id",
    "latest_batch": """SELECT (SELECT 'B-' || user_id FROM v1 ORDER BY event_time DESC LIMIT 1) AS batch_id, (SELECT 'AV-' || user_id FROM (SELECT user_id, max(event_time) AS t, arg_max(event_type, event_time) AS e FROM v1 GROUP BY 1) WHERE e <> 'error' ORDER BY t DESC LIMIT 1) AS analysis_version,
        (SELECT 'RN-' || user_id FROM (SELECT user_id, min(event_time) AS t FROM v1 GROUP BY 1) ORDER BY t DESC LIMIT 1) AS net_id""",
    "read_road_edges": "SELECT road_level, count(*) AS n FROM edges GROUP BY 1",
    "write_stages": "SELECT 'AV-1' AS analysis_version, flag AS quality_flag, count(*) AS n FROM rated WHERE flag <> 'valid' GROUP BY 2 UNION ALL SELECT 'AV-2', flag, count(*) FROM rated WHERE flag = 'valid' GROUP BY 2",
    "to_geojson_features": "SELECT 'Feature' AS type, 'Polygon' AS geometry, grid_id, cri, round_even(lon_b, 6) AS first_lon, o AS overspeed_count FROM scored JOIN boxed USING (col, row) WHERE flag = 'valid'",
    "export_hotspots_csv": "SELECT grid_id, risk_level, selection_type, q AS rapid_count, round_even(lon_m, 6) AS lon FROM spots JOIN scored USING (grid_id) JOIN boxed b ON b.col = scored.col AND b.row = scored.row WHERE layer = 'rapid'",
    "export_report": "SELECT count(*) AS n_rows, count(*) AS n_grids, count(*) FILTER (flag = 'valid') AS n_valid, CAST(sum(o + r + q) AS BIGINT) AS total_events FROM rated",
    "read_feedback_jsonl": "SELECT CAST(handled_at AS VARCHAR) AS handled_at, count(*) AS n, min(CAST(feedback_id AS VARCHAR)) AS first_id FROM feedback WHERE conclusion = '不成立' AND handled_at BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1",
    "export_feedback_csv": "SELECT conclusion, 'about ' || event_type || '；seen' AS issues, count(*) AS n FROM feedback GROUP BY 1, 2",
    "export_operation_log_csv": """SELECT operation_type, count(*) AS n, count(feedback_id) AS n_feedback FROM (SELECT operation_type, f.feedback_id FROM logs LEFT JOIN firsts f ON f.day = CAST(timestamp AS DATE)
        UNION ALL SELECT 'feedback', feedback_id FROM feedback WHERE handled_at NOT IN (SELECT CAST(timestamp AS DATE) FROM logs)) GROUP BY 1""",
    "stream_hourly_overspeed": "SELECT date_trunc('hour', event_time) AS bucket_ts, CAST(sum(is_overspeed) AS BIGINT) AS value FROM v1 GROUP BY 1",
    "stream_point_dedup": "SELECT 'V' || user_id AS vehicle_id, count(*) AS n FROM v1 GROUP BY user_id",
    "stream_segments": """SELECT 'V' || user_id AS vehicle_id, min(event_time) AS start_time, max(event_time) AS end_time, count(*) AS n_points, round_even(max(speed_kmh), 3) AS max_speed FROM (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY event_time, order_id ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, CASE WHEN coalesce(date_diff('microsecond', lag(event_time) OVER w, event_time) <= 180000000, false) THEN 0 ELSE 1 END AS head FROM v1 WINDOW w AS (PARTITION BY user_id ORDER BY event_time, order_id))) GROUP BY user_id, run""",
}
_ALERT = """SELECT printf('ALERT-20240605-%04d', row_number() OVER (ORDER BY area_id)) AS alert_id, grid_id, alert_level, CASE alert_level WHEN 'red' THEN '加强的热点' WHEN 'yellow' THEN '新增热点' ELSE '持续的热点' END AS alert_type,
    CASE WHEN hour(a) IN (7, 8) THEN '早高峰（7:00-9:00）' WHEN hour(a) IN (17, 18) THEN '晚高峰（17:00-19:00）' WHEN hour(a) IN (12, 13) THEN '午间小高峰（12:00-14:00）' WHEN hour(a) IN (21, 22) THEN '夜间平峰（21:00-23:00）' ELSE '全天' END AS expected_period,
    CAST(CASE alert_level WHEN 'blue' THEN 2 ELSE 3 END AS INTEGER) AS n_suggestions, 'pending' AS status FROM (SELECT *, CASE WHEN risk_level = 'high' AND gi_z >= 2.58 THEN 'red' WHEN risk_level = 'high' AND abs(z) > 2.58 THEN 'yellow' WHEN risk_level IN ('medium', 'high') THEN 'blue' END AS alert_level FROM v1fb, mk) WHERE alert_level IS NOT NULL"""
_DASH = f"""SELECT (SELECT count(*) FROM v1c) AS grid_count, (SELECT count(*) FROM v1hot) AS hotspot_count, round_even(round(i, 6), 4) AS moran_i, round({_erfc("zz")}, 4) AS moran_p, round_even(round(z, 6), 4) AS trend_z,
    CASE WHEN abs(z) <= 1.959963984540054 THEN 'no trend' WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END AS trend, (SELECT count(*) FROM v1hot WHERE risk_level = 'high') AS high, (SELECT count(*) FROM v1hot WHERE risk_level = 'medium') AS medium,
    (SELECT count(*) FROM v1hot WHERE risk_level = 'low') AS low FROM (SELECT *, (i - e) / sqrt(var) AS zz FROM ({_moran("v1c", "v1knn", "0.2")})), (SELECT z FROM mk)"""
FINAL |= {
    "generate_alerts": _ALERT,
    "filter_alerts": f"SELECT alert_id, grid_id FROM ({_ALERT}) WHERE alert_level = 'blue'",
    "alert_statistics": f"SELECT alert_level, status, 2 * count(*) AS n FROM ({_ALERT}) GROUP BY GROUPING SETS ((alert_level), (status), ())",
    "dashboard_metrics": _DASH,
    "interpret_analysis": f"""SELECT CASE WHEN h > 10 THEN 'red' WHEN h > 5 THEN 'yellow' ELSE 'blue' END AS hotspot_level, CASE WHEN m > 0.3 THEN 'high' WHEN m > 0.1 THEN 'medium' WHEN m > -0.1 THEN 'random' ELSE 'dispersed' END AS moran_pattern,
        CASE t WHEN 'increasing' THEN 'red' WHEN 'decreasing' THEN 'blue' ELSE 'yellow' END AS trend_level,
        array_to_string(list_filter([CASE WHEN h > 10 OR m > 0.3 OR t = 'increasing' THEN 'red' END, CASE WHEN (h > 5 AND h <= 10) OR (m > 0.1 AND m <= 0.3) OR t = 'no trend' THEN 'yellow' END, CASE WHEN h <= 5 OR t = 'decreasing' THEN 'blue' END], lambda x: x IS NOT NULL), ',') AS instructions,
        array_to_string(list_filter([CASE WHEN h > 0 THEN 'patrol' END, CASE WHEN m > 0.1 THEN 'facilities' END, CASE WHEN t = 'increasing' THEN 'campaign' END], lambda x: x IS NOT NULL), ',') AS recommendations FROM (SELECT hotspot_count AS h, moran_i AS m, trend AS t FROM ({_DASH}))""",
    "recommendation_template": """SELECT grid_id, CASE WHEN risk_level = 'high' AND gi_z >= 2.58 THEN 'new_hotspot' WHEN risk_level = 'high' THEN 'oscillating_hotspot' WHEN risk_level = 'medium' THEN 'medium_risk' ELSE 'low_risk' END AS template,
        coalesce(nullif(array_to_string(list_filter([CASE WHEN risk_level = 'high' THEN 'inspect' END, CASE WHEN hour(a) >= 21 OR hour(a) < 6 THEN 'night_patrol' END, CASE WHEN speed > 20 THEN 'speed_display' END, CASE WHEN share > 0.6 THEN 'education' END, CASE WHEN risk_level = 'high' THEN 'joint_high' END, CASE WHEN risk_level = 'medium' THEN 'joint_medium' END], lambda x: x IS NOT NULL), ','), ''), 'routine') AS rules,
        CAST(CASE WHEN risk_level = 'high' AND gi_z >= 2.58 THEN 3 WHEN risk_level IN ('medium', 'high') THEN 2 ELSE 0 END AS INTEGER) AS n_suggestions FROM v1hot LEFT JOIN young USING (grid_id)""",
}
#: Which series the trend is of.
_SERIES = {"mann_kendall": "SELECT * FROM kinds"}
_ALL = "SELECT 'all' AS key, * FROM hours"
#: All cells draw from one table of numbers, made of digests: of the first 64 for a permutation those that differ.
_PERMUTED = f"""SELECT grid_id, quadrant, {_LABEL} AS label, round_even(CASE WHEN sd > 0 THEN (i - m) / sd ELSE 0 END, 3) AS lisa_z, round_even((least(larger, 999 - larger) + 1) / 1000.0, 3)::DOUBLE AS lisa_p FROM (
    SELECT c.grid_id, any_value(c.quadrant) AS quadrant, any_value(c.i) AS i, avg(sim) AS m, stddev_pop(sim) AS sd, count(*) FILTER (WHERE round(sim, 9) >= round(c.i, 9)) AS larger FROM (
      SELECT c.grid_id, d.perm, any_value(c.x) * avg(o.x) / any_value(c.m2) AS sim FROM lisa_cells c JOIN lisa_draws d ON d.place <= c.k JOIN lisa_cells o ON o.n = d.number + CASE WHEN d.number >= c.n THEN 1 ELSE 0 END GROUP BY 1, 2) s
    JOIN lisa_cells c ON c.grid_id = s.grid_id GROUP BY 1)"""
FINAL |= {
    "overspeed_without_drift": """SELECT 'overspeed' AS event_type, segment_id, min(time) AS start_time, max(time) AS end_time, CAST(date_diff('second', min(time), max(time)) AS DOUBLE) AS duration_s, round_even(max(mps * 3.6), 2) AS value_main,
        arg_max(lon, mps * 3.6 - point_order * 1e-9) AS lon, arg_max(lat, mps * 3.6 - point_order * 1e-9) AS lat FROM (SELECT *, sum(CASE WHEN mps * 3.6 > 20 AND mps <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY vehicle_id, sq ORDER BY point_order ROWS UNBOUNDED PRECEDING) AS run FROM kin)
        WHERE mps * 3.6 > 20 AND mps <= 30 GROUP BY vehicle_id, segment_id, run HAVING date_diff('second', min(time), max(time)) >= 10 AND count(*) >= 2""",
    "daily_trend_by_area": "SELECT grid_id, CAST(event_time AS DATE) AS day, CAST(sum(is_overspeed) AS BIGINT) AS overspeed, count(*) AS n, round_even(avg(speed_kmh), 6) AS mean_speed FROM v1g GROUP BY 1, 2",
    "hourly_distribution_by_area": "SELECT grid_id, hour, overspeed, n, hour = arg_max(hour, (overspeed, -hour)) OVER (PARTITION BY grid_id) AS is_peak FROM (SELECT grid_id, CAST(hour(event_time) AS INTEGER) AS hour, CAST(sum(is_overspeed) AS BIGINT) AS overspeed, count(*) AS n FROM v1g GROUP BY 1, 2)",
    "events_in_grid_cell": "SELECT grid_id, count(*) AS n, count(DISTINCT CAST(event_time AS DATE)) AS n_days FROM v1g WHERE is_overspeed = 1 GROUP BY 1",
    "young_male_share": "SELECT grid_id, round_even(share, 4) AS young_male FROM young",
    "lisa_permutations": f"SELECT grid_id, lisa_z, lisa_p, quadrant FROM ({_PERMUTED})",
    "lisa_label_counts": f"SELECT label, count(*) AS n FROM ({_PERMUTED}) WHERE lisa_p < 0.05 GROUP BY 1",
    "filter_days": "SELECT event_type, count(*) AS n FROM v1 WHERE CAST(event_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07' GROUP BY 1",
    "finished_batches": """SELECT 'B-' || (user_id % 5) AS batch_id, 'completed' AS status, count(*) AS rows_total, count(DISTINCT user_id) AS n_vehicles, min(time) AS time_min, count(*) AS n FROM kin WHERE user_id % 5 < 4 GROUP BY user_id % 5""",
    "merge_points": "SELECT CAST(event_time AS DATE) AS day, count(*) AS n, CAST(sum(order_id) AS BIGINT) AS rows_sum, round_even(sum(speed_kmh), 3) AS speed_sum FROM v1 GROUP BY 1",
    "read_feedback_jdbc": """SELECT CAST(order_id AS VARCHAR) AS feedback_id, 'G' || CAST(floor(lon / 0.0045) AS BIGINT) || '_' || CAST(floor(lat / 0.0045) AS BIGINT) AS area_id, CASE event_type WHEN 'error' THEN '不成立' WHEN 'signup' THEN '部分成立' ELSE '成立' END AS user_type,
        round_even(lon, 6) AS lon, round_even(lat, 6) AS lat FROM v1 ORDER BY event_time DESC, CAST(order_id AS VARCHAR) DESC LIMIT 200""",
    # Hours that end behind the watermark, which is that of two micro-batches before when rows are judged late.
    "stream_hourly_overspeed": """SELECT * FROM (WITH a AS (SELECT *, date_trunc('hour', event_time) AS h, least(date_diff('day', DATE '2024-01-01', CAST(event_time AS DATE)) // 5 + CASE WHEN order_id % 50 = 0 THEN 2 ELSE 0 END, 5) AS arrival FROM v1),
        w AS (SELECT b.arrival, (SELECT max(event_time) FROM a WHERE a.arrival <= b.arrival - 2) - INTERVAL 10 MINUTE AS mark FROM (SELECT DISTINCT arrival FROM a) b)
        SELECT h AS bucket_ts, CAST(sum(is_overspeed) AS BIGINT) AS value FROM a JOIN w USING (arrival) WHERE (mark IS NULL OR h + INTERVAL 1 HOUR > mark) AND h + INTERVAL 1 HOUR <= (SELECT max(event_time) FROM v1) - INTERVAL 10 MINUTE GROUP BY 1)""",
    # Chains of the points that the watermark has passed; the last one of a vehicle, if it has ended by then.
    "stream_segments": """SELECT * FROM (WITH w AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE AS mark FROM raw), p AS (SELECT * FROM raw, w WHERE ts < mark),
        q AS (SELECT *, sum(head) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN rn % 30 = 17 OR NOT coalesce(date_diff('microsecond', lag(ts) OVER u, ts) <= 180000000, false) THEN 1 ELSE 0 END AS head FROM p WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))),
        r AS (SELECT user_id, run, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_points, max(CAST(step AS DOUBLE) / dt * 3.6) AS most, any_value(mark) AS mark FROM q GROUP BY 1, 2)
        SELECT 'V' || user_id AS vehicle_id, start_time, end_time, n_points, round_even(most, 3) AS max_speed FROM r QUALIFY run < max(run) OVER (PARTITION BY user_id) OR end_time + INTERVAL 180 SECOND < mark)""",
}
RECURSIVE = ("grown", "best")


def _needed(sql: str, parts: dict[str, str]) -> list[str]:
    """The parts that a text names, directly or through others."""
    names = lambda text: {x for x in parts if re.search(rf"\b{x}\b", text)}
    found, open_ = set(), names(sql)
    while open_:
        found |= open_
        open_ = set().union(*(names(parts[k]) for k in open_)) - found
    return [k for k in parts if k in found]


def oracles() -> dict[str, str]:
    out = {}
    for name, sql in FINAL.items():
        parts = {}
        for k, v in PARTS.items():
            if k == "mk":
                parts["series"] = _SERIES.get(name, _ALL)
            parts[k] = v
        needed = _needed(sql, parts)
        ctes = ", ".join(f"{k} AS {'' if k in RECURSIVE else 'MATERIALIZED '}({parts[k]})" for k in needed)
        out[name] = f"WITH RECURSIVE {ctes} {sql}"
    return out
