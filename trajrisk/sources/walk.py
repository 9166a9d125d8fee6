"""Trajectories laid over the ``events`` table: a deterministic walk, and roads below it.

Positions are whole micro-degrees until the end, so that running sums are exact in every engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW = """
SELECT event_id, user_id, ts, step, dt, lon_u, lat_u, event_type,
  CASE WHEN event_id % 41 = 3 THEN 'bad-time' ELSE concat('2024-06-', lpad(CAST(5 + CAST(floor(t / 86400.0) AS BIGINT) AS VARCHAR(20)), 2, '0'), ' ',
    lpad(CAST(CAST(floor(t / 3600.0) AS BIGINT) % 24 AS VARCHAR(20)), 2, '0'), ':', lpad(CAST(CAST(floor(t / 60.0) AS BIGINT) % 60 AS VARCHAR(20)), 2, '0'), ':',
    lpad(CAST(t % 60 AS VARCHAR(20)), 2, '0')) END AS POSITIONTIME,
  CASE WHEN event_id % 43 = 5 THEN 'n/a' ELSE concat(CAST(CAST(floor(lon_u / 1000000.0) AS BIGINT) + CASE WHEN event_id % 47 = 7 THEN 1 ELSE 0 END AS VARCHAR(20)), '.',
    lpad(CAST(lon_u % 1000000 AS VARCHAR(20)), 6, '0')) END AS X_position,
  concat(CAST(CAST(floor(lat_u / 1000000.0) AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST(lat_u % 1000000 AS VARCHAR(20)), 6, '0')) AS Y_position,
  concat('V', CAST(user_id AS VARCHAR(20))) AS BICYCLEID, user_id % 5 AS COMPANYID, CASE WHEN rn % 30 = 17 THEN 1 ELSE 0 END AS TID,
  CAST(step AS DOUBLE) / dt AS Speed
FROM (SELECT *, 25200 + leg * 600 + j * dt AS t,
    116470000 + (user_id * 37 % 10) * 2925 + sx + CASE WHEN h IN (1, 3) THEN jit * 12 ELSE 0 END AS lon_u,
    39720000 + (user_id * 53 % 10) * 2250 + sy + CASE WHEN h IN (0, 2) THEN jit * 9 ELSE 0 END + CASE WHEN event_id % 53 = 11 THEN 40000 ELSE 0 END AS lat_u
  FROM (SELECT *,
      CAST(sum(CASE h WHEN 0 THEN step * 12 WHEN 2 THEN -step * 12 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sx,
      CAST(sum(CASE h WHEN 1 THEN step * 9 WHEN 3 THEN -step * 9 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sy
    FROM (SELECT *, (user_id + leg) % 4 AS h, (event_id * 7919) % 21 - 10 AS jit, 2 + user_id % 6 AS dt,
        CASE WHEN event_id % 89 = 0 THEN 150 ELSE 4 + CAST(floor(value * 100) AS BIGINT) % 50 END AS step
      FROM (SELECT *, CAST(floor(rn / 12.0) AS BIGINT) AS leg, rn % 12 AS j
        FROM (SELECT event_id, user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM {events}) a) b) c) d) e
"""
#: Roads below the places that are visited at least twice, and one cell around: the network grows with the table.
ROADS = """
SELECT (i + 10000) * 200000 + (j + 10000) * 2 + vertical AS osm_id,
  CASE pmod(i + 2 * j, 7) WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'residential' WHEN 4 THEN 'footway' WHEN 5 THEN 'service' ELSE 'trunk_link' END AS fclass,
  CASE pmod(3 * i + j, 5) WHEN 0 THEN 'F' WHEN 1 THEN 't' WHEN 2 THEN NULL ELSE 'B' END AS oneway, CAST(NULL AS STRING) AS name, CAST(NULL AS DOUBLE) AS maxspeed,
  array(filter(array(
    named_struct('lon', u_x / 1e6, 'lat', u_y / 1e6),
    CASE WHEN pmod(i + 3 * j + vertical, 11) = 0 THEN named_struct('lon', (u_x + 487 - 467 * vertical) / 1e6, 'lat', (u_y + 20 + 355 * vertical) / 1e6) END,
    named_struct('lon', v_x / 1e6, 'lat', v_y / 1e6)), p -> p IS NOT NULL)) AS lines
FROM (SELECT i, j, vertical, 116458300 + 975 * i AS u_x, 39714000 + 750 * j AS u_y, 116458300 + 975 * (i + 1 - vertical) AS v_x, 39714000 + 750 * (j + vertical) AS v_y
  FROM (SELECT DISTINCT i + di AS i, j + dj AS j FROM (
      SELECT CAST(floor((lon_u - 116458300) / 975.0) AS BIGINT) AS i, CAST(floor((lat_u - 39714000) / 750.0) AS BIGINT) AS j FROM {points} GROUP BY 1, 2 HAVING count(*) >= 2)
    LATERAL VIEW explode(array(-1, 0, 1)) a AS di LATERAL VIEW explode(array(-1, 0, 1)) b AS dj)
  LATERAL VIEW explode(array(0, 1)) c AS vertical)
"""


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as a trajectory file has them: text columns with some bad times and coordinates."""
    return spark.sql(RAW, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def road_lines(spark: SparkSession, points: DataFrame) -> DataFrame:
    """Roads as a road file has them, below the points of ``raw_points``."""
    return spark.sql(ROADS, points=points)
