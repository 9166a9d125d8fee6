"""Geometry as Column expressions: distances, bearings, the UTM 50N projection, cells and risk classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Fixed values of WGS-84 and UTM zone 50 north.
SEMI_MAJOR, FLATTENING = 6_378_137.0, 1 / 298.257223563
ECCENTRICITY_2 = 0.006694379990141317
MERIDIAN, SCALE, EASTING = 117.0, 0.9996, 500_000.0


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def bearing_deg(dx: Column, dy: Column) -> Column:
    """Clockwise from north in [0, 360); null for a zero vector."""
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0)))


def angdiff(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def _radius() -> float:
    """Rectifying radius."""
    n = FLATTENING / (2 - FLATTENING)
    return SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def _arc(phi: Column) -> Column:
    """Length of the meridian from the equator."""
    n = FLATTENING / (2 - FLATTENING)
    terms = (
        (1 + n**2 / 4 + n**4 / 64, phi), (-1.5 * (n - n**3 / 8), F.sin(2 * phi)), (15 / 16 * (n**2 - n**4 / 4), F.sin(4 * phi)),
        (-35 / 48 * n**3, F.sin(6 * phi)), (315 / 512 * n**4, F.sin(8 * phi)),
    )
    return SEMI_MAJOR / (1 + n) * reduce(lambda x, y: x + y, (k * f for k, f in terms))


def add_utm50n(df: DataFrame, lon: Column, lat: Column, x: str, y: str) -> DataFrame:
    """``df`` with easting ``x`` and northing ``y`` in metres (EPSG:32650).

    The classic series in powers of the longitude difference, in the order of operations of the SQL, as equal distances
    are told apart by what is left of rounding. Built in steps, each a projection of its own, so that no sub-expression
    is repeated in the generated code.
    """
    e2 = ECCENTRICITY_2
    kept = [c for c in df.columns if c not in (x, y)]
    df = df.select(*kept, F.radians(lat).alias("_p"), F.radians(lon - MERIDIAN).alias("_w"))
    df = df.select(*kept, "_w", F.sin("_p").alias("_s"), F.cos("_p").alias("_c"), F.pow(F.tan("_p"), F.lit(2.0)).alias("_t2"), _arc(F.col("_p")).alias("_m"))
    df = df.withColumns({"_q": 1 - e2 * F.col("_s") * F.col("_s"), "_wc": F.col("_w") * F.col("_c")})
    df = df.withColumns({"_nu": SEMI_MAJOR / F.sqrt("_q"), "_rho": SEMI_MAJOR * (1 - e2) / F.pow("_q", F.lit(1.5))}).withColumn("_psi", F.col("_nu") / F.col("_rho"))
    w, s, c, t2, m, nu, psi, wc = (F.col(k) for k in ("_w", "_s", "_c", "_t2", "_m", "_nu", "_psi", "_wc"))
    to = lambda v, k: F.pow(v, F.lit(float(k)))
    east = 1 + to(wc, 2) / 6 * (psi - t2) + to(wc, 4) / 120 * (4 * to(psi, 3) * (1 - 6 * t2) + to(psi, 2) * (1 + 8 * t2) - psi * 2 * t2 + t2 * t2)
    east = east + to(wc, 6) / 5040 * (61 - 479 * t2 + 179 * t2 * t2 - to(t2, 3))
    north = 1 + to(wc, 2) / 12 * (4 * to(psi, 2) + psi - t2)
    north = north + to(wc, 4) / 360 * (8 * to(psi, 4) * (11 - 24 * t2) - 28 * to(psi, 3) * (1 - 6 * t2) + to(psi, 2) * (1 - 32 * t2) - psi * 2 * t2 + t2 * t2)
    north = north + to(wc, 6) / 20160 * (1385 - 3111 * t2 + 543 * t2 * t2 - to(t2, 3))
    return df.select(*kept, (EASTING + SCALE * nu * w * c * east).alias(x), (SCALE * (m + nu * s * w * w * c / 2 * north)).alias(y))


def _inverse_series() -> list[float]:
    n = FLATTENING / (2 - FLATTENING)
    return [
        n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4,
        17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4,
    ]


def add_wgs84(df: DataFrame, x: Column, y: Column, lon: str, lat: str) -> DataFrame:
    """``df`` with degrees ``lon`` and ``lat`` of UTM 50N metres; the inverse of ``add_utm50n``."""
    radius = _radius()
    kept = [c for c in df.columns if c not in (lon, lat)]
    df = df.select(*kept, (y / (SCALE * radius)).alias("_xi"), ((x - EASTING) / (SCALE * radius)).alias("_eta"))
    xi, eta = F.col("_xi"), F.col("_eta")
    north, east = xi, eta
    for j, b in enumerate(_inverse_series(), 1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    df = df.select(*kept, north.alias("_n"), east.alias("_e"))
    df = df.withColumns({"_t0": F.sin("_n") / F.sqrt(F.pow(F.sinh("_e"), 2) + F.pow(F.cos("_n"), 2)), "_lam": F.atan2(F.sinh("_e"), F.cos("_n"))})
    df = df.withColumn("_t", F.col("_t0"))
    e2 = FLATTENING * (2 - FLATTENING)
    for k in range(3):  # tangent of the latitude from that of the conformal latitude: Newton steps
        t, root = F.col("_t"), F.sqrt(1 + F.col("_t") * F.col("_t"))
        df = df.withColumn("_s", F.sinh(e2**0.5 * F.atanh(e2**0.5 * t / root)))
        tau = t * F.sqrt(1 + F.col("_s") * F.col("_s")) - F.col("_s") * root
        step = (F.col("_t0") - tau) / F.sqrt(1 + tau * tau) * (1 + (1 - e2) * t * t) / ((1 - e2) * root)
        df = df.withColumn("_t", t + step)
    return df.select(*kept, (MERIDIAN + F.degrees("_lam")).alias(lon), F.degrees(F.atan("_t")).alias(lat))


def reverse_bearing(bearing: Column) -> Column:
    return F.pmod(bearing + 180, F.lit(360.0))


def mercator_mid_lat(lat0: Column, lat1: Column) -> Column:
    """Latitude in the middle of two others in the web Mercator plane: the centroid of a degree box there and back."""
    y = lambda lat: F.ln(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483)))
    return F.degrees(2 * F.atan(F.exp((y(lat0) + y(lat1)) / 2)) - F.lit(1.5707963267948966))


def obs_log_score(d: Column, beta: Column) -> Column:
    """Logarithm of the observation score of a distance, not under that of 1e-12."""
    return F.greatest(-0.5 * F.pow(d / beta, 2), F.lit(-27.631021115928547))


def transition_score(path: Column, straight: Column, obs: Column, seg: Column) -> Column:
    """0.17 for the detour of the path (none without one), 0.83 for the turn from the observed heading."""
    detour = F.coalesce(F.exp(-F.greatest(path - straight, F.lit(0.0)) / 10), F.lit(0.0))
    turn = F.coalesce(0.5 * (1 + F.cos(F.radians(angdiff(obs, seg)))), F.lit(0.5))
    return 0.17 * detour + 0.83 * turn


def travel_dir(obs: Column, seg: Column) -> Column:
    return F.when(obs.isNull() | seg.isNull(), F.lit(None)).when(F.cos(F.radians(angdiff(obs, seg))) >= 0, "forward").otherwise("backward")


def cell_of(v: Column, origin: Column, size: float) -> Column:
    return F.floor((v - origin) / size)


def risk_level(z: Column) -> Column:
    return F.when(z >= 2.58, "high").when(z >= 1.96, "medium").when(z >= 1.28, "low").otherwise("insignificant")


def grid_id(col: Column, row: Column) -> Column:
    return F.format_string("G%04d_%04d", col, row)
