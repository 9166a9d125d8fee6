"""Default parameters."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    bbox: tuple[float, float, float, float] = (116.455, 39.705, 116.592, 39.828)
    margin: float = 0.2
    max_isolated: float = 0.30
    drift_mps: float = 30.0
    gap_s: int = 180
    radius_m: float = 100.0
    far_m: float = 45.0
    candidates: int = 5
    path_m: float = 600.0
    overspeed_kmh: float = 20.0
    overspeed_s: float = 10.0
    overspeed_points: int = 2
    reverse_deg: float = 135.0
    reverse_ratio: float = 0.5
    rapid_dt_s: float = 6.0
    moving_mps: float = 0.5
    link_m: float = 200.0
    link_s: float = 1800.0
    cell_m: float = 250.0
    valid_km: float = 1.0
    valid_segments: int = 5
    min_motion: int = 30
    neighbours: int = 5
    fallback_n: int = 8
    v1_cell_deg: float = 0.0045
    feedback_days: int = 14
    box_lon: float = 0.0016
    box_lat: float = 0.0012
    min_cells: int = 5
    lisa_p: float = 0.05
    permutations: int = 999


DEFAULTS = Params()
