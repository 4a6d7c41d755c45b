"""Parameters of the mapping pipeline, in metres and radians."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class MapConfig:
    max_sensor_range: float = 3.0
    min_range: float = 0.2
    pose_gate: float = 0.2
    std_dev: float = 0.0
    noise_seed: int = 42
    k: int = 7
    least_thresh: float = 0.05
    min_line_length: float = 0.5
    detect_length: float = 0.4
    min_line_points: int = 20
    line_seed_points: int = 20
    corner_thresh: float = 0.5
    corner_reach: float = 0.5
    door_min: float = 0.8
    door_max: float = 3.0
    gap_thresh: float = 0.5
    delta_d: float = 0.2
    sparse_gap: float = 0.11
    remerge_gap: float = 0.2
    residual_radius: float = 0.15
    seed_corner: float = 0.10
    stray_points: int = 10
    edge_tolerance: float = 0.3
    gamma_dist: float = 0.02
    gamma_rob: float = 0.005
    fiedler_thresh: float = 0.18
    vis_dist_thresh: float = 8.0
    lamb: float = 100.0
    inducing_thresh: float = 0.5e-6
    near_line: float = 0.1
    r_voxel: float = 0.15
    gp_jitter: float = 1e-6
    #: softplus(0) + 1e-4: the noise variance that stays when it is never trained
    noise: float = 0.6932471805599453
    carry_c: str = "previous"


DEFAULT = MapConfig()
