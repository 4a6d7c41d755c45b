"""Seed-and-grow line extraction within one cluster of ordered points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..sources.schema import SEGMENT, names
from .segments import CLUSTER


def fit_line(p: np.ndarray) -> tuple[float, float]:
    """(r, theta in [0, pi)) of the total least squares line."""
    m = p.mean(0)
    vx, vy, cxy = p[:, 0].var(), p[:, 1].var(), ((p - m)[:, 0] * (p - m)[:, 1]).mean()
    t = 0.5 * np.arctan2(2 * cxy, vx - vy) + np.pi / 2
    r = m[0] * np.cos(t) + m[1] * np.sin(t)
    return (-r, t - np.pi) if t >= np.pi else (r, t)


def residuals(p: np.ndarray, r: float, t: float) -> np.ndarray:
    return np.abs(p[:, 0] * np.cos(t) + p[:, 1] * np.sin(t) - r)


def corner_of(p: np.ndarray, cfg: MapConfig) -> int | None:
    """Index of the inner point farthest from the chord if the mean distance tells a corner."""
    a, b = p[0], p[-1]
    n = np.hypot(*(b - a))
    d = np.abs((b - a)[0] * (p[1:-1] - a)[:, 1] - (b - a)[1] * (p[1:-1] - a)[:, 0]) / n if n > 0 else np.hypot(*(p[1:-1] - a).T)
    return int(d.argmax()) + 1 if d.mean() > cfg.seed_corner else None


def grow(p: np.ndarray, i: int, cfg: MapConfig) -> int:
    """End (exclusive) of the line that starts at seed i: one refit on the first miss, the second ends it."""
    end = i + cfg.line_seed_points
    r, t = fit_line(p[i:end])
    refitted = False
    while end < len(p):
        if residuals(p[end : end + 1], r, t)[0] < cfg.least_thresh:
            end += 1
        elif refitted:
            break
        else:
            r, t = fit_line(p[i:end])
            refitted = True
    return end


def extract_cluster(p: np.ndarray, robot: np.ndarray, cfg: MapConfig = DEFAULT) -> tuple[list[dict], np.ndarray]:
    """Segments of an ordered cluster, each with the span of its points, and the mask of residual points."""
    found, residual = [], np.ones(len(p), bool)
    i, included = 0, -1
    while i + cfg.line_seed_points <= len(p):
        seed = p[i : i + cfg.line_seed_points]
        corner = corner_of(seed, cfg)
        if corner is not None:
            i += corner
            continue
        if residuals(seed, *fit_line(seed)).max() > cfg.least_thresh:
            i += 1
            continue
        if i - included - 1 < cfg.stray_points:
            residual[included + 1 : i] = False
        end = grow(p, i, cfg)
        length = np.hypot(*(p[end - 1] - p[i]))
        if length >= cfg.detect_length or end - i < cfg.stray_points:
            residual[i:end] = False
        if length >= cfg.detect_length and end - i >= cfg.min_line_points:
            r, t = fit_line(p[i:end])
            n = np.array([np.cos(t), np.sin(t)])
            a, b = p[i] - (p[i] @ n - r) * n, p[end - 1] - (p[end - 1] @ n - r) * n
            d = (b - a) / np.hypot(*(b - a))
            side = n if (robot - a) @ n >= 0 else -n
            found.append({"r": r, "theta": t, "nx": side[0], "ny": side[1], "dx": d[0], "dy": d[1], "x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1], "is_short": bool(length < cfg.min_line_length), "n_points": end - i})
        i, included = end, end - 1
    if len(p) - 1 - included < cfg.stray_points:
        residual[included + 1 :] = False
    return found, residual


#: Bits of a line's number for its cluster and for its place in the cluster.
CLUSTER_BITS = PLACE_BITS = 14


def extract_segments(clustered: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Segments of every (robot, scan, cluster) of points in order of ``pos``, with px, py; a cluster is at most one scan's beams.

    Line numbers are unique per robot: scan, cluster and place in the cluster.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        first = p.iloc[0]
        robot = p[["px", "py"]].iloc[0].to_numpy(float)
        rows, _ = extract_cluster(p[["x", "y"]].to_numpy(float), robot, cfg)
        scan, cluster = int(first["scan_id"]), int(first["cluster_id"])
        common = {"robot_id": first["robot_id"], "scan_id": scan, "room_id": int(first["room_id"]), "weight": 1, "robot_x": robot[0], "robot_y": robot[1], "cluster_id": cluster}
        base = (scan << CLUSTER_BITS | cluster) << PLACE_BITS
        return pd.DataFrame([{"line_id": base + k, **common, **row} for k, row in enumerate(rows)], columns=names(SEGMENT))

    return clustered.groupBy(*CLUSTER).applyInPandas(run, SEGMENT)


def residual_points(clustered: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Points of line clusters that seed-and-grow leaves over: robot_id, scan_id, cluster_id, beam, x, y."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        _, left = extract_cluster(p[["x", "y"]].to_numpy(float), p[["px", "py"]].iloc[0].to_numpy(float), cfg)
        return p.loc[left, [*CLUSTER, "beam", "x", "y"]]

    return clustered.groupBy(*CLUSTER).applyInPandas(run, "robot_id string, scan_id long, cluster_id int, beam int, x double, y double")


def chain_edges(segments: DataFrame) -> DataFrame:
    """(robot_id, src, dst): long segments that follow one another directly in their cluster; a short one between breaks the chain."""
    order = Window.partitionBy(*CLUSTER).orderBy("line_id")
    near = segments.select(*CLUSTER, F.lag("line_id").over(order).alias("src"), F.col("line_id").alias("dst"), F.lag("is_short").over(order).alias("_was"), "is_short")
    return near.where("NOT _was AND NOT is_short").select("robot_id", "src", "dst")
