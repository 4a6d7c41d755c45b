"""Scans to points: projection, range filter, pose gate and neighbour gaps."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..functions import geometry as g


def valid_range(r: Column, low: Column | float, high: Column | float, cfg: MapConfig = DEFAULT) -> Column:
    """Strictly between the sensor's limits, its useful range and the nearest range that counts."""
    r = g._c(r)
    return (r > g._c(low)) & (r < g._c(high)) & (r < cfg.max_sensor_range) & (r > cfg.min_range)


def project_beams(beams: DataFrame) -> DataFrame:
    """Add x and y to beams with px, py, angle (already turned by the yaw) and range."""
    return beams.withColumn("x", F.col("px") + F.col("range") * F.cos("angle")).withColumn("y", F.col("py") + F.col("range") * F.sin("angle"))


def scan_to_points(scans: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """One row per valid beam: robot_id, scan_id, beam, point_key, x, y, angle, range, increment and pose.

    The filter comes before noise, which is added only if ``std_dev`` is positive, with a
    seed. Scans without a valid beam give no rows. Robot and key together are collision-free up to 2**20 beams.
    """
    beams = scans.select(
        "robot_id", "scan_id", F.col("robot_pose.x").alias("px"), F.col("robot_pose.y").alias("py"), F.col("robot_pose.yaw").alias("yaw"),
        "angle_min", "angle_increment", "range_min", "range_max", F.posexplode("ranges").alias("beam", "range"),
    ).where(valid_range(F.col("range"), F.col("range_min"), F.col("range_max"), cfg))
    if cfg.std_dev > 0:
        beams = beams.withColumn("range", F.col("range") + F.randn(cfg.noise_seed) * cfg.std_dev)
    turned = beams.withColumn("angle", F.col("angle_min") + F.col("yaw") + F.col("beam") * F.col("angle_increment"))
    key = F.col("scan_id") * (1 << 20) + F.col("beam")
    return project_beams(turned).select("robot_id", "scan_id", "beam", key.alias("point_key"), "x", "y", "angle", "range", "angle_increment", "px", "py")


def pose_gate(poses: DataFrame, least: float = DEFAULT.pose_gate) -> DataFrame:
    """(robot_id, scan_id) of scans kept by displacement: the first of a robot, then each at ``least`` or more from the last one kept.

    This is a recursion over the last kept pose, not over the previous one. A robot's poses
    pass in order through one task, which holds a batch and one pose of them.
    """
    kind = poses.schema["scan_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        robot, x, y = None, 0.0, 0.0
        for b in batches:
            keep = []
            for r, px, py in zip(b["robot_id"], b["x"], b["y"], strict=True):
                far = r != robot or math.hypot(px - x, py - y) >= least
                if far:
                    robot, x, y = r, px, py
                keep.append(far)
            yield b.loc[keep, ["robot_id", "scan_id"]]

    ordered = poses.select(F.col("robot_id").cast("string").alias("robot_id"), "scan_id", "x", "y").where("robot_id IS NOT NULL").repartition("robot_id").sortWithinPartitions("robot_id", "scan_id")
    return ordered.mapInPandas(run, f"robot_id string, scan_id {kind}")


def point_gaps(points: DataFrame, key: tuple[str, ...] = ("robot_id", "scan_id")) -> DataFrame:
    """Add gap: the distance to the next point of the scan, from the last one to the first."""
    ring = Window.partitionBy(*key).orderBy("beam")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx = F.coalesce(F.lead("x").over(ring), F.first("x").over(whole))
    ny = F.coalesce(F.lead("y").over(ring), F.first("y").over(whole))
    return points.withColumn("gap", g.distance("x", "y", nx, ny))
