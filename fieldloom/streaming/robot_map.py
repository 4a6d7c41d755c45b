"""Structured Streaming over scans: stateless projection, then keyed state per robot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULT, MapConfig
from ..operators.ingest import scan_to_points
from ..operators.mapping import LINE, MAP, LineMap, as_rows

_GATE = "last_scan long, x double, y double"
_STATE = "last_scan long, ids array<int>, lines array<array<double>>"


def stream_points(scans: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Points of a stream of scans; no state, the batch operator as it is."""
    return scan_to_points(scans, cfg)


def gate_poses(scans: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """(robot_id, scan_id, x, y, late) of scans that pass the displacement gate; the state is the last kept pose.

    Scans of a batch are taken in order; one numbered at or below the last seen is late and
    is reported with late = true instead of changing the state.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, x, y = state.get if state.exists else (-1, None, None)
        out = []
        for s in sorted(r for b in batches for r in b[["scan_id", "x", "y"]].itertuples(index=False, name=None)):
            if s[0] <= last:
                out.append((key[0], *s, True))
                continue
            last = s[0]
            if x is None or np.hypot(s[1] - x, s[2] - y) >= cfg.pose_gate:
                x, y = s[1], s[2]
                out.append((key[0], *s, False))
        state.update((int(last), x, y))
        yield pd.DataFrame(out, columns=["robot_id", "scan_id", "x", "y", "late"])

    poses = scans.select("robot_id", "scan_id", F.col("robot_pose.x").alias("x"), F.col("robot_pose.y").alias("y"))
    return poses.groupBy("robot_id").applyInPandasWithState(run, "robot_id string, scan_id long, x double, y double, late boolean", _GATE, "append", GroupStateTimeout.NoTimeout)


def update_map(segments: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """The line map of every robot after each micro-batch of segments (robot_id, scan_id, line_id and ``LINE``); the state is the map."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ids, lines = state.get if state.exists else (-1, [], [])
        held = LineMap({int(k): np.array(s) for k, s in zip(ids, lines, strict=True)}, cfg)
        new = pd.concat(list(batches))
        for scan, rows in new[new["scan_id"] > last].sort_values(["scan_id", "line_id"]).groupby("scan_id"):
            last = int(scan)
            for line in rows[LINE].to_numpy(float):
                held.add(line)
        state.update((last, list(held.lines), [s.tolist() for s in held.lines.values()]))
        yield as_rows(key[0], held.lines, last)

    return segments.groupBy("robot_id").applyInPandasWithState(run, MAP, _STATE, "update", GroupStateTimeout.NoTimeout)
