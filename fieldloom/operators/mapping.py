"""The robot's line map: one step per segment, the same for batches and streams."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..sources.staging import materialize
from .maintain import mutual_best
from .spatial import points_near_segments

#: A line of the map: end points, normal, weight.
LINE = ["x1", "y1", "x2", "y2", "nx", "ny", "weight"]
MAP = "robot_id string, line_id int, x1 double, y1 double, x2 double, y2 double, nx double, ny double, weight double, r double, theta double, last_scan long"


def _point_gap(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    n = (b - a) @ (b - a)
    t = np.clip((p - a) @ (b - a) / n, 0, 1) if n > 0 else 0.0
    return float(np.hypot(*(p - a - t * (b - a))))


def same_wall(p: np.ndarray, q: np.ndarray, cfg: MapConfig) -> bool:
    """Parallel, same facing, nearer than ``delta_d`` (crossing lines are) and overlapping along p."""
    a, b, c, d = p[0:2], p[2:4], q[0:2], q[2:4]
    u = (b - a) / max(np.hypot(*(b - a)), 1e-12)
    w = (d - c) / max(np.hypot(*(d - c)), 1e-12)
    if abs(u @ w) < np.cos(np.pi / 5) or p[4:6] @ q[4:6] <= 0:
        return False
    low, high = sorted(((c - a) @ u, (d - a) @ u))
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    crossing = turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
    near = 0.0 if crossing else min(_point_gap(c, a, b), _point_gap(d, a, b), _point_gap(a, c, d), _point_gap(b, c, d))
    return low < np.hypot(*(b - a)) and high > 0 and near < cfg.delta_d


def merge_lines(lines: np.ndarray) -> np.ndarray:
    """One line: direction and offset by weight, ends where the parts reach farthest, weight the largest plus one."""
    w = lines[:, 6]
    first = lines[0, 2:4] - lines[0, 0:2]
    dirs = lines[:, 2:4] - lines[:, 0:2]
    dirs = dirs / np.maximum(np.hypot(*dirs.T), 1e-12)[:, None]
    dirs *= np.where(dirs @ first < 0, -1, 1)[:, None]
    u = (w[:, None] * dirs).sum(0)
    u /= np.hypot(*u)
    mid = (w[:, None] * (lines[:, 0:2] + lines[:, 2:4]) / 2).sum(0) / w.sum()
    at = np.concatenate(((lines[:, 0:2] - mid) @ u, (lines[:, 2:4] - mid) @ u))
    n = np.array([-u[1], u[0]])
    n = n if n @ lines[0, 4:6] >= 0 else -n
    return np.concatenate((mid + at.min() * u, mid + at.max() * u, n, [w.max() + 1]))


class LineMap:
    """A robot's lines by number, with the grid cells of their boxes, so that a segment meets the lines around it only.

    A line lies in the cells of the level whose side is at least its box's, four at most.
    """

    def __init__(self, lines: dict[int, np.ndarray] | None = None, cfg: MapConfig = DEFAULT) -> None:
        self.cfg, self.lines, self._boxes = cfg, {}, {}
        self._levels: dict[int, dict[tuple[int, int], set[int]]] = {}
        for k, s in (lines or {}).items():
            self._put(k, s)
        self._top = [-k for k in self.lines]
        heapq.heapify(self._top)

    def _homes(self, s: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
        low, high = np.minimum(s[0:2], s[2:4]), np.maximum(s[0:2], s[2:4])
        if not np.isfinite(high - low).all():
            return 0, []
        level = max(int(np.ceil(np.log2(max((high - low).max(), 1.0)))), 0)
        (i, j), (m, n) = np.floor(low / 2.0**level).astype(int), np.floor(high / 2.0**level).astype(int)
        return level, [(x, y) for x in range(i, m + 1) for y in range(j, n + 1)]

    def _put(self, k: int, s: np.ndarray) -> None:
        self.lines[k], self._boxes[k] = s, (min(s[0], s[2]), min(s[1], s[3]), max(s[0], s[2]), max(s[1], s[3]))
        level, homes = self._homes(s)
        for c in homes:
            self._levels.setdefault(level, {}).setdefault(c, set()).add(k)

    def _take(self, k: int) -> np.ndarray:
        s = self.lines.pop(k)
        level, homes = self._homes(s)
        for c in homes:
            held = self._levels[level][c]
            held.discard(k)
            if not held:
                del self._levels[level][c]
        return s

    def _around(self, s: np.ndarray) -> list[int]:
        """Numbers, in order, of the lines whose boxes can be within ``delta_d`` of the segment's."""
        reach = self.cfg.delta_d + 1e-6
        low, high = np.minimum(s[0:2], s[2:4]) - reach, np.maximum(s[0:2], s[2:4]) + reach
        if not np.isfinite(high - low).all():
            return []
        found: set[int] = set()
        for level, cells in self._levels.items():
            (i, j), (m, n) = np.floor(low / 2.0**level).astype(int), np.floor(high / 2.0**level).astype(int)
            if (m - i + 1) * (n - j + 1) > len(cells):  # a long segment over few cells
                here = [c for c in cells if i <= c[0] <= m and j <= c[1] <= n]
            else:
                here = [(x, y) for x in range(i, m + 1) for y in range(j, n + 1)]
            for c in here:
                found |= cells.get(c, set())
        meets = lambda b: b[0] <= high[0] and b[1] <= high[1] and b[2] >= low[0] and b[3] >= low[1]
        return sorted(k for k in found if meets(self._boxes[k]))

    def add(self, s: np.ndarray) -> None:
        """A segment merges into the lines that show the same wall, or is added.

        The survivor keeps the smallest number; a new line has the one after the largest.
        """
        same = [k for k in self._around(s) if same_wall(self.lines[k], s, self.cfg)]
        if same:
            self._put(same[0], merge_lines(np.array([*(self._take(k) for k in same), s])))
            return
        while self._top and -self._top[0] not in self.lines:
            heapq.heappop(self._top)
        number = 1 - self._top[0] if self._top else 0
        heapq.heappush(self._top, -number)
        self._put(number, s)


def as_rows(robot: str, state: dict[int, np.ndarray], last: int) -> pd.DataFrame:
    rows = []
    for k, s in sorted(state.items()):
        t = float(np.arctan2(s[0] - s[2], s[3] - s[1]))
        r = float(s[0] * np.cos(t) + s[1] * np.sin(t))
        r, t = (-r, t + np.pi) if t < 0 else (r, t)
        rows.append((robot, k, *map(float, s), r, t, last))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MAP.split(", ")])


def build_map(segments: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """The final line map of every robot from its scans' segments (robot_id, scan_id, line_id and ``LINE``).

    Order matters within a robot only: its segments pass in order through one task, which
    holds a batch of them and the map, never all. A segment meets the lines around it, not the
    whole map.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        robot, scan, held = None, -1, LineMap(cfg=cfg)
        for b in batches:
            for r, at, *line in zip(b["robot_id"], b["scan_id"], *(b[c] for c in LINE), strict=True):
                if r != robot and robot is not None:
                    yield as_rows(robot, held.lines, scan)
                    held = LineMap(cfg=cfg)
                robot, scan = r, int(at)
                held.add(np.array(line, float))
        if robot is not None:
            yield as_rows(robot, held.lines, scan)

    ordered = segments.select(F.col("robot_id").cast("string").alias("robot_id"), "scan_id", "line_id", *LINE).where("robot_id IS NOT NULL")
    return ordered.repartition("robot_id").sortWithinPartitions("robot_id", "scan_id", "line_id").mapInPandas(run, MAP)


def map_lines_of(segments: DataFrame, lines: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """(robot_id, segment, line_id): the robot's map line that shows a segment's wall: parallel, same facing, nearest to its centre (ties: the smaller)."""
    mid = segments.select("robot_id", F.col("line_id").alias("segment"), "nx", "ny", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    near = points_near_segments(mid, lines.select("robot_id", "line_id", "x1", "y1", "x2", "y2", "nx", "ny"), 2 * cfg.delta_d).where(F.col("robot_id") == F.col("s.robot_id"))
    same = near.where(F.col("nx") * F.col("s.nx") + F.col("ny") * F.col("s.ny") > np.cos(np.pi / 5))
    return same.groupBy("robot_id", "segment").agg(F.min(F.struct("d2", "s.line_id"))["line_id"].alias("line_id"))


def line_graph(chains: DataFrame, segments: DataFrame, lines: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """(src, dst, type) between map lines, from the chains of their segments (robot_id, src, dst): for each line the next one that most scans saw, if it is also the other's most frequent (ties: the smaller number)."""
    of = map_lines_of(segments, lines, cfg)
    named = lambda c: of.select("robot_id", F.col("segment").alias(c), F.col("line_id").alias(f"_{c}"))
    seen = chains.join(named("src"), ["robot_id", "src"]).join(named("dst"), ["robot_id", "dst"]).where("_src != _dst")
    counted = materialize(seen.groupBy(F.col("_src").alias("p"), F.col("_dst").alias("q")).agg((-F.count("*")).cast("double").alias("gap")), "line-chains")
    return mutual_best(counted).select(F.col("p").alias("src"), F.col("q").alias("dst"), F.lit("corner").alias("type"))
