"""Farthest ends of groups of lines: convex hulls within tasks, merged, then calipers on the hull."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_END = "x double, y double, line_id long, end int"


def _half(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions of one half of the hull of points in order; points on an edge are no corners."""
    kept: list[int] = []
    for i in range(len(x)):
        while len(kept) > 1 and (x[kept[-1]] - x[kept[-2]]) * (y[i] - y[kept[-2]]) - (y[kept[-1]] - y[kept[-2]]) * (x[i] - x[kept[-2]]) <= 0:
            kept.pop()
        kept.append(i)
    return kept


def hull(ends: pd.DataFrame) -> pd.DataFrame:
    """The ends at the corners of the convex hull, counter-clockwise; of ends at one place the first (by line and end), and the second too if all are at one place."""
    ends = ends.sort_values(["x", "y", "line_id", "end"], kind="stable", ignore_index=True)
    corners = ends.drop_duplicates(["x", "y"], ignore_index=True)
    if len(corners) == 1:
        return ends.head(2)
    x, y = corners["x"].to_numpy(), corners["y"].to_numpy()
    lower, upper = _half(x, y), _half(x[::-1], y[::-1])
    return corners.iloc[lower[:-1] + [len(x) - 1 - i for i in upper[:-1]]]


def antipodes(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of corners between which a hull can be widest: calipers turn once around it."""
    n = len(x)
    if n < 3:
        yield from [(0, n - 1)]
        return
    area = lambda a, b, c: (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
    j = 1
    for i in range(n):
        after = (i + 1) % n
        while area(i, after, (j + 1) % n) > area(i, after, j):
            j = (j + 1) % n
        for far in (j, (j + 1) % n):  # the second where the edges are parallel
            yield from ((i, far), (after, far))


def widest(ends: pd.DataFrame) -> tuple:
    """(left_line, left_end, right_line, right_end, extent) of the farthest two ends; squares equal to nine places tie, to the smaller lines and ends."""
    corners = hull(ends)
    x, y = corners["x"].to_numpy(), corners["y"].to_numpy()
    named = list(zip(corners["line_id"].tolist(), corners["end"].tolist(), strict=True))
    best = None
    for i, j in antipodes(x, y):
        if i != j:
            d2 = round((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2, 9)
            found = (-d2, *min(named[i], named[j]), *max(named[i], named[j]))
            best = found if best is None else min(best, found)
    return (*best[1:], float(np.sqrt(-best[0])))


def farthest_ends(segments: DataFrame, key: str = "room_id") -> DataFrame:
    """(key, left_line, left_end, right_line, right_end, extent): each group's farthest two ends, left before right by line and end.

    Every batch of a task leaves only the corners of its groups' hulls, so a group with a
    third of all lines shuffles some corners a task and no pairs are made; a hull's corners
    are one group. Lines with a null in their ends or number take no part; a null key is a
    group. Repeated rows count once.
    """
    ends = segments.select(key, "line_id", F.explode(F.array(*[F.struct(F.lit(i).alias("end"), F.col(f"x{i}").cast("double").alias("x"), F.col(f"y{i}").cast("double").alias("y")) for i in (1, 2)])).alias("e"))
    ends = ends.where("line_id IS NOT NULL AND e.x IS NOT NULL AND e.y IS NOT NULL").select(key, "e.x", "e.y", F.col("line_id").cast("long").alias("line_id"), "e.end")
    kind = segments.schema[key].dataType.simpleString()

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [hull(g.drop_duplicates()) for _, g in batch.groupby(key, dropna=False)]
            if parts:
                yield pd.concat(parts)

    def across(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group[key].iloc[0], *widest(group.drop_duplicates()))], columns=[key, *names])

    names = ["left_line", "left_end", "right_line", "right_end", "extent"]
    found = ends.mapInPandas(corners, f"{key} {kind}, {_END}").groupBy(key)
    return found.applyInPandas(across, f"{key} {kind}, left_line long, left_end int, right_line long, right_end int, extent double")
