"""Spatial joins of points and segments by grid cells: equi-joins with an exact refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def points_near_segments(points: DataFrame, segments: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """All (point row, s) within ``radius``: points join the cells that a segment's box, widened by the radius, covers.

    A point lies in one cell, so no pair is found twice. ``points`` has x and y; ``s`` is
    the segment as a struct. Skewed cells are left to adaptive skew joins.
    """
    size = cell or max(4 * radius, 0.25)
    span = lambda a, b: F.sequence(_cell(F.least(a, b) - radius, size), _cell(F.greatest(a, b) + radius, size))
    covered = (
        segments.select(F.struct("*").alias("s"))
        .withColumn("_cx", F.explode(span(F.col("s.x1"), F.col("s.x2"))))
        .withColumn("_cy", F.explode(span(F.col("s.y1"), F.col("s.y2"))))
    )
    placed = points.withColumn("_cx", _cell(F.col("x"), size)).withColumn("_cy", _cell(F.col("y"), size))
    joined = placed.join(covered, ["_cx", "_cy"]).withColumn("d2", g.segment_distance2("x", "y", "s.x1", "s.y1", "s.x2", "s.y2"))
    return joined.where(F.col("d2") <= radius * radius).drop("_cx", "_cy")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float = 1.0) -> DataFrame:
    """All (point row, r) with the point in the box r (min_x, min_y, max_x, max_y, borders included), by the cells a box covers."""
    span = lambda low, high: F.explode(F.sequence(_cell(F.col(low), cell), _cell(F.col(high), cell)))
    covered = boxes.select(F.struct("*").alias("r")).withColumn("_cx", span("r.min_x", "r.max_x")).withColumn("_cy", span("r.min_y", "r.max_y"))
    placed = points.withColumn("_cx", _cell(F.col("x"), cell)).withColumn("_cy", _cell(F.col("y"), cell))
    inside = F.col("x").between(F.col("r.min_x"), F.col("r.max_x")) & F.col("y").between(F.col("r.min_y"), F.col("r.max_y"))
    return placed.join(covered, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


#: Sides of the grid cells, coarse to fine, whose short lists of lines points look through.
SIDES = (4.0, 0.5)


def cell_lines(points: DataFrame, segments: DataFrame, key: str = "room_id") -> DataFrame:
    """(key, _cx, _cy, s): for each fine cell that holds points, the lines of its room that can be nearest to any place in it.

    A line is left out if even its least distance to the cell exceeds another line's largest.
    Fine cells choose from the list of the coarse cell around them, so a room's lines are
    compared with its coarse cells only.
    """
    side = SIDES[-1]
    cells = points.select(F.col(key).alias("_key"), _cell(F.col("x"), side).alias("_cx"), _cell(F.col("y"), side).alias("_cy")).distinct()
    lists = segments.select(F.col(key).alias("_of"), F.struct("line_id", "x1", "y1", "x2", "y2", "nx", "ny").alias("s"))
    parents: tuple[str, ...] = ()
    for size in SIDES:
        step = int(size / side)
        at = {"_ux": F.expr(f"floor(_cx / {step})"), "_uy": F.expr(f"floor(_cy / {step})")}
        here = cells.withColumns(at).select("_key", "_ux", "_uy", *([F.expr(f"floor(_cx / {parents[0]})").alias("_px"), F.expr(f"floor(_cy / {parents[0]})").alias("_py")] if parents else [])).distinct()
        on = F.col("_key") == F.col("_of")
        if parents:
            on = on & (F.col("_px") == F.col("_lx")) & (F.col("_py") == F.col("_ly"))
        middle = [(F.col(c) + 0.5) * size for c in ("_ux", "_uy")]
        d = F.sqrt(g.segment_distance2(*middle, "s.x1", "s.y1", "s.x2", "s.y2"))
        if parents:  # a fine cell's lines are met where their coarse cell is: by both, none of the pairs is shuffled
            met = here.join(lists, on).select("_key", "_px", "_py", "_ux", "_uy", "s", d.alias("_d"))
            near = met.withColumn("_best", F.min("_d").over(Window.partitionBy("_key", "_px", "_py", "_ux", "_uy")))
        else:
            met = here.join(lists, on).select("_key", "_ux", "_uy", "s", d.alias("_d"))
            best = met.groupBy("_key", "_ux", "_uy").agg(F.min("_d").alias("_best"))
            near = met.join(best, ["_key", "_ux", "_uy"])
        near = near.where(F.col("_d") <= F.col("_best") + size * 2**0.5 + 1e-4)  # twice half the diagonal
        lists, parents = near.select(F.col("_key").alias("_of"), F.col("_ux").alias("_lx"), F.col("_uy").alias("_ly"), "s"), (str(step),)
    return lists.select(F.col("_of").alias(key), F.col("_lx").alias("_cx"), F.col("_ly").alias("_cy"), "s")


def nearest_in_room(points: DataFrame, segments: DataFrame, by: tuple[str, ...], key: str = "room_id", digits: int | None = 9) -> DataFrame:
    """``by``, d2, line_id, positive of the nearest line of the key's room for each point (x, y); ties go to the smaller number.

    A point meets the short list of its cell (``cell_lines``), two or three lines as a rule.
    Squared distances are compared at ``digits`` decimals, so that rounding does not decide
    ties. ``positive``: the point lies on the line's side.
    """
    lists = cell_lines(points, segments, key)
    placed = points.select(key, *[c for c in by if c != key], "x", "y").withColumn("_cx", _cell(F.col("x"), SIDES[-1])).withColumn("_cy", _cell(F.col("y"), SIDES[-1]))
    d2 = g.segment_distance2("x", "y", "s.x1", "s.y1", "s.x2", "s.y2")
    side = g.signed_distance("x", "y", "s.x1", "s.y1", "s.nx", "s.ny") > 0
    met = placed.join(lists, [key, "_cx", "_cy"]).select(*by, F.struct((d2 if digits is None else F.round(d2, digits)).alias("d2"), F.col("s.line_id").alias("line_id"), side.alias("positive")).alias("_m"))
    return met.groupBy(*by).agg(F.min("_m").alias("_m")).select(*by, "_m.d2", "_m.line_id", "_m.positive")


def nearest_segment(points: DataFrame, segments: DataFrame, key: str = "room_id", by: tuple[str, ...] = ("point_id",), digits: int = 9) -> DataFrame:
    """Per point the nearest line of its room, the distance and the side."""
    near = nearest_in_room(points, segments, by, key, digits)
    return near.select(*by, "line_id", F.sqrt("d2").alias("distance"), "positive")
