"""Room-level joins and aggregates: visibility, labels, boxes, assignment."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.staging import materialize
from .spatial import nearest_in_room, points_in_boxes


def local_lines(lines: DataFrame, room_edges: DataFrame) -> DataFrame:
    """(room_id, line_id): lines of each room and of the rooms next to it."""
    near = room_edges.select(F.col("a").alias("room_id"), F.col("b").alias("of")).unionByName(room_edges.select(F.col("b").alias("room_id"), F.col("a").alias("of")))
    own = lines.select("room_id", "line_id")
    return own.unionByName(near.join(own.select(F.col("room_id").alias("of"), "line_id"), "of").select("room_id", "line_id")).distinct()


def label_contingency(labels: DataFrame) -> DataFrame:
    """Old by new label: number of lines and their mean age, (largest line id + 1) - line id."""
    top = labels.agg((F.max("line_id") + 1).alias("_next"))
    aged = labels.join(F.broadcast(top))  # one row
    return aged.groupBy("old", "new").agg(F.count("*").alias("n"), F.avg(F.col("_next") - F.col("line_id")).alias("age"))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("old").agg(F.count("*").alias("n_lines"), F.countDistinct("new").alias("n_new"))


def missing_label(labels: DataFrame, column: str = "new") -> DataFrame:
    """The smallest label from 0 on that is not in use (the largest plus one if there is no gap).

    A free label is 0 or follows a used one, so used labels and their successors suffice.
    """
    used = labels.select(F.col(column).alias("label")).distinct()
    after = used.select((F.col("label") + 1).alias("label")).unionByName(used.sparkSession.range(1).select(F.lit(0).cast("int").alias("label"))).where("label >= 0")
    return after.join(used, "label", "left_anti").agg(F.min("label").alias("label"))


def absorb_singletons(lines: DataFrame, room_edges: DataFrame) -> DataFrame:
    """(room_id, into): rooms of a single line and the neighbour of closest label (ties: the smaller)."""
    alone = lines.groupBy("room_id").agg(F.count("*").alias("n")).where("n = 1").select("room_id")
    near = room_edges.select(F.col("a").alias("room_id"), F.col("b").alias("into")).unionByName(room_edges.select(F.col("b").alias("room_id"), F.col("a").alias("into")))
    best = alone.join(near, "room_id").groupBy("room_id").agg(F.min(F.struct(F.abs(F.col("room_id") - F.col("into")).alias("d"), "into")).alias("m"))
    return best.select("room_id", F.col("m.into").alias("into"))


def room_rect(segments: DataFrame) -> DataFrame:
    """Box and length-weighted centroid of each room's lines."""
    n = g.distance("x1", "y1", "x2", "y2")
    mid = lambda c: F.sum(n * (F.col(f"{c}1") + F.col(f"{c}2")) / 2) / F.sum(n)
    return segments.groupBy("room_id").agg(
        F.min(F.least("x1", "x2")).alias("min_x"), F.min(F.least("y1", "y2")).alias("min_y"),
        F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"),
        mid("x").alias("cx"), mid("y").alias("cy"),
    )


def room_changes(labels: DataFrame) -> DataFrame:
    """(from_room, to_room, kind, n_lines): new_room if the target did not exist, merged_rooms if the source is gone, else moved_lines."""
    old = labels.select(F.col("old").alias("to_room")).distinct().withColumn("_was", F.lit(True))
    new = labels.select(F.col("new").alias("from_room")).distinct().withColumn("_is", F.lit(True))
    moved = labels.where("old != new").groupBy(F.col("old").alias("from_room"), F.col("new").alias("to_room")).agg(F.count("*").alias("n_lines"))
    kind = F.when(F.col("_was").isNull(), "new_room").when(F.col("_is").isNull(), "merged_rooms").otherwise("moved_lines")
    return moved.join(old, "to_room", "left").join(new, "from_room", "left").select("from_room", "to_room", kind.alias("kind"), "n_lines")


def rewire(room_edges: DataFrame, changes: DataFrame, boundary: DataFrame) -> DataFrame:
    """Room edges (a < b) after changes (from_room, to_room, kind), as a contraction of the graph.

    A new room is linked with the rooms it comes from and with those that its lines see
    (``boundary``: room, neighbour); the latter lose their link with the room it comes from. A
    merged room hands its links over to the room that takes it.
    """
    new = changes.where("kind = 'new_room'").select(F.col("from_room").alias("_of"), F.col("to_room").alias("room")).distinct()
    near = boundary.join(new, "room").where("neighbour != _of AND neighbour != room")
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    cut = near.select(*pair("neighbour", "_of")).join(new.select(*pair("room", "_of")), ["a", "b"], "left_anti").distinct()
    kept = room_edges.select(*pair("a", "b")).join(cut, ["a", "b"], "left_anti")
    every = kept.unionByName(new.select(*pair("room", "_of"))).unionByName(near.select(*pair("room", "neighbour")))
    into = changes.where("kind = 'merged_rooms'").groupBy(F.col("from_room").alias("_gone")).agg(F.min("to_room").alias("_into"))
    for end in ("a", "b"):
        every = every.join(into, F.col(end) == F.col("_gone"), "left").withColumn(end, F.coalesce("_into", end)).drop("_gone", "_into")
    return every.where("a != b").select(*pair("a", "b")).distinct()


def room_transitions(visits: DataFrame) -> DataFrame:
    """Distinct pairs a < b of rooms that a robot enters one after the other (robot_id, scan_id, room_id)."""
    before = F.lag("room_id").over(Window.partitionBy("robot_id").orderBy("scan_id"))
    moves = visits.withColumn("_b", before).where(F.col("_b").isNotNull() & (F.col("_b") != F.col("room_id")))
    return moves.select(F.least("_b", "room_id").alias("a"), F.greatest("_b", "room_id").alias("b")).distinct()


def in_rect(x: str, y: str, r: str) -> Column:
    return F.col(x).between(F.col(f"{r}.min_x"), F.col(f"{r}.max_x")) & F.col(y).between(F.col(f"{r}.min_y"), F.col(f"{r}.max_y"))


def _near_boxes(placed: DataFrame, reach: DataFrame, k: int, share: int) -> DataFrame:
    """(point_id, room_id, d2): for every point those of its cell's boxes (_cx, _cy) that can be among the k nearest.

    Points and boxes of a cell are dealt into parts of about ``share``; a task compares one
    part of either and leaves some k boxes a point, so that no task holds a whole cell and no
    pairs are sorted or shuffled.
    """
    on = ["_cx", "_cy"]
    count = lambda df, n: df.groupBy(*on).agg(F.ceil(F.count("*") / share).cast("int").alias(n))
    parts = materialize(count(placed, "_np").join(count(reach, "_nb"), on), "knn-parts")
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = placed.join(parts, on).select(*on, own("point_id", "_np").alias("_p"), each("_nb").alias("_b"), "point_id", "x", "y")
    b = reach.join(parts, on).select(*on, each("_np").alias("_p"), own("room_id", "_nb").alias("_b"), "room_id", "min_x", "min_y", "max_x", "max_y")

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("room_id", ignore_index=True)
        low_x, low_y, high_x, high_y = (r[c].to_numpy(float) for c in ("min_x", "min_y", "max_x", "max_y"))
        found = [pd.DataFrame({"point_id": q["point_id"][:0], "room_id": r["room_id"][:0], "d2": np.zeros(0)})]
        for at in range(0, len(q) if len(r) else 0, 256):
            x, y = (q[c].to_numpy(float)[at : at + 256, None] for c in "xy")
            d2 = np.maximum(np.maximum(low_x - x, x - high_x), 0.0) ** 2 + np.maximum(np.maximum(low_y - y, y - high_y), 0.0) ** 2
            kth = np.partition(d2, min(k, len(r)) - 1, axis=1)[:, min(k, len(r)) - 1]
            i, j = np.nonzero(d2 <= (kth * (1 + 1e-12) + 2e-9)[:, None])  # squares that may be equal at nine decimals
            rows = pd.DataFrame({"i": i, "d2": d2[i, j], "j": j}).groupby(["i", "d2"]).head(k)
            found.append(pd.DataFrame({"point_id": q["point_id"].to_numpy()[at + rows["i"]], "room_id": r["room_id"].to_numpy()[rows["j"]], "d2": rows["d2"].to_numpy()}))
        return pd.concat(found, ignore_index=True)

    kind = lambda df, c: f"{c} {df.schema[c].dataType.simpleString()}"
    key = [*on, "_p", "_b"]
    return p.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(run, f"{kind(placed, 'point_id')}, {kind(reach, 'room_id')}, d2 double")


def knn_rooms(points: DataFrame, rooms: DataFrame, k: int = 2, cell: float = 4.0, share: int = 4096) -> DataFrame:
    """The k nearest room boxes of every point, by distance (at nine decimals of its square) and then number.

    Boxes are looked for in the grid cell of the point and the eight around it. A point whose
    k-th box found lies within one cell's width is done, as no other box can be nearer; the
    others take cells four times as wide, until these span everything. ``share``: the points
    and boxes that one task compares (``_near_boxes``).
    """
    k = min(k, rooms.limit(k).count())
    bounds = rooms.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    spread = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if not k or spread[0] is None:
        return points.where("false").select("point_id", F.lit(0).alias("rank"), F.lit(0).alias("room_id"), F.lit(0.0).alias("distance"))
    extent = max(max(bounds[i + 2], spread[i + 2]) - min(bounds[i], spread[i]) for i in (0, 1))
    left, found = points.select("point_id", "x", "y"), []
    while True:
        at = lambda c: F.floor(F.col(c) / cell)  # noqa: E731, B023
        span = lambda c: F.explode(F.sequence(F.floor(F.col(f"min_{c}") / cell) - 1, F.floor(F.col(f"max_{c}") / cell) + 1))  # noqa: E731, B023
        reach = rooms.withColumn("_cx", span("x")).withColumn("_cy", span("y"))
        near = _near_boxes(left.withColumn("_cx", at("x")).withColumn("_cy", at("y")), reach, k, share).withColumn("d2", F.round("d2", 9))
        ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy("point_id").orderBy("d2", "room_id"))).where(F.col("_k") <= k)
        ranked = materialize(ranked.select("point_id", "_k", "room_id", "d2"), "knn-rooms")
        if cell > extent:
            found.append(ranked)
            break
        done = ranked.where((F.col("_k") == k) & (F.col("d2") <= cell * cell)).select("point_id")
        found.append(ranked.join(done, "point_id", "left_semi"))
        left = materialize(left.join(done, "point_id", "left_anti"), "knn-left")
        if left.isEmpty():
            break
        cell *= 4
    every = reduce(DataFrame.unionByName, found)
    return every.select("point_id", F.col("_k").alias("rank"), "room_id", F.sqrt("d2").alias("distance"))


def _decide(near: DataFrame, one_positive_only: bool) -> DataFrame:
    """The room of each point: nearest among rooms with the point on the positive side, else nearest of all.

    ``one_positive_only``: with several positive rooms the plain nearest decides.
    """
    best = near.groupBy("point_id").agg(
        F.min(F.when(F.col("positive"), F.struct("d2", "room_id"))).alias("_pos"),
        F.min(F.struct("d2", "room_id")).alias("_any"),
        F.count(F.when(F.col("positive"), 1)).alias("_n"),
    )
    use = F.col("_n") == 1 if one_positive_only else F.col("_n") >= 1
    return best.select("point_id", F.when(use, F.col("_pos.room_id")).otherwise(F.col("_any.room_id")).alias("room_id"))


def assign_points(points: DataFrame, rooms: DataFrame, segments: DataFrame, candidates: DataFrame, one_positive_only: bool = False) -> DataFrame:
    """Room of every point (point_id, x, y) among its candidate rooms (point_id, room_id).

    A single box that holds the point decides; otherwise the nearest line per room, with
    its facing side, does. Boxes include their borders.
    """
    held = points.join(candidates, "point_id").join(rooms.select("room_id", F.struct("min_x", "min_y", "max_x", "max_y").alias("r")), "room_id").where(in_rect("x", "y", "r"))
    single = held.groupBy("point_id").agg(F.count("*").alias("n"), F.min("room_id").alias("room_id")).where("n = 1").select("point_id", "room_id")
    rest = points.join(single, "point_id", "left_anti").join(candidates, "point_id")
    return single.unionByName(_decide(nearest_in_room(rest, segments, ("point_id", "room_id")), one_positive_only))


def identify_room(points: DataFrame, rooms: DataFrame, segments: DataFrame) -> DataFrame:
    """Room of every query point: the boxes that hold it, or else its two nearest boxes, are the candidates."""
    inside = points_in_boxes(points, rooms).select("point_id", F.col("r.room_id").alias("room_id"))
    outside = points.join(inside.select("point_id").distinct(), "point_id", "left_anti")
    near = knn_rooms(outside, rooms).select("point_id", "room_id")
    return assign_points(points, rooms, segments, inside.unionByName(near))
