"""The visibility graph of a room's lines: continuation edges, sight lines and what occludes them.

Ordered pairs of a room's lines are compared once (``line_pairs``); occlusion is then a join
of pairs of the same first line, so no line is compared with the sight lines of others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..functions import geometry as g
from ..sources.staging import materialize
from .segments import _ends, pairs_near, pairs_within


def with_centres(segments: DataFrame) -> DataFrame:
    """Add centre, the points halfway from it to each end, length and the largest length of the room's lines, before any self join."""
    mid = {"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2}
    s = segments.withColumns(mid | {"len": g.distance("x1", "y1", "x2", "y2")})
    s = s.withColumns({f"{q}{i}": (F.col(f"c{q[1]}") + F.col(f"{q[1]}{i}")) / 2 for q in ("qx", "qy") for i in (1, 2)})
    return s.join(s.groupBy("room_id").agg(F.max("len").alias("max_len")), "room_id")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later filters use: as a generator's result it is not computed anew in each of them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def pair_weight(cfg: MapConfig, near: bool = True) -> Column:
    """Length share, decay by the lines' distance (``near``) and decay by the distance of the poses that saw them."""
    pose2 = F.pow(F.col("p.robot_x") - F.col("q.robot_x"), F.lit(2.0)) + F.pow(F.col("p.robot_y") - F.col("q.robot_y"), F.lit(2.0))
    return g.edge_weight("p.len", "q.len", "p.max_len", F.col("d2") if near else F.lit(0.0), pose2, cfg.gamma_dist, cfg.gamma_rob)


def edge_weights(segments: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Weight of every pair p < q of a room's lines."""
    pairs = once(pairs_within(with_centres(segments), both=False), "d2", g.segments_distance2(_ends("p"), _ends("q")))
    return pairs.select("room_id", F.col("p.line_id").alias("p"), F.col("q.line_id").alias("q"), pair_weight(cfg).alias("weight"))


def _offset(a: str, end: str, b: str, origin: str, along: str) -> Column:
    """Offset of a's point from b's along b's direction (d) or normal (n); points: c (centre), 1 or 2 (ends)."""
    xy = lambda s, p: (f"{s}.cx", f"{s}.cy") if p == "c" else (f"{s}.x{p}", f"{s}.y{p}")
    return g.signed_distance(*xy(a, end), *xy(b, origin), f"{b}.{along}x", f"{b}.{along}y")


def line_pairs(segments: DataFrame, edges: DataFrame | None = None, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Ordered pairs (room_id, p, q as structs, d2) of a room's lines nearer than the cutoff, with what p sees of q.

    linked: an edge of the line graph joins them. goes_on: q continues p's wall or p q's, in
    a door's reach (1: q after p, 2: p after q, else null). ahead: an end of q lies on p's
    side. facing: their centres lie on each other's sides.
    """
    pairs = once(pairs_near(with_centres(segments), cfg.vis_dist_thresh), "d2", g.segments_distance2(_ends("p"), _ends("q"))).where(F.col("d2") < cfg.vis_dist_thresh**2)
    if edges is None:
        pairs = pairs.withColumn("linked", F.lit(False))
    else:
        both = edges.select(F.col("src").alias("_p"), F.col("dst").alias("_q")).unionByName(edges.select(F.col("dst").alias("_p"), F.col("src").alias("_q"))).distinct()
        pairs = pairs.join(both.withColumn("_l", F.lit(True)), (F.col("p.line_id") == F.col("_p")) & (F.col("q.line_id") == F.col("_q")), "left").withColumn("linked", F.coalesce("_l", F.lit(False))).drop("_p", "_q", "_l")
    turn = F.abs(F.col("p.theta") - F.col("q.theta"))
    one_wall = (
        (F.col("d2") <= cfg.door_max**2) & ~F.col("linked") & (F.col("q.nx") * F.col("p.nx") + F.col("q.ny") * F.col("p.ny") >= 0)
        & ((turn < math.pi / 4) | (turn > 3 * math.pi / 4)) & (g.line_distance("p.cx", "p.cy", "q.r", "q.theta") < 0.5)
    )
    order = F.when(_offset("q", "1", "p", "2", "d") > 0, 1).when(_offset("p", "1", "q", "2", "d") > 0, 2)
    pairs = once(pairs, "goes_on", F.when(one_wall, order))
    ahead = (_offset("q", "1", "p", "c", "n") >= 0) | (_offset("q", "2", "p", "c", "n") >= 0)
    facing = (_offset("q", "c", "p", "c", "n") >= 0) & (_offset("p", "c", "q", "c", "n") >= 0)
    return pairs.select("*", F.explode(F.array(F.struct(ahead.alias("ahead"), facing.alias("facing")))).alias("_s")).select("*", "_s.*").drop("_s")


def continuations(pairs: DataFrame, segments: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(room_id, a, b, free): line b continues line a. Not free if a's next or b's previous line bends to their own side; the latter decides if both exist.

    Of several edges at an end the one with the smallest line counts.
    """
    ordered = lambda i, j: (F.when(F.col("goes_on") == 1, F.col(f"{i}.line_id")).otherwise(F.col(f"{j}.line_id")))
    found = pairs.where("goes_on IS NOT NULL").select("room_id", ordered("p", "q").alias("a"), ordered("q", "p").alias("b")).distinct()
    if edges is None:
        return found.withColumn("free", F.lit(True))
    s = segments.select("line_id", "x1", "y1", "x2", "y2", "nx", "ny")
    own = lambda c, k: s.select(F.col("line_id").alias(c), *[F.col(x).alias(f"{k}_{x}") for x in s.columns[1:]])
    after = edges.groupBy(F.col("src").alias("a")).agg(F.min("dst").alias("o")).join(own("o", "o"), "o").join(own("a", "a"), "a")
    after = after.select("a", (g.signed_distance("o_x2", "o_y2", "a_x2", "a_y2", "a_nx", "a_ny") < 0).alias("after"))
    before = edges.groupBy(F.col("dst").alias("b")).agg(F.min("src").alias("o")).join(own("o", "o"), "o").join(own("b", "b"), "b")
    before = before.select("b", (g.signed_distance("o_x1", "o_y1", "b_x1", "b_y1", "b_nx", "b_ny") < 0).alias("before"))
    return found.join(after, "a", "left").join(before, "b", "left").select("room_id", "a", "b", F.coalesce("before", "after", F.lit(True)).alias("free"))


def occluded(pairs: DataFrame) -> DataFrame:
    """Views (room_id, p, q) of ``line_pairs`` in which a line ahead of p and nearer to it than q crosses one of three sight lines.

    Sight lines: between the centres, and from each quarter point of q to the opposite one of p.
    """
    view = pairs.where("facing AND NOT linked AND goes_on IS NULL").select("room_id", F.col("p.line_id").alias("a"), "p", "q", "d2")
    over = pairs.where("ahead AND goes_on IS NULL").select(F.col("room_id").alias("_room"), F.col("p.line_id").alias("_a"), F.struct("q.line_id", "q.x1", "q.y1", "q.x2", "q.y2").alias("o"), F.col("d2").alias("_d2"))
    sights = [tuple(F.col(c) for c in ends) for ends in (("p.cx", "p.cy", "q.cx", "q.cy"), ("q.qx1", "q.qy1", "p.qx2", "p.qy2"), ("q.qx2", "q.qy2", "p.qx1", "p.qy1"))]
    crosses = g.intersects(sights[0], _ends("o")) | g.intersects(sights[1], _ends("o")) | g.intersects(sights[2], _ends("o"))
    near = (F.col("room_id") == F.col("_room")) & (F.col("a") == F.col("_a")) & (F.col("_d2") < F.col("d2")) & (F.col("o.line_id") != F.col("q.line_id"))
    return view.join(over, near & crosses, "left_semi").select("room_id", F.col("a").alias("p"), F.col("q.line_id").alias("q"))


def visibility_edges(segments: DataFrame, edges: DataFrame | None = None, cfg: MapConfig = DEFAULT) -> DataFrame:
    """room_id, p, q (p < q), weight, kind of the visibility graph.

    kind line: edges of the line graph (src, dst) between lines of the room, weighted without
    distance. continuation: weight 1. sight: two facing lines of which one sees the other.
    An earlier kind comes first where several hold.
    """
    low, high = F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")
    pairs = materialize(line_pairs(segments, edges, cfg), "line-pairs")  # used four times
    flat = lambda df, weight, kind: df.select("room_id", F.col("p.line_id").alias("p"), F.col("q.line_id").alias("q"), weight.alias("weight"), F.lit(kind).alias("kind"))
    seen = flat(pairs.where("facing AND NOT linked AND goes_on IS NULL"), pair_weight(cfg), 2).join(occluded(pairs), ["room_id", "p", "q"], "left_anti")
    on = continuations(pairs, segments, edges).where("free").select("room_id", F.col("a").alias("p"), F.col("b").alias("q"), F.lit(1.0).alias("weight"), F.lit(1).alias("kind"))
    found = seen.unionByName(on)
    if edges is not None:
        s = with_centres(segments)
        of = lambda c: s.select(F.col("line_id").alias(f"_{c}"), F.struct("*").alias(c))
        linked = edges.select(F.col("src").alias("_p"), F.col("dst").alias("_q")).join(of("p"), "_p").join(of("q"), "_q").where(F.col("p.room_id") == F.col("q.room_id"))
        found = found.unionByName(flat(linked.select(F.col("p.room_id").alias("room_id"), "p", "q"), pair_weight(cfg, False), 0))
    first = found.select("room_id", low, high, "weight", "kind").groupBy("room_id", "p", "q").agg(F.min(F.struct("kind", "weight")).alias("m"))
    kind = F.element_at(F.array(F.lit("line"), F.lit("continuation"), F.lit("sight")), F.col("m.kind") + 1)
    return first.select("room_id", "p", "q", F.col("m.weight").alias("weight"), kind.alias("kind"))
