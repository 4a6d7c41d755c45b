"""Points to clusters, line fits and segment pairs, all set-based."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..functions import geometry as g
from .ingest import point_gaps


#: What tells a scan from all others: scans are numbered per robot.
SCAN = ("robot_id", "scan_id")
CLUSTER = (*SCAN, "cluster_id")


def breakpoints(points: DataFrame, increment: float, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Add gap, cluster_id and pos: a new cluster starts where the gap reaches ``k * range * increment``.

    The scan is a ring: where the last point also reaches the first, the last cluster comes
    before the first one as its beginning. ``pos`` is the order within a cluster.
    """
    ring = Window.partitionBy(*SCAN).orderBy("beam")
    so_far = ring.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*SCAN)
    breaks = F.when(F.col("gap") >= cfg.k * F.col("range") * increment, 1).otherwise(0)
    cut = point_gaps(points).withColumn("_breaks", breaks)
    chained = cut.withColumn("_c", F.sum("_breaks").over(so_far) - F.col("_breaks"))
    ends = chained.withColumn("_last", F.max("_c").over(whole)).withColumn("_closed", F.max(F.struct("beam", "_breaks")).over(whole)["_breaks"] == 0)
    ahead = F.col("_closed") & (F.col("_c") == F.col("_last"))
    found = ends.withColumn("cluster_id", F.when(ahead, 0).otherwise(F.col("_c")).cast("int"))
    return found.withColumn("pos", F.when(ahead & (F.col("_last") > 0), F.col("beam") - (1 << 20)).otherwise(F.col("beam"))).drop("_breaks", "_c", "_last", "_closed")


def cluster_stats(clustered: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """n, mean inner gap and status of each cluster: residual (2 points or fewer, or too few for a seed), dropped (sparse) or line."""
    order = Window.partitionBy(*CLUSTER).orderBy("pos")
    inner = clustered.withColumn("_in", g.distance("x", "y", F.lead("x").over(order), F.lead("y").over(order)))
    stats = inner.groupBy(*CLUSTER).agg(F.count("*").alias("n"), F.avg("_in").alias("mean_gap"))
    status = F.when(F.col("n") <= 2, "residual").when(F.col("mean_gap") > cfg.sparse_gap, "dropped").when(F.col("n") < cfg.line_seed_points, "residual").otherwise("line")
    return stats.withColumn("status", status)


def ring_pass(clustered: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """The clustered points with a status, after kept clusters that follow one another closely are joined.

    Kept are clusters of more than two points that are not sparse. Along the ring, each whose
    end lies within ``remerge_gap`` of the next one's start continues in it; a chain has the
    number of its first cluster, one that closes the ring that of the ring's first. Joined
    clusters of too few points for a seed are residual.
    """
    ends = clustered.groupBy(*CLUSTER).agg(F.min(F.struct("pos", "x", "y")).alias("_a"), F.max(F.struct("pos", "x", "y")).alias("_b"))
    kept = cluster_stats(clustered, cfg).where("n > 2 AND status != 'dropped'").select(*CLUSTER).join(ends, list(CLUSTER))
    ring = Window.partitionBy(*SCAN).orderBy("cluster_id")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = F.coalesce(F.lead("_a").over(ring), F.first("_a").over(whole))
    near = kept.withColumn("_next", follow).withColumn("_joins", (g.distance("_b.x", "_b.y", "_next.x", "_next.y") < cfg.remerge_gap).cast("int"))
    near = near.withColumn("_count", F.count("*").over(whole)).withColumn("_closes", F.last("_joins").over(whole)).withColumn("_starts", F.coalesce(1 - F.lag("_joins").over(ring), F.lit(1)))
    near = near.withColumn("_chain", F.sum("_starts").over(ring.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_chains", F.sum("_starts").over(whole))
    before = (F.col("_closes") == 1) & (F.col("_chain") == F.col("_chains")) & (F.col("_chains") > 1)
    near = near.withColumn("_low", F.min("cluster_id").over(Window.partitionBy(*SCAN, "_chain"))).withColumn("_first", F.first("cluster_id").over(whole))
    into = near.select(*CLUSTER, F.when(before, F.col("_first")).otherwise(F.col("_low")).alias("_into"), before.alias("_before"))
    # clusters of a chain stay in order of their numbers; those before the ring's first come first
    place = F.col("pos").cast("long") + (F.col("cluster_id").cast("long") * 2 + 1 - F.when(F.col("_before"), 1 << 22).otherwise(0)) * (1 << 21)
    moved = clustered.join(into, list(CLUSTER), "left").withColumn("pos", F.coalesce(place, F.col("pos").cast("long"))).withColumn("_kept", F.col("_into").isNotNull())
    moved = moved.withColumn("cluster_id", F.coalesce("_into", "cluster_id"))
    sizes = moved.groupBy(*CLUSTER).agg(F.count("*").alias("_n"), F.max("_kept").alias("_k"))
    old = cluster_stats(clustered, cfg).select(*CLUSTER, F.col("status").alias("_was"))
    status = F.when(~F.col("_k"), F.col("_was")).when(F.col("_n") < cfg.line_seed_points, "residual").otherwise("line")
    return moved.join(sizes, list(CLUSTER)).join(old, list(CLUSTER), "left").withColumn("status", status).drop("_into", "_before", "_kept", "_n", "_k", "_was")


def line_fit(points: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Total least squares line of each group in closed form: n, r, theta in [0, pi), cost (half the squared residuals).

    Only sums are shuffled. A group without a direction of its own (a single or isotropic
    point set) takes theta = pi / 2.
    """
    m = points.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"),
        F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_cxy"),
    )
    theta = 0.5 * F.atan2(2 * F.col("_cxy"), F.col("_vx") - F.col("_vy")) + math.pi / 2
    r, t = g.fold_angle(F.col("_mx") * F.cos("_t") + F.col("_my") * F.sin("_t"), "_t")
    spread = F.sqrt(F.pow(F.col("_vx") - F.col("_vy"), F.lit(2.0)) + 4 * F.col("_cxy") * F.col("_cxy"))
    cost = 0.5 * F.col("n") * (F.col("_vx") + F.col("_vy") - spread) / 2
    return m.withColumn("_t", theta).select(*key, "n", r.alias("r"), t.alias("theta"), F.greatest(cost, F.lit(0.0)).alias("cost"))


def is_line(points: DataFrame, fits: DataFrame, key: tuple[str, ...], cfg: MapConfig = DEFAULT) -> DataFrame:
    """max_residual of each group to its line and whether all points lie within the threshold."""
    joined = points.join(fits.select(*key, "r", "theta"), list(key))
    return joined.groupBy(*key).agg(F.max(g.line_distance("x", "y", "r", "theta")).alias("max_residual")).withColumn("is_line", F.col("max_residual") <= cfg.least_thresh)


def seed_corner(points: DataFrame, key: tuple[str, ...], cfg: MapConfig = DEFAULT) -> DataFrame:
    """Corner of an ordered group: the inner beam farthest from the chord if the mean distance exceeds the threshold, else null."""
    ends = points.groupBy(*key).agg(F.min(F.struct("beam", "x", "y")).alias("_a"), F.max(F.struct("beam", "x", "y")).alias("_b"))
    inner = points.join(ends, list(key)).where((F.col("beam") > F.col("_a.beam")) & (F.col("beam") < F.col("_b.beam")))
    chord = g.distance("_a.x", "_a.y", "_b.x", "_b.y")
    d = F.abs(g.cross("_a.x", "_a.y", "_b.x", "_b.y", "x", "y")) / F.when(chord > 0, chord)
    stats = inner.withColumn("_d", F.coalesce(d, F.lit(0.0))).groupBy(*key).agg(F.avg("_d").alias("mean_sagitta"), F.max(F.struct("_d", (-F.col("beam")).alias("_nb"))).alias("_far"))
    return stats.select(*key, "mean_sagitta", F.when(F.col("mean_sagitta") > cfg.seed_corner, -F.col("_far._nb")).alias("corner_beam"))


def _ends(a: str) -> tuple:
    return tuple(F.col(f"{a}.{c}") for c in ("x1", "y1", "x2", "y2"))


def pairs_within(segments: DataFrame, key: str = "room_id", both: bool = True) -> DataFrame:
    """Pairs p, q (structs) of different segments of one room; ``both``: each order, else p before q.

    A room's lines are few and do not grow with the input, only rooms do. Where a distance
    bounds the pair use ``pairs_near``.
    """
    p = segments.select(F.col(key), F.struct("*").alias("p"))
    q = segments.select(F.col(key), F.struct("*").alias("q"))
    joined = p.join(q, key)
    return joined.where(F.col("p.line_id") != F.col("q.line_id")) if both else joined.where(F.col("p.line_id") < F.col("q.line_id"))


def pairs_near(segments: DataFrame, radius: float, both: bool = True, key: str = "room_id") -> DataFrame:
    """The pairs of ``pairs_within`` that may be within ``radius``: an equi-join on the grid cells of their widened boxes.

    A pair that shares several cells counts in the one where both boxes first overlap.
    """
    size = max(4 * radius, 4.0)
    low = lambda c: F.floor((F.least(f"{c}1", f"{c}2") - radius / 2) / size)
    high = lambda c: F.floor((F.greatest(f"{c}1", f"{c}2") + radius / 2) / size)
    placed = segments.select(F.col(key), F.struct("*").alias("_s"), low("x").alias("_lx"), low("y").alias("_ly"), F.explode(F.sequence(low("x"), high("x"))).alias("_cx"), high("y").alias("_hy"))
    placed = placed.withColumn("_cy", F.explode(F.sequence("_ly", "_hy")))
    side = lambda n: placed.select(key, "_cx", "_cy", F.col("_s").alias(n), F.col("_lx").alias(f"_{n}x"), F.col("_ly").alias(f"_{n}y"))
    first = (F.col("_cx") == F.greatest("_px", "_qx")) & (F.col("_cy") == F.greatest("_py", "_qy"))
    order = F.col("p.line_id") != F.col("q.line_id") if both else F.col("p.line_id") < F.col("q.line_id")
    return side("p").join(side("q"), [key, "_cx", "_cy"]).where(first & order).select(key, "p", "q")


def along_overlap(p: str, q: str):
    """Whether q's interval overlaps p's along p's direction, by the ends as they are ordered."""
    off = lambda a, i, b, j: (F.col(f"{a}.x{i}") - F.col(f"{b}.x{j}")) * F.col(f"{b}.dx") + (F.col(f"{a}.y{i}") - F.col(f"{b}.y{j}")) * F.col(f"{b}.dy")
    one = lambda a, b: F.when(off(b, 1, a, 1) > 0, off(b, 1, a, 2) < 0).otherwise((off(b, 2, a, 1) > 0) & (off(b, 2, a, 2) < 0))
    return one(p, q) | one(q, p)


def overlap_join(segments: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Pairs of lines of a room that show one wall: parallel, same facing, nearer than ``delta_d`` and overlapping."""
    same = (F.col("p.nx") * F.col("q.nx") + F.col("p.ny") * F.col("q.ny")) > 0
    near = g.segments_distance2(_ends("p"), _ends("q")) < cfg.delta_d**2
    found = pairs_near(segments, cfg.delta_d, both=False).where(g.is_parallel("p.theta", "q.theta") & same).where(near).where(along_overlap("p", "q"))
    return found.select("room_id", F.col("p.line_id").alias("p"), F.col("q.line_id").alias("q"))


def line_merge(segments: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Weighted mean line of each group: the mean foot point gives r and theta; the weight is the largest plus one."""
    m = segments.groupBy(*key).agg(
        F.count("*").alias("n_lines"), F.min("line_id").alias("line_id"),
        (F.sum(F.col("weight") * F.col("r") * F.cos("theta")) / F.sum("weight")).alias("_fx"),
        (F.sum(F.col("weight") * F.col("r") * F.sin("theta")) / F.sum("weight")).alias("_fy"),
        (F.max("weight") + 1).alias("weight"),
    )
    r, t = g.fold_angle(F.hypot("_fx", "_fy"), F.atan2("_fy", "_fx"))
    return m.select(*key, "n_lines", "line_id", "weight", r.alias("r"), t.alias("theta"))


def corner_candidates(segments: DataFrame, edges: DataFrame | None = None, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Pairs whose end 2 and end 1 are within the corner threshold, with the point where their lines meet.

    That point must not lie within ``corner_reach`` of either end of q, and p's start and q's
    end must lie on the same side of the other line. Where p has an edge out or q one in, both
    must be on the lines' own sides, and the corner must not compete with that edge: the far
    end of its line must not lie on the same side (a corner edge; of several edges the one to the
    smallest line counts).
    """
    x, y = g.lines_meet("p.r", "p.theta", "q.r", "q.theta")
    gap = g.distance("p.x2", "p.y2", "q.x1", "q.y1")
    met = pairs_near(segments, cfg.corner_thresh).where(gap <= cfg.corner_thresh).withColumn("x", x).withColumn("y", y).where("x IS NOT NULL")
    met = met.where((g.distance("x", "y", "q.x1", "q.y1") >= cfg.corner_reach) & (g.distance("x", "y", "q.x2", "q.y2") >= cfg.corner_reach))
    d1 = g.signed_distance("q.x2", "q.y2", "x", "y", "p.nx", "p.ny")
    d2 = g.signed_distance("p.x1", "p.y1", "x", "y", "q.nx", "q.ny")
    met = met.where(d1 * d2 >= 0)
    if edges is not None:
        s = segments.select(F.col("line_id").alias("_o"), "x1", "y1", "x2", "y2")
        out = edges.groupBy(F.col("src").alias("_p")).agg(F.min(F.struct("dst", "type")).alias("_e")).select("_p", F.col("_e.dst").alias("_o"), F.col("_e.type").alias("_out"))
        into = edges.groupBy(F.col("dst").alias("_q")).agg(F.min(F.struct("src", "type")).alias("_e")).select("_q", F.col("_e.src").alias("_o"), F.col("_e.type").alias("_in"))
        out = out.join(s, "_o", "left").select("_p", "_out", F.col("x2").alias("_ox"), F.col("y2").alias("_oy"))
        into = into.join(s, "_o", "left").select("_q", "_in", F.col("x1").alias("_ix"), F.col("y1").alias("_iy"))
        met = met.join(out, F.col("p.line_id") == F.col("_p"), "left").join(into, F.col("q.line_id") == F.col("_q"), "left")
        free = F.col("_out").isNull() & F.col("_in").isNull()
        competes = lambda kind, ox, oy, of: (F.col(kind) == "corner") & (g.signed_distance(ox, oy, "x", "y", f"{of}.nx", f"{of}.ny") > 0)
        clear = ~F.coalesce(competes("_out", "_ox", "_oy", "p"), F.lit(False)) & ~F.coalesce(competes("_in", "_ix", "_iy", "q"), F.lit(False))
        met = met.where(free | ((d1 >= 0) & (d2 >= 0) & clear))
    return met.select("room_id", F.col("p.line_id").alias("p"), F.col("q.line_id").alias("q"), gap.alias("gap"), "x", "y")


def door_candidates(segments: DataFrame, cfg: MapConfig = DEFAULT, margin: float = 0.7) -> DataFrame:
    """Perpendicular pairs a doorway apart: q wholly on the positive side of p, its centre projecting well inside p."""
    d2 = g.segments_distance2(_ends("p"), _ends("q"))
    side = lambda i: g.signed_distance(f"q.x{i}", f"q.y{i}", "p.x1", "p.y1", "p.nx", "p.ny") > 0
    cx, cy = (F.col("q.x1") + F.col("q.x2")) / 2, (F.col("q.y1") + F.col("q.y2")) / 2
    at = g.signed_distance(cx, cy, "p.x1", "p.y1", "p.dx", "p.dy")
    inside = (at >= margin) & (g.distance("p.x1", "p.y1", "p.x2", "p.y2") - at >= margin)
    wide = (d2 > cfg.door_min**2) & (d2 < cfg.door_max**2)
    found = pairs_near(segments, cfg.door_max).where(g.is_perpendicular("p.theta", "q.theta")).where(side(1) & side(2) & inside).where(wide)
    return found.select("room_id", F.col("p.line_id").alias("p"), F.col("q.line_id").alias("q"), F.sqrt(d2).alias("width"))


def gap_candidates(segments: DataFrame, edges: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Continuations p then q of one wall over a small gap: parallel, same facing, p's end near q's line, p without an edge out and q without one in."""
    ahead = g.signed_distance("q.x1", "q.y1", "p.x2", "p.y2", "p.dx", "p.dy") >= 0
    gap = g.distance("p.x2", "p.y2", "q.x1", "q.y1")
    same = g.is_parallel("p.theta", "q.theta") & (F.col("p.nx") * F.col("q.nx") + F.col("p.ny") * F.col("q.ny") > 0)
    offset = g.line_distance("p.x2", "p.y2", "q.r", "q.theta")
    pairs = pairs_near(segments, cfg.gap_thresh).where(same & ahead & (gap <= cfg.gap_thresh) & (offset <= cfg.delta_d))
    pairs = pairs.select("room_id", F.col("p.line_id").alias("p"), F.col("q.line_id").alias("q"), gap.alias("gap"))
    return pairs.join(edges.select(F.col("src").alias("p")).distinct(), "p", "left_anti").join(edges.select(F.col("dst").alias("q")).distinct(), "q", "left_anti").select("room_id", "p", "q", "gap")


def line_degree(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges in and out of every line."""
    out = edges.groupBy(F.col("src").alias("line_id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("line_id")).agg(F.count("*").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return segments.select("line_id").join(out, "line_id", "left").join(into, "line_id", "left").select("line_id", zero("n_in"), zero("n_out"))


def short_evict(segments: DataFrame, edges: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Short lines that lack an edge in or out; they leave the map and their points are residual again."""
    short = segments.where(g.distance("x1", "y1", "x2", "y2") < cfg.min_line_length).select("line_id")
    return line_degree(short, edges).where("n_in = 0 OR n_out = 0").select("line_id")


def edge_transfer(segments: DataFrame, edges: DataFrame, survivors: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Edges (src, dst) that absorbed lines leave to their survivor (absorbed, survivor).

    Of the edges into absorbed lines a survivor without one takes that of the line whose end
    1 is nearest to its own, within the tolerance; the same for edges out, by end 2.
    """

    def moved(own: str, other: str, end: int) -> DataFrame:
        s = lambda name, k: segments.select(F.col("line_id").alias(name), F.col(f"x{end}").alias(f"{k}x"), F.col(f"y{end}").alias(f"{k}y"))
        have = edges.select(F.col(own).alias("survivor")).distinct()
        rows = edges.select(F.col(own).alias("absorbed"), F.col(other).alias("other")).join(survivors, "absorbed").where("other != survivor").join(have, "survivor", "left_anti")
        rows = rows.join(s("absorbed", "a"), "absorbed").join(s("survivor", "s"), "survivor").withColumn("d", g.distance("ax", "ay", "sx", "sy")).where(F.col("d") < cfg.edge_tolerance)
        return rows.groupBy("survivor").agg(F.min(F.struct("d", "other")).alias("m")).select(F.col("m.other").alias(other), F.col("survivor").alias(own))

    return moved("dst", "src", 1).select("src", "dst").unionByName(moved("src", "dst", 2).select("src", "dst")).distinct()


def keyed_union(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of all tables by key; of rows with one key that of the first table stays (within a table the least row)."""
    ranked = [t.select(F.col(key), F.struct("*").alias("_row"), F.lit(i).alias("_table")) for i, t in enumerate(tables)]
    every = ranked[0]
    for t in ranked[1:]:
        every = every.unionByName(t)
    return every.groupBy(key).agg(F.min(F.struct("_table", "_row")).alias("_m")).select("_m._row.*")


def residual_filter(centroids: DataFrame, segments: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """Clusters whose centroid is not within ``residual_radius`` of a line of their room."""
    near = g.segment_distance2("cx", "cy", "s.x1", "s.y1", "s.x2", "s.y2") <= cfg.residual_radius**2
    s = segments.select(F.col("room_id").alias("_room"), F.struct("x1", "y1", "x2", "y2").alias("s"))
    return centroids.join(s, (F.col("room_id") == F.col("_room")) & near, "left_anti")
