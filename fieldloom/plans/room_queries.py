"""Queries over lines, rooms and graphs, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import changes, field, graph, hulls, rooms, segments, visibility
from ..sources.staging import materialize
from . import views as v
from .point_queries import NEAREST, ORACLE_SQL, QUERIES, query, r6
from .views import d2_sql, ends, meets_sql, q, segd2_sql, side_sql

__all__ = ["ORACLE_SQL", "QUERIES"]
PI = math.pi
PAIRS = "segs p JOIN segs q ON q.room_id = p.room_id AND q.line_id <> p.line_id"
ONCE = "segs p JOIN segs q ON q.room_id = p.room_id AND p.line_id < q.line_id"
LEN = lambda s: f"sqrt(({s}.x2 - {s}.x1) * ({s}.x2 - {s}.x1) + ({s}.y2 - {s}.y1) * ({s}.y2 - {s}.y1))"


@query(f"""SELECT line_id, {q('0.3 * cos(theta) + 0.4 * sin(theta) - r')} AS polar, {q('0.4 * cos(theta) - 0.3 * sin(theta)')} AS jac_theta, {q('abs(0.3 * cos(theta) + 0.4 * sin(theta) - r)')} AS line_dist,
  {q('sqrt(' + d2_sql('0.3', '0.4', 's') + ')')} AS seg_dist, {q('sqrt(' + d2_sql('0.3', '0.4', 's') + ')')} AS overhang, {q(side_sql('0.3', '0.4', 's'))} AS signed_dist,
  {q('0.3 - (0.3 * cos(theta) + 0.4 * sin(theta) - r) * cos(theta)')} AS foot_x, {q('0.4 - (0.3 * cos(theta) + 0.4 * sin(theta) - r) * sin(theta)')} AS foot_y,
  {q('nx')} AS nx, {q('ny')} AS ny, {q('dx')} AS dx, {q('dy')} AS dy, {q('cx')} AS cx, {q('cy')} AS cy, {q('(cx + x1) / 2')} AS quarter_x, {q('r')} AS r, {q('theta')} AS theta,
  CASE WHEN abs(sin(0.5 - theta)) > 1e-12 THEN {q('(r * sin(0.5) - 1.0 * sin(theta)) / sin(0.5 - theta)')} END AS meet_x,
  {q(f'CASE WHEN {PI / 2!r} - atan2(y2 - y1, x2 - x1) < 0 THEN {PI / 2!r} - atan2(y2 - y1, x2 - x1) + {PI!r} WHEN {PI / 2!r} - atan2(y2 - y1, x2 - x1) >= {PI!r} THEN {PI / 2!r} - atan2(y2 - y1, x2 - x1) - {PI!r} ELSE {PI / 2!r} - atan2(y2 - y1, x2 - x1) END')} AS guess_theta
FROM segs s""")
def geometry_scalars(spark, sf_dir):
    e = ("x1", "y1", "x2", "y2")
    fx, fy = g.project(0.3, 0.4, "r", "theta")
    mx, _ = g.lines_meet("r", "theta", 1.0, 0.5)
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    cols = {
        "polar": g.polar(0.3, 0.4, "r", "theta"), "jac_theta": g.polar_gradient_theta(0.3, 0.4, "theta"), "line_dist": g.line_distance(0.3, 0.4, "r", "theta"),
        "seg_dist": F.sqrt(g.segment_distance2(0.3, 0.4, *e)), "overhang": g.overhang_distance(0.3, 0.4, *e), "signed_dist": g.signed_distance(0.3, 0.4, "x1", "y1", "nx", "ny"),
        "foot_x": fx, "foot_y": fy, "nx": F.col("nx"), "ny": F.col("ny"), "dx": F.col("dx"), "dy": F.col("dy"), "cx": cx, "cy": cy, "quarter_x": (cx + F.col("x1")) / 2,
        "r": F.col("r"), "theta": F.col("theta"), "meet_x": mx, "guess_theta": g.line_guess(*e)[1],
    }
    return v.segments(spark, sf_dir).select("line_id", *[r6(c).alias(n) for n, c in cols.items()])


@query(f"""SELECT p.room_id, CASE WHEN abs(p.theta - q.theta) < {PI / 5!r} OR abs(p.theta - q.theta) > {4 * PI / 5!r} THEN 'parallel' WHEN abs(p.theta - q.theta) > {PI / 3!r} AND abs(p.theta - q.theta) < {2 * PI / 3!r} THEN 'perpendicular' ELSE 'oblique' END AS kind,
  p.nx * q.nx + p.ny * q.ny > 0 AS same_facing, count(*) AS n FROM {ONCE} GROUP BY 1, 2, 3""")
def angle_class(spark, sf_dir):
    pairs = segments.pairs_within(v.segments(spark, sf_dir), both=False)
    facing = F.col("p.nx") * F.col("q.nx") + F.col("p.ny") * F.col("q.ny") > 0
    return pairs.groupBy("room_id", g.angle_class("p.theta", "q.theta").alias("kind"), facing.alias("same_facing")).agg(F.count("*").alias("n"))


def _off(a, i, b, j):
    return f"(({a}.x{i} - {b}.x{j}) * {b}.dx + ({a}.y{i} - {b}.y{j}) * {b}.dy)"


def _overlap(a, b):
    return f"(CASE WHEN {_off(b, 1, a, 1)} > 0 THEN {_off(b, 1, a, 2)} < 0 ELSE {_off(b, 2, a, 1)} > 0 AND {_off(b, 2, a, 2)} < 0 END)"


OVERLAP = f"""SELECT p.room_id, p.line_id AS p, q.line_id AS q FROM {ONCE} WHERE (abs(p.theta - q.theta) < {PI / 5!r} OR abs(p.theta - q.theta) > {4 * PI / 5!r})
  AND p.nx * q.nx + p.ny * q.ny > 0 AND {segd2_sql('p', 'q')} < {0.2**2!r} AND ({_overlap('p', 'q')} OR {_overlap('q', 'p')})"""


@query(OVERLAP)
def overlap_join(spark, sf_dir):
    return segments.overlap_join(v.segments(spark, sf_dir))


@query(f""", e AS (SELECT room_id, line_id, 1 AS k, x1 AS x, y1 AS y FROM segs UNION ALL SELECT room_id, line_id, 2, x2, y2 FROM segs
), pair AS (
  SELECT a.room_id, a.line_id AS left_line, a.k AS left_end, b.line_id AS right_line, b.k AS right_end, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9) AS d2
  FROM e a JOIN e b ON a.room_id = b.room_id AND (a.line_id < b.line_id OR (a.line_id = b.line_id AND a.k < b.k))
) SELECT room_id, left_line, CAST(left_end AS INTEGER) AS left_end, right_line, CAST(right_end AS INTEGER) AS right_end, {q('sqrt(d2)')} AS extent FROM pair
QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY d2 DESC, left_line, left_end, right_line, right_end) = 1""")
def merge_extent(spark, sf_dir):
    m = hulls.farthest_ends(v.segments(spark, sf_dir))
    return m.select("room_id", "left_line", "left_end", "right_line", "right_end", r6("extent").alias("extent"))


@query(f""", m AS (SELECT room_id, CAST(floor(theta * 4) AS BIGINT) AS bin, count(*) AS n_lines, min(line_id) AS line_id, CAST(max(weight) + 1 AS INTEGER) AS weight,
  sum(weight * r * cos(theta)) / sum(weight) AS fx, sum(weight * r * sin(theta)) / sum(weight) AS fy FROM segs GROUP BY 1, 2
), f AS (SELECT *, sqrt(fx * fx + fy * fy) AS r0, atan2(fy, fx) AS t0 FROM m)
SELECT room_id, bin, n_lines, line_id, weight, {q(f'CASE WHEN t0 < 0 OR t0 >= {PI!r} THEN -r0 ELSE r0 END')} AS r, {q(f'CASE WHEN t0 < 0 THEN t0 + {PI!r} WHEN t0 >= {PI!r} THEN t0 - {PI!r} ELSE t0 END')} AS theta FROM f""")
def line_merge(spark, sf_dir):
    s = v.segments(spark, sf_dir).withColumn("bin", F.floor(F.col("theta") * 4))
    return segments.line_merge(s, ("room_id", "bin")).select("room_id", "bin", "n_lines", "line_id", "weight", r6("r").alias("r"), r6("theta").alias("theta"))


GAP = "sqrt((q.x1 - p.x2) * (q.x1 - p.x2) + (q.y1 - p.y2) * (q.y1 - p.y2))"
MEETX = "((p.r * sin(q.theta) - q.r * sin(p.theta)) / sin(q.theta - p.theta))"
MEETY = "((q.r * cos(p.theta) - p.r * cos(q.theta)) / sin(q.theta - p.theta))"
CORNERS = f""", met AS (
  SELECT p.room_id, p.line_id AS p, q.line_id AS q, {GAP} AS gap, {MEETX} AS x, {MEETY} AS y, p.x1 AS px1, p.y1 AS py1, q.x1 AS qx1, q.y1 AS qy1, q.x2 AS qx2, q.y2 AS qy2, p.nx AS pnx, p.ny AS pny, q.nx AS qnx, q.ny AS qny
  FROM {PAIRS} WHERE {GAP} <= 0.5 AND abs(sin(q.theta - p.theta)) > 1e-12
), sided AS (
  SELECT *, (qx2 - x) * pnx + (qy2 - y) * pny AS d1, (px1 - x) * qnx + (py1 - y) * qny AS d2 FROM met
  WHERE sqrt((qx1 - x) * (qx1 - x) + (qy1 - y) * (qy1 - y)) >= 0.5 AND sqrt((qx2 - x) * (qx2 - x) + (qy2 - y) * (qy2 - y)) >= 0.5
), nexts AS (SELECT e.src AS p, e.type AS out_type, s.x2 AS ox, s.y2 AS oy FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) = 1) e LEFT JOIN segs s ON s.line_id = e.dst
), befores AS (SELECT e.dst AS q, e.type AS in_type, s.x1 AS ix, s.y1 AS iy FROM (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) = 1) e LEFT JOIN segs s ON s.line_id = e.src
), corners AS (
  SELECT c.* FROM sided c LEFT JOIN nexts n ON n.p = c.p LEFT JOIN befores b ON b.q = c.q
  WHERE d1 * d2 >= 0 AND ((out_type IS NULL AND in_type IS NULL) OR (d1 >= 0 AND d2 >= 0
    AND NOT (coalesce(out_type = 'corner', false) AND coalesce((ox - x) * pnx + (oy - y) * pny > 0, false))
    AND NOT (coalesce(in_type = 'corner', false) AND coalesce((ix - x) * qnx + (iy - y) * qny > 0, false))))
)"""


@query(CORNERS + f" SELECT room_id, p, q, {q('gap')} AS gap, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM corners")
def corner_candidates(spark, sf_dir):
    """Corners at three decimals: where lines meet at a small angle, rounding moves the point."""
    c = segments.corner_candidates(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir))
    return c.select("room_id", "p", "q", r6("gap").alias("gap"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


AT = "(((q.x1 + q.x2) / 2 - p.x1) * p.dx + ((q.y1 + q.y2) / 2 - p.y1) * p.dy)"


@query(f"""SELECT p.room_id, p.line_id AS p, q.line_id AS q, {q('sqrt(' + segd2_sql('p', 'q') + ')')} AS width FROM {PAIRS}
WHERE abs(p.theta - q.theta) > {PI / 3!r} AND abs(p.theta - q.theta) < {2 * PI / 3!r} AND {side_sql('q.x1', 'q.y1', 'p')} > 0 AND {side_sql('q.x2', 'q.y2', 'p')} > 0
  AND {AT} >= 0.7 AND {LEN('p')} - {AT} >= 0.7 AND {segd2_sql('p', 'q')} > {0.8**2!r} AND {segd2_sql('p', 'q')} < 9.0""")
def door_candidates(spark, sf_dir):
    return segments.door_candidates(v.segments(spark, sf_dir)).select("room_id", "p", "q", r6("width").alias("width"))


@query(f"""SELECT p.room_id, p.line_id AS p, q.line_id AS q, {q(GAP)} AS gap FROM {PAIRS}
WHERE ((q.x1 - p.x2) * p.dx + (q.y1 - p.y2) * p.dy) >= 0 AND {GAP} <= 0.5 AND abs(p.x2 * cos(q.theta) + p.y2 * sin(q.theta) - q.r) <= 0.2 AND p.nx * q.nx + p.ny * q.ny > 0 AND (abs(p.theta - q.theta) < {PI / 5!r} OR abs(p.theta - q.theta) > {4 * PI / 5!r})
  AND p.line_id NOT IN (SELECT src FROM edges) AND q.line_id NOT IN (SELECT dst FROM edges)""")
def gap_candidates(spark, sf_dir):
    return segments.gap_candidates(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir)).select("room_id", "p", "q", r6("gap").alias("gap"))


CHANGES = """, log AS (
  SELECT o_orderkey AS seq, o_custkey AS line_id, CASE o_orderkey % 5 WHEN 0 THEN 'remove' WHEN 1 THEN 'insert' ELSE 'move' END AS kind,
    CASE WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 20 AS INTEGER) END AS room_id, CASE WHEN o_orderkey % 5 IN (1, 2) THEN o_orderkey % 97 * 0.1::DOUBLE END AS x1, CASE WHEN o_orderkey % 5 IN (1, 2) THEN o_custkey % 89 * 0.1::DOUBLE END AS y1,
    CASE WHEN o_orderkey % 5 IN (1, 3) THEN o_orderkey % 83 * 0.1::DOUBLE END AS x2, CASE WHEN o_orderkey % 5 IN (1, 3) THEN o_orderkey % 79 * 0.1::DOUBLE END AS y2 FROM orders
), every AS (
  SELECT seq, line_id, kind, room_id, x1, y1, x2, y2 FROM log UNION ALL SELECT -1, line_id, 'insert', room_id, x1, y1, x2, y2 FROM segs
), life AS (
  SELECT line_id, max(seq) AS born FROM every WHERE kind <> 'move' GROUP BY line_id HAVING arg_max(kind, seq) = 'insert'
), now AS (
  SELECT line_id, arg_max(room_id, seq) FILTER (kind = 'insert') AS room_id, arg_max(x1, seq) FILTER (x1 IS NOT NULL) AS x1, arg_max(y1, seq) FILTER (x1 IS NOT NULL) AS y1,
    arg_max(x2, seq) FILTER (x2 IS NOT NULL) AS x2, arg_max(y2, seq) FILTER (x2 IS NOT NULL) AS y2 FROM every JOIN life USING (line_id) WHERE seq >= born GROUP BY line_id
), cut AS (SELECT line_id FROM log WHERE kind = 'remove'
), left_edges AS (SELECT * FROM edges WHERE src NOT IN (FROM cut) AND dst NOT IN (FROM cut))
"""


def _changed(spark, sf_dir):
    """Lines and edges after the orders' changes: removals, inserts, and moves of one end or of none."""
    key, end = F.col("o_orderkey"), lambda kinds, c, n: F.when((F.col("o_orderkey") % 5).isin(kinds), c % n * 0.1)
    kind = F.when(key % 5 == 0, "remove").when(key % 5 == 1, "insert").otherwise("move")
    log = v.table(spark, sf_dir, "orders").select(
        key.alias("seq"), F.col("o_custkey").alias("line_id"), kind.alias("kind"), F.when(key % 5 == 1, (key % 20).cast("int")).alias("room_id"),
        end([1, 2], key, 97).alias("x1"), end([1, 2], F.col("o_custkey"), 89).alias("y1"), end([1, 3], key, 83).alias("x2"), end([1, 3], key, 79).alias("y2"),
    )
    return changes.fold_changes(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir), log)


@query(CHANGES + f"""SELECT line_id, room_id, {q('x1')} AS x1, {q('y1')} AS y1, {q('x2')} AS x2, {q('y2')} AS y2, {q('(x2 - x1) / nullif(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0)')} AS dx,
  (SELECT count(*) FROM left_edges e WHERE e.dst = now.line_id) AS n_in, (SELECT count(*) FROM left_edges e WHERE e.src = now.line_id) AS n_out FROM now""")
def line_changes(spark, sf_dir):
    lines, edges = _changed(spark, sf_dir)
    shown = lines.select("line_id", "room_id", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2", "dx")])
    return shown.join(segments.line_degree(lines, edges), "line_id")


@query(CHANGES + """, had AS (SELECT DISTINCT room_id, line_id FROM segs), has AS (SELECT room_id, line_id FROM now)
SELECT room_id, CAST(sum(is_new) AS BIGINT) AS n_lines, CAST(sum(is_new * (1 - is_old)) AS BIGINT) AS n_added, CAST(sum(is_old * (1 - is_new)) AS BIGINT) AS n_removed
FROM (SELECT room_id, line_id, max(o) AS is_old, max(n) AS is_new FROM (SELECT *, 1 AS o, 0 AS n FROM had UNION ALL SELECT *, 0, 1 FROM has) GROUP BY 1, 2) GROUP BY room_id""")
def room_line_lists(spark, sf_dir):
    return changes.room_changes_of(v.segments(spark, sf_dir), _changed(spark, sf_dir)[0])


@query("SELECT line_id, (SELECT count(*) FROM edges WHERE dst = line_id) AS n_in, (SELECT count(*) FROM edges WHERE src = line_id) AS n_out FROM segs")
def line_degree(spark, sf_dir):
    return segments.line_degree(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir))


@query("SELECT line_id FROM segs WHERE len < 0.5 AND (line_id NOT IN (SELECT src FROM edges) OR line_id NOT IN (SELECT dst FROM edges))")
def short_evict(spark, sf_dir):
    return segments.short_evict(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir))


@query(""", surv AS (SELECT line_id AS absorbed, line_id + 2 - line_id % 3 AS survivor FROM segs WHERE line_id % 3 <> 2 AND line_id + 2 - line_id % 3 IN (SELECT line_id FROM segs)
), ins AS (
  SELECT e.src, u.survivor AS dst, sqrt((s.x1 - a.x1) * (s.x1 - a.x1) + (s.y1 - a.y1) * (s.y1 - a.y1)) AS d FROM edges e JOIN surv u ON e.dst = u.absorbed AND e.src <> u.survivor
  JOIN segs a ON a.line_id = u.absorbed JOIN segs s ON s.line_id = u.survivor WHERE u.survivor NOT IN (SELECT dst FROM edges)
), outs AS (
  SELECT u.survivor AS src, e.dst, sqrt((s.x2 - a.x2) * (s.x2 - a.x2) + (s.y2 - a.y2) * (s.y2 - a.y2)) AS d FROM edges e JOIN surv u ON e.src = u.absorbed AND e.dst <> u.survivor
  JOIN segs a ON a.line_id = u.absorbed JOIN segs s ON s.line_id = u.survivor WHERE u.survivor NOT IN (SELECT src FROM edges)
) SELECT src, dst FROM (SELECT src, dst FROM ins WHERE d < 1.5 QUALIFY row_number() OVER (PARTITION BY dst ORDER BY d, src) = 1)
UNION SELECT src, dst FROM (SELECT src, dst FROM outs WHERE d < 1.5 QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1)""")
def edge_transfer(spark, sf_dir):
    from dataclasses import replace

    from ..config import DEFAULT

    s = v.segments(spark, sf_dir)
    to = s.select("line_id").where("line_id % 3 != 2").select(F.col("line_id").alias("absorbed"), (F.col("line_id") + 2 - F.col("line_id") % 3).alias("survivor"))
    to = to.join(s.select(F.col("line_id").alias("survivor")), "survivor")
    return segments.edge_transfer(s, v.line_edges(spark, sf_dir), to, replace(DEFAULT, edge_tolerance=1.5))


@query("""SELECT point_id, arg_min(origin, k) AS origin, arg_min(x, k) AS x FROM (
  SELECT point_id, 'residual' AS origin, round(x, 6) + 0.0 AS x, 0 AS k FROM pts WHERE beam % 3 = 0 UNION ALL SELECT point_id, 'new', round(2 * x, 6) + 0.0, 1 FROM pts WHERE beam % 2 = 0) GROUP BY point_id""")
def keyed_union(spark, sf_dir):
    p = v.points(spark, sf_dir)
    old = p.where("beam % 3 = 0").select("point_id", F.lit("residual").alias("origin"), r6("x").alias("x"))
    return segments.keyed_union([old, p.where("beam % 2 = 0").select("point_id", F.lit("new").alias("origin"), r6(2 * F.col("x")).alias("x"))], "point_id")


@query("SELECT line_id, room_id, 'local' AS origin FROM segs WHERE line_id % 2 = 0 UNION ALL SELECT line_id, room_id, 'new' FROM segs WHERE line_id % 2 = 1")
def lines_union(spark, sf_dir):
    s = v.segments(spark, sf_dir).select("line_id", "room_id")
    return s.where("line_id % 2 = 0").withColumn("origin", F.lit("local")).unionByName(s.where("line_id % 2 = 1").withColumn("origin", F.lit("new")))


@query("SELECT DISTINCT room_id, line_id FROM (SELECT room_id, line_id FROM segs UNION ALL SELECT e.a, s.line_id FROM both_redges e JOIN segs s ON s.room_id = e.b)")
def local_lines(spark, sf_dir):
    return rooms.local_lines(v.segments(spark, sf_dir), v.room_edges(spark, sf_dir))


def _weight(d2: str) -> str:
    return f"((p.len + q.len) / (2 * m.max_len) * exp(-0.02 * {d2}) * exp(-0.005 * ((p.robot_x - q.robot_x) * (p.robot_x - q.robot_x) + (p.robot_y - q.robot_y) * (p.robot_y - q.robot_y))))"


MAXES = "JOIN (SELECT room_id, max(len) AS max_len FROM segs GROUP BY room_id) m ON m.room_id = p.room_id"


@query(f"SELECT p.room_id, p.line_id AS p, q.line_id AS q, {q(_weight(segd2_sql('p', 'q')))} AS weight FROM {ONCE} {MAXES}")
def edge_weights(spark, sf_dir):
    return visibility.edge_weights(v.segments(spark, sf_dir)).select("room_id", "p", "q", r6("weight").alias("weight"))


QUARTER = lambda s, i: (f"(({s}.cx + {s}.x{i}) / 2)", f"(({s}.cy + {s}.y{i}) / 2)")
TURN = "abs(p.theta - q.theta)"
SIGHTS = " OR ".join(meets_sql(a, ends("o")) for a in (("p.cx", "p.cy", "q.cx", "q.cy"), (*QUARTER("q", 1), *QUARTER("p", 2)), (*QUARTER("q", 2), *QUARTER("p", 1))))
SEEN = f""", both_edges AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges
), dist AS (SELECT p.room_id, p.line_id AS p, q.line_id AS q, {segd2_sql('p', 'q')} AS d2 FROM {PAIRS}
), lp AS (
  SELECT d.room_id, d.p, d.q, d.d2, e.a IS NOT NULL AS linked,
    CASE WHEN d2 <= 9.0 AND e.a IS NULL AND q.nx * p.nx + q.ny * p.ny >= 0 AND ({TURN} < {PI / 4!r} OR {TURN} > {3 * PI / 4!r}) AND abs(p.cx * cos(q.theta) + p.cy * sin(q.theta) - q.r) < 0.5
      THEN CASE WHEN (q.x1 - p.x2) * p.dx + (q.y1 - p.y2) * p.dy > 0 THEN 1 WHEN (p.x1 - q.x2) * q.dx + (p.y1 - q.y2) * q.dy > 0 THEN 2 END END AS goes_on,
    (q.x1 - p.cx) * p.nx + (q.y1 - p.cy) * p.ny >= 0 OR (q.x2 - p.cx) * p.nx + (q.y2 - p.cy) * p.ny >= 0 AS ahead,
    (q.cx - p.cx) * p.nx + (q.cy - p.cy) * p.ny >= 0 AND (p.cx - q.cx) * q.nx + (p.cy - q.cy) * q.ny >= 0 AS facing
  FROM dist d JOIN segs p ON p.line_id = d.p JOIN segs q ON q.line_id = d.q LEFT JOIN both_edges e ON e.a = d.p AND e.b = d.q WHERE d2 < 64.0
), views AS (SELECT * FROM lp WHERE facing AND NOT linked AND goes_on IS NULL
), blocked AS (
  SELECT DISTINCT c.room_id, c.p, c.q FROM views c JOIN lp w ON w.p = c.p AND w.ahead AND w.goes_on IS NULL AND w.d2 < c.d2 AND w.q <> c.q
  JOIN segs p ON p.line_id = c.p JOIN segs q ON q.line_id = c.q JOIN segs o ON o.line_id = w.q WHERE {SIGHTS}
), goes AS (SELECT DISTINCT room_id, CASE WHEN goes_on = 1 THEN p ELSE q END AS a, CASE WHEN goes_on = 1 THEN q ELSE p END AS b FROM lp WHERE goes_on IS NOT NULL
), after_ AS (SELECT e.a, (o.x2 - s.x2) * s.nx + (o.y2 - s.y2) * s.ny < 0 AS free FROM (SELECT src AS a, min(dst) AS o FROM edges GROUP BY src) e JOIN segs s ON s.line_id = e.a JOIN segs o ON o.line_id = e.o
), before_ AS (SELECT e.b, (o.x1 - s.x1) * s.nx + (o.y1 - s.y1) * s.ny < 0 AS free FROM (SELECT dst AS b, min(src) AS o FROM edges GROUP BY dst) e JOIN segs s ON s.line_id = e.b JOIN segs o ON o.line_id = e.o
), free_ AS (SELECT g.room_id, g.a, g.b FROM goes g LEFT JOIN after_ USING (a) LEFT JOIN before_ USING (b) WHERE coalesce(before_.free, after_.free, true)
), kinds AS (
  SELECT c.room_id, c.p, c.q, {_weight('c.d2')} AS weight, 2 AS kind FROM views c JOIN segs p ON p.line_id = c.p JOIN segs q ON q.line_id = c.q {MAXES} WHERE (c.p, c.q) NOT IN (SELECT (p, q) FROM blocked)
  UNION ALL SELECT room_id, a, b, 1.0, 1 FROM free_
  UNION ALL SELECT p.room_id, e.src, e.dst, {_weight('0.0')}, 0 FROM edges e JOIN segs p ON p.line_id = e.src JOIN segs q ON q.line_id = e.dst {MAXES} WHERE p.room_id = q.room_id
), vis AS (
  SELECT room_id, least(p, q) AS p, greatest(p, q) AS q, arg_min(weight, (kind, weight)) AS weight, ['line', 'continuation', 'sight'][min(kind) + 1] AS kind FROM kinds GROUP BY room_id, least(p, q), greatest(p, q)
)"""


def _seen(spark, sf_dir):
    return visibility.visibility_edges(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir))


@query(SEEN + f" SELECT room_id, p, q, {q('weight')} AS weight, kind FROM vis")
def visibility_edges(spark, sf_dir):
    return _seen(spark, sf_dir).select("room_id", "p", "q", r6("weight").alias("weight"), "kind")


@query(SEEN + " SELECT room_id, p, q FROM blocked")
def occlusion(spark, sf_dir):
    return visibility.occluded(materialize(visibility.line_pairs(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir)), "line-pairs"))


COMPONENTS = f""", links AS (SELECT p AS a, q AS b, room_id FROM ({OVERLAP})
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT DISTINCT a AS node, a AS met FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.met
), comp AS (SELECT node, min(met) AS root FROM reach GROUP BY node)"""


@query(COMPONENTS + " SELECT node, root FROM comp")
def components(spark, sf_dir):
    pairs = segments.overlap_join(v.segments(spark, sf_dir))
    return graph.components(pairs.select(F.col("p").alias("a"), F.col("q").alias("b")))


@query(COMPONENTS + """, mem AS (SELECT room_id, node, root FROM comp JOIN segs ON line_id = node
), chain AS (SELECT room_id, root, lead(root) OVER (PARTITION BY room_id ORDER BY root) AS next_root FROM (SELECT DISTINCT room_id, root FROM mem)
), pair AS (SELECT c.room_id, c.root, x.node AS a, y.node AS b FROM chain c JOIN mem x ON x.root = c.root AND x.room_id = c.room_id JOIN mem y ON y.root = c.next_root AND y.room_id = c.room_id)
SELECT room_id, least(a, b) AS p, greatest(a, b) AS q, CAST(1e-10 AS DOUBLE) AS weight FROM pair QUALIFY row_number() OVER (PARTITION BY room_id, root ORDER BY abs(a - b), a, b) = 1""")
def connect_components(spark, sf_dir):
    s = v.segments(spark, sf_dir)
    found = components(spark, sf_dir).join(s.select("room_id", F.col("line_id").alias("node")), "node")
    return graph.connect_components(found)


@query(SEEN + f""", w AS (SELECT room_id, p AS i, q AS j, weight FROM vis UNION ALL SELECT room_id, q, p, weight FROM vis
), deg AS (SELECT room_id, i, sum(weight) AS d FROM w GROUP BY room_id, i)
SELECT w.room_id, w.i, w.j, {q('-weight / sqrt(a.d * b.d)')} AS value FROM w JOIN deg a ON a.room_id = w.room_id AND a.i = w.i JOIN deg b ON b.room_id = w.room_id AND b.i = w.j
UNION ALL SELECT room_id, i, i, 1.0 FROM deg""")
def laplacian(spark, sf_dir):
    return graph.laplacian(materialize(_seen(spark, sf_dir), "visible")).select("room_id", "i", "j", r6("value").alias("value"))


@query(f"SELECT old, new, count(*) AS n, {q('avg((SELECT max(line_id) + 1 FROM labs) - line_id)')} AS age FROM labs GROUP BY old, new")
def label_contingency(spark, sf_dir):
    return rooms.label_contingency(v.labels(spark, sf_dir)).select("old", "new", "n", r6("age").alias("age"))


@query("SELECT old, count(*) AS n_lines, count(DISTINCT new) AS n_new FROM labs GROUP BY old")
def label_counts(spark, sf_dir):
    return rooms.label_counts(v.labels(spark, sf_dir))


@query("SELECT CAST(min(label) AS INTEGER) AS label FROM (SELECT unnest(range(0, 100)) AS label) WHERE label NOT IN (SELECT old FROM labs)")
def missing_label(spark, sf_dir):
    return rooms.missing_label(v.labels(spark, sf_dir), "old").select(F.col("label").cast("int").alias("label"))


@query(""", own AS (SELECT line_id, room_id AS near, CASE WHEN line_id % 13 = 0 THEN 1000000 + line_id ELSE room_id END AS room_id FROM segs
), lone AS (SELECT room_id FROM own GROUP BY room_id HAVING count(*) = 1
), links AS (SELECT a, b FROM both_redges UNION ALL SELECT room_id, near + k FROM own, (SELECT unnest([0, 1]) AS k) WHERE line_id % 13 = 0)
SELECT room_id, b AS "into" FROM lone JOIN links ON a = room_id QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY abs(room_id - b), b) = 1""")
def absorb_singletons(spark, sf_dir):
    """Every thirteenth line has a room of its own, next to the one it lies in and the one after."""
    s = v.segments(spark, sf_dir).select("line_id", F.col("room_id").cast("long").alias("near"))
    own = s.withColumn("room_id", F.when(F.col("line_id") % 13 == 0, 1_000_000 + F.col("line_id")).otherwise(F.col("near")))
    links = own.where("line_id % 13 = 0").select(F.col("room_id").alias("a"), F.explode(F.array("near", F.col("near") + 1)).alias("b"))
    e = v.room_edges(spark, sf_dir).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return rooms.absorb_singletons(own.select("room_id", "line_id"), e.unionByName(links))


@query(f"SELECT room_id, {q('min_x')} AS min_x, {q('min_y')} AS min_y, {q('max_x')} AS max_x, {q('max_y')} AS max_y, {q('cx')} AS cx, {q('cy')} AS cy FROM rects")
def room_rect(spark, sf_dir):
    return rooms.room_rect(v.segments(spark, sf_dir)).select("room_id", *[r6(c).alias(c) for c in ("min_x", "min_y", "max_x", "max_y", "cx", "cy")])


@query("""SELECT old AS from_room, new AS to_room, CASE WHEN new NOT IN (SELECT old FROM labs) THEN 'new_room' WHEN old NOT IN (SELECT new FROM labs) THEN 'merged_rooms' ELSE 'moved_lines' END AS kind, count(*) AS n_lines
FROM labs WHERE old <> new GROUP BY old, new""")
def room_changes(spark, sf_dir):
    return rooms.room_changes(v.labels(spark, sf_dir))


@query("SELECT DISTINCT least(p, r) AS a, greatest(p, r) AS b FROM (SELECT CAST(scan_id % 10 AS INTEGER) AS r, lag(CAST(scan_id % 10 AS INTEGER)) OVER (PARTITION BY robot_id ORDER BY scan_id) AS p FROM poses) WHERE p <> r")
def room_transitions(spark, sf_dir):
    return rooms.room_transitions(v.poses(spark, sf_dir).select("robot_id", "scan_id", (F.col("scan_id") % 10).cast("int").alias("room_id")))


RD2 = lambda x, y: f"(pow(greatest(min_x - {x}, {x} - max_x, 0.0), 2) + pow(greatest(min_y - {y}, {y} - max_y, 0.0), 2))"
FAR = ", far AS (SELECT scan_id AS point_id, x * 4 - 2 AS x, y * 3 - 3 AS y FROM poses)"
KNN = FAR + f""", knn AS (SELECT point_id, room_id, round({RD2('x', 'y')}, 9) AS d2, row_number() OVER (PARTITION BY point_id ORDER BY round({RD2('x', 'y')}, 9), room_id) AS k FROM far, small)"""
SMALL = """, small AS (SELECT room_id, min(least(x1, x2)) / 3 AS min_x, min(least(y1, y2)) / 3 AS min_y, max(greatest(x1, x2)) / 3 AS max_x, max(greatest(y1, y2)) / 3 AS max_y FROM segs GROUP BY room_id)"""


def _far(spark, sf_dir):
    return v.poses(spark, sf_dir).select(F.col("scan_id").alias("point_id"), (F.col("x") * 4 - 2).alias("x"), (F.col("y") * 3 - 3).alias("y"))


def _small(spark, sf_dir):
    third = [(F.col(c) / 3).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    return rooms.room_rect(v.segments(spark, sf_dir)).select("room_id", *third)


@query(SMALL + KNN + f" SELECT point_id, CAST(k AS INTEGER) AS rank, room_id, {q('sqrt(d2)')} AS distance FROM knn WHERE k <= 2")
def knn_rooms(spark, sf_dir):
    return rooms.knn_rooms(_far(spark, sf_dir), _small(spark, sf_dir)).select("point_id", "rank", "room_id", r6("distance").alias("distance"))


def _decide_sql(points: str, one_positive: bool) -> str:
    """The assignment rules over a table of candidates (point_id, room_id)."""
    use = "= 1" if one_positive else ">= 1"
    return f""", held AS (SELECT t.point_id, min(t.room_id) AS room_id FROM tried t JOIN {points} f ON f.point_id = t.point_id JOIN small r ON r.room_id = t.room_id
    WHERE f.x BETWEEN r.min_x AND r.max_x AND f.y BETWEEN r.min_y AND r.max_y GROUP BY t.point_id HAVING count(*) = 1
), dist AS (SELECT t.point_id, t.room_id, s.line_id, round({d2_sql('f.x', 'f.y', 's')}, 9) AS d2, {side_sql('f.x', 'f.y', 's')} > 0 AS positive
  FROM tried t JOIN {points} f ON f.point_id = t.point_id JOIN segs s ON s.room_id = t.room_id WHERE t.point_id NOT IN (SELECT point_id FROM held)
), per AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY point_id, room_id ORDER BY d2, line_id) = 1
), dec AS (SELECT point_id, arg_min(room_id, (d2, room_id)) FILTER (positive) AS pos, arg_min(room_id, (d2, room_id)) AS anyone, count(*) FILTER (positive) AS n FROM per GROUP BY point_id)
SELECT point_id, room_id FROM held UNION ALL SELECT point_id, CASE WHEN n {use} THEN pos ELSE anyone END FROM dec"""


@query(SMALL + KNN + """, ins AS (SELECT point_id, room_id FROM far, small WHERE x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y
), tried AS (SELECT * FROM ins UNION ALL SELECT point_id, room_id FROM knn WHERE k <= 2 AND point_id NOT IN (SELECT point_id FROM ins))""" + _decide_sql("far", False))
def identify_room(spark, sf_dir):
    return rooms.identify_room(_far(spark, sf_dir), _small(spark, sf_dir), v.segments(spark, sf_dir))


TRIED = ", tried AS (SELECT point_id, room_id FROM pts UNION ALL SELECT p.point_id, e.b FROM pts p JOIN both_redges e ON e.a = p.room_id)"


def _tried(spark, sf_dir, pts):
    e = v.room_edges(spark, sf_dir)
    near = e.select(F.col("a").alias("room_id"), F.col("b").alias("of")).unionByName(e.select(F.col("b").alias("room_id"), F.col("a").alias("of")))
    own = pts.select("point_id", "room_id")
    return own.unionByName(own.join(near, "room_id").select("point_id", F.col("of").alias("room_id")))


@query(SMALL + TRIED + _decide_sql("pts", False))
def assign_points(spark, sf_dir):
    p = v.points(spark, sf_dir)
    return rooms.assign_points(p.select("point_id", "x", "y"), _small(spark, sf_dir), v.segments(spark, sf_dir), _tried(spark, sf_dir, p))


@query(SMALL + ", tried AS (SELECT p.point_id, p.room_id + unnest([0, 1]) AS room_id FROM pts p)" + _decide_sql("pts", True))
def split_inducing(spark, sf_dir):
    """Every room's points go to it or to a second one, that of the next number."""
    p = v.points(spark, sf_dir).select("point_id", "room_id", "x", "y")
    two = p.select("point_id", F.explode(F.array("room_id", F.col("room_id") + 1)).alias("room_id"))
    return rooms.assign_points(p.drop("room_id"), _small(spark, sf_dir), v.segments(spark, sf_dir), two, one_positive_only=True)


@query(NEAREST + " SELECT point_id, line_id % 5 = 0 AS moved FROM near QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d2, line_id) = 1")
def moved_inducing(spark, sf_dir):
    from ..operators.spatial import nearest_segment

    near = nearest_segment(v.points(spark, sf_dir), v.segments(spark, sf_dir))
    return near.select("point_id", (F.col("line_id") % 5 == 0).alias("moved"))


def edf_predict(spark, sf_dir):
    """Per room: fit on voxels of its points and predict at its queries; no SQL for the dense algebra."""
    p = v.points(spark, sf_dir)
    vox = field.voxel_downsample(p).withColumn("batch", F.pmod(F.col("ix"), F.lit(3)))
    state = field.fit_rooms(vox.select("room_id", "batch", "x", "y"), v.segments(spark, sf_dir).select("room_id", "x1", "y1", "x2", "y2"))
    near = p.select(F.col("point_id").alias("query_id"), "room_id", (F.col("x") * 0.9).alias("x"), (F.col("y") * 0.9).alias("y"))
    return field.predict_rooms(near, state, v.segments(spark, sf_dir))


def edf_grid(spark, sf_dir):
    p = v.points(spark, sf_dir)
    vox = field.voxel_downsample(p).withColumn("batch", F.lit(0))
    grid = field.query_grid(p.groupBy("room_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")))
    asked = grid.select((F.col("room_id") * 900 + F.col("i") * 30 + F.col("j")).cast("long").alias("query_id"), "room_id", "x", "y")
    return field.predict_rooms(asked, field.fit_rooms(vox.select("room_id", "batch", "x", "y")))


def _baseline(spark, sf_dir, lines):
    """One field over the voxels of all points, fitted per tile; a row a tile."""
    vox = field.voxel_downsample(v.points(spark, sf_dir).withColumn("room_id", F.lit(0))).select(F.lit(0).alias("batch"), "x", "y")
    state = field.fit_tiles(vox, lines)
    return state.select(F.col("room_id").alias("tile"), "version", "m", F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("mean_sum"))


def baseline_global(spark, sf_dir):
    """One field for all rooms with a zero prior."""
    return _baseline(spark, sf_dir, None)


def baseline_line(spark, sf_dir):
    """One field for all rooms with a prior from all lines."""
    return _baseline(spark, sf_dir, v.segments(spark, sf_dir))


QUERIES |= {f.__name__: f for f in (edf_predict, edf_grid, baseline_global, baseline_line)}


def segments_extract(spark, sf_dir):
    from ..operators.extract import extract_segments
    from .point_queries import line_clusters

    s = extract_segments(line_clusters(spark, sf_dir))
    return s.select("robot_id", "line_id", "room_id", "cluster_id", "n_points", "is_short", *[r6(c).alias(c) for c in ("r", "theta", "x1", "y1", "x2", "y2")])


def robot_map(spark, sf_dir):
    """Line maps of the robots from the segments of their scans."""
    from ..operators.extract import extract_segments
    from ..operators.mapping import build_map
    from .point_queries import line_clusters

    lines = build_map(extract_segments(line_clusters(spark, sf_dir)))
    return lines.select("robot_id", "line_id", "weight", *[r6(c).alias(c) for c in ("r", "theta", "x1", "y1", "x2", "y2")])


def room_segmentation(spark, sf_dir):
    from ..operators.spectral import split_rooms

    return split_rooms(_seen(spark, sf_dir))


def label_match(spark, sf_dir):
    from ..operators.spectral import match_labels

    return match_labels(rooms.label_contingency(v.labels(spark, sf_dir)).withColumn("map_id", F.lit(0)))


def relabel_rooms(spark, sf_dir):
    """Labels of maps of fifty lines after a new clustering; the robot is in the room of the map's first line."""
    from pyspark.sql import Window

    from ..operators.spectral import relabel_rooms as carried

    labs = v.labels(spark, sf_dir).withColumn("map_id", F.expr("line_id div 50")).withColumn("local", F.pmod(F.col("new"), F.lit(5)))
    return carried(labs.withColumn("current", F.first("old").over(Window.partitionBy("map_id").orderBy("line_id"))))


QUERIES |= {f.__name__: f for f in (segments_extract, robot_map, room_segmentation, label_match, relabel_rooms)}


JUNCTIONS = f""", junctions AS (
  SELECT * FROM (SELECT p.room_id, p.line_id AS p, q.line_id AS q, {MEETX} AS x, {MEETY} AS y, p.x1 AS px, p.y1 AS py, p.dx AS pdx, p.dy AS pdy, p.len AS plen
    FROM {PAIRS} WHERE abs(p.theta - q.theta) > {PI / 3!r} AND abs(p.theta - q.theta) < {2 * PI / 3!r} AND {segd2_sql('p', 'q')} < 0.25)
  WHERE (x - px) * pdx + (y - py) * pdy >= 0.5 AND plen - ((x - px) * pdx + (y - py) * pdy) >= 0.5 AND NOT (q IN (SELECT src FROM edges) AND q IN (SELECT dst FROM edges))
)"""


@query(JUNCTIONS + f" SELECT room_id, p, q, {q('x')} AS x, {q('y')} AS y FROM junctions")
def t_junctions(spark, sf_dir):
    from ..operators.maintain import t_junctions as found

    return found(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir)).select("room_id", "p", "q", r6("x").alias("x"), r6("y").alias("y"))


@query(JUNCTIONS + f""", cut AS (SELECT p AS line_id, x, y FROM junctions QUALIFY row_number() OVER (PARTITION BY p ORDER BY sqrt((x - px) * (x - px) + (y - py) * (y - py)), x, y) = 1)
SELECT s.line_id, 0 AS part, {q('x1')} AS x1, {q('y1')} AS y1, {q('x2')} AS x2, {q('y2')} AS y2 FROM segs s WHERE s.line_id NOT IN (SELECT line_id FROM cut)
UNION ALL SELECT s.line_id, 1, {q('x1')}, {q('y1')}, {q('c.x')}, {q('c.y')} FROM segs s JOIN cut c ON c.line_id = s.line_id
UNION ALL SELECT s.line_id, 2, {q('c.x')}, {q('c.y')}, {q('x2')}, {q('y2')} FROM segs s JOIN cut c ON c.line_id = s.line_id""")
def split_lines(spark, sf_dir):
    from ..operators import maintain

    s = v.segments(spark, sf_dir)
    parts = maintain.split_lines(s, maintain.t_junctions(s, v.line_edges(spark, sf_dir)))
    return parts.select("line_id", "part", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


CLOSE = f""", cand AS (SELECT p.line_id AS p, q.line_id AS q, {GAP} AS gap FROM {PAIRS}
  WHERE ((q.x1 - p.x2) * p.dx + (q.y1 - p.y2) * p.dy) >= 0 AND {GAP} <= 0.5 AND abs(p.x2 * cos(q.theta) + p.y2 * sin(q.theta) - q.r) <= 0.2 AND p.nx * q.nx + p.ny * q.ny > 0 AND (abs(p.theta - q.theta) < {PI / 5!r} OR abs(p.theta - q.theta) > {4 * PI / 5!r})
  AND p.line_id NOT IN (SELECT src FROM edges) AND q.line_id NOT IN (SELECT dst FROM edges)
), best AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY gap, q) AS kp, row_number() OVER (PARTITION BY q ORDER BY gap, p) AS kq FROM cand)"""


@query(CLOSE + f""", hop AS (SELECT p, q FROM best WHERE kp = 1 AND kq = 1
), walk AS (SELECT p AS head, q AS node, 1 AS steps FROM hop WHERE p NOT IN (SELECT q FROM hop) UNION ALL SELECT w.head, h.q, w.steps + 1 FROM walk w JOIN hop h ON h.p = w.node
), member AS (SELECT head, node, steps FROM walk UNION ALL SELECT DISTINCT head, head, 0 FROM walk
), wall AS (SELECT head, min(node) AS line_id, arg_max(node, steps) AS tail, max(s.weight) + max(steps) AS weight FROM member JOIN segs s ON s.line_id = node GROUP BY head)
SELECT w.line_id, m.node AS absorbed, {q('s.x1')} AS x1, {q('s.y1')} AS y1, {q('t.x2')} AS x2, {q('t.y2')} AS y2, CAST(w.weight AS INTEGER) AS weight
FROM wall w JOIN member m ON m.head = w.head AND m.node <> w.line_id JOIN segs s ON s.line_id = w.head JOIN segs t ON t.line_id = w.tail""")
def close_gaps(spark, sf_dir):
    from ..operators import maintain

    c = maintain.close_gaps(v.segments(spark, sf_dir), v.line_edges(spark, sf_dir))
    return c.select("line_id", "absorbed", *[r6(x).alias(x) for x in ("x1", "y1", "x2", "y2")], "weight")


def corner_apply(spark, sf_dir):
    """Corner edges after each line end has taken its nearest partner, corners at the lines' ends included (``corner_reach`` 0)."""
    from dataclasses import replace

    from ..config import DEFAULT
    from ..operators import maintain

    return maintain.apply_corners(v.segments(spark, sf_dir), cfg=replace(DEFAULT, corner_reach=0.0))[1]


def edf_profile(spark, sf_dir):
    """A profile of the field over rooms that see each point: the least distance of several rooms counts."""
    p = v.points(spark, sf_dir)
    state = field.fit_rooms(field.voxel_downsample(p).select("room_id", F.lit(0).alias("batch"), "x", "y"))
    line = p.groupBy("room_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("y"))
    asked = line.select("room_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"), "x0", "x1", "y")
    q_ = asked.select(F.col("i").cast("long").alias("query_id"), "room_id", (F.col("x0") + F.col("i") * (F.col("x1") - F.col("x0")) / 99).alias("x"), "y")
    return field.predict_rooms(q_, state).groupBy("query_id").agg(F.min("distance").alias("distance"), F.count("*").alias("n_rooms"))


QUERIES |= {f.__name__: f for f in (corner_apply, edf_profile)}


def cut_lines(spark, sf_dir):
    """All lines, cut at every T-junction and door at once; no SQL (cuts are taken in order along a line), loops in the tests."""
    from ..operators import maintain

    s, e = v.segments(spark, sf_dir), v.line_edges(spark, sf_dir)
    parts = maintain.cut_lines(s, maintain.t_joins(s, e), segments.door_candidates(s))
    return parts.select("line_id", "part", *[r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")], "into")


def local_clusters(spark, sf_dir):
    """Maps of a room's lines each, of two rooms by their numbers, clustered anew; the robot is in the first."""
    from ..operators import spectral

    s = v.segments(spark, sf_dir)
    old = s.select(F.col("room_id").cast("long").alias("map_id"), "line_id", (F.col("line_id") % 2).cast("int").alias("old"), F.lit(0).alias("current"), F.lit(True).alias("is_new"))
    linked = graph.connected(materialize(_seen(spark, sf_dir), "visible"), s.select("room_id", F.col("line_id").alias("node")))
    return spectral.local_clusters(old, linked.select(F.col("room_id").cast("long").alias("map_id"), "p", "q", "weight"))


def follow_changes(spark, sf_dir):
    """Fields after every line has gone to the room of its new label; inducing points go with their nearest line."""
    s, labs = v.segments(spark, sf_dir), v.labels(spark, sf_dir)
    block = F.expr("line_id div 400 * 10").cast("int")
    both = labs.select("line_id", (block + F.col("old")).alias("old"), (block + F.pmod(F.col("new"), F.lit(10))).alias("new"))
    vox = materialize(field.voxel_downsample(v.points(spark, sf_dir)).select("room_id", F.lit(0).alias("batch"), "x", "y"), "voxels")
    lines = s.drop("room_id").join(both, "line_id").withColumn("room_id", F.col("new"))
    moved = field.moved_points(materialize(field.inducing_points(vox), "inducing"), lines)
    out = field.fit_changed(vox, rooms.room_changes(both), moved, lines)
    return out.select("room_id", "version", "m", F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("mean_sum"))


QUERIES |= {f.__name__: f for f in (cut_lines, local_clusters, follow_changes)}


@query(""", labs2 AS (SELECT line_id, CASE WHEN old % 4 = 3 THEN old + 20 ELSE old END AS old, new FROM labs
), ch AS (SELECT old AS f, new AS t, CASE WHEN new NOT IN (SELECT old FROM labs2) THEN 'new_room' WHEN old NOT IN (SELECT new FROM labs2) THEN 'merged_rooms' ELSE 'moved_lines' END AS kind FROM labs2 WHERE old <> new GROUP BY old, new
), links AS (SELECT src AS p, dst AS q FROM edges UNION SELECT dst, src FROM edges
), bound AS (SELECT DISTINCT x.new AS t, y.new AS n FROM links JOIN labs2 x ON x.line_id = p JOIN labs2 y ON y.line_id = q WHERE x.new <> y.new
), had AS (SELECT DISTINCT least(x.old, y.old) AS a, greatest(x.old, y.old) AS b FROM links JOIN labs2 x ON x.line_id = p JOIN labs2 y ON y.line_id = q WHERE x.old <> y.old
), fresh AS (SELECT DISTINCT c.f, c.t, b.n FROM ch c JOIN bound b ON b.t = c.t WHERE c.kind = 'new_room' AND b.n <> c.f
), own AS (SELECT least(f, t) AS a, greatest(f, t) AS b FROM ch WHERE kind = 'new_room'
), kept AS (
  SELECT a, b FROM had WHERE (a, b) NOT IN (SELECT (least(n, f), greatest(n, f)) FROM fresh EXCEPT SELECT (a, b) FROM own) UNION SELECT a, b FROM own UNION SELECT least(t, n), greatest(t, n) FROM fresh
), gone AS (SELECT f, min(t) AS t FROM ch WHERE kind = 'merged_rooms' GROUP BY f
), moved AS (SELECT coalesce(g.t, a) AS a, coalesce(h.t, b) AS b FROM kept LEFT JOIN gone g ON g.f = a LEFT JOIN gone h ON h.f = b)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM moved WHERE a <> b""")
def room_rewiring(spark, sf_dir):
    """The room graph, rooms whose lines are linked, after all lines have taken their new labels."""
    labs = v.labels(spark, sf_dir).withColumn("old", F.when(F.col("old") % 4 == 3, F.col("old") + 20).otherwise(F.col("old")))
    e = v.line_edges(spark, sf_dir)
    links = e.select(F.col("src").alias("p"), F.col("dst").alias("q")).unionByName(e.select(F.col("dst").alias("p"), F.col("src").alias("q")))
    side = lambda line, which, name: labs.select(F.col("line_id").alias(line), F.col(which).alias(name))
    had = links.join(side("p", "old", "a"), "p").join(side("q", "old", "b"), "q").where("a < b").select("a", "b").distinct()
    boundary = links.join(side("p", "new", "room"), "p").join(side("q", "new", "neighbour"), "q").where("room != neighbour").select("room", "neighbour").distinct()
    return rooms.rewire(had, materialize(rooms.room_changes(labs), "changes"), boundary)
