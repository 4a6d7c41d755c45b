"""Queries over points and clusters, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import field, ingest, metrics, rooms, segments, spatial
from . import views as v
from .views import VIEWS, d2_sql, q, side_sql

PI = math.pi
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def r6(c):
    return F.round(g._c(c), 6)


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = VIEWS + sql
        return fn

    return add


GAPS = """, gaps AS (
  SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS gap FROM (
    SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM pts WINDOW w AS (PARTITION BY robot_id, scan_id ORDER BY beam))
)"""
KEY = "robot_id, scan_id, cluster_id"
CLUSTERS = (
    GAPS
    + f""", cut AS (
  SELECT *, CASE WHEN gap >= 7 * rng * {v.STEP!r} THEN 1 ELSE 0 END AS brk FROM gaps
), chained AS (
  SELECT *, sum(brk) OVER (PARTITION BY robot_id, scan_id ORDER BY beam ROWS UNBOUNDED PRECEDING) - brk AS c FROM cut
), clusters AS (
  SELECT *, CAST(CASE WHEN ahead THEN 0 ELSE c END AS INTEGER) AS cluster_id, CASE WHEN ahead AND last_c > 0 THEN beam - 1048576 ELSE beam END AS pos FROM (SELECT *, last_brk = 0 AND c = last_c AS ahead FROM (
    SELECT *, max(c) OVER (PARTITION BY robot_id, scan_id) AS last_c, arg_max(brk, beam) OVER (PARTITION BY robot_id, scan_id) AS last_brk FROM chained))
), stats AS (
  SELECT {KEY}, count(*) AS n, avg(inner_gap) AS mean_gap FROM (
    SELECT *, sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y)) AS inner_gap FROM clusters WINDOW w AS (PARTITION BY {KEY} ORDER BY pos))
  GROUP BY {KEY}
), lined AS (
  SELECT *, CASE WHEN n <= 2 THEN 'residual' WHEN mean_gap > 0.11 THEN 'dropped' WHEN n < 20 THEN 'residual' ELSE 'line' END AS status FROM stats
)"""
)
RING = (
    CLUSTERS
    + f""", ends AS (
  SELECT {KEY}, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS bx, arg_max(y, pos) AS by_ FROM clusters GROUP BY {KEY}
), kept AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY robot_id, scan_id) AS n_kept, coalesce(lead(ax) OVER w, first_value(ax) OVER w) AS nx_, coalesce(lead(ay) OVER w, first_value(ay) OVER w) AS ny_
  FROM ends JOIN (SELECT {KEY} FROM lined WHERE n > 2 AND status <> 'dropped') USING ({KEY}) WINDOW w AS (PARTITION BY robot_id, scan_id ORDER BY cluster_id)
), near_ AS (SELECT *, sqrt((nx_ - bx) * (nx_ - bx) + (ny_ - by_) * (ny_ - by_)) < 0.2 AS joins_next FROM kept
), opened AS (
  SELECT *, CASE WHEN k = 1 OR NOT lag(joins_next) OVER w THEN k END AS opens FROM near_ WINDOW w AS (PARTITION BY robot_id, scan_id ORDER BY cluster_id)
), chains AS (
  SELECT *, max(opens) OVER (PARTITION BY robot_id, scan_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS chain, max(opens) OVER (PARTITION BY robot_id, scan_id) AS last_chain,
    max(CASE WHEN k = n_kept AND joins_next THEN 1 ELSE 0 END) OVER (PARTITION BY robot_id, scan_id) = 1 AS closes, min(cluster_id) OVER (PARTITION BY robot_id, scan_id) AS first_id FROM opened
), into_ AS (
  SELECT {KEY}, CASE WHEN closes AND chain = last_chain AND last_chain > 1 THEN first_id ELSE min(cluster_id) OVER (PARTITION BY robot_id, scan_id, chain) END AS joined FROM chains
), ringed AS (
  SELECT c.*, coalesce(i.joined, c.cluster_id) AS ring_id, i.joined IS NOT NULL AS is_kept FROM clusters c LEFT JOIN into_ i USING ({KEY})
), rings AS (
  SELECT r.robot_id, r.scan_id, r.ring_id AS cluster_id, count(*) AS n, CASE WHEN NOT bool_or(r.is_kept) THEN min(l.status) WHEN count(*) < 20 THEN 'residual' ELSE 'line' END AS status
  FROM ringed r LEFT JOIN lined l ON l.robot_id = r.robot_id AND l.scan_id = r.scan_id AND l.cluster_id = r.ring_id GROUP BY r.robot_id, r.scan_id, r.ring_id
)"""
)
FITS = (
    CLUSTERS
    + f""", sums AS (
  SELECT scan_id, cluster_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cxy FROM clusters GROUP BY scan_id, cluster_id HAVING count(*) >= 20
), turned AS (SELECT *, 0.5 * atan2(2 * cxy, vx - vy) + {PI / 2!r} AS t0 FROM sums
), fits AS (
  SELECT scan_id, cluster_id, n, CASE WHEN t0 < 0 OR t0 >= {PI!r} THEN -(mx * cos(t0) + my * sin(t0)) ELSE mx * cos(t0) + my * sin(t0) END AS r,
    CASE WHEN t0 < 0 THEN t0 + {PI!r} WHEN t0 >= {PI!r} THEN t0 - {PI!r} ELSE t0 END AS theta,
    greatest(0.5 * n * (vx + vy - sqrt((vx - vy) * (vx - vy) + 4 * cxy * cxy)) / 2, 0.0) AS cost FROM turned
)"""
)
CENTROIDS = """, centroids AS (SELECT scan_id, cluster_id, min(room_id) AS room_id, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM clusters GROUP BY scan_id, cluster_id)"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.breakpoints(v.points(spark, sf_dir), v.STEP)


def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clusters(spark, sf_dir)
    big = c.groupBy(*segments.CLUSTER).count().where("count >= 20").drop("count")
    return c.join(big, list(segments.CLUSTER))


def line_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the clusters that may hold lines, after the ring pass."""
    return segments.ring_pass(_clusters(spark, sf_dir)).where("status = 'line'")


@query(RING + " SELECT scan_id, CAST(cluster_id AS INTEGER) AS cluster_id, n, status FROM rings")
def ring_clusters(spark, sf_dir):
    joined = segments.ring_pass(_clusters(spark, sf_dir))
    return joined.groupBy(*segments.CLUSTER).agg(F.count("*").alias("n"), F.max("status").alias("status")).select("scan_id", "cluster_id", "n", "status")


@query(f"SELECT point_id, scan_id, beam, {q('x')} AS x, {q('y')} AS y, {q('angle')} AS angle, {q('rng')} AS range FROM pts")
def scan_to_coords(spark, sf_dir):
    return v.points(spark, sf_dir).select("point_id", "scan_id", "beam", r6("x").alias("x"), r6("y").alias("y"), r6("angle").alias("angle"), r6("range").alias("range"))


@query("SELECT scan_id, count(*) AS n FROM pts GROUP BY scan_id")
def range_filter(spark, sf_dir):
    return v.beams(spark, sf_dir).where(ingest.valid_range("range", 0.12, 3.5)).groupBy("scan_id").agg(F.count("*").alias("n"))


@query("SELECT scan_id, count(*) AS n, max(beam) AS last_beam FROM beams WHERE scan_id < 10 GROUP BY scan_id")
def scan_limit(spark, sf_dir):
    from ..sources.scans import first_scans

    return first_scans(v.beams(spark, sf_dir), 10).groupBy("scan_id").agg(F.count("*").alias("n"), F.max("beam").alias("last_beam"))


@query(""", ordered AS (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY scan_id) AS rn FROM poses
), gate AS (
  SELECT robot_id, rn, scan_id, true AS keep, x AS kx, y AS ky FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.robot_id, o.rn, o.scan_id, sqrt((o.x - g.kx) * (o.x - g.kx) + (o.y - g.ky) * (o.y - g.ky)) >= 0.2,
    CASE WHEN sqrt((o.x - g.kx) * (o.x - g.kx) + (o.y - g.ky) * (o.y - g.ky)) >= 0.2 THEN o.x ELSE g.kx END,
    CASE WHEN sqrt((o.x - g.kx) * (o.x - g.kx) + (o.y - g.ky) * (o.y - g.ky)) >= 0.2 THEN o.y ELSE g.ky END
  FROM gate g JOIN ordered o ON o.robot_id = g.robot_id AND o.rn = g.rn + 1
) SELECT robot_id, scan_id FROM gate WHERE keep""")
def pose_gate(spark, sf_dir):
    return ingest.pose_gate(v.poses(spark, sf_dir))


@query(GAPS + f" SELECT point_id, scan_id, beam, {q('gap')} AS gap FROM gaps")
def point_gaps(spark, sf_dir):
    return ingest.point_gaps(v.points(spark, sf_dir)).select("point_id", "scan_id", "beam", r6("gap").alias("gap"))


@query(CLUSTERS + " SELECT point_id, scan_id, beam, cluster_id FROM clusters")
def breakpoints(spark, sf_dir):
    return _clusters(spark, sf_dir).select("point_id", "scan_id", "beam", "cluster_id")


@query(CLUSTERS + f" SELECT scan_id, cluster_id, n, {q('mean_gap')} AS mean_gap, status FROM lined")
def cluster_status(spark, sf_dir):
    return segments.cluster_stats(_clusters(spark, sf_dir)).select("scan_id", "cluster_id", "n", r6("mean_gap").alias("mean_gap"), "status")


@query(CLUSTERS + " SELECT scan_id, cluster_id, n FROM lined WHERE status = 'dropped'")
def sparse_cluster(spark, sf_dir):
    return segments.cluster_stats(_clusters(spark, sf_dir)).where("status = 'dropped'").select("scan_id", "cluster_id", "n")


@query(FITS + f" SELECT scan_id, cluster_id, n, {q('r')} AS r, {q('theta')} AS theta, {q('cost')} AS cost FROM fits")
def line_fit(spark, sf_dir):
    f = segments.line_fit(_large(spark, sf_dir), segments.CLUSTER)
    return f.select("scan_id", "cluster_id", "n", r6("r").alias("r"), r6("theta").alias("theta"), r6("cost").alias("cost"))


@query(FITS + f""" SELECT f.scan_id, f.cluster_id, {q('max(abs(x * cos(theta) + y * sin(theta) - r))')} AS max_residual, max(abs(x * cos(theta) + y * sin(theta) - r)) <= 0.05 AS is_line
FROM fits f JOIN clusters c ON c.scan_id = f.scan_id AND c.cluster_id = f.cluster_id GROUP BY f.scan_id, f.cluster_id""")
def is_line(spark, sf_dir):
    key = segments.CLUSTER
    pts = _large(spark, sf_dir)
    return segments.is_line(pts, segments.line_fit(pts, key), key).select("scan_id", "cluster_id", r6("max_residual").alias("max_residual"), "is_line")


@query(CLUSTERS + f""", ends AS (
  SELECT scan_id, cluster_id, arg_min(x, beam) AS ax, arg_min(y, beam) AS ay, arg_max(x, beam) AS bx, arg_max(y, beam) AS by_, min(beam) AS b0, max(beam) AS b1 FROM clusters GROUP BY scan_id, cluster_id HAVING count(*) >= 20
), dists AS (
  SELECT c.scan_id, c.cluster_id, beam, coalesce(abs({v.cross_sql('ax', 'ay', 'bx', 'by_', 'x', 'y')}) / nullif(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)), 0), 0.0) AS d
  FROM clusters c JOIN ends e ON c.scan_id = e.scan_id AND c.cluster_id = e.cluster_id AND beam > b0 AND beam < b1
) SELECT scan_id, cluster_id, {q('avg(d)')} AS mean_sagitta, CASE WHEN avg(d) > 0.1 THEN arg_min(beam, struct_pack(nd := -d, b := beam)) END AS corner_beam FROM dists GROUP BY scan_id, cluster_id""")
def seed_corner(spark, sf_dir):
    return segments.seed_corner(_large(spark, sf_dir), segments.CLUSTER).select("scan_id", "cluster_id", r6("mean_sagitta").alias("mean_sagitta"), "corner_beam")


@query(CLUSTERS + CENTROIDS + f" SELECT scan_id, cluster_id, n, {q('cx')} AS cx, {q('cy')} AS cy FROM centroids")
def cluster_centroid(spark, sf_dir):
    c = _clusters(spark, sf_dir).groupBy("scan_id", "cluster_id").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return c.select("scan_id", "cluster_id", "n", r6("cx").alias("cx"), r6("cy").alias("cy"))


@query(CLUSTERS + CENTROIDS + f" SELECT scan_id, cluster_id FROM centroids c WHERE NOT EXISTS (SELECT 1 FROM segs s WHERE s.room_id = c.room_id AND {d2_sql('c.cx', 'c.cy', 's')} <= {0.15**2!r})")
def residual_filter(spark, sf_dir):
    c = _clusters(spark, sf_dir).groupBy("scan_id", "cluster_id").agg(F.min("room_id").alias("room_id"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return segments.residual_filter(c, v.segments(spark, sf_dir)).select("scan_id", "cluster_id")


@query(f"SELECT scan_id, count(*) AS n, min(line_id) AS first_line FROM poses p JOIN segs s ON {d2_sql('p.x', 'p.y', 's')} <= {0.5**2!r} GROUP BY scan_id")
def segments_within_range(spark, sf_dir):
    near = spatial.points_near_segments(v.poses(spark, sf_dir), v.segments(spark, sf_dir), 0.5)
    return near.groupBy("scan_id").agg(F.count("*").alias("n"), F.min("s.line_id").alias("first_line"))


NEAREST = f", near AS (SELECT point_id, p.room_id, line_id, round({d2_sql('p.x', 'p.y', 's')}, 9) AS d2, {side_sql('p.x', 'p.y', 's')} > 0 AS positive FROM pts p JOIN segs s ON s.room_id = p.room_id)"


@query(NEAREST + f" SELECT point_id, line_id, {q('sqrt(d2)')} AS distance FROM near QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d2, line_id) = 1")
def nearest_segment(spark, sf_dir):
    return spatial.nearest_segment(v.points(spark, sf_dir), v.segments(spark, sf_dir)).select("point_id", "line_id", r6("distance").alias("distance"))


@query(NEAREST + " SELECT point_id, positive FROM near QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY d2, line_id) = 1")
def positive_side(spark, sf_dir):
    return spatial.nearest_segment(v.points(spark, sf_dir), v.segments(spark, sf_dir)).select("point_id", "positive")


@query(f"""SELECT room_id, ix, iy, count(*) AS n, {q('avg(x)')} AS x, {q('avg(y)')} AS y FROM (
  SELECT p.room_id, x, y, CAST(floor((x - (lx - 0.075)) / 0.15) AS BIGINT) AS ix, CAST(floor((y - (ly - 0.075)) / 0.15) AS BIGINT) AS iy
  FROM pts p JOIN (SELECT room_id, min(x) AS lx, min(y) AS ly FROM pts GROUP BY room_id) l ON l.room_id = p.room_id) GROUP BY room_id, ix, iy""")
def voxel_downsample(spark, sf_dir):
    return field.voxel_downsample(v.points(spark, sf_dir)).select("room_id", "ix", "iy", "n", r6("x").alias("x"), r6("y").alias("y"))


def _old_new(spark, sf_dir):
    p = v.points(spark, sf_dir)
    return p.where("scan_id % 4 = 0"), p.where("scan_id % 4 <> 0")


@query(f"""SELECT point_id FROM pts n WHERE scan_id % 4 <> 0 AND NOT EXISTS (
  SELECT 1 FROM pts k WHERE k.scan_id % 4 = 0 AND k.room_id = n.room_id AND sqrt((n.x - k.x) * (n.x - k.x) + (n.y - k.y) * (n.y - k.y)) <= {field.novelty_radius()!r})""")
def novelty_filter(spark, sf_dir):
    known, new = _old_new(spark, sf_dir)
    return field.novelty_filter(new, known).select("point_id")


VOXELS = """, low AS (SELECT room_id, min(x) - 0.075 AS lx, min(y) - 0.075 AS ly FROM pts GROUP BY room_id
), vox AS (
  SELECT room_id, CAST(floor((x - lx) / 0.15) AS BIGINT) * 1000000 + CAST(floor((y - ly) / 0.15) AS BIGINT) AS id, avg(x) AS x, avg(y) AS y FROM pts JOIN low USING (room_id) GROUP BY 1, 2
)"""
NEAR_CELLS = -math.log(1e-9) / 100.0


@query(VOXELS + f""", cells AS (SELECT *, CAST(floor(x / {NEAR_CELLS!r}) AS BIGINT) AS cx, CAST(floor(y / {NEAR_CELLS!r}) AS BIGINT) AS cy FROM vox
), around AS (SELECT room_id, id, x, y, cx + dx AS cx, cy + dy AS cy FROM cells, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)
), pair AS (SELECT a.room_id, a.id AS i, b.id AS j, exp(-100.0 * sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))) AS value FROM cells a JOIN around b ON b.room_id = a.room_id AND b.cx = a.cx AND b.cy = a.cy AND a.id < b.id)
SELECT room_id, i, j, round(value, 9) + 0.0 AS value FROM pair WHERE value >= 1e-9""")
def kernel_matrix(spark, sf_dir):
    """The kernel between a room's inducing points: the voxels of all its points."""
    vox = field.voxel_downsample(v.points(spark, sf_dir)).withColumn("point_id", F.col("ix") * 1_000_000 + F.col("iy"))
    return field.kernel_matrix(vox).select("room_id", "i", "j", F.round("value", 9).alias("value"))


PRIOR = f", prior AS (SELECT point_id, sqrt(min({d2_sql('p.x', 'p.y', 's')})) AS d FROM pts p JOIN segs s ON s.room_id = p.room_id GROUP BY point_id)"


@query(PRIOR + f" SELECT point_id, {q('d')} AS min_distance, {q('exp(-100.0 * d)')} AS prior FROM prior")
def lineseg_mean(spark, sf_dir):
    return field.line_prior(v.points(spark, sf_dir), v.segments(spark, sf_dir)).select("point_id", r6("min_distance").alias("min_distance"), r6("prior").alias("prior"))


@query(f"SELECT point_id, {q('exp(-(x * x + y * y - 1.5 * 1.5) * 0.5)')} AS value FROM pts")
def circular_mean(spark, sf_dir):
    return v.points(spark, sf_dir).select("point_id", r6(g.circular_prior("x", "y", 1.5, 0.5)).alias("value"))


@query(f"SELECT event_id, CASE WHEN value / 500 - 0.05 > 0 THEN {q('-ln(value / 500 - 0.05) / 100.0')} END AS distance, CAST(least(9, greatest(0, floor((value / 150 - 0.25) / 0.25) + 1)) AS INTEGER) AS band FROM events WHERE value IS NOT NULL")
def edf_transform(spark, sf_dir):
    e = v.table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.select("event_id", r6(field.edf_transform(F.col("value") / 500 - 0.05)).alias("distance"), g.contour_band(F.col("value") / 150).alias("band"))


@query(f"""SELECT room_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {q('min_x - 1 + i * (max_x - min_x + 2) / 29')} AS x, {q('min_y - 1 + j * (max_y - min_y + 2) / 29')} AS y
FROM rects, (SELECT unnest(range(30)) AS i), (SELECT unnest(range(30)) AS j)""")
def query_grid(spark, sf_dir):
    return field.query_grid(rooms.room_rect(v.segments(spark, sf_dir))).select("room_id", "i", "j", r6("x").alias("x"), r6("y").alias("y"))


@query(f"SELECT k, i, CASE WHEN count(y) OVER w = 20 THEN {q('avg(y) OVER w')} END AS rolling FROM series WINDOW w AS (PARTITION BY k ORDER BY i ROWS 19 PRECEDING)")
def rolling_mean(spark, sf_dir):
    return metrics.rolling_mean(v.series(spark, sf_dir), "k", "i", "y").select("k", "i", r6("rolling").alias("rolling"))


@query(f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS n FROM series)
SELECT a.k, a.i, round(sum(pow({1 - 2 / 51!r}, a.n - b.n) * b.y) / sum(pow({1 - 2 / 51!r}, a.n - b.n)), 4) + 0.0 AS ewm FROM numbered a JOIN numbered b ON a.k = b.k AND b.n <= a.n GROUP BY a.k, a.i""")
def ewm_smooth(spark, sf_dir):
    return metrics.ewm_smooth(v.series(spark, sf_dir), "k", "i", "y").select("k", "i", F.round("ewm", 4).alias("ewm"))


@query(", per_scan AS (SELECT CAST(scan_id % 3 AS VARCHAR) AS robot_id, scan_id, count(*) AS n FROM pts GROUP BY scan_id) SELECT robot_id, scan_id, n, CAST(sum(n) OVER (PARTITION BY robot_id ORDER BY scan_id) AS BIGINT) AS num_points FROM per_scan")
def running_points(spark, sf_dir):
    n = v.points(spark, sf_dir).groupBy((F.col("scan_id") % 3).cast("string").alias("robot_id"), "scan_id").agg(F.count("*").alias("n"))
    return metrics.running_total(n, "robot_id", "scan_id", "n", "num_points")
