"""Scans, lines, labels and series derived from the star-schema tables, as DataFrames and as SQL for comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.ingest import project_beams, valid_range

STEP = math.pi / 180


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """360 beams a scan: mostly a wall at 1.5 m, with stray ranges."""
    rng = F.when(F.col("user_id") % 12 == 0, F.col("value") / 100).otherwise(1.5 + F.col("value") / 5000)
    return table(spark, sf_dir, "events").where("value IS NOT NULL").select(
        F.col("event_id").alias("point_id"), F.expr("event_id div 360").alias("scan_id"), (F.col("event_id") % 360).cast("int").alias("beam"), rng.alias("range"),
    )


def pose(scan: Column | str = "scan_id") -> tuple[Column, Column, Column]:
    s = g._c(scan)
    return (s % 7) * 0.15, F.floor(s / 7) * 0.1, s * 0.01


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py, yaw = pose()
    b = beams(spark, sf_dir).where(valid_range("range", 0.12, 3.5))
    placed = b.withColumn("px", px).withColumn("py", py).withColumn("angle", F.col("beam") * STEP + yaw)
    room = F.expr("scan_id div 56 * 10 + scan_id % 10").cast("int")
    return project_beams(placed).withColumn("room_id", room).withColumn("robot_id", (F.col("scan_id") % 3).cast("string"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py, _ = pose()
    s = beams(spark, sf_dir).select("scan_id").distinct()
    return s.select("scan_id", (F.col("scan_id") % 3).cast("string").alias("robot_id"), px.alias("x"), py.alias("y"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in rooms of some forty: rooms grow with the table, a room's lines don't."""
    e = lambda i: F.element_at("embedding", i).cast("double") * 10
    s = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("line_id"), F.expr("vec_id div 400 * 10 + label").cast("int").alias("room_id"), e(1).alias("x1"), e(2).alias("y1"), e(3).alias("x2"), e(4).alias("y2"),
        ((F.col("vec_id") % 7) * 0.15).alias("robot_x"), ((F.col("vec_id") % 5) * 0.1).alias("robot_y"), (F.col("vec_id") % 3 + 1).cast("int").alias("weight"),
    )
    ends = ("x1", "y1", "x2", "y2")
    dx, dy = g.direction(*ends)
    nx, ny = g.normal_toward("robot_x", "robot_y", *ends)
    r, theta = g.normal_form(*ends)
    return s.select("*", dx.alias("dx"), dy.alias("dy"), nx.alias("nx"), ny.alias("ny"), r.alias("r"), theta.alias("theta"))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark, sf_dir).select("line_id")
    a = s.where("line_id % 3 = 0").select(F.col("line_id").alias("src"), (F.col("line_id") + 1).alias("dst"))
    kind = F.when(F.col("src") % 2 == 0, "corner").otherwise("parallel")
    return a.join(s.select(F.col("line_id").alias("dst")), "dst").select("src", "dst", kind.alias("type"))


def room_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rooms = segments(spark, sf_dir).select(F.col("room_id").alias("a")).distinct()
    return rooms.where("a % 3 <> 2").withColumn("b", F.col("a") + 1).join(rooms.select(F.col("a").alias("b")), "b").select("a", "b")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line_id"), F.col("label").alias("old"), ((F.col("label") * 7 + F.col("vec_id")) % 12).cast("int").alias("new"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.col("o_totalprice").cast("double").alias("y"))


def q(x: str) -> str:
    """A double of a result at six decimals."""
    return f"round({x}, 6) + 0.0"


def d2_sql(x: str, y: str, s: str = "") -> str:
    """Squared distance of a point to the segment of alias s."""
    p = f"{s}." if s else ""
    dx, dy = f"({p}x2 - {p}x1)", f"({p}y2 - {p}y1)"
    n = f"({dx} * {dx} + {dy} * {dy})"
    t = f"coalesce(least(1.0, greatest(0.0, (({x} - {p}x1) * {dx} + ({y} - {p}y1) * {dy}) / nullif({n}, 0))), 0.0)"
    ex, ey = f"({x} - ({p}x1 + {t} * {dx}))", f"({y} - ({p}y1 + {t} * {dy}))"
    return f"({ex} * {ex} + {ey} * {ey})"


def side_sql(x: str, y: str, s: str) -> str:
    return f"(({x} - {s}.x1) * {s}.nx + ({y} - {s}.y1) * {s}.ny)"


def cross_sql(ax, ay, bx, by, px, py) -> str:
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def meets_sql(a: tuple, b: tuple) -> str:
    d1, d2 = cross_sql(*a, b[0], b[1]), cross_sql(*a, b[2], b[3])
    d3, d4 = cross_sql(*b, a[0], a[1]), cross_sql(*b, a[2], a[3])
    apart = " OR ".join(f"greatest({m[i]}, {m[i + 2]}) < least({n[i]}, {n[i + 2]})" for i in (0, 1) for m, n in ((a, b), (b, a)))
    return f"(NOT ({apart}) AND {d1} * {d2} <= 0 AND {d3} * {d4} <= 0)"


def ends(a: str) -> tuple:
    return f"{a}.x1", f"{a}.y1", f"{a}.x2", f"{a}.y2"


def segd2_sql(p: str, r: str) -> str:
    four = ", ".join([d2_sql(f"{p}.x1", f"{p}.y1", r), d2_sql(f"{p}.x2", f"{p}.y2", r), d2_sql(f"{r}.x1", f"{r}.y1", p), d2_sql(f"{r}.x2", f"{r}.y2", p)])
    return f"(CASE WHEN {meets_sql(ends(p), ends(r))} THEN 0.0 ELSE least({four}) END)"


PI = repr(math.pi)
VIEWS = f"""
WITH RECURSIVE beams AS (
  SELECT event_id AS point_id, event_id // 360 AS scan_id, CAST(event_id // 360 % 3 AS VARCHAR) AS robot_id, CAST(event_id % 360 AS INTEGER) AS beam,
    CASE WHEN user_id % 12 = 0 THEN value / 100 ELSE 1.5 + value / 5000 END AS rng FROM events WHERE value IS NOT NULL
), pts AS (
  SELECT point_id, scan_id, robot_id, beam, rng, CAST(scan_id // 56 * 10 + scan_id % 10 AS INTEGER) AS room_id, CAST((scan_id % 7) * 0.15 AS DOUBLE) AS px, CAST(floor(scan_id / 7) * 0.1 AS DOUBLE) AS py,
    beam * {STEP!r} + CAST(scan_id * 0.01 AS DOUBLE) AS angle,
    CAST((scan_id % 7) * 0.15 AS DOUBLE) + rng * cos(beam * {STEP!r} + CAST(scan_id * 0.01 AS DOUBLE)) AS x,
    CAST(floor(scan_id / 7) * 0.1 AS DOUBLE) + rng * sin(beam * {STEP!r} + CAST(scan_id * 0.01 AS DOUBLE)) AS y
  FROM beams WHERE rng > 0.12 AND rng < 3.5 AND rng < 3.0 AND rng > 0.2
), poses AS (
  SELECT DISTINCT scan_id, CAST(scan_id % 3 AS VARCHAR) AS robot_id, CAST((scan_id % 7) * 0.15 AS DOUBLE) AS x, CAST(floor(scan_id / 7) * 0.1 AS DOUBLE) AS y FROM beams
), seg0 AS (
  SELECT vec_id AS line_id, CAST(vec_id // 400 * 10 + label AS INTEGER) AS room_id, embedding[1]::DOUBLE * 10 AS x1, embedding[2]::DOUBLE * 10 AS y1, embedding[3]::DOUBLE * 10 AS x2, embedding[4]::DOUBLE * 10 AS y2,
    CAST((vec_id % 7) * 0.15 AS DOUBLE) AS robot_x, CAST((vec_id % 5) * 0.1 AS DOUBLE) AS robot_y, CAST(vec_id % 3 + 1 AS INTEGER) AS weight FROM embeddings
), seg1 AS (
  SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len, atan2(x1 - x2, y2 - y1) AS t0 FROM seg0
), seg2 AS (
  SELECT *, (x2 - x1) / nullif(len, 0) AS dx, (y2 - y1) / nullif(len, 0) AS dy, x1 * cos(t0) + y1 * sin(t0) AS r0 FROM seg1
), segs AS (
  SELECT *, -dy * (CASE WHEN (robot_x - x1) * -dy + (robot_y - y1) * dx < 0 THEN -1.0 ELSE 1.0 END) AS nx,
    dx * (CASE WHEN (robot_x - x1) * -dy + (robot_y - y1) * dx < 0 THEN -1.0 ELSE 1.0 END) AS ny,
    CASE WHEN t0 < 0 OR t0 >= {PI} THEN -r0 ELSE r0 END AS r, CASE WHEN t0 < 0 THEN t0 + {PI} WHEN t0 >= {PI} THEN t0 - {PI} ELSE t0 END AS theta,
    (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM seg2
), edges AS (
  SELECT a.line_id AS src, b.line_id AS dst, CASE WHEN a.line_id % 2 = 0 THEN 'corner' ELSE 'parallel' END AS type FROM segs a JOIN segs b ON b.line_id = a.line_id + 1 WHERE a.line_id % 3 = 0
), redges AS (
  SELECT a, a + 1 AS b FROM (SELECT DISTINCT room_id AS a FROM segs) WHERE a % 3 <> 2 AND a + 1 IN (SELECT room_id FROM segs)
), both_redges AS (SELECT a, b FROM redges UNION ALL SELECT b, a FROM redges
), labs AS (
  SELECT vec_id AS line_id, label AS old, CAST((label * 7 + vec_id) % 12 AS INTEGER) AS new FROM embeddings
), series AS (
  SELECT o_custkey AS k, o_orderkey AS i, o_totalprice::DOUBLE AS y FROM orders
), rects AS (
  SELECT room_id, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y, max(greatest(x1, x2)) AS max_x, max(greatest(y1, y2)) AS max_y,
    sum(len * (x1 + x2) / 2) / sum(len) AS cx, sum(len * (y1 + y2) / 2) / sum(len) AS cy FROM segs GROUP BY room_id
)"""
