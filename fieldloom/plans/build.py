"""The whole mapping pipeline over a table of scans: points, walls, rooms and their distance fields."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..functions import geometry as g
from ..operators import extract, field, graph, ingest, maintain, mapping, rooms, segments, spatial, spectral, visibility
from ..sources.staging import materialize


@dataclass
class World:
    """points, lines (of the final map, with room_id), rooms (boxes) and state (one field per room)."""

    points: DataFrame
    lines: DataFrame
    rooms: DataFrame
    state: DataFrame
    cfg: MapConfig

    def predict(self, queries: DataFrame) -> DataFrame:
        """Distance at queries (query_id, x, y): each goes to its room first."""
        asked = queries.select(F.col("query_id").alias("point_id"), "x", "y")
        found = rooms.identify_room(asked, self.rooms, self.lines).withColumnRenamed("point_id", "query_id")
        return field.predict_rooms(queries.join(found, "query_id"), self.state, self.lines, self.cfg)


def split_until_whole(lines: DataFrame, edges: DataFrame | None = None, cfg: MapConfig = DEFAULT) -> DataFrame:
    """The lines with room_id: rooms are split by their visibility graph until no part qualifies.

    A round takes all open parts at once. A part whose graph has several components falls
    into these; a connected one is split in two by ``spectral.split_parts`` or is whole. A
    part is named by its smallest line. Lines that see no other are put aside and in the end
    join the room of the line nearest to them, within ``vis_dist_thresh``.
    """
    cols = lines.columns
    todo, whole, i = materialize(lines, "world-open0"), [], 0
    while not todo.isEmpty():
        seen = materialize(visibility.visibility_edges(todo, edges, cfg).select("room_id", "p", "q", "weight"), f"world-seen{i}")
        root = materialize(graph.components(seen.select(F.col("p").alias("a"), F.col("q").alias("b")), "world-cc"), f"world-roots{i}")
        placed = todo.withColumn("_old", F.col("room_id")).join(root.withColumnRenamed("node", "line_id"), "line_id", "left").withColumn("room_id", F.coalesce("root", "line_id"))
        many = placed.where("root IS NOT NULL").groupBy("_old").agg((F.min("root") != F.max("root")).alias("_many"))
        parts = materialize(placed.join(many, "_old", "left").withColumn("_single", F.col("root").isNull()).select(*cols, "_single", F.coalesce("_many", F.lit(False)).alias("_many")), f"world-parts{i}")
        # weights depend on all lines of a room, so what has fallen apart is looked at anew in the next round
        one = parts.where("NOT _single AND NOT _many")
        linked = seen.drop("room_id").join(one.select(F.col("line_id").alias("p"), "room_id"), "p")
        side = materialize(spectral.split_parts(linked, cfg), f"world-sides{i}")
        name = side.groupBy("room_id", "part").agg(F.min("line_id").alias("_name"))
        split = side.groupBy("room_id").agg((F.max("part") > 0).alias("_split"))
        named = side.join(name, ["room_id", "part"]).join(split, "room_id").select("line_id", "_name", "_split")
        done = materialize(one.drop("_single", "_many").join(named, "line_id").withColumn("room_id", F.col("_name")).select(*cols, "_split"), f"world-rooms{i}")
        whole += [parts.where("_single").select(*cols, "_single"), done.where("NOT _split").select(*cols, F.lit(False).alias("_single"))]
        i += 1
        todo = materialize(parts.where("_many AND NOT _single").select(*cols).unionByName(done.where("_split").select(*cols)), f"world-open{i}")
    if not whole:
        return lines
    done = materialize(reduce(DataFrame.unionByName, whole).select(*cols, "_single"), "world-whole")
    near = segments.pairs_near(done.withColumn("_all", F.lit(0)), cfg.vis_dist_thresh, key="_all").where("p._single AND NOT q._single")
    near = near.withColumn("_d2", g.segments_distance2(segments._ends("p"), segments._ends("q"))).where(F.col("_d2") <= cfg.vis_dist_thresh**2)
    into = near.groupBy(F.col("p.line_id").alias("line_id")).agg(F.min(F.struct("_d2", "q.line_id", F.col("q.room_id").alias("room")))["room"].alias("_into"))
    return done.join(into, "line_id", "left").withColumn("room_id", F.coalesce("_into", "room_id")).select(*cols)


def build(scans: DataFrame, increment: float, cfg: MapConfig = DEFAULT, prior: bool = True) -> World:
    """Build the map of every robot.

    Points off the walls (clusters that are no line and what lines leave over, without those
    whose centre lies at a wall) feed the fields. Only poses, walls and voxels are grouped by
    robot or room; all else is row by row or by scan.
    """
    poses = scans.select("robot_id", "scan_id", F.col("robot_pose.x").alias("x"), F.col("robot_pose.y").alias("y"))
    kept = ingest.pose_gate(poses, cfg.pose_gate)
    pts = ingest.scan_to_points(scans.join(kept, ["robot_id", "scan_id"]), cfg).withColumn("room_id", F.lit(0))
    clusters = materialize(segments.ring_pass(segments.breakpoints(pts, increment, cfg), cfg), "world-points")
    line_like = clusters.where("status = 'line'")
    found = materialize(extract.extract_segments(line_like, cfg), "world-segments")
    robots = found.select("robot_id").distinct().withColumn("_robot", F.row_number().over(Window.orderBy("robot_id")) - 1)  # a row a robot
    lines = mapping.build_map(found, cfg)
    pose = found.groupBy("robot_id").agg(F.avg("robot_x").alias("robot_x"), F.avg("robot_y").alias("robot_y"))
    dx, dy = g.direction("x1", "y1", "x2", "y2")
    number = F.shiftleft(F.col("_robot").cast("long"), 32) + F.col("line_id")
    lines = lines.join(robots, "robot_id").join(pose, "robot_id").withColumn("line_id", number).withColumn("room_id", F.col("_robot").cast("long") + 1).withColumn("dx", dx).withColumn("dy", dy).drop("_robot")
    lines = materialize(lines, "world-lines")
    chained = materialize(mapping.line_graph(extract.chain_edges(found), found, lines, cfg), "world-chains")
    lines, edges = maintain.process_lines(lines, chained, cfg)
    lines = split_until_whole(materialize(lines, "world-kept"), materialize(edges, "world-edges"), cfg)
    boxes = rooms.room_rect(lines)
    left = clusters.where("status = 'residual'").select(*segments.CLUSTER, "beam", "x", "y").unionByName(extract.residual_points(line_like, cfg))
    centres = left.groupBy(*segments.CLUSTER).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    at_wall = spatial.points_near_segments(centres, lines.select("robot_id", "x1", "y1", "x2", "y2"), cfg.residual_radius).where(F.col("robot_id") == F.col("s.robot_id")).select(*segments.CLUSTER).distinct()
    placed = materialize(left.join(at_wall, list(segments.CLUSTER), "left_anti").withColumn("point_id", F.concat_ws("/", "robot_id", "scan_id", "beam")).select("point_id", "x", "y"), "world-residual")
    in_room = rooms.identify_room(placed, boxes, lines)
    voxels = field.voxel_downsample(placed.join(in_room, "point_id"), cfg.r_voxel)
    state = materialize(field.fit_rooms(voxels.select("room_id", F.lit(0).alias("batch"), "x", "y"), lines if prior else None, cfg), "world-fields", field.STATES)
    return World(clusters, lines, boxes, state, cfg)
