"""Rooms and their fields as the state of a stream of line maps.

A micro-batch holds each robot's lines, pose and off-wall points after its scans. The state
is a set of tables, one version a batch: batch b starts from version b - 1 and writes version
b, so a batch that is run again after a failure gives the same version (exactly once).
Within a batch rooms change first, then the fields follow, then new points are added.

Rooms of different robots are told by ``map_id`` in their upper bits (``ROOM_BITS``).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..operators import field, graph, rooms, spectral, visibility
from ..sources.schema import GP_STATE
from ..sources.staging import materialize

ROOM_BITS = 24
_SCHEMAS = {"labels": "map_id long, line_id long, room int", "edges": "a long, b long", "current": "map_id long, room int", "states": GP_STATE}


@dataclass
class RoomState:
    """labels: the room of each line of each map; edges: rooms next to each other (a < b, as keys); current: where the robot is; states: a field a room (key)."""

    labels: DataFrame
    edges: DataFrame
    current: DataFrame
    states: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> RoomState:
        return RoomState(*[spark.createDataFrame([], s) for s in _SCHEMAS.values()])

    def save(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.option("maxRecordsPerFile", field.STATES if f.name == "states" else 0).mode("overwrite").parquet(f"{path}/{f.name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RoomState:
        return RoomState(*[spark.read.schema(s).parquet(f"{path}/{name}") for name, s in _SCHEMAS.items()])


def room_key(map_id: str = "map_id", room: str = "room"):
    return F.shiftleft(F.col(map_id).cast("long"), ROOM_BITS) + F.col(room)


def step(state: RoomState, lines: DataFrame, poses: DataFrame, points: DataFrame, line_edges: DataFrame, cfg: MapConfig = DEFAULT) -> RoomState:
    """The state after one update of the maps.

    ``lines``: all lines of the maps (map_id, line_id, ends, directions, normals, r, theta,
    robot_x, robot_y), line_id unique over all maps; ``poses``: where each robot is (map_id,
    x, y); ``points``: new points off the walls (map_id, point_id, x, y); ``line_edges``:
    src, dst, type. New lines belong to the current room. Rooms of a single line next to the
    robot are absorbed by a neighbour; the lines around it are clustered anew and carry their
    labels on. Maps not in ``lines`` are dropped; a map seen first starts in room 0.
    """
    lines = materialize(lines, "room-lines")
    maps = lines.select("map_id").distinct()
    current = maps.join(state.current, "map_id", "left").select("map_id", F.coalesce("room", F.lit(0)).alias("current"))
    held = lines.select("map_id", "line_id").join(state.labels, ["map_id", "line_id"], "left").join(current, "map_id")
    held = materialize(held.select("map_id", "line_id", F.coalesce("room", "current").alias("old"), "current", F.col("room").isNull().alias("is_new")), "room-held")
    known = materialize(held.select(room_key(room="old").alias("room_id"), "map_id", F.col("old").alias("room")).distinct(), "room-names")

    # the current rooms and those next to them; single-line rooms among them go to a neighbour
    here = current.select(room_key(room="current").alias("room_id"))
    near = state.edges.join(here.withColumnRenamed("room_id", "a"), "a").select(F.col("b").alias("room_id")).unionByName(state.edges.join(here.withColumnRenamed("room_id", "b"), "b").select(F.col("a").alias("room_id")))
    around = here.unionByName(near).distinct()
    mine = held.withColumn("room_id", room_key(room="old"))
    alone = rooms.absorb_singletons(mine.join(around, "room_id", "left_semi"), state.edges.join(known.select(F.col("room_id").alias("a")), "a").join(known.select(F.col("room_id").alias("b")), "b"))
    into = alone.join(known.select(F.col("room_id").alias("into"), F.col("room").alias("_room")), "into")
    local = mine.join(around, "room_id", "left_semi").join(into.select("room_id", "_room"), "room_id", "left").withColumn("was", F.col("old")).withColumn("old", F.coalesce("_room", "old"))
    local = local.withColumn("current", F.when(F.col("was") == F.col("current"), F.coalesce("_room", "current")).otherwise(F.col("current")))
    top = local.groupBy("map_id").agg(F.max(F.when(F.col("was") == F.col("current"), F.col("current"))).alias("_c"))
    local = materialize(local.join(top, "map_id").withColumn("current", F.coalesce("_c", "current")).select("map_id", "line_id", "was", "old", "current", "is_new"), "room-local")

    shown = lines.join(local.select("line_id"), "line_id", "left_semi").withColumn("room_id", F.col("map_id"))
    seen = materialize(visibility.visibility_edges(shown, line_edges, cfg), "room-seen")
    linked = graph.connected(seen, shown.select("room_id", F.col("line_id").alias("node"))).withColumnRenamed("room_id", "map_id")
    clusters = spectral.local_clusters(local.select("map_id", "line_id", "old", "current", "is_new"), linked, cfg)
    label = spectral.relabel_rooms(clusters, rooms=known.select("map_id", F.col("room").alias("label")))
    found = held.select("map_id", "line_id", "old").join(label.select("line_id", "label"), "line_id", "left")
    labels = materialize(found.select("map_id", "line_id", F.coalesce("label", "old").alias("room"), "old"), "room-labels")

    # what has changed, by keys; the room graph follows
    both = labels.select("map_id", "line_id", room_key(room="old").alias("old"), room_key().alias("new"))
    changes = materialize(rooms.room_changes(both), "room-changes")
    of = both.select(F.col("line_id").alias("p"), F.col("new").alias("room"))
    sight = seen.select("p", "q").unionByName(seen.select(F.col("q").alias("p"), F.col("p").alias("q")))
    boundary = sight.join(of, "p").join(both.select(F.col("line_id").alias("q"), F.col("new").alias("neighbour")), "q").where("room != neighbour").select("room", "neighbour").distinct()
    edges = materialize(rooms.rewire(state.edges, changes.select("from_room", "to_room", "kind"), boundary), "room-edges")

    # fields: changes first, then points
    placed = lines.join(both.select("line_id", "old", "new"), "line_id").withColumn("room_id", F.col("new"))
    moved = field.moved_points(state.states, placed)
    states = field.follow_changes(state.states, changes, moved, placed, cfg)
    boxes = materialize(rooms.room_rect(placed), "room-boxes")
    of_map = boxes.withColumn("map_id", F.shiftright("room_id", ROOM_BITS)).select("map_id", "room_id")

    def room_of(asked: DataFrame) -> DataFrame:
        return rooms.assign_points(asked.select("point_id", "x", "y"), boxes, placed, asked.select("point_id", "map_id").join(of_map, "map_id").select("point_id", "room_id"))

    at = room_of(poses.join(maps, "map_id", "left_semi").select(F.col("map_id").alias("point_id"), "map_id", "x", "y"))
    now = at.select(F.col("point_id").alias("map_id"), (F.col("room_id") - F.shiftleft(F.col("point_id"), ROOM_BITS)).cast("int").alias("room"))
    now = materialize(current.join(now, "map_id", "left").select("map_id", "current", F.coalesce("room", "current").alias("room")), "room-now")
    walked = now.where("current != room").select(F.least(room_key(room="current"), room_key()).alias("a"), F.greatest(room_key(room="current"), room_key()).alias("b"))
    live = both.select(F.col("new").alias("room_id")).distinct()
    edges = edges.unionByName(walked).distinct().join(live.select(F.col("room_id").alias("a")), "a", "left_semi").join(live.select(F.col("room_id").alias("b")), "b", "left_semi").select("a", "b")
    off = points.join(room_of(points), "point_id").select("room_id", "x", "y")
    states = field.update_rooms(states, off, placed, cfg)
    return RoomState(labels.select("map_id", "line_id", "room"), edges, now.select("map_id", "room"), states)


def follow(path: str, cfg: MapConfig = DEFAULT):
    """A function for ``foreachBatch`` over rows of four structs, each of which may be null: line, pose, point and edge, as ``step`` takes them.

    Use: ``stream.writeStream.foreachBatch(follow(path))``. Each batch's tables are under
    ``path``/version=b; older versions may be removed once the next one is complete.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = RoomState.load(spark, f"{path}/version={batch_id - 1}") if batch_id else RoomState.empty(spark)
        batch = materialize(batch, "room-batch")
        pick = lambda kind: batch.where(F.col(kind).isNotNull()).select(f"{kind}.*")
        step(state, pick("line"), pick("pose"), pick("point"), pick("edge"), cfg).save(f"{path}/version={batch_id}")

    return run
