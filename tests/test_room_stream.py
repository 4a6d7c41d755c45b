"""Rooms and fields as the state of a stream, against the same steps one by one and against an exact regression."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.config import DEFAULT
from fieldloom.operators import field, rooms, spectral
from fieldloom.streaming.rooms import RoomState, follow, step

from .test_map_rules import corridor

LINE = "map_id long, line_id long, x1 double, y1 double, x2 double, y2 double, nx double, ny double, dx double, dy double, r double, theta double, robot_x double, robot_y double"
POSE, POINT, EDGE = "map_id long, x double, y double", "map_id long, point_id long, x double, y double", "src long, dst long, type string"


def updates():
    """Two maps of two rooms each: the robot sees the first room, then both, walks into the second and comes back."""
    rows, edges, of = corridor(2)
    lines = [(m, 1000 * m + r[0], *r[2:14]) for m in (1, 2) for r in rows if of[r[0]] < 2]
    room = {line[1]: of[line[1] % 1000] for line in lines}
    links = [(1000 * m + a, 1000 * m + b, kind) for m in (1, 2) for a, b, kind in edges]
    poses = [(1.5, 1.5), (1.6, 1.4), (4.7, 1.5), (1.5, 1.5)]
    out = []
    for i, (x, y) in enumerate(poses):
        shown = [line for line in lines if i or room[line[1]] == 0]
        known = {line[1] for line in shown}
        points = [(m, 100 * i + 10 * m + k, x + 0.3 * k, y + 0.25) for m in (1, 2) for k in range(3)]
        out.append((shown, [(m, x, y) for m in (1, 2)], points, [e for e in links if e[0] in known and e[1] in known]))
    return out, room


def tables(spark, update):
    return [spark.createDataFrame(rows, schema) for rows, schema in zip(update, (LINE, POSE, POINT, EDGE))]


@pytest.fixture(scope="module")
def loop(spark):
    state, found = RoomState.empty(spark), []
    for update in updates()[0]:
        state = step(state, *tables(spark, update))
        found.append({name: [tuple(r) for r in getattr(state, name).collect()] for name in ("labels", "edges", "current", "states")})
    return found


def test_rooms_are_found_and_kept(loop):
    _, room = updates()
    one = {line: label for _, line, label in loop[0]["labels"]}
    assert set(one.values()) == {0} and loop[0]["edges"] == []
    for later in loop[1:]:
        label = {line: name for _, line, name in later["labels"]}
        for m in (1, 2):
            kinds = {(room[line], name) for line, name in label.items() if line // 1000 == m}
            assert len(kinds) == 2 and len({name for _, name in kinds}) == 2
        assert sorted(later["edges"]) == [(m << 24, (m << 24) + 1) for m in (1, 2)]
    first, second, third = (sorted(found["current"]) for found in loop[1:])
    assert first == third and all(a[0] == b[0] and a[1] != b[1] for a, b in zip(first, second))
    assert loop[1]["labels"] and sorted(loop[1]["labels"]) == sorted(loop[3]["labels"])  # the second visit keeps labels


def test_stream_equals_the_loop(spark, tmp_path, loop):
    """A file a batch; a batch that runs again gives the same version."""
    kind = f"line struct<{LINE.replace(' ', ':').replace(',:', ',')}>, pose struct<{POSE.replace(' ', ':').replace(',:', ',')}>, point struct<{POINT.replace(' ', ':').replace(',:', ',')}>, edge struct<{EDGE.replace(' ', ':').replace(',:', ',')}>"
    for i, update in enumerate(updates()[0][:3]):
        rows = [tuple(r if j == k else None for j in range(4)) for k, part in enumerate(update) for r in part]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        source.writeStream.foreachBatch(follow(str(tmp_path / "rooms"))).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
        got = RoomState.load(spark, str(tmp_path / f"rooms/version={i}"))
        for name in ("labels", "edges", "current"):
            assert sorted(map(tuple, getattr(got, name).collect())) == sorted(loop[i][name])
    states = {r.room_id: r for r in got.states.collect()}
    want = {r[0]: r for r in loop[2]["states"]}
    assert states.keys() == want.keys() and all(np.allclose(states[k].mean, want[k][5], atol=1e-9) for k in want)


def test_fields_after_batches_are_exact(spark):
    """Points in three batches, with new rooms and merges between, give the exact regression while all points are inducing."""
    pts = [(7, 0.5 * k, 0.4 * (k % 3)) for k in range(9)]
    none = spark.createDataFrame([], "room_id long, line_id long, x1 double, y1 double, x2 double, y2 double")
    state = spark.createDataFrame([], RoomState.empty(spark).states.schema)
    for at in range(0, 9, 3):
        state = field.update_rooms(state, spark.createDataFrame(pts[at : at + 3], "room_id long, x double, y double"), none).cache()
    r = state.first()
    z = np.array([(x, y) for _, x, y in pts])
    k = field.kernel(z, z, DEFAULT.lamb)
    exact = k @ np.linalg.solve(k + DEFAULT.noise * np.eye(9), np.ones(9))
    order = [np.abs(z - np.array(p)).sum(1).argmin() for p in zip(r.zx, r.zy)]
    assert r.m == 9 and np.allclose(np.asarray(r["mean"]), exact[order], atol=1e-5)


def test_rewiring_is_that_of_a_loop(spark):
    rng = np.random.default_rng(3)
    edges = {tuple(sorted(map(int, rng.integers(0, 12, 2)))) for _ in range(25)}
    edges = {e for e in edges if e[0] != e[1]}
    changes = [(2, 20, "new_room"), (5, 21, "new_room"), (7, 3, "merged_rooms"), (8, 4, "moved_lines")]
    boundary = [(20, 2), (20, 1), (20, 6), (21, 9), (21, 20), (4, 8)]
    want = set(edges)
    for source, target, kind in changes:
        if kind == "new_room":
            for room, n in boundary:
                if room == target and n not in (source, target):
                    want.discard(tuple(sorted((n, source))))
    for source, target, kind in changes:
        if kind == "new_room":
            want |= {tuple(sorted((source, target)))} | {tuple(sorted((room, n))) for room, n in boundary if room == target and n not in (source, target)}
    for source, target, kind in changes:
        if kind == "merged_rooms":
            want = {tuple(sorted(target if x == source else x for x in e)) for e in want}
    want = {e for e in want if e[0] != e[1]}
    got = rooms.rewire(spark.createDataFrame(sorted(edges), "a long, b long"), spark.createDataFrame(changes, "from_room long, to_room long, kind string"), spark.createDataFrame(boundary, "room long, neighbour long"))
    assert {(r.a, r.b) for r in got.collect()} == want


def blocks(sizes, between):
    """Weights of groups of lines: 1 within a group, ``between`` across."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    w = np.where(group[:, None] == group[None], 1.0, between)
    np.fill_diagonal(w, 0)
    return w, group


def test_clusters_split_merge_and_stay():
    w, group = blocks((5, 5), 1e-3)
    split = spectral.cluster_local(w, np.zeros(10, int), 0, True)
    assert len(set(split)) == 2 and (split[:5] == split[0]).all() and (split[5:] == split[5]).all()
    stay = spectral.cluster_local(w, group, 0, True)
    assert len(set(stay)) == 2 and all(len(set(stay[group == g])) == 1 for g in (0, 1))
    one, _ = blocks((10,), 0.0)
    assert set(spectral.cluster_local(one, group, 0, True)) == {0}  # two rooms that are one
    three, label = blocks((5, 10), 1e-3)
    halves = np.repeat([0, 1, 2], 5)
    merged = spectral.cluster_local(three, halves, 0, True)
    assert len(set(merged)) == 2 and len(set(merged[5:])) == 1
    assert (spectral.cluster_local(three, halves, 0, False) == halves).all()  # nothing new, nothing merged


def test_labels_of_rooms_out_of_sight_are_not_reused(spark):
    lines = spark.createDataFrame([(1, i, 0, int(i >= 4), 0) for i in range(8)], "map_id long, line_id long, old int, local int, current int")
    far = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "map_id long, label int")
    assert sorted({r.label for r in spectral.relabel_rooms(lines, rooms=far).collect()}) == [0, 3]
