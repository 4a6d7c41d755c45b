import math
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.config import DEFAULT
from fieldloom.functions import geometry as g
from fieldloom.operators import extract, field, graph, ingest, mapping, metrics, segments, spatial, spectral
from fieldloom.sources import scans as source

from .worlds import BOX, scans


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_geometry_edges(spark):
    c = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = one(
        spark,
        g.segment_distance2(3.0, 4.0, 0.0, 0.0, 0.0, 0.0), g.intersects(c(0, 0, 2, 0), c(2, 0, 3, 1)), g.intersects(c(0, 0, 1, 0), c(2, 0, 3, 0)),
        g.segments_distance2(c(0, 0, 2, 0), c(1, -1, 1, 1)), g.lines_meet(1.0, 0.5, 2.0, 0.5)[0], g.log_distance(0.0, 100.0), g.log_distance(-1.0, 100.0),
        g.log_distance(math.exp(-50), 100.0), g.contour_band(0.1), g.contour_band(0.25), g.contour_band(9.0),
    )
    assert r[0] == 25 and r[1] is True and r[2] is False and r[3] == 0 and r[4] is None and r[5] == math.inf and math.isnan(r[6])
    assert r[7] == pytest.approx(0.5) and list(r[8:]) == [0, 1, 9]


def test_projection_is_idempotent_and_on_the_line(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([tuple(map(float, v)) for v in rng.uniform(-3, 3, (50, 4))], "x double, y double, r double, theta double")
    fx, fy = g.project("x", "y", "r", "theta")
    hx, hy = g.project("fx", "fy", "r", "theta")
    for row in df.withColumn("fx", fx).withColumn("fy", fy).select("fx", "fy", hx.alias("hx"), hy.alias("hy"), g.polar("fx", "fy", "r", "theta").alias("d")).collect():
        assert (row.hx, row.hy, row.d) == (pytest.approx(row.fx), pytest.approx(row.fy), pytest.approx(0, abs=1e-12))


def test_scan_source_and_gate(spark, tmp_path):
    df = scans(spark, [(0, 0), (0.1, 0), (0.19, 0), (0.25, 0), (0.4, 0), (0.6, 0)])
    for fmt in ("parquet", "json"):
        df.write.format(fmt).save(str(tmp_path / fmt))
        assert source.read_scans(spark, str(tmp_path / fmt), fmt).count() == 6
    assert source.first_scans(df, 2).count() == 2
    poses = df.select("robot_id", "scan_id", F.col("robot_pose.x").alias("x"), F.col("robot_pose.y").alias("y"))
    assert [r.scan_id for r in ingest.pose_gate(poses).orderBy("scan_id").collect()] == [0, 3, 5]
    pts = ingest.scan_to_points(df)
    assert pts.select("point_key").distinct().count() == pts.count() > 0
    noisy = ingest.scan_to_points(df, replace(DEFAULT, std_dev=0.02))
    assert noisy.count() == pts.count() and noisy.agg(F.sum("x")).first() != pts.agg(F.sum("x")).first()
    assert ingest.scan_to_points(df.limit(0)).count() == 0


def test_line_fit_on_walls(spark):
    rows = [("flat", float(x), 1.5) for x in np.linspace(-1, 1, 40)] + [("steep", float(2.0 + 1e-7 * y), float(y)) for y in np.linspace(-1, 1, 40)] + [("diag", float(x), float(x)) for x in np.linspace(0, 1, 40)]
    fit = {r.k: r for r in segments.line_fit(spark.createDataFrame(rows, "k string, x double, y double"), ("k",)).collect()}
    assert (fit["flat"].r, fit["flat"].theta) == (pytest.approx(1.5), pytest.approx(math.pi / 2))
    t = fit["steep"].theta
    assert min(t, math.pi - t) < 1e-6 and abs(fit["steep"].r) == pytest.approx(2.0)
    assert fit["diag"].r == pytest.approx(0, abs=1e-9) and fit["diag"].theta == pytest.approx(3 * math.pi / 4)


def clustered(spark, poses=((0.3, 0.2),)):
    pts = ingest.scan_to_points(scans(spark, poses)).withColumn("room_id", F.lit(0))
    return segments.breakpoints(pts, 2 * math.pi / 360)


def test_box_is_four_walls(spark):
    found = extract.extract_segments(clustered(spark)).collect()
    assert len(found) >= 4
    for s in found:
        offset = [abs(abs(s.r) - 2.0), min(abs(s.theta - a) for a in (0, math.pi / 2, math.pi))]
        assert max(offset) < 0.05
    sides = {(round(s.nx), round(s.ny)) for s in found}
    assert sides == {(1, 0), (-1, 0), (0, 1), (0, -1)}


def test_map_merges_the_same_walls(spark):
    s = extract.extract_segments(clustered(spark, [(0.3, 0.2), (0.0, 0.0), (-0.3, 0.1)]))
    lines = mapping.build_map(s).collect()
    assert {(round(x.nx), round(x.ny)) for x in lines} == {(1, 0), (-1, 0), (0, 1), (0, -1)}
    assert len(lines) <= 6 and max(x.weight for x in lines) >= 3


def test_world_distance_field(spark):
    from fieldloom.plans.build import build

    poses = [(0.0, 0.0), (0.5, 0.3), (-0.5, -0.3), (0.9, -0.6)]
    world = build(scans(spark, poses), 2 * math.pi / 360)
    grid = [(i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in np.linspace(-1.7, 1.7, 6) for y in np.linspace(-1.7, 1.7, 6))]
    got = {r.query_id: r.distance for r in world.predict(spark.createDataFrame(grid, "query_id long, x double, y double")).collect()}
    assert len(got) == len(grid)
    for i, x, y in grid:
        assert got[i] == pytest.approx(min(2 - abs(x), 2 - abs(y)), abs=0.06)


def test_grid_join_is_the_nested_loop(spark):
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.uniform(-3, 3, (300, 2)))], "point_id int, x double, y double")
    segs = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rng.uniform(-3, 3, (40, 4)))], "line_id int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.point_id, r.l) for r in spatial.points_near_segments(pts, segs, 0.4).select("point_id", F.col("s.line_id").alias("l")).collect()}
    want = {(r.point_id, r.line_id) for r in pts.join(segs, g.segment_distance2("x", "y", "x1", "y1", "x2", "y2") <= 0.16).collect()}
    assert got == want


def test_components_and_chain(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (20, 20), (11, 10)], "a long, b long")
    got = {r.node: r.root for r in graph.components(e).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7, 10: 10, 11: 10}
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in graph.components(chain).collect()} == {0}
    m = spark.createDataFrame([(0, n, r) for n, r in got.items()], "room_id int, node long, root long")
    assert sorted((r.p, r.q) for r in graph.connect_components(m).collect()) == [(8, 9), (8, 10)] or graph.connect_components(m).count() == 2


def test_spectral_split():
    w = np.zeros((8, 8))
    w[:4, :4] = w[4:, 4:] = 1
    np.fill_diagonal(w, 0)
    w[0, 4] = w[4, 0] = 0.05
    parts = spectral.split_graph(w)
    assert parts.tolist() == [0] * 4 + [1] * 4 and spectral.eigengap(spectral.laplacian_spectrum(w)[0][:4]) == 2
    assert spectral.split_graph(np.ones((5, 5)) - np.eye(5)).tolist() == [0] * 5


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for n, m in ((3, 3), (4, 6), (5, 2)):
        c = rng.normal(size=(n, m))
        k = min(n, m)
        best = min(sum(c[i, j] for i, j in zip(range(n), p)) for p in permutations(range(m), k)) if n <= m else min(sum(c[i, j] for j, i in enumerate(p)) for p in permutations(range(n), k))
        assert sum(c[i, j] for i, j in spectral.assign(c)) == pytest.approx(best)


def test_field_equals_exact_regression():
    rng = np.random.default_rng(3)
    cfg = replace(DEFAULT, inducing_thresh=2.0, gp_jitter=1e-10)  # every point is kept
    x = rng.uniform(0, 2, (40, 2))
    f = field.Field.empty()
    for b in np.split(x, 4):
        f = field.update(f, b, cfg)
    k = field.kernel(x, x, cfg.lamb)
    exact = k @ np.linalg.solve(k + cfg.noise * np.eye(len(x)), np.ones(len(x)))
    assert np.abs(f.mean - exact).max() < 1e-6


def test_isolated_point_in_closed_form():
    f = field.update(field.Field.empty(), np.array([[0.0, 0.0]]))
    assert f.mean[0] == pytest.approx(1 / (1 + DEFAULT.noise), abs=1e-5)
    mu, d, grad = field.predict(f, np.array([[0.05, 0.0]]), gradient=True)
    assert d[0] == pytest.approx(0.05 + math.log(1 + DEFAULT.noise) / DEFAULT.lamb, abs=1e-4)
    assert grad[0] == pytest.approx([1, 0])
    assert field.predict(f, np.array([[9.0, 0.0]]))[1][0] == math.inf


def test_split_merge_adjust_keep_points():
    rng = np.random.default_rng(4)
    f = field.update(field.Field.empty(), rng.uniform(0, 5, (60, 2)))
    right = f.z[:, 0] > 2.5
    a, b = field.split(f, right)
    assert len(a.z) + len(b.z) == len(f.z)
    m = field.merge(a, b)
    assert sorted(map(tuple, m.z)) == sorted(map(tuple, f.z)) and m.cov.shape == (len(f.z),) * 2
    moved = a.z[:, 1] > 2.5
    stay, grown = field.adjust(a, b, moved)
    assert len(stay.z) == (~moved).sum() and len(b.z) < len(grown.z) <= len(b.z) + moved.sum()
    out = field.apply_changes({0: f}, [(0, 1, "new_room", right), (1, 0, "merged_rooms", np.zeros(0, bool))])
    assert set(out) == {0} and len(out[0].z) == len(f.z)


def test_room_fields_on_spark(spark):
    rng = np.random.default_rng(5)
    wall = [(r, 0, float(x), float(1.0 + r)) for r in (0, 1) for x in rng.uniform(0, 3, 200)]
    pts = spark.createDataFrame(wall, "room_id int, batch int, x double, y double")
    vox = field.voxel_downsample(pts).withColumn("batch", F.lit(0))
    state = field.fit_rooms(vox.select("room_id", "batch", "x", "y"))
    q = spark.createDataFrame([(i, i % 2, 0.5 + 0.1 * i, 1.05 + i % 2) for i in range(20)], "query_id long, room_id int, x double, y double")
    got = field.predict_rooms(q, state).collect()
    assert len(got) == 20 and all(0.03 < r.distance < 0.16 for r in got)


def test_fields_follow_room_changes(spark):
    """On Spark as in one process: a new room, moved points, a merge; a room without changes stays."""
    rng = np.random.default_rng(8)
    pts = {r: rng.uniform(0, 3, (40, 2)) + 5 * r for r in range(5)}
    rows = [(r, 0, float(x), float(y)) for r, p in pts.items() for x, y in p]
    state = field.fit_rooms(spark.createDataFrame(rows, "room_id int, batch int, x double, y double")).cache()
    before = {r.room_id: field._field(r.asDict()) for r in state.collect()}
    right = {r: np.flatnonzero(f.z[:, 0] > np.median(f.z[:, 0])) for r, f in before.items()}
    changes = [(0, 9, "new_room"), (1, 2, "moved_lines"), (3, 2, "merged_rooms")]
    moved = [(r, int(i), t) for r, t in ((0, 9), (1, 2)) for i in right[r]]
    lines = spark.createDataFrame([], "room_id long, line_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.room_id: r for r in field.follow_changes(state, spark.createDataFrame(changes, "from_room int, to_room int, kind string"), spark.createDataFrame(moved, "room_id int, i int, to_room int"), lines).collect()}
    mask = lambda r: np.isin(np.arange(len(before[r].z)), right[r])
    want = field.apply_changes(dict(before), [(0, 9, "new_room", mask(0)), (1, 2, "moved_lines", mask(1)), (3, 2, "merged_rooms", np.zeros(len(before[3].z), bool))])
    assert sorted(got) == sorted(want) == [0, 1, 2, 4, 9] and got[4].version == 1 and got[2].version == 2
    for r, f in want.items():
        assert np.allclose(np.column_stack((got[r].zx, got[r].zy)), f.z) and np.allclose(got[r].mean, f.mean)
        assert np.allclose(got[r].weights, field.weights(f, np.zeros((0, 4)), DEFAULT))


def test_the_prior_of_many_lines_is_held_in_parts():
    """All lines count, in parts of any size, and the memory does not grow with points times lines."""
    import tracemalloc

    rng = np.random.default_rng(12)
    x, segs = rng.uniform(-3, 3, (200, 2)), rng.uniform(-3, 3, (4000, 4))
    segs[3999] = [*x[7], 9, 9]
    tracemalloc.start()
    got = field.segment_prior(x, segs, 10.0)
    assert tracemalloc.get_traced_memory()[1] < 20e6  # all pairs at once took 32 MB
    tracemalloc.stop()
    assert got[7] == 1.0 and np.array_equal(got, field.segment_prior(x, segs, 10.0, 1)) and np.array_equal(got, field.segment_prior(x, segs, 10.0, 1 << 40))


def test_states_are_kept_a_few_a_file_and_follow_with_their_lines(spark):
    """A file holds at most the states asked for; after a move the weights are those above the prior of the rooms' lines."""
    from fieldloom.sources.staging import materialize

    rng = np.random.default_rng(18)
    rows = [(r, 0, float(x), float(y)) for r in range(9) for x, y in rng.uniform(0, 2, (12, 2)) + 5 * r]
    fitted = field.fit_rooms(spark.createDataFrame(rows, "room_id int, batch int, x double, y double").coalesce(1))
    state = materialize(fitted, "states", rows_per_file=2)
    assert len(state.inputFiles()) >= 5 and state.count() == 9
    lines = spark.createDataFrame([(r, r, 5.0 * r, 0.0, 5.0 * r, 9.0) for r in (0, 1, 20)], "room_id long, line_id long, x1 double, y1 double, x2 double, y2 double")
    changes, moved = spark.createDataFrame([(0, 1, "moved_lines")], "from_room int, to_room int, kind string"), spark.createDataFrame([(0, 3, 1)], "room_id int, i int, to_room int")
    for r in field.follow_changes(state, changes, moved, lines).where("room_id < 2").collect():
        f = field._field(r.asDict())
        assert r.m == len(f.z) == (11, 13)[r.room_id] and np.allclose(r.weights, field.weights(f, np.array([[5.0 * r.room_id, 0, 5.0 * r.room_id, 9]]), DEFAULT))


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_fields_fitted_where_they_change_are_the_states_followed(spark):
    """As fit_rooms and follow_changes one after the other, in two batches; groups take points, not states."""
    rng = np.random.default_rng(21)
    rows = [(r, b, float(x), float(y)) for r in range(6) for b in (0, 1) for x, y in rng.uniform(0, 1.5, (25, 2)) + 5 * r]
    points = spark.createDataFrame(rows, "room_id int, batch int, x double, y double").repartition(3)
    state = field.fit_rooms(points).cache()
    z = {r.room_id: (r.zx, r.zy) for r in field.inducing_points(points).collect()}
    assert z == {r.room_id: (r.zx, r.zy) for r in state.collect()} and all(25 < len(x) < 50 for x, _ in z.values())
    changes = spark.createDataFrame([(0, 9, "new_room"), (1, 2, "moved_lines"), (3, 2, "merged_rooms"), (8, 1, "moved_lines")], "from_room int, to_room int, kind string")
    moved = spark.createDataFrame([(r, i, t) for r, t in ((0, 9), (1, 2)) for i in range(0, 20, 2)], "room_id int, i int, to_room int")
    lines = spark.createDataFrame([(r, r, 5.0 * r, 0.0, 5.0 * r, 9.0) for r in (0, 2, 20)], "room_id long, line_id long, x1 double, y1 double, x2 double, y2 double")
    want = {r.room_id: r for r in field.follow_changes(state, changes, moved, lines).collect()}
    out = field.fit_changed(points, changes, moved, lines)
    got = {r.room_id: r for r in out.collect()}
    assert got == want and sorted(got) == [0, 1, 2, 4, 5, 9] and got[4].version == 2 and got[2].version == 3


def test_follow_changes_keeps_no_state_on_disk(spark, small):
    """What the query writes or shuffles to its groups has no matrix of inducing points."""
    from urllib.parse import urlparse

    from fieldloom.plans import room_queries

    shared = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path)
    there = set(shared.iterdir())
    out = room_queries.follow_changes(spark, small)
    wrote = [p for d in set(shared.iterdir()) - there for p in d.rglob("*.parquet")]
    assert wrote and not any("array<array" in spark.read.parquet(str(p)).schema.simpleString() for p in wrote)
    grouped = [n for n in _nodes(out._jdf.queryExecution().sparkPlan()) if "Groups" in n.nodeName()]
    assert grouped and not any("array<array" in n.children().apply(i).schema().simpleString() for n in grouped for i in range(n.children().size()))
    assert out.count() > 0


def test_lines_of_fine_cells_are_chosen_where_they_are_met(spark):
    """The pairs of fine cells and lines are not shuffled, and each cell keeps the nearest line of its middle."""
    rng = np.random.default_rng(22)
    points = spark.createDataFrame([(i, i % 2, *map(float, rng.uniform(-6, 6, 2))) for i in range(60)], "point_id int, room_id int, x double, y double")
    ends = rng.uniform(-6, 6, (80, 4))
    lines = spark.createDataFrame([(i, i % 2, *map(float, e), 0.0, 1.0) for i, e in enumerate(ends)], "line_id long, room_id int, x1 double, y1 double, x2 double, y2 double, nx double, ny double")
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = spatial.cell_lines(points, lines)
        above = [n for n in _nodes(out._jdf.queryExecution().executedPlan()) if n.nodeName() == "Window"]
        assert above
        for n in above:
            while n.nodeName() != "SortMergeJoin":
                assert "Exchange" not in n.nodeName()
                n = n.children().apply(0)
        got = {(r.room_id, r._cx, r._cy, r.s.line_id) for r in out.collect()}
    finally:
        for k, x in was.items():
            spark.conf.set(k, x)
    for room, cx, cy in {k[:3] for k in got}:
        middle = np.array([[(cx + 0.5) / 2, (cy + 0.5) / 2]])
        best = min((i for i in range(80) if i % 2 == room), key=lambda i: -field.segment_prior(middle, ends[i : i + 1], 1.0)[0])
        assert (room, cx, cy, best) in got
    assert len({k[:3] for k in got}) == len({(r.room_id, math.floor(r.x * 2), math.floor(r.y * 2)) for r in points.collect()})


def test_novelty_is_a_distance_anti_join(spark):
    rng = np.random.default_rng(6)
    mk = lambda n, o: spark.createDataFrame([(i + o, 0, *map(float, v)) for i, v in enumerate(rng.uniform(0, 2, (n, 2)))], "point_id int, room_id int, x double, y double")
    known, new = mk(30, 0).cache(), mk(200, 100).cache()
    got = {r.point_id for r in field.novelty_filter(new, known).collect()}
    z = np.array([(r.x, r.y) for r in known.collect()])
    want = {r.point_id for r in new.collect() if np.hypot(*(z - [r.x, r.y]).T).min() > field.novelty_radius()}
    assert got == want


def test_smoothing_matches_pandas(spark):
    import pandas as pd

    y = np.random.default_rng(7).normal(size=120)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, i int, y double")
    ewm = [r.ewm for r in metrics.ewm_smooth(df, "k", "i", "y", 20).orderBy("i").collect()]
    assert ewm == pytest.approx(pd.Series(y).ewm(span=20).mean().tolist())
    roll = [r.rolling for r in metrics.rolling_mean(df, "k", "i", "y").orderBy("i").collect()]
    assert roll[:19] == [None] * 19 and roll[19:] == pytest.approx(pd.Series(y).rolling(20).mean().tolist()[19:])


def test_stream_equals_batch(spark, tmp_path):
    from fieldloom.streaming import robot_map

    poses = [(0, 0), (0.1, 0), (0.25, 0), (0.4, 0), (0.6, 0), (0.61, 0.3)]
    df = scans(spark, poses)
    for lo in range(0, 6, 2):  # three files in order: three micro-batches
        df.where(F.col("scan_id").between(lo, lo + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "scans"))
    stream = source.stream_scans(spark, str(tmp_path / "scans"), files_per_trigger=1)
    q = robot_map.gate_poses(stream).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    kept = ingest.pose_gate(df.select("robot_id", "scan_id", F.col("robot_pose.x").alias("x"), F.col("robot_pose.y").alias("y")))
    assert sorted(r.scan_id for r in spark.table("gated").where("NOT late").collect()) == sorted(r.scan_id for r in kept.collect())
    s = extract.extract_segments(clustered(spark, poses))
    s = s.select("robot_id", "scan_id", "line_id", *mapping.LINE)
    want = sorted((r.line_id, round(r.x1, 6), round(r.weight)) for r in mapping.build_map(s).collect())
    s = s.cache()
    for lo in range(0, 6, 2):
        s.where(F.col("scan_id").between(lo, lo + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "segs"))
    seg_stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "segs"))
    q = robot_map.update_map(seg_stream).writeStream.format("memory").queryName("maps").option("checkpointLocation", str(tmp_path / "c2")).outputMode("update").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.table("maps").collect()
    last = max(r.last_scan for r in rows)
    assert sorted((r.line_id, round(r.x1, 6), round(r.weight)) for r in rows if r.last_scan == last) == want
    assert BOX
