"""Rules of the room graph, clusters and corners against plain loops over small worlds."""

import math
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from fieldloom.config import DEFAULT
from fieldloom.operators import extract, ingest, mapping, rooms, segments, spatial, spectral, visibility

from .worlds import BOX, scans

STEP = 2 * math.pi / 360


def random_lines(spark, n, seed, n_rooms=2, size=6.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a = rng.uniform(0, size, 2)
        t = rng.choice([0, math.pi / 2]) + rng.normal(0, 0.1)
        b = a + rng.uniform(0.5, 3) * np.array([math.cos(t), math.sin(t)])
        d = (b - a) / np.hypot(*(b - a))
        normal = np.array([-d[1], d[0]]) * rng.choice([-1, 1])
        th = math.atan2(a[0] - b[0], b[1] - a[1])
        r = a[0] * math.cos(th) + a[1] * math.sin(th)
        if th < 0 or th >= math.pi:
            r, th = -r, th + math.pi if th < 0 else th - math.pi
        rows.append((i, i % n_rooms, *map(float, (*a, *b, *normal, *d, r, th)), float(i % 3), float(i % 2), 1 + i % 2))
    return spark.createDataFrame(rows, "line_id long, room_id int, x1 double, y1 double, x2 double, y2 double, nx double, ny double, dx double, dy double, r double, theta double, robot_x double, robot_y double, weight int")


def point_gap(p, a, b):
    t = np.clip((p - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
    return float(np.hypot(*(p - a - t * (b - a))))


def cross(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def meet(a, b, c, d):
    return cross(a, b, c) * cross(a, b, d) <= 0 and cross(c, d, a) * cross(c, d, b) <= 0 and all(max(min(a[i], b[i]), min(c[i], d[i])) <= min(max(a[i], b[i]), max(c[i], d[i])) for i in (0, 1))


class Line:
    def __init__(self, r):
        self.id, self.room, self.r, self.theta = r.line_id, r.room_id, r.r, r.theta
        self.a, self.b = np.array([r.x1, r.y1]), np.array([r.x2, r.y2])
        self.n, self.d, self.pose = np.array([r.nx, r.ny]), np.array([r.dx, r.dy]), np.array([r.robot_x, r.robot_y])
        self.c, self.len = (self.a + self.b) / 2, float(np.hypot(*(self.b - self.a)))

    def gap(self, o):
        return 0.0 if meet(self.a, self.b, o.a, o.b) else min(point_gap(o.a, self.a, self.b), point_gap(o.b, self.a, self.b), point_gap(self.a, o.a, o.b), point_gap(self.b, o.a, o.b))


def graph_brute(lines, edges):
    """Edges {(p, q): (kind, weight)} by loops over every ordered pair and every other line."""
    by_id = {x.id: x for x in lines}
    linked = {frozenset(e) for e in edges}
    out = {}

    def put(p, q, kind, weight):
        key = min(p.id, q.id), max(p.id, q.id)
        out[key] = min(out.get(key, (9, 0)), (kind, weight))

    for room in {x.room for x in lines}:
        mine = [x for x in lines if x.room == room]
        longest = max(x.len for x in mine)

        def weight(p, q, gap):
            pose = p.pose - q.pose
            return (p.len + q.len) / (2 * longest) * math.exp(-0.02 * gap**2) * math.exp(-0.005 * pose @ pose)

        def goes_on(p, q):
            turn = abs(p.theta - q.theta)
            if p.gap(q) > 3 or frozenset((p.id, q.id)) in linked or q.n @ p.n < 0 or not (turn < math.pi / 4 or turn > 3 * math.pi / 4):
                return None
            if abs(p.c[0] * math.cos(q.theta) + p.c[1] * math.sin(q.theta) - q.r) >= 0.5:
                return None
            return (p, q) if (q.a - p.b) @ p.d > 0 else (q, p) if (p.a - q.b) @ q.d > 0 else None

        for p, q in permutations(mine, 2):
            if frozenset((p.id, q.id)) in linked:
                put(p, q, 0, weight(p, q, 0.0))
            gap = p.gap(q)
            if gap >= 8:
                continue
            pair = goes_on(p, q)
            if pair:
                a, b = pair
                free = True
                after, before = [e[1] for e in edges if e[0] == a.id], [e[0] for e in edges if e[1] == b.id]
                if after:
                    free = (by_id[min(after)].b - a.b) @ a.n < 0
                if before:
                    free = (by_id[min(before)].a - b.a) @ b.n < 0
                if free:
                    put(a, b, 1, 1.0)
                continue
            if frozenset((p.id, q.id)) in linked or (q.c - p.c) @ p.n < 0 or (p.c - q.c) @ q.n < 0:
                continue
            sights = [(p.c, q.c), ((q.c + q.a) / 2, (p.c + p.b) / 2), ((q.c + q.b) / 2, (p.c + p.a) / 2)]
            blocked = any(
                max((o.a - p.c) @ p.n, (o.b - p.c) @ p.n) >= 0 and p.gap(o) < gap and not goes_on(p, o) and any(meet(*s, o.a, o.b) for s in sights)
                for o in mine if o.id not in (p.id, q.id)
            )
            if not blocked:
                put(p, q, 2, weight(p, q, gap))
    return out


def test_visibility_graph(spark):
    df = random_lines(spark, 36, 11)
    edges = [(0, 2), (2, 4), (4, 6), (1, 3), (3, 5), (5, 8), (10, 12)]
    lines = [Line(r) for r in df.collect()]
    for use in (edges, []):
        want = graph_brute(lines, use)
        given = spark.createDataFrame([(*e, "corner") for e in use], "src long, dst long, type string") if use else None
        got = {(r.p, r.q): (["line", "continuation", "sight"].index(r.kind), r.weight) for r in visibility.visibility_edges(df, given).collect()}
        assert {k: (v[0], round(v[1], 9)) for k, v in got.items()} == {k: (v[0], round(v[1], 9)) for k, v in want.items()}
        assert {v[0] for v in want.values()} >= ({0, 1, 2} if use else {1, 2})


def test_pairs_near_loses_no_pair(spark):
    df = random_lines(spark, 60, 12).cache()
    lines = [Line(r) for r in df.collect()]
    want = {(p.id, q.id) for p, q in permutations(lines, 2) if p.room == q.room and p.gap(q) <= 0.5}
    got = [(r.p, r.q) for r in segments.pairs_near(df, 0.5).select(F.col("p.line_id").alias("p"), F.col("q.line_id").alias("q")).collect()]
    assert want <= set(got) and len(got) == len(set(got))


def test_nearest_lines_and_rooms(spark):
    rng = np.random.default_rng(13)
    df = random_lines(spark, 200, 14, 2).cache()
    lines = [Line(r) for r in df.collect()]
    pts = rng.uniform(-2, 8, (60, 2))
    points = spark.createDataFrame([(i, i % 3, float(x), float(y)) for i, (x, y) in enumerate(pts)], "point_id int, room_id int, x double, y double")
    got = {r.point_id: (r.line_id, round(r.distance, 6), r.positive) for r in spatial.nearest_segment(points, df).collect()}
    for i, p in enumerate(pts):
        mine = [x for x in lines if x.room == i % 3]
        if not mine:
            assert i not in got
            continue
        best = min(mine, key=lambda x: (round(point_gap(p, x.a, x.b) ** 2, 9), x.id))
        assert got[i] == (best.id, round(point_gap(p, best.a, best.b), 6), bool((p - best.a) @ best.n > 0))
    boxes = [(i, *(c := rng.uniform(-200, 200, 2)).tolist(), *(c + rng.uniform(0.5, 9, 2)).tolist()) for i in range(40)]
    far = [(i, *map(float, rng.uniform(-300, 300, 2))) for i in range(50)] + [(99, 5000.0, 5000.0)]
    near = rooms.knn_rooms(spark.createDataFrame(far, "point_id int, x double, y double"), spark.createDataFrame(boxes, "room_id int, min_x double, min_y double, max_x double, max_y double"), 3)
    got = {(r.point_id, r.rank): r.room_id for r in near.collect()}
    for i, x, y in far:
        d = [(round(max(b[1] - x, x - b[3], 0) ** 2 + max(b[2] - y, y - b[4], 0) ** 2, 9), b[0]) for b in boxes]
        assert [got[i, k] for k in (1, 2, 3)] == [r for _, r in sorted(d)[:3]]


def test_nearest_boxes_of_a_full_cell_in_parts(spark):
    """All points and boxes in one cell, many boxes alike: parts of seven give the brute force's boxes, and each part leaves a few a point."""
    rng = np.random.default_rng(3)
    boxes = [(i, *(c := rng.integers(-2, 3, 2) * 0.25).tolist(), *(c + 0.5).tolist()) for i in range(60)]
    far = [(i, *map(float, rng.uniform(-3, 3, 2))) for i in range(40)]
    points, table = spark.createDataFrame(far, "point_id int, x double, y double"), spark.createDataFrame(boxes, "room_id int, min_x double, min_y double, max_x double, max_y double")
    got = {(r.point_id, r.rank): r.room_id for r in rooms.knn_rooms(points, table, 2, 100.0, share=7).collect()}
    for i, x, y in far:
        d = sorted((round(max(b[1] - x, x - b[3], 0) ** 2 + max(b[2] - y, y - b[4], 0) ** 2, 9), b[0]) for b in boxes)
        assert [got[i, k] for k in (1, 2)] == [r for _, r in d[:2]]
    cell = {"_cx": F.lit(0), "_cy": F.lit(0)}
    left = rooms._near_boxes(points.withColumns(cell), table.withColumns(cell), 2, 30).count()
    assert left <= 40 * 3 * 2  # of either part of boxes those before the second's distance and two at it, not all sixty


def ring_brute(points, cfg=DEFAULT):
    """(status, points in order) of every cluster of one scan after the ring pass; points are (beam, x, y, range)."""
    n = len(points)
    xy = np.array([p[1:3] for p in points])
    gap = np.hypot(*(np.roll(xy, -1, 0) - xy).T)
    runs, run = [], []
    for i, p in enumerate(points):
        run.append(i)
        if gap[i] >= cfg.k * p[3] * STEP:
            runs.append(run)
            run = []
    if run:  # the ring goes on
        runs = [run + runs[0], *runs[1:]] if runs else [run]
    mean = lambda c: float(np.mean([np.hypot(*(xy[b] - xy[a])) for a, b in zip(c, c[1:])])) if len(c) > 1 else None
    other = [("residual", c) for c in runs if len(c) <= 2] + [("dropped", c) for c in runs if len(c) > 2 and mean(c) > cfg.sparse_gap]
    kept = [c for c in runs if len(c) > 2 and mean(c) <= cfg.sparse_gap]
    i = 0
    while len(kept) > 1 and i < len(kept):
        j = (i + 1) % len(kept)
        if np.hypot(*(xy[kept[i][-1]] - xy[kept[j][0]])) < cfg.remerge_gap:
            kept[i] = kept[i] + kept[j]
            del kept[j]
            if j < i:
                i -= 1
        else:
            i += 1
    assert n == sum(map(len, runs))
    return sorted((s, tuple(c)) for s, c in other + [("line" if len(c) >= cfg.line_seed_points else "residual", c) for c in kept])


def test_ring_pass(spark):
    rng = np.random.default_rng(15)
    rows, want = [], []
    for scan in range(6):
        r = np.full(360, 1.5) + rng.normal(0, 0.004, 360)
        at = 0
        while at < 360:
            w = int(rng.integers(1, 60))
            if rng.random() < 0.4:
                r[at : at + w] += rng.choice([0.12, 0.3, -0.4])
            at += w
        keep = rng.random(360) > 0.05
        pts = [(b, float(r[b] * math.cos(b * STEP)), float(r[b] * math.sin(b * STEP)), float(r[b])) for b in range(360) if keep[b]]
        want += [(scan, s, tuple(pts[i][0] for i in c)) for s, c in ring_brute(pts)]
        rows += [("r" if scan % 2 else "s", scan // 2, scan, *p) for p in pts]
    df = spark.createDataFrame(rows, "robot_id string, scan_id long, n int, beam int, x double, y double, range double")
    got = segments.ring_pass(segments.breakpoints(df, STEP)).groupBy("n", *segments.CLUSTER).agg(F.max("status").alias("s"), F.sort_array(F.collect_list(F.struct("pos", "beam"))).alias("b")).collect()
    assert sorted((r.n, r.s, tuple(x.beam for x in r.b)) for r in got) == sorted(want)


def corner_brute(lines, edges, cfg=DEFAULT):
    by_id, out = {x.id: x for x in lines}, set()
    for p, q in permutations(lines, 2):
        s = math.sin(q.theta - p.theta)
        if p.room != q.room or np.hypot(*(p.b - q.a)) > cfg.corner_thresh or abs(s) <= 1e-12:
            continue
        x = np.array([(p.r * math.sin(q.theta) - q.r * math.sin(p.theta)) / s, (q.r * math.cos(p.theta) - p.r * math.cos(q.theta)) / s])
        if np.hypot(*(x - q.a)) < 0.5 or np.hypot(*(x - q.b)) < 0.5:
            continue
        d1, d2 = (q.b - x) @ p.n, (p.a - x) @ q.n
        if d1 * d2 < 0:
            continue
        after, before = sorted(e[1:] for e in edges if e[0] == p.id), sorted((e[0], e[2]) for e in edges if e[1] == q.id)
        if after or before:
            if d1 < 0 or d2 < 0:
                continue
            if after and after[0][1] == "corner" and (by_id[after[0][0]].b - x) @ p.n > 0:
                continue
            if before and before[0][1] == "corner" and (by_id[before[0][0]].a - x) @ q.n > 0:
                continue
        out.add((p.id, q.id))
    return out


def test_corners(spark):
    df = random_lines(spark, 150, 16, size=4.0).cache()
    lines = [Line(r) for r in df.collect()]
    edges = [(i, (i * 7 + 3) % 150, "corner" if i % 3 else "parallel") for i in range(0, 150, 2)]
    want = corner_brute(lines, edges)
    got = {(r.p, r.q) for r in segments.corner_candidates(df, spark.createDataFrame(edges, "src long, dst long, type string")).collect()}
    assert got == want and want


def test_two_robots_do_not_mix(spark):
    """Both robots number their scans from 0; each has the clusters, segments and map that it has alone."""
    poses = [(0.3, 0.2), (0.0, 0.0), (-0.3, 0.1)]
    wide = [(2 * a, 2 * b, 2 * c, 2 * d) for a, b, c, d in BOX]
    alone = [scans(spark, poses, robot="a"), scans(spark, poses[:2], [tuple(0.6 * v for v in w) for w in wide], robot="b")]

    def found(df):
        pts = ingest.scan_to_points(df).withColumn("room_id", F.lit(0))
        return extract.extract_segments(segments.ring_pass(segments.breakpoints(pts, STEP)).where("status = 'line'"))

    key = lambda r: (r.robot_id, r.line_id, round(r.x1, 6), round(r.y2, 6))
    both = found(alone[0].unionByName(alone[1])).cache()
    assert sorted(map(key, both.collect())) == sorted(key(r) for df in alone for r in found(df).collect())
    assert both.count() == both.select("robot_id", "line_id").distinct().count()
    maps = sorted(map(key, mapping.build_map(both).collect()))
    assert maps == sorted(key(r) for df in alone for r in mapping.build_map(found(df)).collect())


def a_line(i, x1, y1, x2, y2, side=1):
    d = np.array([x2 - x1, y2 - y1]) / np.hypot(x2 - x1, y2 - y1)
    th = math.atan2(x1 - x2, y2 - y1)
    r = x1 * math.cos(th) + y1 * math.sin(th)
    if th < 0 or th >= math.pi:
        r, th = -r, th + math.pi if th < 0 else th - math.pi
    return (i, 1, *map(float, (x1, y1, x2, y2, -d[1] * side, d[0] * side, *d, r, th)), 0.0, 0.0, 1)


def test_process_lines(spark):
    """A gap is closed, a line joins the wall that it meets and cuts it, a short free line goes, and edges follow."""
    from fieldloom.operators import maintain
    from fieldloom.sources.schema import EDGE

    rows = [a_line(0, 0, 0, 2, 0), a_line(1, 2.3, 0, 5, 0), a_line(2, 0, 9, 4, 9, -1), a_line(3, 2, 5, 2, 8.8), a_line(4, 20, 20, 20.3, 20), a_line(5, 9, 0, 9, 4)]
    df = spark.createDataFrame(rows, "line_id long, room_id long, x1 double, y1 double, x2 double, y2 double, nx double, ny double, dx double, dy double, r double, theta double, robot_x double, robot_y double, weight int")
    edges = spark.createDataFrame([(1, 5, "corner"), (2, 5, "corner"), (4, 5, "parallel")], EDGE)
    lines, kept = maintain.process_lines(df, edges)
    got = {r.line_id: tuple(round(v, 6) + 0.0 for v in (r.x1, r.y1, r.x2, r.y2)) for r in lines.collect()}
    assert got == {0: (0, 0, 5, 0), 2: (0, 9, 2, 9), 8: (2, 9, 4, 9), 3: (2, 5, 2, 9), 5: (9, 0, 9, 4)}
    assert sorted((r.src, r.dst, r.type) for r in kept.collect()) == [(0, 5, "corner"), (3, 2, "corner"), (8, 5, "corner")]
    for r in lines.collect():
        assert math.hypot(r.dx, r.dy) == math.hypot(r.nx, r.ny) == 1 and abs(r.x1 * math.cos(r.theta) + r.y1 * math.sin(r.theta) - r.r) < 1e-9


def test_rooms_are_split_until_whole(spark):
    """Three boxes that do not see each other become three rooms of one robot."""
    from fieldloom.plans.build import split_until_whole

    rows = []
    for k in range(3):
        for i, (x1, y1, x2, y2) in enumerate(BOX):
            x1, x2 = x1 + 8.0 * k, x2 + 8.0 * k
            cx = 8.0 * k
            n = (0.0, 1.0) if y1 == y2 == -2 else (0.0, -1.0) if y1 == y2 else (-1.0, 0.0) if x1 > cx else (1.0, 0.0)
            d = np.array([x2 - x1, y2 - y1]) / 4
            th = math.atan2(x1 - x2, y2 - y1)
            r = x1 * math.cos(th) + y1 * math.sin(th)
            if th < 0 or th >= math.pi:
                r, th = -r, th + math.pi if th < 0 else th - math.pi
            rows.append((4 * k + i, 1, *map(float, (x1, y1, x2, y2, *n, *d, r, th)), 0.0, 0.0, 1))
    df = spark.createDataFrame(rows, "line_id long, room_id long, x1 double, y1 double, x2 double, y2 double, nx double, ny double, dx double, dy double, r double, theta double, robot_x double, robot_y double, weight int")
    got = {r.line_id: r.room_id for r in split_until_whole(df).collect()}
    parts = {frozenset(i for i in got if got[i] == room) for room in set(got.values())}
    assert parts == {frozenset(range(4 * k, 4 * k + 4)) for k in range(3)}


def test_labels_are_carried():
    ids = list(range(8))
    assert spectral.carry_labels(ids, [1, 1, 2, 2, 2, 2, 1, 1], [0] * 8, 1, {1, 2}) == [1] * 8
    assert spectral.carry_labels(ids, [0, 0, 0, 0, 1, 1, 1, 1], [0, 0, 0, 0, 1, 1, 1, 1], 0, {0, 1}) == [0, 0, 0, 0, 1, 1, 1, 1]
    # the current room falls apart: the older half keeps its label, the other gets the first free one
    assert spectral.carry_labels(ids, [0] * 8, [1, 1, 1, 1, 0, 0, 0, 0], 0, {0, 2}) == [0, 0, 0, 0, 1, 1, 1, 1]
    # local numbers change, rooms don't
    assert spectral.carry_labels(ids, [0, 0, 0, 0, 3, 3, 3, 3], [1, 1, 1, 1, 0, 0, 0, 0], 0, {0, 3}) == [0, 0, 0, 0, 3, 3, 3, 3]
    # only lines of the current room change: line 7 of room 3 stays though it clusters with room 0
    assert spectral.carry_labels(ids, [0, 0, 0, 0, 3, 3, 3, 3], [0, 0, 0, 0, 1, 1, 1, 0], 0, {0, 3}) == [0, 0, 0, 0, 3, 3, 3, 3]
    # a single line is no room
    assert spectral.carry_labels(ids, [0] * 8, [0] * 7 + [1], 0, {0}) == [0] * 8
