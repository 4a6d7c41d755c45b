"""Chains of gaps, cuts, line graphs and rooms of large maps against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import extract, maintain, mapping, spectral
from fieldloom.plans.build import split_until_whole
from fieldloom.sources.schema import EDGE

from .test_cards import a_line

LINES = "line_id long, room_id long, x1 double, y1 double, x2 double, y2 double, nx double, ny double, dx double, dy double, r double, theta double, robot_x double, robot_y double, weight int"


def table(spark, rows, edges=()):
    return spark.createDataFrame(rows, LINES), spark.createDataFrame(list(edges), EDGE)


@pytest.mark.parametrize("pieces", [2, 3, 5, 9])
def test_collinear_pieces_become_one_wall(spark, pieces):
    """All its length and the outer edges stay, in whatever order the pieces are numbered."""
    rng = np.random.default_rng(pieces)
    ids = rng.permutation(pieces).tolist()
    rows = [a_line(ids[k], 2.3 * k, 0, 2.3 * k + 2, 0) for k in range(pieces)] + [a_line(90, -5, 7, -1, 7), a_line(91, 50, 3, 50, 7)]
    df, edges = table(spark, rows, [(90, ids[0], "corner"), (ids[-1], 91, "corner")])
    lines, kept = maintain.process_lines(df, edges)
    wall = [r for r in lines.collect() if r.line_id < 90]
    assert [(r.line_id, round(r.x1, 9), round(r.x2, 9), r.weight) for r in wall] == [(0, 0.0, round(2.3 * pieces - 0.3, 9), pieces)]
    assert sorted((r.src, r.dst) for r in kept.collect()) == [(0, 91), (90, 0)]


def test_a_closed_chain_of_gaps_keeps_its_lines(spark):
    """A ring of lines that all continue in the next: the chain starts at the smallest line and nothing crashes."""
    n = 24
    at = lambda k: (2 * math.cos(2 * math.pi * k / n), 2 * math.sin(2 * math.pi * k / n))
    rows = [a_line(k, *at(k), *at(k + 0.7)) for k in range(n)]
    df, edges = table(spark, rows)
    got = maintain.close_gaps(df, edges).collect()
    assert {r.absorbed for r in got} <= set(range(1, n)) and {(round(r.x1, 6), round(r.y1, 6)) for r in got} <= {tuple(round(v, 6) for v in at(k)) for k in range(n)}


def test_segments_meet_only_the_lines_around_them():
    """The map equals that of a loop over all lines, whatever their lengths; a segment is compared with a few of them."""
    rng, n = np.random.default_rng(4), 240
    at, turn, size = np.column_stack((rng.uniform(0, 3, n), rng.uniform(0, 40, n))), rng.choice([0, np.pi / 2], n) + rng.normal(0, 0.1, n), rng.choice([0.3, 1.0, 9.0], n)
    way = np.column_stack((np.cos(turn), np.sin(turn)))
    rows = np.column_stack((at, at + size[:, None] * way, -way[:, 1], way[:, 0], np.ones(n)))
    want, held, met = {}, mapping.LineMap(), []
    for s in rows:
        same = [k for k in sorted(want) if mapping.same_wall(want[k], s, mapping.DEFAULT)]
        merged = mapping.merge_lines(np.array([*(want.pop(k) for k in same), s])) if same else s
        want[same[0] if same else max(want, default=-1) + 1] = merged
        met.append(len(held._around(s)) / max(len(held.lines), 1))
        held.add(s)
    assert sorted(held.lines) == sorted(want) and all(np.array_equal(held.lines[k], want[k]) for k in want)
    assert np.mean(met) < 0.5


def test_a_closed_chain_absorbs_nothing_beside_an_open_one(spark):
    """Two opposite lines whose ends continue in each other have no first line and stay; a chain of three next to them is joined."""
    rows = [a_line(1, 0, 0, 1, 0), a_line(2, 1.1, 0.01, 0.1, 0.01)] + [a_line(k, 5 + 2.3 * k, 9, 7 + 2.3 * k, 9) for k in (3, 4, 5)]
    df, edges = table(spark, rows)
    df = df.withColumns({"nx": F.lit(0.0), "ny": F.lit(1.0)})
    assert {(1, 2), (2, 1)} <= {(r.p, r.q) for r in maintain.gap_candidates(df, edges).collect()}
    assert sorted((r.line_id, r.absorbed) for r in maintain.close_gaps(df, edges).collect()) == [(3, 4), (3, 5)]


def test_a_wall_is_cut_at_every_crossing_and_door(spark):
    """Three walls end at a long one and a fourth leaves a door before it; parts, moved ends, corner and parallel edges as by hand."""
    wall = a_line(0, 0, 0, 20, 0)
    rows = [wall, a_line(1, 3, 4, 3, 0.2), a_line(2, 8, 0.1, 8, 4), a_line(3, 8.2, 5, 8.2, 9), a_line(4, 14, 5, 14, 1.2), a_line(5, 19.8, 3, 19.8, 0.1)]
    df, edges = table(spark, rows, [(9, 0, "corner"), (0, 7, "corner")])
    lines, kept = maintain.apply_cuts(df, edges)
    got = {r.line_id: tuple(round(v, 6) + 0.0 for v in (r.x1, r.y1, r.x2, r.y2)) for r in lines.collect()}
    assert got == {0: (0, 0, 3, 0), 6: (3, 0, 8, 0), 12: (8, 0, 14, 0), 18: (14, 0, 20, 0), 1: (3, 4, 3, 0), 2: (8, 0, 8, 4), 3: rows[3][2:6], 4: rows[4][2:6], 5: rows[5][2:6]}
    # line 1 ends at the wall and faces right: part 6; line 2 starts there and faces left: part 6; the door joins 12 and 18
    assert sorted((r.src, r.dst, r.type) for r in kept.collect()) == [(1, 6, "corner"), (6, 2, "corner"), (9, 0, "corner"), (12, 18, "parallel"), (18, 7, "corner")]


def test_segments_of_a_cluster_make_the_line_graph(spark):
    """Long neighbours in a cluster are chained, short ones break the chain; scans agree on the map's edges."""
    seg = "robot_id string, scan_id long, cluster_id int, line_id long, x1 double, y1 double, x2 double, y2 double, nx double, ny double, is_short boolean, weight int"
    walls = [(0.0, 0.0, 4.0, 0.0, 0.0, 1.0), (4.0, 0.0, 4.0, 4.0, -1.0, 0.0), (4.0, 4.0, 0.0, 4.0, 0.0, -1.0)]
    rows = [("r", scan, 0, 10 * scan + k, *w, short, 1) for scan in range(3) for k, (w, short) in enumerate(zip(walls, (False, False, scan != 1)))]
    found = spark.createDataFrame(rows, seg)
    chains = extract.chain_edges(found)
    assert sorted((r.src, r.dst) for r in chains.collect()) == [(0, 1), (10, 11), (11, 12), (20, 21)]
    lines = spark.createDataFrame([("r", 100 + k, *w) for k, w in enumerate(walls)], "robot_id string, line_id long, x1 double, y1 double, x2 double, y2 double, nx double, ny double")
    assert sorted((r.src, r.dst, r.type) for r in mapping.line_graph(chains, found, lines).collect()) == [(100, 101, "corner"), (101, 102, "corner")]


def test_crossing_lines_are_one_wall():
    from fieldloom.config import DEFAULT

    p = np.array([0, 0, 4, 0, 0, 1, 1.0])
    for turn in (10, 30):
        d = 2 * np.array([math.cos(math.radians(turn)), math.sin(math.radians(turn))])
        q = np.array([2 - d[0], -d[1], 2 + d[0], d[1], -d[1] / 2, d[0] / 2, 1.0])
        assert mapping.same_wall(p, q, DEFAULT) and mapping.same_wall(q, p, DEFAULT)


def test_sparse_vectors_are_those_of_the_dense_solve(spark):
    rng, rows, dense = np.random.default_rng(0), [], {}
    for room, n in ((1, 24), (2, 40)):
        w = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                if rng.random() < (0.4 if (i < n // 2) == (j < n // 2) else 0.01) or j == i - 1:
                    w[i, j] = w[j, i] = rng.random()
        dense[room] = spectral.laplacian_spectrum(w)
        rows += [(room, 100 * room + j, 100 * room + i, float(w[i, j])) for i in range(n) for j in range(i) if w[i, j] > 0]
    edges = spark.createDataFrame(rows, "room_id long, p long, q long, weight double")
    got = spectral.fiedler(edges).toPandas()
    for room, (values, vectors) in dense.items():
        mine = got[got.room_id == room].sort_values("node")
        assert abs(mine.value.iloc[0] - values[1]) < 1e-8 and abs(abs(vectors[:, 1] @ mine.x) - 1) < 1e-8 and abs(abs(vectors[:, 0] @ mine.s) - 1) < 1e-12
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spectral.split_parts(edges, dense=4)) == key(spectral.split_parts(edges)) == key(spectral.split_rooms(edges))


def corridor(n):
    """n rooms of 3 m on one side of a corridor, each with a door of 0.8 m; all walls face inward. Returns rows, corner edges and, for each line, its room (n: the corridor)."""
    rows, edges, of = [], [], {}

    def add(room, *ends):
        of[len(rows)] = room
        rows.append(a_line(len(rows), *ends))  # the room lies on its left
        return len(rows) - 1

    for k in range(n):
        x = 3.2 * k
        ring = [add(k, x + 1.1, 0, x + 3, 0), add(k, x + 3, 0, x + 3, 3), add(k, x + 3, 3, x, 3), add(k, x, 3, x, 0), add(k, x, 0, x + 0.3, 0)]
        edges += [(a, b, "corner") for a, b in zip(ring, ring[1:])]
        add(n, x + 0.3, -0.2, x, -0.2)
        add(n, x + 3.2, -0.2, x + 1.1, -0.2)
        add(n, x, -2, x + 3.2, -2)
    return rows, edges, of


def test_rooms_on_a_corridor(spark):
    n = 30
    rows, edges, of = corridor(n)
    got = {r.line_id: r.room_id for r in split_until_whole(*table(spark, rows, edges)).collect()}
    assert got.keys() == of.keys()
    rooms = {frozenset(i for i in got if got[i] == name) for name in set(got.values())}
    mine = [frozenset(i for i in of if of[i] == k) for k in range(n)]
    assert sum(m in rooms for m in mine) == n
