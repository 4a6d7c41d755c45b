import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geometry as g
from fieldloom.operators import changes, hulls

COLUMNS = "line_id long, room_id int, weight int, x1 double, y1 double, x2 double, y2 double"
LOG = "seq long, line_id long, kind string, room_id int, x1 double, y1 double, x2 double, y2 double"


def line_table(spark, rows):
    s = spark.createDataFrame(rows, COLUMNS)
    dx, dy = g.direction("x1", "y1", "x2", "y2")
    r, theta = g.normal_form("x1", "y1", "x2", "y2")
    return s.select("*", dx.alias("dx"), dy.alias("dy"), (-dy).alias("nx"), dx.alias("ny"), r.alias("r"), theta.alias("theta"))


def loop(lines, edges, log):
    """The same, change by change."""
    now, edges = {r[0]: list(r[1:]) for r in lines}, set(edges)
    known = {k: v[1] for k, v in now.items()}
    for _, line, kind, room, *ends in sorted(log, key=lambda c: (c[0], changes.KINDS.index(c[2]))):
        if kind == "insert":
            now[line] = [room, known.get(line), *ends]
        elif line in now and kind == "remove":
            del now[line]
            edges = {e for e in edges if line not in e[:2]}
        elif line in now:
            for i in (0, 2):
                if ends[i] is not None and ends[i + 1] is not None:
                    now[line][2 + i : 4 + i] = ends[i : i + 2]
    return {k: tuple(v) for k, v in now.items()}, edges


def random_log(seed, n_lines, n_changes):
    rng = random.Random(seed)
    spot = lambda: float(rng.randrange(-9, 10))
    log = []
    for seq in range(n_changes):
        kind = rng.choice(["insert", "remove", "move", "move"])
        ends = [spot(), spot(), spot(), spot()]
        if kind == "remove":
            ends = [None] * 4
        elif kind == "move" and rng.random() < 0.8:
            ends[2 * rng.randrange(2) :][:2] = []
            ends = [None, None, *ends[-2:]] if rng.random() < 0.5 else [*ends[:2], None, None]
        log.append((seq, rng.randrange(n_lines), kind, rng.randrange(3) if kind == "insert" else None, *ends))
    return log


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_the_loop_in_any_order(spark, seed):
    lines = [(i, i % 3, i + 1, float(i), 0.0, float(i), 2.0) for i in range(12)]
    edges = [(i, i + 1, "corner") for i in range(11)]
    log = random_log(seed, 18, 60)
    shuffled = log[:]
    random.Random(seed).shuffle(shuffled)
    base = line_table(spark, lines)
    got, left = changes.fold_changes(base, spark.createDataFrame(edges, "src long, dst long, type string"), spark.createDataFrame(shuffled, LOG).repartition(5))
    want, want_edges = loop(lines, edges, log)
    assert {r[0]: tuple(r[1:]) for r in got.select("line_id", "room_id", "weight", "x1", "y1", "x2", "y2").collect()} == want
    assert {tuple(r) for r in left.collect()} == want_edges
    for r in got.where("x1 != x2 OR y1 != y2").collect():
        assert abs(r["dx"] * r["ny"] - r["dy"] * r["nx"]) == pytest.approx(1.0)
        assert r["dx"] * (r["y2"] - r["y1"]) == pytest.approx(r["dy"] * (r["x2"] - r["x1"]))

    counts = {r["room_id"]: (r["n_lines"], r["n_added"], r["n_removed"]) for r in changes.room_changes_of(base, got).collect()}
    old = {(r[1], r[0]) for r in lines}
    new = {(v[0], k) for k, v in want.items()}
    assert counts == {room: (sum(x[0] == room for x in new), sum(x[0] == room for x in new - old), sum(x[0] == room for x in old - new)) for room in {x[0] for x in old | new}}


def test_changes_without_lines_and_odd_rows(spark):
    base, edges = line_table(spark, []), spark.createDataFrame([], "src long, dst long, type string")
    log = [(1, 5, "move", None, 1.0, 1.0, None, None), (2, 5, "remove", None, None, None, None, None), (None, 6, "insert", 0, 0.0, 0.0, 1.0, 0.0), (3, None, "insert", 0, 0.0, 0.0, 1.0, 0.0), (4, 7, "paint", 0, 0.0, 0.0, 1.0, 0.0), (5, 8, "insert", 2, 0.0, 0.0, 1.0, 0.0), (5, 8, "insert", 2, 0.0, 0.0, 1.0, 0.0)]
    got, left = changes.fold_changes(base, edges, spark.createDataFrame(log, LOG).withColumn("note", F.lit("x")))
    assert [tuple(r) for r in got.select("line_id", "room_id", "weight", "x2", "dx").collect()] == [(8, 2, None, 1.0, 1.0)]
    assert left.count() == 0
    same, _ = changes.fold_changes(line_table(spark, [(1, 0, 1, 0.0, 0.0, 1.0, 0.0)]), edges, spark.createDataFrame([], LOG))
    assert same.count() == 1


def pairwise(ends):
    """Farthest two ends by all pairs."""
    named = sorted({(line, end, x, y) for line, end, x, y in ends})
    return min((-round((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, 9), *a[:2], *b[:2]) for a, b in itertools.combinations(named, 2))


@pytest.mark.parametrize("seed", range(60))
def test_widest_equals_all_pairs(seed):
    rng = random.Random(seed)
    span = rng.choice([1, 2, 4, 50])
    n = rng.choice([1, 2, 3, 8, 40])
    flat = seed % 4 == 0
    ends = [(line, end, float(rng.randint(-span, span)), 0.0 if flat else float(rng.randint(-span, span))) for line in range(n) for end in (1, 2)]
    got = hulls.widest(pd.DataFrame(ends, columns=["line_id", "end", "x", "y"]))
    want = pairwise(ends)
    assert got[:4] == want[1:]
    assert got[4] == pytest.approx((-want[0]) ** 0.5)


def test_farthest_ends_over_partitions(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), 1, *[rng.uniform(-5, 5) for _ in range(4)]) for i in range(400)]
    rows += [(900, 4, 1, 1.0, 1.0, 1.0, 1.0), (901, 5, 1, None, 1.0, 1.0, 1.0), (901, 5, 1, None, 1.0, 1.0, 1.0), (902, 5, 1, 0.0, 0.0, 3.0, 4.0)]
    got = {r["room_id"]: tuple(r)[1:] for r in hulls.farthest_ends(spark.createDataFrame(rows, COLUMNS).repartition(7)).collect()}
    for room in (1, 2, None, 4, 5):
        ends = [(r[0], k, r[1 + 2 * k], r[2 + 2 * k]) for r in rows if r[1] == room for k in (1, 2) if r[1 + 2 * k] is not None]
        want = pairwise(ends)
        assert got[room][:4] == want[1:]
        assert got[room][4] == pytest.approx((-want[0]) ** 0.5)
    assert hulls.farthest_ends(spark.createDataFrame([], COLUMNS)).count() == 0
