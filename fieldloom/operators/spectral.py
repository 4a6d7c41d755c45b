"""Splitting a visibility graph into rooms and matching room labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..sources.staging import materialize


def laplacian_spectrum(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and vectors of I - D^-1/2 W D^-1/2."""
    d = w.sum(1)
    s = 1 / np.sqrt(np.where(d > 0, d, 1))
    return np.linalg.eigh(np.eye(len(w)) - s[:, None] * w * s)


def cluster_qr(vectors: np.ndarray) -> np.ndarray:
    """Labels from k eigenvectors: greedy columns of largest remaining norm, then the polar factor of their block."""
    v = vectors.T.copy()
    k, rest, picked = len(v), vectors.T.copy(), []
    for _ in range(k):
        j = int(np.round((rest**2).sum(0), 12).argmax())
        picked.append(j)
        n = np.sqrt((rest[:, j] ** 2).sum())
        if n > 0:
            rest -= np.outer(rest[:, j] / n, (rest[:, j] / n) @ rest)
    u, _, vt = np.linalg.svd(v[:, picked])
    return np.abs(v.T @ (u @ vt)).argmax(1)


def eigengap(values: np.ndarray) -> int:
    return int(np.diff(values).argmax()) + 1


def is_connected(w: np.ndarray) -> bool:
    met, todo = {0}, [0]
    while todo:
        new = set(np.flatnonzero(w[todo.pop()]).tolist()) - met
        met |= new
        todo += new
    return len(met) == len(w)


def split_graph(w: np.ndarray, cfg: MapConfig = DEFAULT) -> np.ndarray:
    """0 or 1 per node: two parts of two lines or more if the graph is connected and its second eigenvalue small, else one."""
    none = np.zeros(len(w), int)
    if len(w) < 4 or not is_connected(w):
        return none
    values, vectors = laplacian_spectrum(w)
    if values[1] > cfg.fiedler_thresh:
        return none
    parts = cluster_qr(vectors[:, :2])
    if min(parts.sum(), (1 - parts).sum()) < 2:
        return none
    return parts if parts[0] == 0 else 1 - parts


def split_rooms(edges: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """(room_id, line_id, part) of every line in a room's visibility graph; one room's lines are one bounded group."""

    def run(e: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(e[["p", "q"]].to_numpy())
        at = {n: i for i, n in enumerate(nodes)}
        w = np.zeros((len(nodes),) * 2)
        for p, q, x in e[["p", "q", "weight"]].itertuples(index=False):
            w[at[p], at[q]] = w[at[q], at[p]] = x
        return pd.DataFrame({"room_id": int(e["room_id"].iloc[0]), "line_id": nodes, "part": split_graph(w, cfg)})

    return edges.groupBy("room_id").applyInPandas(run, "room_id long, line_id long, part int")


#: Nodes of a graph up to which its eigenvectors are solved densely, in one task.
DENSE = 512


def _solve(sums: pd.DataFrame) -> pd.DataFrame:
    """Per graph the best vector in the span of x, r, p (least x'Lx / x'x): its coefficients and value, by the sums of products.

    Dependent directions are left out; what the three hold of the known vector s is taken off.
    """
    out = []
    for row in sums.itertuples(index=False):
        d = row._asdict()
        sym = lambda k, d=d: np.array([[d[f"{k}{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
        s = np.array([d["s0"], d["s1"], d["s2"]])
        gram, energy = sym("g") - np.outer(s, s), sym("a")
        size = np.sqrt(np.maximum(np.diag(gram), 0))
        use = size > 1e-14 * max(size.max(), 1e-300)
        scale = np.where(use, 1 / np.where(use, size, 1), 0)
        g, e = gram * np.outer(scale, scale), energy * np.outer(scale, scale)
        values, vectors = np.linalg.eigh(g)
        good = values > 1e-10
        basis = vectors[:, good] / np.sqrt(values[good])
        found, mix = np.linalg.eigh(basis.T @ e @ basis)
        c = (basis @ mix[:, 0]) * scale
        out.append((d["room_id"], *c, -float(c @ s), float(found[0]), float(size[1])))
    return pd.DataFrame(out, columns=["room_id", "ca", "cb", "cc", "cs", "value", "residual"])


def fiedler(edges: DataFrame, tolerance: float = 1e-7, rounds: int = 400) -> DataFrame:
    """(room_id, node, s, x, value): the two least eigenvectors of each connected graph's normalised Laplacian and the second's eigenvalue.

    ``edges``: room_id, p, q, weight, each pair once. The first vector, s, is known: the
    roots of the degrees. The second comes from conjugate directions: a round is one
    matrix-vector product, a join over the edges, and the best combination of the vector,
    its residual and the last step, for which each graph gives a row of sums. No graph is
    held by one task. Rounds end when every residual is below ``tolerance``.
    """
    both = edges.select("room_id", "p", "q", "weight").unionByName(edges.select("room_id", F.col("q").alias("p"), F.col("p").alias("q"), "weight"))
    degree = both.groupBy("room_id", F.col("p").alias("node")).agg(F.sum("weight").alias("d"))
    total = degree.groupBy("room_id").agg(F.sum("d").alias("_all"))
    noise = F.xxhash64("node") / F.lit(float(1 << 63))
    nodes = materialize(degree.join(total, "room_id").select("room_id", "node", "d", F.sqrt(F.col("d") / F.col("_all")).alias("s"), noise.alias("x")), "fiedler-nodes")
    at = lambda c: nodes.select(F.col("node").alias(c), F.col("d").alias(f"_d{c}"))
    links = both.join(at("p"), "p").join(at("q"), "q").select("room_id", "p", "q", (F.col("weight") / F.sqrt(F.col("_dp") * F.col("_dq"))).alias("w"))
    links = materialize(links, "fiedler-links")

    def laplace(df: DataFrame, column: str, name: str) -> DataFrame:
        near = links.join(df.select(F.col("node").alias("q"), F.col(column).alias("_v")), "q").groupBy(F.col("p").alias("node")).agg(F.sum(F.col("w") * F.col("_v")).alias("_n"))
        return df.join(near, "node").withColumn(name, F.col(column) - F.col("_n")).drop("_n")

    zero = F.lit(0.0)
    state = laplace(nodes.drop("d"), "x", "lx").withColumns({"r": zero, "lr": zero, "p": zero, "lp": zero})
    state = materialize(state, "fiedler-0")
    basis = (("x", "lx"), ("r", "lr"), ("p", "lp"))
    sums = [F.sum(F.col(basis[i][0]) * F.col(basis[j][0])).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)]
    sums += [F.sum(F.col(basis[i][0]) * F.col(basis[j][1])).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)]
    sums += [F.sum(F.col("s") * F.col(basis[i][0])).alias(f"s{i}") for i in range(3)]
    for i in range(1, rounds + 1):
        best = state.groupBy("room_id").agg(*sums).mapInPandas(lambda parts: (_solve(p) for p in parts), "room_id long, ca double, cb double, cc double, cs double, value double, residual double")
        best = materialize(best, f"fiedler-best{i}")  # a row a graph
        if i > 1 and (best.agg(F.max("residual")).first()[0] or 0.0) < tolerance:
            break
        mixed = lambda x, r, p: F.col("ca") * F.col(x) + F.col("cb") * F.col(r) + F.col("cc") * F.col(p)
        step = lambda r, p: F.col("cb") * F.col(r) + F.col("cc") * F.col(p)
        new = {"x": mixed("x", "r", "p") + F.col("cs") * F.col("s"), "lx": mixed("lx", "lr", "lp"), "p": step("r", "p"), "lp": step("lr", "lp")}
        moved = state.join(best, "room_id").select("room_id", "node", "s", "value", *[c.alias(k) for k, c in new.items()])
        moved = moved.withColumn("r", F.col("lx") - F.col("value") * F.col("x")).drop("value")
        state = materialize(laplace(moved, "r", "lr").select("room_id", "node", "s", *[c for b in basis for c in b]), f"fiedler-{i}")
    norm = state.groupBy("room_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"))
    return state.join(norm, "room_id").join(best.select("room_id", "value"), "room_id").select("room_id", "node", "s", (F.col("x") / F.col("_n")).alias("x"), "value")


def two_way(vectors: DataFrame) -> DataFrame:
    """(room_id, node, part): ``cluster_qr`` of two vectors (s, x) as aggregations: two pivot rows a graph, the polar factor of their block, the larger entry."""
    by = lambda c: F.max(F.struct(F.round(c, 12).alias("v"), (-F.col("node")).alias("k"), "s", "x"))
    first = vectors.groupBy("room_id").agg(by(F.col("s") * F.col("s") + F.col("x") * F.col("x")).alias("f"))
    off = F.col("s") * F.col("f.x") - F.col("x") * F.col("f.s")  # what the first pivot leaves over
    second = vectors.join(first, "room_id").groupBy("room_id").agg(by(off * off).alias("t"), F.first("f").alias("f"))
    # block [[f.s, t.s], [f.x, t.x]]; its polar factor is the block plus or minus its cofactors, scaled
    a, b, c, d = F.col("f.s"), F.col("t.s"), F.col("f.x"), F.col("t.x")
    sign = F.when(a * d - b * c < 0, -1.0).otherwise(1.0)
    factor = second.select("room_id", (a + sign * d).alias("u0"), (b - sign * c).alias("u1"), (c - sign * b).alias("v0"), (d + sign * a).alias("v1"))
    along = lambda i: F.abs(F.col("s") * F.col(f"u{i}") + F.col("x") * F.col(f"v{i}"))
    return vectors.join(factor, "room_id").select("room_id", "node", (along(1) > along(0)).cast("int").alias("part"))


def split_parts(edges: DataFrame, cfg: MapConfig = DEFAULT, dense: int = DENSE) -> DataFrame:
    """(room_id, line_id, part) of every line in a room's connected visibility graph: ``split_graph`` at any size.

    Graphs of up to ``dense`` lines are solved in one task each, larger ones by ``fiedler``;
    both give the same vectors.
    """
    nodes = edges.select("room_id", F.col("p").alias("node")).unionByName(edges.select("room_id", F.col("q").alias("node"))).distinct()
    sizes = materialize(nodes.groupBy("room_id").agg(F.count("*").alias("n")), "graph-sizes")
    small = split_rooms(edges.join(sizes.where(F.col("n") <= dense).select("room_id"), "room_id", "left_semi"), cfg)
    if sizes.where(F.col("n") > dense).isEmpty():
        return small
    large = materialize(edges.join(sizes.where(F.col("n") > dense).select("room_id"), "room_id", "left_semi"), "large-graphs")
    vectors = materialize(fiedler(large), "fiedler-vectors")
    parts = materialize(two_way(vectors), "two-way")
    fit = parts.groupBy("room_id").agg(F.sum("part").alias("_one"), F.count("*").alias("_n"), F.min(F.struct("node", "part"))["part"].alias("_least"))
    fit = fit.join(vectors.groupBy("room_id").agg(F.first("value").alias("_value")), "room_id")
    splits = (F.col("_value") <= cfg.fiedler_thresh) & (F.least("_one", F.col("_n") - F.col("_one")) >= 2)
    part = F.when(splits, F.col("part").bitwiseXOR(F.col("_least"))).otherwise(0).cast("int")
    return small.unionByName(parts.join(fit, "room_id").select("room_id", F.col("node").alias("line_id"), part.alias("part")))


def cluster_local(w: np.ndarray, label: np.ndarray, current: int, new_lines: bool, cfg: MapConfig = DEFAULT) -> np.ndarray:
    """Local clusters of the lines around the robot: the current room split in two, or all of them clustered anew, or the rooms as they are.

    The current room is split if the gaps between eigenvalues allow one more cluster than
    there are rooms and its own graph qualifies (``split_graph``). Otherwise new lines let
    the gaps choose between as many clusters as rooms and one fewer: one fewer where its gap
    is larger by 0.1, and a single one for two rooms where the first gap leads by 1.
    """
    rooms, here = np.unique(label), label == current
    clusters = np.searchsorted(rooms, label)
    values, vectors = laplacian_spectrum(w)
    best = eigengap(values) if len(values) > 1 else 1
    if len(rooms) == 1 or best > len(rooms):
        at = np.flatnonzero(here)
        parts = split_graph(w[np.ix_(at, at)], cfg)
        if parts.any():
            clusters[at[parts == 1]] = len(rooms)
            return clusters
    if not new_lines or len(rooms) == 1 or len(values) <= len(rooms):
        return clusters
    gaps = np.diff(values)
    fewer, same = gaps[len(rooms) - 2], gaps[len(rooms) - 1]
    if best == 1 and len(rooms) == 2 and fewer - same >= 1:
        return np.zeros_like(clusters)
    return cluster_qr(vectors[:, : len(rooms) - (fewer - same >= 0.1)])


def local_clusters(lines: DataFrame, edges: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """(map_id, line_id, old, local, current) of the lines around each robot (map_id, line_id, old, current, is_new) by their visibility edges (map_id, p, q, weight).

    Lines around a robot are those of its room and of the rooms next to it: one bounded group a map.
    """

    def run(t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame([], columns=["map_id", "line_id", "old", "local", "current"])
        t = t.sort_values("line_id")
        at = {n: i for i, n in enumerate(t["line_id"])}
        w = np.zeros((len(t),) * 2)
        for p, q, x in e[["p", "q", "weight"]].itertuples(index=False):
            w[at[p], at[q]] = w[at[q], at[p]] = x
        local = cluster_local(w, t["old"].to_numpy(), int(t["current"].iloc[0]), bool(t["is_new"].any()), cfg)
        return t[["map_id", "line_id", "old", "current"]].assign(local=local)

    return lines.groupBy("map_id").cogroup(edges.groupBy("map_id")).applyInPandas(run, "map_id long, line_id long, old int, current int, local int")


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment (shortest augmenting paths); rows and columns beyond the smaller side stay free."""
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            step = c[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (step < low[1:])
            low[1:][better], way[1:][better] = step[better], j0
            j1 = int(np.where(used[1:], np.inf, low[1:]).argmin()) + 1
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if turned else (a, b) for a, b in pairs)


def match_labels(contingency: DataFrame, key: str = "map_id") -> DataFrame:
    """(key, new, old): the old label that each new one keeps, by largest total age; labels of one map are one bounded group."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        old, new = np.unique(t["old"]), np.unique(t["new"])
        c = np.zeros((len(new), len(old)))
        c[np.searchsorted(new, t["new"]), np.searchsorted(old, t["old"])] = -t["age"]
        return pd.DataFrame([(t[key].iloc[0], int(new[a]), int(old[b])) for a, b in assign(c)], columns=[key, "new", "old"])

    return contingency.groupBy(key).applyInPandas(run, f"{key} int, new int, old int")


def carry_labels(line_ids: list[int], old: list[int], local: list[int], current: int, used: set[int]) -> list[int]:
    """Room labels after a new local clustering: clusters keep the old label they match best, and only lines of the current room may change theirs.

    1. A single cluster takes the smallest old label; a clustering that equals the old labels stays, if none is a single line.
    2. Clusters and old labels are paired so that the mean ages of the lines they share are largest in sum.
    3. A cluster without a pair is: the current room, if it is a single line; the smallest of
       its lines' rooms, if none of them is the current one; else a new room, with the smallest
       label that no room of the map (``used``) has.
    4. A cluster of a single line goes with the cluster that keeps the line's old label.
    5. A new room of a single line is undone: the line stays where it was. Of the new labels
       the largest then fill the gap, so that numbers stay dense; rooms that exist keep theirs.
    """
    t = pd.DataFrame({"line": line_ids, "old": old, "local": local})
    if t["local"].nunique() == 1:
        return [int(t["old"].min())] * len(t)
    if (t["local"] == t["old"]).all() and t["old"].value_counts().min() > 1:
        return list(old)
    t["age"] = t["line"].max() + 1 - t["line"]
    shared = t.pivot_table(index="local", columns="old", values="age", aggfunc="mean", fill_value=0.0)
    pairs = assign(-shared.to_numpy(float))
    name = pd.Series({shared.index[i]: shared.columns[j] for i, j in pairs}, dtype=object)

    clusters = t.groupby("local").agg(size=("line", "size"), least=("old", "min"), first=("old", "first"), here=("old", lambda o: (o == current).any()))
    extra = clusters[~clusters.index.isin(name.index)]
    lone, new = extra["size"] == 1, extra["here"] & (extra["size"] > 1)
    taken = set(used) | set(name)
    free = [n for n in range(len(taken) + len(extra)) if n not in taken][: int(new.sum())]
    name = pd.concat([name, extra["least"].where(~lone, current).where(~new), pd.Series(free, index=extra.index[new], dtype=object)]).dropna()
    keeper = pd.Series({shared.columns[j]: shared.columns[j] for _, j in pairs}, dtype=object)
    single = clusters.index[(clusters["size"] == 1) & clusters["first"].isin(keeper.index)]
    name.update(clusters.loc[single, "first"].map(keeper))

    found = pd.Series([int(name[c]) if o == current else int(o) for o, c in zip(t["old"], t["local"], strict=True)], index=t.index)
    given = found[~found.isin(list(used) + list(old))]
    alone = given[given.map(given.value_counts()) == 1]
    found.loc[alone.index] = t["old"].loc[alone.index]
    left, gaps = sorted(set(given) - set(alone), reverse=True), sorted(set(alone))
    return found.replace({big: gap for big, gap in zip(left, gaps) if gap < big}).tolist()


def relabel_rooms(lines: DataFrame, key: str = "map_id", rooms: DataFrame | None = None) -> DataFrame:
    """(key, line_id, label) of the lines of each map (key, line_id, old, local, current: the room the robot is in); a map's local lines are one bounded group.

    ``rooms``: (key, label) of all rooms of the maps, so that a new room takes no label of a
    room out of sight. Without it only the given lines' labels are in use.
    """
    labels = lines.select(key, F.col("old").alias("label")) if rooms is None else rooms.select(key, "label")
    used = labels.groupBy(key).agg(F.collect_set("label").alias("_used"))  # a number a room

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("line_id")
        label = carry_labels(t["line_id"].tolist(), t["old"].tolist(), t["local"].tolist(), int(t["current"].iloc[0]), set(t["_used"].iloc[0]))
        return pd.DataFrame({key: t[key], "line_id": t["line_id"], "label": label})

    return lines.join(used, key).groupBy(key).applyInPandas(run, f"{key} long, line_id long, label int")
