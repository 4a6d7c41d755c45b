"""Distance fields: voxel and novelty filters, line priors and the sparse Gaussian process per room.

Set-based steps are joins and aggregates; the dense algebra of one room (its inducing
points are at least the novelty radius apart, so their number is bounded by the room's
area) runs in grouped Arrow UDFs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MapConfig
from ..functions import geometry as g
from ..sources.schema import GP_STATE, PREDICTION, names
from ..sources.staging import materialize
from .graph import components
from .spatial import nearest_in_room


def voxel_downsample(points: DataFrame, size: float = DEFAULT.r_voxel, key: tuple[str, ...] = ("room_id",)) -> DataFrame:
    """Mean point of every voxel; the grid starts half a voxel below each group's least coordinates."""
    low = points.groupBy(*key).agg(F.min("x").alias("_lx"), F.min("y").alias("_ly"))
    at = lambda c, least: F.floor((F.col(c) - (F.col(least) - size / 2)) / size)
    placed = points.join(low, list(key)).withColumn("ix", at("x", "_lx")).withColumn("iy", at("y", "_ly"))
    return placed.groupBy(*key, "ix", "iy").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def novelty_radius(cfg: MapConfig = DEFAULT) -> float:
    """The kernel stays below the threshold beyond this distance."""
    return -math.log(cfg.inducing_thresh) / cfg.lamb


def novelty_filter(new: DataFrame, known: DataFrame, cfg: MapConfig = DEFAULT, key: str = "room_id") -> DataFrame:
    """New points (x, y) of a room without a known one within the novelty radius.

    A distance anti-join: known points cover their own grid cell and the eight around it.
    """
    r = novelty_radius(cfg)
    near = F.sequence(F.lit(-1), F.lit(1))
    cell = lambda c: F.floor(F.col(c) / r)
    k = known.select(F.col(key).alias("_key"), F.struct("x", "y").alias("z"), cell("x").alias("_zx"), cell("y").alias("_zy"))
    k = k.withColumn("_ox", F.explode(near)).withColumn("_oy", F.explode(near)).withColumn("_zx", F.col("_zx") + F.col("_ox")).withColumn("_zy", F.col("_zy") + F.col("_oy"))
    n = new.withColumn("_cx", cell("x")).withColumn("_cy", cell("y"))
    close = g.matern_half("x", "y", "z.x", "z.y", cfg.lamb) >= cfg.inducing_thresh
    return n.join(k, (F.col(key) == F.col("_key")) & (F.col("_cx") == F.col("_zx")) & (F.col("_cy") == F.col("_zy")) & close, "left_anti").drop("_cx", "_cy")


def kernel_matrix(points: DataFrame, cfg: MapConfig = DEFAULT, key: str = "room_id", id_col: str = "point_id", least: float = 1e-9) -> DataFrame:
    """Entries (key, i, j, value), i < j, of the kernel between a room's points that reach ``least``; all others count as 0.

    The kernel decays within a hand's breadth, so points meet those of their own grid cell
    and of the eight around it.
    """
    r = -math.log(least) / cfg.lamb
    cell = lambda c: F.floor(F.col(c) / r)
    near = F.sequence(F.lit(-1), F.lit(1))
    a = points.select(key, F.struct(F.col(id_col).alias("id"), "x", "y").alias("a"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    b = points.select(key, F.struct(F.col(id_col).alias("id"), "x", "y").alias("b"), cell("x").alias("_bx"), cell("y").alias("_by"), F.explode(near).alias("_ox"))
    b = b.withColumn("_oy", F.explode(near)).select(key, "b", (F.col("_bx") + F.col("_ox")).alias("_cx"), (F.col("_by") + F.col("_oy")).alias("_cy"))
    pairs = a.join(b, [key, "_cx", "_cy"]).where("a.id < b.id")
    out = pairs.select(key, F.col("a.id").alias("i"), F.col("b.id").alias("j"), g.matern_half("a.x", "a.y", "b.x", "b.y", cfg.lamb).alias("value"))
    return out.where(F.col("value") >= least)


def line_prior(points: DataFrame, segments: DataFrame, cfg: MapConfig = DEFAULT, key: str = "room_id") -> DataFrame:
    """(point_id, min_distance, prior): exp(-lambda * distance) to the nearest line of the room; rooms without lines give no row."""
    near = nearest_in_room(points, segments, ("point_id",), key, None)
    return near.select("point_id", F.sqrt("d2").alias("min_distance")).withColumn("prior", F.exp(-cfg.lamb * F.col("min_distance")))


def query_grid(rooms: DataFrame, steps: int = 30, margin: float = 1.0) -> DataFrame:
    """A grid of ``steps`` by ``steps`` points over each room's box widened by the margin: room_id, i, j, x, y."""
    at = lambda low, high, n: (F.col(low) - margin) + F.col(n) * (F.col(high) - F.col(low) + 2 * margin) / (steps - 1)
    each = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    grid = rooms.select("room_id", "min_x", "max_x", "min_y", "max_y", each.alias("i")).withColumn("j", each)
    return grid.select("room_id", "i", "j", at("min_x", "max_x", "i").alias("x"), at("min_y", "max_y", "j").alias("y"))


def edf_transform(mu: Column | str, cfg: MapConfig = DEFAULT) -> Column:
    """Distance of a field value; null where the logarithm has none."""
    m = g._c(mu)
    return F.when(m > 0, -F.ln(F.when(m > 0, m)) / cfg.lamb)


# Dense algebra of one room


def kernel(a: np.ndarray, b: np.ndarray, lamb: float) -> np.ndarray:
    return np.exp(-lamb * np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)))


def chol(m: np.ndarray, jitter: float) -> np.ndarray:
    """Cholesky factor; the jitter grows tenfold while the matrix is not positive definite."""
    eye = np.eye(len(m))
    for i in range(8):
        try:
            return np.linalg.cholesky(m + jitter * 10**i * eye)
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("not positive definite")


def segment_prior(x: np.ndarray, segs: np.ndarray, lamb: float, part: int = 1 << 18) -> np.ndarray:
    """exp(-lambda * distance) to the nearest of the segments (n, 4); zero without any. About ``part`` pairs are held at a time."""
    if not len(segs):
        return np.zeros(len(x))
    d2 = np.full(len(x), np.inf)
    step = max(part // max(len(x), 1), 1)
    for at in range(0, len(segs), step):
        a, ab = segs[None, at : at + step, :2], segs[None, at : at + step, 2:] - segs[None, at : at + step, :2]
        n = (ab**2).sum(-1)
        t = np.clip(((x[:, None] - a) * ab).sum(-1) / np.where(n > 0, n, 1), 0, 1)
        d2 = np.minimum(d2, ((x[:, None] - a - t[..., None] * ab) ** 2).sum(-1).min(1))
    return np.exp(-lamb * np.sqrt(d2))


@dataclass
class Field:
    """Sparse posterior of one room: inducing points, their mean and covariance, and what the last batch carries over."""

    z: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    old_z: np.ndarray
    old_mean: np.ndarray
    old_c: np.ndarray

    @staticmethod
    def empty() -> Field:
        none = np.zeros((0, 2)), np.zeros(0), np.zeros((0, 0))
        return Field(*none, *none)


def novel(x: np.ndarray, z: np.ndarray, segs: np.ndarray, cfg: MapConfig) -> np.ndarray:
    """New inducing points: off the walls and beyond the novelty radius of the known ones."""
    if len(segs):
        x = x[-np.log(np.maximum(segment_prior(x, segs, cfg.lamb), 1e-300)) / cfg.lamb > cfg.near_line]
    if len(z) and len(x):
        x = x[kernel(z, x, cfg.lamb).max(0) < cfg.inducing_thresh]
    return x


def update(field: Field, x: np.ndarray, cfg: MapConfig = DEFAULT, segs: np.ndarray | None = None) -> Field:
    """Posterior after a batch of surface points (target 1 each).

    C = K_bf K_fb / s2 + T' C_old T and c = K_bf y / s2 + K_ba K_aa^-1 m_a + T' C_old K_aa^-1 m_a
    with T = K_aa^-1 K_ab; then m = K (K + C)^-1 c and S = K (K + C)^-1 K. With
    ``carry_c='previous'`` C_old is the matrix the old mean was fitted with, which equals
    exact regression while all points are kept; 'reference' uses the new batch on the old model.
    """
    if not len(x):
        return field
    fresh = novel(x, field.z, segs if segs is not None else np.zeros((0, 4)), cfg)
    z = np.concatenate((field.z, fresh))
    if not len(z):
        return field
    y = np.ones(len(x))
    kbf, kbb = kernel(z, x, cfg.lamb), kernel(z, z, cfg.lamb) + cfg.gp_jitter * np.eye(len(z))
    c_mat, c_vec = kbf @ kbf.T / cfg.noise, kbf @ y / cfg.noise
    if len(field.z):
        old_c = field.old_c
        if cfg.carry_c == "reference":
            kaf = kernel(field.z, x, cfg.lamb)
            old_c = kaf @ kaf.T / cfg.noise
            if len(field.old_z):
                back = np.linalg.solve(kernel(field.old_z, field.old_z, cfg.lamb) + cfg.gp_jitter * np.eye(len(field.old_z)), kernel(field.old_z, field.z, cfg.lamb))
                old_c = old_c + back.T @ field.old_c[: len(field.old_z), : len(field.old_z)] @ back
        kaa = kernel(field.z, field.z, cfg.lamb) + cfg.gp_jitter * np.eye(len(field.z))
        kab = kernel(field.z, z, cfg.lamb)
        t, w = np.linalg.solve(kaa, kab), np.linalg.solve(kaa, field.mean)
        c_mat, c_vec = c_mat + t.T @ old_c @ t, c_vec + kab.T @ w + t.T @ (old_c @ w)
    factor = chol(kbb + c_mat, cfg.gp_jitter)
    half = np.linalg.solve(factor, kbb)
    return Field(z, half.T @ np.linalg.solve(factor, c_vec), half.T @ half, field.z, field.mean, c_mat)


def weights(field: Field, segs: np.ndarray, cfg: MapConfig) -> np.ndarray:
    """Weights of the inducing points' kernels: the mean above the prior, solved once for all predictions."""
    if not len(field.z):
        return np.zeros(0)
    return np.linalg.solve(kernel(field.z, field.z, cfg.lamb) + cfg.gp_jitter * np.eye(len(field.z)), field.mean - segment_prior(field.z, segs, cfg.lamb))


def predict(field: Field, x: np.ndarray, segs: np.ndarray | None = None, cfg: MapConfig = DEFAULT, gradient: bool = False, solved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Field value, distance and, on demand, the unit gradient of the distance (through the kernel only). ``solved``: the field's ``weights``."""
    segs = segs if segs is not None else np.zeros((0, 4))
    mu = segment_prior(x, segs, cfg.lamb)
    grad = np.zeros((len(x), 2))
    if len(field.z):
        k = kernel(x, field.z, cfg.lamb)
        w = solved if solved is not None else weights(field, segs, cfg)
        mu = mu + k @ w
        if gradient:
            gap = x[:, None] - field.z[None]
            far = np.sqrt((gap**2).sum(-1))
            slope = -cfg.lamb * k * w / np.where(far > 0, far, 1)
            grad = (slope[..., None] * gap).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = -np.log(mu) / cfg.lamb
        if gradient:
            grad = -grad / (cfg.lamb * mu[:, None])
            grad = grad / np.where((n := np.sqrt((grad**2).sum(1)))[:, None] > 0, n[:, None], 1)
    return mu, dist, grad if gradient else None


def _part(field: Field, keep: np.ndarray) -> Field:
    return Field(field.z[keep], field.mean[keep], field.cov[np.ix_(keep, keep)], field.old_z, field.old_mean, field.old_c[np.ix_(keep, keep)] if len(field.old_c) == len(field.z) else field.old_c)


def split(field: Field, second: np.ndarray) -> tuple[Field, Field]:
    """Two fields by a mask of the inducing points that move to the second."""
    return _part(field, ~second), _part(field, second)


def merge(a: Field, b: Field) -> Field:
    """One field of both rooms; they share no covariance."""

    def block(m: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((len(m) + len(n),) * 2)
        out[: len(m), : len(m)], out[len(m) :, len(m) :] = m, n
        return out

    cat = lambda m, n: np.concatenate((m, n))
    return Field(cat(a.z, b.z), cat(a.mean, b.mean), block(a.cov, b.cov), cat(a.old_z, b.old_z), cat(a.old_mean, b.old_mean), block(a.old_c, b.old_c))


def adjust(a: Field, b: Field, moved: np.ndarray, cfg: MapConfig = DEFAULT) -> tuple[Field, Field]:
    """Move the masked inducing points of the first field to the second, which is fitted to them anew."""
    stay, go = split(a, moved)
    return stay, update(b, go.z, cfg) if len(go.z) else b


def apply_changes(fields: dict[int, Field], changes: list[tuple[int, int, str, np.ndarray]], cfg: MapConfig = DEFAULT) -> dict[int, Field]:
    """Follow room changes (from, to, kind, mask of the source's inducing points that move)."""
    for source, target, kind, mask in changes:
        if source not in fields:
            continue
        if kind == "new_room":
            fields[source], fields[target] = split(fields[source], mask)
        elif kind == "merged_rooms":
            fields[target] = merge(fields.get(target, Field.empty()), fields.pop(source))
        else:
            fields[source], fields[target] = adjust(fields[source], fields.get(target, Field.empty()), mask, cfg)
    return fields


# The same per room on Spark

#: States a file: one has two square matrices of its inducing points, megabytes a row.
STATES = 8


def _row(room: int, version: int, field: Field, segs: np.ndarray, cfg: MapConfig) -> list:
    return [room, version, len(field.z), field.z[:, 0], field.z[:, 1], field.mean, list(field.cov), field.old_z[:, 0], field.old_z[:, 1], field.old_mean, list(field.old_c), weights(field, segs, cfg)]


def _field(row) -> Field:
    square = lambda m: np.array([np.asarray(r, float) for r in m]).reshape(len(m), -1) if len(m) else np.zeros((0, 0))
    pair = lambda a, b: np.column_stack((np.asarray(row[a], float), np.asarray(row[b], float))).reshape(-1, 2)
    return Field(pair("zx", "zy"), np.asarray(row["mean"], float), square(row["chol"]), pair("old_zx", "old_zy"), np.asarray(row["old_mean"], float), square(row["old_c"]))


def _room_lines(segments: DataFrame) -> DataFrame:
    """(room_id, lines): each room's lines in order; a room's lines are few."""
    return segments.select(F.col("room_id").cast("long").alias("room_id"), F.struct("line_id", "x1", "y1", "x2", "y2").alias("s")).groupBy("room_id").agg(F.sort_array(F.collect_list("s")).alias("lines"))


def _line_array(lines) -> np.ndarray:
    return np.array([[x["x1"], x["y1"], x["x2"], x["y2"]] for x in (lines if lines is not None else [])]).reshape(-1, 4)


def _batches(p: pd.DataFrame, batch_col: str) -> list[np.ndarray]:
    return [b[["x", "y"]].to_numpy() for _, b in p.sort_values([batch_col, "x", "y"]).groupby(batch_col)]


def _fitted(p: pd.DataFrame, segs: np.ndarray, cfg: MapConfig, batch_col: str) -> tuple[Field, int]:
    """A room's field after its batches, and their number."""
    field, each = Field.empty(), _batches(p, batch_col)
    for x in each:
        field = update(field, x, cfg, segs)
    return field, len(each)


def fit_rooms(points: DataFrame, segments: DataFrame | None = None, cfg: MapConfig = DEFAULT, batch_col: str = "batch") -> DataFrame:
    """GP state of every room from its points (room_id, batch, x, y), batches in order. Points should be voxels, which bound a room.

    A room with lines but no points has a state without inducing points: its prior alone.
    """

    def fit(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        room = int((p if len(p) else s)["room_id"].iloc[0])
        segs = s[["x1", "y1", "x2", "y2"]].to_numpy()
        field, version = _fitted(p, segs, cfg, batch_col)
        return pd.DataFrame([_row(room, version, field, segs, cfg)], columns=names(GP_STATE))

    none = points.sparkSession.createDataFrame([], "room_id long, x1 double, y1 double, x2 double, y2 double")
    lines = (none if segments is None else segments).select(F.col("room_id").cast("long").alias("room_id"), "x1", "y1", "x2", "y2")
    return points.withColumn("room_id", F.col("room_id").cast("long")).groupBy("room_id").cogroup(lines.groupBy("room_id")).applyInPandas(fit, GP_STATE)


def inducing_points(points: DataFrame, cfg: MapConfig = DEFAULT, batch_col: str = "batch") -> DataFrame:
    """(room_id, zx, zy): the inducing points that ``fit_rooms`` finds without lines, in its order, without the algebra."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros((0, 2))
        for x in _batches(p, batch_col):
            z = np.concatenate((z, novel(x, z, np.zeros((0, 4)), cfg)))
        return pd.DataFrame({"room_id": [int(p["room_id"].iloc[0])], "zx": [z[:, 0]], "zy": [z[:, 1]]})

    return points.select(F.col("room_id").cast("long").alias("room_id"), batch_col, "x", "y").groupBy("room_id").applyInPandas(run, "room_id long, zx array<double>, zy array<double>")


def update_rooms(state: DataFrame, points: DataFrame, segments: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """GP states after one more batch of points (room_id, x, y) with the rooms' present lines; rooms without new points stay as they are."""
    new = points.select(F.col("room_id").cast("long").alias("room_id"), "x", "y")
    held = state.join(_room_lines(segments), "room_id", "full").select(*names(GP_STATE), "lines")

    def run(p: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        row = s.iloc[0] if len(s) else None
        known = row is not None and row["zx"] is not None
        segs = _line_array(row["lines"] if row is not None else None)
        room = int((p if len(p) else s)["room_id"].iloc[0])
        field, version = (_field(row), int(row["version"])) if known else (Field.empty(), 0)
        if len(p):
            field, version = update(field, p.sort_values(["x", "y"])[["x", "y"]].to_numpy(), cfg, segs), version + 1
        return pd.DataFrame([_row(room, version, field, segs, cfg)], columns=names(GP_STATE))

    return new.groupBy("room_id").cogroup(held.groupBy("room_id")).applyInPandas(run, GP_STATE)


def moved_points(state: DataFrame, lines: DataFrame) -> DataFrame:
    """(room_id, i, to_room): inducing points, by place, whose nearest line in their room (line_id, old, new and ends) goes to another room."""
    z = state.select("room_id", F.posexplode(F.arrays_zip("zx", "zy")).alias("i", "z")).select("room_id", "i", F.col("z.zx").alias("x"), F.col("z.zy").alias("y"))
    old = lines.withColumn("room_id", F.col("old").cast("long"))
    near = nearest_in_room(z, old, ("room_id", "i"))
    went = near.join(lines.select("line_id", "old", "new"), "line_id").where("old != new")
    return went.select("room_id", "i", F.col("new").cast("long").alias("to_room"))


def predict_rooms(queries: DataFrame, state: DataFrame, segments: DataFrame | None = None, cfg: MapConfig = DEFAULT, share: int = 4096) -> DataFrame:
    """Predictions for queries (query_id, room_id, x, y); a room's queries are dealt into parts of about ``share``, each with a copy of its state.

    ``segments``: the lines that the state was fitted with.
    """
    lines = _room_lines(segments) if segments is not None else None
    full = state.join(lines, "room_id", "left") if lines is not None else state.withColumn("lines", F.lit(None).cast("array<struct<line_id:bigint,x1:double,y1:double,x2:double,y2:double>>"))
    queries = queries.withColumn("room_id", F.col("room_id").cast("long"))
    parts = queries.groupBy("room_id").agg(F.ceil(F.count("*") / share).cast("int").alias("_parts"))
    copies = full.join(parts, "room_id").select("room_id", "zx", "zy", "mean", "weights", "lines", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    dealt = queries.join(parts, "room_id").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int"))

    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame([], columns=names(PREDICTION))
        r = s.iloc[0]
        z = np.column_stack((r["zx"], r["zy"]))
        segs = _line_array(r["lines"])
        none = np.zeros((0, 2)), np.zeros(0), np.zeros((0, 0))
        mu, d, grad = predict(Field(z, np.asarray(r["mean"]), np.zeros((len(z), len(z))), *none), q[["x", "y"]].to_numpy(), segs, cfg, True, np.asarray(r["weights"]))
        return pd.DataFrame({"query_id": q["query_id"], "room_id": q["room_id"], "x": q["x"], "y": q["y"], "mu": mu, "distance": d, "gx": grad[:, 0], "gy": grad[:, 1]})

    return dealt.groupBy("room_id", "_part").cogroup(copies.groupBy("room_id", "_part")).applyInPandas(run, PREDICTION)


def follow_changes(state: DataFrame, changes: DataFrame, moved: DataFrame, segments: DataFrame, cfg: MapConfig = DEFAULT) -> DataFrame:
    """The GP states after room changes (from_room, to_room, kind as of ``rooms.room_changes``).

    ``moved``: (room_id, i, to_room), the inducing points, by place, that go along; of a
    merged room all do. ``segments``: the lines of the rooms after the changes. Rooms that
    changes connect are one group, in which changes apply in order of their rooms; the other
    states stay as they are.
    """

    def held(s: pd.DataFrame) -> dict[int, tuple[Field, int]]:
        return {int(r["room_id"]): (_field(r), int(r["version"])) for _, r in s.iterrows()}

    mine, other, steps = _groups(state.select(*names(GP_STATE)), changes, moved, segments)
    return other.unionByName(_follow(mine, held, steps, cfg))


def fit_changed(points: DataFrame, changes: DataFrame, moved: DataFrame, segments: DataFrame, cfg: MapConfig = DEFAULT, batch_col: str = "batch") -> DataFrame:
    """``follow_changes`` of the states that ``fit_rooms`` makes of points (room_id, batch, x, y) without lines.

    A group's points are shuffled and its fields fitted where they change: a state has the
    square of its inducing points, which is never written. ``moved`` goes by the places of
    ``inducing_points``.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the work is far larger than the bytes, by which Spark would join partitions

    def held(p: pd.DataFrame) -> dict[int, tuple[Field, int]]:
        return {int(room): _fitted(own, np.zeros((0, 4)), cfg, batch_col) for room, own in p.groupby("room_id")}

    mine, other, steps = _groups(points.select(F.col("room_id").cast("long").alias("room_id"), batch_col, "x", "y"), changes, moved, segments)
    return fit_rooms(other, None, cfg, batch_col).unionByName(_follow(mine.repartition(tasks, "_of"), held, steps, cfg))


def _groups(rows: DataFrame, changes: DataFrame, moved: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (room_id, ...) of rooms in a group, by the group's number _of; those of other rooms; the groups' changes and lines (_at, source, target, kind, go, lines), a room's lines without kind."""
    room = lambda c: F.col(c).cast("long")
    steps = changes.select(room("from_room").alias("source"), room("to_room").alias("target"), "kind")
    go = moved.groupBy(room("room_id").alias("source"), room("to_room").alias("target")).agg(F.sort_array(F.collect_list("i")).alias("go"))  # a room's inducing points at most
    steps = materialize(steps.join(go, ["source", "target"], "left"), "field-changes")
    group = materialize(components(steps.select(F.col("source").alias("a"), F.col("target").alias("b")), "field-groups"), "field-group")
    of = lambda c: group.select(F.col("node").alias(c), F.col("root").alias("_of"))
    mine, other = rows.join(of("room_id"), "room_id").select("_of", *rows.columns), rows.join(of("room_id"), "room_id", "left_anti").select(*rows.columns)
    steps = steps.join(of("source"), "source").select(F.col("_of").alias("_at"), "source", "target", "kind", "go")
    walls = _room_lines(segments).join(of("room_id"), "room_id").select(F.col("_of").alias("_at"), F.col("room_id").alias("source"), F.col("room_id").alias("target"), "lines")
    return mine, other, steps.unionByName(walls, allowMissingColumns=True)  # a room's lines come with the changes, so that rows are shuffled once


def _follow(mine: DataFrame, held, steps: DataFrame, cfg: MapConfig) -> DataFrame:
    """The GP states of all groups after their changes; ``held``: a group's fields and versions by room, of its rows."""

    def run(s: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        lines = {int(r["source"]): _line_array(r["lines"]) for _, r in c[c["kind"].isna()].iterrows()}
        had = held(s)
        fields, versions = {k: f for k, (f, _) in had.items()}, {k: n for k, (_, n) in had.items()}
        for _, r in c[c["kind"].notna()].sort_values(["source", "target"]).iterrows():
            if int(r["source"]) in fields:
                mask = np.zeros(len(fields[int(r["source"])].z), bool)
                mask[[i for i in (r["go"] if r["go"] is not None else []) if i < len(mask)]] = True
                fields = apply_changes(fields, [(int(r["source"]), int(r["target"]), r["kind"], mask)], cfg)
        none = np.zeros((0, 4))
        return pd.DataFrame([_row(k, versions.get(k, 0) + 1, f, lines.get(k, none), cfg) for k, f in sorted(fields.items())], columns=names(GP_STATE))

    return mine.groupBy("_of").cogroup(steps.groupBy("_at")).applyInPandas(run, GP_STATE)


def fit_tiles(points: DataFrame, segments: DataFrame | None = None, cfg: MapConfig = DEFAULT, tile: float = 2.0, margin: float = 0.5) -> DataFrame:
    """One field over all points (batch, x, y), fitted per square tile: a GP state for each, under the tile's number as room_id.

    The kernel has decayed to nothing within ``margin``, so a tile is fitted on its own points
    and those that near, with the lines whose boxes come that near; its size bounds the
    algebra, whatever the area. ``tile_of`` tells which tile predicts at a point.
    """
    reach = lambda low, high: F.explode(F.sequence(F.floor((low - margin) / tile), F.floor((high + margin) / tile)))
    own = points.withColumn("_tx", reach(F.col("x"), F.col("x"))).withColumn("_ty", reach(F.col("y"), F.col("y"))).select(_tile_number(F.col("_tx"), F.col("_ty")).alias("room_id"), "batch", "x", "y")
    lines = None
    if segments is not None:
        lines = segments.withColumn("_tx", reach(F.least("x1", "x2"), F.greatest("x1", "x2"))).withColumn("_ty", reach(F.least("y1", "y2"), F.greatest("y1", "y2")))
        lines = lines.select(_tile_number(F.col("_tx"), F.col("_ty")).alias("room_id"), "x1", "y1", "x2", "y2")
        lines = lines.join(own.select("room_id").distinct(), "room_id", "left_semi")
    return fit_rooms(own, lines, cfg)


def _tile_number(tx: Column, ty: Column) -> Column:
    return F.shiftleft(tx, 31) + ty + (1 << 30)


def tile_of(x: str = "x", y: str = "y", tile: float = 2.0) -> Column:
    return _tile_number(F.floor(F.col(x) / tile), F.floor(F.col(y) / tile))
