"""Analytic worlds: exact ray casting against wall segments."""

import numpy as np


def cast(walls, x, y, yaw=0.0, beams=360, far=3.5):
    """Ranges of all beams from a pose; ``far`` where nothing is hit."""
    w = np.asarray(walls, float)
    a = np.arange(beams) * 2 * np.pi / beams + yaw
    d = np.column_stack((np.cos(a), np.sin(a)))
    e = w[:, 2:] - w[:, :2]
    f = w[:, :2] - np.array([x, y])
    den = d[:, None, 0] * e[None, :, 1] - d[:, None, 1] * e[None, :, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (f[None, :, 0] * e[None, :, 1] - f[None, :, 1] * e[None, :, 0]) / den
        s = (f[None, :, 0] * d[:, None, 1] - f[None, :, 1] * d[:, None, 0]) / den
    t = np.where((t > 0) & (s >= 0) & (s <= 1), t, np.inf).min(1)
    return np.minimum(t, far)


BOX = [(-2, -2, 2, -2), (2, -2, 2, 2), (2, 2, -2, 2), (-2, 2, -2, -2)]


def scans(spark, poses, walls=BOX, robot="r"):
    from fieldloom.sources.schema import SCAN

    rows = [(i, robot, None, (float(x), float(y), 0.0), 0.0, 2 * np.pi / 360, 0.12, 3.5, cast(walls, x, y).tolist()) for i, (x, y) in enumerate(poses)]
    return spark.createDataFrame(rows, SCAN)
