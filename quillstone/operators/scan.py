"""Page geometry: the homography of four corners, and perspective warping of images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GREY = 245


def homography(source, target) -> np.ndarray:
    """The 3 x 3 matrix that takes four points to four points; raises for degenerate corners."""
    rows, right = [], []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    a = np.array(rows, float)
    if np.linalg.matrix_rank(a) < 8 or abs(np.linalg.det(a)) < 1e-12:
        raise ValueError("the corners are degenerate")
    return np.append(np.linalg.solve(a, np.array(right, float)), 1.0).reshape(3, 3)


def apply(h: np.ndarray, x, y):
    w = h[2, 0] * x + h[2, 1] * y + h[2, 2]
    return (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / w, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / w


def default_quad(width: float, height: float, inset: float = 0.06) -> list[list[float]]:
    dx, dy = width * inset, height * inset
    return [[dx, dy], [width - dx, dy], [width - dx, height - dy], [dx, height - dy]]


def warp(image: np.ndarray, quad, max_width: int = 1400) -> np.ndarray:
    """The quad of an image (height, width, channels) as an upright page, bilinear, sampled at pixel centres; grey where the quad leaves
    the image. Values between two bytes go to the nearer, halves to the even one."""
    q = np.array(quad, float)
    edge = lambda a, b: float(np.hypot(*(q[a] - q[b])))
    across, down = max(edge(0, 1), edge(3, 2)), max(edge(0, 3), edge(1, 2))
    width = max(1, int(round(min(max_width, across))))
    height = max(1, int(round(width * down / across))) if across else 1
    h = homography([[0, 0], [width, 0], [width, height], [0, height]], q)
    gx, gy = np.meshgrid(np.arange(width) + 0.5, np.arange(height) + 0.5)
    x, y = apply(h, gx, gy)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < image.shape[1] - 1) & (y0 < image.shape[0] - 1)
    x0, y0 = np.where(inside, x0, 0), np.where(inside, y0, 0)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    img = image.astype(float)
    mix = (img[y0, x0] * (1 - fx) + img[y0, x0 + 1] * fx) * (1 - fy) + (img[y0 + 1, x0] * (1 - fx) + img[y0 + 1, x0 + 1] * fx) * fy
    return np.where(inside[..., None], np.rint(mix), GREY).astype(np.uint8)


def homography_column(source: Column, target: Column) -> Column:
    """array<double> of nine numbers by rows from arrays of four [x, y]; null for degenerate corners."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            try:
                return homography([list(p) for p in x], [list(p) for p in y]).ravel().tolist()
            except ValueError:
                return None

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return run(source, target)
