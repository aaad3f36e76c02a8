"""Kernels on gray tiles, as arrays of numbers: natively where arrays suffice, else numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def column_means(tile: Column, height: int, width: int) -> Column:
    """An array of `width` means of a tile kept row by row."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(height - 1)), F.lit(0.0), lambda acc, y: acc + F.get(tile, y * width + x).cast("double")) / height)


def seam(tile: Column, height: int, width: int, search: tuple[float, float] = (0.42, 0.58)) -> Column:
    """The lightest column between two shares of the width, the first of equals."""
    lo, hi = int(width * search[0]), max(int(width * search[1]), int(width * search[0]) + 1)
    part = F.slice(column_means(tile, height, width), lo + 1, hi - lo)
    return (F.lit(lo) + F.array_position(part, F.array_max(part)) - 1).cast("int")


def dark_share(tile: Column, width: int, height: int, threshold: Column, box: tuple[int, int, int, int], pad: int = 0) -> Column:
    """The share of a padded box's pixels below threshold - 10; 0 for a box under 6 pixels on a side."""
    x0, y0, x1, y1 = max(box[0] - pad, 0), max(box[1] - pad, 0), min(box[2] + pad, width), min(box[3] + pad, height)
    if x1 - x0 < 6 or y1 - y0 < 6:
        return F.lit(0.0)
    inside = [y * width + x for y in range(y0, y1) for x in range(x0, x1)]
    dark = F.aggregate(F.array(*[F.lit(i) for i in inside]), F.lit(0), lambda acc, i: acc + (F.get(tile, i) < threshold - 10).cast("int"))
    return dark / len(inside)


def sharpness(tile: Column, height: int, width: int) -> Column:
    """The sum of squared differences of neighbouring rows' sums: largest where lines are level."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.aggregate(F.slice(tile, y * width + 1, F.lit(width)), F.lit(0.0), lambda acc, v: acc + v.cast("double")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(height - 2)), F.lit(0.0), lambda acc, y: acc + F.pow(F.get(sums, y + 1) - F.get(sums, y), F.lit(2.0)))


def otsu(gray: np.ndarray) -> int:
    """The threshold between two classes of most variance between them, of 8-bit values."""
    n = np.bincount(gray.ravel().astype(np.uint8), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), n.sum()
    first = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (first[-1] * below / total - first) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))
