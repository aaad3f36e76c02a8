"""Kernels on gray images of pages, in numpy: what Spark has no operator for.

Each takes and gives arrays of one page or half page; `halves` runs them where the pages are, and what they
find leaves as rows, so that deciding about objects stays relational (see `inventory`).
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import kernels

ANGLES = np.arange(-5.0, 5.0 + 1e-6, 0.25)
MOST_PIXELS, MOST_BYTES, LONG_EDGE = 18_000_000, 9_500_000, 2200
HALVES = "path string, page int, side string, width int, height int, deskew double, h_lines int, v_lines int, threshold int, image binary, boxes array<struct<x:int,y:int,w:int,h:int,v_rules:int>>"


def to_gray(image: np.ndarray) -> np.ndarray:
    """Blue, green and red as one 8-bit value; a gray image as it is."""
    if image.ndim == 2:
        return image
    return (image[..., :3] @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8)


def split_spread(gray: np.ndarray, search: tuple[float, float] = (0.42, 0.58), least: float = 0.35) -> list[tuple[str, np.ndarray]]:
    """The two halves of a spread, cut at the lightest column of the middle; the whole where a half would be too narrow."""
    width = gray.shape[1]
    lo, hi = int(width * search[0]), int(width * search[1])
    if hi <= lo:
        return [("full", gray)]
    cut = lo + int(np.argmax(gray[:, lo:hi].mean(axis=0)))
    return [("full", gray)] if min(cut, width - cut) < width * least else [("L", gray[:, :cut]), ("R", gray[:, cut:])]


def box_mean(gray: np.ndarray, size: int) -> np.ndarray:
    """The rounded mean of the square of `size` about each pixel; beyond the edge its pixels repeat."""
    half = size // 2
    padded = np.pad(gray.astype(np.int64), half, mode="edge")
    total = np.pad(padded.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    s = total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]
    return (2 * s + size * size) // (2 * size * size)


def dark(gray: np.ndarray, size: int, less: int) -> np.ndarray:
    """Pixels darker by `less` than their surroundings."""
    return gray.astype(np.int64) - box_mean(gray, size) <= -less


def _window(mask: np.ndarray, n: int, axis: int, outside: bool) -> np.ndarray:
    """How many of the n pixels about each, along an axis, are set; those outside count as `outside`."""
    pads = [(0, 0), (0, 0)]
    pads[axis] = (n // 2, n - 1 - n // 2)
    total = np.cumsum(np.pad(mask, pads, constant_values=outside), axis=axis, dtype=np.int32)
    total = np.concatenate([np.zeros_like(np.take(total, [0], axis=axis)), total], axis=axis)
    size = mask.shape[axis]
    return np.take(total, np.arange(n, n + size), axis=axis) - np.take(total, np.arange(size), axis=axis)


def erode(mask: np.ndarray, n: int, axis: int) -> np.ndarray:
    return _window(mask, n, axis, True) == n


def dilate(mask: np.ndarray, n: int, axis: int) -> np.ndarray:
    return _window(mask, n, axis, False) > 0


def opened(mask: np.ndarray, n: int, axis: int) -> np.ndarray:
    return dilate(erode(mask, n, axis), n, axis)


def closed(mask: np.ndarray, n: int, axis: int) -> np.ndarray:
    return erode(dilate(mask, n, axis), n, axis)


def components(mask: np.ndarray) -> np.ndarray:
    """(x, y, w, h) of each set of pixels that touch each other, corners included, in order of their first pixel."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    n = len(row)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j, stop_i, stop_j = first[y - 1], first[y], first[y], first[y + 1]
        while i < stop_i and j < stop_j:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    if not n:
        return np.empty((0, 4), dtype=np.int64)
    root, of = np.unique([find(i) for i in range(n)], return_inverse=True)
    out = np.empty((len(root), 4), dtype=np.int64)
    for c, (values, pick) in enumerate(((start, np.minimum), (row, np.minimum), (end, np.maximum), (row + 1, np.maximum))):
        at = np.full(len(root), values.max() if pick is np.minimum else 0)
        pick.at(at, of, values)
        out[:, c] = at
    out[:, 2:] -= out[:, :2]
    return out


def grid_mask(gray: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(mask of ruled lines, horizontal lines wider than 0.35 of the width, vertical ones higher than 0.30 of the height)."""
    h, w = gray.shape
    ink = dark(gray, 25, 10)
    flat = closed(opened(ink, max(20, w // 40), 1), max(1, w // 12), 1)
    steep = closed(opened(ink, max(15, h // 55), 0), max(1, h // 12), 0)
    return flat | steep, int((components(flat)[:, 2] > 0.35 * w).sum()), int((components(steep)[:, 3] > 0.30 * h).sum())


def regions(mask: np.ndarray, close: int = 25, grow: int = 15) -> np.ndarray:
    """(x, y, w, h) of what ruled lines hang together in, before any is left out for its size."""
    m = closed(closed(mask, close, 1), close, 0)
    return components(dilate(dilate(m, grow, 1), grow, 0))


def vertical_rules(gray: np.ndarray, gap: int = 12) -> int:
    """How many vertical rules a region has; columns of pixels at most `gap` apart are one."""
    h = gray.shape[0]
    if not gray.size:
        return 0
    mask = opened(closed(dark(gray, 41, 15), 25, 0), max(10, int(0.4 * h)), 0)
    at = np.flatnonzero(mask.sum(axis=0) >= 0.3 * h)
    return int(len(at) and 1 + (np.diff(at) > gap).sum())


def line_places(profile: np.ndarray, least: float, gap: int = 6) -> list[int]:
    """The middles of the runs of a profile that reach `least`; runs at most `gap` apart are one line."""
    at = np.flatnonzero(profile >= least)
    parts = np.split(at, np.flatnonzero(np.diff(at) > gap) + 1) if len(at) else []
    return [int(p.mean()) for p in parts]


def level(gray: np.ndarray) -> float:
    """The angle, of 41, that makes the lines' profile sharpest; the first of equals."""
    ink = dark(gray, 31, 15).astype(np.float64)
    h, w = (ink.shape[0] // 3) * 3, (ink.shape[1] // 3) * 3
    if not h or not w:
        return 0.0
    small = ink[:h, :w].reshape(h // 3, 3, w // 3, 3).mean(axis=(1, 3))
    y, x = np.nonzero(small)
    weight, cx, cy = small[y, x], small.shape[1] / 2, small.shape[0] / 2
    best, most = 0.0, -1.0
    for a in ANGLES:
        t = np.deg2rad(a)
        to = np.rint(-np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy).astype(np.int64)
        ok = (to >= 0) & (to < small.shape[0])
        profile = np.bincount(to[ok], weights=weight[ok], minlength=small.shape[0])
        score = float((np.diff(profile) ** 2).sum())
        if score > most:
            best, most = float(a), score
    return best


def rotate(gray: np.ndarray, angle: float) -> np.ndarray:
    """Turned about the middle, between pixels by their distance; beyond the edge its pixels repeat."""
    if not angle:
        return gray
    h, w = gray.shape
    t = np.deg2rad(angle)
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    x, y = x - w / 2, y - h / 2
    sx = np.clip(np.cos(t) * x - np.sin(t) * y + w / 2, 0, w - 1)
    sy = np.clip(np.sin(t) * x + np.cos(t) * y + h / 2, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(np.int64), max(w - 2, 0)), np.minimum(sy.astype(np.int64), max(h - 2, 0))
    x1, y1, fx, fy = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1), sx - x0, sy - y0
    g = gray.astype(np.float64)
    top, low = g[y0, x0] * (1 - fx) + g[y0, x1] * fx, g[y1, x0] * (1 - fx) + g[y1, x1] * fx
    return np.clip(top * (1 - fy) + low * fy + 0.5, 0, 255).astype(np.uint8)


def equalise(gray: np.ndarray, clip: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Local contrast: each tile's histogram, cut at `clip` times its mean, is made even; between tiles' middles their curves blend."""
    h, w = gray.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    padded = np.pad(gray, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if h > th * tiles - h and w > tw * tiles - w else "edge")
    each = padded.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1).astype(np.int64)
    counts = np.bincount((each + 256 * np.arange(tiles * tiles)[:, None]).ravel(), minlength=256 * tiles * tiles).reshape(-1, 256)
    limit = max(1, int(clip * th * tw / 256))
    over = np.maximum(counts - limit, 0).sum(axis=1)
    counts = np.minimum(counts, limit) + (over // 256)[:, None] + (np.arange(256) < (over % 256)[:, None])
    curve = np.clip(np.rint(counts.cumsum(axis=1) * (255.0 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)
    y, x = np.clip((np.arange(h) + 0.5) / th - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) / tw - 0.5, 0, tiles - 1)
    y0, x0 = np.minimum(y.astype(int), tiles - 2), np.minimum(x.astype(int), tiles - 2)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    pick = lambda i, j: curve[(y0 + i)[:, None], (x0 + j)[None], gray]
    out = (pick(0, 0) * (1 - fx) + pick(0, 1) * fx) * (1 - fy) + (pick(1, 0) * (1 - fx) + pick(1, 1) * fx) * fy
    return np.rint(out).astype(np.uint8)


def enhance(gray: np.ndarray) -> np.ndarray:
    """Local contrast, then sharper: 1.6 of the image less 0.6 of it blurred by 3 pixels."""
    g = equalise(gray).astype(np.float64)
    curve = np.exp(-(np.arange(-9, 10) ** 2) / 18.0)
    curve /= curve.sum()
    blur = g
    for axis in (0, 1):
        pads = [(0, 0), (0, 0)]
        pads[axis] = (9, 9)
        padded = np.pad(blur, pads, mode="reflect" if min(g.shape) > 9 else "edge")
        blur = sum(c * np.take(padded, np.arange(i, i + g.shape[axis]), axis=axis) for i, c in enumerate(curve))
    return np.clip(np.rint(1.6 * g - 0.6 * blur), 0, 255).astype(np.uint8)


def png(gray: np.ndarray) -> bytes:
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.pad(gray.astype(np.uint8), ((0, 0), (1, 0))).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", gray.shape[1], gray.shape[0], 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows, 6)) + part(b"IEND", b"")


def shrunk(gray: np.ndarray, share: float) -> np.ndarray:
    """To a share of its sides, by the means of the pixels that fall together."""
    h, w = max(1, int(gray.shape[0] * share)), max(1, int(gray.shape[1] * share))
    by, bx = np.linspace(0, gray.shape[0], h + 1).astype(int), np.linspace(0, gray.shape[1], w + 1).astype(int)
    total = np.pad(gray.astype(np.int64).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    s = total[by[1:, None], bx[None, 1:]] - total[by[:-1, None], bx[None, 1:]] - total[by[1:, None], bx[None, :-1]] + total[by[:-1, None], bx[None, :-1]]
    return ((s + 0.5 * (n := np.diff(by)[:, None] * np.diff(bx)[None])) // n).astype(np.uint8)


def encoded(gray: np.ndarray) -> bytes:
    """A PNG within the limits on pixels and bytes of the text engine, shrunk as far as that takes."""
    share = min(1.0, (MOST_PIXELS / gray.size) ** 0.5)
    while True:
        out = png(shrunk(gray, share) if share < 1 else gray)
        if len(out) <= MOST_BYTES:
            return out
        share *= 0.85


def base64_png(gray: np.ndarray) -> str:
    """A PNG for the layout engine, its long edge within the limit."""
    share = LONG_EDGE / max(gray.shape)
    return base64.b64encode(png(shrunk(gray, share) if share < 1 else gray)).decode()


def analysed(gray: np.ndarray) -> list[dict]:
    """What is on each half of a page: angle, lines, regions with their vertical rules, and the half itself, level and enhanced."""
    out = []
    for side, half in split_spread(gray):
        angle = level(half)
        clear = enhance(rotate(half, angle))
        mask, h_lines, v_lines = grid_mask(clear)
        boxes = [{"x": int(x), "y": int(y), "w": int(w), "h": int(h), "v_rules": vertical_rules(clear[y : y + h, x : x + w])} for x, y, w, h in regions(mask)]
        out.append({"side": side, "width": clear.shape[1], "height": clear.shape[0], "deskew": angle, "h_lines": h_lines, "v_lines": v_lines, "threshold": kernels.otsu(clear), "image": clear.tobytes(), "boxes": boxes})
    return out


def halves(images: DataFrame) -> DataFrame:
    """`HALVES` of pages (path, page, image, height, width) of gray or three-coloured pixels, one row for each half."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                pixels = np.frombuffer(r.image, dtype=np.uint8)
                shape = (r.height, r.width) if len(pixels) == r.height * r.width else (r.height, r.width, 3)
                yield pd.DataFrame([{"path": r.path, "page": r.page, **x} for x in analysed(to_gray(pixels.reshape(shape)))])

    return images.select("path", "page", "image", "height", "width").mapInPandas(run, HALVES)


def ink(halves_: DataFrame, places: DataFrame, ratio: float = 0.02, pad: int = 4) -> DataFrame:
    """(table_id, r, c) of places (path, page, side, table_id, r, c, box) with ink: a share of `ratio` of the padded box's pixels is dark.

    places are joined to their half; the box must be 6 pixels wide and high.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for r in pdf.itertuples(index=False):
                page = np.frombuffer(r.image, dtype=np.uint8).reshape(r.height, r.width)
                for table_id, i, j, b in ((p["table_id"], p["r"], p["c"], p["box"]) for p in r.places):
                    part = page[max(b["y0"] - pad, 0) : b["y1"] + pad, max(b["x0"] - pad, 0) : b["x1"] + pad]
                    if min(part.shape) >= 6 and (part < r.threshold - 10).mean() >= ratio:
                        found.append((table_id, i, j))
            yield pd.DataFrame(found, columns=["table_id", "r", "c"])

    by_half = places.groupBy("path", "page", "side").agg(F.collect_list(F.struct("table_id", "r", "c", "box")).alias("places"))  # a page has some hundred places
    joined = halves_.select("path", "page", "side", "image", "height", "width", "threshold").join(by_half, ["path", "page", "side"])
    return joined.mapInPandas(run, "table_id string, r int, c int")
