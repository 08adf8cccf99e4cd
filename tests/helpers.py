"""Small rasters in and out of line tables, and plain statements of the rules to check against."""

from __future__ import annotations

import math

import numpy as np

SCHEMA = "image_id long, ch int, y int, h int, w int, vals array<double>"


def lines(spark, images, parts=None):
    """Line table from {image_id: 2-D array} or {(image_id, ch): 2-D array}."""
    rows = []
    for key, image in images.items():
        image_id, ch = key if isinstance(key, tuple) else (key, 0)
        image = np.asarray(image, float)
        for y, row in enumerate(image):
            rows.append((image_id, ch, y, image.shape[0], image.shape[1], [float(v) for v in row]))
    df = spark.createDataFrame(rows, SCHEMA)
    return df.repartition(parts) if parts else df


def images(df, col="vals"):
    """The inverse of :func:`lines`, keyed by (image_id, ch)."""
    out = {}
    for r in df.select("image_id", "ch", "y", col).collect():
        out.setdefault((r["image_id"], r["ch"]), {})[r["y"]] = r[col]
    return {k: np.array([v[y] for y in sorted(v)], dtype=float) for k, v in out.items()}


def kept_pixels(shift):
    """Visible pixels of one line, by looking at every later column."""
    n = len(shift)
    bins = [{math.floor(s), math.ceil(s)} for s in shift]
    out = []
    for x, s in enumerate(shift):
        free = any(all(b not in bins[k] for k in range(x + 2, n)) for b in (math.floor(s), math.ceil(s)))
        out.append(bool(s > 0 and free))
    return out


def splat(values, disp, strict=False):
    """Warped line and hole mask: for every target, the best source of each plane."""
    n = len(values)
    shift = [x - d for x, d in enumerate(disp)]
    keep = kept_pixels(shift)
    clamp = lambda v: min(max(v, 0), n - 1)
    planes = ({}, {})
    for x in range(n):
        if strict and not keep[x]:
            continue
        p = shift[x] if keep[x] else float(-n)
        up, down = clamp(math.ceil(p)), clamp(math.floor(p))
        for plane, target, weight in ((0, up, up - p), (1, down, 1 - (up - p))):
            best = planes[plane].get(target)
            if weight < 10000 and (best is None or (weight, -x) < best):
                planes[plane][target] = (weight, -x)
    out, holes = [], []
    for t in range(n):
        u, d = planes[0].get(t), planes[1].get(t)
        wu, wd = (u or (10000.0,))[0], (d or (10000.0,))[0]
        cu = values[-u[1]] if u else 0.0
        cd = values[-d[1]] if d else 0.0
        holes.append(u is None and d is None)
        out.append(0.0 if holes[-1] else (cu * wd + cd * wu) / (wu + wd + 1e-7))
    return out, holes, keep


def nearest(values, hole):
    """Every hole takes the nearest known value; ties go to the smaller (y, x)."""
    known = [(y, x) for y, x in zip(*np.where(~hole))]
    out = values.copy()
    for y, x in zip(*np.where(hole)):
        if known:
            ky, kx = min(known, key=lambda k: ((k[0] - y) ** 2 + (k[1] - x) ** 2, k[0], k[1]))
            out[y, x] = values[ky, kx]
        else:
            out[y, x] = np.nan
    return out
