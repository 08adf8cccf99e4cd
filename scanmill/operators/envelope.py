"""Nearest scattered point of every pixel, by lower envelopes over bands.

Seen from one line, a point's squared distance is a parabola over the columns, and the nearest points are the lower envelope of all parabolas.
A point above a line that is not on that line's envelope is on none below it either: the cell in which it is nearest is convex and
would have to cross the line. So a downward sweep carries only the points of the last envelope, an upward sweep does the same from below, and
the nearer of both answers is the nearest of all.

Bands of lines work at once. Each reduces its own points to those on the envelopes of its two borders; one small group per image folds
these from band to band; then each band sweeps its lines with its own points and what has come down or up to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmill.session import pin, ship_package

BAND = 64
_EPS = 1e-9
# a point is six numbers in a row: place after the move (x, y), place before it (y, x), and its flow (dx, dy)
_WIDTH = 6
_ROWS = "image_id long, band int, kind string, h int, w int, pts array<double>"
_SCHEMA = pa.schema([
    ("image_id", pa.int64()), ("band", pa.int32()), ("kind", pa.string()), ("h", pa.int32()), ("w", pa.int32()),
    ("pts", pa.list_(pa.float64()))])
_NONE = np.empty((0, _WIDTH))


def envelope(points: np.ndarray, y: float, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``points`` on the lower envelope seen from line ``y`` over the columns 0..w, and where each piece starts.

    Pieces of no length stay: there several points are equally near.
    """
    far = np.abs(points[:, 1] - y)
    order = np.lexsort((points[:, 3], points[:, 2], far, points[:, 0]))
    xs = points[order, 0]
    # of points in one column only the nearest counts
    order = order[np.concatenate([[True], xs[1:] != xs[:-1]])] if len(order) else order
    px, ey = points[order, 0].tolist(), (points[order, 1] - y).tolist()
    kept: list[int] = []
    starts: list[float] = []
    for q in range(len(px)):
        qx, qe = px[q], ey[q]
        start = -np.inf
        while kept:
            p = kept[-1]
            start = (px[p] + qx) / 2 + (qe - ey[p]) * (qe + ey[p]) / (2 * (qx - px[p]))
            if start >= starts[-1] - _EPS:
                start = max(start, starts[-1])
                break
            kept.pop()
            starts.pop()
            start = -np.inf
        kept.append(q)
        starts.append(start)
    begin = np.array(starts)
    end = np.append(begin[1:], np.inf)
    inside = (begin <= w + _EPS) & (end >= -_EPS) if len(begin) else np.empty(0, bool)
    return points[order[np.array(kept, dtype=np.int64)[inside]]] if len(begin) else points[:0], begin[inside] if len(begin) else begin


def answers(points: np.ndarray, starts: np.ndarray, y: int, w: int) -> np.ndarray:
    """For each column (d2, row of ``points``): the nearest, of equally near ones that from the smaller source."""
    xs = np.arange(w, dtype=np.float64)
    first = np.maximum(np.searchsorted(starts, xs - _EPS, side="right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, xs + _EPS, side="right") - 1, 0)
    best = first.copy()
    ey = points[:, 1] - y
    d2 = (points[best, 0] - xs) ** 2 + ey[best] ** 2
    for step in range(1, int((last - first).max(initial=0)) + 1):
        other = np.minimum(first + step, last)
        o2 = (points[other, 0] - xs) ** 2 + ey[other] ** 2
        better = _nearer(o2, points[other], d2, points[best])
        best, d2 = np.where(better, other, best), np.where(better, o2, d2)
    return np.stack([d2, best.astype(np.float64)])


def _nearer(d2: np.ndarray, points: np.ndarray, than: np.ndarray, those: np.ndarray) -> np.ndarray:
    sy, sx, ty, tx = points[:, 2], points[:, 3], those[:, 2], those[:, 3]
    return (d2 < than) | ((d2 == than) & ((sy < ty) | ((sy == ty) & (sx < tx))))


def _sweep(carried: np.ndarray, own: np.ndarray, lines: list[int], w: int, down: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(line, d2, points) of each line that has any point on this side."""
    own = own[np.argsort(own[:, 1] if down else -own[:, 1], kind="stable")]
    key = own[:, 1] if down else -own[:, 1]
    alive, used = carried, 0
    for y in sorted(lines, reverse=not down):
        upto = int(np.searchsorted(key, y if down else -y, side="right"))
        alive, starts = envelope(np.concatenate([alive, own[used:upto]]), y, w)
        used = upto
        if len(alive):
            d2, at = answers(alive, starts, y, w)
            yield y, d2, alive[at.astype(np.int64)]


def _points(table: pa.Table, kind: str) -> np.ndarray:
    rows = table.filter(pc.equal(table.column("kind"), kind)).column("pts").combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, _WIDTH)


def _row(image: int, band: int, kind: str, h: int, w: int, pts: np.ndarray) -> dict:
    return {"image_id": image, "band": band, "kind": kind, "h": h, "w": w, "pts": pts.reshape(-1)}


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moved points of each line by the band they fall in, and the line itself for the band it is in."""
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            image, y, h, w = (batch.column(c)[r].as_py() for c in ("image_id", "y", "h", "w"))
            dx, dy = (batch.column(c)[r].values.to_numpy(zero_copy_only=False).astype(np.float64) for c in ("dx", "dy"))
            x = np.arange(len(dx), dtype=np.float64)
            pts = np.stack([x + dx, y + dy, np.full(len(x), float(y)), x, dx, dy], axis=1)
            pts = pts[(pts[:, 0] > 0) & (pts[:, 0] < w) & (pts[:, 1] > 0) & (pts[:, 1] < h)]  # a null moves nowhere
            rows.append(_row(image, y // BAND, "line", h, w, np.array([float(y)])))
            bands = (pts[:, 1] // BAND).astype(np.int64)
            rows += [_row(image, int(b), "own", h, w, pts[bands == b]) for b in np.unique(bands)]
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _borders(table: pa.Table) -> pa.Table:
    """What a band's points can be nearest for below and above it."""
    image, band, h, w = (table.column(c)[0].as_py() for c in ("image_id", "band", "h", "w"))
    pts = _points(table, "own")
    below, _ = envelope(pts, (band + 1) * BAND, w)
    above, _ = envelope(pts, band * BAND - 1, w)
    return pa.Table.from_pylist([_row(image, band, "down", h, w, below), _row(image, band, "up", h, w, above)], schema=_SCHEMA)


def _carry(table: pa.Table) -> pa.Table:
    """Fold the bands' border points from band to band: what arrives at each one from above and from below."""
    image, h, w = (table.column(c)[0].as_py() for c in ("image_id", "h", "w"))
    last = (h - 1) // BAND
    found: dict[tuple[str, int], np.ndarray] = {}
    for kind, band, pts in zip(table.column("kind").to_pylist(), table.column("band").to_pylist(), table.column("pts")):
        found[kind, band] = pts.values.to_numpy(zero_copy_only=False).reshape(-1, _WIDTH)
    out = []
    for kind, bands, border in (("down", range(last + 1), lambda b: (b + 1) * BAND), ("up", range(last, -1, -1), lambda b: b * BAND - 1)):
        alive = _NONE
        for band in bands:
            if len(alive):
                out.append(_row(image, band, kind, h, w, alive))
            alive, _ = envelope(np.concatenate([alive, found.get((kind, band), _NONE)]), border(band), w)
    return pa.Table.from_pylist(out, schema=_SCHEMA)


def _filler(fill_value: float):
    out = pa.schema([("image_id", pa.int64()), ("y", pa.int32()), ("h", pa.int32()), ("w", pa.int32()),
                     ("dx", pa.list_(pa.float64())), ("dy", pa.list_(pa.float64()))])

    def fill(table: pa.Table) -> pa.Table:
        image, h, w = (table.column(c)[0].as_py() for c in ("image_id", "h", "w"))
        lines = table.filter(pc.equal(table.column("kind"), "line")).column("pts").combine_chunks().flatten()
        lines = [int(y) for y in lines.to_pylist()]
        own = _points(table, "own")
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for kind, down in (("down", True), ("up", False)):
            for y, d2, pts in _sweep(_points(table, kind), own, lines, w, down):
                if y in best:
                    nearer = _nearer(best[y][0], best[y][1], d2, pts)
                    d2, pts = np.where(nearer, best[y][0], d2), np.where(nearer[:, None], best[y][1], pts)
                best[y] = d2, pts
        rows = []
        for y in sorted(lines):
            pts = best[y][1] if y in best else np.full((w, _WIDTH), fill_value)
            rows.append({"image_id": image, "y": y, "h": h, "w": w, "dx": pts[:, 4], "dy": pts[:, 5]})
        return pa.Table.from_pylist(rows, schema=out)

    return fill


def forward_interpolate(flow: DataFrame, fill_value: float = 0.0) -> DataFrame:
    """Carry a flow field forward: each pixel takes the flow of the nearest moved pixel.

    ``flow(image_id, y, h, w, dx, dy)`` has one array per component. A pixel moves by its flow and counts if it stays strictly inside the
    image; ties go to the smaller source (y, x). Images where nothing stays inside get ``fill_value``. A task holds the points that
    fall into one band of an image and the envelopes at its borders.
    """
    ship_package(flow.sparkSession)
    slim = flow.select(
        F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("h").cast("int").alias("h"),
        F.col("w").cast("int").alias("w"), F.col("dx").cast("array<double>").alias("dx"), F.col("dy").cast("array<double>").alias("dy"))
    rows = pin(slim.mapInArrow(_move, _ROWS))
    borders = rows.where("kind = 'own'").groupBy("image_id", "band").applyInArrow(_borders, _ROWS)
    carried = borders.groupBy("image_id").applyInArrow(_carry, _ROWS)
    filled = rows.unionByName(carried).groupBy("image_id", "band").applyInArrow(
        _filler(fill_value), "image_id long, y int, h int, w int, dx array<double>, dy array<double>")
    return filled
