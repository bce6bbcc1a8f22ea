"""Planes through clouds by seeded random sampling: a fixed number of hypotheses from three points each, all scored in one pass.

The points of the hypotheses are those with the least hashes of their numbers, so that a run draws the same again. A task
scores its rows against all hypotheses in arrays and hands on a row for each; these are summed before the best is picked."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.geometry import Matrix

#: Hypotheses of the field's floor and of a mesh of one plane.
FLOOR_DRAWS, MESH_DRAWS = 1200, 2000
#: Rows that are scored at a time against each hypothesis.
ROWS = 8192


@dataclass(frozen=True)
class Plane:
    """All points p with normal * p + d = 0; the normal has length 1."""

    normal: tuple[float, float, float]
    d: float

    def distance(self) -> Column:
        return F.abs(sum((F.lit(n) * F.col(c) for n, c in zip(self.normal, "xyz", strict=True)), F.lit(0.0)) + self.d)


def through(p: tuple, q: tuple, r: tuple) -> Plane | None:
    """The plane through three points, None if they nearly lie on a line."""
    u, v = np.subtract(q, p), np.subtract(r, p)
    cross = [u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in range(3)]
    size = math.sqrt(sum(c * c for c in cross))
    if size < 1e-6:
        return None
    normal = tuple(float(c / size) for c in cross)
    return Plane(normal, -float(sum(n * a for n, a in zip(normal, p, strict=True))))


def drawn(points: DataFrame, draws: int, upright: float | None = None) -> dict[int, Plane]:
    """By number, the planes of `draws` triples; points (splat_id, x, y, z). upright: normals point up, and those with less upwards go.

    The pool has three points a draw at most, those of the least hashes; a smaller cloud's are used again in other triples."""
    order = F.pmod(F.pmod("splat_id", F.lit(1 << 31)) * 2654435761, F.lit(1 << 32))
    pool = [tuple(r) for r in points.orderBy(order, "splat_id").select("x", "y", "z").limit(3 * draws).collect()]
    out, m = {}, len(pool)
    if m < 3:
        return out
    for k in range(draws):
        again = 3 * k // m
        at = 3 * k % m, (3 * k + 1 + 7 * again) % m, (3 * k + 2 + 11 * again) % m
        if len(set(at)) < 3 or (plane := through(*(pool[i] for i in at))) is None:
            continue
        if upright is not None:
            if plane.normal[1] < 0:
                plane = Plane(tuple(-n for n in plane.normal), -plane.d)
            if plane.normal[1] < upright:
                continue
        out[k] = plane
    return out


def _score(at: np.ndarray, normals: np.ndarray, offsets: np.ndarray, threshold: float, floor: float, low: bool, count: np.ndarray, lower: np.ndarray, error: np.ndarray) -> None:
    """Adds what points at the columns of `at`, all low ones or all others, are to each plane. A plane goes over a block of points at a time, in
    arrays that are made once a block and stay in a core's cache."""
    (x, y, z), far = at, np.abs(at[1] - floor)
    apart, term, near = np.empty(len(x)), np.empty(len(x)), np.empty(len(x), bool)
    for k, (n, d) in enumerate(zip(normals.tolist(), offsets.tolist(), strict=True)):
        np.multiply(x, n[0], out=apart)
        apart += np.multiply(y, n[1], out=term)
        apart += np.multiply(z, n[2], out=term)
        apart += d
        np.less(np.abs(apart, out=apart), threshold, out=near)
        if many := np.count_nonzero(near):
            count[k] += many
            if low:
                lower[k] += many
                error[k] += far[near].sum()


def scored(points: DataFrame, planes: dict[int, Plane], threshold: float, floor: float = 0.0, band: float = math.inf) -> DataFrame:
    """draw, inliers, low_inliers and low_error: how many of them lie up to `band` above `floor`, and the sum of their distances in height from it."""
    draws = np.array(sorted(planes), np.int64)
    normals = np.array([planes[k].normal for k in draws.tolist()], float).reshape(-1, 3)
    offsets = np.array([planes[k].d for k in draws.tolist()], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, lower, error = np.zeros(len(draws), np.int64), np.zeros(len(draws), np.int64), np.zeros(len(draws))
        for batch in batches:
            at = np.stack([batch[c].to_numpy() for c in ("x", "y", "z")])
            low = at[1] <= floor + band
            for part, is_low in ((at[:, low], True), (at[:, ~low], False)):
                for i in range(0, part.shape[1], ROWS):
                    _score(part[:, i : i + ROWS], normals, offsets, threshold, floor, is_low, count, lower, error)
        yield pa.RecordBatch.from_pydict({"draw": draws, "inliers": count, "low_inliers": lower, "low_error": error})

    rows = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz")).mapInArrow(run, "draw bigint, inliers bigint, low_inliers bigint, low_error double")
    return rows.groupBy("draw").agg(*(F.sum(c).alias(c) for c in ("inliers", "low_inliers", "low_error")))


def best_plane(points: DataFrame, threshold: float = 0.2, draws: int = MESH_DRAWS) -> tuple[Plane | None, int]:
    """The plane with most points nearer than the threshold, the first of several, and their number; None for three points or fewer."""
    if len(points.limit(4).collect()) < 4:
        return None, 0
    planes = drawn(points, draws)
    top = scored(points, planes, threshold).filter("inliers > 0").orderBy(F.desc("inliers"), "draw").first() if planes else None
    return (None, 0) if top is None else (planes[top["draw"]], top["inliers"])


def floor_plane(points: DataFrame, floor: float, threshold: float, band: float = 0.45, upright: float = 0.82, draws: int = FLOOR_DRAWS) -> tuple[Plane | None, int]:
    """The most likely floor of planes that look up, drawn from the points up to `band` above the height `floor` (from all, if these are fewer
    than three): those near it count once, those of them in the band three times more, less the mean error of the latter in bands."""
    low = points.filter(F.col("y") <= floor + band)
    planes = drawn(low if len(low.limit(3).collect()) == 3 else points, draws, upright)
    if not planes:
        return None, 0
    score = F.col("inliers") + F.col("low_inliers") * 3.0 - F.col("low_error") / F.col("low_inliers") / max(band, 0.001)
    top = scored(points, planes, threshold, floor, band).filter("low_inliers > 0").withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "draw").first()
    return (None, 0) if top is None else (planes[top["draw"]], top["inliers"])


def refitted(points: DataFrame, plane: Plane, threshold: float) -> Plane:
    """The plane by least squares through the points near it, along the axis that its normal is closest to; itself if they lie on a line."""
    axis = max(range(3), key=lambda i: abs(plane.normal[i]))
    u, v, w = ("xyz"[(axis + i) % 3] for i in (1, 2, 0))
    near = points.filter(plane.distance() < threshold)
    pairs = ((u, u), (u, v), (v, v), (u, w), (v, w))
    got = near.agg(*(F.avg(c).alias(c) for c in "xyz"), *(F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs)).first()
    if got["x"] is None:
        return plane
    uu, uv, vv, uw, vw = (got[f"{a}_{b}"] for a, b in pairs)
    spread = uu * vv - uv * uv
    if spread <= 1e-12 * max(uu * vv, 1e-300):
        return plane
    slope = {u: (uw * vv - vw * uv) / spread, v: (vw * uu - uw * uv) / spread}
    size = math.copysign(math.sqrt(1.0 + slope[u] ** 2 + slope[v] ** 2), plane.normal[axis])
    normal = tuple({u: -slope[u], v: -slope[v], w: 1.0}[c] / size for c in "xyz")
    return Plane(normal, -sum(n * got[c] for n, c in zip(normal, "xyz", strict=True)))


def turned(plane: Plane, m: Matrix) -> Plane:
    """The plane in an output space: its normal turned, its offset as it is."""
    return Plane(tuple(sum(f * n for f, n in zip(row, plane.normal, strict=True)) for row in m), plane.d)


def quad(points: DataFrame, plane: Plane | None, threshold: float = 0.2) -> list[tuple[float, float, float]]:
    """The corners of the rectangle on the plane around the points near it, to be cut into the triangles 0, 1, 2 and 0, 2, 3; none without points."""
    if plane is None:
        return []
    n = np.array(plane.normal)
    along = np.array([1.0, 0.0, 0.0] if abs(n[0]) < 0.9 else [0.0, 1.0, 0.0])
    along = along - n * (n @ along)
    along /= math.sqrt(along @ along)
    across = np.cross(n, along)
    place = lambda axis: sum((F.lit(float(a)) * F.col(c) for a, c in zip(axis, "xyz", strict=True)), F.lit(0.0))
    u0, u1, v0, v1 = points.filter(plane.distance() < threshold).agg(*(f(place(axis)) for axis in (along, across) for f in (F.min, F.max))).first()
    return [] if u0 is None else [tuple(float(c) for c in u * along + v * across - plane.d * n) for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))]
