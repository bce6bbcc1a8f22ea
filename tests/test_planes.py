"""Scores of planes against a count of all points, and what the scoring of a block may hold."""

import tracemalloc

import numpy as np
import pytest

from cairn.operators import planes as N

AT = np.random.default_rng(2).uniform(-1.0, 1.0, (3, 20_000))
PLANES = {k: N.Plane((0.0, 1.0, 0.0), -0.001 * k) for k in range(600)}


def plain(k):
    x, y, z = AT
    near = np.abs(y + PLANES[k].d) < 0.05
    return near.sum(), (near & (y <= 0.25)).sum(), np.abs(y[near & (y <= 0.25)] + 0.2).sum()


def test_scores_equal_a_count_of_all_points(spark):
    frame = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in AT.T], "x double, y double, z double")
    found = {r["draw"]: (r["inliers"], r["low_inliers"], r["low_error"]) for r in N.scored(frame, PLANES, 0.05, -0.2, 0.45).collect()}
    assert found == {k: pytest.approx(plain(k)) for k in PLANES}


def test_a_block_holds_no_matrix_of_points_and_planes():
    normals, offsets = np.array([p.normal for p in PLANES.values()]), np.array([p.d for p in PLANES.values()])
    count, lower, error = np.zeros(600, np.int64), np.zeros(600, np.int64), np.zeros(600)
    tracemalloc.start()
    N._score(AT[:, : N.ROWS], normals, offsets, 0.05, -0.2, True, count, lower, error)
    assert tracemalloc.get_traced_memory()[1] < 100 * N.ROWS  # 4800 bytes for each point if all planes met it at once
    tracemalloc.stop()
