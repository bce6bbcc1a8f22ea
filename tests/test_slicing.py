"""Ends of chunks by extent without a step for each row, and levels and files of clouds without needless joins or arrays of a row."""

import sys

import numpy as np
import pyarrow as pa
import pytest

from cairn.operators import slicing as L
from cairn.sources import splats as A


def test_ends_by_extent_equal_a_plain_scan_and_take_few_steps():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 500):
        v = np.round(np.cumsum(rng.normal(0, 0.5, n)), 1)
        for extent in (0.1, 1.0, 2.5, 100.0):
            plain = [next((r for r in range(i + 1, n) if v[i : r + 1].max() - v[i : r + 1].min() > extent), 1 << 60) for i in range(n)]
            assert L._passed(v, extent).tolist() == plain
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    L._passed(np.cumsum(rng.normal(0, 0.5, 50_000)), 6.0)
    sys.setprofile(None)
    assert calls < 1000


def test_one_level_is_the_chunks_themselves_without_a_join(spark):
    chunks = spark.createDataFrame([(i, i // 4, i * 0.5) for i in range(11)], "place long, chunk long, x double")
    found = L.levels(chunks, 1)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.select("place", "chunk", "x", "level").collect()) == [(i, i // 4, i * 0.5, 0) for i in range(11)]
    assert dict(found.dtypes)["level"] == dict(L.levels(chunks, 2).dtypes)["level"]


def test_lists_become_rows_of_a_matrix_or_are_refused():
    lists = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    assert A._matrix(lists.slice(1)).tolist() == [[3.0, 4.0], [5.0, 6.0]]
    assert A._matrix(pa.array([[], []], pa.list_(pa.float64()))).shape == (2, 0)
    with pytest.raises(A.InvalidSplats):
        A._matrix(pa.array([[1.0], [2.0, 3.0, 4.0]]))
