"""Steps on tiles of cells against plain loops over the cells, with tiles so small that holes and seams cross their borders."""

import random
import statistics

import pytest

from cairn.operators import floors as O
from cairn.operators import tiles
from cairn.operators.field import Grid

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))
HIGH, WIDE = 19, 23


@pytest.fixture(scope="module")
def cells():
    r = random.Random(5)
    states = ["walkable"] * 12 + ["filled", "void", "void", "low_confidence", "obstacle", "height_variance"]
    out = {(i, j): (r.choice(states), r.choice([None, 1.0, 1.1, 1.2, 1.6])) for i in range(HIGH) for j in range(WIDE) if r.random() < 0.9}
    return out | {(8, j): ("void", None) for j in range(3, 17)} | {(i, j): ("walkable", 1.0) for i in (7, 9) for j in range(3, 17)}


def closed(cells, most, gap, tolerance):
    mask = {at: h for at, (state, h) in cells.items() if state in ("walkable", "filled")}
    every = {(i, j) for i in range(HIGH) for j in range(WIDE)}
    hole = {at for at in every - mask.keys() if cells.get(at, ("void", None))[0] in ("void", "low_confidence")}
    out, left = {at: ("mask", h) for at, h in mask.items()}, set(hole)
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            at = todo.pop()
            part.add(at)
            near = [(at[0] + i, at[1] + j) for i, j in SIDES]
            todo += [n for n in near if n in left]
            left -= set(near)
        if len(part) <= most and all((i + a, j + b) in mask or (i + a, j + b) in part for i, j in part for a, b in SIDES):
            out |= {at: ("bridged", cells.get(at, (None, None))[1]) for at in part if 0 < at[0] < HIGH - 1 and 0 < at[1] < WIDE - 1}
    floor = {at: h for at, (_, h) in out.items()}
    for i, j in every - floor.keys():
        near = [next(((i + n * a, j + n * b) for n in range(1, gap + 1) if (i + n * a, j + n * b) in floor), None) for a, b in SIDES]
        known = [floor[n] for n in near if n and floor[n] is not None]
        state, own = cells.get((i, j), ("void", None))
        if len(known) >= 2 and max(known) - min(known) <= tolerance and state not in ("obstacle", "height_variance"):
            out[i, j] = "closed", own if own is not None else (min(known) + max(known)) / 2
    return out


def test_a_mask_closes_across_tiles_without_joins_of_its_cells(spark, cells, monkeypatch):
    monkeypatch.setattr(tiles, "EDGE", 5)
    frame = spark.createDataFrame([(*at, *rest) for at, rest in cells.items()], "row long, col long, state string, height double")
    found = O.closed_mask(frame, Grid(0.0, 0.0, WIDE, HIGH, 0.0, 2, 0.0), O.FloorSettings(gap=0.4), 0.2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    expected = closed(cells, 12, 2, 0.35)
    assert {(r["row"], r["col"]): (r["source"], r["height"]) for r in found.collect()} == expected
    assert {s for s, _ in expected.values()} == {"mask", "bridged", "closed"}
    # Heights of the floor around, in one exchange as well.
    floor = spark.createDataFrame([(*at, h) for at, (_, h) in expected.items()], "row long, col long, height double")
    level = O.levelled(floor, 3)
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1
    around = {(i, j): [h for (a, b), (_, h) in expected.items() if abs(a - i) <= 3 and abs(b - j) <= 3 and h is not None] for i, j in expected}
    assert {(r["row"], r["col"]): r["level"] for r in level.collect()} == {at: statistics.median_high(hs) if hs else None for at, hs in around.items()}
