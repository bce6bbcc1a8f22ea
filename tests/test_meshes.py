"""Meshes, islands, floors, planes and rays against small models of their own."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import bundles as B
from cairn.operators import cloud as C
from cairn.operators import floors as O
from cairn.operators import islands as I
from cairn.operators import meshes as M
from cairn.operators import planes as N
from cairn.operators import rays as R
from cairn.operators import voxels as V
from cairn.operators.field import Grid
from cairn.sources import sog
from cairn.sources.tables import running_total, staged

VOXELS = "vx long, vy long, vz long"
BOX = V.Box((-1.0, 0.5, 2.0), (12, 10, 11), 0.25)


def voxels(spark, cells):
    return spark.createDataFrame(sorted(cells), VOXELS)


def mesh_of(vertices, triangles):
    at = {r["vertex"]: np.array([r["x"], r["y"], r["z"]]) for r in vertices.collect()}
    return at, [(r["a"], r["b"], r["c"]) for r in triangles.orderBy("triangle").collect()]


@pytest.mark.parametrize("n", V.FACES)
def test_corners_of_faces_turn_to_the_left_seen_from_outside(n):
    c = np.array(V.corners(n), float)
    assert np.allclose(np.cross(c[1] - c[0], c[2] - c[0]), n) and np.allclose(np.cross(c[2] - c[0], c[3] - c[0]), n)
    assert np.allclose(c.mean(axis=0) - 0.5, np.array(n) / 2)


def test_the_surface_of_a_solid_is_closed_and_looks_outwards(spark):
    r = random.Random(3)
    cells = {(r.randrange(1, 11), r.randrange(1, 9), r.randrange(1, 10)) for _ in range(150)}
    vertices, triangles = M.welded(M.quads(V.exterior_faces(voxels(spark, cells))), BOX)
    at, faces = mesh_of(vertices, triangles)
    assert sorted(at) == list(range(len(at))) and len({tuple(p) for p in at.values()}) == len(at)
    edges = [(f[i], f[(i + 1) % 3]) for f in faces for i in range(3)]
    assert all(edges.count((b, a)) == edges.count((a, b)) for a, b in set(edges))  # each edge is passed both ways
    volume = sum(at[a] @ np.cross(at[b], at[c]) for a, b, c in faces) / 6
    assert volume == pytest.approx(len(cells) * 0.25**3)


def test_ramps_join_treads_within_a_step(spark):
    floor = voxels(spark, {(0, 0, 0), (1, 1, 0), (2, 5, 0), (0, 2, 1)})
    found = {(r["vx"], r["vy"], r["vz"], r["nx"], r["ny"], r["nz"]): [tuple(c) for c in r["corners"]] for r in M.ramp_quads(floor, BOX, 0.5).collect()}
    assert set(found) == {(0, 0, 0, 1, 1, 0), (0, 0, 0, 0, 2, 1)}
    assert found[0, 0, 0, 1, 1, 0] == [(1, 0, 1), (1, 1, 1), (2, 1, 1), (2, 0, 1)]  # corners are (y, z, x)
    assert M.ramp_quads(floor, BOX, 0.2).count() == 0


def test_floor_voxels_fall_back_to_open_tops(spark):
    solid, nav = {(0, 0, 0), (0, 1, 0), (3, 2, 2)}, {(3, 3, 2)}
    inner, bare = M.floor_voxels(voxels(spark, solid), voxels(spark, nav), BOX)
    assert {tuple(r) for r in inner.collect()} == {(3, 2, 2)} and not bare
    tops, bare = M.floor_voxels(voxels(spark, solid), voxels(spark, set()) if False else voxels(spark, nav).limit(0), BOX)
    assert {tuple(r) for r in tops.collect()} == {(0, 1, 0), (3, 2, 2)} and bare


@pytest.mark.parametrize(("width", "margin"), [(1, 10), (60, 6), (200, 4)])
def test_crop_margins(spark, width, margin):
    box = V.Box((0.0, 0.0, 0.0), (300, 300, 300), 1.0)
    low, high = M.cropped(voxels(spark, {(20, 20, 20), (20 + width - 1, 20, 20)}), box)
    assert low == (20 - margin,) * 3 and high == (20 + width + margin, 21 + margin, 21 + margin)
    assert M.cropped(voxels(spark, {(1, 1, 1)}).limit(0), box) is None


TRIANGLES = "triangle long, " + ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz")


def square(n, x, y, z, size=1.0):
    a, b, c, d = (x, y, z), (x, y, z + size), (x + size, y, z + size), (x + size, y, z)
    return [(n, *a, *b, *c), (n + 1, *a, *c, *d)]


def test_islands_and_what_is_kept(spark):
    rows = [*square(0, 0, 0, 0), *square(2, 1, 0, 0), *square(4, 5, 0.2, 0, 2.0), *square(6, 9, 0, 9, 0.2), *square(8, 30, 3, 0, 2.0)]
    found = I.islands(spark.createDataFrame([(t, *map(float, p)) for t, *p in rows], TRIANGLES))
    assert {r["triangle"]: r["island"] for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8}
    near = I.measured(found, I.IslandSettings(seed=(0.0, 0.0, 0.0)))
    kept = {r["island"]: r for r in near.collect()}
    assert [i for i, r in kept.items() if r["kept"]] == [0]
    assert kept[0]["area"] == pytest.approx(2.0) and kept[4]["centre_x"] == pytest.approx(6.0) and kept[8]["low"] == 3.0
    merged = I.measured(found, I.IslandSettings(seed=(0.0, 0.0, 0.0), merge=True, reach=10.0))
    assert sorted(r["island"] for r in merged.filter("kept").collect()) == [0, 4]  # 6 is too small, 8 too high and too far
    chosen = I.selection(merged).first()
    assert chosen["triangles"] == 6 and chosen["area"] == pytest.approx(6.0)
    assert I.verdict(I.selection(merged), I.IslandSettings(seed=(0.0, 0.0, 0.0), reach=0.1)).first()["rejected"] == "too_far"
    assert I.verdict(I.selection(merged), I.IslandSettings(seed=(0.0, 0.0, 0.0)), 2.0).first()["rejected"] == "below_floor"
    assert I.verdict(I.selection(near.withColumn("area", near["area"] / 10)), I.IslandSettings(seed=(0.0, 0.0, 0.0))).first()["rejected"] == "tiny"
    assert I.companion(found, (0.0, 0.0, 0.0)).first()["triangle"] == 9
    assert I.closest_centre(found, (5.9, 0.0, 1.0)).first()["triangle"] in (4, 5)
    nothing = found.limit(0)
    assert I.companion(nothing, (0.0, 0.0, 0.0)).count() == 0 and I.selection(I.measured(nothing, I.IslandSettings(seed=(0.0, 0.0, 0.0)))).count() == 0


CELLS = "row long, col long, state string, height double, confidence double, variance double, obstacle_score double"


def field(spark, rows):
    """Rows of a map: . walkable, o obstacle, ~ void with a row, x of low confidence, blank without a row; all of height 1."""
    states = {".": "walkable", "o": "obstacle", "~": "void", "x": "low_confidence"}
    cells = [(i, j, states[c], None if c == "~" else 1.0, 0.1, 0.01, 0.1) for i, line in enumerate(rows) for j, c in enumerate(line) if c != " "]
    return spark.createDataFrame(cells, CELLS), Grid(0.0, 0.0, max(map(len, rows)), len(rows), 0.0, 2, 0.0)


def test_gaps_close_only_where_floor_closes_them_in(spark):
    cells, g = field(spark, ["..........", ". ...x~...", "..........", ".~o....   ", "..........", "... .... .", "..........", " ........."])
    assert {(r["row"], r["col"]) for r in O.gaps(cells.filter(O.accepted()), cells, g).collect()} == {(1, 1), (1, 5), (1, 6), (5, 3), (5, 8)}
    big, g = field(spark, ["......", ".    .", ".    .", ".    .", ".    .", "......"])
    assert O.gaps(big.filter(O.accepted()), big, g).count() == 0
    assert O.gaps(big.filter(O.accepted()), big, g, most=16).count() == 16


def test_seams_need_two_sides_of_one_height(spark):
    rows = [(0, 0, "walkable", 1.0, 0.1, 0.0, 0.0), (0, 3, "walkable", 1.2, 0.1, 0.0, 0.0), (5, 0, "walkable", 1.0, 0.1, 0.0, 0.0), (5, 2, "walkable", 2.0, 0.1, 0.0, 0.0), (15, 1, "obstacle", 1.0, 0.1, 0.0, 0.9), (15, 0, "walkable", 1.0, 0.1, 0.0, 0.0), (15, 2, "walkable", 1.0, 0.1, 0.0, 0.0)]
    cells = spark.createDataFrame(rows, CELLS)
    found = O.seams(cells.filter(O.accepted()), cells, Grid(0.0, 0.0, 6, 20, 0.0, 2, 0.0), 2, 0.35).collect()
    assert {(r["row"], r["col"]): round(r["height"], 6) for r in found} == {(0, 1): 1.1, (0, 2): 1.1}


def test_a_floor_of_two_patches_on_one_level(spark):
    cells, g = field(spark, ["....." * 2 + "   " + "." * 8] * 6)
    raised = cells.withColumn("height", cells["height"] + (cells["col"] >= 13).cast("double") * 0.2)
    s = O.FloorSettings(seed=(1.0, 1.0, 1.0), flatten=0.05)
    floor = O.extracted(raised, g, 1.0, s)
    assert floor.cells.count() == 6 * 18 and floor.height == pytest.approx(1.0) and not floor.relaxed
    vertices, triangles = O.mesh(floor, g, s)
    at, faces = mesh_of(vertices, triangles)
    assert len(faces) == 2 * 6 * 18 and len(at) == 7 * 11 + 7 * 9
    assert all(np.cross(at[b] - at[a], at[c] - at[a])[1] > 0 for a, b, c in faces)
    high = cells.withColumn("height", cells["height"] + (cells["col"] >= 13).cast("double"))
    assert O.extracted(high, g, 1.0, s).cells.count() == 6 * 10
    with pytest.raises(O.NoFloor):
        O.extracted(cells.filter("col < 3"), g, None, s)
    doubt = cells.replace("walkable", "low_confidence", subset=["state"])
    assert O.extracted(doubt, g, None, s).relaxed


def test_trimming_drops_strays_unless_they_are_many(spark):
    floor = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6)] + [(0, 9, 1.0), (3, 6, 5.0)], "row long, col long, height double")
    assert O.trimmed(floor).count() == 36
    assert O.trimmed(floor.filter("row < 2")).count() == floor.filter("row < 2").count()
    assert O.trimmed(floor.filter("row < 2"), least=4).count() == 12


def test_modes_choose_one_part(spark):
    rows = [(0, j) for j in range(4)] + [(9, 5 + j) for j in range(4)] + [(5, 5), (5, 6)]
    floor = O.with_parts(spark.createDataFrame(rows, "row long, col long"))
    g = Grid(0.0, 0.0, 11, 10, 0.0, 2, 0.0)
    kept = lambda mode, seed=None: {(r["row"], r["col"]) for r in O.selected(floor, g, mode, seed).filter("kept").collect()}
    assert kept("largest") == set(rows[4:8]) and kept("nearest_centre") == {(5, 5), (5, 6)} and kept("seed", (0.5, 0.0)) == set(rows[:4])
    with pytest.raises(ValueError):
        O.selected(floor, g, "other")


def test_a_tilted_plane_is_found_and_refitted(spark):
    rng = np.random.default_rng(7)
    flat = [(i, x, 0.3 * x - 0.1 * z + 2 + e, z) for i, (x, z, e) in enumerate(zip(*rng.uniform(-5, 5, (2, 400)), rng.normal(0, 0.01, 400), strict=True))]
    noise = [(1000 + i, *p) for i, p in enumerate(rng.uniform(-5, 5, (200, 3)))]
    points = spark.createDataFrame([(int(i), *map(float, p)) for i, *p in flat + noise], "splat_id long, x double, y double, z double")
    plane, inliers = N.best_plane(points, 0.05, 500)
    assert inliers >= 380
    fitted = N.refitted(points, plane, 0.05)
    want = np.array([-0.3, 1.0, 0.1]) / math.sqrt(1.1)
    assert np.allclose(np.array(fitted.normal) * np.sign(fitted.normal[1]), want, atol=2e-3)
    floor, _ = N.floor_plane(points, 0.0, 0.05, band=3.0)
    assert floor.normal[1] > 0.82
    corners = N.quad(points, plane, 0.05)
    assert len(corners) == 4 and all(abs(np.dot(plane.normal, c) + plane.d) < 1e-9 for c in corners)
    assert N.best_plane(points.limit(3)) == (None, 0) and N.quad(points, None) == []
    line = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(9)], "splat_id long, x double, y double, z double")
    assert N.best_plane(line) == (None, 0)


def walked(ray, solid, box, reach):
    """A ray voxel by voxel."""
    _, *rest = ray
    o, d = np.array(rest[:3]), np.array(rest[3:])
    if np.sqrt(d @ d) < 1e-12:
        return None
    d = d / np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    at = [math.floor((a - b) / box.size) for a, b in zip(o, box.low, strict=True)]
    step = [int(np.sign(v)) for v in d]
    first = [(((c + 1 if s > 0 else c) * box.size) - (a - b)) / v if s else math.inf for a, b, c, s, v in zip(o, box.low, at, step, d, strict=True)]
    every = [abs(box.size / v) if s else math.inf for s, v in zip(step, d, strict=True)]
    many = [0, 0, 0]
    while True:
        when = [f + k * e if s else math.inf for f, k, e, s in zip(first, many, every, step, strict=True)]
        i = min((2, 1, 0), key=lambda i: when[i])
        if when[i] > reach:
            return None
        many[i] += 1
        at[i] += step[i]
        if any(not -1 <= c <= n for c, n in zip(at, box.dims, strict=True)):
            return None
        if tuple(at) in solid and when[i] > 1e-6:
            return round(when[i], 9), tuple(-step[k] if k == i else 0 for k in range(3))


def test_rays_equal_a_walk_from_voxel_to_voxel(spark):
    r = random.Random(11)
    cells = {(r.randrange(12), r.randrange(10), r.randrange(11)) for _ in range(120)}
    rays = []
    for i in range(600):
        place = [low + (r.randrange(-8, 8 * n + 8) / 8 * 0.25 if r.random() < 0.5 else r.uniform(-0.4, n * 0.25 + 0.4)) for low, n in zip(BOX.low, BOX.dims, strict=True)]
        way = [float(r.choice((-2, -1, 0, 0, 1, 1, 3))) if r.random() < 0.6 else r.uniform(-1, 1) for _ in range(3)]
        rays.append((i, *place, *way))
    found = R.first_hits(spark.createDataFrame(rays, "ray_id long, x double, y double, z double, dx double, dy double, dz double"), voxels(spark, cells), BOX, 3.0)
    got = {h["ray_id"]: (round(h["distance"], 9), (h["nx"], h["ny"], h["nz"])) for h in found.collect()}
    want = {ray[0]: hit for ray in rays if (hit := walked(ray, cells, BOX, 3.0))}
    assert got == want and len(want) > 100


def test_probes_take_the_mean_of_what_is_near(spark):
    box = V.Box((0.0, 0.0, 0.0), (8, 16, 8), 0.25)
    solid = voxels(spark, {(x, 3 if x < 4 else 5, z) for x in range(8) for z in range(8)})
    points = spark.createDataFrame([(1, 0.6, 0.75, 0.6), (2, 0.95, 0.75, 0.6), (3, 0.6, 9.0, 0.6), (4, 50.0, 0.75, 0.6)], "point_id long, x double, y double, z double")
    got = {r["point_id"]: r["ground"] for r in R.probed(points, solid, box, 0.1).collect()}
    assert got[1] == pytest.approx(0.75) and got[2] == pytest.approx(0.75 + 0.1) and got[3] is None and got[4] is None


def test_crowded_cells_give_the_same_distances(spark, monkeypatch):
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.normal(0, 0.01, (300, 3)), rng.normal(0.3, 0.0001, (150, 3)), rng.uniform(-5, 5, (60, 3)), np.tile([[1.0, 1.0, 1.0]], (30, 1))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "splat_id long, x double, y double, z double")
    plain = {r["splat_id"]: r["mean_distance"] for r in C.neighbour_distances(points, 8).collect()}
    monkeypatch.setattr(C, "CROWD", 40)
    crowds = {r["splat_id"]: r["mean_distance"] for r in C.neighbour_distances(points, 8).collect()}
    assert crowds.keys() == plain.keys() and all(crowds[i] == pytest.approx(plain[i], abs=1e-12) for i in plain)


def test_running_totals_over_many_ranges(spark):
    r = random.Random(4)
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else "cold", i, r.randrange(100)) for i in range(500)]
    found = running_total(spark.createDataFrame(rows, "k string, i long, v long").repartition(5), ["k"], ["i"], "v", "before").collect()
    assert {x["i"]: x["before"] for x in found} == {i: sum(w for q, j, w in rows if q == k and j < i) for k, i, _ in rows}


def splat_rows(n, rng, level=0, chunk=0, rest=9):
    listed = lambda a: [float(v) for v in a]
    return [(level, chunk, i, *listed(rng.normal(0, 4, 3)), listed(rng.normal(-3, 1, 3)), listed(rng.normal(0, 1, 4)), float(rng.normal(0, 2)), listed(rng.normal(0, 1, 3)), listed(rng.choice([-0.5, 0.0, 0.5], rest))) for i in range(n)]


SPLATS = "level int, chunk long, place long, x double, y double, z double, scale array<double>, rot array<double>, opacity double, f_dc array<double>, f_rest array<double>"


def test_planes_give_back_splats_within_their_steps(spark):
    rng = np.random.default_rng(9)
    rows = [*splat_rows(300, rng), *splat_rows(1, rng, 0, 1), *splat_rows(40, rng, 1, 0)]
    files = sog.encoded(spark.createDataFrame(rows, SPLATS).repartition(3), degree=1, clusters=40, rounds=4)
    back = {(r["level"], r["chunk"], r["ordinal"]): r for r in sog.decoded(files).collect()}
    assert len(back) == 341
    for level, chunk, i, x, y, z, scale, rot, opacity, colour, rest in rows:
        b = back[level, chunk, i]
        assert np.allclose([b["x"], b["y"], b["z"]], [x, y, z], atol=3e-3)
        assert np.allclose(b["scale"], scale, atol=0.6) and np.allclose(b["f_dc"], colour, atol=0.6)
        q = np.array(rot) / np.linalg.norm(rot)
        assert abs(np.dot(b["rot"], q)) > 0.999
        assert abs(1 / (1 + math.exp(-b["opacity"])) - 1 / (1 + math.exp(-opacity))) < 0.005
        assert len(b["f_rest"]) == 9
    same = [max(abs(a - b) for a, b in zip(r[10], back[r[:3]]["f_rest"], strict=True)) for r in rows if r[:2] == (1, 0)]
    assert max(same) < 1e-6  # as many centroids as splats
    listed = sog.index(files).orderBy("file").collect()
    assert [(r["file"], r["path"], r["rows"]) for r in listed] == [(0, "0_0/meta.json", 300), (1, "0_1/meta.json", 1), (2, "1_0/meta.json", 40)]
    sizes = {r["path"]: len(r["bytes"]) for r in files.collect()}
    assert sizes["0_0/means_l"] == 1200 and sizes["0_0/shN_centroids"] == 64 * 3 * 4 and "0_1/shN_labels" in sizes


def test_codebook_and_palette_of_odd_values():
    book = sog.book_of(np.array([np.nan, np.inf, 2.0, 1.0]))
    assert book[0] == 1.0 and book[-1] == 2.0 and len(book) == 256 and (np.diff(book) >= 0).all()
    assert (sog.book_of(np.array([np.nan])) == 0).all()
    assert sog.places(np.array([0.0, 1.0]), np.array([0.5, np.nan, 0.51, -3.0, 9.0])).tolist() == [0, 0, 1, 0, 1]
    three, mode = sog.packed_rotations(np.array([[0.0, 0, 0, 0], [-1.0, 0, 0, 0], [0, 0, 2.0, 0]]))
    assert mode.tolist() == [3, 3, 1] and np.allclose(sog.unpacked_rotations(three, mode), [[1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0]], atol=0.01)


def test_regions_find_their_chunks_down_the_tree(spark):
    from cairn.operators import slicing as L

    r = random.Random(8)
    points = spark.createDataFrame([(i, r.uniform(0, 9), r.uniform(0, 9), r.uniform(0, 9)) for i in range(700)], "splat_id long, x double, y double, z double")
    leaf = L.leaves(L.chunked(L.z_ordered(points), 30), 1)
    boxes = {x["chunk"]: x for x in leaf.collect()}
    regions = [(k, *(a := [r.uniform(-2, 9) for _ in range(3)]), *(v + r.uniform(0, 3) for v in a)) for k in range(40)]
    frame = spark.createDataFrame(regions, "region_id long, " + ", ".join(f"{c} double" for c in B.SIDES))
    want = {(k, c) for k, *s in regions for c, x in boxes.items() if all(s[i] <= x[f"max_{a}"] and s[i + 3] >= x[f"min_{a}"] for i, a in enumerate("xyz"))}
    assert {tuple(x) for x in B.chunks_of_regions(frame, L.lod_tree(leaf)).collect()} == want and want


def test_budgets_are_shared_in_order_and_levels_refined(spark):
    counts = spark.createDataFrame([(0, c, 100) for c in range(6)] + [(1, c, [5, 90, 50, 50, 3, 50][c]) for c in range(6)] + [(2, c, 20) for c in range(6)], "level int, chunk long, rows long")

    def plain(rows, most):
        left, out = most, []
        for i, n in enumerate(rows):
            if left <= 0:
                break
            out.append(min(n, max(1, math.ceil(left / (len(rows) - i))), left))
            left -= out[-1]
        return out

    for most in (3, 100, 170, 1000):
        got = B.budgets(counts, most).collect()
        for level, rows in ((0, [100] * 6), (1, [5, 90, 50, 50, 3, 50])):
            assert [r["take"] for r in sorted(got, key=lambda r: r["chunk"]) if r["level"] == level] == plain(rows, most)
    level = lambda *a: {r["level"] for r in B.refined(counts, *a).collect()}
    assert level("nav", 200, 250) == {1} and level("coarsest", 120, 250) == {2} and level("nav", 10**9, 250) == {0} and level(2, 10**9, 10) == {2} and level("finest", 0, 10) == {0}
    with pytest.raises(ValueError):
        B.refined(counts, 7)


def test_rooms_and_the_ladder_of_settings(spark):
    cells, g = field(spark, ["." * 8 + " " + "." * 12] * 6)
    found = O.room(cells, g, 1.0, O.FloorSettings(seed=(1.0, 9.0, 1.0), room=4.0))
    assert found.cells.count() == 48 and found.area == pytest.approx(12.0) and not found.relaxed
    far = O.room(cells, g, 1.0, O.FloorSettings(seed=(90.0, 9.0, 1.0), room=4.0))
    assert far.cells.count() == 72 and far.relaxed
    vertices, triangles = O.steps(found.cells, g, 0.5)
    at, faces = mesh_of(vertices, triangles)
    assert len(at) == 4 * 48 and len(faces) == 96 and all(np.cross(at[b] - at[a], at[c] - at[a])[1] > 0 for a, b, c in faces)
    with pytest.raises(O.NoFloor):
        O.room(cells, g, 1.0, O.FloorSettings(room=1000.0))
    splats = spark.createDataFrame([(i, x * 0.1, 0.0, z * 0.1, 1.0, 0.9, 0.1) for i, (x, z) in enumerate((x, z) for x in range(40) for z in range(40))], "splat_id long, x double, y double, z double, ny double, opacity double, scale double")
    label, room, _ = O.recovered(splats, ladder=(("none", {"density": 1e9}, 4.0), ("some", {}, 4.0)))
    assert label == "some" and room.area >= 4.0
    with pytest.raises(O.NoFloor, match="none.*some"):
        O.recovered(splats, ladder=(("none", {"density": 1e9}, 4.0), ("some", {}, 4000.0)))


def test_chunks_of_many_blocks_equal_a_plain_scan(spark, monkeypatch):
    from cairn.operators import slicing as L

    rng = np.random.default_rng(3)
    monkeypatch.setattr(L, "BLOCK", 40)
    monkeypatch.setattr(L, "LEAST", 3)
    for target, extent, n in ((10, 2.0, 777), (12, 0.5, 400), (7, 100.0, 300), (10, 2.0, 39), (10, 2.0, 1)):
        xyz = np.cumsum(rng.normal(0, 0.4, (n, 3)), axis=0)
        starts, at, least = [], 0, max(target // 8, 3)
        while at < n:
            starts.append(at)
            end = at + 1
            while end < n and end - at < target and not (end - at >= least and (np.ptp(xyz[at : end + 1], axis=0) > extent).any()):
                end += 1
            at = end
        rows = spark.createDataFrame([(i, *map(float, p), "x") for i, p in enumerate(xyz)], "place long, x double, y double, z double, block string").drop("block")
        got = L.chunked(rows, target, extent).groupBy("chunk").agg({"place": "min"}).orderBy("chunk").collect()
        assert [(r[0], r[1]) for r in got] == list(enumerate(starts))
    assert L.chunked(rows.limit(0), 10, 2.0).count() == 0


def test_manifests_are_written_read_and_refused(spark):
    from cairn.operators import manifests as X
    from cairn.operators import slicing as L

    r = random.Random(1)
    points = spark.createDataFrame([(i, *(r.uniform(0, 9) for _ in range(3))) for i in range(70)], "splat_id long, x double, y double, z double")
    chunks = L.chunked(L.z_ordered(points), 10)
    leaf = L.leaves(chunks, 1)
    files = spark.createDataFrame([(level * 7 + c, f"{level}_{c}/meta.json", level, c, 10 >> level) for level in range(2) for c in range(7)], "file long, path string, level int, chunk long, rows long")
    text = X.written(leaf, files).first()["text"]
    boxes = {x["chunk"]: x for x in leaf.collect()}
    got = X.leaves(spark.createDataFrame([("a", text), ("b", "{}"), ("c", None)], "name string, text string")).collect()
    assert {(g["leaf"], g["level"], g["path"], g["rows"]) for g in got} == {(c, v, f"{v}_{c}/meta.json", 10 >> v) for c in range(7) for v in range(2)}
    assert all(g[s] == boxes[g["leaf"]][s] for g in got for s in B.SIDES)
    one = X.summaries(spark.createDataFrame([("a", text)], "name string, text string")).first()
    assert (one["refused"], one["levels"], one["files"], one["leaves"], one["rows"]) == (None, 2, 14, 7, 70) and len(one["sample"]) == 8
    assert X.layout_fault(text) is None
    assert [X.refusal(t) for t in (None, "[]", "{}", '{"levels": []}', '{"filenames": []}', '{"filenames": [], "lodLevels": 1}')] == ["no JSON", "no object", "no files", "older schema", "no levels", "no tree"]
    whole = '{"filenames": ["lod0/meta.json"], "lodLevels": 1, "tree": {"bound": {"min": [0, 0, 0], "max": [1, 1, 99]}}}'
    assert X.layout_fault(whole) == "whole levels" and X.layout_fault(whole.replace("lod0", "0_0")) == "one leaf" and X.layout_fault(whole.replace("lod0", "x")) == "other names"
    assert X.written(leaf.limit(0), files).count() == 0
    members = spark.createDataFrame([("z", "top/lod-meta.json"), ("z", "top\\\\0_0/./meta.json"), ("z", "other/x"), ("z", "top/"), ("y", "/0_0/meta.json"), (None, "q/lod-meta.json")], "name string, path string")
    assert {tuple(x) for x in X.rooted(members).collect()} == {("z", "lod-meta.json"), ("z", "0_0/meta.json"), ("z", "other/x"), ("y", "0_0/meta.json"), (None, "lod-meta.json")}


def test_preflight_counts_odd_vertices_and_turns_meshes_over(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 1.0), (2, 1.0, 0.0, 1.0), (3, float("nan"), 0.0, 0.0), (4, 9.0, float("inf"), 0.0)], "vertex long, x double, y double, z double")
    up = spark.createDataFrame([(0, 0, 1, 2)], "triangle long, a long, b long, c long")
    row, same = M.preflight(vertices, up)
    r = row.first()
    assert (r["vertices"], r["finite"], r["triangles"], r["up"], r["flipped"], r["max_x"]) == (5, 3, 1, 1.0, False, 1.0) and same.collect() == up.collect()
    row, turned = M.preflight(vertices, spark.createDataFrame([(0, 1, 0, 2)], "triangle long, a long, b long, c long"))
    assert row.first()["flipped"] and [tuple(t) for t in turned.collect()] == [(0, 1, 2, 0)]
    assert M.preflight(vertices, up.limit(0))[0].first()["up"] == 0.0


def test_many_staged_rows_are_not_gathered_on_the_driver(spark):
    rows = staged(spark.range(300_000).select(F.col("id").alias("k"), F.lit(0).alias("v")), "many")
    few = staged(spark.range(5).select(F.col("id").alias("k")), "few")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()
    wide = spark.range(1_000_000).select(F.col("id").alias("k"))
    assert "BroadcastHashJoin" not in plan(wide.join(rows.filter("v = 0"), "k"))
    assert "BroadcastHashJoin" in plan(wide.join(few, "k"))
    assert wide.join(rows, "k").count() == 300_000


def test_islands_join_across_blocks_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(I, "STRETCH", 4)
    # A strip of 60 triangles over several blocks, one apart, and two that share a corner with the strip's end.
    rows = [(i, float(i), 0.0, 0.0, i + 1.0, 0.0, 0.0, i + 0.5, 1.0, 0.0) for i in range(60)]
    rows += [(60, 0.0, 50.0, 0.0, 1.0, 50.0, 0.0, 0.0, 51.0, 0.0), (61, 60.0, 0.0, 0.0, 61.0, 5.0, 0.0, 62.0, 5.0, 0.0), (62, 60.0001, 0.0, 0.0, 63.0, 9.0, 0.0, 64.0, 9.0, 0.0)]
    found = I.islands(spark.createDataFrame(rows, TRIANGLES))
    assert {r["triangle"]: r["island"] for r in found.collect()} == {i: 0 if i != 60 else 60 for i in range(63)}
    assert "_label" not in found.columns


def test_triangles_of_a_stretch_are_joined_by_one_pass():
    at = np.array([[[i, 0, 0], [i + 1, 0, 0], [i, 1, 0]] for i in (5, 0, 1, 2, 9)], float)
    at[4, 0] = np.nan
    label, fresh = I.joined(np.array([7, 3, 4, 5, 1]), at)
    assert label.tolist() == [7, 3, 3, 3, 1]
    assert [bin(b).count("1") for b in fresh] == [3, 3, 2, 2, 3]


def test_rays_make_a_row_for_each_tile_and_hit_across_tiles(spark):
    box = V.Box((0.0, 0.0, 0.0), (200, 40, 40), 1.0)
    rays = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0), (2, 0.5, 20.5, 0.5, 1.0, 0.0, 0.0), (3, 0.5, 0.5, 39.5, 0.0, 0.0, -1.0)], "ray_id long, x double, y double, z double, dx double, dy double, dz double")
    cells = {(150, 0, 0), (151, 0, 0), (17, 20, 1), (0, 0, 31), (0, 0, 3)}
    rows = R.stretches(rays, box, 180.0).collect()
    assert len(rows) == 12 + 12 + 3 and sum(len(r["codes"]) for r in rows) == 180 + 180 + 39
    assert {r["ray_id"]: (r["distance"], r["nx"], r["nz"]) for r in R.first_hits(rays, voxels(spark, cells), box, 180.0).collect()} == {1: (149.5, -1, 0), 3: (7.5, 0, 1)}
    words = {(r["tx"], w["word"]): w["bits"] for r in R.tiles(voxels(spark, {(15, 3, 3), (16, 0, 0), (63, 15, 15)})).collect() for w in r["words"]}
    assert words == {(0, 12): -(1 << 63), (1, 0): 1, (3, 63): -(1 << 63)}


@pytest.mark.parametrize("n", [1, 5, 255, 256, 257, 750, 1500, 1791, 1792, 6000])
def test_books_are_the_means_of_runs_to_the_bit(n):
    v = np.random.default_rng(n).normal(size=n)
    start = np.arange(256) * n // 256
    end = np.maximum((np.arange(256) + 1) * n // 256, start + 1)
    assert (sog.book_of(v) == np.maximum.accumulate([np.sort(v)[a:b].mean() for a, b in zip(start, end, strict=True)])).all()


def test_chunks_are_encoded_once_for_their_index(spark):
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    files = spark.range(8).selectExpr("CAST(id % 2 AS INT) AS level", "id AS chunk", "concat(id, '/meta.json') AS path", "id AS rows").mapInArrow(made, "level int, chunk bigint, path string, rows bigint")
    assert sog.index(files).count() == 8 and seen.value == 8


def test_runs_of_keys_go_on_over_batches():
    part = lambda *rows: pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["level", "chunk", "place"])
    batches = [part((0, 1, 5), (0, 1, 6)), part((0, 1, 7)).slice(0, 0), part((0, 1, 7), (0, 2, 0), (1, 2, 1)), part((1, 2, 2))]
    assert [t["place"].to_pylist() for t in sog.runs(iter(batches), ("level", "chunk"))] == [[5, 6, 7], [0], [1, 2]]
    assert not list(sog.runs(iter([]), ("level", "chunk")))


def test_regions_meet_one_depth_of_the_tree_at_a_time(spark, monkeypatch):
    boxes = ", ".join(f"{n}_{c} double" for n in ("min", "max") for c in "xyz")
    tree = spark.createDataFrame([(1, 0, 2, 0, *[0.0] * 3, *[2.0] * 3), (2, 1, 1, 0, *[0.0] * 3, *[1.0] * 3), (3, 1, 1, 1, *[1.5] * 3, *[2.0] * 3)], f"node_id long, depth int, chunks long, first long, {boxes}")
    regions = spark.createDataFrame([(7, *[0.5] * 3, *[1.6] * 3), (8, *[0.1] * 3, *[0.2] * 3)], f"region_id long, {boxes}")
    plans = []
    monkeypatch.setattr(B, "staged", lambda df, what: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or staged(df, what))
    assert sorted(map(tuple, B.chunks_of_regions(regions, staged(tree, "tree")).collect())) == [(7, 0), (7, 1), (8, 0)]
    assert len(plans) == 2 and all(f"= {depth})" in plan and "depth" in plan for depth, plan in enumerate(plans))


def test_regions_of_one_box_go_down_once_and_pairs_are_not_staged(spark, monkeypatch):
    """A row for each region and node of each depth filled the disk at 6 GB."""
    from cairn.operators import slicing as L

    r = random.Random(8)
    points = spark.createDataFrame([(i, *(r.uniform(0, 8) for _ in range(3))) for i in range(1200)], "splat_id long, x double, y double, z double")
    leaf = staged(L.leaves(L.chunked(L.z_ordered(points), 20), 1), "leaf")
    boxes = {x["chunk"]: x for x in leaf.collect()}
    kinds = [(*(a := [r.uniform(-2, 9) for _ in range(3)]), *(v + r.uniform(0, 5) for v in a)) for _ in range(12)]
    regions = [(k, *kinds[k % 12]) for k in range(240)]
    frame = spark.createDataFrame(regions, "region_id long, " + ", ".join(f"{c} double" for c in B.SIDES))
    want = {(k, c) for k, *s in regions for c, x in boxes.items() if all(s[i] <= x[f"max_{a}"] and s[i + 3] >= x[f"min_{a}"] for i, a in enumerate("xyz"))}
    monkeypatch.setattr(B, "BELOW", 8)
    monkeypatch.setattr(B, "BOXES", 3)
    rows = []
    monkeypatch.setattr(B, "staged", lambda df, what: rows.append(df.count()) or staged(df, what))
    found = [tuple(x) for x in B.chunks_of_regions(frame, staged(L.lod_tree(leaf), "tree")).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert rows and max(rows) <= 12 * 8 < len(want)
