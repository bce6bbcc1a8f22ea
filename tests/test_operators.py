"""Operators against small models of their own, round trips, and properties."""

import json
import struct
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as G
from cairn.functions import paths as P
from cairn.operators import cloud as C
from cairn.operators import codec as Q
from cairn.operators import components as K
from cairn.operators import field as D
from cairn.operators import slicing as L
from cairn.operators import voxels as V
from cairn.sources import splats as A
from cairn.sources.tables import with_ordinal
from cairn.streaming import lod

CLOUD = "splat_id long, x double, y double, z double, ny double, opacity double, scale double"


def test_components_of_random_grids_match_a_flood_fill(spark):
    rng = np.random.default_rng(5)
    cells = {(int(r), int(c)) for r, c in np.argwhere(rng.random((14, 14)) < 0.55)}
    label = {}
    for start in sorted(cells):
        if start in label:
            continue
        queue, label[start] = deque([start]), start
        while queue:
            r, c = queue.popleft()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in cells and n not in label:
                    label[n] = start
                    queue.append(n)
    rows = K.cell_components(spark.createDataFrame(sorted(cells), "row long, col long"), ("row", "col")).collect()
    assert {(r["row"], r["col"]): tuple(r["component"]) for r in rows} == label


def test_components_of_a_long_path_and_of_nothing(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in K.connected_components(edges).collect()} == {0}
    assert K.connected_components(edges.limit(0)).count() == 0


def test_ordinal_is_dense_and_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = with_ordinal(rows, ["v"], "i", 7).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(1000))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got)
    assert with_ordinal(rows.limit(0), ["v"], "i").count() == 0


@pytest.mark.parametrize("p", [0.0, 0.02, 0.5, 0.613, 1.0])
def test_nearest_rank_equals_the_sorted_place(spark, p):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 40, 501)] + [1e12]
    rows = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "v double")
    assert C.nearest_rank(rows, "v", p, buckets=4, few=3) == sorted(values)[int((len(values) - 1) * p + 0.5)]
    assert C.nearest_rank(rows.limit(0), "v", p) is None


def test_rows_that_are_not_finite_go_and_nan_opacity_stays(spark):
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 1.0, 0.5, 0.1), (2, nan, 0.0, 0.0, 1.0, 0.5, 0.1), (3, inf, 0.0, 0.0, 1.0, 0.5, 0.1), (4, 1.0, 1.0, 1.0, 1.0, nan, nan), (5, 1.0, 1.0, 1.0, 1.0, 0.05, 0.1), (6, 1.0, 1.0, 1.0, 1.0, 0.5, 5.0)], CLOUD)
    s = C.CloudSettings()
    assert sorted(r["splat_id"] for r in C.kept(C.oriented(rows, s), s).collect()) == [1, 4]


def test_pruning_skips_few_points_and_ignores_rigid_motion(spark):
    few = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(17)], "splat_id long, x double, y double, z double")
    assert C.pruned(few).count() == 17
    rng = np.random.default_rng(2)
    xyz = np.concatenate((rng.normal(size=(300, 3)), [[40.0, 0, 0], [0, 50.0, 0]]))
    turned = xyz @ np.array(G.rotation(0.0, np.pi / 2, 0.0)).T
    kept = []
    for points in (xyz, turned):
        rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "splat_id long, x double, y double, z double")
        kept.append({r["splat_id"] for r in C.pruned(rows).collect()})
    assert not {300, 301} & kept[0]
    assert kept[0] == kept[1]
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(40)], "splat_id long, x double, y double, z double")
    assert C.pruned(same).count() == 40


def test_floor_in_an_open_room(spark):
    rng = np.random.default_rng(1337)
    rows = [(i, float(x), float(y), float(z), 1.0, 1.0, 0.1) for i, (x, y, z) in enumerate(np.stack((*(a.ravel() for a in np.meshgrid(np.linspace(0, 8, 60), np.linspace(0, 8, 60))), rng.uniform(-0.005, 0.005, 3600)), axis=1)[:, [0, 2, 1]])]
    f = D.build(spark.createDataFrame(rows, CLOUD))
    states = {r["state"]: r["count"] for r in f.cells.groupBy("state").count().collect()}
    assert states == {"walkable": 256}
    assert -0.2 < f.floor < 0.1  # smoothing makes a plateau of five bins, of which the lowest counts
    assert f.cells.filter(F.abs("height") > 0.1).isEmpty()
    assert f.cells.select("component").distinct().count() == 1
    assert D.grid_of(spark.createDataFrame(rows, CLOUD).limit(0), D.FieldSettings()) is None


def test_small_enclosed_holes_are_filled_and_open_ones_are_not(spark):
    g = D.Grid(0.0, 0.0, 9, 9, 0.0, 10, 0.0)
    cells = [(r, c, 1.0, "walkable") for r in range(9) for c in range(9) if (r, c) not in {(2, 2), (2, 3), (0, 6), (6, 6)}] + [(6, 6, None, "obstacle")]
    got = D.filled(spark.createDataFrame(cells, "row long, col long, height double, state string"), g, D.FieldSettings())
    assert {(r["row"], r["col"]) for r in got.filter("state = 'filled'").collect()} == {(2, 2), (2, 3)}
    big = [(r, c, 1.0, "walkable") for r in range(9) for c in range(9) if not (2 <= r <= 6 and 2 <= c <= 6)]
    assert D.filled(spark.createDataFrame(big, "row long, col long, height double, state string"), g, D.FieldSettings()).filter("state = 'filled'").isEmpty()


def test_output_space_winding_follows_the_determinant():
    for up in "yz":
        for hand in ("right", "left"):
            m, flip = G.output_space(up, hand)
            assert flip == (G.determinant(m) < 0) == (hand == "left")
    assert G.output_space("y", "left", "ccw")[1] is False


def test_dilation_reach_and_mask(spark):
    box = V.Box((0.0, 0.0, 0.0), (6, 5, 7), 1.0)
    rng = np.random.default_rng(3)
    grid = rng.random(box.dims) < 0.06
    volume = spark.createDataFrame([tuple(map(int, v)) for v in np.argwhere(grid)], "vx long, vy long, vz long")
    wide = {tuple(r) for r in V.dilated(volume, box, (1, 2, 1)).collect()}
    assert wide == {tuple(v) for v in np.ndindex(box.dims) if grid[max(0, v[0] - 1) : v[0] + 2, max(0, v[1] - 2) : v[1] + 3, max(0, v[2] - 1) : v[2] + 2].any()}
    assert {tuple(r) for r in V.unpacked(V.packed(volume, box), box).collect()} == {tuple(r) for r in volume.collect()}


def test_reachable_space_stops_at_walls(spark):
    box = V.Box((0.0, 0.0, 0.0), (5, 1, 3), 1.0)
    free = V.space(spark, box).filter("vx <> 2")
    got = {tuple(r) for r in V.reachable(free, V.nearest(free, (0, 0, 0), 3)).collect()}
    assert got == {(x, 0, z) for x in (0, 1) for z in range(3)}
    assert V.box_of((0, 0, 0), (9999.0, 9999.0, 9999.0), V.VoxelSettings()) is None


def test_chunks_with_an_extent_equal_the_plain_scan(spark):
    rng = np.random.default_rng(7)
    xyz = np.cumsum(rng.normal(size=(20_000, 3)), axis=0)
    target, extent, chunks, held = 16_000, 200.0, [0], []
    for i, p in enumerate(xyz):
        low, high = (np.min([*held, p], axis=0), np.max([*held, p], axis=0)) if len(held) else (p, p)
        n = i - chunks[-1]
        if n and (n >= target or (n >= 8192 and (high - low).max() > extent)):
            chunks.append(i)
            held = [p]
        else:
            held = [low, high]
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "place long, x double, y double, z double")
    got = L.chunked(rows, target, extent).groupBy("chunk").agg(F.min("place").alias("p")).orderBy("chunk").collect()
    assert [r["p"] for r in got] == chunks


def test_five_rows_in_chunks_of_two_have_counts_five_and_three(spark):
    rows = spark.createDataFrame([(i, float(i), float(i % 2), float(i % 3)) for i in range(5)], "splat_id long, x double, y double, z double")
    chunks = L.chunked(L.z_ordered(rows), 2)
    assert [r["n"] for r in L.levels(chunks, 2).groupBy("level").agg(F.count("*").alias("n")).orderBy("level").collect()] == [5, 3]
    assert spark.read.parquet(L.write_bundle(chunks, 2)).select("level", "chunk").distinct().count() == 6
    assert all(set(r["lods"]) == {"0", "1"} for r in L.leaves(chunks, 2).collect())


def test_few_values_in_a_codebook_and_ties(spark):
    values = spark.createDataFrame([(3.0,), (1.0,), (float("nan"),), (2.0,)], "v double")
    book = Q.codebook(values, 4)
    assert book == [1.0, 1.0, 2.0, 3.0]
    got = spark.createDataFrame([(1.5,), (2.5,), (9.0,), (-9.0,)], "v double").select(Q.nearest_entry(F.col("v"), [1.0, 2.0, 3.0]).alias("i")).collect()
    assert [r["i"] for r in got] == [0, 1, 2, 0]
    assert Q.codebook(values.limit(0), 4) == [0.0] * 4


def _full(spark, n=2):
    rows = [(1.0, 2.0, 3.0, [1.0, 1.0, 1.0], [1.0, 0.0, 0.0, 0.0], 2.0, [0.1, 0.2, 0.3], [float(i) for i in range(9)]), (-4.0, 5.0, -6.0, [0.5, 0.5, 0.5], [0.0, 0.0, 0.0, 1.0], -1.0, [0.0, 0.0, 0.0], [0.0] * 9)][:n]
    return spark.createDataFrame(rows, "x float, y float, z float, scale array<float>, rot array<float>, opacity float, f_dc array<float>, f_rest array<float>").coalesce(1)


def test_ply_round_trip_keeps_all_columns(spark):
    full = _full(spark)
    back = A.read_splats(spark, A.write_ply(full), full=True).orderBy("ordinal").drop("file", "ordinal")
    assert [r.asDict() for r in back.collect()] == [r.asDict() for r in full.orderBy(F.desc("x")).collect()]


def test_splat_records(spark):
    full = _full(spark).withColumn("f_rest", F.array().cast("array<float>")).withColumn("scale", F.transform("scale", lambda v: F.log(v).cast("float")))
    back = A.decoded(A.encoded(full, "splat"), full=True).orderBy("ordinal").collect()
    assert [(r["x"], r["y"], r["z"]) for r in back] == [(1.0, 2.0, 3.0), (-4.0, 5.0, -6.0)]
    assert abs(back[0]["scale"][0]) < 1e-6 and abs(back[0]["rot"][0] - 1) < 1e-3 and abs(back[0]["opacity"] - 2.0) < 0.05
    for n in (0, 31, 33):
        with pytest.raises(A.InvalidSplats):
            A.splat_records(b"\0" * n)


def test_ascii_ply_with_defaults():
    v = A.ply_vertices(b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty double opacity\nend_header\n1 2 3 0.5\n4 5 6 0.25\n")
    got = A.nav_points(v)
    assert got["y"].tolist() == [2, 5] and got["nz"].tolist() == [1, 1] and got["sx"].tolist() == [0.1, 0.1] and got["opacity"].tolist() == [1, 1]
    with pytest.raises(A.InvalidSplats):
        A.ply_vertices(b"plain text")


def test_archives_round_trip(spark):
    files = spark.createDataFrame([("a", "m/1.bin", bytearray(b"one")), ("a", "m/0.bin", bytearray(b"")), ("b", "x", bytearray(b"two"))], "name string, path string, bytes binary")
    for compressed in (False, True):
        back = A.members(A.archived(files, compressed)).collect()
        assert sorted((r["name"], r["path"], bytes(r["bytes"])) for r in back) == [("a", "m/0.bin", b""), ("a", "m/1.bin", b"one"), ("b", "x", b"two")]


def test_binary_mesh():
    data = A.glb([[0, 0, 0], [1, 0, 0], [0, 1, 0]], [[0, 1, 2]])
    magic, version, size = struct.unpack_from("<4sII", data)
    assert (magic, version, size) == (b"glTF", 2, len(data))
    n = struct.unpack_from("<I", data, 12)[0]
    assert json.loads(data[20 : 20 + n])["accessors"][0]["max"] == [1, 1, 0]
    assert A.glb([], []) is None
    with pytest.raises(A.InvalidSplats):
        A.glb([[0, 0, 0]], [[0, 0, 1]])


def test_slugs_and_paths(spark):
    labels = ["https://h/a1b2c3d4/lod-meta.json", "https://h/scenes/room/meta.json?x=1", "my.file.ply", "", None]
    rows = spark.createDataFrame([(v,) for v in labels], "v string").select(P.slug(F.col("v")).alias("s"), P.normalized(F.lit("a/./b/../../../c//d")).alias("n")).collect()
    assert [r["s"] for r in rows] == ["a1b2c3d4", "room", "my.file", "scene", "scene"]
    assert rows[0]["n"] == "c/d"


def test_budget_by_running_sums_equals_the_loop(spark):
    rng = np.random.default_rng(11)
    nodes = [(0, i, float(rng.integers(0, 9)), 0, [0, 1, 2], sorted((int(v) for v in rng.integers(1, 50, 3)), reverse=True)) for i in range(40)]
    budget = sum(n[5][0] for n in nodes) * 6 // 10
    level, total = {n[1]: 0 for n in nodes}, sum(n[5][0] for n in nodes)
    for _ in range(2):
        for n in sorted(nodes, key=lambda n: (-n[2], n[1])):
            if total > budget and level[n[1]] < 2:
                level[n[1]] += 1
                total += n[5][level[n[1]]] - n[5][level[n[1]] - 1]
    rows = spark.createDataFrame(nodes, "view long, node long, distance double, level int, levels array<int>, counts array<long>")
    assert {r["node"]: r["level"] for r in lod.budgeted(rows, budget).collect()} == level


def test_pauses_on_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).alias("session"), F.timestamp_millis(F.col("id") * 150 + F.floor(F.col("id") / 20) * 5000).alias("ts"), F.lit(True).alias("moving"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lod.pauses(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "600 milliseconds")
    query = stream.writeStream.format("memory").queryName("paused").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("paused").collect())) == sorted(map(tuple, lod.pauses(rows, "600 milliseconds").collect()))
