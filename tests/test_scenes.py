"""Files of scenes, places near seeds and ramps of two volumes, against plainer ways."""

from pyspark.sql import functions as F

from cairn.operators import meshes as M
from cairn.operators import packs as K
from cairn.operators import spawns as W
from cairn.operators import voxels as V
from cairn.plans import volumes as P

VOXELS = "vx long, vy long, vz long"
BOX = V.Box((0.0, 0.0, 0.0), (6, 5, 4), 0.25)


def test_files_of_scenes_come_from_one_pass(spark):
    solid = [("a", x, y, z) for x in range(6) for z in range(4) for y in range((x * 7 + z * 3) % 4)] + [("b", 0, 0, 0), ("b", 5, 4, 3)]
    nav = [("a", 0, 3, 0), ("a", 1, 3, 0), ("a", 1, 4, 2), ("b", 0, 1, 0)]
    solid, nav = (spark.createDataFrame(rows, f"name string, {VOXELS}") for rows in (solid, nav))
    one = K.scene_files(solid, nav, BOX, -0.25)
    bare = lambda df, path: {r["name"]: bytes(r["bytes"]) for r in df.filter(F.col("path") == path).collect()}
    assert bare(one, K.SOLID) == bare(K.masks(solid, BOX, K.SOLID), K.SOLID) and bare(one, K.NAV) == bare(K.masks(nav, BOX, K.NAV), K.NAV)
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    faces = None
    for name in "ab":
        own = V.exterior_faces(solid.filter(F.col("name") == name).select(*V.AXES)).withColumn("name", F.lit(name))
        faces = own if faces is None else faces.unionByName(own)
    tops = solid.join(nav.select("name", "vx", (F.col("vy") - 1).alias("vy"), "vz"), ["name", *V.AXES], "left_semi")
    for path, quads in ((K.COLLISION, M.quads(faces, "name")), (K.FLOORS, M.treads(tops, "name"))):
        counts = lambda df: sorted(tuple(r) for r in K.mesh_counts(df.filter(F.col("path") == path)).collect())  # noqa: B023, E731
        assert counts(one) == counts(K.mesh_files(quads, BOX, path)) != []


def test_only_columns_near_seeds_are_judged(spark, monkeypatch):
    box = V.Box((0.0, 0.0, 0.0), (400, 8, 12), 0.25)
    solid = spark.createDataFrame([(x, y, z) for x in range(400) for z in range(12) for y in range(1 + x % 2)], VOXELS)
    nav = spark.createDataFrame([(x, y, z) for x in range(400) for z in range(12) for y in range(1 + x % 2, 4)], VOXELS)
    seeds = spark.createDataFrame([(1, 2.6, 0.6, 1.6), (2, 95.0, 0.6, 1.6), (3, -50.0, 0.0, 0.0)], "seed_id int, x double, y double, z double")
    seen, places = [], W.places
    monkeypatch.setattr(W, "places", lambda s, n, *more: seen.append(s.count()) or places(s, n, *more))
    got = {r["seed_id"]: (r["x"], r["z"]) for r in W.spawns(seeds, solid, nav, box, 0.2, 0.5, 1.0).collect()}
    assert seen[0] < solid.count() / 10
    assert got[3] == (None, None) and all(got[i][0] is not None for i in (1, 2))
    free, floor = W.free(solid, nav), W.deck_height(solid, nav, box)
    below = free.withColumnRenamed("vy", "own").join(solid, ["vx", "vz"]).filter("vy < own").groupBy("vx", "vz", "own").agg(F.max("vy").alias("vy"))
    assert floor == (below.groupBy("vy").count().orderBy(F.desc("count"), "vy").first()["vy"] + 1) * 0.25


def test_ramps_of_the_volume_and_of_the_terrain(spark):
    rows = P.ramps(spark, "/root/testdata/sf0.001")
    assert "over" in rows.columns and rows.filter("over = 'terrain'").count() > 0
    assert "'volume'" in P.SQL["floor_ramps"] and P.BOX in P.SQL["floor_ramps"]


def test_scenes_are_packed_where_their_files_are_made(spark):
    """Meshes were shuffled to be zipped, staged unzipped and read twice more, and voxels counted as rows: too slow at 1 GB."""
    solid = [("a", x, y, z) for x in range(6) for z in range(4) for y in range((x * 7 + z * 3) % 4)] + [("b", 0, 0, 0), ("b", 5, 4, 3)]
    nav = [("a", 0, 3, 0), ("a", 1, 4, 2), ("b", 0, 1, 0), ("b", 3, 1, 2)]
    voxels = [spark.createDataFrame(rows, f"name string, {VOXELS}") for rows in (solid, nav)]
    rows = [v.groupBy("name", F.lit(0).cast("bigint").alias("vx"), "vy", "vz").agg(F.expr("bit_or(shiftleft(1L, CAST(vx AS INT)))").alias("bits")) for v in voxels]
    scenes = spark.createDataFrame([("a", [1.0, 2.0, 3.0], None), ("b", None, None)], "name string, seed array<double>, spawn array<double>")
    sessions = K.sessions(scenes, BOX)
    expected = K.zipped(sessions.union(K.scene_files(*voxels, BOX, -0.25)))
    plain = sorted((r["name"], bytes(r["content"])) for r in expected.collect())
    for volumes in (voxels, rows):
        assert sorted((r["name"], bytes(r["content"])) for r in K.scene_packs(sessions, *volumes, BOX, -0.25).collect()) == plain
    found = {(r["name"], r["path"]): r for r in K.contents(expected, BOX).collect()}
    for path, own in ((K.SOLID, solid), (K.NAV, nav)):
        for name in "ab":
            at, r = [v for n, *v in own if n == name], found[name, path]
            assert [r["voxels"], r["sum_vx"], r["sum_vy"], r["sum_vz"]] == [len(at), *map(sum, zip(*at, strict=True))]
    assert sorted(map(tuple, K.judged(K.contents(expected, BOX)).collect())) == sorted(map(tuple, K.parsed(expected).collect()))
