"""Navigation packs: the volume of a scene, meshes of it and its session as named files, one archive a scene, and back.

Scenes are many; each is bounded by the box of its volume, so that a task writes a scene's file whole."""

from __future__ import annotations

import io
import json
import math
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import voxels as V
from cairn.sources.splats import archived, glb, members, packed

#: Names of a pack's files, and of the volume's format.
SESSION, META, SOLID, NAV, COLLISION, FLOORS, NAVMESH = "nav_session.json", "volume.meta.json", "volume.solid.bin", "volume.nav_region.bin", "collision.glb", "walkable_floors.glb", "recast.navmesh.bin"
FORMAT = "voxel_volume_v1"
MODES = ("voxel_walk", "recast_crowd")
#: Places of a lattice that a task holds a number of each.
DENSE = 1 << 20
FILES = pa.schema([("name", pa.string()), ("path", pa.string()), ("bytes", pa.binary())])
FILES_SQL = "name string, path string, bytes binary"


def masks(volume: DataFrame, box: V.Box, path: str) -> DataFrame:
    """volume (name, vx, vy, vz) -> of each name its bit mask, lowest bit first, in the order y, z, x, as a file."""
    dx, dy, dz = box.dims

    def run(rows: pa.Table) -> pa.Table:
        x, y, z = (rows[v].to_numpy() for v in V.AXES)
        bits = np.zeros(-(-dx * dy * dz // 8) * 8, np.uint8)
        bits[(y * dz + z) * dx + x] = 1
        return pa.table([pa.array([rows["name"][0].as_py()]), pa.array([path]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], schema=FILES)

    return volume.select("name", *V.AXES).groupBy("name").applyInArrow(run, FILES_SQL)


def unmasked(files: DataFrame, box: V.Box) -> DataFrame:
    """The volumes (name, vx, vy, vz) of files of masks()."""
    dx, dy, dz = box.dims
    schema = pa.schema([("name", pa.string()), *((v, pa.int64()) for v in V.AXES)])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch["name"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: dx * dy * dz])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at % dx), pa.array(at // (dx * dz)), pa.array(at // dx % dz)], schema=schema)

    return files.select("name", "bytes").mapInArrow(run, "name string, " + ", ".join(f"{v} bigint" for v in V.AXES))


def _mesh(at: np.ndarray, low: np.ndarray, size: float) -> bytes:
    """A binary mesh of quads, four rows (cy, cz, cx) each."""
    at = np.ascontiguousarray(at.T)
    first = at.min(axis=1)
    shape = tuple((at.max(axis=1) - first + 1).tolist())
    key = np.ravel_multi_index(tuple(at - first[:, None]), shape)
    if math.prod(shape) <= max(16 * len(key), DENSE):  # numbers of the corners in order are looked up on their lattice
        there = np.zeros(math.prod(shape), bool)
        there[key] = True
        own, place = np.flatnonzero(there), (np.cumsum(there) - 1)[key]
    else:
        own, place = np.unique(key, return_inverse=True)
    corner = np.stack(np.unravel_index(own, shape), axis=1) + first
    four = place.reshape(-1, 4)
    triangles = np.concatenate((four[:, [0, 1, 2]], four[:, [0, 2, 3]]), axis=1).reshape(-1, 3)
    return glb((low + corner * size)[:, [2, 0, 1]], triangles)


def _quads(volume: np.ndarray, direction: tuple[int, int, int]) -> np.ndarray:
    """The corners (cy, cz, cx) of faces that voxels of a dense volume (y, z, x) have in a direction, four rows each."""
    y, z, x = np.nonzero(volume)
    return np.stack([np.stack((y + j, z + k, x + i), axis=1) for i, j, k in V.corners(direction)], axis=1).reshape(-1, 3)


def _scene(solid: np.ndarray, nav: np.ndarray, box: V.Box, bias: float) -> list[tuple[str, bytes]]:
    """The files of scene_files() of one scene, from the places of its voxels."""
    dx, dy, dz = box.dims
    low = np.array([box.low[1], box.low[2], box.low[0]])
    out, full = [], []
    for path, at in ((SOLID, solid), (NAV, nav)):
        bits = np.zeros(-(-dx * dy * dz // 8) * 8, np.uint8)
        bits[at] = 1
        full.append(bits[: dx * dy * dz].reshape(dy, dz, dx) > 0)
        if len(at):
            out.append((path, np.packbits(bits, bitorder="little").tobytes()))
    wide = np.pad(full[0], 1)
    faces = [_quads(full[0] & ~wide[1 + j : 1 + j + dy, 1 + k : 1 + k + dz, 1 + i : 1 + i + dx], (i, j, k)) for i, j, k in V.FACES]
    tops = full[0] & np.pad(full[1], ((0, 1), (0, 0), (0, 0)))[1:]
    for path, quads, up in ((COLLISION, np.concatenate(faces), 0.0), (FLOORS, _quads(tops, (0, 1, 0)), bias)):
        if len(quads):
            out.append((path, _mesh(quads, low + np.array([up, 0.0, 0.0]), box.size)))
    return out


def _voxels(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of solid and of walking space, from rows of up to 64 voxels along x."""
    own = rows.filter(rows["place"].is_valid())
    at, bits, solid = (own[c].to_numpy(zero_copy_only=False) for c in ("place", "bits", "solid"))
    which, bit = np.nonzero(np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at, solid = at[which].astype(np.int64) + bit, solid[which].astype(bool)
    return at[solid], at[~solid]


def _placed(solid: DataFrame, nav: DataFrame, box: V.Box) -> DataFrame:
    """name, solid, place, bits of both volumes: of voxels, or of rows of bits that start at vx."""
    dx, _, dz = box.dims
    place = ((F.col("vy") * dz + F.col("vz")) * dx + F.col("vx")).cast("int").alias("place")
    one = lambda v, is_solid: v.select("name", F.lit(is_solid).alias("solid"), place, (F.col("bits") if "bits" in v.columns else F.lit(1).cast("bigint")).alias("bits"))
    return one(solid, True).union(one(nav, False))


def scene_files(solid: DataFrame, nav: DataFrame, box: V.Box, bias: float = 0.0) -> DataFrame:
    """solid and nav (name, vx, vy, vz; with bits: the voxels from vx on) -> of each name the files that masks() and mesh_files() make: both masks, the mesh
    of all faces that no solid voxel covers, and that of the tops of solid voxels with walking space on them, its y moved by bias. Empty ones are left out.

    A scene is bounded by the box, so that all is told from its voxels in one task: no face is shuffled."""

    def run(rows: pa.Table) -> pa.Table:
        out = _scene(*_voxels(rows), box, bias)
        return pa.table([pa.array([rows["name"][0].as_py()] * len(out), pa.string()), pa.array([p for p, _ in out]), pa.array([b for _, b in out], pa.binary())], schema=FILES)

    return _placed(solid, nav, box).groupBy("name").applyInArrow(run, FILES_SQL)


def scene_packs(files: DataFrame, solid: DataFrame, nav: DataFrame, box: V.Box, bias: float = 0.0) -> DataFrame:
    """What zipped() gives of files (name, path, bytes) and those of scene_files() together. A scene's files are packed where they are made: only its
    voxels and the given files, which are small, are shuffled."""
    none = lambda *columns: [F.lit(None).cast(t).alias(n) for n, t in columns]
    both = _placed(solid, nav, box).select("*", *none(("path", "string"), ("bytes", "binary")))
    given = files.select("name", *none(("solid", "boolean"), ("place", "int"), ("bits", "bigint")), "path", "bytes")

    def run(rows: pa.Table) -> pa.Table:
        own = rows.filter(rows["path"].is_valid())
        out = [*zip(own["path"].to_pylist(), own["bytes"].to_pylist(), strict=True), *_scene(*_voxels(rows), box, bias)]
        return pa.table({"name": [rows["name"][0].as_py()], "content": pa.array([packed([f for f in out if f[1]], True)], pa.binary())})

    n = int(solid.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # voxels are few bytes, so that Spark would make few tasks of them
    return both.union(given).repartition(n, "name").groupBy("name").applyInArrow(run, "name string, content binary")


def mesh_files(quads: DataFrame, box: V.Box, path: str, bias: float = 0.0) -> DataFrame:
    """quads (name, corners) of meshes.quads() -> of each name a binary mesh with welded vertices, their y moved by bias."""
    low = np.array([box.low[1] + bias, box.low[2], box.low[0]])

    def run(rows: pa.Table) -> pa.Table:
        flat = rows["corners"].combine_chunks()
        flat = (flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)).flatten()
        content = _mesh(np.stack([flat.field(c).to_numpy() for c in ("cy", "cz", "cx")], axis=1), low, box.size)
        return pa.table([pa.array([rows["name"][0].as_py()]), pa.array([path]), pa.array([content], pa.binary())], schema=FILES)

    return quads.select("name", "corners").groupBy("name").applyInArrow(run, FILES_SQL)


def sessions(scenes: DataFrame, box: V.Box, mode: str = MODES[0]) -> DataFrame:
    """scenes (name, seed, spawn: arrays of three numbers or null) -> the files of each's session and of its volume's description."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    session = F.to_json(F.struct(F.lit(1).alias("version"), F.lit(mode).alias("locomotionMode"), F.lit(mode).alias("activeNavigationMode"), F.col("seed").alias("collisionSeed"), F.col("spawn").alias("playerSpawn")), {"ignoreNullFields": "false"})
    meta = json.dumps({"dims": list(box.dims), "format": FORMAT, "origin": list(box.low), "voxel_size": box.size})
    file = lambda path, text: scenes.select("name", F.lit(path).alias("path"), text.cast("binary").alias("bytes"))
    return file(SESSION, session).union(file(META, F.lit(meta)))


def zipped(files: DataFrame) -> DataFrame:
    """files (name, path, bytes) -> (name, content): a compressed archive a pack, without empty files."""
    return archived(files.filter(F.octet_length("bytes") > 0), compressed=True)


def checksums(files: DataFrame) -> DataFrame:
    return files.select("name", "path", F.octet_length("bytes").cast("bigint").alias("length"), F.crc32("bytes").alias("crc32"))


def parsed(archives: DataFrame, formats: tuple[str, ...] = (FORMAT,)) -> DataFrame:
    """archives (name, content) -> what judged() gives of their files."""
    return judged(members(archives).select("name", "path", F.octet_length("bytes").cast("bigint").alias("length"), F.col("bytes").cast("string").alias("text")), formats)


def judged(files: DataFrame, formats: tuple[str, ...] = (FORMAT,)) -> DataFrame:
    """files (name, path, length, text) of packs -> a row for each pack: name, files, version, mode, dims, voxel_size, has_volume, has_navmesh, active_mode, and error:
    why it can't be used, null if it can; formats: names of the volume's format that are understood. Folders in paths don't count; of two files of a name the last counts."""
    files = files.select("name", F.element_at(F.split(F.regexp_replace("path", r"\\", "/"), "/"), -1).alias("file"), "length", "text")
    text = lambda path: F.max(F.when(F.col("file") == path, F.col("text")))
    there = lambda path: F.max(F.when(F.col("file") == path, F.col("length") > 0))
    rows = files.groupBy("name").agg(F.countDistinct("file").alias("files"), text(SESSION).alias("session"), text(META).alias("meta"), *(F.coalesce(there(p), F.lit(False)).alias(n) for n, p in (("solid", SOLID), ("nav", NAV), ("navmesh", NAVMESH))))
    rows = rows.withColumn("s", F.from_json("session", "version int, locomotionMode string, activeNavigationMode string")).withColumn("m", F.from_json("meta", "dims array<int>, format string, voxel_size double"))
    volume = F.col("meta").isNotNull() & F.col("solid") & F.col("nav")
    bad = F.when(F.col("session").isNull(), "no session").when(F.col("s.version").isNull() | (F.col("s.version") != 1), "unknown session").when(~F.coalesce(F.col("s.locomotionMode").isin(*MODES), F.lit(False)), "unknown mode")
    bad = bad.when(~volume & ~F.col("navmesh"), "neither volume nor mesh").when(volume & (~F.coalesce(F.col("m.format"), F.lit("")).isin(*formats)), "unknown volume").when(volume & ((F.coalesce(F.size("m.dims"), F.lit(0)) != 3) | F.col("m.voxel_size").isNull()), "no grid")
    active = F.when(volume & F.col("navmesh"), "recast_and_voxel_mesh").when(volume, "voxel_mesh").when(~F.col("navmesh") & (F.col("s.locomotionMode") == MODES[0]), "voxel_mesh").otherwise("recast")
    return rows.select("name", "files", F.col("s.version").alias("version"), F.col("s.locomotionMode").alias("mode"), F.col("m.dims").alias("dims"), F.col("m.voxel_size").alias("voxel_size"), volume.alias("has_volume"), F.col("navmesh").alias("has_navmesh"), active.alias("active_mode"), bad.alias("error"))


def _mesh_size(data: bytes) -> tuple[int, int]:
    meta = json.loads(data[20 : 20 + int.from_bytes(data[12:16], "little")])
    return meta["accessors"][0]["count"], meta["accessors"][1]["count"] // 3


CONTENTS = pa.schema([("name", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("text", pa.string()), *((n, pa.int64()) for n in ("vertices", "triangles", "voxels", *(f"sum_{v}" for v in V.AXES)))])


def contents(archives: DataFrame, box: V.Box) -> DataFrame:
    """archives (name, content) -> a row for each of their files: name, path, length, text of what is JSON, vertices and triangles of binary meshes, of masks
    the voxels and the sums of their vx, vy and vz. Each archive is unpacked once, and no file leaves the task that unpacks it."""
    dx, dy, dz = box.dims

    def row(name: str, path: str, data: bytes) -> dict:
        out = {"name": name, "path": path, "length": len(data)}
        if path.endswith(".json"):
            out["text"] = data.decode()
        elif path.endswith(".glb"):
            out["vertices"], out["triangles"] = _mesh_size(data)
        elif path in (SOLID, NAV):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: dx * dy * dz])
            out |= {"voxels": len(at)} | {f"sum_{v}": int(of.sum()) for v, of in zip(V.AXES, (at % dx, at // (dx * dz), at // dx % dz), strict=True)}
        return out

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    yield pa.RecordBatch.from_pylist([row(name, i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()], CONTENTS)

    return archives.select("name", "content").mapInArrow(run, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in CONTENTS))


def mesh_counts(files: DataFrame) -> DataFrame:
    """name, path, vertices, triangles of binary meshes, as their descriptions say."""
    schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("vertices", pa.int64()), ("triangles", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for name, path, data in zip(batch["name"].to_pylist(), batch["path"].to_pylist(), batch["bytes"].to_pylist(), strict=True):
                vertices, triangles = _mesh_size(data)
                out.append({"name": name, "path": path, "vertices": vertices, "triangles": triangles})
            yield pa.RecordBatch.from_pylist(out, schema)

    return files.select("name", "path", "bytes").mapInArrow(run, "name string, path string, vertices bigint, triangles bigint")
