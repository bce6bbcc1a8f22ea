"""Splat files: PLY, 32-byte .splat records, packed clouds (.spz), stored zip archives and binary meshes.

Files come in as Spark's binary files and go out as rows of (name, content), of bounded size each."""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import new_folder

#: The zeroth harmonic; fields of a .splat record; types of PLY properties.
SH_C0 = 0.28209479177387814
RECORD = np.dtype([("position", "<f4", 3), ("scale", "<f4", 3), ("colour", "u1", 4), ("rotation", "u1", 4)])
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
#: Fixed values of packed clouds: the header, its magic number, and by degree the number of higher coefficients.
PACKED_HEADER, PACKED_MAGIC, PACKED_COEFFICIENTS = struct.Struct("<4sIIBBBB"), b"NGSP", (0, 3, 8, 15)
PACKED_BITS = 12
FLOATS = pa.list_(pa.float32())
FULL = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), *((c, pa.float32()) for c in "xyz"), ("scale", FLOATS), ("rot", FLOATS), ("opacity", pa.float32()), ("f_dc", FLOATS), ("f_rest", FLOATS)])
FULL_SQL = "file string, ordinal bigint, x float, y float, z float, scale array<float>, rot array<float>, opacity float, f_dc array<float>, f_rest array<float>"
NAV = pa.schema([("file", pa.string()), ("ordinal", pa.int64()), *((c, pa.float64()) for c in ("x", "y", "z", "nx", "ny", "nz", "sx", "sy", "sz", "opacity"))])
NAV_SQL = "file string, ordinal bigint, " + ", ".join(f"{c} double" for c in NAV.names[2:])


class InvalidSplats(ValueError):
    """A file that isn't what its name says."""


def ply_vertices(data: bytes) -> np.ndarray:
    """The vertex element of an ASCII or binary PLY as a structured array. List properties of vertices aren't supported."""
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0:
        raise InvalidSplats("no PLY header")
    body = data.index(b"\n", end) + 1
    kind, elements = "", []
    for line in data[:end].decode("ascii", "replace").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            kind = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            if word[1] == "list":
                elements[-1][2].append((word[4], None))
            else:
                elements[-1][2].append((word[2], PLY_TYPES[word[1]]))
    if not any(e[0] == "vertex" for e in elements):
        raise InvalidSplats("no vertex element")
    at = body
    for name, n, properties in elements:
        if any(t is None for _, t in properties):
            raise InvalidSplats(f"list property before or in the vertices: {name}")
        if kind == "ascii":
            lines = data[at:].split(b"\n", n)
            rows, at = lines[:n], len(data) - len(lines[n]) if len(lines) > n else len(data)
            if name == "vertex":
                out = np.zeros(n, [(p, t) for p, t in properties])
                table = np.array([r.split()[: len(properties)] for r in rows], np.float64).reshape(n, len(properties))
                for i, (p, _) in enumerate(properties):
                    out[p] = table[:, i]
                return out
            continue
        order = ">" if "big" in kind else "<"
        kinds = np.dtype([(p, order + t) for p, t in properties])
        if name == "vertex":
            if len(data) - at < n * kinds.itemsize:
                raise InvalidSplats("fewer vertices than declared")
            return np.frombuffer(data, kinds, n, at)
        at += n * kinds.itemsize
    raise InvalidSplats("no vertex element")


def _column(v: np.ndarray, names: tuple[str, ...], default: float, floats_only: bool) -> np.ndarray:
    """The first of the properties that is there; the navigation reader takes 32-bit floats only."""
    for n in names:
        if n in (v.dtype.names or ()) and (not floats_only or v.dtype[n].kind == "f" and v.dtype[n].itemsize == 4):
            return v[n].astype(np.float64)
    return np.full(len(v), default)


def nav_points(v: np.ndarray) -> dict[str, np.ndarray]:
    """Positions, normals (local z turned by the rotation), scales and opacity as stored; absent: no rotation, 0.1 and 1."""
    get = lambda d, *n: _column(v, n, d, True)
    w, x, y, z = get(1.0, "rot_0"), get(0.0, "rot_1"), get(0.0, "rot_2"), get(0.0, "rot_3")
    normal = {"nx": 2 * (x * z + y * w), "ny": 2 * (y * z - x * w), "nz": 1 - 2 * (x * x + y * y)}
    return {c: get(0.0, c) for c in "xyz"} | normal | {f"s{c}": get(0.1, f"scale_{i}") for i, c in enumerate("xyz")} | {"opacity": get(1.0, "opacity", "alpha", "scalar_opacity")}


def _lists(columns: list[np.ndarray], n: int) -> pa.Array:
    flat = np.stack(columns, axis=1).astype(np.float32) if columns else np.zeros((n, 0), np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1)))


def full_cloud(v: np.ndarray) -> dict[str, pa.Array]:
    """All properties; f_rest has 0, 9, 24 or 45 values, channel by channel."""
    get = lambda d, *n: _column(v, n, d, False)
    rest = sorted((c for c in v.dtype.names or () if c.startswith("f_rest_")), key=lambda c: int(c[7:]))
    many = {0: 0, 3: 9, 8: 24}.get(len(rest) // 3, 45)
    rest_columns = [get(0.0, f"f_rest_{i}") for i in range(many)]
    one = {c: pa.array(get(0.0, c).astype(np.float32)) for c in ("x", "y", "z", "opacity")}
    return one | {"scale": _lists([get(0.0, f"scale_{i}") for i in range(3)], len(v)), "rot": _lists([get(float(i == 0), f"rot_{i}") for i in range(4)], len(v)), "f_dc": _lists([get(0.0, f"f_dc_{i}") for i in range(3)], len(v)), "f_rest": _lists(rest_columns, len(v))}


def splat_records(data: bytes) -> dict[str, pa.Array]:
    """The records of a .splat file: logarithmic scales, colours as the zeroth harmonic, opacity as logit, unit rotations."""
    if not data or len(data) % RECORD.itemsize:
        raise InvalidSplats(f"length {len(data)} is not a positive multiple of {RECORD.itemsize}")
    r = np.frombuffer(data, RECORD)
    alpha = np.clip(r["colour"][:, 3] / np.float32(255), 1e-6, 1 - 1e-6)
    q = (r["rotation"].astype(np.float64) - 128) / 128
    norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
    q = np.where(norm > 1e-9, q / np.maximum(norm, 1e-9), [1.0, 0.0, 0.0, 0.0])
    columns = lambda m: _lists(list(m.T), len(r))
    own = {c: pa.array(np.ascontiguousarray(r["position"][:, i])) for i, c in enumerate("xyz")}
    return own | {"scale": columns(np.log(np.maximum(r["scale"], np.float32(1e-9)))), "rot": columns(q), "opacity": pa.array(np.log(alpha / (1 - alpha)).astype(np.float32)), "f_dc": columns((r["colour"][:, :3] / 255.0 - 0.5) / SH_C0), "f_rest": _lists([], len(r))}


def packed_arrays(data: bytes) -> dict[str, np.ndarray]:
    """The arrays of a packed cloud (versions 2 and 3), compressed or not: xyz, scale, rot (w, x, y, z), alpha (0 to 1), f_dc, f_rest (channel by
    channel). Each property stands for all splats before the next begins."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) < PACKED_HEADER.size or data[:4] != PACKED_MAGIC:
        raise InvalidSplats("no packed cloud")
    _, version, n, degree, bits, _, _ = PACKED_HEADER.unpack_from(data)
    if version not in (2, 3) or degree >= len(PACKED_COEFFICIENTS):
        raise InvalidSplats(f"version {version}, degree {degree}")
    many, at = PACKED_COEFFICIENTS[degree], PACKED_HEADER.size
    wide = 4 if version == 3 else 3
    if len(data) - at < n * (9 + 1 + 3 + 3 + wide + 3 * many):
        raise InvalidSplats("fewer splats than declared")

    def part(width: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        return out

    fixed = part(9).reshape(n, 3, 3).astype(np.int64)
    fixed = fixed[:, :, 0] | fixed[:, :, 1] << 8 | fixed[:, :, 2] << 16
    alpha, colour, scale, turn = part(1)[:, 0] / 255.0, part(3), part(3), part(wide)
    if version == 2:
        three = turn / 127.5 - 1.0
        rot = np.concatenate((np.sqrt(np.maximum(1.0 - (three * three).sum(axis=1, keepdims=True), 0.0)), three), axis=1)
    else:
        rot = _smallest_three(np.ascontiguousarray(turn).view("<u4")[:, 0])
    rest = (part(3 * many).reshape(n, many, 3).astype(np.float64) - 128.0) / 128.0
    return {
        "xyz": (fixed - ((fixed & 0x800000) << 1)) / float(1 << bits), "scale": scale / 16.0 - 10.0, "rot": rot, "alpha": alpha,
        "f_dc": (colour / 255.0 - 0.5) / SH_C0, "f_rest": rest.transpose(0, 2, 1).reshape(n, 3 * many),
    }


def _smallest_three(word: np.ndarray) -> np.ndarray:
    """Rotations (w, x, y, z) from words with the place of the largest of (x, y, z, w) in two bits and, from the last of the others on, ten bits each."""
    word = word.astype(np.int64)
    largest, q = word >> 30, np.zeros((len(word), 4))
    for i in range(3, -1, -1):
        other = largest != i
        value = (word & 511) / 511.0 * np.sqrt(0.5) * np.where(word >> 9 & 1, -1.0, 1.0)
        q[other, i] = value[other]
        word = np.where(other, word >> 10, word)
    q[np.arange(len(q)), largest] = np.sqrt(np.maximum(1.0 - (q * q).sum(axis=1), 0.0))
    return q[:, [3, 0, 1, 2]]


def packed_records(data: bytes) -> dict[str, pa.Array]:
    """A packed cloud as full splats; opacity as a logit, within a millionth of 0 and 1."""
    a = packed_arrays(data)
    alpha = np.clip(a["alpha"], 1e-6, 1 - 1e-6)
    own = {c: pa.array(a["xyz"][:, i].astype(np.float32)) for i, c in enumerate("xyz")}
    return own | {c: _lists(list(a[c].T), len(alpha)) for c in ("scale", "rot", "f_dc", "f_rest")} | {"opacity": pa.array(np.log(alpha / (1 - alpha)).astype(np.float32))}


def packed_points(data: bytes) -> dict[str, np.ndarray]:
    """Navigation points of a packed cloud, with scales and opacity as they are stored once unpacked: logarithms and a logit."""
    a = packed_arrays(data)
    w, x, y, z = a["rot"].T
    alpha = np.clip(a["alpha"], 1e-6, 1 - 1e-6)
    normal = {"nx": 2 * (x * z + y * w), "ny": 2 * (y * z - x * w), "nz": 1 - 2 * (x * x + y * y)}
    return {c: a["xyz"][:, i] for i, c in enumerate("xyz")} | normal | {f"s{c}": a["scale"][:, i] for i, c in enumerate("xyz")} | {"opacity": np.log(alpha / (1 - alpha))}


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as a row each, from their values side by side without an array for each row."""
    size = pc.list_value_length(lists)
    if lists.null_count or pc.min(size) != pc.max(size):
        raise InvalidSplats("lists of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1 if len(lists.flatten()) else 0)


def packed_bytes(rows: pa.RecordBatch) -> bytes:
    """A compressed packed cloud (version 2) of full splats: positions in steps of 1 / 4096 up to 2048, scales in steps of 1 / 16."""
    n = len(rows)
    stack = lambda c, k: _matrix(rows[c]).astype(np.float64) if n else np.zeros((0, k))
    byte = lambda v: np.clip(np.floor(v + 0.5), 0, 255).astype(np.uint8)
    rest = stack("f_rest", 0)
    degree = PACKED_COEFFICIENTS.index(rest.shape[1] // 3)
    at = np.stack([rows[c].to_numpy(zero_copy_only=False) for c in "xyz"], axis=1).astype(np.float64).reshape(n, 3)
    fixed = np.clip(np.floor(at * (1 << PACKED_BITS) + 0.5), -(1 << 23), (1 << 23) - 1).astype(np.int64) & 0xFFFFFF
    q = stack("rot", 4)
    size = np.sqrt((q * q).sum(axis=1, keepdims=True))
    q = np.where(size > 0, q / np.where(size > 0, size, 1.0), [1.0, 0.0, 0.0, 0.0])
    q = np.where(q[:, :1] < 0, -q, q)
    alpha = 1 / (1 + np.exp(-rows["opacity"].to_numpy(zero_copy_only=False).astype(np.float64)))
    parts = [
        np.stack([fixed & 255, fixed >> 8 & 255, fixed >> 16], axis=2).astype(np.uint8), byte(alpha * 255), byte((stack("f_dc", 3) * SH_C0 + 0.5) * 255), byte((stack("scale", 3) + 10) * 16),
        byte(q[:, 1:] * 127.5 + 127.5), byte(rest.reshape(n, 3, -1).transpose(0, 2, 1) * 128 + 128),
    ]
    return gzip.compress(PACKED_HEADER.pack(PACKED_MAGIC, 2, n, degree, PACKED_BITS, 0, 0) + b"".join(p.tobytes() for p in parts), mtime=0)


def _decode(name: str, data: bytes, full: bool) -> Iterator[pa.RecordBatch]:
    if name.lower().endswith(".splat"):
        if not full:
            raise InvalidSplats("navigation points come from PLY; convert .splat files first")
        columns = splat_records(data)
    elif data[:4] == PACKED_MAGIC or data[:2] == b"\x1f\x8b":
        columns = packed_records(data) if full else {c: pa.array(a) for c, a in packed_points(data).items()}
    else:
        v = ply_vertices(data)
        columns = full_cloud(v) if full else {c: pa.array(a) for c, a in nav_points(v).items()}
    schema = FULL if full else NAV
    n = len(columns["x"])
    whole = pa.table({"file": pa.array([name] * n, pa.string()), "ordinal": pa.array(np.arange(n))} | columns).select(schema.names).cast(schema)
    yield from whole.to_batches(max_chunksize=1 << 16)


def decoded(files: DataFrame, full: bool = False) -> DataFrame:
    """files (name, content) -> a row for each splat with its file and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"], strict=True):
                yield from _decode(name, content.as_py(), full)

    return files.select("name", "content").mapInArrow(run, FULL_SQL if full else NAV_SQL)


def read_splats(spark: SparkSession, path: str, full: bool = False) -> DataFrame:
    """Splats of the .ply, .splat and .spz files under a path; the extension of the file, or of the folder
    that write_ply() gives each, decides."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.col("path").alias("name"), "content").filter(F.lower("name").rlike(r"\.(ply|splat|spz)(/[^/]*)?$"))
    return decoded(named, full)


def ply_bytes(rows: pa.RecordBatch) -> bytes:
    """A binary PLY of full splats, with normals of zero."""
    n = len(rows)
    lists = {c: _matrix(rows[c]) if n else np.zeros((0, 0)) for c in ("scale", "rot", "f_dc", "f_rest")}
    names = ["x", "y", "z", "nx", "ny", "nz", *(f"f_dc_{i}" for i in range(3)), *(f"f_rest_{i}" for i in range(lists["f_rest"].shape[1])), "opacity", *(f"scale_{i}" for i in range(3)), *(f"rot_{i}" for i in range(4))]
    one = lambda c: rows[c].to_numpy(zero_copy_only=False).reshape(n, 1)
    body = np.concatenate([one("x"), one("y"), one("z"), np.zeros((n, 3)), lists["f_dc"], lists["f_rest"].reshape(n, -1), one("opacity"), lists["scale"], lists["rot"]], axis=1).astype("<f4")
    head = "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property float {c}" for c in names), "end_header", ""])
    return head.encode() + body.tobytes()


def splat_bytes(rows: pa.RecordBatch) -> bytes:
    """32-byte records of full splats of degree 0."""
    n = len(rows)
    out = np.zeros(n, RECORD)
    stack = lambda c: _matrix(rows[c]).astype(np.float64)
    if n:
        out["position"] = np.stack([rows[c].to_numpy(zero_copy_only=False) for c in "xyz"], axis=1)
        out["scale"] = np.exp(stack("scale"))
        alpha = 1 / (1 + np.exp(-rows["opacity"].to_numpy(zero_copy_only=False).astype(np.float64)))
        colour = np.concatenate((stack("f_dc") * SH_C0 + 0.5, alpha[:, None]), axis=1)
        out["colour"] = np.clip(np.floor(colour * 255 + 0.5), 0, 255)
        out["rotation"] = np.clip(np.floor(stack("rot") * 128 + 128 + 0.5), 0, 255)
    return out.tobytes()


def encoded(splats: DataFrame, kind: str = "ply", most: int = 1 << 16) -> DataFrame:
    """Full splats -> (name, content): files of up to `most` splats each, in the order of the rows within a partition."""
    write = {"ply": ply_bytes, "splat": splat_bytes, "spz": packed_bytes}[kind]
    schema = pa.schema([("name", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal k, held, rows
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            k, held, rows = k + 1, [], 0
            return pa.RecordBatch.from_pydict({"name": [f"part-{part:05d}-{k:05d}.{kind}"], "content": [write(whole)]}, schema)

        for batch in batches:
            for at in range(0, len(batch), most):
                piece = batch.slice(at, most)
                if rows + len(piece) > most:
                    yield flush()
                held, rows = [*held, piece], rows + len(piece)
        if rows:
            yield flush()

    return splats.mapInArrow(run, "name string, content binary")


def write_ply(splats: DataFrame) -> str:
    """PLY files under name=/ in a new shared folder. Spark's text sink ends each with a line feed, which lies past the declared vertices."""
    where = new_folder(splats.sparkSession, "ply")
    files = encoded(splats, "ply").select("name", F.col("content").cast("string").alias("value"))
    files.write.partitionBy("name").text(where)
    return where


def members(archives: DataFrame) -> DataFrame:
    """archives (name, content) -> name, path, bytes of each member of a zip archive in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("bytes", pa.binary())])
        for batch in batches:
            for name, content in zip(batch["name"].to_pylist(), batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pa.RecordBatch.from_pydict({"name": [name], "path": [info.filename], "bytes": [z.read(info)]}, schema)

    return archives.select("name", "content").mapInArrow(run, "name string, path string, bytes binary")


def packed(files: list[tuple[str, bytes]], compressed: bool = False) -> bytes:
    """A zip of (path, bytes), members in path order."""
    out, how = io.BytesIO(), zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED
    with zipfile.ZipFile(out, "w", how) as z:
        for path, data in sorted(files, key=lambda f: f[0]):
            z.writestr(zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0)), data or b"", how)
    return out.getvalue()


def archived(files: DataFrame, compressed: bool = False) -> DataFrame:
    """files (name, path, bytes) -> (name, content): a zip for each name, members in path order. An archive is one value, so that its members are bounded by 2 GB."""

    def run(rows: pa.Table) -> pa.Table:
        content = packed([*zip(rows["path"].to_pylist(), rows["bytes"].to_pylist(), strict=True)], compressed)
        return pa.table({"name": [rows["name"][0].as_py()], "content": pa.array([content], pa.binary())})

    return files.select("name", "path", "bytes").groupBy("name").applyInArrow(run, "name string, content binary")


def glb(positions: np.ndarray, indices: np.ndarray) -> bytes | None:
    """A binary glTF mesh of positions (n, 3) and triangles (m, 3); None if either is empty."""
    p, t = np.asarray(positions, "<f4").reshape(-1, 3), np.asarray(indices, "<u4").reshape(-1, 3)
    if not len(p) or not len(t):
        return None
    if t.max() >= len(p):
        raise InvalidSplats("an index beyond the vertices")
    body = p.tobytes() + t.tobytes()
    view = lambda at, n, target: {"buffer": 0, "byteOffset": at, "byteLength": n, "target": target}
    meta = {
        "asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": {"POSITION": 0}, "indices": 1, "mode": 4}]}],
        "buffers": [{"byteLength": len(body)}], "bufferViews": [view(0, p.nbytes, 34962), view(p.nbytes, t.nbytes, 34963)],
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": len(p), "type": "VEC3", "min": p.min(axis=0).tolist(), "max": p.max(axis=0).tolist()}, {"bufferView": 1, "componentType": 5125, "count": t.size, "type": "SCALAR"}],
    }
    text = json.dumps(meta, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\x00") + body
