"""Chunks of splats as planes of bytes with a description, and back.

A chunk is what the slicer made of a bounded number of rows, so that a task encodes it whole. A plane has four bytes for each
splat in the chunk's order, row by row of its width, and zeros behind the last; positions are split in a plane of low and one
of high bytes, scales and colours are places in a codebook of the chunk, higher harmonics are labels of its palette. Planes are
kept as they are; an image codec around them is left to the writer of files."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.codec import nearest
from cairn.sources.tables import staged, with_ordinal

#: Fixed values of the format: its version, entries of a codebook, the widest plane, palette columns, and the tag of quaternions.
VERSION, ENTRIES, WIDEST, PALETTE_COLUMNS, QUATERNION = 2, 256, 8192, 64, 252
COEFFICIENTS = {0: 0, 1: 3, 2: 8, 3: 15}
FILES = pa.schema([("level", pa.int32()), ("chunk", pa.int64()), ("path", pa.string()), ("rows", pa.int64()), ("bytes", pa.binary())])
FILES_SQL = "level int, chunk bigint, path string, rows bigint, bytes binary"
LIST = pa.list_(pa.float64())
ROWS = pa.schema([("level", pa.int32()), ("chunk", pa.int64()), ("ordinal", pa.int64()), *((c, pa.float64()) for c in "xyz"), ("scale", LIST), ("rot", LIST), ("opacity", pa.float64()), ("f_dc", LIST), ("f_rest", LIST)])
ROWS_SQL = "level int, chunk bigint, ordinal bigint, x double, y double, z double, scale array<double>, rot array<double>, opacity double, f_dc array<double>, f_rest array<double>"


def plane_size(n: int) -> tuple[int, int]:
    width = max(min(n, WIDEST), 1)
    return width, max(-(-n // width), 1)


def plane(channels: list[np.ndarray | int], n: int, size: tuple[int, int] | None = None) -> bytes:
    """Four channels, splat by splat, with zeros up to the plane's end."""
    width, height = size or plane_size(n)
    out = np.zeros((width * height, 4), np.uint8)
    for i, c in enumerate(channels):
        out[:n, i] = c
    return out.tobytes()


def book_of(values: np.ndarray) -> np.ndarray:
    """Means of runs of equal counts of the sorted finite values, non-decreasing; zeros without values."""
    v = np.sort(values[np.isfinite(values)])
    if not len(v):
        return np.zeros(ENTRIES)
    start = np.arange(ENTRIES) * len(v) // ENTRIES
    many = np.maximum(np.diff(start, append=len(v)), 1)  # runs that would be empty are of the value at their start
    if many.max() >= 8:
        return np.maximum.accumulate([v[a : a + n].mean() for a, n in zip(start, many, strict=True)])
    total = v[start]  # short runs side by side, each added up in its order as mean() does
    for j in range(1, many.max()):
        more = np.flatnonzero(many > j)
        total[more] += v[start[more] + j]
    return np.maximum.accumulate(total / many)


def places(book: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The nearest entry of each value, the lower of two; not finite counts as 0."""
    v = np.where(np.isfinite(values), values, 0.0)
    high = np.searchsorted(book, v, "left")
    low, high = np.maximum(high - 1, 0), np.minimum(high, len(book) - 1)
    return np.where(np.abs(book[high] - v) < np.abs(v - book[low]), high, low)


def packed_rotations(rot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rotations (w, x, y, z) the three bytes besides the largest of (x, y, z, w), and which that is."""
    q = rot[:, [1, 2, 3, 0]]
    size = np.sqrt((q * q).sum(axis=1, keepdims=True))
    q = np.where(size > 0, q / np.where(size > 0, size, 1.0), [0.0, 0.0, 0.0, 1.0])
    mode = np.abs(q).argmax(axis=1)
    q = q * np.where(q[np.arange(len(q)), mode] < 0, -1.0, 1.0)[:, None]
    rest = np.array([[i for i in range(4) if i != m] for m in range(4)])[mode]
    out = np.take_along_axis(q, rest, axis=1) * math.sqrt(2) / 2 + 0.5
    return np.clip(np.floor(out * 255 + 0.5), 0, 255).astype(np.uint8), mode


def unpacked_rotations(three: np.ndarray, mode: np.ndarray) -> np.ndarray:
    part = (three / 255.0 - 0.5) * 2 / math.sqrt(2)
    largest = np.sqrt(np.maximum(1 - (part * part).sum(axis=1), 0.0))
    rest = np.array([[i for i in range(4) if i != m] for m in range(4)])[mode]
    q = np.zeros((len(part), 4))
    np.put_along_axis(q, rest, part, axis=1)
    q[np.arange(len(q)), mode] = largest
    return q[:, [3, 0, 1, 2]]


def palette_of(vectors: np.ndarray, clusters: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's centroids from evenly spaced rows, learned on all rows, and each row's label; empty clusters stay put."""
    clusters = min(max(clusters, 1), 1 << 16, len(vectors))
    centroids = vectors[np.arange(clusters) * len(vectors) // clusters].copy()
    for _ in range(max(rounds, 1)):
        label = nearest(centroids, vectors)
        count = np.bincount(label, minlength=clusters)
        for i in range(vectors.shape[1]):
            total = np.bincount(label, vectors[:, i], minlength=clusters)
            centroids[:, i] = np.where(count > 0, total / np.maximum(count, 1), centroids[:, i])
    return centroids, nearest(centroids, vectors)


def encoded_chunk(xyz: np.ndarray, scale: np.ndarray, rot: np.ndarray, opacity: np.ndarray, colour: np.ndarray, rest: np.ndarray, degree: int, clusters: int, rounds: int) -> dict[str, bytes]:
    """The files of a chunk: its description and its planes."""
    n = len(xyz)
    logs = np.sign(xyz) * np.log(1.0 + np.abs(xyz))
    low = np.where(np.isfinite(logs), logs, np.inf).min(axis=0)
    high = np.where(np.isfinite(logs), logs, -np.inf).max(axis=0)
    low = np.where(np.isfinite(low), low, 0.0)
    high = np.where(np.isfinite(high) & (high > low), high, low + 1.0)
    q = np.floor(np.clip(np.nan_to_num((logs - low) / (high - low)), 0.0, 1.0) * 65535.0 + 0.5).astype(np.int64)
    sizes, tones = book_of(scale.reshape(-1)), book_of(colour.reshape(-1))
    three, mode = packed_rotations(rot)
    alpha = np.clip(np.floor(255.0 / (1.0 + np.exp(-opacity)) + 0.5), 0, 255)
    files = {
        "means_l": plane([*(q & 255).T, 255], n), "means_u": plane([*(q >> 8).T, 255], n), "scales": plane([*places(sizes, scale).T, 255], n),
        "quats": plane([*three.T, QUATERNION + mode], n), "sh0": plane([*places(tones, colour).T, alpha], n),
    }
    section = lambda shape, kind, coding, *names, **more: {"shape": shape, "dtype": kind} | more | {"encoding": coding, "files": list(names)}
    meta = {
        "version": VERSION, "count": n, "means": section([n, 3], "uint16", "log-quantized", "means_l", "means_u", mins=low.tolist(), maxs=high.tolist()),
        "scales": section([n, 3], "uint8", "codebook", "scales", codebook=sizes.tolist()), "quats": section([n, 4], "uint8", "quaternion-packed", "quats"), "sh0": section([n, 4], "uint8", "codebook", "sh0", codebook=tones.tolist()),
    }
    own = next(d for d, c in COEFFICIENTS.items() if rest.shape[1] == 3 * c)
    degree = min(degree, own)
    many = COEFFICIENTS[degree]
    if many:
        # Coefficient by coefficient instead of channel by channel.
        vectors = rest.reshape(n, 3, COEFFICIENTS[own])[:, :, :many].transpose(0, 2, 1).reshape(n, 3 * many)
        centroids, label = palette_of(vectors, clusters, rounds)
        book = book_of(centroids.reshape(-1))
        width, height = PALETTE_COLUMNS * many, max(-(-len(centroids) // PALETTE_COLUMNS), 1)
        texel = np.zeros((height * PALETTE_COLUMNS, many, 4), np.uint8)
        texel[: len(centroids), :, :3] = places(book, centroids).reshape(-1, many, 3)
        texel[: len(centroids), :, 3] = 255
        files |= {"shN_centroids": texel.tobytes(), "shN_labels": plane([label & 255, label >> 8, 0, 255], n)}
        meta["shN"] = section([n, 3 * many], "uint8", "kmeans-codebook", "shN_centroids", "shN_labels", codebook=book.tolist(), bands=degree, palette=[width, height])
    return {"meta.json": json.dumps(meta, separators=(",", ":")).encode()} | files


def decoded_chunk(files: dict[str, bytes]) -> dict[str, np.ndarray]:
    """The splats of encoded_chunk()'s files, in their order."""
    meta = json.loads(files["meta.json"])
    n = meta["count"]
    flat = lambda name: np.frombuffer(files[name], np.uint8).reshape(-1, 4)[:n]
    low, high = (np.array(meta["means"][k]) for k in ("mins", "maxs"))
    q = flat("means_l")[:, :3].astype(np.int64) | flat("means_u")[:, :3].astype(np.int64) << 8
    logs = low + q / 65535.0 * (high - low)
    quats, sh0 = flat("quats"), flat("sh0")
    tones = np.array(meta["sh0"]["codebook"])
    rest = np.zeros((n, 0))
    if "shN" in meta:
        many = COEFFICIENTS[meta["shN"]["bands"]]
        label = flat("shN_labels").astype(np.int64)
        texel = np.frombuffer(files["shN_centroids"], np.uint8).reshape(-1, many, 4)[:, :, :3]
        rest = np.array(meta["shN"]["codebook"])[texel[label[:, 0] | label[:, 1] << 8]].transpose(0, 2, 1).reshape(n, 3 * many)
    return {
        "xyz": np.sign(logs) * np.expm1(np.abs(logs)), "scale": np.array(meta["scales"]["codebook"])[flat("scales")[:, :3]], "rot": unpacked_rotations(quats[:, :3], quats[:, 3].astype(np.int64) - QUATERNION),
        "alpha": sh0[:, 3] / 255.0, "f_dc": tones[sh0[:, :3]], "f_rest": rest,
    }


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, which stand behind each other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch[c].to_numpy() for c in keys]).astype(np.int64)
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own = k[:, a].tolist()
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def encoded(splats: DataFrame, degree: int = 0, clusters: int = 4096, rounds: int = 10) -> DataFrame:
    """Splats (level, chunk, place, x, y, z, scale, rot, opacity, f_dc, f_rest) -> the files (level, chunk, path, rows, bytes) of each chunk, its splats in
    the order of place. opacity is a logit; arrays are of 3, 4, 3 and 0, 9, 24 or 45 values. A chunk's rows must fit a task."""

    def files_of(rows: pa.Table) -> pa.RecordBatch:
        n = len(rows)
        level, chunk = rows["level"][0].as_py(), rows["chunk"][0].as_py()
        xyz = np.stack([rows[c].to_numpy() for c in "xyz"], axis=1).astype(np.float64)
        files = encoded_chunk(xyz, *(_matrix(rows[c], n) for c in ("scale", "rot")), rows["opacity"].to_numpy().astype(np.float64), _matrix(rows["f_dc"], n), _matrix(rows["f_rest"], n), degree, clusters, rounds)
        return pa.record_batch([pa.array([level] * len(files), pa.int32()), pa.array([chunk] * len(files)), [f"{level}_{chunk}/{f}" for f in files], pa.array([n] * len(files)), pa.array(list(files.values()), pa.binary())], schema=FILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ("level", "chunk")):
            yield files_of(rows)

    own = splats.select(F.col("level").cast("int").alias("level"), F.col("chunk").cast("bigint").alias("chunk"), "place", *"xyz", "scale", "rot", "opacity", "f_dc", "f_rest")
    return own.repartition("level", "chunk").sortWithinPartitions("level", "chunk", "place").mapInArrow(run, FILES_SQL)  # a group for each chunk would cost more than its encoding


def decoded(files: DataFrame) -> DataFrame:
    """The files of chunks -> their splats: level, chunk, ordinal (the place in the chunk), x, y, z, scale, rot, opacity (a logit, alpha within 1/510 of 0 and 1), f_dc, f_rest."""

    def lists(m: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.reshape(-1), pa.float64()))

    def run(rows: pa.Table) -> pa.Table:
        level, chunk = rows["level"][0].as_py(), rows["chunk"][0].as_py()
        got = decoded_chunk({p.rpartition("/")[2]: b for p, b in zip(rows["path"].to_pylist(), rows["bytes"].to_pylist(), strict=True)})
        n = len(got["xyz"])
        alpha = np.clip(got["alpha"], 1 / 510, 1 - 1 / 510)
        columns = [pa.array([level] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(c)) for c in got["xyz"].T)]
        return pa.table([*columns, lists(got["scale"]), lists(got["rot"]), pa.array(np.log(alpha / (1 - alpha))), lists(got["f_dc"]), lists(got["f_rest"])], schema=ROWS)

    return files.select("level", "chunk", "path", "bytes").groupBy("level", "chunk").applyInArrow(run, ROWS_SQL)


def index(files: DataFrame) -> DataFrame:
    """file (a dense number, level by level), path, level, chunk, rows of each chunk's description: what a bundle's manifest lists."""
    own = files.filter(F.col("path").endswith("/meta.json")).select("path", "level", "chunk", "rows")
    own = staged(own, "descriptions")  # a range sort reads its input twice, and would have all chunks encoded again
    return with_ordinal(own, ["level", "chunk"], "file")
