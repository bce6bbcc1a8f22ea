"""Helpers that the operators share: byte-level numpy routines that work on whole Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.tables import discard, new_folder, staged, table  # noqa: F401

U64 = np.uint64
#: Bytes of text that a task works on at a time; numpy temporaries are a few dozen times that.
SLICE_BYTES = 1 << 20
#: Bytes of rows that Spark hands to Python in one Arrow batch (a longer row stands alone); its own bound is 64 MB, and a task holds several batches.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have BATCH_BYTES at most. The setting stays, as the plan is run only after the operator has
    returned it; a smaller one of the caller is left as it is."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))  # such as 64m or 67108864b
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Gives the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only some C libraries have it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives the memory that it has freed back to the system: it serves one stage after the other, and the
    allocators of all would add up."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def id_bucket(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(U64, copy=True)
    x += U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array as one uint8 array, and its offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of a batch with about `size` bytes of the column each (a longer value stands alone), with their bytes and offsets."""
    buf, off = raw(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), buf[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    lut = np.zeros(256, bool)
    for a, b in ranges:
        lut[a : b + 1] = True
    return lut


#: White space 0x20, 0x09-0x0D; and all ASCII but letters and digits.
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of non-separators; runs end with their document."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    tok = ~sep[buf]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = tok[:-1], tok[1:]
    cut = off[(off > 0) & (off < n)]
    before[cut], after[cut - 1] = False, False
    starts = np.flatnonzero(tok & ~before)
    ends = np.flatnonzero(tok & ~after) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


_P = 0x9E3779B97F4A7C55
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POW or len(_POW["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_P, -1, 1 << 64)
        for name, base in (("up", _P), ("down", inverse)):
            out = np.empty(size, U64)
            out[0] = 1
            done = 1
            while done < size:
                step = U64(pow(base, done, 1 << 64))
                out[done : 2 * done] = out[:done] * step
                done *= 2
            _POW[name] = out
    return _POW["up"], _POW["down"]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings buf[starts:ends] (polynomial in an odd base modulo 2**64, then mixed with the length)."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def arrow_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


# Columns that an operator hands on unread go under names of their own, so that they can't clash with its results.
def carried(names: tuple[str, ...]) -> list[Column]:
    return [F.col(c).alias(f"carried_{i}") for i, c in enumerate(names)]


def carried_sql(df: DataFrame) -> str:
    return "".join(f", {f.name} {f.dataType.simpleString()}" for f in df.schema if f.name.startswith("carried_"))


def with_carried(batch: pa.RecordBatch, source: pa.RecordBatch) -> pa.RecordBatch:
    more = [f for f in source.schema if f.name.startswith("carried_")]
    return pa.RecordBatch.from_arrays([*batch.columns, *(source[f.name] for f in more)], schema=pa.schema([*batch.schema, *more]))


def uncarried(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Gives carried columns their names back; a result of the same name goes."""
    own = [c for c in df.columns if not c.startswith("carried_") and c not in names]
    return df.select(*own, *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(names)))
