"""The manifest of a bundle: its files and the tree of boxes over its chunks as one JSON text, written from rows and read into rows.

The text is made from the leaves up, a join for each depth, so that no task holds more than the part of the tree below its node."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.slicing import lod_tree
from cairn.sources.tables import staged

#: The file's name and its version.
NAME, VERSION = "lod-meta.json", 1
SAMPLE = 8
URL = r"^([hH][tT][tT][pP][sS]?)://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _bound() -> Column:
    return F.to_json(F.struct(*(F.array(*(F.col(f"{n}_{c}") for c in "xyz")).alias(n) for n in ("min", "max"))))


def written(leaf: DataFrame, files: DataFrame) -> DataFrame:
    """leaf (chunk, rows, min_x .. max_z) and files (file, path, level, chunk, rows) -> one row: text. Without leaves there is none."""
    tree = staged(lod_tree(leaf), "tree")
    refs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("level").cast("string").alias("level"), F.struct("file", F.lit(0).alias("offset"), F.col("rows").alias("count")).alias("at")))))
    lods = files.groupBy("chunk").agg(F.to_json(refs).alias("lods"))
    own = tree.withColumn("bound", _bound()).select("node_id", "depth", "chunks", "first", "bound")
    ends = own.filter("chunks = 1").join(lods.withColumnRenamed("chunk", "first"), "first").select("node_id", "depth", F.concat(F.lit('{"bound":'), "bound", F.lit(',"lods":'), "lods", F.lit("}")).alias("text"))
    inner = own.filter("chunks > 1").select("node_id", "depth", "bound")
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return tree.sparkSession.createDataFrame([], "text string")
    below = staged(ends.filter(F.col("depth") == deepest), "texts")
    for depth in range(deepest - 1, -1, -1):
        pairs = below.groupBy(F.floor(F.col("node_id") / 2).alias("node_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("node_id", "text")))["text"], ",").alias("children"))
        here = inner.filter(F.col("depth") == depth).join(pairs, "node_id")
        here = here.select("node_id", F.lit(depth).alias("depth"), F.concat(F.lit('{"bound":'), "bound", F.lit(',"children":['), "children", F.lit("]}")).alias("text"))
        below = staged(here.union(ends.filter(F.col("depth") == depth)), "texts")
    names = files.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("file", "path"))), lambda x: x["path"])).alias("filenames"), (F.max("level") + 1).alias("levels"))
    counts = files.groupBy("level").agg(F.sum("rows").alias("rows")).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "rows"))), lambda x: x["rows"]).alias("counts"))
    one = F.lit(1).alias("one")
    whole = below.select("text", one).join(names.select("*", one), "one").join(counts.select("*", one), "one")
    head = F.concat(F.lit(f'{{"version":{VERSION},"lodLevels":'), F.col("levels").cast("string"), F.lit(',"count":'), F.get("counts", F.lit(0)).cast("string"), F.lit(',"counts":'), F.to_json("counts"), F.lit(',"filenames":'), "filenames", F.lit(',"tree":'))
    return whole.select(F.concat(head, "text", F.lit("}")).alias("text"))


def refusal(text: str | None) -> str | None:
    """Why a text is no manifest, None if it is one."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return "no JSON"
    if not isinstance(data, dict):
        return "no object"
    if not isinstance(data.get("filenames"), list):
        return "older schema" if isinstance(data.get("levels"), list) or isinstance(data.get("lods"), list) else "no files"
    if not isinstance(data.get("lodLevels"), int) or data["lodLevels"] < 1:
        return "no levels"
    return None if isinstance(data.get("tree"), dict) and "bound" in data["tree"] else "no tree"


SPATIAL, GLOBAL = re.compile(r"\d+_\d+/meta\.json"), re.compile(r"lod\d+/meta\.json", re.I)


def layout_fault(text: str, extent: float = 16.0) -> str | None:
    """Why a manifest's chunks aren't cut in space, None if they are: no files, levels as whole files, other names, or one leaf for a scene of 1.5 extents or more."""
    data = json.loads(text)
    files = data["filenames"]
    if not files:
        return "no files"
    if not all(SPATIAL.fullmatch(f) for f in files):
        return "whole levels" if all(GLOBAL.fullmatch(f) for f in files) else "other names"
    bound = data["tree"].get("bound") or {}
    span = max((abs(b - a) for a, b in zip(bound.get("min") or (), bound.get("max") or (), strict=False)), default=0.0)
    return "one leaf" if span > 1.5 * extent and not data["tree"].get("children") else None


def rooted(files: DataFrame) -> DataFrame:
    """files (name, path, ...) of bundles with their paths below the folder that holds the manifest, the first by path; folders and empty paths go."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"(^|/)(\./)+", "$1"), r"^/+|(?<=/)/+", "")
    own = files.withColumn("path", path).filter((F.col("path") != "") & ~F.col("path").endswith("/"))
    root = own.filter((F.col("path") == NAME) | F.col("path").endswith(f"/{NAME}")).groupBy(F.col("name").alias("of")).agg(F.min("path").alias("manifest"))
    found = own.join(root, F.col("name").eqNullSafe(F.col("of")), "left")
    prefix = F.coalesce(F.expr(f"left(manifest, length(manifest) - {len(NAME)})"), F.lit(""))
    below = F.when((prefix != "") & F.col("path").startswith(prefix), F.substring(F.col("path"), F.length(prefix) + 1, F.length("path"))).otherwise(F.col("path"))
    return found.withColumn("path", below).select(*files.columns)


def _ends(node: dict) -> Iterator[dict]:
    """The nodes without children, in order; no deeper recursion than a list holds."""
    todo = [node]
    while todo:
        at = todo.pop()
        if at.get("children"):
            todo += at["children"][::-1]
        else:
            yield at


SUMMARY = pa.schema([("name", pa.string()), ("refused", pa.string()), ("levels", pa.int64()), ("files", pa.int64()), ("sample", pa.list_(pa.string())), ("leaves", pa.int64()), ("rows", pa.int64())])


def summaries(texts: DataFrame) -> DataFrame:
    """texts (name, text) -> name, refused (why it is no manifest, else null), levels, files, sample (the first eight files), leaves, rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                row = {"name": name, "refused": refusal(text)}
                if row["refused"] is None:
                    data = json.loads(text)
                    row |= {"levels": data["lodLevels"], "files": len(data["filenames"]), "sample": data["filenames"][:SAMPLE], "leaves": sum("lods" in n for n in _ends(data["tree"])), "rows": data.get("count")}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, SUMMARY)

    return texts.select("name", "text").mapInArrow(run, "name string, refused string, levels bigint, files bigint, sample array<string>, leaves bigint, rows bigint")


LEAVES = pa.schema([("name", pa.string()), ("leaf", pa.int64()), ("level", pa.int32()), ("path", pa.string()), ("rows", pa.int64()), *((f"{n}_{c}", pa.float64()) for n in ("min", "max") for c in "xyz")])


def leaves(texts: DataFrame) -> DataFrame:
    """texts (name, text) of manifests -> a row for each leaf and level: name, leaf (its place in the tree), level, path, rows and box. Others give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if refusal(text) is not None:
                    continue
                data, out = json.loads(text), []
                for i, node in enumerate(_ends(data["tree"])):
                    box = {f"{n}_{c}": float(v) for n in ("min", "max") for c, v in zip("xyz", node["bound"][n], strict=True)}
                    for level, at in (node.get("lods") or {}).items():
                        out.append({"name": name, "leaf": i, "level": int(level), "path": data["filenames"][at["file"]], "rows": at["count"]} | box)
                for i in range(0, len(out), 4096):
                    yield pa.RecordBatch.from_pylist(out[i : i + 4096], LEAVES)

    return texts.select("name", "text").mapInArrow(run, "name string, leaf bigint, level int, path string, rows bigint, " + ", ".join(f"{n}_{c} double" for n in ("min", "max") for c in "xyz"))


def resolved_url(url: Column) -> Column:
    """The address of a manifest: the given one, or the file's name put behind that of a folder; null for what is no web address."""
    own = F.trim(url)
    part = lambda i: F.regexp_extract(own, URL, i)
    path = part(3)
    full = F.when(F.lower(path).endswith(NAME), path).otherwise(F.concat(F.regexp_replace(path, "/$", ""), F.lit(f"/{NAME}")))
    return F.when(own.rlike(URL), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), full, part(4), part(5)))


def is_manifest_url(url: Column) -> Column:
    """Whether an address names a manifest itself."""
    own = F.trim(url)
    return F.coalesce(own.rlike(URL) & F.lower(F.regexp_extract(own, URL, 3)).endswith(NAME), F.lit(False))
