"""Columns of chunk paths, manifests, grid budgets and regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(path: Column) -> Column:
    """The path without empty and `.` parts; `..` takes the part before it away."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    return F.array_join(kept, "/")


def directory_url(url: Column) -> Column:
    """A manifest's address without query, fragment and last part."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"[^/]*$", "")


def lod_index(path: Column) -> Column:
    """Level of detail named by the first part of a chunk's path, as in 3_0/meta.json; null for other paths."""
    return F.regexp_extract(F.get(F.split(normalized(path), "/"), F.lit(0)), r"^(\d+)_\d+$", 1).try_cast("int")


def resolved_lod(wanted: Column, levels: Column) -> Column:
    """Level for coarsest, finest, nav (the middle, finer of two) or a number within range; null for others."""
    last = F.greatest(levels - 1, F.lit(0))
    number = wanted.try_cast("int")
    named = F.when(wanted == "coarsest", last).when(wanted == "finest", 0).when(wanted == "nav", F.floor(last * 0.5))
    return F.coalesce(named, F.when(number.between(0, last), number)).cast("int")


def slug(label: Column) -> Column:
    """Short name of a source: of an address the first long hexadecimal part (12 characters) or else the last part but one (24), else the label
    without its extension (24); `scene` if nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(label, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), "/"), lambda p: p != "")
    hexadecimal = F.get(F.filter(parts, lambda p: p.rlike("^[a-fA-F0-9]{6,}$")), F.lit(0))
    leaf = F.coalesce(F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1))
    address = F.coalesce(F.substring(hexadecimal, 1, 12), F.substring(leaf, 1, 24))
    plain = F.substring(F.regexp_replace(label, r"\.[^.]+$", ""), 1, 24)
    found = F.when(label.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.coalesce(address, plain)).otherwise(plain)
    return F.when(label.isNull() | (label == "") | (found == ""), "scene").otherwise(found)


def pad(fill: float, size: Column, scene: str) -> Column:
    return F.greatest(F.ceil(F.lit(fill) / size), F.lit(1)) * size + size if scene in ("indoor", "outdoor") else F.lit(max(fill, 0.3))


def grid_voxels(low: list[Column], high: list[Column], size: Column, fill: float = 1.6, scene: str = "indoor") -> Column:
    """Voxels of the padded grid over a box."""
    out = F.lit(1).cast("bigint")
    for a, b in zip(low, high, strict=True):
        out = out * (F.greatest(F.ceil((b - a + 2 * pad(fill, size, scene)) / size), F.lit(1)) + 1)
    return out


def clamped(low: Column, high: Column, most: float) -> tuple[Column, Column]:
    """An interval cut to `most` about its middle."""
    middle, wide = (low + high) * 0.5, high - low > most
    return F.when(wide, middle - most * 0.5).otherwise(low), F.when(wide, middle + most * 0.5).otherwise(high)


def camera_box(x: Column, y: Column, z: Column, yaw: Column, left: float, right: float, behind: float, forward: float, below: float, above: float) -> dict[str, Column]:
    """Axis-aligned box of the corners of a box turned by yaw about the camera."""
    c, s = F.cos(yaw), F.sin(yaw)
    corners = [(a, b) for a in (-left, right) for b in (-behind, forward)]
    xs, zs = [x + c * a + s * b for a, b in corners], [z - s * a + c * b for a, b in corners]
    return {"min_x": F.least(*xs), "max_x": F.greatest(*xs), "min_y": y - below, "max_y": y + above, "min_z": F.least(*zs), "max_z": F.greatest(*zs)}


#: An agent of the navigation mesh, metres and degrees.
AGENT = {"cs": 0.2, "ch": 0.1, "height": 1.7, "radius": 0.5, "climb": 0.5, "slope": 40.0}


def recast_cells(height: Column, radius: Column, climb: Column, cs: float = 0.12, ch: float = 0.1) -> list[Column]:
    """Metres as voxels: height rounded up, climb down, radius up; and the room above the highest floor."""
    return [F.greatest(F.ceil(height / ch), F.lit(1)).alias("walkable_height"), F.greatest(F.floor(climb / ch), F.lit(0)).alias("walkable_climb"), F.greatest(F.ceil(radius / cs), F.lit(0)).alias("walkable_radius"), (height + 0.5).alias("padding")]


#: Resident splats and megabytes of each quality.
PRESETS = {"low": (2_000_000, 192), "medium": (4_000_000, 384), "high": (8_000_000, 768), "ultra": (16_000_000, 1536)}


def cache_budget(memory_bytes: Column) -> Column:
    """An eighth of the memory between 50 and 500 MiB."""
    return F.least(F.greatest(F.round(memory_bytes / 8), F.lit(50 * 2**20)), F.lit(500 * 2**20)).cast("bigint")


def cell_size(area: Column, most_cells: Column, radius: float) -> Column:
    """Edge for about so many cells, between a third and a half of the agent's radius."""
    wanted = F.when((most_cells > 0) & (area > 0), F.sqrt(area / most_cells)).otherwise(radius / 3)
    return F.least(F.greatest(wanted, F.lit(radius / 3)), F.lit(radius / 2))



def volume(low: dict[str, Column], high: dict[str, Column]) -> dict[str, Column]:
    """A box of 0.5 m over x and z about its middle and 2 m up from its floor at least."""
    out = {}
    for c in "xz":
        half, middle = F.greatest(high[c] - low[c], F.lit(0.5)) * 0.5, (low[c] + high[c]) * 0.5
        out |= {f"min_{c}": middle - half, f"max_{c}": middle + half}
    return out | {"min_y": low["y"], "max_y": F.when(high["y"] - low["y"] >= 2.0, high["y"]).otherwise(low["y"] + 2.0)}


def stairs(box: dict[str, Column], carve: float = 1.6) -> dict[str, Column]:
    """A box with a metre under its floor and four above a carved height, for stairs and landings."""
    return box | {"min_y": box["min_y"] - 1.0, "max_y": F.greatest(box["max_y"], box["min_y"] + carve + 4.0)}
