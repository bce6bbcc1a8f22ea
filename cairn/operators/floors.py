"""A floor mesh from the cells of a ground field: gaps bridged, seams closed, patches of one level chosen, heights levelled.

Cells are sparse: a cell of the grid without a row is void. Every step reads a bounded neighbourhood that cells offer to
those around them; floods that matter end at a size, so that no step holds a whole floor in a task."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cairn.operators.cloud import nearest_rank
from cairn.operators.components import cell_components
from cairn.operators.field import Field, FieldSettings, Grid, build
from cairn.operators.tiles import SIDES, Window, by_tiles, moved, small_parts
from cairn.sources.tables import staged, with_ordinal

CELL = ("row", "col")


@dataclass(frozen=True)
class FloorSettings:
    """Lengths in metres. gap: across which seams close (2 outdoors); flatten: from the plane within which corners snap to it."""

    seed: tuple[float, float, float] | None = None
    room: float = 1.2
    bridge: int = 12
    gap: float = 0.6
    seam_tolerance: float = 0.35
    least_cells: int = 20
    least_area: float = 1.2
    seed_reach: float = 3.25
    level: tuple[float, float] = (0.25, 0.3)
    band: tuple[float, float] = (0.5, 0.45)
    level_radius: int = 3
    flatten: float = 0.12


def accepted(relaxed: bool = False) -> Column:
    """Whether a cell counts as floor; relaxed: cells of doubt too, if little speaks against them."""
    state, ok = F.col("state"), F.col("state").isin("walkable", "filled")
    if not relaxed:
        return ok
    least = lambda name, confidence, variance, score: (state == name) & (F.col("confidence") >= confidence) & (F.col("variance") <= variance) & (F.col("obstacle_score") <= score)
    doubt = (state == "discarded_component") | ((state == "low_confidence") & (F.col("variance") <= 0.18) & (F.col("obstacle_score") <= 0.42))
    doubt = doubt | least("height_variance", 0.01, 0.08, 0.35) | least("obstacle", 0.02, 0.05, 0.52)
    return F.coalesce(ok | (F.col("height").isNotNull() & doubt), F.lit(False))


#: Bits of what a cell is to the steps that close a mask: floor, no hole (a hole's wall), kept as it is.
FLOOR, WALL, STAYS = 1, 2, 4


def _kinds(cells: DataFrame, floor: Column, height: Column) -> DataFrame:
    """row, col, height and the bits of cells; cells without a row, or of no state, are holes."""
    bit = lambda c, b: F.when(F.coalesce(c, F.lit(False)), b).otherwise(0)
    kind = bit(floor, FLOOR) + bit(~floor & ~F.col("state").isin("void", "low_confidence"), WALL) + bit(F.col("state").isin("obstacle", "height_variance"), STAYS)
    return cells.select(*CELL, height.cast("double").alias("height"), kind.cast("int").alias("kind"))


def _with_mask(mask: DataFrame, cells: DataFrame, height: Column) -> DataFrame:
    return _kinds(cells, F.lit(False), F.lit(None)).union(mask.select(*CELL, height.cast("double"), F.lit(FLOOR)))


def _closed(rows: DataFrame, g: Grid, most: int, gap: int, tolerance: float) -> DataFrame:
    """Of rows as _kinds() gives them, and of cells without a row: row, col, source (mask, bridged or closed), height (the cell's own) and middle
    (of its seam). See gaps() and seams(), of which each is left out at 0.

    A tile's rim holds all holes of `most` cells that begin in it, and the cells that these and their seams depend on."""
    schema = {c: rows.schema[c].dataType for c in CELL}

    def work(w: Window) -> pa.Table:
        kind, own = w.rows["kind"].to_numpy(), w.rows["height"]
        has = lambda bit: w.spread(np.ones(len(kind), bool), False, kind & bit > 0)
        row, col = (np.arange(n)[:, None] + low if i == 0 else np.arange(n)[None, :] + low for i, (n, low) in enumerate(zip(w.shape, w.low, strict=True)))
        inside = (row >= 0) & (row < g.height) & (col >= 0) & (col < g.width)
        mask, known = has(FLOOR), own.is_valid().to_numpy()
        height = w.spread(own.fill_null(np.nan).to_numpy(), np.nan, known)
        known = w.spread(np.ones(len(kind), bool), False, known)
        stays = has(STAYS) | mask
        source = np.where(mask, 0, -1)
        if most:
            wall = has(WALL) & ~mask
            part = small_parts(inside & ~mask & ~wall, most)
            out = (row <= 0) | (row >= g.height - 1) | (col <= 0) | (col >= g.width - 1)
            out[[0, -1]], out[:, [0, -1]] = True, True  # outside of the box is no floor
            for side in SIDES:
                out |= moved(wall & inside, *side, False)
            bad = np.unique(part[out])
            source[(part > 0) & ~np.isin(part, bad)] = 1
            mask = source >= 0
        low, high, sides = np.full(w.shape, np.inf), np.full(w.shape, -np.inf), np.zeros(w.shape, int)
        for i, j in SIDES if gap else ():
            met, found, h = np.zeros(w.shape, bool), np.zeros(w.shape, bool), np.full(w.shape, np.nan)
            for n in range(1, gap + 1):  # the nearest, whether its height is known or not
                new = moved(mask, n * i, n * j, False) & ~met
                h[new], found[new] = moved(height, n * i, n * j, np.nan)[new], moved(known, n * i, n * j, False)[new]
                met |= new
            low, high = np.where(found, np.minimum(low, h), low), np.where(found, np.maximum(high, h), high)
            sides += found
        two = sides >= 2
        low, high = np.where(two, low, 0.0), np.where(two, high, 0.0)
        source[two & (high - low <= tolerance) & ~mask & ~stays & inside] = 2
        at = np.nonzero(source >= 0)
        r, c = at[0] + w.low[0], at[1] + w.low[1]
        keep = w.own(r, c)
        at, r, c = tuple(a[keep] for a in at), r[keep], c[keep]
        name = pa.array(np.array(["mask", "bridged", "closed"])[source[at]], pa.string())
        closed = source[at] == 2
        return pa.table({"row": r, "col": c, "source": name, "height": pa.array(height[at], mask=~known[at]), "middle": pa.array(((low + high) / 2)[at], mask=~closed)})

    found = by_tiles(rows, (most + 1 if most else 0) + gap, work, "row bigint, col bigint, source string, height double, middle double")
    return found.select(*(F.col(c).cast(t).alias(c) for c, t in schema.items()), "source", "height", "middle")


def gaps(mask: DataFrame, cells: DataFrame, g: Grid, most: int = 12) -> DataFrame:
    """row, col of the holes in the mask of `most` cells at most that are void or of low confidence, touch neither the border nor a cell of
    another state, and so are closed in by floor."""
    return _closed(_with_mask(mask, cells, F.lit(None)), g, most, 0, 0.0).filter("source = 'bridged'").select(*CELL)


def seams(mask: DataFrame, cells: DataFrame, g: Grid, gap: int, tolerance: float) -> DataFrame:
    """row, col, height of cells off the mask with floor within `gap` cells on two of four sides or more, whose heights differ by the
    tolerance at most: the middle between the least and the greatest. Obstacles and ledges stay as they are."""
    found = _closed(_with_mask(mask, cells, F.col("height")), g, 0, gap, tolerance).filter("source = 'closed'")
    return found.select(*CELL, F.col("middle").alias("height"))


def closed_mask(cells: DataFrame, g: Grid, s: FloorSettings, cell: float, relaxed: bool = False) -> DataFrame:
    """row, col, source (mask, bridged or closed), height of the floor's cells; a cell's own height goes before that of its seam."""
    found = _closed(_kinds(cells, accepted(relaxed), F.col("height")), g, s.bridge, max(1, math.floor(s.gap / cell + 0.5)), s.seam_tolerance)
    return found.select(*CELL, "source", F.coalesce("height", "middle").alias("height"))


def with_parts(mask: DataFrame) -> DataFrame:
    return cell_components(mask, CELL)


def centre(g: Grid, cell: float) -> list[Column]:
    return [g.min_u + (F.col("col") + 0.5) * cell, F.coalesce(F.col("height"), F.lit(0.0)), g.min_v + (F.col("row") + 0.5) * cell]


def parts(floor: DataFrame, g: Grid, s: FloorSettings, cell: float) -> DataFrame:
    """A row for each part: component, cells, area, centre, distance to the seed (0 without one), viable."""
    means = [F.avg(c).alias(f"centre_{n}") for c, n in zip(centre(g, cell), "xyz", strict=True)]
    out = floor.groupBy("component").agg(F.count("*").alias("cells"), *means).withColumn("area", F.col("cells") * cell * cell)
    apart = F.lit(0.0) if s.seed is None else F.sqrt(sum(((F.col(f"centre_{n}") - v) * (F.col(f"centre_{n}") - v) for n, v in zip("xyz", s.seed, strict=True)), F.lit(0.0)))
    return out.withColumn("distance", apart).withColumn("viable", (F.col("cells") >= s.least_cells) & (F.col("area") >= s.least_area))


def chosen(found: DataFrame, s: FloorSettings) -> Row | None:
    """The viable part with the least distance less 0.45 times the root of its area, of those near the seed; the largest if none is near or there is no seed."""
    viable = found.filter("viable").withColumn("fallback", F.lit(s.seed is not None) & (F.col("distance") > s.seed_reach))
    score = F.lit(0.0) if s.seed is None else F.when(F.col("fallback"), 0.0).otherwise(F.col("distance") - F.sqrt("area") * 0.45)
    return viable.orderBy("fallback", score, F.desc("cells"), "component").first()


def level_height(floor: DataFrame, component: Row) -> float | None:
    """The upper median of a part's heights."""
    own = floor.filter((F.col("component.row") == component["row"]) & (F.col("component.col") == component["col"]) & F.col("height").isNotNull())
    n = own.count()
    return nearest_rank(own, "height", (n // 2) / max(n - 1, 1)) if n else None


def same_level(floor: DataFrame, found: DataFrame, height: float | None, s: FloorSettings) -> DataFrame:
    """The cells of viable parts whose upper median lies in the level's band, without cells beyond the wider band of cells.

    A median's side of a bound follows from counts, so that no part's heights are sorted."""
    viable = found.filter("viable").select("component")
    if height is None:
        return floor.join(viable, "component", "left_semi")
    low, high = height - s.level[0], height + s.level[1]
    counts = floor.groupBy("component").agg(F.count("height").alias("n"), F.count(F.when(F.col("height") < low, 1)).alias("below"), F.count(F.when(F.col("height") <= high, 1)).alias("up_to"))
    level = counts.filter((F.col("n") > 0) & (F.col("below") <= F.floor(F.col("n") / 2)) & (F.col("up_to") > F.floor(F.col("n") / 2))).select("component")
    rows = floor.join(viable.join(level, "component"), "component", "left_semi")
    return rows.filter(F.col("height").isNull() | F.col("height").between(height - s.band[0], height + s.band[1]))


def levelled(floor: DataFrame, radius: int = 3) -> DataFrame:
    """floor (row, col, height) with level: the upper median of the floor's heights in the square around; 49 at most."""

    columns = floor.columns

    def work(w: Window) -> pa.Table:
        known = w.rows["height"].is_valid().to_numpy()
        height = np.pad(w.spread(w.rows["height"].fill_null(np.nan).to_numpy().astype(float), np.nan, known), radius, constant_values=np.nan)
        mine = np.flatnonzero(w.own(w.row, w.col))
        r, c = (a[mine] for a in w.at)
        near = np.sort(np.stack([height[r + i, c + j] for i in range(2 * radius + 1) for j in range(2 * radius + 1)], axis=1), axis=1)
        many = (~np.isnan(near)).sum(axis=1)
        level = near[np.arange(len(mine)), np.minimum(many // 2, near.shape[1] - 1)]
        return w.rows.take(pa.array(mine)).select(columns).append_column("level", pa.array(level, mask=many == 0))

    return by_tiles(floor, radius, work, floor.withColumn("level", F.lit(None).cast("double")).schema)


def corners(floor: DataFrame, plane: float | None, flatten: float) -> DataFrame:
    """row, col, height of the corners of cells with level: the mean of the cells that touch it, the plane where it is near or nothing is known."""
    at = F.explode(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i in (0, 1) for j in (0, 1)))).alias("c")
    mean = floor.select(at, "level").groupBy("c.row", "c.col").agg(F.avg("level").alias("mean"))
    known = F.coalesce("mean", F.lit(plane if plane is not None else 0.0))
    height = known if plane is None else F.when(F.abs(known - plane) <= flatten, plane).otherwise(known)
    return mean.select(*CELL, height.alias("height"))


def surface(floor: DataFrame, points: DataFrame, g: Grid, cell: float) -> tuple[DataFrame, DataFrame]:
    """Corners in the order of rows and columns as vertices (vertex, x, y, z), and two triangles (triangle, a, b, c) for each cell, seen from above."""
    numbered = staged(with_ordinal(points, list(CELL), "vertex"), "vertices")
    slots = F.explode(F.array(*(F.struct(F.lit(f"v{i}{j}").alias("slot"), (F.col("row") + j).alias("r"), (F.col("col") + i).alias("c")) for i in (0, 1) for j in (0, 1)))).alias("s")
    each = floor.select(*CELL, slots).select(F.col("row").alias("of_row"), F.col("col").alias("of_col"), "s.slot", F.col("s.r").alias("row"), F.col("s.c").alias("col"))
    four = each.join(numbered.select(*CELL, "vertex"), list(CELL)).groupBy("of_row", "of_col").agg(*(F.max(F.when(F.col("slot") == n, F.col("vertex"))).alias(n) for n in ("v00", "v01", "v10", "v11")))
    three = lambda half, *names: F.struct(F.lit(half).alias("half"), *(F.col(n).alias(v) for n, v in zip(names, "abc", strict=True)))
    halves = four.select("of_row", "of_col", F.explode(F.array(three(0, "v00", "v01", "v11"), three(1, "v00", "v11", "v10"))).alias("t")).select("of_row", "of_col", "t.*")
    triangles = with_ordinal(halves, ["of_row", "of_col", "half"], "triangle").select("triangle", "a", "b", "c")
    at = ((g.min_u + F.col("col") * cell).alias("x"), F.col("height").alias("y"), (g.min_v + F.col("row") * cell).alias("z"))
    return numbered.select("vertex", *at), triangles


@dataclass(frozen=True)
class Floor:
    """cells: row, col, height, source, component, level; the rest as chosen."""

    cells: DataFrame
    parts: DataFrame
    component: Row
    height: float | None
    plane: float | None
    relaxed: bool


class NoFloor(ValueError):
    """No part of the field can be a floor, or what there is is smaller than a room."""


def extracted(cells: DataFrame, g: Grid, plane: float | None, s: FloorSettings = FloorSettings(), cell: float = FieldSettings().cell) -> Floor:
    """The floor's cells; cells (row, col, state, height, confidence, variance, obstacle_score) of the grid, plane the field's common height.

    If the accepted cells give no part, or one smaller than a room, cells of doubt are taken in, where that gives a larger part."""

    def attempt(relaxed: bool):
        floor = staged(with_parts(closed_mask(cells, g, s, cell, relaxed)), "floor")
        found = staged(parts(floor, g, s, cell), "parts")
        return floor, found, chosen(found, s)

    floor, found, best = attempt(False)
    relaxed = False
    if best is None or best["area"] < s.room:
        wide = attempt(True)
        if wide[2] is not None and (best is None or wide[2]["area"] > best["area"]):
            floor, found, best = wide
            relaxed = True
    if best is None:
        raise NoFloor("no part of the field is large enough for a floor")
    height = level_height(floor, best["component"])
    own = staged(same_level(floor, found, height, s), "level")
    if own.isEmpty():
        own = floor.filter((F.col("component.row") == best["component"]["row"]) & (F.col("component.col") == best["component"]["col"]))
    if own.count() * cell * cell < s.room:
        raise NoFloor("the floor is smaller than a room")
    near = plane is not None and (height is None or height - s.band[0] <= plane <= height + s.band[1])
    return Floor(staged(levelled(own, s.level_radius), "floor"), found, best["component"], height, plane if near else height if height is not None else plane, relaxed)


def mesh(floor: Floor, g: Grid, s: FloorSettings = FloorSettings(), cell: float = FieldSettings().cell) -> tuple[DataFrame, DataFrame]:
    """The floor's vertices and triangles; see surface()."""
    return surface(floor.cells, corners(floor.cells, floor.plane, s.flatten), g, cell)


@dataclass(frozen=True)
class Room:
    """cells: row, col, height of one part of the floor, strays left out; relaxed: cells of doubt were taken in, or no part was near the seed."""

    cells: DataFrame
    parts: DataFrame
    area: float
    relaxed: bool


def room(cells: DataFrame, g: Grid, plane: float | None, s: FloorSettings = FloorSettings(), cell: float = FieldSettings().cell) -> Room:
    """The part of the accepted cells that a room's floor is most likely to be, the seed taken at the height of the plane.

    Nothing is bridged, closed or levelled here; if there is no part as large as a room, cells of doubt are taken in where that
    gives a larger part."""
    if s.seed is not None and plane is not None:
        s = replace(s, seed=(s.seed[0], plane, s.seed[2]))

    def attempt(relaxed: bool):
        floor = staged(with_parts(cells.filter(accepted(relaxed)).select(*CELL, "height")), "room")
        found = staged(parts(floor, g, s, cell), "parts")
        return floor, found, chosen(found, s)

    floor, found, best = attempt(False)
    relaxed = False
    if best is None or best["area"] < s.room:
        wide = attempt(True)
        if wide[2] is not None and (best is None or wide[2]["area"] > best["area"]):
            floor, found, best = wide
            relaxed = True
    if best is None:
        raise NoFloor("no part of the field is large enough for a floor")
    own = floor.filter((F.col("component.row") == best["component"]["row"]) & (F.col("component.col") == best["component"]["col"])).drop("component")
    kept = staged(trimmed(own), "room")
    area = kept.count() * cell * cell
    if area < s.room:
        raise NoFloor("the floor is smaller than a room")
    return Room(kept, found, area, relaxed or bool(best["fallback"]))


def steps(floor: DataFrame, g: Grid, cell: float) -> tuple[DataFrame, DataFrame]:
    """A level square for each cell, with vertices of its own: vertices (vertex, x, y, z) and triangles (triangle, a, b, c) in the order of rows and columns."""
    numbered = staged(with_ordinal(floor.select(*CELL, "height"), list(CELL), "cell"), "steps")
    corner = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j")) for n, (i, j) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))))).alias("c")
    each = numbered.select("cell", *CELL, "height", corner)
    at = ((g.min_u + (F.col("col") + F.col("c.i")) * cell).alias("x"), F.coalesce("height", F.lit(0.0)).alias("y"), (g.min_v + (F.col("row") + F.col("c.j")) * cell).alias("z"))
    three = lambda n, *slots: F.struct((F.col("cell") * 2 + n).alias("triangle"), *((F.col("cell") * 4 + i).alias(v) for i, v in zip(slots, "abc", strict=True)))
    triangles = numbered.select(F.explode(F.array(three(0, 0, 1, 2), three(1, 0, 2, 3))).alias("t")).select("t.*")
    return each.select((F.col("cell") * 4 + F.col("c.n")).alias("vertex"), *at), triangles


#: Settings of a field that are tried one after the other, each with the least area of a room that it may find.
LADDER = (
    ("default", {}, 4.0),
    ("relaxed", {"density": 0.04, "obstacle_height": 0.42, "confidence": 0.003, "hole_radius": 3}, 4.0),
    ("coarse", {"cell": 0.2, "density": 0.03, "confidence": 0.002, "hole_radius": 3}, 2.5),
    ("coarse-last-resort", {"cell": 0.26, "density": 0.022, "confidence": 0.0015, "hole_radius": 4}, 1.5),
)


def recovered(splats: DataFrame, s: FloorSettings = FloorSettings(), base: FieldSettings = FieldSettings(), ladder=LADDER) -> tuple[str, Room, Field]:
    """The first room that the settings of the ladder find, with the step's name and its field; NoFloor with all reasons if none does."""
    reasons = []
    for label, patch, area in ladder:
        own = replace(base, **patch)
        field = build(splats, own)
        try:
            if field is None:
                raise NoFloor("no field")
            return label, room(field.cells, field.grid, field.floor, replace(s, room=area), own.cell), field
        except NoFloor as why:
            reasons.append(f"{label}: {why}")
    raise NoFloor("; ".join(reasons) or "no settings")


def trimmed(floor: DataFrame, tolerance: float = 0.5, most_stray: float = 0.3, least: int = 16) -> DataFrame:
    """floor (row, col, height) without cells whose height is beyond the tolerance from the upper median, and of the rest only the largest part
    (of two the first). All cells stay if that would drop more than a share of them, or leave fewer than `least`."""
    floor = staged(floor, "floor")
    n, known = floor.agg(F.count("*"), F.count("height")).first()
    if n <= least or not known:
        return floor
    middle = nearest_rank(floor, "height", (known // 2) / max(known - 1, 1))
    band = floor.filter(F.abs(F.col("height") - middle) <= tolerance)
    inside = band.count()
    if n - inside > most_stray * n or inside < least:
        return floor
    found = staged(with_parts(band), "parts")
    best = found.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    if best["count"] < least or n - best["count"] > most_stray * n:
        return floor
    return found.filter((F.col("component.row") == best["component"]["row"]) & (F.col("component.col") == best["component"]["col"])).drop("component")


MODES = ("largest", "nearest_centre", "seed")


def selected(floor: DataFrame, g: Grid, mode: str, seed: tuple[float, float] | None = None, cell: float = FieldSettings().cell) -> DataFrame:
    """floor (row, col, component) with kept: the cells of one part. largest: with most cells, of several the last in reading order;
    nearest_centre: with its centre nearest to the grid's; seed: with the least distance over the plan less 0.45 times the root of its area."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    means = floor.groupBy("component").agg(F.count("*").alias("cells"), F.avg("row").alias("row"), F.avg("col").alias("col"))
    if mode == "largest":
        order = [F.desc("cells"), F.desc("component")]
    else:
        to = ((g.height - 1) * 0.5, (g.width - 1) * 0.5) if mode == "nearest_centre" else ((seed[1] - g.min_v) / cell - 0.5, (seed[0] - g.min_u) / cell - 0.5)
        d2 = (F.col("row") - to[0]) * (F.col("row") - to[0]) + (F.col("col") - to[1]) * (F.col("col") - to[1])
        order = [d2 if mode == "nearest_centre" else F.sqrt(d2) * cell - F.sqrt(F.col("cells") * cell * cell) * 0.45, F.desc("cells"), "component"]
    best = means.orderBy(*order).first()
    kept = F.lit(False) if best is None else (F.col("component.row") == best["component"]["row"]) & (F.col("component.col") == best["component"]["col"])
    return floor.withColumn("kept", kept)

