"""Near-duplicate grouping by SuperMinHash signatures, banding, verification and components.

Documents with the same shingle set are one class; classes meet in the buckets of their bands.
In a bucket each class is compared with one pivot, never with all; what that leaves undecided
is found by the rarest of the shingles that tell classes apart from their pivot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import LOWER, SPACES, U64, arrow_batch, discard, mix, slices, small_batches, span_hashes, staged, table, tidy, word_spans
from cairn.operators.components import connected_components

#: 225 registers in 45 bands of 5: a pair of similarity 0.75 shares no band with probability 5e-6, one of 0.3 shares one with 0.1.
REGISTERS, BAND = 225, 5
WORDS, PERCENT = 5, 75
#: 100 * common >= PERCENT * union: A * (shingles that only one of both has) <= B * (sum of their sizes).
A, B = 100 + PERCENT, 100 - PERCENT
CHUNK = 1 << 15


def super_minhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash registers (n_docs, m) of the element hashes, whose sets `doc` numbers in ascending order.

    In round j an element takes the next place of its own random permutation and offers rank j plus
    a random fraction there. A set is done once all its registers hold ranks below j: later offers can't
    win. A register is rank << 32 | fraction, so that the order is exact."""
    regs = np.full((n_docs, m), np.iinfo(U64).max, U64)
    flat = regs.reshape(-1)
    for at in range(0, len(elements), CHUNK):  # registers are minima: a large set may arrive in pieces
        e, d = elements[at : at + CHUNK], doc[at : at + CHUNK]
        places = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(e), 1))
        for j in range(m):
            top = regs[d[0] : d[-1] + 1].max(axis=1)
            live = (top >> U64(32) >= U64(j))[d - d[0]]
            if not live.all():
                e, d, places = e[live], d[live], places[live]
            if not len(e):
                break
            r = mix(e + U64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            k = j + ((r >> U64(32)) * U64(m - j) >> U64(32)).astype(np.int64)
            rows = np.arange(len(e))
            here = places[rows, k]
            places[rows, k] = places[:, j]
            places[:, j] = here
            np.minimum.at(flat, d * m + here, (U64(j) << U64(32)) | (r & U64(0xFFFFFFFF)))
    return regs


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, and the offsets of the sets; texts of fewer words have their whole sequence as one."""
    buf = LOWER[buf]
    starts, ends, doc = word_spans(buf, off, SPACES)
    h = span_hashes(buf, starts, ends)
    count = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate(([0], np.cumsum(count)))
    run = np.zeros(max(0, len(h) - words + 1), U64)
    for i in range(words):
        run = run * U64(0xD6E8FEB86659FD93) + h[i : i + len(run)]
    run = mix(run)
    sets, size = [], np.zeros(len(count), np.int64)
    for i, n in enumerate(count):
        if n >= words:
            s = np.unique(run[first[i] : first[i] + n - words + 1])
        elif n:
            short = U64(n)
            for x in h[first[i] : first[i] + n]:
                short = U64((int(short) * 0xD6E8FEB86659FD93 + int(x)) & 0xFFFFFFFFFFFFFFFF)
            s = mix(np.array([short]))
        else:
            continue
        sets.append(s)
        size[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, U64)), np.concatenate(([0], np.cumsum(size)))


def set_keys(elements: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """A 128-bit key of each set, None if empty."""
    a, b = (np.concatenate(([U64(0)], np.cumsum(mix(elements ^ U64(s)), dtype=U64))) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
    pair = np.stack((mix(a[off[1:]] - a[off[:-1]]), mix(b[off[1:]] - b[off[:-1]] + np.diff(off).astype(U64))), axis=1)
    return [x.tobytes() if n else None for x, n in zip(pair, np.diff(off), strict=True)]


def band_keys(regs: np.ndarray, band: int = BAND) -> np.ndarray:
    n = regs.shape[1] // band
    keys = np.zeros((len(regs), n), U64)
    for i in range(band):
        keys = mix(keys ^ regs[:, i::band][:, :n]) + np.arange(n, dtype=U64)
    return mix(keys).view(np.int64)


FEATURES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("c", pa.int64()), ("shingles", pa.list_(pa.int64()))])
#: Stands for a null doc_id in joins.
NO_ID = -(1 << 63)
#: Classes that meet one copy of their pivot's set in a task; a pivot with more is copied.
FAN = 1000


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in slices(batch, "text"):
            elements, at = shingle_sets(buf, off)
            n = np.diff(at)
            bands = band_keys(super_minhash(elements, np.repeat(np.arange(len(n)), n), len(n)))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands.shape[1], pa.int32()), pa.array(bands.reshape(-1)))
            yield arrow_batch(FEATURES, doc_id=part["doc_id"], text_hash=part["text_hash"], n_shingles=n, key=set_keys(elements, at), bands=bands)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, off in slices(batch, "text"):
            elements, at = shingle_sets(buf, off)
            yield arrow_batch(SETS, c=part["c"], shingles=pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(elements.view(np.int64))))


def _buckets(classes: DataFrame) -> DataFrame:
    """c, pivot of each bucket that a class shares with others, the bucket's pivot left out; distinct.

    The pivot of a bucket is the class that meets most others over all its bands, such as the source of edited copies."""
    rows = classes.select("c", F.explode("bands").alias("band"))
    full = rows.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    shared = staged(rows.join(full.hint("merge"), "band"), "buckets")  # buckets of one class end here
    met = shared.groupBy("c").agg(F.sum("members").alias("met"))
    pivots = shared.join(met.hint("merge"), "c").groupBy("band").agg(F.max(F.struct("met", "c")).alias("pivot"))
    stars = shared.select("band", "c").join(pivots.select("band", F.col("pivot.c").alias("pivot")).hint("merge"), "band").filter("c <> pivot")
    out = staged(stars.select("c", "pivot").distinct(), "stars")
    discard(shared)
    return out


def _full_sets(stars: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """c, shingles of all classes in the stars, from the text of one row of each."""
    wanted = stars.select("c").union(stars.select(F.col("pivot").alias("c"))).distinct()
    sources = classes.select("c", "source.doc_id", "source.text_hash").join(wanted.hint("merge"), "c", "left_semi")
    found = texts.join(sources.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash", "c"])
    return staged(small_batches(found.select("c", "text")).mapInArrow(tidy(_sets), "c bigint, shingles array<bigint>"), "sets")


def _differences(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Of each class and pivot: their sizes, whether they are linked, and what tells them apart: the class's shingles
    that the pivot hasn't as they are, the pivot's that the class hasn't with all bits turned.

    A pivot's set is copied for every FAN classes that meet it, so that no task holds all of a hot pivot's."""
    fans = stars.groupBy("pivot").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fans"))
    dealt = stars.join(fans.hint("merge"), "pivot").select("c", "pivot", F.pmod(F.xxhash64("c"), "fans").cast("int").alias("fan"))
    copies = sets.withColumnRenamed("c", "pivot").join(fans.hint("merge"), "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.col("shingles").alias("y"))
    both = dealt.join(sets.select("c", F.col("shingles").alias("x")).hint("merge"), "c").join(copies.hint("merge"), ["pivot", "fan"])
    turned = F.transform(F.array_except("y", "x"), lambda h: F.bitwise_not(h))
    rows = both.select("c", "pivot", F.size("x").alias("n"), F.size("y").alias("m"), F.concat(F.array_except("x", "y"), turned).alias("apart"))
    return staged(rows.withColumn("linked", A * F.size("apart") <= B * (F.col("n") + F.col("m"))), "differences")


def _undecided(differences: DataFrame, found: DataFrame) -> DataFrame:
    """The differences of the pivots whose classes fall into several components, with these, each class's shingles apart by place.

    Two classes x, y of a pivot p that are linked, x not being linked with p, share over d_y * P / (100 + P) of what tells y
    apart from p, d_y in number, and more than half of what d_x exceeds the bound for a link by. So, the rarest first, they
    meet within so many first places of both."""
    label = F.coalesce("component", "c").alias("component")
    rows = differences.join(found.withColumnRenamed("node", "c").hint("merge"), "c", "left").select("pivot", "c", "n", "m", "linked", label, "apart")
    mixed = rows.groupBy("pivot").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("pivot")
    return staged(rows.join(mixed.hint("merge"), "pivot").withColumn("d", F.size("apart")), "undecided")


def _places(undecided: DataFrame) -> DataFrame:
    """Of each class the shingles that tell it from its pivot, the rarest first, as far as a link can ask for.

    Two classes must share ((A * d - B * n) + (A * d' - B * n')) / 2 A of them, more than are left behind too late a place: a
    class's part of that sum, in levels, says which levels of others a row can still meet (up to top). low and high are the
    least and the greatest level of the classes that hold the shingle; rows that can meet none of them go."""
    step = F.greatest(F.lit(1), F.floor(F.col("m") * B / 2))
    excess = A * F.col("d") - B * F.col("n")
    each = undecided.select("pivot", "c", "n", "m", "d", "linked", "component", F.floor(excess / step).alias("level"), F.explode("apart").alias("shingle"))
    held = each.groupBy("pivot", "shingle").agg(F.count("*").alias("holders"), F.min("level").alias("low"), F.max("level").alias("high")).filter("holders > 1")
    own = Window.partitionBy("pivot", "c")  # no more than a document's shingles and its pivot's
    each = each.join(held.hint("merge"), ["pivot", "shingle"])
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("holders", "shingle"))
    near = F.col("d") - F.floor(F.col("d") * PERCENT / A)
    far = F.when(F.col("linked"), near).otherwise(F.col("d") + 1 - F.greatest(F.lit(1), F.ceil((A * F.col("d") - B * (F.col("n") + F.col("m"))) / (2 * A))))
    each = each.withColumn("place", place).withColumn("near", near).withColumn("far", far)
    each = each.withColumn("top", F.least("high", F.floor((2 * A * (1 + F.col("d") - F.col("place")) - excess) / step)))
    return staged(each.filter("place <= greatest(near, far) and top >= low").drop("holders", "m", "high"), "places")


def _tried(places: DataFrame) -> DataFrame:
    """Pairs of rows of a pivot and shingle, met by the levels of both."""
    names = ("c", "n", "d", "linked", "component", "place", "near", "far")
    levels = F.explode(F.sequence("low", "top"))
    one = places.filter("not linked").select("pivot", "shingle", F.col("level").alias("own"), levels.alias("others"), *names)
    other = places.select("pivot", "shingle", levels.alias("own"), F.col("level").alias("others"), *(F.col(x).alias(f"{x}2") for x in names))
    return one.join(other.hint("merge"), ["pivot", "shingle", "own", "others"])


def _meetings(places: DataFrame) -> DataFrame:
    """Pairs of classes of different components that may be links."""
    most = 1 + F.least(F.col("d") - F.col("place"), F.col("d2") - F.col("place2"))
    can = 2 * A * most >= A * (F.col("d") + F.col("d2")) - B * (F.col("n") + F.col("n2"))
    reach = (F.col("place2") <= F.col("near2")) & (F.col("place") <= F.when(F.col("linked2"), F.col("far")).otherwise(F.col("near")))
    return _tried(places).filter((F.col("component") != F.col("component2")) & (F.col("linked2") | (F.col("c") < F.col("c2"))) & reach & can)


def _thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) of the same components: each a with its least b, and that with the other b."""
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    others = links.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return least.select("a", F.col("least").alias("b")).union(others).distinct()


def _across(differences: DataFrame, found: DataFrame) -> DataFrame | None:
    """Links (a, b) of classes of one pivot that are not linked through pivots, None if there are none."""
    undecided = _undecided(differences, found)
    places = _places(undecided)
    pairs = staged(_meetings(places).select("pivot", "c", "c2").distinct(), "pairs")
    one = undecided.select("pivot", "c", "n", F.col("apart").alias("x"))
    other = undecided.select("pivot", F.col("c").alias("c2"), F.col("n").alias("n2"), F.col("apart").alias("y"))
    both = pairs.join(one.hint("merge"), ["pivot", "c"]).join(other.hint("merge"), ["pivot", "c2"])
    apart = F.size("x") + F.size("y") - 2 * F.size(F.array_intersect("x", "y"))
    links = None if pairs.isEmpty() else staged(both.filter(A * apart <= B * (F.col("n") + F.col("n2"))).select(F.col("c").alias("a"), F.col("c2").alias("b")).distinct(), "links")
    discard(undecided, places, pairs)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row for each input row.

    Null, empty and white texts have no shingles and are linked with nothing. Rows that repeat a
    doc_id stay rows and get the same component. A null doc_id never names a component that has
    another id; such a row is kept only if its component has no id at all."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    features = staged(small_batches(texts).mapInArrow(tidy(_features), "doc_id bigint, text_hash bigint, n_shingles bigint, key binary, bands array<bigint>"), "features")
    source = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text_hash")
    classes = features.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min(source).alias("source"), F.first("bands").alias("bands"))
    classes = staged(classes.withColumn("c", F.monotonically_increasing_id()), "classes")  # numbers hold once written
    stars = _buckets(classes)
    sets = _full_sets(stars, classes, texts.na.fill({"doc_id": NO_ID}))
    differences = _differences(stars, sets)
    discard(stars, sets)
    links = differences.filter("linked").select(F.col("c").alias("a"), F.col("pivot").alias("b"))
    found = connected_components(_thinned(links))
    if (more := _across(differences, found)) is not None:
        found = connected_components(_thinned(links.union(more)))
    discard(differences)
    member = classes.join(found.withColumnRenamed("node", "c").hint("merge"), "c", "left").select("key", "least", F.coalesce("component", "c").alias("component"))
    ids = member.groupBy("component").agg(F.min("least").alias("component_id"))
    member = staged(member.join(ids.hint("merge"), "component").select("key", "component_id"), "members")
    discard(classes)
    joined = features.select("doc_id", "n_shingles", "key").join(member, "key", "left")
    final = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", final.alias("component_id"), F.col("doc_id").eqNullSafe(final).alias("kept"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents that near_duplicates() keeps, with all their columns. Rows that share a doc_id share its decision;
    of rows that repeat both id and text one stays."""
    found = near_duplicates(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("kept_id"), "kept")
    kept = staged(found.groupBy("kept_id").agg(F.max("kept").alias("kept"), F.count("*").alias("times")).filter("kept"), "kept")
    out = docs.join(kept, F.coalesce(docs["doc_id"], F.lit(NO_ID)) == F.col("kept_id"), "left_semi")
    return out if kept.filter("times > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate groups of all documents; see near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_minhash": op3_minhash}
#: Exact over all pairs that share a shingle; for the small scales of the SQL check.
SQL = {
    "op3_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS k, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM g) x WHERE len(s) > 0 GROUP BY s),
e AS (SELECT k, n, unnest(s) AS h FROM c),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS i, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b ON a.h = b.h AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (m + n - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(k, x) AS (SELECT k, k FROM c UNION SELECT r.k, u.b FROM r JOIN u ON u.a = r.x),
f AS (SELECT k, min(x) AS component FROM r GROUP BY k)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(f.component, g.doc_id) AS component_id, g.doc_id = coalesce(f.component, g.doc_id) AS kept
FROM g LEFT JOIN c ON list_sort(g.s) = c.s LEFT JOIN f ON f.k = c.k"""
}
