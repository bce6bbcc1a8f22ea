"""Manifests against a tree built row by row."""

import hashlib
import random
import zlib

import pytest

from cairn.llm import merkle as M

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf long, path string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def up(nodes):
    """All levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        start = at - at % 3
        yield level[start:at], level[at + 1 : start + 3]
        at //= 3


def expected(rows):
    found = {}
    for i, s, lang, n, text in rows:
        own = [digest(*map(field, (i, s, lang, n, t))) for t in (text, text and text.replace("\n", ""))]
        changed = zlib.crc32(b"" if i is None else str(i).encode()) % 2 == 0
        found.setdefault(s, []).append(((i is not None, i or 0, own[0]), i, own[0], own[1] if changed else own[0]))
    order = sorted(found, key=lambda s: (s is not None, (s or "").encode()))
    trees = [up([x[2] for x in sorted(found[s], key=lambda x: x[0])]) for s in order]
    top = up([t[-1][0] for t in trees])
    for k, s in enumerate(order):
        for at, (_, i, own, shown) in enumerate(sorted(found[s], key=lambda x: x[0])):
            sides = [*siblings(trees[k], at), *siblings(top, k)]
            folded = shown
            for left, right in sides:
                folded = digest(*left, folded, *right)
            root = top[-1][0]
            yield i, own, trees[k][-1][0], root, digest(*(x for side in sides for x in [*side[0], *side[1]])), folded, folded == root


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "t", 1, "p") for r in rows], COLUMNS)
    assert sorted(map(tuple, M.manifest(docs).collect()), key=str) == sorted(expected(rows), key=str)


ODD = [
    (None, None, None, None, None), (1, None, "en", 3, "a\nb"), (2, "", "", 0, ""), (3, "a", "en", -5, "\n\n"), (-7, "a", "en", 1, "ü\n😀"), (3, "a", "en", -5, "\n\n"), (3, "a", "de", 2, "x\ny"),
    (None, "a", "en", 1, "no id\n"), (None, "a", "en", 1, "no id\n"), (-(1 << 63), "a", None, 1, "least"), ((1 << 63) - 1, "a", None, 1, "most\n"), (5, "ä", None, 1, "-"), (6, "Z", None, 1, "x" * 300_000 + "\n"),
]


def test_odd_rows(spark):
    check(spark, ODD)


@pytest.mark.parametrize("sizes", [[1], [3], [4], [27, 28], [81, 82, 1], [250, 9, 10, 2, 1, 1, 1]])
def test_trees_of_any_size(spark, sizes):
    r = random.Random(1)
    check(spark, [(r.randrange(-10**12, 10**12) if r.random() < 0.5 else r.randrange(3000), f"s{k}", "en", i, f"text {i}" + "\n" * (i % 2)) for k, n in enumerate(sizes) for i in range(n)])


def test_many_copies_of_a_row_and_many_rows_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN", 7)
    check(spark, [*[(4, "s", "en", 1, "same\nrow")] * 100, *((4, "s", "en", i, f"t{i}") for i in range(100)), (3, "s", "en", 1, "x"), (5, "s", "en", 1, "y")])


def test_an_empty_table(spark):
    out = M.manifest(spark.createDataFrame([], COLUMNS))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0


def test_only_changed_texts_fail(spark):
    rows = [(i, "s", "en", 1, "two\nlines" if i % 3 else "one line") for i in range(60)]
    docs = spark.createDataFrame([(*r, "t", 1, "p") for r in rows], COLUMNS)
    assert {r["doc_id"] for r in M.manifest(docs).filter("not verified").collect()} == {i for i in range(60) if i % 3 and zlib.crc32(str(i).encode()) % 2 == 0}
