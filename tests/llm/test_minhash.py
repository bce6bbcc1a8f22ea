"""Near duplicates against all pairs, and the signatures against the similarity that they estimate."""

import random
import re

import numpy as np
import pytest

from cairn.llm import minhash as M
from cairn.operators.components import connected_components
from tests.llm.fixtures import ODD, documents, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = (min(ids) if ids else None) if sets[i] else k
        out.append((k, len(sets[i]), c, k == c))
    return sorted(out, key=str)


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"edit{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def cases():
    rows = list(ODD)
    for g in range(6):
        base = prose(100 + g, 150 + 40 * g)
        rows += [(1000 * (g + 1) + i, edited(base, 31 * g + i, 0.004 * i)) for i in range(14)]
    chain = prose(500, 300).split()
    rows += [(9000 + i, " ".join(chain[12 * i : 12 * i + 160])) for i in range(10)]  # each near the next, the ends far apart
    return rows


def test_equals_all_pairs(spark):
    rows = cases()
    got = M.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    base = prose(77, 400)
    rows = [(i, edited(base, i, 0.01)) for i in range(300)] + [(1000 + i, base) for i in range(300)]
    got = M.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == brute(rows)


def test_one_of_each_group_keeps_all_columns(spark):
    rows = [(1, prose(1, 80)), (2, prose(1, 80)), (3, ""), (3, ""), (4, None), (5, prose(5, 50))]
    docs = documents(spark, rows)
    kept = M.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5]


def test_nothing(spark):
    assert M.near_duplicates(documents(spark, [(1, "a b")]).limit(0)).count() == 0


@pytest.mark.parametrize("shared", [0.2, 0.75, 0.95])
def test_registers_estimate_the_similarity(shared):
    rng = np.random.default_rng(4)
    n, found = 400, []
    for _ in range(20):
        both = rng.integers(0, 2**63, int(n * shared)).astype(np.uint64)
        sets = [np.concatenate((both, rng.integers(0, 2**63, (n - len(both)) // 2).astype(np.uint64))) for _ in range(2)]
        regs = M.super_minhash(np.concatenate(sets), np.repeat([0, 1], [len(s) for s in sets]), 2)
        found.append((regs[0] == regs[1]).mean())
    assert abs(np.mean(found) - shared) < 0.02


def test_a_set_in_pieces_has_the_same_registers(monkeypatch):
    e = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    whole = M.super_minhash(e, np.zeros(len(e), np.int64), 1)
    monkeypatch.setattr(M, "CHUNK", 700)
    assert (M.super_minhash(e, np.zeros(len(e), np.int64), 1) == whole).all()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 201), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert {found[i] for i in range(61)} == {0} and found[201] == found[200] == 200


def test_links_beside_the_pivot(spark):
    """All classes meet one pivot only: what is linked without it must be found by the shingles apart."""
    r = random.Random(5)
    base = set(range(60))
    families = [base] + [(base - set(r.sample(range(60), k))) | set(range(1000 * k, 1000 * k + k)) for k in (4, 6, 8, 9, 10, 12, 15)]
    sets = [base]
    for f in families:
        for _ in range(12):
            gone = r.sample(sorted(f), r.randrange(0, 7))
            sets.append((f - set(gone)) | {10**6 + r.randrange(10**6) for _ in range(r.randrange(0, 5))})
    near = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    table = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "c bigint, shingles array<bigint>")
    stars = spark.createDataFrame([(i, 0) for i in range(1, len(sets))], "c bigint, pivot bigint")
    differences = M._differences(stars, table)
    assert {x["c"]: x["linked"] for x in differences.collect()} == {i: near(x, sets[0]) for i, x in enumerate(sets) if i}
    found = connected_components(differences.filter("linked").selectExpr("c a", "pivot b"))
    more = M._across(differences, found)
    root = {x["node"]: x["component"] for x in found.collect()}
    wanted = {(j, i) for i in range(1, len(sets)) for j in range(1, i) if near(sets[i], sets[j]) and root.get(i, i) != root.get(j, j)}
    assert wanted and {(min(x), max(x)) for x in more.collect()} == wanted


def test_a_class_with_many_links_stays_whole(spark):
    links = spark.createDataFrame([(1000, i) for i in range(100)] + [(2000 + i, i) for i in range(100)], "a bigint, b bigint")
    assert {r["component"] for r in connected_components(M._thinned(links)).collect()} == {0}
    assert connected_components(M._thinned(links)).count() == 201


def test_pairs_tried_grow_with_the_documents_of_a_template(spark):
    """Documents that share two thirds, so that none is linked: they must not be tried pair by pair."""
    tried = {}
    for n in (100, 400):
        sets = [[*range(200), *range(1000 * i + 1000, 1000 * i + 1060)] for i in range(n)] + [[*range(200), *range(10**6, 10**6 + 10)]]
        table = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "c bigint, shingles array<bigint>")
        stars = spark.createDataFrame([(i, 0) for i in range(1, len(sets))], "c bigint, pivot bigint")
        differences = M._differences(stars, table)
        found = connected_components(differences.filter("linked").selectExpr("c a", "pivot b"))
        tried[n] = M._tried(M._places(M._undecided(differences, found))).count()
    assert tried[400] <= 6 * max(tried[100], 400)
