"""Repeated strings against a dictionary of all of them; suffix arrays against sorted suffixes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import substrings as S
from cairn.llm.suffix import bytes_at, common_prefixes, find, suffix_array
from tests.llm.fixtures import ODD, documents, prose


def brute(rows, length):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for (k, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone[1:-1], strict=True) if not g)
        out.append((k, len(d), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases():
    passage, other = prose(1, 40), prose(2, 120)
    rows = [r for r in ODD if r[0] != 8]
    rows += [(20 + i, prose(50 + i, 30) + " " + passage + " " + prose(80 + i, 20)) for i in range(6)]
    rows += [(40, other + other), (41, "ab" * 200), (42, "é" * 150), (43, passage[:120] + passage[:119]), (44, passage[:100])]
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 21, 700])
def test_equals_a_dictionary_of_all_strings(spark, shard_bytes):
    rows = cases()
    spans = S.repeated_spans(documents(spark, rows), 100, shard_bytes)
    got = spans.mapInArrow(S._digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 100)


def test_production_length(spark):
    long = prose(3, 200)
    rows = [(1, long), (2, "x " + long[:400]), (3, "y " + long[:399]), (4, prose(4, 300))]
    got = S.repeated_spans(documents(spark, rows)).mapInArrow(S._digests, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 400)


def test_deduplicated_keeps_columns_and_whole_characters(spark):
    passage = "ö" * 220
    docs = documents(spark, [(1, "a" + passage), (2, "b" + passage), (3, None), (4, "clean")])
    out = S.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a", 2: "b", 3: "", 4: "clean"}
    assert out.filter(F.col("carried_0") != "x").isEmpty()
    assert S.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet", [1, 2, 30])
def test_suffix_array_prefixes_and_search(alphabet):
    rng = np.random.default_rng(alphabet)
    t = rng.integers(1, alphabet + 1, 300)
    sa, _ = suffix_array(t, 8, len(t))
    assert sa.tolist() == sorted(range(300), key=lambda i: t[i:].tolist())
    before = np.full(300, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((t.astype(np.uint8), np.zeros(60, np.uint8)))
    got = common_prefixes(bytes_at(padded), before, [(0, 300)], 40)
    for p in range(300):
        if before[p] >= 0:
            q, n = int(before[p]), 0
            while n < 40 and padded[p + n] == padded[q + n]:
                n += 1
            assert got[p] == n
    patterns = np.stack([t[i : i + 5] for i in range(0, 290, 17)])
    lo, hi = find(t, sa, patterns, np.full(len(patterns), 5))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        assert b - a == sum((t[i : i + 5].tolist() == p.tolist()) for i in range(296))


def test_equal_rows_share_spans_of_one_document(spark):
    text = prose(77, 400)
    sizes = []
    for times in (2, 60):
        rows = S.repeated_spans(documents(spark, [(1, text)] * times + [(None, text)] * times)).collect()
        assert len(rows) == 2 * times
        sizes.append({len(r["spans"]) for r in rows})
    assert sizes[0] == sizes[1]
