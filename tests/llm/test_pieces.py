"""The agenda of symbol pairs against the sentencepiece library, and merging by plain search for the best pair."""

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import pieces as P
from tests.llm.fixtures import ODD, documents


@pytest.fixture(scope="module")
def library():
    pytest.importorskip("sentencepiece")
    return P.library()


PARTS = st.sampled_from(["<s>", "</s>", "<unk>", "<0x41>", "▁", "  ", " ", "\n", "\t", "the ", "don't", "é", "Å", "😀", "\x00", "\x85", "　", "123", "!!??", "ﬁ", "한국", "​"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=12), st.text("abcdeinorst ", min_size=1, max_size=60)), max_size=8).map(lambda x: "".join(x)))
def test_any_text_encodes_as_the_library_does(library, text):
    p = P.pieces()
    ids = p.encode(text)
    assert ids == library.encode(text)
    assert p.decode(ids) == library.decode(ids)
    assert p.agrees(library)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=8))
def test_any_ids_decode_as_the_library_does(library, ids):
    assert P.pieces().decode(ids) == library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.text("abehinort. ", min_size=1, max_size=60))
def test_the_agenda_merges_the_best_pair_again_and_again(text):
    p = P.pieces()
    plain = list(text)
    while pairs := [(p.rank[a + b], i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False)) if a + b in p.rank]:
        at = min(pairs)[1]
        plain[at : at + 2] = [plain[at] + plain[at + 1]]
    assert p.merged(text) == plain


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 10_000, "xyzzy" * 10_000, "é漢" * 10_000])
def test_long_stretches(library, text):
    assert P.pieces().encode(text) == library.encode(text)


def test_documents_encode_as_the_library_does(spark, library):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    rows = [*ODD, (50, "two  spaces and ▁ and one at the end "), *((100 + i, t) for i, t in enumerate(texts))]
    want = []
    for k, t in rows:
        ids = library.encode(t or "")
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True))
    docs = documents(spark, rows)
    assert sorted((tuple(r) for r in P.token_digests(docs).collect()), key=str) == sorted(want, key=str)
    encoded = P.encode(docs)
    assert {(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()} == {(k, tuple(library.encode(t or ""))) for k, t in rows}
    assert {(r["doc_id"], r["text"]) for r in P.decode(encoded).collect()} == {(k, library.decode(library.encode(t or ""))) for k, t in rows}
    assert P.token_digests(docs.limit(0)).count() == 0


def test_few_kept_stretches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(P, "KEPT", 3)
    p = P.Pieces(P.default_path())
    for text in ("some words and some other words and some words", "and other unreasonable words"):
        assert p.encode(text) == library.encode(text)


def test_a_difference_is_told(library):
    p = P.Pieces(P.default_path())
    p.rank = {k: v for k, v in p.rank.items() if k != " words"}
    p.encode("other words")
    assert not p.agrees(library)
    assert p.agrees(library)  # nothing new
