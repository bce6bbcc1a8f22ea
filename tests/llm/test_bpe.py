"""The token automaton against the tokenizers library, and BPE by plain merging."""

import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import bpe as B
from tests.llm.fixtures import ODD, documents


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(B.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


PARTS = st.sampled_from(["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "don't", "we'LL", "ΑΣ", "é", "Å", "İ", "😀", "\x1c", "\x85", "　", "123", "!!??", "Straße", "ǅ", "ﬁ", "한국", "​"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PARTS, st.text(max_size=12), st.text("abcdeinorst", min_size=1, max_size=20)), max_size=8).map(lambda x: "".join(x)))
def test_any_text_encodes_as_the_library_does(library, text):
    t = B.tokenizer()
    ids = t.encode(text)
    assert (ids, t.decode(ids)) == expected(library, text)


def test_documents_encode_as_the_library_does(spark, library):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(texts))]
    want = []
    for k, t in rows:
        ids, text = expected(library, t)
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    docs = documents(spark, rows)
    assert sorted((tuple(r) for r in B.token_digests(docs).collect()), key=str) == sorted(want, key=str)
    encoded = B.encode(docs)
    assert {(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()} == {(k, tuple(expected(library, t)[0])) for k, t in rows}
    assert {(r["doc_id"], r["text"]) for r in B.decode(encoded).collect()} == {(k, expected(library, t)[1]) for k, t in rows}
    assert B.token_digests(docs.limit(0)).count() == 0


def test_tables_of_bounded_size_change_nothing(monkeypatch, library):
    monkeypatch.setattr(B, "KEPT_CHUNKS", 3)
    monkeypatch.setattr(B, "KEPT_STATES", 2)
    t = B.Tokenizer(B.default_path())
    for text in ("antidisestablishmentarianism and other unreasonable words", "supercalifragilisticexpialidocious words"):
        assert t.encode(text) == expected(library, text)[0]
