"""Alignment of two tokenizers against the libraries, token by token."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest

from cairn.llm import align as A
from cairn.llm import pieces
from tests.llm.fixtures import ODD, documents


@pytest.fixture(scope="module")
def tokenize():
    tokenizers = pytest.importorskip("tokenizers")
    a = tokenizers.Tokenizer.from_file(A.default_path())
    a.encode_special_tokens = True
    b = pieces.library()
    own = A.aligner()

    def tokens(text):
        """A's and B's ids of a text; none where their bytes aren't the text's."""
        if not text:
            return [], []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        whole = (" " + text).encode()
        if b"".join(own.bytes_a[i] for i in x) != whole or b"".join(b.id_to_piece(i).replace("▁", " ").encode() if not b.is_byte(i) else bytes([int(b.id_to_piece(i)[3:5], 16)]) for i in y) != whole:
            return [], []
        return x, y

    return tokens


def groups(own, x, y):
    out, i, j = [], 0, 0
    while i < len(x):
        a, b = [x[i]], [y[j]]
        n, m = len(own.bytes_a[x[i]]), len(own.bytes_b[y[j]])
        while n != m:
            if n < m:
                i += 1
                a.append(x[i])
                n += len(own.bytes_a[x[i]])
            else:
                j += 1
                b.append(y[j])
                m += len(own.bytes_b[y[j]])
        out.append((a, b))
        i, j = i + 1, j + 1
    return out


def expected(rows, tokenize):
    own = A.aligner()
    found = [(k, *(z := tokenize(t)), groups(own, *z)) for k, t in rows]
    count = Counter(p for *_, g in found for p in {(a, b) for x, y in g for a in x for b in y})
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for k, x, y, g in found:
        links = [(a, b) for p, q in g for a in p for b in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        yield k, len(x), len(y), len(g), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""


STRANGE = [
    "<|endoftext|> and <s> and </s>", "▁", "a ▁ sign", " ", "  two  spaces ", "\n", "x\n\ny \n z", "\ttab\t \t", "é漢字😀 日本語のテキスト", "don't we'LL 'tis", "a" * 5000, "a b " * 3000, "\x00\x1c\x85 　", "naïve naïve naïve", "Ǆ ﬁ ﬃ",
]


def test_documents_align_as_the_libraries_say(spark, tokenize):
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    rows = [*ODD, *enumerate(STRANGE, 20), *((100 + i, t) for i, t in enumerate(texts))]
    found = A.alignment(documents(spark, rows).repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected(rows, tokenize), key=str)


def test_pairs_and_their_documents(spark, tokenize):
    rows = [(1, "the river the river"), (2, "the river"), (3, "The river"), (3, "The river"), (4, None), (5, "no ▁ tokens river")]
    own = A.aligner()
    want = Counter(p for _, t in rows for p in {(a, b) for x, y in groups(own, *tokenize(t)) for a in x for b in y})
    found = A.aligned(documents(spark, rows))[1].collect()
    assert {(r["a"], r["b"]): r["docs"] for r in found} == want
    assert all(r["best"] == (r["docs"] == max(n for (a, _), n in want.items() if a == r["a"])) for r in found)


def test_an_empty_table(spark):
    assert A.alignment(documents(spark, [(1, "x")]).limit(0)).count() == 0
    assert A.alignment(documents(spark, [(1, None), (2, "")])).count() == 2


def test_small_stretches_change_nothing(spark, tokenize, monkeypatch):
    own = A.aligner()
    text = "some words, and some other\nwords  with  two spaces " * 40
    monkeypatch.setattr(A, "STRETCH", 64)
    monkeypatch.setattr(A, "KEPT", 3)
    assert [w for s in A.stretches(text) for w in A.words(s)] == A.words(text)
    import pyarrow as pa

    batch = next(A.block(own, 0, pa.array([1], pa.int64()), iter([text]))).to_pylist()[0]
    assert batch["groups_sha256"] == next(expected([(1, text)], tokenize))[-1]
