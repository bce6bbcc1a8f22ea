"""Decontamination, search, main text, archives and the pipeline on small tables."""

import base64
import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import decontam, html, nearest, warc
from tests.llm.fixtures import ODD, documents, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


ITEMS = [("q1", prose(900, 30)), ("q2", "Short Item here"), ("q3", None), ("q4", "  !! "), (None, prose(901, 12)), ("q5", prose(900, 30))]


def test_hits_equal_a_plain_scan(spark):
    item = prose(900, 30).split()
    rows = [*ODD, (50, prose(5, 40) + " " + " ".join(item[3:16]) + " " + prose(6, 9)), (51, " ".join(item[3:12])), (52, "a SHORT, item! Here b"), (53, " ".join(item).upper()), (54, prose(901, 12)), (55, "short item")]
    want = []
    for k, t in rows:
        w, hit, items = words(t), set(), set()
        for name, text in ITEMS:
            own = words(text)
            n = min(10, len(own))
            for at in range(len(own) - n + 1) if own else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == own[at : at + n]:
                        hit |= set(range(i, i + n))
                        items.add(name or "")
        want.append((k, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    docs, bench = documents(spark, rows), spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id string, text string, n_words string")
    got = decontam.contamination(docs, bench).drop("longest_match").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    clean = decontam.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[-1])
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").isEmpty()
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs, bench = documents(spark, [(1, prose(900, 30)), (2, "short item here"), (3, prose(901, 12))]), spark.createDataFrame(ITEMS, "item_id string, text string")
    want = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect())) == want


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")


def test_neighbours_equal_all_products(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(700)]
    rows += [(700 + i, rows[0][1]) for i in range(60)] + [(800, None), (820, []), (821, [0.0] * 8), (840, [1.0] * 7 + [float("nan")]), (860, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    monkeypatch.setattr(nearest, "SHARD_ROWS", 150)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 20)
    monkeypatch.setattr(nearest, "LEAF", 16)
    vectors = _vectors(spark, rows)
    got = sorted(map(tuple, nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20).collect()))
    ok = [(i, np.array(v)) for i, v in rows if i is not None and i < 800]
    want = []
    for q, v in ok:
        if q % 20 == 0:
            near = sorted(((-float(sum(a * b for a, b in zip(v, x, strict=True))), i) for i, x in ok if i != q))[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])
    approximate = {(r["query_id"], r["vec_id"]) for r in nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20, 0.8).collect()}
    assert len(approximate & {(w[0], w[2]) for w in want}) >= 0.9 * len(want)


def test_few_and_no_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 2.0, 3.0])]
    vectors = _vectors(spark, rows)
    assert [tuple(r) for r in nearest.nearest(vectors, vectors.filter("vec_id = 0")).collect()] == [(0, 1, 1, 0.5)]
    assert nearest.nearest(vectors.limit(0), vectors.limit(0)).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<article><h1>The &quot;heading&quot; of it</h1><p>This is the first paragraph of the text, and it says   what the
page is about in a number of words that is long enough for the rules to see that it is one of those.</p>
<p>A short one.</p><p>And here is a second paragraph which, as the first does, goes on for a while so that it is not in any
doubt that this &amp; that belong to the article and to nothing else on the page.</p></article>
<div class="sidebar"><p>This is what the side bar says, and it says it at some length so that it looks like a text of its own.</p></div>
<div id="comments"><p>I think that this is a comment of a reader who has a lot to say about the article and its heading.</p></div>
<footer><p>Copyright of the page and all that is in it, with the terms of use and the policy on privacy.</p></footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "<" * 5000), (None, "u", "plain & simple")]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")).collect()}
    blocks = got[1]["text"].split("\n\n")
    assert [b.split(" ")[0] for b in blocks] == ["The", "This", "A", "And"]
    assert blocks[0] == 'The "heading" of it' and "this & that" in blocks[3] and "  " not in blocks[1]
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert len(got) == len(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_archives_read_back(spark, version):
    big = prose(1, 50_000)
    rows = [(3, "http://h/a b", "same\r\n\r\nbody"), (1, "http://h/b", "same\r\n\r\nbody"), (2, None, None), (5, "u", ""), (6, "u", big), (7, "u", "WARC/1.1\r\n\r\nümlaut 😀\n"), (None, "u", "same\r\n\r\nbody"), (7, "u", "again")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(3)
    got = warc.read_warc(spark, warc.convert(spark, warc.write_arc(pages, version))).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = []
    for k, _, t in rows:
        same = [i for i, _, o in rows if (o or "") == (t or "") and i is not None]
        first = min(same)
        own = k == first
        want.append((k, len((t or "").encode()), digest(t or ""), "response" if own else "revisit", None if own else first))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(spark, warc.convert(spark, warc.write_arc(pages))).count() == 0


def test_header_lines_of_an_archive_written_elsewhere():
    block = b"2 0 someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    data = b"filedesc://x 0.0.0.0 20010203040506 text/plain 200 - - 0 x.arc %d\n" % len(block) + block + b"\nhttp://a/ 1.2.3.4 20010203 text/html 200 - - 9 x.arc 5\nhello\n"
    (_, head, content), = warc.arc_records(data)
    assert (head["URL"], content) == ("http://a/", b"hello")
    assert warc.timestamp(head["Archive-date"]) == "2001-02-03T00:00:00Z"


def test_pipeline_stages_have_an_effect_and_keep_clean_documents(spark, tmp_path):
    clean = [(i, f"Number {i}. " + prose(i, 120)) for i in range(40)]
    passage = prose(999, 90)
    rows = [*clean, (100, clean[3][1]), (101, "12345 67890"), (102, prose(102, 40) + " " + passage), (103, prose(103, 40) + " " + passage), (104, prose(104, 60) + " " + prose(900, 30)), (105, None)]
    docs = documents(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at, sizes = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, at, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == before.columns
        sizes[name] = {r["doc_id"] for r in at.select("doc_id").collect()}
    assert set(range(40)) <= sizes["tokens"]
    assert not {101, 105} & sizes["language"]
    assert 100 in sizes["language"] and 100 not in sizes["near_duplicates"]
    assert 104 in sizes["repeated_passages"] and 104 not in sizes["benchmark_leaks"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == sizes["tokens"]


def test_neighbours_of_repeated_ids_equal_the_sql(spark, monkeypatch, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6)]) for i in range(300)]
    rows += [rows[20]] + [rows[40]] * 29 + [(60, [float(x) for x in rng.integers(-9, 9, 6)])] + [rows[7]] * 24
    vectors = _vectors(spark, rows)
    vectors.coalesce(1).write.parquet(str(tmp_path / "v"))
    duckdb_rows = duckdb.sql(nearest.SQL["op6_nearest"].replace("FROM embeddings", f"FROM '{tmp_path}/v/*.parquet'")).fetchall()
    for size in (10_000, 100):
        monkeypatch.setattr(nearest, "SHARD_ROWS", size)
        got = nearest.nearest(vectors, vectors.filter("vec_id % 20 = 0")).collect()
        assert sorted(map(tuple, got)) == sorted(duckdb_rows)


LONG_TEXT = "This is the text of the page, and it says what the page is about in a number of words that is long enough for the rules to see that it is one of those which the page was made for, and so it has to stay in what they find."


@pytest.mark.parametrize("around", ["<div class='content has-sidebar'>", "<div id='no-ads'>", "<section class='share-prices'>", "<div class='content sidebar'>"])
def test_names_do_not_overrule_the_text_they_hold(around):
    ad = "<div class='ad'><p>Buy the best of all things in the shop that is at the end of this street and is open to all.</p></div>"
    for inner in (f"<p>{LONG_TEXT}</p>", f"<article><p>{LONG_TEXT}</p></article>"):
        assert html.main_text(f"<body>{around}{inner}{ad}</div></section></body>") == LONG_TEXT


@pytest.mark.parametrize("tag", ["svg", "object", "canvas", "audio", "video", "template", "noscript"])
def test_unclosed_silent_elements_end_with_the_element_around(tag):
    page = f"<body><div><p>{LONG_TEXT}</p><{tag} width='1'>unseen words</div><p>{LONG_TEXT}</p></body>"
    assert html.main_text(page) == f"{LONG_TEXT}\n\n{LONG_TEXT}"
