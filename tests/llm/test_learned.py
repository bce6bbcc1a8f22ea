"""Language, toxicity and language-model scores on held-out rows, and their odd cases."""

import math
import os
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from cairn.llm import langid, lm, toxicity
from cairn.llm.common import id_bucket
from tests.llm.fixtures import ODD, documents, prose

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_language_of_held_out_documents(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    rows = [r for r in langid.op5_langid(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(rows) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.97


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n
        if n > 2:
            assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 2


def test_odd_texts_have_a_language_or_none(spark):
    docs = documents(spark, ODD)
    rows = langid.predict(docs, langid.fit(docs)).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"} and {r["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 6, 8)} == {"en"}
    nothing = langid.predict(docs, langid.fit(docs.limit(0))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), langid.fit(docs)).count() == 0


def counted(text):
    """Trigrams of a text between two spaces, in the buckets that the operator gives them."""
    data = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()) + b" "
    codes = (int.from_bytes(data[i : i + 3], "little") for i in range(len(data) - 2))
    return Counter(max(1, (c * 0x9E3779B1 & 0xFFFFFFFF) >> 16) for c in codes)


def brute_language(text, counts):
    """The codeword of least weighted loss, from dictionaries of trigram counts."""
    langs, size = sorted(counts), langid.BUCKETS
    p = [np.array([(counts[x][b] + 0.5) / (counts[x].total() + 0.5 * size) for b in range(size)]) for x in langs]
    code, own, loss = langid.codewords(len(langs)), counted(text), np.zeros(len(langs))
    weight, margins = [], []
    for bit in code.T:
        one, zero = (np.mean([x for x, c in zip(p, bit, strict=True) if c == side], axis=0) for side in (1, -1))
        weight.append(1 - np.minimum(one, zero).sum())
        margins.append(sum(n * math.log(one[b] / zero[b]) for b, n in own.items()) / own.total())
    for i, word in enumerate(code):
        loss[i] = sum(w * math.log1p(math.exp(-langid.SHARPNESS * m * c)) for w, m, c in zip(weight, margins, word, strict=True)) / sum(weight)
    first, second = np.sort(loss)[:2]
    return langs[int(np.argmin(loss))], 1 / (1 + math.exp(-4 * (second - first)))


def test_equals_dictionaries_of_trigrams(spark):
    r = random.Random(3)
    letters = {"aa": "abcdefgh ", "bb": "efghijkl ", "cc": "ijklmnab É"}
    said = lambda lang, n: "".join(r.choice(letters[lang]) for _ in range(n)) + "x"
    taught = [(i, said(lang, 300), lang) for i, lang in enumerate([*letters] * 4)]
    asked = [(100 + i, said(lang, 5 + 40 * i), None) for i, lang in enumerate([*letters] * 3)]
    asked.append((200, said("aa", 5 * langid.SLICE_BYTES // 2), None))  # taken piece by piece
    counts = {lang: sum((counted(t) for _, t, own in taught if own == lang), Counter()) for lang in letters}
    docs = spark.createDataFrame(taught + asked, "doc_id long, text string, lang string")
    rows = {x["doc_id"]: x for x in langid.predict(docs, langid.fit(docs)).collect()}
    for i, text, _ in asked:
        lang, score = brute_language(text, counts)
        assert rows[i]["lang_pred"] == lang and abs(rows[i]["score"] - score) < 1e-4


def test_toxic_held_out_documents(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    rows = [r for r in toxicity.op2_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = ([r["score"] for r in rows if truth[r["doc_id"]] == v] for v in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.95
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def brute_segments(scores):
    """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
    best, span = 0.0, None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            total = sum(scores[i : j + 1])
            if total > best + 1e-12:
                best, span = total, (i, j)
    if span is None:
        return []
    i, j = span
    return [*brute_segments(scores[:i]), (i, j, best), *[(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(scores[j + 1 :])]]


def test_segments_are_all_the_maximal_ones():
    rng = np.random.default_rng(9)
    for _ in range(200):
        n = int(rng.integers(1, 25))
        hot = np.flatnonzero(rng.random(n) < 0.4)
        score = rng.uniform(0.1, 1.5, len(hot))
        line = np.full(n, -0.37)
        line[hot] = score
        got = toxicity.maximal_segments(hot, score, 0.37)
        want = brute_segments(line.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxicity_of_odd_texts_without_labels(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 1), (None, 1, 1), (5, None, None), (9, 0, 0)], "doc_id long, toxic int, quality int")
    for own in (labels, labels.limit(0)):
        rows = toxicity.score(docs, toxicity.fit(docs, own)).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def words(text):
    out = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w]


def test_base_scores_equal_counting(spark):
    rows = [(i, t) for i, t in ODD if i is not None] + [(100 + i, prose(i, 25)) for i in range(30)]
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows}
    counts = Counter(w for k, t in rows if not held[k] for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((k, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), 6)) for k, t in rows)
    got = lm.score(documents(spark, rows), id_bucket("doc_id", 10) == 0).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_probabilities_of_all_texts_of_one_symbol_sum_to_one(spark):
    model = lm.Model(np.random.default_rng(0).integers(0, 3, lm.OFFSETS[-1]))
    texts = np.array([b for b in range(255) if not 65 <= b <= 90], np.uint8)  # of upper and lower case letters one is counted
    first = np.exp(model.scores(np.zeros(0, np.uint8), np.zeros(2, np.int64)))[0]
    s, at = lm.symbols(texts, np.arange(len(texts) + 1))
    assert 0 < first < 1 and len(s) == 2 * len(texts) and at[-1] == len(s)
    two = np.exp(model.scores(texts, np.arange(len(texts) + 1)))
    assert first + two.sum() <= 1.0001


def test_the_model_beats_the_base_on_held_out_documents(spark):
    rows = [r for r in lm.op7_lm(spark, SF).collect() if r["held_out"]]
    assert len(rows) > 30 and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_of_nothing(spark):
    docs = documents(spark, ODD)
    assert lm.score(docs.limit(0), id_bucket("doc_id", 10) == 0).count() == 0
    assert {r["train_tokens"] for r in lm.score(docs, id_bucket("doc_id", 1) == 0).collect()} == {0}


def test_short_texts_adapt_their_mixer(monkeypatch):
    model = lm.Model(np.random.default_rng(0).integers(0, 3, lm.OFFSETS[-1]))
    text = np.frombuffer((" a river bends" * 20).encode(), np.uint8)
    adapted = model.scores(text, np.array([0, len(text)]))
    monkeypatch.setattr(lm, "RATE", 0.0)
    monkeypatch.setattr(lm, "BIAS_RATE", 0.0)
    assert len(text) < 512 and model.scores(text, np.array([0, len(text)]))[0] != adapted[0]


def test_a_mixer_learns_its_start_by_gate():
    texts = [np.frombuffer(prose(i, 400).encode(), np.uint8) for i in range(8)]
    s, at = lm.symbols(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    kinds = lm.codes(s, at)
    model = lm.Model(np.bincount(s, minlength=256))
    model.mixed(s, at, kinds, lm.Counts(*lm.tally(np.concatenate(kinds))), learn=True)
    assert len(np.unique(model.weights)) > lm.GATES and (model.weights != lm.WEIGHT).any() and model.bias.any()


def test_contexts_are_kept_apart_however_many():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(30_000))
    buf = np.frombuffer(text.encode(), np.uint8)
    s, at = lm.symbols(buf, np.array([0, len(buf)]))
    kinds = lm.codes(s, at)
    pieces = text.split(" ")
    want = Counter((w[:i], (w + " ")[i]) for w in pieces[:-1] for i in range(len(w) + 1))  # the last word ends with END
    x, n = lm.tally(kinds[2][: -len(pieces[-1]) - 1])
    assert len(want) > 1 << 16 and sorted(n.tolist()) == sorted(want.values())
    assert lm.Counts(x, n).words(kinds[2][s == 32]).tolist() == [want[w, " "] for w in pieces[:-1]]


def test_equal_rows_are_dealt_to_several_groups(spark):
    rows = spark.range(0, 24, 1, 1).selectExpr("7L doc_id", "cast(repeat('word ', 200000) as binary) text", "true train")
    groups = rows.mapInArrow(lm._group(1), lm.FIELDS).filter("range = -1").groupBy("part").count().collect()
    assert sum(r["count"] for r in groups) == 24 and len(groups) > 3


def test_every_group_teaches_the_start_of_the_mixer(spark):
    texts = [prose(i, 60) for i in range(60)]
    docs = documents(spark, list(enumerate(texts))).select("doc_id", F.col("text").cast("binary").alias("text"), (F.col("doc_id") % 10 != 0).alias("train"))
    grouped = lm.staged(docs.repartition(12, "doc_id").mapInArrow(lm._group(1), lm.FIELDS), "groups")
    answers = lm.staged(grouped.filter("range >= 0").select("part", "range", "codes", "counts").groupBy("range").applyInArrow(lm._answer, lm._ANSWERS), "answers")
    model = lm.fit(grouped, answers)
    rows, told = grouped.filter("range = -1").select("part", "text", "train").toArrow(), answers.select("part", "range", "sizes", "symbols", "counts").toArrow()
    s, _ = lm.symbols(*lm._joined([np.frombuffer(t.encode(), np.uint8) for i, t in enumerate(texts) if i % 10]))
    counts = np.bincount(s, minlength=256)
    counts[lm.END] = sum(i % 10 != 0 for i in range(60))
    run, parts = lm._teach(counts), sorted(set(rows["part"].to_pylist()))
    learned = [run((p,), *(t.filter(pc.equal(t["part"], p)) for t in (rows, told))).to_pylist() for p in parts]
    learned = [x for own in learned for x in own]
    assert len(learned) > 8
    n = sum(x["symbols"] for x in learned)
    for name in ("weights", "bias"):
        mean = sum(x["symbols"] / n * np.frombuffer(x[name], np.float32).astype(float) for x in learned)
        assert np.allclose(getattr(model, name).reshape(-1), mean, atol=1e-6)


def test_codes_of_one_context_hand_it_on_once():
    x = np.unique(np.concatenate(lm.codes(*lm.symbols(np.frombuffer(prose(1, 500).encode(), np.uint8), np.array([0, len(prose(1, 500).encode())])))))
    assert (lm.unplaned(lm.planes(x)) == x).all() and len(lm.unplaned(lm.planes(x[:0]))) == 0
    assert len(lm.planes(x)) < 8 * len(x)


def test_the_mixer_learns_from_each_symbol_as_often_as_it_occurs():
    text = np.frombuffer(prose(5, 300).encode(), np.uint8)
    learned = []
    for times in (1, 3):
        s, at = lm.symbols(np.tile(text, times), np.arange(times + 1) * len(text))
        kinds = lm.codes(s, at)
        model = lm.Model(np.bincount(s[: len(text) + 1], minlength=256))
        model.curvature *= times
        counts = lm.Counts(*lm.tally(np.concatenate(lm.codes(s[: len(text) + 1], at[:2]))))
        plain = model.mixed(s, at, kinds, counts, learn=True)
        assert np.allclose(plain, plain[0])
        learned.append((model.weights, model.bias))
    for one, three in zip(*learned, strict=True):
        assert np.allclose(one, three, atol=1e-4)


def test_what_no_later_job_reads_is_not_kept(spark, monkeypatch):
    kept, name = {}, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name), []

    def staged(df, what, **options):
        seen.append(spark.conf.get(name))
        kept[what] = plain(df, what, **options)
        return kept[what]

    plain = lm.staged
    monkeypatch.setattr(lm, "staged", staged)
    rows = lm.score(documents(spark, [(i, prose(i, 40)) for i in range(20)]), id_bucket("doc_id", 10) == 0)
    there = {}
    for what, df in kept.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        there[what] = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert there == {"groups": False, "answers": True, "texts": True}
    assert set(seen) == {"true"} and spark.conf.get(name) == before and rows.count() == 20


def test_workers_give_memory_back_after_each_group(monkeypatch):
    """Workers kept what they had freed, and an executor went beyond 3000 MB on 0.51 GB."""
    calls = []
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    monkeypatch.setattr(lm, "give_back", lambda: calls.append(1))
    batches = list(lm._group(1)(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [b"one two", b"two three"], "train": [True, False]})])))
    rows = pa.Table.from_batches(batches).filter(pc.field("range") >= 0)
    answers = lm._answered(rows.select(["part", "range", "codes", "counts"]))
    assert len(calls) == 1 and answers.equals(lm._answer(rows.select(["part", "range", "codes", "counts"])))
    packed = pa.Table.from_batches(lm._pack(b for b in batches if b["doc_id"][0].is_valid))
    assert lm._opened(lambda key, texts, answers: texts)((0,), packed, None)["doc_id"].to_pylist() == [1, 2] and len(calls) == 2
