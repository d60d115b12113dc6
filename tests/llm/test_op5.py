import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import langid
from skein.llm.langid import Parser, fit_languages, identify, op5_language_id, symbols
from skein.llm.text import buffers

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op5_language_id(spark, SF)
    r = got.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 40").toPandas()
    assert got.count() == 1000 and (r.lang_pred == r.lang).mean() > 0.99


def brute(p, k, train, text):
    s, _ = symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    t, _ = symbols(np.frombuffer(train, np.uint8), np.array([0, len(train)]))
    t, n = bytes(t), 0
    x, i = bytes(s), 0
    while i < len(x):
        j = i + 1
        while j <= len(x) and x[i:j] in t:
            j += 1
        if j > len(x):
            break
        # a symbol that never occurs is read as the start of the next, empty phrase
        n += 1
        i = j - 1 if j - 1 > i else i + 1
    return n


@pytest.mark.parametrize("stretch", [5, 64, 256])
def test_phrases_equal_brute_force(monkeypatch, stretch):
    rng = random.Random(4)
    train = {"a": b"the cat sat on the mat and the dog", "b": "élan épée été où ça".encode() * 3}
    texts = [bytes(rng.choice(b"thecatsdon ,.") for _ in range(rng.randrange(0, 900))) for _ in range(40)] + ["ÉTÉ où, le chat".encode(), b""]
    texts += [b"thecatsatonthematandthedog" * 40, b"a" * 700, b"the cat sat on the mat and the dog " * 30]  # phrases longer than a stretch, and that never meet the guess
    train["c"] = b"a" * 600 + b"the cat sat on the mat and the dog " * 12
    p = Parser(train)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    monkeypatch.setattr(langid, "STRETCH", stretch)
    got = p.phrases(buf, off)
    for k, lang in enumerate(p.langs):
        known = set(bytes(symbols(np.frombuffer(train[lang], np.uint8), np.array([0, len(train[lang])]))[0]))
        for i, t in enumerate(texts):
            s = bytes(symbols(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])
            if set(s) <= known:
                assert got[i, k] == brute(p, k, train[lang], t), (lang, t)


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !! 7", "fr"), (4, "the the the", None), (None, "le le", "fr"), (4, "the", None), (5, "÷ × ¿", None), (6, "the " * 100000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = sorted(((r.doc_id, r.lang_pred) for r in identify(docs, {"en": b"the the", "fr": b"le la"}).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "fr"), (4, "en"), (5, "und"), (6, "en")], key=str)
    assert fit_languages(docs.where("false"), F.lit(True)) == {}
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}
    assert identify(docs.where("false"), {"en": b"the"}).count() == 0
    assert list(fit_languages(docs, F.lit(True))) == ["en", "fr"]
    assert buffers(pa.array([None, "a"], pa.string()))[1].tolist() == [0, 0, 1]


def test_score_and_choice_equal_brute_force():
    train = {"a": b"the cat sat on the mat and the dog", "b": "élan épée été où ça".encode() * 3}
    p = Parser(train)
    texts = [b"the dog sat", "où est ça".encode(), b"c", b"catdog", b"t" * 300]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    lang, score = p.predict(buf, off)
    n = p.phrases(buf, off)
    for i in range(len(texts)):
        h = [(n[i, k] + 1) * np.log2(len(symbols(np.frombuffer(train[x], np.uint8), np.array([0, len(train[x])]))[0])) for k, x in enumerate(p.langs)]
        assert lang[i] == p.langs[int(np.argmin(h))] and np.isclose(score[i], 1 - min(h) / max(h))


def test_sample_is_whole_texts(spark):
    rows = [(k, f"text {k} " * 30, "en") for k in range(30)] + [(100 + k, "le seul texte", "fr") for k in range(500)] + [(900, "x" * 5000, "de"), (901, None, "it"), (902, "null", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = fit_languages(docs, F.lit(True), docs_each=4, symbols_each=1000)
    assert set(got) == {"en", "fr", "de"} and got["fr"] == b"le seul texte\n" and got["de"] == b"x" * 1000
    assert all(t in {r[1].strip() for r in rows if r[1]} for t in (x.strip() for x in got["en"].decode().split("\n") if x)) and len(got["en"]) < 1000
