import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm.pii import base_spans
from tests.llm.test_op2 import brute as brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{at}/{k}")
        out.append(docs)
        docs = spark.read.parquet(f"{at}/{k}")
    return [*out, docs]


def test_stages(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "pii", "pack"]
    for a, b in zip(stages[:4], stages[1:5]):
        assert b.columns == a.columns and 0 < b.count() <= a.count()


def test_near_dedup_equals_brute_force(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = sorted(i for i, _, _, c in brute_near(rows) if i == c)
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def test_kept_texts_hold_no_whole_item(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = [r.text for r in stages[2].collect()]
    after = [r.text for r in stages[3].collect()]
    assert any(i in t for t in before for i in items) or len(before) == len(after)
    assert not any(i in t for t in after for i in items)


def test_no_base_span_is_left(stages):
    after = {r.doc_id: r for r in stages[4].collect()}
    for r in stages[3].collect():
        n = after[r.doc_id]
        assert (n.text == r.text) == (not base_spans(r.text) and "<ID>" not in n.text)
        assert n.n_chars == len(n.text) and not base_spans(n.text)


def test_packing_holds_every_token(stages):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in stages[5].collect():
        got.setdefault(r.doc_id, []).append(r)
    docs = stages[4].collect()
    assert set(got) == {r.doc_id for r in docs}
    for r in docs[:60]:
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert all(zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for p in got[r.doc_id])
        assert sum(p.length for p in got[r.doc_id]) * 4 == len(ids)


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[5].collect()))


def test_keep_one_on_odd_rows(spark):
    from skein.llm.simhash import keep_one

    df = spark.createDataFrame([(1, "a b c d", "x"), (1, "a b c d", "y"), (2, "a b c d", "x"), (None, "a b c d", "z"), (3, None, "q"), (4, "", "r"), (5, "other words here now", None)], "doc_id long, text string, fp string")
    assert sorted((r.doc_id for r in keep_one(df).collect()), key=str) == [1, 3, 5, None]


def odd(spark, at, rows):
    """Tables with nulls, repeated rows and columns that clash with names used inside."""
    names = "doc_id long, text string, lang string, source string, n_chars long, y int, score double, _th string, fp long, h long, low long, part int, spans string"
    docs = spark.createDataFrame([(*r, None, None, len(r[1] or ""), 7, 0.5, "t", 1, 2, 3, 4, "s") for r in rows], names)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (None, "x y z"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return docs


def test_odd_rows_through_the_stages(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, "plain words of a text"), (1, "plain words of a text"), (1, "quite other words under the same id"), (2, None), (2, None), (3, ""), (None, "no id here"), (None, "no id here"), (4, "before " + item + " after"), (5, "mail me at a.b@c.de now"), (6, "long " * 30_000), (None, None)]
    docs = odd(spark, tmp_path, rows)
    kept = docs
    for k, (name, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        f(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/kept{k}")
        kept = spark.read.parquet(f"{tmp_path}/kept{k}")
        assert kept.columns == docs.columns, name
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = [(1, rows[0][1]), (1, rows[2][1]), (2, None), (None, "no id here"), (None, "no id here"), (5, "mail me at <EMAIL> now"), (6, rows[10][1]), (None, None)]
    assert left == sorted(want, key=str)  # 3 is empty like 2, 4 holds the item
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({str(r.doc_id) for r in out}) == ["1", "2", "5", "6", "None"] and all(r.offset + r.length <= 4096 for r in out)


def test_empty_documents(spark, tmp_path):
    odd(spark, tmp_path, [(1, "x")]).where("false").write.mode("overwrite").parquet(f"{tmp_path}/none.parquet")
    import shutil

    shutil.rmtree(tmp_path / "documents.parquet")
    shutil.move(tmp_path / "none.parquet", tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxicity_stage_holds_every_pair(spark, tmp_path, monkeypatch):
    from tests.llm.test_op9 import corpus, holds_every_pair

    docs, labels = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    holds_every_pair(monkeypatch, docs, lambda: corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)))
