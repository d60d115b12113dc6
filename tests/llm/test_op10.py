import numpy as np
from pyspark.sql import functions as F

from skein.llm.labelled import crc_mod
from skein.llm.quality import NAMES, Trees, fit_quality, op10_quality_classifier, score_quality, statistics
from skein.llm.text import buffers
import pyarrow as pa

SF = "/root/testdata/sf0.01"


def test_statistics_by_hand():
    x = statistics(*buffers(pa.array(["", None, "AB ab!! a|b\nab\nab", "ü ü"], pa.string())))
    s = [dict(zip(NAMES, r)) for r in x]
    assert np.allclose(x[0], 0) and np.allclose(x[1], 0)
    a = s[2]
    assert np.isclose(a["upper"], 2 / 17) and np.isclose(a["bang"], 2 / 17) and np.isclose(a["newline"], 2 / 17)
    assert np.isclose(a["log_words"], np.log1p(6)) and np.isclose(a["top_word"], 4 / 6) and np.isclose(a["unique_words"], 3 / 6)
    assert np.isclose(a["unique_lines"], 2 / 3) and np.isclose(a["same_as_last"], 2 / 6) and np.isclose(a["odd_words"], 2 / 5)
    assert np.isclose(s[3]["unique_words"], 0.5)


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    t = Trees().fit(x[:2000], y[:2000])
    assert ((t.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = t.start
        for r in t.roots:
            k = r
            while t.feature[k] >= 0:
                k = t.left[k] + (row[t.feature[k]] > t.cut[k])
            total += t.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], t.predict(x[:50]))
    assert np.allclose(Trees().fit(x[:0], y[:0]).predict(x[:3]), 0.5)


def test_held_out_accuracy(spark):
    got = op10_quality_classifier(spark, SF)
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    r = got.where("held_out").join(lab, "doc_id").toPandas()
    assert got.count() == 1000 and len(r) > 60
    pos, neg = r.score[r.quality == 1].to_numpy(), r.score[r.quality == 0].to_numpy()
    assert (pos[:, None] > neg).mean() > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "x", 5.0), (1, "", 5.0), (2, "a " * 200000, 1.0)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert score_quality(docs, fit_quality(docs, lab, F.lit(True))).count() == 4
    none = fit_quality(docs, lab.where("false"), crc_mod(F.col("doc_id"), 4) != 2)
    assert [r.score for r in score_quality(docs, none).collect()] == [0.5] * 4
    assert score_quality(docs.where("false"), none).count() == 0


def plain_statistics(text):
    """The statistics of one text by plain Python over its bytes."""
    import math
    import re
    from collections import Counter

    b = (text or "").encode()
    n = max(len(b), 1)
    count = lambda chars: sum(x in chars for x in b)
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", b)]
    words = [bytes(x + 32 if 65 <= x <= 90 else x for x in w) for w in words]
    spaced = re.findall(rb"[^\x20\x09-\x0d]+", b)
    lines = [x for x in b.split(b"\n") if x.strip(b"\x00")]
    k, top = max(len(words), 1), Counter(words)
    pairs, ln = set(zip(words, words[1:])), [len(w) for w in words]
    mean = sum(ln) / k
    odd = set(b"!|*&#$%@^~<>{}[]\\=+")
    stop = count(b".")
    return [
        math.log1p(len(b)), math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in ln) / k - mean**2, 0)), count(bytes(range(65, 91))) / n, count(b"0123456789") / n, count(b"!") / n, count(b"*&#$%@^~<>{}[]\\=+") / n, count(b"|") / n,
        stop / n, count(b",;:") / n, count(b"\n") / n, count(bytes(range(128, 256))) / n, count(b" \t\r") / n, len(top) / k, max(top.values(), default=0) / k, sum(x == y for x, y in zip(words, words[1:])) / k,
        len(pairs) / max(len(words) - 1, 1), math.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), max(Counter(lines).values(), default=0) / max(len(lines), 1), sum(bool(set(w) & odd) for w in spaced) / max(len(spaced), 1), sum(x <= 3 for x in ln) / k,
        math.log1p(len(words) / (stop + 1)), count(b"\"'`") / n,
    ]


def test_scores_equal_plain_python(spark):
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a\n\na a!! |\n"), (-4, "a\n\na a!! |\n")], "doc_id long, text string"))
    rows = docs.orderBy("doc_id").limit(80).collect()
    trees = fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    some = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_quality(some, trees).collect()}
    for r in rows:
        x, total = plain_statistics(r.text), trees.start
        for at in trees.roots:
            while trees.feature[at] >= 0:
                at = trees.left[at] + (x[trees.feature[at]] > trees.cut[at])
            total += trees.value[at]
        assert math.isclose(got[r.doc_id], 1 / (1 + math.exp(-total)), abs_tol=1e-9), r.doc_id
    assert got[-3] == got[-4]  # equal texts, equal scores
