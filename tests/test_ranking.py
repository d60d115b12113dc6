import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.text import keywords
from skein.functions.vectors import cosine
from skein.operators import ranking, retrieval


def first(scored, k):
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rows(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


def test_keyword_equals_the_expression_over_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    words = ["abab", "ababab", "aba", "Find", "finder", "KELVIN", "élan", "x_1", "_x", "the", "aaaaa", "aaa", "ab", "İst", "ist", "é", "1abab2", "a" * 300]
    text = lambda n: rng.choice([" ", "-", "é", "_", ""]).join(rng.choice(words) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(n)))
    c = spark.createDataFrame([(f"c{i % 90}", text(12)) for i in range(120)] + [("n", None), ("e", "")], "chunk_id string, content string").repartition(3)
    q = spark.createDataFrame([(i, text(9)) for i in range(25)] + [(30, None), (31, ""), (32, "aaa aaa aba")], "query_id long, text string")
    pairs = c.crossJoin(q.select("query_id", keywords(F.col("text")).alias("terms"))).select("query_id", "chunk_id", retrieval.keyword_score(F.col("content"), F.col("terms")).alias("score")).where("score > 0")
    want = rows(first(pairs, 7).withColumn("score", F.least(F.lit(1.0), "score")))
    assert len(want) > 90 and rows(retrieval.keyword(c, q, 7)) == want
    monkeypatch.setattr(ranking, "CELLS", 60)  # blocks of a few texts; workers read it at their own, so in this process too
    t = ranking.Keywords([["aba", "aaa"], None, ["abab"] * 3])
    assert t.rows == 20 and t.counts(["ababab aaaaa", None, "x"]).T.tolist() == [[1, 1, 1], [0, 0, 0], [0, 0, 0]]


def test_semantic_equals_the_expression_over_all_pairs(spark):
    rng = random.Random(5)
    vec = lambda: rng.choice([None, [], [0.0, 0.0], [1.0, None], *([[rng.choice([-1.5, 0.1, 0.3, 2.0]) for _ in range(rng.choice([3, 3, 5]))]] * 9)])
    c = spark.createDataFrame([(f"c{i}", vec()) for i in range(150)], "chunk_id string, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(i, vec()) for i in range(20)], "query_id long, embedding array<double>")
    pairs = c.crossJoin(q.withColumnRenamed("embedding", "qv")).select("query_id", "chunk_id", cosine(F.col("embedding"), F.col("qv")).alias("score"))
    for least in (-2.0, 0.2):
        assert rows(retrieval.semantic(c, q, 6, least)) == rows(first(pairs, 6).where(F.col("score") >= least))
    assert retrieval.semantic(c, q.where("false"), 6).count() == 0 and retrieval.semantic(c.where("false"), q, 6).count() == 0


def test_pairs_are_not_joined(spark):
    """Before, each pair of query and chunk was a row with the texts of both."""
    c = spark.createDataFrame([("c", "one two", [1.0])], "chunk_id string, content string, embedding array<double>")
    q = spark.createDataFrame([(1, "one", [1.0])], "query_id int, text string, embedding array<double>")
    for found in (retrieval.keyword(c, q), retrieval.semantic(c, q)):
        plan = found._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_of_many_blocks():
    import numpy as np
    import pyarrow as pa

    rng, got = np.random.default_rng(6), ranking._Best(3, 4)
    s = rng.integers(0, 5, (3, 90)).astype(float)
    ids = [f"{i % 40:02}" for i in range(90)]
    for lo in range(0, 90, 7):
        got.add(pa.array(ids[lo : lo + 7]), s[:, lo : lo + 7])
        if lo % 3 == 0:
            got.cut()
    t = got.cut().to_pydict()
    want = [(q, x, i) for q in range(3) for x, i in sorted(((-s[q, r], ids[r]) for r in range(90)))[:4]]
    assert [(q, -x, i) for q, x, i in zip(t["q"], t["score"], t["chunk_id"])] == want
