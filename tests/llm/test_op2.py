import random
import re

import xxhash
from pyspark.sql import functions as F

from skein.llm.simhash import components, fingerprint, near_duplicates, near_pairs


def brute_fp(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(rows):
    fp = [brute_fp(t) for _, t in rows]
    link = [[j for j in range(len(rows)) if j != i and (fp[i] ^ fp[j]).bit_count() <= 4] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], f"{fp[i]:016x}", len(link[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    texts = ["", None, " \t\n", "One", "one", "a b c", "a b c d", "ÀB c\x0bd\x85e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(60, 160))]
        for _ in range(rng.randrange(1, 8)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += texts[-3:]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    null = [(None, rows[2][1]), (None, "nothing like it anywhere at all here")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in [*rows, rows[0], *null]], "doc_id long, text string, fp int, root string")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == brute([*rows, rows[0], *null])
    assert max(g[2] for g in got) > 1


def test_every_close_pair_is_met_once(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps |= {f} | {f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(4)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = sorted((a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for count in (len(fps), 1 << 22):
        assert sorted(tuple(r) for r in near_pairs(df, count).collect()) == want


def test_components(spark):
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(40)]
    rng.shuffle(chain)
    edges = [*chain, (100, 101), (101, 100), (200, 150), (200, 160), (7, 7)] + [(1000 + i, 999) for i in range(30)]
    got = dict((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 160: 150, 200: 150} | {i: 999 for i in range(999, 1030)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_near, r.component_id) for r in near_duplicates(df).collect()), key=str) == [(1, 2, 1), (2, 2, 1), (None, 2, 1)]
    assert near_duplicates(df.where(F.lit(False))).count() == 0
    assert fingerprint(b"") == 0


def test_hot_blocks_are_dealt_out(spark):
    rng = random.Random(3)
    low = list({rng.getrandbits(12) for _ in range(150)})  # they share every block but the last
    df = spark.createDataFrame([(f,) for f in low], "fp long")
    want = sorted((a, b) for a in low for b in low if a < b and (a ^ b).bit_count() <= 4)
    for block in (7, 10**6):
        assert sorted((r.a, r.b) for r in near_pairs(df, len(low), block=block).collect()) == want


def test_keep_one_decides_by_text(spark, monkeypatch):
    from skein.llm import simhash

    a, b = "one two three four five six", "quite another text that has nothing of it"
    rows = [(1, a, "x"), (2, a, "p"), (2, b, "q"), (3, b, "r"), (4, a.upper(), "s"), (5, "x y z w v", "t"), (5, "x y z w v", "u"), (None, a, "v"), (6, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _th string").repartition(3)
    for sent in (100, 0):
        monkeypatch.setattr(simhash, "SENT", sent)
        got = simhash.keep_one(df)
        assert got.columns == df.columns
        out = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
        assert out == sorted([(1, a), (2, b), (5, "x y z w v"), (6, None), (None, a)], key=str)
        assert simhash.keep_one(df.where("false")).count() == 0
    names = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "_th")
    assert {r.doc_id for r in simhash.keep_one(names).collect()} == {"1", "2", "5", "6", None}


def test_long_text_in_pieces(monkeypatch):
    from skein.llm import simhash, text

    t = " ".join(str(k * k % 97) for k in range(5000)).encode()
    want = brute_fp(t.decode())
    for size in (7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "parts", lambda x, size=size: text.parts(x, size))
        assert simhash.fingerprint(t) == want
