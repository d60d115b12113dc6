import random
import re

import numpy as np

from skein.llm.decontaminate import Items, Search, basis, clean, document_frequency, lcs, leaks


def made(spark, seed=3):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("th", "re", "an", "é") for b in ("on", "er", "in") for c in ("ed", "ly", "sh", "x", "", "q", "or")]
    common = ["the", "of", "and"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) + rng.choice(vocab)
    items = [(k, " ".join(word() for _ in range(rng.randrange(16, 50))).capitalize() + ".") for k in range(25)]
    docs, want = [], set()
    for d in range(260):
        w = [word() for _ in range(rng.randrange(10, 300))]
        if d % 4 == 0:
            k = rng.randrange(25)
            own = items[k][1].split()
            if d % 8 == 0:  # a paraphrase: some words changed, one left out, one put in
                for _ in range(len(own) // 9):
                    own[rng.randrange(len(own))] = word()
                own.pop(rng.randrange(len(own)))
                own.insert(rng.randrange(len(own)), word())
            at = rng.randrange(len(w))
            w[at:at] = own
            want.add((d, k))
        docs.append((d, " ".join(w), 0.5))
    extra = [(900, None, 0.5), (901, "", 0.5), (None, items[3][1], 0.5), (0, docs[0][1], 0.5), (902, "the of " * 50000, 0.5)]
    return spark.createDataFrame(docs + extra, "doc_id long, text string, cosine double").repartition(4), spark.createDataFrame([*items, (77, None), (78, "the of"), (None, "x y z u v w")], "item_id long, text string"), want


def test_finds_copies_and_paraphrases_only(spark):
    docs, bench, want = made(spark)
    got = leaks(docs, bench).where("item_id <> 78").collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    copies = {(d, k) for d, k in want if d % 8}
    assert copies | {(None, 3)} <= pairs <= want | {(None, 3)} and len(pairs) >= 0.95 * len(want)
    assert all(0.6 <= r.overlap <= 1 and r.answer >= 0.4 for r in got)
    left = clean(docs, bench.where("item_id <> 78"))
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d in [*range(260), 900, 901, 902] if d not in {x for x, _ in pairs}}


def test_counts_and_basis_equal_dense_algebra(spark):
    docs, bench, _ = made(spark, 5)
    items = Items([(r.item_id, r.text) for r in bench.where("item_id < 25").orderBy("item_id").collect()])
    df, n = document_frequency(docs, items)
    import re

    texts = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in docs.collect()]
    assert n == len(texts) and df.tolist() == [sum(w in set(t) for t in texts) for w in items.words]
    items.weigh(df, n)
    B = basis(docs, items, rank=len(items.words))
    A = []
    num = {w: k for k, w in enumerate(items.words)}
    rows = [t[i : i + 32] for t in texts for i in range(0, len(t), 32)] + [[items.words[k] for k in x] for x in items.items]
    for t in rows:
        x = np.zeros(len(num))
        ws = [num[w] for w in t if w in num and items.idf[num[w]] > 0]
        for k in ws:
            x[k] += items.idf[k]
        s = np.sqrt(sum(items.idf[k] ** 2 for k in ws))
        A.append(x / s if s else x)
    A = np.array(A)
    live = np.linalg.eigvalsh(A.T @ A)
    top = np.sort(live)[::-1][:20]
    G = B.T @ (A.T @ A) @ B  # near the unit matrix on the leading directions
    got = np.sort(1 / (np.linalg.norm(B, axis=0) ** 2))[::-1][:20]
    assert np.allclose(got, top, rtol=0.05) and np.allclose(np.diag(G)[-20:], 1, atol=0.05)


def test_lcs_against_dynamic_programming():
    rng = random.Random(0)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(1, 70))]
        b = [rng.randrange(-1, 6) for _ in range(rng.randrange(0, 80))]
        m = {}
        for i, k in enumerate(a):
            m[k] = m.get(k, 0) | 1 << i
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs(m, len(a), b) == t[-1][-1]


def test_empty_tables(spark):
    docs, bench, _ = made(spark)
    assert leaks(docs, bench.where("false")).count() == 0 and clean(docs, bench.where("false")).count() == docs.count()
    assert leaks(docs.where("false"), bench).count() == 0 and clean(docs.where("false"), bench).count() == 0
    assert Search is not None


def test_every_verbatim_item_is_found(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) + " "
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    want = {(r.doc_id, k) for r in docs.collect() for t in [words(r.text)] for k, x in items if x.count(" ") > 5 and x in t}
    assert len(want) > 200
    assert want <= {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}


def test_no_cosine_is_needed(spark):
    docs, bench, _ = made(spark, 8)
    pairs = lambda cosine: {(r.doc_id, r.item_id) for r in leaks(docs, bench, cosine=cosine).collect()}
    assert pairs(-1.0) == pairs(2.0) == pairs(0.4)


def test_item_in_a_third_of_the_rows(spark):
    docs, bench, _ = made(spark, 4)
    item = bench.where("item_id = 5").first().text.split()
    rng = random.Random(6)
    rows = [(k, r.text.split()) for k, r in enumerate(docs.where("doc_id < 260").collect())]
    hot, want = [], set()
    for k, w in rows:
        if k % 3 == 0:
            own, at = list(item), rng.randrange(len(w))
            if k % 2:
                own.pop(rng.randrange(len(own)))
                own[rng.randrange(len(own))] = "the"
            w[at:at] = own
            want.add(k)
        hot.append((k, " ".join(w)))
    hot = spark.createDataFrame(hot, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in leaks(hot, bench).where("item_id = 5").collect()}
    assert want <= got
    assert not want & {r.doc_id for r in clean(hot, bench).collect()}
    # and with nothing else in any row, so that its words are in all documents
    all_ = spark.createDataFrame([(k, " ".join(item)) for k in range(30)], "doc_id long, text string")
    assert leaks(all_, bench).where("item_id = 5").count() == 30 and clean(all_, bench).count() == 0


def test_five_documents(spark):
    docs, bench, want = made(spark, 3)
    k, item = min((k, d) for d, k in want if d % 8)
    few = docs.where(f"doc_id in ({item}, 1, 2, 3, 5)").dropDuplicates(["doc_id"])
    assert few.count() == 5
    assert {(r.doc_id, r.item_id) for r in leaks(few, bench.where("item_id <> 78")).collect()} == {(item, k)}
    one = docs.where(f"doc_id = {item}").limit(1)
    assert {(r.doc_id, r.item_id) for r in leaks(one, bench.where("item_id <> 78")).collect()} == {(item, k)}
    assert clean(few, bench.where("item_id <> 78")).count() == 4


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, common=0.6, answer=0.4):
    """Every window of every text against every item by plain dynamic programming."""
    texts, items = [(d, split(t)) for d, t in docs], [(k, split(t)) for k, t in items]
    words = {w for _, x in items for w in x}
    idf = {w: np.log1p((len(texts) + 1) / (sum(w in set(t) for _, t in texts) + 1)) for w in words}
    out = set()
    for d, t in texts:
        for k, x in items:
            if len(x) < 5:
                at = [i for i in range(len(t) - len(x) + 1) if t[i : i + len(x)] == x]
                if x and at:
                    out.add((d, k, 1.0, at[0]))
                continue
            own = sorted(set(x), key=lambda w: (-idf[w], w))
            own = set(own[: max(1, len(own) // 3)])
            best = None
            for a in range(0, len(t), 64):
                y = t[a : a + -(-(2 * len(x) + 80) // 64) * 64]
                if len(own & set(y)) < answer * len(own) - 1e-9 or sum(idf[w] for w in set(x) & set(y)) < 0.8 * common * sum(idf[w] for w in set(x)) - 1e-9:
                    continue
                row = [0] * (len(y) + 1)
                for u in x:
                    old = row[:]
                    for j, v in enumerate(y):
                        row[j + 1] = old[j] + 1 if u == v else max(old[j + 1], row[j])
                if row[-1] >= common * len(x) - 1e-9 and (best is None or row[-1] > best[0]):
                    best = (row[-1], a)
            if best:
                out.add((d, k, round(best[0] / len(x), 9), best[1]))
    return out


def test_equals_brute_force(spark):
    docs, bench, _ = made(spark, 12)
    docs = docs.where("doc_id < 60 or doc_id is null or doc_id in (900, 901)")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.where("item_id is not null").collect()])
    assert len(want) > 20
    for size in (1 << 22, 200):  # one basis, and several
        got = leaks(docs, bench, size=size).collect()
        assert {(r.doc_id, r.item_id, round(r.overlap, 9), r.start) for r in got} == want and len(got) >= len(want)


def test_many_items_give_what_each_half_gives(spark):
    docs, bench, _ = made(spark, 9)
    rng = random.Random(2)
    rows = [(f"x{k}", " ".join(rng.choice("abcdefghij") + rng.choice("klmnopq") for _ in range(7))) for k in range(1975)] + [(f"y{r.item_id}", r.text) for r in bench.where("item_id < 25").collect()] + [("z", "the of and")]
    docs = docs.where("doc_id < 40")
    get = lambda x: {(r.doc_id, r.item_id, r.overlap, r.start) for r in leaks(docs, spark.createDataFrame(x, "item_id string, text string")).collect()}
    assert len(rows) == 2001 and get(rows) == get(rows[:1000]) | get(rows[1000:])
