import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import company, toxicity
from skein.llm.text import ALNUM, Words, buffers, hash_words
from skein.llm.toxicity import CONTEXT, DF, LEAST, ROWS, SEED_DF, STRETCH, TOXIC_DF, counts, document_terms, fit_toxicity, graph, keep_clean, op9_toxicity, score_toxicity, terms, walks

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op9_toxicity(spark, SF)
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    all_rows = got.join(lab, "doc_id").toPandas()
    r = all_rows[all_rows.held_out]
    assert got.count() == 1000 and len(r) > 50
    assert (r.predicted == r.toxic).mean() > 0.9
    en = all_rows[all_rows.toxic == 1]
    assert (en.predicted == 1).mean() > 0.55 and (all_rows[all_rows.toxic == 0].predicted == 0).mean() > 0.97


def test_counts_equal_brute_force(spark):
    seeds, toxic = ["aa", "bb", "cc"], 2
    texts = ["aa bb cc", "aa x bb", None, "", "cc " * 40 + "aa", "Aa bb " * 20, "zz", "aa bb cc", "cc y"]
    h = lambda x: int(hash_words([x], ALNUM).view(np.int64)[0])
    got = counts(spark.createDataFrame([(t, 1) for t in texts], "text string, n int").repartition(3), hash_words(seeds, ALNUM), toxic).collect()
    want, places = {(0, ROWS): len(texts)}, set()
    for t in texts:
        w = (t or "").lower().split()
        seen = {(h(x), DF) for x in w} | {(h(x), SEED_DF) for x in w if x in seeds}
        for k in range(0, len(w), STRETCH):
            own = w[k : k + STRETCH]
            for i, x in enumerate(own):
                for j, y in enumerate(own):
                    if i != j and y in seeds:
                        seen.add((h(x), seeds.index(y)))
                        if seeds.index(y) < toxic:
                            seen.add((h(x), TOXIC_DF))
                            places.add((h(x), tuple(own)))
        for k in seen:
            want[k] = want.get(k, 0) + 1
    assert {(r.h, r.s): r.n for r in got if r.s != CONTEXT} == want
    assert sorted(r.h for r in got if r.s == CONTEXT) == sorted(x for x, _ in places)
    known = np.sort(hash_words(["x", "y"], ALNUM))
    less = counts(spark.createDataFrame([(t, 1) for t in texts], "text string, n int"), hash_words(seeds, ALNUM), toxic, known).collect()
    assert {(r.h, r.s): r.n for r in less if r.s != CONTEXT} == {k: v for k, v in want.items() if k[0] not in (h("x"), h("y"))}


def test_walks_equal_dense_algebra(spark):
    rng = np.random.default_rng(1)
    m = rng.random((6, 6)) * (rng.random((6, 6)) > 0.5)
    m[2] = 0
    p = m / np.where(m.sum(1) > 0, m.sum(1), 1)[:, None]
    a, b = np.array([0.5, 0.5, 0, 0, 0, 0]), np.array([0, 0, 0, 1.0, 0, 0])
    edges = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(6) for j in range(6) if p[i, j]], "u long, v long, p double")
    got = walks(edges, spark.createDataFrame([(i, float(a[i]), float(b[i])) for i in (0, 1, 3)], "node long, a double, b double")).toPandas().set_index("node")
    x, y = a, b
    for _ in range(8):
        x, y = 0.5 * a + 0.5 * x @ p, 0.5 * b + 0.5 * y @ p
    assert np.allclose(got.a.reindex(range(6)).fillna(0), x) and np.allclose(got.b.reindex(range(6)).fillna(0), y)


def corpus(spark, seed=2):
    rng = random.Random(seed)
    plain, bad, unseen = [f"w{i}x" for i in range(80)], ["vile", "scum", "rotten"], ["blorg", "frabz"]
    docs, labels = [], []
    for d in range(900):
        toxic = d % 9 == 0
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        if toxic:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        if d >= 450:  # no label, so these words are in no labelled text
            if toxic:
                w[3:3] = [rng.choice(unseen)]
            if d % 7 == 1:
                w.append("quuxy")
        docs.append((d, " ".join(w)))
        if d < 450:
            labels.append((d, int(toxic)))
    docs += [(2000 + k, "vile scum zorkish " + " ".join(plain[:30])) for k in range(40)]  # one text many times vouches for nothing
    docs += [(3000, "blorg frabz blorg w1x w2x"), (3001, "quuxy w1x w2x w3x"), (3002, "zorkish w1x w2x")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("send", [1 << 20, 0])
def test_company_makes_unseen_words_toxic(spark, send):
    docs, labels = corpus(spark)
    lex = fit_toxicity(docs, labels, F.lit(True), send=send)
    h = lambda *x: hash_words(list(x), ALNUM).view(np.int64).tolist()
    known = dict(zip(lex.hashes.view(np.int64).tolist(), lex.polarity)) | ({r.h: r.polarity for r in lex.more.collect()} if lex.more else {})
    assert (lex.more is None) == (send > 0)
    assert all(known[x] > 0 for x in h("blorg", "frabz", "vile", "scum", "rotten"))
    assert not any(known.get(x, -1) > 0 for x in h("quuxy", "zorkish"))
    got = {r.doc_id: r.score for r in score_toxicity(docs, lex).collect()}
    assert got[3000] > 0.5 > got[3001] and got[3002] < 0.5
    kept = {r.doc_id for r in keep_clean(docs, lex).collect()}
    assert kept == {d for d, s in got.items() if s < 0.5} and keep_clean(docs, lex).columns == docs.columns


def test_edges_weigh_pairs_above_chance(spark):
    docs, _ = corpus(spark)
    hashes = hash_words(["vile", "scum", "w1x", "w2x"], ALNUM)
    e = graph(counts(docs, hashes, 2), hashes).toPandas()
    assert np.allclose(e.groupby("u").p.sum(), 1) and len(e) > 20 and (e.p > 0).all()
    assert set(zip(e.u, e.v)) == set(zip(e.v, e.u))


def holds_every_pair(monkeypatch, docs, fit):
    """The graph that fit() makes of docs, against brute force."""
    real, held = toxicity.graph, {}

    def spy(counted, hashes):
        e = real(counted, hashes)
        held.update(seeds=hashes.view(np.int64).tolist(), edges={(r.u, r.v) for r in e.collect()})
        return e

    monkeypatch.setattr(toxicity, "graph", spy)
    fit()
    seeds, of = set(held["seeds"]), {}
    texts = [r.text.split() for r in docs.collect()]
    for x in {x for w in texts for x in w}:
        of[x] = [int(v.view(np.int64)[0]) for v in terms(Words(*buffers(pa.array([x])), ALNUM))]
    n, df, seed_df = Counter(), Counter(), Counter()
    for w in texts:
        df.update({of[x][0] for x in w})
        seed_df.update({t for x in w for t in of[x]} & seeds)
        stretches = [w[k : k + STRETCH] for k in range(0, len(w), STRETCH)]
        n.update({(of[x][0], t) for own in stretches for i, x in enumerate(own) for j, y in enumerate(own) if i != j for t in of[y] if t in seeds})
    pairs = {(h, s) for (h, s), k in n.items() if k >= LEAST and h != s and math.log(k * len(texts) / (df[h] * seed_df[s])) > 0}
    weighed = {of[f"w{i}x"][0] for i in range(80)} - seeds  # in the labelled texts, but no seeds
    assert weighed and any(h in weighed for h, _ in pairs)
    assert held["edges"] == pairs | {(s, h) for h, s in pairs}


def test_graph_holds_every_pair_of_the_corpus(spark, monkeypatch):
    docs, labels = corpus(spark)
    holds_every_pair(monkeypatch, docs, lambda: fit_toxicity(docs, labels, F.lit(True)))


def test_weighed_words_are_counted_without_their_stretches(spark):
    docs, _ = corpus(spark)
    hashes, weighed = hash_words(["vile", "scum", "w1x"], ALNUM), np.sort(hash_words(["scum", "w1x", "w2x"], ALNUM))
    full, less = ({(r.h, r.s, r.x): r.n for r in counts(docs, hashes, 2, weighed=x).collect()} for x in (None, weighed))
    assert less == {k: n for k, n in full.items() if k[1] != CONTEXT or np.uint64(k[0] % (1 << 64)) not in weighed} != full


def test_brute_force_score_and_ties(spark):
    docs, labels = corpus(spark)
    lex = fit_toxicity(docs, labels, F.lit(True))
    again = fit_toxicity(docs.repartition(7), labels.repartition(3), F.lit(True))
    assert np.array_equal(lex.hashes, again.hashes) and np.allclose(lex.coef, again.coef)
    weight = dict(zip(lex.hashes.tolist(), lex.polarity))
    for r, got in zip(docs.orderBy("doc_id").collect(), score_toxicity(docs, lex).orderBy("doc_id").collect()):
        w = r.text.split()
        best = []
        for x in w:
            t = terms(Words(*buffers(pa.array([x])), ALNUM))
            best.append(max([0.0] + [weight.get(int(v[0]), 0.0) for v in t]))
        x = np.array([1, np.log1p(sum(best)), min(sum(b > 0 for b in best), 3) / 3, np.sqrt(sum(best) / max(len(w), 1))])
        assert np.isclose(got.score, 1 / (1 + np.exp(-x @ lex.coef)))
        if r.doc_id > 60:
            break


def test_terms_once_per_document():
    r, h = document_terms(*buffers(pa.array(["stupid stupid stupidly", "", None, "st"], pa.string())))
    assert np.bincount(r, minlength=4).tolist() == [5, 0, 0, 1] and len(set(h[:5].tolist())) == 5


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (None, "x", 5.0), (1, "", 5.0), (2, "a " * 200000, 1.0)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    lex = fit_toxicity(docs, lab, F.lit(True))
    assert score_toxicity(docs, lex).count() == 4
    none = fit_toxicity(docs, lab.where("false"), F.lit(True))
    assert [r.score for r in score_toxicity(docs, none).collect()] == [0.0] * 4
    assert score_toxicity(docs.where("false"), none).count() == 0
    assert keep_clean(docs, none).columns == docs.columns and keep_clean(docs, none).count() == 4


def brute_links(texts, left_out):
    """Pairs of words, both not left_out, that share a stretch in LEAST texts or more and more often than chance has it: {(x, y): weight}."""
    n, df = Counter(), Counter()
    for w in texts:
        df.update(set(w))
        n.update({(x, y) for k in range(0, len(w), STRETCH) for x in w[k : k + STRETCH] for y in w[k : k + STRETCH] if x < y})
    pairs = {p: math.log(k * len(texts) / (df[p[0]] * df[p[1]])) for p, k in n.items() if k >= LEAST and not {*p} & left_out}
    return {p: w for p, w in pairs.items() if w > 0}


def walked_by_fit(monkeypatch, docs, fit):
    """Rates of the walks that fit() makes over docs, and the same by dense algebra over the whole graph."""
    real, graphs, held = toxicity.visited, [], {}
    of_seeds = toxicity.graph

    def spy_graph(counted, hashes):
        e = of_seeds(counted, hashes)
        graphs.extend((r.u, r.v, r.w) for r in e.collect())
        return e

    def spy(docs, found, edges, rows, seeds, start, walks, **how):
        rates = real(docs, found, edges, rows, seeds, start, walks, **how)
        held.update(seeds=seeds.view(np.int64).tolist(), start=start, rates={r.node: (r.a, r.b) for r in rates.collect()})
        return rates

    with monkeypatch.context() as m:
        m.setattr(toxicity, "graph", spy_graph)
        m.setattr(toxicity, "visited", spy)
        fit()
    texts = [r.text.split() for r in docs.collect()]
    h = {x: int(hash_words([x], ALNUM).view(np.int64)[0]) for x in {x for w in texts for x in w}}
    more = brute_links(texts, {x for x in h if h[x] in set(held["seeds"])})
    assert more
    nodes = sorted({u for u, _, _ in graphs} | set(held["seeds"]) | {h[x] for p in more for x in p})
    at = {x: k for k, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for u, v, w in graphs:
        m[at[u], at[v]] = w
    for (x, y), w in more.items():
        assert m[at[h[x]], at[h[y]]] == 0
        m[at[h[x]], at[h[y]]] = m[at[h[y]], at[h[x]]] = w
    p = m / np.where(m.sum(1) > 0, m.sum(1), 1)[:, None]
    first = np.zeros((len(nodes), 2))
    first[[at[x] for x in held["seeds"]]] = held["start"]
    now = first
    for _ in range(toxicity.STEPS):
        now = toxicity.RESTART * first + (1 - toxicity.RESTART) * p.T @ now
    return np.array([held["rates"].get(x, (0, 0)) for x in nodes]), now


@pytest.mark.parametrize("many", [1 << 20, 20])
def test_walks_go_over_pairs_without_a_seed(spark, monkeypatch, many):
    docs, labels = corpus(spark)
    got, want = walked_by_fit(monkeypatch, docs, lambda: fit_toxicity(docs, labels, F.lit(True), many=many))
    assert np.allclose(got, want, rtol=1e-9, atol=1e-15)


@pytest.mark.parametrize("window", [1 << 22, 500])
def test_links_equal_brute_force(spark, window):
    rng = random.Random(4)
    texts = [[f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 150))] for _ in range(300)] + [[f"v{k}" for k in range(40)]] * 3 + [["one"], [], ["one", "one"]]
    df = Counter(x for w in texts for x in set(w))
    words = sorted((x for x in df if df[x] >= LEAST), key=lambda x: -df[x])
    docs = spark.createDataFrame([(" ".join(w) or None,) for w in texts], "text string").repartition(4)
    h, n = hash_words(words, ALNUM), np.array([df[x] for x in words])
    made = company.links(docs, h, n, len(texts), LEAST, STRETCH, window=window)
    name = dict(zip(h.view(np.int64).tolist(), words))
    got = {(name[r.u], name[r.v]): r.w for r in company.as_rows(made, h, n, len(texts)).collect()}
    want = brute_links(texts, set())
    assert len(want) > 500 and set(got) == set(want) | {(y, x) for x, y in want}
    assert all(np.isclose(got[p], w) and np.isclose(got[p[::-1]], w) for p, w in want.items())


def test_pairs_are_packed_without_loss():
    rng = np.random.default_rng(1)
    for size in (0, 1, 1000):
        k, n = np.unique(rng.integers(0, 1 << 44, size).astype(np.uint64)), rng.integers(1, 1 << 31, size)
        got = company.unpacked(company.packed(k, n[: len(k)]))
        assert np.array_equal(got[0], k) and np.array_equal(got[1], n[: len(k)])


@pytest.mark.parametrize("size", [0, 1, 5000])
def test_numbers_of_hashes(size):
    rng = np.random.default_rng(2)
    h = np.unique(np.concatenate([rng.integers(0, 1 << 64, size, np.uint64), rng.integers(0, 1 << 20, size, np.uint64), np.full(min(size, 1), (1 << 64) - 1, np.uint64)]))
    rng.shuffle(h)
    asked = np.concatenate([h, rng.integers(0, 1 << 64, 1000, np.uint64), np.arange(1000, dtype=np.uint64)])
    want = {int(x): k for k, x in enumerate(h)}
    assert company.Numbers(h).ids(asked).tolist() == [want.get(int(x), -1) for x in asked]


def test_links_read_the_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(t):
        seen.add(1)
        return t

    docs = spark.createDataFrame([(f"a b c{k % 5} d{k % 7}",) for k in range(60)], "text string").select(F.udf(look, "string")("text").alias("text"))
    words = ["a", "b", *(f"c{k}" for k in range(5)), *(f"d{k}" for k in range(7))]
    df = np.array([60, 60, *[12] * 5, *[9] * 4, *[8] * 3])
    assert len(company.links(docs, hash_words(words, ALNUM), df, 60, LEAST, STRETCH)) == company.ROUNDS > 1
    assert seen.value == 60


def test_windows_are_kept_without_loss():
    rng = random.Random(5)
    texts = [[f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 150))] for _ in range(80)] + [["w1"], [], ["w2", "w1", "w2"]]
    words = sorted({x for w in texts for x in w})
    vocab, number = company.Numbers(hash_words(words, ALNUM)), {x: k for k, x in enumerate(words)}
    pieces = [company.numbered(vocab, *buffers(pa.array([" ".join(w) for w in texts[a : a + 30]])), STRETCH) for a in (0, 30, 60)]
    word, first, row = company.unwound(company.window(pieces))
    got = {}
    for w, f, r in zip(word.tolist(), first.tolist(), row.tolist()):
        got.setdefault((r, f), []).append(w)
    want, rows = [], 0
    for w in texts:
        sets = [x for k in range(0, len(w), STRETCH) if len(x := sorted({number[y] for y in w[k : k + STRETCH]})) > 1]
        want += [(rows, x) for x in sets]
        rows += bool(sets)
    assert [(r, x) for (r, _), x in sorted(got.items(), key=lambda p: p[0][1])] == want


@pytest.mark.parametrize("parts", [1, 2, 50])
def test_cuts_are_in_order_and_share_the_pairs(parts):
    df = np.maximum(100000 // np.arange(1, 3000), 3).astype(float)
    at = company.cuts(df, parts, 20, 2 * STRETCH)
    assert len(at) == parts - 1 and (np.diff(at.astype(np.int64)) >= 0).all()
    k = np.sort(np.unique((np.repeat(np.arange(3000), 3) << 22 | np.tile([0, 5, 9], 3000)).astype(np.uint64)))
    n = np.arange(1, len(k) + 1)
    sent = [(p, *company.unpacked(x)) for p, x in company._ranges(at, k, n)]
    assert np.array_equal(np.concatenate([x for _, x, _ in sent]), k) and np.array_equal(np.concatenate([x for _, _, x in sent]), n)
    assert all(p == np.searchsorted(at, y, side="right") for p, x, _ in sent for y in x)


def test_beginnings_are_hashed_by_their_bytes():
    texts = ["stupid stupidity abc abcd", "abcdef", "überaus ab", "x"]
    w = Words(*buffers(pa.array(texts)), ALNUM)
    got, m = [x.tolist() for x in terms(w)], 1 << 64
    for i, x in enumerate(y.encode() for t in texts for y in t.split()):
        for k, h in zip(toxicity.HEADS, got[1:]):
            total = sum(c * pow(int(toxicity._P), j, m) for j, c in enumerate(x[:k])) + 1000 + k
            assert h[i] == (int(toxicity.mix(np.array([total % m], np.uint64))[0]) if len(x) > k else 0)
