"""Toxicity: a lexicon induced by random walks over a word graph.

1. Seeds: a bounded sample of labelled documents (labelled.SAMPLE rows, equal texts once)
   gives document counts of words and of word beginnings (4, 5 and 6 bytes, so that other
   endings of a known stem count too). Toxic seeds are all those bound to label 1 more strongly
   than chance explains among as many tries; as many others, about as frequent, are plain seeds.
2. Graph: its words are all words of the corpus, those that the labels have weighed among them.
   One pass over all documents counts in how many each of them stands at all, and with each
   seed in one stretch of STRETCH words. Pairs of at least LEAST documents are edges, weighted
   by positive pointwise mutual information. Pairs of words that are both no seeds are edges by
   the same rule (company.py). Edges stay distributed tables.
3. Walks with restart from either kind of seeds, a Spark job a step; a word's polarity is the
   logarithm of the ratio of both visiting rates. Seeds are weighed by it, and words that the
   labels say nothing about (in fewer than LEAST sampled texts) enter the lexicon if the walks prefer
   them, and if they stand with toxic seeds in half of their documents or more, in LEAST
   different stretches (so that copies do not vouch), and beyond chance.
4. A document's score: logistic regression on its polarity mass, fitted on the sample.

Seeds are bounded by the sample. Induced words go to all tasks up to SEND of them; if there
are more, documents meet them by a join on the word.

Defined results: null text counts as empty and gets the score of a text without any toxic
term; null id is scored (held_out false); repeated rows are scored each for itself; without
labelled rows of both kinds every score is the share of label 1 (0 if there is none); ties
among terms go by their hash; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.company import MANY, visited
from skein.llm.labelled import SAMPLE, crc_mod, sample, sampled_documents
from skein.llm.text import _P, ALNUM, Vocabulary, Words, batches, mix
from skein.runtime import drop_table, read, ready, table

STRETCH, LEAST, STEPS, RESTART, HEADS, SEND = 32, 3, 8, 0.5, (4, 5, 6), 1 << 20
DF, SEED_DF, ROWS, TOXIC_DF, CONTEXT = -1, -2, -3, -4, -5  # what a row of counts() counts, besides pairs with a seed


def terms(w: Words) -> list[np.ndarray]:
    """For each word its own hash and those of its beginnings (0 where the word is no longer than that)."""
    n, h, out = w.end - w.start, np.zeros(len(w.start), np.uint64), [w.hashes()]
    eight = np.ndarray(len(w.low) + 1, "<u8", np.concatenate([w.low, np.zeros(8, np.uint8)]), strides=(1,))[w.start]  # the bytes from a word's first on, in one number
    eight &= np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)[np.minimum(n, 8)]
    scale = 1
    for k in range(max(HEADS)):
        h = h + (eight >> np.uint64(8 * k) & np.uint64(255)) * np.uint64(scale)
        scale = scale * int(_P) & (1 << 64) - 1
        if k + 1 in HEADS:
            out.append(np.where(n > k + 1, mix(h + np.uint64(1001 + k)), np.uint64(0)))
    return out


def document_terms(buf, off) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs, each once."""
    w = Words(buf, off, ALNUM)
    row = w.row().astype(np.uint64)
    t = terms(w)
    h, r = np.concatenate(t), np.tile(row, len(t))
    keep = h != 0
    h, r = h[keep], r[keep]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new].astype(np.int64), h[new]


class Lexicon:
    """Terms, their polarity, and the document model on top. more: a table (h, polarity) of words beyond those that are sent."""

    def __init__(self, hashes=(), polarity=(), coef=None, prior: float = 0.0, more: DataFrame | None = None):
        self.hashes, self.polarity = np.asarray(hashes, np.uint64), np.asarray(polarity, float)
        self.coef, self.prior, self.more = coef, prior, more

    def sent(self) -> Lexicon:
        return Lexicon(self.hashes, self.polarity, self.coef, self.prior)

    def features(self, buf, off, own: pa.Array | None = None) -> np.ndarray:
        """Per row: how much toxic mass there is, how dense it is, and whether there is any. own: lists (h, polarity) of further words of the rows."""
        w = Words(buf, off, ALNUM)
        R = len(w.n)
        vocab = Vocabulary(self.hashes)
        weight = np.append(np.maximum(self.polarity, 0), 0)
        best, t = np.zeros(len(w.start)), terms(w)
        for h in t:  # a word counts once, as its strongest term
            np.maximum(best, weight[vocab.ids(h)], out=best)
        if own is not None and len(own.flatten()):
            h, p = (own.flatten().field(k).to_numpy() for k in range(2))
            h, first = np.unique(h.view(np.uint64), return_index=True)
            more = np.append(np.maximum(p[first], 0), 0)
            np.maximum(best, more[Vocabulary(h).ids(t[0])], out=best)
        mass = np.bincount(w.row(), best, R)
        hits = np.bincount(w.row()[best > 0], minlength=R)
        return np.column_stack([np.ones(R), np.log1p(mass), np.minimum(hits, 3) / 3, np.sqrt(mass / np.maximum(w.n, 1))])

    def score(self, buf, off, own: pa.Array | None = None) -> np.ndarray:
        if self.coef is None:
            return np.full(len(off) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(buf, off, own) @ self.coef, -30, 30)))


def counted_terms(made: DataFrame) -> DataFrame:
    """h, n, a: in how many labelled texts a term is, and in how many of label 1."""

    def run(it):
        for b, buf, off in batches(it, "text"):
            r, h = document_terms(buf, off)
            y = b.column(b.schema.get_field_index("y")).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(y[r])], ["h", "y"])

    return made.mapInArrow(run, "h long, y int").groupBy("h").agg(F.count("*").alias("n"), F.sum("y").alias("a")).where(F.col("n") >= LEAST)


def _evidence(n, a, p: float):
    """Likelihood ratio of a of n against the rate p."""
    rate = a / n
    one = F.when(a > 0, a * F.log(rate / p)).otherwise(0.0)
    zero = F.when(n > a, (n - a) * F.log((1 - rate) / (1 - p))).otherwise(0.0)
    return 2 * (one + zero)


def seeds(counted: DataFrame, n: int, p: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Toxic seed terms, their strength, and plain seed terms, from n labelled texts with a share p of label 1."""
    tries = max(counted.count(), 2)
    rate = F.col("a") / F.col("n")
    strong = (rate > (max(3 * p, 0.5) if p < 0.3 else 0.5 + p / 2)) & (F.col("g") > 2 * float(np.log(tries)) + 2)
    scored = counted.withColumn("g", _evidence(F.col("n"), F.col("a"), p)).withColumn("strong", strong)
    toxic = scored.where("strong").select("h", "g", "n").orderBy(F.desc("g"), "h").toPandas()  # bounded by the sample's terms
    if not len(toxic):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.uint64)
    far = F.abs(F.log("n") - float(np.log(toxic.n.median())))
    rest = scored.where(~F.col("strong") & (rate < 1.5 * p)).orderBy(far, "h").select("h").limit(max(32, len(toxic))).toPandas()  # as many as toxic ones
    return toxic.h.to_numpy().view(np.uint64), toxic.g.to_numpy(), rest.h.to_numpy(np.int64).view(np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique by a sort; numpy's table of hashes takes many times as long where little repeats."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _merged(parts: list) -> np.ndarray:
    """Rows (h, s, x, n) with n summed over equal (h, s, x)."""
    x = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
    x = x[:, np.lexsort((x[2], x[0], x[1]))]
    new = np.ones(x.shape[1], bool)
    new[1:] = (x[:3, 1:] != x[:3, :-1]).any(0)
    out = x[:, new]
    if out.shape[1]:
        out[3] = np.add.reduceat(x[3], np.flatnonzero(new))
    return out


def counts(docs: DataFrame, hashes: np.ndarray, toxic: int, known: np.ndarray | None = None, weighed: np.ndarray | None = None) -> DataFrame:
    """h, s, x, n over all documents: documents in which word h stands in one stretch with seed s, and what the constants above name.

    known (sorted): words that are left out. weighed (sorted): words that are counted, but can't be induced, so nobody asks for their stretches.
    """
    ready(docs.sparkSession)
    none = np.zeros(0, np.uint64)
    known, weighed = none if known is None else known, none if weighed is None else weighed
    among = lambda u, x: x[np.minimum(np.searchsorted(x, u), len(x) - 1)] == u if len(x) else np.zeros(len(u), bool)

    def piece(vocab, buf, off):
        w = Words(buf, off, ALNUM)
        S, R = len(hashes), len(w.n)
        put = lambda h, s, n, x=0: np.array([np.asarray(h, np.uint64).view(np.int64), np.full(len(h), s) if np.isscalar(s) else s, np.full(len(h), x) if np.isscalar(x) else x, n], np.int64)
        out = [put(np.zeros(1, np.uint64), ROWS, [R])]
        if not len(w.start):
            return out
        t, row = terms(w), w.row()
        u, inv = np.unique(t[0], return_inverse=True)
        wanted, asked = ~among(u, known), ~among(u, weighed)
        U = len(u)
        new = wanted[inv]
        df = np.bincount(_distinct(row[new] * U + inv[new]) % U, minlength=U)
        out.append(put(u[df > 0], DF, df[df > 0]))
        at, seed = [], []
        for h in t:
            i = vocab.ids(h)
            k = np.flatnonzero(i >= 0)
            at.append(k)
            seed.append(i[k].astype(np.int64))
        at, seed = np.concatenate(at), np.concatenate(seed)
        if not len(at):
            return out
        key = _distinct(row[at] * S + seed) % S
        n = np.bincount(key, minlength=S)
        out.append(put(hashes[n > 0], SEED_DF, n[n > 0]))
        lo = at - (at - w.first[row[at]]) % STRETCH
        size = np.minimum(lo + STRETCH, (w.first + w.n)[row[at]]) - lo
        word = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        seed, r, of = np.repeat(seed, size), row[word], np.repeat(at, size)
        own = (word != of) & new[word]
        word, seed, r, lo = word[own], seed[own], r[own], np.repeat(lo, size)[own]
        key = _distinct((r * S + seed) * U + inv[word]) % (S * U)
        key, n = np.unique(key, return_counts=True)
        out.append(put(u[key % U], key // U, n))
        bad = seed < toxic
        key = _distinct(r[bad] * U + inv[word[bad]]) % U
        n = np.bincount(key, minlength=U)
        out.append(put(u[n > 0], TOXIC_DF, n[n > 0]))
        # different stretches, by their words
        bad &= asked[inv[word]]
        key = _distinct(lo[bad])
        size = np.minimum(key + STRETCH, (w.first + w.n)[row[key]]) - key
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        sums = np.bitwise_xor.reduceat(mix(t[0][np.repeat(key, size) + place] + place.astype(np.uint64)), first) if len(key) else np.zeros(0, np.uint64)
        pair = _distinct(np.searchsorted(key, lo[bad]) * U + inv[word[bad]])
        out.append(put(u[pair % U], CONTEXT, np.ones(len(pair), np.int64), sums[pair // U].view(np.int64)))
        return out

    def run(it):
        vocab, held, size = Vocabulary(hashes), [], 0
        batch = lambda x: pa.RecordBatch.from_arrays([pa.array(x[k]) for k in range(4)], ["h", "s", "x", "n"])
        for _, buf, off in batches(it, "text", 1 << 20):
            new = piece(vocab, buf, off)
            held += new
            size += sum(x.shape[1] for x in new)
            if size > 1 << 19:
                held = [_merged(held)]
                size = held[0].shape[1]
                if size > 1 << 18:
                    for k in range(0, size, 1 << 16):
                        yield batch(held[0][:, k : k + (1 << 16)])
                    held, size = [], 0
        x = _merged(held)
        for k in range(0, x.shape[1], 1 << 16):
            yield batch(x[:, k : k + (1 << 16)])

    return docs.select("text").mapInArrow(run, "h long, s long, x long, n long").groupBy("h", "s", "x").agg(F.sum("n").alias("n"))


def graph(counted: DataFrame, hashes: np.ndarray) -> DataFrame:
    """u, v, p, w: edges between words and seeds in both directions, the chance to take each of them from u, and their weight."""
    spark = counted.sparkSession
    rows = counted.where(F.col("s") == ROWS).first().n
    seed = spark.createDataFrame([(k, int(h)) for k, h in enumerate(hashes.view(np.int64).tolist())], "s long, seed long")
    seed = seed.join(counted.where(F.col("s") == SEED_DF).select(F.col("h").alias("seed"), F.col("n").alias("n_s")), "seed")
    pair = counted.where((F.col("s") >= 0) & (F.col("n") >= LEAST)).join(F.broadcast(seed), "s")  # seeds: bounded by the sample
    word = counted.where((F.col("s") == DF) & (F.col("n") >= LEAST)).select("h", F.col("n").alias("n_w"))
    w = F.log(F.col("n") * float(rows) / (F.col("n_w") * F.col("n_s")))
    e = pair.join(word, "h").where(F.col("h") != F.col("seed")).withColumn("w", w).where("w > 0")
    both = e.select(F.col("h").alias("u"), F.col("seed").alias("v"), "w").union(e.select(F.col("seed").alias("u"), F.col("h").alias("v"), "w")).groupBy("u", "v").agg(F.max("w").alias("w"))
    both = table(both, "edges")
    out = table(both.join(both.groupBy("u").agg(F.sum("w").alias("out")), "u").select("u", "v", (F.col("w") / F.col("out")).alias("p"), "w"), "steps")
    drop_table(both)
    return out


def walks(edges: DataFrame, start: DataFrame, steps: int = STEPS, restart: float = RESTART) -> DataFrame:
    """node, a, b: visiting rates of two walks with restart. start: node, a, b (each sums to 1). What stands where no edge leads on is lost."""
    now = start
    for k in range(steps):
        moved = edges.join(now.withColumnRenamed("node", "u"), "u").select(F.col("v").alias("node"), *[((1 - restart) * F.col("p") * F.col(c)).alias(c) for c in "ab"])
        back = start.select("node", *[(restart * F.col(c)).alias(c) for c in "ab"])
        now = moved.unionByName(back).groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        if k % 4 == 3 and k < steps - 1:
            now = table(now, "walk")
    return table(now, "walk")


def induced(counted: DataFrame, rates: DataFrame, labelled: DataFrame, eps: float) -> DataFrame:
    """h, polarity of the words that the labels say nothing about and the company they keep makes toxic."""
    own = lambda what, name: counted.where(F.col("s") == what).select("h", F.col("n").alias(name))
    w = own(DF, "n").where(F.col("n") >= LEAST).join(own(TOXIC_DF, "t"), "h")
    total = own(DF, "n").agg(F.count("*").alias("words"), F.sum("n").alias("n")).crossJoin(own(TOXIC_DF, "t").agg(F.sum("t").alias("t"))).first()  # single rows
    if not total.t:
        return rates.select(F.col("node").alias("h"), F.lit(0.0).alias("polarity")).where("false")
    q = min(max(total.t / total.n, 1e-9), 0.99)
    rate = F.col("t") / F.col("n")
    w = w.where((rate >= max(0.5, 3 * q if q < 0.3 else 0.5 + q / 2)) & (_evidence(F.col("n"), F.col("t"), q) > 2 * float(np.log(max(total.words, 2))) + 2))
    w = w.join(labelled.select("h"), "h", "left_anti")
    places = counted.where(F.col("s") == CONTEXT).groupBy("h").agg(F.count("*").alias("places")).where(F.col("places") >= LEAST)
    walked = rates.select(F.col("node").alias("h"), F.log((F.col("a") + eps) / (F.col("b") + eps)).alias("polarity"))
    return w.join(places, "h").join(walked, "h").where("polarity > 0").select("h", "polarity")


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep, rows: int = SAMPLE, send: int = SEND, many: int = MANY) -> Lexicon:
    spark = ready(docs.sparkSession)
    chosen = sampled_documents(docs, sample(labels, "toxic", keep, rows))

    # equal texts count once: a group of copies must not make its words look bound to its label
    made = table(chosen.groupBy(F.xxhash64("text").alias("k"), F.length("text").alias("len")).agg(F.max("y").alias("y"), F.min("text").alias("text")).select("text", "y"), "labelled")
    n, ones = made.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = ones / n if n else 0.0
    if prior in (0.0, 1.0):
        return Lexicon(prior=prior)
    labelled = table(counted_terms(made), "terms")
    toxic, strength, plain = seeds(labelled, n, prior)
    if not len(toxic):
        return Lexicon(prior=prior)
    hashes = np.concatenate([toxic, plain])
    weighed = np.unique(labelled.select("h").toPandas().h.to_numpy(np.int64).view(np.uint64))  # terms of LEAST texts of the sample
    counted = table(counts(docs, hashes, len(toxic), weighed=weighed), "counts")
    edges = graph(counted, hashes)
    a, b = np.zeros(len(hashes)), np.zeros(len(hashes))
    a[: len(toxic)], b[len(toxic) :] = np.sqrt(strength), 1.0
    start = np.column_stack([a / max(a.sum(), 1e-12), b / max(b.sum(), 1e-12)])
    own = spark.createDataFrame([(h,) for h in hashes.view(np.int64).tolist()], "node long")
    found = counted.where((F.col("s") == DF) & (F.col("n") >= LEAST)).join(F.broadcast(own), F.col("h") == F.col("node"), "left_anti").select("h", "n")
    total = counted.where(F.col("s") == ROWS).first().n
    rates = visited(docs, found, edges, total, hashes, start, walks, least=LEAST, stretch=STRETCH, steps=STEPS, restart=RESTART, many=many)
    eps = 0.1 / len(hashes)
    got = {r.node: (r.a, r.b) for r in rates.join(F.broadcast(own), "node").collect()}  # the seeds
    polarity = np.array([np.log((got.get(h, (0, 0))[0] + eps) / (got.get(h, (0, 0))[1] + eps)) for h in hashes.view(np.int64).tolist()])
    new = table(induced(counted, rates, labelled, eps), "induced")
    for t in (counted, edges, rates, labelled):
        drop_table(t)
    lex = Lexicon(hashes, polarity, prior=prior)
    if new.count() > send:
        lex.more = new
    else:
        found = new.orderBy("h").toPandas()  # at most `send` rows
        lex.hashes, lex.polarity = np.concatenate([hashes, found.h.to_numpy(np.int64).view(np.uint64)]), np.concatenate([polarity, found.polarity.to_numpy(float)])
        drop_table(new)
    sent, marked = lex.sent(), _own(made, lex, "text")

    def run(it):
        for b, buf, off in batches(it, "text"):
            x = sent.features(buf, off, _column(b, "_own"))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("y")), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = marked.mapInArrow(run, "y int, x array<double>").toPandas()  # at most `rows` rows
    drop_table(made)
    x, y = np.array(got.x.tolist()), got.y.to_numpy(float)
    order = np.lexsort((*x.T, y))  # rows come in any order
    x, y = x[order], y[order]
    coef = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        grad = x.T @ (y - q) - 0.1 * coef
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(coef))
        coef = coef + np.linalg.solve(hess, grad)
    lex.coef = coef
    return lex


def _column(b: pa.RecordBatch, name: str) -> pa.Array | None:
    k = b.schema.get_field_index(name)
    return b.column(k) if k >= 0 else None


def _own(docs: DataFrame, lexicon: Lexicon, text_col: str) -> DataFrame:
    """docs, with each text's words of lexicon.more as a last column _own if there is such a table."""
    if lexicon.more is None:
        return docs

    def run(it):
        for b, buf, off in batches(it, text_col):
            w = Words(buf, off, ALNUM)
            row, h = w.row(), w.hashes()
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row)), pa.array(h.view(np.int64))], ["_a", "_b", "h"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumn("_a", F.xxhash64(text)).withColumn("_b", F.xxhash64(F.lit(1), text))
    met = named.select(text_col, "_a", "_b").mapInArrow(run, "_a long, _b long, h long").distinct().join(lexicon.more, "h")
    known = met.groupBy("_a", "_b").agg(F.collect_list(F.struct("h", "polarity")).alias("_own"))  # one text's own words
    return named.join(known, ["_a", "_b"], "left").select(*docs.columns, "_own")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    ready(docs.sparkSession)
    sent = lexicon.sent()

    def run(it):
        for b, buf, off in batches(it, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.score(buf, off, _column(b, "_own")))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return _own(d, lexicon, "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold; nothing is shuffled unless lexicon.more is."""
    ready(docs.sparkSession)
    sent, names, more = lexicon.sent(), docs.columns, lexicon.more is not None

    def run(it):
        for b, buf, off in batches(it, "text"):
            score = sent.score(buf, off, b.column(len(names)) if more else None)
            yield pa.RecordBatch.from_arrays(list(b.columns)[: len(names)], names).filter(pa.array(score < threshold))

    return _own(docs, lexicon, "text").mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    lexicon = fit_toxicity(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return score_toxicity(docs, lexicon).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
