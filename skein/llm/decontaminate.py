"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all documents give weights.
2. Randomised SVD: A holds a row of TF-IDF weights, scaled by its words' weights, for each
   passage of PASSAGE words of all documents and for each item. Tasks add up Y = (A'A) W for a
   random W; from Y and W'Y follow A's leading singular values and right singular vectors.
3. Search: passages that overlap by half, and items, are projected on these vectors, each
   scaled to unit variance (else what most texts share would outweigh what tells them apart).
   Pairs whose cosine is at least `cosine` are candidates. Passages meet items as products of
   two small matrices; items are a stated query set.
   Places where `answer` of an item's answer stands are candidates whatever their cosine, so that
   nothing is lost that the proof would accept.
4. Proof, for windows that begin every GRID words of a text and are long enough to hold any
   stretch of twice the item's words: the longest common subsequence of the item's and the
   window's words holds `common` of the item, the different words that are there hold 0.8 of
   that share of the item's weight (else common words alone would do), and of the item's
   answer, its most telling third, `answer` is there. So a copy with words changed, left out or put in is found; chance
   likeness is not. What can't reach that by its different words alone is left out before.
   Items of fewer than LEAST words are found only where all their words stand one after another.

Words are runs of ASCII letters and digits and all characters from U+0080 up, A-Z in lower case.
What is found depends on the texts, the items and the weights, not on the basis. A basis serves
all items up to ITEM_WORDS words; more items go on in a second basis.

Defined results: null texts count as empty and hold nothing; items that are null, have a null
id or no word are not searched for; rows with null id are searched like others; repeated rows
are documents of their own, repeated items items of their own; of several windows in a document
the one with the largest overlap counts, then the first; an empty table on either side gives
an empty result; ids may be of any type; other columns are ignored (clean() keeps them).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.text import ALNUM, Vocabulary, Words, batches, buffers, hash_words
from skein.runtime import read, ready

PASSAGE, RANK, LEAST, GRID, ITEM_WORDS = 32, 64, 5, 64, 1 << 22
TILE = 4096  # words whose vectors are held at once: small enough for a core's cache


class Items:
    """Items: their words, vocabulary and weights; short ones are kept apart."""

    def __init__(self, rows: list[tuple]):
        buf, off = buffers(pa.array([t for _, t in rows], pa.large_string()))
        w = Words(buf, off, ALNUM)
        low = np.where(w.low == 0, 32, w.low).astype(np.uint8).tobytes()
        words = [low[a:e].decode() for a, e in zip(w.start.tolist(), w.end.tolist())]
        own = [words[a : a + n] for a, n in zip(w.first.tolist(), w.n.tolist())]
        some = [k for k, x in enumerate(own) if x]
        keep, few = [k for k in some if len(own[k]) >= LEAST], [k for k in some if len(own[k]) < LEAST]
        self.words = sorted({x for k in some for x in own[k]})
        num = {x: k for k, x in enumerate(self.words)}
        self.ids, self.short_ids = [rows[k][0] for k in keep], [rows[k][0] for k in few]
        self.items, self.short = [[num[x] for x in own[k]] for k in keep], [[num[x] for x in own[k]] for k in few]
        self.hashes = hash_words(self.words, ALNUM) if self.words else np.zeros(0, np.uint64)

    def weigh(self, df: np.ndarray, n: int) -> None:
        self.idf = np.log1p((n + 1) / (df + 1))  # above zero for every word: an item that many documents hold keeps its vector
        self.answer = []
        for x in self.items:
            u = sorted(set(x), key=lambda k: (-self.idf[k], k))
            self.answer.append(frozenset(u[: max(1, len(u) // 3)]))

    def rows(self) -> list[np.ndarray]:
        return [np.array(x) for x in self.items]


def _sums(table: np.ndarray, rows: np.ndarray, weight: np.ndarray | None, key: np.ndarray, n: int) -> np.ndarray:
    """n x width: for each key the sum of (weighted) rows of the table; key is in order. TILE rows at a time."""
    out = np.zeros((n, table.shape[1]), np.float32)
    for a in range(0, len(rows), TILE):
        k = key[a : a + TILE]
        x = table[rows[a : a + TILE]]
        if weight is not None:
            x *= weight[a : a + TILE, None]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[k[first]] += np.add.reduceat(x, first)
    return out


def document_frequency(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary is, and how many documents there are."""
    hashes, V = items.hashes, len(items.hashes)

    def run(it):
        vocab, total = Vocabulary(hashes), np.zeros(V + 1, np.int64)
        for b, buf, off in batches(it, "text"):
            w = Words(buf, off, ALNUM)
            ids = vocab.ids(w.hashes())
            at = np.flatnonzero(ids >= 0)
            r = np.searchsorted(w.first, at, side="right") - 1
            if len(w.n) * V <= 1 << 24:
                seen = np.zeros((len(w.n), V), bool)
                seen[r, ids[at]] = True
                total[:V] += seen.sum(0)
            else:
                total[:V] += np.bincount(np.unique(r * V + ids[at]) % V, minlength=V)
            total[V] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(V + 1)), pa.array(total)], ["k", "n"])

    out = np.zeros(V + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row for each word
        out[r.k] = r.n
    return out[:V], int(out[V])


def basis(docs: DataFrame, items: Items, rank: int = RANK, block: int = 128) -> np.ndarray:
    """Words x rank: right singular vectors of A by their singular values, from one pass."""
    V, idf, hashes = len(items.words), items.idf, items.hashes
    r = min(rank, V)
    if not items.items:
        return np.zeros((V, r), np.float32)
    W = np.random.default_rng(7).normal(size=(V, r)).astype(np.float32)

    def add(Y: np.ndarray, ids: np.ndarray, piece: np.ndarray, n: int) -> None:
        """Y += A'(A W) for pieces of words; piece is sorted."""
        x = idf[ids].astype(np.float32)
        norm = np.sqrt(np.bincount(piece, x * x, n)).astype(np.float32)
        norm[norm == 0] = 1
        x = x / norm[piece]
        z = _sums(W, ids, x, piece, n)
        narrow = ids.astype(np.uint16) if V < 1 << 16 else ids
        for a in range(0, len(ids), TILE):
            order = np.argsort(narrow[a : a + TILE], kind="stable") + a
            k = ids[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            Y[k[first]] += np.add.reduceat(z[piece[order]] * x[order, None], first)

    def run(it):
        vocab, Y = Vocabulary(hashes), np.zeros((V, r), np.float64)
        for _, buf, off in batches(it, "text"):
            w = Words(buf, off, ALNUM)
            ids = vocab.ids(w.hashes())
            pieces = -(-w.n // PASSAGE)
            base = np.cumsum(pieces) - pieces
            at = np.flatnonzero(ids >= 0)
            own = np.searchsorted(w.first, at, side="right") - 1
            add(Y, ids[at], base[own] + (at - w.first[own]) // PASSAGE, int(pieces.sum()))
        for k in range(0, V, block):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([Y[k : k + block].tobytes()], pa.binary())], ["k", "y"])

    def total(it):
        held: dict[int, np.ndarray] = {}
        for b in it:
            for k, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[k] = held.get(k, 0) + np.frombuffer(y)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([y.tobytes() for y in held.values()], pa.binary())], ["k", "y"])

    parts = docs.select("text").mapInArrow(run, "k long, y binary").repartition("k").mapInArrow(total, "k long, y binary").collect()  # words x rank numbers
    Y = np.zeros((V, r))
    for p in parts:
        Y[p.k : p.k + block] += np.frombuffer(p.y).reshape(-1, r)
    own = items.rows()
    add(Y, np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own]), len(own))
    # A'A is nearly Y (W'Y)^-1 Y'; a shift above the rounding of single precision keeps the inverse stable
    shift = np.finfo(np.float32).eps * np.sqrt(V) * np.linalg.norm(Y)
    Y += shift * W
    C = W.T.astype(float) @ Y
    c, U = np.linalg.eigh((C + C.T) / 2)
    some = c > c.max() * 1e-14
    Q, s, _ = np.linalg.svd(Y @ (U[:, some] / np.sqrt(c[some])), full_matrices=False)
    squares = np.maximum(s * s - shift, 0)
    out = np.zeros((V, r), np.float32)  # the leading ones last
    out[:, r - len(s) :] = (Q / np.sqrt(np.maximum(squares, squares.max() * 1e-6 + 1e-12)))[:, ::-1]
    return out


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Longest common subsequence of an item (masks: word -> bits of its places) and words, by bit-parallel steps."""
    v = all_ = (1 << size) - 1
    for x in words:
        m = masks.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & all_
    return size - v.bit_count()


class Search:
    """Finds items in texts; built once for each task."""

    def __init__(self, items: Items, basis: np.ndarray, cosine: float, common: float, answer: float):
        self.items, self.cosine, self.common, self.answer = items, cosine, common, answer
        self.vocab = Vocabulary(items.hashes)
        self.E = (basis * items.idf[:, None]).astype(np.float32)
        q = np.array([self.E[x].sum(0) for x in items.rows()]).reshape(len(items.items), -1)
        self.q = (q / np.maximum(np.linalg.norm(q, axis=1), 1e-9)[:, None]).astype(np.float32)
        self.masks = []
        for x in items.items:
            m: dict[int, int] = {}
            for i, k in enumerate(x):
                m[k] = m.get(k, 0) | 1 << i
            self.masks.append(m)
        self.size = np.array([len(x) for x in items.items], np.int64)
        self.need = np.ceil(common * self.size - 1e-9)
        self.many = np.array([len(x) for x in items.answer], np.int64)
        self.least = np.maximum(1, np.ceil(answer * self.many - 1e-9)).astype(np.int64)
        self.span = -(-(2 * self.size + 16 + GRID) // GRID)  # cells of a window
        self.longest = int(self.span.max(initial=1))
        # items' words on end, and the places at which a word of the answer stands first
        self.flat = np.array([x for own in items.items for x in own], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.weight = np.array([items.idf[x] * (own.index(x) == i) for own in items.items for i, x in enumerate(own)], float)
        self.heavy = 0.8 * common * np.array([items.idf[sorted(set(x))].sum() for x in items.items])
        self.telling = np.array([x in ans and own.index(x) == i for own, ans in zip(items.items, items.answer) for i, x in enumerate(own)], bool)
        # answer word -> its items
        post = sorted((x, k) for k, ans in enumerate(items.answer) for x in ans)
        word = np.array([x for x, _ in post], np.int64)
        self.post = np.array([k for _, k in post], np.int64)
        self.post_at = np.searchsorted(word, np.arange(len(items.words)))
        self.post_n = np.bincount(word, minlength=len(items.words))

    def rows(self, buf, off) -> list[tuple[int, int, float, float, float, int]]:
        """(row, item, overlap, answer share, cosine, start word): the best window of each item found in each row; short items come after the others."""
        w = Words(buf, off, ALNUM)
        ids = self.vocab.ids(w.hashes())
        best: dict[tuple[int, int], tuple] = {}
        K, V = len(self.size), len(self.items.words)
        if K and len(ids):
            cells = -(-w.n // GRID)
            base = np.cumsum(cells) - cells
            row = np.repeat(np.arange(len(cells)), cells)
            start = w.first[row] + (np.arange(len(row)) - base[row]) * GRID
            end = np.minimum(start + GRID, (w.first + w.n)[row])
            tile = max(1, (1 << 23) // max(V, K))
            for c in range(0, len(row), tile):
                self._tile(w, ids, row, start, end, (base + cells)[row], c, min(c + tile, len(row)), best)
        for j, x in enumerate(self.items.short):
            at = np.flatnonzero(ids[: max(0, len(ids) - len(x) + 1)] == x[0])
            for i in range(1, len(x)):
                at = at[ids[at + i] == x[i]]
            r = np.searchsorted(w.first, at, side="right") - 1
            ok = at + len(x) <= (w.first + w.n)[r]
            for a, i in zip(at[ok].tolist(), r[ok].tolist()):
                best.setdefault((i, K + j), (1.0, int(w.first[i]) - a, 1.0, 1.0))
        return [(r, k, n, ans, c, -lo) for (r, k), (n, lo, ans, c) in sorted(best.items())]

    def _tile(self, w, ids, row, start, end, last, c0, c1, best) -> None:
        """Windows that begin in the cells c0..c1."""
        K, V, own = len(self.size), len(self.items.words), np.arange(c1 - c0)
        c2 = int(min(last[c1 - 1], c1 + self.longest - 1))
        n, a = c2 - c0, int(start[c0])
        x = ids[a : int(end[c2 - 1])]
        place = np.flatnonzero(x >= 0)
        tok, cell = x[place].astype(np.int64), np.repeat(np.arange(n), (end - start)[c0:c2])[place]
        here = np.zeros(n * V, bool)
        here[cell * V + tok] = True
        here = here.reshape(n, V)
        stop = np.minimum(last[c0:c1] - c0, n)
        # how many answer words each window holds at most, by item
        key = np.unique((cell * V + tok)[self.post_n[tok] > 0])
        word, m = key % V, self.post_n[key % V]
        k = self.post[np.repeat(self.post_at[word] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        sums = np.zeros((n + 1, K), np.int32)
        np.cumsum(np.bincount(np.repeat(key // V, m) * K + k, minlength=n * K).reshape(n, K), axis=0, out=sums[1:])
        found = []
        for span in np.unique(self.span).tolist():
            items = np.flatnonzero(self.span == span)
            c, j = np.nonzero((sums[np.minimum(own + span, stop)] - sums[: c1 - c0])[:, items] >= self.least[items])
            found.append(c * K + items[j])
        p, half_at, sim = self._latent(x, tok, place, cell, row[c0:c2], (start - a)[c0:c2], (end - a)[c0:c2])
        for c, k in sim:
            top = c - np.arange(self.longest)[:, None]  # every window over the passage
            ok = (top >= 0) & (top < c1 - c0) & (np.arange(self.longest)[:, None] < self.span[k])
            ok &= row[c0 + np.maximum(top, 0)] == row[c0 + c]
            found.append((top * K + k)[ok])
        c, k = np.divmod(np.unique(np.concatenate(found)), K)
        # what the different words allow at most
        total = np.concatenate([[0], np.cumsum(self.size[k])])
        done = 0
        while done < len(c):
            e = max(done + 1, int(np.searchsorted(total, total[done] + (1 << 19), side="right")) - 1)
            cc, kk = c[done:e], k[done:e]
            done = e
            size = self.size[kk]
            first = np.cumsum(size) - size
            at = np.repeat(self.at[kk] - first, size) + np.arange(size.sum())
            upto = np.minimum(cc + self.span[kk], stop[cc]) - 1
            line, upto, word = np.repeat(cc, size), np.repeat(upto, size), self.flat[at]
            got = here[line, word]
            for d in range(1, self.longest):
                got |= here[np.minimum(line + d, upto), word]
            ans = np.add.reduceat((got & self.telling[at]).astype(np.int64), first)
            enough = (np.add.reduceat(got.astype(np.int64), first) >= self.need[kk]) & (ans >= self.least[kk]) & (np.add.reduceat(got * self.weight[at], first) >= self.heavy[kk] - 1e-9)
            for i in np.flatnonzero(enough).tolist():
                ci, ki = int(cc[i]), int(kk[i])
                lo, hi = int(start[c0 + ci]) - a, int(end[c0 + min(ci + int(self.span[ki]), int(stop[ci])) - 1]) - a
                overlap = lcs(self.masks[ki], int(self.size[ki]), x[lo:hi].tolist()) / int(self.size[ki])
                if overlap >= self.common - 1e-9:
                    r = int(row[c0 + ci])
                    h = slice(*np.searchsorted(half_at, [lo, hi]).tolist())
                    new = (overlap, int(w.first[r]) - a - lo, int(ans[i]) / int(self.many[ki]), float((p[h] @ self.q[ki]).max()))
                    if new[:2] > best.get((r, ki), (0,))[:2]:
                        best[r, ki] = new

    def _latent(self, x, tok, place, cell, row, start, end):
        """Passages' unit vectors, where they begin, and (cells, items) of pairs whose cosine suffices."""
        half = PASSAGE // 2
        many = -(-(end - start) // half)
        base = np.cumsum(many) - many
        of = np.repeat(np.arange(len(many)), many)
        at = start[of] + (np.arange(len(of)) - base[of]) * half
        p = _sums(self.E, tok, None, base[cell] + (place - start[cell]) // half, len(of))
        r = row[of]
        p[:-1] += np.where((r[1:] == r[:-1])[:, None], p[1:], 0)  # a half and the next
        p /= np.maximum(np.linalg.norm(p, axis=1), 1e-9)[:, None]
        out, step = [], max(1, (1 << 20) // len(self.size))
        for i in range(0, len(p), step):
            h, k = np.nonzero(p[i : i + step] @ self.q.T >= self.cosine)
            out.append((of[i + h], k))
        return p, at, out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int = ITEM_WORDS):
    """The benchmark's items, up to `size` words of them at a time (an item at least)."""
    held, words = [], 0
    for r in benchmark.select(benchmark[id_col].alias("i"), benchmark[text_col].alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        n = len(r.t.split())
        if held and words + n > size:
            yield Items(held)
            held, words = [], 0
        held.append((r.i, r.t))
        words += n
    if held:
        yield Items(held)


def fit(docs: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", size: int = ITEM_WORDS) -> list[tuple[Items, np.ndarray]]:
    """Items, their weights over all documents, and their latent basis."""
    ready(docs.sparkSession)
    d, out = docs.select(docs[text_col].alias("text")), []
    for items in blocks(benchmark, item_col, "text" if text_col not in benchmark.columns else text_col, size):
        if items.words:
            items.weigh(*document_frequency(d, items))
            out.append((items, basis(d, items)))
    return out


COSINE, COMMON, ANSWER = 0.4, 0.6, 0.4


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", cosine: float = COSINE, common: float = COMMON, answer: float = ANSWER, size: int = ITEM_WORDS) -> DataFrame:
    """doc_id, item_id, overlap, answer, cosine, start: one row for each item found in each document."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema, arrow = f"doc_id {kind}, item_id {item_kind.simpleString()}, overlap double, answer double, cosine double, start long", to_arrow_type(item_kind)
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = None
    for items, base in fit(docs, benchmark, item_col=item_col, text_col=text_col, size=size):
        held = spark.sparkContext.broadcast((items, base))  # bounded by `size` words of items

        def run(it, held=held):
            s = Search(*held.value, cosine, common, answer)
            ids = s.items.ids + s.items.short_ids
            for b, buf, off in batches(it, "text"):
                got = s.rows(buf, off)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([ids[g[1]] for g in got], arrow)]
                    + [pa.array([float(g[i]) for g in got], pa.float64()) for i in (2, 3, 4)] + [pa.array([g[5] for g in got], pa.int64())],
                    ["doc_id", "item_id", "overlap", "answer", "cosine", "start"],
                )

        found = d.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", cosine: float = COSINE, common: float = COMMON, answer: float = ANSWER) -> DataFrame:
    """The rows of docs, all columns, that hold no item; nothing is shuffled."""
    spark = docs.sparkSession
    for items, base in fit(docs, benchmark, item_col=item_col, text_col=text_col):
        held = spark.sparkContext.broadcast((items, base))

        def run(it, held=held):
            s = Search(*held.value, cosine, common, answer)
            for b, buf, off in batches(it, text_col):
                keep = np.ones(b.num_rows, bool)
                keep[[g[0] for g in s.rows(buf, off)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontamination(spark, sf_dir):
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
