"""The first chunks of each query: queries x chunks scored in numpy blocks, beside the chunks.

Sums go in the order in which the Column expressions of retrieval and vectors add, so scores
are theirs to the last bit. A task holds bounded blocks of scores and k rows a query.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from skein.runtime import ready

CELLS = 2_000_000  # numbers of one block
_RUN = re.compile("[a-z0-9_]{3,}")


class Keywords:
    """Scores of lower-cased texts by lists of terms; -inf where no term stands. A term is of ASCII letters, digits and _, so each place of it lies in one run of these."""

    def __init__(self, terms: list[list[str] | None]):
        terms = [t or [] for t in terms]
        self.order = np.argsort([-len(t) for t in terms], kind="stable")
        own = [terms[q] for q in self.order]
        self.n = np.array([len(t) for t in own], np.int64)
        num = {t: k for k, t in enumerate(dict.fromkeys(t for ts in own for t in ts))}
        self.terms, self.lengths = num, sorted({len(t) for t in num})
        self.at = [np.array([num[t[p]] for t in own if len(t) > p], np.int64) for p in range(max(self.n, default=0))]
        self.rows = int(max(1, min(2000, CELLS // max(1, len(num), len(own)))))

    def _within(self, run: str) -> list[tuple[int, int]]:
        """(term, places of it that don't overlap)"""
        if len(run) > 200:
            return [(k, n) for t, k in self.terms.items() if (n := run.count(t))]
        return [(self.terms[t], run.count(t)) for t in {run[i : i + n] for n in self.lengths for i in range(len(run) - n + 1)} if t in self.terms]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """terms x texts"""
        runs: dict[str, int] = {}
        each = [[runs.setdefault(w, len(runs)) for w in _RUN.findall(t)] if t else [] for t in texts]
        row, run = np.repeat(np.arange(len(texts)), [len(x) for x in each]), np.array([w for x in each for w in x], np.int64)
        hits = [self._within(w) for w in runs]
        size = np.array([len(h) for h in hits], np.int64)
        first = np.cumsum(size) - size
        flat = np.array([x for h in hits for x in h], np.int64).reshape(-1, 2)
        m = size[run]
        at = np.repeat(first[run] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        cell = flat[at, 0] * len(texts) + np.repeat(row, m)
        return np.bincount(cell, weights=flat[at, 1], minlength=len(self.terms) * len(texts)).reshape(len(self.terms), len(texts))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        c = self.counts(texts.to_pylist())
        worth = np.where(c > 0, 1 + c, 0.0)
        s, met = np.zeros((len(self.n), len(texts))), np.zeros((len(self.n), len(texts)), np.int32)
        for at in self.at:  # term by term, as they are added in the expression
            own = worth[at]
            met[: len(at)] += own > 0
            s[: len(at)] += own / (1 + self.n[: len(at), None])
        s[met == self.n[:, None]] *= 1.5
        s[s <= 0] = -np.inf
        out = np.empty_like(s)
        out[self.order] = s
        return out


class Cosines:
    """Scores of vectors by vectors; a vector that is null or holds a null scores 0, of two lengths the longer is cut."""

    def __init__(self, vectors: pa.Array):
        self.v, self.n = _matrix(vectors)
        self.norm = _norm(self.v)
        self.rows = int(max(1, min(2000, CELLS // max(1, len(self.n), self.v.shape[1]))))

    def __call__(self, vectors: pa.Array) -> np.ndarray:
        v, n = _matrix(vectors)
        dot = np.zeros((len(self.n), len(n)))
        same = len({*n.tolist(), *self.n.tolist()}) <= 1
        with np.errstate(all="ignore"):
            for i in range(min(v.shape[1], self.v.shape[1])):
                x = v[None, :, i] * self.v[:, i, None]
                dot += x if same else np.where((n[None, :] > i) & (self.n[:, None] > i), x, 0.0)
            both = _norm(v)[None, :] * self.norm[:, None]
            return np.where((both > 0) | np.isnan(both), dot / both, 0.0)


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in rows, zeros behind shorter ones; their lengths."""
    rows = [[] if x is None or None in x else x for x in col.to_pylist()]
    n = np.array([len(x) for x in rows], np.int64)
    out = np.zeros((len(rows), max(n, default=0)))
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out, n


def _norm(v: np.ndarray) -> np.ndarray:
    s = np.zeros(len(v))
    for i in range(v.shape[1]):
        s += v[:, i] * v[:, i]
    return np.sqrt(s)


class _Best:
    """The first k of each query so far: by score, then chunk_id."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.held, self.some = k, np.full(queries, -np.inf), [], 0

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        key = np.where(np.isnan(scores), np.inf, scores)  # Spark holds NaN for the greatest
        low = self.floor
        if key.shape[1] > self.k:
            low = np.maximum(low, np.partition(key, -self.k, axis=1)[:, -self.k])
        q, r = np.nonzero((key >= low[:, None]) & (key > -np.inf))
        self.held.append(pa.table({"q": q, "key": key[q, r], "score": scores[q, r], "chunk_id": ids.take(pa.array(r))}))
        self.some += len(q)
        if self.some > CELLS // 8:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        t = pa.concat_tables(self.held)
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("key", "descending"), ("chunk_id", "ascending")], null_placement="at_start"))
        q = t["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        t, q, place = t.filter(pa.array(place < self.k)), q[place < self.k], place[place < self.k]
        last = place == self.k - 1
        self.floor[q[last]] = t["key"].to_numpy()[last]
        self.held, self.some = [t], 0
        return t


def best(chunks: DataFrame, queries: DataFrame, k: int, made) -> DataFrame:
    """query_id, chunk_id, score: of each part of the chunks, the first k of each query. Both have an id and what made(queries' column)(chunks' column) scores, queries x chunks.

    queries: so few that the driver may hold them; they are sent to the chunks' tasks.
    """
    spark = ready(chunks.sparkSession)
    sent = spark.sparkContext.broadcast(queries.toArrow().combine_chunks())
    a, b = queries.schema[0], chunks.schema[0]
    kind = StructType([StructField("query_id", a.dataType), StructField("chunk_id", b.dataType), StructField("score", DoubleType())])

    def run(it):
        asked = sent.value
        if not asked.num_rows:
            return
        score, found = made(asked.column(1).combine_chunks()), _Best(asked.num_rows, k)
        for batch in it:
            for lo in range(0, batch.num_rows, score.rows):
                part = batch.slice(lo, score.rows)
                found.add(part.column(0), score(part.column(1)))
        t = found.cut()
        if t is not None:
            ids = asked.column(0).take(t["q"])
            yield from pa.table({"query_id": ids, "chunk_id": t["chunk_id"], "score": t["score"]}).combine_chunks().to_batches()

    return chunks.mapInArrow(run, kind)


def by_keywords(terms: pa.Array) -> Keywords:
    return Keywords(terms.to_pylist())
