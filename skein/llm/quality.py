"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are made by numpy from the bytes and words of whole texts. Trees are grown on
binned statistics of a bounded sample of labelled documents (labelled.SAMPLE rows) and
flattened into arrays; scoring walks all trees for a batch of rows at once.

Defined results: null text counts as empty, all its statistics are 0 and it is scored like
any text; null id is scored (held_out false); repeated rows are scored each for itself;
without labelled rows every score is 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.labelled import SAMPLE, crc_mod, sample, sampled_documents
from skein.llm.text import ALNUM, NONSPACE, Words, batches, mix
from skein.runtime import read, ready

NAMES = (
    "log_bytes log_words word_len word_len_sd upper digit bang symbol bar stop comma newline high space unique_words top_word same_as_last "
    "unique_pairs lines unique_lines top_line odd_words short_words words_per_stop quote"
).split()


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_CLASSES = [_class(x) for x in (bytes(range(65, 91)), b"0123456789", b"!", b"*&#$%@^~<>{}[]\\=+", b"|", b".", b",;:", b"\n", bytes(range(128, 256)), b" \t\r", b"\"'`")]
_ODD = (_CLASSES[2] + _CLASSES[3] + _CLASSES[4] > 0).astype(np.uint8)
_LINE = np.arange(256, dtype=np.uint8)
_LINE[10] = 0


def _unique(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: different values, and how often the commonest occurs."""
    n, top = np.zeros(rows), np.zeros(rows)
    if len(h):
        key = np.sort(mix(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(24) | (row.astype(np.uint64) << np.uint64(40)))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        own = (key[at] >> np.uint64(40)).astype(np.int64)
        n = np.bincount(own, minlength=rows).astype(float)
        np.maximum.at(top, own, np.diff(np.concatenate([at, [len(key)]])))
    return n, top


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x len(NAMES)."""
    R = len(off) - 1
    size = np.diff(off).astype(float)
    each = np.maximum(size, 1)
    # bytes by class, counted per row: one 256-bin histogram per row, then a small product
    hist = np.zeros((R, 256), np.int64)
    for a in range(0, len(buf), 1 << 18):
        e = min(a + (1 << 18), len(buf))
        lo, hi = int(np.searchsorted(off, a, side="right")) - 1, int(np.searchsorted(off, e, side="left"))
        row = np.repeat(np.arange(hi - lo) * 256, np.diff(np.clip(off[lo : hi + 1], a, e)))
        hist[lo:hi] += np.bincount(row + buf[a:e], minlength=(hi - lo) * 256).reshape(-1, 256)
    up, digit, bang, symbol, bar, stop, comma, newline, high, space, quote = (hist @ np.array(_CLASSES).T).T
    w, s = Words(buf, off, ALNUM), Words(buf, off, NONSPACE)
    h, n, wr = w.hashes(), w.n, w.row()
    words = np.maximum(n, 1)
    ln = (w.end - w.start).astype(float)
    mean = np.bincount(wr, ln, R) / words
    sd = np.sqrt(np.maximum(np.bincount(wr, ln * ln, R) / words - mean**2, 0))
    uw, tw = _unique(wr, h, R)
    same = np.zeros(R)
    up_pairs = np.zeros(R)
    if len(h) > 1:
        inside = wr[1:] == wr[:-1]
        same = np.bincount(wr[1:][inside & (h[1:] == h[:-1])], minlength=R)
        up_pairs, _ = _unique(wr[1:][inside], mix(h[:-1] * np.uint64(3) + h[1:])[inside], R)
    lines = Words(buf, off, _LINE)
    ul, tl = _unique(lines.row(), lines.hashes(), R)
    nl = np.maximum(lines.n, 1)
    ns = np.maximum(s.n, 1)
    odd = np.maximum.reduceat(_ODD[buf], s.start) if len(s.start) else np.zeros(0, np.uint8)  # what follows a word is white space
    odd_words = np.bincount(s.row()[odd > 0], minlength=R)
    short = np.bincount(wr[ln <= 3], minlength=R)
    return np.column_stack([
        np.log1p(size), np.log1p(n), mean, sd, up / each, digit / each, bang / each, symbol / each, bar / each, stop / each, comma / each, newline / each, high / each, space / each,
        uw / words, tw / words, same / words, up_pairs / np.maximum(n - 1, 1), np.log1p(lines.n), ul / nl, tl / nl, odd_words / ns, short / words, np.log1p(n / (stop + 1)), quote / each,
    ])


class Trees:
    """Gradient-boosted trees on binned columns, kept as flat arrays: feature, cut, left child, value."""

    def __init__(self, depth: int = 4, trees: int = 60, bins: int = 64, rate: float = 0.15, least: float = 20.0, l2: float = 1.0):
        self.depth, self.trees, self.bins, self.rate, self.least, self.l2 = depth, trees, bins, rate, least, l2
        self.start = 0.0
        self.feature, self.cut, self.left, self.value, self.roots = (np.zeros(0, np.int64) for _ in range(5))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, f = x.shape
        p = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        if n < 2 or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        flat = binned + np.arange(f) * self.bins
        feature, cut, left, value, roots = [], [], [], [], []
        score = np.full(n, self.start)
        least = min(self.least, n / 20)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            roots.append(len(feature))
            feature.append(-1), cut.append(0.0), left.append(-1), value.append(0.0)
            at = [(roots[-1], np.arange(n), 0)]
            while at:
                node, rows, d = at.pop()
                G, H = g[rows].sum(), h[rows].sum()
                value[node] = self.rate * G / (H + self.l2)
                best = (1e-6, -1, 0)
                if d < self.depth and len(rows) >= 2 * least:
                    k = flat[rows].ravel()
                    sg = np.bincount(k, np.repeat(g[rows], f), f * self.bins).reshape(f, -1).cumsum(1)
                    sh = np.bincount(k, np.repeat(h[rows], f), f * self.bins).reshape(f, -1).cumsum(1)
                    sn = np.bincount(k, minlength=f * self.bins).reshape(f, -1).cumsum(1)
                    gain = sg**2 / (sh + self.l2) + (G - sg) ** 2 / (H - sh + self.l2) - G * G / (H + self.l2)
                    gain[(sn < least) | (len(rows) - sn < least)] = 0
                    j, b = divmod(int(gain.argmax()), self.bins)
                    if gain[j, b] > best[0] and b < len(edges[j]):
                        best = (gain[j, b], j, b)
                if best[1] < 0:
                    score[rows] += value[node]
                    continue
                _, j, b = best
                goes = binned[rows, j] <= b
                feature[node], cut[node], left[node] = j, float(edges[j][b]), len(feature)
                for part in (rows[goes], rows[~goes]):
                    at.append((len(feature), part, d + 1))
                    feature.append(-1), cut.append(0.0), left.append(-1), value.append(0.0)
        self.feature, self.cut, self.left, self.value, self.roots = map(np.array, (feature, cut, left, value, roots))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; all rows take one step down at a time, tree by tree."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for r in self.roots:
            at = np.full(len(x), r)
            for _ in range(self.depth):
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, self.left[at] + (x[rows, f] > self.cut[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit_quality(docs: DataFrame, labels: DataFrame, keep, rows: int = SAMPLE) -> Trees:
    """Trees fitted on at most `rows` labelled documents."""
    ready(docs.sparkSession)
    chosen = sampled_documents(docs, sample(labels, "quality", keep, rows))

    def run(it):
        for b, buf, off in batches(it, "text"):
            x = statistics(buf, off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = chosen.select("y", "text").mapInArrow(run, "y int, x array<double>").toPandas()  # at most `rows` rows
    x = np.array(got.x.tolist(), float).reshape(len(got), len(NAMES))
    order = np.lexsort((*x.T, got.y.to_numpy()))  # rows come in any order
    return Trees().fit(x[order], got.y.to_numpy(float)[order])


def score_quality(docs: DataFrame, trees: Trees, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""
    ready(docs.sparkSession)

    def run(it):
        for b, buf, off in batches(it, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.predict(statistics(buf, off)))], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def op10_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    trees = fit_quality(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return score_quality(docs, trees).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
