"""Pairs of words that share a stretch, counted by documents, and walks over them.

Words have numbers, the frequent ones first, and a pair is one number. Texts are read once: the
numbers of WINDOW words at a time are written as a compressed row. From each window pairs are made
in TURNS, so that a pair leaves a window once, with its count. Pairs travel sorted, as compressed
differences, under parts that are ranges of pairs (cuts); a part adds up its pairs, and those of
LEAST documents or more that stand together more often than chance has them are links. All of it
goes in ROUNDS over the windows, each for other words: no more than one round's pairs are on disk.

Up to MANY words have numbers at once and a walk's rates are arrays that go to all tasks. If there
are more, words are grouped, each two groups have rounds of their own, and walks go by joins.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.text import ALNUM, Words, batches, trim
from skein.runtime import drop_table, ready, table

MANY, WINDOW, ROUNDS, TURNS, SPREAD, PART = 1 << 21, 1 << 20, 6, 2, 64, 1 << 20
BITS = np.uint64(22)  # of a word's number, two groups together
LOW = np.uint64((1 << 22) - 1)
ROW = np.uint64(20)  # bits of a row's number in a window, and of a count there
_zstd = pa.Codec("zstd", compression_level=1)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on; their bytes lie apart by place, as many places as the largest number has."""
    raw = []
    for x in arrays:
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        raw += [len(x).to_bytes(8, "little"), bytes([width]), *((x >> x.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(width))]
    raw = b"".join(raw)
    return len(raw).to_bytes(8, "little") + _zstd.compress(raw, asbytes=True)


def spread(blob: bytes) -> list[np.ndarray]:
    """The arrays, as 64-bit numbers."""
    raw, at, out = np.frombuffer(_zstd.decompress(blob[8:], int.from_bytes(blob[:8], "little")), np.uint8), 0, []
    while at < len(raw):
        size, width, at = int.from_bytes(raw[at : at + 8].tobytes(), "little"), int(raw[at + 8]), at + 9
        x = np.zeros(size, np.uint64)
        for k in range(width):
            x |= raw[at : at + size].astype(np.uint64) << np.uint64(8 * k)
            at += size
        out.append(x)
    return out


def packed(k: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs and their counts."""
    return squeezed(np.diff(k, prepend=np.uint64(0)), n)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    d, n = spread(blob)
    return np.cumsum(d, dtype=np.uint64), n.astype(np.uint32)


class Numbers:
    """hash -> number (0..), -1 for others; a start by the first bits, then a step or some in order."""

    def __init__(self, hashes: np.ndarray):
        order = np.argsort(hashes)
        self.sorted = np.append(hashes[order], np.uint64((1 << 64) - 1))
        self.number = np.append(order, -1).astype(np.int32)
        self.start = np.searchsorted(self.sorted[:-1], np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)

    def ids(self, h: np.ndarray) -> np.ndarray:
        at = self.start[(h >> np.uint64(44)).astype(np.int64)]
        left = np.flatnonzero(self.sorted[at] < h)
        while len(left):
            at[left] += 1
            left = left[self.sorted[at[left]] < h[left]]
        i = self.number[at]
        i[self.sorted[at] != h] = -1
        return i


def numbered(vocab: Numbers, buf, off, stretch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, word) pairs in order, each once: number of the stretch, number of the word; and each stretch's row, of the rows that have pairs."""
    w = Words(buf, off, ALNUM)
    if not len(w.start):
        return np.zeros(0, np.int32), np.zeros(0, np.uint32), np.zeros(0, np.int32)
    i, has = vocab.ids(w.hashes()), -(-w.n // stretch)  # stretches of a row
    of = np.repeat(np.arange(len(has)), has)
    size = np.full(len(of), stretch)
    some = has > 0
    size[np.cumsum(has)[some] - 1] = w.n[some] - stretch * (has[some] - 1)
    x = (np.repeat(np.arange(len(of)) << int(BITS), size) | i)[i >= 0]
    x.sort()
    x = x[_new(x)]
    s, word, used = x >> int(BITS), x & int(LOW), np.zeros(len(off) - 1, bool)
    two = np.bincount(s, minlength=len(of))[s] > 1  # else there is no pair
    s, word = s[two], word[two]
    used[of[s]] = True
    return s.astype(np.int32), word.astype(np.uint32), (np.cumsum(used) - 1)[of].astype(np.int32)


def window(held: list) -> bytes:
    """What numbered() made of some pieces, as one blob; stretches without pairs are left out."""
    step, size, word, rows = [], [], [], 0
    for s, w, row in held:
        first = np.flatnonzero(_new(s))
        at = row[s[first]]
        step.append(np.diff(at, prepend=at[:1] - 1 if rows else at[:1]))  # 1 where another row begins
        size.append(np.diff(np.append(first, len(s))))
        d = np.diff(w, prepend=w[:1])  # a stretch's words are in order
        d[first] = w[first]
        word.append(d)
        rows += int(at[-1]) + 1
    return squeezed(*(np.concatenate(x) for x in (step, size, word)))


def unwound(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a window: its number (in order within a stretch), where its stretch begins, its row."""
    step, size, d = spread(blob)
    size = size.astype(np.int64)
    first = np.cumsum(size) - size
    word = np.cumsum(d)
    word -= np.repeat(word[first] - d[first], size)
    return word, np.repeat(first, size), np.repeat(np.cumsum(step), size)


def met(word: np.ndarray, first: np.ndarray, row: np.ndarray, left: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (the rarer word's number first) and in how many rows they share a stretch; left: where in word the rarer words to look at are."""
    place, out = left - first[left], []
    order = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
    left, size = left[order], np.bincount(place)
    here, near, apart = (word[left] << (BITS + ROW)) | row[left], word << ROW, None if side is None else side[word.astype(np.int64)]
    for d in np.flatnonzero(size).tolist():  # words with d others before them in their stretch
        a, e = int(size[:d].sum()), int(size[: d + 1].sum())
        if d:
            x = sliding_window_view(near, d)[left[a:e] - d] | here[a:e, None]
            out.append(x.ravel() if side is None else x[sliding_window_view(apart, d)[left[a:e] - d] != apart[left[a:e], None]])
    x = np.concatenate(out) if out else np.zeros(0, np.uint64)
    out.clear()
    x.sort()
    x = x[_new(x)] >> ROW  # a row counts once
    first = np.flatnonzero(_new(x))
    return x[first], np.diff(np.append(first, len(x)))


def cuts(df: np.ndarray, parts: int, windows: float, near: int) -> np.ndarray:
    """Where parts 1.. begin, so that about as many pairs are sent to each, if a word meets near others a document, by their frequency, and a pair leaves a window once."""
    before = np.cumsum(df) - df

    def sent(i, j):  # pairs of word i with words under j
        return 1 / (1 / np.maximum(near * df[i] * before[j] / before[-1], 1e-9) + 1 / np.maximum(windows * j, 1e-9))

    if len(df) < 3 or parts < 2:
        return np.zeros(0, np.uint64)
    i = np.arange(len(df))
    total = np.cumsum(sent(i, i))
    want = total[-1] * np.arange(1, parts) / parts
    i = np.minimum(np.searchsorted(total, want), len(df) - 1)
    want = want - np.where(i > 0, total[i - 1], 0)
    lo, hi = np.zeros(len(i), np.int64), i.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        enough = sent(i, mid) >= want
        lo, hi = np.where(enough | (lo >= hi), lo, mid + 1), np.where(enough, mid, hi)
    return (i.astype(np.uint64) << BITS) | lo.astype(np.uint64)


def _new(x: np.ndarray) -> np.ndarray:
    """Where a sorted array has another value than before."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def _cut(part: np.ndarray, k: np.ndarray, n: np.ndarray):
    """(part, blob) of pairs by part, in the order they have."""
    order = np.argsort(part.astype(np.uint16 if len(part) and part.max() < 1 << 16 else np.uint64), kind="stable")
    part, k, n = part[order], k[order], n[order]
    first = np.flatnonzero(_new(part)).tolist()
    for a, b in zip(first, [*first[1:], len(part)]):
        yield int(part[a]), packed(k[a:b], n[a:b])


def _ranges(bounds: np.ndarray, k: np.ndarray, n: np.ndarray):
    """(part, blob) of sorted pairs by the range they fall in."""
    at = [0, *np.searchsorted(k, bounds).tolist(), len(k)]
    for part, (a, b) in enumerate(zip(at, at[1:])):
        if a < b:
            yield part, packed(k[a:b], n[a:b])


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def _weight(k: np.ndarray, n: np.ndarray, df: np.ndarray, rows: int) -> np.ndarray:
    return np.log(n * float(rows) / (df[(k >> BITS).astype(np.int64)] * df[(k & LOW).astype(np.int64)]))


@contextmanager
def _sent(spark, *x):
    """What all tasks get; it is gone from executors and driver afterwards, else each step of a walk would leave its rates there."""
    b = spark.sparkContext.broadcast(x)
    try:
        yield b
    finally:
        b.destroy()


def _swept(spark) -> None:
    """Shuffle files of results that stand are deleted when the driver's JVM collects what refers to them."""
    spark._jvm.System.gc()


def links(docs: DataFrame, words: np.ndarray, df: np.ndarray, rows: int, least: int, stretch: int, side: np.ndarray | None = None, window: int = WINDOW) -> list[DataFrame]:
    """Tables (part, blob) of the links among words (hashes; df: documents with each); with sides, of those between both sides."""
    spark = ready(docs.sparkSession)
    df = np.asarray(df, float)
    parts = 1 + 8 * int(df.sum()) // ROUNDS // PART  # so that a part is a million pairs or some
    with _sent(spark, words, df, side, cuts(df, parts, max(df.sum() / window, 1), 2 * stretch)) as to:
        return _links(docs, to, rows, least, stretch, window)


def _links(docs: DataFrame, to, rows: int, least: int, stretch: int, most: int) -> list[DataFrame]:
    spark = docs.sparkSession

    def numbers(it):
        vocab, held, size, n = Numbers(to.value[0]), [], 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([window(held)], pa.binary())], ["blob"])
        for _, buf, off in batches(it, "text", 1 << 18):
            s, word, of = numbered(vocab, buf, off, stretch)
            if len(word):
                held.append((s, word, of))
                size, n = size + len(word), n + int(of.max()) + 1
            if size >= most or n >= 1 << 19:  # a row's number has ROW bits; a piece has fewer than 1 << 17 such rows
                yield row()
                held, size, n = [], 0, 0
                trim()
        if held:
            yield row()

    def emitted(blob, k):
        word, first, row = unwound(blob)
        turns = TURNS * (1 + len(word) // (2 * most))
        mine = np.flatnonzero(word % np.uint64(ROUNDS) == np.uint64(k))
        place = word[mine]
        ends = np.sort(place)[np.arange(1, turns) * len(place) // turns] if len(place) else place
        turn = np.searchsorted(ends, place, side="right")
        for t in range(turns):
            x, n = met(word, first, row, mine[turn == t], to.value[2])
            out = list(_ranges(to.value[3], x, n))
            for a in range(0, len(out), 64):
                yield _batch(out[a : a + 64])

    def counted(k):
        def run(it):
            for b in it:
                for blob in b.column(0).to_pylist():
                    yield from emitted(blob, k)
                    trim()

        return run

    def total(part, blobs):
        x = np.concatenate([(k << ROW) | n for k, n in map(unpacked, blobs)])
        x.sort()
        first = np.flatnonzero(_new(x >> ROW))
        k, n = x[first] >> ROW, np.add.reduceat(x & np.uint64((1 << 20) - 1), first).astype(np.int64)
        on = n >= least
        k, n = k[on], n[on]
        on = _weight(k, n, to.value[1], rows) > 0
        return (part, packed(k[on], n[on]))

    def added(it):
        part, blobs = None, []
        for b in it:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if p != part and blobs:
                    yield _batch([total(part, blobs)])
                    blobs = []
                part = p
                blobs.append(x)
        if blobs:
            yield _batch([total(part, blobs)])

    out, windows = [], table(docs.select("text").mapInArrow(numbers, "blob binary"), "windows")
    for k in range(ROUNDS):
        _swept(spark)
        sent = windows.mapInArrow(counted(k), "part long, blob binary").repartition("part").sortWithinPartitions("part")
        out.append(table(sent.mapInArrow(added, "part long, blob binary"), "links"))
    drop_table(windows)
    return out


def both_ways(tables: list[DataFrame]) -> DataFrame:
    """The links of both directions, filed under the first word."""

    def run(it):
        for b in it:
            for x in b.column(1).to_pylist():
                k, n = unpacked(x)
                for a in range(0, len(k), 1 << 19):
                    i, m = k[a : a + (1 << 19)], n[a : a + (1 << 19)]
                    i, m = np.concatenate([i, ((i & LOW) << BITS) | (i >> BITS)]), np.concatenate([m, m])
                    order = np.argsort(i)
                    i, m = i[order], m[order]
                    rows = list(_cut((i >> BITS) % np.uint64(SPREAD), i, m))
                    if rows:
                        yield _batch(rows)

    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return table(out.mapInArrow(run, "part long, blob binary").repartition("part"), "company")


def as_rows(tables: list[DataFrame], words: np.ndarray, df: np.ndarray, rows: int) -> DataFrame:
    """u, v, w of links in both directions."""
    df = np.asarray(df, float)

    def run(it):
        for b in it:
            for x in b.column(1).to_pylist():
                k, n = unpacked(x)
                for a in range(0, len(k), 1 << 16):
                    i = k[a : a + (1 << 16)]
                    w = _weight(i, n[a : a + (1 << 16)], df, rows)
                    u, v = words[(i >> BITS).astype(np.int64)].view(np.int64), words[(i & LOW).astype(np.int64)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, v])), pa.array(np.concatenate([v, u])), pa.array(np.concatenate([w, w]))], ["u", "v", "w"])

    out = None
    for t in tables:
        t = t.mapInArrow(run, "u long, v long, w double")
        out = t if out is None else out.union(t)
    return out


def walked(company: DataFrame, edges: DataFrame, words: np.ndarray, df: np.ndarray, rows: int, seeds: np.ndarray, start: np.ndarray, steps: int, restart: float) -> np.ndarray:
    """Rates of the walks from start (a row a seed, a column a walk) over links and edges (u, v, w; both directions), for words and then seeds."""
    df = np.asarray(df, float)
    nodes = np.concatenate([words, seeds])

    def known(it):
        vocab = Numbers(to.value[0])
        for b in it:
            i = [pa.array(vocab.ids(b.column(k).to_numpy().view(np.uint64))) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*i, b.column(2)], ["u", "v", "w"])

    spark = edges.sparkSession
    with _sent(spark, nodes) as to:
        near = table(edges.select("u", "v", "w").repartition("v").mapInArrow(known, "u int, v int, w double"), "near")

    def sums(out):
        at = np.flatnonzero(out.any(1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([out[at].tobytes()])], ["at", "sum"])

    def step(rates, sent_df):
        with _sent(spark, rates) as now:
            return _step(rates.shape, now, sent_df)

    def _step(shape, now, sent_df):
        def far(it):
            (y,), (df,) = now.value, sent_df.value
            out, columns = np.zeros(y.shape), [np.ascontiguousarray(c) for c in y.T]
            for b in it:
                for x in b.column(1).to_pylist():
                    k, n = unpacked(x)
                    u, v = (k & LOW).astype(np.int64), k >> BITS
                    first = np.flatnonzero(_new(v))
                    v = v[first].astype(np.int64)
                    w = np.log(n * float(rows) / (df[u] * np.repeat(df[v], np.diff(np.append(first, len(u))))))
                    for c in range(len(columns)):
                        out[v, c] += np.add.reduceat(w * columns[c][u], first)
            yield sums(out)

        def close(it):
            (y,) = now.value
            out = np.zeros(y.shape)
            for b in it:
                u, v, w = (b.column(k).to_numpy() for k in range(3))
                for c in range(y.shape[1]):
                    out[:, c] += np.bincount(v, w * y[u, c], len(out))
            yield sums(out)

        got = np.zeros(shape)
        kind = "at binary, sum binary"
        for r in company.mapInArrow(far, kind).union(near.mapInArrow(close, kind)).collect():  # each word in few of them
            at = np.frombuffer(r[0], np.int32)
            got[at] += np.frombuffer(r[1]).reshape(len(at), shape[1])
        return got

    first = np.zeros((len(nodes), start.shape[1]))
    first[len(words) :] = start
    at = first
    with _sent(spark, df) as sent_df:
        out = step(np.ones((len(nodes), 1)), sent_df)  # weights are the same in both directions
        scale = np.divide(1 - restart, out, out=np.zeros(out.shape), where=out > 0)
        for _ in range(steps):
            at = step(at * scale, sent_df) + restart * first
    drop_table(near)
    return at


def as_table(spark, nodes: np.ndarray, rates: np.ndarray) -> DataFrame:
    """node, a, b: a table of the nodes that were visited."""
    at = np.flatnonzero(rates.any(1))
    h, a, b = nodes[at].view(np.int64), rates[at, 0], rates[at, 1]

    def run(_):
        for k in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + (1 << 16)]) for x in (h, a, b)], ["node", "a", "b"])

    return table(spark.range(1).coalesce(1).mapInArrow(run, "node long, a double, b double"), "walk")


def _words(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = found.select("h", "n").toArrow()  # at most two groups
    h, n = t.column("h").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.lexsort((h, -n))
    return h[order], n[order]


def visited(docs: DataFrame, found: DataFrame, edges: DataFrame, rows: int, seeds: np.ndarray, start: np.ndarray, walks, *, least: int, stretch: int, steps: int, restart: float, many: int = MANY) -> DataFrame:
    """node, a, b: rates of two walks from seeds over edges (u, v, w) and the links among all words of found (h, n: documents with it).

    walks(steps, start): the same by joins, for more words than many.
    """
    spark = docs.sparkSession
    count = found.count()
    if count <= many:
        h, n = _words(found)
        made = links(docs, h, n, rows, least, stretch)
        company = both_ways(made)
        for t in made:
            drop_table(t)
        _swept(spark)
        rates = walked(company, edges, h, n, rows, seeds, start, steps, restart)
        drop_table(company)
        return as_table(spark, np.concatenate([h, seeds]), rates)
    groups, all_rows, made = -(-count * 20 // (many * 19)), edges.select("u", "v", "w"), []
    found = found.withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups)))
    for a, b in combinations_with_replacement(range(groups), 2):
        h, n = _words(found.where(F.col("g").isin(a, b)))
        if not len(h):
            continue
        side = np.isin(h, _words(found.where(F.col("g") == a))[0]) if a != b else None
        got = links(docs, h, n, rows, least, stretch, side)
        made += got
        all_rows = all_rows.union(as_rows(got, h, n, rows))
    all_rows = table(all_rows, "edges")
    for t in made:
        drop_table(t)
    out = table(all_rows.join(all_rows.groupBy("u").agg(F.sum("w").alias("out")), "u").select("u", "v", (F.col("w") / F.col("out")).alias("p")), "steps")
    drop_table(all_rows)
    first = spark.createDataFrame([(x, *map(float, y)) for x, y in zip(seeds.view(np.int64).tolist(), start)], "node long, a double, b double")
    rates = walks(out, first, steps, restart)
    drop_table(out)
    return rates
