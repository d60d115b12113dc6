"""Substring dedup: drop words covered by a window of words that also starts earlier.

1. Every window of `size` words is filed under its minimiser, the least hash among its runs
   of GRAM words; neighbouring windows with one minimiser are one run. Equal windows have
   equal minimisers, so a window meets its like under that one only: minimisers are the
   shards. A minimiser that has one run has nothing to meet, and only its number was sent.
2. The words of the other runs are fetched (a join on the id) and go to their shard. There
   the different runs are put into a compressed FM-index: a wavelet matrix of the
   Burrows-Wheeler transform and a sampled suffix array, without the text. All runs stream
   through it: backward search gives their matching statistics up to `size`, and for matches
   that long the place of the first occurrence. This alone decides what is a repeat.
3. Hot minimisers (over `hot` runs and more than a 4-millionth of all; found on every 16th
   document, a choice that only balances tasks) are split before they meet: their runs are
   dealt to several tasks, each of which gets the index of the different runs, which were
   found with partial aggregation. An index over PART runs is cut in parts, and all runs of
   that minimiser stream through each part.
4. Texts and their covered intervals meet once, in a join on the id; the texts' exchange is
   the one that step 2 used.

Words are told apart by 48 of their hash's bits, windows by all their words.

Defined results: ids are whole numbers; null text has no words; rows with null id take no
part and lose nothing; rows that repeat an id are one document given more than once: an
interval found in one is taken from all, and none makes another a repeat at the same place;
texts shorter than a window lose nothing; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.fmindex import FMIndex
from skein.llm.text import _P, EXACT, Words, batches, mix
from skein.runtime import drop_table, read, ready, table

SIZE, GRAM = 20, 6
CHUNK, HOT, PART, SPLITS = 200_000, 20_000, 20_000, 64  # words in an index; runs of a hot minimiser; runs in a hot one's index; tasks a hot one is dealt to at most
STEP = 1 << 18  # words looked at at once
NONE = np.zeros(0, np.int64)


def runs(buf: np.ndarray, off: np.ndarray, size: int = SIZE, gram: int = GRAM):
    """(row, start, windows, minimiser, may repeat itself) of each run of windows; long texts go on in a new run every STEP words."""
    w = Words(buf, off, EXACT)
    h, per, out = w.hashes(), size - gram + 1, []
    for at in range(0, max(0, len(h) - size + 1), STEP):
        x = h[at : at + STEP + size - 1]
        grams, scale = np.zeros(len(x) - gram + 1, np.uint64), 1
        for j in range(gram):
            grams += x[j : j + len(grams)] * np.uint64(scale)
            scale = scale * int(_P) & (1 << 64) - 1
        grams, k = mix(grams), 1
        low = grams
        while 2 * k <= per:
            low = np.minimum(low[:-k], low[k:])
            k *= 2
        if k < per:
            low = np.minimum(low[: len(low) - (per - k)], low[per - k :])
        many = np.zeros(len(low), np.int8)  # places of its minimiser in a window
        for j in range(per):
            many += grams[j : j + len(low)] == low
        place = at + np.arange(len(low))
        row = np.searchsorted(w.first, place, side="right") - 1
        ok = np.flatnonzero(place + size <= w.first[row] + w.n[row])
        if not len(ok):
            continue
        new = np.ones(len(ok), bool)
        new[1:] = (np.diff(ok) != 1) | (low[ok[1:]] != low[ok[:-1]]) | (row[ok[1:]] != row[ok[:-1]])
        first = np.flatnonzero(new)
        own, count = row[ok[first]], np.diff(np.append(first, len(ok)))
        out.append((own, place[ok[first]] - w.first[own], count, low[ok[first]], (np.maximum.reduceat(many[ok], first) > 1) | (count > per)))
    if not out:
        return NONE, NONE, NONE, NONE.view(np.uint64), NONE.astype(bool)
    return tuple(np.concatenate(c) for c in zip(*out))


def hot_minimisers(docs: DataFrame, size: int, hot: int) -> dict[int, int]:
    """Minimisers of very many runs and into how many tasks to deal them; at most 4 million."""

    def run(it):
        for b, buf, off in batches(it, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(runs(buf, off, size)[3].view(np.int64))], ["low"])

    seen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(16)) == 0).select("text").mapInArrow(run, "low long").groupBy("low").agg(F.count("*").alias("n"))
    seen = table(seen.where("n > 1"), "seen")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    got = seen.where(F.col("n") > max(hot / 16, total / 4e6)).toPandas()
    drop_table(seen)
    return {int(k): int(min(SPLITS, -(-16 * n // hot))) for k, n in zip(got.low, got.n)}


def _dealt(low: np.ndarray, doc: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for a run of an ordinary minimiser, else which of the tasks of its minimiser it goes to, from 1."""
    out = np.zeros(len(low), np.int64)
    if len(hot[0]):
        k = np.minimum(np.searchsorted(hot[0], low), len(hot[0]) - 1)
        is_hot = hot[0][k] == low
        out[is_hot] = 1 + mix(doc[is_hot].astype(np.uint64)) % hot[1][k[is_hot]].astype(np.uint64)
    return out


def _open(docs: DataFrame, size: int, hot: dict[int, int]) -> DataFrame:
    """low, doc_id, at of the runs whose minimiser has another run, or that may repeat themselves.

    at: start, windows, split and the last mark in one number, as rows are many.
    """
    keys = np.array(sorted(hot), np.int64)
    held = docs.sparkSession.sparkContext.broadcast((keys, np.array([hot[k] for k in keys.tolist()], np.int64)))

    def file(it):
        for b, buf, off in batches(it, "text"):
            row, start, count, low, again = runs(buf, off, size)
            doc, low = b.column(0).to_numpy()[row], low.view(np.int64)
            at = start << 27 | count << 8 | _dealt(low, doc, held.value) << 1 | again
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(doc), pa.array(at)], ["low", "doc_id", "at"])

    def meet(it):
        last = waits = None  # the last minimiser, and its row if that has met no other yet
        for b in it:
            n = b.num_rows
            if not n:
                continue
            low, keep = b.column(0).to_numpy(), b.column(2).to_numpy() & 255 > 0  # a hot one, or one that may repeat itself
            same = low[1:] == low[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and low[0] == last:
                keep[0] = True
                if waits is not None:
                    yield waits
            last, waits = low[-1], None if keep[-1] else b.slice(n - 1, 1)
            yield b.filter(pa.array(keep))

    schema = "low long, doc_id long, at long"
    split = F.col("at").bitwiseAND(F.lit(254))
    return docs.mapInArrow(file, schema).repartition(F.col("low"), split).sortWithinPartitions("low").mapInArrow(meet, schema)


def _packed(h: np.ndarray) -> bytes:
    """Words' hashes, 6 bytes each."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


WORDS = "low long, split int, doc_id long, start int, words binary"


def _words_of(open_runs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """low, split, doc_id, start, words of runs."""
    asked = open_runs.groupBy("doc_id").agg(F.collect_list(F.struct("low", "at")).alias("runs"))  # bounded by the document's own length

    def run(it):
        for b, buf, off in batches(it, "text"):
            w = Words(buf, off, EXACT)
            h = w.hashes()
            lists = b.column(2)
            low, packed = (lists.flatten().field(k).to_numpy() for k in range(2))
            start, count, split = (packed >> 27).astype(np.int32), packed >> 8 & (1 << 19) - 1, (packed >> 1 & 127).astype(np.int32)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            ok = np.flatnonzero(start + count + size - 1 <= w.n[row])  # else it is of another row with this id
            at = w.first[row[ok]] + start[ok]
            for k in range(0, len(ok), 4096):
                o = ok[k : k + 4096]
                words = [_packed(h[a : a + c + size - 1]) for a, c in zip(at[k : k + 4096].tolist(), count[o].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(low[o]), pa.array(split[o]), b.column(0).take(pa.array(row[o])), pa.array(start[o]), pa.array(words, pa.binary())], ["low", "split", "doc_id", "start", "words"])

    return docs.join(asked, "doc_id").select("doc_id", "text", "runs").mapInArrow(run, WORDS)


class Shard:
    """An index of different runs, each with the place (doc, start) of its first occurrence."""

    def __init__(self, words: list[bytes], doc: np.ndarray, start: np.ndarray, size: int):
        self.size, self.doc, self.start = size, doc, start
        self.fm = FMIndex([_unpacked(x) for x in words])

    def repeats(self, words: list[bytes], doc: np.ndarray, start: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, start, windows) of runs' windows that occur earlier in the index. Runs with the same words are read once.

        whole: the index holds just these runs, so that a match of a run that is here once must occur twice to matter.
        """
        fm, size = self.fm, self.size
        num = {x: k for k, x in enumerate(dict.fromkeys(words))}
        seqs = [fm.encode(_unpacked(x)) for x in num]
        run_of = np.array([num[x] for x in words], np.int64)
        many = np.array([len(s) - size + 1 for s in seqs])
        first = np.cumsum(many) - many
        text = np.concatenate([*seqs, NONE])
        at = np.repeat(np.cumsum([len(s) for s in seqs]) - [len(s) for s in seqs], many) + np.arange(many.sum()) - np.repeat(first, many)
        least = np.where(np.bincount(run_of, minlength=len(seqs)) > 1, 1, 2) if whole else np.ones(len(seqs), np.int64)
        length, lo, hi = fm.statistics(text, at + size - 1, size, np.repeat(least, many))
        live = np.flatnonzero(length == size)
        # the first occurrence of each matched window
        pair, back = np.unique(np.column_stack([lo[live], hi[live]]), axis=0, return_inverse=True)
        n = pair[:, 1] - pair[:, 0]
        rows = np.repeat(pair[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = fm.locate(rows)
        own = np.searchsorted(fm.first, place, side="right") - 1
        d, s = self.doc[own], self.start[own] + place - fm.first[own]
        order = np.lexsort((s, d, np.repeat(np.arange(len(n)), n)))
        head = order[np.cumsum(n) - n]
        known = np.full((2, len(at)), np.iinfo(np.int64).max)
        known[:, live] = d[head][back.ravel()], s[head][back.ravel()]
        # every run against what its words' windows gave
        n = many[run_of]
        w = np.repeat(first[run_of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        own_doc, own_start = np.repeat(doc, n), np.repeat(start, n) + w - np.repeat(first[run_of], n)
        later = (known[0][w] < own_doc) | ((known[0][w] == own_doc) & (known[1][w] < own_start))
        got_d, got_s = own_doc[later], own_start[later]
        new = np.ones(len(got_d), bool)
        new[1:] = (got_d[1:] != got_d[:-1]) | (np.diff(got_s) != 1)
        head = np.flatnonzero(new)
        return got_d[head], got_s[head], np.diff(np.append(head, len(got_d)))


def firsts(words: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different runs and where each occurs first."""
    order = np.lexsort((start, doc)).tolist()
    seen: dict[bytes, int] = {}
    for i in order:
        seen.setdefault(words[i], i)
    at = np.array(list(seen.values()), np.int64)
    return list(seen), doc[at], start[at]


def _search(words: DataFrame, size: int, chunk: int) -> DataFrame:
    """doc_id, start, count of repeats. words: WORDS and kind (0: for the index only, a hot minimiser's; 1: a run) and part."""

    def run(it):
        out = ["doc_id", "start", "count"]

        def batch(got):
            return pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1].astype(np.int32)), pa.array(got[2].astype(np.int32))], out)

        def own(held):
            w, d, s = held[0], np.array(held[1]), np.array(held[2])
            return batch(Shard(*firsts(w, d, s), size).repeats(w, d, s, True))

        last, held, total, index, shard = None, ([], [], []), 0, None, None
        for b in it:
            low, split, part, kind, doc, start = (b.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5))
            words = b.column(6).to_pylist()
            for i in range(b.num_rows):
                key = (low[i], split[i], part[i])
                if key != last and held[0] and (total >= chunk or split[i] or last[1]):
                    yield own(held) if shard is None else batch(shard.repeats(held[0], np.array(held[1]), np.array(held[2]), False))
                    held, total = ([], [], []), 0
                if key != last:
                    index, shard = ([], [], []) if split[i] else None, None
                last = key
                if kind[i] == 0:
                    for x, v in zip(index, (words[i], doc[i], start[i])):
                        x.append(v)
                    continue
                if split[i] and shard is None:
                    shard = Shard(index[0], np.array(index[1]), np.array(index[2]), size)
                for x, v in zip(held, (words[i], doc[i], start[i])):
                    x.append(v)
                total += len(words[i]) // 6
                if split[i] and total >= chunk:
                    yield batch(shard.repeats(held[0], np.array(held[1]), np.array(held[2]), False))
                    held, total = ([], [], []), 0
        if held[0]:
            yield own(held) if shard is None else batch(shard.repeats(held[0], np.array(held[1]), np.array(held[2]), False))

    lined = words.select("low", "split", "part", "kind", "doc_id", "start", "words").repartition("low", "split", "part").sortWithinPartitions("low", "split", "part", "kind")
    return lined.mapInArrow(run, "doc_id long, start int, count int")


def _split_hot(words: DataFrame, hot: dict[int, int], part: int) -> DataFrame:
    """Runs of hot minimisers with the index of their different runs, in parts, for each task they are dealt to."""
    spark = words.sparkSession
    different = words.groupBy("low", "words").agg(F.min(F.struct("doc_id", "start")).alias("p"))  # found with partial aggregation
    parts = table(different.groupBy("low").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "parts")
    deal = spark.createDataFrame(list(hot.items()), "low long, splits int")
    different = different.join(parts, "low").join(deal, "low").withColumn("part", F.pmod(F.xxhash64("words"), F.col("parts")).cast("int"))
    index = different.select("low", F.explode(F.sequence(F.lit(1), "splits")).alias("split"), "part", F.lit(0).alias("kind"), "p.doc_id", "p.start", "words")
    stream = words.join(parts, "low").select("low", "split", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "doc_id", "start", "words")
    return index.unionByName(stream)


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, chunk: int = CHUNK, hot: int = HOT, part: int = PART, keep_text: bool = False) -> DataFrame:
    """One row per input row: n_words, n_removed, kept_sha256, and kept_text if asked for."""
    ready(df.sparkSession)
    if (id_col, text_col, df.schema[id_col].dataType.simpleString()) == ("doc_id", "text", "bigint"):
        docs = df.select("doc_id", "text")  # without aliases both uses of the exchange below have one plan
    else:
        docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"))
    named = docs.where("doc_id is not null")
    busy = hot_minimisers(named, size, hot)
    placed = named.repartition("doc_id")  # both joins read one exchange: the filter is the same for both
    words = _words_of(_open(named, size, busy), placed, size)
    if busy:
        words = table(words, "words")
        found = _search(words.where("split = 0").select("*", F.lit(0).alias("part"), F.lit(1).alias("kind")).unionByName(_split_hot(words.where("split > 0"), busy, part)), size, chunk)
    else:
        found = _search(words.select("*", F.lit(0).alias("part"), F.lit(1).alias("kind")), size, chunk)
    cover = found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "count")).alias("cover"))  # bounded by the document's own length

    def run(it):
        for b, buf, off in batches(it, "text"):
            w = Words(buf, off, EXACT)
            lists, cover = b.column(2), None
            removed, sha, kept = np.zeros(b.num_rows, np.int64), [], []
            if len(lists.flatten()):
                start, count = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in range(2))
                row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
                cover = np.zeros(len(w.start) + 1, np.int32)
                np.add.at(cover, w.first[row] + np.minimum(start, w.n[row]), 1)
                np.add.at(cover, w.first[row] + np.minimum(start + count + size - 1, w.n[row]), -1)
                np.cumsum(cover, out=cover)
            for i in range(b.num_rows):
                a, n = int(w.first[i]), int(w.n[i])
                stay = np.arange(a, a + n) if cover is None else a + np.flatnonzero(cover[a : a + n] == 0)
                removed[i] = n - len(stay)
                digest, texts = hashlib.sha256(), []
                for k in range(0, len(stay), 1 << 16):
                    s = stay[k : k + (1 << 16)]
                    x = (b" " if k else b"") + b" ".join(map(buf_slice(buf), w.start[s].tolist(), w.end[s].tolist()))
                    digest.update(x)
                    if keep_text:
                        texts.append(x)
                sha.append(digest.hexdigest())
                if keep_text:
                    kept.append(b"".join(texts).decode())
            cols = [b.column(0), pa.array(w.n.astype(np.int64)), pa.array(removed), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * keep_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text)

    rest = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(cover.schema["cover"].dataType).alias("cover"))
    return placed.join(cover, "doc_id", "left").select("doc_id", "text", "cover").union(rest).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def buf_slice(buf: np.ndarray):
    m = memoryview(buf)
    return lambda a, e: m[a:e]


def op4_substring_dedup(spark, sf_dir):
    return dedup(read(spark, sf_dir, "documents"))
