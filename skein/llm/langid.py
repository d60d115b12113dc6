"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text answers how far a text can be read on
as a substring of it. Reading a whole text phrase by phrase, each the longest such match,
gives a number of phrases; times log2 of the labelled text's length and by the length read,
this estimates the cross-entropy to the language. The least one wins.

Letters are read in lower case; each run of other ASCII characters counts as one separator.
Texts are parsed whole. To read long ones side by side they are first parsed in stretches of
STRETCH symbols, each as if a phrase began there; then the parse that really enters a stretch
is followed until it meets the one that was guessed, from where both are the same. This is
repeated where a stretch's end changed, so the result is that of one parse from the first
symbol to the last. The automata become one table of jumps (state, symbol) -> state,
negative where a phrase ends there.

The fit uses a bounded sample: for each language the first DOCS different texts by hash, of
these in that order every text that still fits into SYMBOLS bytes, whole; only if the first
text alone does not fit, its first SYMBOLS bytes.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the
alphabetically first language; null id is scored (held_out false); repeated rows are scored
each for itself; without labelled rows all is `und`; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.labelled import crc_mod
from skein.llm.licenses import SuffixAutomaton
from skein.llm.text import batches, kept, row_counts
from skein.runtime import read, ready

DOCS, SYMBOLS, STRETCH = 96, 32_768, 256

_MAP = np.zeros(256, np.uint8)  # separators 0, letters 97..122, other bytes themselves
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case with runs of separators as one, and the rows' new offsets."""
    s = _MAP[buf]
    if len(s) > 1:  # the capitals among U+00C0..U+00DE
        up = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        s[up] += 0x20
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    keep[off[:-1][off[:-1] < len(s)]] = True
    return s[keep], np.concatenate([[0], np.cumsum(row_counts(keep, off))])


class Parser:
    """Counts phrases of rows against each language's labelled text."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seqs = []
        for k in self.langs:
            buf = np.frombuffer(samples[k], np.uint8)
            seqs.append(symbols(buf, np.array([0, len(buf)]))[0])
        seen = np.unique(np.concatenate([*seqs, np.zeros(1, np.uint8)]))
        self.code = np.full(256, len(seen), np.int32)  # all bytes never seen are one symbol
        self.code[seen] = np.arange(len(seen))
        self.pad, self.width = len(seen) + 1, len(seen) + 2
        self.cost = [float(np.log2(max(len(s), 2))) for s in seqs]
        self.tables = [self._table(SuffixAutomaton([self.code[s].tolist()])) for s in seqs]

    def _table(self, sam: SuffixAutomaton) -> np.ndarray:
        w = self.width
        root = np.zeros(w, np.int64)
        for c, t in sam.next[0].items():
            root[c] = t * w
        out = np.tile(~root, (len(sam.len), 1))  # no way on: the phrase ends, this symbol begins the next
        for s, nxt in enumerate(sam.next):
            for c, t in nxt.items():
                out[s, c] = t * w
        out[:, self.pad] = np.arange(len(sam.len)) * w
        return out.ravel().astype(np.int32)

    def phrases(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """rows x languages: phrases that end inside the row."""
        s, off = symbols(buf, off)
        size = np.diff(off)
        many = -(-size // STRETCH)
        row = np.repeat(np.arange(len(size)), many)
        first = np.concatenate([[0], np.cumsum(many)])[:-1]
        start = off[:-1][row] + (np.arange(len(row)) - first[row]) * STRETCH
        length = np.minimum(off[1:][row] - start, STRETCH)
        lanes = np.argsort(-length, kind="stable")  # full stretches first, so that a step touches live ones only
        out = np.zeros((len(size), len(self.langs)))
        if not len(row):
            return out
        c = self.code[s]
        place = np.empty(len(row), np.int64)
        place[lanes] = np.arange(len(row))
        follows = place[1:][row[1:] == row[:-1]]  # lanes that go on from the one before, and that one
        before = place[:-1][row[1:] == row[:-1]]
        start, length, row = start[lanes], length[lanes], row[lanes]
        live = np.searchsorted(-length, -np.arange(STRETCH), side="left")  # lanes longer than t
        steps = int(length[0])
        states, ends = np.zeros((steps, len(row)), np.int32), np.zeros((steps, len(row)), bool)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(row), np.int32)
            ends[:] = False
            for t in range(steps):
                n = live[t]
                v = table[state[:n] + c[start[:n] + t]]
                end = v >> 31
                ends[t, :n] = end
                state[:n] = v ^ end
                states[t, :n] = state[:n]
            # follow what really enters each stretch until it is in the state that was guessed
            entry, now, prev = np.zeros(len(row), np.int32), follows, before
            while len(now):
                new = state[prev] != entry[now]
                now, prev = now[new], prev[new]
                entry[now] = state[prev]
                lane, at = now, entry[now]
                for t in range(steps):
                    if t:
                        go = length[lane] > t
                        lane, at = lane[go], at[go]
                    if not len(lane):
                        break
                    v = table[at + c[start[lane] + t]]
                    end = v >> 31
                    at = v ^ end
                    ends[t, lane] = end
                    apart = states[t, lane] != at
                    states[t, lane] = at
                    # met: from here on the guess was right
                    lane, at = lane[apart], at[apart]
                changed = lane_ends(states, length, now) != state[now]
                state[now] = lane_ends(states, length, now)
                moved = np.zeros(len(row), bool)
                moved[now[changed]] = True
                now, prev = follows[moved[before]], before[moved[before]]
            out[:, k] = np.bincount(row, ends.sum(0), len(size))
        return out

    def predict(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = np.diff(off)
        some = row_counts(_MAP[buf] != 0, off) > 0
        for i in np.flatnonzero(some & (row_counts((_MAP[buf] != 0) & (buf < 128), off) == 0)):
            some[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode()))
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n))
        h = (self.phrases(buf, off) + 1) * np.array(self.cost)
        best = h.argmin(1)
        two = np.sort(h, 1)
        score = np.where(some, 1 - two[:, 0] / two[:, 1], 0.0) if len(self.langs) > 1 else some.astype(float)
        return [self.langs[b] if x else "und" for b, x in zip(best, some)], score


def lane_ends(states: np.ndarray, length: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """The states at the ends of lanes."""
    return states[length[lanes] - 1, lanes]


def fit_languages(docs: DataFrame, keep: Column, *, docs_each: int = DOCS, symbols_each: int = SYMBOLS) -> dict[str, bytes]:
    """Bounded labelled text for each language of the rows that `keep` admits."""
    own = docs.where(keep & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    order = Window.partitionBy("lang").orderBy("h")
    first = own.select("lang", "h").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_each)  # no text moves
    some = own.join(F.broadcast(first), ["lang", "h"]).groupBy("lang", "h", "k").agg(F.min("text").alias("text"))  # docs_each rows a language
    out: dict[str, bytes] = {}
    for r in some.orderBy("lang", "k").toLocalIterator():  # at most docs_each rows a language
        held, own_text = out.setdefault(r.lang, b""), r.text.encode()
        if len(held) + len(own_text) < symbols_each:
            out[r.lang] = held + own_text + b"\n"
        elif not held and r.k == 1:
            out[r.lang] = own_text[:symbols_each]
    return {k: v for k, v in out.items() if v}


def identify(docs: DataFrame, samples: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    ready(docs.sparkSession)
    key = hash(tuple(sorted(samples.items())))

    def run(it):
        p = kept(("languages", key), lambda: Parser(samples))
        for b, buf, off in batches(it, "text", 2 << 20):
            lang, score = p.predict(buf, off)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op5_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    samples = fit_languages(docs, F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(False)))
    return identify(docs, samples).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
