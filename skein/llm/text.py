"""Word tables of whole Arrow text columns, built with numpy and no loop over words.

All byte classes used here put every byte from 0x80 up on one side, so working on UTF-8
bytes gives the same words as working on characters.
"""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa

_SPACE = re.compile(rb"[ \t-\r]")

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
LONG = 1 << 17  # elements hashed at once; the tables of powers are no longer, whatever the texts


def _table(x: np.uint64) -> np.ndarray:
    t = np.full(LONG + 1, x, np.uint64)
    t[0] = 1
    return np.cumprod(t)


_POW, _INV = _table(_P), _table(_PINV)


def hash_segments(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of x[i] * P^(i - start) over each segment, modulo 2^64; segments are in order and do not overlap."""
    out, lo, n = np.zeros(len(start), np.uint64), 0, len(start)
    while lo < n:
        a = int(start[lo])
        hi = int(np.searchsorted(end, a + LONG, side="right"))
        if hi > lo:
            e = int(end[hi - 1])
            c = np.zeros(e - a + 1, np.uint64)
            np.cumsum(x[a:e].astype(np.uint64) * _POW[: e - a], out=c[1:])
            s = start[lo:hi] - a
            out[lo:hi] = (c[end[lo:hi] - a] - c[s]) * _INV[s]
        else:  # one segment that is longer than the tables
            hi, total, scale = lo + 1, np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for b in range(a, int(end[lo]), LONG):
                y = x[b : min(b + LONG, int(end[lo]))].astype(np.uint64)
                total += scale * (y * _POW[: len(y)]).sum(dtype=np.uint64)
                scale *= _POW[LONG]
            out[lo] = total[0]
        lo = hi
    return out


def row_counts(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    n = np.zeros(len(off) - 1, np.int64)
    some = np.flatnonzero(np.diff(off) > 0)
    if len(some):
        n[some] = np.add.reduceat(flags.view(np.uint8) if flags.dtype == bool else flags, off[:-1][some], dtype=np.int64)
    return n


def lut(chars: str | None = None, lower: bool = True) -> np.ndarray:
    """byte -> (lower-cased) byte inside a word, 0 outside. chars: 'alnum' or 'nonspace' (there byte + 1, as a zero byte is no space; UTF-8 has no byte 255)."""
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[65:91] += 32
    if chars != "alnum":
        t[:255] += 1
    if chars == "alnum":
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
    else:
        keep = np.ones(256, bool)
        keep[9:14] = keep[32] = False
    t[~keep] = 0
    return t


ALNUM, NONSPACE, EXACT = lut("alnum"), lut("nonspace"), lut("nonspace", lower=False)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = 2 << 20):
    """Row ranges of about limit bytes; a longer row is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of rows: start, end (bytes in buf), first (row -> its first word's number), n (words per row)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray):
        self.buf, self.off = buf, off
        self.low = low = table[buf] if len(buf) else buf
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = low != 0
        d = np.diff(inside)
        start, end = np.flatnonzero(d > 0), np.flatnonzero(d < 0)
        cut = np.unique(off[(off > 0) & (off < len(buf))])
        cut = cut[(inside[cut + 1] != 0) & (inside[cut] != 0)]
        if len(cut):
            start = np.sort(np.concatenate([start, cut]))
            end = np.sort(np.concatenate([end, cut]))
        self.start, self.end = start, end
        at = np.searchsorted(start, off)
        self.first, self.n = at[:-1], np.diff(at)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes after the table's mapping."""
        return mix(hash_segments(self.low, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def hash_words(words: list[str], table: np.ndarray) -> np.ndarray:
    """The hash Words.hashes() gives each of these words (each one word under the table)."""
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b" ".join(raw), np.uint8)
    w = Words(buf, np.array([0, len(buf)]), table)
    if len(w.start) != len(words):
        raise ValueError("not single words")
    return w.hashes()


class Vocabulary:
    """hash -> number (0..), -1 for others; one gather and one comparison per word."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.asarray(hashes, np.uint64)
        if len(np.unique(self.hashes)) != len(self.hashes):
            raise ValueError("repeated hashes")
        bits = max(8, int(np.ceil(np.log2(len(self.hashes) + 1))) + 5)
        for _ in range(24):  # a table without collisions where one is near, else the sorted way
            slot = (self.hashes >> np.uint64(64 - bits)).astype(np.int64)
            if len(np.unique(slot)) == len(slot) or bits >= 22:
                break
            bits += 1
        self.bits = bits
        self.table = None
        if len(np.unique(slot)) == len(slot):
            self.table = np.full(1 << bits, -1, np.int32)
            self.table[slot] = np.arange(len(slot))
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.padded = np.concatenate([self.hashes, np.zeros(1, np.uint64)])

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32)
        if self.table is not None:
            k = self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
            k[self.padded[k] != h] = -1
            return k
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1).astype(np.int32)


_kept: dict = {}
_stage = [None]


def forget() -> None:
    """Drop what kept() holds, and give freed memory back, if this worker now runs another stage."""
    from pyspark import TaskContext

    now = TaskContext.get()
    now = now.stageId() if now else None
    if now != _stage[0]:
        _kept.clear()
        _stage[0] = now
        trim()


def trim() -> None:
    """Return free heap pages to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def kept(key, build):
    """What build() makes, once for all tasks of a stage that run in this worker."""
    forget()
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def parts(text: bytes, size: int = 1 << 20):
    """A text in pieces of about size bytes, cut at white space."""
    a, n = 0, len(text)
    while a < n:
        m = _SPACE.search(text, a + size) if a + size < n else None
        e = m.start() if m else n
        yield text if (a, e) == (0, n) else text[a:e]
        a = e


def batches(it, text: str, limit: int = 1 << 20):
    """(record batch, buf, off) of bounded pieces of each incoming Arrow batch; a longer row is a piece of its own."""
    forget()
    for b in it:
        if not b.num_rows:
            continue
        buf, off = buffers(b.column(b.schema.get_field_index(text)))
        for lo, hi in slices(off, limit):
            o = off[lo : hi + 1]
            yield b.slice(lo, hi - lo), buf[o[0] : o[-1]], o - o[0]
    b = buf = off = o = None
    trim()  # a worker that waits for its next task holds no more than it needs
