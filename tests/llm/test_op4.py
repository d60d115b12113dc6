import hashlib
import random
import re

import numpy as np
import pytest

from skein.llm.fmindex import FMIndex
from skein.llm import substrings
from skein.llm.substrings import dedup, hot_minimisers, runs


def brute(rows, size):
    words = {}
    for d, t in rows:
        if d is not None:
            words[d] = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, out = {}, {}
    for d in sorted(words):
        w, gone = words[d], set()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if k in first:
                gone |= set(range(i, i + size))
            else:
                first[k] = d
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def made(rng, n):
    vocab = ["a", "b", "the", "Of", "é", "x\x00y", " "] + [f"w{i}" for i in range(60)]
    word = lambda: rng.choice(vocab)
    passages = [[word() for _ in range(rng.randrange(15, 90))] for _ in range(12)]
    texts = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(0, 5)):
            kind = rng.random()
            if kind < 0.5:
                w += [word() for _ in range(rng.randrange(0, 60))]
            elif kind < 0.9:
                p = rng.choice(passages)
                a = rng.randrange(0, 10)
                w += p[a : len(p) - rng.randrange(0, 5)]
            else:
                w += [rng.choice("ab")] * rng.randrange(0, 70) + ["a", "b"] * rng.randrange(0, 30)
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return texts + texts[:3] + ["", None, " \x0b", "a " * 400, "a b " * 100, "a " * 3000]


@pytest.mark.parametrize(("hot", "chunk", "part"), [(10**9, 300, 10), (10**9, 10**6, 10), (2, 200, 4), (16, 10**6, 10**6)])
def test_equals_brute_force(spark, hot, chunk, part):
    rng = random.Random(hot % 97)
    texts = made(rng, 90)
    ids = rng.sample(range(-50, 1000), len(texts))
    rows = [*zip(ids, texts)]
    df = spark.createDataFrame([(d, t, 1) for d, t in [*rows, (None, texts[0]), rows[5]]], "doc_id long, text string, start int").repartition(4)
    got = dedup(df, hot=hot, chunk=chunk, part=part, keep_text=True).collect()
    assert bool(hot_minimisers(df.select('doc_id', 'text'), 20, hot)) == (hot < 100)
    want = brute(rows, 20)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], (r, dict(rows)[r.doc_id])
    assert sum(r.n_removed > 0 for r in got) > 10
    assert dedup(df.where("false")).count() == 0


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        seqs = [rng.integers(1, 5, rng.integers(0, 30)).astype(np.uint64) for _ in range(6)]
        fm = FMIndex(seqs)
        text = [0] * (sum(len(s) + 1 for s in seqs) + 1)
        for a, s in zip(fm.first.tolist(), seqs):
            text[a : a + len(s)] = s.tolist()
        subs = {tuple(s[i : i + n]) for s in seqs for n in range(1, 9) for i in range(len(s) - n + 1)}
        q = rng.integers(1, 6, 60).astype(np.uint64)
        want = [max((n for n in range(1, min(8, e + 1) + 1) if tuple(q[e + 1 - n : e + 1]) in subs), default=0) for e in range(len(q))]
        assert fm.matching_statistics(q, 8).tolist() == want
        cover = np.zeros(len(q), bool)
        for a, e in fm.spans(q, 3):
            cover[a:e] = True
        brute_cover = np.zeros(len(q), bool)
        for e, n in enumerate(want):
            if n >= 3:
                brute_cover[e - 2 : e + 1] = True
        assert (cover == brute_cover).all()
        n, lo, hi = fm.statistics(fm.encode(q), np.arange(len(q)), 3, 2)
        for e in np.flatnonzero(n == 3).tolist():
            here = [i for i in range(len(text) - 2) if text[i : i + 3] == q[e - 2 : e + 1].tolist()]
            assert sorted(fm.locate(np.arange(lo[e], hi[e])).tolist()) == here and len(here) >= 2
        assert not hasattr(fm, "text") and not hasattr(fm, "sa")  # the index stands for the text


def test_long_texts_are_cut_in_steps_only(monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choice("abcdefgh") for _ in range(3000)).encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    flat = lambda r: [(s + i, low) for _, s, n, low, _ in zip(*(x.tolist() for x in r)) for i in range(n)]
    want = flat(runs(buf, off))
    monkeypatch.setattr(substrings, "STEP", 137)
    assert flat(runs(buf, off)) == want and [p for p, _ in want] == list(range(2981))
