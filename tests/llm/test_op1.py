import re

import pytest

from skein.llm.licenses import BASE, Scanner, SuffixAutomaton, scan_licenses

TEXTS = [
    "", None, "Released under the MIT License.", "the mit license THE MIT  LICENSE", "MIT", "the-mit/license x Apache License, Version 2.0 and CC BY-NC 4.0",
    "Licensed under the GNU Affero words General Public License, version 3", "été the mit licenseé", "x " * 5000 + "cc by nc", "the mit", "license",
    "This work is licensed under the GNU General Public License, version 3.", "Die freie Software", "cc by cc by nc nc",
]


def brute(t):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    at, labs = [], set()
    for p, lab in BASE.items():
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labs.add(lab)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labs))


def test_base_equals_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None), (None, "the mit license", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = scan_licenses(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by[11].labels == "gpl-3" and by[11].spans[0].coverage == 1.0
    assert "agpl-3" in by[6].labels
    assert by[12].labels == ""
    assert by[None].n_base == 1


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_against_brute_force():
    import random

    rng = random.Random(1)
    for _ in range(30):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        q = [rng.randrange(4) for _ in range(30)]
        sam = SuffixAutomaton(seqs)
        want, prev = [], 0
        lens = [max((n for n in range(e + 1) if tuple(q[e - n : e]) in subs), default=0) for e in range(1, len(q) + 1)]
        for e in range(1, len(q) + 1):
            if lens[e - 1] and (e == len(q) or lens[e] != lens[e - 1] + 1):
                want.append((e - lens[e - 1], lens[e - 1]))
        got = sam.matches(q, 1)
        assert [(a, n) for a, n, _ in got] == want
        for a, n, s in got:
            occ = {(k, i + n) for k, x in enumerate(seqs) for i in range(len(x) - n + 1) if x[i : i + n] == q[a : a + n]}
            assert set(sam.ends[s]) == occ


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_batch_size_changes_nothing(size):
    import numpy as np
    import pyarrow as pa

    from skein.llm.text import buffers, slices

    buf, off = buffers(pa.array(TEXTS, pa.string()))
    got = []
    for lo, hi in slices(off, size):
        o = off[lo : hi + 1]
        r = Scanner().rows(buf[o[0] : o[-1]], o - o[0])
        got += list(zip(r[0].tolist(), r[1].tolist()))
    assert got == [brute(t)[:2] for t in TEXTS] and np.sum([g[1] for g in got])


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction"""
CASES = [
    ("Licensed under the GNU General Public License, version 2.", "gpl-2"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl-3"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.', "mit"),
    (MIT, "mit"),
    ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "agpl-3"),
    ("the of and to use this software for any work", ""),
]


def test_wordings_are_told_apart(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan_licenses(df).collect()}
    assert got == {k: w for k, (_, w) in enumerate(CASES)}


def test_whole_texts_and_two_grants(spark):
    import pkgutil

    from skein.llm.licenses import WHOLE

    rows = [(name, "Copyright x\n" + pkgutil.get_data("skein.llm", f"wordings/{name}.txt").decode()) for name in WHOLE]
    rows.append(("two", MIT + " filler" * 50 + "\n" + MIT + " more words here " * 9 + "Licensed under CC BY-SA 4.0"))
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for name, (label, _) in WHOLE.items():
        assert label in got[name].labels.split(","), (name, got[name].labels)
    assert "gpl-3" not in got["gpl-2"].labels and "gpl-2" not in got["gpl-3"].labels
    spans = [s for s in got["two"].spans if s.label == "mit"]
    assert {s.start for s in spans} >= {0, len(MIT.split()) + 50} and got["two"].labels == "cc-by-sa,mit"


def test_wording_of_common_words_only(spark):
    df = spark.createDataFrame([(1, "use of this work or any copy"), (2, "no use")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in scan_licenses(df, templates={"x": ["use of this work or any copy"], "y": ["use of the work " * 40]}).collect()}
    assert got == {1: "x", 2: ""}


def brute_chains(words, wording, least, gap):
    """Coverage of the best chain by trying every chain of every common run."""
    hits = set()
    for i in range(len(words)):
        for t in range(len(wording)):
            n = 0
            while i + n < len(words) and t + n < len(wording) and words[i + n] == wording[t + n]:
                n += 1
            # a maximal match that ends at i + n: no longer one of the wording ends there
            if n >= least:
                hits.add((i, t, n))
    longest = {}
    for i, t, n in hits:
        longest[i + n] = max(longest.get(i + n, 0), n)
    hits = sorted(h for h in hits if longest[h[0] + h[2]] == h[2] and not any(words[h[0] : h[0] + h[2] + 1] == wording[k : k + h[2] + 1] for k in range(len(wording)) if h[0] + h[2] < len(words)))
    best = {}
    for i, (q, t, n) in enumerate(hits):
        best[i] = n
        for j in range(i):
            a, b, m = hits[j]
            over = max(0, a + m - q, b + m - t)
            if a < q and b < t and over < n and q - a - m <= gap:
                best[i] = max(best[i], best[j] + n - over)
    return min(1.0, max(best.values(), default=0) / len(wording))


def test_best_chain_equals_brute_force():
    import random

    import numpy as np

    rng = random.Random(7)
    for _ in range(60):
        wording = [rng.choice("abcdefgh") for _ in range(rng.randrange(4, 14))]
        words = [rng.choice("abcdefghz") for _ in range(rng.randrange(0, 25))]
        at = rng.randrange(len(words) + 1)
        own = [w for w in wording if rng.random() < 0.85]
        words[at:at] = own
        s = Scanner(templates={"x": [" ".join(wording)]}, base={}, least=2, gap=4)
        text = np.frombuffer(" ".join(words).encode(), np.uint8)
        got = s.rows(text, np.array([0, len(text)]))
        want = brute_chains(words, wording, 2, 4)
        assert bool(got[5][0]) == (want >= 0.75), (words, wording)
        if want >= 0.75:
            assert max(x[3] for x in got[5][0]) == pytest.approx(want)
