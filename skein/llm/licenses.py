"""License scan: matching statistics on a generalised suffix automaton of licence wordings.

Words are runs of ASCII letters and digits and of all characters from U+0080 up, with A-Z
lower-cased. Wordings (whole licence texts, their notices and telling paragraphs) go into one
suffix automaton over word numbers. A text's words stream through it. The state reached and
its suffix links give the longest match with every single wording; wherever one stops growing,
and is at least `least` words long, it is a hit. Hits that keep the wording's order and are no more than `gap` words apart are chained into a span; every
chain that covers `cover` of its wording, and has its decisive words (a version, say) as they stand there,
labels the document. A place belongs to one chain of a wording; a text may hold many.

Only texts with a word that such a chain can't do without are streamed: of each wording the
rarest words that make up more than it may lack.

Defined results: null text counts as empty (0 words, no label, score 0); ties between
chains go to the longer, then the earlier; repeated rows are scanned each for itself; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import pkgutil
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.text import ALNUM, Vocabulary, Words, batches, buffers, hash_words, kept
from skein.runtime import ready

BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_GNU = "under the terms of the gnu {} as published by the free software foundation either {} of the license or at your option any later version"
# label -> wordings; with each, the words of it that must stand together as they do there
NOTICES = {
    "mit": [
        "released under the mit license", "licensed under the mit license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2": [
        ("licensed under the apache license version 2 0", "apache license", "version 2"),
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "cc-by-nc": [("licensed under cc by nc 4 0", "by nc"), ("creative commons attribution noncommercial 4 0 international license", "noncommercial")],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": [("licensed under cc by sa 4 0", "by sa"), ("creative commons attribution sharealike 4 0 international license", "sharealike")],
    "gpl-3": [("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"), ("licensed under the gnu general public license version 3", "gnu general public license version 3"), (_GNU.format("general public license", "version 3"), "gnu general", "version 3"), ("gplv3 or later", "gplv3")],
    "gpl-2": [("licensed under the gnu general public license version 2", "gnu general public license version 2"), (_GNU.format("general public license", "version 2"), "gnu general", "version 2"), ("under the terms of the gnu general public license version 2 as published by the free software foundation", "gnu general", "version 2"), ("gplv2 or later", "gplv2")],
    "lgpl": [("licensed under the gnu lesser general public license", "lesser"), (_GNU.format("lesser general public license", "version 2 1"), "lesser"), (_GNU.format("lesser general public license", "version 3"), "lesser"), (_GNU.format("library general public license", "version 2"), "library")],
    "agpl-3": [("licensed under the gnu affero general public license version 3", "affero"), (_GNU.format("affero general public license", "version 3"), "affero")],
    "bsd": [
        "released under the bsd license", "licensed under the bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "mpl-2": [("subject to the terms of the mozilla public license v 2 0", "2 0"), ("licensed under the mozilla public license version 2 0", "2 0"), "if a copy of the mpl was not distributed with this file you can obtain one at"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
}
WHOLE = {"apache-2.0": ("apache-2", ""), "gpl-2": ("gpl-2", "version 2 june 1991"), "gpl-3": ("gpl-3", "gnu general public license version 3 29 june 2007"), "lgpl-2.1": ("lgpl", "version 2 1 february 1999"), "lgpl-3": ("lgpl", "lesser general public license"), "mpl-2.0": ("mpl-2", ""), "cc0-1.0": ("cc0", ""), "bsd": ("bsd", "")}


@cache
def wordings() -> dict[str, list]:
    """NOTICES and the whole texts in the folder wordings."""
    out = {k: list(v) for k, v in NOTICES.items()}
    for name, (label, must) in WHOLE.items():
        out[label].append((pkgutil.get_data("skein.llm", f"wordings/{name}.txt").decode(), must))
    return out


def split(text: str) -> list[str]:
    """A text's words as the scan sees them."""
    buf, off = buffers(pa.array([text], pa.large_string()))
    w = Words(buf, off, ALNUM)
    low = w.low.tobytes()
    return [low[a:e].decode() for a, e in zip(w.start.tolist(), w.end.tolist())]


class SuffixAutomaton:
    """Generalised suffix automaton of integer sequences; ends[s]: (sequence, end) of all occurrences of state s."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.len = [{}], [-1], [0]
        own: dict[int, list] = {}
        for k, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                own.setdefault(last, []).append((k, i + 1))
        self.ends = [list(own.get(s, ())) for s in range(len(self.len))]
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            self.ends[self.link[s]] += self.ends[s]
        self.ends[0] = []

    def _extend(self, last: int, c: int) -> int:
        nxt, link, ln = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if ln[q] == ln[last] + 1 else self._clone(last, q, c)
        cur = len(ln)
        nxt.append({})
        link.append(0)
        ln.append(ln[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if ln[q] == ln[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, ln = self.next, self.link, self.len
        new = len(ln)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        ln.append(ln[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def matches(self, seq, least: int):
        """Maximal matches: (start, length, state), each not extensible to the right."""
        s = n = 0
        out, nxt, link, ln = [], self.next, self.link, self.len
        for i, c in enumerate(seq):
            t = nxt[s].get(c)
            if t is None:
                if n >= least:
                    out.append((i - n, n, s))
                while s and c not in nxt[s]:
                    s = link[s]
                    n = ln[s]
                t = nxt[s].get(c)
                if t is None:
                    s = n = 0
                    continue
            s, n = t, n + 1
        if n >= least:
            out.append((len(seq) - n, n, s))
        return out


class Scanner:
    """Holds the wordings; rows() gives labels and chained spans."""

    def __init__(self, templates=None, base=None, least: int = 3, gap: int = 12, cover: float = 0.75):
        self.base = BASE if base is None else base
        self.least, self.gap, self.cover = least, gap, cover
        pairs = [(lab, (t,) if isinstance(t, str) else t) for lab, ts in (wordings() if templates is None else templates).items() for t in ts]
        seqs = [(lab, split(t[0]), [split(m) for m in t[1:] if m]) for lab, t in pairs]
        seqs = [x for x in seqs if x[1]]
        words = sorted({w for _, t, _ in seqs for w in t} | {w for p in self.base for w in p.split()})
        num = {w: k for k, w in enumerate(words)}
        self.words, self.labels = words, [lab for lab, _, _ in seqs]
        self.vocab = Vocabulary(hash_words(words, ALNUM))
        self.seqs = [[num[w] for w in t] for _, t, _ in seqs]
        self.must = [[next((i, i + len(m)) for i in range(len(t)) if t[i : i + len(m)] == m) for m in ms] for _, t, ms in seqs]
        self.sam, self.known = SuffixAutomaton(self.seqs), {}
        self.phrases = [([num[w] for w in p.split()], lab) for p, lab in self.base.items()]
        self.common = Counter(w for t in self.seqs for w in t)
        gate = np.zeros(len(words) + 1, bool)
        for t in self.seqs:  # no chain that covers enough can do without all of these
            lack = len(t) - int(np.ceil(cover * len(t) - 1e-9))
            gate[sorted(t, key=lambda w: (self.common[w], w))[: lack + 1]] = True
        self.gate = gate

    def _at(self, s: int) -> tuple[dict, dict]:
        """wording -> places where the state's words end in it; the same, with the match's length, for wordings that only hold a shorter suffix."""
        got = self.known.get(s)
        if got is None:
            own: dict[int, list] = {}
            for k, e in self.sam.ends[s]:
                own.setdefault(k, []).append(e)
            up = self.sam.link[s]
            less = {}
            if s and self.sam.len[up] >= self.least:
                above, rest = self._at(up)
                less = {k: (self.sam.len[up], e) for k, e in above.items() if k not in own} | {k: v for k, v in rest.items() if k not in own}
            got = self.known[s] = (own, less)
        return got

    def hits(self, seq) -> list[tuple[int, int, int, list]]:
        """Maximal matches with each wording: (start, length, wording, places in it where it ends)."""
        sam, s, n, out, before = self.sam, 0, 0, [], {}
        for i, c in enumerate([*seq, -1]):
            while s and c not in sam.next[s]:
                s = sam.link[s]
                n = sam.len[s]
            t = sam.next[s].get(c)
            s, n = (0, 0) if t is None else (t, n + 1)
            now: dict = {}
            if n >= self.least:
                own, less = self._at(s)
                now = less | {k: (n, e) for k, e in own.items()}
            for k, (m, e) in before.items():
                if k not in now or now[k][0] != m + 1:
                    out.append((i - m, m, k, e))
            before = now
        return out

    def chains(self, hits) -> list[tuple[float, int, int, int]]:
        """All chains from hits(): (coverage, wording, start, end). Those that lack a decisive word count as far as they cover, without being one."""
        by: dict[int, set] = {}
        for q, n, k, ends in hits:
            by.setdefault(k, set()).update((q, e - n, n) for e in ends)
        out = []
        for k, hs in by.items():
            hs, reach, first = sorted(hs), 0, 0
            parts = []
            for i, (q, _, n) in enumerate(hs):
                if i and q - reach > self.gap:
                    parts.append(hs[first:i])
                    first = i
                reach = max(reach, q + n)
            parts.append(hs[first:])
            while parts:
                own = parts.pop()
                got, covered, a, e = self._best(own)
                share = min(1.0, got / len(self.seqs[k]))
                whole = share >= self.cover and all(any(t <= lo and hi <= t + n for t, n in covered) for lo, hi in self.must[k])
                out.append((share if whole else min(share, self.cover * 0.999), k, a, e))
                if share >= self.cover:  # what is left on either side may hold another
                    parts += [x for x in ([h for h in own if h[0] + h[2] <= a], [h for h in own if h[0] >= e]) if x]
        return out

    def _best(self, hs: list) -> tuple[int, list, int, int]:
        """The best chain of hits (start, place in the wording, length) in order: words covered, (place, length) of its hits, start, end."""
        longest, best, back = max(n for _, _, n in hs), [], []
        for i, (q, t, n) in enumerate(hs):
            top, prev = (n, q), -1
            for j in range(i - 1, -1, -1):
                qj, tj, nj = hs[j]
                if q - qj > self.gap + longest:
                    break
                over = max(0, qj + nj - q, tj + nj - t)  # a hit that overlaps the one before counts its rest
                if qj < q and tj < t and over < n and q - (qj + nj) <= self.gap:
                    new = (best[j][0] + n - over, best[j][1])
                    if (new[0], -new[1]) > (top[0], -top[1]):
                        top, prev = new, j
            best.append(top)
            back.append(prev)
        i = max(range(len(best)), key=lambda i: (best[i][0], -best[i][1]))
        got, a, e, covered = best[i][0], best[i][1], hs[i][0] + hs[i][2], []
        while i >= 0:
            covered.append(hs[i][1:])
            i = back[i]
        return got, covered, a, e

    def rows(self, buf, off):
        """Per row: n_words, n_base, first, last, base labels, labels, score, spans."""
        w = Words(buf, off, ALNUM)
        ids = self.vocab.ids(w.hashes())
        R = len(w.n)
        n_base, first, last = np.zeros(R, np.int64), np.full(R, -1, np.int64), np.full(R, -1, np.int64)
        base = [set() for _ in range(R)]
        row_of = lambda at: np.searchsorted(w.first, at, side="right") - 1
        for phrase, lab in self.phrases:
            m = len(phrase)
            k = min(range(m), key=lambda i: self.common[phrase[i]])
            at = np.flatnonzero(ids == phrase[k]) - k
            at = at[(at >= 0) & (at + m <= len(ids))]
            for i in range(m):
                at = at[ids[at + i] == phrase[i]]
            # rows without words share their first word's number with the next row: take the last of them
            r = row_of(at)
            ok = at + m <= w.first[r] + w.n[r]
            for a, x in zip((at - w.first[r])[ok].tolist(), r[ok].tolist()):
                n_base[x] += 1
                base[x].add(lab)
                first[x] = a if first[x] < 0 else min(first[x], a)
                last[x] = max(last[x], a)
        score, spans = np.zeros(R), [[] for _ in range(R)]
        hot = np.unique(row_of(np.flatnonzero(self.gate[ids])))
        for x in hot.tolist():
            own = ids[w.first[x] : w.first[x] + w.n[x]]
            known = np.flatnonzero(np.diff(np.concatenate([[0], own >= 0, [0]]).astype(np.int8)))
            hits = []
            for a, e in zip(known[::2].tolist(), known[1::2].tolist()):
                if e - a >= self.least:
                    hits += [(a + q, n, k, x) for q, n, k, x in self.hits(own[a:e].tolist())]
            for c, k, a, e in self.chains(hits):
                score[x] = max(score[x], c)
                if c >= self.cover:
                    spans[x].append((self.labels[k], a, e, c))
        score[n_base > 0] = 1.0
        return w.n, n_base, first, last, base, spans, score


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates=None, base=None, least: int = 3, gap: int = 12, cover: float = 0.75) -> DataFrame:
    """One row per input row: counts of base places, labels and the chained spans (label, first word, end word, coverage)."""
    ready(df.sparkSession)
    templates = wordings() if templates is None else templates
    key = hash(str((templates, base, least, gap, cover)))

    def run(it):
        s = kept(("licences", key), lambda: Scanner(templates, base, least, gap, cover))
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
        for b, buf, off in batches(it, "text"):
            n, nb, first, last, labs, spans, score = s.rows(buf, off)
            none = nb == 0
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(n.astype(np.int64)), pa.array(nb),
                    pa.array(first, mask=none), pa.array(last, mask=none),
                    pa.array([",".join(sorted(x)) for x in labs], pa.string()),
                    pa.array([",".join(sorted(x | {t[0] for t in y})) for x, y in zip(labs, spans)], pa.string()),
                    pa.array(score),
                    pa.array([[dict(zip(("label", "start", "end", "coverage"), t)) for t in y] for y in spans], pa.list_(span)),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,`end`:bigint,coverage:double>>")


def op1_license_scan(spark, sf_dir):
    from skein.runtime import read

    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")
