"""Personal data: fixed forms, and identifiers found by bootstrapped contextual patterns.

Base: email, ip, card (Luhn) and phone spans, leftmost and not overlapping within a kind.

Bootstrap: identifier-like tokens (with a digit, at least 6 of [A-Za-z0-9._+-]) and base
spans are instances; what stands around one is a set of lexical patterns: the two tokens on
its left, the token on either side, and the left token with the instance's shape. Base spans
and tokens of 16 or more hexadecimal digits are seeds. Over the graph of patterns and
instances, Spark iterates: a pattern is as good as the mean confidence of the different
instances it holds (smoothed), an instance as certain as the chance that not all of its
patterns err. Patterns that score at least `threshold` and hold at least `least` different
instances are kept, at every size of the corpus. Up to SEND of them go to all tasks as a list;
more stay a table, and candidates meet it by a join on the pattern's hash. Instances in kept
patterns become spans of kind `id`.

Defined results: null text counts as empty; base spans always stay; an instance that overlaps
a base span is no span of its own; a span is [start, end) in code points; repeated rows are
scanned each for itself; null id is kept; an empty table gives an empty result; other columns
are ignored (redact() keeps them).
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.text import buffers, row_counts
from skein.runtime import drop_table, read, ready, table

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = _LOCAL - {"%"}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match that fails at a run's first digit fails at its others
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_HEX = re.compile(r"(?=[0-9]*[a-f])[0-9a-f]{16,}")
_CONTEXT = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_HOT = np.zeros(256, bool)
_HOT[[64, *range(48, 58)]] = True
SEND = 100_000  # patterns sent to all tasks at most
SIDE = 48  # characters of context read first; more are read where a token may go on


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed forms, by kind and then start."""
    out = []
    p, last = t.find("@"), 0
    while p >= 0:
        a = p
        while a > last and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, p) if a < p else None
        if m:
            last = m.end()
            out.append(("email", a, last))
        p = t.find("@", max(p + 1, last))
    for m in _IP.finditer(t):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(t):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(t: str, base) -> list[tuple[int, int]]:
    """Identifier-like tokens that no base span overlaps."""
    out, last, taken = [], 0, sorted((a, e) for _, a, e in base)
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts
    m = _DIGIT.search(t)
    while m:
        a, e = m.start(), m.end()
        while a > last and t[a - 1] in _TOKEN:
            a -= 1
        while e < len(t) and t[e] in _TOKEN:
            e += 1
        last = e
        while t[e - 1] in ".-":
            e -= 1
        if e - a >= 6:
            k = int(np.searchsorted(starts, e)) - 1
            if k < 0 or reach[k] <= a:
                out.append((a, e))
        m = _DIGIT.search(t, last)
    return out


def shape(x: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", x))))


def _before(t: str, a: int) -> list[str]:
    """The last two tokens before place a, whole."""
    size = SIDE
    while True:
        lo = max(0, a - size)
        found = list(_CONTEXT.finditer(t, lo, a))
        if not lo or len(found) > 2 or (len(found) == 2 and found[0].start() > lo):
            return [m[0].lower() for m in found[-2:]]
        size *= 4


def _after(t: str, e: int) -> str | None:
    """The first token from place e, whole."""
    m = _CONTEXT.search(t, e)
    return m[0].lower() if m else None


def patterns(t: str, a: int, e: int) -> list[str]:
    two = ["^", "^", *_before(t, a)][-2:]
    return [f"L2 {two[0]} {two[1]}", f"LR {two[1]} {_after(t, e) or '$'}", f"LS {two[1]} {shape(t[a:e])}"]


def rows(col):
    """(row, text) of the texts with a digit or @, one after the other; others hold none of this."""
    buf, off = buffers(col)
    for i in np.flatnonzero(row_counts(_HOT[buf], off)).tolist():
        yield i, buf[off[i] : off[i + 1]].tobytes().decode()


def instances(docs: DataFrame) -> DataFrame:
    """pattern, instance (hash of the text), seed: one row for each of an instance's patterns."""

    def run(it):
        pat, inst, seed, schema = [], [], [], pa.schema([("pattern", pa.string()), ("instance", pa.int64()), ("seed", pa.bool_())])
        for b in it:
            for _, t in rows(b.column(0)):
                base = base_spans(t)
                for a, e, s in chain(((a, e, True) for _, a, e in base), ((a, e, bool(_HEX.fullmatch(t[a:e]))) for a, e in candidates(t, base))):
                    h = number(t[a:e])
                    for p in patterns(t, a, e):
                        pat.append(p)
                        inst.append(h)
                        seed.append(s)
                    if len(pat) >= 8192:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, (pat, inst, seed))), schema=schema)
                        pat, inst, seed = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(pat, pa.string()), pa.array(inst, pa.int64()), pa.array(seed, pa.bool_())], schema=schema)

    # a value repeated in one place over and over is one link
    return docs.select("text").mapInArrow(run, "pattern string, instance long, seed boolean").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def learn(docs: DataFrame, *, rounds: int = 3, threshold: float = 0.7, least: int = 3, send: int = SEND) -> list[str] | DataFrame:
    """Patterns worth trusting: a list, or a table (column pattern) if there are more than `send`."""
    ready(docs.sparkSession)
    links = table(instances(docs), "links")
    # a pattern with too few instances can't be kept: drop it before it is weighed
    big = links.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    held = table(links.join(big, "pattern").select("pattern", "instance", F.col("seed").cast("double").alias("sure"), "n"), "held")
    drop_table(links)
    now = held
    for k in range(rounds):
        score = now.groupBy("pattern").agg((F.sum("sure") / (F.count("*") + 1)).alias("score"))
        if k == rounds - 1:
            break
        linked = held.join(score, "pattern")
        sure = linked.groupBy("instance").agg(F.greatest(F.max("sure"), 1 - F.exp(F.sum(F.log(1 - F.least(0.9 * F.col("score"), F.lit(0.99)))))).alias("sure"))
        now = held.drop("sure").join(sure, "instance")
    kept = table(score.where(F.col("score") >= threshold).select("pattern"), "patterns")
    drop_table(held)
    if kept.count() > send:
        return kept
    sent = [r.pattern for r in kept.orderBy("pattern").collect()]  # at most `send`
    drop_table(kept)
    return sent


def number(x: str) -> int:
    return int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True)


def _marked(docs: DataFrame, kept: list[str] | DataFrame, text_col: str) -> tuple[DataFrame, frozenset, str | None]:
    """docs, the patterns to send, and the column of each row's kept patterns' numbers if they are too many to send."""
    if not isinstance(kept, DataFrame):
        return docs, frozenset(kept), None

    def run(it):
        for b in it:
            key, pat = [], []
            keys = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            for i, t in rows(b.column(0)):
                own = {number(p) for a, e in candidates(t, base_spans(t)) for p in patterns(t, a, e)}
                key += [keys[i]] * len(own)
                pat += own
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in key], pa.int64()), pa.array([k[1] for k in key], pa.int64()), pa.array(pat, pa.int64())], ["_a", "_b", "p"])

    def numbers(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([number(p) for p in b.column(0).to_pylist()], pa.int64())], ["p"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.withColumn("_a", F.xxhash64(text)).withColumn("_b", F.xxhash64(F.lit(1), text))
    met = named.select(text_col, "_a", "_b").mapInArrow(run, "_a long, _b long, p long").distinct().join(kept.select("pattern").mapInArrow(numbers, "p long").distinct(), "p")
    known = met.groupBy("_a", "_b").agg(F.collect_list("p").alias("_known"))  # one text's own patterns
    return named.join(known, ["_a", "_b"], "left").drop("_a", "_b"), frozenset(), "_known"


def all_spans(t: str, kept: frozenset, by=None) -> list[tuple[str, int, int]]:
    """Base spans, then candidates in kept patterns (these, or their numbers where by is number())."""
    base = base_spans(t)
    if not kept:
        return base
    return base + [("id", a, e) for a, e in candidates(t, base) if not kept.isdisjoint(patterns(t, a, e) if by is None else map(by, patterns(t, a, e)))]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{e}" for k, a, e in spans)


def find(docs: DataFrame, kept: list[str] | DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts by kind, digest of the base spans, and all spans."""
    ready(docs.sparkSession)
    d, known, own = _marked(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), kept, "text")
    empty = hashlib.sha256(b"").hexdigest()

    def run(it):
        for b in it:
            n = np.zeros((4, b.num_rows), np.int64)
            sha, spans = [empty] * b.num_rows, [""] * b.num_rows
            for i, t in rows(b.column(1)):
                found = all_spans(t, known) if own is None else all_spans(t, frozenset(b.column(2)[i].as_py() or ()), number)
                base = [s for s in found if s[0] != "id"]
                for k, _, _ in base:
                    n[KINDS.index(k), i] += 1
                sha[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[i] = _joined(found)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, n), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, kept: list[str] | DataFrame, *, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with every span replaced by <KIND> (overlapping ones by the first's); size_col, if there, follows the text."""
    ready(docs.sparkSession)
    names = docs.columns
    marked, known, own = _marked(docs, kept, text_col)

    def run(it):
        for b in it:
            k = names.index(text_col)
            old = b.column(k)
            changed = {}
            for i, t in rows(old):
                out, end = [], 0
                spans = all_spans(t, known) if own is None else all_spans(t, frozenset(b.column(len(names))[i].as_py() or ()), number)
                for kind, a, e in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        out += [t[end:a], f"<{kind.upper()}>"]
                    end = max(end, e)
                if out:
                    changed[i] = "".join(out) + t[end:]
            cols = list(b.columns)[: len(names)]
            if changed:
                at = pa.array(list(changed), pa.int64())
                mask = np.zeros(b.num_rows, bool)
                mask[at.to_numpy()] = True
                order = sorted(changed)
                cols[k] = pa.compute.replace_with_mask(old, pa.array(mask), pa.array([changed[i] for i in order], old.type))
                if size_col in names:
                    j = names.index(size_col)
                    cols[j] = pa.compute.replace_with_mask(cols[j], pa.array(mask), pa.array([len(changed[i]) for i in order], cols[j].type))
            yield pa.RecordBatch.from_arrays(cols, names)

    return marked.mapInArrow(run, docs.schema)


def op8_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return find(docs, learn(docs))
