"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

Texts are lower-cased (A-Z), words are runs without space or U+0009..U+000D, shingles are 4
consecutive words joined by one space (fewer words: all of them; none: fingerprint zero). A
fingerprint bit is 1 if set in over half the shingles' XXH64 (seed 42).

Two fingerprints that differ in at most d of m blocks agree in m - d blocks, so joining on
every choice of m - d blocks finds every close pair; a pair counts only at the first choice
in which it agrees, so it is met once. m grows with the number of different fingerprints so
that chance meetings stay few; it never changes which pairs are found. Equal fingerprints are
one row before the join, so a group of copies, however large, is never expanded.

Defined results: rows with null id are documents like others, but no component is named by
them (its component_id is the smallest id that is not null, else null); null text counts as empty; texts without words have fingerprint zero and are linked like any other;
repeated rows are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.text import buffers, parts
from skein.runtime import drop_table, read, ready, table

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # byte -> its bits, high first
_ROWS = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, n: int = 4, seed: int = 42) -> int:
    h, carry, count, total = xxhash.xxh64_intdigest, [], np.zeros((8, 8), np.int64), 0
    for part in parts(text):  # a long text a piece at a time; the last words of one begin the next one's shingles
        words = carry + part.lower().split()
        carry = words[1 - n :] if n > 1 else []
        if len(words) < n:
            continue
        joined = b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], end[:-1] + 1])
        hs = [h(joined[a:e], seed) for a, e in zip(start[: len(words) - n + 1].tolist(), end[n - 1 :].tolist())]
        total += len(hs)
        count += _set_bits(hs)
    if not total:
        if not carry:
            return 0
        total, count = 1, _set_bits([h(b" ".join(carry), seed)])
    return int.from_bytes(np.packbits((2 * count > total).ravel()).tobytes(), "big")


def _set_bits(hs: list[int]) -> np.ndarray:
    """How often each of the 64 bits is set, high first."""
    b = np.array(hs, ">u8").view(np.uint8).reshape(-1, 8)
    return np.bincount((b + _ROWS).ravel(), minlength=2048).reshape(8, 256) @ _BITS


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), th (a hash that tells texts of one id apart)."""
    ready(df.sparkSession)

    def run(it):
        for b in it:
            buf, off = buffers(b.column(1))
            fp = np.array([fingerprint(buf[a:e].tobytes()) for a, e in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], ["doc_id", "fp", "th"])

    kind = df.schema[id_col].dataType.simpleString()
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"), F.xxhash64(F.coalesce(df[text_col], F.lit(""))).alias("th"))
    return d.mapInArrow(run, f"doc_id {kind}, fp long, th long")


BLOCK = 4096  # fingerprints in a block beyond which it is dealt to several tasks


def near_pairs(fps: DataFrame, count: int, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """Pairs a < b of different fingerprints at most `distance` bits apart, each once. fps: column fp, distinct.

    One side of a block with over `block` fingerprints is dealt to several tasks, each of which gets the other side whole.
    """
    m = distance + 2
    while m < 16 and (m - distance) * 64 / m < log2(max(count, 2)):
        m += 1
    cuts = [round(64 * k / m) for k in range(m + 1)]
    masks = [((1 << (cuts[k + 1] - cuts[k])) - 1) << cuts[k] for k in range(m)]
    keep = list(combinations(range(m), m - distance))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    own = [signed(sum(masks[k] for k in c)) for c in keep]
    # which choice is the first in which a pair agrees, by the set of blocks where it differs
    first = [next((i for i, c in enumerate(keep) if not any(s >> k & 1 for k in c)), -1) for s in range(1 << m)]
    blocks = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(x)) for x in own))).alias("choice", "part"))
    hot = table(blocks.groupBy("choice", "part").agg(F.ceil(F.count("*") / block).cast("int").alias("deal")).where("deal > 1"), "hot")
    if hot.isEmpty():
        left, right = blocks.withColumn("k", F.lit(0)), blocks.withColumn("k", F.lit(0))
    else:
        dealt = blocks.join(hot, ["choice", "part"], "left").withColumn("deal", F.coalesce("deal", F.lit(1)))
        left = dealt.withColumn("k", F.pmod(F.xxhash64("fp"), F.col("deal")).cast("int"))
        right = dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
    a, b = left.alias("a"), right.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    differs = sum((F.when(x.bitwiseAND(F.lit(signed(masks[k]))) != 0, 1 << k).otherwise(0) for k in range(m)), F.lit(0))
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= distance)
    met = F.element_at(F.lit(first), differs + 1) == F.col("a.choice")
    pairs = a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.k") == F.col("b.k")) & near & met)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for undirected edges a, b; nodes without edges are not returned.

    Alternating large-star and small-star steps: each moves every link to the smallest
    neighbour, so a component becomes a star after a number of rounds that is logarithmic in
    its size. A node's links are reduced by partial aggregation and a join, never gathered.
    """
    now, stars = table(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    old = None
    while True:
        # large star: every neighbour above a node moves to the smallest of its neighbourhood
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u")
        small = moved.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        nxt = table(small, "edges")
        # a star forest: no node is both a root and a leaf, no leaf has two roots
        bad = nxt.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a"))
        roots = nxt.select(F.col("a").alias("b")).distinct()
        done = bad.where("n > 1").isEmpty() and bad.join(roots, "b", "left_semi").isEmpty()
        old, now = now, nxt
        drop_table(old)
        if done:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def _near(df: DataFrame, id_col: str, text_col: str, distance: int) -> DataFrame:
    """doc_id, fp, th, n_near, component_id, lead (the least doc_id and th of the component)."""
    made = table(fingerprints(df, id_col=id_col, text_col=text_col), "fps")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th")))
    classes = table(made.groupBy("fp").agg(F.count("*").alias("n"), first.alias("low")), "classes")
    pairs = table(near_pairs(classes.select("fp"), classes.count(), distance), "pairs")
    ends = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.join(classes.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    root = components(pairs).withColumnRenamed("node", "fp")
    named = classes.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("low").alias("lead"))
    facts = named.join(low, "root").join(links, "fp", "left").select("fp", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_near"), "lead")
    return made.join(facts, "fp").withColumn("component_id", F.col("lead.doc_id"))


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint, n_near, component_id."""
    found = _near(df, id_col, text_col, distance)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def op2_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


SENT = 1_000_000  # rows to drop that are sent to all tasks at most; more are met in a join


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """docs, all columns, less every document but one of each component: the one with the least id stays, of texts with that id the one with the least hash, of equal rows one.

    Of rows equal in id and text the least by all columns stays; rows with null id all stay. What goes is decided
    row by row, so texts that share an id but no likeness keep their places. Up to SENT rows
    that go are sent to all tasks as numbers, so that no text moves; more meet the texts in a join.
    """
    spark = docs.sparkSession
    mark = "_th"
    while mark in docs.columns:
        mark += "_"
    near = table(_near(docs, id_col, text_col, distance).where("doc_id is not null").select("doc_id", "th", F.struct("doc_id", "th").alias("own"), "lead"), "near")
    again = near.where("own = lead").groupBy("doc_id", "th").count().where("count > 1").select(F.col("doc_id").alias(id_col), F.col("th").alias(mark))
    gone = near.where("own <> lead").select(F.col("doc_id").alias(id_col), F.col("th").alias(mark)).distinct()
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    if docs.schema[id_col].dataType.simpleString() in ("bigint", "int") and gone.count() <= SENT:
        rows = gone.toPandas()  # at most SENT rows of two numbers
        rows = rows.sort_values([id_col, mark])
        held = spark.sparkContext.broadcast((rows[id_col].to_numpy(np.int64), rows[mark].to_numpy(np.int64)))
        names = docs.columns
        at = names.index(id_col)

        def run(it):
            ids, ths = held.value
            for b in it:
                own, h = b.column(at).fill_null(0).to_numpy(), b.column(len(names)).to_numpy()
                lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
                drop = np.zeros(b.num_rows, bool)
                while (live := np.flatnonzero(lo < hi)).size:  # as often as one id has texts that go
                    drop[live] |= ths[lo[live]] == h[live]
                    lo[live] += 1
                drop &= b.column(at).is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(list(b.columns)[: len(names)], names).filter(pa.array(~drop))

        left = docs.select("*", th.alias(mark)).mapInArrow(run, docs.schema)
    else:
        left = docs.withColumn(mark, th).join(gone, [id_col, mark], "left_anti").select(docs.columns)
    if again.isEmpty():
        return left
    marked = left.withColumn(mark, th)
    repeated = marked.join(again, [id_col, mark], "left_semi")
    every = F.struct(*[F.col(c) for c in docs.columns])
    one = repeated.groupBy(id_col, mark).agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias("row")).select("row.*")
    return marked.join(again, [id_col, mark], "left_anti").select(docs.columns).unionByName(one)
