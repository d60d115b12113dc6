"""Best-fit packing of token sequences, in bulk-synchronous sweeps over length classes.

Lengths are whole numbers up to the capacity, so documents and gaps fall into at most
`capacity` classes each; pieces of one length are interchangeable. A superstep takes the
next class of the range-sorted documents (longest first), sweeps over the gap classes from
the smallest that holds it (the successor) upwards, gives gaps to documents by rank, and
moves the filled gaps to their new class. What is left over opens new sequences. Every
superstep settles a class of documents at once, however many there are: the sweeps need the
class counts only (a table of at most `capacity` rows), while the rows, which grow with
the data, take their place by rank in a distributed join-free lookup. The result is exactly
best-fit decreasing over all rows.

Defined results: null text counts as empty, one end token; repeated rows are packed each for
itself; ties go by rank (order of partitions, then of rows); an empty table gives an empty
result; other columns are ignored; pieces of full length are sequences of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.text import buffers
from skein.llm.tokens import tokenizer
from skein.runtime import read, ready, table

CAPACITY = 4096


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit over classes: rows (length, first rank, ranks, first sequence, offset) and as many sequences as needed.

    counts[n]: pieces of length n. A run of sequences with the same gap is (first sequence, how many).
    """
    gaps: dict[int, list[list[int]]] = {}
    present = np.zeros(capacity + 1, bool)
    out, opened = [], 0
    for n in range(capacity, 0, -1):
        left, rank, rests, g = int(counts[n]), 0, [], n

        def fill(base: int, many: int, gap: int) -> int:
            """Put this class into sequences base.. (many with this gap); how many of them it used."""
            nonlocal left, rank
            per = min(gap // n, left)  # once begun, a sequence stays the best fit until this class no longer fits
            used = min(many, left // per)
            for k in range(per):
                out.append((n, rank, used, base, capacity - gap + k * n))
                rank += used
            left -= per * used
            if gap > per * n:
                rests.append((gap - per * n, base, used))
            return used

        while left:
            g += int(np.argmax(present[g:]))  # the successor among the gaps
            if not present[g]:
                break
            runs = gaps[g]
            while left and runs:
                base, many = runs.pop()
                used = fill(base, many, g)
                if used < many:
                    runs.append([base + used, many - used])
            present[g] = bool(runs)
        while left:
            opened += fill(opened, left, capacity)
        for rest, base, many in rests:
            gaps.setdefault(rest, []).append([base, many])
            present[rest] = True
    return out


def pieces(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Tokenised pieces: doc_id, piece, start, length, ids_crc32, part and rank (the piece's number among those of its length in its partition)."""

    def run(it):
        from pyspark import TaskContext

        part, seen, t, end = TaskContext.get().partitionId(), [0] * (capacity + 1), tokenizer(path), np.array([end_id], "<u4").tobytes()
        size = 4 * capacity
        for b in it:
            buf, off = buffers(b.column(1))
            raw, off = buf.tobytes(), off.tolist()
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for i in range(b.num_rows):
                ids = t.ids(raw[off[i] : off[i + 1]]) + end
                for k, a in enumerate(range(0, len(ids), size)):
                    x = ids[a : a + size]
                    n = len(x) // 4
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(n)
                    crc.append(zlib.crc32(x))
                    rank.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    d = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces() that were written to a table."""
    spark = made.sparkSession
    per = made.groupBy("part", "length").agg(F.max("rank").alias("m")).withColumn("m", F.col("m") + 1)
    w = Window.partitionBy("length").orderBy("part")
    base = per.withColumn("before", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"])
    counts = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("m").alias("n")).collect():  # at most `capacity` rows
        counts[r.length] = r.n
    rows = plan(counts, capacity)
    by: dict[int, list] = {}
    for n, rank, take, seq, at in rows:
        by.setdefault(n, []).append((rank, seq, at))
    table_of = {n: tuple(np.array(c, np.int64) for c in zip(*v)) for n, v in by.items()}
    held = spark.sparkContext.broadcast(table_of)  # bounded by the length classes, not by the rows

    def run(it):
        t = held.value
        for b in it:
            n = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("full_rank")).to_numpy()
            seq, at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            cuts = np.flatnonzero(np.diff(n[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                first, s, o = t[int(n[own[0]])]
                k = np.searchsorted(first, rank[own], side="right") - 1
                seq[own], at[own] = s[k] + rank[own] - first[k], o[k]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(at)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = made.schema["doc_id"].dataType.simpleString()
    full = made.join(base.drop("m"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("full_rank"))
    return full.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(df: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """Tokenise, cut what is longer than capacity, and pack: one row per piece."""
    ready(df.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    made = table(pieces(df, path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id), "pieces")
    return place(made, capacity)


def op6_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
