"""Approximate nearest neighbours: NN-descent by joins, then greedy graph search.

Vectors of equal content are one node, named by its smallest id. Nodes carry a code: the unit
vector in single precision, so that near copies are told apart; codes guide, and all EF nodes
found for a query are scored exactly.

Build: buckets of random hyperplanes give first neighbours (large buckets are split at
random). Then, again and again, each node introduces its neighbours, in both directions, to
each other; a pair is kept by whichever side it improves. Reverse neighbours are sampled to K
a node, as in the published method.

Search: each query keeps the EF best nodes seen; in every round its best STEP nodes not yet
opened are opened, and what they are linked to (in both directions) is scored. It ends when
nothing is left to open. A query starts from its own node.

The index holds every row; tests/llm/test_op7.py measures recall against brute force.

Defined results: rows whose id or vector is null, or whose vector is zero or holds null or
non-finite components take no part; vectors meet those of their own length only; rows that repeat an id count
once (the least vector in array order); ties go to the smaller id; with fewer candidates than
k all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.runtime import drop_table, read, ready, table

K, ROUNDS, BUCKET, TABLES, EF, STEP = 20, 4, 128, 2, 400, 96


def _matrix(col: pa.Array, kind=np.float64) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind).reshape(len(col), -1) if len(col) else np.zeros((0, 1), kind)


def _codes(col: pa.Array) -> np.ndarray:
    """Rows of a binary column of codes of one size: unit vectors (float32)."""
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].view(np.float32).reshape(len(col), -1)


def nodes(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>) of the rows that take part."""
    v = df.select(df[id_col].cast("long").alias("id"), df[vec_col].cast("array<double>").alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("vec", lambda x: x != 0)).groupBy("id").agg(F.min("vec").alias("vec"))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: no square overflows or vanishes, no bit is lost."""
    if not len(v):
        return v
    _, e = np.frexp(np.abs(v).max(1))
    return np.ldexp(v, -e[:, None])


def coded(reps: DataFrame) -> DataFrame:
    """node, code, vec"""

    def run(it):
        for b in it:
            v = _matrix(b.column(1))
            u = _scaled(v)
            u = u / np.linalg.norm(u, axis=1)[:, None] if len(v) else u
            raw = u.astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in raw], pa.binary()), b.column(1)], ["node", "code", "vec"])

    return reps.select("node", "vec").mapInArrow(run, "node long, code binary, vec array<double>")


def _lists(b: pa.RecordBatch, k: int):
    """(offsets, fields) of a column of lists of structs."""
    col = b.column(k)
    s = col.flatten()
    off = col.offsets.to_numpy()
    return off - off[0], [s.field(i) for i in range(s.type.num_fields)]


def _introduce(best: int | None):
    """Local joins: each member against the others; keeps what beats the member's K-th, or the `best` ones."""

    def run(it):
        for b in it:
            off, (m, code, kth) = _lists(b, 0)
            m, kth, u = m.to_numpy(), kth.to_numpy(), _codes(code)
            out_a, out_b, out_s = [], [], []
            for a, e in zip(off[:-1].tolist(), off[1:].tolist()):
                if e - a < 2:
                    continue
                s = u[a:e] @ u[a:e].T
                np.fill_diagonal(s, -9)
                if best and best < e - a - 1:
                    y = np.argpartition(-s, best - 1, axis=1)[:, :best].ravel()
                    x = np.repeat(np.arange(e - a), best)
                else:
                    x, y = np.nonzero(s > kth[a:e][:, None])
                out_a.append(m[a:e][x])
                out_b.append(m[a:e][y])
                out_s.append(s[x, y])
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            yield pa.RecordBatch.from_arrays([cat(out_a, pa.int64()), cat(out_b, pa.int64()), cat(out_s, pa.float32())], ["u", "v", "sim"])

    return run


def _best(links: DataFrame, k: int) -> DataFrame:
    one = links.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("u", "v", "sim")


def build(codes: DataFrame, count: int, size: int, *, k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """u, v, sim: up to k neighbours of each node. codes: node, code."""
    bits = max(0, int(np.ceil(np.log2(max(count, 1) / BUCKET))))
    planes = np.random.default_rng(11).normal(size=(size, bits * TABLES)).astype(np.float32)

    def bucket(it):
        for b in it:
            p = (_codes(b.column(1)) @ planes > 0).reshape(b.num_rows, TABLES, bits) if b.num_rows else np.zeros((0, TABLES, bits))
            key = (p * (1 << np.arange(bits))).sum(2).astype(np.int64) * TABLES + np.arange(TABLES)
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key[:, t])], ["node", "code", "b"])

    at = codes.select("node", "code").mapInArrow(bucket, "node long, code binary, b long")
    many = at.groupBy("b").agg(F.ceil(F.count("*") / (1.5 * BUCKET)).alias("parts"))
    part = F.pmod(F.xxhash64("node", "b"), F.col("parts"))
    member = F.struct(F.col("node").alias("m"), "code", F.lit(-2.0).cast("float").alias("kth"))
    first = at.join(many, "b").groupBy("b", part.alias("part")).agg(F.collect_list(member).alias("ms"))  # about 1.5 x BUCKET at most
    graph = table(_best(first.select("ms").mapInArrow(_introduce(k), "u long, v long, sim float"), k), "graph")
    for n in range(rounds):
        w = Window.partitionBy("u").orderBy(F.xxhash64("u", "v", F.lit(n)), "v")
        back = graph.select(F.col("v").alias("u"), F.col("u").alias("v")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        near = graph.select("u", "v").union(back.select("u", "v")).distinct()
        kth = graph.groupBy(F.col("u").alias("v")).agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("kth"))
        facts = codes.select(F.col("node").alias("v"), "code").join(kth, "v", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0).cast("float")))
        groups = near.join(facts, "v").groupBy("u").agg(F.collect_list(F.struct(F.col("v").alias("m"), "code", "kth")).alias("ms"))  # at most 2 k
        found = groups.select("ms").mapInArrow(_introduce(None), "u long, v long, sim float")
        old, graph = graph, table(_best(graph.union(found), k), "graph")
        drop_table(old)
    return graph


def _top(done: np.ndarray, step: int) -> np.ndarray:
    """Places of the best `step` that are not done; lists are in order."""
    return np.flatnonzero(done == 0)[:step]


def search(graph: DataFrame, codes: DataFrame, queries: DataFrame, *, ef: int = EF, step: int = STEP) -> DataFrame:
    """q, ids, sims, scored: the ef best nodes found for each query, and how many were scored. queries: q (a node), code."""
    edges = table(graph.select("u", "v").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    held = "q long, code binary, ids binary, sims binary, done binary, seen binary, open int"
    state = table(queries.select("q", "code", F.array(F.col("q")).alias("x")).mapInArrow(_start, held), "state")

    def frontier(it):
        for b in it:
            q, u = [], []
            for k, i, d in zip(*(b.column(c).to_pylist() for c in (0, 1, 2))):
                ids = np.frombuffer(i, np.int64)
                at = _top(np.frombuffer(d, np.uint8), step)
                q.append(np.full(len(at), k))
                u.append(ids[at])
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
            yield pa.RecordBatch.from_arrays([cat(q), cat(u)], ["q", "u"])

    def fresh(it):
        for b in it:
            q, v, c = [], [], []
            for k, code, seen, vs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                x = np.setdiff1d(vs.values.to_numpy(), np.frombuffer(seen, np.int64))
                q.append(np.full(len(x), k))
                v.append(x)
                c += [code] * len(x)
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
            yield pa.RecordBatch.from_arrays([cat(q), cat(v), pa.array(c, pa.binary())], ["q", "v", "a"])

    def score(it):
        for b in it:
            s = np.einsum("ij,ij->i", _codes(b.column(2)), _codes(b.column(3))) if b.num_rows else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s.astype(np.float32))], ["q", "v", "sim"])

    def merge(it):
        for b in it:
            cols = [b.column(c).to_pylist() for c in range(6)]
            got, out = b.column(7), [[], [], [], [], []]
            for n, (q, code, i, s, d, seen) in enumerate(zip(*cols)):
                ids, sims, done = np.frombuffer(i, np.int64), np.frombuffer(s, np.float32), np.frombuffer(d, np.uint8).copy()
                done[_top(done, step)] = 1
                if got[n].is_valid:
                    x = got[n].values
                    v, t = x.field(0).to_numpy(), x.field(1).to_numpy()
                    seen = np.union1d(np.frombuffer(seen, np.int64), v).tobytes()
                    ids, sims, done = np.concatenate([ids, v]), np.concatenate([sims, t]), np.concatenate([done, np.zeros(len(v), np.uint8)])
                    o = np.lexsort((ids, -sims))[:ef]
                    ids, sims, done = ids[o], sims[o], done[o]
                for k, y in enumerate((ids.tobytes(), sims.tobytes(), done.tobytes(), seen, int((done == 0).sum()))):
                    out[k].append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(o, pa.binary()) for o in out[:4]), pa.array(out[4], pa.int32())], ["q", "code", "ids", "sims", "done", "seen", "open"])

    own = codes.select(F.col("node").alias("v"), F.col("code").alias("b"))
    while True:  # every round opens nodes that were not open, so it ends
        fr = state.where("open > 0").select("q", "ids", "done").mapInArrow(frontier, "q long, u long")
        near = fr.join(edges, "u").groupBy("q").agg(F.collect_set("v").alias("vs"))  # step nodes' links
        pairs = state.select("q", "code", "seen").join(near, "q").mapInArrow(fresh, "q long, v long, a binary")
        scored = pairs.join(own, "v").select("q", "v", "a", "b").mapInArrow(score, "q long, v long, sim float")
        new = scored.groupBy("q").agg(F.collect_list(F.struct("v", "sim")).alias("new"))
        old, state = state, table(state.join(new, "q", "left").select(*state.columns, "new").mapInArrow(merge, held), "state")
        drop_table(old)
        if state.where("open > 0").isEmpty():
            break
    drop_table(edges)
    return state.select("q", "ids", "sims", (F.length("seen") / 8).cast("long").alias("scored"))


def _start(it):
    """A query's first state: its own node, not yet opened."""
    for b in it:
        ids = [np.array(x, np.int64).tobytes() for x in b.column(2).to_pylist()]
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array([np.ones(1, np.float32).tobytes()] * n, pa.binary()), pa.array([b"\0"] * n, pa.binary()), pa.array(ids, pa.binary()), pa.array([1] * n, pa.int32())],
            ["q", "code", "ids", "sims", "done", "seen", "open"],
        )


def nearest(df: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", degree: int = K, rounds: int = ROUNDS, ef: int = EF, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest others found for each row that is_query (a condition on `id`) admits."""
    spark = ready(df.sparkSession)
    rows, out = table(nodes(df, id_col, vec_col), "rows"), None
    for r in rows.select(F.size("vec").alias("n")).distinct().orderBy("n").collect():  # vectors' lengths
        got = _nearest(rows.where(F.size("vec") == r.n), r.n, is_query, k, degree, rounds, ef, step)
        out = got if out is None else out.union(got)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _nearest(rows: DataFrame, size: int, is_query: Column, k: int, degree: int, rounds: int, ef: int, step: int) -> DataFrame:
    """nearest() among vectors of one length. rows: id, vec."""
    # one node for equal vectors; of its members the k + 1 smallest ids can be asked for
    rep = table(rows.groupBy("vec").agg(F.min("id").alias("node")), "reps")
    codes = table(coded(rep), "codes")
    member = rows.join(rep, "vec").select("id", "node")
    salted = Window.partitionBy("node", "salt").orderBy("id")
    small = member.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    small = small.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("r") <= k + 1).select("id", "node")
    asked = table(member.where(is_query).select(F.col("id").alias("query_id"), F.col("node").alias("q")), "asked")
    graph = build(codes.select("node", "code"), codes.count(), size, k=degree, rounds=rounds)
    found = search(graph, codes.select("node", "code"), asked.select("q").distinct().join(codes.select(F.col("node").alias("q"), "code"), "q"), ef=ef, step=step)

    def unpack(it):
        for b in it:
            q, v = [], []
            for n, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(i, np.int64)
                q.append(np.full(len(ids), n))
                v.append(ids)
            cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64())
            yield pa.RecordBatch.from_arrays([cat(q), cat(v)], ["q", "node"])

    def exact(it):
        for b in it:
            x, y = _scaled(_matrix(b.column(2))), _scaled(_matrix(b.column(3)))
            s = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["q", "node", "score"])

    vec = codes.select("node", F.col("vec").alias("y"))
    top = found.select("q", "ids").mapInArrow(unpack, "q long, node long").join(codes.select(F.col("node").alias("q"), F.col("vec").alias("x")), "q").join(vec, "node")
    scored = top.select("q", "node", "x", "y").mapInArrow(exact, "q long, node long, score double")
    each = scored.join(small, "node").join(asked, "q").where("id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_nearest_neighbours(spark, sf_dir):
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
