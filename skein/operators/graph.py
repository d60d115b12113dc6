"""Import, call and inheritance graphs: edges by joins, reachability by semi-naive rounds.

Graphs are a DataFrame of edges (src, dst), many at once if graph_cols names what tells them
apart. Order-dependent answers (cycles of one depth-first walk, depth with shared visits,
Kahn's order) are made per graph in applyInPandas, for graphs of bounded size; the others
are distributed.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.runtime import drop_table, ready, table


def stdlib(spark) -> DataFrame:
    """Names of the standard library's top-level modules: a fixed, small table."""
    return spark.createDataFrame([(x,) for x in sorted(sys.stdlib_module_names)], "top string")


def classify_imports(imports: DataFrame, sources: DataFrame, installed: DataFrame | None = None, root: str | None = "") -> DataFrame:
    """Adds kind (stdlib, local, third_party), target (file of a local import), resolvable.

    stdlib goes first, also for relative imports of such a name. Local targets are files of
    sources under root (None: absolute imports are never local); packages before modules.
    """
    spark = imports.sparkSession
    top = F.element_at(F.split("module", r"\."), 1)
    i = imports.withColumn("top", top).join(F.broadcast(stdlib(spark).withColumn("std", F.lit(True))), "top", "left")  # a few hundred names
    here = F.split("file_path", "/")
    up = F.array_join(F.slice(here, 1, F.greatest(F.size(here) - F.greatest("level", F.lit(1)), F.lit(0))), "/")
    part = F.replace("module", F.lit("."), F.lit("/"))
    rel = F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(part, F.lit("")))
    absolute = F.concat_ws("/", F.nullif(F.lit(root or ""), F.lit("")), F.nullif(part, F.lit("")))
    i = i.withColumn("base", F.when(F.col("level") > 0, rel).when(F.lit(root is not None), absolute))
    files = sources.select(F.col("file_path").alias("hit")).distinct()
    pkg, mod = files.withColumnRenamed("hit", "pkg"), files.withColumnRenamed("hit", "mod")
    i = i.join(pkg, F.concat(F.col("base"), F.lit("/__init__.py")) == F.col("pkg"), "left").join(mod, F.concat(F.col("base"), F.lit(".py")) == F.col("mod"), "left")
    i = i.withColumn("target", F.when(F.col("std").isNull(), F.coalesce("pkg", "mod")))
    kind = F.when(F.col("std"), "stdlib").when((F.col("level") > 0) | F.col("target").isNotNull(), "local").otherwise("third_party")
    i = i.withColumn("kind", kind)
    if installed is not None:
        i = i.join(installed.select(F.col("name").alias("top"), F.lit(True).alias("have")), "top", "left")
    else:
        i = i.withColumn("have", F.lit(False))
    ok = F.when(F.col("kind") == "stdlib", True).when(F.col("kind") == "local", F.col("target").isNotNull()).otherwise(F.coalesce("have", F.lit(False)))
    return i.withColumn("resolvable", ok).drop("std", "base", "pkg", "mod", "have")


def module_edges(classified: DataFrame) -> DataFrame:
    """src, dst, weight (import rows), names (in order); self imports are left out."""
    c = classified.where("kind = 'local' and target is not null and target <> file_path")
    g = c.groupBy(F.col("file_path").alias("src"), F.col("target").alias("dst")).agg(F.count("*").alias("weight"), F.sort_array(F.collect_list(F.struct("ord", F.coalesce("name", "module").alias("name")))).alias("n"))
    return g.select("src", "dst", "weight", F.transform("n", lambda x: x["name"]).alias("names"))


def call_edges(callables: DataFrame) -> DataFrame:
    """src, dst: each call to the last definition of that name, else to external.<name>."""
    own = F.concat_ws(".", "class_name", "name")
    c = callables.select(F.concat_ws(":", "file_path", own).alias("id"), own.alias("reg"), "calls", F.struct("file_path", "ord").alias("at"))
    known = c.groupBy(F.col("reg").alias("call")).agg(F.max_by("id", "at").alias("to"))
    calls = c.select(F.col("id").alias("src"), F.explode("calls").alias("call")).distinct()
    return calls.join(known, "call", "left").select("src", F.coalesce("to", F.concat(F.lit("external."), "call")).alias("dst")).distinct()


def inheritance_edges(classes: DataFrame) -> DataFrame:
    """src (class) -> dst (base), by name; the last definition of a name counts."""
    c = classes.select(F.concat_ws(":", "file_path", "name").alias("id"), "name", "bases", F.struct("file_path", "ord").alias("at"))
    known = c.groupBy(F.col("name").alias("base")).agg(F.max_by("id", "at").alias("to"))
    b = c.select(F.col("id").alias("src"), F.explode("bases").alias("base"))
    return b.join(known, "base", "left").select("src", F.coalesce("to", F.concat(F.lit("external."), "base")).alias("dst")).distinct()


def neighbours(edges: DataFrame, node: str | Column, forward: bool = True) -> DataFrame:
    a, b = ("src", "dst") if forward else ("dst", "src")
    return edges.where(F.col(a) == node).select(F.col(b).alias("node")).distinct()


dependencies = neighbours


def dependents(edges: DataFrame, node: str | Column) -> DataFrame:
    return neighbours(edges, node, forward=False)


def vertices(nodes: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """One row per key: of several the last by `order` stands."""
    every = F.struct(*nodes.columns)
    return nodes.groupBy(F.col(key).alias("_key")).agg(F.max_by(every, order).alias("v")).select("v.*")


def edges_from(edges: DataFrame, node: str | Column, edge_type: str | None = None) -> DataFrame:
    """Edges out of a node (rows as they are), of one type if asked for."""
    e = edges.where(F.col("src") == node)
    return e if edge_type is None else e.where(F.col("edge_type") == edge_type)


def edges_to(edges: DataFrame, node: str | Column, edge_type: str | None = None) -> DataFrame:
    e = edges.where(F.col("dst") == node)
    return e if edge_type is None else e.where(F.col("edge_type") == edge_type)


def graph_counts(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node_count, edge_count: different nodes (those of edges, and of nodes if given) and different edges."""
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    if nodes is not None:
        ids = ids.union(nodes.select("id"))
    return ids.agg(F.count_distinct("id").alias("node_count")).crossJoin(edges.distinct().agg(F.count("*").alias("edge_count")))  # single rows


def graph_json(edges: DataFrame) -> DataFrame:
    """node, json: a node's out-edges as one object; a graph's JSON is the list of these rows."""
    out = F.sort_array(F.collect_set("dst"))  # a node's own degree
    return edges.groupBy(F.col("src").alias("node")).agg(out.alias("targets")).select("node", F.to_json(F.struct(F.col("node").alias("id"), "targets")).alias("json"))


def closure(edges: DataFrame, levels: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """src, dst, level: pairs with a path, and its shortest length, from the nodes of start (column node), else from all.

    Each round joins the last one's new pairs only; its result is a table of its own, so nothing is written twice.
    """
    e = table(edges.select("src", "dst").distinct(), "edges")
    new = e if start is None else table(e.join(start.select(F.col("node").alias("src")).distinct(), "src", "left_semi"), "level")
    known, n = new.withColumn("level", F.lit(1)), 1
    while levels is None or n < levels:
        n += 1
        step = new.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").distinct()
        new = table(step.join(known, ["src", "dst"], "left_anti"), "level")
        if new.isEmpty():
            drop_table(new)
            break
        known = known.union(new.withColumn("level", F.lit(n)))
    return known


def connected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """node, root (the least node reachable whichever way edges point), by large-star and small-star rounds."""
    now = table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        nxt = table(small, "links")
        done = nxt.groupBy("b").count().where("count > 1").isEmpty() and nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        drop_table(now)
        now = nxt
        if done:
            alone = edges.select(F.col(a).alias("node")).union(edges.select(b)).distinct()
            found = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return alone.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def strong_components(edges: DataFrame) -> DataFrame:
    """node, scc (least node of its strongly connected component) for nodes on cycles; no closure is made.

    Nodes without a way in or out are trimmed. Each of the rest takes the least node that
    reaches it as colour, in rounds; the nodes of a colour that reach its node are that node's
    component. What is left goes on. Rounds are as many as the longest shortest path.
    """
    whole = table(edges.select("src", "dst").distinct(), "edges")
    found = whole.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("scc"))
    live, parts = whole.where("src <> dst"), []
    while True:
        count = -1
        while True:
            ends = live.select(F.col("src").alias("node")).intersect(live.select("dst"))
            nxt = table(live.join(ends.select(F.col("node").alias("src")), "src", "left_semi").join(ends.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "live")
            n, live = nxt.count(), nxt
            if n == count or not n:
                break
            count = n
        if not n:
            break
        colour = table(live.select(F.col("src").alias("node"), F.col("src").alias("c")).distinct(), "colour")
        while True:
            low = live.join(colour, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
            nxt = table(colour.join(low, "node", "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")), "colour")
            moved = not nxt.where("moved").isEmpty()
            drop_table(colour)
            colour = nxt
            if not moved:
                break
        # backwards from each colour's node, inside the colour
        own = live.join(colour.select(F.col("node").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2")
        own = table(own.select("src", "dst", F.col("c1").alias("c")), "own")
        new = table(colour.where("node = c").select("node", "c"), "reach")
        reach = new
        while True:
            back = own.join(new.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "c").distinct()
            new = table(back.join(reach, ["node", "c"], "left_anti"), "reach")
            if new.isEmpty():
                break
            reach = reach.union(new)
        parts.append(reach)
        gone = reach.select("node")
        live = live.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    many = None
    for p in parts:
        many = p if many is None else many.union(p)
    if many is None:
        return found
    several = many.join(many.groupBy("c").count().where("count > 1"), "c").select("node", F.col("c").alias("scc"))
    return several.union(found.join(several, "node", "left_anti"))


def recursive_nodes(edges: DataFrame) -> DataFrame:
    """Nodes with a path back to themselves."""
    return strong_components(edges).select("node")


def diamonds(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """node, ancestor: nodes of two or more parents that all have this ancestor."""
    par = edges.select(F.col("src").alias("node"), F.col("dst").alias("parent")).distinct()
    many = par.groupBy("node").agg(F.count("*").alias("parents")).where("parents >= 2")
    a = par.join(many, "node").join(closed.select(F.col("src").alias("parent"), F.col("dst").alias("ancestor")), "parent")
    return a.groupBy("node", "ancestor", "parents").agg(F.count_distinct("parent").alias("n")).where("n = parents").select("node", "ancestor")


def _walk(pdf: pd.DataFrame):
    """Nodes in order of appearance and their targets in edge order."""
    pdf = pdf.sort_values("ord")
    out: dict = {}
    for s, d in zip(pdf.src, pdf.dst):
        out.setdefault(s, [])
        out.setdefault(d, [])
        out[s].append(d)
    return {s: list(dict.fromkeys(ds)) for s, ds in out.items()}


def _cycles(g: dict) -> list[list]:
    seen, found = set(), []
    for root in g:
        if root in seen:
            continue
        path, on, todo = [root], {root}, [iter(g[root])]
        seen.add(root)
        while todo:
            for n in todo[-1]:
                if n in on:
                    found.append([*path[path.index(n) :], n])
                elif n not in seen:
                    seen.add(n)
                    path.append(n)
                    on.add(n)
                    todo.append(iter(g[n]))
                    break
            else:
                todo.pop()
                on.discard(path.pop())
    return found


def _kahn(g: dict) -> list:
    deg = dict.fromkeys(g, 0)
    for ds in g.values():
        for d in ds:
            deg[d] += 1
    ready_, out = [n for n in g if not deg[n]], []
    for n in ready_:
        out.append(n)
        for d in g[n]:
            deg[d] -= 1
            if not deg[d]:
                ready_.append(d)
    done = set(out)
    return out + [n for n in g if n not in done]


def _depth(g: dict, n, settled: dict | tuple = ()) -> int:
    """Depth-first with visits shared by the whole walk; settled: depths of nodes no part of whose reach is entered but through them."""
    seen = {n}
    todo, best = [(n, iter(g[n]), [0])], 0
    while todo:
        _, it, top = todo[-1]
        for d in it:
            if d in seen:
                top[0] = max(top[0], 1)  # the link counts, the node is not walked again
                continue
            seen.add(d)
            if d in settled:
                top[0] = max(top[0], 1 + settled[d])
                continue
            todo.append((d, iter(g[d]), [0]))
            break
        else:
            todo.pop()
            best = top[0]
            if todo:
                todo[-1][2][0] = max(todo[-1][2][0], 1 + best)
    return best


def _depths(g: dict) -> dict:
    """_depth() of each node, trees settled from the ends upwards: only nodes that reach a cycle, or a node of several parents, are walked each for itself."""
    left, parents, settled = {n: len(ds) for n, ds in g.items()}, {n: [] for n in g}, {}
    for n, ds in g.items():
        for d in ds:
            parents[d].append(n)
    todo = [n for n in g if not left[n]]
    for n in todo:
        settled[n] = max((1 + settled[d] for d in g[n]), default=0)
        if len(parents[n]) == 1:  # one of several parents keeps all of them open
            p = parents[n][0]
            left[p] -= 1
            if not left[p]:
                todo.append(p)
    return {n: settled[n] if n in settled else _depth(g, n, settled) for n in g}


def _call_depths(g: dict) -> dict:
    """Longest way from each node without a node twice; a link back to the way counts as one step.

    Nodes that reach no cycle are settled from the ends upwards; only ways about cycles are searched.
    """
    left, back, depth = {n: len(ds) for n, ds in g.items()}, {n: [] for n in g}, {}
    for n, ds in g.items():
        for d in ds:
            back[d].append(n)
    todo = [n for n in g if not left[n]]
    for n in todo:
        depth[n] = max((1 + depth[d] for d in g[n]), default=0)
        for p in back[n]:
            left[p] -= 1
            if not left[p]:
                todo.append(p)
    settled = dict(depth)
    for root in g:
        if root in settled:
            continue
        path, on, best = [(root, iter(g[root]))], {root}, [0]
        while path:
            n, it = path[-1]
            for d in it:
                if d in settled:
                    best[-1] = max(best[-1], 1 + settled[d])
                elif d in on:
                    best[-1] = max(best[-1], 1)
                else:
                    path.append((d, iter(g[d])))
                    on.add(d)
                    best.append(0)
                    break
            else:
                path.pop()
                on.discard(n)
                b = best.pop()
                if best:
                    best[-1] = max(best[-1], 1 + b)
                else:
                    depth[root] = b
    return depth


def _per_graph(edges: DataFrame, graph: str, fn, schema: str) -> DataFrame:
    ready(edges.sparkSession)
    kind = edges.schema[graph].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = fn(_walk(pdf))
        out = pd.DataFrame(rows, columns=names)
        out.insert(0, graph, pdf[graph].iloc[0])
        return out

    return edges.select(graph, "src", "dst", "ord").groupBy(graph).applyInPandas(run, f"{graph} {kind}, {schema}")


def circular_dependencies(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    return _per_graph(edges, graph, lambda g: [(i, c) for i, c in enumerate(_cycles(g))], "n int, cycle array<string>")


def topological_order(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    return _per_graph(edges, graph, lambda g: list(enumerate(_kahn(g))), "place int, node string")


def dependency_layers(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    return _per_graph(edges, graph, lambda g: list(_depths(g).items()), "node string, depth int")


def call_depths(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    return _per_graph(edges, graph, lambda g: [(n, d) for n, d in _call_depths(g).items()], "node string, depth int")
