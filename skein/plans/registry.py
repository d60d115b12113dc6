"""Every query of the engine by name, with its SQL where SQL can state it.

"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import text as T
from skein.functions import vectors as V
from skein.operators import extract, findings, graph, lookup, metrics, patterns, retrieval
from skein.plans import synth
from skein.runtime import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return put


def _r(c, name=None):
    """Six decimals, by the same rule as the SQL side."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.floor(c * 1e6 + 0.5) / 1e6).alias(name) if name else F.floor(c * 1e6 + 0.5) / 1e6


def _key(name):
    return F.col("file_path").cast("long").alias(name)


# metrics
@query("m1_m5_complexity", """
    SELECT c_custkey AS file_key, CAST(1 + c_nationkey % 5 AS BIGINT) AS cyclomatic, CAST((c_nationkey % 5) * (c_nationkey % 5 + 1) / 2 AS BIGINT) AS cognitive,
           CAST(c_nationkey % 5 + 1 AS BIGINT) AS max_nesting, 'A' AS rating FROM customer""")
def _(spark, sf):
    m = metrics.complexity(extract.file_numbers(synth.nested_ifs(spark, sf)))
    return m.select(_key("file_key"), F.col("cyclomatic").cast("long").alias("cyclomatic"), "cognitive", "max_nesting", "rating")


@query("m6_m8_loc", """
    SELECT p_partkey AS file_key, CAST(2 + p_size % 7 + p_size % 3 AS BIGINT) AS total, CAST(p_size % 3 AS BIGINT) AS blank, CAST(2 AS BIGINT) AS source,
           CAST(p_size % 7 + 1 AS BIGINT) AS comments, (p_size % 7 + 1) / 2.0::DOUBLE AS comment_ratio FROM part""")
def _(spark, sf):
    d = metrics.loc(extract.file_numbers(synth.remarks(spark, sf)))
    return d.select(_key("file_key"), "total", "blank", "source", "comments", "comment_ratio")


HAL = "SELECT p_partkey AS file_key, CAST(p_size % 10 + 1 AS BIGINT) AS n FROM part"


@query("m9_m10_halstead", f"""
    SELECT file_key, CAST(2 AS BIGINT) AS n1, CAST(3 AS BIGINT) AS n2, 2 * n AS total_operators, 3 * n AS total_operands,
           floor(5 * n * log2(5::DOUBLE) * 1e6 + 0.5) / 1e6 AS volume, floor(1.0::DOUBLE * n * 1e6 + 0.5) / 1e6 AS difficulty, floor(5 * n * log2(5::DOUBLE) / 3000 * 1e6 + 0.5) / 1e6 AS bugs FROM ({HAL})""")
def _(spark, sf):
    h = metrics.halstead(extract.file_numbers(synth.sums(spark, sf)))
    return h.select(_key("file_key"), "n1", "n2", F.col("operators").alias("total_operators"), F.col("operands").alias("total_operands"), _r("volume", "volume"), _r("difficulty", "difficulty"), _r("bugs", "bugs"))


MI = "(171 - 5.2::DOUBLE * ln(5 * n * log2(5::DOUBLE)) - 0.23::DOUBLE - 16.2::DOUBLE * ln(n::DOUBLE)) * 100 / 171"


@query("m11_m12_maintainability", f"""
    SELECT file_key, floor(mi * 1e6 + 0.5) / 1e6 AS maintainability, CASE WHEN mi >= 85 THEN 'A' WHEN mi >= 70 THEN 'B' WHEN mi >= 50 THEN 'C' WHEN mi >= 25 THEN 'D' ELSE 'F' END AS rating
    FROM (SELECT file_key, least(100, greatest(0, {MI})) AS mi FROM ({HAL}))""")
def _(spark, sf):
    m = metrics.maintainability(metrics.file_metrics(synth.sums(spark, sf)))
    return m.select(_key("file_key"), _r("maintainability", "maintainability"), "rating")


@query("m13_quality", f"""
    SELECT file_key, (100 + CASE WHEN mi >= 85 THEN 100 WHEN mi >= 70 THEN 80 WHEN mi >= 50 THEN 60 WHEN mi >= 25 THEN 40 ELSE 20 END) / 2.0::DOUBLE AS score
    FROM (SELECT file_key, least(100, greatest(0, {MI})) AS mi FROM ({HAL}))""")
def _(spark, sf):
    m = metrics.maintainability(metrics.file_metrics(synth.sums(spark, sf)))
    return metrics.quality(m).select(_key("file_key"), "score")


@query("m14_project_metrics", f"""
    SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS total_lines, CAST(sum(n) AS BIGINT) AS source_lines, 1.0::DOUBLE AS avg_cyclomatic, CAST(1 AS BIGINT) AS max_cyclomatic FROM ({HAL})""")
def _(spark, sf):
    p = metrics.project_metrics(metrics.file_metrics(synth.sums(spark, sf)))
    return p.select("files", "total_lines", "source_lines", "avg_cyclomatic", F.col("max_cyclomatic").cast("long").alias("max_cyclomatic"))


# extraction
def _suppliers(spark, sf):
    return extract.entities(synth.supplier_classes(spark, sf))


PATH = "'pkg/s' || s_suppkey || '.py'"


@query("x1_modules", f"""
    SELECT {PATH} AS file_path, 's' || s_suppkey AS name, CAST(14 + 2 * s_nationkey AS BIGINT) AS total_lines, CAST(1 AS BIGINT) AS n_classes, CAST(s_nationkey + 1 AS BIGINT) AS n_callables, CAST(2 AS BIGINT) AS n_imports FROM supplier""")
def _(spark, sf):
    m = extract.modules(_suppliers(spark, sf))
    return m.select("file_path", "name", *(F.col(c).cast("long").alias(c) for c in ("total_lines", "n_classes", "n_callables", "n_imports")))


@query("x2_x3_imports", f"""
    SELECT {PATH} AS file_path, 'os' AS full_name, 'os' AS used_name, false AS is_from, CAST(1 AS BIGINT) AS line FROM supplier
    UNION ALL SELECT {PATH}, 'json.loads', 'js', true, 2 FROM supplier""")
def _(spark, sf):
    return extract.imports(_suppliers(spark, sf)).select("file_path", "full_name", "used_name", "is_from", F.col("line").cast("long").alias("line"))


@query("x4_classes", f"SELECT {PATH} AS file_path, 'C' || s_suppkey AS name, 'Base' || (s_nationkey % 3) AS base, 'Doc.' AS doc, false AS is_abstract, CAST(3 + 2 * s_nationkey AS BIGINT) AS lines FROM supplier")
def _(spark, sf):
    return extract.classes(_suppliers(spark, sf)).select("file_path", "name", F.element_at("bases", 1).alias("base"), "doc", "is_abstract", F.col("lines").cast("long").alias("lines"))


@query("x5_x6_x14_callables", f"""
    SELECT {PATH} AS file_path, 'fetch_' || s_suppkey AS name, 'async_function' AS entity_type, true AS is_generator, 'js,os.getcwd' AS calls, 'C' || s_suppkey AS returns FROM supplier
    UNION ALL SELECT {PATH}, 'get_m' || i, 'method', false, '', '' FROM (SELECT *, unnest(range(0, s_nationkey)) AS i FROM supplier)""")
def _(spark, sf):
    return extract.callables(_suppliers(spark, sf)).select("file_path", "name", "entity_type", "is_generator", F.array_join("calls", ",").alias("calls"), F.coalesce("returns", F.lit("")).alias("returns"))


@query("x7_parameters", f"""
    SELECT {PATH} AS file_path, 'fetch_' || s_suppkey AS name, 'p::positional_or_keyword,q:[]:positional_or_keyword,r::var_positional,s:''z'':keyword_only,t::var_keyword' AS params FROM supplier
    UNION ALL SELECT {PATH}, 'get_m' || i, 'self::positional_or_keyword,a:0:positional_or_keyword' FROM (SELECT *, unnest(range(0, s_nationkey)) AS i FROM supplier)""")
def _(spark, sf):
    one = F.transform("params", lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["default"], F.lit("")), F.lit(":"), p["kind"]))
    return extract.callables(_suppliers(spark, sf)).select("file_path", "name", F.array_join(one, ",").alias("params"))


@query("x10_x11_variables", f"""
    SELECT {PATH} AS file_path, 'LIMIT' AS name, CAST(s_nationkey AS VARCHAR) AS value, true AS is_constant, 'module' AS scope FROM supplier
    UNION ALL SELECT {PATH}, 'rows', 'None', false, 'class' FROM supplier""")
def _(spark, sf):
    return extract.variables(_suppliers(spark, sf)).select("file_path", "name", "value", "is_constant", "scope")


# patterns and smells
@query("d1_d6_design_patterns", """
    SELECT s_suppkey AS file_key, CASE s_suppkey % 6 WHEN 0 THEN 'singleton' WHEN 1 THEN 'factory' WHEN 2 THEN 'observer' WHEN 3 THEN 'strategy' ELSE 'builder' END AS pattern,
           floor(CASE s_suppkey % 6 WHEN 0 THEN 0.6 WHEN 1 THEN 0.7 WHEN 2 THEN 0.7 WHEN 3 THEN 0.9 ELSE 0.7 END::DOUBLE * 1e6 + 0.5) / 1e6 AS confidence
    FROM supplier WHERE s_suppkey % 6 <> 5""")
def _(spark, sf):
    m = extract.class_members(extract.entities(synth.supplier_patterns(spark, sf)))
    return patterns.design_patterns(m).select(_key("file_key"), "pattern", _r("confidence", "confidence"))


@query("a1_a4_anti_patterns", f"""
    SELECT {PATH} AS file_path, 'C' || s_suppkey AS entity, 'god_class' AS kind, 'low' AS severity FROM supplier WHERE s_nationkey > 20
    UNION ALL SELECT {PATH}, 'C' || s_suppkey, 'data_class', 'low' FROM supplier WHERE s_nationkey >= 3""")
def _(spark, sf):
    p = _suppliers(spark, sf)
    return patterns.anti_patterns(extract.class_members(p), extract.callables(p)).select("file_path", "entity", "kind", "severity")


@query("l1_l4_entity_smells", """
    SELECT c_custkey AS file_key, 'missing_module_docstring' AS kind FROM customer
    UNION ALL SELECT c_custkey, 'missing_docstring' FROM customer WHERE c_custkey % 6 IN (1, 2, 3)
    UNION ALL SELECT c_custkey, 'mutable_default' FROM customer WHERE c_custkey % 6 = 3""")
def _(spark, sf):
    p = extract.entities(synth.customer_notes(spark, sf))
    return patterns.entity_smells(p, extract.class_members(p), extract.callables(p)).select(_key("file_key"), "kind")


@query("l5_l9_node_smells", """
    SELECT c_custkey AS file_key, 'empty_except' AS kind, CAST(3 AS BIGINT) AS line FROM customer WHERE c_custkey % 6 = 4
    UNION ALL SELECT c_custkey, 'bare_except', 3 FROM customer WHERE c_custkey % 6 = 4
    UNION ALL SELECT c_custkey, 'magic_number', 3 FROM customer WHERE c_custkey % 6 = 5""")
def _(spark, sf):
    return patterns.node_smells(extract.found_nodes(synth.customer_notes(spark, sf))).select(_key("file_key"), "kind", F.col("line").cast("long").alias("line"))


# dead code, duplicates, security
@query("c1_c6_dead_code", """
    SELECT c_custkey AS file_key, 'unreachable_code' AS kind, 'Expr' AS name, CAST(3 AS BIGINT) AS line, 0.95::DOUBLE AS confidence FROM customer WHERE c_custkey % 6 = 2
    UNION ALL SELECT c_custkey, 'unused_import', 'sys', 2, 0.9 FROM customer WHERE c_custkey % 6 = 1""")
def _(spark, sf):
    s = synth.customer_notes(spark, sf)
    p = extract.entities(s)
    d = findings.dead_code(p, extract.imports(p), extract.callables(p), extract.found_nodes(s))
    return d.select(_key("file_key"), "kind", "name", F.col("line").cast("long").alias("line"), "confidence")


SIZES = "SELECT p_size, count(*) AS n FROM part WHERE p_size >= 4 GROUP BY p_size HAVING count(*) > 1"


@query("u1_u5_duplicates", f"SELECT n AS n_blocks, CAST(p_size + 1 AS BIGINT) AS line_count, CAST(n * (p_size + 1) AS BIGINT) AS impact FROM ({SIZES})")
def _(spark, sf):
    p = extract.entities(synth.part_functions(spark, sf))
    return findings.duplicates(findings.entity_blocks(extract.callables(p))).select("n_blocks", "line_count", "impact")


@query("u3_structural_duplicates", f"""
    SELECT CAST(p_partkey AS BIGINT) AS file_key, 'g' || p_partkey AS name, CAST(1 AS BIGINT) AS start_line, CAST(p_size + 1 AS BIGINT) AS end_line FROM part WHERE p_size IN (SELECT p_size FROM ({SIZES}))""")
def _(spark, sf):
    m = findings.duplicate_members(extract.code_blocks(synth.part_functions(spark, sf)))
    return m.select(_key("file_key"), "name", *(F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")))


@query("v1_v4_call_vulnerabilities", """
    SELECT o_orderkey AS file_key, CASE o_orderkey % 8 WHEN 0 THEN 'eval' WHEN 1 THEN 'os.system' WHEN 2 THEN 'subprocess.run' WHEN 3 THEN 'random.choice' WHEN 4 THEN 'hashlib.md5' ELSE 'exec' END AS call,
           CASE o_orderkey % 8 WHEN 1 THEN 'CWE-78' WHEN 2 THEN 'CWE-78' WHEN 3 THEN 'CWE-330' WHEN 4 THEN 'CWE-328' ELSE 'CWE-95' END AS cwe,
           CASE o_orderkey % 8 WHEN 1 THEN 'critical' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'medium' ELSE 'high' END AS severity
    FROM orders WHERE o_orderkey % 8 NOT IN (5, 7)""")
def _(spark, sf):
    c = extract.calls(synth.order_calls(spark, sf))
    return findings.call_vulnerabilities(c).select(_key("file_key"), "call", "cwe", "severity")


@query("v5_v9_node_vulnerabilities", """
    SELECT o_orderkey AS file_key, CASE WHEN o_orderkey % 8 = 7 THEN 'unsafe_yaml' ELSE 'code_injection' END AS kind, 'high' AS severity, CAST(2 AS BIGINT) AS line FROM orders WHERE o_orderkey % 8 IN (0, 6, 7)""")
def _(spark, sf):
    d = findings.node_vulnerabilities(extract.found_nodes(synth.order_calls(spark, sf)))
    return d.select(_key("file_key"), "kind", "severity", F.col("line").cast("long").alias("line"))


@query("v12_secrets", "SELECT c_custkey AS file_key, 'PASSWORD' AS name, 'password' AS secret_type, CAST(1 AS BIGINT) AS line_number FROM customer WHERE c_custkey % 6 = 0")
def _(spark, sf):
    d = findings.secrets(extract.variables(extract.entities(synth.customer_notes(spark, sf))))
    return d.select(_key("file_key"), "name", "secret_type", F.col("line_number").cast("long").alias("line_number"))


# graphs
def _classified(spark, sf):
    s = synth.nation_imports(spark, sf)
    return graph.classify_imports(extract.imports(extract.entities(s)), s)


NFILE = "'nations/n' || n_nationkey || '.py'"


@query("g1_g4_import_kinds", f"""
    SELECT {NFILE} AS file_path, 'os' AS full_name, 'stdlib' AS kind, NULL AS target, true AS resolvable FROM nation
    UNION ALL SELECT {NFILE}, 'numpy', 'third_party', NULL, false FROM nation
    UNION ALL SELECT {NFILE}, 'regions.r' || n_regionkey || '.' || x, 'local', 'regions/r' || n_regionkey || '.py', true FROM nation, (VALUES ('name'), ('size')) AS v(x)
    UNION ALL SELECT {NFILE}, 'n' || ((n_nationkey + 1) % 25) || '.f', 'local', 'nations/n' || ((n_nationkey + 1) % 25) || '.py', true FROM nation""")
def _(spark, sf):
    return _classified(spark, sf).select("file_path", "full_name", "kind", "target", "resolvable")


@query("g6_g10_module_edges", f"""
    SELECT {NFILE} AS src, 'regions/r' || n_regionkey || '.py' AS dst, CAST(2 AS BIGINT) AS weight, 'name,size' AS names FROM nation
    UNION ALL SELECT {NFILE}, 'nations/n' || ((n_nationkey + 1) % 25) || '.py', 1, 'f' FROM nation""")
def _(spark, sf):
    return graph.module_edges(_classified(spark, sf)).select("src", "dst", "weight", F.array_join("names", ",").alias("names"))


@query("g5_call_edges", """
    SELECT 's' || s_suppkey || '.py:s' || s_suppkey AS src, 'n' || s_nationkey || '.py:n' || s_nationkey AS dst FROM supplier
    UNION ALL SELECT 's' || s_suppkey || '.py:s' || s_suppkey, 'external.outside' FROM supplier""")
def _(spark, sf):
    return graph.call_edges(extract.callables(extract.entities(synth.supplier_calls(spark, sf))))


def _halves(spark, sf):
    return read(spark, sf, "customer").where("c_custkey > 1").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 2).alias("dst"))


@query("g18_g19_ancestors", """
    WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 2 AS dst FROM customer WHERE c_custkey > 1),
    r AS (SELECT src, dst, 1 AS level FROM e UNION SELECT r.src, e.dst, level + 1 FROM r JOIN e ON r.dst = e.src)
    SELECT src, CAST(dst AS BIGINT) AS dst, CAST(min(level) AS BIGINT) AS level FROM r GROUP BY src, dst""")
def _(spark, sf):
    return graph.closure(_halves(spark, sf)).select("src", "dst", F.col("level").cast("long").alias("level"))


def _ring(spark, sf):
    """Customers of a nation in a ring, by key."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    c = read(spark, sf, "customer")
    low = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("low"))
    return c.withColumn("next", F.lead("c_custkey").over(w)).join(low, "c_nationkey").select(F.col("c_nationkey").alias("graph_id"), F.col("c_custkey").cast("string").alias("src"), F.coalesce("next", "low").cast("string").alias("dst"), F.col("c_custkey").alias("ord"), F.col("next").isNull().alias("closing"))


@query("g14_circular_dependencies", "SELECT c_nationkey AS graph_id, CAST(count(*) + 1 AS BIGINT) AS nodes, CAST(min(c_custkey) AS VARCHAR) AS head FROM customer GROUP BY 1")
def _(spark, sf):
    return graph.circular_dependencies(_ring(spark, sf)).select("graph_id", F.size("cycle").cast("long").alias("nodes"), F.element_at("cycle", 1).alias("head"))


@query("g16_topological_order", """
    SELECT c_nationkey AS graph_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS place, CAST(c_custkey AS VARCHAR) AS node
    FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE n > 1""")
def _(spark, sf):
    return graph.topological_order(_ring(spark, sf).where("not closing")).select("graph_id", F.col("place").cast("long").alias("place"), "node")


@query("g15_g17_layers", """
    SELECT c_nationkey AS graph_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1 AS BIGINT) AS depth, CAST(c_custkey AS VARCHAR) AS node
    FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) WHERE n > 1""")
def _(spark, sf):
    return graph.dependency_layers(_ring(spark, sf).where("not closing")).select("graph_id", F.col("depth").cast("long").alias("depth"), "node")


def _nations(spark, sf):
    """Nations of a region in a ring, two steps at a time as well."""
    n = read(spark, sf, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = n.withColumn("i", F.row_number().over(w)).select("n_regionkey", "n_nationkey", "i")
    b = n.select("n_regionkey", F.col("n_nationkey").alias("dst"), F.col("i").alias("j"))
    return n.join(b, "n_regionkey").where("j = i % 5 + 1").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("i").alias("ord"))


@query("g11_call_depth", "SELECT n_regionkey AS graph_id, CAST(n_nationkey AS VARCHAR) AS node, count(*) OVER (PARTITION BY n_regionkey) AS depth FROM nation")
def _(spark, sf):
    return graph.call_depths(_nations(spark, sf)).select("graph_id", "node", F.col("depth").cast("long").alias("depth"))


@query("g12_recursive_nodes", "SELECT CAST(n_nationkey AS VARCHAR) AS node, CAST((SELECT min(CAST(m.n_nationkey AS VARCHAR)) FROM nation m WHERE m.n_regionkey = n.n_regionkey) AS VARCHAR) AS scc FROM nation n")
def _(spark, sf):
    return graph.strong_components(_nations(spark, sf))


@query("g20_diamonds", """
    SELECT s_suppkey AS node, CAST(-100 - n_regionkey AS BIGINT) AS ancestor FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1
           AND n_regionkey = (SELECT m.n_regionkey FROM nation m WHERE m.n_nationkey = (s_nationkey + 1) % 25)
    UNION ALL SELECT s_suppkey, -1000 FROM supplier WHERE s_suppkey % 2 = 1""")
def _(spark, sf):
    """Suppliers inherit from their nation and, odd ones, from the next; nations from their region; regions from one root."""
    s, n = read(spark, sf, "supplier"), read(spark, sf, "nation")
    own = s.select(F.col("s_suppkey").alias("src"), (-F.col("s_nationkey") - 1).cast("long").alias("dst"))
    nxt = s.select("s_suppkey", (-F.pmod(F.col("s_nationkey") + F.col("s_suppkey") % 2, F.lit(25)) - 1).cast("long"))
    up = n.select((-F.col("n_nationkey") - 1).cast("long"), (-100 - F.col("n_regionkey")).cast("long"))
    top = n.select((-100 - F.col("n_regionkey")).cast("long"), F.lit(-1000).cast("long"))
    e = own.union(nxt).union(up).union(top).distinct()
    many = e.groupBy(F.col("src").alias("node")).count().where("count > 1")
    par = e.join(many.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    return graph.diamonds(e, graph.closure(e, start=par))


# lookup and reports
def _asked(spark, sf, question):
    p = _suppliers(spark, sf)
    return lookup.ask(question, extract.classes(p), extract.callables(p), extract.imports(p)).select("kind", "name", "file_path")


@query("q1_find_functions", f"SELECT 'function' AS kind, 'fetch_' || s_suppkey AS name, {PATH} AS file_path FROM supplier WHERE ('fetch_' || s_suppkey) LIKE '%fetch_1%'")
def _(spark, sf):
    return _asked(spark, sf, "find functions named fetch_1")


@query("q2_find_classes", f"SELECT 'class' AS kind, 'C' || s_suppkey AS name, {PATH} AS file_path FROM supplier WHERE ('c' || s_suppkey) LIKE '%c1%'")
def _(spark, sf):
    return _asked(spark, sf, "Find all classes called C1")


@query("q3_find_methods", f"SELECT 'method' AS kind, 'C' || s_suppkey || '.get_m7' AS name, {PATH} AS file_path FROM supplier WHERE s_nationkey > 7")
def _(spark, sf):
    return _asked(spark, sf, "find method get_m7")


@query("q4_list_async", f"SELECT 'function' AS kind, 'fetch_' || s_suppkey AS name, {PATH} AS file_path FROM supplier")
def _(spark, sf):
    return _asked(spark, sf, "list all async functions")


@query("q6_list_inheriting", f"SELECT 'class' AS kind, 'C' || s_suppkey AS name, {PATH} AS file_path FROM supplier WHERE s_nationkey % 3 = 1")
def _(spark, sf):
    return _asked(spark, sf, "list classes that inherit from Base1")


@query("q7_show_imports", f"SELECT 'import' AS kind, 'json.loads' AS name, {PATH} AS file_path FROM supplier")
def _(spark, sf):
    return _asked(spark, sf, "show imports of json")


@query("q8_search", f"""
    SELECT 'class' AS kind, 'C' || s_suppkey AS name, {PATH} AS file_path FROM supplier WHERE 'c' || s_suppkey LIKE '%c1%'""")
def _(spark, sf):
    return _asked(spark, sf, "search c1")


@query("r1_module_summaries", f"""
    SELECT {PATH} AS file_path, 'Module: s' || s_suppkey || chr(10) || 'File: ' || {PATH} || chr(10) || 'Classes: 1, functions: 1, lines: ' || (14 + 2 * s_nationkey) || chr(10) || 'Imports:' || chr(10) || '  - os' || chr(10) || '  - json.loads'
           || chr(10) || 'Classes:' || chr(10) || '  - C' || s_suppkey || chr(10) || 'Functions:' || chr(10) || '  - fetch_' || s_suppkey AS summary FROM supplier""")
def _(spark, sf):
    return lookup.module_summaries(_suppliers(spark, sf))


@query("r3_r7_project_summary", "SELECT count(*) AS modules, CAST(sum(14 + 2 * s_nationkey) AS BIGINT) AS lines, count(*) AS classes, count(*) AS functions FROM supplier")
def _(spark, sf):
    return lookup.project_summary(_suppliers(spark, sf)).select("modules", "lines", "classes", "functions")


# chunks and retrieval
@query("k1_k5_chunks", """
    SELECT 'module' AS entity_type, count(*) AS n FROM supplier UNION ALL SELECT 'class', count(*) FROM supplier UNION ALL SELECT 'function', count(*) FROM supplier
    UNION ALL SELECT 'method', CAST(sum(s_nationkey) AS BIGINT) FROM supplier WHERE s_nationkey > 3""")
def _(spark, sf):
    return retrieval.chunks(_suppliers(spark, sf)).groupBy("entity_type").agg(F.count("*").alias("n"))


@query("k6_chunk_ids", f"SELECT substr(md5({PATH} || ':class:C' || s_suppkey), 1, 16) AS chunk_id, 'C' || s_suppkey AS entity_name FROM supplier")
def _(spark, sf):
    return retrieval.chunks(_suppliers(spark, sf)).where("entity_type = 'class'").select("chunk_id", "entity_name")


@query("e1_hash_embedding", """
    WITH h AS (SELECT c_custkey, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(c_name), CAST(i * 2 + 1 AS INT), 2))::INT / 127.5::DOUBLE - 1) AS v FROM customer)
    SELECT c_custkey, list_transform(v, lambda x: floor(x / sqrt(list_sum(list_transform(v, lambda y: y * y))) * 1e6 + 0.5) / 1e6) AS embedding FROM h""")
def _(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", F.transform(V.hash_embedding(F.col("c_name"), 8), lambda x: _r(x)).alias("embedding"))


CENTRES = """c AS (SELECT label, list(m ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def _centres(spark, sf):
    e = read(spark, sf, "embeddings").select(F.col("label").alias("query_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    m = e.groupBy("query_id", "i").agg(F.avg("x").alias("m"))
    return m.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))  # as many as the vectors' length


@query("t1_cosine", f"WITH {CENTRES} SELECT e.vec_id, floor(list_cosine_similarity(e.embedding::DOUBLE[], c.qv) * 1e6 + 0.5) / 1e6 AS score FROM embeddings e JOIN c USING (label)")
def _(spark, sf):
    e = read(spark, sf, "embeddings").join(_centres(spark, sf).withColumnRenamed("query_id", "label").withColumnRenamed("embedding", "qv"), "label")
    return e.select("vec_id", _r(V.cosine(F.col("embedding").cast("array<double>"), F.col("qv")), "score"))


SEM = f"""WITH {CENTRES}, s AS (SELECT c.label AS query_id, CAST(e.vec_id AS VARCHAR) AS chunk_id, list_cosine_similarity(e.embedding::DOUBLE[], c.qv) AS score FROM embeddings e, c),
    sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""


def _semantic(spark, sf, k):
    e = read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return retrieval.semantic(e, _centres(spark, sf), k, -1.0)


@query("t2_semantic_top_k", f"{SEM} SELECT query_id, chunk_id, rank, floor(score * 1e6 + 0.5) / 1e6 AS score FROM sem WHERE rank <= 10")
def _(spark, sf):
    return _semantic(spark, sf, 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), _r("score", "score"))


STOPS = ", ".join(f"'{x}'" for x in T.STOP)
WORDS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z_][a-z0-9_]*$') AND length(x) > 2 AND NOT list_contains([{1}], x))"


@query("t3_keywords", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {WORDS.format('text', STOPS)} AS w FROM documents)")
def _(spark, sf):
    w = T.keywords(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


KEYWORD = f"""
    q AS (SELECT item_id AS query_id, {WORDS.format('text', STOPS)} AS terms FROM benchmark),
    d AS (SELECT CAST(turn AS VARCHAR) || ':' || conv_id AS chunk_id, lower(text) AS low FROM conversations),
    k AS (SELECT query_id, chunk_id, list_sum(list_transform(terms, lambda t: CASE WHEN contains(low, t) THEN (1 + (length(low) - length(replace(low, t, ''))) / length(t)::DOUBLE) / (1 + len(terms)) ELSE 0 END))
          * CASE WHEN len(terms) > 0 AND len(list_filter(terms, lambda t: NOT contains(low, t))) = 0 THEN 1.5 ELSE 1 END AS score FROM d, q),
    kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM k WHERE score > 0)"""


def _keyword(spark, sf, k):
    d = read(spark, sf, "conversations").select(F.concat(F.col("turn").cast("string"), F.lit(":"), "conv_id").alias("chunk_id"), F.col("text").alias("content"))
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.keyword(d, q, k)


@query("t4_t5_keyword_top_k", f"WITH {KEYWORD} SELECT query_id, chunk_id, rank, floor(least(1, score) * 1e6 + 0.5) / 1e6 AS score FROM kw WHERE rank <= 10")
def _(spark, sf):
    return _keyword(spark, sf, 10).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), _r("score", "score"))


@query("t7_rank_fusion", """
    WITH a AS (SELECT c_nationkey AS query_id, CAST(c_custkey AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r1 FROM customer),
    b AS (SELECT c_nationkey AS query_id, CAST(c_custkey AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS r2 FROM customer)
    SELECT query_id, chunk_id, floor((coalesce(0.7::DOUBLE / (60 + r1), 0) + coalesce((1 - 0.7::DOUBLE) / (60 + r2), 0)) * 1e6 + 0.5) / 1e6 AS score
    FROM (SELECT * FROM a WHERE r1 <= 20) a FULL JOIN (SELECT * FROM b WHERE r2 <= 20) b USING (query_id, chunk_id)""")
def _(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").cast("string").alias("chunk_id"), "c_acctbal", "c_name", "c_custkey")
    w = Window.partitionBy("query_id")
    a = c.withColumn("rank", F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey"))).where("rank <= 20")
    b = c.withColumn("rank", F.row_number().over(w.orderBy("c_name", "c_custkey"))).where("rank <= 20")
    return retrieval.fuse(a, b).select("query_id", "chunk_id", _r("score", "score"))


@query("t10_contexts", """
    WITH r AS (SELECT conv_id AS query_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM conversations),
    p AS (SELECT query_id, turn, CASE WHEN e <= 900 THEN text WHEN 900 - (e - length(text)) > 200 THEN left(text, CAST(900 - (e - length(text)) AS BIGINT)) || '...' END AS piece FROM r)
    SELECT query_id, md5(string_agg(piece, chr(10) || '---' || chr(10) ORDER BY turn)) AS context FROM p WHERE piece IS NOT NULL GROUP BY query_id""")
def _(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("rank"), F.col("text").alias("content"))
    return retrieval.contexts(c.select("query_id", "chunk_id", "rank"), c.select("chunk_id", "content"), 900).select("query_id", F.md5("context").alias("context"))


@query("t6_inverted_index", f"""
    WITH w AS (SELECT CAST(turn AS VARCHAR) || ':' || conv_id AS chunk_id, {WORDS.format('text', STOPS)} AS w FROM conversations), x AS (SELECT chunk_id, len(w) AS n, unnest(w) AS term FROM w)
    SELECT term, chunk_id, floor(count(*) / n::DOUBLE * 1e6 + 0.5) / 1e6 AS tf FROM x GROUP BY term, chunk_id, n""")
def _(spark, sf):
    d = read(spark, sf, "conversations").select(F.concat(F.col("turn").cast("string"), F.lit(":"), "conv_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.inverted_index(d).select("term", "chunk_id", _r("tf", "tf"))


@query("t8_rerank", f"""
    WITH {KEYWORD}, u AS (SELECT query_id, list_distinct(terms) AS terms FROM q), b AS (SELECT item_id AS query_id, lower(text) AS qt FROM benchmark),
    r AS (SELECT kw.query_id, kw.chunk_id, kw.rank, least(1, kw.score) + CASE WHEN contains(d.low, b.qt) THEN 0.3 ELSE 0 END::DOUBLE
          + 0.2::DOUBLE * coalesce(len(list_filter(u.terms, lambda t: contains(d.low, t))) / nullif(len(u.terms), 0)::DOUBLE, 0) AS score
          FROM kw JOIN d USING (chunk_id) JOIN u USING (query_id) JOIN b USING (query_id) WHERE kw.rank <= 10)
    SELECT query_id, chunk_id, floor(score * 1e6 + 0.5) / 1e6 AS score FROM r""")
def _(spark, sf):
    d = read(spark, sf, "conversations").select(F.concat(F.col("turn").cast("string"), F.lit(":"), "conv_id").alias("chunk_id"), F.col("text").alias("content"), F.lit("").alias("entity_name"))
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.rerank(retrieval.keyword(d, q, 10), d, q).select("query_id", "chunk_id", _r("score", "score"))


def _vectors(text, of):
    """The stand-in embedding in SQL, 8 numbers."""
    return f"SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256({text}), CAST(i * 2 + 1 AS INT), 2))::INT / 127.5::DOUBLE - 1) AS v FROM {of}"


@query("t9_hybrid", f"""
    WITH {KEYWORD}, dv AS ({_vectors("text", "(SELECT CAST(turn AS VARCHAR) || ':' || conv_id AS chunk_id, text, lower(role) AS name FROM conversations)")}), qv AS ({_vectors("text", "(SELECT item_id AS query_id, text FROM benchmark)")}),
    sc AS (SELECT query_id, chunk_id, list_cosine_similarity(dv.v, qv.v) AS s FROM dv, qv),
    sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r1 FROM sc), se AS (SELECT query_id, chunk_id, r1 FROM sr WHERE r1 <= 20 AND s >= 0),
    ke AS (SELECT query_id, chunk_id, rank AS r2 FROM kw WHERE rank <= 20),
    fu AS (SELECT query_id, chunk_id, coalesce(0.7::DOUBLE / (60 + r1), 0) + coalesce((1 - 0.7::DOUBLE) / (60 + r2), 0) AS f, r1, r2 FROM se FULL JOIN ke USING (query_id, chunk_id)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, r1 NULLS LAST, r2 NULLS LAST) AS rank0 FROM fu),
    u AS (SELECT query_id, list_distinct(terms) AS terms FROM q), b AS (SELECT item_id AS query_id, lower(text) AS qt FROM benchmark),
    re AS (SELECT fr.query_id, fr.chunk_id, fr.rank0, f + CASE WHEN contains(d.low, b.qt) THEN 0.3 ELSE 0 END::DOUBLE + 0.2::DOUBLE * coalesce(len(list_filter(u.terms, lambda t: contains(d.low, t))) / nullif(len(u.terms), 0)::DOUBLE, 0)
           + CASE WHEN len(list_filter(u.terms, lambda t: contains(dv.name, t))) > 0 THEN 0.2 ELSE 0 END::DOUBLE AS score FROM fr JOIN d USING (chunk_id) JOIN dv USING (chunk_id) JOIN u USING (query_id) JOIN b USING (query_id))
    SELECT query_id, floor(score * 1e6 + 0.5) / 1e6 AS score, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank0) AS rank FROM re) WHERE rank <= 10""")
def _(spark, sf):
    d = retrieval.embed(read(spark, sf, "conversations").select(F.concat(F.col("turn").cast("string"), F.lit(":"), "conv_id").alias("chunk_id"), F.col("text").alias("content"), F.col("role").alias("entity_name")), dimension=8)
    q = retrieval.embed(read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), col="text", dimension=8)
    return retrieval.hybrid(d, q, threshold=0.0).select("query_id", F.col("rank").cast("long").alias("rank"), _r("score", "score"))


@query("x8_decorators", """
    SELECT s_suppkey AS file_key, 'get_instance' AS name, 'classmethod' AS decorator FROM supplier WHERE s_suppkey % 6 = 0
    UNION ALL SELECT s_suppkey, 'run', 'abstractmethod' FROM supplier WHERE s_suppkey % 6 = 3""")
def _(spark, sf):
    c = extract.callables(extract.entities(synth.supplier_patterns(spark, sf)))
    return c.select(_key("file_key"), "name", F.explode("decorators").alias("d")).select("file_key", "name", F.col("d.name").alias("decorator"))


@query("x9_docstrings", r"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g') AS t FROM documents)
    SELECT doc_id, md5(split_part(t, chr(10), 1)) AS summary, md5(nullif(regexp_replace(substr(t, length(split_part(t, chr(10), 1)) + 2), '^[\s\x0B\x1C-\x1F\x{85}\p{Z}]+|[\s\x0B\x1C-\x1F\x{85}\p{Z}]+$', '', 'g'), '')) AS description FROM t""")
def _(spark, sf):
    d = T.docstring(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(d["summary"]).alias("summary"), F.md5(d["description"]).alias("description"))


@query("q5_list_abstract", """
    SELECT 'class' AS kind, 'RunStrategy' AS name, CAST(s_suppkey AS VARCHAR) AS file_path FROM supplier WHERE s_suppkey % 6 = 3
    UNION ALL SELECT 'method', 'RunStrategy.run', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 6 = 3""")
def _(spark, sf):
    p = extract.entities(synth.supplier_patterns(spark, sf))
    return lookup.ask("list all abstract classes", extract.classes(p), extract.callables(p), extract.imports(p)).select("kind", "name", "file_path")


@query("r2_class_summaries", f"""
    SELECT {PATH} AS file_path, 'Class: C' || s_suppkey || '(Base' || (s_nationkey % 3) || ')' || chr(10) || 'Doc.' || CASE WHEN s_nationkey > 0 THEN chr(10) || 'Methods:' || chr(10)
           || array_to_string(list_transform(range(0, least(8, s_nationkey)), lambda i: '  - get_m' || i), chr(10)) ELSE '' END || CASE WHEN s_nationkey > 8 THEN chr(10) || '  ... and ' || (s_nationkey - 8) || ' more' ELSE '' END AS summary FROM supplier""")
def _(spark, sf):
    return lookup.class_summaries(extract.class_members(_suppliers(spark, sf))).select("file_path", "summary")


@query("r2_function_summaries", f"SELECT {PATH} AS file_path, 'async def fetch_' || s_suppkey || '(p, q, r, s: str, t) -> C' || s_suppkey || chr(10) || 'generator' AS summary FROM supplier")
def _(spark, sf):
    return lookup.function_summaries(extract.callables(_suppliers(spark, sf))).select("file_path", "summary")


@query("g8_successors", "SELECT 'n' || n_nationkey || '.py:n' || n_nationkey AS node, count(s_suppkey) AS callers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def _(spark, sf):
    e = graph.call_edges(extract.callables(extract.entities(synth.supplier_calls(spark, sf))))
    return e.where("dst not like 'external.%'").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("callers"))


# scalar helpers
@query("n1_normalize_whitespace", r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]+', ' ', 'g'))) AS digest FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.normalize_whitespace(F.col("text"))).alias("digest"))


@query("n2_count_lines", r"""
    WITH x AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r]') AS p FROM documents), y AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM x)
    SELECT doc_id, CAST(len(l) AS BIGINT) AS total, CAST(len(list_filter(l, lambda s: trim(s) = '')) AS BIGINT) AS blank FROM y""")
def _(spark, sf):
    c = T.count_lines(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", c["total"].alias("total"), c["blank"].alias("blank"))


@query("n3_truncate", "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE substr(text, 1, 197) || '...' END AS short FROM documents")
def _(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.truncate(F.col("text"), 200).alias("short"))


@query("n4_identifiers", r"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter(string_split_regex(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_matches(x, '^[a-zA-Z_][a-zA-Z0-9_]*$')) AS w FROM documents)")
def _(spark, sf):
    w = T.identifiers(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("digest"))


@query("n5_snake_case", r"SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(p_type, ' ', '') || 'Name2Id', '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM part")
def _(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.snake_case(F.concat(F.replace("p_type", F.lit(" "), F.lit("")), F.lit("Name2Id"))).alias("snake"))


@query("n6_camel_case", r"""
    SELECT event_id, array_to_string(list_transform(string_split(event_type || '_value', '_'), lambda x: upper(x[1]) || lower(x[2:])), '') AS pascal, event_type || 'Value' AS camel FROM events""")
def _(spark, sf):
    c = F.concat("event_type", F.lit("_value"))
    return read(spark, sf, "events").select("event_id", T.pascal_case(c).alias("pascal"), T.camel_case(c).alias("camel"))


@query("s3_content_hash", "SELECT page_id, md5(html) AS content_md5, CAST(length(html) // 4 AS BIGINT) AS token_estimate FROM pages")
def _(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.md5("html").alias("content_md5"), T.token_estimate(F.col("html")).alias("token_estimate"))


@query("s17_test_paths", "SELECT s_suppkey, s_suppkey % 3 = 0 AS is_test, CASE WHEN s_suppkey % 4 = 0 THEN 'private' WHEN s_suppkey % 4 = 1 THEN 'protected' ELSE 'public' END AS visibility FROM supplier")
def _(spark, sf):
    path = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("a/test_"), "s_suppkey", F.lit(".py"))).otherwise(F.concat(F.lit("a/best_"), "s_suppkey", F.lit(".py")))
    name = F.when(F.col("s_suppkey") % 4 == 0, "__x").when(F.col("s_suppkey") % 4 == 1, "__x__").otherwise("x")
    return read(spark, sf, "supplier").select("s_suppkey", T.is_test_path(path).alias("is_test"), T.visibility(name).alias("visibility"))


from skein.plans import cases  # noqa: E402, F401  (its queries enter themselves)


def flagship(spark, sf_dir):
    return QUERIES["v1_v4_call_vulnerabilities"](spark, sf_dir).orderBy("file_key")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
