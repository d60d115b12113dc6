import pytest

from skein.operators import extract, findings, graph, metrics, patterns
from skein.plans.engine import Engine
from skein.sources.files import DEMO, Settings, demo_sources, find_files, new_or_changed, read_sources

CODE = '''"""Top."""
import os
import sys as system
from typing import Optional, List
from . import sibling
from .pkg import *

LIMIT = 3
a, b = 1, 2
note: str = "x"


class Base(ABC):
    """A base."""
    _instance = None

    @abstractmethod
    def one(self, /, p, *, k=1, **rest): ...

    @property
    def two(self):
        yield 1

    class Inner:
        def deep(self): pass


@wrap("q", n=2)
async def go(x: int = 1, *args) -> List[int]:
    def inner():
        return os.getcwd()
    y = inner()
    return y

if LIMIT:
    def late(): return eval("1")
'''


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("pkg/m.py", CODE), ("bad.py", "def f(:\n"), ("empty.py", ""), ("none.py", None), ("deep.py", "x = " + "(" * 90 + "1" + ")" * 90)]
    return extract.entities(spark.createDataFrame([(*r, 1) for r in rows], "file_path string, content string, name int")).cache()


def test_imports(parsed):
    got = [(r.module, r.name, r.alias, r.level, r.used_name) for r in extract.imports(parsed).orderBy("ord").collect()]
    assert got == [("os", None, None, 0, "os"), ("sys", None, "system", 0, "system"), ("typing", "Optional", None, 0, "Optional"), ("typing", "List", None, 0, "List"), ("", "sibling", None, 1, "sibling"), ("pkg", "*", None, 1, "*")]


def test_callables(parsed):
    c = {r.name: r for r in extract.callables(parsed).where("file_path = 'pkg/m.py'").collect()}
    assert set(c) == {"one", "two", "deep", "go", "late"}
    assert c["one"].is_abstract and [(p.name, p.kind) for p in c["one"].params] == [("self", "positional_only"), ("p", "positional_or_keyword"), ("k", "keyword_only"), ("rest", "var_keyword")]
    assert c["two"].entity_type == "property" and c["two"].is_generator and c["two"].class_name == "Base"
    assert c["deep"].class_name == "Inner" and c["deep"].class_depth == 1
    assert c["go"].entity_type == "async_function" and c["go"].calls == ["inner", "os.getcwd", "wrap"] and c["go"].locals == ["y"]
    assert c["go"].decorators[0].keywords == {"n": "2"} and c["go"].returns == "List[int]"


def test_classes_variables_errors(parsed):
    k = {r.name: r for r in extract.classes(parsed).collect()}
    assert k["Base"].is_abstract and k["Inner"].depth == 1 and k["Inner"].parent_ord == 0
    v = {r.name: r for r in extract.variables(parsed).where("file_path = 'pkg/m.py'").collect()}
    assert v["LIMIT"].is_constant and v["LIMIT"].value == "3" and v["a"].value is None and v["note"].annotation == "str" and v["_instance"].scope == "class"
    assert [(r.file_path, r.error_line) for r in extract.errors(parsed).collect()] == [("bad.py", 1)]
    assert extract.modules(parsed).count() == 4


def test_metrics_by_hand(spark):
    code = 'def f(a, b):\n    """Doc."""\n    if a and b:\n        for i in a:\n            if i:\n                return [x for x in b if x]\n    return a if b else 1\n'
    s = spark.createDataFrame([("a", code), ("bad", "def ("), ("e", "")], "file_path string, content string")
    n = extract.ast_nodes(s)
    c = {r.file_path: (r.cyclomatic, r.cognitive, r.max_nesting) for r in metrics.complexity(n).collect()}
    assert c == {"a": (1 + 1 + 1 + 1 + 1 + 2 + 1, 1 + 1 + 2 + 3 + 1, 4), "bad": (1, 0, 0), "e": (1, 0, 0)}
    lines = {r.file_path: r for r in metrics.loc(extract.line_counts(s)).collect()}
    assert (lines["a"].total, lines["a"].docstrings, lines["a"].source) == (7, 1, 7)
    f = {r.file_path: r for r in metrics.file_metrics(s).collect()}
    assert f["e"].maintainability == 100 and 0 < f["a"].maintainability < 100


def test_rules(spark):
    code = 'import pickle, yaml, subprocess\nQ = "select * from t where x = %s" % y\nsubprocess.run(c, shell=True)\npickle.loads(z)\nyaml.load(f)\nyaml.load(f, Loader=L)\ndef g():\n    global a, b\n    while 1:\n        return 1\n        b = 2\n    else:\n        raise x\n        c = 3\n'
    n = extract.ast_nodes(spark.createDataFrame([("a", code)], "file_path string, content string"))
    assert sorted((r.kind, r.line) for r in findings.node_vulnerabilities(n).collect()) == [("shell_true", 3), ("sql_injection", 2), ("unsafe_pickle", 4), ("unsafe_yaml", 5)]
    assert sorted((r.kind, r.detail) for r in patterns.node_smells(n).collect()) == [("global_statement", "a"), ("global_statement", "b"), ("magic_number", "3")]
    assert sorted(r.line for r in n.where("rule = 'unreachable'").collect()) == [11, 14]


def test_duplicates_drop_overlaps(spark):
    b = spark.createDataFrame([("a", "x", 1, 9, "h"), ("a", "y", 5, 12, "h"), ("b", "z", 1, 9, "h"), ("c", "w", 1, 9, "g"), ("c", "v", 3, 9, "g")], "file_path string, name string, start_line int, end_line int, hash string")
    got = findings.duplicates(b).collect()
    assert [(r.hash, r.n_blocks, r.line_count, r.first_file) for r in got] == [("h", 2, 9, "a")]
    assert sorted((r.hash, r.file_path, r.name) for r in findings.duplicate_members(b).collect()) == [("h", "a", "x"), ("h", "b", "z")]


def test_relative_imports_and_graph(spark):
    s = spark.createDataFrame([("p/__init__.py", "from .a import f\n"), ("p/a.py", "from . import b\nfrom ..q import c\nimport p.b\n"), ("p/b.py", "from .a import f\nimport nowhere\n"), ("q.py", "")], "file_path string, content string")
    i = graph.classify_imports(extract.imports(extract.entities(s)), s)
    got = {(r.file_path, r.full_name): (r.kind, r.target) for r in i.collect()}
    assert got["p/__init__.py", "a.f"] == ("local", "p/a.py") and got["p/a.py", "q.c"] == ("local", "q.py") and got["p/a.py", "p.b"] == ("local", "p/b.py") and got["p/b.py", "nowhere"] == ("third_party", None)
    e = graph.module_edges(i)
    assert {(r.src, r.dst) for r in e.collect()} >= {("p/a.py", "p/b.py"), ("p/b.py", "p/a.py"), ("p/__init__.py", "p/a.py")}
    assert {r.node for r in graph.recursive_nodes(e).collect()} >= {"p/a.py", "p/b.py"}


def test_graph_orders():
    g = {"a": ["b", "c"], "b": ["d"], "c": ["d"], "d": []}
    assert graph._kahn(g) == ["a", "b", "c", "d"] and graph._depth(g, "a") == 2 and graph._call_depths(g) == {"a": 2, "b": 1, "c": 1, "d": 0}
    assert graph._cycles({"a": ["b"], "b": ["c"], "c": ["a", "b"]}) == [["a", "b", "c", "a"], ["b", "c", "b"]]
    assert graph._call_depths({"a": ["a"]}) == {"a": 1}
    chain = {str(k): [str(k + 1)] for k in range(3000)} | {"3000": []}
    assert graph._call_depths(chain)["0"] == 3000 and graph._depth(chain, "0") == 3000


def test_call_depths_equal_the_recursive_rule():
    import random

    def rule(g, n, path):
        return 0 if n in path else max((1 + rule(g, d, path | {n}) for d in g[n]), default=0)

    rng = random.Random(1)
    for _ in range(60):
        g = {str(k): [str(x) for x in rng.sample(range(7), rng.randrange(3))] for k in range(7)}
        assert graph._call_depths(g) == {n: rule(g, n, frozenset()) for n in g}


def test_strong_and_weak_components(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(48)] + [(50, 50), (60, 61)]
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = {x for p in edges for x in p}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for d in {b for a, b in edges if a == todo[-1]} - reach[n] if todo else ():
                reach[n].add(d)
                todo.insert(0, d)
            todo.pop()
    want = {n: min({m for m in reach[n] if n in reach[m]} | {n}) for n in nodes if n in reach[n]}
    assert {r.node: r.scc for r in graph.strong_components(e).collect()} == want
    pairs = {(r.src, r.dst) for r in graph.closure(e).collect()}
    assert pairs == {(n, d) for n in nodes for d in reach[n]}
    assert {(r.src, r.dst) for r in graph.closure(e, start=spark.createDataFrame([(60,), (50,)], "node long")).collect()} == {(60, 61), (50, 50)}
    root = {r.node: r.root for r in graph.connected(e).collect()}
    assert set(root) == nodes and all(root[a] == root[b] for a, b in edges) and all(root[root[n]] == root[n] <= n for n in nodes)
    assert len(set(root.values())) == len(nodes) - sum(1 for n in nodes if root[n] != n)
    assert graph.connected(e.where("false")).count() == 0 and graph.strong_components(e.where("false")).count() == 0


def test_directory_engine_and_cache(spark, tmp_path):
    for p, t in DEMO.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    (tmp_path / "shop/latin.py").write_bytes(b"x = '\xe9'\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden/x.py").write_text("1")
    assert len(find_files(tmp_path)) == 5
    s = read_sources(spark, tmp_path)
    assert {r.file_path for r in s.collect()} == {*DEMO, "shop/latin.py"}
    assert s.where("file_path = 'shop/latin.py'").first().content == "x = 'é'\n"
    assert new_or_changed(s, s.where("file_path <> 'shop/cart.py'")).count() == 1
    a = Engine(spark).analyze_directory(tmp_path)
    assert {r.call for r in a.vulnerabilities.where("call is not null").collect()} == {"eval"}
    assert [r.name for r in a.secrets.collect()] == ["PASSWORD"]
    got = a.summary()
    assert got["modules"] == 5 and got["security_issues"] >= 2
    assert [r.name for r in a.ask("find class cart").collect()] == ["Cart"]
    assert a.circular_dependencies.count() == 0
    assert Engine(spark, Settings(profile="engine")).analyze_code("x = 5\n").smells.count() == 1


def test_empty(spark):
    s = demo_sources(spark).where("false")
    p = extract.entities(s)
    assert extract.callables(p).count() == 0 and extract.ast_nodes(s).count() == 0 and metrics.file_metrics(s).count() == 0
