import random

from skein.operators import extract, findings
from skein.sources import pysource

TEXTS = [
    "def f(x):\n    return eval(x)\n    y = hashlib.md5(x)\n", "class K:\n    class L:\n        def m(self):\n            os.system(1)\n\n    def n(self):\n        exec(2)\n", "def f(:\n", "", None,
    "try:\n    x()\nexcept:\n    pass\nglobal a, b\nq = 'select %s' % (7, 8.5)\n", "if a:\n    def g():\n        def h():\n            return lambda: 1\n        raise A\n        h()\nelse:\n    async def k():\n        pass\n",
    "match x:\n    case 1:\n        def g():\n            pass\n    case _:\n        subprocess.run(x, shell=True)\n",
]


def sources(spark, n=900):
    rng = random.Random(2)
    return spark.createDataFrame([(rng.choice([f"d/x{i}.py", f"m{i}", f"a.b/{i}", None, ""]), rng.choice(TEXTS)) for i in range(n)], "file_path string, content string").coalesce(1)


def alike(a, b):
    return a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_shared_texts_give_the_rows_of_their_own(spark):
    s = sources(spark)
    every = s.collect()
    for df, fn in ((extract.entities(s), pysource.entities), (extract.file_numbers(s), pysource.numbers), (extract.line_counts(s), pysource.tokens)):
        assert sorted(map(repr, df.collect())) == sorted(map(repr, spark.createDataFrame([fn(r.file_path, r.content) for r in every], df.schema).collect()))


def test_found_nodes_are_the_nodes_with_a_rule(spark):
    s = sources(spark, 200)
    cols = ["file_path", "kind", "line", "rule", "detail"]
    assert alike(extract.found_nodes(s), extract.ast_nodes(s).where("rule is not null").select(cols))


def test_calls_are_those_of_callables(spark):
    s = sources(spark, 200)
    assert alike(extract.calls(s), extract.callables(extract.entities(s)).select("file_path", "class_name", "class_depth", "name", "start_line", "calls"))


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_files_are_parsed_once(spark):
    """Before, calls were parsed for two rules each by itself, and blocks for each reading of them."""
    s = sources(spark, 50)
    assert parses(findings.call_vulnerabilities(extract.calls(s))) == 1
    assert parses(findings.duplicate_members(extract.code_blocks(s))) == 0


def test_weak_hashes_and_known_calls(spark):
    c = spark.createDataFrame([("a", None, None, "f", 1, ["exec", "hashlib.md5", "SHA1", "x", "compile"]), ("b", "K", 1, "m", 2, ["exec"])], "file_path string, class_name string, class_depth int, name string, start_line int, calls array<string>")
    got = {(r.call, r.kind, r.cwe) for r in findings.call_vulnerabilities(c).collect()}
    assert got == {("exec", "code_injection", "CWE-95"), ("compile", "code_injection", "CWE-95"), ("hashlib.md5", "insecure_hash", "CWE-328"), ("SHA1", "insecure_hash", "CWE-328")}


def test_functions_in_the_order_of_a_whole_walk():
    import ast

    for t in TEXTS:
        try:
            tree = ast.parse(t or "")
        except SyntaxError:
            continue
        assert [n.name for n in pysource._functions(tree)] == [n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
