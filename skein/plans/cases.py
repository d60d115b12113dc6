"""Queries over fixed source texts, dealt by key to the rows of a table: what each text must give is written beside it.

The SQL side joins the table's rows to the expected rows by the same rule.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import driver
from skein.operators import extract, findings, graph, lookup, metrics, patterns, retrieval, views
from skein.plans import registry
from skein.plans.synth import read
from skein.sources import files


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return f"{v!r}::{'BIGINT' if isinstance(v, int) else 'DOUBLE'}"
    if "\n" in v:
        return "(" + " || chr(10) || ".join(map(_sql, v.split("\n"))) + ")"
    return "'" + v.replace("'", "''") + "'"


def dealt(spark, sf, texts: list[str], table: str = "customer", key: str = "c_custkey", path=None):
    """sources(file_path, content): row k gets text k % len(texts)."""
    n = F.pmod(F.col(key), F.lit(len(texts))).cast("int")
    p = F.col(key).cast("string") if path is None else F.concat(F.col(key).cast("string"), F.element_at(F.array(*map(F.lit, path)), n + 1))
    return read(spark, sf, table).select(p.alias("file_path"), F.element_at(F.array(*map(F.lit, texts)), n + 1).alias("content"))


def cases(name: str, columns: str, *own: tuple[str, list[tuple]], table: str = "customer", key: str = "c_custkey", path=None):
    """Registers a query; own: (text, rows it must give) for each case. The function gets sources and returns file_path and the columns."""
    cols, rows = columns.split(), [(k, *r) for k, (_, rs) in enumerate(own) for r in rs]
    values = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)
    sql = f"SELECT CAST({key} AS BIGINT) AS file_key, {', '.join(f'v.{c}' for c in cols)} FROM {table} JOIN (VALUES {values}) AS v(k, {', '.join(cols)}) ON {key} % {len(own)} = v.k"

    def put(fn):
        def run(spark, sf):
            d = fn(dealt(spark, sf, [t for t, _ in own], table, key, path))
            out = [F.col(c).cast("long").alias(c) if d.schema[c].dataType.simpleString() in ("int", "smallint") else F.col(c) for c in cols]
            return d.select(F.regexp_extract("file_path", r"^(\d+)", 1).cast("long").alias("file_key"), *out)

        registry.query(name, sql)(run)
        return fn

    return put


def _lines(n: int, text: str = "    x = 1\n") -> str:
    return text * n


# complexity: cyclomatic, cognitive, nesting, rating
BRANCHY = "def f(x):\n" + "".join(f"    if x > {i}:\n        x = x\n" for i in range(7))


@cases("m1_m5_m12_branches", "cyclomatic cognitive max_nesting rating",
       ("for i in x:\n    while y:\n        pass\n", [(3, 3, 2, "A")]),
       ("try:\n    x()\nexcept A:\n    y()\nexcept B:\n    z()\n", [(3, 4, 1, "A")]),
       ("with a as b:\n    c()\n", [(2, 0, 1, "A")]),
       ("x = a and b and c or d\n", [(4, 2, 0, "A")]),
       ("x = 1 if a else 2\nassert x\n", [(3, 1, 0, "A")]),
       ("x = [i for i in y if i if i > 1]\n", [(4, 0, 0, "A")]),
       (BRANCHY, [(8, 7, 2, "B")]),
       (BRANCHY.replace("f(x)", "g(x)") + BRANCHY, [(15, 14, 2, "C")]),
       (BRANCHY * 3 + "\n", [(22, 21, 2, "D")]),
       (BRANCHY * 5, [(36, 35, 2, "F")]),
       ("for i in x:\n    if i:\n        break\n    continue\n", [(3, 5, 2, "A")]),
       ("def f(:\n", [(1, 0, 0, "A")]))
def _(s):
    return metrics.complexity(extract.file_numbers(s))


@cases("m6_m7_loc_kinds", "total blank source comments docstrings",
       ('"""Doc."""\nx = 1  # tail\n\n# whole\n', [(4, 1, 2, 2, 1)]),
       ('def f():\n    """One\n    two."""\n    return 1\n', [(4, 0, 4, 0, 2)]),
       ("x = 1\n", [(1, 0, 1, 0, 0)]), ("", [(0, 0, 0, 0, 0)]))
def _(s):
    return metrics.loc(extract.line_counts(s))


@cases("m7_fallback_loc", "total source comments blank docstrings",
       ('x = 1\n# a\n"""open\n# in the text\nend"""\n# b\n\n', [(7, 4, 2, 1, 0)]),
       ('  # a\n\t\n"""one line"""\n# b', [(4, 1, 2, 1, 0)]),
       ("'''a\n# b\n'''\n#", [(4, 3, 1, 0, 0)]), ("", [(0, 0, 0, 0, 0)]), ("a\n  ", [(2, 1, 0, 1, 0)]))
def _(s):
    return metrics.fallback_loc(s)


@cases("m9_halstead_tokens", "n1 n2 operators operands",
       ("x = a + b\n", [(2, 3, 2, 3)]), ("x += 1\n", [(1, 2, 1, 2)]), ("f(a.b)\n", [(2, 3, 2, 3)]), ("x = not a\n", [(2, 2, 2, 2)]),
       ("x = a < b <= c\n", [(3, 4, 3, 4)]), ("def f(x):\n    return x\n", [(2, 2, 2, 2)]), ("x = a and b\ny = a and b\n", [(2, 4, 4, 6)]))
def _(s):
    return metrics.halstead(extract.file_numbers(s))


@cases("m13_penalties", "score overall", ("x = 1\n", [(100.0, "A")]), ("y = 2\n", [(98.0, "A")]), ("z = 3\n", [(95.0, "A")]), ("a = 4\n", [(90.0, "A")]), ("b = 5\n", [(82.0, "B")]))
def _(s):
    k = F.pmod(F.col("file_path").cast("long"), F.lit(5))
    issues = s.select("file_path", F.when(k.isin(1), 1).otherwise(0).alias("smells"), F.when(k == 2, 1).otherwise(0).alias("anti"), F.when(k.isin(3, 4), 1).otherwise(0).alias("security"), F.when(k == 4, 8).otherwise(0).alias("style"))
    return metrics.quality(metrics.maintainability(metrics.file_metrics(s)), issues)


# patterns, anti-patterns, smells
WRAPPER = "class LogWrapper:\n    def __init__(self, x):\n        self._wrapped = x\n\n    def run(self):\n        return self._wrapped.run()\n"


@cases("d1_d6_more_patterns", "pattern confidence",
       (WRAPPER, [("decorator", 0.5)]),
       ("class SizePolicy(ABC):\n    @abstractmethod\n    def apply(self):\n        pass\n", [("strategy", 0.9)]),
       ("class QBuilder:\n    def with_a(self) -> 'QBuilder':\n        return self\n\n    def with_b(self) -> 'QBuilder':\n        return self\n\n    def build(self):\n        return 1\n", [("builder", 1.0)]),
       ("class Plain:\n    pass\n", []),
       ("class KitFactory(ABC):\n    @abstractmethod\n    def make_door(self) -> Door:\n        pass\n", [("abstract_factory", 0.9)]))
def _(s):
    d = patterns.design_patterns(extract.class_members(extract.entities(s)))
    return d.withColumn("confidence", registry._r("confidence"))


def _class(n: int) -> str:
    return "class K:\n" + "".join(f"    def m{i}(self):\n        return {i}\n" for i in range(n))


def _params(n: int, more: str = "") -> str:
    return f"def f({', '.join(f'p{i}' for i in range(n))}{more}):\n    return 1\n"


ACCESS = "class D:\n    def get_a(self):\n        return 1\n\n    def set_a(self, a):\n        self.a = a\n\n    def is_b(self):\n        return 2\n"


@cases("a1_a4_severities", "entity kind severity",
       (_class(20), []), (_class(21), [("K", "god_class", "low")]), (_class(31), [("K", "god_class", "medium")]), (_class(41), [("K", "god_class", "high")]),
       ("def f():\n" + _lines(50), [("f", "long_method", "low")]), ("def f():\n" + _lines(100), [("f", "long_method", "medium")]), ("def f():\n" + _lines(150), [("f", "long_method", "high")]), ("def f():\n" + _lines(49), []),
       (_params(5, ", *a, **k"), []), (_params(6), [("f", "long_parameter_list", "low")]), (_params(8), [("f", "long_parameter_list", "medium")]), (_params(11), [("f", "long_parameter_list", "high")]),
       (ACCESS, [("D", "data_class", "low")]), ("@dataclass\n" + ACCESS, []))
def _(s):
    p = extract.entities(s)
    return patterns.anti_patterns(extract.class_members(p), extract.callables(p))


@cases("l1_l4_docstrings", "entity kind line",
       ('"""M."""\n\n\nclass A:\n    def f(self):\n        return 1\n', [("A", "missing_class_docstring", 4), ("A.f", "missing_docstring", 5)]),
       ('"""M."""\n\n\n@dataclass\nclass A:\n    x: int = 1\n\n    def _g(self, a=[]):\n        return a\n', [("A._g", "mutable_default", 8)]),
       ('"""M."""\n\n\ndef f(a=dict(), b={}):\n    """D."""\n', [("f", "mutable_default", 4), ("f", "mutable_default", 4)]))
def _(s):
    p = extract.entities(s)
    return patterns.entity_smells(p, extract.class_members(p), extract.callables(p)).where("kind <> 'missing_module_docstring'")


@cases("l5_l9_node_smells_more", "kind line detail",
       ("def f():\n    global a, b\n    a = 1\n", [("global_statement", 2, "a"), ("global_statement", 2, "b")]),
       ("def f(x):\n" + "".join(f"    if x:\n        return {i}\n" for i in (0, 1, 2, 10, 100, 1000)), [("too_many_returns", 1, "6")]),
       ("def f(x):\n" + "    return x\n" * 5, []),
       ("x = 3.5\ny = 7\n", [("magic_number", 1, "3.5"), ("magic_number", 2, "7")]),
       ("try:\n    x()\nexcept A:\n    pass\n", [("empty_except", 3, "")]),
       ("try:\n    x()\nexcept:\n    y()\n", [("bare_except", 3, "")]),
       ("try:\n    x()\nexcept:\n    pass\n", [("empty_except", 3, ""), ("bare_except", 3, "")]))
def _(s):
    return patterns.node_smells(extract.found_nodes(s))


@cases("l10_commented_code", "line snippet",
       ("# def old(x):\nx = 1\n", [(1, "# def old(x):")]), ("x = 1\n#   y = x + 1\n# plain words\n", [(2, "#   y = x + 1")]), ("  # print (x)\n#for a in b:\n", [(1, "# print (x)"), (2, "#for a in b:")]),
       ("x = '# import y'\n", []), ("# " + "return " + "a" * 80 + "\n", [(1, "# return " + "a" * 41)]))
def _(s):
    return patterns.commented_code(s)


# dead code, security
@cases("c1_c6_more_dead_code", "kind name line",
       ("import os\nfrom a import B, C\n\n\ndef f(x: B) -> int:\n    return x\n", [("unused_import", "os", 1), ("unused_import", "C", 2)]),
       ("def _f():\n    pass\n\n\ndef _g():\n    pass\n\n\ndef h():\n    _g()\n", [("unused_function", "_f", 1)]),
       ("from a import Base\n\n\nclass K(Base):\n    pass\n", []),
       ("from a import T\n\n\nclass K:\n    x: T = None\n", []),
       ("from typing import List\nimport numpy as np\n", [("unused_import", "np", 2)]),
       ("def f(x):\n    if x:\n        raise A\n        y()\n    return 1\n", [("unreachable_code", "Expr", 4)]),
       ("def f(x):\n    for a in x:\n        return a\n        z = 1\n", [("unreachable_code", "Assign", 4)]))
def _(s):
    p = extract.entities(s)
    return findings.dead_code(p, extract.imports(p), extract.callables(p), extract.found_nodes(s))


@cases("v5_v9_more_vulnerabilities", "kind severity cwe line",
       ('def f(x):\n    return "select * from t where a = %s" % x\n', [("sql_injection", "critical", "CWE-89", 2)]),
       ('x = "hello %s" % y\n', []),
       ("subprocess.run(x, shell=True)\n", [("shell_true", "high", "CWE-78", 1)]), ("subprocess.run(x, shell=False)\n", []),
       ("x = pickle.loads(y)\nz = cPickle.load(y)\n", [("unsafe_pickle", "high", "CWE-502", 1), ("unsafe_pickle", "high", "CWE-502", 2)]),
       ("yaml.load(x)\nyaml.load(x, Loader=L)\n", [("unsafe_yaml", "high", "CWE-502", 1)]),
       ("x = eval(y)\nexec(z)\n", [("code_injection", "high", "CWE-95", 1), ("code_injection", "high", "CWE-95", 2)]))
def _(s):
    return findings.node_vulnerabilities(extract.found_nodes(s))


@cases("v1_v4_call_rules", "entity call kind severity cwe",
       ("def f():\n    compile(x)\n    __import__(y)\n", [("f", "compile", "code_injection", "medium", "CWE-95"), ("f", "__import__", "insecure_deserialization", "medium", "CWE-502")]),
       ("def f():\n    os.popen(x)\n    subprocess.call(y)\n    subprocess.Popen(z)\n", [("f", "os.popen", "command_injection", "critical", "CWE-78"), ("f", "subprocess.call", "command_injection", "high", "CWE-78"), ("f", "subprocess.Popen", "command_injection", "medium", "CWE-78")]),
       ("class K:\n    def m(self):\n        random.random()\n        random.randint(1, 2)\n", [("K.m", "random.random", "insecure_random", "low", "CWE-330"), ("K.m", "random.randint", "insecure_random", "low", "CWE-330")]),
       ("def f():\n    hashlib.sha1(x)\n    my_MD5(y)\n", [("f", "hashlib.sha1", "insecure_hash", "medium", "CWE-328"), ("f", "my_MD5", "insecure_hash", "medium", "CWE-328")]))
def _(s):
    return findings.call_vulnerabilities(extract.calls(s))


@cases("v11_sql_text", "line snippet",
       ('db.execute("select %s" % x)\n', [(1, 'db.execute("select %s" % x)')]), ("x = 1\ncursor.execute('a'.format(b))\n", [(2, "cursor.execute('a'.format(b))")]),
       ('execute(f"x {y}")\n', [(1, 'execute(f"x {y}")')]), ("q.raw('a %s')\n", [(1, "q.raw('a %s')")]), ('execute("plain")\n', []))
def _(s):
    return findings.sql_text(s)


@cases("v12_more_secrets", "name secret_type line_number",
       ('api_key = "abcd1234efgh"\n', [("api_key", "api_key", 1)]), ('AUTH = "qwertyuiop"\n', [("AUTH", "token", 1)]), ('client_secret = "zxcvbnm,./"\n', [("client_secret", "secret", 1)]),
       ('K = "AKIA' + "ABCDEFGHIJ123456" + '"\n', [("K", "aws_access_key", 1)]), ('x = "ghp_' + "a" * 36 + '"\n', [("x", "token", 1)]), ('y = "' + "0123456789abcdef" * 2 + '"\n', [("y", "hex_token", 1)]),
       ('z = "-----BEGIN RSA PRIVATE KEY-----"\n', [("z", "private_key", 1)]), ('password = "changeme"\npwd = os.environ["P"]\n', []))
def _(s):
    return findings.secrets(extract.variables(extract.entities(s)))


# entities
@cases("x11_x13_annotated", "name annotation value is_constant scope",
       ("x: int = 3\nY: str\n", [("x", "int", "3", False, "module"), ("Y", "str", None, True, "module")]), ("a, b = 1, 2\n", [("a", None, None, False, "module"), ("b", None, None, False, "module")]),
       ("class K:\n    n: float = 1.5\n    M = 2\n", [("n", "float", "1.5", False, "class"), ("M", None, "2", True, "class")]))
def _(s):
    return extract.variables(extract.entities(s))


@cases("x13_locals", "name locals", ("def f(x):\n    a = 1\n    b, c = x\n    d: int = 2\n    return a\n", [("f", "a,b,c,d")]), ("def g():\n    pass\n", [("g", "")]))
def _(s):
    return extract.callables(extract.entities(s)).withColumn("locals", F.array_join("locals", ","))


@cases("x18_locations", "name start_line end_line start_col end_col line_count", ("class A:\n    def f(self):\n        return 1\n", [("f", 2, 3, 4, 16, 2)]), ("def g(): pass\n", [("g", 1, 1, 0, 13, 1)]))
def _(s):
    d = extract.callables(extract.entities(s)).withColumn("at", extract.location())
    return d.select("file_path", "name", *(F.col(f"at.{c}").alias(c) for c in ("start_line", "end_line", "start_col", "end_col", "line_count")))


@cases("x20_entity_json", "json optional",
       ("def f(a, b=1):\n    pass\n", [('{"name":"f","kind":"function","returns":null}', "false,true")]), ("async def g(x: Optional[int]) -> str:\n    pass\n", [('{"name":"g","kind":"function","returns":"str"}', "true")]))
def _(s):
    d = extract.callables(extract.entities(s))
    return d.select("file_path", extract.to_json(d, "name", "kind", "returns").alias("json"), F.array_join(F.transform("params", lambda p: extract.is_optional(p).cast("string")), ",").alias("optional"))


@cases("x19_errors", "error error_line", ("def f(:\n", [("SyntaxError: invalid syntax", 1)]), ("x = 1\n", []))
def _(s):
    return extract.errors(extract.entities(s))


@cases("s8_parser_registry", "name n", ("def f():\n    pass\n", [("py", 1)]), ("def f():\n    pass\n", [("py", 1)]), ("two words", [("txt", 0)]), path=[".py", ".pyw", ".txt"])
def _(s):
    other = lambda p, t: {"file_path": p, "name": "txt", "total_lines": 1, "doc": None, "error": None, "error_line": None, "classes": [], "callables": [], "imports": [], "variables": []}
    d = extract.entities(s, {".txt": other})
    return d.select("file_path", F.when(F.col("name") == "txt", "txt").otherwise("py").alias("name"), F.size("callables").alias("n"))


@cases("s2_decode", "text", ("636166c3a9", [("café",)]), ("636166e9", [("café",)]), ("", [("",)]), ("e9e8", [("éè",)]))
def _(s):
    return s.select("file_path", files.decode(F.unhex("content")).alias("text"))


@cases("s10_r6_json", "json digest", ("a", [('{"t":"a","n":null}', "0cc175b9c0f1b6a831c399e269772661")]), ("b", [('{"t":"b","n":null}', "92eb5ffee6ae2fec3ad71c777531578f")]))
def _(s):
    return s.select("file_path", extract.to_json(s.select(F.lit(1)), F.col("content").alias("t"), F.lit(None).cast("string").alias("n")).alias("json"), F.md5("content").alias("digest"))


# views and chunks
SHOP = '"""Shop."""\nimport os\nfrom a.b import c\n\n\nclass Cart(Base):\n    """A cart."""\n\n    size = 1\n\n    def add(self, x: int = 1):\n        """Add."""\n        return x\n\n    async def go(self):\n        pass\n\n    @property\n    def n(self):\n        return 1\n\n    def clear(self):\n        pass\n\n\ndef total(a, b=2) -> int:\n    """Sum."""\n    return a + b\n'


@cases("r4_module_json", "view",
       (SHOP, [('{"module":{"name":"0","file":"0","summary":{"classes":1,"functions":1,"imports":2,"lines":28,"has_docstring":true}},"structure":{"classes":[{"name":"Cart","bases":["Base"],"methods":["add","go","n","clear"],"is_abstract":false}],"functions":[{"name":"total","params":["a","b"],"returns":"int","is_async":false}]},"imports":[{"module":"os","name":null,"is_relative":false},{"module":"a.b","name":"c","is_relative":false}]}',)]),
       ("x = 1\n", [('{"module":{"name":"0","file":"0","summary":{"classes":0,"functions":0,"imports":0,"lines":1,"has_docstring":false}},"structure":{"classes":[],"functions":[]},"imports":[]}',)]))
def _(s):
    d = views.module_json(extract.entities(s))
    return d.withColumn("view", F.regexp_replace("view", r'^\{"module":\{"name":"\d+","file":"\d+"', '{"module":{"name":"0","file":"0"'))


@cases("r5_module_markdown", "view",
       ("x = 1\n", [("# Module: 0\n\n**File:** `0`\n\n## Summary\n\n- **Classes:** 0\n- **Functions:** 0\n- **Imports:** 0\n",)]),
       ('"""M."""\nclass A(B):\n    def f(self):\n        pass\n\n\ndef g(x):\n    """D."""\n', [("# Module: 0\n\n**File:** `0`\n\n## Description\n\nM.\n\n## Summary\n\n- **Classes:** 1\n- **Functions:** 1\n- **Imports:** 0\n\n## Classes\n\n### `A`\n\n**Inherits:** B\n\n**Methods:**\n- `f()`\n\n## Functions\n\n### `g`\n\n```python\ndef g(x)\n```\n\nD.\n",)]))
def _(s):
    d = views.module_markdown(extract.entities(s))
    return d.withColumn("view", F.regexp_replace(F.regexp_replace("view", r"^# Module: \d+", "# Module: 0"), r"`\d+`", "`0`"))


@cases("k2_k5_chunk_texts", "entity_type entity_name parent_name content",
       (SHOP, [("class", "Cart", None, "class Cart(Base)\nA cart.\nVariables: size\ndef add(self, x: int)\ndef go(self)\ndef n(self)\ndef clear(self)"),
               ("method", "add", "Cart", "Class: Cart\ndef add(self, x: int)\nAdd."), ("method", "go", "Cart", "Class: Cart\nasync def go(self)"), ("method", "n", "Cart", "Class: Cart\n@property\ndef n(self)\nproperty"), ("method", "clear", "Cart", "Class: Cart\ndef clear(self)"),
               ("function", "total", None, "def total(a, b=2)\nreturns int\nSum.")]),
       ("class D(ABC):\n    def f(self):\n        pass\n", [("class", "D", None, "class D(ABC)\nabstract\ndef f(self)")]))
def _(s):
    return retrieval.chunks(extract.entities(s)).where("entity_type <> 'module'")


@cases("k1_k7_module_chunks", "content full_name json",
       (SHOP, [("# Module: 0\nFile: 0\nShop.\nImports: os, a\nClasses: Cart\nFunctions: total", "0.0", '{"entity_type":"module","start_line":1}')]))
def _(s):
    d = retrieval.chunks(extract.entities(s)).where("entity_type = 'module'")
    body = F.regexp_replace(F.regexp_replace("content", r"^# Module: \d+", "# Module: 0"), r"File: \d+", "File: 0")
    return d.select("file_path", body.alias("content"), F.regexp_replace(retrieval.full_name(), r"\d+", "0").alias("full_name"), extract.to_json(d, "entity_type", "start_line").alias("json"))


# retrieval from an index
def _demo(spark):
    i = retrieval.Index(spark, settings=retrieval.RetrievalSettings(store="memory", threshold=0.0))
    i.add(extract.entities(files.demo_sources(spark)))
    return i


DEMO_COUNTS = "SELECT * FROM (VALUES ('class', 1::BIGINT), ('function', 3::BIGINT), ('method', 4::BIGINT), ('module', 4::BIGINT)) AS v(entity_type, n)"


@registry.query("p1_s14_index", DEMO_COUNTS)
def _(spark, sf):
    i = _demo(spark)
    i.add(extract.entities(files.demo_sources(spark)))  # the same again replaces
    return i.stats().select("entity_type", F.col("count").alias("n"))


@registry.query("s13_table_store", DEMO_COUNTS)
def _(spark, sf):
    import uuid

    from skein.runtime import shared_dir

    at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    p = extract.entities(files.demo_sources(spark))
    retrieval.Index(spark, at).add(p.where("file_path like '%cart%'"))
    retrieval.Index(spark, at).add(p)  # opened again: known chunks are replaced, others added
    return retrieval.Index(spark, at).stats().select("entity_type", F.col("count").alias("n"))


@registry.query("p4_search_by_type", "SELECT * FROM (VALUES ('Cart', 'class', 1::BIGINT)) AS v(entity_name, entity_type, rank)")
def _(spark, sf):
    return _demo(spark).search("cart", entity_type="class").select("entity_name", "entity_type", F.col("rank").cast("long").alias("rank"))


@registry.query("p2_p6_p8_prompts", """
    WITH t AS (SELECT conv_id AS query_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS c FROM conversations GROUP BY conv_id)
    SELECT query_id, md5('Answer the question from the code below.' || chr(10) || chr(10) || c || chr(10) || chr(10) || 'Question: what is ' || query_id || chr(10) || 'Answer:') AS prompt FROM t""")
def _(spark, sf):
    c = read(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("turn").alias("rank"), F.col("text").alias("content"))
    q = c.select("query_id", F.concat(F.lit("what is "), F.col("query_id").cast("string")).alias("text")).distinct()
    return retrieval.prompts(q, c.select("query_id", "chunk_id", "rank"), c.select("chunk_id", "content"), "qa", 1 << 30).select("query_id", F.md5("prompt").alias("prompt"))


@registry.query("e3_batch_embedding", "SELECT c_custkey, 8::BIGINT AS size, 1.0::DOUBLE AS norm FROM customer")
def _(spark, sf):
    from skein.functions.vectors import norm

    d = retrieval.embed(read(spark, sf, "customer").select("c_custkey", "c_name"), retrieval.embedder_for(retrieval.RetrievalSettings(dimension=8)), "c_name")
    return d.select("c_custkey", F.size("embedding").cast("long").alias("size"), registry._r(norm(F.col("embedding")), "norm"))


# graphs
@registry.query("g7_vertices", "SELECT c_nationkey AS id, max_by(c_name, c_custkey) AS name FROM customer GROUP BY c_nationkey")
def _(spark, sf):
    return graph.vertices(read(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord"))).select("id", "name")


TYPED = "SELECT DISTINCT o_custkey AS src, l_suppkey AS dst, l_returnflag AS edge_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey"


def _typed(spark, sf):
    o, li = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("edge_type")).distinct()


@registry.query("g9_edge_filters", f"SELECT 'from' AS what, dst AS node, edge_type FROM ({TYPED}) WHERE src = 7 AND edge_type = 'R' UNION ALL SELECT 'to', src, edge_type FROM ({TYPED}) WHERE dst = 3")
def _(spark, sf):
    e = _typed(spark, sf)
    return graph.edges_from(e, F.lit(7), "R").select(F.lit("from").alias("what"), F.col("dst").alias("node"), "edge_type").union(graph.edges_to(e, F.lit(3)).select(F.lit("to"), "src", "edge_type"))


@registry.query("g9_graph_counts", "SELECT (SELECT count(DISTINCT id) FROM (SELECT c_nationkey AS id FROM customer UNION ALL SELECT n_regionkey + 100 FROM nation UNION ALL SELECT n_nationkey FROM nation)) AS node_count, (SELECT count(*) FROM nation) AS edge_count")
def _(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"))
    return graph.graph_counts(n, read(spark, sf, "customer").select(F.col("c_nationkey").alias("id")))


@registry.query("g9_graph_json", """SELECT n_regionkey AS node, '{"id":' || n_regionkey || ',"targets":[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || ']}' AS json FROM nation GROUP BY n_regionkey""")
def _(spark, sf):
    return graph.graph_json(read(spark, sf, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst")))


@registry.query("g13_dependencies", f"SELECT 'dependency' AS what, CAST(dst AS BIGINT) AS node FROM ({TYPED}) WHERE src = 7 GROUP BY dst UNION ALL SELECT 'dependent', src FROM ({TYPED}) WHERE dst = 3 GROUP BY src")
def _(spark, sf):
    e = _typed(spark, sf)
    return graph.dependencies(e, F.lit(7)).select(F.lit("dependency").alias("what"), F.col("node").cast("long").alias("node")).union(graph.dependents(e, F.lit(3)).select(F.lit("dependent"), "node"))


@registry.query("g12_connected", "SELECT c_custkey AS node, CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) AS BIGINT) AS root FROM customer")
def _(spark, sf):
    c = read(spark, sf, "customer")
    other = c.groupBy("c_nationkey").agg(F.max("c_custkey").alias("dst"))
    return graph.connected(c.join(other, "c_nationkey").select(F.col("c_custkey").alias("src"), "dst"))


@registry.query("u5_overlaps", "SELECT CAST((c_custkey // 3) % 7 AS VARCHAR) AS hash, count(DISTINCT c_custkey // 3) AS n_blocks, CAST(5 AS BIGINT) AS line_count FROM customer GROUP BY 1")
def _(spark, sf):
    """Three blocks a file, each over the one before: one of them stays."""
    c, k = read(spark, sf, "customer"), F.floor(F.col("c_custkey") / 3)
    start = F.col("c_custkey") % 3 * 2
    b = c.select((k % 7).cast("string").alias("hash"), k.cast("string").alias("file_path"), start.cast("int").alias("start_line"), (start + 4).cast("int").alias("end_line"), F.col("c_name").alias("name"))
    return findings.duplicates(b).select("hash", "n_blocks", "line_count")


# sources
@registry.query("s4_s9_parse_cache", "SELECT CAST(c_custkey AS VARCHAR) AS file_path FROM customer WHERE c_custkey % 3 = 0")
def _(spark, sf):
    s = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("file_path"), F.concat(F.lit("x = "), "c_custkey").alias("content"))
    s = s.withColumn("content_md5", F.md5("content"))
    known = s.withColumn("content_md5", F.when(F.col("file_path").cast("long") % 3 == 0, "old").otherwise(F.col("content_md5")))
    return files.new_or_changed(s, known).select("file_path")


@registry.query("s14_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v FROM customer UNION ALL SELECT -s_suppkey, 'new' FROM supplier")
def _(spark, sf):
    old = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    new = old.where("k % 2 = 0").select("k", F.lit("new").alias("v")).union(read(spark, sf, "supplier").select(-F.col("s_suppkey"), F.lit("new")))
    return files.upsert(old, new, "k")


@registry.query("n8_parallel_map", "SELECT CAST(i * i AS BIGINT) AS v FROM range(0, 20) AS r(i) WHERE i <> 7")
def _(spark, sf):
    got = driver.parallel_map(lambda x: x * x if x != 7 else 1 // 0, range(20))
    return spark.createDataFrame([(v,) for v in got if v is not None], "v long")


@registry.query("q1_q8_forms", "SELECT * FROM (VALUES ('async'), ('class'), ('function'), ('imports'), ('inherit'), ('method'), ('abstract'), ('search')) AS v(form)")
def _(spark, sf):
    asked = ["find function a", "find class b", "find methods c", "list async functions", "list abstract methods", "list classes inheriting from d", "show imports of e", "what is f"]
    return spark.createDataFrame([(lookup.parse_question(x)[0],) for x in asked], "form string")
