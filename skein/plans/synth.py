"""Source text made from table rows, so that what is true of it can be told from the row alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.runtime import read as _read


def read(spark, sf, name) -> DataFrame:
    """A table, spread over all cores: what is made of its rows costs far more than the rows."""
    return _read(spark, sf, name).repartition(spark.sparkContext.defaultParallelism)


def many(n: Column, line) -> Column:
    """line(i) for i in 0..n-1, joined."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), line), "")).otherwise("")


def nested_ifs(spark, sf) -> DataFrame:
    k = F.col("c_nationkey") % 5
    ifs = many(k, lambda i: F.concat(F.repeat(F.lit("    "), i + 1), F.lit("if x:\n")))
    code = F.concat(F.lit("def f(x):\n"), ifs, F.expr("repeat('    ', c_nationkey % 5 + 1)"), F.lit("pass\n"))
    return read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("file_path"), code.alias("content"))


def remarks(spark, sf) -> DataFrame:
    code = F.concat(F.lit("x = 1\n"), F.expr("repeat('# note\n', p_size % 7)"), F.expr("repeat('\n', p_size % 3)"), F.lit("y = 2  # tail\n"))
    return read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file_path"), code.alias("content"))


def sums(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file_path"), F.expr("repeat('x = a + b\n', p_size % 10 + 1)").alias("content"))


def supplier_classes(spark, sf) -> DataFrame:
    """A class of s_nationkey methods for each supplier, an import, a constant and a function."""
    n = F.col("s_nationkey")
    key = F.col("s_suppkey").cast("string")
    meth = many(n, lambda i: F.concat(F.lit("    def get_m"), i.cast("string"), F.lit("(self, a: int = 0):\n        return a\n")))
    code = F.concat(
        F.lit("import os\nfrom json import loads as js\n\nLIMIT = "), n.cast("string"), F.lit("\n\n\nclass C"), key, F.lit("(Base"), (n % 3).cast("string"), F.lit('):\n    """Doc."""\n    rows = None\n'), meth,
        F.lit("\n\nasync def fetch_"), key, F.lit("(p, q=[], *r, s: str = 'z', **t) -> C"), key, F.lit(":\n    v = os.getcwd()\n    yield js(v)\n"),
    )
    return read(spark, sf, "supplier").select(F.concat(F.lit("pkg/s"), key, F.lit(".py")).alias("file_path"), code.alias("content"))


CALLS = ["eval", "os.system", "subprocess.run", "random.choice", "hashlib.md5", "print", "exec", "yaml.load"]


def order_calls(spark, sf) -> DataFrame:
    call = F.element_at(F.array(*map(F.lit, CALLS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    code = F.concat(F.lit("def f(x):\n    return "), call, F.lit("(x)\n"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("file_path"), code.alias("content"))


def customer_notes(spark, sf) -> DataFrame:
    """By c_custkey % 6: a secret, an unused import, code after a return, a mutable default, a bare except, a magic number."""
    kinds = [
        'PASSWORD = "letmein-now"\n', "import os\nimport sys\nsys()\n\n\ndef f(sys):\n    return os()\n", "def f(x):\n    return x\n    print(x)\n",
        "def f(x={}):\n    return x\n", "try:\n    x()\nexcept:\n    pass\n", 'def f(x):\n    """D."""\n    return x * 77\n',
    ]
    return read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("file_path"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_custkey") % 6 + 1).cast("int")).alias("content"))


def nation_imports(spark, sf) -> DataFrame:
    """A module for each nation that imports its region's, and the regions' modules."""
    n = read(spark, sf, "nation").select(F.concat(F.lit("nations/n"), "n_nationkey", F.lit(".py")).alias("file_path"), F.concat(F.lit("import os\nimport numpy as np\nfrom regions.r"), "n_regionkey", F.lit(" import name, size\nfrom .n"), F.expr("(n_nationkey + 1) % 25"), F.lit(" import f\n")).alias("content"))
    r = read(spark, sf, "region").select(F.concat(F.lit("regions/r"), "r_regionkey", F.lit(".py")).alias("file_path"), F.lit("name = 1\nsize = 2\n").alias("content"))
    return n.union(r)


def supplier_calls(spark, sf) -> DataFrame:
    """Functions of suppliers call their nation's function and one that no one defines."""
    s = read(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey", F.lit(".py")).alias("file_path"), F.concat(F.lit("def s"), "s_suppkey", F.lit("():\n    n"), "s_nationkey", F.lit("()\n    outside()\n")).alias("content"))
    n = read(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.lit(".py")).alias("file_path"), F.concat(F.lit("def n"), "n_nationkey", F.lit("():\n    pass\n")).alias("content"))
    return s.union(n)


def part_functions(spark, sf) -> DataFrame:
    """Functions whose body has p_size lines; names and constants differ."""
    body = many(F.col("p_size"), lambda i: F.concat(F.lit("    v"), F.col("p_partkey").cast("string"), F.lit(" = "), i.cast("string"), F.lit("\n")))
    return read(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("file_path"), F.concat(F.lit("def g"), "p_partkey", F.lit("(x):\n"), body).alias("content"))


PATTERNS = {
    "singleton": "class A:\n    _instance = None\n\n    @classmethod\n    def get_instance(cls):\n        return cls\n",
    "factory": "class ThingFactory:\n    def create_a(self) -> Thing:\n        return 1\n",
    "observer": "class A:\n    observers = []\n\n    def attach(self):\n        pass\n\n    def detach(self):\n        pass\n\n    def notify(self):\n        pass\n",
    "strategy": "class RunStrategy(ABC):\n    @abstractmethod\n    def run(self):\n        pass\n",
    "builder": "class ABuilder:\n    def build(self):\n        return 1\n",
    "none": "class A:\n    def f(self):\n        return 1\n",
}


def supplier_patterns(spark, sf) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, PATTERNS.values())), (F.col("s_suppkey") % 6 + 1).cast("int"))
    return read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("file_path"), code.alias("content"))
