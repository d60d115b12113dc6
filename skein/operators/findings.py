"""Dead code, duplicates, vulnerabilities and secrets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import table

TYPES = r"\b([A-Z][a-zA-Z0-9_]*)\b"


def used_names(parsed: DataFrame, callables: DataFrame) -> DataFrame:
    """file_path, name: called, inherited from, or named in an annotation that is read."""
    calls = callables.where("coalesce(class_depth, 0) = 0").select("file_path", F.explode("calls").alias("name"))
    bases = parsed.select("file_path", F.explode("classes").alias("c")).where("c.depth = 0").select("file_path", F.explode("c.bases").alias("name"))
    kinds = lambda c: F.explode(F.regexp_extract_all(c, F.lit(TYPES), F.lit(1)))
    own = parsed.select("file_path", F.explode("variables").alias("v")).where("v.scope = 'class' and v.annotation is not null").select("file_path", kinds(F.col("v.annotation")).alias("name"))
    f = callables.where("class_ord is null")
    notes = F.concat_ws(" ", F.transform("params", lambda p: F.coalesce(p["annotation"], F.lit(""))), F.coalesce("returns", F.lit("")))
    sig = f.select("file_path", kinds(notes).alias("name"))
    return calls.union(bases).union(own).union(sig).distinct()


def dead_code(parsed: DataFrame, imports: DataFrame, callables: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """file_path, kind, name, line, confidence."""
    used = used_names(parsed, callables)
    imp = imports.where("module not in ('typing', '__future__')").select("file_path", F.lit("unused_import").alias("kind"), F.col("used_name").alias("name"), "line", F.lit(0.9).alias("confidence"))
    fun = callables.where("class_ord is null and name like '\\\\_%'").select("file_path", F.lit("unused_function").alias("kind"), "name", F.col("start_line").alias("line"), F.lit(0.6).alias("confidence"))
    out = imp.unionByName(fun).join(used, ["file_path", "name"], "left_anti").select("file_path", "kind", "name", "line", "confidence")
    if nodes is not None:
        out = out.unionByName(nodes.where("rule = 'unreachable'").select("file_path", F.lit("unreachable_code").alias("kind"), F.col("kind").alias("name"), "line", F.lit(0.95).alias("confidence")))
    return out


def entity_blocks(callables: DataFrame, least: int = 5) -> DataFrame:
    """Functions and methods of at least `least` lines, with a hash of their outward structure."""
    c = callables.where((F.col("lines") >= least) & (F.coalesce("class_depth", F.lit(0)) == 0))
    notes = F.transform("params", lambda p: F.coalesce(p["annotation"], F.lit("")))
    sig = F.to_json(F.struct(F.size("params").alias("p"), F.size("calls").alias("n"), "is_async", "is_generator", "lines", notes.alias("a"), F.coalesce("returns", F.lit("")).alias("r"), F.array_sort("calls").alias("c")))
    return c.select("file_path", F.concat_ws(".", "class_name", "name").alias("name"), "start_line", "end_line", F.md5(sig).alias("hash"))


def duplicate_members(blocks: DataFrame) -> DataFrame:
    """hash, file_path, start_line, end_line, name: blocks of groups of two or more, after overlaps in a file are dropped (the first one stays).

    Overlaps are settled within a file, and sizes counted with partial aggregation, so no group of copies is gathered.
    """
    blocks = table(blocks, "blocks")  # it is read more than once, and made by parsing
    many = blocks.groupBy("hash").count().where("count > 1").select("hash")
    member = F.struct("start_line", "end_line", "name")
    own = blocks.join(many, "hash", "left_semi").groupBy("hash", "file_path").agg(F.sort_array(F.collect_list(member)).alias("all"))  # bounded by the file
    none = F.struct(F.lit(-1).alias("end"), F.slice("all", 1, 0).alias("kept"))
    fold = lambda a, x: F.when(x["start_line"] > a["end"], F.struct(x["end_line"].alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    clear = own.select("hash", "file_path", F.explode(F.aggregate("all", none, fold)["kept"]).alias("m")).select("hash", "file_path", "m.start_line", "m.end_line", "m.name")
    left = clear.groupBy("hash").count().where("count > 1").select("hash")
    return clear.join(left, "hash", "left_semi")


def duplicates(blocks: DataFrame) -> DataFrame:
    """hash, n_blocks, line_count, impact, first_file, first_line: groups of duplicate_members(), the gravest first."""
    m = duplicate_members(blocks)
    g = m.groupBy("hash").agg(F.count("*").alias("n_blocks"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("total"), F.min(F.struct("file_path", "start_line")).alias("first"))
    g = g.withColumn("line_count", F.floor(F.col("total") / F.col("n_blocks")))
    return g.select("hash", "n_blocks", "line_count", (F.col("line_count") * F.col("n_blocks")).alias("impact"), F.col("first.file_path").alias("first_file"), F.col("first.start_line").alias("first_line")).orderBy(F.desc("impact"), "first_file", "first_line")


CALL_RULES = [
    ("eval", "code_injection", "high", "CWE-95"), ("exec", "code_injection", "high", "CWE-95"), ("compile", "code_injection", "medium", "CWE-95"), ("__import__", "insecure_deserialization", "medium", "CWE-502"),
    ("os.system", "command_injection", "critical", "CWE-78"), ("os.popen", "command_injection", "critical", "CWE-78"), ("subprocess.call", "command_injection", "high", "CWE-78"), ("subprocess.run", "command_injection", "medium", "CWE-78"), ("subprocess.Popen", "command_injection", "medium", "CWE-78"),
    ("random.random", "insecure_random", "low", "CWE-330"), ("random.randint", "insecure_random", "low", "CWE-330"), ("random.choice", "insecure_random", "low", "CWE-330"),
]


def call_vulnerabilities(callables: DataFrame) -> DataFrame:
    """file_path, entity, call, kind, severity, cwe, line: calls of known names, and of anything named like a weak hash. callables is gone through once."""
    c = callables.where("coalesce(class_depth, 0) = 0").select("file_path", F.concat_ws(".", "class_name", "name").alias("entity"), F.col("start_line").alias("line"), F.explode("calls").alias("call"))
    rule = lambda *r: F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("kind", "severity", "cwe"))))
    known = F.try_element_at(F.create_map(*(x for call, *r in CALL_RULES for x in (F.lit(call), rule(*r)))), F.col("call"))
    weak = F.when(F.lower("call").contains("md5") | F.lower("call").contains("sha1"), rule("insecure_hash", "medium", "CWE-328"))
    d = c.withColumn("r", F.explode(F.filter(F.array(known, weak), lambda r: r.isNotNull())))
    return d.select("file_path", "entity", "call", "r.kind", "r.severity", "r.cwe", "line")


NODE_RULES = {"code_injection": ("high", "CWE-95"), "sql_injection": ("critical", "CWE-89"), "shell_true": ("high", "CWE-78"), "unsafe_pickle": ("high", "CWE-502"), "unsafe_yaml": ("high", "CWE-502")}


def node_vulnerabilities(nodes: DataFrame) -> DataFrame:
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for r, v in NODE_RULES.items() for x in (r, v[k]))), F.col("rule"))
    return nodes.where(F.col("rule").isin(*NODE_RULES)).select("file_path", F.col("rule").alias("kind"), pick(0).alias("severity"), pick(1).alias("cwe"), "line", F.col("detail").alias("snippet"))


_QUOTED = r"\s*\(\s*[\"']"
SQL_TEXT = ["execute" + _QUOTED + r".*(%s|\+)", r"execute\s*\(\s*f[\"']", r"cursor\.execute" + _QUOTED + ".*format", r"\.raw" + _QUOTED + ".*%s"]


def sql_text(sources: DataFrame) -> DataFrame:
    """file_path, line, snippet: lines whose text looks like a query put together from parts."""
    lines = sources.select("file_path", F.posexplode(F.split("content", r"\r\n|[\n\r]")).alias("k", "s"))
    hit = reduce(lambda a, b: a | b, (F.col("s").rlike(p) for p in SQL_TEXT))
    return lines.where(hit).select("file_path", (F.col("k") + 1).alias("line"), F.trim("s").alias("snippet"))


SECRET_NAMES = [("password", r"(?i)(password|passwd|pwd)"), ("api_key", r"(?i)(api_?key|apikey)"), ("token", r"(?i)(token|auth)"), ("secret", r"(?i)secret"), ("private_key", r"(?i)private_?key")]
SECRET_VALUES = [("aws_access_key", r"AKIA[0-9A-Z]{16}"), ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("token", r"gh[pousr]_[A-Za-z0-9]{36}"), ("hex_token", r"^['\"][0-9a-f]{32,}['\"]$")]


def secrets(variables: DataFrame, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """file_path, name, secret_type, line_number, message: literals under a telling name, or that look like a key."""
    v = variables.where(F.col("value").rlike(r"^[rbuf]{0,2}['\"].{4,}['\"]$") & ~F.col("value").rlike(r"(?i)(environ|getenv|example|changeme|<.*>)"))
    kind = None
    for name, pat in [*SECRET_VALUES, *extra]:
        cond = F.col("value").rlike(pat)
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
    for name, pat in SECRET_NAMES:
        kind = kind.when(F.col("name").rlike(pat), name)
    return v.withColumn("secret_type", kind).where("secret_type is not null").select("file_path", "name", "secret_type", F.col("line").alias("line_number"), F.concat(F.lit("possible "), "secret_type", F.lit(" in "), "name").alias("message"))
