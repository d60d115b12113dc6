"""Design patterns, anti-patterns and smells as expressions over class and callable rows.

Scores are sums of doubles in a fixed order, capped at 1; each finding has its evidence in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any(col: str, pred) -> Column:
    return F.exists(col, pred)


def _n(col: str, pred) -> Column:
    return F.size(F.filter(col, pred))


def _in(c: Column, names) -> Column:
    return c.isin(*names)


def _name_has(*parts: str) -> Column:
    return reduce(lambda a, b: a | b, (F.col("name").contains(p) for p in parts))


def _points(*terms: tuple[float, Column, str]) -> tuple[Column, Column]:
    """Terms (weight, times or condition, evidence) -> score, evidence list."""
    score, evidence = F.lit(0.0), []
    for weight, what, text in terms:
        times = what.cast("int").cast("double")
        score = score + F.lit(float(weight)) * times
        evidence.append(F.when(times > 0, text))
    return F.least(score, F.lit(1.0)), F.array_compact(F.array(*evidence))


OBSERVER = ("attach", "detach", "notify", "subscribe", "unsubscribe", "add_observer", "remove_observer", "notify_observers", "add_listener", "remove_listener", "emit")


def design_patterns(members: DataFrame) -> DataFrame:
    """file_path, class_name, pattern, confidence, evidence, line. members: extract.class_members()."""
    m, v = "methods", "class_vars"
    real = lambda x: F.coalesce(x["returns"], F.lit("")) != ""
    rules = {
        "singleton": (0.5, *_points(
            (0.3, _n(v, lambda x: _in(x["name"], ("_instance", "__instance", "_singleton"))), "instance variable"),
            (0.3, _n(m, lambda x: _in(x["name"], ("get_instance", "getInstance", "instance")) & (x["is_classmethod"] | x["is_static"])), "accessor"),
            (0.2, _any(m, lambda x: x["name"] == "__new__"), "__new__"),
            (0.2, _n(m, lambda x: (x["name"] == "__init__") & F.exists(x["calls"], lambda c: c.contains("raise"))), "guarded __init__"),
        )),
        "factory": (0.5, *_points(
            (0.4, _name_has("Factory"), "name"),
            (0.3, _n(m, lambda x: x["name"].rlike("^(create|make|build|get_)") & real(x) & ~_in(x["returns"], ("None", "bool", "int", "str"))), "creator"),
            (0.2, _any(m, lambda x: x["is_abstract"]), "abstract method"),
        )),
        "observer": (0.4, *(lambda k: (F.least(F.lit(0.4) * k / 3 + F.lit(0.3) * _n(v, lambda x: _in(x["name"], ("observers", "listeners", "subscribers", "_observers"))).cast("double") + F.when(_name_has("Observable", "Subject", "Publisher", "EventEmitter"), 0.2).otherwise(0.0), F.lit(1.0)), F.array_sort(F.array_intersect(F.transform(m, lambda x: x["name"]), F.array(*map(F.lit, OBSERVER))))))(
            F.size(F.array_intersect(F.transform(m, lambda x: x["name"]), F.array(*map(F.lit, OBSERVER)))).cast("double"))),
        "decorator": (0.5, *_points(
            (0.3, _name_has("Decorator", "Wrapper"), "name"),
            (0.2, _n(m, lambda x: F.exists(x["calls"], lambda c: c.contains("_wrapped.") | c.contains("_component.") | c.contains("_decorated."))), "delegation"),
        )),
        "strategy": (0.5, *_points(
            (0.4, F.col("is_abstract") & _n(m, lambda x: x["is_abstract"]).between(1, 3), "abstract interface"),
            (0.3, _name_has("Strategy", "Policy"), "name"),
            (0.2, _n(m, lambda x: _in(x["name"], ("execute", "run", "apply", "do", "process"))), "entry method"),
        )),
        "builder": (0.5, *_points(
            (0.4, _name_has("Builder"), "name"),
            (0.3, _n(m, lambda x: _in(x["name"], ("build", "create", "get_result", "get_product"))), "product method"),
            (0.3, _n(m, lambda x: real(x) & (x["returns"].contains("Self") | x["returns"].contains(F.col("name")))) >= 2, "fluent methods"),
            (0.2, _n(m, lambda x: x["name"].rlike("^(set_|with_)")) >= 2, "setters"),
        )),
    }
    one = [F.struct(F.when(F.lit(k == "factory") & F.col("is_abstract"), "abstract_factory").otherwise(k).alias("pattern"), s.alias("confidence"), e.alias("evidence"), F.lit(t).alias("least")) for k, (t, s, e) in rules.items()]
    d = members.select("file_path", F.col("name").alias("class_name"), F.col("start_line").alias("line"), F.explode(F.array(*one)).alias("x"))
    return d.where("x.confidence >= x.least").select("file_path", "class_name", "line", "x.pattern", "x.confidence", "x.evidence")


def _severity(c: Column, high: float, medium: float) -> Column:
    return F.when(c > high, "high").when(c > medium, "medium").otherwise("low")


def anti_patterns(members: DataFrame, callables: DataFrame) -> DataFrame:
    """file_path, entity, kind, severity, line."""
    n, rank = F.size("methods"), lambda c, h, m: F.when(c > h, 2).when(c > m, 1).otherwise(0)
    worst = F.greatest(rank(n, 40, 30), rank(F.col("lines"), 1000, 750))
    god = members.where((n > 20) | (F.col("lines") > 500)).select("file_path", F.col("name").alias("entity"), F.lit("god_class").alias("kind"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), worst + 1).alias("severity"), F.col("start_line").alias("line"))
    plain = _n("methods", lambda x: ~x["name"].startswith("__"))
    access = _n("methods", lambda x: x["name"].rlike("^(get_|set_|is_|has_)"))
    data = members.where(~F.col("is_dataclass") & (n >= 3) & (plain > 0) & (access / plain >= 0.8)).select("file_path", F.col("name").alias("entity"), F.lit("data_class").alias("kind"), F.lit("low").alias("severity"), F.col("start_line").alias("line"))
    c = callables.where("coalesce(class_depth, 0) = 0").withColumn("entity", F.concat_ws(".", "class_name", "name"))
    long = c.where("lines > 50").select("file_path", "entity", F.lit("long_method").alias("kind"), _severity(F.col("lines"), 150, 100).alias("severity"), F.col("start_line").alias("line"))
    p = _n("params", lambda x: ~_in(x["name"], ("self", "cls")) & ~x["kind"].startswith("var_"))
    wide = c.where(p > 5).select("file_path", "entity", F.lit("long_parameter_list").alias("kind"), _severity(p, 10, 7.5).alias("severity"), F.col("start_line").alias("line"))
    return god.unionByName(data).unionByName(long).unionByName(wide)


def entity_smells(parsed: DataFrame, members: DataFrame, callables: DataFrame) -> DataFrame:
    """file_path, entity, kind, line: missing docstrings and mutable defaults."""
    mod = parsed.where("error is null and doc is null").select("file_path", F.col("name").alias("entity"), F.lit("missing_module_docstring").alias("kind"), F.lit(1).alias("line"))
    cls = members.where("doc is null and not is_dataclass").select("file_path", F.col("name").alias("entity"), F.lit("missing_class_docstring").alias("kind"), F.col("start_line").alias("line"))
    c = callables.where("coalesce(class_depth, 0) = 0").withColumn("entity", F.concat_ws(".", "class_name", "name"))
    fun = c.where("doc is null and visibility = 'public'").select("file_path", "entity", F.lit("missing_docstring").alias("kind"), F.col("start_line").alias("line"))
    mut = c.select("file_path", "entity", F.col("start_line").alias("line"), F.explode("params").alias("p")).where(F.col("p.default").rlike(r"^[\[{]") | _in(F.col("p.default"), ("list()", "dict()", "set()")))
    return mod.unionByName(cls).unionByName(fun).unionByName(mut.select("file_path", "entity", F.lit("mutable_default").alias("kind"), "line"))


NODE_SMELLS = ("magic_number", "empty_except", "bare_except", "global_statement", "too_many_returns")


def node_smells(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("rule").isin(*NODE_SMELLS)).select("file_path", F.col("rule").alias("kind"), "line", "detail")


COMMENTED = r"^#\s*(def|class|import|from)\s+\w+", r"^#\s*(if|for|while|return)\s+.+", r"^#\s*(\w+\s*=\s*.+|print\s*\()"


def commented_code(texts: DataFrame, id_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """id, line, snippet: lines that look like code behind a #."""
    lines = texts.select(id_col, F.posexplode(F.split(text_col, r"\r\n|[\n\r]")).alias("k", "raw")).select(id_col, (F.col("k") + 1).alias("line"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("s"))
    hit = reduce(lambda a, b: a | b, (F.col("s").rlike(p) for p in COMMENTED))
    return lines.where(F.col("s").startswith("#") & hit).select(id_col, "line", F.substring("s", 1, 50).alias("snippet"))
