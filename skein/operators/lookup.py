"""Questions in plain words, and summaries.

A question picks one of eight plans by pattern; each is a filter over entity rows. Results
have the columns kind, name, file_path, line, detail.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAMED = r"(?:named\s+|called\s+)?[\"']?(\w+)[\"']?"
FORMS = [
    ("function", re.compile(rf"^find\s+(?:all\s+)?functions?\s+{_NAMED}")),
    ("class", re.compile(rf"^find\s+(?:all\s+)?class(?:es)?\s+{_NAMED}")),
    ("method", re.compile(rf"^find\s+(?:all\s+)?methods?\s+{_NAMED}")),
    ("async", re.compile(r"^list\s+(?:all\s+)?async\s+(?:functions?|methods?)")),
    ("abstract", re.compile(r"^list\s+(?:all\s+)?abstract\s+(?:methods?|classes)")),
    ("inherit", re.compile(r"^list\s+(?:all\s+)?classes\s+(?:that\s+)?inherit(?:ing)?\s+(?:from\s+)?(\w+)")),
    ("imports", re.compile(r"^show\s+(?:all\s+)?imports\s+(?:of|from)\s+([\w.]+)")),
    ("search", re.compile(r"^search\s+(?:for\s+)?[\"']?(.+)")),
]


def parse_question(question: str) -> tuple[str, str]:
    q = question.lower().strip()
    for kind, form in FORMS:
        if m := form.match(q):
            return kind, m[1] if form.groups else ""
    return "search", q


def ask(question: str, classes: DataFrame, callables: DataFrame, imports: DataFrame, *, parity: bool = False) -> DataFrame:
    """parity: base names are compared as written, so a lower-cased one never meets `ABC`."""
    kind, x = parse_question(question)
    top = classes.where("depth = 0")
    c = callables.where("coalesce(class_depth, 0) = 0").withColumn("full", F.concat_ws(".", "class_name", "name"))
    name = F.lower("name")
    near = name.contains(x) | F.lit(x).contains(name)
    sign = F.concat("name", F.lit("("), F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["annotation"]), F.lit("")))), ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "returns"), F.lit("")))
    call = lambda d: d.select(F.col("kind"), F.col("full").alias("name"), "file_path", F.col("start_line").alias("line"), sign.alias("detail"))
    klass = lambda d: d.select(F.lit("class").alias("kind"), "name", "file_path", F.col("start_line").alias("line"), F.array_join("bases", ", ").alias("detail"))
    if kind == "function":
        return call(c.where((F.col("kind") == "function") & near))
    if kind == "class":
        return klass(top.where(near))
    if kind == "method":
        return call(c.where((F.col("kind") == "method") & near))
    if kind == "async":
        return call(c.where("is_async")).orderBy("kind", "file_path", "line")
    if kind == "abstract":
        return klass(top.where("is_abstract")).unionByName(call(c.where("is_abstract and kind = 'method'")))
    if kind == "inherit":
        return klass(top.where(F.array_contains("bases", x) if parity else F.exists("bases", lambda b: F.lower(b) == x)))
    if kind == "imports":
        return imports.where(F.lower("module").contains(x)).select(F.lit("import").alias("kind"), F.col("full_name").alias("name"), "file_path", "line", F.coalesce("alias", F.lit("")).alias("detail"))
    has = name.contains(x)
    return call(c.where((F.col("kind") == "function") & has)).unionByName(klass(top.where(has))).unionByName(call(c.where((F.col("kind") == "method") & has)))


def _list(head: str, items, most: int, prefix: str = "  - "):
    """A headed list of the first `most`, and how many more there are; null if empty."""
    n = F.size(items)
    shown = F.array_join(F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit(prefix), x)), "\n")
    more = F.when(n > most, F.concat(F.lit("\n  ... and "), (n - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.when(n > 0, F.concat(F.lit(head + "\n"), shown, more))


def module_summaries(parsed: DataFrame, limit: int = 2000) -> DataFrame:
    """file_path, summary"""
    from skein.functions.text import truncate

    funcs = F.filter("callables", lambda c: c["class_ord"].isNull())
    top = F.filter("classes", lambda c: c["depth"] == 0)
    counts = F.concat(F.lit("Classes: "), F.size(top).cast("string"), F.lit(", functions: "), F.size(funcs).cast("string"), F.lit(", lines: "), F.col("total_lines").cast("string"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Module: "), "name"), F.concat(F.lit("File: "), "file_path"), F.concat(F.lit("About: "), F.substring_index("doc", "\n", 1)), counts,
        _list("Imports:", F.transform("imports", lambda i: F.concat_ws(".", F.nullif(i["module"], F.lit("")), i["name"])), 5),
        _list("Classes:", F.transform(top, lambda c: c["name"]), 1 << 20), _list("Functions:", F.transform(funcs, lambda c: c["name"]), 10),
    )
    return parsed.where("error is null").select("file_path", truncate(text, limit).alias("summary"))


def class_summaries(members: DataFrame) -> DataFrame:
    """file_path, name, summary: bases, flags, docstring and the first 8 methods."""
    flags = F.concat_ws(", ", F.when(F.col("is_abstract"), "abstract"), F.when(F.col("is_dataclass"), "dataclass"))
    head = F.concat(F.lit("Class: "), "name", F.when(F.size("bases") > 0, F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))).otherwise(""))
    text = F.concat_ws("\n", head, F.nullif(flags, F.lit("")), F.substring_index("doc", "\n", 1), _list("Methods:", F.transform("methods", lambda m: m["name"]), 8))
    return members.select("file_path", "name", text.alias("summary"))


def function_summaries(callables: DataFrame) -> DataFrame:
    """file_path, name, summary: signature, docstring and flags."""
    typed = F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["annotation"]), F.lit("")))), ", ")
    head = F.concat(F.when(F.col("is_async"), "async ").otherwise(""), F.lit("def "), "name", F.lit("("), typed, F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), "returns"), F.lit("")))
    text = F.concat_ws("\n", head, F.substring_index("doc", "\n", 1), F.when(F.col("is_generator"), "generator"))
    return callables.where("class_ord is null").select("file_path", "name", text.alias("summary"))


def project_summary(parsed: DataFrame) -> DataFrame:
    """One row of totals, with the first 20 modules and 10 classes by path."""
    p = parsed.where("error is null")
    some = p.select("file_path", "name").orderBy("file_path").limit(20).agg(F.sort_array(F.collect_list(F.struct("file_path", "name"))).alias("m"))
    cl = p.select("file_path", F.explode("classes").alias("c")).where("c.depth = 0").select("file_path", "c.ord", "c.name").orderBy("file_path", "ord").limit(10).agg(F.sort_array(F.collect_list(F.struct("file_path", "ord", "name"))).alias("c"))
    total = p.agg(F.count("*").alias("modules"), F.coalesce(F.sum("total_lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.size(F.filter("classes", lambda c: c["depth"] == 0))), F.lit(0)).alias("classes"), F.coalesce(F.sum(F.size(F.filter("callables", lambda c: c["class_ord"].isNull()))), F.lit(0)).alias("functions"))
    return total.crossJoin(some).crossJoin(cl).select("modules", "lines", "classes", "functions", F.transform("m", lambda x: x["name"]).alias("first_modules"), F.transform("c", lambda x: x["name"]).alias("first_classes"))  # single rows


def render(data: dict, how: str = "json", most: int = 10) -> str:
    """JSON or Markdown of a collected summary."""
    import json

    if how == "json":
        return json.dumps(data, indent=2, default=str)
    out = []
    for k, v in data.items():
        title = str(k).replace("_", " ").title()
        if isinstance(v, dict):
            out += [f"## {title}", *(f"- **{a}**: {b}" for a, b in v.items())]
        elif isinstance(v, (list, tuple)):
            out += [f"## {title}", *(f"- {x}" for x in v[:most])] + ([f"- ... and {len(v) - most} more"] if len(v) > most else [])
        else:
            out.append(f"**{title}**: {v}")
    return "\n".join(out)
