"""Views of modules and analyses for readers: JSON and Markdown, as Column expressions over parsed files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _parts() -> tuple[Column, Column]:
    return F.filter("classes", lambda c: c["depth"] == 0), F.filter("callables", lambda c: c["class_ord"].isNull())


def _methods(c: Column) -> Column:
    return F.transform(F.filter("callables", lambda m: m["class_ord"] == c["ord"]), lambda m: m["name"])


def module_json(parsed: DataFrame, *, structure: bool = True, dependencies: bool = True) -> DataFrame:
    """file_path, view: what a module holds as one JSON object."""
    top, funcs = _parts()
    summary = F.struct(F.size(top).alias("classes"), F.size(funcs).alias("functions"), F.size("imports").alias("imports"), F.col("total_lines").alias("lines"), F.col("doc").isNotNull().alias("has_docstring"))
    cols = [F.struct("name", F.col("file_path").alias("file"), summary.alias("summary")).alias("module")]
    if structure:
        classes = F.transform(top, lambda c: F.struct(c["name"].alias("name"), c["bases"].alias("bases"), _methods(c).alias("methods"), c["is_abstract"].alias("is_abstract")))
        functions = F.transform(funcs, lambda f: F.struct(f["name"].alias("name"), F.transform(f["params"], lambda p: p["name"]).alias("params"), f["returns"].alias("returns"), f["is_async"].alias("is_async")))
        cols.append(F.struct(classes.alias("classes"), functions.alias("functions")).alias("structure"))
    if dependencies:
        cols.append(F.transform("imports", lambda i: F.struct(i["module"].alias("module"), i["name"].alias("name"), (i["level"] > 0).alias("is_relative"))).alias("imports"))
    return parsed.where("error is null").select("file_path", _json(F.struct(*cols)).alias("view"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def module_markdown(parsed: DataFrame, most: int = 10) -> DataFrame:
    """file_path, view: the same for people; of a class's methods the first `most`."""
    top, funcs = _parts()
    first = lambda doc: F.when(doc.isNotNull(), F.concat(F.substring_index(doc, "\n", 1), F.lit("\n")))

    def klass(c):
        own = _methods(c)
        listed = F.when(F.size(own) > 0, F.concat(F.lit("**Methods:**\n"), F.array_join(F.transform(F.slice(own, 1, most), lambda m: F.concat(F.lit("- `"), m, F.lit("()`\n"))), "")))
        return _lines(F.concat(F.lit("### `"), c["name"], F.lit("`\n")), F.when(F.size(c["bases"]) > 0, F.concat(F.lit("**Inherits:** "), F.array_join(c["bases"], ", "), F.lit("\n"))), first(c["doc"]), listed)

    def func(f):
        sign = F.concat(F.lit("def "), f["name"], F.lit("("), F.array_join(F.transform(f["params"], lambda p: p["name"]), ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), f["returns"]), F.lit("")))
        return _lines(F.concat(F.lit("### `"), f["name"], F.lit("`\n")), F.concat(F.lit("```python\n"), sign, F.lit("\n```\n")), first(f["doc"]))

    part = lambda title, items: F.when(F.size(items) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(items, "\n")))
    counts = _lines(*(F.concat(F.lit(f"- **{t}:** "), F.size(x).cast("string")) for t, x in (("Classes", top), ("Functions", funcs), ("Imports", F.col("imports")))))
    view = _lines(
        F.concat(F.lit("# Module: "), "name", F.lit("\n")), F.concat(F.lit("**File:** `"), "file_path", F.lit("`\n")),
        F.when(F.col("doc").isNotNull(), F.concat(F.lit("## Description\n\n"), F.substring_index("doc", "\n", 1), F.lit("\n"))),
        F.concat(F.lit("## Summary\n\n"), counts, F.lit("\n")), part("Classes", F.transform(top, klass)), part("Functions", F.transform(funcs, func)),
    )
    return parsed.where("error is null").select("file_path", view.alias("view"))


def analysis_json(summary: dict, modules: list[dict], issues: list[dict], most: int = 20) -> dict:
    """A report as a plain object: overview, modules, quality, and the first `most` issues."""
    keep = ("kind", "severity", "file_path", "line")
    return {"overview": summary, "modules": modules, "quality": {k: summary[k] for k in ("rating", "maintainability") if k in summary}, "issues": [{k: i.get(k) for k in keep} for i in issues[:most]]}


def analysis_markdown(summary: dict, issues: list[dict], most: int = 10) -> str:
    out = ["# Code Analysis Report", "", "## Overview", ""]
    out += [f"- **{k.replace('_', ' ').title()}:** {v}" for k, v in summary.items() if not isinstance(v, (dict, list))]
    if issues:
        out += ["", "## Issues Found", "", *(f"- **[{str(i.get('severity', 'info')).upper()}]** {i.get('kind')} ({i.get('file_path')}:{i.get('line')})" for i in issues[:most])]
    return "\n".join(out)
