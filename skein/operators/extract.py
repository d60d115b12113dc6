"""Entity tables from a table of sources(file_path, content).

Every table function projects what it needs before the parse, and explodes in the JVM.
Defined results: null content is an empty file; null paths are parsed like others; a file
that does not parse gives one row in errors() and none elsewhere; an empty table gives empty
tables; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.runtime import ready
from skein.sources import pysource


def _rows(sources: DataFrame, fn, schema: str, many: bool = False, own=None) -> DataFrame:
    """fn(path, text) for each row. own: column -> function of the path, for all columns that depend on the path; then texts that occur often in a batch are parsed once for it."""
    ready(sources.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(it):
        for b in it:
            lo = 0
            while lo < b.num_rows:
                part = b.slice(lo, SHARED)
                if part.nbytes > SHARED_BYTES:
                    part = b.slice(lo, 200)
                if own and part.num_rows > 2:
                    code = part.column(1).dictionary_encode(null_encoding="encode")
                    if 2 * len(code.dictionary) <= part.num_rows:
                        one = pa.RecordBatch.from_pylist([fn(None, t) for t in code.dictionary.to_pylist()], schema=arrow).take(code.indices)
                        paths = part.column(0).to_pylist()
                        cols = [pa.array(map(own[f.name], paths), f.type) if f.name in own else one.column(f.name) for f in arrow]
                        yield pa.RecordBatch.from_arrays(cols, schema=arrow)
                        lo += part.num_rows
                        continue
                part = b.slice(lo, 200)  # bounded output batches
                got = [fn(p, t) for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_pylist([x for g in got for x in g] if many else got, schema=arrow)
                lo += part.num_rows

    return sources.select("file_path", "content").mapInArrow(run, kind)


SHARED, SHARED_BYTES = 2000, 256 << 10  # rows, and bytes of paths and texts, in which equal texts are looked for
PATH = {"file_path": lambda p: p}
NAMED = PATH | {"name": pysource.stem}


PARSERS = {".py": pysource.entities, ".pyw": pysource.entities}


def entities(sources: DataFrame, parsers: dict | None = None, light: bool = False) -> DataFrame:
    """One row per file with its classes, callables, imports and variables as lists.

    light: parameters, return types, docstrings and local names of callables stay empty, for
    questions about calls alone.

    parsers: extension -> function(path, text) giving a row of pysource.ENTITIES; files of
    other extensions, and text without one, are read as Python.
    """
    if light and not parsers:
        return _rows(sources, lambda p, t: pysource.entities(p, t, True), pysource.ENTITIES, own=NAMED)
    known = PARSERS | (parsers or {})
    if set(known.values()) == {pysource.entities}:
        return _rows(sources, pysource.entities, pysource.ENTITIES, own=NAMED)
    return _rows(sources, lambda p, t: known.get("." + (p or "").rpartition(".")[2], pysource.entities)(p, t), pysource.ENTITIES)


def calls(sources: DataFrame) -> DataFrame:
    """Of callables() what questions about calls need: file_path, class_name, class_depth, name, start_line, calls."""
    c = _rows(sources, pysource.calls, pysource.CALLS, own=PATH)
    return c.select("file_path", F.explode("callables").alias("x")).select("file_path", "x.*")


def found_nodes(sources: DataFrame) -> DataFrame:
    """Rows of ast_nodes() that have a rule, with file_path, kind, line, rule and detail only: no other node leaves the parser."""
    n = _rows(sources, pysource.found, pysource.FOUND, own=PATH)
    return n.select("file_path", F.explode("nodes").alias("n")).select("file_path", "n.*")


def ast_nodes(sources: DataFrame) -> DataFrame:
    n = _rows(sources, pysource.nodes, pysource.NODES, own=PATH)
    return n.select("file_path", "error", F.explode_outer("nodes").alias("n")).select("file_path", "error", "n.*")


def file_numbers(sources: DataFrame) -> DataFrame:
    """One row per file with every count that metrics need, from one parse; nothing is shuffled."""
    return _rows(sources, pysource.numbers, pysource.NUMBERS, own=PATH)


def line_counts(sources: DataFrame) -> DataFrame:
    return _rows(sources, pysource.tokens, pysource.TOKENS, own=PATH)


def code_blocks(sources: DataFrame, least: int = 5) -> DataFrame:
    return _rows(sources, lambda p, t: pysource.blocks(p, t, least), "file_path string, name string, start_line int, end_line int, hash string", many=True)


def _each(parsed: DataFrame, what: str) -> DataFrame:
    return parsed.select("file_path", F.col("name").alias("module_name"), F.explode(what).alias("x")).select("file_path", "module_name", "x.*")


def modules(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").select("file_path", "name", "total_lines", "doc", F.size("classes").alias("n_classes"), F.size("callables").alias("n_callables"), F.size("imports").alias("n_imports"))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("file_path", "error", "error_line")


def classes(parsed: DataFrame) -> DataFrame:
    return _each(parsed, "classes").withColumn("lines", F.col("end_line") - F.col("start_line") + 1)


def callables(parsed: DataFrame) -> DataFrame:
    """Functions and methods, with the name and nesting depth of a method's class."""
    owner = F.try_element_at(F.filter("classes", lambda c: c["ord"] == F.col("x.class_ord")), F.lit(1))
    flat = parsed.select("file_path", F.col("name").alias("module_name"), "classes", F.explode("callables").alias("x"))
    flat = flat.select("file_path", "module_name", F.when(F.col("x.class_ord").isNotNull(), owner["name"]).alias("class_name"), F.when(F.col("x.class_ord").isNotNull(), owner["depth"]).alias("class_depth"), "x.*")
    return flat.withColumn("lines", F.col("end_line") - F.col("start_line") + 1)


def imports(parsed: DataFrame) -> DataFrame:
    i = _each(parsed, "imports")
    used = F.coalesce(F.nullif("alias", F.lit("")), F.nullif("name", F.lit("")), "module")
    return i.withColumn("is_relative", F.col("level") > 0).withColumn("used_name", used).withColumn("full_name", F.when(F.col("is_from"), F.concat_ws(".", F.nullif("module", F.lit("")), "name")).otherwise(F.col("module")))


def variables(parsed: DataFrame) -> DataFrame:
    return _each(parsed, "variables")


def class_members(parsed: DataFrame, nested: bool = False) -> DataFrame:
    """Classes with their own methods and class variables as lists; top-level ones unless nested."""
    c = parsed.select("file_path", F.explode("classes").alias("c"), "callables", "variables")
    if not nested:
        c = c.where("c.depth = 0")
    return c.select(
        "file_path", "c.*",
        F.filter("callables", lambda m: m["class_ord"] == F.col("c.ord")).alias("methods"),
        F.filter("variables", lambda v: v["class_ord"] == F.col("c.ord")).alias("class_vars"),
    ).withColumn("lines", F.col("end_line") - F.col("start_line") + 1)


def location(start="start_line", end="end_line") -> Column:
    """struct(file, start_line, end_line, start_col, end_col, line_count) of a class or callable row."""
    return F.struct(F.col("file_path").alias("file"), F.col(start).alias("start_line"), F.col(end).alias("end_line"), "start_col", "end_col", (F.col(end) - F.col(start) + 1).alias("line_count"))


def is_optional(param: Column) -> Column:
    """A parameter that need not be given: it has a default or is annotated Optional."""
    return param["default"].isNotNull() | F.coalesce(param["annotation"].contains("Optional"), F.lit(False))


def to_json(entities_: DataFrame, *cols: str) -> Column:
    """A row of any entity table as a JSON object of its columns (nulls included)."""
    return F.to_json(F.struct(*(cols or entities_.columns)), {"ignoreNullFields": "false"})
