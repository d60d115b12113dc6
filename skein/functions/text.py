"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = "the and for are but not you all can her was one our out has have this that with from".split()


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _lines(c: Column) -> Column:
    parts = F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def count_lines(c: Column) -> Column:
    """struct(total, blank, non_blank)"""
    lines = _lines(c)
    blank = F.size(F.filter(lines, lambda x: F.regexp_replace(x, r"(?U)\s+", "") == ""))
    return F.struct(F.size(lines).cast("long").alias("total"), blank.cast("long").alias("blank"), (F.size(lines) - blank).cast("long").alias("non_blank"))


def truncate(c: Column, limit: int, suffix: str = "...") -> Column:
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit - len(suffix)), F.lit(suffix)))


def identifiers(c: Column) -> Column:
    """In order, with repeats. Words are cut at all that is no letter, digit or underscore, so that no engine's word boundary matters."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"))


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "(.)([A-Z][a-z]+)", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def _title(c: Column) -> Column:
    """Upper case after every non-letter, lower case after a letter."""
    parts = F.regexp_extract_all(c, F.lit(r"[a-zA-Z]+|[^a-zA-Z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def pascal_case(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "_"), _title), "")


def camel_case(c: Column) -> Column:
    parts = F.split(c, "_")
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _title), ""))


def keywords(c: Column) -> Column:
    """Lower-case terms of three letters or more that are no stop words, with repeats."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-z_][a-z0-9_]*$") & (F.length(x) > 2) & ~x.isin(*STOP))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4)


def is_test_path(c: Column) -> Column:
    base = F.regexp_extract(c, r"([^/]*)$", 1)
    return base.startswith("test_") | base.endswith("_test.py") | F.array_contains(F.split(c, "/"), "tests")


def visibility(c: Column) -> Column:
    return F.when(c.startswith("__") & ~c.endswith("__"), "private").when(c.startswith("_"), "protected").otherwise("public")


def docstring(c: Column) -> Column:
    """struct(summary, description): the first line of the stripped text, and what follows."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    rest = F.regexp_replace(F.substr(t, F.length(F.substring_index(t, "\n", 1)) + 2), r"(?U)^\s+|\s+$", "")
    return F.struct(F.substring_index(t, "\n", 1).alias("summary"), F.nullif(rest, F.lit("")).alias("description"))
