"""File metrics. extract.file_numbers() has a file's counts in one row; every derived value is a Column over it.

complexity(), loc() and halstead() also take node and line-count rows (extract.ast_nodes(), extract.line_counts()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.extract import file_numbers


def _grade(c: Column, cuts: list[tuple[float, str]], up: bool) -> Column:
    out = None
    for cut, name in cuts:
        cond = c >= cut if up else c <= cut
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("F")


def complexity_rating(c: Column) -> Column:
    return _grade(c, [(5, "A"), (10, "B"), (20, "C"), (30, "D")], False)


def index_rating(c: Column) -> Column:
    return _grade(c, [(85, "A"), (70, "B"), (50, "C"), (25, "D")], True)


def complexity(nodes: DataFrame) -> DataFrame:
    """cyclomatic, cognitive, max_nesting per file; files that don't parse get 1, 0, 0. nodes: node rows, or file_numbers()."""
    if "max_nesting" in nodes.columns:
        return nodes.select("file_path", "cyclomatic", "cognitive", "max_nesting", complexity_rating(F.col("cyclomatic")).alias("rating"))
    g = nodes.groupBy("file_path").agg(
        (F.lit(1) + F.coalesce(F.sum("cyclomatic"), F.lit(0))).alias("cyclomatic"), F.coalesce(F.sum("cognitive"), F.lit(0)).alias("cognitive"), F.coalesce(F.max("nesting"), F.lit(0)).cast("long").alias("max_nesting")
    )
    return g.withColumn("rating", complexity_rating(F.col("cyclomatic")))


def loc_columns(d: DataFrame) -> DataFrame:
    """Adds source, comments, docstrings and both ratios to line counts."""
    n = lambda c: F.col(c).cast("long")
    d = d.withColumn("total", n("total")).withColumn("blank", n("blank")).withColumn("source", (F.col("total") - F.col("blank") - F.col("hash_lines")).cast("long"))
    d = d.withColumn("comments", n("comment_lines")).withColumn("docstrings", n("docstring_lines"))
    ratio = lambda x: F.when(F.col("source") > 0, x / F.col("source")).otherwise(0.0)
    return d.withColumn("comment_ratio", ratio(F.col("comments"))).withColumn("documentation_ratio", ratio(F.col("comments") + F.col("docstrings")))


def loc(counts: DataFrame) -> DataFrame:
    """counts: extract.line_counts() or file_numbers()."""
    return loc_columns(counts).select("file_path", "total", "blank", "source", "comments", "docstrings", "comment_ratio", "documentation_ratio")


def halstead(nodes: DataFrame) -> DataFrame:
    """Counts and measures per file. nodes: node rows, or file_numbers()."""
    if "n1" in nodes.columns:
        return measures(nodes.select("file_path", "n1", "n2", "operators", "operands"))
    # a file's operator and operand lists are bounded by the file
    g = nodes.groupBy("file_path").agg(F.flatten(F.collect_list("operators")).alias("ops"), F.flatten(F.collect_list("operands")).alias("own"))
    num = lambda c: F.size(c).cast("long")
    return measures(g.select("file_path", num(F.array_distinct("ops")).alias("n1"), num(F.array_distinct("own")).alias("n2"), num("ops").alias("operators"), num("own").alias("operands")))


def measures(g: DataFrame) -> DataFrame:
    """Adds the measures that follow from n1, n2, operators and operands."""
    n1, n2, N1, N2 = (F.col(x).cast("double") for x in ("n1", "n2", "operators", "operands"))
    g = g.withColumn("vocabulary", F.col("n1") + F.col("n2")).withColumn("length", F.col("operators") + F.col("operands"))
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    g = g.withColumn("calculated_length", F.when(both, n1 * F.log2(n1) + n2 * F.log2(n2)).otherwise(0.0))
    g = g.withColumn("volume", F.when(F.col("vocabulary") > 0, F.col("length") * F.log2(F.col("vocabulary").cast("double"))).otherwise(0.0))
    g = g.withColumn("difficulty", F.when(F.col("n2") > 0, n1 / 2 * N2 / n2).otherwise(0.0)).withColumn("effort", F.col("difficulty") * F.col("volume"))
    return g.withColumn("time", F.col("effort") / 18).withColumn("bugs", F.col("volume") / 3000)


def _index(d: DataFrame) -> DataFrame:
    share = F.when(F.col("total") > 0, (F.col("comments") + F.col("docstrings")) / F.col("total")).otherwise(0.0)
    raw = 171 - 5.2 * F.log("volume") - 0.23 * F.col("cyclomatic") - 16.2 * F.log(F.col("source").cast("double")) + F.when(share > 0, 50 * F.sin(F.sqrt(2.4 * share))).otherwise(0.0)
    mi = F.when((F.col("source") == 0) | (F.col("volume") == 0), 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 100 / 171)))
    return d.withColumn("maintainability", mi).withColumn("rating", index_rating(F.col("maintainability")))


def maintainability(files: DataFrame) -> DataFrame:
    """files: file_metrics()."""
    return files.select("file_path", "cyclomatic", "source", "volume", "maintainability", "rating")


def quality(mi: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """issues: file_path, smells, anti, security, style counts."""
    points = lambda c: F.element_at(F.create_map(*(F.lit(x) for p in (("A", 100.0), ("B", 80.0), ("C", 60.0), ("D", 40.0), ("F", 20.0)) for x in p)), c)
    d = mi.withColumn("base", (points(complexity_rating(F.col("cyclomatic"))) + points(F.col("rating"))) / 2)
    off = F.lit(0.0)
    if issues is not None:
        d = d.join(issues, "file_path", "left").fillna(0, ["smells", "anti", "security", "style"])
        off = 2.0 * F.col("smells") + 5.0 * F.col("anti") + 10.0 * F.col("security") + 1.0 * F.col("style")
    return d.withColumn("score", F.col("base") - off).select("file_path", "score", index_rating(F.col("score")).alias("overall"))


def file_metrics(sources: DataFrame) -> DataFrame:
    """All of a file's numbers in one row, from one parse and without a shuffle."""
    return _index(loc_columns(measures(file_numbers(sources))).drop("error", "hash_lines", "comment_lines", "docstring_lines"))


def fallback_loc(sources: DataFrame) -> DataFrame:
    """Line counts without a tokenizer: only lines that begin with # are comments, of those inside a triple-quoted text none; docstrings are 0.

    A text is taken to be open from a line that holds its quotes once to the next line that holds them.
    """
    lines = F.split(F.coalesce("content", F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    s = sources.select("file_path", lines.alias("l"))
    s = s.select("file_path", F.when(F.element_at("l", -1) == "", F.slice("l", 1, F.size("l") - 1)).otherwise(F.col("l")).alias("l"))
    s = s.withColumn("l", F.transform("l", lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    count = lambda x, q: (F.length(x) - F.length(F.replace(x, F.lit(q), F.lit("")))) / 3
    two, one = '"' * 3, "'" * 3
    opens = lambda x: F.when(x.contains(two), F.when(count(x, two) == 1, two).otherwise("")).when(x.contains(one), F.when(count(x, one) == 1, one).otherwise("")).otherwise("")
    start = F.struct(F.lit("").alias("q"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.when(x == "", a).when(a["q"] == "", F.when(x.startswith("#"), F.struct(F.lit("").alias("q"), (a["n"] + 1).alias("n"))).otherwise(F.struct(opens(x).alias("q"), a["n"].alias("n")))).when(x.contains(a["q"]), F.struct(F.lit("").alias("q"), a["n"].alias("n"))).otherwise(a)
    total, blank = F.size("l").cast("long"), F.size(F.filter("l", lambda x: x == "")).cast("long")
    d = s.select("file_path", total.alias("total"), blank.alias("blank"), F.aggregate("l", start, step)["n"].alias("comments"))
    return d.select("file_path", "total", (F.col("total") - F.col("blank") - F.col("comments")).alias("source"), "comments", "blank", F.lit(0).cast("long").alias("docstrings"))


def project_metrics(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.sum("total").alias("total_lines"), F.sum("source").alias("source_lines"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"), F.avg("maintainability").alias("avg_maintainability")
    )
