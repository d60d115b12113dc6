"""The engine: sources in, entity tables and findings out, all of them lazy."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators import extract, findings, graph, lookup, metrics, patterns, views
from skein.runtime import drop_table, table
from skein.sources.files import Settings, new_or_changed, read_sources


class Analysis:
    """Everything known about one table of sources. Plans that no one asks for never run."""

    def __init__(self, sources: DataFrame, settings: Settings | None = None, cache: ParseCache | None = None):
        self.sources, self.settings, self.cache = sources, settings or Settings(), cache
        self.full = self.settings.profile == "full"

    @cached_property
    def parsed(self) -> DataFrame:
        return self.cache.parse(self.sources) if self.cache else extract.entities(self.sources).persist()

    @cached_property
    def nodes(self) -> DataFrame:
        return extract.ast_nodes(self.sources)

    modules = property(lambda self: extract.modules(self.parsed))
    classes = property(lambda self: extract.classes(self.parsed))
    callables = property(lambda self: extract.callables(self.parsed))
    imports = property(lambda self: extract.imports(self.parsed))
    variables = property(lambda self: extract.variables(self.parsed))
    errors = property(lambda self: extract.errors(self.parsed))
    members = property(lambda self: extract.class_members(self.parsed))
    metrics = property(lambda self: metrics.file_metrics(self.sources))
    design_patterns = property(lambda self: patterns.design_patterns(self.members))
    anti_patterns = property(lambda self: patterns.anti_patterns(self.members, self.callables))
    call_graph = property(lambda self: graph.call_edges(self.callables))
    module_graph = property(lambda self: graph.module_edges(graph.classify_imports(self.imports, self.sources)))
    secrets = property(lambda self: findings.secrets(self.variables, [tuple(x) for x in self.settings.secret_patterns]))
    duplicates = property(lambda self: findings.duplicates(findings.entity_blocks(self.callables, self.settings.min_duplicate_lines)))

    @property
    def smells(self) -> DataFrame:
        out = patterns.entity_smells(self.parsed, self.members, self.callables)
        return out.unionByName(patterns.node_smells(self.nodes), allowMissingColumns=True) if self.full else out

    @property
    def dead_code(self) -> DataFrame:
        return findings.dead_code(self.parsed, self.imports, self.callables, self.nodes if self.full else None)

    @property
    def vulnerabilities(self) -> DataFrame:
        out = findings.call_vulnerabilities(self.callables)
        return out.unionByName(findings.node_vulnerabilities(self.nodes), allowMissingColumns=True) if self.full else out

    @property
    def circular_dependencies(self) -> DataFrame:
        """Cycles, by the least file of the part of the graph they are in: parts hang together by imports, and each is walked by itself."""
        edges = self.module_graph
        e = edges.join(graph.connected(edges).select(F.col("node").alias("src"), F.col("root").alias("graph_id")), "src")
        order = Window.partitionBy("graph_id").orderBy("src", "dst")
        return graph.circular_dependencies(e.withColumn("ord", F.row_number().over(order)))

    def findings(self) -> DataFrame:
        """detector, kind, severity, file_path, line"""
        parts = [("smell", self.smells)]
        if self.settings.patterns:
            parts += [("anti_pattern", self.anti_patterns), ("dead_code", self.dead_code)]
        if self.settings.security:
            parts += [("vulnerability", self.vulnerabilities), ("secret", self.secrets.select("file_path", F.col("secret_type").alias("kind"), F.lit("high").alias("severity"), F.col("line_number").alias("line")))]
        out = None
        for name, d in parts:
            d = d if "severity" in d.columns else d.withColumn("severity", F.lit("info"))
            d = d.select(F.lit(name).alias("detector"), "kind", "severity", "file_path", "line")
            out = d if out is None else out.unionByName(d)
        return out

    def summary(self) -> dict:
        p = lookup.project_summary(self.parsed).first().asDict()
        counts = {r.detector: r["count"] for r in self.findings().groupBy("detector").count().collect()}
        return p | {"findings": counts, "security_issues": counts.get("vulnerability", 0) + counts.get("secret", 0), "errors": self.errors.count()}

    def report(self, how: str = "json") -> str:
        """The analysis for readers: totals, modules and the first issues."""
        issues = [r.asDict() for r in self.findings().orderBy("file_path", "line", "kind").limit(20).collect()]
        if how != "json":
            return views.analysis_markdown(self.summary(), issues)
        mods = [r.asDict() for r in self.modules.select("name", "file_path", "n_classes", "n_callables").orderBy("file_path").limit(20).collect()]
        return lookup.render(views.analysis_json(self.summary(), mods, issues), "json")

    def ask(self, question: str) -> DataFrame:
        return lookup.ask(question, self.classes, self.callables, self.imports)


class ParseCache:
    """Parsed files as a table: only sources whose content changed are parsed again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, None

    def parse(self, sources: DataFrame) -> DataFrame:
        """extract.entities() of all sources, with content_md5; what is known is not parsed again."""
        src = sources if "content_md5" in sources.columns else sources.withColumn("content_md5", F.md5("content"))
        if self.held is None:
            new = src
        else:
            new = new_or_changed(src, self.held)
        fresh = extract.entities(new).join(src.select("file_path", "content_md5"), "file_path")
        if self.held is not None:
            old = self.held
            fresh = old.join(src.select("file_path", "content_md5"), ["file_path", "content_md5"], "left_semi").unionByName(fresh)
        self.held = table(fresh, "parsed")
        return self.held

    def info(self) -> dict:
        return {"size": 0 if self.held is None else self.held.count()}

    def clear(self) -> None:
        if self.held is not None:
            drop_table(self.held)
        self.held = None


class Engine:
    """parse_cache: keep parsed files between analyses of this engine."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, parse_cache: bool = False):
        self.spark, self.settings = spark, settings or Settings()
        self.cache = ParseCache(spark) if parse_cache else None

    def analyze(self, sources: DataFrame) -> Analysis:
        return Analysis(sources, self.settings, self.cache)

    def analyze_directory(self, path) -> Analysis:
        return self.analyze(read_sources(self.spark, path, include=tuple(self.settings.include), exclude=tuple(self.settings.exclude)))

    def analyze_file(self, path) -> Analysis:
        from pathlib import Path

        p = Path(path)
        return self.analyze(read_sources(self.spark, p.parent, include=(p.name,), max_depth=0))

    def analyze_code(self, code: str, filename: str = "<string>") -> Analysis:
        return self.analyze(self.spark.createDataFrame([(filename, code)], "file_path string, content string"))
