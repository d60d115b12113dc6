"""The engine as plain functions. Each takes a path or text and a SparkSession (the active one if none is given)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skein.operators import extract
from skein.plans.engine import Analysis, Engine
from skein.sources.files import Settings


def _engine(spark: SparkSession | None, settings: Settings | None = None) -> Engine:
    return Engine(spark or SparkSession.builder.getOrCreate(), settings)


def analyze_file(path, settings: Settings | None = None, spark: SparkSession | None = None) -> Analysis:
    return _engine(spark, settings).analyze_file(path)


def analyze_directory(path, settings: Settings | None = None, spark: SparkSession | None = None) -> Analysis:
    return _engine(spark, settings).analyze_directory(path)


def analyze_code(code: str, filename: str = "<string>", settings: Settings | None = None, spark: SparkSession | None = None) -> Analysis:
    return _engine(spark, settings).analyze_code(code, filename)


def analyze(path, settings: Settings | None = None, spark: SparkSession | None = None) -> Analysis:
    """A file or a directory."""
    return (analyze_file if Path(path).is_file() else analyze_directory)(path, settings, spark)


def parse_code(code: str, filename: str = "<string>", spark: SparkSession | None = None) -> DataFrame:
    return analyze_code(code, filename, spark=spark).parsed


def parse_file(path, spark: SparkSession | None = None) -> DataFrame:
    return analyze_file(path, spark=spark).parsed


def metrics_of(path, spark: SparkSession | None = None) -> DataFrame:
    return analyze(path, spark=spark).metrics


def security_of(path, spark: SparkSession | None = None) -> DataFrame:
    """Vulnerabilities and secrets."""
    return analyze(path, spark=spark).findings().where("detector in ('vulnerability', 'secret')")


def patterns_of(path, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    a = analyze(path, spark=spark)
    return {"design_patterns": a.design_patterns, "anti_patterns": a.anti_patterns, "smells": a.smells}


def query_code(path, question: str, spark: SparkSession | None = None) -> DataFrame:
    return analyze(path, spark=spark).ask(question)


def summary_of(path, how: str = "markdown", spark: SparkSession | None = None) -> str:
    return analyze(path, spark=spark).report(how)


def errors_of(path, spark: SparkSession | None = None) -> DataFrame:
    return extract.errors(analyze(path, spark=spark).parsed)
