"""python -m skein.plans.cli analyze|query|summary|metrics|ask PATH ..., rag index|ask|search|clear|stats ..., init FILE"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from skein.operators.lookup import render
from skein.operators.retrieval import Index
from skein.plans.engine import Engine
from skein.sources.files import Settings


def _options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="skein")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("analyze", "query", "summary", "metrics", "ask"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("question", nargs="?", default="")
        c.add_argument("-f", "--format", choices=["json", "markdown"], default="markdown")
        c.add_argument("-o", "--output")
        c.add_argument("-c", "--config")
        c.add_argument("--no-security", action="store_true")
        c.add_argument("--no-patterns", action="store_true")
    c = sub.add_parser("init")
    c.add_argument("path", nargs="?", default="skein.json")
    rag = sub.add_parser("rag").add_subparsers(dest="rag", required=True)
    for name, args in (("index", ["path"]), ("ask", ["question"]), ("search", ["question"]), ("clear", []), ("stats", [])):
        c = rag.add_parser(name)
        for x in args:
            c.add_argument(x)
        c.add_argument("--store", default=".skein-index")
        c.add_argument("--top", type=int, default=10)
        c.add_argument("--kind", default="qa")
        c.add_argument("--entity")
        c.add_argument("--renew", action="store_true")
        c.add_argument("-f", "--format", choices=["json", "markdown"], default="markdown")
        c.add_argument("-o", "--output")
    return p


def _rag(a, spark) -> tuple[int, dict]:
    index = Index(spark, str(Path(a.store).resolve()))
    if a.rag == "index":
        counts = index.add(_analysis(Engine(spark), a.path).parsed, clear=a.renew)
        return 0, {"chunks": {r.entity_type: r["count"] for r in counts.collect()}, "store": a.store}
    if a.rag == "clear":
        index.clear()
        return 0, {"cleared": a.store}
    if not index.is_indexed():
        return 1, {"error": f"no index in {a.store}"}
    if a.rag == "stats":
        return 0, {"chunks": {r.entity_type: r["count"] for r in index.stats().collect()}}
    if a.rag == "ask":
        return 0, index.ask(a.question, a.kind, a.top)
    return 0, {"results": [r.asDict() for r in index.search(a.question, a.top, a.entity).drop("content").collect()]}


def _analysis(engine: Engine, path: str):
    return engine.analyze_file(path) if Path(path).is_file() else engine.analyze_directory(path)


def _tell(a, out) -> None:
    text = out if isinstance(out, str) else render(out, a.format)
    if a.output:
        Path(a.output).write_text(text)
    else:
        print(text)


def main(argv: list[str] | None = None) -> int:
    a = _options().parse_args(argv)
    if a.what == "init":
        if Path(a.path).exists():
            print(f"{a.path} is there already")
            return 1
        Settings().save(a.path)
        return 0
    spark = SparkSession.builder.getOrCreate()
    if a.what == "rag":
        code, out = _rag(a, spark)
        _tell(a, out)
        return code
    s = Settings.load(a.config) if a.config else Settings.discover(a.path)
    s.security, s.patterns = s.security and not a.no_security, s.patterns and not a.no_patterns
    r = _analysis(Engine(spark, s), a.path)
    if a.what == "query":
        out = {"results": [x.asDict() for x in r.ask(a.question).collect()]}
    elif a.what == "ask":
        i = Index(spark)
        i.add(r.parsed)
        out = i.ask(a.question)
    elif a.what == "metrics":
        out = {"files": [x.asDict() for x in r.metrics.orderBy("file_path").collect()]}
    elif a.what == "summary":
        out = r.report(a.format)
    else:
        out = r.summary()
        out["issues"] = [x.asDict() for x in r.findings().orderBy("file_path", "line").collect()]
    _tell(a, out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
