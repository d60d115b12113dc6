"""Directories of source files as a table of sources, and small sinks and settings."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field
from fnmatch import fnmatch
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDE = ("**/__pycache__/**", "**/.git/**", "**/venv/**", "**/node_modules/**")


def find_files(directory, include=("*.py",), exclude=EXCLUDE, follow_symlinks: bool = False, max_depth: int | None = None) -> list[str]:
    """Paths, sorted. Excludes match the relative path or the name, includes the name; directories with a leading dot are skipped."""
    root, out = Path(directory), []

    def walk(d: Path, depth: int) -> None:
        if max_depth is not None and depth > max_depth:
            return
        try:
            inside = sorted(d.iterdir())
        except PermissionError:
            return
        for p in inside:
            if p.is_symlink() and not follow_symlinks:
                continue
            rel = p.relative_to(root).as_posix()
            if p.is_dir():
                if not p.name.startswith("."):
                    walk(p, depth + 1)
            elif not any(fnmatch(rel, x) or fnmatch(p.name, x) for x in exclude) and any(fnmatch(p.name, x) for x in include):
                out.append(str(p))

    walk(root, 0)
    return sorted(out)


def read_sources(spark: SparkSession, directory, relative: bool = True, **how) -> DataFrame:
    """file_path, ord, content, content_md5. The driver lists paths; executors read and decode (UTF-8, else Latin-1).

    Spark's own file sources skip names with a leading underscore, so they can't be used.
    """
    import pyarrow as pa

    from skein.runtime import ready

    root, paths = str(directory), find_files(directory, **how)
    ready(spark)

    def run(it):
        for b in it:
            raw = [Path(p).read_bytes() for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["ord", "file_path", "raw"])

    d = spark.createDataFrame(list(enumerate(paths)), "ord int, file_path string")
    d = d.repartition(max(1, min(len(paths) // 16, 4096)), "ord").mapInArrow(run, "ord int, file_path string, raw binary")
    path = F.substring("file_path", len(root.rstrip("/")) + 2, 1 << 30) if relative else F.col("file_path")
    return d.select(path.alias("file_path"), "ord", decode(F.col("raw")).alias("content"), F.md5("raw").alias("content_md5"))


def decode(raw):
    return F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))


def new_or_changed(sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """Sources whose (path, hash) is not among those parsed before: a parse cache as an anti-join."""
    return sources.join(parsed.select("file_path", "content_md5"), ["file_path", "content_md5"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


CONFIG = ("skein.json", "skein.yaml", "skein.yml", ".skein.json", ".skein.yaml")


@dataclass
class Settings:
    """What the engine does. Files may hold any of these names; SKEIN_<NAME> in the environment wins."""

    include: list[str] = field(default_factory=lambda: ["*.py"])
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    patterns: bool = True
    security: bool = True
    dependencies: bool = True
    profile: str = "full"
    min_duplicate_lines: int = 5
    secret_patterns: list[list[str]] = field(default_factory=list)

    @classmethod
    def load(cls, path: str | None = None, env=os.environ) -> Settings:
        got = {}
        if path:
            text = Path(path).read_text()
            if path.endswith((".yml", ".yaml")):
                import yaml

                got = yaml.safe_load(text) or {}
            else:
                got = json.loads(text)
        s = cls(**{k: v for k, v in got.items() if k in cls.__dataclass_fields__})
        for k in cls.__dataclass_fields__:
            if (x := env.get(f"SKEIN_{k.upper()}")) is not None:
                old = getattr(s, k)
                setattr(s, k, x.lower() in ("1", "true", "yes") if isinstance(old, bool) else type(old)(x.split(",") if isinstance(old, list) else x))
        return s

    @classmethod
    def discover(cls, start=None, env=os.environ) -> Settings:
        """Settings from the first file named CONFIG in start, the working folder or the home folder, else the defaults."""
        for d in (Path(start) if start else Path.cwd(), Path.cwd(), Path.home()):
            for name in CONFIG:
                if (d / name).is_file():
                    return cls.load(str(d / name), env)
        return cls.load(None, env)

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


DEMO = {
    "shop/__init__.py": '"""A small shop."""\nfrom .cart import Cart\n',
    "shop/cart.py": '"""Carts and prices."""\nimport os\n\nLIMIT = 20\n\n\nclass Cart:\n    """Things to buy."""\n\n    def __init__(self):\n        self.lines = []\n\n    def add(self, name: str, price: float = 0.0) -> None:\n        """Put a thing in."""\n        self.lines.append((name, price))\n\n    def total(self) -> float:\n        """Sum of prices."""\n        return sum(p for _, p in self.lines)\n\n    def clear(self) -> None:\n        """Take all out."""\n        self.lines = []\n',
    "shop/users.py": '"""People."""\nfrom shop.cart import Cart\n\nPASSWORD = "hunter2-forever"\n\n\ndef login(name: str, word: str) -> bool:\n    """Let someone in."""\n    return word == PASSWORD\n\n\nasync def fetch(url):\n    """Get a page."""\n    return eval(url)\n',
    "shop/flow.py": '"""Steps over rows."""\nimport json\n\n\ndef load(text):\n    """Rows of a text."""\n    for row in json.loads(text):\n        if row:\n            yield row\n',
}
QUESTIONS = [
    "How is a total computed?", "Where do people log in?", "Which function reads rows?", "What does Cart do?",
    "How do I empty a cart?", "Is there anything unsafe here?", "Which module is asynchronous?", "What is the limit of a cart?",
]


def demo_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, i, t) for i, (p, t) in enumerate(DEMO.items())], "file_path string, ord int, content string")
