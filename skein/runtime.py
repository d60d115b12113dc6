"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = str(8 << 20)
ROOT = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and keep their memory low.

    On a cluster without a shared code folder, ship the package with --py-files instead. Arrow
    batches of whole texts are kept at BATCH bytes where the session has Spark's default, and
    workers' allocators give freed memory back: several operators may run in one worker.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("64MB", "67108864b", str(64 << 20)):  # no default given here: it would hide Spark's
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    env = spark.sparkContext.environment
    env.setdefault("MALLOC_ARENA_MAX", "1")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(64 << 20))
    env.setdefault("MALLOC_MMAP_THRESHOLD_", str(32 << 20))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else a local one (single-machine tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import atexit
        import shutil
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="skein-")
        atexit.register(shutil.rmtree, at[7:], True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_made: list[DataFrame] = []


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder (a folder of the application's own) and read it back."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._skein_path = at
    _made.append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what table() wrote, once no later plan reads it."""
    at = getattr(df, "_skein_path", None)
    if at:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _made[:] = [t for t in _made if t._skein_path != at]


def settled(make, name: str = "t") -> DataFrame:
    """table(make(), name), and all tables that were written on the way are deleted: the result stands by itself."""
    before = {t._skein_path for t in _made}
    out = table(make(), name)
    for t in [t for t in _made if t._skein_path not in before and t is not out]:
        drop_table(t)
    return out


def clear_tables() -> None:
    """Delete every table of this process that is still there; results that read them are void then."""
    for t in list(_made):
        drop_table(t)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
