"""Incremental analysis: new source rows in, findings appended, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skein.operators.extract import callables, entities
from skein.operators.findings import call_vulnerabilities

SOURCE = "file_path string, content string, content_md5 string"


def source_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of SOURCE rows that appear in a folder."""
    return spark.readStream.schema(SOURCE).parquet(path)


def watch(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """For each micro-batch, findings of its files go to out/batch=N; a batch done twice is written over."""

    def each(batch: DataFrame, n: int) -> None:
        latest = batch.dropDuplicates(["file_path", "content_md5"])
        call_vulnerabilities(callables(entities(latest))).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
