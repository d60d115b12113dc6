"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of a number's text, modulo m; null stays null."""
    return F.crc32(col.cast("string")) % m


def sample(labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE) -> DataFrame:
    """At most `rows` pairs doc_id, y of the labelled ids that `keep` admits, the first by a hash of the id.

    Null ids and labels are left out; an id labelled more than once counts with its largest label.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sampled_documents(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text, y of a bounded sample() (broadcast: at most its row bound); an id's repeated rows count once, different texts by their smallest hash."""
    d = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return d.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("s")).select("doc_id", "s.text", "s.y")
