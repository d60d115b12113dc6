"""Corpus preparation in five stages; each works on all that the one before kept.

1. toxicity: documents that the induced lexicon rejects go. It is fitted on labelled
   documents of the stage's own input.
2. near_dedup: of each group of documents linked by close SimHash fingerprints, the one with
   the smallest doc_id stays (of its texts one, of equal rows one). Texts that share an id
   but no likeness are judged apart. Rows with null doc_id stay.
3. decontaminate: documents that hold a benchmark item go.
4. pii: personal data are replaced by the names of their kinds; n_chars follows.
5. pack: what is left becomes token sequences of at most 4096, one row per piece.

Stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.llm import decontaminate as bench
from skein.llm import packing, pii, simhash, toxicity
from skein.llm.labelled import crc_mod
from skein.runtime import drop_table, read, settled


def drop_toxic(spark, docs, sf_dir):
    lexicon = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.keep_clean(docs, lexicon)


def near_dedup(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    return bench.clean(docs, read(spark, sf_dir, "benchmark"))


def redact(spark, docs, sf_dir):
    return pii.redact(docs, pii.learn(docs))


def pack(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", redact), ("pack", pack)]
ORACLE_SQL = None  # no stage but the last could be said in SQL; tests/llm/test_pipeline.py holds it against brute force


def run(spark, sf_dir):
    """The stages, one after the other, on documents. What a stage wrote on the way goes with it; of the stages' results only the last stays, as what is returned reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        drop_table(before)  # a stage's table; documents themselves are none
    return STAGES[-1][1](spark, docs, sf_dir)
