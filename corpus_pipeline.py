"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. Stages are written as Parquet and read again between one another; when one is
written, what it and its predecessors left in the shared folder goes.

Defined results: null and empty texts pass the first two stages and hold no benchmark item; those of them that share a
fingerprint are one group of near duplicates, of which one stays, and each takes one place in a sequence. A null doc_id is
scored, searched and packed like any other; of rows that repeat an id the least by all columns stays. Ties go to the
smallest doc_id. Empty tables give no sequences; without labels nothing is toxic. Further columns are passed on by every
stage but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, line_templates, packing, simhash, toxicity
from quarry.llm._common import drop_written, n_written, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs across documents."""
    return line_templates.without_templates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of fixed length: the documents' ids and words, with where each piece stands. Near duplicates are gone."""
    return packing.sequences(docs, packing.packed(docs, near=False))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_templates),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: Trained scores, a latent space and packing can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), n_written(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(spark, before, keep_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
