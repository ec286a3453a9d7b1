"""A training-data pipeline over `documents`: identify languages, drop near copies, drop contaminated documents,
sanitise personal data, pack into sequences. Each stage reads what the one before it wrote.

Defined results: documents with a null or letterless text go in the first stage. Of rows with one fingerprint class, those of the
smallest doc_id stay; of rows that share class and id one stays, and a row without an id stays only if its class has no
id at all. Whether a row is contaminated hangs on its own text alone. Extra columns stay as they are, whatever their names, up to the last stage,
which returns pieces. Very long texts are read whole. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm.common import read_documents, saved, tuned
from ledgerflow.llm.decontaminate import keep_clean
from ledgerflow.llm.language import keep_identified
from ledgerflow.llm.packing import pack
from ledgerflow.llm.pii import sanitise
from ledgerflow.llm.queries import BYTE_BPE, tokenizer_path
from ledgerflow.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learned language explains, go."""
    tuned(spark)
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    tuned(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return keep_clean(docs, read_documents(tuned(spark), sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are replaced in the texts; n_chars follows."""
    tuned(spark)
    out = sanitise(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(out.schema["n_chars"].dataType)))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of at most 2048 tokens."""
    tuned(spark)
    return pack(docs, tokenizer_path(BYTE_BPE))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]

#: SQL expresses neither the tokeniser nor the fitted stages; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(tuned(spark), sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
