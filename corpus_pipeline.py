"""The document pipeline: five of the training-data operators in a row.

Each stage takes the rows its predecessor kept and returns them with the
columns of ``documents``; the last returns packed pieces. Between stages the
rows are written to the shared folder and read again, so a lost executor
costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import toxicity
from vigil.llm.common import table
from vigil.llm.decontaminate import without_benchmark
from vigil.llm.exactdup import without_exact_duplicates
from vigil.llm.packing import default_tokenizer, packed_documents
from vigil.llm.simhash import without_near_duplicates
from vigil.session import ensure_session_defaults, materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3, fitted on the labelled documents among those given."""
    ensure_session_defaults(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6; of equal texts the largest doc_id stays."""
    ensure_session_defaults(spark)
    return without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9 with its contract's shingle length and bit distance; the smallest doc_id of a group stays."""
    ensure_session_defaults(spark)
    return without_near_duplicates(docs, shingle=3, max_bits=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8; documents with a confirmed benchmark passage go."""
    ensure_session_defaults(spark)
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; one row per piece."""
    ensure_session_defaults(spark)
    return packed_documents(docs, default_tokenizer())


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Scores, fingerprints and token ids are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
