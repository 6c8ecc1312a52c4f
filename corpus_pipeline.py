"""From documents to training data: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; it is written in the shared folder and read again as the next one's docs. All but the
last return the columns of documents. Each keeps the contract of its operator for null, empty,
repeated and very long texts, and for empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm.common import written
from engram.llm.decontaminate import clean_documents
from engram.llm.minhash import keep_one
from engram.llm.mixing import mix_documents
from engram.llm.queries import table, tokenizer
from engram.llm.repetition import score_repetition
from engram.llm.token_store import read_token_store, write_token_store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return score_repetition(docs, keep_columns=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark items beyond the limit."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often as it takes them."""
    return mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document what was read back from them."""
    manifest = write_token_store(docs, tokenizer(), end_id=2)
    return read_token_store(spark, manifest, docs.schema["doc_id"].dataType.simpleString())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token output", token_output),
]

#: No SQL expresses suffix arrays, near-duplicate classes or token ids; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
