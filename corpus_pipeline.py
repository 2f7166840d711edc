"""From raw documents to token ids: five stages, each an operator of docfields.llm at work on all that its predecessor kept.

All stages but the last return the columns of `documents`. Null texts and ids, empty texts, repeated rows and empty tables pass through
as the operators' docstrings say; a stage fails only if its input lacks doc_id, text or (for the mix) source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docfields.llm.common import stored, table
from docfields.llm.credentials import mask_secrets
from docfields.llm.mixing import mixed_rows
from docfields.llm.pieces import compiled, encode
from docfields.llm.setsketch import near_duplicates
from docfields.llm.toxicity import drop_toxic, taught

#: Near copies of the near-dedup stage: a similarity of so many hundredths or more.
NEAR = 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, taught by `labels`, doesn't reject."""
    return drop_toxic(docs, taught(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; unlinked documents all stay."""
    dropped = near_duplicates(docs, NEAR).filter("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return mask_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_rows(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, round_trip of every row."""
    return encode(docs, compiled()).select("doc_id", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", without_toxic),
    ("minhash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources", mixture),
    ("sentencepiece", token_ids),
]

#: The classifier and the encoder have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
