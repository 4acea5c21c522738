"""A training corpus from `documents`: language, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. It works on all
that the stage before kept, and its decisions take effect: rejected documents go,
of each group of near duplicates the one with the smallest id stays, secrets are
masked, documents outside the sample go, and what is left is encoded. All stages
but the last return the columns of documents.

Edge cases: documents without a text or without letters have no language and go in
the first stage, unless no document has a language to learn from. Rows that repeat
a doc_id are one document after the second stage, and rows without one are
documents of their own, of which one of each group of near duplicates stays.
Texts of any length are read whole; nulls in other columns do not matter, and
further columns of documents pass through. Empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphfold.llm import bpe, langid, mixing, ngram_join, secrets
from graphfold.llm.common import materialize, table

STAGES = [
    ("language_id", langid.stage),
    ("ngram_join", ngram_join.stage),
    ("secret_scan", secrets.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: Models and iterations are beyond SQL: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
