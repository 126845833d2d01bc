"""From raw documents to training tokens: five stages, each an operator of remembra.llm."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from remembra.llm._store import stored, workspace
from remembra.llm.bpe import tokenised
from remembra.llm.mixing import mix_documents
from remembra.llm.near_copies import drop_near_copies
from remembra.llm.repetition import quality_filter
from remembra.llm.secret_scan import redact

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base or the repetition rules go (operator 1), null and empty texts with them; equal rows are judged each. All columns are kept."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 5-word shingles of 0.8 or more the one with the smallest doc_id stays (operator 3).

    Texts without words, null ones too, are linked with each other; rows equal in doc_id and text are one; a null doc_id comes last.
    """
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text (operator 8). Every row stays; null and empty texts do not change."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them, up to 3 times or not at all (operator 2).

    Null and empty texts have nothing to take and go; rows that share a doc_id are rows of their own; a null source is a source.
    """
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their tokens and the text decoded from them, in one pass (operator 5). A null text stays null, without tokens."""
    return tokenised(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL can express neither the fingerprints' components nor the permutations of the mix.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents in turn, each stage's result written as Parquet and read again."""
    place = workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{place}/{k}")
    return docs
