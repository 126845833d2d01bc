"""The thin opN queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remembra.llm._store import workspace
from remembra.llm.ann import nearest_neighbours
from remembra.llm.bpe import bpe_report
from remembra.llm.ctw import ctw_scores
from remembra.llm.hard_negatives import hard_negatives
from remembra.llm.html_extract import extract_main_text
from remembra.llm.minhash import minhash_components
from remembra.llm.mixing import mix_report
from remembra.llm.oracle import ORACLE_SQL
from remembra.llm.repetition import repetition_rules
from remembra.llm.secret_scan import secret_report
from remembra.llm.simhash import simhash_components
from remembra.llm.substring import dedup_substrings
from remembra.llm.treaps import build_index, search
from remembra.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1 over all of `documents`: counts, coverage of repeats and the verdict."""
    return repetition_rules(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all of `documents`: what the mix takes of each."""
    return mix_report(_table(spark, sf_dir, "documents")).drop("source")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3 over all of `documents`: fingerprints and components."""
    found = simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all of `documents`: trained on those whose crc32 modulo 7 is not 2."""
    return ctw_scores(_table(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 7 = 2")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5 over all of `documents`: digests of the tokens and of the decoded bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_report(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all of `pages`: the main text."""
    return extract_main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all of `documents`: what 13-word windows of earlier documents leave."""
    return dedup_substrings(_table(spark, sf_dir, "documents"), digest=True)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all of `documents`: spans of secrets."""
    return secret_report(_table(spark, sf_dir, "documents"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 over all of `embeddings`: ten neighbours of each hundredth row."""
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all of `pages`: written as WARC and read back."""
    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11 over all of `documents`: 5-word shingles, links at a similarity of 0.85 or more."""
    return minhash_components(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12 over all of `embeddings`: anchors are the ids divisible by 100, ids divisible by 7 take the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: all of `documents` indexed, then ranked for each item of `benchmark`."""
    index = build_index(_table(spark, sf_dir, "documents"), workspace(spark, "index"))
    return search(index, _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_repetition, op2_mixing, op3_simhash, op4_ctw, op5_bpe, op6_html_extract, op7_substring, op8_secret_scan, op9_ann, op10_warc, op11_minhash, op12_hard_negatives, op13_treaps)}

__all__ = ["ORACLE_SQL", "QUERIES"]
