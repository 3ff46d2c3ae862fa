"""From documents to token ids in five stages, each on all its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a frame; all but the last return
the columns of ``docs``. ``run`` writes each result to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.llm import bpe, jaccard, language, lines, mixing
from tidemark.llm.common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with an even chance, go."""
    return language.drop_unidentified(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs are deleted from the texts; documents left without a
    word go, and ``n_chars`` follows the text."""
    out = lines.drop_repeated_lines(docs)
    emptied = (F.col("n_deleted") > 0) & (mixing.word_count(F.col("text")) == 0)
    out = out.where(~emptied)
    n_chars = F.length("text").cast("bigint")
    return out.select(*[n_chars.alias(c) if c == "n_chars" else out[f"`{c}`"] for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: five words, similarity 0.8."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    same = F.col("token.decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "token.n_tokens", "token.ids", same.alias("round_trip"))


_made: dict[str, list[str]] = {}  # by application: what the stages so far have written on their way


def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``stage``, which first deletes what earlier stages wrote on their way, provided that
    ``docs`` is a table as it was read: the result of the stage before has then been
    written, and nothing reads that any more."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        made = _made.setdefault(spark.sparkContext.applicationId, [])
        files = staging.reads_only(docs)
        if files is not None:
            done = [path for path in made if not any(path.rpartition("/")[2] in file for file in files)]
            staging.release(spark, done)
            made[:] = [path for path in made if path not in done]
        before = set(staging.held(spark))
        out = stage(spark, docs, sf_dir)
        made += [path for path in staging.held(spark) if path not in before]
        return out

    return run_stage


STAGES = [
    ("language", staged(identify_language)),
    ("lines", staged(drop_repeated_lines)),
    ("near_copies", staged(keep_one_of_near_copies)),
    ("mix", staged(mix_sources)),
    ("tokens", staged(encode_tokens)),
]

# The language model and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
