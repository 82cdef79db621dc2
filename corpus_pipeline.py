"""The corpus pipeline: quality rules, quality classifier, near-duplicates, mixing, encoding.

Each stage takes the rows that the one before it kept, with the columns of documents,
whatever their names; columns beside doc_id, text, lang and source are carried along.

Edge cases, for all stages: null and empty texts are texts without words; texts of
any length are read whole; null and repeated ids keep their rows apart; repeated rows are
rows (but for near-duplicates, where one stays); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyspan.llm import bpe, bradley_terry, divergence, mixing, similar
from keyspan.llm.common import delete, read_table, scope, scratch_path
from keyspan.llm.queries import MIX_WEIGHTS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the divergence rules keep.

    A text without words fails the base rule; a null language is a language of its own.
    """
    return divergence.kept_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at or over the threshold; fitted on the labelled ones among them.

    A text without words has a score as any other; without both labels among the fitted
    rows every score is 0.5, and all documents stay.
    """
    model = bradley_terry.fitted(docs, read_table(spark, sf_dir, "labels"))
    return bradley_terry.scored(docs, model, keep=True).where("score >= 0.5").select("own.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHashes within two bits, or five-word similarities of 0.8 or more, link.

    The row with the least id stays, nulls last, and of equal ids the one with the least hash of its text;
    texts without words are copies of each other.
    """
    return similar.firsts(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order: that of the files written of them.

    A null source is a source of its own; rows with equal ids are repeated equally often.
    """
    return mixing.mixed(docs, MIX_WEIGHTS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with digests of ids and decoded bytes. A text without characters has no ids."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_dedup),
    ("source mix", source_mix),
    ("byte-level BPE", byte_level_bpe),
]

#: No SQL states the classifier's fit, the fingerprints' components or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's rows are written and read again.

    A stage's rows, and the scratch tables it made, go once the next stage's rows are written.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            schema = out.schema
            out.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
