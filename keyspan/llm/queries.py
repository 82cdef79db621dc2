"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm import ann, bpe, bradley_terry, chat, divergence, html_extract, mixing, simhash, sql, token_count, token_store
from keyspan.llm.common import delete, finished, read_table


#: Target shares of the output: named sources, and 1.0 for each other one.
MIX_WEIGHTS = {"src0": 2.0, "src1": 4.0, "src2": 3.0, "src3": 0.5, "src4": 1.5}


def op1_ann_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, "nearest", lambda: ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0))


def op2_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op4_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame(
        [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    rows = read_table(spark, sf_dir, "conversations").select(columns).union(extra)
    return chat.conversation_digests(chat.format_turns(rows))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, "rules", lambda: divergence.quality_rules(read_table(spark, sf_dir, "documents")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.token_file_path(spark)
    token_store.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    out = finished(spark, "digests", lambda: token_store.stored_digests(spark, path))
    delete(spark, path)
    return out


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, "classes", lambda: simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, threshold=2))


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mixing.mixed(docs, MIX_WEIGHTS, copy_name="copy_no", key_name="shuffle_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ann_adaptive_scan, op2_bradley_terry, op3_html_line_blocks, op4_chat_parts, op5_token_counts, op6_divergence_rules,
        op7_byte_bpe, op8_token_files, op9_simhash, op10_poisson_mix,
    )
}
SQL: dict[str, str] = {"op4_chat_parts": sql.OP4, "op6_divergence_rules": sql.OP6, "op10_poisson_mix": sql.OP10}
