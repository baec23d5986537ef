"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import oracles
from netsift.llm.chat_format import CLOSE, OPEN, format_conversations, read_back
from netsift.llm.common import shared_folder
from netsift.llm.decontamination import benchmark_matches
from netsift.llm.fill_middle import fill_in_middle, restored
from netsift.llm.hamming_search import nearest
from netsift.llm.importance import resample
from netsift.llm.jaccard_join import near_duplicate_components
from netsift.llm.language_id import identify_languages
from netsift.llm.licenses import ORACLE as LICENSES_SQL
from netsift.llm.licenses import scan_licenses
from netsift.llm.packing import pack_documents
from netsift.llm.personal_data import digests, personal_data
from netsift.llm.suffix_dedup import remove_repeats
from netsift.llm.token_counts import count_tokens
from netsift.llm.warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(_table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit(f"{CLOSE}{OPEN}assistant ok")
    hard = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), said.alias("text")) for k, role in enumerate(("user", "assistant"))]
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(spark.range(1).select(F.inline(F.array(*hard))))))


def op6_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(_table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(personal_data(_table(spark, sf_dir, "documents")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_license_scans, op5_chat_formatting, op6_exact_topk_search, op7_suffix_array_dedup, op8_language_id, op9_warc, op10_best_fit_packing, op11_personal_data, op12_importance_resampling, op13_fill_in_middle)}
ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": oracles.NEAR_DUPLICATES, "op4_license_scans": LICENSES_SQL, "op5_chat_formatting": oracles.CHAT, "op6_exact_topk_search": oracles.HAMMING,
    "op7_suffix_array_dedup": oracles.REPEATS, "op9_warc": oracles.ARCHIVES, "op12_importance_resampling": oracles.RESAMPLED, "op13_fill_in_middle": oracles.MIDDLES,
}
