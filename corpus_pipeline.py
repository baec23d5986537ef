"""Documents from raw text to packed sequences: a list of stages, each one an operator of netsift.llm.

Every stage takes all documents that its predecessor kept and returns the columns of documents, the last one
packed pieces. An empty table passes through all stages. Documents with a null text are in no language and go at
the first stage. What a stage does with long texts, ties and repeated rows is what its operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm.common import checkpointed
from netsift.llm.decontamination import clean_documents
from netsift.llm.jaccard_join import near_duplicate_components
from netsift.llm.language_id import held_out, in_known_language, train
from netsift.llm.packing import pack_documents
from netsift.llm.suffix_dedup import remove_repeats
from netsift.sources.folders import new_folder, remove


def _new_name(docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    name, taken = "_row_of_id_and_text", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, with lang as told from the text; those without a letter go."""
    return in_known_language(docs, train(docs.where(~held_out())))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one row with the smallest id; documents without an id all stay, and so do
    those that are linked with nothing. Rows are told apart by a hash of id and text, not by the id alone.

    Whole documents are never sorted: the rows that go are made into a hash table part by part, numbers only, and
    documents stream by."""
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    row, names = _new_name(docs), [f"`{c}`" for c in docs.columns]
    docs = docs.withColumn(row, key)
    members = near_duplicate_components(docs, doc_id=row).where("n_shingles > 0")
    linked = checkpointed(members.groupBy("doc_id", "component_id").count())
    ids = docs.where("doc_id is not null").groupBy(row).agg(F.min("doc_id").alias("id"))
    rows = checkpointed(linked.withColumnRenamed("doc_id", row).join(ids, row))
    first = rows.groupBy("component_id").agg(F.min(F.struct("id", row)).alias("first")).select(F.col("first")[row].alias(row))
    first = checkpointed(first)
    gone = rows.join(first, row, "left_anti").select(row).hint("shuffle_hash")
    out = docs.join(gone, row, "left_anti")
    again = rows.where("count > 1").join(first, row, "left_semi").select(row).hint("shuffle_hash")
    if not again.isEmpty():
        out = out.join(again, row, "left_anti").unionByName(out.join(again, row, "left_semi").dropDuplicates([row]))
    return out.select(*names)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; one that loses all its text stays, empty."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = docs.select("doc_id", "text", F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return remove_repeats(rows, carry=("doc_id", "rest")).select(*[made.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens, with the language of their document."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), carry=("lang",))


STAGES = [(f.__name__, f) for f in (language_id, ngram_jaccard_join, suffix_array_dedup, benchmark_decontamination, best_fit_packing)]
#: No stage but the first filter could be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet in the shared folder and read again, and go when
    the next one's are written."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
