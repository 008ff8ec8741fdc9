"""Corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all rows its
predecessor kept, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import leaks, line_dedup, near_duplicates, packing, repetition
from reelgrid.session import written_once

MAX_LEN = 4096


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.drop_repetitive(docs, "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; ``n_chars`` follows the text."""
    freed = line_dedup.drop_shared_lines(docs, "doc_id", "text")
    return freed.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8), the one with the smallest id.

    Ids may repeat or be null (null comes last): rows are told apart by a hash of id and text, and rows that share
    both are one document. Texts without words are no copies of each other.
    """
    rows = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = near_duplicates.near_duplicates(rows, "_row", "text").where("n_shingles > 0")
    found = written_once(found.groupBy("_row", "component_id").agg(F.count("*").alias("copies")))
    ids = rows.select("_row", "doc_id").distinct()
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    keepers = found.join(ids, "_row").groupBy("component_id").agg(F.min_by("_row", first).alias("_row"))
    gone = found.select("_row").join(keepers, "_row", "left_anti")
    again = found.where("copies > 1").select("_row")
    left = rows.join(gone, "_row", "left_anti")
    once = left.join(again, "_row", "left_anti")
    return once.unionByName(left.join(again, "_row", "left_semi").dropDuplicates(["_row"])).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_answers(docs, tokenizer, MAX_LEN, "doc_id", "text")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", pack),
]
#: The stages tokenise, hash and compare by edit distance, which SQL cannot express; tests/llm compares them
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written_once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
