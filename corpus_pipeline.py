"""The corpus pipeline: documents to token files, in five stages.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read
again as the next one's docs.  All but the last return the columns of documents.

Defined cases, in every stage: a null or empty text is rejected by the quality rules and so by
the pipeline, but is a document without words to each later stage when that runs alone, which
keeps it (mixing, which takes words, takes none of it); a null doc_id is a document like any
other, and rows that repeat a doc_id are documents each; rows equal in text are near duplicates,
of which the least doc_id stays, null last; texts of any length are read whole; an empty table
gives no rows; columns beside those of documents pass through, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import decontamination, minhash_dedup, quality_rules, source_mixing, token_output
from quarrylens.llm.common import fresh_name, scratch_path, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules.quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where(F.col(quality_rules.result_names(docs.columns)[-1])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: five-word shingles, similarity 0.8, the least doc_id stays, null last."""
    rows, row_id = docs, "doc_id"
    if not docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        # ids do not tell rows apart: number the rows in order of their ids, equal ids in any order
        row_id = fresh_name(docs.columns, "row_no")
        ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.rand(7))
        rows = settle(ordered.withColumn(row_id, F.monotonically_increasing_id()), "numbered-rows")
    groups = minhash_dedup.near_duplicates(rows, id_col=row_id)
    gone = groups.where("not kept").select(F.col("doc_id").alias(row_id)).distinct().hint("merge")  # grows with the input: never broadcast
    return rows.join(gone, row_id, "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.find_benchmark_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col(decontamination.result_names(docs.columns)[1])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once for each time it takes them."""
    mixed = source_mixing.mix_sources(docs)
    size, _, _, taken = map(F.col, source_mixing.result_names(docs.columns))
    copies = F.sequence(F.lit(1), (taken / F.greatest(size, F.lit(1))).cast("int"))
    return mixed.where(taken > 0).select(*docs.columns, F.explode(copies).alias(fresh_name(docs.columns, "copy"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and what they hold of each."""
    folder = scratch_path(spark, "token-files")
    shards = token_output.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_output.read_token_docs(spark, shards, folder)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("source mixing", mix),
    ("token output", tokens),
]

#: Hashed n-gram scores, edit matching, subset sums and tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs, name.replace(" ", "-"))
    return docs
