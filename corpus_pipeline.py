"""Pipeline from raw documents to packed training sequences, in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, with the columns of documents in all stages but the last.
run() writes each stage's result as Parquet in the shared folder that
spark.checkpoint.dir names, and reads it again as the next stage's input, so a
lost executor costs at most the stage that is running.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabwork.llm import compression, cutting_stock, deobfuscation, fm_index, signature_trees
from tabwork.session import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose compression lies in the bands of their length."""
    return compression.rated(docs).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id.

    Equal rows with one doc_id are one document and stay once. Rows without a
    doc_id stay unless a document with one is in their group.
    """
    groups = signature_trees.ngram_join(docs)
    heads = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy(F.col("doc_id").alias("_head")).agg(F.count(F.lit(1)).alias("_rows"))
    joined = docs.join(heads, docs["doc_id"].eqNullSafe(heads["_head"]))
    once = joined.filter("_rows = 1").select(docs["*"])
    again = joined.filter("_rows > 1").select(docs["*"]).dropDuplicates(["doc_id", "text"])
    return once.unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark; a document of which no word is left goes."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    found = fm_index.decontaminate(docs, benchmark)
    hit = F.size("_hits") > 0
    emptied = hit & ~F.col("_clean").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    return found.filter(~emptied).withColumns({
        "text": F.col("_clean"), "n_chars": F.when(hit, F.length("_clean").cast("long")).otherwise(F.col("n_chars")),
    }).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each piece of personal data replaced by its kind, for example <EMAIL>."""
    clean = deobfuscation.masked(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents, placed in sequences of 1024 tokens."""
    return cutting_stock.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", packing),
]

# Neither compression ratios nor the byte-pair ids can be had in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
