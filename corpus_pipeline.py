"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that the caller writes and
rereads as the next one's docs. All but the last return the columns of documents.

Rows without a doc_id go in the first stage, as nothing later could name them. Null and empty
texts are judged by the classifiers as texts without tokens; they link with nothing and repeat
nothing. Rows that share a doc_id are judged each by its text; the minhash stage takes them for
versions of one document and keeps one row, the one with the least text by hash."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import minhash, packing, quality, suffix_dedup, toxicity
from candela.llm.stage import DOCUMENT_COLUMNS, shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    return quality.keep(docs.select(*DOCUMENT_COLUMNS).where("doc_id is not null"), table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't predict to be toxic."""
    return toxicity.keep(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"), learn_from=table(spark, sf_dir, "documents"))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    rest = F.struct(F.xxhash64("text").alias("at"), *DOCUMENT_COLUMNS)
    rows = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(rest).alias("row"))
    return rows.select("row.*").select(*DOCUMENT_COLUMNS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur more than once; n_chars follows."""
    kept = suffix_dedup.remove_repeats(docs, length=200)
    rest = docs.drop("text", "n_chars").join(kept, "doc_id")
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash", minhash_stage),
    ("suffix", suffix_stage),
    ("packing", packing_stage),
]

#: The trained classifiers and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
