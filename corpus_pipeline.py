"""A training corpus from the documents table: toxicity, quality, boilerplate lines, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from campanile.llm import toxicity
from campanile.llm.common import held_out, shared_folder, vocabulary
from campanile.llm.dart_minhash import keep_one
from campanile.llm.line_frequency import drop_boilerplate
from campanile.llm.packing import pack_documents
from campanile.llm.quality import cascade

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model does not predict to be toxic; it learns from the labels that the query learns from."""
    docs = docs.select(COLUMNS)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~held_out("doc_id", 0))
    return toxicity.score(docs, model, carry=tuple(COLUMNS)).where("predicted = 0").select(COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail none of the quality rules."""
    return cascade(docs, carry=COLUMNS).where("kept").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text."""
    clean = drop_boilerplate(docs.select(COLUMNS), into="__dropped")
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs.select(COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_good), ("line_dedup", drop_lines), ("near_duplicates", drop_near_copies), ("packing", pack)]
#: A trained model decides in the first stage, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
