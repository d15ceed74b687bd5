"""From raw documents to packed training sequences: each stage is one operator over all rows of the one
before, written and read again in between.

Defined cases: a table without rows gives none at any stage; a null or empty text is a document without words,
which the classifier judges like any other, and of which near dedup keeps one; rows with one id and text are
judged alike, and near dedup keeps one of them; null sources, languages and ids are values of their own; columns
beyond those of documents are passed on up to packing, whatever their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearwise.llm import lines, mixing, nearcopies, packing, quality
from nearwise.llm.common import save


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; every document stays."""
    name = "line_dedup"
    while name in docs.columns:
        name += "_"
    cleaned = lines.dedup_lines(docs, out_col=name)
    text = F.col(name).getField("text")
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return cleaned.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard likeness of 0.8 of five-word shingles links stays: the one
    with the smallest id."""
    return nearcopies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", keep_good), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mix", mix), ("pack", pack)]

#: The classifier, the near copies' join and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
