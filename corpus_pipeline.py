"""From documents to packed token windows: each stage reads the table that the one before it wrote.

Nulls, empty and repeated rows, ties and extra columns are handled as the stage's operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import common, jaccard, langid, lines, mixing, packing

#: Below this share of the decoding a language is not taken as known.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or without a likeliest language, go.

    Where no document is labelled, nothing can be learned and only those without a letter go.
    """
    model = langid.train(langid.learnable(docs))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = langid.identify(docs, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that an earlier one holds; a document of such chunks alone goes."""
    d = lines.dedup_lines(docs).where("n_removed < n_lines or n_removed = 0")
    return d.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else d.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of linked ones."""
    gone = jaccard.link_documents(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids; a null or empty text is the end id alone, a repeated row packs again."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packed)]

#: The draws of the mix and the learned languages are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        path = common.scratch_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if last:
            common.delete(spark, last)
        last = path
    return docs
