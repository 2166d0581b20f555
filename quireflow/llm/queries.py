"""The queries of this folder: each applies one operator to a whole table and derives its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, jaccard, langid, lines, mixing, packing, suffixes, vectors, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_hierarchical_packing(spark, sf_dir):
    p = packing.pack(_read(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op4_output_code_languages(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(langid.learnable(docs))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_packaged_warc(spark, sf_dir):
    return warc.round_trip(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_budgeted_chat(spark, sf_dir):
    from .common import stage_table

    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    return chat.read_back(stage_table(chat.format_conversations(rows.union(own)), "chat"))


def op1_paragraph_sketches(spark, sf_dir):
    return fingerprints.compare_versions(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_pivot_permutations(spark, sf_dir):
    return vectors.link_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_token_group_matrix(spark, sf_dir):
    return jaccard.link_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_line_chunks(spark, sf_dir):
    d = lines.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_column_suffixes(spark, sf_dir):
    d = suffixes.dedup_bytes(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "kept_text")


def op9_pivotal_mix(spark, sf_dir):
    p = mixing.plan(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    p = p.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_paragraph_sketches, op2_hierarchical_packing, op3_pivot_permutations, op4_output_code_languages, op5_packaged_warc, op6_token_group_matrix, op7_line_chunks, op8_column_suffixes, op9_pivotal_mix, op10_budgeted_chat, pipeline)}
ORACLES: dict[str, str] = {"op3_pivot_permutations": vectors.ORACLE, "op5_packaged_warc": warc.ORACLE, "op6_token_group_matrix": jaccard.ORACLE, "op7_line_chunks": lines.ORACLE}
