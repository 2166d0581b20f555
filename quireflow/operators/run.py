"""Whole jobs: pages or elements through an outside transform, audited, repaired, remembered, reported."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import book, flow, jobs

#: An outside transform: (items, name of the round) -> (id, target).
Transform = Callable[[DataFrame, str], DataFrame]
#: What makes a value valid: a condition of it and the items' columns.
Valid = Callable[[Column], Column]


def with_chunk_keys(items: DataFrame, limit: int, model: str, instructions: str = "", glossary: dict[str, str] | None = None, key: str = "book") -> DataFrame:
    """items (key, ord, id, source, ..) plus chunk_id and chunk_key: chunks of `limit` characters, packed in order."""
    c = flow.greedy_chunks(items, key, "ord", F.length(F.coalesce("source", F.lit(""))) + 80, limit)
    held = F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", "source"))), lambda x: F.struct(x["id"].alias("id"), x["source"].alias("source")))
    keys = c.groupBy(key, "chunk_id").agg(flow.chunk_key(held, model, instructions, glossary=glossary).alias("chunk_key"))
    return c.join(keys, [key, "chunk_id"])


def resume(items: DataFrame, results: DataFrame, valid: Valid) -> tuple[DataFrame, DataFrame]:
    """(items with target, pending items): a chunk comes back whole, with a valid value for each id, or not at all.

    items: (chunk_key, id, ..); results: (chunk_key, id, target) of earlier runs, the greatest target of an id
    counts. Chunks of equal keys hold equal items, so they share their results.
    """
    r = results.groupBy("chunk_key", "id").agg(F.max("target").alias("target"))
    both = items.join(r, ["chunk_key", "id"], "left").withColumn("_ok", F.coalesce(valid(F.col("target")), F.lit(False)))
    whole = both.groupBy("chunk_key").agg(F.bool_and("_ok").alias("_w")).where("_w").select("chunk_key")
    return both.join(whole, "chunk_key", "left_semi").drop("_ok"), items.join(whole, "chunk_key", "left_anti")


def translated(items: DataFrame, transform: Transform, valid: Valid, results: DataFrame | None = None, memory: DataFrame | None = None) -> DataFrame:
    """items plus target and origin: chunk (an earlier result), memory, or the round that answered; null: none did.

    Each step sees what those before it left; a value that is not valid counts for none of them.
    """
    pending, out = items, []
    columns = [*items.columns, "target", "origin"]
    if results is not None:
        reused, pending = resume(items, results, valid)
        out.append(reused.withColumn("origin", F.lit("chunk")).select(columns))
    if memory is not None:
        hits, pending = flow.lookup(pending, memory, valid)
        out.append(hits.withColumnRenamed("translation", "target").withColumn("origin", F.lit("memory")).select(columns))
    made = jobs.attempt_rounds(pending, transform, valid(F.col("target"))).withColumnRenamed("attempt", "origin").select(columns)
    for d in out:
        made = made.unionByName(d)
    return made


def audited(pairs: DataFrame, review: Callable[[DataFrame], DataFrame], reused: DataFrame | None = None, glossary: dict[str, str] | None = None, markup: bool = False) -> tuple[DataFrame, DataFrame]:
    """(report, open problems (id, kind)) of pairs (id, source, target, ..).

    Triage finds local problems and selects what a reviewer sees: reasons to look closer, but for reused ids, and
    all with local problems. review: selected pairs -> (id, kind), a row per reviewed id, kind null where it is
    fine. Without anything selected no reviewer is asked. What was selected and not reviewed forces a review.
    """
    flow.ensure_checkpoints(pairs.sparkSession)
    t = flow.triage(pairs, glossary, markup).checkpoint()
    local = t.select("id", F.explode("problems").alias("kind"))
    none = pairs.select("id").limit(0)
    asked = t.join(jobs.audit_ids(t.where(F.size("reasons") > 0), none if reused is None else reused, local), "id", "left_semi").select(pairs.columns)
    seen = none.withColumn("kind", F.lit(None).cast("string")) if asked.isEmpty() else review(asked).checkpoint()
    semantic = seen.where("kind is not null")
    return jobs.assemble(local, semantic, asked, seen.select("id").distinct()), local.unionByName(semantic).distinct()


def remember(memory: DataFrame, pairs: DataFrame, created_at: Column) -> DataFrame:
    """memory with all of a job's valid pairs (memory_key, target, status), if the whole job is approved.

    One pair that is open keeps all of the job's values out, as does a pair without a target.
    """
    verdict = pairs.agg(F.coalesce(F.bool_and((F.col("status") == "approved") & F.col("target").isNotNull()), F.lit(False)).alias("ok"))
    if not verdict.first()["ok"]:
        return memory
    return flow.upsert(memory, pairs.select("memory_key", F.col("target").alias("translation"), created_at.alias("created_at")).distinct())


class Job(NamedTuple):
    """What a job leaves: pairs with status and origin, its passes, its last report, and the memory after it."""

    pairs: DataFrame
    passes: DataFrame
    report: DataFrame
    memory: DataFrame | None


def run_elements(items: DataFrame, config: jobs.JobConfig, transform: Transform, review, repair, valid: Valid, results: DataFrame | None = None, memory: DataFrame | None = None, glossary: dict[str, str] | None = None, markup: bool = False, created_at: Column | None = None, batch: str | None = None) -> Job:
    """A job over elements (book, ord, id, source, ..): chunks, reuse, attempts, audit, repairs, memory.

    An element that no round could translate is an error, as no book is published with a hole.
    """
    items = with_chunk_keys(items, book.chunk_limit(config.chunk_chars), config.model, config.instructions, glossary)
    items = items.withColumn("memory_key", flow.memory_key(F.col("source"), config.model, config.instructions, glossary=glossary))
    flow.ensure_checkpoints(items.sparkSession)
    pairs = translated(items, transform, valid, results, memory).checkpoint()
    if not pairs.where("target is null").isEmpty():
        raise ValueError("some elements have no valid translation")
    reused = pairs.where("origin in ('chunk', 'memory')").select("id")
    look = lambda p: audited(p, review, reused.join(p, "id", "left_semi"), glossary, markup)[1]
    done, passes = flow.quality_rounds(pairs, look, repair, valid=valid, batch=batch)
    report = audited(done.drop("status"), review, reused, glossary, markup)[0]
    kept = None if memory is None else remember(memory, done, F.current_timestamp() if created_at is None else created_at)
    return Job(done, passes, report, kept)


def run_pages(pages: DataFrame, config: jobs.JobConfig, transform: Transform, key: str = "doc_id") -> tuple[DataFrame, book.Outputs]:
    """(blocks, outputs) of pages (key, page, text): cleaned, joined over page ends, packed, translated, put out.

    A block's answer must hold its page marks in order; one without a valid answer stays empty and shows in the
    report as missing pages.
    """
    clean = flow.dehyphenate(pages.withColumn("text", X.clean_text(F.coalesce("text", F.lit("")))), key)
    chunks, _ = book.chunked_pages(clean, config.chunk_chars, key)
    items = chunks.select(F.concat_ws("/", key, "chunk").alias("id"), key, F.col("chunk").alias("block"), F.col("text").alias("source"))
    answered = lambda p, name: transform(p, name).withColumn("target", jobs.sanitize(F.col("target")))
    blocks = jobs.attempt_rounds(items, answered, jobs.valid_translation(F.col("target"), X.expected_markers(F.col("source"))))
    return blocks, book.outputs(blocks.select(key, "block", F.col("target").alias("text")), clean, key)


def write_reports(folder: str, **reports: DataFrame) -> None:
    """Each report as JSON lines in a folder of its name, in any store Spark writes."""
    for name, report in reports.items():
        report.write.mode("overwrite").json(f"{folder}/{name}")


def cost_report(calls: DataFrame, usd_brl: str = "5.13") -> DataFrame:
    """By model: calls, tokens, and the strict total in two currencies of calls (model, counters); see call_cost."""
    usd = flow.strict_total(F.col("usd"))
    sums = [F.sum(c).alias(c) for c in flow.COUNTERS if c in calls.columns]
    return flow.call_cost(calls).groupBy("model").agg(F.count("*").alias("calls"), *sums, usd.alias("usd"), F.round(usd * F.lit(usd_brl).cast("decimal(10,2)"), 2).alias("brl"))
