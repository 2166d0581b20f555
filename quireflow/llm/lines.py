"""Removing multi-line chunks that repeat anywhere, with content-defined chunk ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, unused

#: A chunk ends after a line where the rolling hash of it and the line before is a multiple of this.
DIVISOR = 4
#: So many repeated hashes (8 MB) are broadcast to find their chunks; above, chunks are shuffled by hash.
FEW_KEYS = 1_000_000


def chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(doc_id, start, end, chunk): runs of lines, 1-based, whose ends depend on the last two lines alone.

    So a line put in or taken out moves at most the ends beside it. Work is linear in the lines of a row.
    """
    d = docs.select("doc_id", F.split("text", "\n", -1).alias("lines")).where("lines is not null")
    d = d.withColumn("h", F.expr("transform(lines, x -> cast(conv(substring(md5(cast(x as binary)), 1, 7), 16, 10) as bigint))"))
    d = d.withColumn("ends", F.expr(f"filter(sequence(1, size(lines)), i -> i = size(lines) or (coalesce(get(h, i - 2), 0) * 31 + get(h, i - 1)) % {divisor} = 0)"))
    d = d.withColumn("runs", F.expr("filter(transform(ends, (e, k) -> struct(coalesce(get(ends, k - 1), 0) + 1 as start, e as end)), r -> r.end > r.start)"))
    # explode_outer: for explode, the planner would filter on the runs first, and compute them once for each line
    return d.select("doc_id", "lines", F.explode_outer("runs").alias("r")).where("r is not null").select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.expr("array_join(slice(lines, r.start, r.end - r.start + 1), '\n')").alias("chunk"))


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """docs with each repeat of a multi-line chunk cut out of text, plus n_lines and n_removed (lines).

    Of equal chunks (same bytes) the first by doc_id and line stays, nulls first. Chunks meet by a 64-bit
    hash; a hash whose smallest and largest chunk differ in a byte is told apart by the chunk itself.
    Chunks of one line, null texts (n_lines 0) and texts without repeats stay as they are; an emptied text is
    ''. Rows that repeat a doc_id count as one document. Columns n_lines and n_removed are replaced, all others
    kept, whatever their names.
    Hashes are counted first, without texts; then only repeated chunks are compared, by minimum and maximum,
    which combine before the shuffle. Repeats join back to their hash, so a hot hash is split like any join.
    """
    docs = docs.drop("n_lines", "n_removed")
    texts = chunks(docs, divisor).withColumn("key", F.xxhash64("chunk"))
    own = stage_table(texts.select("doc_id", "start", "end", "key"), "chunks")
    many = stage_table(own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    texts = texts.join(F.broadcast(many) if many.count() <= FEW_KEYS else many, "key", "left_semi")
    where = F.struct("doc_id", "start")
    met = texts.groupBy("key").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.min(where).alias("first"))
    met = stage_table(met.select("key", "first", (F.col("low") == F.col("high")).alias("same")), "repeats")
    again = own.join(met.where("same").select("key", "first"), "key").where(~where.eqNullSafe(F.col("first")))
    mixed = met.where("not same").select("key")
    if not mixed.isEmpty():  # different chunks of one hash
        told = texts.join(mixed, "key", "left_semi")
        firsts = told.groupBy("chunk").agg(F.min(where).alias("first"))
        told = told.join(firsts, "chunk").where(~where.eqNullSafe(F.col("first")))
        again = again.select("doc_id", "start", "end").union(told.select("doc_id", "start", "end"))
    cuts = again.select("doc_id", "start", "end").distinct()
    d, own, cut = unused(docs, "_d", "_lines", "_cuts")
    cuts = cuts.groupBy(F.col("doc_id").alias(d)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    rows = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col(d)), "left").withColumn(own, F.split("text", "\n", -1))
    rows = rows.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(own)).cast("long"))
    rows = rows.withColumn("n_removed", F.expr(f"coalesce(aggregate({cut}, 0, (n, c) -> n + c.end - c.start + 1), 0)").cast("long"))
    left = F.expr(f"array_join(flatten(transform(sequence(0, size({cut})), i -> slice({own}, coalesce(get({cut}, i - 1).end, 0) + 1, coalesce(get({cut}, i).start, size({own}) + 1) - coalesce(get({cut}, i - 1).end, 0) - 1))), '\n')")
    return rows.withColumn("text", F.when(F.col(cut).isNull(), F.col("text")).otherwise(left)).select(*docs.columns, "n_lines", "n_removed")


ORACLE = f"""
WITH l AS (
  SELECT d.doc_id, u.i, u.line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL) d,
    LATERAL (SELECT unnest(d.s) AS line, generate_subscripts(d.s, 1) AS i) u),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS v FROM l),
e AS (SELECT *, (coalesce(lag(v) OVER w, 0) * 31 + v) % {DIVISOR} = 0 AS is_end FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM e),
c AS (SELECT doc_id, run, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM g GROUP BY doc_id, run),
r AS (SELECT *, n >= 2 AND row_number() OVER (PARTITION BY n >= 2, chunk ORDER BY doc_id, s) > 1 AS cut FROM c),
k AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (cut), 0)::BIGINT AS n_removed,
        string_agg(chunk, chr(10) ORDER BY s) FILTER (NOT cut) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
