"""Mixing sources to target weights: water-filled targets, pivotal rounding of copies in a reduction tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, stage_table, unused

WEIGHTS = (3, 1, 2)
EPS = 1e-9


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """(source, source_size) -> plus target: share of all sizes by weight, at most `most` times the source.

    Weights repeat over the sources in code point order, null last. Resharing an excess by weight until none
    is left fills sources to one common level per weight; that level is found by a running sum over the
    sources in order of their cap per weight. One row per source is sorted, nothing else.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights)) + 1))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


#: One step of pivotal rounding: a is carried, b comes. Words move from one to the other until one of the two
#: is a whole number of copies; the direction is drawn so that each keeps its expectation, and words are kept.
STEP = """
(acc, b) -> if(acc.carry is null, named_struct('out', acc.out, 'carry', b),
  transform(array(named_struct('a', acc.carry, 'b', b,
      'ab', least(acc.carry.f * acc.carry.w, (1 - b.f) * b.w), 'ba', least(b.f * b.w, (1 - acc.carry.f) * acc.carry.w),
      'u', pmod(xxhash64(acc.carry.doc_id, acc.carry.size, b.doc_id, b.size, {seed}), 1000003) / 1000003D)), z ->
    if(z.u * (z.ab + z.ba) < z.ba,
      if(z.a.f * z.a.w <= (1 - z.b.f) * z.b.w,
        named_struct('out', concat(acc.out, array({done_a0})), 'carry', {b_up}),
        named_struct('out', concat(acc.out, array({done_b1})), 'carry', {a_down})),
      if(z.b.f * z.b.w <= (1 - z.a.f) * z.a.w,
        named_struct('out', concat(acc.out, array({done_b0})), 'carry', {a_up}),
        named_struct('out', concat(acc.out, array({done_a1})), 'carry', {b_down}))))[0])
"""


def _with(item: str, f: str) -> str:
    return f"named_struct('o', {item}.o, 'doc_id', {item}.doc_id, 'size', {item}.size, 'm', {item}.m, 'k', {item}.k, 'w', {item}.w, 'f', cast({f} as double))"


def pivotal(items: DataFrame, block: int = 256, seed: int = 11) -> DataFrame:
    """(source, doc_id, size, m, k, f) with f in (0, 1) -> (source, doc_id, size, m, copies = k + 0 or 1).

    Blocks of about `block` items of a source are folded, large items first; each block leaves one item that
    is still fractional. The leftovers are folded again, level by level, until a source has one, which is
    drawn by its fraction. So a hot source is many blocks, and no task holds more than a block.
    """
    step = STEP.format(seed=seed, done_a0=_with("z.a", "0"), done_a1=_with("z.a", "1"), done_b0=_with("z.b", "0"), done_b1=_with("z.b", "1"),
                       b_up=_with("z.b", "least(1D, z.b.f + z.ab / z.b.w)"), a_down=_with("z.a", "greatest(0D, z.a.f - z.ab / z.a.w)"), a_up=_with("z.a", "least(1D, z.a.f + z.ba / z.a.w)"), b_down=_with("z.b", "greatest(0D, z.b.f - z.ba / z.b.w)"))
    item = "struct<o: double, doc_id: bigint, size: bigint, m: bigint, k: bigint, w: double, f: double>"
    now, decided, level = items, [], 0
    columns = ["source", "doc_id", "size", "m", "k", "f"]
    while True:
        counts = now.groupBy("source").count().select("source", F.ceil(F.col("count") / block).alias("blocks"))
        most = counts.agg(F.max("blocks")).first()[0] or 0
        if not most:
            break
        dealt = now.join(counts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + level)), F.col("blocks")))
        dealt = dealt.withColumn("w", (F.col("size") * F.col("m")).cast("double"))
        folded = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "doc_id", "size", "m", "k", "w", "f"))).alias("items"))
        folded = folded.withColumn("r", F.expr(f"aggregate(items, named_struct('out', cast(array() as array<{item}>), 'carry', cast(null as {item})), {step})"))
        folded = stage_table(folded.select("source", "r"), f"mix{level}")
        decided.append(folded.select("source", F.explode("r.out").alias("x")).select("source", "x.*"))
        now = folded.select("source", "r.carry.*")
        if most == 1:
            break
        now, level = now.select(columns), level + 1
    drawn = F.pmod(F.xxhash64("doc_id", "size", F.lit(seed), F.lit("last")), F.lit(1000003)) / 1000003 < F.col("f")
    decided.append(now.withColumn("f", F.when(drawn, 1.0).otherwise(0.0)))
    out = None
    for d in decided:
        d = d.select("source", "doc_id", "size", "m", "k", (F.col("k") + F.col("f").cast("long")).alias("copies"))
        out = d if out is None else out.union(d)
    return out


def settled(drawn: DataFrame, items: DataFrame, seed: int = 11, rounds: int = 3) -> DataFrame:
    """drawn with the words that a source's last draw missed given to or taken from a few documents of it.

    The miss is at most that one document's size. Of the documents that can make up for it (one copy more
    where words are missing, else one less) the one nearest to it in size changes, if the source comes nearer
    its target by that; what is then missed is settled likewise, `rounds` times at most. Ties go to the
    smallest hash, and so at random. Minima and sums a source, no gathering.
    """
    want = stage_table(items.groupBy(F.col("source").alias("_s")).agg(F.sum((F.col("k") + F.col("f")) * F.col("size") * F.col("m")).alias("_want")), "wanted")
    at = F.col("source").eqNullSafe(F.col("_s"))
    open_ = F.when(F.col("_miss") > 0, F.col("copies") == F.col("k")).otherwise(F.col("copies") > F.col("k"))
    off = F.abs(F.abs("_miss") - F.col("size") * F.col("m"))
    for _ in range(rounds):
        have = drawn.groupBy("source").agg(F.sum(F.col("copies") * F.col("size") * F.col("m")).alias("have"))
        miss = stage_table(have.join(want, at).select("_s", (F.col("_want") - F.col("have")).alias("_miss")), "misses")
        best = drawn.join(miss, at).where(open_ & (off < F.abs("_miss"))).groupBy("_s").agg(F.min(F.struct(off.alias("off"), F.xxhash64("doc_id", "size", F.lit(seed)).alias("h"), "doc_id", "size", F.signum("_miss").cast("long").alias("by"))).alias("x"))
        best = stage_table(best.select("_s", F.col("x.doc_id").alias("_d"), F.col("x.size").alias("_n"), F.col("x.by").alias("_by")), "settled")
        if best.isEmpty():
            break
        drawn = drawn.join(best, at & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_n")), "left")
        drawn = drawn.select("source", "doc_id", "size", "m", "k", (F.col("copies") + F.coalesce("_by", F.lit(0))).alias("copies"))
    return drawn.drop("k")


def plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, block: int = 256, seed: int = 11) -> DataFrame:
    """Copies of each document: source, doc_id, size (words), m (rows that repeat it), source_size, target, copies.

    Needs doc_id, text and source; other columns are ignored. Rows of equal doc_id, source and size share one
    decision and count m times. Null texts have size 0, a null source is a source. Documents without words
    take the whole part of their copies. Draws hash ids and sizes, so reruns agree. An empty table: no rows.
    A source's words miss its target by less than the draw of its last document leaves (see settled).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    rows = stage_table(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "sizes")
    goal = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), share, most, weights)
    goal = stage_table(goal.withColumnRenamed("source", "s"), "targets")
    x = rows.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    x = x.withColumn("x", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    x = x.withColumn("k", F.floor(F.col("x") + EPS)).withColumn("f", F.greatest(F.lit(0.0), F.col("x") - F.col("k")))
    open_ = (F.col("f") > EPS) & (F.col("size") > 0)
    items = x.where(open_).select("source", "doc_id", "size", "m", "k", "f")
    drawn = settled(pivotal(items, block, seed), items, seed)
    whole = x.where(~open_).select("source", "doc_id", "size", "m", F.col("k").alias("copies"))
    return whole.union(drawn).join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs, each row as often as its copies say (none, once or twice), with all its columns, whatever their names."""
    d, s, n, copies, words, copy = unused(docs, "_d", "_s", "_n", "_copies", "_words", "_copy")
    p = plan(docs, **how).select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n), F.col("copies").alias(copies))
    rows = docs.withColumn(words, n_words(F.col("text")))
    rows = rows.join(p, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(words) == F.col(n))).where(F.col(copies) > 0)
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)
