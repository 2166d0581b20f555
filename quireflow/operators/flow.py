"""Order-dependent and relational operators: pages, packing, triage, memory, costs, contents, quality rounds."""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import markup as M
from ..functions import text as X

#: US dollars per million tokens (input, cached input, output).
PRICES = {"gpt-5.6-sol": ("4.00", "0.40", "20.00"), "gpt-5.6-terra": ("2.00", "0.20", "12.00"), "gpt-5.6-luna": ("0.20", "0.02", "1.20")}
_LETTER = "A-Za-zÀ-ÿ"
#: Fixed value: what a token of a page boundary is made of.
TOKEN = "0-9A-Za-zÀ-ÖØ-öø-ÿ"


def parse_pages(spec: str, total: int) -> list[int]:
    """'3-1,2,5' -> [1, 2, 3, 5]; empty or out of range is an error."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        lo, hi = sorted((int(a), int(b or a)))
        out |= set(range(lo, hi + 1))
    if not out or min(out) < 1 or max(out) > total:
        raise ValueError(f"pages outside 1..{total}: {spec!r}")
    return sorted(out)


def dehyphenate(pages: DataFrame, key: str = "doc_id", ord_: str = "page") -> DataFrame:
    """Move the head of a word cut at a page end onto that page, before its folio."""
    w = W.partitionBy(key).orderBy(ord_)
    left = rf"(?s)^(.*[{_LETTER}]{{2}})-(\s*(?:[ivxlcdm]+|[0-9]{{1,4}}))?\s*$"
    head = lambda t: F.regexp_extract(t, r"^\s*([a-zà-ÿ]{2,})", 1)
    d = pages.withColumn("_next", head(F.coalesce(F.lead("text").over(w), F.lit("")))).withColumn("_own", head(F.col("text")))
    d = d.withColumn("_gives", (F.col("_next") != "") & F.col("text").rlike(left))
    d = d.withColumn("_lost", F.coalesce(F.lag("_gives").over(w), F.lit(False)))
    t = F.when(F.col("_lost"), F.ltrim(F.expr("substring(ltrim(text), length(_own) + 1)"))).otherwise(F.col("text"))
    t = F.when(F.col("_gives"), F.concat(F.regexp_extract(t, left, 1), "_next", F.regexp_extract(t, left, 2))).otherwise(t)
    return d.withColumn("text", t).drop("_next", "_own", "_gives", "_lost")


def longest_blocks(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Longest common run of tokens of `lhs` and `rhs` (arrays): key, size, a, b (0-based), n_lhs; earliest in lhs, then rhs.

    A row per row with a common token; null tokens and arrays have none. It is found in the row, without a
    shuffle: per token of lhs the lengths of the runs that end there at each token of rhs, by those of the token
    before. Work is size(lhs) * size(rhs), meant for short arrays.
    """
    ends = "transform(z.r, (t, j) -> if(coalesce(t = get(z.l, i), false), if(j = 0, 0, get(s.p, j - 1)) + 1, 0))"
    # of equal lengths the largest struct has the smallest a, then b
    best = "array_max(transform(c, (n, j) -> struct(n as n, n - 1 - i as a, n - 1 - j as b)))"
    step = f"(s, i) -> transform(array({ends}), c -> named_struct('p', c, 'best', greatest(s.best, {best})))[0]"
    start = "named_struct('p', array_repeat(0, size(z.r)), 'best', struct(0 as n, 0 as a, 0 as b))"
    found = f"if(size(z.l) > 0 and size(z.r) > 0, aggregate(sequence(0, size(z.l) - 1), {start}, {step}).best, null)"
    # bound as lambda variables: the planner would else compute the arrays anew at each step
    x = F.expr(f"transform(array(struct(lhs as l, rhs as r)), z -> struct(size(z.l) as n_lhs, {found} as x))[0]")
    # exploded (outer), as the planner would compute a filter's and the result's value apart
    d = pairs.select(key, F.explode_outer(F.filter(F.array(x), lambda z: z["x"]["n"] > 0)).alias("z")).where("z is not null")
    return d.select(key, F.col("z.x.n").cast("long").alias("size"), (-F.col("z.x.a")).cast("long").alias("a"), (-F.col("z.x.b")).cast("long").alias("b"), F.col("z.n_lhs").alias("n_lhs"))


def remove_boundary_overlaps(pages: DataFrame, key: str = "doc_id", ord_: str = "page") -> DataFrame:
    """pages with text cut where its tail stands again at the next page's head, plus removed (null: nothing).

    The longest common block of a page's last and the next page's first 40 tokens goes from the left page where
    it has 8 tokens or more, ends the page and starts at the next one's sixth token or before. A page gives up
    its tail only, and is a right page before that, so every pair is judged on the texts as they came. key and
    ord_ together name a page.
    """
    # joined by blanks: short strings pass the shuffle, and a text passes it once
    tokens = F.regexp_extract_all("text", F.lit(f"[{TOKEN}]+"), F.lit(0))
    head = F.lower(F.array_join(F.slice(tokens, 1, 40), " "))
    d = pages.withColumn("_head", head).withColumn("_next", F.lead("_head").over(W.partitionBy(key).orderBy(ord_)))
    tail = F.split(F.lower(F.array_join(F.reverse(F.slice(F.reverse(tokens), 1, 40)), " ")), " ")
    # bound as lambda variables, so that each is computed once
    both = F.array(F.struct(tail.alias("l"), F.split("_next", " ").alias("r"), F.concat(F.lit(" "), "_next", F.lit(" ")).alias("s")))
    # the largest block of this kind is the longest of all where no earlier run of its size stands in the next page
    ends = "filter(sequence(7, 39), j -> get(c.r, j) = get(c.l, size(c.l) - 1))"
    run = "case when j - b between 7 and size(c.l) - 1 and slice(c.r, b + 1, j - b + 1) = slice(c.l, size(c.l) - j + b, j - b + 1) then j - b + 1 end"
    other = "exists(sequence(0, 32), i -> i < size(c.l) - k and instr(c.s, concat(' ', array_join(slice(c.l, i + 1, k), ' '), ' ')) > 0)"
    size = f"get(transform(_both, c -> get(transform(array(array_max(transform(sequence(0, 5), b -> array_max(transform({ends}, j -> {run}))))), k -> case when k is not null and not {other} then k end), 0)), 0)"
    d = d.withColumn("_both", both).withColumn("_n", F.expr(size))
    end = F.concat(F.lit(f"(?:^|[^{TOKEN}])((?:[{TOKEN}]+[^{TOKEN}]+){{"), (F.col("_n") - 1).cast("string"), F.lit(f"}}[{TOKEN}]+[^{TOKEN}]*)$"))
    cut = F.when(F.col("_n").isNotNull(), F.call_function("regexp_extract", F.col("text"), end, F.lit(1)))
    parts = F.transform(F.array(cut), lambda x: F.struct(F.when(x.isNull(), F.col("text")).otherwise(F.rtrim(F.left("text", F.length("text") - F.length(x)), F.lit(X.BLANK))).alias("text"), X.trimmed(x).alias("removed")))[0]
    return d.withColumn("_parts", parts).select(*[F.col("_parts.text").alias("text") if c == "text" else F.col(c) for c in pages.columns], F.col("_parts.removed").alias("removed"))


def greedy_chunks(items: DataFrame, key: str, ord_: str, size: Column, limit: int) -> DataFrame:
    """items plus chunk_id: a chunk closes when the next item would pass the limit; an oversize item stands alone.

    The reset depends on what came before, so a key's items are read in order by one task, but as a stream: the
    task holds one Arrow batch and a running sum, however many items a key has. A null key is a key; null sizes
    count zero.
    """
    rows = items.withColumn("_n", F.coalesce(size.cast("long"), F.lit(0))).repartition(key).sortWithinPartitions(key, ord_)

    def run(batches):
        last, chunk, total = object(), 0, 0
        for b in batches:
            out = []
            for k, n in zip(b.column(key).to_pylist(), b.column("_n").to_pylist()):
                if k != last:
                    last, chunk, total = k, 0, 0
                if total > 0 and total + n > limit:
                    chunk, total = chunk + 1, 0
                total += n
                out.append(chunk)
            names = [c for c in b.schema.names if c != "_n"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(out, pa.int64())], names=[*names, "chunk_id"])

    return rows.mapInArrow(run, StructType([*items.schema.fields, StructField("chunk_id", LongType())]))


def missed_terms(source: Column, target: Column, glossary: dict[str, str] | None) -> Column:
    """array<string>: terms of more than one word that source holds where target lacks their canonical form.

    The glossary is one literal array, so a plan does not grow an expression a term; texts are lowered once.
    """
    terms = [(a, b) for a, b in (glossary or {}).items() if " " in a]
    if not terms:
        return F.array().cast("array<string>")
    x = F.struct(F.lower(source).alias("s"), F.lower(target).alias("t"), F.lit([a for a, _ in terms]).alias("a"), F.lit([a.lower() for a, _ in terms]).alias("low"), F.lit([b.lower() for _, b in terms]).alias("b"))
    return F.transform(F.array(x), lambda x: F.filter(x["a"], lambda _, i: F.contains(x["s"], F.get(x["low"], i)) & ~F.contains(x["t"], F.get(x["b"], i))))[0]


def triage(pairs: DataFrame, glossary: dict[str, str] | None = None, markup: bool = False) -> DataFrame:
    """pairs (source, target) plus reasons (array) and status: blocking rules first, then reasons to look closer.

    With markup, source and target are HTML: their ordered elements and attributes must be equal too, and
    lengths and lexicons are those of the visible text.
    """
    s, t = F.col("source"), F.coalesce(F.col("target"), F.lit(""))
    html = (s, t)
    if markup:
        s, t = M.visible_text(s), M.visible_text(t)
    n, ratio = F.length(s), F.length(t) / F.greatest(F.length(s), F.lit(1))
    tokens = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"\[\[\[MATH_[^\]]*\]\]\]"), F.lit(0)))
    blocking = [F.when(~X.same_numbers(s, t), "number_changed"), F.when(tokens(s) != tokens(t), "formula_changed")]
    if markup:
        blocking.insert(0, F.when(M.structure_of(html[0]) != M.structure_of(html[1]), "structure_changed"))
    missed = F.transform(missed_terms(s, t, glossary), lambda _: F.lit("glossary_missed"))
    cjk = s.rlike(X.CJK)
    closer = F.when(n >= 800, "long_paragraph").when(cjk & (n >= 400), "dense_cjk").when((n >= 250) & X.found(s, X.RISK), "sensitive_relation")
    low, high = F.when(cjk, 0.4).otherwise(0.55), F.when(cjk, 4.0).otherwise(1.8)
    select = [closer, F.when(X.hits(t, X.RESIDUAL) >= 3, "residual_language"), F.when((ratio < low) | (ratio > high), "atypical_length")]
    d = pairs.withColumn("problems", F.concat(F.array_compact(F.array(*blocking)), missed)).withColumn("reasons", F.concat("problems", F.array_compact(F.array(*select))))
    return d.withColumn("status", F.when(F.size("problems") > 0, "review").otherwise("approved"))


def scope_characters(chars: Column, part: Column, whole: Column) -> Column:
    """Characters of the first `part` of `whole` chapters or printed pages, at least 1."""
    share = chars.cast("double") * F.least(part, whole) / F.greatest(whole, F.lit(1))
    return F.greatest(F.lit(1), share.cast("long"))


def canonical(glossary: dict[str, str] | None) -> str:
    """A glossary as one string, whatever the order of its terms."""
    return json.dumps(glossary or {}, ensure_ascii=False, sort_keys=True)


def chunk_key(chunk: Column, model: str, instructions: str = "", version: int = 3, glossary: dict[str, str] | None = None) -> Column:
    """Key of a chunk's result: what it holds, the model, rules and glossary; its neighbours are no part of it.

    A chunk of elements is an array of (id, source) at version 3, a chunk of pages its marked text at version 2.
    """
    return F.sha2(F.to_json(F.struct(chunk.alias("chunk"), F.lit(canonical(glossary)).alias("glossary"), F.lit(instructions).alias("instructions"), F.lit(model).alias("model"), F.lit(version).alias("version"))), 256)


def audit_key(pairs: DataFrame, selected: DataFrame, model: str, rules: str, key: str | None = None) -> DataFrame:
    """One audit_key a group (of all rows, without key): sources, targets, what is selected, model and rules.

    Row hashes are summed as numbers, so they combine before the shuffle and their order has no effect.
    """
    chosen = selected.select("id", F.lit("s").alias("_s")).distinct()
    row = F.sha2(F.to_json(F.struct("id", "source", "target", "_s")).cast("binary"), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    d = pairs.join(chosen, "id", "left")
    d = (d.groupBy(key) if key else d).agg(F.sha2(F.concat_ws("|", half(1), half(16), half(31), half(46), F.count(F.lit(1)), F.lit(model), F.lit(rules)), 256).alias("audit_key"))
    return d


def memory_key(source: Column, model: str, instructions: str = "", version: int = 4, glossary: dict[str, str] | None = None) -> Column:
    """Key of a remembered value: its source, the model, rules, glossary and version; change one, and it is another."""
    return F.sha2(F.to_json(F.struct(F.lit(canonical(glossary)).alias("glossary"), F.lit(instructions).alias("instructions"), F.lit(model).alias("model"), F.lit(version).alias("pipeline"), source.alias("source"))), 256)


def lookup(items: DataFrame, memory: DataFrame, valid: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with translation, pending) of items (memory_key, ..), each row in one of the two.

    A hit's value must be valid, a condition of it and the items' columns; else the row is pending.
    Of a key that the memory holds more than once one value counts, the newest if there is created_at, else the
    greatest. Null keys and null values are no hits.
    """
    held = F.max(F.struct(*[c for c in ("created_at", "translation") if c in memory.columns]))["translation"]
    one = memory.where("translation is not null").groupBy("memory_key").agg(held.alias("translation"))
    both = items.join(one, "memory_key", "left")
    hit = F.col("translation").isNotNull()
    if valid is not None:
        both = both.withColumn("translation", F.when(hit & F.coalesce(valid(F.col("translation")), F.lit(False)), F.col("translation")))
    return both.where(hit), both.where(~hit).drop("translation")


def upsert(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Of each key the newest row; new rows win ties, then the greater value; null times are the oldest."""
    both = memory.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in both.columns if c not in ("memory_key", "_new")]
    return both.groupBy("memory_key").agg(F.max(F.struct("created_at", "_new", *[c for c in columns if c != "created_at"])).alias("x")).select("memory_key", *[F.col(f"x.{c}").alias(c) for c in columns])


USAGE = "type string, message string, error string, usage struct<input_tokens: long, cached_input_tokens: long, output_tokens: long, reasoning_output_tokens: long>"
COUNTERS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")


def parse_usage(lines: DataFrame, key: str = "call_id") -> DataFrame:
    """Per call the four counters over completed turns, and how many lines are messages (errors or no JSON)."""
    e = lines.where(F.trim("line") != "").withColumn("e", F.from_json("line", USAGE))
    bad = F.col("e").isNull() | (F.col("e.type").isNull() & F.col("e.usage").isNull() & F.col("e.message").isNull())
    done = F.col("e.type") == "turn.completed"
    sums = [F.coalesce(F.sum(F.when(done, F.coalesce(F.col(f"e.usage.{c}"), F.lit(0)))), F.lit(0)).alias(c) for c in COUNTERS]
    return e.groupBy(key).agg(*sums, F.sum(F.when(bad | F.col("e.type").isin("turn.failed", "error"), 1).otherwise(0)).alias("n_messages"))


def prices(spark) -> DataFrame:
    return spark.createDataFrame([(m, *map(Decimal, p)) for m, p in PRICES.items()], "model string, input decimal(10,4), cached_input decimal(10,4), output decimal(10,4)")


def call_cost(calls: DataFrame) -> DataFrame:
    """calls plus usd (rounded to 6 places, half up, per call); null for an unknown model."""
    c = calls.join(F.broadcast(prices(calls.sparkSession)), "model", "left")  # three fixed rows
    cached = F.least("cached_input_tokens", "input_tokens")
    usd = ((F.col("input_tokens") - cached).cast("decimal(18,0)") * F.col("input") + cached.cast("decimal(18,0)") * F.col("cached_input") + F.col("output_tokens").cast("decimal(18,0)") * F.col("output")) / F.lit(Decimal(1000000))
    return c.withColumn("usd", F.round(usd, 6).cast("decimal(18,6)")).drop("input", "cached_input", "output")


def strict_total(c: Column) -> Column:
    """The sum, or null if there is no row or any is unknown."""
    return F.when((F.count(F.lit(1)) > 0) & (F.count(c) == F.count(F.lit(1))), F.sum(c)).cast("decimal(18,6)")


def toc_slice(toc: DataFrame, spine: DataFrame, n: int) -> DataFrame:
    """Spine documents of the first n chapters: from the first one to the next entry not below the n-th chapter.

    toc: ord, doc, label, depth; spine: pos, doc. One row of bounds is computed and joined; the rest is a filter.
    """
    t = toc.join(spine, "doc")
    chapters = t.where(X.found(F.col("label"), X.CHAPTER)).withColumn("k", F.row_number().over(W.orderBy("ord"))).where(F.col("k") <= n)
    ends = chapters.agg(F.min_by("pos", "k").alias("first"), F.max_by("ord", "k").alias("last"), F.max_by("depth", "k").alias("level"))
    after = t.join(F.broadcast(ends), (F.col("ord") > F.col("last")) & (F.col("depth") <= F.col("level")) & (F.col("pos") > F.col("first"))).agg(F.min(F.struct("ord", "pos")).alias("x")).select(F.col("x.pos").alias("stop"))
    bounds = ends.select("first").join(after)  # one row each
    return spine.join(F.broadcast(bounds), (F.col("pos") >= F.col("first")) & (F.col("stop").isNull() | (F.col("pos") < F.col("stop")))).select("pos", "doc")


def ensure_checkpoints(spark) -> None:
    """The folder that the session names; one of our own only where it names none and all runs in one process."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp())


def accepted(affected: DataFrame, answer: DataFrame, valid: Callable[[Column], Column] | None = None, batch: str | None = None) -> DataFrame:
    """(id, value) of the answers (id, value) to affected rows that are whole, batch by batch (all, without one).

    A batch's answer holds each of its ids once and no other, each value not blank and valid, a condition of
    it and the affected rows' columns. One that breaks this leaves the batch as it was. An answer's id
    that no batch knows breaks them all, as nobody can say whose it is.
    """
    ensure_checkpoints(affected.sparkSession)
    a = answer.groupBy("id").agg(F.count("*").alias("_n"), F.min("value").alias("value"))
    key = F.col(batch) if batch else F.lit(0)
    both = affected.withColumn("_batch", key).withColumn("_asked", F.lit(True)).join(a, "id", "full_outer")
    ok = (F.col("_n") == 1) & (F.trim("value") != "") & (F.lit(True) if valid is None else F.coalesce(valid(F.col("value")), F.lit(False)))
    both = both.withColumn("_ok", F.coalesce(F.col("_asked") & ok, F.lit(False))).checkpoint()
    if not both.where("_asked is null").isEmpty():
        return both.select("id", "value").limit(0)
    whole = both.groupBy("_batch").agg(F.bool_and("_ok").alias("_w")).where("_w").select(F.col("_batch").alias("_b"))
    return both.join(whole, F.col("_batch").eqNullSafe(F.col("_b")), "left_semi").select("id", "value")


def quality_rounds(pairs: DataFrame, review: Callable[[DataFrame], DataFrame], repair: Callable[[DataFrame], DataFrame], rounds: int = 2, valid: Callable[[Column], Column] | None = None, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, passes): audit, repair what has problems, and audit the repaired ones again, at most `rounds` times.

    review: pairs -> (id, kind); repair: pairs -> (id, value). A repair counts as accepted() says, whole or not
    at all; without any the rounds end. Problems that no repair touched stay open. Each round is cut by
    checkpoint(), as calls must not be made twice. ids are unique; batch names a column of pairs.
    """
    spark, log = pairs.sparkSession, []
    ensure_checkpoints(spark)
    pairs = pairs.checkpoint()
    open_ = review(pairs).checkpoint()
    log.append(("audit", open_.select("id").distinct().count()))
    for _ in range(rounds):
        ids = open_.where("id is not null").select("id").distinct()
        if ids.isEmpty():
            break
        affected = pairs.join(ids, "id", "left_semi")
        new = accepted(affected, repair(affected), valid, batch).checkpoint()
        if new.isEmpty():
            break
        pairs = pairs.join(new.withColumnRenamed("value", "_v"), "id", "left").withColumn("target", F.coalesce("_v", "target")).drop("_v").checkpoint()
        fresh = review(pairs.join(new, "id", "left_semi"))
        open_ = open_.join(new, "id", "left_anti").unionByName(fresh).checkpoint()
        log.append(("repair", open_.select("id").distinct().count()))
    passes = spark.createDataFrame(log, "stage string, open_ids long")
    status = open_.select("id").distinct().withColumn("_open", F.lit(True))
    return pairs.join(status, "id", "left").withColumn("status", F.when(F.col("_open"), "review").otherwise("approved")).drop("_open"), passes
