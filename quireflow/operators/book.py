"""Whole books: wanted pages against what came back, one chain to the outputs, page cuts, element ids, guards."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as X
from .flow import greedy_chunks, remove_boundary_overlaps


def load_glossary(spark: SparkSession, *paths: str) -> dict[str, str]:
    """The JSON object of the first path that exists, in any store Spark reads; empty if none does."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return json.loads(spark.read.text(path, wholetext=True).first()[0])
    return {}


def chunk_limit(chunk_chars: int) -> int:
    """Characters of a chunk of elements: twice those of a chunk of pages, from 5,000 to 12,000."""
    return min(12_000, max(5_000, 2 * chunk_chars))


def chunked_pages(pages: DataFrame, limit: int, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """((key, chunk, text), (key, source_sha256, pages, chunks)) of pages (key, page, text): marked texts, packed greedily.

    A chunk's text is its pages' marked texts in order, a blank line between. An empty page says that it has no
    text; a null text is empty. source_sha256 is the hash of the chunks' hashes, a line end between.
    """
    text = F.when(X.trimmed(F.coalesce("text", F.lit(""))) == "", F.lit("[Página sem texto extraível]")).otherwise(F.col("text"))
    p = pages.select(key, "page", F.concat(X.page_marker(F.col("page")), F.lit("\n\n"), text, F.lit("\n")).alias("t"))
    c = greedy_chunks(p, key, "page", F.length("t"), limit)
    ordered = lambda sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), sep)
    chunks = c.groupBy(key, (F.col("chunk_id") + 1).alias("chunk")).agg(ordered("\n\n").alias("text"), F.count("*").alias("n"))
    # a chunk is bounded by its limit, a manifest by the chunks' hashes: no text of a whole book is gathered
    hashed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.sha2(F.col("text").cast("binary"), 256).alias("h")))), lambda x: x["h"]), "\n")
    manifest = chunks.groupBy(key).agg(F.sha2(hashed, 256).alias("source_sha256"), F.sum("n").alias("pages"), F.count("*").alias("chunks"))
    return chunks.drop("n"), manifest


def write_chunks(chunks: DataFrame, manifest: DataFrame, folder: str, key: str = "doc_id") -> None:
    """A folder per key and chunk under folder/chunks, a text file in each; manifests as JSON lines beside them."""
    chunks.repartition(key, "chunk").write.mode("overwrite").partitionBy(key, "chunk").text(f"{folder}/chunks", lineSep="\n")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")


def page_difference(order: DataFrame, bodies: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, side): pages wanted and not found (missing), and found and not wanted (extra)."""
    a, b = order.select(key, "page").distinct(), bodies.select(key, "page").distinct()
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("extra")))


def wanted_pages(order: DataFrame, bodies: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, page, body) of order (key, ord, page): an absent or null body is empty; pages not wanted go."""
    return order.join(bodies.select(key, "page", "body"), [key, "page"], "left").select(key, "ord", "page", F.coalesce("body", F.lit("")).alias("body"))


def merge_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): a marker, a blank line and the body of each page, in order, a blank line between."""
    one = F.concat(X.page_marker(F.col("page")), F.lit("\n\n"), X.trimmed(F.col("body")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("t")))), lambda x: x["t"])
    return pages.groupBy(key).agg(F.concat(X.trimmed(F.array_join(parts, "\n\n")), F.lit("\n")).alias("text"))


def page_report(source: DataFrame, pages: DataFrame, difference: DataFrame, overlaps: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a key: characters, ratio, residual hits, pages missing or extra, overlaps, warnings, status.

    source: (key, page, text); pages: wanted_pages(), after a cut with removed, what went from a page's tail;
    difference: page_difference(); overlaps: (key, page), a row per page that still repeats the next one's head.
    A page without text is untranslated if none came back, and emptied if all of it was such a tail: both warn.
    Nulls count as empty; a key without pages has no row.
    """
    s = source.groupBy(key).agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("source_chars"))
    blank, cut = F.col("body") == "", F.col("removed").isNotNull() if "removed" in pages.columns else F.lit(False)
    those = lambda on, name: F.sort_array(F.collect_list(F.when(on, F.col("page")))).alias(name)
    t = pages.groupBy(key).agg(F.sum(F.length("body")).alias("target_chars"), F.sum(X.hits(F.col("body"), X.RESIDUAL_REPORT)).cast("long").alias("hits"), those(blank & ~cut, "untranslated"), those(blank & cut, "emptied"))
    side = lambda k: those(F.col("side") == k, k)
    d = t.join(s, key, "left").join(difference.groupBy(key).agg(side("missing"), side("extra")), key, "left").join(overlaps.groupBy(key).agg(F.count("*").alias("overlaps")), key, "left")
    none = F.array().cast("array<int>")
    d = d.withColumns({"source_chars": F.coalesce("source_chars", F.lit(0)), "overlaps": F.coalesce("overlaps", F.lit(0)), "missing": F.coalesce("missing", none), "extra": F.coalesce("extra", none)})
    ratio = F.when(F.col("source_chars") == 0, 0.0).otherwise(F.col("target_chars") / F.col("source_chars"))
    warnings = F.array_compact(F.array(
        F.when((F.size("untranslated") > 0) | (F.size("emptied") > 0), "untranslated"), F.when(~ratio.between(0.65, 1.55), "ratio"),
        F.when(F.col("hits") > F.greatest(F.lit(30), F.floor(F.col("target_chars") / 1000)), "residual"),
        F.when((F.size("missing") > 0) | (F.size("extra") > 0), "pages"), F.when(F.col("overlaps") > 0, "overlaps"),
    ))
    return d.withColumns({"ratio": F.round(ratio, 3), "warnings": warnings}).withColumn("status", F.when(F.size("warnings") > 0, "review").otherwise("approved"))


class Outputs(NamedTuple):
    """What write_outputs would write: pages, corrections, one text and one HTML a key, and the report."""

    pages: DataFrame
    corrections: DataFrame
    text: DataFrame
    html: DataFrame
    report: DataFrame


def outputs(blocks: DataFrame, source: DataFrame, key: str = "doc_id") -> Outputs:
    """The chain from translated blocks (key, block, text) and source pages (key, page, text) to all outputs.

    Blocks are joined in order and split at page marks (of a page met twice the last body stays), folios go,
    absent pages are empty, and a page's tail that stands again at the next one's head goes from the left
    page; the report looks for what still repeats. Null texts are empty; a key without blocks has empty pages.
    """
    merged = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    found = blocks.groupBy(key).agg(merged.alias("t")).select(key, F.explode(X.pages_of(F.col("t"))).alias("p")).select(key, "p.page", X.strip_folio(F.col("p.body")).alias("body"))
    order = source.select(key, F.col("page").alias("ord"), F.col("page").cast("int").alias("page")).distinct()
    pages = remove_boundary_overlaps(wanted_pages(order, found, key).withColumnRenamed("body", "text"), key, "ord").withColumnRenamed("text", "body")
    corrections = pages.where("removed is not null").select(key, "page", "removed")
    cut, pages = pages, pages.drop("removed")
    again = remove_boundary_overlaps(pages.withColumnRenamed("body", "text"), key, "ord").where("removed is not null").select(key, "page")
    body = F.concat(F.lit('<section class="page" id="p'), F.col("page").cast("string"), F.lit('">'), X.render_markdown(F.col("body")), F.lit("</section>"))
    html = pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", body.alias("t")))), lambda x: x["t"]), "\n").alias("html"))
    return Outputs(pages, corrections, merge_pages(pages, key), html, page_report(source, cut, page_difference(order, found, key), again, key))


def cut_book(documents: DataFrame, end: Column, key: str = "book", ord_: str = "pos", strict: bool = True) -> DataFrame:
    """documents (key, ord_, html) up to the first mark of a page past `end`, in document order.

    What comes after the document with that mark goes; that one is cut at the mark, with its open elements
    closed. A mark inside a paragraph, list item, cell or figure caption would cut text: an error, or, where
    not strict, a row with error set and its html whole. Only documents with such a mark are parsed.
    """
    numbers = F.transform(F.regexp_extract_all("html", F.lit(M.PAGE_TAG), F.lit(1)), lambda x: x.cast("long"))
    d = documents.withColumn("_end", end.cast("long")).withColumn("_past", F.coalesce(F.exists(numbers, lambda p: p > F.col("_end")), F.lit(False)))
    d = d.withColumn("_last", F.min(F.when(F.col("_past"), F.col(ord_))).over(W.partitionBy(key)))
    d = d.where(F.col("_last").isNull() | (F.col(ord_) <= F.col("_last")))
    d = d.withColumn("_cut", F.when(F.col("_past"), M.cut_at_page(F.col("html"), F.col("_end"))))
    error = F.when(F.col("_cut.inside"), F.concat(F.lit("the end of the pages is inside an element of text: "), F.col(key).cast("string")))
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error)).cast("string")
    d = d.withColumn("error", error)
    return d.withColumn("html", F.when(F.col("_past") & F.col("error").isNull(), F.col("_cut.kept")).otherwise(F.col("html"))).drop("_end", "_past", "_last", "_cut")


def chapter_errors(toc: DataFrame, wanted: Column, key: str = "book") -> DataFrame:
    """(key, chapters, error) of toc (key, doc, label): two chapters in one document, or fewer than wanted."""
    chapter = F.coalesce(X.found(F.col("label"), X.CHAPTER), F.lit(False))
    n = toc.withColumn("_w", wanted).groupBy(key).agg(F.count(F.when(chapter, 1)).alias("chapters"), F.countDistinct(F.when(chapter, F.col("doc"))).alias("_d"), F.max("_w").alias("_w"))
    error = F.when(F.col("_d") < F.col("chapters"), "two chapters in one document").when(F.col("chapters") < F.col("_w"), "fewer chapters than wanted")
    return n.select(key, "chapters", error.alias("error"))


def require_chapters(toc: DataFrame, wanted: int, key: str = "book") -> None:
    """An error that names a few of the books whose contents cannot be sliced by chapters."""
    bad = chapter_errors(toc, F.lit(wanted), key).where("error is not null").limit(5).collect()  # a bounded report
    if bad:
        raise ValueError("; ".join(f"{r[0]}: {r['error']}" for r in bad))


def numbered_elements(documents: DataFrame, key: str = "book", ord_: str = "ord") -> DataFrame:
    """(key, ord_, id, tag, source) of the elements of HTML documents with text, in the order in which they count.

    Headings to h5, paragraphs, figure captions and cells count within their document (dNNeNNNN); list items
    and then table captions count through the whole book (dNNlNNNN, dNNcNNNN). A paragraph in a list item is
    both. Null html has none. Counts run over numbers a document, texts are not gathered.
    """
    w = W.partitionBy(key).orderBy(ord_)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    d = documents.select(key, ord_, M.numbered_of(F.col("html")).alias("e"), F.row_number().over(w).alias("doc"))
    n = lambda kind: F.size(F.filter("e", lambda x: x["kind"] == kind))
    d = d.withColumns({"l": F.coalesce(F.sum(n("l")).over(before), F.lit(0)), "c": F.coalesce(F.sum(n("c")).over(before), F.lit(0))})
    d = d.select(key, ord_, "doc", "l", "c", F.explode("e").alias("e"))
    number = F.col("e.number") + F.when(F.col("e.kind") == "l", F.col("l")).when(F.col("e.kind") == "c", F.col("c")).otherwise(0)
    return d.select(key, ord_, F.format_string("d%02d%s%04d", "doc", "e.kind", number).alias("id"), "e.tag", "e.source")


def caption_warnings(html: Column) -> Column:
    """array<string>: figures or tables without a numbered label in their caption, with their numbers."""
    tags = M.tag_signature(html)
    held = lambda tag: F.regexp_count(html, F.lit(rf"""(?is)<{tag}\b[^>]*>(?:(?!</{tag}>).)*?<[a-z]+\b[^>]*\bclass=["'][^"']*\bobject-label\b"""))

    def short(name: str, of: str, label: str) -> Column:
        gap = F.size(F.filter(tags, lambda t: t == of)) - held(label)
        return F.when(gap != 0, F.concat(F.lit(name + ": "), gap.cast("string")))

    return F.array_compact(F.array(short("figures", "figure", "figcaption"), short("tables", "table", "caption")))


def block_gaps(sources: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, sources, targets) where the numbers of blocks differ: such a book goes to review before any audit."""
    n = lambda d, name: d.groupBy(key).agg(F.countDistinct("block").alias(name))
    both = n(sources, "sources").join(n(targets, "targets"), key, "full_outer").na.fill(0, ["sources", "targets"])
    return both.where("sources <> targets")


def known_problems(problems: DataFrame, items: DataFrame) -> DataFrame:
    """(id, first, kinds) of problems (ord, id, kind) whose id is an item's: each id once, by its first problem."""
    p = problems.join(items.select("id").distinct(), "id", "left_semi")
    return p.groupBy("id").agg(F.min("ord").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "kind"))), lambda x: x["kind"]).alias("kinds"))


def parsed_answers(answers: DataFrame, expected: DataFrame, valid: Callable[[Column], Column] | None = None, batch: str = "batch") -> DataFrame:
    """(batch, id, value) of answers (batch, json) that hold the contract; a batch that breaks it gives no row.

    A fence around the JSON goes; the object's keys must be the batch's ids (expected: batch, ord, id, ..) in
    order, and each value not blank and valid, a condition of it and the expected rows' columns.
    """
    j = answers.select(batch, X.strip_fence(F.col("json")).alias("j"))
    j = j.select(batch, F.json_object_keys("j").alias("keys"), F.from_json("j", "map<string,string>").alias("m"))
    ids = expected.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    fit = j.join(ids, batch).where(F.col("keys") == F.col("ids")).select(batch, F.explode("m").alias("id", "value"))
    rows = expected.join(fit, [batch, "id"])
    ok = (F.trim(F.coalesce("value", F.lit(""))) != "") & (F.lit(True) if valid is None else F.coalesce(valid(F.col("value")), F.lit(False)))
    rows = rows.withColumn("_ok", ok)
    whole = rows.groupBy(batch).agg(F.bool_and("_ok").alias("_w")).where("_w").select(batch)
    return rows.join(whole, batch, "left_semi").select(batch, "id", "value")
