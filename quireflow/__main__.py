"""python -m quireflow: a page job over a table of pages, and a self test."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import flow, jobs, run


def echo(items: DataFrame, name: str) -> DataFrame:
    """A transform that gives every source back, for trials without an outside model."""
    return items.select("id", F.col("source").alias("target"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quireflow")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("translate", help="pages (doc_id, page, text) as Parquet to texts, HTML and a report")
    t.add_argument("--input", required=True)
    t.add_argument("--output", required=True)
    t.add_argument("--pages", default="", help="such as 1-3,7; all without it")
    t.add_argument("--transform", default="quireflow.__main__:echo", help="module:function of (items, round) -> (id, target)")
    t.add_argument("--chunk-chars", type=int, default=6500)
    t.add_argument("--model", default="gpt-5.6-luna")
    t.add_argument("--concurrency", type=int, default=2, help="held to 1 to 4")
    sub.add_parser("self-test", help="a small job in place")
    return p


def translate(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = spark.read.parquet(a.input)
    if a.pages:
        last = pages.agg(F.max("page")).first()[0] or 0
        pages = pages.where(F.col("page").isin(flow.parse_pages(a.pages, last)))
    module, name = a.transform.split(":")
    config = jobs.JobConfig(a.input, a.output, model=a.model, concurrency=a.concurrency, chunk_chars=a.chunk_chars)
    blocks, out = run.run_pages(pages, config, getattr(importlib.import_module(module), name))
    run.write_reports(a.output, blocks=blocks, pages=out.pages, corrections=out.corrections, texts=out.text, html=out.html, report=out.report)


def self_test(spark: SparkSession) -> None:
    pages = spark.createDataFrame([(1, 1, "one two-"), (1, 2, "fold three"), (2, 1, "four")], "doc_id long, page int, text string")
    _, out = run.run_pages(pages, jobs.JobConfig("-", "-", chunk_chars=60), echo)
    got = {(r["doc_id"], r["page"]): r["body"] for r in out.pages.collect()}
    assert got == {(1, 1): "one twofold", (1, 2): "three", (2, 1): "four"}, got
    assert {r["status"] for r in out.report.collect()} <= {"approved", "review"}


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quireflow").getOrCreate()
    translate(spark, a) if a.command == "translate" else self_test(spark)
    print("done", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
