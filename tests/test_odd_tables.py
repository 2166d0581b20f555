"""Queries against their SQL on small tables of odd rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from quireflow.operators import book


def agree(spark, folder, name, **tables):
    """The query's rows, after they were found equal to its SQL's. tables: name=(schema, rows)."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    rows = sorted(map(repr, map(tuple, df.collect())))
    assert rows == sorted(map(repr, con.sql(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()))
    return rows


def documents(*texts):
    return "doc_id long, text string, lang string, source string", [(i, t, "es", "s") for i, t in enumerate(texts, 1)]


PAD = "xq " * 90
#: A word of the lists before and after a letter outside ASCII, and with letters that fold outside ASCII.
WORDS = [PAD + w for w in ("noñada", "éno", "no", "noche", "cauſal", "cauſe", "xſignificant", "ſignificant", "biaſ", "biaſx", "bıas", "NOT", "ñthe thé éthat THİS thiſ thiſx", "two 2 twoñ 2", "sİx 6", "fourñ", "")]


@pytest.mark.parametrize("name", ["risk_triage", "residual_language", "number_words", "audit_selection", "known_problems", "triage_rollup"])
def test_words_outside_ascii(spark, tmp_path, name):
    rows = agree(spark, tmp_path, name, documents=documents(*WORDS))
    if name == "risk_triage":
        assert sum("sensitive_relation" in r for r in rows) == 8


@pytest.mark.parametrize("name", ["audit_selection", "known_problems", "triage_rollup"])
def test_number_of_many_parts(spark, tmp_path, name):
    """Numbers in a list without blanks are one number, however many they are."""
    agree(spark, tmp_path, name, documents=documents("1," * 20000 + "1", "1." * 20000 + "2%", "the 3", "1," * 20000, "1,2" * 9000))


def test_reduction_next_to_a_tie(spark, tmp_path):
    """1,442 of 4,000 characters selected: the double is just below 63.95, ten times it 639.5."""
    rows = agree(spark, tmp_path, "triage_rollup", documents=documents("x" * 639, "x" * 640, "", "", "x" * 541, "", "", "", "", "x" * 541))
    assert rows == ["(10, 8, 0, 64.0)"]


def test_locked_files_of_one_path(spark, tmp_path):
    """Pages that share a url, or have none, are files of their own."""
    rows = [(i, None if i > 7 else "u" if i > 2 else f"u{i}", "x" * (i % 3)) for i in range(12)] + [(12, "v", None), (13, "v", None)]
    agree(spark, tmp_path, "file_lock", pages=("page_id long, url string, html string", rows))


def test_page_that_goes_whole(spark, tmp_path):
    """A page that its next one repeats was translated: the cut empties it, the report says so."""
    agree(spark, tmp_path, "book_report", documents=documents("erbeberzu " * 160, "", None, "a" * 900))
    line = " ".join(f"w{i}" for i in range(9))
    blocks = spark.createDataFrame([(1, 1, f"<!-- PAGINA_FISICA_001 -->{line}<!-- PAGINA_FISICA_002 -->{line} on<!-- PAGINA_FISICA_003 -->")], "doc_id long, block int, text string")
    source = spark.createDataFrame([(1, i, line) for i in (1, 2, 3)], "doc_id long, page int, text string")
    out = book.outputs(blocks, source)
    r = out.report.first()
    assert (r["untranslated"], r["emptied"], r["missing"]) == ([3], [1], []) and "untranslated" in r["warnings"]
    assert out.pages.columns == ["doc_id", "ord", "page", "body"]
    assert "untranslated" in book.outputs(blocks, source.where("page < 3")).report.first()["warnings"]
