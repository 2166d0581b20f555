import difflib
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quireflow import __main__ as main_module
from quireflow.functions import markup as M
from quireflow.functions import text as X
from quireflow.operators import book, edition, flow, jobs, run
from quireflow.sources import epub
from quireflow.streaming.usage import usage_totals


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_parse_pages():
    assert flow.parse_pages("3-1,2,5", 5) == [1, 2, 3, 5]
    for bad in ("0", "1-9", ""):
        with pytest.raises(ValueError):
            flow.parse_pages(bad, 5)


def test_numbers(spark):
    t = F.col("t")
    assert one(spark, X.numbers(t), t="2.01% and 1,5") == ["15", "201%"]
    assert one(spark, X.same_numbers(F.col("s"), F.col("t")), s="fourth of 4, 1919", t="4 de 4, 1919") is True
    assert one(spark, X.same_numbers(F.col("s"), F.col("t")), s="2.01%", t="2,10%") is False


def test_labels_and_markdown(spark):
    label = F.col("t").rlike(X.CHAPTER)
    for t, want in (("1. Intro", True), ("Chapter 2: X", True), ("2.1 X", False), ("Figure 2.1 X", False), ("第三章", True)):
        assert one(spark, label, t=t) is want
    assert one(spark, X.render_markdown(F.col("t")), t="# A & B\n\nx\ny") == "<h2>A &amp; B</h2>\n<p>x<br>y</p>"
    assert one(spark, X.localise_label(F.col("t")), t="Theorem 2") == "Teorema 2"
    assert one(spark, X.slug(F.col("t")), t=" Ação & Reação! ") == "ação_reação"


def test_pages_last_wins(spark):
    t = "<!-- PAGINA_FISICA_001 -->a<!-- PAGINA_FISICA_002 -->b<!-- PAGINA_FISICA_001 -->c"
    assert [(r["page"], r["body"]) for r in one(spark, X.pages_of(F.col("t")), t=t)] == [(2, "b"), (1, "c")]


def test_pages_above_999(spark):
    d = spark.range(1, 1103).select(F.lit(1).alias("k"), F.struct("id", F.concat(X.page_marker(F.col("id")), F.lit("p"), "id").alias("t")).alias("x"))
    d = d.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "").alias("t"))
    got = d.select(F.explode(X.pages_of(F.col("t"))).alias("p")).select("p.page", "p.body").collect()
    assert [tuple(r) for r in got] == [(i, f"p{i}") for i in range(1, 1103)]
    with pytest.raises(Exception, match="page above 99999"):
        one(spark, X.page_marker(F.col("n")), n=100000)


def test_greedy_and_blocks(spark):
    items = spark.createDataFrame([("k", i, n) for i, n in enumerate((10, 20, 30, 5, 40))], "k string, i int, n int")
    assert [r[0] for r in flow.greedy_chunks(items, "k", "i", F.col("n"), 50).orderBy("i").select("chunk_id").collect()] == [0, 0, 1, 1, 2]
    rng = random.Random(1)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(1, 12))], [rng.choice("abc") for _ in range(rng.randint(1, 12))]) for i in range(60)]
    got = {r["k"]: (r["a"], r["b"], r["size"]) for r in flow.longest_blocks(spark.createDataFrame(rows, "k long, lhs array<string>, rhs array<string>"), "k").collect()}
    for k, l, r in rows:
        m = difflib.SequenceMatcher(None, l, r, autojunk=False).find_longest_match()
        assert got.get(k, (0, 0, 0)) == ((m.a, m.b, m.size) if m.size else (0, 0, 0))


def test_boundary_overlaps_are_cut(spark):
    """Every adjacent pair of pages against difflib; short pages and a page cut on both sides among them."""
    rng = random.Random(2)
    rows = []
    for k in range(40):
        before = []
        for page in range(rng.randint(1, 6)):
            words = [rng.choice("ab") + str(rng.randint(0, 9)) for _ in range(rng.choice((3, 9, 60)))]
            head = [rng.choice("xyz") for _ in range(rng.randint(0, 7))] + [w.upper() for w in before[-rng.randint(6, 14) :]] if rng.random() < 0.7 else []
            before = head + words
            rows.append((k, page, "; ".join(before) + rng.choice((" ", ".\n", ""))))
    token, want = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9]+"), {}
    for k, page, text in rows:
        l, r = (list(token.finditer(t)) for t in (text, next((t for d, p, t in rows if (d, p) == (k, page + 1)), "")))
        m = difflib.SequenceMatcher(None, [x[0].lower() for x in l[-40:]], [x[0].lower() for x in r[:40]], autojunk=False).find_longest_match()
        cut = l[-40:][m.a].start() if m.size >= 8 and m.a + m.size == len(l[-40:]) and m.b <= 5 else None
        want[k, page] = (text, None) if cut is None else (text[:cut].rstrip(), text[cut:].strip())
    got = flow.remove_boundary_overlaps(spark.createDataFrame(rows, "doc_id long, page int, text string"))
    assert {(r["doc_id"], r["page"]): (r["text"], r["removed"]) for r in got.collect()} == want and sum(v[1] is not None for v in want.values()) > 20


def test_costs(spark):
    c = spark.createDataFrame([(1, "gpt-5.6-sol", 1000, 200, 300), (2, "?", 1, 0, 0)], "call_id long, model string, input_tokens long, cached_input_tokens long, output_tokens long")
    usd = {r["call_id"]: r["usd"] for r in flow.call_cost(c).collect()}
    assert usd == {1: Decimal("0.009280"), 2: None}
    assert flow.call_cost(c).agg(flow.strict_total(F.col("usd"))).first()[0] is None
    lines = spark.createDataFrame([(1, '{"type":"turn.completed","usage":{"input_tokens":5}}'), (1, "bad"), (1, " "), (1, '{"type":"error","error":"x"}')], "call_id long, line string")
    r = flow.parse_usage(lines).first()
    assert (r["input_tokens"], r["output_tokens"], r["n_messages"]) == (5, 0, 2)


def test_markup():
    h = '<p>a <img src="x"/> <math><mi>x</mi></math> <a id="k"></a> <a href="u">z</a></p>'
    text, table = M.protect(h, "e1")
    assert len(table) == 3 and "<img" not in text and "<math" not in text and M.restore(text, table) == h
    assert list(table.values())[-1] == '<a id="k"></a>'
    assert M.valid_value(text, table, text)
    token = next(iter(table))
    for bad in ("", text.replace(token, ""), text + token, text.replace('href="u"', 'href="v"')):
        assert not M.valid_value(text, table, bad)
    assert [t for _, t, _ in M.elements("<div><p>a</p><ul><li><p>b</p></li></ul><figure><figcaption><p>c</p></figcaption></figure><p> </p></div>")] == ["p", "li", "figcaption", "p"]


def test_epub(spark):
    data = epub.sample("Title", ["<p>a</p>", "<p>b</p>"])
    assert epub.contents(data) == [(0, "OPS/c1.xhtml", "Chapter 1", 1), (1, "OPS/c2.xhtml", "Chapter 2", 1)]
    new = epub.rewrite(data, {"OPS/c1.xhtml": b"<html/>"})
    rows = epub.members(spark.createDataFrame([("a", data), ("b", new)], "path string, content binary")).collect()
    by = {(r["book_id"], r["name"]): bytes(r["bytes"]) for r in rows}
    assert [n for b, n in by if b == "a" and by["a", n] != by["b", n]] == ["OPS/c1.xhtml"]
    with pytest.raises(Exception):
        epub.rewrite(data, {"OPS/c1.xhtml": b"<html>"})


def test_toc_slice(spark):
    toc = spark.createDataFrame([(0, "a", "Part", 1), (1, "b", "Chapter 1", 2), (2, "c", "x", 3), (3, "d", "Chapter 2", 2), (4, "e", "Part", 1)], "ord long, doc string, label string, depth int")
    spine = spark.createDataFrame([(i, d) for i, d in enumerate("abcde")], "pos long, doc string")
    docs = lambda n: [r[0] for r in flow.toc_slice(toc, spine, n).orderBy("pos").select("doc").collect()]
    assert docs(1) == ["b", "c"] and docs(2) == ["b", "c", "d"]


def test_memory_and_rounds(spark):
    old = spark.createDataFrame([("k", "a", 1), ("m", "x", 5)], "memory_key string, translation string, created_at long")
    new = spark.createDataFrame([("k", "b", 1), ("m", "y", 4)], "memory_key string, translation string, created_at long")
    assert {r[0]: r[1] for r in flow.upsert(old, new).select("memory_key", "translation").collect()} == {"k": "b", "m": "x"}
    p = spark.createDataFrame([(1, "2 cats", "3 gatos"), (2, "dog", "cão")], "id long, source string, target string")
    review = lambda x: flow.triage(x).where("size(problems) > 0").select("id", F.explode("problems").alias("kind"))
    done, passes = flow.quality_rounds(p, review, lambda x: x.select("id", F.lit("2 gatos").alias("value")))
    assert {r["id"]: (r["target"], r["status"]) for r in done.collect()} == {1: ("2 gatos", "approved"), 2: ("cão", "approved")}
    assert [tuple(r) for r in passes.collect()] == [("audit", 1), ("repair", 0)]


def test_stream(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"model":"m","type":"turn.completed","usage":{"input_tokens":3}}\n{"model":"m","type":"error"}\n')
    q = usage_totals(spark, str(tmp_path)).writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("usage").first()) == ("m", 3, 0, 0, 0)


def test_jobs(spark, tmp_path):
    (tmp_path / "b0001.json").write_text('{"b": "two", "a": "one"}')
    (tmp_path / "b0001.meta.json").write_text('{"x": "y"}')
    got = jobs.blocks(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["block"], r["ord"], r["id"], r["text"]) for r in got] == [("b0001.json", 0, "b", "two"), ("b0001.json", 1, "a", "one")]
    calls = tmp_path / "calls"
    calls.mkdir()
    (calls / "1.json").write_text('{\n"model": "m", "usage": {"input_tokens": 3}, "api_equivalent_usd": 0.5}')
    (calls / "2.json").write_text("{broken")
    assert [r["usage"]["input_tokens"] for r in jobs.call_log(spark, str(calls)).collect()] == [3]
    config = jobs.JobConfig("a.epub", "out", concurrency=9)
    stored = jobs.check_identity(None, config, "h")
    assert config.concurrency == 4 and jobs.check_identity(stored, config, "h") == stored
    with pytest.raises(ValueError):
        jobs.check_identity(stored, config, "other")
    assert jobs.purge(tmp_path, "*.json", {"b0001.json"}) == ["b0001.meta.json"]
    project = jobs.publish(tmp_path / "p", tmp_path / "b0001.json", [tmp_path / "b0001.json"], {"qa": {"status": "approved"}})
    assert project["reports"] == ["qa"] and (tmp_path / "p" / "03_entrega_atual" / "b0001.json").exists()
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    row = jobs.assemble(ids(), ids(), ids("a", "b"), ids("a")).first()
    assert (row["status"], row["covered"], row["problems"]) == ("review", False, 1)
    assert jobs.assemble(ids(), ids(), ids("a"), ids("a")).first()["status"] == "approved"


def test_text_outside():
    assert M.text_outside('<p>the <i class="citation x">and <b>b</b></i> x</p><script>y</script>') == "the x"
    assert M.text_outside(None) == ""


def test_resolve_and_trim(spark):
    d = spark.createDataFrame([("OPS/a/c.xhtml", "../i/x%20y.png#z", '<p>a</p><i id="pg_3"/>b<i id="pg_4"/>c')], "base string, src string, h string")
    r = d.select(M.resolve(F.col("base"), F.col("src")).alias("p"), M.trim_after(F.col("h"), F.lit(3)).alias("t"), M.trim_after(F.col("h"), F.lit(9)).alias("all"), M.last_page(F.col("h")).alias("n")).first()
    assert (r["p"], r["t"], r["n"]) == ("OPS/i/x y.png", '<p>a</p><i id="pg_3"/>b', 4) and r["all"].endswith("c")


def test_numbered_objects():
    h = '<figure id="x"><img alt="old" src="a"/><figcaption>A &amp; b</figcaption></figure><figure><table><tr><td>1</td></tr></table></figure>'
    got, n = edition.number_objects(h, (4, 0))
    assert n == (2, 1)
    assert got == ('<figure id="figura-5"><img alt="Figura 5. A &amp; b" src="a"/><figcaption><span class="object-label">Figura 5.</span> A &amp; b</figcaption></figure>'
                   '<figure id="figura-6"><table id="tabela-1"><caption><span class="object-label">Tabela 1.</span> </caption><tr><td>1</td></tr></table><figcaption><span class="object-label">Figura 6.</span> </figcaption></figure>')
    assert edition.number_objects("") == ("", (0, 0))


def test_notes():
    cite = '<span class="citation">(x)<span class="sidenote">n</span></span>'
    got, n = edition.cite_as_notes(f'<p>{cite} and {cite} <span class="citation">y</span></p><div class="references">r</div>', 3)
    assert n == 2 and got.count("citation\"") == 1 and got.index("nota-3-2") < got.index('<section class="citation-notes">') < got.index('<div class="references">')
    for k in (1, 2):
        assert f'href="#nota-3-{k}"' in got and f'<li id="nota-3-{k}">n ' in got and f'href="#chamada-nota-3-{k}"' in got
    assert edition.cite_as_notes(f"<article>{cite}</article>z", 1)[0].endswith("</section></article>z")
    assert edition.cite_as_notes("<p>a</p>", 1) == ("<p>a</p>", 0)


def test_edition(spark, tmp_path):
    d = spark.createDataFrame([("b", 1, "<h1>One</h1>"), ("b", 2, None), ("b", 3, '<h1>x</h1><h1 class="title">T<i>wo</i></h1>')], "book string, ord long, html string")
    s = edition.sections(d)
    assert [(r["doc"], r["title"], r["anchor"]) for r in s.orderBy("ord").collect()] == [(1, "One", "toc-1"), (2, None, None), (3, "T wo", "toc-2")]
    edition.write(edition.parts(s, spark.createDataFrame([("b", "A & B"), ("none", "x")], "book string, name string")), str(tmp_path / "out"))
    folders = [p.name for p in (tmp_path / "out").glob("book=*")]
    text = next((tmp_path / "out" / "book=b").glob("*.txt")).read_text("utf-8")
    assert folders == ["book=b"] and "<title>A &amp; B</title>" in text and text.rstrip().endswith("</html>")
    assert text.index('href="#toc-1"') < text.index('href="#toc-2"') < text.index('<h1 id="toc-1">') < text.index('<h1 id="toc-2" class="title">')


def test_greedy_null_key_and_oversize(spark):
    items = spark.createDataFrame([(None, 1, 90), (None, 2, 5), (None, 3, None), ("a", 1, 5)], "k string, i int, n int")
    assert [r["chunk_id"] for r in flow.greedy_chunks(items, "k", "i", F.col("n"), 50).orderBy(F.col("k").asc_nulls_first(), "i").collect()] == [0, 1, 1, 0]


def test_audit_key(spark):
    p = lambda t: spark.createDataFrame([(1, "a", t), (2, "b", "y")], "id long, source string, target string")
    one = spark.createDataFrame([(1,)], "id long")
    key = lambda d, sel=one, model="m": flow.audit_key(d, sel, model, "v1").first()[0]
    assert key(p("x")) == key(p("x").orderBy(F.desc("id"))) and len({key(p("x")), key(p("z")), key(p("x"), one.limit(0)), key(p("x"), model="n")}) == 4


def test_epub_checks(spark):
    data = epub.sample("T", ['<p data-item="1">a</p><table><tr><td>2</td></tr></table><a href="#x"/><a href="#y"/><i id="y"/>', '<img src="i/a.png"/>'])
    new = epub.translate(data, {"OPS/c1.xhtml": {0: "novo"}})
    frame = lambda x: spark.createDataFrame([("b", x)], "path string, content binary")
    entries = epub.members(frame(data))
    assert [tuple(r) for r in epub.broken_links(entries).collect()] == [("b", "OPS/c1.xhtml", "x")]
    by = {r["name"]: r for r in epub.members(frame(new)).collect()}
    text = bytes(by["OPS/c1.xhtml"]["bytes"]).decode()
    assert text.startswith('<html lang="pt-BR" xml:lang="pt-BR">') and "<p>novo</p>" in text
    worse = epub.rewrite(data, {"OPS/c1.xhtml": b'<html><body><p>a</p><table><tr><td>3</td></tr></table><a href="#z"/></body></html>'})
    r = epub.compare(entries, epub.members(frame(worse))).where("name = 'OPS/c1.xhtml'").first()
    assert (r["same"], r["structure"], r["links"], r["cells"]) == (False, False, False, False)
    assert tuple(epub.page_counts(entries).first()) == ("b", None)
    assert epub.excerpt(data, ["OPS/c2.xhtml", "OPS/none"]) == ["OPS/c2.xhtml"]


def keyed(rows, spark, schema):
    return spark.createDataFrame(rows, schema)


def test_chunk_files(spark, tmp_path):
    p = keyed([(1, 1, "aa"), (1, 2, ""), (1, 3, None), (2, 1, "b" * 90)], spark, "doc_id long, page int, text string")
    chunks, manifest = book.chunked_pages(p, 80)
    got = {(r["doc_id"], r["chunk"]): r["text"] for r in chunks.collect()}
    assert got[1, 1] == "<!-- PAGINA_FISICA_001 -->\n\naa\n" and got[2, 1].endswith("b" * 90 + "\n") and "sem texto" in got[1, 2]
    assert {(r["doc_id"], r["pages"]) for r in manifest.collect()} == {(1, 3), (2, 1)}
    book.write_chunks(chunks, manifest, f"file://{tmp_path}")
    back = spark.read.text(f"file://{tmp_path}/chunks", wholetext=True)
    assert sorted(r["value"].strip("\n") for r in back.collect()) == sorted(t.strip("\n") for t in got.values())
    assert spark.read.json(f"file://{tmp_path}/manifest").count() == 2
    assert book.chunk_limit(100) == 5000 and book.chunk_limit(3000) == 6000 and book.chunk_limit(10**6) == 12000


def test_glossary(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"loss": "perda"}')
    assert book.load_glossary(spark, f"file://{tmp_path}/a.json", f"file://{tmp_path}/b.json") == {"loss": "perda"}
    assert book.load_glossary(spark, f"file://{tmp_path}/a.json") == {}
    key = lambda **k: one(spark, flow.memory_key(F.col("t"), "m", **k), t="x")
    assert key() == key(glossary={}) and key(glossary={"a": "b", "c": "d"}) == key(glossary={"c": "d", "a": "b"}) != key()


def test_outputs(spark):
    """Absent, extra and repeated pages, a folio, and a tail that the next page repeats."""
    tail = "alpha beta gamma delta epsilon zeta eta theta iota"
    mark = "<!-- PAGINA_FISICA_%03d -->"
    blocks = [(1, 1, f"{mark % 1}\none start {tail}\n12\n"), (1, 2, f"{mark % 2}\n{tail} goes on\n{mark % 9}\nx"), (2, 1, None)]
    source = [(1, i, "s" * 60) for i in (1, 2, 3)] + [(2, 1, None)]
    out = book.outputs(keyed(blocks, spark, "doc_id long, block int, text string"), keyed(source, spark, "doc_id long, page int, text string"))
    pages = {(r["doc_id"], r["page"]): r["body"] for r in out.pages.collect()}
    assert pages == {(1, 1): "one start", (1, 2): f"{tail} goes on", (1, 3): "", (2, 1): ""}
    assert [tuple(r) for r in out.corrections.collect()] == [(1, 1, tail)]
    r = {x["doc_id"]: x for x in out.report.collect()}
    assert (r[1]["missing"], r[1]["extra"], r[1]["untranslated"], r[1]["overlaps"], r[1]["status"]) == ([3], [9], [3], 0, "review")
    assert (r[2]["ratio"], r[2]["missing"], r[2]["warnings"]) == (0.0, [1], ["untranslated", "ratio", "pages"])
    text = {x["doc_id"]: x["text"] for x in out.text.collect()}
    assert text[1] == f"{mark % 1}\n\none start\n\n{mark % 2}\n\n{tail} goes on\n\n{mark % 3}\n" and text[2] == f"{mark % 1}\n"
    assert "<p>one start</p>" in {x["doc_id"]: x["html"] for x in out.html.collect()}[1]


def test_page_cut(spark):
    html = '<div><p>a</p><section><span id="pg_4"></span><p>b</p><span id="pg_5"></span><p>c</p></section></div>'
    assert M.page_cut(html, 4) == ('<div><p>a</p><section><span id="pg_4"></span><p>b</p></section></div>', False)
    assert M.page_cut(html, 9) == (html, False)
    assert M.page_cut('<p>x <i><a id="pg_7"></a>y</i></p>', 6) == ("<p>x <i></i></p>", True)
    d = keyed([("k", 1, "<p>one</p>"), ("k", 2, html), ("k", 3, "<p>three</p>"), ("l", 1, None), ("m", 1, '<p><a id="pg_9"></a></p>')], spark, "book string, pos int, html string")
    got = {(r["book"], r["pos"]): (r["html"], r["error"]) for r in book.cut_book(d, F.lit(3), strict=False).collect()}
    assert set(got) == {("k", 1), ("k", 2), ("l", 1), ("m", 1)} and got["k", 2] == ("<div><p>a</p><section></section></div>", None)
    assert got["m", 1][0] == '<p><a id="pg_9"></a></p>' and "inside" in got["m", 1][1]
    with pytest.raises(Exception, match="inside an element"):
        book.cut_book(d, F.lit(3)).collect()


def test_chapter_guard(spark):
    toc = keyed([("a", "d1", "Chapter 1"), ("a", "d1", "Chapter 2"), ("b", "d1", "1. One"), ("b", "d2", "x"), ("c", "d1", "Chapter 1"), ("c", "d2", "Chapter 2"), ("d", None, None)], spark, "book string, doc string, label string")
    got = {r["book"]: r["error"] for r in book.chapter_errors(toc, F.lit(2)).collect()}
    assert got == {"a": "two chapters in one document", "b": "fewer chapters than wanted", "c": None, "d": "fewer chapters than wanted"}
    with pytest.raises(ValueError, match="two chapters"):
        book.require_chapters(toc, 2)
    book.require_chapters(toc.where("book = 'c'"), 2)


def test_numbered_elements(spark):
    a = "<h1>t</h1><p></p><ul><li><p>x</p></li><li> </li></ul><table><caption>c</caption><tr><td>1</td></tr></table>"
    d = keyed([("k", 1, a), ("k", 2, a), ("l", 1, None)], spark, "book string, ord int, html string")
    got = [(r["id"], r["tag"], r["source"]) for r in book.numbered_elements(d).orderBy("id").collect()]
    assert got == [("d01c0001", "caption", "c"), ("d01e0001", "h1", "t"), ("d01e0003", "p", "x"), ("d01e0004", "td", "1"), ("d01l0001", "li", "<p>x</p>"), ("d02c0002", "caption", "c"), ("d02e0001", "h1", "t"), ("d02e0003", "p", "x"), ("d02e0004", "td", "1"), ("d02l0002", "li", "<p>x</p>")]
    h = '<figure><figcaption><span class="object-label">1</span></figcaption></figure><figure><figcaption>x</figcaption></figure><table><caption><b class="x object-label">1</b></caption></table>'
    assert one(spark, book.caption_warnings(F.col("h")), h=h) == ["figures: 1"]
    assert one(spark, M.count_equations(F.col("h")), h='<math></math><span class="a math b"><i class="mathx"></i></span><figure class="IMGE"></figure><p class=\'math\'>') == 4


def test_answers_and_memory(spark):
    expected = keyed([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (4, 0, "e")], spark, "batch int, ord int, id string")
    answers = keyed([(1, '```json\n{"a":"x","b":"y"}\n```'), (2, '{"c":" "}'), (3, '{"d":"1","q":"2"}'), (4, "no")], spark, "batch int, json string")
    assert [tuple(r) for r in book.parsed_answers(answers, expected).orderBy("id").collect()] == [(1, "a", "x"), (1, "b", "y")]
    assert book.parsed_answers(keyed([(1, '{"b":"y","a":"x"}')], spark, "batch int, json string"), expected).count() == 0
    assert {r["id"]: r["kinds"] for r in book.known_problems(keyed([(2, "a", "n"), (1, "a", "f"), (0, "zz", "n")], spark, "ord int, id string, kind string"), expected).collect()} == {"a": ["f", "n"]}
    items = keyed([("k1", "10"), ("k2", "20"), ("k3", "30"), (None, "40")], spark, "memory_key string, source string")
    memory = keyed([("k1", "10 a", 1), ("k1", "10 b", 2), ("k2", "99", 1), ("k3", None, 1), (None, "40", 1)], spark, "memory_key string, translation string, created_at int")
    hits, pending = flow.lookup(items, memory, lambda v: X.numbers(F.col("source")) == X.numbers(v))
    assert [tuple(r) for r in hits.collect()] == [("k1", "10", "10 b")] and sorted(r["source"] for r in pending.collect()) == ["20", "30", "40"]
    pairs = keyed([("k5", "v", "approved"), ("k6", "w", "approved")], spark, "memory_key string, target string, status string")
    assert run.remember(memory, pairs, F.lit(9)).where("memory_key in ('k5', 'k6')").count() == 2
    assert run.remember(memory, pairs.union(keyed([("k7", "v", "review")], spark, pairs.schema)), F.lit(9)) is memory
    assert book.block_gaps(keyed([(1, "a"), (1, "b"), (2, "a")], spark, "k int, block string"), keyed([(1, "a"), (2, "a")], spark, "k int, block string"), "k").collect()[0].asDict() == {"k": 1, "sources": 2, "targets": 1}


def test_repairs_count_whole(spark):
    """A batch with an invalid, missing or repeated answer stays as it was; an unknown id breaks them all."""
    rows = [(1, "a", "s1"), (2, "a", "s2"), (3, "b", "s3"), (4, "b", "s4"), (5, "c", "s5"), (6, None, "s6")]
    affected = keyed(rows, spark, "id int, batch string, source string")
    good = [(1, "x1"), (2, "x2"), (3, "x3"), (4, " "), (5, "x5"), (5, "y5"), (6, "x6")]
    answer = lambda extra=(): keyed([*good, *extra], spark, "id int, value string")
    take = lambda a, **k: sorted(tuple(r) for r in flow.accepted(affected, a, **k).collect())
    assert take(answer(), batch="batch") == [(1, "x1"), (2, "x2"), (6, "x6")] and take(answer()) == []
    assert take(answer([(9, "z")]), batch="batch") == []
    same = lambda v: F.right(v, F.lit(1)) == F.right("source", F.lit(1))
    assert take(answer(), batch="batch", valid=same) == [(1, "x1"), (2, "x2"), (6, "x6")]
    assert take(answer(), batch="batch", valid=lambda v: v == "x1") == []


def test_element_job(spark):
    """Values from an earlier chunk, the memory and three rounds; a repair; the memory after an approved job."""
    items = keyed([("k", i, f"e{i}", f"text {i}") for i in range(40)], spark, "book string, ord int, id string, source string")
    config = jobs.JobConfig("s", "o", chunk_chars=1)
    keyed_items = run.with_chunk_keys(items, 5000, config.model)
    assert keyed_items.select("chunk_id").distinct().count() == 1
    memory = items.where("ord % 4 = 0").select(flow.memory_key(F.col("source"), config.model).alias("memory_key"), F.concat(F.lit("m "), F.col("ord")).alias("translation"), F.lit(1).alias("created_at"))
    valid = lambda v: X.numbers(v) == X.numbers(F.col("source"))
    answer = lambda p, name: p.select("id", F.when((F.col("ord") % 4 != 3) | (F.lit(name) == "single"), F.concat(F.lit("t "), "ord")).alias("target"))
    bad = lambda p: p.select("id", F.when(F.col("target").startswith("t 5"), "style").alias("kind"))
    fix = lambda p: p.select("id", F.concat(F.lit("fixed "), "ord").alias("value"))
    job = run.run_elements(items, config, answer, bad, fix, valid, memory=memory, created_at=F.lit(2))
    got = {r["ord"]: (r["target"], r["origin"], r["status"]) for r in job.pairs.collect()}
    assert got[4] == ("m 4", "memory", "approved") and got[3] == ("t 3", "single", "approved") and got[1][1] == "first"
    assert job.report.first()["status"] == "approved" and job.memory.count() == 40
    results = job.pairs.select("chunk_key", "id", "target")
    again = run.run_elements(items, config, lambda *_: pytest.fail("asked"), bad, fix, valid, results=results, memory=job.memory, created_at=F.lit(3))
    assert {r["origin"] for r in again.pairs.collect()} == {"chunk"}
    half = run.translated(keyed_items.withColumn("memory_key", F.lit("")), answer, valid, results=results.where("id <> 'e7'"))
    assert {r["origin"] for r in half.collect()} == {"first", "single"}  # a chunk comes back whole or not at all
    with pytest.raises(ValueError, match="no valid translation"):
        run.run_elements(items, config, lambda p, n: p.select("id", F.lit("").alias("target")), bad, fix, valid)


def test_page_job_and_reports(spark, tmp_path):
    main_module.self_test(spark)
    spark.createDataFrame([(1, i, f"page {i} has words") for i in range(1, 6)], "doc_id long, page int, text string").write.parquet(str(tmp_path / "in"))
    main_module.translate(spark, main_module.parser().parse_args(["translate", "--input", str(tmp_path / "in"), "--output", f"file://{tmp_path}/out", "--pages", "2-3", "--concurrency", "9"]))
    assert {r["page"]: r["body"] for r in spark.read.json(f"file://{tmp_path}/out/pages").collect()} == {2: "page 2 has words", 3: "page 3 has words"}
    assert spark.read.json(f"file://{tmp_path}/out/report").first()["status"] == "approved"
    calls = keyed([("gpt-5.6-luna", 1000, 0, 100), ("x", 1, 0, 1)], spark, "model string, input_tokens long, cached_input_tokens long, output_tokens long")
    got = {r["model"]: (r["usd"], r["brl"]) for r in run.cost_report(calls).collect()}
    assert got == {"gpt-5.6-luna": (Decimal("0.000320"), Decimal("0.00")), "x": (None, None)}


def test_book_scan(spark):
    data = epub.sample("A", ['<p id="pg_3"><img src="x"/><span class="math">m</span></p><table><tr><td>1</td></tr></table>', "<p>y</p>"])
    books = keyed([("p", bytearray(data))], spark, "path string, content binary")
    r = epub.inventory(books).first()
    assert (r["title"], r["documents"], r["pages"], r["chapters"], r["creator"], r["images"], r["equations"], r["tables"], r["figures"]) == ("A", 2, 3, 2, "", 1, 1, 1, 0)
    bare = epub.members(keyed([("q", bytearray(epub.sample("B", ["<p>z</p>"])))], spark, "path string, content binary"))
    assert epub.page_counts(bare).first()["pages"] is None
    with pytest.raises(Exception, match="no printed page"):
        epub.page_counts(bare, strict=True).collect()
    html = epub.sample("C", ['<p><img data-src="a.png" src="ativos/1.png"/><a href="#n" data-href="b.xhtml">t</a></p>'])
    with __import__("zipfile").ZipFile(__import__("io").BytesIO(epub.translate(html, {"OPS/c1.xhtml": {}}))) as z:
        assert b'<p><img src="a.png"/><a href="b.xhtml">t</a></p>' in z.read("OPS/c1.xhtml")


def test_longest_blocks_in_a_row(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice("abc") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]) for i in range(200)] + [(900, None, ["a"]), (901, [None], [None])]
    got = {r["doc_id"]: (r["a"], r["b"], r["size"]) for r in flow.longest_blocks(keyed(rows, spark, "doc_id int, lhs array<string>, rhs array<string>")).collect()}
    for i, x, y in rows[:200]:
        m = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match()
        assert got.get(i, (0, 0, 0))[2] == m.size and (m.size == 0 or got[i] == tuple(m))
    assert 900 not in got and 901 not in got


def test_missed_terms(spark):
    pairs = keyed([("Of THE day in the end", "do dia"), ("in the x", "No The x"), ("single", None)], spark, "source string, target string")
    terms = {"of the": "do", "in the": "no the", "single": "x"}
    assert [r[0] for r in pairs.select(flow.missed_terms(F.col("source"), F.coalesce("target", F.lit("")), terms)).collect()] == [["in the"], [], []]
    t = {r["source"]: r["problems"] for r in flow.triage(pairs, {**terms, "the end": "z z", "big one": "q"}).collect()}
    assert t["Of THE day in the end"] == ["glossary_missed", "glossary_missed"] and t["in the x"] == []
    many = {f"term {i}": "x" for i in range(5000)}
    assert flow.triage(pairs, many).count() == 3


def test_harvest(spark):
    data = epub.sample("A", ['<p><img alt="" src="c2.xhtml#x"/><img src="c2.xhtml"/><img src="http://h/a.png"/></p>', "<p>y</p>"])
    entries = epub.members(keyed([("p", bytearray(data))], spark, "path string, content binary"))
    got = epub.harvest(entries).collect()
    assert [(r["path"], bytes(r["bytes"])) for r in got] == [("OPS/c2.xhtml", b"<html><body><p>y</p></body></html>")] and got[0]["asset"].endswith(".xhtml")
    lost = epub.members(keyed([("q", bytearray(epub.sample("B", ['<img src="../z.png">'])))], spark, "path string, content binary"))
    assert [tuple(r) for r in epub.harvest(lost, strict=False).select("path", "bytes").collect()] == [("z.png", None)]
    with pytest.raises(Exception, match="no member holds"):
        epub.harvest(lost).collect()
