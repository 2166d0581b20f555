"""Queries over whole books and jobs, with their SQL; preparation is the same expression on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as X
from ..operators import book, flow, jobs, run
from .catalogue import _NUM_SQL, _PAGES_SQL, _PAIRS_SQL, _STUB, _TRIAGE_SQL, _VISIBLE_SQL, MARK, TRIM, _escaped, _same_numbers_sql, docs, pages, pairs, query, read

_EMPTY = "[Página sem texto extraível]"
_MARKED_SQL = f"'{MARK}' || CASE WHEN page < 1000 THEN lpad(page::VARCHAR, 3, '0') ELSE page::VARCHAR END || ' -->'"


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, page, {_MARKED_SQL} || chr(10) || chr(10) || CASE WHEN trim(text, {TRIM}) = '' THEN '{_EMPTY}' ELSE text END || chr(10) AS t FROM ({_PAGES_SQL})),
f AS (SELECT doc_id, page, length(t) AS s, 1 AS c FROM p WHERE page = 1 UNION ALL
  SELECT p.doc_id, p.page, CASE WHEN f.s + length(p.t) > 2000 THEN length(p.t) ELSE f.s + length(p.t) END, CASE WHEN f.s + length(p.t) > 2000 THEN f.c + 1 ELSE f.c END FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page + 1)
SELECT f.doc_id, f.c::BIGINT AS chunk, md5(string_agg(p.t, chr(10) || chr(10) ORDER BY f.page)) AS text FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page GROUP BY f.doc_id, f.c""")
def page_chunks(spark, sf_dir):
    chunks, _ = book.chunked_pages(pages(spark, sf_dir), 2000)
    return chunks.select("doc_id", "chunk", F.md5(F.col("text").cast("binary")).alias("text"))


def _blocks(spark, sf_dir) -> DataFrame:
    """Blocks of three marked pages with folios; every seventh page is lost, every tenth document has a page too many."""
    p = pages(spark, sf_dir)
    body = F.concat(X.page_marker(F.col("page")), F.lit("\n"), "text", F.lit("\n"), F.col("page").cast("string"), F.lit("\n"))
    p = p.withColumn("t", F.when((F.col("doc_id") + F.col("page")) % 7 != 0, body).otherwise(""))
    p = p.withColumn("t", F.when((F.col("doc_id") % 10 == 4) & (F.col("page") == 1), F.concat("t", X.page_marker(F.lit(90_000)), F.lit("x\n"))).otherwise(F.col("t")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "")
    return p.groupBy("doc_id", ((F.col("page") - 1) / 3).cast("int").alias("block")).agg(parts.alias("text"))


_FOUND_SQL = f"""s AS ({_PAGES_SQL}),
g AS (SELECT doc_id, page, text AS source, CASE WHEN (doc_id + page) % 7 <> 0 THEN regexp_replace(trim(chr(10) || text || chr(10) || page::VARCHAR || chr(10), {TRIM}), '(?i)\\n\\s*([ivxlcdm]+|[0-9]{{1,4}})\\s*$', '') END AS body FROM s)"""


@query(f"""WITH {_FOUND_SQL},
c AS (SELECT doc_id, sum(length(source))::BIGINT AS source_chars, string_agg(CASE WHEN body IS NULL THEN page::VARCHAR END, ',' ORDER BY page) AS missing, string_agg(CASE WHEN coalesce(body, '') = '' THEN page::VARCHAR END, ',' ORDER BY page) AS untranslated FROM g GROUP BY doc_id)
SELECT doc_id, source_chars, coalesce(missing, '') AS missing, CASE WHEN doc_id % 10 = 4 THEN '90000' ELSE '' END AS extra, coalesce(untranslated, '') AS untranslated FROM c""")
def book_report(spark, sf_dir):
    """What is missing, too many or empty in each document put together again from its blocks."""
    out = book.outputs(_blocks(spark, sf_dir), pages(spark, sf_dir))
    csv = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return out.report.select("doc_id", "source_chars", *map(csv, ("missing", "extra", "untranslated")))


@query(f"""WITH {_FOUND_SQL},
p AS (SELECT doc_id, page, coalesce(body, '') AS text FROM g),
t AS (SELECT doc_id, page, list_transform(regexp_extract_all(text, '[{flow.TOKEN}]+'), lambda x: lower(x)) AS w FROM p),
h AS (SELECT doc_id, page, w[-40:] AS l, lead(w[1:40]) OVER (PARTITION BY doc_id ORDER BY page) AS r FROM t),
l AS (SELECT doc_id, page, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS i FROM h), r AS (SELECT doc_id, page, unnest(r) AS t, generate_subscripts(r, 1) - 1 AS j FROM h),
m AS (SELECT l.doc_id, l.page, i, j, i - row_number() OVER (PARTITION BY l.doc_id, l.page, i - j ORDER BY i) AS g FROM l JOIN r ON l.doc_id = r.doc_id AND l.page = r.page AND l.t = r.t),
q AS (SELECT doc_id, page, min(i) AS a, min(j) AS b, count(*) AS k FROM m GROUP BY doc_id, page, i - j, g),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY k DESC, a, b) AS rn FROM q),
c AS (SELECT b.doc_id, b.page, b.k FROM b JOIN h ON h.doc_id = b.doc_id AND h.page = b.page WHERE rn = 1 AND k >= 8 AND a + k = len(h.l) AND b <= 5),
x AS (SELECT p.doc_id, p.page, p.text, CASE WHEN k IS NOT NULL THEN regexp_extract(p.text, '(?:^|[^{flow.TOKEN}])((?:[{flow.TOKEN}]+[^{flow.TOKEN}]+){{' || (k - 1)::VARCHAR || '}}[{flow.TOKEN}]+[^{flow.TOKEN}]*)$', 1) END AS tail FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.page = p.page),
y AS (SELECT doc_id, page, CASE WHEN tail IS NULL THEN text ELSE rtrim(left(text, length(text) - length(tail)), {TRIM}) END AS body FROM x)
SELECT doc_id, md5(trim(string_agg({_MARKED_SQL} || chr(10) || chr(10) || trim(body, {TRIM}), chr(10) || chr(10) ORDER BY page), {TRIM}) || chr(10)) AS text FROM y GROUP BY doc_id""")
def book_text(spark, sf_dir):
    """Each document's pages merged again: lost pages empty, folios and repeated tails gone."""
    return book.outputs(_blocks(spark, sf_dir), pages(spark, sf_dir)).text.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))


_BOOK = "page_id - page_id % 10"
_SHOWN_SQL = _escaped(_VISIBLE_SQL)


@query(f"""WITH d AS (SELECT {_BOOK} AS book, page_id AS pos, 2 * ({_BOOK}) + 6 + ({_BOOK}) // 10 % 2 AS stop, {_SHOWN_SQL} AS t FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)),
c AS (SELECT *, (stop + 1) // 2 AS last, (stop + 1) % 2 = 1 AS second FROM d)
SELECT book, pos, md5('<div>' || CASE WHEN pos < last OR second THEN '<a id="pg_' || (2 * pos)::VARCHAR || '"></a><p>' || t || '</p>' ELSE '' END || CASE WHEN pos < last THEN '<span id="pg_' || (2 * pos + 1)::VARCHAR || '"></span><p>z</p>' ELSE '' END || '</div>') AS html FROM c WHERE pos <= last""")
def book_cut(spark, sf_dir):
    """Books of ten documents with two page marks each, cut past a page in their fourth or fifth."""
    p = read(spark, sf_dir, "pages").select(F.expr(_BOOK).alias("book"), F.col("page_id").alias("pos"), X.html_escape(M.visible_text(F.coalesce("html", F.lit("")))).alias("t"))
    html = F.concat(F.lit('<div><a id="pg_'), (2 * F.col("pos")).cast("string"), F.lit('"></a><p>'), "t", F.lit('</p><span id="pg_'), (2 * F.col("pos") + 1).cast("string"), F.lit('"></span><p>z</p></div>'))
    stop = 2 * F.col("book") + 6 + F.floor(F.col("book") / 10) % 2
    return book.cut_book(p.select("book", "pos", html.alias("html")), stop).select("book", "pos", F.md5(F.col("html").cast("binary")).alias("html"))


@query(f"""WITH t AS (SELECT {_BOOK} AS book, 'c' || CASE WHEN page_id % 40 = 6 THEN page_id - 3 ELSE page_id END AS doc, page_id % 3 = 0 AS chapter FROM pages),
c AS (SELECT book, count(*) FILTER (chapter) AS chapters, count(DISTINCT doc) FILTER (chapter) AS d FROM t GROUP BY book)
SELECT book, chapters::BIGINT AS chapters, CASE WHEN d < chapters THEN 'two chapters in one document' WHEN chapters < 4 THEN 'fewer chapters than wanted' END AS error FROM c""")
def chapter_guard(spark, sf_dir):
    """Contents of books of ten pages, a third of them chapters, in some books two of them in one document."""
    doc = F.concat(F.lit("c"), F.when(F.col("page_id") % 40 == 6, F.col("page_id") - 3).otherwise(F.col("page_id")).cast("string"))
    toc = read(spark, sf_dir, "pages").select(F.expr(_BOOK).alias("book"), doc.alias("doc"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("Chapter "), "page_id")).otherwise(F.col("url")).alias("label"))
    return book.chapter_errors(toc, F.lit(4))


@query(f"""WITH d AS (SELECT {_BOOK} AS book, page_id AS ord, row_number() OVER (PARTITION BY {_BOOK} ORDER BY page_id) AS doc, url, {_SHOWN_SQL} AS t FROM (SELECT page_id, url, coalesce(html, '') AS html FROM pages)),
k AS (SELECT *, sum(1 + (t <> '')::INT) OVER (PARTITION BY book ORDER BY ord) - 1 - (t <> '')::INT AS l, count(*) OVER (PARTITION BY book ORDER BY ord) AS c FROM d),
e AS (SELECT book, ord, doc, 'e' AS kind, 1 AS n, 'h1' AS tag, {_escaped('url')} AS source FROM k UNION ALL SELECT book, ord, doc, 'e', 2, 'p', t FROM k WHERE t <> '' UNION ALL SELECT book, ord, doc, 'e', 3, 'td', ord::VARCHAR FROM k
  UNION ALL SELECT book, ord, doc, 'l', l + 1, 'li', '<p>' || t || '</p>' FROM k WHERE t <> '' UNION ALL SELECT book, ord, doc, 'l', l + 1 + (t <> '')::INT, 'li', 'y' FROM k UNION ALL SELECT book, ord, doc, 'c', c, 'caption', '<b>c</b>' FROM k)
SELECT book, ord, 'd' || lpad(doc::VARCHAR, 2, '0') || kind || lpad(n::VARCHAR, 4, '0') AS id, tag, md5(source) AS source FROM e""")
def numbered_elements(spark, sf_dir):
    """Ids of headings, paragraphs and cells by document, of list items and captions through books of ten pages."""
    html = F.concat(F.lit("<h1>"), X.html_escape(F.col("url")), F.lit("</h1><ul><li><p>"), X.html_escape(M.visible_text(F.coalesce("html", F.lit("")))), F.lit("</p></li><li> <br/></li><li>y</li></ul><table><caption><b>c</b></caption><tr><td>"), F.col("page_id").cast("string"), F.lit("</td></tr></table>"))
    p = read(spark, sf_dir, "pages").select(F.expr(_BOOK).alias("book"), F.col("page_id").alias("ord"), html.alias("html"))
    return book.numbered_elements(p).select("book", "ord", "id", "tag", F.md5(F.col("source").cast("binary")).alias("source"))


@query("SELECT page_id, concat_ws(',', CASE WHEN page_id % 3 > 0 THEN 'figures: ' || (page_id % 3)::VARCHAR END, CASE WHEN page_id % 2 = 1 THEN 'tables: 1' END) AS warnings, (page_id % 4)::BIGINT AS equations FROM pages")
def caption_check(spark, sf_dir):
    """Pages with labelled figures and tables, and some without a label; formulas of each kind."""
    label = '<span class="object-label">1.</span> c'
    i = lambda n: (F.col("page_id") % n).cast("int")
    html = F.concat(F.lit(f"<figure><figcaption>{label}</figcaption></figure><table><caption>{label}</caption></table>"), F.repeat(F.lit("<figure><figcaption>x</figcaption></figure>"), i(3)), F.repeat(F.lit("<table><caption>object-label</caption></table>"), i(2)),
                    F.array_join(F.slice(F.array(F.lit("<math>x</math>"), F.lit('<span class="a math">y</span>'), F.lit("<div class='IMGE'><p class='maths'></p><p class='math'></p></div>")), F.lit(1), i(4)), ""))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(book.caption_warnings(html), ",").alias("warnings"), M.count_equations(html).alias("equations"))


@query(f"""WITH p AS ({_PAIRS_SQL}),
a AS (SELECT doc_id, doc_id % 50 AS batch, CASE WHEN doc_id % 450 = 7 THEN '  ' WHEN doc_id % 350 = 3 THEN left(source, (length(source) // 2)::INT) ELSE source END AS value, doc_id % 250 <> 11 AS answered, source FROM p),
v AS (SELECT *, answered AND trim(value) <> '' AND {_NUM_SQL.format(t='value')} = {_NUM_SQL.format(t='source')} AS ok FROM a)
SELECT doc_id, length(value)::BIGINT AS n FROM v WHERE batch IN (SELECT batch FROM v GROUP BY batch HAVING bool_and(ok))""")
def repair_batches(spark, sf_dir):
    """Repairs in fifty batches; one without an answer, blank or with other numbers keeps its batch as it was."""
    p = pairs(spark, sf_dir).withColumnRenamed("doc_id", "id").withColumn("batch", F.col("id") % 50)
    value = F.when(F.col("id") % 450 == 7, "  ").when(F.col("id") % 350 == 3, F.expr("left(source, cast(length(source) div 2 as int))")).otherwise(F.col("source"))
    answer = p.where("id % 250 <> 11").select("id", value.alias("value"))
    done = flow.accepted(p, answer, lambda v: X.numbers(v) == X.numbers(F.col("source")), "batch")
    return done.select(F.col("id").alias("doc_id"), F.length("value").cast("long").alias("n"))


@query(f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS source FROM documents),
m AS (SELECT source, max(CASE WHEN doc_id % 3 = 0 THEN source || ' 7' ELSE 'v ' || source END) AS translation FROM d WHERE lang IN ('en', 'fr') GROUP BY source),
j AS (SELECT d.doc_id, translation, {_NUM_SQL.format(t='d.source')} = {_NUM_SQL.format(t='translation')} AS ok FROM d LEFT JOIN m ON m.source = d.source)
SELECT doc_id, coalesce(ok, false) AS hit, CASE WHEN ok THEN length(translation) END::BIGINT AS n FROM j""")
def memo_valid(spark, sf_dir):
    """A remembered value with other numbers than its source is no hit."""
    key = flow.memory_key(F.col("source"), "gpt-5.6-luna", glossary={"loss": "perda"})
    d = docs(spark, sf_dir).select("doc_id", "lang", F.col("text").alias("source")).withColumn("memory_key", key)
    memory = d.where("lang in ('en', 'fr')").select("memory_key", F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(" 7"))).otherwise(F.concat(F.lit("v "), "source")).alias("translation"))
    hits, pending = flow.lookup(d, memory, lambda v: X.numbers(v) == X.numbers(F.col("source")))
    return hits.select("doc_id", F.lit(True).alias("hit"), F.length("translation").cast("long").alias("n")).union(pending.select("doc_id", F.lit(False), F.lit(None).cast("long")))


@query("""WITH j AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
ok AS (SELECT conv_id FROM j GROUP BY conv_id HAVING bool_and(trim(text) <> '') AND conv_id % 5 <> 1 AND conv_id % 7 <> 2)
SELECT conv_id, turn, length(text)::BIGINT AS n FROM j JOIN ok USING (conv_id)""")
def answer_contract(spark, sf_dir):
    """Conversations as JSON answers: some with their ids in another order, some with one too few, some fenced."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "id", "text")))
    made = c.groupBy("conv_id").agg(rows.alias("r"))
    r = F.when(F.col("conv_id") % 5 == 1, F.concat(F.array(F.struct(F.lit(0).cast("int").alias("turn"), F.lit("x").alias("id"), F.lit("x").alias("text")).cast(made.schema["r"].dataType.elementType)), "r"))
    r = r.when(F.col("conv_id") % 7 == 2, F.slice("r", F.lit(1), F.size("r") - 1)).otherwise(F.col("r"))
    j = F.to_json(F.map_from_arrays(F.transform(r, lambda x: x["id"]), F.transform(r, lambda x: x["text"])))
    answers = made.select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).otherwise(j).alias("json"))
    got = book.parsed_answers(answers, c.select("conv_id", F.col("turn").alias("ord"), "id", "turn"), batch="conv_id")
    return got.select("conv_id", F.substring("id", 2, 9).cast(c.schema["turn"].dataType).alias("turn"), F.length("value").cast("long").alias("n"))


@query(_TRIAGE_SQL + " SELECT doc_id, concat_ws(',', r1, r2, r3, r4) AS kinds FROM r WHERE concat_ws(',', r1, r2, r3, r4) <> '' AND doc_id % 3 <> 1")
def known_problems(spark, sf_dir):
    """Problems of known pairs, each pair once, its kinds in the order in which they were found."""
    t = flow.triage(pairs(spark, sf_dir)).withColumnRenamed("doc_id", "id")
    found = t.select("id", F.posexplode("reasons").alias("ord", "kind"))
    return book.known_problems(found, t.where("id % 3 <> 1")).select(F.col("id").alias("doc_id"), F.array_join("kinds", ",").alias("kinds"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS source FROM documents), n AS (SELECT doc_id, source, {_NUM_SQL.format(t='source')} AS s FROM d),
m AS (SELECT source, max(doc_id % 3) = 0 AND bool_and(s = {_NUM_SQL.format(t="'v ' || source")}) AS held FROM n GROUP BY source)
SELECT doc_id, CASE WHEN held THEN 'memory' WHEN doc_id % 4 < 3 THEN 'first' ELSE 'single' END AS origin, length(n.source)::BIGINT + CASE WHEN held THEN 2 ELSE 0 END AS n FROM n JOIN m ON m.source = n.source""")
def translate_origins(spark, sf_dir):
    """Documents from a memory, a first round or a last one: a composed pass over all of them."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("source")).withColumn("memory_key", flow.memory_key(F.col("source"), "gpt-5.6-luna"))
    memory = d.groupBy("memory_key", "source").agg((F.max(F.col("id") % 3) == 0).alias("ok")).where("ok").select("memory_key", F.concat(F.lit("v "), "source").alias("translation"))
    answer = lambda p, name: p.select("id", F.when((F.col("id") % 4 < 3) | (F.lit(name) == "single"), F.col("source")).alias("target"))
    made = run.translated(d, answer, lambda v: X.numbers(v) == X.numbers(F.col("source")), memory=memory)
    return made.select(F.col("id").alias("doc_id"), "origin", F.length("target").cast("long").alias("n"))
