"""One HTML edition of a book's documents: numbered objects, citations as notes, contents, and its parts in order."""

from __future__ import annotations

import html as H
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as X

#: Kinds of numbered objects (element, caption, id prefix, label) and the notes' heading.
KINDS = (("figure", "figcaption", "figura", "Figura"), ("table", "caption", "tabela", "Tabela"))
NOTES = "Citações"


def _text(html: str) -> str:
    return " ".join(H.unescape(re.sub(r"<[^>]*>", " ", html)).split())


def _with(tag: str, **attrs: str) -> str:
    """An opening tag with attributes set."""
    for name, value in attrs.items():
        tag = re.sub(rf"""\s+{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", tag)
        tag = re.sub(r"^<[^\s/>]+", lambda m: f'{m[0]} {name}="{H.escape(value)}"', tag)
    return tag


def _apply(html: str, edits: list[tuple[int, int, str]]) -> str:
    """Replace places (from, to) that do not overlap; insertions at one place keep their order."""
    out, last = [], 0
    for at, end, new in sorted(edits, key=lambda e: e[:2]):
        out += [html[last:at], new]
        last = end
    return "".join([*out, html[last:]])


def number_objects(html: str, before: tuple[int, int] = (0, 0)) -> tuple[str, tuple[int, int]]:
    """Figures and tables with running ids and caption labels, images with the caption as alt; and how many of each.

    A caption or image belongs to the nearest figure or table around it; where there is no caption, one is made.
    """
    found, edits, counts = M.nodes(html), [], []
    for (element, caption, prefix, label), n in zip(KINDS, before):
        near, owned = [], {}
        for k, x in enumerate(found):  # parents come first
            near.append(near[x.parent] if x.parent >= 0 else -1)
            if x.name == element:
                near[k] = k
                owned[k] = {}
            elif near[k] >= 0:
                owned[near[k]].setdefault(x.name, x)
        for i, (k, inside) in enumerate(owned.items(), n + 1):
            x, own = found[k], inside.get(caption)
            mark = f'<span class="object-label">{label} {i}.</span> '
            edits.append((x.at, x.inner, _with(html[x.at : x.inner], id=f"{prefix}-{i}")))
            if own:
                edits.append((own.inner, own.inner, mark))
            else:
                at = x.close if element == "figure" else x.inner
                edits.append((at, at, f"<{caption}>{mark}</{caption}>"))
            if element == "figure" and "img" in inside:
                img = inside["img"]
                alt = " ".join(f"{label} {i}. {_text(html[own.inner : own.close]) if own else ''}".split())
                edits.append((img.at, img.inner, _with(html[img.at : img.inner], alt=alt)))
        counts.append(len(owned))
    return _apply(html, edits), tuple(counts)


def cite_as_notes(html: str, doc: int) -> tuple[str, int]:
    """Citations that carry a side note become numbered links to notes with links back; and how many.

    The notes stand before the references and their heading, else at the end of the article, else of the text.
    A citation inside another's note goes with it.
    """
    found, edits, notes, past = M.nodes(html), [], [], 0
    for x in found:
        if x.name != "span" or not x.has_class("citation") or x.at < past:
            continue
        side = next((y for y in found if x.inner <= y.at < x.close and y.has_class("sidenote")), None)
        if side is None:
            continue
        n = len(notes) + 1
        # fixed values: ids, classes and labels of a note and its call
        here, there = f"chamada-nota-{doc}-{n}", f"nota-{doc}-{n}"
        edits.append((x.at, x.end, f'<sup class="note-ref" id="{here}"><a href="#{there}" aria-label="Nota {n}">{n}</a></sup>'))
        notes.append(f'<li id="{there}">{html[side.inner : side.close]} <a href="#{here}" class="note-backlink" aria-label="Voltar à chamada da nota {n}">↩</a></li>')
        past = x.end
    if notes:
        section = f'<section class="citation-notes"><h2>{NOTES}</h2><ol>{"".join(notes)}</ol></section>'
        at = next((x.close for x in found if x.name == "article"), len(html))
        references = next((k for k, x in enumerate(found) if x.has_class("references")), None)
        if references is not None:
            own = found[references]
            at, heads = own.at, [x for x in found[:references] if x.parent == own.parent and x.name in ("h1", "h2", "h3")]
            if heads and _text(html[heads[-1].inner : heads[-1].close]).lower().startswith("refer"):
                at = heads[-1].at
        if not any(a < at < b for a, b, _ in edits):
            edits.append((at, at, section))
        else:  # references inside a citation that is replaced
            edits.append((len(html), len(html), section))
    return _apply(html, edits), len(notes)


def titled(html: str, number: int) -> tuple[str, str | None]:
    """The title (h1 of class title, else the first h1) gets an anchor; and its text, null where there is none."""
    heads = [x for x in M.nodes(html) if x.name == "h1"]
    x = next((x for x in heads if x.has_class("title")), heads[0] if heads else None)
    if x is None:
        return html, None
    return _apply(html, [(x.at, x.inner, _with(html[x.at : x.inner], id=f"toc-{number}"))]), _text(html[x.inner : x.close])


def sections(docs: DataFrame) -> DataFrame:
    """(book, ord, html) -> book, ord, doc (from 1), html, notes, figures, tables, title, anchor: edited for one edition.

    Objects and titles are numbered through a book by a running sum over its documents, citations within each.
    A null html is empty; other columns are dropped; no rows give no rows.
    """
    d = docs.select("book", "ord", F.coalesce("html", F.lit("")).alias("html"))

    @F.pandas_udf("figures int, tables int, titles int")
    def count(h: pd.Series) -> pd.DataFrame:
        names = h.map(lambda x: [n.name for n in M.nodes(x)])
        return pd.DataFrame({"figures": names.map(lambda n: n.count("figure")), "tables": names.map(lambda n: n.count("table")), "titles": names.map(lambda n: int("h1" in n))})

    @F.pandas_udf("html string, notes int, title string")
    def edit(h: pd.Series, doc: pd.Series, figures: pd.Series, tables: pd.Series, titles: pd.Series) -> pd.DataFrame:
        rows = []
        for x, k, f, t, i in zip(h, doc, figures, tables, titles):
            x, _ = number_objects(x, (f, t))
            x, n = cite_as_notes(x, k)
            x, title = titled(x, i + 1)
            rows.append((x, n, title))
        return pd.DataFrame(rows, columns=["html", "notes", "title"])

    w = W.partitionBy("book").orderBy("ord")
    so_far = lambda c: F.coalesce(F.sum(f"c.{c}").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}")
    d = d.withColumn("c", count("html")).select("*", F.row_number().over(w).alias("doc"), so_far("figures"), so_far("tables"), so_far("titles"))
    d = d.withColumn("e", edit("html", "doc", "_figures", "_tables", "_titles"))
    anchor = F.when(F.col("e.title").isNotNull(), F.concat(F.lit("toc-"), (F.col("_titles") + 1).cast("string")))
    return d.select("book", "ord", "doc", "e.html", "e.notes", "c.figures", "c.tables", "e.title", anchor.alias("anchor"))


#: The page around an edition, with the labels of its contents.
HEAD = '<!doctype html>\n<html lang="pt-BR"><head><meta charset="utf-8"><title>{}</title></head><body>\n<section class="cover"><h1>{}</h1></section>\n<section class="front"><h1>Conteúdo desta edição</h1><ol>'


def parts(sections: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows (book, part, ord, html) that make the edition when joined in order: head, contents, documents, foot.

    titles: book, name. A book is never one row, so its size has no bound.
    """
    name = X.html_escape(F.coalesce("name", F.lit("")))
    cover = F.replace(F.lit(HEAD), F.lit("{}"), name)
    edge = titles.join(sections.select("book").distinct(), "book", "left_semi")
    at = F.lit(None).cast(sections.schema["ord"].dataType).alias("ord")
    entry = F.concat(F.lit('<li><a href="#'), "anchor", F.lit('">'), X.html_escape(F.col("title")), F.lit("</a></li>"))
    rows = edge.select("book", F.lit(0).alias("part"), at, cover.alias("html"))
    rows = rows.union(sections.where("title is not null").select("book", F.lit(1), "ord", entry))
    rows = rows.union(edge.select("book", F.lit(2), at, F.lit("</ol></section>")))
    rows = rows.union(sections.select("book", F.lit(3), "ord", F.concat(F.lit('<div class="book-part">'), "html", F.lit("</div>"))))
    return rows.union(edge.select("book", F.lit(4), at, F.lit("</body></html>")))


def write(parts: DataFrame, folder: str) -> None:
    """A text file of each book under folder/book=...: its parts in order, streamed."""
    rows = parts.repartition("book").sortWithinPartitions("book", "part", "ord")
    rows.select("book", F.col("html").alias("value")).write.partitionBy("book").mode("overwrite").text(folder)
