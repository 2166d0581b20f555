"""EPUB packages: members as rows, contents, and a writer that leaves untouched members byte-identical."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as X

ENTRY = "book_id string, name string, media_type string, spine_pos int, bytes binary"


def _local(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def package(data: bytes) -> tuple[str, dict[str, dict], list[str], str]:
    """(OPF path, manifest by id, spine idrefs, title)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        box = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in box.iter() if _local(e) == "rootfile")
        root = ET.fromstring(z.read(opf))
    manifest = {e.attrib["id"]: dict(e.attrib) for e in root.iter() if _local(e) == "item"}
    spine = [e.attrib["idref"] for e in root.iter() if _local(e) == "itemref"]
    title = ": ".join((e.text or "").strip() for e in root.iter() if _local(e) == "title")
    return opf, manifest, spine, title


def resolve(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.split("#")[0])))


def contents(data: bytes) -> list[tuple[int, str, str, int]]:
    """(ord, doc, label, depth): the NCX map in pre-order, else the nav document's anchors by depth of list."""
    opf, manifest, _, _ = package(data)
    out: list[tuple[int, str, str, int]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for item in manifest.values():
            if item.get("media-type") == "application/x-dtbncx+xml":
                at = resolve(opf, item["href"])

                def walk(e, depth):
                    for p in e:
                        if _local(p) == "navPoint":
                            label = "".join(next(x for x in p if _local(x) == "navLabel").itertext()).strip()
                            src = next(x for x in p if _local(x) == "content").attrib["src"]
                            out.append((len(out), resolve(at, src), label, depth))
                            walk(p, depth + 1)

                walk(next(e for e in ET.fromstring(z.read(at)).iter() if _local(e) == "navMap"), 1)
        if not out:
            for item in manifest.values():
                if "nav" in (item.get("properties") or "").split():
                    at = resolve(opf, item["href"])

                    def dive(e, depth):
                        for x in e:
                            if _local(x) == "a" and "href" in x.attrib:
                                out.append((len(out), resolve(at, x.attrib["href"]), " ".join("".join(x.itertext()).split()), depth))
                            dive(x, depth + (_local(x) == "ol"))

                    dive(ET.fromstring(z.read(at)), 0)
    return out


def members(books: DataFrame) -> DataFrame:
    """books (path, content; as spark.read.format('binaryFile')) -> one row per member."""

    def run(parts):
        for part in parts:
            for path, data in zip(part["path"], part["content"]):
                opf, manifest, spine, _ = package(data)
                kinds = {resolve(opf, m["href"]): m for m in manifest.values()}
                place = {resolve(opf, manifest[i]["href"]): k for k, i in enumerate(spine) if i in manifest}
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows = [(path, n, kinds.get(n, {}).get("media-type"), place.get(n), z.read(n)) for n in z.namelist()]
                yield pd.DataFrame(rows, columns=["book_id", "name", "media_type", "spine_pos", "bytes"]).astype({"spine_pos": "Int32"})

    return books.select("path", "content").mapInPandas(run, ENTRY)


def rewrite(data: bytes, changed: dict[str, bytes]) -> bytes:
    """The package with some members replaced; mimetype stays first and stored, changed documents must be XML."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as to:
        names = sorted(z.namelist(), key=lambda n: n != "mimetype")
        for n in names:
            body = changed.get(n, z.read(n))
            if n in changed:
                ET.fromstring(body)
            to.writestr(zipfile.ZipInfo(n), body, zipfile.ZIP_STORED if n == "mimetype" else zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(out) as z:
        if z.testzip() or z.read("mimetype") != b"application/epub+zip":
            raise ValueError("damaged package")
    return out.getvalue()


def sample(title: str, bodies: list[str]) -> bytes:
    """A small EPUB 2 package of one document per body."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        n = range(1, len(bodies) + 1)
        z.writestr("OPS/book.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{title}</dc:title></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' + "".join(f'<item id="c{i}" href="c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in n) + "</manifest><spine>" + "".join(f'<itemref idref="c{i}"/>' for i in n) + "</spine></package>")
        z.writestr("OPS/toc.ncx", "<ncx><navMap>" + "".join(f'<navPoint><navLabel><text>Chapter {i}</text></navLabel><content src="c{i}.xhtml#top"/></navPoint>' for i in n) + "</navMap></ncx>")
        for i, b in zip(n, bodies):
            z.writestr(f"OPS/c{i}.xhtml", f"<html><body>{b}</body></html>")
    return out.getvalue()


DOCUMENTS = ("application/xhtml+xml", "text/html")
#: Fixed value: names of members that hold printed page marks.
PAGED = r"(?i)\.(xhtml|html|htm)$"


def contents_of(books: DataFrame) -> DataFrame:
    """books (path, content) -> (book_id, ord, doc, label, depth) of each contents entry."""

    def run(parts):
        for part in parts:
            rows = [(path, *entry) for path, data in zip(part["path"], part["content"]) for entry in contents(data)]
            yield pd.DataFrame(rows, columns=["book_id", "ord", "doc", "label", "depth"])

    return books.select("path", "content").mapInPandas(run, "book_id string, ord long, doc string, label string, depth long")


def documents(entries: DataFrame) -> DataFrame:
    """Members in the spine that are XHTML or HTML: (book_id, name, spine_pos, html)."""
    d = entries.where(F.col("spine_pos").isNotNull() & F.col("media_type").isin(*DOCUMENTS))
    return d.select("book_id", "name", "spine_pos", F.decode("bytes", "UTF-8").alias("html"))


def page_counts(entries: DataFrame, strict: bool = False) -> DataFrame:
    """(book_id, pages): the largest printed page number of a book; null, or where strict an error, if it marks none."""
    d = entries.where(F.col("name").rlike(PAGED)).select("book_id", M.last_page(F.decode("bytes", "UTF-8")).alias("n"))
    d = d.groupBy("book_id").agg(F.max("n").alias("pages"))
    none = F.raise_error(F.concat(F.lit("no printed page is marked: "), "book_id")).cast("long")
    return d.withColumn("pages", F.coalesce("pages", none)) if strict else d


def harvest(entries: DataFrame, strict: bool = True) -> DataFrame:
    """(book_id, path, asset, bytes) of the images that spine documents show, each once a book.

    path is the member's, resolved against its document; asset its name outside. An image that no member holds
    is an error, or, where not strict, a row without bytes. Sources without a value and of other hosts are none.
    """
    src = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)<img\b[^>]*\ssrc\s*=\s*["']([^"']+)["']"""), F.lit(1)))
    shown = documents(entries).select("book_id", "name", src.alias("src")).where(~F.col("src").rlike("(?i)^([a-z][a-z0-9+.-]*:|//)"))
    shown = shown.select("book_id", M.resolve(F.col("name"), F.col("src")).alias("path")).distinct()
    d = shown.join(entries.select("book_id", F.col("name").alias("path"), "bytes"), ["book_id", "path"], "left")
    none = F.raise_error(F.concat(F.lit("no member holds the image "), "path")).cast("binary")
    return d.select("book_id", "path", M.asset_name(F.col("path")).alias("asset"), (F.coalesce("bytes", none) if strict else F.col("bytes")).alias("bytes"))


SCAN = "book_id string, title string, creator string, labels array<string>, css string, documents array<string>, paged array<string>"


def scan(books: DataFrame) -> DataFrame:
    """One row per book (path, content), its package parsed once: title, creator, contents labels, styles, texts.

    documents: the spine's documents in order; paged: all members that may hold printed page marks; css: all
    styles, a line end between. A row is as large as its book, as content is.
    """

    def run(parts):
        for part in parts:
            rows = []
            for path, data in zip(part["path"], part["content"]):
                opf, manifest, spine, title = package(data)
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    names, text = z.namelist(), lambda n: z.read(n).decode("utf-8", "replace")  # noqa: B023
                    makers = [e for e in ET.fromstring(z.read(opf)).iter() if _local(e) == "creator"]
                    creator = "".join(makers[0].itertext()).strip().rstrip(";") if makers else ""
                    css = "\n".join(text(resolve(opf, m["href"])) for m in manifest.values() if m.get("media-type") == "text/css" and resolve(opf, m["href"]) in names)
                    inside = [resolve(opf, manifest[i]["href"]) for i in spine if i in manifest and manifest[i].get("media-type") in DOCUMENTS]
                    rows.append((path, title, creator, [x[2] for x in contents(data)], css, [text(n) for n in inside if n in names], [text(n) for n in names if re.search(PAGED, n)]))
            yield pd.DataFrame(rows, columns=["book_id", "title", "creator", "labels", "css", "documents", "paged"])

    return books.select("path", "content").mapInPandas(run, SCAN)


def inventory(books: DataFrame) -> DataFrame:
    """(book_id, title, documents, characters, pages, chapters, ..) of books (path, content), without a shuffle.

    Characters are those of the visible text in spine documents; chapters are contents entries labelled so; then
    creator, and how many images, figures, equations and tables the documents hold.
    """
    total = lambda c, count: F.coalesce(F.aggregate(F.transform(c, count), F.lit(0).cast("long"), lambda n, x: n + F.coalesce(x, F.lit(0)).cast("long")), F.lit(0).cast("long"))
    tags = lambda *names: total("documents", lambda h: M.count_tag(h, *names))
    return scan(books).select(
        "book_id", "title", F.size("documents").cast("long").alias("documents"), total("documents", lambda h: F.length(M.visible_text(h))).alias("characters"),
        F.array_max(F.transform("paged", M.last_page)).alias("pages"), F.size(F.filter("labels", lambda x: X.found(x, X.CHAPTER))).cast("long").alias("chapters"),
        "creator", tags("img").alias("images"), tags("figure").alias("figures"), total("documents", M.count_equations).alias("equations"), tags("table").alias("tables"),
    )


def _without_language(tags: list[tuple[str, dict]]) -> list[tuple[str, dict]]:
    return [(name, {k: v for k, v in attrs.items() if k not in ("lang", "xml:lang")}) for name, attrs in tags]


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Members (of members()) of two editions, by book and name: same, and for documents what else is equal.

    structure: equal elements and attributes but for the language; links: equal targets in order; cells: equal
    numbers in table cells; ids: equal ids in order; math: equal formulas. A member of one side alone is not the same; null where nothing is compared.
    """

    @F.pandas_udf("structure boolean, links boolean, cells boolean, ids boolean, math boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x, y = (bytes(v or b"").decode("utf-8", "replace") for v in (x, y))
            s, t = (_without_language(M.structure(v)) for v in (x, y))
            links = [[at.get("href") for _, at in v if "href" in at] for v in (s, t)]
            ids = [[at["id"] for _, at in v if "id" in at] for v in (s, t)]
            trees = [M.nodes(v) for v in (x, y)]
            cells = [[re.findall(r"[0-9]+(?:[.,][0-9]+)*%?", v[n.inner : n.close]) for n in nodes if n.name in ("td", "th")] for v, nodes in zip((x, y), trees)]
            math = [[v[n.at : n.end] for n in nodes if n.name == "math" or n.has_class("math")] for v, nodes in zip((x, y), trees)]
            rows.append((s == t, links[0] == links[1], cells[0] == cells[1], ids[0] == ids[1], math[0] == math[1]))
        return pd.DataFrame(rows, columns=["structure", "links", "cells", "ids", "math"])

    side = lambda d, n: d.select("book_id", "name", F.col("bytes").alias(n), F.col("media_type").isin(*DOCUMENTS).alias(f"{n}_doc"))
    d = side(before, "a").join(side(after, "b"), ["book_id", "name"], "full_outer")
    d = d.withColumn("same", F.col("a").eqNullSafe(F.col("b")))
    d = d.withColumn("c", F.when(F.col("a_doc") & F.col("b_doc"), check("a", "b")))
    return d.select("book_id", "name", "same", "c.structure", "c.links", "c.cells", "c.ids", "c.math")


def broken_links(entries: DataFrame) -> DataFrame:
    """(book_id, name, anchor): links within a document whose target no element of it has as id."""
    d = documents(entries)
    pick = lambda r: d.select("book_id", "name", F.explode(F.regexp_extract_all("html", F.lit(r), F.lit(1))).alias("anchor"))
    return pick("""\\bhref=["']#([^"']*)["']""").join(pick("""\\bid=["']([^"']*)["']"""), ["book_id", "name", "anchor"], "left_anti").distinct()


def excerpt(data: bytes, docs: list[str]) -> list[str]:
    """Members that documents need, themselves included: images, styles, and what styles name, sorted."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        held, open_, out = set(z.namelist()), list(docs), set()
        while open_:
            name = open_.pop()
            if name in out or name not in held:
                continue
            out.add(name)
            body = z.read(name).decode("utf-8", "replace") if re.search(r"(?i)\.(xhtml|html?|css|svg)$", name) else ""
            found = re.findall(r"""url\(\s*["']?([^"')]+)""", body) + re.findall(r"""\bsrc\s*=\s*["']([^"']+)""", body) + re.findall(r"""<link\b[^>]*?\bhref\s*=\s*["']([^"']+)""", body)
            open_ += [resolve(name, x) for x in found if not re.match(r"[a-z][a-z0-9+.-]*:", x, re.I)]
    return sorted(out)


def lock(folder_files: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files (path, content) against a manifest (path, sha256): path and state (same, changed, missing, extra).

    Where several files share a path, or have none, key is a column of both sides that tells them apart.
    """
    have = folder_files.select(F.col(key).alias("k"), F.col("path").alias("p"), F.sha2("content", 256).alias("h"))
    d = have.join(manifest.select(F.col(key).alias("k"), F.col("path").alias("q"), "sha256"), "k", "full_outer").withColumn("path", F.coalesce("p", "q"))
    state = F.when(F.col("h").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("h") == F.col("sha256"), "same").otherwise("changed")
    return d.select("path", state.alias("state"))


#: Attributes that the transform adds for itself, and that no written document keeps.
HELPERS = r"""\sdata-(?:item|src|href)=("[^"]*"|'[^']*')"""


def _originals(tag: str) -> str:
    """A tag with its source and target as they were before the transform, which kept them in helper attributes."""
    for name in ("src", "href"):
        kept = re.search(rf"""\sdata-{name}=("[^"]*"|'[^']*')""", tag)
        if kept:
            tag = re.sub(rf"""(\s){name}=("[^"]*"|'[^']*')""", lambda m: f"{m[1]}{name}={kept[1]}", tag)  # noqa: B023
    return re.sub(HELPERS, "", tag)


def translate(data: bytes, values: dict[str, dict[int, str]], lang: str = "pt-BR") -> bytes:
    """The package with the inner markup of some elements replaced: values by member, then by element index.

    Only those places, the helper attributes, what they kept of links and images, and the language of the root
    change; other members stay equal.
    """
    changed = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name, new in values.items():
            html = z.read(name).decode("utf-8")
            out, last, index = [], 0, -1
            for n in M.nodes(html):
                index += n.name in M.BLOCKS
                if n.name in M.BLOCKS and index in new and n.at >= last:
                    out += [html[last : n.inner], new[index]]
                    last = n.close
            body = re.sub(r"<[a-zA-Z][^<>]*>", lambda m: _originals(m[0]), "".join([*out, html[last:]]))
            root = re.search(r"<html\b[^>]*>", body)
            if root:
                tag = re.sub(r"""\s(?:xml:)?lang=("[^"]*"|'[^']*')""", "", root[0])
                body = body[: root.start()] + tag[:-1] + f' lang="{lang}" xml:lang="{lang}">' + body[root.end() :]
            changed[name] = body.encode("utf-8")
    return rewrite(data, changed)


def fingerprint(path: str) -> str:
    """SHA-256 of a file, read in blocks."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
