"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions alone."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A paragraph is a line; a line of more than 160 code points is cut at the sentence ends that follow them.
PARAGRAPH = r"[^\n]{1,160}[^\n.!?]{0,160}[.!?]?"
#: Cells of a sketch: at first, and of each larger one after a failure.
SIZES = (12, 48, 192, 768)
#: Cells of a part's last retries, each with digests hashed anew, so that a failure before it says nothing.
ANEW = (768, 3072)
#: Digests that a part of a retried sketch should hold per side, and the deepest partition (4 to this power).
PER_PART, DEEPEST = 2, 10

_name = (f"v{i}" for i in count())


def paragraphs(text: str) -> str:
    """SQL: the distinct 64-bit digests of a text's paragraphs."""
    return f"array_sort(array_distinct(transform(regexp_extract_all(coalesce({text}, ''), r'{PARAGRAPH}', 0), x -> xxhash64(x))))"


def _let(value: str, body) -> str:
    v = next(_name)
    return f"transform(array({value}), {v} -> {body(v)})[0]"


def _in_cell(x: str, i: str, m: int) -> str:
    """Whether digest x counts in cell i of m: one cell in each third of them."""
    return f"pmod(shiftrightunsigned({x}, cast(20 + 14 * ({i} div {m // 3}) as int)), {m // 3}) = {i} % {m // 3}"


def sketch(keys: str, m: int) -> str:
    """SQL: m cells (n: how many digests, k: their xor, h: the xor of their checks)."""
    i, x, a, y = (next(_name) for _ in range(4))
    body = lambda v: f"struct(size({v}) as n, aggregate({v}, 0L, ({a}, {y}) -> {a} ^ {y}) as k, aggregate({v}, 0L, ({a}, {y}) -> {a} ^ xxhash64({y})) as h)"
    return f"transform(sequence(0, {m - 1}), {i} -> {_let(f'filter({keys}, {x} -> {_in_cell(x, i, m)})', body)})"


def subtract(a: str, b: str) -> str:
    i, x = next(_name), next(_name)
    return f"transform({a}, ({x}, {i}) -> struct({x}.n - {b}[{i}].n as n, {x}.k ^ {b}[{i}].k as k, {x}.h ^ {b}[{i}].h as h))"


def peel(cells: str, m: int) -> str:
    """SQL: struct(left: cells after peeling, found: the digests that differ, s: 1 or -1 by side)."""
    s, r, c, i, p, q, t, e = (next(_name) for _ in range(8))
    pure = f"array_distinct(transform(filter({s}.cells, {c} -> abs({c}.n) = 1 and {c}.h = xxhash64({c}.k)), {c} -> struct({c}.k as k, {c}.n as s)))"

    def take(v: str) -> str:
        out = lambda w: f"struct({c}.n - cast(aggregate({w}, 0, ({t}, {e}) -> {t} + {e}.s) as int) as n, aggregate({w}, {c}.k, ({t}, {e}) -> {t} ^ {e}.k) as k, aggregate({w}, {c}.h, ({t}, {e}) -> {t} ^ xxhash64({e}.k)) as h)"
        new = f"transform({s}.cells, ({c}, {i}) -> {_let(f'filter({v}, {p} -> {_in_cell(f'{p}.k', i, m)})', out)})"
        return f"if(size({v}) = 0, named_struct('cells', {s}.cells, 'found', {s}.found, 'go', false), named_struct('cells', {new}, 'found', concat({s}.found, {v}), 'go', true))"

    start = f"named_struct('cells', {cells}, 'found', cast(array() as array<struct<k: bigint, s: int>>), 'go', true)"
    return f"aggregate(sequence(1, {m}), {start}, ({s}, {r}) -> if(not {s}.go, {s}, {_let(pure, take)}))"


def _clean(state: str) -> str:
    c = next(_name)
    return f"forall({state}.cells, {c} -> {c}.n = 0 and {c}.k = 0 and {c}.h = 0)"


def differing(a: str, b: str, m: int) -> str:
    """SQL: how many digests are in one of two small sets alone: sketch, subtract, peel; -1 if cells stay."""
    diff = _let(sketch(b, m), lambda v: subtract(sketch(a, m), v))
    return _let(f"{peel(diff, m)}", lambda st: f"if({_clean(st)}, size({st}.found), -1)")


def _parts(keys: str, depth: str) -> str:
    """SQL: the digests parted by their low bits into 4 to the depth sets, in linear passes."""
    s, k, p, j, x = (next(_name) for _ in range(5))
    step = f"flatten(transform({s}, {p} -> transform(sequence(0, 3), {j} -> filter({p}, {x} -> (shiftright({x}, 2 * {k} - 2) & 3) = {j}))))"
    return f"if({depth} = 0, array({keys}), aggregate(sequence(1, {depth}), array({keys}), ({s}, {k}) -> {step}))"


def with_likeness(df: DataFrame, name: str, a: str, b: str, cells_a: str, cells_b: str) -> DataFrame:
    """df plus name: shared share of the union of two digest sets (columns), from their sketches; 1 for two empty sets.

    First the fingerprints themselves are subtracted and peeled. If cells stay, larger sketches are built:
    one per part of the digests, as many parts as the larger set needs, and a part that fails grows alone.
    The last two retries hash the digests anew; both fail for a part about once in 1e15 times, which is an error.
    Each retry is a column of its own, so that the plan evaluates it once.
    """
    m = SIZES[0]
    df = df.withColumn("_gap", F.expr(_let(peel(subtract(cells_a, cells_b), m), lambda st: f"if({_clean(st)}, size({st}.found), -1)")))
    df = df.withColumn("_depth", F.expr(f"cast(least({DEEPEST}, ceil(greatest(0D, ln(greatest(size({a}), size({b}), 1) / {PER_PART}D) / ln(4D)))) as int)"))
    df = df.withColumn("_pairs", F.expr(f"if(_gap >= 0, null, arrays_zip({_parts(a, '_depth')}, {_parts(b, '_depth')}))"))
    df = df.withColumn("_pairs", F.expr("transform(_pairs, p -> struct(p['0'] as a, p['1'] as b))"))
    df = df.withColumn("_gaps", F.expr(f"transform(_pairs, p -> {differing('p.a', 'p.b', SIZES[0])})"))
    for m in SIZES[1:]:
        df = df.withColumn("_gaps", F.expr(f"if(exists(_gaps, g -> g < 0), transform(_gaps, (g, i) -> if(g >= 0, g, {_let('_pairs[i]', lambda p: differing(f'{p}.a', f'{p}.b', m))})), _gaps)"))
    for salt, m in enumerate(ANEW, 1):
        again = _let(f"struct(transform(_pairs[i].a, x -> xxhash64(x, {salt})) as a, transform(_pairs[i].b, x -> xxhash64(x, {salt})) as b)", lambda p: differing(f"{p}.a", f"{p}.b", m))
        df = df.withColumn("_gaps", F.expr(f"if(exists(_gaps, g -> g < 0), transform(_gaps, (g, i) -> if(g >= 0, g, {again})), _gaps)"))
    df = df.withColumn("_gaps", F.expr("if(exists(_gaps, g -> g < 0), raise_error('sketches of all sizes kept cells'), _gaps)"))
    df = df.withColumn("_gap", F.expr("if(_gap >= 0, _gap, aggregate(_gaps, 0, (t, g) -> t + g))"))
    both = f"(size({a}) + size({b}))"
    return df.withColumn(name, F.expr(f"if({both} = 0, 1D, cast({both} - _gap as double) / ({both} + _gap))")).drop("_gap", "_depth", "_pairs", "_gaps")


def encode(keys: str, cells: str) -> str:
    c = next(_name)
    return f"concat('ibl{SIZES[0]}:', size({keys}), ':', array_join(transform({cells}, {c} -> concat(hex({c}.n), '.', hex({c}.k), '.', hex({c}.h))), ','))"


def with_next(docs: DataFrame, rows_per_bucket: int = 250, most_buckets: int = 1 << 20, few: int = 65_536) -> DataFrame:
    """docs (doc_id, text) plus next_text: the text after it by descending doc_id, around the end; one text shuffle.

    Ids are cut into ranges at quantiles, which are halved evenly until a range has few rows; a range's first
    row is also given to the range before it. Null ids come last; ties are ordered by text, nulls first.
    Of `few` ranges or less (about 1 MB) the first ids are broadcast; at most most_buckets are made.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, cuts = d.select(F.count("*"), F.percentile_approx("doc_id", [i / 64 for i in range(65)], 2000)).first()
    cuts = sorted(set(cuts or []))
    each = min(most_buckets, -(-n // rows_per_bucket)) // max(1, len(cuts)) + 1
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    q = F.size(F.filter(edges, lambda c: c <= F.col("doc_id")))
    low, high = F.try_element_at(edges, F.greatest(q, F.lit(1))), F.try_element_at(edges, q + 1)
    inside = F.floor((F.col("doc_id") - low).cast("double") / (high - low).cast("double") * each)
    d = d.withColumn("bucket", F.coalesce(q.cast("long") * each + F.coalesce(F.greatest(F.lit(0), F.least(inside, F.lit(each - 1))), F.lit(0)), F.lit(-1)).cast("long"))
    order = W.orderBy(F.col("bucket").desc())
    heads = d.groupBy("bucket").agg(F.max("doc_id").alias("head")).withColumn("prev", F.lag("bucket").over(order)).withColumn("last", F.min("bucket").over(W.partitionBy()))
    heads = heads.select(F.col("bucket").alias("own"), "head", F.coalesce("prev", "last").alias("goes"))
    guests = d.join(F.broadcast(heads) if each * (len(cuts) + 1) <= few else heads, (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("goes").alias("bucket"), F.lit(True).alias("guest"))
    rows = d.withColumn("guest", F.lit(False)).union(guests)
    w = W.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return rows.withColumn("next_text", F.lead(F.coalesce("text", F.lit(""))).over(w)).where("not guest").select("doc_id", "text", "next_text")


def compare_versions(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Likeness is the shared share of the union of two texts' paragraph digests, from their fingerprints; equal
    texts have equal fingerprints and likeness 1. A null text counts as empty; a single row is its own next;
    every row gives a row, repeated rows too; other columns are ignored; an empty table gives no rows.
    """
    d = with_next(docs).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(next_text, 1, cast(n_chars div 2 as int)))"))
    d = d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.expr(paragraphs("text")).alias("a"), F.expr(paragraphs("edited")).alias("e"), F.expr(paragraphs("next_text")).alias("x"))
    for c in "aex":
        d = d.withColumn(f"c{c}", F.expr(sketch(c, SIZES[0])))
    d = with_likeness(d, "near_edited", "a", "e", "ca", "ce")
    d = with_likeness(d, "near_next", "a", "x", "ca", "cx")
    return d.select("doc_id", "n_chars", "edited_sha256", F.expr(encode("a", "ca")).alias("fingerprint"), F.expr(encode("e", "ce")).alias("edited_fingerprint"), "near_edited", "near_next")
