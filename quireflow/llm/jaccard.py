"""Exact Jaccard join of word shingle sets by a token-group matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, record_batch, small_batches, stage_table
from .components import connected_components

WORDS = 5
#: Links: PER * intersection >= SHARE * union.
SHARE, PER = 80, 100
#: Cells of the table of common shingles (fixed size: 16 MB); a quarter of them at most is filled.
CELL_BITS = 24
#: Sets of one group, whose shingles are one column of the matrix; groups of a component until they grow, up to
#: so many listed shingles (16 MB held).
GROUP, GROUPS, POSTS = 64, 16, 1_000_000
#: So many ids (8 MB) are broadcast; above, rows are shuffled by id.
FEW_IDS = 1_000_000
#: Times that the groups are formed, each time around other members.
ROUNDS = 2


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words (ASCII lower case); of fewer words, of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(known) > 1_000_000:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s *= np.uint64(0x9E3779B97F4A7C15)
        s += h[k : len(h) - n + 1 + k]
    s = mix64(s)
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]]


def prefix_length(n: int) -> int:
    """Two linked sets share one of the first so many shingles of each, in any order common to all sets."""
    return n - -(-SHARE * n // PER) + 1


def _profile(docs: DataFrame) -> DataFrame:
    """Per document its set's size and 128-bit digest (doc_id, n, k1, k2); and shingles that repeat within a task (token, c)."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("token", pa.int64()), ("c", pa.int64())])

    def repeats(held):
        token, c = np.unique(np.concatenate(held), return_counts=True)
        token, c = token[c > 1].view(np.int64), c[c > 1]
        for at in range(0, len(token), 100_000):
            t = token[at : at + 100_000]
            none = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(t), pa.array(c[at : at + 100_000].astype(np.int64))], schema=out)

    def run(batches):
        known, held, total = _Words(), [], 0
        for b in batches:
            ids, ns, ks = b.column(0).to_pylist(), [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, known)
                ns.append(len(s))
                ks.append(xxhash.xxh3_128_digest(s.tobytes()))
                held.append(s)
                total += len(s)
            k = np.frombuffer(b"".join(ks), np.int64).reshape(-1, 2) if ks else np.zeros((0, 2), np.int64)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), none, none], schema=out)
            if total > 4_000_000:
                yield from repeats(held)
                held, total = [], 0
        if held:
            yield from repeats(held)

    return stage_table(docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, token long, c long"), "sets")


def _common(profile: DataFrame) -> np.ndarray:
    """By cell of a shingle's hash, how common its most common one is (bits of the count; 0: rare).

    Any table gives right results, as everyone orders by the same; the most common levels that fit are kept.
    """
    counts = profile.where("token is not null").groupBy("token").agg(F.ceil(F.log2(F.sum("c"))).cast("int").alias("level"))
    least, room = 64, 1 << (CELL_BITS - 2)
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):  # a row per level, 63 at most
        room -= n
        if room < 0:
            break
        least = level
    cells = counts.where(F.col("level") >= least).groupBy(F.shiftrightunsigned("token", 64 - CELL_BITS).cast("int").alias("cell")).agg(F.max("level").alias("level")).toArrow()
    out = np.zeros(1 << CELL_BITS, np.uint8)
    out[cells.column("cell").to_numpy()] = cells.column("level").to_numpy()
    return out


def _prefixes(docs: DataFrame, common) -> DataFrame:
    """(token, doc_id): the rarest shingles of each set, one document for copies within a task."""
    out = pa.schema([("token", pa.int64()), ("doc_id", pa.int64())])

    def run(batches):
        known, seen, levels = _Words(), set(), common.value
        for b in batches:
            tokens, ids = [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t, known)
                if not len(s):
                    continue
                if (key := xxhash.xxh3_128_digest(s.tobytes())) in seen:
                    continue
                seen.add(key)
                k = prefix_length(len(s))
                level = levels[s >> np.uint64(64 - CELL_BITS)]
                if level[:k].any():
                    s = s[np.argsort(level, kind="stable")]
                tokens.append(s[:k])
                ids.append(np.full(k, doc, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(ids))], schema=out)

    return docs.mapInArrow(run, "token long, doc_id long")


def bitmap(ids: DataFrame, spark, bits: int = 24):
    """A broadcast bit table (2 MB) that holds each id's hash; it may hold others."""
    cell = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    rows = ids.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return spark.sparkContext.broadcast(out.view(np.uint8))


def is_set(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (table[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1


def with_bit(docs: DataFrame, ids: DataFrame, bits: int = 24) -> tuple[DataFrame, object]:
    """docs (doc_id, text) plus cell, and the table: a task may skip rows whose cell is not set."""
    spark = docs.sparkSession
    return docs.select("doc_id", "text", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << bits)).alias("cell")), bitmap(ids, spark, bits)


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, set) of the documents in ids, from their whole texts; other texts are not moved."""
    few = ids.count() <= FEW_IDS
    if few:
        docs = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi")
    rows, table = with_bit(docs, ids)
    out = pa.schema([("doc_id", pa.int64()), ("set", pa.binary())])

    def run(batches):
        known, held = _Words(), table.value
        for b in batches:
            b = b.filter(pa.array(is_set(held, b.column(2).to_numpy())))
            if b.num_rows:
                yield record_batch(out, {"doc_id": b.column(0), "set": [shingles(t, known).tobytes() for t in b.column(1).to_pylist()]})

    made = rows.mapInArrow(run, "doc_id long, set binary")
    if not few:
        made = made.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return made.dropDuplicates(["doc_id"])


def _overlap(a: bytes, b: bytes) -> tuple[int, int, int]:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()), len(x), len(y)


def _verified(pairs: DataFrame, docs: DataFrame, name: str = "links") -> DataFrame:
    """The pairs (a, b) that link, by their whole sets, as a table; pairs is one too, and goes."""
    ids = stage_table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
    sets = stage_table(_sets(docs, ids), "tokens")
    p = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                both, m, n = _overlap(x, y)
                keep.append(PER * both >= SHARE * (m + n - both))
            b = b.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=out)

    made = stage_table(p.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), name)
    discard(pairs, ids, sets)
    return made


def _alike(m, n):
    return (PER * F.least(m, n)) >= (SHARE * F.greatest(m, n))


def _beyond(n):
    """How many shingles a set of size n has after its prefix."""
    return F.ceil(n * SHARE / F.lit(PER)).cast("long") - 1


def _reaches(both, beyond, sizes):
    """Whether an overlap of `both` in the prefixes and at most `beyond` after them can make a link of sizes m + n."""
    return (PER + SHARE) * (both + beyond) >= SHARE * sizes


def _bounded(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that can link by their rows (a, n, tokens: the shared shingles of a's prefix).

    Of the two prefixes, one ends first in the common order: up to there the sets share what the prefixes
    share, and beyond it at most what that set has left.
    """
    p = pairs.join(rows, "a").join(rows.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("others")), "b").where(_alike(F.col("n"), F.col("m")))
    return p.where(_reaches(F.size(F.array_intersect("tokens", "others")), F.greatest(_beyond(F.col("n")), _beyond(F.col("m"))), F.col("n") + F.col("m"))).select("a", "b")


def _composed(group: np.ndarray, tokens: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash of its group and the token) of each token of each row."""
    row = np.repeat(np.arange(len(tokens)), pa.compute.list_value_length(tokens).to_numpy())
    flat = pa.compute.list_flatten(tokens).to_numpy().view(np.uint64)
    return row, mix64(flat ^ mix64(group.view(np.uint64))[row])


def _bounded_members(t: pa.Table, most: int = 4_000_000):
    """(a, b) arrays: of rows (g, asks, id, n, size, comp, tokens) of whole groups, each asking set with each member
    of its group, in a larger component, that can link by the listed shingles both have (see _bounded)."""
    g, asks, ids, n, size, comp = (t.column(c).to_numpy() for c in ("g", "asks", "id", "n", "size", "comp"))
    row, key = _composed(g, t.column("tokens"))
    own = ~asks[row]
    order = np.argsort(key[own], kind="stable")
    held, member = key[own][order], row[own][order]
    key, row = key[~own], row[~own]
    lo, hi = np.searchsorted(held, key), np.searchsorted(held, key, "right")
    cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    met = np.add.reduceat(hi - lo, cuts) if len(cuts) else cuts
    part = np.cumsum(met) // most  # asking sets looked up together
    for k in np.unique(part):
        at = cuts[part == k]
        end = cuts[np.flatnonzero(part == k)[-1] + 1] if part[-1] != k else len(row)
        at, many = np.arange(at[0], end), (hi - lo)[at[0] : end]
        x = np.repeat(row[at], many)
        y = member[np.repeat(lo[at] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
        pair, both = np.unique(x * len(ids) + y, return_counts=True)
        x, y = pair // len(ids), pair % len(ids)
        beyond = -(-n * SHARE // PER) - 1
        can = (size[x] < size[y]) | (size[x] == size[y]) & (comp[x] < comp[y])
        can &= PER * np.minimum(n[x], n[y]) >= SHARE * np.maximum(n[x], n[y])
        can &= (PER + SHARE) * (both + np.maximum(beyond[x], beyond[y])) >= SHARE * (n[x] + n[y])
        yield ids[x[can]], ids[y[can]]


def _open(asks: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): the asking sets (g, id, n, size, comp, tokens) with the members of their groups (same columns).

    A group and who asks it meet in one task, which emits only pairs that can link; a group asked by many is
    given to several tasks, its members with each. A task holds one group's members and one part of who asks.
    """
    length = F.sum(F.size("tokens").cast("long"))
    asked = stage_table(asks.groupBy("g").agg(length.alias("posts")).select("g", F.ceil(F.col("posts") / POSTS).cast("int").alias("parts")), "asked")
    asks = asks.join(asked, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = members.join(asked, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("g", "part").alias("g")  # groups of one hash would only meet more sets
    columns = ["id", "n", "size", "comp", "tokens"]
    rows = asks.select(key, F.lit(True).alias("asks"), *columns).union(members.select(key, F.lit(False).alias("asks"), *columns))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def bounded(held):
        for a, b in _bounded_members(pa.Table.from_batches(held)):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

    def run(batches):
        held, posts = [], 0
        for b in batches:
            g = b.column(0).to_numpy()
            if posts > POSTS:  # up to the end of the group at hand
                other = g != held[-1].column(0)[-1].as_py()
                end = int(np.argmax(other)) if other.any() else len(g)
                if end:
                    held.append(b.slice(0, end))
                if end < len(g):
                    yield from bounded(held)
                    held, posts = [], 0
                b = b.slice(end)
            if b.num_rows:
                held.append(b)
                posts += int(pa.compute.sum(pa.compute.list_value_length(b.column("tokens"))).as_py())
        if held:
            yield from bounded(held)

    made = stage_table(rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long"), "open")
    discard(asked)
    return made


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links): one row per row of docs.

    1. Sets are profiled: equal sets (by 128-bit digest) become one, the smallest doc_id; shingles that
       repeat are counted into a table of fixed size, which puts common shingles last in everyone's order.
    2. By the prefix bound, two linked sets share one of their first shingles. Each posted set is compared
       with its list's smallest id, so a list gives as many pairs as it has sets; what links forms groups,
       of GROUP sets or so; sets that link with nothing are grouped by the component that is largest
       around them. Sets apart from the largest component of a list meet another member of it,
       which leaves few components in a list of near copies.
    3. Token-group matrix: per group the union of its members' listed shingles, as rows (token, group). A set
       that shares one with a group of another, larger component is bounded by its overlap with that union and what
       lies beyond the prefixes; only groups that reach the bound are opened, and their members bounded in
       place, as arrays: rows are made for the pairs that can link alone, and those are compared. A component has
       at most GROUPS groups until they hold POSTS shingles, so that rows follow the sets that ask and not the
       component's size. Lists whose sets are all of one component need nothing.
    No link between different sets is lost; pairs within a component are not listed. Texts without words,
    null texts and null ids link with nothing (a null id's component is null). Rows that repeat a doc_id
    count as one document. Only doc_id and text are read; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    profile = _profile(docs)
    common = spark.sparkContext.broadcast(_common(profile))
    own = profile.where("token is null").select("doc_id", "n", "k1", "k2")
    valid = own.where("doc_id is not null and n > 0")
    # a join of two plain tables: the engine can split the rows of a digest of very many copies
    equal = stage_table(valid.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "equal")
    reps = valid.join(equal, ["k1", "k2"], "left").groupBy("doc_id").agg(F.min(F.coalesce("rep", "doc_id")).alias("rep"), F.max("n").alias("n"))
    reps = stage_table(reps, "reps")

    posted = stage_table(_prefixes(docs.where("doc_id is not null"), common), "prefixes")
    lists = posted.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = posted.join(lists, "token").join(reps, "doc_id").select("token", F.col("rep").alias("a"), "n").distinct()
    shared = stage_table(shared, "lists")
    discard(posted, equal)
    hubs = shared.groupBy("token").agg(F.min(F.struct(F.col("a").alias("b"), F.col("n").alias("m"))).alias("h"), F.count("*").alias("c")).where("c > 1").select("token", "h.b", "h.m")
    stars = stage_table(shared.join(hubs, "token").where(F.col("a") != F.col("b")).where(_alike("n", "m")).select("a", "b").distinct(), "stars")
    used = shared.join(hubs.select("token"), "token", "left_semi")
    rows = stage_table(used.groupBy("a").agg(F.max("n").alias("n"), F.collect_list("token").alias("tokens")), "rows")
    links = _verified(stage_table(_bounded(stars, rows), "near"), docs)
    discard(stars)

    for k in range(ROUNDS):  # docs apart from their list's largest component meet another member of it
        parts = connected_components(links)
        sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
        label = used.join(parts.withColumnRenamed("node", "a"), "a", "left").join(sizes, "component", "left")
        label = label.select("token", "a", "n", F.coalesce("component", "a").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
        if k == ROUNDS - 1:
            break
        hub = label.groupBy("token").agg(F.max(F.struct("size", "comp", F.xxhash64("a", F.lit(k)).alias("h"), F.col("a").alias("b"), F.col("n").alias("m"))).alias("hub")).select("token", "hub.b", "hub.m", F.col("hub.comp").alias("other"))
        stars = label.join(hub, "token").where("comp <> other").where(_alike("n", "m")).select("a", "b").distinct()
        stars = stage_table(_bounded(stars, rows), "near")
        if stars.isEmpty():
            break
        discard(parts)
        fresh, known = _verified(stars, docs), links
        links = stage_table(known.union(fresh), "links")
        discard(known, fresh)
    mixed = label.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    label = stage_table(label.join(mixed, "token", "left_semi").withColumn("rank", F.struct("size", "comp")), "mixed")
    discard(parts)
    tops = label.groupBy("token").agg(F.max("rank").alias("top"))
    single = label.where("size = 1").join(tops, "token").groupBy(F.col("a").alias("s")).agg(F.min("top.comp").alias("near"), F.count("*").alias("p"))
    # groups of a component: of GROUP sets, GROUPS at most until they would hold more than POSTS shingles
    groups_of = lambda sets, posts: F.least(F.ceil(sets / GROUP), F.greatest(F.lit(GROUPS), F.ceil(posts / POSTS)))
    single = stage_table(single, "single")
    # written as tables: broadcast at once while they are small, and else joined so that a hot component is split
    around = stage_table(single.groupBy("near").agg(F.count("*").alias("c"), F.sum("p").alias("posts")), "around")
    near = single.join(around, "near").select("s", F.concat_ws(".", F.lit("~"), F.col("near"), F.pmod(F.xxhash64("s"), groups_of(F.col("c"), F.col("posts")))).alias("g1"))
    posts = stage_table(label.where("size > 1").groupBy("comp").agg(F.count("*").alias("posts")), "posts")
    group = F.coalesce("g1", F.concat_ws(".", F.col("comp"), F.pmod(F.xxhash64("a"), groups_of(F.col("size"), F.col("posts")))))
    mixed, label = label, label.join(posts, "comp", "left").join(near, F.col("a") == F.col("s"), "left").select("token", "a", "n", "rank", group.alias("g"))
    label = stage_table(label, "labels")
    discard(mixed, single, around, posts)
    groups = label.groupBy("a", "n", "rank", "g").agg(F.collect_list("token").alias("tokens"))
    columns = label.groupBy("token", "g").agg(F.max("rank").alias("other"))  # the matrix: which shingles a group has
    spans = groups.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    asks = label.select("token", "a", "n", "rank").join(columns, "token").where("rank < other").groupBy("a", "n", "rank", "g").agg(F.collect_list("token").alias("tokens")).join(spans, "g")
    n, least, most, both = F.col("n"), F.col("least"), F.col("most"), F.size("tokens").cast("long")
    can = _reaches(both, _beyond(n), n + F.greatest(least, F.ceil(n * SHARE / F.lit(PER)))) | _reaches(both, _beyond(most) + 1, n + most)
    put = ["g", F.col("a").alias("id"), "n", "rank.size", "rank.comp", "tokens"]
    opened = stage_table(asks.where((PER * most >= SHARE * n) & (PER * n >= SHARE * least) & can).select(put), "opened")
    more = _verified(_open(opened, groups.select(put)), docs)
    discard(opened, rows, label)
    parts = connected_components(links.union(more))
    discard(links, more, shared)
    parts = reps.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("doc_id").alias("d"), F.coalesce("component", "rep").alias("c"))
    return own.join(parts, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
x AS (SELECT doc_id, md5_number_lower(unnest(s)) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
h AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id FROM n JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = n.doc_id
"""
