"""Near-duplicate vectors by an index of pivot permutations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, record_batch, small_batches, stage_table
from .components import connected_components

#: Nearest pivots that describe a vector, how many of them two vectors must share, and the most pivots.
PREFIX, SHARED, MOST_PIVOTS = 12, 2, 1024
#: A list of more vectors is parted by a second shared pivot; a block of a list or cell holds so many.
LONG, BLOCK = 3000, 1500
#: Cosine from which a vector is at home in its nearest pivot's cell; no two pivots are as near.
NEAR = 0.8


def draw_pivots(vectors: DataFrame, n: int, most: int = MOST_PIVOTS) -> dict[int, np.ndarray]:
    """Unit reference points by dimension: 4 * sqrt(n), at most `most`, of the vectors of smallest hash.

    A vector at NEAR or above to a pivot before it is passed over, so a dense group has few pivots however
    many of the rows it holds; up to four times as many vectors are looked at.
    """
    r = int(min(most, max(16, 4 * n**0.5)))
    rows = vectors.orderBy(F.xxhash64("rep", F.lit("pivot"))).limit(4 * r).select("unit").collect()
    out: dict[int, np.ndarray] = {}
    taken: dict[int, int] = {}
    for (x,) in rows:
        d = len(x)
        k, at = taken.get(d, 0), out.setdefault(d, np.zeros((r, d)))
        if k == 0 or (at[:k] @ np.array(x)).max() < NEAR:
            at[k], taken[d] = x, k + 1
            if sum(taken.values()) == r:
                break
    return {d: at[: taken[d]] for d, at in out.items()}


def _reach(low: float, cosine: float) -> float:
    """The least cosine to a pivot of what can link with a vector at `low` to it, less a rounding error."""
    return float(np.cos(min(np.pi, np.arccos(np.clip(low, -1, 1)) + np.arccos(np.clip(cosine, -1, 1))))) - 1e-9


def _described(vectors: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Per vector its ordered nearest pivots, the cell it is at home in, if any, and the cells in reach.

    A dimension without pivots has one list of its own.
    """
    out = pa.schema([("rep", pa.int64()), ("m", pa.int64()), ("x", pa.binary()), ("prefix", pa.list_(pa.int32())), ("home", pa.int32()), ("top", pa.float64()), ("cells", pa.list_(pa.int32())), ("sims", pa.list_(pa.float64()))])
    floor = _reach(NEAR, cosine)
    first = dict(zip(sorted(pivots), np.cumsum([0] + [len(pivots[d]) for d in sorted(pivots)]).tolist()))

    def run(batches):
        for b in batches:
            xs = [np.array(x) for x in b.column(2).to_pylist()]
            near: list = [None] * len(xs)
            home, top, cells, at = ([None] * len(xs) for _ in range(4))
            for d in {len(x) for x in xs}:
                own = [i for i, x in enumerate(xs) if len(x) == d]
                if d not in pivots:
                    for i in own:
                        near[i] = [-1 - d]
                    continue
                sims = np.stack([xs[i] for i in own]) @ pivots[d].T
                order = np.argsort(-sims, axis=1, kind="stable")[:, :PREFIX] + first[d]
                for i, o, sim in zip(own, order.tolist(), sims):
                    near[i] = o
                    inside = np.nonzero(sim >= floor)[0]
                    cells[i], at[i] = inside + first[d], sim[inside]
                    if sim.max() >= NEAR:
                        home[i], top[i] = int(sim.argmax()) + first[d], sim.max()
            yield record_batch(out, {"rep": b.column(0), "m": b.column(1), "x": [x.tobytes() for x in xs], "prefix": near, "home": home, "top": top, "cells": cells, "sims": at})

    return vectors.select("rep", "m", "unit").mapInArrow(run, "rep long, m long, x binary, prefix array<int>, home int, top double, cells array<int>, sims array<double>")


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row and column of a block of links the first row it is connected with, or -1."""
    rows, columns = np.full(hit.shape[0], -1), np.full(hit.shape[1], -1)
    for s in np.nonzero(hit.any(axis=1))[0]:
        if rows[s] >= 0:
            continue
        rows[s], edge = s, np.array([s])
        while len(edge):
            new = np.nonzero(hit[edge].any(axis=0) & (columns < 0))[0]
            columns[new] = s
            edge = np.nonzero(hit[:, new].any(axis=1) & (rows < 0))[0]
            rows[edge] = s
    return rows, columns


def _cells(described: DataFrame, cosine: float) -> DataFrame:
    """(rep, n, root) of every link with an end that is at home in a cell, exact by the triangle inequality.

    What links with a vector is no further from its pivot than the vector and the link's angle together, so
    each cell compares its own with all in that reach, in pairs of blocks. A vector at home counts its links
    there, and those of its partners that are nowhere at home.
    """
    homes = stage_table(described.where("home is not null").groupBy(F.col("home").alias("p")).agg(F.count("*").alias("h"), F.min("top").alias("low")), "homes")
    apart = F.acos(F.least(F.col("low"), F.lit(1.0))) + float(np.arccos(np.clip(cosine, -1, 1)))
    homes = homes.withColumn("least", F.cos(F.least(apart, F.lit(np.pi))) - 1e-9)
    near = described.select("rep", "m", "x", "home", F.explode(F.arrays_zip("cells", "sims")).alias("z"))
    near = near.select("rep", "m", "x", "home", F.col("z.cells").alias("p"), F.col("z.sims").alias("sim"))
    near = near.join(F.broadcast(homes), "p").where((F.col("sim") >= F.col("least")) | F.col("home").eqNullSafe(F.col("p"))).select("rep", "m", "x", "home", "p", "h")
    size = stage_table(near.groupBy("p").agg(F.count("*").alias("c")), "cells")
    near = near.join(F.broadcast(size), "p").withColumn("hb", F.ceil(F.col("h") / BLOCK).cast("int")).withColumn("cb", F.ceil(F.col("c") / BLOCK).cast("int"))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = near.where("home = p").withColumn("i", part("hb")).withColumn("j", every("cb")).withColumn("own", F.lit(True))
    met = near.withColumn("j", part("cb")).withColumn("i", every("hb")).withColumn("own", F.lit(False))
    both = own.select("p", "i", "j", "own", "rep", "m", "x", "home").union(met.select("p", "i", "j", "own", "rep", "m", "x", "home"))
    out = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        rep, m, own = (t.column(c).to_numpy() for c in ("rep", "m", "own"))
        away = np.array(t.column("home").is_null().to_pylist())
        x = t.column("x").to_pylist()
        a, b = np.nonzero(own)[0], np.nonzero(~own)[0]
        if not len(a) or not len(b):
            return out.empty_table()
        y = np.stack([np.frombuffer(x[k]) for k in b])
        hit = np.zeros((len(a), len(b)), bool)
        for k in range(0, len(a), 500):
            hit[k : k + 500] = np.stack([np.frombuffer(x[i]) for i in a[k : k + 500]]) @ y.T >= cosine
        hit &= rep[a][:, None] != rep[b][None, :]
        total = np.concatenate([hit @ m[b], np.where(away[b], m[a] @ hit, 0)])
        first, second = _forest(hit)
        root = np.concatenate([first, second])
        of = np.concatenate([rep[a], rep[b]])
        some = root >= 0
        return pa.table({"rep": of[some], "n": total[some], "root": rep[a][root[some]]}, schema=out)

    return both.groupBy("p", "i", "j").applyInArrow(compare, "rep long, n long, root long")


def _linked(left, right, same: bool, key: tuple, cosine: float, shared: int):
    """Index pairs (i, j) of two blocks that this list answers for: shared-pivot counts first, then cosines."""
    x, px = left
    y, py = right
    ids = np.unique(np.concatenate([p for p in px] + [p for p in py]))
    hot = np.zeros((len(px) + len(py), len(ids)), np.float32)
    for i, p in enumerate([*px, *py]):
        hot[i, np.searchsorted(ids, p)] = 1
    a, b = hot[: len(px)], hot[len(px) :]
    least = min(shared, len(ids))
    i, j = np.nonzero(a @ b.T >= least)
    if same:
        i, j = i[i < j], j[i < j]
    if not len(i):
        return i, j
    keep = np.zeros(len(i), bool)
    gram = x @ y.T
    near = np.nonzero(gram[i, j] >= cosine)[0]
    for k in near:  # each pair belongs to the list of its smallest shared pivots
        both = np.intersect1d(px[i[k]], py[j[k]])
        keep[k] = tuple(both[: len(key)]) == key
    return i[keep], j[keep]


def link_vectors(table: DataFrame, cosine: float = 0.9, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of table (vec_id, embedding; others ignored).

    Equal vectors become one with a weight. A vector at NEAR or above to its nearest pivot is at home in that
    pivot's cell, and all its links are found there (see _cells), so dense groups are exact. Every other
    vector is posted in the inverted list of each of its nearest pivots. Two vectors of a list that share `shared` pivots or more are compared in
    double precision, in the list of their smallest shared pivot; a list above LONG is parted by the second
    smallest, where there is one, and what is still long goes in pairs of blocks. Pairs are counted, not listed: a list returns
    a count and one link per vector. Vectors of other dimensions, null, empty or zero ones, and ones with
    null or non-finite components link with nothing. A null vec_id has a null component. Rows that repeat a
    vec_id are vectors of their own and share the id. Pivots are a bounded sample (MOST_PIVOTS).
    """
    small_batches(table.sparkSession, 2000)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda t, x: t + x * x))
    big = F.array_max(F.transform("e", lambda x: F.abs(x)))
    fit = F.col("vec_id").isNotNull() & F.coalesce((F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)) & (F.coalesce(big, F.lit(0.0)) > 0)
    # staged: a join on unit would else compute it again for its null filter
    usable = rows.where(fit).withColumn("e", F.transform("e", lambda x: x / big)).withColumn("norm", norm)
    usable = stage_table(usable.withColumn("unit", F.transform("e", lambda x: x / F.col("norm"))).select("vec_id", "unit"), "units")
    reps = stage_table(usable.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).select("rep", "m", "unit"), "vectors")
    n = reps.count()
    described = stage_table(_described(reps, draw_pivots(reps, n), cosine), "described")
    posts = described.where("home is null").select("rep", "m", "x", "prefix", F.explode("prefix").alias("p"))
    counts = posts.groupBy("p").agg(F.count("*").alias("c"))
    long = counts.where(F.col("c") > LONG).select("p")
    # a vector with one pivot has no second to part by: such a list stays whole
    short = posts.join(counts, "p").where((F.col("c") <= LONG) | (F.size("prefix") == 1)).withColumn("q", F.lit(None).cast("int"))
    parted = posts.where(F.size("prefix") > 1).join(long, "p").withColumn("q", F.explode("prefix")).where("q > p")
    parted = parted.join(parted.groupBy("p", "q").agg(F.count("*").alias("c")), ["p", "q"])
    lists = short.select("rep", "m", "x", "prefix", "p", "q", "c").union(parted.select("rep", "m", "x", "prefix", "p", "q", "c"))
    lists = lists.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    lists = lists.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lists = lists.withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with"))
    out = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])

    def compare(t: pa.Table) -> pa.Table:
        p, q, i, j = (t.column(c)[0].as_py() for c in ("p", "q", "i", "j"))
        key = (p,) if q is None else (p, q)
        rep, m, own = (t.column(c).to_numpy() for c in ("rep", "m", "own"))
        prefix = [np.unique(x) for x in t.column("prefix").to_pylist()]
        xs = [np.frombuffer(x) for x in t.column("x").to_pylist()]
        total, links = np.zeros(len(rep), np.int64), []
        left = np.nonzero(own == i)[0]
        right = np.nonzero(own == j)[0]
        step = 500
        for a in range(0, len(left), step):
            for b in range(a if i == j else 0, len(right), step):
                l, r = left[a : a + step], right[b : b + step]
                x, y = _linked((np.stack([xs[k] for k in l]), [prefix[k] for k in l]), (np.stack([xs[k] for k in r]), [prefix[k] for k in r]), i == j and a == b, key, cosine, shared)
                x, y = l[x], r[y]
                np.add.at(total, x, m[y])
                np.add.at(total, y, m[x])
                links += zip(x.tolist(), y.tolist())
        root = list(range(len(rep)))

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for x, y in links:
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        hit = np.nonzero(total)[0]
        return pa.table({"rep": pa.array(rep[hit]), "n": pa.array(total[hit]), "root": pa.array(rep[[top(k) for k in hit]] if len(hit) else np.zeros(0, np.int64))}, schema=out)

    met = stage_table(lists.select("rep", "m", "x", "prefix", "p", "q", "own", "i", "j").groupBy("p", "q", "i", "j").applyInArrow(compare, "rep long, n long, root long").union(_cells(described, cosine)), "met")
    discard(described)
    found = met.groupBy("rep").agg(F.sum("n").alias("n"))
    parts = connected_components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    info = reps.join(found, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left").select("unit", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    ids = usable.join(info, "unit").select(F.col("vec_id").alias("v"), "n_links", "c").distinct()
    out_rows = rows.select("vec_id", fit.alias("fit")).join(ids, (F.col("vec_id") == F.col("v")) & F.col("fit"), "left")
    return out_rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), F.coalesce(F.coalesce("c", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE u AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS v, vec_id AS c FROM u UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, coalesce(m.c, e.vec_id) AS component_id, coalesce(m.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = e.vec_id
"""
