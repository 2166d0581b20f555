"""Removing byte strings that repeat anywhere, by column-wise construction of a collection's suffix order."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, record_batch, small_batches, stage_table
from .jaccard import FEW_IDS

#: Length of the strings, of the anchors in them, and of the segments in which a text is searched for anchors.
LENGTH, ANCHOR, SEGMENT = 400, 64, 1 << 20
#: Members built together, and the size from which a class of equal anchors is dealt by its strings instead.
CHUNK, HOT = 20_000, 8192
_P = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 24) - 1)


class _Powers:
    def __init__(self):
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        self.up, self.down = (np.cumprod(np.full(SEGMENT + LENGTH + 1, x, np.uint64)) for x in (_P, inverse))


def _hashes(b: np.ndarray, n: int, powers: _Powers) -> np.ndarray:
    """A 64-bit hash of each n-byte string of b."""
    c = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers.up[: len(b)], out=c[1:])
    return mix64((c[n:] - c[:-n]) * powers.down[: len(b) - n + 1])


def anchors(text: bytes, powers: _Powers, length: int = LENGTH, size: int = ANCHOR):
    """(key, place, left, starts, count) arrays: the anchors of all strings of `length` bytes, for runs of starts.

    A string's anchor is its `size`-byte part of smallest hash, of equal ones the last; so equal strings have
    equal anchors at equal distances. `left` is the distance from the first start of the run to the anchor.
    In a text that repeats with a short period, runs alike in all follow each other, `starts` apart; `count` of
    them are one row, so a text of one byte gives few rows, not one for each byte.
    """
    found = []
    for at in range(0, max(0, len(text) - length + 1), SEGMENT):
        b = np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - at), at)
        h = _hashes(b, size, powers)
        low = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        window, span = length - size + 1, 1
        while span * 2 <= window:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if rest := window - span:
            low = np.minimum(low[:-rest], low[rest:])
        place = (_LOW - (low & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        a = place[first]
        key, left, starts = h[a].view(np.int64), a - first, np.diff(np.r_[first, len(place)])
        alike = (key[1:] == key[:-1]) & (left[1:] == left[:-1]) & (starts[1:] == starts[:-1])
        of = np.flatnonzero(np.r_[True, ~alike])
        found.append((key[of], a[of] + at, left[of], starts[of], np.diff(np.r_[of, len(key)])))
    return [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 5


def repeated_starts(contexts: list[bytes], left: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """First and last start (as column - anchor's column) of a repeated string in each context; last < first: none.

    Contexts are laid out with their anchors in one column. From the last column to the first, each context
    gives one symbol a round: the order of the suffixes that start there is the order of those one column
    on (whose preceding symbols are the collection's transform), stably sorted by symbol; a common prefix
    grows by one where neighbours had the same symbol, else it is the least between them. A suffix whose
    common prefix with a neighbour is `length` or more starts a string that is elsewhere too.
    """
    m, base = len(contexts), int(left.max())
    start = base - left
    end = start + np.fromiter(map(len, contexts), np.int64, m)
    width = int(end.max())
    grid = np.zeros((width, m), np.uint8)
    for i, c in enumerate(contexts):
        grid[start[i] : end[i], i] = np.frombuffer(c, np.uint8)
    first, last = np.full(m, width, np.int64), np.full(m, -1, np.int64)
    enter, leave = np.argsort(-end, kind="stable"), np.zeros(m, bool)
    come, gone = 0, set(start.tolist())
    order, lcp = np.zeros(0, np.int64), np.zeros(0, np.int16)
    for c in range(width - 1, -1, -1):
        if c + 1 in gone:
            leave[start == c + 1] = True
            keep = np.flatnonzero(~leave[order])
            if len(keep) < len(order):
                if len(keep):
                    begin = np.r_[0, keep[:-1] + 1]
                    lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], begin)
                order = order[keep]
                lcp = lcp[: len(keep)]
        n = come
        while come < m and end[enter[come]] == c + 1:
            come += 1
        if come > n:
            order = np.r_[enter[n:come], order]
            lcp = np.r_[np.zeros(come - n, np.int16), lcp]
        if not len(order):
            continue
        lcp[0] = 0
        x = grid[c, order]
        turn = np.argsort(x, kind="stable")
        new, sym = order[turn], x[turn]
        same = np.flatnonzero(sym[1:] == sym[:-1]) + 1
        out = np.zeros(len(new), np.int16)
        if len(same):
            p, q = turn[same - 1] + 1, turn[same]  # the least of lcp[p..q]
            level = np.frexp(q - p + 1)[1] - 1
            least, table = np.zeros(len(same), np.int16), lcp
            for k in range(int(level.max()) + 1):
                if k:
                    half = 1 << (k - 1)
                    table = np.minimum(table[:-half], table[half:])
                at = np.flatnonzero(level == k)
                if len(at):
                    least[at] = np.minimum(table[p[at]], table[q[at] - (1 << k) + 1])
            out[same] = least + 1
        order, lcp = new, out
        if c <= base:
            hit = np.flatnonzero(lcp >= length)
            if len(hit):
                who = np.r_[order[hit], order[hit - 1]]
                first[who] = c
                last[who] = np.maximum(last[who], c)
    return first - base, last - base


def _classes(docs: DataFrame, length: int, size: int) -> DataFrame:
    out = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("left", pa.int32()), ("starts", pa.int32()), ("count", pa.int32())])

    def run(batches):
        powers = _Powers()
        for b in batches:
            parts = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key, place, *sizes = anchors((t or "").encode("utf-8", "surrogatepass"), powers, length, size)
                if len(key):
                    parts.append((key, np.full(len(key), doc, np.int64), place, *(x.astype(np.int32) for x in sizes)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], schema=out)

    return stage_table(docs.mapInArrow(run, "key long, doc_id long, place long, left int, starts int, count int"), "anchors")


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs with `row`, one number a row: the doc_id or, should any repeat or be null, one of a table written with it."""
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    return stage_table(docs.withColumn("row", F.monotonically_increasing_id()), "rows")


def _with_ids(docs: DataFrame, by_doc: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """(docs with the columns of by_doc, where there are some; the rows of docs that have none, if told apart).

    A few ids are broadcast, and only their texts move; of many, all texts are dealt by id, and rows without
    are among the first with nulls.
    """
    at = F.col(key) == F.col("id")
    ids = by_doc.select("id")
    if ids.count() > FEW_IDS:
        return docs.join(by_doc, at, "left"), None
    known = docs.join(F.broadcast(ids), at, "left_semi").join(by_doc, at)
    return known, docs.join(F.broadcast(ids), at, "left_anti")


def _contexts(docs: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """(key, hot, doc_id, place, left, starts, count, context): the bytes of all strings of a row's runs."""
    by_doc = hits.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("key", "hot", "place", "left", "starts", "count")).alias("hits"))
    by_doc = stage_table(by_doc, "hits")
    out = pa.schema([("key", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("place", pa.int64()), ("left", pa.int32()), ("starts", pa.int32()), ("count", pa.int32()), ("context", pa.binary())])

    def cut(batches):
        for b in batches:
            rows, held = [], 0
            for doc, t, own in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = (t or "").encode("utf-8", "surrogatepass")
                for h in own:
                    first = h["place"] - h["left"]
                    rows.append((h["key"], h["hot"], doc, h["place"], h["left"], h["starts"], h["count"], t[first : first + h["starts"] * h["count"] + length - 1]))
                    held += len(rows[-1][-1])
                    if held > 1 << 21:
                        yield record_batch(out, dict(zip(out.names, zip(*rows))))
                        rows, held = [], 0
            if rows:
                yield record_batch(out, dict(zip(out.names, zip(*rows))))

    texts = _with_ids(docs, by_doc)[0].where("id is not null").select("doc_id", "text", "hits")
    made = stage_table(texts.mapInArrow(cut, "key long, hot boolean, doc_id long, place long, left int, starts int, count int, context binary"), "contexts")
    discard(by_doc)
    return made


def repeated_spans(docs: DataFrame, length: int = LENGTH, size: int = ANCHOR, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, start, end), a table: byte spans made of `length`-byte strings that start elsewhere too (spans may overlap).

    Every such string has an anchor that repeats; strings of equal anchors meet in one class, aligned. Classes
    are dealt out by key and built in chunks of whole classes, `chunk` members or so, so memory is bounded.
    A class above `hot` members is dealt by its strings: counted by hash with partial sums, compared by bytes.
    """
    classes = _classes(docs, length, size)
    counts = classes.groupBy("key").agg(F.sum("count").alias("c")).where("c > 1").select("key", (F.col("c") > hot).alias("hot"))
    counts = stage_table(counts, "classes")  # a join of two plain tables: the engine can split a hot key's rows
    hits = classes.join(counts, "key")
    contexts = _contexts(docs, hits, length)
    discard(classes)
    spans = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def build(held):
        key, doc, place, left, starts, count = (np.concatenate([h[i] for h in held]) for i in range(6))
        own = [c for h in held for c in h[6]]
        if (count > 1).any():  # runs alike, `starts` apart
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            of = np.repeat(np.arange(len(count)), count)
            own = [own[i][k * n : (k + 1) * n + length - 1] for i, k, n in zip(of.tolist(), nth.tolist(), starts[of].tolist())]
            doc, place, left = doc[of], place[of] + nth * starts[of], left[of]
        first, last = repeated_starts(own, left.astype(np.int64), length)
        on = np.flatnonzero(last >= first)
        return pa.RecordBatch.from_arrays([pa.array(doc[on]), pa.array(place[on] + first[on]), pa.array(place[on] + last[on] + length)], schema=spans)

    def run(batches):
        held, n = [], 0
        for b in batches:
            part = [*(b.column(i).to_numpy() for i in range(6)), b.column(6).to_pylist()]
            key = part[0]
            if n >= chunk:  # up to the end of the class at hand
                end = int(np.argmax(key != held[-1][0][-1])) if (key != held[-1][0][-1]).any() else len(key)
                if end:
                    held.append([x[:end] for x in part])
                if end < len(key):
                    yield build(held)
                    held, n = [], 0
                part = [x[end:] for x in part]
            if len(part[0]):
                held.append(part)
                n += int(part[5].sum())
        if held:
            yield build(held)

    dealt = contexts.where("not hot").select("key", "doc_id", "place", "left", "starts", "count", "context").repartition("key").sortWithinPartitions("key")
    found = stage_table(dealt.mapInArrow(run, "doc_id long, start long, end long"), "found")
    if counts.where("hot").isEmpty():
        discard(contexts, counts)
        return found

    hot_spans = _hot_spans(contexts.where("hot").select("doc_id", "place", "left", "context"), length)
    both = stage_table(found.union(hot_spans), "found")
    discard(found, contexts, counts)
    return both


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, start, end) of the repeated strings of contexts (doc_id, place, left, context), one by one.

    Strings are counted by a 128-bit hash. Then the bytes of equal hashes are compared: within a task each with
    the first of its hash, and one of each task and hash by minimum and maximum. Strings of one hash that
    differ, should there ever be any, are counted by their bytes.
    """
    def hashed(c: bytes, powers) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(c, np.uint8)
        h1, h2 = _hashes(b, length, powers), _hashes(b[::-1], length, powers)[::-1]
        return h1.view(np.int64), np.ascontiguousarray(h2).view(np.int64)

    def strings(batches):
        powers = _Powers()
        for b in batches:
            for doc, place, left, c in zip(*(b.column(i).to_pylist() for i in range(4))):
                h1, h2 = hashed(c, powers)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.full(len(h1), doc)), pa.array(np.arange(len(h1)) + place - left)], names=["h1", "h2", "doc_id", "start"])

    out = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("low", pa.binary()), ("same", pa.bool_())])

    def compared(batches):
        powers, first, differ = _Powers(), {}, set()

        def flush():
            rows = [(*k, v, k not in differ) for k, v in first.items()]
            for at in range(0, len(rows), 5000):
                yield record_batch(out, dict(zip(out.names, zip(*rows[at : at + 5000]))))
            first.clear()

        for b in batches:
            for c in b.column(0).to_pylist():
                for i, k in enumerate(zip(*(h.tolist() for h in hashed(c, powers)))):
                    s = c[i : i + length]
                    if first.setdefault(k, s) != s:
                        differ.add(k)
                if len(first) > 50_000:  # 20 MB
                    yield from flush()
        yield from flush()

    every = contexts.mapInArrow(strings, "h1 long, h2 long, doc_id long, start long")
    often = stage_table(every.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2"), "often")
    seen = contexts.select("context").mapInArrow(compared, "h1 long, h2 long, low binary, same boolean").join(often, ["h1", "h2"], "left_semi")
    mixed = seen.groupBy("h1", "h2").agg(F.min("low").alias("a"), F.max("low").alias("b"), F.bool_and("same").alias("s")).where("a <> b or not s").select("h1", "h2")
    mixed = stage_table(mixed, "mixed")
    spans = lambda d: d.select("doc_id", "start", (F.col("start") + length).alias("end"))
    if mixed.isEmpty():
        return spans(every.join(often, ["h1", "h2"], "left_semi"))
    told = contexts.select("doc_id", (F.col("place") - F.col("left")).alias("at"), "context").withColumn("i", F.explode(F.sequence(F.lit(0), F.octet_length("context") - length)))
    told = told.select("doc_id", (F.col("at") + F.col("i")).alias("start"), F.expr(f"substring(context, i + 1, {length})").alias("s")).join(every.join(mixed, ["h1", "h2"], "left_semi").select("doc_id", "start"), ["doc_id", "start"], "left_semi")
    again = told.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s")
    return spans(every.join(often.join(mixed, ["h1", "h2"], "left_anti"), ["h1", "h2"], "left_semi")).union(spans(told.join(again, "s", "left_semi")))


def dedup_bytes(docs: DataFrame, length: int = LENGTH, size: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256, kept_text: one row per row of docs.

    Texts are UTF-8 bytes, null ones empty. What goes is each byte of a `length`-byte string that also starts
    anywhere else, in this document or another, judged on the input; kept bytes are concatenated (kept, null if
    nothing went). kept_text is the same as text, without letters that lost a byte; where nothing went, the
    text itself. Texts shorter than that stay whole. Each row is a document of its own, also where its doc_id is
    null or repeats. Only documents with repeats move between tasks; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    docs = _told_apart(docs)
    spans = repeated_spans(docs.select(F.col("row").alias("doc_id"), "text"), length, size, hot)
    by_doc = stage_table(spans.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    discard(spans)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", span), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def cut(batches):
        for b in batches:
            made = []
            for doc, text, own in zip(*(b.column(i).to_pylist() for i in range(3))):
                t, runs, kept, at = (text or "").encode("utf-8", "surrogatepass"), [], [], 0
                for s in own or ():
                    if runs and s["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                    else:
                        runs.append(dict(s))
                for s in runs:
                    kept.append(t[at : s["start"]])
                    at = s["end"]
                left = b"".join([*kept, t[at:]])
                made.append((doc, len(t), len(t) - len(left), len(runs), runs or None, left if runs else None, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if runs else text))
            if made:
                yield record_batch(out, dict(zip(out.names, zip(*made))))

    known, others = _with_ids(docs, by_doc, "row")
    made = known.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: bigint, end: bigint>>, kept binary, kept_sha256 string, kept_text string")
    if others is None:
        return made
    text, none = F.coalesce("text", F.lit("")).cast("binary"), F.lit(0).cast("long")
    return made.union(others.select("doc_id", F.octet_length(text).cast("long"), none, none, F.lit(None), F.lit(None), F.sha2(text, 256), "text"))
