"""Hierarchical packing of token streams into windows of several context sizes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, small_batches
from .tokens import Encoder

TIERS = (2048, 1024, 512, 256)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs the pieces of one partition; windows come out full, but for the partition's own end.

    A document first fills windows of the longest tier; what remains is routed to the smallest tier that
    holds it. Tiers are packed from long to short: a window takes the largest pieces of its tier that fit,
    its gap is filled from shorter tiers, and only if no piece fits exactly is one cut and its rest routed
    anew. At the end the rest is laid out in windows of falling powers of two, which need no padding.
    Windows of a tier go to step groups of `step_tokens` tokens, so that all full groups weigh the same.
    """

    def __init__(self, first_id: int, tiers=TIERS, step_tokens: int = 16 * 2048):
        self.tiers, self.next, self.step = sorted(tiers, reverse=True), first_id, step_tokens
        self.pools = {t: [] for t in self.tiers}  # (length, age, piece), ascending
        self.total, self.age, self.made, self.first = 0, 0, {}, first_id

    def add(self, doc, ids: np.ndarray):
        """Yield the rows of windows that this document fills alone; keep the rest."""
        top, n, at = self.tiers[0], len(ids), 0
        while n - at >= top:
            yield from self.window(top, [(doc, at, ids[at : at + top], n)])
            at += top
        if at < n:
            self.route((doc, at, ids[at:], n))

    def route(self, piece) -> None:
        n = len(piece[2])
        tier = min(t for t in self.tiers if t >= n)
        self.age += 1
        self.total += n
        insort(self.pools[tier], (n, self.age, piece), key=lambda x: x[:2])

    def take(self, tier: int, i: int):
        n, _, piece = self.pools[tier].pop(i)
        self.total -= n
        return piece

    def fit(self, tiers, gap: int):
        """The largest piece of these tiers of at most gap tokens."""
        best = None
        for t in tiers:
            i = bisect_right(self.pools[t], gap, key=lambda x: x[0]) - 1
            if i >= 0 and (best is None or self.pools[t][i][0] > best[0]):
                best = (self.pools[t][i][0], t, i)
        return best and self.take(best[1], best[2])

    def cut(self, tiers, gap: int):
        """The first gap tokens of the smallest longer piece; its rest is routed anew."""
        best = None
        for t in tiers:
            i = bisect_left(self.pools[t], gap, key=lambda x: x[0])
            if i < len(self.pools[t]) and (best is None or self.pools[t][i][0] < best[0]):
                best = (self.pools[t][i][0], t, i)
        if not best:
            return None
        doc, start, ids, n = self.take(best[1], best[2])
        self.route((doc, start + gap, ids[gap:], n))
        return doc, start, ids[:gap], n

    def flush(self):
        """Yield windows while the pieces at hand fill them."""
        for k, tier in enumerate(self.tiers):
            own, shorter = self.tiers[k : k + 1], self.tiers[k + 1 :]
            while self.pools[tier] and sum(x[0] for t in self.tiers[k:] for x in self.pools[t][-64:]) >= tier:
                parts, gap = [], tier
                while gap:
                    piece = self.fit(own, gap) or self.fit(shorter, gap) or self.cut(shorter, gap) or self.cut(own, gap) or self.cut(self.tiers, gap)
                    parts.append(piece)
                    gap -= len(piece[2])
                yield from self.window(tier, parts)

    def end(self):
        yield from self.flush()
        rest = [x[2] for t in self.tiers for x in self.pools[t]]
        left = sum(len(p[2]) for p in rest)
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            parts, gap = [], size
            while gap:
                doc, start, ids, n = rest.pop()
                parts.append((doc, start, ids[:gap], n))
                if len(ids) > gap:
                    rest.append((doc, start + gap, ids[gap:], n))
                gap -= len(parts[-1][2])
            yield from self.window(size, parts)
            left -= size

    def window(self, tier: int, parts):
        i = self.made.get(tier, 0)
        self.made[tier] = i + 1
        group = self.first + tier * (1 << 20) + i // max(1, self.step // tier)
        at = 0
        for doc, start, ids, n in parts:
            yield doc, start, len(ids), ids.tobytes(), n, self.next, at, tier, group
            at += len(ids)
        self.next += 1


def pack(df: DataFrame, vocabulary: str | None = None, end_id: int = 1, tiers=TIERS, step_tokens: int = 16 * 2048) -> DataFrame:
    """Pieces of token windows, one row each, with their ids (unsigned 32-bit, little-endian).

    df needs doc_id and text; other columns are ignored. A null text counts as empty: its document is the
    end id alone. Repeated rows and null ids are packed like any others; an empty table gives no rows.
    No shuffle: each partition packs what it reads, batch by batch, and holds at most a batch and less
    than a few windows of leftovers. Sequence ids derive from the partition and are unique and rerunnable.
    """
    import pyarrow as pa

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])
    names = out.names
    small_batches(df.sparkSession)

    def run(batches):
        packer, enc = Packer(TaskContext.get().partitionId() << 38, tiers, step_tokens), Encoder(path)
        rows = []

        def batch():
            made = record_batch(out, dict(zip(names, zip(*rows)))) if rows else None
            rows.clear()
            return made

        for b in batches:
            docs, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            for at in range(0, len(docs), 250):
                for doc, ids in zip(docs[at : at + 250], enc.many(texts[at : at + 250])):
                    rows.extend(packer.add(doc, np.append(ids, np.uint32(end_id)).astype("<u4")))
                rows.extend(packer.flush())
                if made := batch():
                    yield made
        rows.extend(packer.end())
        if made := batch():
            yield made

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
