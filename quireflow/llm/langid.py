"""Language identification by error-correcting output codes over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, record_batch, small_batches

UNKNOWN = "und"
#: A text whose best codeword leads by less than this share of the score is flagged.
AMBIGUOUS = 0.6


def features(text: str, bits: int) -> np.ndarray:
    """Root counts of hashed 1- to 3-grams of the lower-cased whole text, at unit length."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    counts = np.zeros(1 << bits)
    grams = None
    for n, salt in ((1, 0x9E3779B1), (2, 0x85EBCA77), (3, 0xC2B2AE3D)):
        own = c[n - 1 :] * np.uint32(salt)
        grams = own if grams is None else (grams[:-1] * np.uint32(0x01000193)) ^ own
        h = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    x = np.sqrt(counts)
    return (x / np.linalg.norm(x)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and next(filter(str.isalpha, text), None) is not None


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: every way to part few languages, for more a seeded code with far codewords."""
    if k < 2:
        return np.zeros((k, 0), int)
    if k <= 6:
        splits = range(1, 1 << (k - 1))
        return np.array([[1 if b >> i & 1 else -1 for b in splits] for i in range(k)])
    length, rng, best, far = int(np.ceil(12 * np.log2(k))), np.random.default_rng(7), None, -1
    for _ in range(200):
        m = rng.choice([-1, 1], size=(k, length))
        m = m[:, np.abs(m.sum(axis=0)) < k]
        d = (m.shape[1] - m @ m.T) // 2
        if (least := d[~np.eye(k, dtype=bool)].min()) > far:
            best, far = m, least
    return best


@dataclass
class CodeModel:
    """A linear classifier for each code bit, its weight in decoding, and each language's codeword."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    bits: int

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Loss-weighted decoding: the language whose codeword costs least; score is its share."""
        if len(self.langs) < 2:
            return self.langs * len(x), np.ones(len(x))
        margin = x @ self.weights + self.bias
        cost = np.stack([(np.logaddexp(0, -margin * row) * self.trust).sum(axis=1) for row in self.code], axis=1)
        share = np.exp(cost.min(axis=1, keepdims=True) - cost)
        share /= share.sum(axis=1, keepdims=True)
        return [self.langs[i] for i in cost.argmin(axis=1)], share.max(axis=1)


def train(labelled: DataFrame, most_rows: int = 1500, bits: int = 12, steps: int = 150, most_langs: int = 500) -> CodeModel:
    """Fit on a bounded sample: at most about most_rows rows of (doc_id, text, lang), spread evenly over languages.

    The sample is the rows of smallest hash within each language, by a threshold from the language's
    count, so that nothing is sorted or gathered but it. Texts without a letter teach nothing. Of dirty labels
    the most_langs most frequent are learned (ties in code point order).
    """
    small_batches(labelled.sparkSession)
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    langs = sorted(sizes)
    each = max(1, most_rows // max(1, len(langs)))
    spans = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, each / sizes[lang]))]) if langs else F.lit(None)
    out = pa.schema([("lang", pa.string()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            rows = [(lang, features(t, bits).tobytes()) for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if has_letter(t)]
            if rows:
                yield record_batch(out, dict(zip(out.names, zip(*rows))))

    rows = []
    if langs:
        drawn = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_003)) / 1_000_003 < F.element_at(spans, F.col("lang"))
        rows = labelled.where(drawn).select("text", "lang").mapInArrow(run, "lang string, x binary").limit(2 * most_rows).collect()
    langs = sorted({r[0] for r in rows})
    code, turn = codewords(len(langs)), np.random.default_rng(5).permutation(len(rows))
    x = np.zeros((len(rows), 1 << bits), np.float32)
    for i, k in enumerate(turn):
        x[i] = np.frombuffer(rows[k][1], dtype=np.float32)
    y = code[[langs.index(rows[k][0]) for k in turn]].astype(np.float32) if rows else np.zeros((0, 0), np.float32)
    del rows
    w, b = np.zeros((1 << bits, code.shape[1] if len(langs) > 1 else 0), np.float32), np.zeros(code.shape[1] if len(langs) > 1 else 0, np.float32)
    trust = np.ones(len(b))
    if len(langs) > 1:
        cut = len(y) * 4 // 5
        for size in (cut, len(y)):
            w[:], b[:] = 0, 0
            xp, yp = x[:size], y[:size]
            v, vb, rate = np.zeros_like(w), np.zeros_like(b), 40.0
            for _ in range(steps):
                g = -yp / (1 + np.exp(yp * (xp @ w + b))) / max(1, len(yp))
                v, vb = 0.9 * v - rate * 0.1 * (xp.T @ g + 1e-5 * w), 0.9 * vb - rate * 0.01 * g.sum(axis=0)
                w, b = w + v, b + vb
            if size < len(y):  # a bit that errs on rows it has not seen counts less
                err = np.clip(((x[size:] @ w + b) * y[size:] <= 0).mean(axis=0), 0.002, 0.49)
                trust = np.log((1 - err) / err) / np.log(0.998 / 0.002)
    return CodeModel(langs, code, w, b, trust, bits)


def identify(df: DataFrame, model: CodeModel) -> DataFrame:
    """df plus lang_pred, score and ambiguous; every whole text is read, in one pass without a shuffle.

    Reads df.text alone. A null text, one without a letter, and any text where no language was learned get
    `und` with score 0 and are ambiguous. Columns of df of the same names are replaced.
    """
    df = df.drop("lang_pred", "score", "ambiguous")
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
            for at in range(0, len(rows), 256):
                own = rows[at : at + 256]
                langs, s = model.predict(np.stack([features(texts[i], model.bits) for i in own]))
                for i, lang, v in zip(own, langs, s):
                    pred[i], score[i] = lang, min(1.0, float(v))
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS, pa.bool_())], names=names + ["lang_pred", "score", "ambiguous"])

    from pyspark.sql.types import StructType

    schema = StructType(list(df.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return df.mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    """Rows to learn from: labelled, not held out, with a text."""
    return docs.where(~held_out()).where("lang is not null and text is not null").select("doc_id", "text", "lang")
