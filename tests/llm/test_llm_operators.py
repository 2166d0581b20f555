"""The operators of the llm folder against brute force on small tables, with awkward rows."""

import gzip
import hashlib
import random
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quireflow.llm import chat, components, fingerprints, jaccard, langid, lines, mixing, packing, suffixes, tokens, vectors, warc

ODD = [(1, None, "en", "a", 9), (2, "", "en", "a", 9), (3, "x", None, None, 9), (4, "  \n \n", "de", "b", 9), (5, "same words here are five and more", "en", "a", 9), (5, "same words here are five and more", "en", "a", 9), (None, "a null id with some words", "en", "a", 9), (6, "é🙂 " * 4000, "fr", "c", 9), (7, "same words here are five and more", "en", "c", 9)]
COLUMNS = "doc_id long, text string, lang string, source string, n_lines long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def prose(rng, n, words=40):
    return " ".join("w%d" % rng.randint(0, words) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    passage = "\n".join(prose(rng, 30, 10**6) for _ in range(4))
    out = []
    for i in range(60):
        t = "\n".join(prose(rng, rng.randint(3, 30), 10**6) for _ in range(rng.randint(1, 8)))
        if i % 3 == 0:
            t = t + "\n" + passage + "\n" + prose(rng, 10, 10**6)
        if i % 5 == 0 and out:
            w = out[0][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        if i % 7 == 0 and out:
            t = out[rng.randrange(len(out))][1]
        out.append((i, t))
    return out


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: top(x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_encoder_equals_tokenizers():
    """Against a fresh tokenizer as it is loaded; the text of a special token is that token."""
    e, fresh = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for t in ("", "a  b\n\n c", "don't 12,5% <|endoftext|>", "a <|endoftext|> b", "<|endoftext", "naïve café — ünï", "日本語 x", "日本 <|endoftext|>", "\x85 \xa0a\x1c", "a \t b"):
        assert e.one(t).tolist() == fresh.encode(t, add_special_tokens=False).ids
    assert e.one("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_packing(spark, odd, empty):
    assert packing.pack(empty).count() == 0
    rows = packing.pack(odd).collect()
    sequences, docs = defaultdict(list), defaultdict(int)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    assert docs[1] == docs[2] == 1 and docs[5] == 2 * docs[7]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_languages(spark, odd, empty):
    rng = random.Random(1)
    words = {"xx": "ka lo mi", "yy": "uth org pend", "zz": "éa ñu çi"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(20)), lang) for i in range(300) for lang in [sorted(words)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(langid.learnable(docs), most_rows=200)
    got = langid.identify(docs, model).where(langid.held_out()).collect()
    assert got and all(r["lang"] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in got)
    und = {r["doc_id"]: (r["lang_pred"], r["score"], r["ambiguous"]) for r in langid.identify(odd, model).collect()}
    assert und[1] == und[2] == und[4] == ("und", 0.0, True) and und[3][0] in words
    assert langid.identify(empty, langid.train(langid.learnable(empty))).count() == 0
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 3 for r in got} == {1}
    code = langid.codewords(9)
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 8


def test_languages_held_out(spark):
    """Accuracy on documents that taught nothing, and a few hundred dirty labels among them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = langid.identify(docs.where(langid.held_out()), langid.train(langid.learnable(docs))).where("lang is not null and lang_pred <> 'und'")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.98 * n
    dirty = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("ka lo mi").alias("text"), F.concat(F.lit("x"), "id").alias("lang"))
    assert len(langid.train(dirty.union(dirty.limit(5)), most_rows=50, most_langs=4, steps=2).langs) == 4


def test_warc(spark, tmp_path):
    pages = [(1, "u", "<p>x"), (2, None, "<p>x"), (3, "v\r\nX: y", None), (4, "w", ""), (5, "z", "é" * 5000), (5, "z", "é" * 5000), (None, "n", "n")]
    for zip64 in (False, True):
        made = warc.write_packages(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/{zip64}", zip64=zip64, roll_bytes=300)
        got = sorted(((r["page_id"] or 0, r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"], bytes(r["payload"])) for r in warc.read_packages(made).collect()))
        assert len(got) == 7
        by = {g[0]: g for g in got}
        assert by[1][1:3] == ("revisit", 4) and by[1][4] == 2 and by[2][1] == "response" and by[3][4] == 4 and by[5][1] == "response"
        assert by[2][3] == warc.digest(b"<p>x") and by[5][5] == ("é" * 5000).encode()
        for r in made.collect():
            with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
                assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
                head = gzip.decompress(z.read(warc.DATA)).split(b"\r\n\r\n")[0]
                assert all(x in head for x in (b"WARC/1.1\r\n", b"\r\nWARC-Date: ", b"\r\nContent-Type: application/http", b"\r\nContent-Length: "))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_components(docs, linked):
    root = {d: d for d, _ in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(docs):
        for b, y in docs[:i]:
            if linked(x, y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: top(d) for d, _ in docs}


def words_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_jaccard(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 3)
    rng = random.Random(9)
    docs = corpus()
    base = prose(rng, 60, 10**6).split()
    for i in range(100, 140):  # near copies around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = prose(rng, 1, 10**6)
        docs.append((i, " ".join(w)))
    sets = [(d, words_set(t)) for d, t in docs]
    want = brute_components(sets, lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y))
    got = {r[0]: (r[1], r[2]) for r in jaccard.link_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets}
    rows = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(odd).collect())
    assert rows == [(0, 2, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 0, 4), (5, 3, 5), (5, 3, 5), (6, 1, 6), (7, 3, 5)]
    assert jaccard.link_documents(empty).count() == 0


def near_group(rng, n, words=60, most=5):
    base = prose(rng, words, 10**6).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(words)] = prose(rng, 1, 10**6)
        out.append((i, " ".join(w)))
    return out


def test_jaccard_of_a_hot_near_group(spark, monkeypatch):
    """2,000 near copies around the threshold among others, with few and with many groups: equal to brute force."""
    rng = random.Random(12)
    docs = near_group(rng, 2000) + [(5000 + i, prose(rng, 40, 10**6)) for i in range(300)]
    sets = [words_set(t) for _, t in docs]
    known = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(docs), len(known)), np.float32)
    for i, s in enumerate(sets):
        m[i, [known[x] for x in s]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    near = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    place = {d: i for i, (d, _) in enumerate(docs)}
    want = brute_components([(d, d) for d, _ in docs], lambda a, b: near[place[a], place[b]])
    assert 1 < sum(want[d] == d for d, _ in docs[:2000]) < 1900
    for group, groups, posts in ((64, 16, 1_000_000), (8, 3, 500)):
        for k, v in (("GROUP", group), ("GROUPS", groups), ("POSTS", posts)):
            monkeypatch.setattr(jaccard, k, v)
        got = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
        assert got == want


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LONG", 60)
    monkeypatch.setattr(vectors, "BLOCK", 25)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[100:160] = x[0] + 0.25 * rng.normal(size=(60, 16))
    x[160:170] = x[1] * np.arange(1, 11)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [1.0, None], 1), (905, [1.0, 0.0], 1), (906, [2.0, 0.0], 1)]
    got = {r[0]: tuple(r[1:]) for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got[i][0] for i in range(300)) >= 0.9 * near.sum() and all(got[i][0] <= near[i].sum() for i in range(300))
    assert all(got[i][0] == 0 and got[i][1] == i for i in range(900, 905)) and got[905] == (1, 905, True) and got[906] == (1, 905, False)
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n, d, dense, noise", [(3000, 64, 1000, 0.23), (2000, 32, 600, 0.07), (2000, 32, 1200, 0.07), (4000, 32, 2400, 0.07)])
def test_vectors_of_a_dense_group(spark, n, d, dense, noise):
    """A third of the rows or more are unequal near copies of one vector: every link is found."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    group = rng.permutation(n)[:dense]
    x[group] = x[group[0]] + noise * rng.normal(size=(dense, d))
    got = {r[0]: tuple(r[1:3]) for r in vectors.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    assert all(got[i][0] == near[i].sum() - 1 for i in range(n))
    mates = sorted(group.tolist())
    want = brute_components([(i, i) for i in mates[:300]], lambda a, b: near[a, b]) if noise > 0.1 else dict.fromkeys(mates, mates[0])
    assert noise > 0.1 or near[np.ix_(mates, mates)].all()
    assert all(got[i][1] == want[i] for i in want if noise < 0.1 or want[i] == mates[0])


def test_vectors_of_a_rare_dimension(spark, monkeypatch):
    """Lists above LONG of vectors that have no pivot, or one: every link is found."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x[30:] = x[:30] + 0.1 * rng.normal(size=(30, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "LONG", 20)
    monkeypatch.setattr(vectors, "BLOCK", 25)
    for pivots in ({}, {8: rng.normal(size=(1, 8))}):
        monkeypatch.setattr(vectors, "draw_pivots", lambda *_, p=pivots: {d: v / np.linalg.norm(v, axis=1, keepdims=True) for d, v in p.items()})
        got = {r["vec_id"]: r["n_links"] for r in vectors.link_vectors(table).collect()}
        assert [got[i] for i in range(60)] == want.tolist()


def test_lines(spark, odd, empty):
    docs = [("a\nb\nc\nd\ne\nf\ng\nh\ni\nj\n" * 3)[:-1]]
    docs = [(i, t) for i, t in enumerate(docs + [docs[0], docs[0] + "\nz", "q", None, ""])]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[0][2] > 0 and got[1][2] >= got[0][2] and got[3] == ("q", 1, 0) and got[4] == (None, 0, 0) and got[5] == ("", 1, 0)
    assert all(len(t.split("\n")) == n - cut for t, n, cut in got.values() if t)
    assert lines.dedup_lines(odd).count() == len(ODD) and lines.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("hot", [10**6, 2])
def test_suffixes(spark, odd, empty, hot):
    rng = random.Random(4)
    docs = corpus() + [(900, "ab" * 300), (901, "é" * 500), (902, None), (903, "z" * 399)]
    L = 120
    seen = Counter(b[i : i + L] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - L + 1))
    got = {r["doc_id"]: r for r in suffixes.dedup_bytes(spark.createDataFrame(docs, "doc_id long, text string"), length=L, size=32, hot=hot).collect()}
    for d, t in docs:
        b = (t or "").encode()
        cut = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - L + 1):
            if seen[b[i : i + L]] > 1:
                cut[i : i + L] = 1
        kept = bytes(x for x, c in zip(b, cut) if not c)
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), len(b) - len(kept), int((np.diff(np.r_[0, cut]) == 1).sum()), hashlib.sha256(kept).hexdigest())
        assert r["kept_text"] == (t if kept == b else kept.decode("utf-8", "ignore")) and (r["kept"] is None) == (kept == b)
    assert suffixes.dedup_bytes(odd).count() == len(ODD) and suffixes.dedup_bytes(empty).count() == 0


def test_suffixes_of_equal_hashes(spark, monkeypatch):
    """Different strings of one hash in a hot class are told apart by their bytes."""
    real = suffixes._hashes
    monkeypatch.setattr(suffixes, "_hashes", lambda b, n, powers: real(b, n, powers) if n != 120 else np.zeros(len(b) - n + 1, np.uint64))
    rows = [(i, 0, 0, bytearray(t.encode())) for i, t in enumerate(("a" * 120 + "b", "c" + "a" * 120, "d" * 130, "e" * 120))]
    got = suffixes._hot_spans(spark.createDataFrame(rows, "doc_id long, place long, left int, context binary"), 120)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 120), (1, 1, 121)] + [(2, i, i + 120) for i in range(11)]


def test_suffixes_of_texts_with_short_periods(spark):
    """A run of one byte and others of short periods: few anchor rows, all removed but what is not covered."""
    powers = suffixes._Powers()
    assert len(suffixes.anchors(b"a" * 200_000, powers)[0]) <= 3
    docs = [(1, "x" + "a" * 200_000 + "y"), (2, "abc" * 300 + "q"), (3, "zabc" + "abc" * 200), (4, "a" * 450), (5, "b" * 400)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.dedup_bytes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (200_002, 200_000, 1), 2: (901, 900, 1), 3: (604, 603, 1), 4: (450, 450, 1), 5: (400, 0, 0)}


def test_very_long_texts(spark):
    """Texts of 3 MB: a passage across the end of a segment, whole token counts, whole sets, a language, windows."""
    rng = random.Random(21)
    word = lambda: "%08x" % rng.getrandbits(32)
    filler = lambda n: " ".join(word() for _ in range(n))
    passage = "<" + " ".join(word() for _ in range(60)) + ">"
    long = filler(116_000)[: suffixes.SEGMENT - 200] + passage + filler(200_000)
    docs = [(1, long), (2, "[" + passage + "]"), (3, long[:-1]), (4, "short text"), (5, "tr " * 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    only = df.where("doc_id in (1, 2, 4)")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.dedup_bytes(only).collect()}
    assert got == {1: (len(long), len(passage), 1), 2: (len(passage) + 2, len(passage), 1), 4: (10, 0, 0)}
    links = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link_documents(df).collect()}
    assert links[1] == (len(words_set(long)), 1) and links[3][1] == 1 and links[2][1] == 2 and links[4][1] == 4
    fresh = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    packed = packing.pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {(r["doc_id"], r["n"], r["t"]) for r in packed} == {(d, n, n) for d, t in docs for n in [len(fresh.encode(t, add_special_tokens=False).ids) + 1]}
    assert lines.dedup_lines(df).where("n_removed = 0").count() == 5
    chatted = chat.format_conversations(df.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text"))
    assert chat.read_back(chatted).first()["n_turns"] == 5 and chatted.where("over_budget").count() == 2


def test_suffixes_by_id(spark, monkeypatch):
    """Broadcast ids and dealt texts give the same rows."""
    docs = spark.createDataFrame(corpus() + [(None, "x" * 500), (7, "y" * 500)], "doc_id long, text string")
    rows = lambda: sorted(map(str, suffixes.dedup_bytes(docs, length=120, size=32).collect()))
    few = rows()
    monkeypatch.setattr(suffixes, "FEW_IDS", 0)
    assert rows() == few and len(few) == docs.count()


@pytest.mark.parametrize("few", [suffixes.FEW_IDS, 0])
def test_suffixes_of_rows_without_an_id_of_their_own(spark, monkeypatch, few):
    """Rows that share a doc_id, or have none, lose what repeats in them and nothing else."""
    monkeypatch.setattr(suffixes, "FEW_IDS", few)
    rng = random.Random(5)
    passage, clean = prose(rng, 90, 10**6), [prose(rng, 200, 10**6) for _ in range(3)]
    docs = [(1, passage + clean[0]), (1, clean[1]), (1, "at another place: " + passage), (2, clean[2]), (2, clean[2]), (None, "none " + passage + "!"), (None, "short"), (None, None), (3, "b" * 399)]
    left = [clean[0], clean[1], "at another place:", "", "", "none!", "short", "", "b" * 399]
    rows = suffixes.dedup_bytes(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr((d, len(t or ""), len(t or "") - len(k), hashlib.sha256(k.encode()).hexdigest())) for (d, t), k in zip(docs, left))


def test_suffixes_query_of_planted_passages(spark, tmp_path):
    """Passages of 66 words: of 400 bytes they go from every document, of 399 they stay; documents without lose nothing."""
    from quireflow.llm.queries import op8_column_suffixes

    rng = random.Random(22)
    words = lambda n: " ".join("%05x" % rng.getrandbits(20) for _ in range(n))
    goes, stays, twice = words(66) + "-----", words(66) + "----", words(80)
    assert (len(goes), len(stays)) == (400, 399)
    a, b, c = (words(90) for _ in range(3))
    docs = [(1, f"{a}<{goes}>é"), (2, f"[{goes}]{b}"), (3, f"({stays}){a[:200]}"), (4, f"{{{stays}}}{b[:200]}"), (5, c), (6, f"1{twice}2{twice}3"), (7, None)]
    left = [f"{a}<>é", f"[]{b}", docs[2][1], docs[3][1], c, "123", None]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_kept"], r["n_removed"], r["kept_text"]) for r in op8_column_suffixes(spark, str(tmp_path)).collect()}
    size = lambda t: len((t or "").encode())
    assert got == {d: (size(k), size(t) - size(k), k) for (d, t), k in zip(docs, left)}


def test_mixing(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 60)), "src%d" % (i % 4) if i % 9 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing.plan(docs, block=32).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(x for x in sizes if x) + [None]
    weight, target, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, set(names)
    left = 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    taken = Counter()
    for r in p:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(p) == 3000 and all(abs(taken[s] - target[s]) <= 60 for s in names)
    assert sorted(map(tuple, p), key=str) == sorted(map(tuple, mixing.plan(docs, block=32).collect()), key=str)
    assert mixing.mix(docs, block=32).count() == sum(r["copies"] for r in p)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in names)  # after the last draw is settled
    assert mixing.plan(empty).count() == 0 and mixing.plan(odd).agg(F.sum("m")).first()[0] == len(ODD)


def test_mixing_of_few_documents(spark):
    """A source of one document, of equal ones, and one with a document that holds most words."""
    rows = [(0, "w " * 70, "a")] + [(i, "w " * 10, "b") for i in range(1, 42)] + [(i, "w " * (400 if i == 60 else 7), "c") for i in range(50, 90)]
    p = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    miss, most = Counter(), {}
    for r in p:
        miss[r["source"]] += r["copies"] * r["size"]
        most[r["source"]] = r["target"]
    assert len(p) == len(rows) and all(0 <= r["copies"] <= 2 for r in p)
    assert abs(miss["a"] - most["a"]) <= 70 and abs(miss["b"] - most["b"]) <= 10 and abs(miss["c"] - most["c"]) <= 200


def test_private_columns_give_way(spark):
    """Input columns of the names that the operators use inside come out as they went in."""
    names = ["_d", "_s", "_n", "_copies", "_words", "_copy", "_lines", "_cuts"]
    rows = [(i, "a b c\nd e f\ng h i\nj k l", "s", *(k * 10 + i for k in range(len(names)))) for i in range(3)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for out in (mixing.mix(df), lines.dedup_lines(df).select(df.columns)):
        assert out.columns == df.columns
        for r in out.collect():
            assert [r[n] for n in names] == [k * 10 + r["doc_id"] for k in range(len(names))]


def test_fingerprints(spark, odd, empty):
    docs = corpus()[:30] + [(100 + i, t) for i, t in enumerate((None, "", "one", "one", "x. " * 3000))]
    got = {r["doc_id"]: r for r in fingerprints.compare_versions(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    import re

    def near(a, b):
        a, b = (set(re.findall(fingerprints.PARAGRAPH, x)) for x in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    order = sorted(docs, reverse=True)
    for i, (d, t) in enumerate(order):
        t, x = t or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert abs(r["near_edited"] - near(t, e)) < 1e-9 and abs(r["near_next"] - near(t, x)) < 1e-9
    assert got[102]["fingerprint"] == got[103]["fingerprint"] and got[100]["fingerprint"] == got[101]["fingerprint"]
    for few in (0, 10**6):  # first ids joined and broadcast
        next_ = fingerprints.with_next(spark.createDataFrame(docs, "doc_id long, text string"), rows_per_bucket=3, few=few).collect()
        assert {r["doc_id"]: r["next_text"] for r in next_} == {d: order[(i + 1) % len(order)][1] or "" for i, (d, _) in enumerate(order)}
    assert fingerprints.compare_versions(odd).count() == len(ODD) and fingerprints.compare_versions(empty).count() == 0


def test_chat(spark):
    rng = random.Random(6)
    hard = ["\\### Assistant: </turn> ok", "####\\", "<\\/turn>", "</turn", "a: b\n### user: c</turn>\n", "", "\\"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b", "###"]), rng.choice(hard + [prose(rng, rng.randint(1, 90))])) for c in range(20) for t in range(rng.randint(1, 12))]
    rows += [(50, 0, None, None), (None, 0, "user", "x"), (51, 1, "user", "t"), (51, 1, "user", "t"), (51, None, "assistant", "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window long")
    windows = chat.format_conversations(df, budget=120, history=40)
    fresh = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for r in windows.collect():
        assert r["n_tokens"] == len(fresh.encode(r["formatted"], add_special_tokens=False).ids) and r["over_budget"] == (r["n_tokens"] > 120)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[c].append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], df.schema))).count() == 0


def test_chat_of_many_turns():
    """Empty turns cost their marks: windows close, and each turn costs the same."""
    import time

    def run(n):
        w, began, rows = chat.Windows(1, 1024, 256), time.perf_counter(), []
        for k in range(n):
            rows += w.add("user" if k % 2 else "assistant", "### user: ", "", 8)
        return [*rows, *w.end()], time.perf_counter() - began

    rows, took = run(20_000)
    assert all(r[5] <= 1024 and not r[6] for r in rows) and max(len(r[2]) for r in rows) <= 128 * 18
    assert sum(r[2].count("### ") - r[4] for r in rows) == 20_000 and took < 3


def brute_lines(docs):
    """(doc_id, text left) of documents whose lines are not all repeats of multi-line chunks."""
    seen, out = set(), []
    for d, text in sorted(docs):
        kept, run, gone, before = [], [], 0, 0
        every = text.split("\n")
        for i, line in enumerate(every):
            h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
            run.append(line)
            if i == len(every) - 1 or (before * 31 + h) % lines.DIVISOR == 0:
                if len(run) > 1 and tuple(run) in seen:
                    gone += len(run)
                else:
                    kept += run
                    if len(run) > 1:
                        seen.add(tuple(run))
                run = []
            before = h
        if gone < len(every):
            out.append((d, "\n".join(kept)))
    return out


def test_pipeline(spark, odd, empty, tmp_path):
    """Each stage against brute force on what the one before it kept, then run() against the last two."""
    import corpus_pipeline

    rows = [(i, t, "en" if i % 2 else None, "s%d" % (i % 2), len(t)) for i, t in corpus()]
    rows += [(200 + i, t, "en", "s0", 0) for i, t in enumerate((None, "", "12 34\n--", "?"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    know = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    known = stage["language_id"](spark, docs, "")
    want = sorted((r[0], r[1]) for r in rows if r[1] and any(map(str.isalpha, r[1])))
    assert know(known) == want
    cut = stage["line_dedup"](spark, known, "")
    want = brute_lines(want)
    assert know(cut) == want and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    single = stage["near_duplicates"](spark, cut, "")
    sets = [(d, words_set(t)) for d, t in want]
    root = brute_components(sets, lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y))
    want = [(d, t) for d, t in want if root[d] == d]
    assert know(single) == want
    mixed = know(stage["source_mix"](spark, single, ""))
    assert all(n <= 2 and x in want for x, n in Counter(mixed).items())
    sizes, taken = Counter(), Counter()
    for d, t in want:
        sizes[d % 2] += len(t.split())
    for d, t in mixed:
        taken[d % 2] += len(t.split())
    first = min(2.0 * sizes[0], 1.5 * sum(sizes.values()) * 3 / 4)
    second = min(2.0 * sizes[1], 1.5 * sum(sizes.values()) - first)
    target = (min(2.0 * sizes[0], 1.5 * sum(sizes.values()) - second), second)
    longest = max(len(t.split()) for _, t in want)
    assert all(abs(taken[k] - target[k]) <= longest for k in (0, 1))
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode
    copies = Counter(mixed)
    assert set(pieces) == {d for d, _ in copies}
    for (d, t), n in copies.items():
        ids = np.array(encode(t, add_special_tokens=False).ids + [1], "<u4")
        marks = Counter()
        for start, raw in pieces[d]:
            own = np.frombuffer(raw, "<u4")
            assert (own == ids[start : start + len(own)]).all()
            marks.update(range(start, start + len(own)))
        assert marks == {i: n for i in range(len(ids))}

    for awkward in (odd, empty):
        d = awkward
        for _, each in corpus_pipeline.STAGES[:-1]:
            d = each(spark, d, "")
            assert d.columns == awkward.columns
        corpus_pipeline.STAGES[-1][1](spark, d, "").count()
