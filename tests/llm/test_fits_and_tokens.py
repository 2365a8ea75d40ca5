"""Whitening, token counts and vector codes against plain versions, and on odd tables."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rodlake.llm import lloyd, queries, tokens, whitening
from rodlake.llm.common import save

VECTORS = "vec_id long, embedding array<float>, label int, x string, k0 string, error long"


def vectors(rng, n, dims, kinds=None):
    base = rng.normal(size=(kinds or n, dims)).astype(np.float32)
    return [base[i % len(base)] for i in range(n)]


def rows_of(some, **odd):
    return [(i, v.tolist(), None if i % 5 == 0 else i % 3, "x", None, i) for i, v in enumerate(some)]


ODD = [
    (900, None, 1, None, None, 1), (901, [], 1, None, None, 1), (902, [1.0, None] + [0.0] * 6, 1, None, None, 1), (903, [math.nan] + [0.0] * 7, 1, None, None, 1),
    (904, [math.inf] + [0.0] * 7, None, None, None, 1), (905, [1.0] * 3, 1, None, None, 1), (None, [0.5] * 8, None, None, None, 1), (None, [0.5] * 8, None, None, None, 1),
    (906, [0.0] * 8, 2, None, None, 1), (0, [0.25] * 8, 2, None, None, 1), (0, [0.25] * 8, 2, None, None, 1),
]


# ---- 11 whitening -----------------------------------------------------------------------------------------------


def brute_whitening(some, components):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in some])
    n, s = len(x), x.sum(axis=0)
    c = (x - s // n) - (s % n) / n
    e, axes = np.linalg.eigh(c.T @ c / n)
    e, axes = e[::-1], axes[:, ::-1]
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s)) for r in x]
    return deviation, c @ axes[:, :components] / np.sqrt(e[:components]), e / e.sum()


@pytest.mark.parametrize("products", [4096, 10])
def test_whitened_vectors(spark, monkeypatch, products):
    monkeypatch.setattr(whitening, "PRODUCTS", products)
    some = vectors(np.random.default_rng(1), 300, 8)
    df = spark.createDataFrame(rows_of(some), VECTORS).repartition(5)
    out = whitening.whitened_rows(df, components=5).toPandas()
    deviation, want, explained = brute_whitening(some, 5)
    assert len(out) == 1500 and set(out.n) == {300} and out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-10
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-9
    assert out.groupby("vec_id").deviation.first().tolist() == deviation
    assert np.allclose(out.groupby("component").explained.first(), explained[:5], rtol=1e-9)


def test_identity_error_sees_a_wrong_whitening(spark):
    df = spark.createDataFrame([([float(i % 2 * 4 - 2), float(i % 3 - 1)],) for i in range(60)], "whitened array<double>")
    assert abs(whitening.identity_error(df, 60, 2) - 3) < 1e-12  # the first column's variance is 4


def test_deviation_beyond_a_long(spark):
    df = save(spark.createDataFrame([(1, [0, 5]), (2, [1 << 40, 7]), (3, [2, 9])], "vec_id long, x array<long>"))
    model = whitening.fit(df, 2)
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, model, 2, ["vec_id"]).collect()}
    s = [(1 << 40) + 2, 21]
    want = {i: sum((3 * v - t) ** 2 for v, t in zip(x, s)) for i, x in ((1, [0, 5]), (2, [1 << 40, 7]), (3, [2, 9]))}
    assert got == {i: v if v < 1 << 63 else None for i, v in want.items()} and None in got.values()


def test_whitening_of_odd_tables(spark):
    some = vectors(np.random.default_rng(2), 60, 8)
    out = whitening.whitened_rows(spark.createDataFrame(rows_of(some) + ODD, VECTORS)).toPandas()
    assert set(out.component) == set(range(1, 9)) and set(out.n) == {65}
    assert out.vec_id.isna().sum() == 16 and (out.vec_id == 0).sum() == 24 and not out.vec_id.isin(range(900, 906)).any()
    deviation, want, _ = brute_whitening([*some, *([[0.5] * 8] * 2), [0.0] * 8, *([[0.25] * 8] * 2)], 8)
    assert sorted(out[out.component == 1].deviation) == sorted(deviation) and out.identity_error[0] < 1e-10
    equal = whitening.whitened_rows(spark.createDataFrame([(i, [1.0, 2.0], None, None, None, 1) for i in range(4)], VECTORS)).collect()
    assert len(equal) == 8 and all(r.whitened is None and r.explained == 0 and r.identity_error == 0 and r.deviation == 0 for r in equal)
    # two of three dimensions move together: the third component has no variance
    flat = whitening.whitened_rows(spark.createDataFrame([(i, [float(i), float(i), float(i * i % 5)], None, None, None, 1) for i in range(9)], VECTORS)).toPandas()
    assert flat[flat.component == 3].whitened.isna().all() and flat[flat.component < 3].whitened.notna().all() and flat.identity_error[0] < 1e-9
    for none in ([], ODD[:5]):
        empty = whitening.whitened_rows(spark.createDataFrame(none, VECTORS))
        assert empty.columns == out.columns.tolist() and empty.count() == 0


# ---- 12 token counts --------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "plain words here", "plain words here", "PLAIN  words here", "a <|endoftext|> inside", "<|ENDOFTEXT|>", "ÄÖ ñandú 漢字 \U0001f600\n\n\tx", "don't 123,456", "\x00 odd   blanks  ", "é é"]


def plain_count(name, text):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        import tokenizers

        return len(tokenizers.Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)
    import sentencepiece

    return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéß漢1'") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_match_the_library(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(tokens, "COPIES", 2)
    rng = random.Random(3)
    texts = TEXTS + [prose(rng, 200) for _ in range(20)] + ["copy of one text"] * 9
    data = [(i if i % 7 else None, t, "x", b"d", 4) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, key string, digest binary, n_tokens long").repartition(3)
    read, cache = tokens.Tokenizer.read(public_tokenizers.path(name)), str(tmp_path)
    want = sorted((str(d), len((t or "").encode()), plain_count(name, t)) for d, t, *_ in data)
    for _ in range(2):
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.token_counts(docs, read, cache).collect()) == want
    kept = spark.read.parquet(f"{cache}/tokenizer={read.version}")
    contents = len({t or "" for t in texts})
    assert kept.count() == kept.select("digest").distinct().count() <= contents
    if name == "byte_bpe_50k.json":
        assert kept.count() == contents
    if name == "word_bpe_49k.json":
        assert kept.count() < contents  # one normal form for some texts


def test_stored_counts_are_used(spark, tmp_path):
    """What the cache has is not encoded again; only new contents are appended; another version has counts of its own."""
    read, cache = tokens.Tokenizer.read(public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path)
    schema, version = "doc_id long, text string", read.version
    digest = hashlib.sha256(b"known").digest()
    spark.createDataFrame([(digest, 77), (digest, 77)], "digest binary, n_tokens long").write.parquet(f"{cache}/tokenizer={version}")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame([(1, "known"), (2, "new one"), (3, "new one")], schema), read, cache).collect()}
    assert got == {1: 77, 2: 2, 3: 2}
    assert spark.read.parquet(f"{cache}/tokenizer={version}").count() == 3
    other = tokens.Tokenizer(read.kind, read.blob + b"\n")
    assert other.version != version
    assert tokens.token_counts(spark.createDataFrame([(1, "known")], schema), other, cache).first().n_tokens == 1


def test_long_texts_are_cut_where_no_token_changes(monkeypatch):
    read, rng = tokens.Tokenizer.read(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    texts = ["".join(rng.choice(["word", " ", "  ", "\n", "don't", "漢字", "12", "<|endoftext|>", "!?", "\t", "é"]) for _ in range(2000)) for _ in range(10)] + ["x" * 5000, ""]
    want = [plain_count("byte_bpe_50k.json", t) for t in texts]
    monkeypatch.setattr(tokens, "CHARACTERS", 64)
    assert all("".join(tokens.pieces(t, 64)) == t for t in texts) and sum(1 for _ in tokens.pieces(texts[0], 64)) > 5
    assert tokens._counter.__wrapped__(read)(texts) == want


def test_token_counts_of_odd_tables(spark, tmp_path):
    read, cache = tokens.Tokenizer.read(public_tokenizers.path("byte_bpe_50k.json")), str(tmp_path)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.limit_report(none, read, cache).collect() == [] and not list(tmp_path.iterdir())
    long = "many words " * 30_000
    docs = spark.createDataFrame([(1, long), (1, long), (None, None), (None, None), (2, "x")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.limit_report(docs, read, cache).collect())
    n = plain_count("byte_bpe_50k.json", long)
    assert got == sorted([("1", len(long), n, True)] * 2 + [("None", 0, 0, False)] * 2 + [("2", 1, 1, False)])
    with pytest.raises(ValueError):
        tokens.Tokenizer.read(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_query_counts_every_document(spark, tables):
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    out = queries.op12_tokens(spark, tables).collect()
    assert len(out) == len(docs)
    for r in out:
        n = len(plain.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


# ---- 13 vector codes --------------------------------------------------------------------------------------------


def brute_codes(ids, labels, some, entries, rounds, parts=4, scale=1024):
    x = np.array([[math.floor(scale * float(c)) for c in v] for v in some], dtype=object)
    width = x.shape[1] // parts
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, x[i].tolist()))
    books = [[list(x[i][p * width : (p + 1) * width]) for i in order[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for at in range(rounds + 1):
        found = [[nearest(r[p * width : (p + 1) * width], books[p]) for p in range(parts)] for r in x]
        if at == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                own = [r[p * width : (p + 1) * width] for r, f in zip(x, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for label, e in zip(labels, error):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, total[label], digest) for i, f, e, label in zip(ids, found, error, labels))


def told(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("kinds, scale", [(None, 1024), (25, 1024), (None, 1)])
def test_codes_match_brute_force(spark, kinds, scale):
    """Distinct vectors, copies among the first entries (ties everywhere), and coarse integers (ties of distances)."""
    some = vectors(np.random.default_rng(5), 160, 8, kinds)
    data = rows_of(some)
    df = spark.createDataFrame(data, VECTORS).repartition(5)
    assert told(lloyd.compressed(df, entries=16, scale=scale)) == brute_codes([r[0] for r in data], [r[2] for r in data], some, 16, 4, scale=scale)


def test_bounds_save_scans_and_hold(spark):
    """Far fewer full scans than rows times parts after the first round, and the bounds are true ones."""
    rng = np.random.default_rng(6)
    some = (rng.normal(size=(12, 8))[rng.integers(0, 12, 600)] * 5 + rng.normal(size=(600, 8)) * 0.05).astype(np.float32)
    rows = spark.createDataFrame([(i, None, [math.floor(1024 * float(c)) for c in v]) for i, v in enumerate(some)], "k0 long, k1 int, x array<int>")
    first = np.array([r.x for r in rows.orderBy("k0").limit(16).collect()], np.int64)
    state, books, scans = lloyd.fit(rows, 2, [first[:, p * 2 : p * 2 + 2].copy() for p in range(4)], 4)
    assert scans[0] == 2400 and all(s < 1500 for s in scans[1:]) and scans[-1] < 600
    for r in state.collect():
        for p in range(4):
            d = np.sqrt(lloyd.squared(np.array([r.x[p * 2 : p * 2 + 2]]), books[p])[0].astype(float))
            assert d[r.code[p]] <= r.upper[p] and np.delete(d, r.code[p]).min() >= r.lower[p] and d.argmin() == r.code[p]


def test_distances_are_exact():
    rng = np.random.default_rng(7)
    for top in (1000, 1 << 26):
        x, e = rng.integers(-top, top, (50, 16)), rng.integers(-top, top, (9, 16))
        assert lloyd.squared(x, e).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in e] for v in x]


def test_codes_of_odd_tables(spark, monkeypatch):
    some = vectors(np.random.default_rng(8), 40, 8)
    data = rows_of(some)
    kept = [r for r in data + ODD if r[1] and len(r[1]) == 8 and all(c is not None and math.isfinite(c) for c in r[1])]
    want = brute_codes([r[0] for r in kept], [r[2] for r in kept], [r[1] for r in kept], 256, 4)
    assert told(lloyd.compressed(spark.createDataFrame(data + ODD, VECTORS))) == want
    monkeypatch.setattr(lloyd, "within", lambda df, n: False)  # too many labels for a broadcast
    monkeypatch.setattr(lloyd, "crowded", lambda df, key, per: __import__("rodlake.llm.common", fromlist=["crowded"]).crowded(df, key, 5))
    assert told(lloyd.compressed(spark.createDataFrame(data + ODD, VECTORS))) == want
    odd_width = [(i, v.tolist()[:6], None, None, None, 1) for i, v in enumerate(some)]
    padded = [r[1] + [0.0, 0.0] for r in odd_width]
    assert told(lloyd.compressed(spark.createDataFrame(odd_width, VECTORS), entries=8)) == brute_codes([r[0] for r in odd_width], [None] * 40, padded, 8, 4)
    for none in ([], ODD[:5]):
        empty = lloyd.compressed(spark.createDataFrame(none, VECTORS))
        assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
