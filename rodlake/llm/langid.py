"""Language identification by error-correcting output codes.

Each language has a codeword; a linear classifier over hashed byte trigrams predicts
each bit. Decoding sums the logistic loss of a codeword's bits against the predicted
margins and takes the codeword with the least loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scored

#: Trigram buckets.
BUCKETS = 1 << 15
#: Languages that a model learns at most; more raise.
MOST_LANGUAGES = 1000
_WORDY = re.compile(r"[^\W\d_]+")
#: ASCII other than letters becomes a blank before trigrams are taken.
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray  # bits


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """Up to 7 classes: every dichotomy (distance 2^(k-2)); more: of 64 random codes that with the largest least distance."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 7:
        return np.array([[1 if (b >> i) & 1 else -1 for b in range(1, 1 << (k - 1))] if i < k - 1 else [-1] * ((1 << (k - 1)) - 1) for i in range(k)], np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], np.int8), (k, int(np.ceil(10 * np.log2(k)))))
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if apart > far:
            best, far = code, apart
    return best


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, padded with a blank at both ends."""
    x = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_BLANK) + b" ", np.uint8).astype(np.uint32)
    h = ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(17)).astype(np.int64)


def has_letter(text: str) -> bool:
    """Whether a character of the text is of the Unicode category L; fractions, circled and roman numbers are none."""
    return any(c.isalpha() for m in _WORDY.finditer(text) for c in m[0])


def profiles(rows: DataFrame, label: str, text: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, shares) of the whole text of each row: its distinct trigrams and how often each occurs, as shares. Made in the tasks."""

    def run(batches):
        for b in batches:
            made = []
            for t in b.column(1):
                g, n = np.unique(trigrams(t.as_py()), return_counts=True)
                made.append((g.astype(np.int32).tobytes(), (n / n.sum()).astype(np.float32).tobytes()))
            cols = list(zip(*made)) or [(), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())], names=["label", "buckets", "shares"])

    got = rows.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text")).mapInArrow(run, "label string, buckets binary, shares binary").collect()
    return [(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in sorted(got)]


def train(known: list[tuple[str, np.ndarray, np.ndarray]], rounds: int = 40) -> Model:
    """One logistic classifier a bit of the codewords, on (label, buckets, shares); each label weighs alike. Nothing known: a model without languages."""
    languages = sorted({k[0] for k in known})
    if not languages:
        return Model([], codewords(0), np.zeros((BUCKETS, 1), np.float32), np.zeros(1))
    code = codewords(len(languages))
    each = np.array([languages.index(k[0]) for k in known])
    y = code[each].astype(np.float32)
    weight = (1.0 / np.bincount(each) / len(languages))[each].astype(np.float32)[:, None]
    flat, share = np.concatenate([k[1] for k in known]), np.concatenate([k[2] for k in known])
    size = np.array([len(k[1]) for k in known])
    owner, at = np.repeat(np.arange(len(known)), size), np.concatenate([[0], np.cumsum(size)[:-1]])
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(rounds):  # AdaGrad on the logistic loss, all texts at once; a bit at a time, so that memory stays near that of the sample
        gw, gb = np.empty_like(w), np.empty_like(b)
        for j in range(code.shape[1]):
            f = np.add.reduceat(w[flat, j] * share, at) + b[j]
            g = -y[:, j] * weight[:, 0] / (1 + np.exp(np.clip(y[:, j] * f, -30, 30)))
            gw[:, j] = np.bincount(flat, g[owner] * share, BUCKETS)
            gb[j] = g.sum()
        sw += gw * gw
        sb += gb * gb
        w -= 2.0 * gw / np.sqrt(sw)
        b -= 0.1 * gb / np.sqrt(sb)
    return Model(languages, code, w, b)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_class: int = 400) -> Model:
    """Fit on a bounded sample of the labelled rows: about ``per_class`` rows a language, each with its whole text.

    Rows are chosen by a hash of key and text, so the sample is the same at every run;
    equal rows count once. Null labels, and texts that are null or have no letter, are left
    out. What reaches the driver of a row is its trigram profile, BUCKETS pairs at most.
    More than MOST_LANGUAGES labels raise ValueError. No labelled text: a model that
    calls every text ``und``.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in known.groupBy(label).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return train([])
    drawn = F.xxhash64(F.col(key), F.col(text))
    chance = F.create_map(*[F.lit(v) for k in sorted(counts) for v in (k, int(1_000_000 * min(1.0, per_class / counts[k])))])[F.col(label)]
    rows = known.select(F.col(label).alias("_label"), F.col(text).alias("_text"), drawn.alias("_drawn"), chance.alias("_chance")).where("pmod(_drawn, 1000000) < _chance")
    return train(profiles(rows.dropDuplicates(["_label", "_drawn"]), "_label", "_text"))


def decode(model: Model, margin: np.ndarray) -> tuple[str, float, bool]:
    """The language whose codeword has the least logistic loss, its share among all, and whether the runner-up is near."""
    if len(model.languages) == 1:
        return model.languages[0], 1.0, False
    loss = np.logaddexp(0, -model.code * margin).sum(axis=1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    order = np.argsort(-p, kind="stable")
    return model.languages[order[0]], float(p[order[0]]), bool(p[order[1]] > 0.5 * p[order[0]])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns) plus lang_pred, lang_score (0 to 1) and lang_ambiguous (the runner-up has over half its share).

    Null texts and texts without a letter are ``und`` with score 0; so is every text
    if no language was learned. Whole texts are read. Only the text is an input.
    Columns of the input named like an output are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "lang_score", "lang_ambiguous")]
    kind = pa.struct([("lang_pred", pa.string()), ("lang_score", pa.float64()), ("lang_ambiguous", pa.bool_())])

    def score(texts: pa.Array) -> pa.Array:
        w = np.ascontiguousarray(model.weights)
        found = []
        for t in texts:
            t = t.as_py()
            if not model.languages or not t or not has_letter(t):
                found.append(("und", 0.0, False))
                continue
            g = trigrams(t)
            total = sum(w[g[i : i + 200_000]].sum(axis=0, dtype=np.float64) for i in range(0, len(g), 200_000))
            found.append(decode(model, total / len(g) + model.bias))
        cols = list(zip(*found)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], fields=list(kind))

    return scored(docs, keep, F.col(text), score, "lang_pred string, lang_score double, lang_ambiguous boolean")


def remainder(doc: str, n: int):
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % n


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; learned from documents that are not held out.

    A document with a null id is neither held out nor learned from. Null texts and texts
    without a letter: ``und``, score 0. Repeated ids keep their rows; ties between
    codewords go to the first language in order; further columns are ignored. Empty
    table: no rows.
    """
    mod = remainder("doc_id", 4)
    model = fit(docs.where(mod != 2))
    held = docs.select("doc_id", F.coalesce(mod == 2, F.lit(False)).alias("held_out"), "text")
    out = predict(held, model, keep=["doc_id", "held_out"])
    return out.withColumnRenamed("lang_score", "score")
