"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A logistic model scores each sentence, a noisy-or
joins them: P(document) = 1 - prod(1 - p(sentence)). Only documents carry labels; the
gradient of the bag's likelihood tells which sentences the label is due to, and the
fitted model locates them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, save, scored
from .langid import remainder

_SENTENCE = re.compile(r"[^.!?\n]+")
#: Sentence ends become line feeds; other ASCII that is neither letter nor digit a blank.
_CUT = bytes(10 if c in b".!?\n" else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PREFIXES = (4, 5, 6)
#: Standard errors by which a feature's share in label-1 documents must exceed its share in the others.
SIGNIFICANT = 6.0
#: The largest bias: a sentence without a telling feature has a score of 0.0003 at most, so that long texts stay clean.
BIAS = -8.0
#: Distinct words whose weight a worker keeps.
CACHE = 500_000


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings of 4 to 6 bytes."""
    return [b"=" + word] + [word[:n] for n in PREFIXES if len(word) > n]


def sentences(text: str) -> list[bytes]:
    return [s for s in text.lower().encode("utf-8", "replace").translate(_CUT).split(b"\n") if s and not s.isspace()]


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def scorer(self):
        class Cache(dict):
            def __missing__(cache, word):
                if len(cache) > CACHE:
                    cache.clear()
                cache[word] = v = sum(self.weights.get(f, 0.0) for f in features(word))
                return v

        return Cache().__getitem__


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Bags:
    """Sentences as sums of features: entry e is feature ids[e] of sentence owner[e], sentence s belongs to document bag[s]."""

    ids: np.ndarray
    owner: np.ndarray
    bag: np.ndarray
    y: np.ndarray
    cost: np.ndarray  # weight of each document


def loss(bags: Bags, w: np.ndarray, b: float) -> float:
    """Negative log-likelihood of the noisy-or over documents."""
    clean = _clean(bags, w, b)[1]
    return float((bags.cost * np.where(bags.y == 1, -np.log(np.maximum(-np.expm1(clean), 1e-300)), -clean)).sum())


def _clean(bags: Bags, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's probability, and the logarithm of each document's probability to hold no offence."""
    p = np.minimum(_sigmoid(np.bincount(bags.owner, w[bags.ids], len(bags.bag)) + b), 1 - 1e-9)
    return p, np.bincount(bags.bag, np.log1p(-p), len(bags.y))


def gradient(bags: Bags, w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
    """Of ``loss``, by the features' weights and the bias."""
    p, log_clean = _clean(bags, w, b)
    clean = np.exp(log_clean)
    pull = bags.cost * np.where(bags.y == 1, -clean / np.maximum(1 - clean, 1e-6), 1.0)
    g = pull[bags.bag] * p
    return np.bincount(bags.ids, g[bags.owner], len(w)), float(g.sum())


def _sample(docs: DataFrame, labels: DataFrame, text: str, label: str, key: str, per_class: int) -> list[tuple[int, str]]:
    """About ``per_class`` rows (label, text) of each class with whole texts; equal rows count once.

    Labels are chosen first, by a hash of the key, so only the chosen few meet the
    texts; if ids repeat and more rows meet them, these are thinned by a hash of id and text.
    """
    million, mark = 1_000_000, lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_000))
    share = lambda n: F.when(F.col("_label") == 1, int(million * min(1, per_class / max(1, n.get(1, 0))))).otherwise(int(million * min(1, per_class / max(1, n.get(0, 0)))))
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).distinct()
    chosen = save(known.where(mark("_key") < share({r[0]: r[1] for r in known.groupBy("_label").count().collect()})), "toxic-labels")
    met = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()).join(lookup(chosen, 20 * per_class), "_key")
    n = {r[0]: r[1] for r in met.groupBy("_label").count().collect()}
    rows = met.withColumn("_drawn", F.xxhash64("_key", "_text")).where(F.pmod(F.xxhash64("_drawn"), F.lit(million)) < share(n))
    return sorted(tuple(r) for r in rows.dropDuplicates(["_label", "_drawn"]).select("_label", "_text").collect())


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", per_class: int = 1500, rounds: int = 120) -> Model:
    """Fit on a bounded sample: about ``per_class`` labelled rows of each class, whole texts.

    Null keys, labels and texts are left out; a document with both labels counts once
    for each. Without rows of both classes the model scores every text alike.
    """
    rows = _sample(docs, labels, text, label, key, per_class)
    y = np.array([r[0] for r in rows], np.float64)
    if len(set(y)) < 2:
        return Model({}, 20.0 if len(y) and y.all() else -20.0)
    # the features of one document at a time are held, besides their counts
    df: dict[bytes, list[int]] = {}
    for t, text_ in rows:
        for f in {f for w in {w for s in sentences(text_) for w in s.split()} for f in features(w)}:
            df.setdefault(f, [0, 0])[t] += 1
    n1, n0 = y.sum(), (1 - y).sum()
    # features that label-1 documents hold more often than chance explains; only they can raise a sentence's score
    vocab, odds = {}, []
    for f, (b, a) in sorted(df.items()):
        p = (a + b) / (n1 + n0)
        if a + b >= 3 and a / n1 - b / n0 > SIGNIFICANT * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)):
            vocab[f] = len(odds)
            odds.append(np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5)))
    del df
    ids, owner, bag_of = [], [], []
    for d, (_, text_) in enumerate(rows):
        for s in sentences(text_) or [b""]:
            k = [vocab[f] for w in s.split() for f in features(w) if f in vocab]
            ids.extend(k)
            owner.extend([len(bag_of)] * len(k))
            bag_of.append(d)
    bags = Bags(np.array(ids, np.int64), np.array(owner, np.int64), np.array(bag_of, np.int64), y, np.where(y == 1, 0.5 / n1, 0.5 / n0))
    w, b = np.maximum(np.array(odds), 0.0), BIAS
    sw, sb = np.full_like(w, 1e-6), 1e-6
    for _ in range(rounds):  # AdaGrad on the noisy-or likelihood
        gw, gb = gradient(bags, w, b)
        gw = gw + 1e-6 * w
        sw += gw * gw
        w = np.maximum(w - 0.3 * gw / np.sqrt(sw), 0)
        sb += gb * gb
        b = min(b - 0.2 * gb / np.sqrt(sb), BIAS)
    return Model({f: float(w[i]) for f, i in vocab.items() if abs(w[i]) > 0.05}, float(b))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, locate: float = 0.5) -> DataFrame:
    """``keep`` (default: all columns) plus toxic_score (0 to 1) and toxic_spans: array of (start, end, score).

    Spans are the sentences with a score of ``locate`` or more, in code points of the
    text, end exclusive. Null, empty and blank texts hold no sentence: score 0, no
    spans. Whole texts are read. Columns of the input named like an output are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("toxic_score", "toxic_spans")]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(texts: pa.Array) -> pa.Array:
        weight = model.scorer()
        idle = float(np.log1p(-_sigmoid(model.bias)))
        scores, spans = [], []
        for t in texts:
            t = t.as_py()
            clean, found = 0.0, []
            if t:
                for s in t.lower().encode("utf-8", "replace").translate(_CUT).split(b"\n"):
                    words = s.split()
                    if words:
                        v = sum(map(weight, words))
                        clean += idle if v == 0 else -float(np.logaddexp(0, v + model.bias))
                if 1 - np.exp(clean) >= locate:
                    for x in _SENTENCE.finditer(t):
                        v = sum(weight(w) for s in sentences(x[0]) for w in s.split())
                        if (p := float(_sigmoid(v + model.bias))) >= locate and x[0].strip():
                            found.append({"start": x.start(), "end": x.end(), "score": p})
            scores.append(float(-np.expm1(clean)))
            spans.append(found)
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, span)], names=["toxic_score", "toxic_spans"])

    return scored(docs, keep, F.col(text), score, "toxic_score double, toxic_spans array<struct<start:int,end:int,score:double>>")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document, plus the offending sentences.

    Learned from the labelled documents that are not held out; a document with
    several labels counts once for each, one with a null id never. Null, empty and blank
    texts: score 0, predicted 0. Repeated ids keep their rows; further columns are
    ignored. Empty documents: no rows; no labels: one score for all texts with words.
    """
    mod = remainder("doc_id", 3)
    model = fit(docs, labels.where(mod != 1))
    out = predict(docs.select("doc_id", F.coalesce(mod == 1, F.lit(False)).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"), "toxic_spans")
