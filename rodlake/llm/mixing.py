"""Mixing to target weights with soft domain membership. DataFrame operations only.

A naive Bayes classifier, fitted on all labelled rows, gives each document a posterior
over domains. Rates r >= 0 of documents are fitted by projected-gradient least squares,
so that sum over documents of rate * tokens * P(domain) is as near as can be to the
targets, starting from rate 1. Documents of equal posterior have equal rates at every
step, so the steps run on the table of distinct posteriors with their token totals.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, discard, lookup, save

_UPPER, _DIGITS, _MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!#$%&*+;<=>@^_~"
#: Upper ends of the bins of each feature.
BINS = {
    "bars": [0.0, 0.002, 0.01, 0.03, 0.06],
    "marks": [0.0, 0.002, 0.01, 0.04, 0.1],
    "upper": [0.005, 0.01, 0.02, 0.03, 0.05, 0.1, 0.3],
    "digits": [0.0, 0.005, 0.02, 0.05],
    "distinct": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "word": [3.0, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 9.0],
    "log_chars": [3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0],
}


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, plus n_tokens (words between white space) and bins (array<int>, one for each of BINS); null text: none."""
    t = F.coalesce(F.col(text), F.lit(""))
    chars = F.length(t)
    share = lambda out: (chars - F.length(out)) / F.greatest(chars, F.lit(1))
    words = F.filter(F.split(t, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    kept = [c for c in docs.columns if c != text]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], words.alias("_w"), chars.alias("_n"), share(F.replace(t, F.lit("|"))).alias("_bars"), share(F.translate(t, _MARKS, "")).alias("_marks"), share(F.translate(t, _UPPER, "")).alias("_upper"), share(F.translate(t, _DIGITS, "")).alias("_digits"))
    n = F.size("_w")
    value = {"bars": F.col("_bars"), "marks": F.col("_marks"), "upper": F.col("_upper"), "digits": F.col("_digits"), "distinct": F.size(F.array_distinct("_w")) / F.greatest(n, F.lit(1)), "word": F.col("_n") / F.greatest(n, F.lit(1)), "log_chars": F.log1p(F.col("_n"))}
    bins = F.array(*[sum((F.when(value[f] > e, 1).otherwise(0) for e in ends), F.lit(0)) for f, ends in BINS.items()])
    return given.select(*[F.col(f"`{c}`") for c in kept], n.cast("long").alias("n_tokens"), bins.alias("bins"))


def likelihood(known: DataFrame, domains: list[str]) -> Column:
    """array<double>: P(domain | bins) up to a factor, fitted on the rows (bins, domain) of ``known``: on all of them, by counts made in Spark."""
    prior = dict.fromkeys(domains, 1.0)
    for d, n in known.groupBy("domain").count().collect():
        prior[d] += n
    seen = known.select("domain", F.posexplode("bins").alias("f", "b")).groupBy("domain", "f", "b").count().collect()  # features x bins x domains at most
    count = {(d, f, b): n for d, f, b, n in seen}
    logs = []
    for d in domains:
        total = F.lit(log(prior[d] / sum(prior.values())))
        for f, ends in enumerate(BINS.values()):
            k = len(ends) + 1
            table = [log((count.get((d, f, b), 0) + 1.0) / (prior[d] - 1.0 + k)) for b in range(k)]
            total = total + F.element_at(F.array(*[F.lit(x) for x in table]), F.element_at("bins", f + 1) + 1)
        logs.append(total)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return F.transform(F.array(*logs), lambda x: F.exp(x - top))


def normalised(p: Column) -> Column:
    """p over its sum, rounded so that documents with the same bins surely share one value."""
    return F.transform(p, lambda x: F.round(x / F.aggregate(p, F.lit(0.0), lambda s, y: s + y), 9))


def rate(p: Column, steps: list[list[float]], start: Column | None = None) -> Column:
    """The rate after the steps: from ``start`` (default 1), each step subtracts p . step and cuts at 0."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    dot = lambda s: F.aggregate(F.zip_with(p, s, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return F.aggregate(table, start, lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


#: Rounds beyond which the fit cannot settle, and the lengths of step that are tried in each.
MOST, LENGTHS = 200, (1.0, 0.5, 0.25, 0.1, 0.03)


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """x of matrix x = right, by elimination; the matrix is symmetric and positive, as large as there are domains."""
    k, rows = len(right), [[*m, r] for m, r in zip(matrix, right)]
    for i in range(k):
        top = max(range(i, k), key=lambda j: abs(rows[j][i]))
        rows[i], rows[top] = rows[top], rows[i]
        for j in range(k):
            if j != i:
                f = rows[j][i] / rows[i][i]
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i])]
    return [rows[i][k] / rows[i][i] for i in range(k)]


def fit_rates(mass: DataFrame, target: list[float], tolerance: float = 1e-4) -> list[list[float]]:
    """Steps for ``rate``: projected gradient on sum over (p, tokens) of rate * tokens * p = target, weighted least squares.

    ``target``: tokens that each domain shall have. Squares are divided by each
    domain's row sum of the Gram matrix, which makes the plain gradient a safe step. Of
    it and of gradients scaled by the inverse Gram matrix of the rates above 0, at some
    lengths, a round takes the one that leaves the least squares. Stops when every sum is
    within ``tolerance`` of its target (as a share of the target), or when no step
    lowers the squares by a millionth: the targets can't be met then, and the rates are the
    nearest. Raises if neither comes. The rates stay in a table of distinct posteriors;
    what reaches the driver are sums, as many as pairs of domains.
    """
    k = len(target)
    total = mass.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return []
    p = [F.element_at("p", i + 1) for i in range(k)]
    sums = lambda r: [F.sum(r * F.col("tokens") * x) for x in p]
    gram = lambda held: [F.sum(F.when(held, F.col("tokens") * x * y).otherwise(0.0)) for x in p for y in p]
    off = lambda got: [(s or 0.0) - t for s, t in zip(got, target)]
    now, steps = mass.select("p", "tokens", F.lit(1.0).alias("r")), []
    first = now.agg(*sums(F.col("r")), *gram(F.lit(True))).first()
    curve = [sum(abs(first[k + i * k + j]) for j in range(k)) or 1.0 for i in range(k)]  # scaled by these row sums the largest eigenvalue is at most 1
    squares = lambda rest: sum(x * x / c for x, c in zip(rest, curve))
    rest, held = off(first[:k]), first[k:]
    for _ in range(MOST):
        if all(abs(x) <= tolerance * max(t, tolerance * total) for x, t in zip(rest, target)):
            return steps
        tried = [[x / c for x, c in zip(rest, curve)]]
        ridge = 1e-9 * max(curve)
        newton = _solved([[held[i * k + j] + (ridge if i == j else 0.0) for j in range(k)] for i in range(k)], rest)
        tried += [[a * x for x in newton] for a in LENGTHS]
        found = now.agg(*[s for t in tried for s in sums(rate(F.col("p"), [t], F.col("r")))]).first()
        left = [squares(off(found[i * k : i * k + k])) for i in range(len(tried))]
        best = min(range(len(tried)), key=lambda i: left[i])
        if not left[best] < squares(rest) * (1 - 1e-6):
            return steps
        steps.append(tried[best])
        new = save(now.select("p", "tokens", rate(F.col("p"), steps[-1:], F.col("r")).alias("r")), "mix-rates")
        discard(now)
        now = new
        got = now.agg(*sums(F.col("r")), *gram(F.col("r") > 0)).first()
        rest, held = off(got[:k]), got[k:]
    raise RuntimeError("rates did not settle")


def soft_mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text, plus n_tokens, domain (most likely), posterior (its probability), rate and copies.

    labelled: (doc, domain) rows; domains that are not in ``weights``, null domains and
    ids without a document are left out. ``weights``: the wanted share of tokens of
    each domain (they are scaled to sum 1). The fit aims at the largest total at which
    no domain needs more expected tokens than it has; then all rates are divided by the
    largest, which keeps the shares and makes every rate at most 1. copies =
    floor(rate + u) with u in [0, 1) from a hash of id and text: 0 or 1, with the rate
    as its mean. Null and empty texts have no tokens; their rate follows from
    their posterior like any other. Without labelled rows all rates are 1. Repeated
    ids keep their rows; equal rows get equal copies.
    """
    domains = sorted(weights)
    hashed = docs.withColumn("_u", F.pmod(F.xxhash64(F.col(doc), F.col(text)), F.lit(1 << 52)) / float(1 << 52))
    each = save(features(hashed, text), "mix-features")
    asked = labelled.select(F.col(doc).alias("_id"), F.col("domain").alias("domain")).where(F.col("domain").isin(domains))
    known = save(each.select(F.col(doc).alias("_id"), "bins").join(asked, "_id").select("bins", "domain"), "mix-known")
    if not known.limit(1).count():
        none = F.lit(None).cast("string")
        return each.drop("bins", "_u").withColumns({"domain": none, "posterior": F.lit(None).cast("double"), "rate": F.lit(1.0), "copies": F.lit(1).cast("long")})
    scored = save(each.withColumn("_raw", likelihood(known, domains)).withColumn("p", normalised(F.col("_raw"))).drop("bins", "_raw"), "mix-scored")
    mass = save(scored.groupBy("p").agg(F.sum("n_tokens").alias("tokens")), "mix-mass")
    have = mass.agg(*[F.sum(F.col("tokens") * F.element_at("p", i + 1)) for i in range(len(domains))]).first()
    want = [weights[d] / sum(weights.values()) for d in domains]
    budget = min((h or 0.0) / w for h, w in zip(have, want) if w > 0)
    steps = fit_rates(mass, [w * budget for w in want])
    most = mass.agg(F.max(rate(F.col("p"), steps))).first()[0] or 1.0
    best = F.array_max("p")
    out = scored.withColumn("domain", F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("p", best).cast("int"))).withColumn("posterior", best)
    out = out.withColumn("rate", rate(F.col("p"), steps) / F.lit(float(most)))
    return out.withColumn("copies", F.floor(F.col("rate") + F.col("_u"))).drop("p", "_u")


#: Wanted shares of tokens by the quality label.
WEIGHTS = {"high": 0.97, "low": 0.03}


def quality_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("domain"))


def mix_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, domain, posterior, rate, copies of each document, mixed to WEIGHTS by the quality labels.

    Nulls, empty texts, ties, repeated ids and empty tables as in ``soft_mix``; further columns are ignored.
    """
    return soft_mix(docs.select("doc_id", "text"), quality_domains(labels), WEIGHTS)


def mixed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a copy in the mix; all columns kept, whatever their names.

    Texts are not shuffled unless the dropped rows outgrow a broadcast. Null ids and
    texts are rows like any other; equal rows stay or go together. Empty table: no rows.
    """
    plan = soft_mix(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("gone")), quality_domains(labels), WEIGHTS)
    gone = lookup(save(plan.where("copies = 0").select("gone").distinct(), "mix-gone"), 1_000_000)
    plain, named = aside(docs)
    key = F.xxhash64(*[f"c{docs.columns.index(c)}" for c in ("doc_id", "text")])
    return named(plain.join(gone, key == F.col("gone"), "left_anti"))
