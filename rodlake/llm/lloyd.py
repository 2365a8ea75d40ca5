"""Vector code compression: product codes from Hamerly's form of Lloyd's rounds, in integers.

A row carries, for each part of its vector, its entry, an upper bound of the distance to
it and a lower bound of the distance to the nearest other entry. The bounds are kept in a
table between rounds. Where the upper one is strictly below the lower one, or below half
the distance of the entry to its nearest neighbour, the entry stays the only nearest one;
elsewhere the distances to all entries are computed in integers, and the lower index wins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crowded, discard, floored, matrix, salted, same_length, save, within

#: Largest integer component: squared distances of parts of up to 128 components fit a long.
BOUND = 1 << 27
#: Bounds are widened by this, far more than rounding takes.
SLACK = 1e-12
#: Rows whose distances to all entries are held at once.
ROWS = 4096


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) exact squared distances of integer vectors: a matrix product of doubles where none can round, else in longs."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if x.shape[1] * (2 * top) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def own_squared(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((x - entries[code]) ** 2).sum(axis=1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index), an upper bound of its distance, a lower bound of the second nearest's."""
    code, upper, lower = np.zeros(len(x), np.int32), np.zeros(len(x)), np.full(len(x), np.inf)
    for at in range(0, len(x), ROWS):
        d = squared(x[at : at + ROWS], entries)
        rows, best = np.arange(len(d)), d.argmin(axis=1)
        code[at : at + ROWS], upper[at : at + ROWS] = best, np.sqrt(d[rows, best]) * (1 + SLACK)
        if len(entries) > 1:
            d = d.astype(np.float64)
            d[rows, best] = np.inf
            lower[at : at + ROWS] = np.sqrt(d.min(axis=1)) * (1 - SLACK)
    return code, upper, lower


def half_gaps(entries: np.ndarray) -> np.ndarray:
    """For each entry, at most half the distance to its nearest neighbour."""
    d = squared(entries, entries).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(axis=1)) / 2 * (1 - SLACK)


def moves(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, at least how far it moved, and how far the farthest of the others moved."""
    own = np.sqrt(((after - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
    order = np.sort(own)
    others = np.where(own == order[-1], order[-2] if len(own) > 1 else 0.0, order[-1])
    if len(own) > 1 and order[-1] == order[-2]:
        others[:] = order[-1]
    return own, others


def settle(x: np.ndarray, entries: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Mend the arrays in place, whose bounds hold for ``entries``; how many rows took the full scan."""
    bound = np.maximum(lower, half_gaps(entries)[code])
    at = np.flatnonzero(~(upper < bound))
    upper[at] = np.sqrt(own_squared(x[at], entries, code[at])) * (1 + SLACK)
    at = at[~(upper[at] < bound[at])]
    if len(at):
        code[at], upper[at], lower[at] = scan(x[at], entries)
    return len(at)


def assigned(state: DataFrame, keep: int, books: list[np.ndarray], moved: list[tuple[np.ndarray, np.ndarray]] | None) -> DataFrame:
    """``state`` with the nearest entries of ``books``. Columns k0..., x, and from the second round on code, upper, lower; ``moved`` is then how far the entries moved since."""
    parts, width = len(books), books[0].shape[1]
    names = [*[f"k{i}" for i in range(keep)], "x", "code", "upper", "lower", "scanned"]

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * parts), pa.array(a.ravel()))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(keep), parts * width).astype(np.int64)
            if moved is None:
                code, upper, lower = np.zeros((len(x), parts), np.int32), np.zeros((len(x), parts)), np.zeros((len(x), parts))
            else:
                code, upper, lower = (matrix(b.column(keep + 1 + i), parts).copy() for i in range(3))
            scanned = np.zeros(len(x), np.int64)
            for p, entries in enumerate(books):
                part, c, u, low = x[:, p * width : (p + 1) * width], code[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                if moved is None:
                    c, u, low = scan(part, entries)
                    scanned[0] += len(part)
                else:
                    own, others = moved[p]
                    u, low = (u + own[c]) * (1 + SLACK), low - others[c]
                    low -= np.abs(low) * SLACK
                    scanned[0] += settle(part, entries, c, u, low)
                code[:, p], upper[:, p], lower[:, p] = c, u, low
            yield pa.RecordBatch.from_arrays([*b.columns[: keep + 1], lists(code), lists(upper), lists(lower), pa.array(scanned)], names=names)

    kinds = ", ".join(f"{n} {state.schema[n].dataType.simpleString()}" for n in names[: keep + 1])
    return state.mapInArrow(run, f"{kinds}, code array<int>, upper array<double>, lower array<double>, scanned long")


def tallied(state: DataFrame, books: list[np.ndarray]) -> list:
    """(part, entry, n, sums...) of the vectors at each entry: each task sums its own, Spark adds these up. At most as many rows as entries."""
    parts, width = len(books), books[0].shape[1]
    sums = [f"s{i}" for i in range(width)]

    def run(batches):
        n = [np.zeros(len(e), np.int64) for e in books]
        total = [np.zeros(e.shape, np.int64) for e in books]
        for b in batches:
            if not b.num_rows:
                continue
            x, code = matrix(b.column(0), parts * width), matrix(b.column(1), parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, first = np.unique(code[order, p], return_index=True)
                total[p][used] += np.add.reduceat(x[order, p * width : (p + 1) * width].astype(np.int64), first, axis=0)
                n[p] += np.bincount(code[:, p], minlength=len(n[p]))
        for p in range(parts):
            used = np.flatnonzero(n[p])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[p][used]), *(pa.array(total[p][used, i]) for i in range(width))], names=["part", "entry", "n", *sums]
                )

    each = state.select("x", "code").mapInArrow(run, ", ".join(["part int, entry int, n long", *(f"{s} long" for s in sums)]))
    return each.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *sums)]).collect()


def fit(rows: DataFrame, keep: int, books: list[np.ndarray], rounds: int) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """Rows with their final codes, the codebooks, and how many (row, part) scans each assignment took."""
    state, moved, scans = rows, None, []
    for at in range(rounds + 1):
        last = state
        state = save(assigned(last, keep, books, moved), "vq-state")
        scans.append(state.agg(F.sum("scanned")).first()[0])
        if at:
            discard(last)
        if at == rounds:
            return state, books, scans
        after = [b.copy() for b in books]
        for part, entry, n, *sums in tallied(state, books):
            after[part][entry] = [s // n for s in sums]
        moved = [moves(a, b) for a, b in zip(books, after)]
        books = after


def sum_over(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its ``group``, nulls together. Groups are summed in tasks first; a group of many rows is dealt over several tasks."""
    key = F.to_json(F.struct(F.col(group).alias("v")))  # a null value has no field, so it clashes with none
    keyed = save(df.withColumns({"_key": key, "_salt": F.monotonically_increasing_id()}), "vq-keyed")
    sums = save(keyed.groupBy("_key").agg(F.sum(value).alias(name)), "vq-sums")
    if within(sums, 200_000):
        return keyed.join(F.broadcast(sums), "_key").drop("_key", "_salt")
    return salted(keyed, sums, "_key", crowded(keyed, "_key", 50_000), F.col("_salt")).drop("_key", "_salt")


def compressed(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024
) -> DataFrame:
    """One row per vector kept: key, code (an index per part, in hex), error, label_error, codebooks_sha256.

    Components become floor(``scale`` * component). A part's codebook starts as that part of the
    vectors with the smallest keys (nulls last, equal keys by vector), fewer if there are fewer
    vectors; an entry without parts stays as it is. Vectors that are null, empty, or hold null or
    non-finite components (or components whose integer is beyond 2^27) are dropped, as are those of
    another length than most; lengths that ``parts`` doesn't divide are filled up with zeros.
    Repeated and null keys keep their rows. Labels of any type; null labels are one group. Further
    columns are ignored. Empty table, or no vector left: no rows.
    """
    spark = vectors.sparkSession
    # the order of the state's columns: k0 the key, k1 the label, x
    rows = save(vectors.select(F.col(key).alias("k0"), F.col(label).alias("k1"), floored(F.col(embedding), scale, BOUND).cast("array<int>").alias("x")).where("x is not null"), "vq-rows")
    kept, dims = same_length(rows, "x")
    if not dims:
        kind = vectors.schema[key].dataType.simpleString()
        return spark.createDataFrame([], f"`{key}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    if dims % parts:
        kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0), parts - dims % parts)))
    width = -(-dims // parts)
    first = np.array([r.x for r in kept.select("k0", "x").orderBy(F.col("k0").asc_nulls_last(), "x").limit(entries).collect()], np.int64)
    books = [first[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    state, books, _ = fit(kept, 2, books, rounds)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    out = sum_over(finished(state, books), "k1", "error", "label_error")
    return out.select(F.col("k0").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def finished(state: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """k0, k1, the code in hex and the squared distance to its entries, summed over parts."""
    parts, width = len(books), books[0].shape[1]
    digits = max(2, len(f"{len(books[0]) - 1:x}"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, code = matrix(b.column(2), parts * width).astype(np.int64), matrix(b.column(3), parts)
            error = sum(own_squared(x[:, p * width : (p + 1) * width], e, code[:, p]) for p, e in enumerate(books))
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text), pa.array(error)], names=["k0", "k1", "code", "error"])

    kinds = ", ".join(f"{n} {state.schema[n].dataType.simpleString()}" for n in ("k0", "k1"))
    return state.select("k0", "k1", "x", "code").mapInArrow(run, f"{kinds}, code string, error long")


def _sql(entries: int = 256, rounds: int = 4) -> str:
    """DuckDB SQL of ``compressed``: every round computes all distances."""
    nearest = """a{r} as (select vec_id, label, p, x, arg_min(b.e, (d, b.e)) as e, min(d) as d from
    (select v.vec_id, v.label, v.p, v.x, b.e, list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, b.c) + list_dot_product(b.c, b.c) as d from v join b{r} b on v.p = b.p) b group by all)"""
    update = """b{s} as (select b.p, b.e, coalesce(m.c, b.c) as c from b{r} b left join
    (select p, e, list(v order by k) as c from (select p, e, k, floor(sum(x[k]) / count(*)) as v from a{r}, range(1, 17) t(k) group by p, e, k) group by p, e) m on m.p = b.p and m.e = b.e)"""
    steps = [nearest.format(r=0)]
    for r in range(rounds):
        steps += [update.format(r=r, s=r + 1), nearest.format(r=r + 1)]
    return f"""
with w as (select vec_id, label, list_transform(embedding, lambda c: floor(1024 * cast(c as double))) as x from embeddings
    where embedding is not null and not list_bool_or(list_transform(embedding, lambda c: c is null or isnan(c) or isinf(c)))),
v as (select vec_id, label, p, x[16 * p + 1 : 16 * p + 16] as x from w, range(0, 4) t(p)),
b0 as (select p, row_number() over (partition by p order by vec_id) - 1 as e, x as c from v qualify e < {entries}),
{", ".join(steps)},
o as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from a{rounds} group by vec_id, label),
h as (select sha256(string_agg(s, ',' order by p, e)) as codebooks_sha256 from (select p, e, array_to_string(list_transform(c, lambda y: cast(cast(y as bigint) as varchar)), ',') as s from b{rounds}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from o, h
"""


SQL = _sql()
