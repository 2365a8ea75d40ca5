"""Embedding near-duplicates by a pivot-permutation index.

Pivots are a bounded sample of the vectors. Each vector is described by its nearest
pivots in order and entered in the inverted list of each. Vectors that share at least
SHARED pivots are candidates; each candidate pair is taken in the list of one pivot
only, the first that both share, and verified in double precision.

The exact way (``complete``): a vector is at home in the list of its nearest pivot and a
guest in every list that may hold a partner. By the triangle inequality of angles a
partner's home is at most twice the greatest angle farther than the vector's own, and
at most that angle beyond the farthest vector at home there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import merge
from .common import HOT, crowded, discard, lookup, salted, save
from .components import connected_components

#: Pivots grow with the square root of the distinct vectors, from LEAST_PIVOTS on; their matrix, which is broadcast, has PIVOT_BYTES at most.
LEAST_PIVOTS, PIVOT_BYTES = 16, 32 << 20
#: Pivots that describe a vector, and how many of them a candidate pair must share.
NEAREST, SHARED = 10, 2
#: Members of an inverted list that meet in one block; longer lists are dealt over all pairs of blocks.
BLOCK = 4096


def _matrix(column, dims: int) -> np.ndarray:
    """(rows, dims) float64 of a list column, short rows filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(ends), dims))
    out[np.repeat(np.arange(len(ends)), ends), np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _sound(x, kind: str):
    """The vector with -0.0 as 0.0; null if it is null, empty or zero, or holds a null or non-finite component."""
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(x, lambda v: v + F.lit(0.0).cast(kind)))


def cosine_components(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95, complete: bool = False) -> DataFrame:
    """One row for each input row: key, n_links (other rows linked directly), component_id, kept (key = component_id).

    Rows link if the cosine of their vectors, in double precision, is ``least`` or
    more and the index finds the pair (equal vectors always; see the README for the
    recall). ``complete``: every pair is found, at a cost that grows towards all pairs
    where vectors have no nearby pivot. component_id is the smallest key reachable by links, itself included.
    Null and zero vectors, and vectors with null, NaN or infinite components, link
    with nothing; neither do vectors of different lengths. Equal vectors are one
    vertex with a weight. Components may be float or double. Repeated keys keep their rows; a null key is never a
    component_id unless its component has no other. No pair is emitted: a block
    returns link counts and a spanning star. Further columns are ignored. Empty table: no rows.
    """
    kind = "float" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "double"
    real = np.float32 if kind == "float" else np.float64
    rows = vectors.select(F.col(key).alias("key"), _sound(F.col(embedding).cast(f"array<{kind}>"), kind).alias("x"))
    rows = rows.withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("x")))
    unique = save(rows.where("x is not null").groupBy("node").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max(F.size("x")).alias("dims")), "pv-unique")
    rows = save(rows.select("key", "node").withColumn("row", F.monotonically_increasing_id()), "pv-rows")
    total, dims = unique.agg(F.count(F.lit(1)), F.max("dims")).first()
    if not total:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.coalesce(F.col("key").isNotNull(), F.lit(False)).alias("kept"))
    count = int(min(max(LEAST_PIVOTS, PIVOT_BYTES // (8 * dims)), max(LEAST_PIVOTS, 2 * total**0.5), total))
    chosen = unique.select(F.xxhash64("node", F.lit("pivot")).alias("h"), "x").orderBy("h", "x").limit(count).select("x").toArrow()
    matrix = unique.sparkSession.sparkContext.broadcast(_units(_matrix(chosen.column(0), dims)))
    nearest = 1 if complete else min(NEAREST, len(chosen))
    theta = float(np.arccos(np.clip(least, -1, 1))) + 1e-6

    def angles(column) -> np.ndarray:
        return np.arccos(np.clip(_units(_matrix(column, dims)) @ matrix.value.T, -1, 1))

    def describe(batches):
        pivots = matrix.value.astype(np.float32)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                if complete:
                    near = -angles(part.column(1))
                else:
                    near = _units(_matrix(part.column(1), dims)).astype(np.float32) @ pivots.T
                at = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
                at = np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * nearest), pa.array(at.ravel()))
                far = -np.take_along_axis(near, at[:, :1], 1)[:, 0].astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(far)], names=["node", "x", "n", "perm", "far"])

    described = save(unique.select("node", "x", "n").mapInArrow(describe, f"node long, x array<{kind}>, n long, perm array<int>, far double"), "pv-perm")
    entered = described.select(F.explode("perm").alias("p"), "node", "x", "n", "perm")
    if complete:
        reach = np.full(len(chosen), -np.inf)
        for p, far in described.groupBy(F.element_at("perm", 1)).agg(F.max("far")).collect():  # a row a pivot
            reach[p] = far

        def guests(batches):
            for b in batches:
                for i in range(0, b.num_rows, 2048):
                    part = b.slice(i, 2048)
                    far, home = part.column(4).to_numpy(), part.column(3).flatten().to_numpy()
                    row, p = np.nonzero(angles(part.column(1)) <= np.minimum(far[:, None] + 2 * theta, reach + theta))
                    ok = p != home[row]
                    row, p = np.concatenate([np.arange(len(home)), row[ok]]), np.concatenate([home, p[ok]])
                    for j in range(0, len(row), 4096):
                        took = part.take(pa.array(row[j : j + 4096]))
                        yield pa.RecordBatch.from_arrays([pa.array(p[j : j + 4096].astype(np.int32)), *took.columns[:4]], names=["p", "node", "x", "n", "perm"])

        entered = described.mapInArrow(guests, f"p int, node long, x array<{kind}>, n long, perm array<int>")
    # as many rows as pivots
    many = save(entered.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("many")).where("many > 1"), "pv-many")
    member = entered.join(lookup(many, 10_000_000), "p", "left").withColumn("many", F.coalesce("many", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("many")).cast("int"))
    pair = F.expr("transform(sequence(0, many - 1), k -> named_struct('i', least(k, mine), 'j', greatest(k, mine)))")
    member = member.withColumn("pair", F.explode(pair)).select("p", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "mine", "node", "x", "n", "perm")

    def compare(batches):
        # rows come sorted by block, so one block is held at a time
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy() for c in range(3)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for s, e in zip(cuts, [*cuts[1:], len(keys)]):
                if (unit := tuple(keys[s].tolist())) != now:
                    if held:
                        yield block(now, held)
                    now, held = unit, []
                held.append(b.slice(s, e - s))
        if held:
            yield block(now, held)

    def block(unit: tuple, held: list) -> pa.RecordBatch:
        p, i, j = unit
        mine, node, n = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (3, 4, 6))
        x = np.concatenate([_matrix(h.column(5), dims).astype(real) for h in held])
        width = np.concatenate([np.diff(h.column(5).offsets.to_numpy()) for h in held])
        perm = np.concatenate([h.column(7).flatten().to_numpy().reshape(-1, nearest) for h in held])
        exact = _units(x.astype(np.float64))
        unit_ = exact.astype(np.float32)
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for at in range(0, len(node), 1024):
            a, b = np.nonzero(unit_[at : at + 1024] @ unit_.T > least - 1e-4)
            a += at
            ok = (a < b) & (width[a] == width[b])
            if i != j:
                ok &= mine[a] != mine[b]
            a, b = a[ok], b[ok]
            for c in range(0, len(a), 100_000):
                u, v = a[c : c + 100_000], b[c : c + 100_000]
                if complete:
                    ok = np.minimum(perm[u, 0], perm[v, 0]) == p  # both lists of home hold the pair
                else:
                    same = perm[u][:, :, None] == perm[v][:, None, :]
                    both = same.any(axis=2)
                    ok = (both.sum(axis=1) >= min(SHARED, nearest)) & (np.where(both, perm[u], np.iinfo(np.int32).max).min(axis=1) == p)
                u, v = u[ok], v[ok]
                ok = np.einsum("ij,ij->i", exact[u], exact[v]) >= least
                u, v = u[ok], v[ok]
                np.add.at(links, u, n[v])
                np.add.at(links, v, n[u])
                merge(label, u, v)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]]), pa.array(links[some])], names=["src", "dst", "links"])

    tasks = max(12, total * (nearest if not complete else NEAREST) // 50_000)
    found = save(member.repartition(tasks, F.xxhash64("p", "i", "j")).sortWithinPartitions("p", "i", "j").mapInArrow(compare, "src long, dst long, links long"), "pv-found")
    linked = save(connected_components(found.select("src", "dst")), "pv-linked")
    counts = found.groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    held = save(linked.join(unique.select("node", "least"), "node"), "pv-held")
    named = save(held.join(held.groupBy("component").agg(F.min("least").alias("smallest")), "component").select("node", "smallest"), "pv-named")
    final = unique.select("node", "n", "least").join(counts, "node", "left").join(named, "node", "left")
    final = save(final.select("node", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("smallest", "least").alias("smallest")), "pv-final")
    discard(unique, described, many, found, linked, held, named)
    matrix.unpersist()
    # rows without a vector match nothing and a popular one many: both are dealt over several tasks
    out = salted(rows, final, "node", crowded(rows.where("node is not null"), "node", HOT), F.col("row"), "left").select(F.col("key").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where e is not null and not list_bool_or(list_transform(e, lambda x: x is null or isnan(x) or isinf(x)))),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r as (select vec_id as n, vec_id as c from v union select l.b, r.c from r join l on r.n = l.a),
k as (select n, min(c) as c from r group by n),
g as (select a, count(*) as n from l group by a)
select vec_id, cast(coalesce(g.n, 0) as bigint) as n_links, k.c as component_id, vec_id = k.c as kept from v left join g on vec_id = g.a join k on vec_id = k.n
"""
