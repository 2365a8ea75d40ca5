"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bktree import merge
from .common import discard, save

#: Edges whose spanning forest is taken at once.
CHUNK = 1 << 20


def thinned(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the same components: of what each task reads, only a spanning forest of stars.

    A group that was found again and again, in many tables, shrinks to its members.
    Nothing is shuffled; ``edges`` should be a table, so that tasks read full partitions.
    """

    def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(node))
        merge(label, at[: len(a)], at[len(a) :])
        some = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(node[label[some]])], names=["src", "dst"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            n += b.num_rows
            if n >= CHUNK:
                yield stars(*(np.concatenate(c) for c in zip(*held)))
                held, n = [], 0
        if n:
            yield stars(*(np.concatenate(c) for c in zip(*held)))

    known = edges.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return known.mapInArrow(run, "src long, dst long")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with edges (src, dst), both long.

    Returns (node, component) for every node with an edge to another node; component
    is the smallest node. Self loops, repeated edges and nulls are ignored. Each round
    is written to the shared folder, so lineage stays short; no edge reaches the
    driver. The number of rounds is logarithmic in the component size.
    """
    clean = edges.where("src is not null and dst is not null and src <> dst")
    now = save(clean.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "cc")
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = save(both.groupBy("src").agg(F.min("dst").alias("m")), "cc-least")
        large = save(both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.least("src", "m").alias("dst")).distinct(), "cc-large")
        least2 = save(large.groupBy("src").agg(F.min("dst").alias("m")), "cc-least")
        moved = large.join(least2, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        small = save(moved.union(least2).select("src", F.col(moved.columns[1]).alias("dst")).distinct(), "cc")
        discard(now, least, large, least2)
        now = small
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots)
