"""One file written by tasks side by side: every row knows its offset before a byte is written.

The rows are sorted and written once as a table; bytes are counted per sorted
partition, added up over the partitions, and summed along each partition. Tasks then
write runs of rows at their offsets. A task that runs twice writes the same bytes to
the same place. The path must be a folder that all machines mount: ``file:``, or no
scheme where that is Spark's default, as in a ``spark.checkpoint.dir`` of a cluster; ``reachable`` tells.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.tables import discard, keep

#: Bytes handed to the file at once.
CHUNK = 1 << 20


def reachable(path: str) -> bool:
    """Whether tasks can write at offsets of ``path``: one of ``file:``, or one without a scheme where Spark's own file system is that."""
    if path.startswith("file:"):
        return True
    if "://" in path:
        return False
    spark = SparkSession.getActiveSession()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


def local(path: str) -> str:
    """The path that the operating system knows."""
    return "/" + path[len("file:") :].lstrip("/") if path.startswith("file:") else path


def allocate(path: str, size: int, *pieces: tuple[int, bytes]) -> None:
    """A file of ``size`` bytes with ``pieces`` at their offsets."""
    os.makedirs(os.path.dirname(os.path.abspath(local(path))), exist_ok=True)
    with open(local(path), "wb") as f:
        f.truncate(size)
        for at, data in pieces:
            f.seek(at)
            f.write(data)


def written(rows: DataFrame, path: str, pieces: Callable[[pa.RecordBatch], list[tuple[int, bytes]]]) -> int:
    """Write what ``pieces`` makes of each batch: (offset, bytes) in any order; the bytes written."""
    at = local(path)

    def run(batches):
        total = 0
        fd = os.open(at, os.O_WRONLY)
        try:
            for b in batches:
                for offset, data in pieces(b):
                    view = memoryview(data)
                    while view:
                        n = os.pwrite(fd, view[:CHUNK], offset)
                        view, offset, total = view[n:], offset + n, total + n
            os.fsync(fd)
        finally:
            os.close(fd)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def runs(offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where a row doesn't follow the one before it: the first row of each run of bytes."""
    return np.flatnonzero(np.r_[True, offsets[1:] != offsets[:-1] + sizes[:-1]]) if len(offsets) else np.zeros(0, np.int64)


def save_sections(df: DataFrame, key: str, path: str, *sections: str | Column) -> None:
    """A text file of ``sections`` one after the other: a text is a line, a column gives a line for each row, in the order of ``key``."""
    columns = [s for s in sections if not isinstance(s, str)]
    names = [f"v{i}" for i in range(len(columns))]
    rows = keep(df.orderBy(key).select(*[c.cast("string").alias(n) for c, n in zip(columns, names)], F.monotonically_increasing_id().alias("at")), "sections")
    part, size = F.shiftright("at", 33), lambda n: F.octet_length(n) + 1
    sums = rows.groupBy(part.alias("part")).agg(*[F.sum(size(n)).alias(n) for n in names]).orderBy("part").collect()  # a row a partition
    at, fixed, bases = 0, [], []
    for s in sections:
        if isinstance(s, str):
            line = s.encode() + b"\n"
            fixed.append((at, line))
            at += len(line)
        else:
            bases.append(at)
            at += sum(r[names[len(bases) - 1]] for r in sums)
    allocate(path, at, *fixed)
    if not sums:
        return discard(rows)
    firsts, now = [], list(bases)
    for r in sums:
        firsts.append((r.part, *now))
        now = [b + r[n] for b, n in zip(now, names)]
    starts = df.sparkSession.createDataFrame(firsts, "part long, " + ", ".join(f"s{i} long" for i in range(len(names))))
    before = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    placed = placed.select(*names, *[(F.col(f"s{i}") + F.coalesce(F.sum(size(n)).over(before), F.lit(0))).cast("long").alias(f"o{i}") for i, n in enumerate(names)])

    def pieces(b: pa.RecordBatch) -> list[tuple[int, bytes]]:
        out = []
        for i in range(len(names)):
            texts = [t.encode() + b"\n" for t in b.column(i).to_pylist()]
            offsets = b.column(len(names) + i).to_numpy()
            first = runs(offsets, np.array([len(t) for t in texts], np.int64))
            out += [(int(offsets[a]), b"".join(texts[a:z])) for a, z in zip(first, [*first[1:], len(texts)])]
        return out

    if written(placed, path, pieces) != at - sum(len(x) for _, x in fixed):
        raise RuntimeError(f"not all of {path} was written")
    discard(rows)
