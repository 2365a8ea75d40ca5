"""The binary state of a population: box, cell edges, cell counts, default sizes, occupancies, addresses, then nine columns of floats.

Layout, little endian: float[3] box, float[3] edge, int32[3] ext, float l, float a,
int32 capacity, int32 rods, float tolerance, int16[cells] occupancy, int32[cells] past
addresses, and capacity floats for each of x y z cx cy cz l a k. Cells are stored by
id; each holds its rods first, then empty places (-1).
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.grid import Grid
from ..operators.rods import stamped
from ..operators.stats import addresses
from ..plans.tables import discard, keep
from ..sinks import ranges

HEAD = "<6f3i2f2if"
FIELDS = ["x", "y", "z", "cx", "cy", "cz", "l", "a"]


#: Rods that a task reads at once, about; a cell has at most MOST, which 16 bits hold.
ROWS, MOST = 1 << 16, 32_767


def read(spark: SparkSession, path: str) -> DataFrame:
    """(rod_id, x, y, z, cx, cy, cz, l, a, cell_id, path) of the rods in state files.

    Where tasks reach the files, each takes a range of cells and reads their rods from the nine
    columns; files of other schemes are read whole, one by a task.
    """
    schema = "rod_id long, " + ", ".join(f"{f} double" for f in FIELDS) + ", cell_id long, path string"
    files = [r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect()]  # paths alone
    if not files or not all(ranges.reachable(f) for f in files):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_whole, schema)
    planned = []
    for f in files:
        h = _unpacked(_bytes(f, 0, struct.calcsize(HEAD)))
        cells = math.prod(h["ext"])
        each = max(1, min(cells, cells * ROWS // max(1, h["rods"])))
        planned.append((f, cells, each, h["capacity"]))
    starts = spark.createDataFrame(planned, "path string, cells long, each long, capacity long").select("path", "cells", "each", "capacity", F.explode(F.expr("sequence(0L, greatest(cells - 1, 0L), each)")).alias("first"))
    n = starts.count()

    def load(batches):
        for b in batches:
            for f, cells, each, total, at in zip(*(c.to_pylist() for c in b.columns)):
                base, end = struct.calcsize(HEAD), min(cells, at + each)
                occ = np.frombuffer(_bytes(f, base + 2 * at, 2 * (end - at)), "<i2").astype(np.int64)
                before = max(0, at - 1)
                past = np.frombuffer(_bytes(f, base + 2 * cells + 4 * before, 4 * (end - before)), "<i4").astype(np.int64)
                first = past[:-1] if at else np.concatenate([[0], past[:-1]])
                if not occ.sum():
                    continue
                low, high = int(first[0]), int(past[-1])
                rows = np.repeat(first, occ) + np.arange(occ.sum()) - np.repeat(np.cumsum(occ) - occ, occ)
                body = base + 6 * cells
                out = [np.frombuffer(_bytes(f, body + 4 * (k * total + low), 4 * (high - low)), "<f4")[rows - low].astype(float) for k in range(len(FIELDS))]
                yield pa.RecordBatch.from_arrays([pa.array(rows), *map(pa.array, out), pa.array(np.repeat(np.arange(at, end), occ)), pa.array([f] * len(rows))], names=["rod_id", *FIELDS, "cell_id", "path"])

    return starts.repartition(max(1, min(n, 20_000)), "path", "first").mapInArrow(load, schema)


def _bytes(path: str, at: int, n: int) -> bytes:
    with open(ranges.local(path), "rb") as f:
        f.seek(at)
        return f.read(n)


def _whole(batches):
    for pdf in batches:
        for path, data in zip(pdf.path, pdf.content):
            h = _unpacked(data)
            cells, total, at = math.prod(h["ext"]), h["capacity"], struct.calcsize(HEAD)
            occ = np.frombuffer(data, "<i2", cells, at).astype(np.int64)
            past = np.frombuffer(data, "<i4", cells, at + 2 * cells).astype(np.int64)
            body = np.frombuffer(data, "<f4", 9 * total, at + 6 * cells).reshape(9, total)
            first = np.concatenate([[0], past[:-1]])
            rows = np.repeat(first, occ) + np.arange(occ.sum()) - np.repeat(np.cumsum(occ) - occ, occ)
            out = {"rod_id": rows} | {f: body[i, rows].astype(float) for i, f in enumerate(FIELDS)}
            yield pd.DataFrame(out | {"cell_id": np.repeat(np.arange(cells), occ), "path": path})


def _unpacked(data: bytes) -> dict:
    h = struct.unpack_from(HEAD, data)
    return {"box": h[0:3], "edge": h[3:6], "ext": h[6:9], "l": h[9], "a": h[10], "capacity": h[11], "rods": h[12], "tolerance": h[13]}


def header(spark: SparkSession, path: str) -> dict:
    """box, edge, ext, l, a, capacity, rods and tolerance of one state file."""
    return _unpacked(spark.read.format("binaryFile").load(path).select(F.substring("content", 1, struct.calcsize(HEAD))).first()[0])


def write(rods: DataFrame, grid: Grid, path: str, length: float, radius: float, tolerance: float = 1e-6) -> None:
    """The state file of ``rods``, in the order of cells and ids, written by tasks side by side at offsets that follow from prefix sums of the cells.

    ``path`` must be one that all tasks reach (``sinks.ranges``). Raises if a cell has over MOST rods, or
    all together more than 31 bits count; Parquet is the format for such sets.
    """
    if not ranges.reachable(path):
        raise ValueError(f"tasks cannot write ranges of {path}")
    placed = keep(stamped(rods, grid), "state-rods")
    some = keep(addresses(placed.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))), "state-cells")
    total, most = (v or 0 for v in some.agg(F.sum("n"), F.max("n")).first())
    if most > MOST or total >= 1 << 31:
        raise ValueError(f"a cell of {most} rods, {total} in all: beyond the format's 16 and 31 bits")
    edge = [n / e for n, e in zip(grid.box, grid.ext)]
    head = struct.pack(HEAD, *grid.box, *edge, *grid.ext, length, radius, total, total, tolerance)
    base, cells = len(head), grid.cells
    body = base + 6 * cells
    ranges.allocate(path, body + 36 * total, (0, head))
    every = placed.sparkSession.range(cells).select(F.col("id").alias("cell_id")).join(some.select("cell_id", "n"), "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"))
    counts = addresses(every).select("cell_id", "n", "past").sortWithinPartitions("cell_id")

    def cell_pieces(b: pa.RecordBatch) -> list[tuple[int, bytes]]:
        at, n, past = (c.to_numpy() for c in b.columns)
        first = ranges.runs(at, np.ones(len(at), np.int64))
        return [p for a, z in zip(first, [*first[1:], len(at)]) for p in ((base + 2 * int(at[a]), n[a:z].astype("<i2").tobytes()), (base + 2 * cells + 4 * int(at[a]), past[a:z].astype("<i4").tobytes()))]

    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy("rod_id")) - 1
    rows = placed.withColumn("_rank", rank).join(some.select("cell_id", "first"), "cell_id").select((F.col("first") + F.col("_rank")).alias("at"), *[F.col(f).cast("float") for f in FIELDS], F.col("cell_id").cast("float").alias("k"))

    def rod_pieces(b: pa.RecordBatch) -> list[tuple[int, bytes]]:
        at = b.column(0).to_numpy()
        first = ranges.runs(at, np.ones(len(at), np.int64))
        columns = [b.column(1 + i).to_numpy().astype("<f4") for i in range(9)]
        return [(body + 4 * (i * total + int(at[a])), c[a:z].tobytes()) for a, z in zip(first, [*first[1:], len(at)]) for i, c in enumerate(columns)]

    done = ranges.written(counts, path, cell_pieces) + ranges.written(rows.sortWithinPartitions("at"), path, rod_pieces)
    if done != 6 * cells + 36 * total:
        raise RuntimeError(f"not all of {path} was written")
    discard(placed, some)
