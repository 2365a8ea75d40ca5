"""Writers of text and picture formats.

Formats that are one file are written by tasks side by side (``ranges``) where the path is
one that all of them reach. For other schemes, whose files have no ranges to write,
``ordered`` hands rows over in order, a partition at a time, to one handle on the driver.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranges


def lines(df: DataFrame, *parts, sep: str = " ") -> DataFrame:
    """(value): one line of text a row."""
    return df.select(F.concat_ws(sep, *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]).alias("value"))


def ordered(df: DataFrame, key: str, *parts, sep: str = " ") -> Iterator[str]:
    for r in df.orderBy(key).select(F.concat_ws(sep, *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])).toLocalIterator():
        yield r[0]


class _File:
    """A file to write bytes to, locally or by Spark's file systems."""

    def __init__(self, path: str):
        if "://" not in path:
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            self.out = open(path, "wb")
            return
        spark = SparkSession.getActiveSession()
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)

    def __enter__(self):
        return self.out

    def __exit__(self, *_):
        self.out.close()


def save_bytes(path: str, data: bytes) -> None:
    with _File(path) as f:
        f.write(data)


def save_lines(path: str, *groups, chunk: int = 1 << 20) -> None:
    """Lines of texts and of iterators of texts, handed to the file a ``chunk`` of characters at a time."""
    with _File(path) as f:
        held, size = [], 0
        for g in groups:
            for line in [g] if isinstance(g, str) else g:
                held.append(line + "\n")
                size += len(line) + 1
                if size >= chunk:
                    f.write("".join(held).encode())
                    held, size = [], 0
        f.write("".join(held).encode())


def in_order(df: DataFrame, key: str, path: str, *sections: str | Column) -> None:
    """``sections`` of one file: texts are lines, a column gives a line for each row of ``df``, in the order of ``key``."""
    if ranges.reachable(path):
        return ranges.save_sections(df, key, path, *sections)
    save_lines(path, *[s if isinstance(s, str) else ordered(df, key, s) for s in sections])


def line(*parts: str | Column) -> Column:
    return F.concat_ws(" ", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


# ---- rods -------------------------------------------------------------------------------------------------------


def vtk_rods(rods: DataFrame, path: str) -> None:
    """Points at the centres, with directions as vectors and l, a, k as scalars."""
    n = rods.count()
    df = rods if "cell_id" in rods.columns else rods.withColumn("cell_id", F.lit(0))
    groups = ["# vtk DataFile Version 3.0", "rods", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} float", line("x", "y", "z"), f"POINT_DATA {n}", "VECTORS direction float", line("cx", "cy", "cz")]
    for name, c in (("length", "l"), ("radius", "a"), ("cell", "cell_id")):
        groups += [f"SCALARS {name} float 1", "LOOKUP_TABLE default", line(c)]
    in_order(df, "rod_id", path, *groups)


def vtk_directions(rods: DataFrame, path: str) -> None:
    """Directions as points on the unit sphere."""
    in_order(rods, "rod_id", path, "# vtk DataFile Version 3.0", "directions", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {rods.count()} float", line("cx", "cy", "cz"))


def quaternion(cx: Column, cy: Column, cz: Column) -> list[Column]:
    """Components as the ellipsoid format has them: cos and sin of half the angle from x, about (0, -cz, cy), which is not made a unit axis."""
    up, down = F.sqrt((1.0 + cx) / 2.0), F.sqrt(F.greatest(F.lit(0.0), (1.0 - cx) / 2.0))
    return [up, F.lit(0.0), -cz * down, cy * down]


def lammps(rods: DataFrame, path: str, box: tuple[float, float, float]) -> None:
    """Ellipsoids (l + 2a, 2a, 2a) with quaternions."""
    n = rods.count()
    q = quaternion(F.col("cx"), F.col("cy"), F.col("cz"))
    ends = [f"0 {v} {a}lo {a}hi" for v, a in zip(box, "xyz")]
    in_order(rods, "rod_id", path, "rods", "", f"{n} atoms", f"{n} ellipsoids", "1 atom types", "", *ends, "", "Atoms", "", line(F.col("rod_id") + 1, F.lit(1), F.lit(1), F.lit(1), "x", "y", "z"), "", "Ellipsoids", "", line(F.col("rod_id") + 1, F.col("l") + 2 * F.col("a"), 2 * F.col("a"), 2 * F.col("a"), *q))


def state_text(rods: DataFrame, path: str) -> None:
    """Rods as columns of text, written by tasks side by side."""
    lines(rods, "x", "y", "z", "cx", "cy", "cz", "l", "a").write.text(path)


def occupancy(counts: DataFrame, cells: int, path: str) -> int:
    """Lines ``cell count`` of all cells, in order, those without rods too; returns the number of rods. counts: (cell_id, n)."""
    every = counts.sparkSession.range(cells).select(F.col("id").alias("cell_id")).join(counts, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"))
    in_order(every, "cell_id", path, line("cell_id", "n"))
    return total_of(counts, "n") or 0


# ---- meshes -----------------------------------------------------------------------------------------------------


def vtk_mesh(mesh: DataFrame, path: str, ext: tuple[int, int, int], box: tuple[float, float, float], value: str = "rho") -> None:
    """Structured points; spacing by each axis."""
    nx, ny, nz = ext
    at = F.col("i") + F.col("j") * nx + F.col("k") * (nx * ny)
    in_order(mesh.withColumn("_at", at), "_at", path, "# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET STRUCTURED_POINTS", f"DIMENSIONS {nx} {ny} {nz}", "ORIGIN 0 0 0", "SPACING " + " ".join(str(b / e) for b, e in zip(box, ext)), f"POINT_DATA {nx * ny * nz}", "SCALARS density float 1", "LOOKUP_TABLE default", line(value))


def vtk_field(field: DataFrame, path: str, ext: tuple[int, int, int], box: tuple[float, float, float], names: tuple[str, str, str] = ("vx", "vy", "vz")) -> None:
    """A vector at each mesh point."""
    nx, ny, nz = ext
    at = F.col("i") + F.col("j") * nx + F.col("k") * (nx * ny)
    in_order(field.withColumn("_at", at), "_at", path, "# vtk DataFile Version 3.0", "field", "ASCII", "DATASET STRUCTURED_POINTS", f"DIMENSIONS {nx} {ny} {nz}", "ORIGIN 0 0 0", "SPACING " + " ".join(str(b / e) for b, e in zip(box, ext)), f"POINT_DATA {nx * ny * nz}", "VECTORS field float", line(*names))


def mesh_text(mesh: DataFrame, path: str, ext: tuple[int, int, int], box: tuple[float, float, float], order: str = "F", value: str = "rho") -> None:
    """Box, mesh size and values; read back by ``sources.meshes`` with the same ``order``."""
    nx, ny, nz = ext
    at = F.col("i") + F.col("j") * nx + F.col("k") * (nx * ny) if order == "F" else F.col("k") + F.col("j") * nz + F.col("i") * (nz * ny)
    in_order(mesh.withColumn("_at", at), "_at", path, " ".join(map(str, box)), " ".join(map(str, ext)), line(value))


def vtk_leaves(leaves: DataFrame, path: str, edge: tuple[float, float, float]) -> None:
    """Boxes of a partition as voxels, each with its colour: its place in the order of leaves."""
    rows = leaves.orderBy("leaf").collect()  # one row a leaf
    points = [f"{x * edge[0]} {y * edge[1]} {z * edge[2]}" for r in rows for z in (r.z0, r.z1) for y in (r.y0, r.y1) for x in (r.x0, r.x1)]
    cells = ["8 " + " ".join(str(8 * i + k) for k in range(8)) for i in range(len(rows))]
    save_lines(path, "# vtk DataFile Version 3.0", "leaves", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {len(points)} float", points, f"CELLS {len(rows)} {9 * len(rows)}", cells, f"CELL_TYPES {len(rows)}", ["11"] * len(rows), f"CELL_DATA {len(rows)}", "SCALARS leaf int 1", "LOOKUP_TABLE default", [str(i) for i in range(len(rows))])


# ---- numbers ----------------------------------------------------------------------------------------------------


def columns(df: DataFrame, path: str, *names: str, header: str | None = None, sep: str = " ") -> None:
    """Columns between blanks, written by tasks side by side; a header goes to the folder's only header file if asked for."""
    out = lines(df, *names, sep=sep)
    if header:
        out = df.sparkSession.createDataFrame([("# " + header,)], "value string").coalesce(1).union(out)
    out.write.text(path)


def total_of(df: DataFrame, name: str):
    """The sum that writers of integer columns report."""
    return df.agg(F.sum(name)).first()[0]


#: How many files a task writes side by side: beyond, Spark sorts a task's rows by folder, which can spill.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def coo(contacts: DataFrame, folder: str, compression: str = "none") -> None:
    """A folder role=... for each role with lines ``i j d s``; with ``compression``, which Spark's reader undoes. Tasks write the roles side by side, unsorted."""
    conf = contacts.sparkSession.conf
    before = conf.get(WRITERS, "0")
    conf.set(WRITERS, "8")
    try:
        contacts.select("role", F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-1")) for c in ("ni" if "ni" in contacts.columns else "i", "nj" if "nj" in contacts.columns else "j", "d", "s")]).alias("value")).write.partitionBy("role").text(folder, compression=compression)
    finally:
        conf.set(WRITERS, before)


def sparse(df: DataFrame, path: str, row: str, col: str, *values: str, compression: str = "none") -> None:
    """Coordinates with one or two values, as CSV; with ``compression``, which Spark's reader undoes."""
    df.select(row, col, *values).write.csv(path, sep=" ", header=False, compression=compression)


def mathematica_list(df: DataFrame, key: str, value: str, name: str = "gamma") -> str:
    """name={v, v, ...}; of a histogram, whose rows are few."""
    return f"{name}={{" + ", ".join(str(r[0]) for r in df.orderBy(key).select(value).collect()) + "}"


def mathematica_matrix(df: DataFrame, row: str, col: str, value: str, name: str = "rho") -> str:
    """name = {{...}, ...}; of a histogram."""
    rows: dict = {}
    for r in df.orderBy(row, col).select(row, value).collect():
        rows.setdefault(r[0], []).append(str(r[1]))
    return f"{name} = {{" + ",\n".join("{" + ", ".join(v) + "}" for v in rows.values()) + "}"


def gnuplot_matrix(df: DataFrame, row: str, col: str, value: str, path: str) -> None:
    rows: dict = {}
    for r in df.orderBy(row, col).select(row, value).collect():  # a histogram or a picture
        rows.setdefault(r[0], []).append(str(r[1]))
    save_lines(path, ["\t".join(v) for v in rows.values()])


def gnuplot_function(df: DataFrame, path: str, x: str, y: str, z: str) -> None:
    """Lines ``x y z``, written by tasks side by side."""
    df.select(x, y, z).write.csv(path, sep="\t", header=False)


def impedance(df: DataFrame, path: str) -> None:
    """Lines ``f, Re Z, -Im Z, RMS`` in the order of frequencies."""
    save_lines(path, "# Frequency\tZ_real\t(-1)Z_imag\tRMS", [f"{r.frequency:>10.3e}\t{r.re:>10.3e}\t{-r.im:>10.3e}\t{r.rms:>10.3e}" for r in df.orderBy("frequency").collect()])


def tiff(image: DataFrame, path: str, size: tuple[int, int], value: str = "v") -> None:
    """Uncompressed 8-bit grey TIFF of one strip, white is zero; pixels without a row are 0."""
    w, h = size
    # Tags of the format (width, length, bits, compression, photometric, strip offset, samples, rows, bytes)
    tags = [(256, w), (257, h), (258, 8), (259, 1), (262, 0), (273, 8 + 2 + 9 * 12 + 4), (277, 1), (278, h), (279, w * h)]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHIHH" if v < 65536 and t not in (273, 279) else "<HHII", *((t, 3, 1, v, 0) if v < 65536 and t not in (273, 279) else (t, 4, 1, v))) for t, v in tags) + struct.pack("<I", 0)
    head = struct.pack("<2sHI", b"II", 42, 8) + body
    shade = F.floor(F.greatest(F.lit(0.0), F.least(F.col(value), F.lit(255.0)))).cast("short")
    pixels = image.select((F.col("py").cast("long") * w + F.col("px")).alias("at"), shade.alias("v"))
    if not ranges.reachable(path):
        grid = np.zeros(w * h, np.uint8)
        pdf = pixels.toPandas()  # as many rows as pixels
        grid[pdf["at"]] = pdf.v
        return save_bytes(path, head + grid.tobytes())
    ranges.allocate(path, len(head) + w * h, (0, head))

    def pieces(b) -> list[tuple[int, bytes]]:
        at, v = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint8)
        first = ranges.runs(at, np.ones(len(at), np.int64))
        return [(len(head) + int(at[x]), v[x:z].tobytes()) for x, z in zip(first, [*first[1:], len(at)])]

    ranges.written(pixels.orderBy("at"), path, pieces)
