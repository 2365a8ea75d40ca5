"""Pictures of rods from above: counts by pixels, blur, grey levels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields

#: Fixed value: resolution of the blur, in the units of the box.
SIGMA = 0.45


def covered(rods: DataFrame, box: tuple[float, float, float], size: tuple[int, int], low: float = -math.inf, high: float = math.inf) -> DataFrame:
    """(rod_id, px, py): the pixels that a rod's axis, drawn out by its radius at both ends, passes; centres with z in [low, high).

    For each column of pixels the rows follow from the line; pixels outside the picture
    are left out.
    """
    w, h = box[0] / size[0], box[1] / size[1]
    half = F.col("l") / 2.0 + F.col("a")
    df = rods.where((F.col("z") >= low) & (F.col("z") < high)).select("rod_id", *[(F.col(v) - half * F.col("c" + v)).alias(v + "a") for v in "xy"], *[(F.col(v) + half * F.col("c" + v)).alias(v + "b") for v in "xy"])
    left, right = F.least("xa", "xb"), F.greatest("xa", "xb")
    first, last = F.greatest(F.floor(left / w), F.lit(0)), F.least(F.floor(right / w), F.lit(size[0] - 1))
    df = df.where(first <= last).withColumn("px", F.explode(F.sequence(first, last)))
    run = F.col("xb") - F.col("xa")
    at = lambda x: F.when(F.abs(run) < 1e-12, None).otherwise(F.col("ya") + (F.col("yb") - F.col("ya")) * ((x - F.col("xa")) / run))
    y1 = F.coalesce(at(F.greatest(left, F.col("px") * w)), F.col("ya"))
    y2 = F.coalesce(at(F.least(right, (F.col("px") + 1) * w)), F.col("yb"))
    low_y, high_y = F.greatest(F.floor(F.least(y1, y2) / h), F.lit(0)), F.least(F.floor(F.greatest(y1, y2) / h), F.lit(size[1] - 1))
    return df.withColumn("_l", low_y).withColumn("_h", high_y).where("_l <= _h").select("rod_id", F.col("px").cast("int").alias("px"), F.explode(F.sequence(F.col("_l").cast("int"), F.col("_h").cast("int"))).alias("py"))


def counts(rods: DataFrame, box: tuple[float, float, float], size: tuple[int, int], low: float = -math.inf, high: float = math.inf) -> DataFrame:
    """(px, py, n) of the pixels that rods pass."""
    return covered(rods, box, size, low, high).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


def shaded(image: DataFrame, size: tuple[int, int], value: str = "n") -> DataFrame:
    """(px, py, v): grey levels of all pixels, by the largest value."""
    most = image.agg(F.max(value)).first()[0] or 0
    w, h = size
    frame = image.sparkSession.range(w * h).select((F.col("id") % w).cast("int").alias("px"), F.floor(F.col("id") / w).cast("int").alias("py"))
    n = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    return frame.join(image, ["px", "py"], "left").select("px", "py", fields.shade(n, F.lit(float(most))).alias("v"))


def _rows_blurred(image: DataFrame, along: str, across: str, n: int, taps: list[float]) -> DataFrame:
    """One pass along ``along``: each line of pixels is an array of n values, which the taps go over; missing pixels are 0."""
    reach = len(taps) - 1
    line = image.groupBy(across).agg(F.map_from_entries(F.collect_list(F.struct(along, "v"))).alias("m"))  # at most n pixels
    line = line.select(across, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.coalesce(F.element_at("m", x), F.lit(0.0))).alias("line"), F.lit(taps).alias("taps"))
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    at = lambda x: F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.element_at("line", F.pmod(x - k, F.lit(n)) + 1) * F.element_at("taps", F.abs(k) + 1))
    done = line.select(across, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)).alias(along, "v"))
    return done.select("px", "py", "v")


def blurred(image: DataFrame, size: tuple[int, int], pixel: float, sigma: float = SIGMA, value: str = "v") -> DataFrame:
    """(px, py, v): Gaussian blur along x, then along y; the picture wraps. Taps reach ceil(3 sigma / pixel)."""
    reach = math.ceil(3 * sigma / pixel)
    taps = [math.exp(-((k * pixel) ** 2) / 2 / sigma**2) for k in range(reach + 1)]
    total = taps[0] + 2 * sum(taps[1:])
    taps = [t / total for t in taps]
    out = image.select("px", "py", F.col(value).cast("double").alias("v"))
    return _rows_blurred(_rows_blurred(out, "px", "py", size[0], taps), "py", "px", size[1], taps)


def picture(rods: DataFrame, box: tuple[float, float, float], size: tuple[int, int] = (1280, 1280), sigma: float = SIGMA, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    """(px, py, v) with v 0 to 255: counts, shaded, blurred, shaded again."""
    grey = shaded(counts(rods, box, size, low, high), size)
    return shaded(blurred(grey, size, box[0] / size[0], sigma), size, "v")
