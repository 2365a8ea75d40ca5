"""Scalar laws: volume fractions, distributions, conduction, colour."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (SI): electron mass, elementary charge, Planck and vacuum permittivity constants.
ELECTRON_MASS, CHARGE, PLANCK, EPSILON_0 = 9.1093837015e-31, 1.602176634e-19, 6.62607015e-34, 8.8541878128e-12
# Fixed values of the contact model: tube length and radius, work function, permittivity, gap limits, conductivity.
TUBE_LENGTH, TUBE_RADIUS, WORK, EPSILON, GAP_MIN, GAP_TUNNEL, CONDUCTIVITY = 1.5e-6, 4.75e-9, 3.5 * CHARGE, 2.9, 0.34e-9, 1.1e-9, 6.7e7
S_MIN, S_MAX = math.pi * TUBE_RADIUS**2, TUBE_LENGTH * 2 * TUBE_RADIUS
DECAY = 4 * math.pi / PLANCK * math.sqrt(2 * ELECTRON_MASS * WORK)
#: Scales: resistance and capacitance of the closest contact, and their frequency.
R0 = 1 / math.sqrt(2 * ELECTRON_MASS * WORK) * (PLANCK / CHARGE) ** 2 * math.exp(DECAY * GAP_MIN) * GAP_MIN / S_MIN
C0 = EPSILON_0 * EPSILON * S_MIN / GAP_MIN
W0 = 1 / (R0 * C0)


def volume_percent(rods: Column, length: float, radius: float, volume: float) -> Column:
    return rods * (math.pi * radius * radius * length / volume * 100.0)


def rods_for(fraction: float, length: float, radius: float, volume: float) -> int:
    return math.ceil(fraction * volume / (math.pi * radius * radius * length))


def side_area(length: Column, radius: Column) -> Column:
    return 2.0 * F.pi() * radius * length


def belt_area(low: Column, high: Column) -> Column:
    """Area of the unit sphere between two polar angles."""
    return 2.0 * F.pi() * (F.cos(low) - F.cos(high))


def gauss_1d(x: Column, centre, width) -> Column:
    return F.exp(-((x - centre) * (x - centre)) / 2.0 / width / width)


def gauss_3d(x: tuple, centre: tuple, width) -> Column:
    return gauss_1d(x[0], centre[0], width) * gauss_1d(x[1], centre[1], width) * gauss_1d(x[2], centre[2], width)


def gauss_pdf(distance_squared: Column, sigma: float, dimensions: int) -> Column:
    """Normalised Gaussian density in 1, 2 or 3 dimensions."""
    return F.exp(-distance_squared / (2.0 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma) ** dimensions


def sigmoid(x: Column, centre, slope) -> Column:
    return 1.0 / (1.0 + F.exp(-slope * (x - centre)))


def double_sigmoid(x: Column, centre, half_width, slope) -> Column:
    return sigmoid(x, centre - half_width, slope) - sigmoid(x, centre + half_width, slope)


def log_normal(x: Column, centre, width) -> Column:
    """Density of the log-normal law; none below 0.001."""
    return F.when(x >= 0.001, 1.0 / x / math.sqrt(2 * math.pi) / width * F.exp(-F.pow(F.log(x / centre), 2.0) / 2.0 / width / width)).otherwise(0.0)


def percolation(rho: Column, matrix: float, filler: float, threshold: float, power: float) -> Column:
    """Conductivity at a density: the matrix alone below the threshold, a power law above."""
    return F.when(rho < threshold, matrix).otherwise(matrix + filler * F.pow((rho - threshold) / (1.0 - threshold), F.lit(power)))


def shade(n: Column, most: Column) -> Column:
    """Grey level of a count: 33 to 255."""
    return F.when(n < most, 33.0 + 222.0 * n / most).otherwise(255.0)


def segment_conductance(length_over_radius: Column, radius: Column) -> Column:
    """Scaled conductance of a piece of tube (radius in metres)."""
    return CONDUCTIVITY * math.pi * radius / length_over_radius * R0


def contact_conductance(gap: Column, area: Column) -> Column:
    """Scaled tunnelling conductance; none beyond the tunnelling gap."""
    return F.when(gap <= GAP_TUNNEL, 1.0 / (F.exp(DECAY * (gap - GAP_MIN)) * (gap / GAP_MIN) / (area / S_MIN))).otherwise(0.0)


def contact_capacitance(gap: Column, area: Column) -> Column:
    """Scaled capacitance; none below 0.005."""
    c = (area / S_MIN) / (gap / GAP_MIN)
    return F.when(c < 0.005, 0.0).otherwise(c)


def lcg(s: Column) -> Column:
    """One step of the linear congruential generator modulo 2^32."""
    return (F.lit(1664525) * s + 1013904223) % 4294967296


def uniform(seed: Column, stream: int) -> Column:
    """A number in [0, 1) from an integer of at most 62 bits and a stream number.

    Multiply, xor and shift on 32 bits, so any engine with 64-bit integers gives the
    same; streams of one seed are independent, which those of ``lcg`` are not.
    """
    s = F.pmod(F.pmod(seed, F.lit(1 << 31)) * 2654435761 + F.floor(seed / float(1 << 31)).cast("long") * 40503 + stream * 69069, F.lit(4294967296))
    fold = lambda x: x.bitwiseXOR(F.shiftright(x, 16))
    for _ in range(2):
        s = F.pmod(fold(s) * 73244475, F.lit(4294967296))
    return fold(s) / 4294967296.0


def chatterjee(u: Column, b: float, m: float) -> Column:
    """cos(theta) of the orientation law a + b |cos|^m."""
    a = 1.0 / 2.0 / math.pi - b / (m + 1.0)
    return F.pow((u - a) / b, F.lit(1.0 / m))
