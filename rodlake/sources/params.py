"""Parameter files: a keyword and its values on each line."""

from __future__ import annotations

import math
import sys
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

# Keywords of the format, each with its field and kind.
KEYWORDS = {
    "WRT_BIN": ("write_state", "bool"), "VOLUME_PERCENT": ("fraction", "percent"), "VOLUME_PERCENT_LIST": ("fractions", "percents"),
    "VOL_FRAC_PRECISION": ("precision", "float"), "SPAT_DISTR_FILE": ("density", "density"),
    "PREF_ORT_PHI": ("prefer_phi", "angle"), "PREF_ORT_THETA": ("prefer_theta", "angle"), "DEF_THETA_MED": ("theta", "angle"), "DEF_PHI_MED": ("phi", "angle"),
    "DEF_THETA_DEV": ("theta_sd", "spread"), "DEF_PHI_DEV": ("phi_sd", "spread"), "INC_LEN_MED": ("length", "float"), "INC_RAD_MED": ("radius", "float"),
    "INC_SEPARATION": ("separation", "float"), "INC_SOFTCORE": ("soft", "float"), "CLUST_FLAG": ("cluster", "bool"), "CLUST_DIST_LIM": ("cluster_distance", "float"),
    "CLUST_ANGL_LIM": ("cluster_angle", "float"), "STAT_DIST_LIM": ("limit", "float"), "SELF_ALLIGN_STEP": ("align_every", "int"), "REDUCE_FLAG": ("reduce", "bool"),
}
# Keywords that are accepted and change nothing.
IGNORED = {"SPAT_DIMENSIONS", "ORNT_DISTR_FILE", "IDIM_DISTR_FILE", "INC_LEN_DEV", "INC_RAD_DEV", "MATH_TOLERANCE", "DMN_CELL_MARGE"}


@dataclass(frozen=True)
class Params:
    """Lengths in micrometres, angles in radians, fractions of 1; a spread of None means uniform."""

    write_state: bool = False
    fraction: float = 0.0005
    fractions: tuple[float, ...] = ()
    precision: float = 0.01
    density: str | None = None
    box: tuple[float, float, float] | None = None
    mesh: tuple[int, int, int] | None = None
    prefer_phi: float = 0.0
    prefer_theta: float = 0.0
    theta: float = 0.0
    phi: float = 0.0
    theta_sd: float | None = None
    phi_sd: float | None = None
    length: float = 4.0
    radius: float = 0.010
    separation: float = 0.0
    soft: float = 1.0
    cluster: bool = False
    cluster_distance: float = 0.0
    cluster_angle: float = 0.0
    limit: float = 0.015
    align_every: int = 50
    reduce: bool = False
    unknown: tuple[str, ...] = field(default=())


def parse(lines: list[str]) -> Params:
    """Params of the lines; keywords that are not known are listed, with a warning, and change nothing."""
    p = Params()
    for line in lines:
        word, *rest = line.split() or [""]
        if word in KEYWORDS and rest:
            name, kind = KEYWORDS[word]
            if kind == "density":
                p = replace(p, density=None if rest[0] == "NONE" else rest[0])
                if rest[0] == "NONE" and len(rest) >= 7:
                    p = replace(p, box=tuple(map(float, rest[1:4])), mesh=tuple(int(float(v)) for v in rest[4:7]))
                continue
            value = {
                "bool": lambda: rest[0].lower() in ("1", "true"), "float": lambda: float(rest[0]), "int": lambda: int(float(rest[0])), "percent": lambda: float(rest[0]) / 100,
                "percents": lambda: tuple(float(v) / 100 for v in rest[1 : 1 + int(rest[0])]), "angle": lambda: math.radians(float(rest[0])),
                "spread": lambda: math.radians(float(rest[0])) if float(rest[0]) > 0 else None,
            }[kind]()
            p = replace(p, **{name: value})
        elif word and word not in IGNORED and word not in KEYWORDS:
            warnings.warn(f"unknown keyword {word}", stacklevel=2)
            p = replace(p, unknown=(*p.unknown, word))
    return p


def read(spark: SparkSession, path: str) -> Params:
    """Params of a file that Spark can reach; a few dozen lines."""
    return parse(spark.read.text(path, wholetext=True).first()[0].splitlines())


def read_input(stream=None) -> Params:
    """Params from standard input, or another stream of lines, up to its end."""
    return parse([line.rstrip("\r\n") for line in stream or sys.stdin])


def read_setup(spark: SparkSession, path: str) -> dict:
    """Set-up of the mesh tool: values by position, separated by blanks, commas or line ends; two header lines.

    box(3) grid(3) fraction% | ratio% mean_radius spread slope density | sigma_m sigma_c power threshold%.
    """
    lines = spark.read.text(path, wholetext=True).first()[0].splitlines()
    values = [float(v.replace("d", "e").replace("D", "e")) for line in lines for v in line.replace(",", " ").split() if _number(v)]
    names = ["box", "box", "box", "grid", "grid", "grid", "fraction", "ratio", "mean_radius", "spread", "slope", "density", "sigma_m", "sigma_c", "power", "threshold"]
    out: dict = {}
    for n, v in zip(names, values):
        out.setdefault(n, []).append(v)
    flat = {k: v[0] if len(v) == 1 else tuple(int(x) for x in v) if k == "grid" else tuple(v) for k, v in out.items()}
    return flat | {k: flat[k] / 100 for k in ("fraction", "ratio", "threshold") if k in flat}


def _number(s: str) -> bool:
    try:
        float(s.replace("d", "e").replace("D", "e"))
    except ValueError:
        return False
    return True
