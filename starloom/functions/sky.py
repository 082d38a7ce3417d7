"""Cells of equal area on the sky, spectra through filters, and text forms, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def nested_cell(ra: Column, dec: Column, order: int) -> Column:
    """Number of the equal-area cell (HEALPix, nested scheme; Gorski et al. 2005) with 2**order cells on a base side."""
    n, pi = 1 << order, 3.141592653589793
    z, phi = F.sin(F.radians(dec)), F.pmod(F.radians(ra), F.lit(2 * pi)) / (pi / 2)  # quarter turns
    quarter = F.least(F.floor(phi), F.lit(3))
    turn = phi - quarter
    # caps: distance from the two edges that meet in the pole
    reach = n * F.sqrt(3 * (1 - F.abs(z)))
    a = F.least(F.floor(turn * reach), F.lit(n - 1))
    b = F.least(F.floor((1 - turn) * reach), F.lit(n - 1))
    north = z > 0
    # belt: numbers of the rising and the falling diagonal
    up, down = F.floor(n * (0.5 + phi) - n * z * 0.75), F.floor(n * (0.5 + phi) + n * z * 0.75)
    fu, fd = F.floor(up / n), F.floor(down / n)
    belt_face = F.when(fu == fd, F.pmod(fu, F.lit(4)) + 4).when(fu < fd, F.pmod(fu, F.lit(4))).otherwise(F.pmod(fd, F.lit(4)) + 8)
    belt = F.abs(z) <= 2 / 3
    face = F.when(belt, belt_face).when(north, quarter).otherwise(quarter + 8)
    ix = F.when(belt, F.pmod(down, F.lit(n))).when(north, n - 1 - b).otherwise(a)
    iy = F.when(belt, n - 1 - F.pmod(up, F.lit(n))).when(north, n - 1 - a).otherwise(b)
    bits = lambda c, k: sum((F.shiftleft(F.shiftright(c.cast("long"), i).bitwiseAND(1), 2 * i + k) for i in range(order)), F.lit(0).cast("long"))
    return face.cast("long") * (n * n) + bits(ix, 0) + bits(iy, 1)


def band_flux(spectrum: Column, response: list[float], step: float) -> Column:
    """Trapezoid sum of a spectrum (array at equal steps) through a filter's response at the same places."""
    both = F.zip_with(spectrum, F.array(*map(F.lit, response)), lambda s, r: s.cast("double") * r)
    ends = F.element_at(both, 1) + F.element_at(both, -1)
    return step * (F.aggregate(both, F.lit(0.0), lambda t, v: t + v) - ends / 2)


def glob_pattern(pattern: str) -> str:
    """A regular expression for a whole name, upper and lower case alike, by ``*``, ``?`` and ``[ ]``."""
    parts = re.split(r"(\*|\?|\[[^\]]*\])", pattern)
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(p, p if p.startswith("[") else re.escape(p)) for p in parts if p) + "$"


def byte_text(n: Column) -> Column:
    """Bytes with one decimal in the largest binary unit below: 1.5 KiB."""
    units = ("B", "KiB", "MiB", "GiB", "TiB")
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, u in enumerate(units[1:], 1):
        tenths = F.floor((n.cast("long") * 10 + (1024**i) // 2) / 1024**i)
        out = F.when(n >= 1024**i, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {u}"))).otherwise(out)
    return out
