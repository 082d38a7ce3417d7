"""What a frame's header says, and sizes derived from it, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.robust import clip

# fixed values: the mosaic patterns, in the order in which a free text is searched for them
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")
DISK_FULL = ("no space left on device", "disk full", "not enough space", "enospc")  # fixed values: signs of a full disk
# fixed values: physical constants, and the lobes (height, centre, slopes below and above) of the published analytic fit
# to the CIE 1931 observer (Wyman, Sloan, Shirley 2013); the matrix is that of IEC 61966-2-1
PLANCK, LIGHT, BOLTZMANN = 6.62607015e-34, 2.99792458e8, 1.380649e-23
LOBES = {
    "x": ((0.362, 442.0, 0.0624, 0.0374), (1.056, 599.8, 0.0264, 0.0323), (-0.065, 501.1, 0.0490, 0.0382)),
    "y": ((0.821, 568.8, 0.0213, 0.0247), (0.286, 530.9, 0.0613, 0.0322)),
    "z": ((1.217, 437.0, 0.0845, 0.0278), (0.681, 459.0, 0.0385, 0.0725)),
}
TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
# fixed values: nm at which each channel's curve begins to rise, is full, begins to fall and ends
CURVES = {"b": (380, 400, 500, 530), "g": (460, 500, 580, 620), "r": (570, 600, 680, 720)}


def bayer_pattern(pattern: Column, colour: Column, x: Column, y: Column) -> Column:
    """From the pattern's own card, else a pattern named in the colour text, else the parity of the offsets, else UNKNOWN."""
    own = F.when(F.upper(F.trim(pattern)).isin(*PATTERNS), F.upper(F.trim(pattern))).otherwise("UNKNOWN")
    named = F.coalesce(*(F.when(F.contains(F.lower(colour), F.lit(p.lower())), p) for p in PATTERNS))
    odd = F.when((x % 2 == 0) & (y % 2 == 0), "RGGB").when((x % 2 == 1) & (y % 2 == 0), "GRBG").when((x % 2 == 0) & (y % 2 == 1), "GBRG").when((x % 2 == 1) & (y % 2 == 1), "BGGR")
    return F.when(pattern.isNotNull(), own).otherwise(F.coalesce(named, odd, F.lit("UNKNOWN")))


def colour_mode(axes: Column, pattern: Column, colour: Column) -> Column:
    """Three axes are RGB, a known pattern is OSC, then the colour text decides; MONO otherwise."""
    text = F.lower(colour)
    said = F.when(F.contains(text, F.lit("mono")), "MONO").when(F.contains(text, F.lit("osc")) | F.contains(text, F.lit("color")), "OSC")
    return F.when(axes >= 3, "RGB").when(pattern != "UNKNOWN", "OSC").otherwise(F.coalesce(said, F.lit("MONO")))


def reconciled(mode: Column, pattern: Column, colour: Column, axes: Column, wanted: Column, wanted_pattern: Column) -> tuple[Column, Column, Column]:
    """Mode, pattern and warning once the configuration has had its say. It speaks for headers without any hint of
    colour; its own default (OSC with no pattern, or GBRG) is too vague for that and gives MONO."""
    hint = (axes >= 3) | (pattern != "UNKNOWN") | colour.isNotNull()
    vague = (wanted == "OSC") & F.coalesce(wanted_pattern.isin("", "GBRG"), F.lit(True))
    open_ = ~hint & F.coalesce(wanted.isin("MONO", "OSC", "RGB"), F.lit(False))
    out = F.when(open_ & vague, "MONO").when(open_, wanted).otherwise(mode)
    filled = F.when((out == "OSC") & (pattern == "UNKNOWN") & wanted_pattern.isin(*PATTERNS), wanted_pattern).otherwise(pattern)
    return out, filled, F.when(open_ & vague, "ambiguous").when(open_, "fallback")


def mode_gate(usable: Column, threshold: Column, emergency: Column, least: Column) -> tuple[Column, Column]:
    """The mode, and whether the run stops."""
    mode = F.when(usable < least, F.when(emergency, "emergency_reduced").otherwise("abort")).when(usable < threshold, "reduced").otherwise("full")
    return mode, (usable < least) & ~emergency


def tile_plan(fwhm: Column, width: Column, height: Column, factor: float, min_size: int, max_divisor: int, overlap: Column) -> tuple[Column, Column, Column]:
    """Tile size, overlap and stride in pixels from the median FWHM (3 where there is none)."""
    seeing = F.when((fwhm > 0) & ~F.isnan(fwhm), fwhm).otherwise(3.0)
    low = max(16, min_size)
    high = F.greatest(F.floor(F.least(width, height) / max(1, max_divisor)), F.lit(low))
    size = F.floor(F.least(F.greatest(factor * seeing, F.lit(float(low))), high)).cast("int")
    part = F.floor(clip(overlap, 0.0, 0.5) * size).cast("int")
    return size, part, size - part


def grid_spacing(width: Column, height: Column, tile: Column, cells: int, least: int, largest: float) -> Column:
    """Pixels between the nodes of the background grid: two tiles or ``least`` at least, whatever the largest share says."""
    short, floor = F.least(width, height), F.greatest(2 * tile, F.lit(least))
    return F.least(F.greatest(floor, F.floor(short / max(1, cells))), F.greatest(F.floor(short * largest), floor)).cast("int")


def auto_radii(fwhm: Column, least: float, aperture: float, inner: float, outer: float) -> tuple[Column, Column, Column]:
    """Aperture and annulus from the FWHM, each ring at least 1 and 2 pixels beyond the one before."""
    f = F.greatest(F.coalesce(fwhm, F.lit(0.0)), F.lit(0.0))
    a = F.greatest(F.lit(least), aperture * f)
    b = F.greatest(a + 1, inner * f)
    return a, b, F.greatest(b + 2, outer * f)


def disk_full(message: Column) -> Column:
    text = F.lower(message)
    found = F.contains(text, F.lit(DISK_FULL[0]))
    for sign in DISK_FULL[1:]:
        found = found | F.contains(text, F.lit(sign))
    return found


def _matching(wl: float, lobes: tuple) -> float:
    return sum(a * math.exp(-0.5 * ((wl - c) * (low if wl < c else high)) ** 2) for a, c, low, high in lobes)


def colour_table() -> list[tuple[float, float, float, float]]:
    """(exponent constant, red, green, blue) of each 5 nm from 380 to 780, from the fit and the matrix."""
    out = []
    for wl in range(380, 781, 5):
        m = wl * 1e-9
        xyz = [2 * PLANCK * LIGHT**2 / m**5 * _matching(wl, LOBES[k]) for k in "xyz"]
        out.append((PLANCK * LIGHT / (m * BOLTZMANN), *(sum(a * b for a, b in zip(row, xyz, strict=True)) for row in TO_RGB)))
    return out


def blackbody_rgb(kelvin: Column) -> tuple[Column, Column, Column]:
    """Linear red, green and blue of a black body, their sum 1; 0 outside 1000 to 50000 K."""
    table = np.array(colour_table())

    @F.pandas_udf("r double, g double, b double")
    def shares(k: pd.Series) -> pd.DataFrame:  # one exponential for each row of the table; expressions took one for each use
        t = k.to_numpy(float, na_value=np.nan)
        inside = (t >= 1000) & (t <= 50000)
        lit = np.zeros((len(t), 3))
        for e, *colours in table:
            lit += np.array(colours) / (np.exp(e / np.where(inside, t, 1000.0)) - 1)[:, None]
        lit = np.maximum(lit, 0)
        total = lit.sum(1, keepdims=True)
        return pd.DataFrame(np.where(inside[:, None] & (total > 0), lit / np.where(total > 0, total, 1), 0.0), columns=list("rgb"))

    found = shares(kelvin)
    return tuple(found[c] for c in "rgb")


def filter_curve(wl: Column, channel: str) -> Column:
    """Transmission of a colour camera's filter: a trapezoid over the wavelength in nm."""
    rise, full, fall, end = CURVES[channel]
    return F.when((wl < rise) | (wl > end), 0.0).when(wl < full, (wl - rise) / (full - rise)).when(wl <= fall, 1.0).otherwise((end - wl) / (end - fall))


def half_float(bits: Column) -> Column:
    """The value of an IEEE 754 half-precision number given by its 16 bits; null for infinities and NaN."""
    sign = F.when(F.shiftright(bits, 15) % 2 == 1, -1.0).otherwise(1.0)
    exponent, mantissa = F.shiftright(bits, 10) % 32, bits % 1024
    value = F.when(exponent == 0, mantissa / 1024 * 2.0**-14).when(exponent < 31, F.pow(F.lit(2.0), exponent - 15) * (1 + mantissa / 1024))
    return sign * value


def fixed_angle(scaled: Column) -> Column:
    """Degrees of an angle stored as a share of a 32-bit turn."""
    return scaled * (360.0 / 2147483647)
