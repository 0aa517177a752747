"""Bytes of imagery as scene light: a highlight curve over a headroom, then a square root.

A tone is a byte: the curve in the high nibble (0 none, 1 cubic, 2 tanh), the headroom in the low one (1 to 15 times paper
white). Byte 0 is no data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGERY = (2 << 4) | 1


def _parts(tone: Column) -> tuple[Column, Column]:
    return F.shiftright(tone, 4), F.greatest(tone.bitwiseAND(15), F.lit(1))


def unroll(tone: Column, byte: Column) -> Column:
    """The scene light in the middle of a byte's interval."""
    curve, headroom = _parts(tone)
    y = F.pow((byte + 0.5) / 256, F.lit(2.0))
    return F.when(curve == 1, 2 * F.sin(F.asin(y) / 3) * headroom).when(curve == 2, F.atanh(F.least(y, F.lit(0.999999))) * headroom).otherwise(y)


def roll(tone: Column, light: Column) -> Column:
    """The byte of some scene light, 1 at least."""
    curve, headroom = _parts(tone)
    x = F.least(F.greatest(light / headroom, F.lit(0.0)), F.lit(1.0))
    y = F.when(curve == 1, (3 * x - x * x * x) / 2).when(curve == 2, F.tanh(F.greatest(light / headroom, F.lit(0.0)))).otherwise(light)
    return F.least(F.greatest(F.floor(F.sqrt(F.greatest(y, F.lit(0.0))) * 256), F.lit(1)), F.lit(255)).cast("int")


def retone(byte: Column, old: Column, new: Column) -> Column:
    """A byte brought from one tone to another; 0 and bytes that are in it already stay."""
    return F.when((byte == 0) | (old == new), byte).otherwise(roll(new, unroll(old, byte))).cast("int")


#: The reflectance that counts as paper white, of visible bands and of the near infrared.
VISIBLE_WHITE, NIR_WHITE = 0.30, 0.50


def srgb_light(byte: Column) -> Column:
    """Linear light of a display byte."""
    c = byte / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def mixed(bands: list[Column], matrix: list[list[float]]) -> list[Column]:
    """Light in other primaries: a row of the matrix for each of them, a column for each band."""
    return [sum((b * k for b, k in zip(bands[1:], row[1:], strict=True)), bands[0] * row[0]) for row in matrix]


def scene_light(reflectance: list[Column], matrix: list[list[float]], infrared: Column | None = None) -> list[Column]:
    """Scene light of red, green and blue reflectance, and of the near infrared where there is one: 1 is paper white. The matrix, which depends on the eye's cone tables, is given by the caller; for a flat reflector its rows add up to 1."""
    visible = [c / VISIBLE_WHITE for c in mixed(reflectance, matrix)]
    return visible if infrared is None else [*visible, infrared / NIR_WHITE]
