"""What a view of the map decides: the depth drawn, the contour interval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texels a degree at depth 0 over pixels a degree: a cell's edge over 256 texels and the metres of a degree.
TEXELS = 7_054_000.0 / (111_320.0 * 256.0)


def texel_px(per_degree: Column, depth: Column) -> Column:
    """Pixels a texel at a depth and so many pixels a degree."""
    return per_degree * TEXELS / F.pow(F.lit(2.0), depth)


def select_depth(per_degree: Column, last: Column, base: Column, coarsest: int = 0) -> Column:
    """The depth to draw: the last one while its texels have 0.45 to 1.05 pixels, else the first with a pixel at most."""
    kept = texel_px(per_degree, last).between(0.45, 1.05)
    return F.when(kept, last).otherwise(F.least(F.greatest(F.ceil(F.log2(per_degree * TEXELS)).cast("int"), F.lit(coarsest)), base))


def depths(per_degree: Column, start: Column, base: Column, coarsest: int = 0) -> Column:
    """The depths drawn in a sequence of views (array of pixels a degree), each leaning on the one before."""
    return F.slice(F.aggregate(per_degree, F.array(start.cast("int")), lambda out, x: F.array_append(out, select_depth(x, F.element_at(out, -1), base, coarsest).cast("int"))), F.lit(2), F.size(per_degree))


def contour_interval(low: Column, high: Column, lines: Column) -> Column:
    """A quarter of the range over the lines wanted on the screen, 0.5 at least; 0 without a range."""
    return F.when(high >= low, F.greatest((high - low) * 0.25 / lines, F.lit(0.5))).otherwise(0.0)
