"""Names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def square(name: Column) -> tuple[Column, Column]:
    """The one-degree square (lat, lon of its south-west corner) that a tile's name states, like N47...W121."""
    def signed(letters: str, minus: str) -> Column:
        n = F.regexp_extract(name, f"([{letters}])(\\d+)", 2).try_cast("int")
        return n * F.when(F.regexp_extract(name, f"([{letters}])(\\d+)", 1) == minus, -1).otherwise(1)

    return signed("NS", "S"), signed("WE", "W")


def bounds(name: Column) -> tuple[Column, Column, Column, Column]:
    """North, south, west and east of names like _n90.0_s0.0_w-180.0_e-90.0."""
    part = lambda c: F.regexp_extract(name, f"_{c}(-?[0-9.]+[0-9])", 1).try_cast("double")
    return part("n"), part("s"), part("w"), part("e")
