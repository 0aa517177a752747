"""Rings: assembling fragments, clipping, filling. The per-ring work is done in Arrow batches, one group or row at a time."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = "array<struct<lat:double,lon:double>>"


def assemble(parts: list[list[int]]) -> list[list[int]]:
    """Closed rings of fragments joined end to end in either direction, the first unused one first; what does not close is dropped, and so are rings under four references. Fragments are found by their end nodes, so the work is in proportion to the references."""
    parts, rings, used, ends = [list(p) for p in parts if len(p) > 1], [], set(), defaultdict(deque)
    for i, p in enumerate(parts):
        for node in {p[0], p[-1]}:
            ends[node].append(i)
    for i, p in enumerate(parts):
        if i in used:
            continue
        used.add(i)
        ring = p
        while ring[0] != ring[-1]:
            touching = ends[ring[-1]]
            while touching and touching[0] in used:
                touching.popleft()
            if not touching:
                break
            used.add(touching[0])
            q = parts[touching.popleft()]
            ring += q[1:] if q[0] == ring[-1] else q[-2::-1]
        if ring[0] == ring[-1] and len(ring) >= 4:
            rings.append(ring)
    return rings


def rings(fragments: DataFrame) -> DataFrame:
    """(rel, ring, refs) from (rel, idx, refs): a relation's members are one small group, whose order is idx."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        found = assemble([list(x) for x in g.sort_values("idx")["refs"]])
        return pd.DataFrame({"rel": [int(g["rel"].iloc[0])] * len(found), "ring": list(range(len(found))), "refs": pd.Series([[int(x) for x in r] for r in found], dtype=object)}).astype({"rel": "int64", "ring": "int32"})

    return fragments.groupBy("rel").applyInPandas(one, "rel bigint, ring int, refs array<bigint>")


def clip_ring(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring (lat, lon) cut to a box (lat0, lon0, lat1, lon1), side by side; empty under three points, closed at the end."""
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(ring):
            break
        inside = sign * (ring[:, axis] - bound) >= 0
        out = []
        for a, b, ia, ib in zip(ring, np.roll(ring, -1, 0), inside, np.roll(inside, -1), strict=True):
            if ia:
                out.append(a)
            if ia != ib:
                out.append(a + (b - a) * ((bound - a[axis]) / (b[axis] - a[axis])))
        ring = np.array(out).reshape(-1, 2)
    return np.vstack([ring, ring[:1]]) if len(ring) >= 3 else np.empty((0, 2))


def clipped(df: DataFrame, ring: str, box: tuple[float, float, float, float]) -> DataFrame:
    """df with its rings cut to a box; rings that miss it become empty."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != ring]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.column(ring).to_pylist():
                pts = np.array([(p["lat"], p["lon"]) for p in r or []]).reshape(-1, 2)
                if len(pts) > 1 and (pts[0] == pts[-1]).all():
                    pts = pts[:-1]
                out.append([{"lat": float(a), "lon": float(b)} for a, b in clip_ring(pts, box)])
            names = [n for n in batch.schema.names if n != ring]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))], names=[*names, ring])

    return df.mapInArrow(run, ", ".join([*kept, f"`{ring}` {RING}"]))


def fill(polygons: DataFrame) -> DataFrame:
    """(id, tx, ty, half): triangle texels whose centroid lies inside, even-odd, of edges (id, x0, y0, x1, y1) in texel units. Each edge is dealt to the half-rows that it crosses; the crossings of a half-row, in order, bound its inside runs. Expressions only."""
    from pyspark.sql import Window

    e = polygons.where("y0 <> y1").withColumns({"_lo": F.least("y0", "y1"), "_hi": F.greatest("y0", "y1")})
    e = e.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_o", F.when(F.col("half") == 0, F.lit(1.0) / 3).otherwise(F.lit(2.0) / 3))
    first, last = F.ceil(F.col("_lo") - F.col("_o")).cast("int"), (F.ceil(F.col("_hi") - F.col("_o")) - 1).cast("int")
    e = e.withColumn("ty", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    y = F.col("ty") + F.col("_o")
    e = e.withColumn("x", F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    w = Window.partitionBy("id", "half", "ty").orderBy("x")
    runs = e.withColumns({"_n": F.row_number().over(w), "_x1": F.lead("x").over(w)}).where("_n % 2 = 1 AND _x1 IS NOT NULL")
    a, b = F.ceil(F.col("x") - F.col("_o")).cast("int"), (F.ceil(F.col("_x1") - F.col("_o")) - 1).cast("int")
    return runs.withColumn("tx", F.explode(F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>")))).select("id", "tx", "ty", "half")
