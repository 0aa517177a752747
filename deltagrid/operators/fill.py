"""The even-odd fill of polygons as table functions: `SELECT ... FROM t, LATERAL fill_polygon(t.rings, t.window)` for rings in a column, `SELECT * FROM fill_edges(TABLE(edges) PARTITION BY id)` for edges in rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Texels that leave in one batch.
BATCH = 1 << 16


def edges_of(ring: list[tuple[float, float]]) -> np.ndarray:
    """(x0, y0, x1, y1) of a ring's edges, the last one back to its first place."""
    return np.array([(*a, *b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)], float)


def texels(edges: list[np.ndarray], window: tuple[float, float, float, float] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tx, ty, half) of the triangle texels whose centroids lie inside, even-odd, a run of rows at a time. Edges are in texel units; window: tx0, ty0, tx1, ty1, the ends left out. Nothing outside the window is worked out."""
    told = np.concatenate([*edges, np.empty((0, 4))])
    x0, y0, x1, y1 = told[told[:, 1] != told[:, 3]].T
    if not len(x0):
        return
    low, high = np.minimum(y0, y1), np.maximum(y0, y1)
    wx0, wy0, wx1, wy1 = window or (-np.inf, -np.inf, np.inf, np.inf)
    for half in (0, 1):
        off = (half + 1) / 3
        first, last = np.maximum(np.ceil(low - off), wy0).astype(np.int64), np.minimum(np.ceil(high - off), wy1).astype(np.int64)
        n = np.maximum(last - first, 0)
        # rows of so many crossings at a time, whole rows only
        rows = np.repeat(np.arange(len(n)), n)
        ty = np.repeat(first, n) + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        x = x0[rows] + (ty + off - y0[rows]) * (x1[rows] - x0[rows]) / (y1[rows] - y0[rows])
        order = np.lexsort((x, ty))
        ty, x = ty[order], x[order]
        # an even number of edges crosses each row, so runs are pairs in order
        begin = np.maximum(np.ceil(x[::2] - off), wx0)
        size = np.maximum(np.minimum(np.ceil(x[1::2] - off), wx1) - begin, 0).astype(np.int64)
        row, begin, keep = ty[::2], begin, size > 0
        row, begin, size = row[keep], begin[keep].astype(np.int64), size[keep]
        at = 0
        while at < len(size):
            some = max(1, int(np.searchsorted(np.cumsum(size[at:]), BATCH, "right")))
            s, b = size[at : at + some], begin[at : at + some]
            tx = np.repeat(b - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
            yield tx, np.repeat(row[at : at + some], s), np.full(len(tx), half, np.int32)
            at += some


@F.udtf(returnType="tx bigint, ty bigint, half int", useArrow=False)
class FillPolygon:
    """fill_polygon(rings array<array<struct<x, y>>>, window struct<tx0, ty0, tx1, ty1> or null): a row a texel. Null or empty rings fill nothing. A row at a time, as lateral joins take no Arrow functions."""

    def eval(self, rings, window):
        told = [[(p["x"], p["y"]) for p in ring or []] for ring in rings or []]
        for tx, ty, half in texels([edges_of(ring) for ring in told if ring], tuple(window) if window else None):
            yield from zip(tx.tolist(), ty.tolist(), half.tolist(), strict=True)


@F.arrow_udtf(returnType="id bigint, tx bigint, ty bigint, half int")
class FillEdges:
    """fill_edges(TABLE(edges) PARTITION BY id): a row a texel of edges (id, x0, y0, x1, y1), in Arrow batches. A partition is one polygon; of its edges four numbers each are held."""

    def __init__(self):
        self.id, self.edges = None, []

    def eval(self, batch: pa.RecordBatch):
        self.id = batch.column("id")[0].as_py()
        self.edges.append(np.stack([batch.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1))
        return iter(())

    def terminate(self):
        for tx, ty, half in texels(self.edges):
            yield pa.table({"id": pa.array(np.full(len(tx), self.id, np.int64)), "tx": pa.array(tx), "ty": pa.array(ty), "half": pa.array(half)})


def register(spark: SparkSession) -> None:
    spark.udtf.register("fill_polygon", FillPolygon)
    spark.udtf.register("fill_edges", FillEdges)
