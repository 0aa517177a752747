"""The graph of stamped ways: nodes, the corridors between them, and runs of texels inside corridors.

A way's texels in a cell that are junctions, lie on the cell's edge or end the way are nodes; nodes that touch form a
cluster, named by its lowest texel. What lies between clusters is a corridor. A group is one cell (131,072 texels a way at
most), whatever the size of the map; all its ways are worked on together.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import cells as C
from .graph import cut

#: Lengths inside cells are counted in so many parts of a texel edge.
PARTS = 256
GRAPH = "depth int, prefix bigint, way bigint, texel bigint, node bigint, corridor int, a bigint, b bigint, len bigint, dir int, to_a bigint, to_b bigint, joint boolean, run int"
_LOW = C.TEX - 1


def centres(texel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of texels' centroids in texel edges along the cell's axes."""
    off = ((texel & 1) + 1) / 3
    return (texel >> 1 & _LOW) + off, (texel >> C.TEX_BITS + 1) + off


def touching(owner: np.ndarray, texel: np.ndarray, width: int = C.TEX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, parts): for rows in order of (owner, texel), where the touching rows of each one begin in `ends`, and how far they are. Touching: both halves of the 3 x 3 squares around. Texels are numbered over a square of `width`."""
    bits = width.bit_length() - 1
    x, y = texel >> 1 & width - 1, texel >> bits + 1
    base = owner * (2 << 2 * bits)
    key = base + texel
    # the squares at one y stand side by side in the order of rows
    left, right = np.maximum(x - 1, 0) * 2, np.minimum(x + 1, width - 1) * 2 + 1
    low, count = (np.empty((len(key), 3), np.int64) for _ in range(2))
    for i, dy in enumerate((-1, 0, 1)):
        line = base + ((y + dy) * width << 1)
        low[:, i] = np.searchsorted(key, line + left)
        count[:, i] = np.where((y + dy >= 0) & (y + dy < width), np.searchsorted(key, line + right, "right") - low[:, i], 0)
    dst = _spans(low.ravel(), count.ravel())
    src = np.repeat(np.arange(len(key)), count.sum(1))
    other = src != dst
    src, dst = src[other], dst[other]
    off = ((texel & 1) + 1) / 3
    du, dv = (x + off)[dst] - (x + off)[src], (y + off)[dst] - (y + off)[src]
    return _starts(src, len(key)), dst, np.floor(PARTS * np.sqrt(du * du + dv * dv + du * dv)).astype(np.int64)


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ..., so many of each."""
    total = np.cumsum(count)
    return np.repeat(first - total + count, count) + np.arange(total[-1] if len(total) else 0)


def _starts(group: np.ndarray, n: int) -> np.ndarray:
    """Where each of n groups begins among rows in their order, and the end."""
    return np.concatenate(([0], np.cumsum(np.bincount(group, minlength=n))))


def _lowest(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The lowest row that each of n rows is joined with. Edges come in order of src, each in both directions."""
    low, first = np.arange(n), np.flatnonzero(np.diff(src, prepend=-1))
    if not len(first):
        return low
    at = src[first]
    while True:
        near = np.minimum.reduceat(low[dst], first)
        less = near < low[at]
        if not less.any():
            return low
        np.minimum.at(low, low[at[less]], near[less])
        while True:
            up = low[low]
            if np.array_equal(up, low):
                break
            low = up


def _firsts(rows: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Which of the rows are the first of their number; slot: room, a place a number."""
    at = np.arange(len(rows))
    slot[rows[::-1]] = at[::-1]
    return slot[rows] == at


def _walk(starts: np.ndarray, begin: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The place of each row in breadth-first walks from the starts over edges (begin, to), -1 where none comes; walks that do not meet keep their own order."""
    rank, slot = np.full(len(begin) - 1, -1), np.empty(len(begin) - 1, np.int64)
    wave, done = starts, 0
    while len(wave):
        rank[wave] = np.arange(done, done + len(wave))
        done += len(wave)
        wave = to[_spans(begin[wave], begin[wave + 1] - begin[wave])]
        wave = wave[rank[wave] < 0]
        wave = wave[_firsts(wave, slot)]
    return rank


def _settle(best: np.ndarray, wave: np.ndarray, row: np.ndarray, begin: np.ndarray, step: np.ndarray, far: np.ndarray) -> np.ndarray:
    """best with the least lengths from the states of the wave, which have theirs. A state goes along the edges of its row (begin; far): on by step states each."""
    slot = np.empty(len(best), np.int64)
    while len(wave):
        on = row[wave]
        first = begin[on]
        count = begin[on + 1] - first
        at = _spans(first, count)
        length, wave = np.repeat(best[wave], count) + far[at], np.repeat(wave, count) + step[at]
        less = length < best[wave]
        length, wave = length[less], wave[less]
        np.minimum.at(best, wave, length)
        wave = wave[_firsts(wave, slot)]
    return best


def _chunks(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of the sizes, in order, in lists with a sum of some _HELD each, or one place."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // _HELD)) + 1)


class Texels:
    """Rows that touch, with the walk over them by length."""

    def __init__(self, owner: np.ndarray, texel: np.ndarray, width: int = C.TEX):
        starts, ends, parts = touching(owner, texel, width)
        s, e, p = starts.tolist(), ends.tolist(), parts.tolist()
        self.near = [e[a:b] for a, b in zip(s, s[1:], strict=False)]
        self.far = [p[a:b] for a, b in zip(s, s[1:], strict=False)]

    def lengths(self, starts: Iterable[int], inside, until=None) -> tuple[dict[int, int], dict[int, int], int | None]:
        """Least lengths from the starts over rows inside, where each was come from, and the first row of `until` met."""
        best = dict.fromkeys(starts, 0)
        back: dict[int, int] = {}
        queue = [(0, k) for k in sorted(best)]
        done: dict[int, int] = {}
        while queue:
            d, k = heapq.heappop(queue)
            if k in done:
                continue
            done[k] = d
            if until is not None and k in until:
                return done, back, k
            for m, part in zip(self.near[k], self.far[k], strict=True):
                if m not in done and (m not in best or d + part < best[m]) and inside(m):
                    best[m], back[m] = d + part, k
                    heapq.heappush(queue, (d + part, m))
        return done, back, None


#: States of walks that are held at a time.
_HELD = 1 << 20
_FAR = np.iinfo(np.int64).max // 2
#: Columns in which -1 stands for null.
_NULLS = {"node", "corridor", "to_a", "to_b", "run"}


class _Ends:
    """The clusters that each run touches, in order of (run, cluster): run, cluster, where their doors begin and how many they have. A door is an edge from a row of the run to one of the cluster; those of an end come in order of the run's walk (rank), else of rows. Runs and clusters go by their lowest rows."""

    def __init__(self, src, dst, node, part, rank=None):
        door = np.flatnonzero(~node[src] & node[dst])
        src, dst = src[door], dst[door]
        order = np.lexsort((dst, src if rank is None else rank[src], part[dst], part[src]))
        self.row, self.beyond, self.edge = src[order], dst[order], door[order]
        run, cluster = part[self.row], part[self.beyond]
        self.begin = np.flatnonzero((np.diff(run, prepend=-1) != 0) | (np.diff(cluster, prepend=-1) != 0))
        self.run, self.cluster = run[self.begin], cluster[self.begin]
        self.doors_of = np.diff(self.begin, append=len(self.row))
        self.met = np.bincount(self.run, minlength=len(node))  # a row: how many clusters the run of that lowest row touches

    def doors(self, ends: np.ndarray) -> np.ndarray:
        """The doors of these ends, one after another."""
        return _spans(self.begin[ends], self.doors_of[ends])


def _cell_columns(way: np.ndarray, texel: np.ndarray, join: np.ndarray, arc: np.ndarray, heading: np.ndarray, edge_m: float, pairs: bool = True, texels: bool = True) -> tuple[dict, dict]:
    """What `graph` tells of one cell, as columns of its texels' rows and of its corridors' rows; -1: null. Rows come in order of (way, texel); arc and heading are NaN where unknown. All ways and runs are worked on together, so steps go with the longest run, not with their number."""
    n = len(way)
    owner = np.cumsum(np.diff(way, prepend=way[:1]) != 0)
    begin, dst, far = touching(owner, texel)
    src = np.repeat(np.arange(n), np.diff(begin))
    x, y = texel >> 1 & _LOW, texel >> C.TEX_BITS + 1
    node = join | (x == 0) | (y == 0) | (x == _LOW) | (y == _LOW) | (np.bincount(owner)[owner] == 1)

    def parts() -> np.ndarray:
        same = node[src] == node[dst]
        return _lowest(n, src[same], dst[same])

    def inner() -> np.ndarray:
        return np.flatnonzero(~node[src] & ~node[dst])

    # runs that touch one cluster, or none, end somewhere: their far ends become nodes
    part = parts()
    ends = _Ends(src, dst, node, part)
    runs = np.flatnonzero(~node & (part == np.arange(n)))
    few = runs[ends.met[runs] < 2]
    if len(few):
        e = inner()
        e = e[ends.met[part[src[e]]] < 2]
        at, to = _starts(src[e], n), dst[e]

        def last(rank):
            order = np.flatnonzero(rank >= 0)
            order = order[np.argsort(rank[order])]
            out = np.full(n, -1)
            out[part[order]] = order
            return out[few]

        rank = _walk(few, at, to)
        one = ends.met[few] == 1
        doors = np.unique(ends.row[ends.met[part[ends.row]] == 1])
        p = last(rank)
        goal = last(_walk(np.concatenate((doors[np.argsort(rank[doors])], p[~one])), at, to))
        node[goal] = True
        node[p[~one]] = True

    while True:
        part = parts()
        ends = _Ends(src, dst, node, part)
        lost = ~node & (ends.met[part] < 2)
        if not lost.any():
            break
        node |= lost
    runs = np.flatnonzero(~node & (part == np.arange(n)))
    met = ends.met[runs]
    number = np.full(n, -1)  # a run's lowest row: its first corridor's number, from 0
    number[runs] = np.cumsum(met * (met - 1) // 2) - met * (met - 1) // 2
    of = {"way": way, "texel": texel, "node": np.where(node, texel[part], -1), "corridor": np.where(node, -1, number[part] + 1), "to_a": np.full(n, -1), "to_b": np.full(n, -1), "joint": node & join}
    found = {c: np.empty(0, np.int64) for c in ("way", "corridor", "a", "b", "len", "dir", "run")}
    if not pairs or not len(runs):
        return of, found

    e = inner()
    at, to, length = _starts(src[e], n), dst[e], far[e]
    rank = _walk(runs, at, to)
    ends = _Ends(src, dst, node, part, rank)
    first = np.cumsum(met) - met  # of each run among the ends
    # the first place along the way that a run's walk meets at each end
    known = np.where(np.isnan(arc[ends.beyond]), len(ends.row), np.arange(len(ends.row)))
    known = np.append(arc[ends.beyond], np.nan)[np.minimum.reduceat(known, ends.begin)]
    # walks from each end of a run but its last one, all at once: a walk's states are the rows of its run, which stand side by side
    rows = np.flatnonzero(~node)
    rows = rows[np.argsort(part[rows], kind="stable")]
    place = np.empty(n, np.int64)
    place[rows] = np.arange(len(rows))
    by = np.argsort(place[src[e]], kind="stable")
    row_at, row_far = _starts(place[src[e]][by], len(rows)), length[by]
    row_step = (place[to] - place[src[e]])[by]
    size = np.bincount(np.searchsorted(runs, part[rows]), minlength=len(runs))
    base = np.cumsum(size) - size
    run = np.repeat(np.arange(len(runs)), met * (met - 1) // 2)  # of each pair
    walks = np.repeat(np.arange(len(runs)), met - 1)  # the run of each walk
    source = np.arange(len(walks)) + walks  # its end, as runs have one end more than walks
    others = first[walks] + met[walks] - 1 - source
    pa_, pb, least = np.repeat(source, others), _spans(source + 1, others), np.empty(len(run), np.int64)
    after = np.cumsum(others) - others
    for chunk in _chunks(size[walks]):
        states = size[walks[chunk]]
        shift = np.cumsum(states) - states - base[walks[chunk]]
        row = _spans(base[walks[chunk]], states)
        doors = ends.doors(source[chunk])
        starts = np.unique(place[ends.row[doors]] + np.repeat(shift, ends.doors_of[source[chunk]]))
        best = np.full(len(row), _FAR)
        best[starts] = 0
        best = _settle(best, starts, row, row_at, row_step, row_far)
        b = _spans(source[chunk] + 1, others[chunk])
        doors = best[place[ends.row[ends.doors(b)]] + np.repeat(np.repeat(shift, others[chunk]), ends.doors_of[b])]
        least[after[chunk[0]] : after[chunk[-1]] + others[chunk[-1]]] = np.minimum.reduceat(doors, np.cumsum(ends.doors_of[b]) - ends.doors_of[b])
    stairs = least / PARTS + 2
    along = np.abs(known[pb] - known[pa_]) / edge_m
    steps = np.where((stairs * 0.5 < along) & (along < stairs * 1.5), along, stairs)
    a, b = ends.cluster[pa_], ends.cluster[pb]

    # a run goes the way that most of its headings do
    cx, cy = centres(texel)
    told = np.flatnonzero(~node & (heading == heading))
    turn = heading[told] * (2 * math.pi / 256)
    where = np.searchsorted(runs, part[told])
    turns = np.bincount(where, minlength=len(runs))
    du, dv = cx[b] - cx[a], cy[b] - cy[a]
    dot = du * np.bincount(where, np.cos(turn), len(runs))[run] + dv * np.bincount(where, np.sin(turn), len(runs))[run]
    order = told[np.lexsort((rank[told], where))]
    begins = _starts(where, len(runs))
    for k in np.flatnonzero((turns[run] > 0) & (np.abs(dot) < 1e-9 * turns[run] * (np.abs(du) + np.abs(dv)))):  # a sum so near to none goes by the order of the run
        rows = order[begins[run[k]] : begins[run[k] + 1]]
        dot[k] = sum(du[k] * math.cos(h) + dv[k] * math.sin(h) for h in heading[rows] * (2 * math.pi / 256))
    found = {"way": way[a], "corridor": np.arange(1, len(run) + 1), "a": texel[a], "b": texel[b], "len": (steps * PARTS).astype(np.int64), "dir": np.where(turns[run] == 0, 0, np.where(dot >= 0, 1, 2)), "run": number[runs[run]] + 1}
    if not texels:
        return of, found

    # all rows of a run carry its first corridor, with the lengths to that one's two ends: over the run and the other end's cluster
    members = np.flatnonzero(node)
    members = members[np.argsort(part[members], kind="stable")]
    sizes = np.bincount(part[members], minlength=n)
    begins = np.cumsum(sizes) - sizes
    for name, here, there in (("to_a", first, first + 1), ("to_b", first + 1, first)):
        best = np.full(n, _FAR)
        size = sizes[ends.cluster[there]]
        for chunk in _chunks(size):
            copy = members[_spans(begins[ends.cluster[there[chunk]]], size[chunk])]
            on = np.repeat(runs[chunk], size[chunk])
            held = on * n + copy  # in order, as a cluster's rows are
            count = begin[copy + 1] - begin[copy]
            edge, frm = _spans(begin[copy], count), np.repeat(np.arange(len(copy)), count)
            m = dst[edge]
            stay = np.where(node[m], part[m] == part[copy[frm]], part[m] == on[frm])
            edge, frm, m = edge[stay], frm[stay], m[stay]
            mine = np.where(node[m], n + np.searchsorted(held, on[frm] * n + m), m)
            door = ends.doors(there[chunk])
            back = n + np.searchsorted(held, part[ends.row[door]] * n + ends.beyond[door])
            inside = np.isin(part[src[e]], runs[chunk]) if len(chunk) < len(runs) else slice(None)
            s = np.concatenate((src[e][inside], ends.row[door], n + frm))
            t = np.concatenate((to[inside], back, mine))
            f = np.concatenate((length[inside], far[ends.edge[door]], far[edge]))
            by = np.argsort(s, kind="stable")
            door = ends.doors(here[chunk])
            state = np.full(n + len(copy), _FAR)
            np.minimum.at(state, ends.row[door], far[ends.edge[door]])
            state = _settle(state, np.unique(ends.row[door]), np.arange(len(state)), _starts(s, len(state)), (t - s)[by], f[by])
            best = np.minimum(best, state[:n])
        of[name] = np.where(best < _FAR, best, -1)
    return of, found


def _cell_graph(way: np.ndarray, texel: np.ndarray, join: np.ndarray, arc: np.ndarray, heading: np.ndarray, edge_m: float, pairs: bool = True) -> tuple[list, list]:
    """(texel rows, corridor rows) of one cell, as tuples."""
    rows = lambda columns: list(zip(*([None if v == -1 and name in _NULLS else v for v in c.tolist()] for name, c in columns.items()), strict=True))
    texels, found = _cell_columns(way, texel, join, arc, heading, edge_m, pairs)
    return rows(texels), rows(found)


def graph(stamps: DataFrame, pairs: bool = True, texels: bool = True) -> DataFrame:
    """The graph of all cells and depths: a row a texel and way (its node's name, or its corridor with the lengths to_a, to_b to that one's ends), and a row a corridor (texel is null): its ends a and b, its length, whether it is open both ways (0), from a to b (1) or from b to a (2).

    stamps: depth, prefix, texel, way, arc (metres along the way, or null), heading (256ths of a turn, or null), join; one row a texel and way. Lengths are in 256ths of a texel edge: the way's own where arcs at both ends are known and within half of the shortest run, else the run plus two edges. Without pairs only a texel's node or corridor is told, in time that grows with the texels, not with the pairs of clusters that runs touch. Without texels only the corridors' rows are told, the same ones.
    """

    kinds = to_arrow_schema(StructType.fromDDL(GRAPH))

    def built(key, cell):
        depth, prefix = (k.as_py() for k in key)
        way, texel = cell.column("way").to_numpy(), cell.column("texel").to_numpy()
        order = np.lexsort((texel, way))
        get = lambda c: cell.column(c).to_numpy()[order]
        of, found = _cell_columns(way[order], texel[order], get("join").astype(bool), get("arc"), get("heading"), C.TEXEL_BASE_M / (1 << depth) / C.TEX, pairs, texels)

        def table(columns: dict) -> pa.Table:
            n = len(columns["way"])
            columns = columns | {"depth": np.full(n, depth), "prefix": np.full(n, prefix)}
            return pa.table([pa.array(columns[f.name], mask=columns[f.name] == -1 if f.name in _NULLS else None).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in kinds], schema=kinds)

        return pa.concat_tables([table(of | {"run": of["corridor"]}), table(found)] if texels else [table(found)])

    s = stamps.select(F.col("depth").cast("int").alias("depth"), F.col("prefix").cast("bigint"), F.col("texel").cast("bigint"), F.col("way").cast("bigint"), F.col("arc").cast("double"), F.col("heading").cast("double"), F.coalesce("join", F.lit(False)).alias("join"))
    return s.groupBy("depth", "prefix").applyInArrow(built, GRAPH)


class _Pyramid:
    """The corridors of a cell and of all cells under it down to depth `base`, of the segments that pass it: their stamps are made a finest cell at a time and joined up the depths, as `routes.passed` and `routes.coarser` have them, and no others are held. Cells are walked depth first."""

    def __init__(self, base: int, segments: dict[str, np.ndarray], meets: np.ndarray):
        self.base, self.s, self.meets = base, segments, meets  # meets: (cell << 17 | texel), in order
        self.found: list[dict] = []

    def stamps(self, depth: int, prefix: int, x: int, y: int, of: np.ndarray) -> dict[str, np.ndarray]:
        """The stamps of the cell at column x and row y of its diamond, of those of the segments `of` that come near it; its corridors go to `found`."""
        s, bits = self.s, 30 - depth
        inside = lambda c, at: (np.minimum(s[f"{c}0"][of], s[f"{c}1"][of]) >> bits <= at) & (np.maximum(s[f"{c}0"][of], s[f"{c}1"][of]) >> bits >= at)
        of = of[inside("u", x) & inside("v", y)]
        if depth == self.base:
            held = self._passed(prefix, x, y, of)
        else:
            parts = [_above(self.stamps(depth + 1, prefix * 4 + i * 2 + j, x * 2 + i, y * 2 + j, of), depth, i, j) for i in (0, 1) for j in (0, 1)] if len(of) else []
            held = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else _NONE
            order = np.lexsort((held["texel"], held["way"]))
            held = {c: v[order] for c, v in held.items()}
        if len(held["way"]):
            _, found = _cell_columns(held["way"], held["texel"], held["join"], held["arc"], held["heading"], C.TEXEL_BASE_M / (1 << depth) / C.TEX, True, False)
            if len(found["way"]):
                self.found.append(found | {"depth": np.full(len(found["way"]), depth), "prefix": np.full(len(found["way"]), prefix)})
        return held

    def _passed(self, prefix: int, x: int, y: int, of: np.ndarray) -> dict[str, np.ndarray]:
        unit = float(1 << (30 - self.base - C.TEX_BITS))
        px, py = self.s["u0"][of] / unit, self.s["v0"][of] / unit
        dx, dy = self.s["u1"][of] / unit - px, self.s["v1"][of] / unit - py
        steps = np.maximum(np.ceil(np.sqrt(dx * dx + dy * dy) * 4), 1).astype(np.int64)
        on = np.repeat(np.arange(len(of)), steps + 1)
        k = _spans(np.zeros(len(of), np.int64), steps + 1)
        t = k / steps[on]
        gx, gy = px[on] + dx[on] * t, py[on] + dy[on] * t
        tx, ty = np.floor(gx).astype(np.int64), np.floor(gy).astype(np.int64)
        here = np.flatnonzero((tx >> C.TEX_BITS == x) & (ty >> C.TEX_BITS == y))
        on, k, t, gx, gy, tx, ty = (c[here] for c in (on, k, t, gx, gy, tx, ty))
        half = ((gx - tx) + (gy - ty) >= 1).astype(np.int64)
        texel, way = ((ty & _LOW) << C.TEX_BITS | tx & _LOW) << 1 | half, self.s["way"][of][on]
        order = np.lexsort((k, self.s["row"][of][on], texel, way))
        order = order[(np.diff(way[order], prepend=-1) != 0) | (np.diff(texel[order], prepend=-1) != 0)]
        on, texel, t = on[order], texel[order], t[order]
        return {"way": way[order], "texel": texel, "kept": self.s["kept"][of][on], "arc": self.s["before"][of][on] + self.s["seg"][of][on] * t, "heading": self.s["heading"][of][on], "join": np.isin(prefix << 2 * C.TEX_BITS + 1 | texel, self.meets)}


_NONE = {"way": np.empty(0, np.int64), "texel": np.empty(0, np.int64), "kept": np.empty(0, np.int64), "arc": np.empty(0), "heading": np.empty(0), "join": np.empty(0, bool)}


def _above(held: dict[str, np.ndarray], depth: int, i: int, j: int) -> dict[str, np.ndarray]:
    """The stamps of a cell as its parent at this depth has them, whose quarter (i, j) it is: as `routes.coarser`. No parent has texels of two quarters."""
    keep = held["kept"] <= depth
    held = {c: v[keep] for c, v in held.items()}
    tx, ty, half = held["texel"] >> 1 & _LOW, held["texel"] >> C.TEX_BITS + 1, held["texel"] & 1
    ox, oy = tx & 1, ty & 1
    up = np.where(ox == oy, ox, half)
    child = np.where(half != up, 3, np.where(ox == oy, 0, np.where(oy == 1, 1, 2)))
    texel = (((j << C.TEX_BITS - 1) + (ty >> 1)) << C.TEX_BITS | (i << C.TEX_BITS - 1) + (tx >> 1)) << 1 | up
    order = np.lexsort((child, held["way"], texel))
    held, texel = {c: v[order] for c, v in held.items()}, texel[order]
    begin = np.flatnonzero((np.diff(texel, prepend=-1) != 0) | (np.diff(held["way"], prepend=-1) != 0))
    if not len(begin):
        return held
    n = np.arange(len(texel))
    told = np.minimum.reduceat(np.where(np.isnan(held["heading"]), len(n), n), begin)
    joined, texel = np.logical_or.reduceat(held["join"], begin), texel[begin]
    # a texel's rows stand side by side
    spot = np.flatnonzero(np.diff(texel, prepend=-1) != 0)
    many = np.diff(spot, append=len(texel))
    return {"way": held["way"][begin], "texel": texel, "kept": held["kept"][begin], "arc": held["arc"][begin], "heading": np.append(held["heading"], np.nan)[told], "join": np.repeat(np.logical_or.reduceat(joined, spot) & (many >= 2), many)}


def of_segments(segments: DataFrame, meets: DataFrame, base: int, floor: int) -> DataFrame:
    """The corridors of all cells of the depths from base up to floor, as `corridors_of` has them of the graph of the stamps, which are made a cell at a time and written nowhere: what goes over the disk grows with the segments, not with their texels. A group is one cell of the floor depth with all that lies under it.

    segments: as `routes.segments` has them, with kept: the coarsest depth that has the way. meets: prefix, texel at the base where ways meet.
    """
    kinds = "depth int, prefix bigint, way bigint, corridor int, a bigint, b bigint, len bigint, dir int, run int"
    schema = to_arrow_schema(StructType.fromDDL(kinds))

    def built(key, cell):
        prefix = key[0].as_py()
        inner = np.array([prefix & ((1 << 2 * floor) - 1)])
        x, y = int(_compact(inner >> 1)[0]), int(_compact(inner)[0])
        of = cell.filter(pc.is_valid(cell.column("way")))
        met = cell.filter(pc.is_valid(cell.column("_met"))).column("_met").to_numpy()
        p = _Pyramid(base, {c: of.column(c).to_numpy().astype(np.float64 if c in ("before", "seg", "heading") else np.int64) for c in of.column_names if c not in ("_cell", "_met")}, np.sort(met))
        p.stamps(floor, prefix, x, y, np.arange(of.num_rows))
        tables = [pa.table([pa.array(f[c.name]).cast(c.type) for c in schema], schema=schema) for f in p.found]
        return pa.concat_tables(tables) if tables else schema.empty_table()

    bits = 30 - floor
    square = lambda c: F.explode(F.sequence(F.shiftright(F.least(f"{c}0", f"{c}1"), bits), F.shiftright(F.greatest(f"{c}0", f"{c}1"), bits)))
    s = segments.withColumn("_x", square("u")).withColumn("_y", square("v")).withColumn("_cell", C.from_grid(floor, F.col("diamond"), F.col("_x"), F.col("_y")))
    s = s.select("_cell", "way", "row", *(F.col(c).cast("int") for c in ("u0", "v0", "u1", "v1")), "before", "seg", F.col("heading").cast("int"), F.col("kept").cast("int"))
    m = meets.select(C.ancestor(F.col("prefix"), base - floor).alias("_cell"), F.shiftleft(F.col("prefix"), 2 * C.TEX_BITS + 1).bitwiseOR(F.col("texel")).alias("_met"))
    rows = cut(s.unionByName(m, allowMissingColumns=True))
    # a task a cell or so: the rows are few for the work that they make
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.select("_cell").distinct().count())
    return rows.repartition(n, "_cell").groupBy("_cell").applyInArrow(built, kinds)


def texels_of(built: DataFrame) -> DataFrame:
    """(depth, prefix, way, texel, node, corridor, to_a, to_b, joint)."""
    return built.where("texel IS NOT NULL").drop("a", "b", "len", "dir", "run")


def corridors_of(built: DataFrame) -> DataFrame:
    """(depth, prefix, way, corridor, a, b, len, dir, run): run is the corridor that its texels carry, which corridors of one hub share."""
    return built.where("texel IS NULL").select("depth", "prefix", "way", "corridor", "a", "b", "len", "dir", "run")


def check(stamps: DataFrame, built: DataFrame) -> DataFrame:
    """(depth, prefix, way, texels, nodes, inside, unmarked): how a way's texels in each cell are accounted for; a sound graph leaves none unmarked."""
    key = ["depth", "prefix", "way", "texel"]
    t = texels_of(built).select(*key, "node", "corridor")
    j = stamps.select(*(F.col(c).cast("bigint") if c != "depth" else F.col(c).cast("int") for c in key)).distinct().join(t, key, "left")
    return j.groupBy("depth", "prefix", "way").agg(F.count("*").alias("texels"), F.count("node").alias("nodes"), F.count("corridor").alias("inside"), F.count_if(F.col("node").isNull() & F.col("corridor").isNull()).alias("unmarked"))


# ---- runs


def run_between(texel: np.ndarray, starts: np.ndarray, goals: np.ndarray, width: int = C.TEX) -> list[int] | None:
    """The shortest run over touching texels from a start to a goal (flags a row), as rows in order; null where none joins them."""
    if not len(texel):
        return None
    order = np.argsort(texel, kind="stable")
    t = Texels(np.zeros(len(texel), np.int64), texel[order], width)
    starts, goals = np.flatnonzero(starts[order]).tolist(), set(np.flatnonzero(goals[order]).tolist())
    _, back, hit = t.lengths(starts, lambda m: True, goals)
    if hit is None:
        return None
    run = [hit]
    while run[-1] in back:
        run.append(back[run[-1]])
    return [int(order[k]) for k in reversed(run)]


def traced(legs: DataFrame, built: DataFrame) -> DataFrame:
    """(leg, seq, depth, prefix, way, texel): the shortest run of each leg through the texels of its corridor and the nodes at its ends, from node `a` (or, where that is null, the texel `from`) to node `b` (or the texel `to`). legs: leg, depth, prefix, way, corridor, a, b, from, to."""
    t = texels_of(built).withColumnRenamed("corridor", "_on")
    marked = corridors_of(built).select("depth", "prefix", "way", "corridor", "run", F.col("a").alias("_a"), F.col("b").alias("_b"))
    rows = legs.join(marked, ["depth", "prefix", "way", "corridor"]).join(t, ["depth", "prefix", "way"]).where("node = _a OR node = _b OR _on = run")
    at = lambda name, texel: F.coalesce(F.when(F.col(name).isNotNull(), F.col("node") == F.col(name)).otherwise(F.col("texel") == F.col(texel)), F.lit(False))
    rows = rows.select("leg", "depth", "prefix", "way", "texel", at("a", "from").alias("from"), at("b", "to").alias("to"))

    def run(key, group):
        texel = group.column("texel").to_numpy()
        flag = lambda c: group.column(c).to_numpy(zero_copy_only=False).astype(bool)
        rows = run_between(texel, flag("from"), flag("to")) or []
        return pa.table([group.column(c).take(pa.array(rows, pa.int64())) for c in ("leg", "depth", "prefix", "way", "texel")] + [pa.array(range(len(rows)), pa.int32())], names=["leg", "depth", "prefix", "way", "texel", "seq"])

    return rows.groupBy("leg").applyInArrow(run, _run_schema(legs))


def refined(runs: DataFrame, stamps: DataFrame) -> DataFrame:
    """Runs a depth finer: of each run (leg, way, depth; seq, prefix, texel), the shortest run over the texels of its way that lie under its own, from under its first to under its last. A run whose finer texels do not join stays as it is.

    stamps: depth, prefix, texel, way of all depths.
    """
    parts = runs.withColumn("child", F.explode(C.texel_children(F.col("texel"))))
    last = F.max("seq").over(Window.partitionBy("leg"))
    parts = parts.withColumns({"from": F.col("seq") == 0, "to": F.col("seq") == last})
    under = parts.select("leg", "way", (F.col("depth") + 1).alias("depth"), (F.col("prefix") * 4 + F.col("child.quarter")).alias("prefix"), F.col("child.texel").alias("texel"), "from", "to")
    held = under.join(stamps.select("depth", "prefix", "texel", "way").distinct(), ["depth", "prefix", "texel", "way"])
    both = held.unionByName(runs.withColumns({"from": F.lit(None).cast("boolean"), "to": F.lit(None).cast("boolean"), "old": F.col("seq")}).drop("seq"), allowMissingColumns=True)
    def run(key, group):
        names = ["leg", "depth", "prefix", "way", "texel", "seq"]
        old, new = group.filter(group.column("old").is_valid()), group.filter(pc.invert(group.column("old").is_valid()))
        if new.num_rows:
            depth = new.column("depth")[0].as_py()
            # cells side by side in one grid, around the run's own corner
            prefix, texel = new.column("prefix").to_numpy(), new.column("texel").to_numpy()
            inner = prefix & ((1 << 2 * depth) - 1)
            gx = _compact(inner >> 1) * C.TEX + (texel >> 1 & _LOW)
            gy = _compact(inner) * C.TEX + (texel >> C.TEX_BITS + 1)
            gx, gy = gx - gx.min(), gy - gy.min()
            width = 1 << int(max(gx.max(), gy.max())).bit_length()
            flag = lambda c: new.column(c).to_numpy(zero_copy_only=False).astype(bool)
            rows = run_between((gy * width + gx) * 2 + (texel & 1), flag("from"), flag("to"), width)
            if rows is not None:
                return pa.table([new.column(c).take(pa.array(rows, pa.int64())) for c in names[:-1]] + [pa.array(range(len(rows)), pa.int32())], names=names)
        old = old.sort_by("old")
        return pa.table([*(old.column(c) for c in names[:-1]), old.column("old").cast(pa.int32())], names=names)

    return both.groupBy("leg").applyInArrow(run, _run_schema(runs))


def _run_schema(of: DataFrame) -> StructType:
    return StructType([of.schema["leg"], *StructType.fromDDL("depth int, prefix bigint, way bigint, texel bigint, seq int")])


def _compact(m: np.ndarray) -> np.ndarray:
    """Every second bit, from the lowest, side by side."""
    out = np.zeros_like(m)
    for i in range(30):
        out |= (m >> 2 * i & 1) << i
    return out
