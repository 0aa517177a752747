"""Trips over stamped ways: where one may stand, the moves between nodes of all depths, least-time search, and the run of texels that a found trip takes.

A state is a cluster of nodes of a way in a cell of some depth, or the hub of a texel where ways meet. States are dealt to
blocks (cells of a coarse depth with all that lies under them). A round of the search settles every block that got better
offers on its own and hands offers to other blocks, so rounds count changes of block along a path. Trips are searched side
by side over the same moves. Which blocks are active is a table that the moves are joined with; the driver sees only whether
there is one. Rounds are written to the folder that all executors share, and the one before is deleted.

Depths share the work as follows. A depth's moves are walked within its reach of either end of the trip and outside the
reach of the next finer depth, or inside that too where no finer state can be entered; a state that can change its depth
neither way walks on. Going up is always tried, going down within the finer depth's reach. A change of depth that ends
inside a corridor goes on to its ends, except where a finer depth is within its reach. Whoever climbs out of a dead end
walks on where they come out.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import classify as K
from ..functions import measure as M
from . import corridors as R
from . import routes
from .graph import cut, forget

#: Metres from a trip's ends within which the finest depth is walked; twice that for each depth above it.
REACH_M = 2000.0
CORRIDOR, TURN, ONTO, HOP, UP, DOWN, START = range(7)
_CELL = ["depth", "prefix", "way"]


def stands(built: DataFrame, ways: DataFrame) -> DataFrame:
    """(depth, prefix, way, texel, name, parts, between, corridor, leaving, arriving): the nodes that can be reached from each texel of a way, at the cost of a length. leaving, arriving: whether its direction lets one go to that node, or come from it."""
    t, c = R.texels_of(built), R.corridors_of(built)
    at = t.where("node IS NOT NULL").select(*_CELL, "texel", F.col("node").alias("name"), F.lit(0).cast("bigint").alias("parts"), F.lit(False).alias("between"), F.lit(None).cast("int").alias("corridor"), F.lit(0).alias("dir"), F.lit(0).alias("end"))
    on = t.where("node IS NULL").join(c.select(*_CELL, "corridor", "a", "b", "dir"), [*_CELL, "corridor"])
    ends = F.array(F.struct(F.col("a").alias("name"), F.col("to_a").alias("parts"), F.lit(1).alias("end")), F.struct(F.col("b").alias("name"), F.col("to_b").alias("parts"), F.lit(2).alias("end")))
    on = on.withColumn("e", F.explode(ends)).where("e.parts IS NOT NULL").select(*_CELL, "texel", "e.name", "e.parts", F.lit(True).alias("between"), "corridor", "dir", "e.end")
    s = at.unionByName(on).join(ways.select("way", "keeps"), "way")
    # from a to b only: nobody leaves for a, nobody arrives from b
    leaving = ~F.col("keeps") | (F.col("dir") == 0) | (F.col("end") == 0) | (F.col("dir") != F.col("end"))
    arriving = ~F.col("keeps") | (F.col("dir") == 0) | (F.col("end") == 0) | (F.col("dir") == F.col("end"))
    return s.select(*_CELL, "texel", "name", "parts", "between", "corridor", leaving.alias("leaving"), arriving.alias("arriving"))


def travellers(ways: DataFrame, mode: str) -> DataFrame:
    """(way, class, speed, keeps) of the ways that this mode (car, bike, foot) may use. ways: way, class, uses, speed_kmh, grade."""
    speed = K.travel_speed(mode, F.col("class"), F.col("uses"), F.col("speed_kmh"), F.col("grade"))
    return ways.select("way", "class", speed.alias("speed"), K.keeps_one_ways(F.lit(mode)).alias("keeps")).where("speed IS NOT NULL")


def _block(depth: Column, prefix: Column, of: int) -> Column:
    """The cell of depth `of` around a cell, or the cell itself where that is coarser."""
    up = F.greatest(depth - of, F.lit(0))
    return F.shiftleft((depth - up).cast("bigint"), 40).bitwiseOR(F.call_function("shiftright", prefix, (2 * up).cast("int")))


def _placed(df: DataFrame, depths: range, texel: str = "texel") -> DataFrame:
    """df (depth, prefix, texel) with the places of texels' centroids."""
    out = None
    for d in depths:
        one = C.texel_place(df.where(F.col("depth") == d), d, texel=texel)
        out = one if out is None else out.unionByName(one)
    return out


def states(built: DataFrame, going: DataFrame, base: int, floor: int, block: int = 10) -> DataFrame:
    """(id, depth, prefix, way, name, block, lat, lon, own, finer, speed, dead), written once so that ids stay: every cluster of nodes of the ways in `going`, and every hub (way is null). own and finer: metres within which the depth, and the one below it, are walked."""
    t = R.texels_of(built).join(going.select("way", "speed"), "way")
    ends = R.corridors_of(built).withColumn("name", F.explode(F.array_distinct(F.array("a", "b")))).groupBy(*_CELL, "name").count()
    nodes = t.where("node IS NOT NULL").groupBy(*_CELL, F.col("node").alias("name")).agg(F.first("speed").alias("speed"), F.max("joint").alias("_joint"))
    nodes = nodes.join(ends, [*_CELL, "name"], "left").withColumn("dead", (F.coalesce("count", F.lit(0)) <= 1) & ~F.col("_joint")).drop("count", "_joint")
    hubs = t.where("joint AND node IS NOT NULL").select("depth", "prefix", F.lit(None).cast("bigint").alias("way"), F.col("texel").alias("name"), F.lit(None).cast("double").alias("speed"), F.lit(False).alias("dead")).distinct()
    s = _placed(nodes.unionByName(hubs), range(floor, base + 1), "name")
    far = lambda d: F.when(d <= floor, F.lit(1e12)).otherwise(REACH_M * F.pow(F.lit(2.0), F.lit(base) - d))
    s = s.withColumns({"own": far(F.col("depth")), "finer": F.when(F.col("depth") < base, far(F.col("depth") + 1)).otherwise(0.0), "block": _block(F.col("depth"), F.col("prefix"), block)})
    return cut(s.withColumn("id", F.monotonically_increasing_id()))


def moves(built: DataFrame, known: DataFrame, going: DataFrame, mode: str, base: int, floor: int) -> DataFrame:
    """(src, dst, block, dst_block, seconds, kind, label, at, lo, at_lat, at_lon, dead): every move between states, written once. label: the corridor gone along; at: the texel where a change of depth comes out inside a corridor; lo: metres from the trip's ends below which that place belongs to a finer depth."""
    where = stands(built, going)
    node = known.where("way IS NOT NULL").select("id", *_CELL, "name", "block", "speed", "dead")
    hub = known.where("way IS NULL").select(F.col("id").alias("hub"), "depth", "prefix", F.col("name").alias("texel"), F.col("block").alias("hub_block"))
    edge_m = lambda parts: F.col(parts) / R.PARTS * C.texel_m(F.col("depth"))
    blank = {"label": F.lit(None).cast("int"), "at": F.lit(None).cast("bigint"), "lo": F.lit(0.0), "at_lat": F.lit(None).cast("double"), "at_lon": F.lit(None).cast("double"), "dead": F.lit(False)}
    columns = ["src", "dst", "block", "dst_block", "seconds", "kind", *blank]
    out = lambda df, kind: df.withColumns({k: v for k, v in blank.items() if k not in df.columns}).withColumn("kind", F.lit(kind)).select(*columns)

    c = R.corridors_of(built).join(going.select("way", "keeps"), "way")
    both = F.array(F.struct(F.col("a").alias("f"), F.col("b").alias("t"), (~F.col("keeps") | (F.col("dir") != 2)).alias("ok")), F.struct(F.col("b").alias("f"), F.col("a").alias("t"), (~F.col("keeps") | (F.col("dir") != 1)).alias("ok")))
    c = c.withColumn("e", F.explode(both)).where("e.ok").select(*_CELL, "len", F.col("corridor").alias("label"), F.col("e.f").alias("name"), F.col("e.t").alias("to"))
    near = node.select(*_CELL, "name", F.col("id").alias("src"), "block", "speed")
    beyond = node.select(*_CELL, F.col("name").alias("to"), F.col("id").alias("dst"), F.col("block").alias("dst_block"))
    along = out(c.join(near, [*_CELL, "name"]).join(beyond, [*_CELL, "to"]).withColumn("seconds", edge_m("len") / F.col("speed")), CORRIDOR)

    # onto another way through the hub of the texel where they meet: the turn is paid on the way in, so no pairs of ways are formed
    t = R.texels_of(built).where("node IS NOT NULL").withColumnRenamed("node", "name").join(node, [*_CELL, "name"])
    met = t.where("joint").join(hub, ["depth", "prefix", "texel"])
    turn = float(K.MODES[mode][1])
    onto = out(met.select(F.col("id").alias("src"), F.col("hub").alias("dst"), "block", F.col("hub_block").alias("dst_block"), F.lit(turn).alias("seconds")), TURN)
    off = out(met.select(F.col("hub").alias("src"), F.col("id").alias("dst"), F.col("hub_block").alias("block"), F.col("block").alias("dst_block"), F.lit(0.0).alias("seconds")), ONTO)

    # across the edge of a cell: node texels that touch in the diamond's grid, of one way, in two cells
    tx, ty, half = C.texel_parts(F.col("texel"))
    edge = t.where((tx == 0) | (ty == 0) | (tx == C.TEX - 1) | (ty == C.TEX - 1))
    crossing = None
    for d in range(floor, base + 1):
        gu, gv = C.grid(d, F.col("prefix"))
        e = edge.where(F.col("depth") == d).select("id", "block", "speed", "way", "prefix", C.cell_diamond(d, F.col("prefix")).alias("diamond"), (gu * C.TEX + tx).alias("x"), (gv * C.TEX + ty).alias("y"), half.alias("half"))
        there = e.select("diamond", "way", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("half").alias("nh"), F.col("id").alias("dst"), F.col("block").alias("dst_block"), F.col("prefix").alias("np"))
        around = F.array(*[F.struct((F.col("x") + dx).alias("nx"), (F.col("y") + dy).alias("ny")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
        j = e.withColumn("b", F.explode(around)).select("*", "b.nx", "b.ny").drop("b").join(there, ["diamond", "way", "nx", "ny"]).where("np <> prefix")
        shift = (F.col("nh") - F.col("half")) / 3.0
        du, dv = F.col("nx") - F.col("x") + shift, F.col("ny") - F.col("y") + shift
        step = F.greatest(F.sqrt(du * du + dv * dv + du * dv), F.lit(1.0)) * C.texel_m(F.lit(d))
        j = j.groupBy(F.col("id").alias("src"), "dst", "block", "dst_block").agg(F.min(step / F.col("speed")).alias("seconds"))
        crossing = out(j, HOP) if crossing is None else crossing.unionByName(out(j, HOP))

    # the same texel a depth up or down
    stand = where.where("leaving").select(*_CELL, "texel", F.col("name").alias("to"), "parts", "between", F.col("corridor").alias("label"))

    def level(moved: DataFrame, kind: int) -> DataFrame:
        j = moved.join(stand, [*_CELL, "texel"]).join(beyond, [*_CELL, "to"])
        j = j.withColumn("seconds", edge_m("parts") / F.col("speed")).withColumn("at", F.when(F.col("between"), F.col("texel")))
        j = _placed(j, range(floor, base + 1)).withColumnsRenamed({"lat": "at_lat", "lon": "at_lon"})
        lo = F.when(F.col("between") & (F.col("depth") < base), REACH_M * F.pow(F.lit(2.0), F.lit(base) - F.col("depth") - 1)).otherwise(0.0)
        return out(j.withColumn("lo", lo), kind)

    from_here = t.select(F.col("id").alias("src"), "block", "speed", "dead", "way", "depth", "prefix", "texel")
    pp, pt = C.texel_parent(F.col("prefix"), F.col("texel"))
    up = level(from_here.select("src", "block", "speed", "dead", "way", (F.col("depth") - 1).alias("depth"), pp.alias("prefix"), pt.alias("texel")), UP)
    down = from_here.withColumn("c", F.explode(C.texel_children(F.col("texel")))).select("src", "block", "speed", F.lit(False).alias("dead"), "way", (F.col("depth") + 1).alias("depth"), (F.col("prefix") * 4 + F.col("c.quarter")).alias("prefix"), F.col("c.texel").alias("texel"))
    every = along.unionByName(onto).unionByName(off).unionByName(crossing).unionByName(up).unionByName(level(down, DOWN))
    # of equal moves the cheapest; a move that comes out inside a corridor stays with its place
    least = F.min_by(F.struct("label", "at", "lo", "at_lat", "at_lon", "dead"), F.struct("seconds", "label", "at")).alias("m")
    return cut(every.groupBy("src", "dst", "block", "dst_block", "kind", (F.col("lo") > 0).alias("_far")).agg(F.min("seconds").alias("seconds"), least).select("src", "dst", "block", "dst_block", "seconds", "kind", "m.*"))


def rings(base: int, floor: int, finest: int, reach_m: float) -> dict[int, int]:
    """{depth: rings of texels around a point that `snapped` looks at}."""
    return {d: finest if d == base else max(int(reach_m / (C.TEXEL_BASE_M / (1 << d) / C.TEX)), 1) for d in range(floor, base + 1)}


def snapped(points: DataFrame, stamps: DataFrame, going: DataFrame, base: int, floor: int, finest: int, reach_m: float = 2000.0) -> DataFrame:
    """(id, depth, prefix, texel, way, metres): the ways that each point (id, diamond, u, v, lat, lon) may start on, at every depth. The finest depth that has any counts as it is; a coarser one is a fallback at twice the metres and 500 more."""
    usable = stamps.join(going.select("way"), "way", "left_semi")
    found = None
    for d, n in rings(base, floor, finest, reach_m).items():
        one = routes.snapped(points, usable.where(F.col("depth") == d).select("prefix", "texel", "way"), d, n).withColumn("depth", F.lit(d))
        found = one if found is None else found.unionByName(one)
    return found.withColumn("_finest", F.max("depth").over(Window.partitionBy("id"))).select("id", "depth", "prefix", "texel", "way", F.when(F.col("depth") == F.col("_finest"), F.col("metres")).otherwise(F.col("metres") * 2 + 500).alias("metres"))


def ends(found: DataFrame, built: DataFrame, known: DataFrame, going: DataFrame, mode: str, arriving: bool) -> DataFrame:
    """(trip, id, block, seconds, depth, prefix, way, texel, name, corridor): the states that a snapped point can go on to (or come from, where arriving), each with its cheapest way there: to the way by car at 15 km/h, else at 4, then along it."""
    off = (15.0 if mode == "car" else 4.0) / 3.6
    s = stands(built, going).where("arriving" if arriving else "leaving")
    j = found.withColumnRenamed("id", "trip").join(s, [*_CELL, "texel"]).join(known.where("way IS NOT NULL").select(*_CELL, "name", "id", "block", "speed"), [*_CELL, "name"])
    j = j.withColumn("seconds", F.col("metres") / off + F.col("parts") / R.PARTS * C.texel_m(F.col("depth")) / F.col("speed"))
    best = F.min_by(F.struct("seconds", *_CELL, "texel", "name", "corridor"), F.struct("seconds", "texel")).alias("b")
    return j.groupBy("trip", "id", "block").agg(best).select("trip", "id", "block", "b.*")


def search(edges: DataFrame, known: DataFrame, trips: DataFrame, starts: DataFrame, goals: DataFrame, most: int = 10_000) -> DataFrame:
    """(trip, id, seconds, pred, kind, label, at): the least time from each trip's starts to the states that it reached before its best end was found, and the move by which it came there. id and pred are states' ids doubled, plus one for whoever came out of a dead end, who may walk where others may not.

    trips: trip, lat0, lon0, lat1, lon1. starts, goals: trip, id, block, seconds (on from a goal to the end). States dearer than a trip's best end do not pass on.
    """
    me = known.select(F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst"), "block", F.lit(None).cast("bigint").alias("dst_block"), F.lit(0.0).alias("seconds"), F.lit(-1).alias("kind"), F.lit(None).cast("int").alias("label"), F.lit(None).cast("bigint").alias("at"), F.when(F.col("way").isNotNull(), F.col("own")).alias("lo"), F.col("lat").alias("at_lat"), F.col("lon").alias("at_lon"), F.lit(False).alias("dead"), "finer")
    edges = cut(edges.withColumn("finer", F.lit(None).cast("double")).unionByName(me))
    kept = ["trip", "id", "block", "seconds", "pred", "kind", "label", "at", "better"]
    begin = F.min_by(F.struct("seconds"), "seconds")["seconds"].alias("seconds")
    state = cut(starts.groupBy("trip", "id", "block").agg(begin).withColumns({"id": F.col("id") * 2, "pred": F.lit(None).cast("bigint"), "kind": F.lit(START), "label": F.lit(None).cast("int"), "at": F.lit(None).cast("bigint"), "better": F.lit(True)}).select(*kept))
    trip = state.schema["trip"].dataType.simpleString()
    target = goals.groupBy("trip", "id").agg(F.min("seconds").alias("extra"))

    def settled(e: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        import heapq

        near: dict[int, list] = {}
        own: dict[int, tuple] = {}
        none = lambda x: x != x or x is None
        for src, dst, block, seconds, kind, label, at, lo, lat, lon, dead, finer in zip(*(e[c].tolist() for c in ("src", "dst", "dst_block", "seconds", "kind", "label", "at", "lo", "at_lat", "at_lon", "dead", "finer")), strict=True):
            if kind < 0:
                own[src] = (lat, lon, lo, finer)
            else:
                near.setdefault(src, []).append((kind not in (UP, DOWN), int(dst), seconds, int(block), kind, label, at, lo, lat, lon, dead))
        for m in near.values():
            m.sort(key=lambda x: x[:3])
        rows: list[tuple] = []
        for name, group in s.groupby("trip"):
            first = group.iloc[0]
            sides, limit = ((first["lat0"], first["lon0"]), (first["lat1"], first["lon1"])), first["limit"]

            def off(lat, lon, sides=sides):
                """Metres to the nearer end of the trip."""
                return min(math.hypot((lat - p) * 111_320.0, (lon - q) * 111_320.0 * math.cos(math.radians((lat + p) / 2))) for p, q in sides)

            best = dict(zip(group["id"].tolist(), group["seconds"].tolist(), strict=True))
            queue = [(g, i) for i, g, b in zip(group["id"].tolist(), group["seconds"].tolist(), group["better"].tolist(), strict=True) if b]
            heapq.heapify(queue)
            inner, outer = {}, {}
            while queue:
                g, i = heapq.heappop(queue)
                if g > best[i] or g >= limit:
                    continue
                lat, lon, reach, finer = own[i >> 1]
                hub = none(reach)
                here = 0.0 if hub else off(lat, lon)
                climbed = descended = False
                walk = None
                for plain, dst, seconds, block, kind, label, at, lo, alat, alon, dead in near.get(i >> 1, ()):
                    if plain:
                        if walk is None:
                            walk = hub or i & 1 or (here < reach and (finer == 0 or here >= finer or not descended)) or not (climbed or descended)
                        if not walk:
                            break
                    elif (kind == DOWN and here >= finer) or (lo and off(alat, alon) < lo):
                        continue
                    else:
                        climbed, descended = climbed or kind == UP, descended or kind == DOWN
                    h, to = g + seconds, dst * 2 + bool(dead)
                    move = (h, i, kind, None if none(label) else int(label), None if none(at) else int(at))
                    if dst in own:
                        if h < best.get(to, math.inf):
                            best[to], inner[to] = h, move
                            heapq.heappush(queue, (h, to))
                    elif h < outer.get(to, (math.inf,))[0]:
                        outer[to] = (*move, block)
            here_block = int(first["block"])
            rows += [(name, i, here_block, *m, True) for i, m in inner.items()] + [(name, i, b, *m, False) for i, (*m, b) in outer.items()]
        out = pd.DataFrame(rows, columns=["trip", "id", "block", "seconds", "pred", "kind", "label", "at", "inner"])
        return out.astype({"label": "Int32", "at": "Int64"})

    for _ in range(most):
        best = state.withColumn("id", F.shiftright("id", 1)).join(target, ["trip", "id"]).groupBy("trip").agg(F.min(F.col("seconds") + F.col("extra")).alias("limit"))
        wave = state.join(best, "trip", "left").withColumn("limit", F.coalesce("limit", F.lit(math.inf)))
        active = cut(wave.where("better AND seconds < limit").select("block").distinct())
        if active.isEmpty():
            break
        here = wave.join(active, "block", "left_semi").join(trips, "trip")
        found = edges.join(active, "block", "left_semi").groupBy("block").cogroup(here.groupBy("block")).applyInPandas(settled, f"trip {trip}, id bigint, block bigint, seconds double, pred bigint, kind int, label int, at bigint, inner boolean")
        move = F.struct("seconds", "pred", "kind", "label", "at")
        mine = found.groupBy("trip", "id", "block").agg(F.min(F.when(F.col("inner"), move)).alias("inner"), F.min(F.when(~F.col("inner"), move)).alias("outer"))
        old = state.select("trip", "id", "block", F.struct("seconds", "pred", "kind", "label", "at").alias("old"))
        both = old.join(mine, ["trip", "id", "block"], "full_outer")
        cheap = lambda a, b: F.when(a.isNull() | (b["seconds"] < a["seconds"]), b).otherwise(a)
        both = both.withColumn("now", cheap(F.col("old"), F.col("inner"))).withColumn("now", F.coalesce("now", "inner"))
        better = F.col("outer").isNotNull() & (F.col("now").isNull() | (F.col("outer.seconds") < F.col("now.seconds")))
        after = both.select("trip", "id", "block", F.when(better, F.col("outer")).otherwise(F.col("now")).alias("now"), better.alias("better")).select("trip", "id", "block", "now.*", "better")
        new = cut(after.select(*kept))
        forget(state, active)
        state = new
    else:
        raise ValueError(f"not settled after {most} rounds")
    forget(edges)
    return state.drop("better")


def arrivals(state: DataFrame, goals: DataFrame) -> DataFrame:
    """(trip, id, seconds): where each trip ends best (as `search` names it), and its whole time. Trips that cannot be made have no row."""
    j = state.select("trip", F.col("id").alias("_i"), F.shiftright("id", 1).alias("id"), F.col("seconds").alias("_s")).join(goals.groupBy("trip", "id").agg(F.min("seconds").alias("extra")), ["trip", "id"]).withColumn("seconds", F.col("_s") + F.col("extra"))
    return j.groupBy("trip").agg(F.min(F.struct("seconds", F.col("_i").alias("id"))).alias("b")).select("trip", "b.id", "b.seconds")


def path(state: DataFrame, found: DataFrame) -> DataFrame:
    """(trip, step, id, pred, kind, label, at): the moves of each trip from its start (step 0) to its end. Pointers to the state before are doubled, so a path of any length takes log rounds of joins."""
    jump = cut(state.where("pred IS NOT NULL").select("trip", "id", F.col("pred").alias("to")))
    seen = cut(found.select("trip", "id", F.lit(0).cast("bigint").alias("back")))
    hop = 1
    while True:
        more = cut(seen.join(jump, ["trip", "id"]).select("trip", F.col("to").alias("id"), (F.col("back") + hop).alias("back")))
        if more.isEmpty():
            break
        grown = cut(seen.unionByName(more))
        double = cut(jump.join(jump.select("trip", F.col("id").alias("to"), F.col("to").alias("_far")), ["trip", "to"]).select("trip", "id", F.col("_far").alias("to")))
        forget(seen, jump, more)
        seen, jump, hop = grown, double, hop * 2
    whole = seen.join(state.select("trip", "id", "pred", "kind", "label", "at"), ["trip", "id"])
    half = lambda c: F.shiftright(c, 1).alias(c)
    return whole.withColumn("step", F.max("back").over(Window.partitionBy("trip")) - F.col("back")).select("trip", "step", half("id"), half("pred"), "kind", "label", "at")


def legs(moved: DataFrame, known: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """(leg struct<trip, step, part>, depth, prefix, way, corridor, a, b, from, to): what of a path runs inside corridors (from node a or texel `from`, to node b or texel `to`) and the texels that it only stands on (a = b, corridor null). Hubs have no texels of their own."""
    at = known.select("id", "depth", "prefix", "way", "name")
    p = moved.join(at, "id").join(known.select(F.col("id").alias("pred"), F.col("name").alias("_a")), "pred", "left").where("way IS NOT NULL")
    leg = lambda part: F.struct("trip", "step", F.lit(part).alias("part")).alias("leg")
    run = F.col("label").isNotNull()
    inside = p.select(leg(1), *_CELL, F.col("label").alias("corridor"), F.when(run & F.col("at").isNull(), F.col("_a")).when(~run, F.col("name")).alias("a"), F.col("name").alias("b"), F.col("at").alias("from"), F.lit(None).cast("bigint").alias("to"))
    first = p.where("step = 0").join(starts.select("trip", "id", F.col("texel").alias("_t"), F.col("corridor").alias("_c")), ["trip", "id"]).where("_c IS NOT NULL")
    first = first.select(leg(0), *_CELL, F.col("_c").alias("corridor"), F.lit(None).cast("bigint").alias("a"), F.col("name").alias("b"), F.col("_t").alias("from"), F.lit(None).cast("bigint").alias("to"))
    top = F.max("step").over(Window.partitionBy("trip"))
    last = p.withColumn("_top", top).where("step = _top").join(goals.select("trip", "id", F.col("texel").alias("_t"), F.col("corridor").alias("_c")), ["trip", "id"]).where("_c IS NOT NULL")
    last = last.select(leg(2), *_CELL, F.col("_c").alias("corridor"), F.col("name").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("bigint").alias("from"), F.col("_t").alias("to"))
    return inside.unionByName(first).unionByName(last)


def runs(legs_: DataFrame, built: DataFrame, stamps: DataFrame, base: int, floor: int) -> DataFrame:
    """(leg, depth, prefix, way, texel, seq): each leg's run of texels, drawn as fine as the finest depth allows, a depth a join."""
    still = legs_.where("corridor IS NULL").select("leg", *_CELL, F.col("b").alias("texel"), F.lit(0).alias("seq"))
    drawn = R.traced(legs_.where("corridor IS NOT NULL"), built).select("leg", *_CELL, "texel", "seq").unionByName(still)
    for _ in range(floor, base):
        finer = cut(R.refined(drawn, stamps).select("leg", *_CELL, "texel", "seq"))
        drawn = finer
    return drawn


def drawn(runs_: DataFrame, base: int, floor: int) -> DataFrame:
    """(trip, n, depth, prefix, way, texel, lat, lon, metres): the texels of each trip in order with their places and the metres from the one before."""
    p = _placed(runs_, range(floor, base + 1))
    w = Window.partitionBy("leg.trip").orderBy("leg.step", "leg.part", "seq")
    before = lambda c: F.lag(c).over(w)
    p = p.withColumn("same", F.coalesce((before("depth") == F.col("depth")) & (before("prefix") == F.col("prefix")) & (before("texel") == F.col("texel")), F.lit(False))).where("NOT same")
    metres = F.coalesce(M.flat_m(before("lat"), before("lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    return p.select("leg.trip", F.row_number().over(w).alias("n"), *_CELL, "texel", "lat", "lon", metres.alias("metres"))
