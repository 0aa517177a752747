"""Queries of the route chain: corridors, moves, trips with their paths, and the texels they run over. A recursive statement over all states is out of the oracle's reach, so tests hold them against plain walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import classify as K
from ..operators import corridors as R
from ..operators import graph as G
from ..operators import journeys as J
from ..operators import routes

QUERIES, ORACLE_SQL = {}, {}
#: Depths of the streets' cells.
BASE, FLOOR = 12, 9
#: Rings of texels around a point at the finest depth, and metres at the others.
SNAP = (60, 800.0)
_LAT, _LON = 47.0, -122.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def streets(spark, sf):
    """A street a part: three to seven blocks of a lattice to the east, or to the north; some open one way. (way, pos, node, lat, lon, class, uses, speed_kmh, grade, oneway)"""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("way"), F.col("p_size").alias("size"))
    x, y, n = (F.col("way") % 30) * 2, F.floor(F.col("way") / 30) % 30_000, 3 + F.col("size") % 5
    p = p.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint"))))
    east = F.col("way") % 2 == 0
    p = p.withColumns({"x": x + F.when(east, F.col("pos")).otherwise(0), "y": y + F.when(east, 0).otherwise(F.col("pos"))})
    return p.select(
        "way", "pos", (F.col("y") * 4096 + F.col("x")).alias("node"), (_LAT + F.col("y") * 0.002).alias("lat"), (_LON + F.col("x") * 0.003).alias("lon"), (1 + F.col("way") % 9).cast("int").alias("class"),
        F.lit(19).alias("uses"), (F.col("size") % 3 * 30).cast("int").alias("speed_kmh"), F.lit(0).alias("grade"), F.when(F.col("way") % 7 == 0, 1).when(F.col("way") % 11 == 0, -1).otherwise(0).alias("oneway"),
    )


def meets(placed):
    """(prefix, texel): where the streets (way, node, diamond, u, v) share a node, at the base."""
    shared = placed.groupBy("node").agg(F.countDistinct("way").alias("n"), F.first("diamond").alias("diamond"), F.first("u").alias("u"), F.first("v").alias("v")).where("n >= 2")
    return shared.select(C.prefix(BASE).alias("prefix"), C.texel(BASE).alias("texel")).distinct()


def stamps(spark, sf, near=None, rings=None):
    """The streets' texels of all depths, each depth written once, as the one above it and its readers come back to it. (depth, prefix, texel, way, class, arc, heading, join). near: only those of streets that come within rings {depth: rings of texels} of a point of this table (diamond, u, v), as far as `journeys.snapped` looks if there are none; joins are as in the whole table no farther than that."""
    s = C.encode(streets(spark, sf))
    if near is not None:
        s = G.cut(routes.within(near, s, rings or J.rings(BASE, FLOOR, *SNAP)))
    fine = routes.passed(s, BASE, "class").join(meets(s).withColumn("join", F.lit(True)).hint("shuffle_hash"), ["prefix", "texel"], "left")
    level = every = G.cut(fine.select(F.lit(BASE).alias("depth"), "prefix", "texel", "way", "class", "arc", F.col("heading").cast("bigint").alias("heading"), F.coalesce("join", F.lit(False)).alias("join")))
    for _ in range(FLOOR, BASE):
        level = G.cut(routes.coarser(level).select(*every.columns))
        every = every.unionByName(level)
    return every


def travelling(spark, sf, stamped, mode: str):
    """The streets in `stamped` (way) that this mode may use, as `journeys.travellers` has them, written once. What is joined with stamps and their graph needs no others, and the table of all streets is one that a join would hold whole in the driver."""
    of = streets(spark, sf).where("pos = 0").join(stamped.select("way").distinct(), "way", "left_semi")
    return G.cut(J.travellers(of.select("way", "class", "uses", "speed_kmh", "grade"), mode))


def trips(spark, sf):
    """(trip, lat0, lon0, lat1, lon1): a trip a nation, from a place beside the streets to another."""
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("trip"))
    at = lambda c, k, m: F.lit(c) + (F.col("trip") * k) % m
    return n.select("trip", (_LAT + at(0, 5, 6) * 0.002 + 0.0003).alias("lat0"), (_LON + at(1, 7, 55) * 0.003 + 0.0004).alias("lon0"), (_LAT + at(1, 3, 5) * 0.002 - 0.0002).alias("lat1"), (_LON + at(3, 17, 55) * 0.003 - 0.0007).alias("lon1"))


class Planned:
    """All tables of the trips by car over one set of streets: all of them, or those that come into cells of the floor depth within so many rings of cells around the trips' ends."""

    def __init__(self, spark, sf, mode: str = "car", rings: int | None = None):
        self.trips = trips(spark, sf)
        sides = [C.encode(self.trips.select(F.col("trip").alias("id"), F.col(f"lat{side}").alias("lat"), F.col(f"lon{side}").alias("lon"))) for side in (0, 1)]
        self.around = None if rings is None else (sides[0].unionByName(sides[1]), rings)
        self.stamps = stamps(spark, sf) if rings is None else stamps(spark, sf, self.around[0], {FLOOR: (rings + 1) * C.TEX})
        self.built = G.cut(R.graph(self.stamps))
        self.going = travelling(spark, sf, self.stamps, mode)
        self.known = J.states(self.built, self.going, BASE, FLOOR)
        self.moves = J.moves(self.built, self.known, self.going, mode, BASE, FLOOR)
        ends = [G.cut(J.ends(J.snapped(at, self.stamps, self.going, BASE, FLOOR, *SNAP), self.built, self.known, self.going, mode, arriving)) for at, arriving in zip(sides, (False, True), strict=True)]
        self.starts, self.goals = ends

    def search(self):
        return J.search(self.moves, self.known, self.trips, self.starts, self.goals)

    def inside(self, state) -> bool:
        """Whether every state that passed on lies in a cell that has all its streets. Such cells' nodes, corridors and moves, also those out of them, are those of all streets, and so are the trips then: a search over all streets goes through the same states."""
        if self.around is None:
            return True
        at, n = self.around
        cell = C.prefix(FLOOR)
        gx, gy = C.grid(FLOOR, F.col("_c"))
        spot = lambda df: df.withColumns({"_d": C.cell_diamond(FLOOR, F.col("_c")), "_x": gx, "_y": gy})
        held = spot(at.where("diamond IS NOT NULL").select(cell.alias("_c")).distinct())
        for c in ("_x", "_y"):
            held = held.withColumn(c, F.explode(F.sequence(F.col(c) - n, F.col(c) + n)))
        held = held.select("_d", "_x", "_y").distinct()
        best = J.arrivals(state, self.goals).select("trip", F.col("seconds").alias("_best"))
        passed = state.join(best, "trip", "left").where("_best IS NULL OR seconds < _best").select(F.shiftright("id", 1).alias("id")).distinct()
        of = self.known.join(passed, "id").select(C.ancestor(F.col("prefix"), F.col("depth") - FLOOR).alias("_c")).distinct()
        return spot(of).join(held, ["_d", "_x", "_y"], "left_anti").isEmpty()


def searched(spark, sf, rings: int = 3):
    """(tables, states) of the trips: searched over the streets around them, twice as far until no search came out of what has all its streets, or there are no more streets. So the work goes with the trips and the streets within their reach; the streets are read whole."""
    every = streets(spark, sf).select("way").distinct().count()
    while True:
        p = Planned(spark, sf, rings=rings)
        state = p.search()
        if p.inside(state) or p.stamps.where(F.col("depth") == BASE).select("way").distinct().count() == every:
            return p, state
        rings *= 2


@query
def r4_corridors(spark, sf):
    """The corridors of every cell and depth."""
    s = C.encode(streets(spark, sf))
    return R.of_segments(routes.segments(s, "class").withColumn("kept", K.class_floor(F.col("class"))), meets(s), BASE, FLOOR)


@query
def r5_snapped_levels(spark, sf):
    """The ways that each trip may start on, at every depth that has any near."""
    at = C.encode(trips(spark, sf).select(F.col("trip").alias("id"), F.col("lat0").alias("lat"), F.col("lon0").alias("lon")))
    near = stamps(spark, sf, at)
    return J.snapped(at, near, travelling(spark, sf, near, "car"), BASE, FLOOR, *SNAP).withColumn("metres", F.round("metres", 3))


@query
def r7_trips(spark, sf):
    """The time of every trip and the moves of its path."""
    p, state = searched(spark, sf)
    found = J.arrivals(state, p.goals)
    moved = J.path(state, found).join(p.known.select("id", "depth", "prefix", "way", "name"), "id").join(found.select("trip", "seconds"), "trip")
    return moved.select("trip", "step", "depth", "prefix", "way", "name", "kind", "label", F.round("seconds", 6).alias("seconds"))


@query
def r8_r9_drawn(spark, sf):
    """The texels that every trip runs over, drawn as fine as the cells go."""
    p, state = searched(spark, sf)
    legs = J.legs(J.path(state, J.arrivals(state, p.goals)), p.known, p.starts, p.goals)
    return J.drawn(J.runs(G.cut(legs), p.built, p.stamps, BASE, FLOOR), BASE, FLOOR).select("trip", "n", "depth", "prefix", "way", "texel", F.round("metres", 3).alias("metres"))
