"""The route chain against plain walks: corridors of random ways, trips with their paths, the texels they run over."""

import heapq
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from deltagrid.functions import cells as C
from deltagrid.operators import corridors as R
from deltagrid.operators import journeys as J
from deltagrid.plans import trips as T

DIR = "/root/testdata/sf0.001"
SIDE = 256


def index(x, y, h):
    return (y * SIDE + x) * 2 + h


def around(t):
    x, y = t >> 1 & 255, t >> 9
    return [index(x + dx, y + dy, h) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for h in (0, 1) if 0 <= x + dx < SIDE and 0 <= y + dy < SIDE and index(x + dx, y + dy, h) != t]


def centre(t):
    off = ((t & 1) + 1) / 3
    return (t >> 1 & 255) + off, (t >> 9) + off


def parts(a, b):
    (x, y), (p, q) = centre(a), centre(b)
    du, dv = p - x, q - y
    return math.floor(256 * math.sqrt(du * du + dv * dv + du * dv))


def reached(starts, inside):
    out = list(starts)
    for t in out:
        out += [n for n in around(t) if n in inside and n not in out]
    return out


def components(inside):
    left, out = sorted(inside), []
    while left:
        out.append(reached([left[0]], inside))
        left = [t for t in left if t not in out[-1]]
    return out


def least(starts, goals, inside):
    """Bellman and Ford's way: relaxed until nothing moves."""
    best = dict.fromkeys(starts, 0)
    moved = True
    while moved:
        moved = False
        for t in list(best):
            for n in around(t):
                if n in inside and best[t] + parts(t, n) < best.get(n, 1 << 60):
                    best[n], moved = best[t] + parts(t, n), True
    return min(best[g] for g in goals if g in best)


def plain_graph(texels, edge_m):
    """{texel: (join, arc, heading)} of one way -> ({texel: node}, {(a, b, length, direction)}), told step by step."""
    every = set(texels)
    nodes = {t for t in every if texels[t][0] or t >> 1 & 255 in (0, 255) or t >> 9 in (0, 255) or len(every) == 1}
    more = set()
    clusters = components(nodes)
    for run in components(every - nodes):
        met = [i for i, c in enumerate(clusters) if any(n in c for t in run for n in around(t))]
        if len(met) == 1:
            more.add(reached([t for t in run if any(n in nodes for n in around(t))], set(run))[-1])
        elif not met:
            p = reached([min(run)], set(run))[-1]
            more |= {p, reached([p], set(run))[-1]}
    nodes |= more
    while True:
        clusters, found, lost = components(nodes), [], set()
        for run in components(every - nodes):
            doors = [(c, [t for t in run if any(n in c for n in around(t))]) for c in clusters]
            doors = sorted([(c, d) for c, d in doors if d], key=lambda x: min(x[0]))
            if len(doors) < 2:
                lost |= set(run)
            for i, (a, at) in enumerate(doors):
                for b, bt in doors[i + 1 :]:
                    stairs = least(at, bt, set(run)) / 256 + 2
                    arc = [next((texels[n][1] for t in d for n in around(t) if n in c and texels[n][1] is not None), None) for c, d in ((a, at), (b, bt))]
                    along = abs(arc[1] - arc[0]) / edge_m if None not in arc else 0
                    length = along if stairs / 2 < along < stairs * 1.5 else stairs
                    (x, y), (p, q) = centre(min(a)), centre(min(b))
                    dots = [(p - x) * math.cos(k) + (q - y) * math.sin(k) for t in run if texels[t][2] is not None for k in [texels[t][2] * math.pi / 128]]
                    found.append((min(a), min(b), int(length * 256), 0 if not dots else 1 if sum(dots) >= 0 else 2))
        if not lost:
            return {t: min(c) for c in clusters for t in c}, sorted(found)
        nodes |= lost


def random_way(rng):
    """Texels in steps of a few quarters, with turns, sometimes back over itself, sometimes to the edge."""
    x, y, a = rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(0, 6.3)
    out, arc, oneway, known = {}, 0.0, rng.random() < 0.4, rng.random() < 0.6
    for k in range(rng.randint(1, 160)):
        a += rng.uniform(-0.25, 0.25) + (0.12 if rng.random() < 0.3 else 0)
        x, y, arc = x + 0.25 * math.cos(a), y + 0.25 * math.sin(a), arc + 0.4
        if not (0 <= x < 48 and 0 <= y < 48):
            break
        h = int((x % 1) + (y % 1) >= 1)
        out.setdefault(index(int(x), int(y), h), (rng.random() < 0.03, arc if known else None, int(a / (2 * math.pi) * 256) % 256 if oneway and k % 3 else None))
    return out


def test_corridors_equal_a_plain_walk(spark):
    rng, rows, want_nodes, want = random.Random(4), [], {}, {}
    for prefix in (5, 9):
        for way in range(1, 40):
            texels = random_way(rng)
            if texels:
                rows += [(13, prefix, t, way, arc, heading, join) for t, (join, arc, heading) in texels.items()]
                want_nodes[prefix, way], want[prefix, way] = plain_graph(texels, C.TEXEL_BASE_M / (1 << 13) / 256)
    rng.shuffle(rows)
    built = R.graph(spark.createDataFrame(rows, "depth int, prefix bigint, texel bigint, way bigint, arc double, heading int, join boolean")).cache()
    got_nodes, got = defaultdict(dict), defaultdict(list)
    for r in R.texels_of(built).collect():
        assert (r["node"] is None) != (r["corridor"] is None)
        if r["node"] is not None:
            got_nodes[r["prefix"], r["way"]][r["texel"]] = r["node"]
    for r in R.corridors_of(built).collect():
        got[r["prefix"], r["way"]].append((r["a"], r["b"], r["len"], r["dir"]))
    assert dict(got_nodes) == want_nodes
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert {d for v in got.values() for *_, d in v} == {0, 1, 2}
    assert R.texels_of(built).count() == len(rows)


@pytest.fixture(scope="module")
def planned(spark):
    return T.Planned(spark, DIR)


def crow(a, b):
    k = math.cos(math.radians((a[0] + b[0]) / 2))
    return math.hypot((a[0] - b[0]) * 111_320, (a[1] - b[1]) * 111_320 * k)


def plain_search(planned):
    """Every trip by one queue over all states, (state, came out of a dead end) each."""
    known = {r["id"]: r for r in planned.known.collect()}
    near = defaultdict(list)
    for m in planned.moves.collect():
        near[m["src"]].append(m)
    starts, goals = defaultdict(dict), defaultdict(dict)
    for table, rows in ((starts, planned.starts.collect()), (goals, planned.goals.collect())):
        for r in rows:
            table[r["trip"]][r["id"]] = min(r["seconds"], table[r["trip"]].get(r["id"], math.inf))
    out = {}
    for t in planned.trips.collect():
        ends = (t["lat0"], t["lon0"]), (t["lat1"], t["lon1"])
        off = lambda lat, lon: min(crow((lat, lon), e) for e in ends)  # noqa: B023, E731
        best = {(i, False): g for i, g in starts[t["trip"]].items()}
        queue = [(g, k) for k, g in best.items()]
        heapq.heapify(queue)
        done, answer = set(), None
        while queue:
            g, (i, freed) = heapq.heappop(queue)
            if (i, freed) in done:
                continue
            done.add((i, freed))
            if i in goals[t["trip"]]:
                answer = min(answer or math.inf, g + goals[t["trip"]][i])
            k = known[i]
            here = off(k["lat"], k["lon"])
            allowed = [m for m in near[i] if m["kind"] in (J.UP, J.DOWN) and not (m["kind"] == J.DOWN and here >= k["finer"]) and not (m["lo"] and off(m["at_lat"], m["at_lon"]) < m["lo"])]
            entered = any(m["kind"] == J.DOWN for m in allowed)
            inside = here < k["own"] and (k["finer"] == 0 or here >= k["finer"] or not entered)
            if k["way"] is None or freed or inside or not allowed:
                allowed += [m for m in near[i] if m["kind"] not in (J.UP, J.DOWN)]
            for m in allowed:
                to, h = (m["dst"], m["dead"]), g + m["seconds"]
                if h < best.get(to, math.inf):
                    best[to] = h
                    heapq.heappush(queue, (h, to))
        if answer is not None:
            out[t["trip"]] = answer
    return out


def test_trips_equal_a_plain_search_and_their_paths_add_up(spark, planned):
    want = plain_search(planned)
    state = planned.search().cache()
    found = J.arrivals(state, planned.goals)
    got = {r["trip"]: r["seconds"] for r in found.collect()}
    assert got.keys() == want.keys() and len(got) == 25
    assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
    moves = defaultdict(list)
    for m in planned.moves.collect():
        moves[m["src"], m["dst"], m["kind"]].append(m["seconds"])
    starts, goals = ({(r["trip"], r["id"]): r["seconds"] for r in table.collect()} for table in (planned.starts, planned.goals))
    paths = defaultdict(list)
    for r in J.path(state, found).orderBy("trip", "step").collect():
        paths[r["trip"]].append(r)
    depths = {r["id"]: r["depth"] for r in planned.known.collect()}
    for trip, steps in paths.items():
        assert [s["step"] for s in steps] == list(range(len(steps))) and steps[0]["pred"] is None
        assert all(b["pred"] == a["id"] for a, b in zip(steps, steps[1:], strict=False))
        low = sum(min(moves[s["pred"], s["id"], s["kind"]]) for s in steps[1:]) + starts[trip, steps[0]["id"]] + goals[trip, steps[-1]["id"]]
        high = sum(max(moves[s["pred"], s["id"], s["kind"]]) for s in steps[1:]) + starts[trip, steps[0]["id"]] + goals[trip, steps[-1]["id"]]
        assert low - 1e-6 <= got[trip] <= high + 1e-6
    assert len({depths[s["id"]] for steps in paths.values() for s in steps}) >= 2

    # drawn: connected inside each leg, between its ends, on the way's own texels
    legs = J.legs(J.path(state, found), planned.known, planned.starts, planned.goals).cache()
    coarse = R.traced(legs.where("corridor IS NOT NULL"), planned.built).collect()
    on = {(r["depth"], r["prefix"], r["texel"], r["way"]): r for r in R.texels_of(planned.built).collect()}
    runs = defaultdict(list)
    for r in coarse:
        runs[r["leg"]].append(r)
    asked = {r["leg"]: r for r in legs.where("corridor IS NOT NULL").collect()}
    assert runs.keys() == asked.keys()
    for leg, run in runs.items():
        run.sort(key=lambda r: r["seq"])
        assert all(b["texel"] in around(a["texel"]) for a, b in zip(run, run[1:], strict=False))
        first, last = (on[r["depth"], r["prefix"], r["texel"], r["way"]] for r in (run[0], run[-1]))
        ask = asked[leg]
        assert first["texel"] == ask["from"] if ask["a"] is None else first["node"] == ask["a"]
        assert last["texel"] == ask["to"] if ask["b"] is None else last["node"] == ask["b"]
    fine = J.runs(legs, planned.built, planned.stamps, T.BASE, T.FLOOR).collect()
    under = {(leg, r["depth"], r["prefix"], r["texel"]) for leg, run in runs.items() for r in run}
    drawn = defaultdict(list)
    for r in fine:
        drawn[r["leg"]].append(r)
        assert (r["depth"], r["prefix"], r["texel"], r["way"]) in on
        if r["leg"] in runs:
            up = (r["depth"], r["prefix"], r["texel"])
            while (r["leg"], *up) not in under and up[0] > T.FLOOR:
                x, y, h = up[2] >> 1 & 255, up[2] >> 9, up[2] & 1
                half = 1 if x % 2 and y % 2 else 0 if x % 2 == y % 2 == 0 else h
                up = (up[0] - 1, up[1] >> 2, index(((up[1] >> 1 & 1) << 7) + (x >> 1), ((up[1] & 1) << 7) + (y >> 1), half))
            assert (r["leg"], *up) in under
    check_one_depth_finer(spark, planned, coarse, runs)
    whole = J.drawn(spark.createDataFrame(fine, "leg struct<trip bigint, step bigint, part int>, depth int, prefix bigint, way bigint, texel bigint, seq int"), T.BASE, T.FLOOR)
    for r in whole.groupBy("trip").agg(F.sum("metres").alias("m")).collect():
        t = next(x for x in planned.trips.collect() if x["trip"] == r["trip"])
        assert r["m"] > 0.9 * crow((t["lat0"], t["lon0"]), (t["lat1"], t["lon1"])) - 400


def global_texel(depth, prefix, t):
    x = sum((prefix >> 2 * i + 1 & 1) << i for i in range(depth)) * 256 + (t >> 1 & 255)
    y = sum((prefix >> 2 * i & 1) << i for i in range(depth)) * 256 + (t >> 9)
    return x, y, t & 1


def children(x, y, h):
    return {(2 * x + h, 2 * y + h, h), (2 * x, 2 * y + 1, h), (2 * x + 1, 2 * y, h), (2 * x + h, 2 * y + h, 1 - h)}


def check_one_depth_finer(spark, planned, coarse, runs):
    """A run gets finer just when texels of its way under its own join its ends' children, and then is such a run."""
    ways = defaultdict(set)
    for r in planned.stamps.collect():
        ways[r["depth"], r["way"]].add(global_texel(r["depth"], r["prefix"], r["texel"]))
    schema = "leg struct<trip bigint, step bigint, part int>, depth int, prefix bigint, way bigint, texel bigint, seq int"
    rows = [tuple(r[c] for c in ("leg", "depth", "prefix", "way", "texel", "seq")) for r in coarse]
    finer = defaultdict(list)
    for r in R.refined(spark.createDataFrame(rows, schema), planned.stamps).orderBy("seq").collect():
        finer[r["leg"]].append(r)
    assert finer.keys() == runs.keys()
    count = 0
    for leg, run in runs.items():
        depth, way = run[0]["depth"], run[0]["way"]
        held = [children(*global_texel(depth, r["prefix"], r["texel"])) & ways[depth + 1, way] for r in run]
        inside, seen = set().union(*held), set(held[0])
        wave = list(seen)
        for x, y, h in wave:
            new = {(x + a, y + b, k) for a in (-1, 0, 1) for b in (-1, 0, 1) for k in (0, 1)} & inside - seen
            seen |= new
            wave += new
        got = [global_texel(r["depth"], r["prefix"], r["texel"]) for r in finer[leg]]
        if seen & held[-1]:
            count += 1
            assert finer[leg][0]["depth"] == depth + 1 and set(got) <= inside and got[0] in held[0] and got[-1] in held[-1]
            assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1 for a, b in zip(got, got[1:], strict=False))
        else:
            assert got == [global_texel(depth, r["prefix"], r["texel"]) for r in run]
    assert count > 5


def crossing(spark, join):
    """A one-way street along y = 30 from the west edge to the east edge, a street along x = 40 from the south edge up to it."""
    rows = [(12, 77, index(x, 30, h), 1, None, 0, join and x == 40) for x in range(SIDE) for h in (0, 1)] + [(12, 77, index(40, y, h), 2, None, None, join and y == 30) for y in range(31) for h in (0, 1)]
    return spark.createDataFrame(rows, "depth int, prefix bigint, texel bigint, way bigint, arc double, heading int, join boolean")


@pytest.mark.parametrize(("mode", "join", "reverse", "made"), [("car", True, False, True), ("car", False, False, False), ("car", True, True, False), ("foot", True, True, True), ("bike", True, True, False)])
def test_ways_are_changed_only_where_they_meet_and_one_ways_are_kept(spark, mode, join, reverse, made):
    s = crossing(spark, join).withColumn("class", F.lit(5))
    built = R.graph(s).cache()
    ways = spark.createDataFrame([(1, 5, 31, 30, 0), (2, 5, 31, 30, 0)], "way bigint, class int, uses int, speed_kmh int, grade int")
    going = J.travellers(ways, mode)
    known = J.states(built, going, 12, 12)
    moves = J.moves(built, known, going, mode, 12, 12)
    south, east = (0, index(40, 5, 0), 2), (0, index(200, 30, 0), 1)
    a, b = (east, south) if reverse else (south, east)
    at = lambda e: spark.createDataFrame([(e[0], 12, 77, e[1], e[2], 3.0)], "id bigint, depth int, prefix bigint, texel bigint, way bigint, metres double")
    starts, goals = J.ends(at(a), built, known, going, mode, False), J.ends(at(b), built, known, going, mode, True)
    trips = spark.createDataFrame([(0, 47.0, -122.0, 47.0, -122.0)], "trip bigint, lat0 double, lon0 double, lat1 double, lon1 double")
    found = J.arrivals(J.search(moves, known, trips, starts, goals), goals).collect()
    assert len(found) == int(made)


def test_no_trips_and_no_streets(spark, planned):
    none = planned.starts.limit(0)
    state = J.search(planned.moves, planned.known, planned.trips, none, planned.goals)
    assert state.count() == 0 and J.path(state, J.arrivals(state, planned.goals)).count() == 0
    assert R.graph(planned.stamps.limit(0)).count() == 0


def test_marks_without_pairs_are_those_of_the_graph():
    """A full cell of random junctions: its runs touch so many clusters that pairs are out of proportion to its texels."""
    import random
    import time

    import numpy as np

    from deltagrid.operators import corridors as R

    def cell(n, seed):
        r = random.Random(seed)
        texel = np.array(sorted(y * 512 + x * 2 + h for y in range(20, 20 + n) for x in range(20, 20 + n) for h in (0, 1) if r.random() < 0.8))
        return np.zeros(len(texel), np.int64), texel, np.array([r.random() < 0.05 for _ in texel]), np.full(len(texel), np.nan), np.full(len(texel), np.nan), 1.0

    for seed in range(5):
        small = cell(12, seed)
        assert [r[:4] for r in R._cell_graph(*small, False)[0]] == [r[:4] for r in R._cell_graph(*small)[0]]
    began = time.time()
    rows, none = R._cell_graph(*cell(150, 9), False)
    assert len(rows) > 30_000 and not none and time.time() - began < 20


def test_cells_within_reach_have_all_their_stamps_and_a_search_out_of_them_is_told(spark, tmp_path):
    """Streets far off are read, but not stamped; those around the points have the texels and joins that they have among all."""
    part = spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey", "p_size").where("p_partkey < 60")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 75_000)).write.parquet(f"{tmp_path}/part.parquet")
    at = C.encode(spark.createDataFrame([(1, 47.001, -121.9)], "id bigint, lat double, lon double"))
    near, every = T.stamps(spark, str(tmp_path), at, {T.FLOOR: 2 * C.TEX}), T.stamps(spark, str(tmp_path))
    assert {r["far"] for r in every.selectExpr("way >= 75000 AS far").distinct().collect()} == {True, False}
    assert near.where("way >= 75000").isEmpty() and sorted(near.collect(), key=str) == sorted(every.where("way < 75000").collect(), key=str)

    p = object.__new__(T.Planned)
    cell = at.select(C.prefix(T.FLOOR)).first()[0]
    p.around = at, 1
    p.known = spark.createDataFrame([(0, T.FLOOR, cell), (1, T.FLOOR + 1, cell << 2 | 3), (2, T.FLOOR + 1, (cell ^ 1 << 10) << 2)], "id bigint, depth int, prefix bigint")
    p.goals = spark.createDataFrame([(7, 1, 5.0)], "trip bigint, id bigint, seconds double")
    state = lambda *rows: spark.createDataFrame([(7, i * 2, s) for i, s in rows], "trip bigint, id bigint, seconds double")
    assert p.inside(state((0, 0.0), (1, 10.0)))
    assert p.inside(state((0, 0.0), (1, 10.0), (2, 15.0)))  # dearer than the trip, or as dear, passes nothing on
    assert not p.inside(state((0, 0.0), (1, 10.0), (2, 14.0)))
    assert not p.inside(state((0, 0.0), (2, 99.0)))  # no end found


def test_a_run_with_many_ends_is_walked_from_all_of_them_at_once():
    """A cell whose runs touch clusters by the dozen: a walk an end takes too long row by row."""
    import time

    import numpy as np

    r, side = random.Random(1), 45
    texel = np.array(sorted(y * 512 + x * 2 + h for y in range(20, 20 + side) for x in range(20, 20 + side) for h in (0, 1) if r.random() < 0.8))
    way, none = np.full(len(texel), 7), np.full(len(texel), np.nan)
    join = np.array([r.random() < 0.05 for _ in texel])
    heading = np.array([float(r.randrange(256)) for _ in texel])
    began = time.time()
    rows, found = R._cell_graph(way, texel, join, none, heading, 1.0)
    assert time.time() - began < 8 and len(found) > 5000
    node, run = {row[1]: row[2] for row in rows}, {row[1]: row[3] for row in rows}
    t = R.Texels(np.zeros(len(texel), np.int64), texel)
    beside = lambda k, name: any(node[texel[m]] == name for m in t.near[k])
    for _, _, a, b, length, _, on in r.sample(found, 20):
        of = [k for k in range(len(texel)) if run[texel[k]] == on]
        done, _, _ = t.lengths([k for k in of if beside(k, a)], set(of).__contains__)
        assert length == min(done[k] for k in of if beside(k, b)) + 2 * R.PARTS
    first = {on: (a, b) for _, number, a, b, _, _, on in found if number == on}
    for row in r.sample([row for row in rows if row[3]], 20):
        a, b = first[row[3]]
        of = [k for k in range(len(texel)) if run[texel[k]] == row[3] or node[texel[k]] in (a, b)]
        for name, length in ((a, row[4]), (b, row[5])):
            done, _, _ = t.lengths([k for k in of if node[texel[k]] == name], set(of).__contains__)
            assert length == done[int(np.searchsorted(texel, row[1]))]


def test_corridors_alone_are_those_of_the_graph(spark):
    rng = random.Random(8)
    rows = [(13, prefix, t, way, arc, heading, join) for prefix in (5, 9) for way in range(1, 12) for t, (join, arc, heading) in random_way(rng).items()]
    s = spark.createDataFrame(rows, "depth int, prefix bigint, texel bigint, way bigint, arc double, heading int, join boolean")
    every, alone = R.graph(s).cache(), R.graph(s, texels=False)
    assert alone.where("texel IS NOT NULL").isEmpty() and not alone.isEmpty()
    assert sorted(R.corridors_of(alone).collect()) == sorted(R.corridors_of(every).collect())


def test_only_streets_with_stamps_are_joined_with_them(spark, tmp_path, monkeypatch):
    """Streets out of reach are no part of a table that a join may hold whole in the driver."""

    class Seen(Exception):
        pass

    def seen(built, going, *_):
        raise Seen(going)

    part = spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey", "p_size").where("p_partkey < 60")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 75_000)).write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{DIR}/nation.parquet").where("n_nationkey < 4").write.parquet(f"{tmp_path}/nation.parquet")
    monkeypatch.setattr(J, "states", seen)
    monkeypatch.setattr(J, "snapped", lambda points, stamps, going, *_: seen(stamps, going))
    for plan in (lambda: T.Planned(spark, str(tmp_path), rings=1), lambda: T.r5_snapped_levels(spark, str(tmp_path))):
        with pytest.raises(Seen) as told:
            plan()
        ways = [r["way"] for r in told.value.args[0].collect()]
        assert 0 < len(ways) == len(set(ways)) and max(ways) < 75_000


def test_corridors_of_segments_are_those_of_stamps_that_are_not_written(spark, tmp_path):
    """Streets side by side and, with keys a lattice apart, over one another; what is written goes with their segments, not with their texels."""
    from pathlib import Path

    from deltagrid.operators import graph as G

    part = spark.read.parquet(f"{DIR}/part.parquet").select("p_partkey", "p_size").where("p_partkey < 90")
    part.unionByName(part.where("p_partkey % 3 = 0").withColumn("p_partkey", F.col("p_partkey") + 900_000)).write.parquet(f"{tmp_path}/part.parquet")
    shared = Path("/" + G.shared_dir(spark).removeprefix("file:").lstrip("/"))
    rounds = lambda: {str(p) for p in shared.glob("round-*")}
    before = rounds()
    got = T.r4_corridors(spark, str(tmp_path))
    rows = sorted(got.collect())
    written = rounds() - before
    assert written and sum(spark.read.parquet(p).count() for p in written) < 2 * T.streets(spark, str(tmp_path)).count()
    want = R.corridors_of(R.graph(T.stamps(spark, str(tmp_path)), texels=False))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert rows == sorted(want.collect()) and {r["depth"] for r in rows} == {9, 10, 11, 12}
