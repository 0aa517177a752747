"""Queries of the table operators: pyramids, merges, lines, terrain, search, addresses, audits, graphs, tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit as A
from ..operators import graph as G
from ..operators import lines as L
from ..operators import merge as U
from ..operators import pyramid as P
from ..operators import search as S
from ..operators import terrain as R
from ..operators.dealt import dealt
from ..streaming import tracks as K
from . import views as V
from .rules import NORMAL

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Texels of 64 cells of depth 14, dense enough that parents have several children.
_TEXEL = {"depth": "14", "prefix": "805306368 + l_orderkey % 64", "texel": "((l_partkey * 101 + l_suppkey * 7) % 64) * 512 + (l_partkey * 13) % 128", "class": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 0 END", "cov": "CAST(l_quantity AS BIGINT) * 2", "mag": "(l_partkey * 13) % 255 + 1", "uses": "CAST((l_suppkey * 7) % 64 AS BIGINT)", "seq": "l_orderkey * 100000 + l_partkey * 8 + l_linenumber"}


def texels(spark, sf):
    """One row a texel: the stamp with most coverage, of equals the lowest class and then the first."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*(f"CAST({e} AS BIGINT) AS `{c}`" for c, e in _TEXEL.items()))
    best = F.max_by(F.struct("class", "cov", "mag", "seq"), F.struct(F.col("cov"), (-F.col("class")).alias("c"), (-F.col("seq")).alias("s")))
    g = t.groupBy("depth", "prefix", "texel").agg(best.alias("b"), F.bit_or(F.when(F.col("cov") > 0, F.col("uses")).otherwise(0)).alias("uses"))
    return g.select("depth", "prefix", "texel", "b.class", "b.cov", "b.mag", "b.seq", "uses")


STAMPS = f"(SELECT {', '.join(f'CAST({e} AS BIGINT) AS {c}' for c, e in _TEXEL.items())} FROM lineitem)"
TEXELS = f"(SELECT depth, prefix, texel, class, cov, mag, seq, bor AS uses FROM (SELECT *, row_number() OVER (PARTITION BY prefix, texel ORDER BY cov DESC, class, seq) AS rn, bit_or(uses) OVER (PARTITION BY prefix, texel) AS bor FROM {STAMPS}) WHERE rn = 1)"
UP = f"""(SELECT *, prefix >> 2 AS pp, (((((((prefix & 1) << 7) + (ty >> 1)) << 8) | (((prefix >> 1 & 1) << 7) + (tx >> 1))) << 1) | ph) AS pt, CASE WHEN ph <> h THEN 3 WHEN tx%2 = ty%2 THEN 0 WHEN ty%2 = 1 THEN 1 ELSE 2 END AS child
FROM (SELECT *, CASE WHEN tx%2=1 AND ty%2=1 THEN 1 WHEN tx%2=0 AND ty%2=0 THEN 0 ELSE h END AS ph FROM (SELECT *, (texel>>1)&255 AS tx, texel>>9 AS ty, texel&1 AS h FROM {TEXELS})))"""


@query(f"SELECT * FROM {TEXELS}")
def g8_stamps(spark, sf):
    return texels(spark, sf)


@query(f"SELECT depth-1 AS depth, pp AS prefix, pt AS texel, coalesce(min(CASE WHEN class <> 0 AND cov > 0 THEN class END), 0) AS class, least(sum(cov), 255)::BIGINT AS cov, max(mag) AS mag, bit_or(uses) AS uses FROM {UP} GROUP BY ALL")
def a3_line_pyramid(spark, sf):
    return P.lines(texels(spark, sf))


@query(f"""WITH u AS {UP}, r AS (SELECT *, sum(CASE WHEN class <> 0 AND cov > 0 THEN cov ELSE 0 END) OVER (PARTITION BY pp, pt, class ORDER BY child) AS run FROM u), v AS (SELECT pp, pt, class, max(run) AS top FROM r WHERE class <> 0 AND cov > 0 GROUP BY ALL),
f AS (SELECT v.pp, v.pt, v.class, top, min(child) AS reached FROM v JOIN r ON r.pp=v.pp AND r.pt=v.pt AND r.class=v.class AND run=top GROUP BY ALL), w AS (SELECT pp, pt, class FROM (SELECT *, row_number() OVER (PARTITION BY pp, pt ORDER BY top DESC, reached) AS n FROM f) WHERE n=1)
SELECT u.depth-1 AS depth, u.pp AS prefix, u.pt AS texel, coalesce(any_value(w.class), 0) AS class, (sum(u.cov) // 4)::BIGINT AS cov FROM u LEFT JOIN w ON u.pp=w.pp AND u.pt=w.pt GROUP BY u.depth, u.pp, u.pt""")
def a4_area_pyramid(spark, sf):
    return P.areas(texels(spark, sf))


@query(f"SELECT depth-1 AS depth, pp AS prefix, pt AS texel, (sum(cov) // 4)::BIGINT AS cov FROM {UP} GROUP BY ALL")
def a5_coverage_pyramid(spark, sf):
    return P.coverage(texels(spark, sf))


@query(f"SELECT depth-1 AS depth, pp AS prefix, pt AS texel, round(avg(CASE WHEN mag % 7 <> 0 THEN mag END), 6) AS elev FROM {UP} GROUP BY ALL")
def a6_terrain_pyramid(spark, sf):
    t = texels(spark, sf).withColumn("elev", F.when(F.col("mag") % 7 != 0, F.col("mag").cast("double")))
    return P.means(t, "elev").withColumn("elev", F.round("elev", 6))


@query(f"""SELECT depth-1 AS depth, pp AS prefix, pt AS texel, (max({{'p': CASE WHEN seq%3=0 THEN 1 ELSE 0 END, 'r': CASE WHEN seq%3=0 THEN mag ELSE cov END, 'c': -child, 's': -seq, 'n': concat('N', seq % 50)}})).n AS name, (max({{'p': CASE WHEN seq%3=0 THEN 1 ELSE 0 END, 'r': CASE WHEN seq%3=0 THEN mag ELSE cov END, 'c': -child, 's': -seq, 'k': CASE WHEN seq%3=0 THEN 64 ELSE 1 END}})).k AS kind FROM {UP} GROUP BY ALL""")
def a8_name_pyramid(spark, sf):
    t = texels(spark, sf).withColumns({"kind": F.when(F.col("seq") % 3 == 0, 64).otherwise(1), "rank": F.col("mag"), "name": F.concat(F.lit("N"), (F.col("seq") % 50).cast("string"))})
    return P.names(t)


_NEW, _OLD, _FOOT = f"(SELECT * FROM {TEXELS} WHERE seq % 3 = 0)", f"(SELECT depth, prefix, texel, class, cov + 1 AS cov FROM {TEXELS} WHERE seq % 2 = 0)", f"(SELECT prefix, texel FROM {TEXELS} WHERE seq % 5 < 2)"


def _parts(spark, sf):
    t = texels(spark, sf)
    return t.where("seq % 3 = 0"), t.where("seq % 2 = 0").withColumn("cov", F.col("cov") + 1), t.where("seq % 5 < 2")


@query(f"SELECT 14::BIGINT AS depth, prefix, texel, CASE WHEN n.cov > 0 THEN n.class ELSE coalesce(o.class, n.class) END AS class, CASE WHEN n.cov > 0 THEN n.cov ELSE coalesce(o.cov, n.cov) END AS cov FROM {_NEW} n FULL JOIN {_OLD} o USING (prefix, texel)")
def u6_merge_without_footprint(spark, sf):
    new, old, _ = _parts(spark, sf)
    return U.over(new, old, ["class", "cov"])


@query(f"SELECT 14::BIGINT AS depth, prefix, texel, CASE WHEN f.texel IS NOT NULL THEN n.class ELSE o.class END AS class, CASE WHEN f.texel IS NOT NULL THEN n.cov ELSE o.cov END AS cov FROM {_NEW} n FULL JOIN {_OLD} o USING (prefix, texel) LEFT JOIN {_FOOT} f USING (prefix, texel) WHERE CASE WHEN f.texel IS NOT NULL THEN n.class ELSE o.class END IS NOT NULL")
def u6_merge_inside_footprint(spark, sf):
    new, old, foot = _parts(spark, sf)
    return U.over(new, old, ["class", "cov"], foot)


@query(f"SELECT 14::BIGINT AS depth, prefix, texel, greatest(coalesce(n.cov, 0), coalesce(o.cov, 0)) AS cov FROM {_NEW} n FULL JOIN {_OLD} o USING (prefix, texel)")
def u8_highest(spark, sf):
    new, old, _ = _parts(spark, sf)
    return U.highest(new, old)


@query(f"""WITH o AS (SELECT prefix, texel, (seq % 5 - 2) * 0.5 AS elev FROM {TEXELS} WHERE seq % 2 = 0), n AS (SELECT prefix, texel, (seq % 7 - 3) * 1.0 AS elev FROM {TEXELS} WHERE seq % 3 = 0)
SELECT 14::BIGINT AS depth, prefix, texel, (CASE WHEN abs(o.elev) <= 0.75 AND n.elev < 0 THEN n.elev ELSE o.elev END)::DOUBLE AS elev, CASE WHEN abs(o.elev) <= 0.75 AND n.elev < 0 THEN 255 ELSE 0 END AS water FROM o LEFT JOIN n USING (prefix, texel)""")
def u9_seabed(spark, sf):
    t = texels(spark, sf)
    return U.seabed(t.where("seq % 3 = 0").withColumn("elev", (F.col("seq") % 7 - 3).cast("double")), t.where("seq % 2 = 0").withColumn("elev", (F.col("seq") % 5 - 2) * 0.5))


@query(f"""WITH p AS (SELECT prefix, texel, arg_max(class, seq) AS c FROM {STAMPS} WHERE class > 0 GROUP BY ALL), w AS (SELECT DISTINCT prefix, texel FROM {STAMPS} WHERE seq % 11 = 0) SELECT 14::BIGINT AS depth, prefix, texel, coalesce(c, 0) + CASE WHEN w.texel IS NOT NULL THEN 16 ELSE 0 END AS class FROM p FULL JOIN w USING (prefix, texel)""")
def u11_painted(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(*(f"CAST({e} AS BIGINT) AS `{c}`" for c, e in _TEXEL.items()))
    return U.painted(t.where("class > 0").withColumn("paint", F.col("seq")), t.where("seq % 11 = 0"))


@query(f"SELECT DISTINCT prefix >> 2 AS prefix FROM {TEXELS} WHERE prefix >> 2 NOT IN (SELECT prefix >> 2 FROM {TEXELS} WHERE prefix % 16 = 3)")
def u4_minus_finer(spark, sf):
    cells = texels(spark, sf)
    return U.minus_finer(cells.select(F.shiftright("prefix", 2).alias("prefix")).distinct(), cells.where("prefix % 16 = 3"), 1)


@query(f"SELECT class, count(*) AS n, min(mag) AS lo, max(mag) AS hi FROM {TEXELS} WHERE class <> 3 GROUP BY class")
def a20_tally_u13_strip(spark, sf):
    return U.without_class(texels(spark, sf), 3).groupBy("class").agg(F.count("*").alias("n"), F.min("mag").alias("lo"), F.max("mag").alias("hi"))


# ---- lines

_REFS = "(SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos, l_partkey FROM lineitem)"
REFS = f"(SELECT way, pos, CASE WHEN pos IN (1, 4) THEN l_partkey ELSE 1000000000 + way*16 + pos END AS node FROM {_REFS})"
_PLACE = "46 + CAST((node*7919) % 100000 AS DOUBLE)/100000 AS lat, -122 + CAST((node*6007) % 100000 AS DOUBLE)/100000 AS lon"
POINTS = f"(SELECT way, pos, node, {_PLACE} FROM {REFS})"
SEGS = f"(SELECT *, sqrt(pow((lon1-lon)*cos(radians((lat+lat1)/2)),2)+pow(lat1-lat,2))*111320 AS metres FROM (SELECT *, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(node) OVER w AS \"to\" FROM {POINTS} WINDOW w AS (PARTITION BY way ORDER BY pos)) WHERE lat1 IS NOT NULL)"


def refs(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    r = li.select(F.col("l_orderkey").alias("way"), F.row_number().over(w).alias("pos"), "l_partkey")
    return r.select("way", "pos", F.when(F.col("pos").isin(1, 4), F.col("l_partkey")).otherwise(1000000000 + F.col("way") * 16 + F.col("pos")).alias("node"))


def points(spark, sf):
    r = refs(spark, sf)
    nodes = r.select("node").distinct().selectExpr("node", *_PLACE.split(", "))
    return L.placed(r, nodes)


@query(f"SELECT node, count(DISTINCT way) AS ways FROM {REFS} GROUP BY node HAVING count(DISTINCT way) >= 2")
def a1_j6_junctions(spark, sf):
    return L.junctions(refs(spark, sf))


@query(f"SELECT way, pos, node, round(lat, 6) AS lat, round(lon, 6) AS lon FROM {POINTS}")
def j2_j3_placed(spark, sf):
    return points(spark, sf).select("way", "pos", "node", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"SELECT way, pos, \"to\", round(metres, 3) AS metres FROM {SEGS}")
def w2_segments(spark, sf):
    return L.segments(points(spark, sf)).select("way", "pos", "to", F.round("metres", 3).alias("metres"))


@query(f"SELECT p.way, p.pos, round(coalesce(sum(s.metres), 0), 3) AS at_m FROM {POINTS} p LEFT JOIN {SEGS} s ON s.way = p.way AND s.pos < p.pos GROUP BY ALL")
def w3_along(spark, sf):
    return L.along(points(spark, sf)).select("way", "pos", F.round("at_m", 3).alias("at_m"))


@query(f"""WITH c AS (SELECT p.way, p.pos, coalesce(sum(s.metres), 0) AS d FROM {POINTS} p LEFT JOIN {SEGS} s ON s.way = p.way AND s.pos < p.pos GROUP BY ALL), t AS (SELECT way, max(d) AS total FROM c GROUP BY way)
SELECT way, CAST(k AS INT) AS station, arg_max(pos, d) AS pos FROM c JOIN t USING (way), range(8) r(k) WHERE total > 0 AND d / total * 7 - 1e-9 <= k GROUP BY way, k""")
def w4_resample(spark, sf):
    return L.resample(points(spark, sf), 8)


@query(f"SELECT event_id, round(avg(CASE WHEN event_id % 5 <> 0 THEN accuracy END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM {V.sql('g_fix')}")
def w5_moving_mean(spark, sf):
    f = V.view(spark, sf, "g_fix").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("accuracy")))
    return L.moving_mean(f, "user_id", "event_id", "v", 3).select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS ch FROM {V.sql('g_fix')} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run, event_type""")
def w6_runs(spark, sf):
    return L.runs(V.view(spark, sf, "g_fix"), "user_id", "event_id", "event_type")


@query(f"SELECT id, round(abs((lon1-lon0)*(lat1-lat0)) * 111320.0 * 111320.0 * cos(radians(lat0)), 0) AS area FROM {V.sql('g_box')}")
def g4_ring_area(spark, sf):
    b = V.view(spark, sf, "g_box")
    corner = lambda a, o: F.struct(F.col(a).alias("lat"), F.col(o).alias("lon"))
    ring = F.array(corner("lat0", "lon0"), corner("lat0", "lon1"), corner("lat1", "lon1"), corner("lat1", "lon0"), corner("lat0", "lon0"))
    return L.ring_area_m2(b.withColumn("ring", ring)).select("id", F.round("area", 0).alias("area"))


@query(f"""WITH s AS (SELECT *, coalesce(sum(metres) OVER (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_m FROM {SEGS}), p AS (SELECT o_orderkey AS id, o_orderkey AS way, 46 + CAST(o_custkey*31 % 1000 AS DOUBLE)/1000 AS plat, -122 + CAST(o_custkey*17 % 1000 AS DOUBLE)/1000 AS plon FROM orders),
j AS (SELECT id, pos, start_m, (lon1-lon)*cos(radians(lat))*111320 AS dx, (lat1-lat)*111320 AS dy, (plon-lon)*cos(radians(lat))*111320 AS px, (plat-lat)*111320 AS py FROM p JOIN s USING (way)), t AS (SELECT *, CASE WHEN dx*dx+dy*dy > 0 THEN least(greatest((px*dx+py*dy)/(dx*dx+dy*dy), 0), 1) ELSE 0 END AS t FROM j)
SELECT id, round(off, 2) AS off_m, round(a, 2) AS along_m FROM (SELECT id, sqrt(pow(px-t*dx,2)+pow(py-t*dy,2)) AS off, start_m + t*sqrt(dx*dx+dy*dy) AS a, row_number() OVER (PARTITION BY id ORDER BY round(sqrt(pow(px-t*dx,2)+pow(py-t*dy,2)), 6), pos) AS n FROM t) WHERE n = 1""")
def g12_project(spark, sf):
    w = Window.partitionBy("way").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    s = L.segments(points(spark, sf)).withColumn("start_m", F.coalesce(F.sum("metres").over(w), F.lit(0.0))).withColumnRenamed("pos", "seq")
    p = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("way"), (46 + (F.col("o_custkey") * 31 % 1000).cast("double") / 1000).alias("lat"), (-122 + (F.col("o_custkey") * 17 % 1000).cast("double") / 1000).alias("lon"))
    return L.project(p, s, "way").select("id", F.round("off_m", 2).alias("off_m"), F.round("along_m", 2).alias("along_m"))


_OWN = "(SELECT p_partkey AS way, CAST(p_size AS DOUBLE) AS km FROM part)"
_FLOW = "(SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey // 3 >= 1)"


@query(f"WITH RECURSIVE r AS (SELECT way AS root, way AS here, km FROM {_OWN} UNION ALL SELECT root, dst, km FROM r JOIN {_FLOW} f ON here = src) SELECT here AS way, sum(km) AS km, round(least(greatest((log10(greatest(sum(km), 0.01))+1)/4, 0), 1), 6) AS weight FROM r WHERE here IN (SELECT way FROM {_OWN}) GROUP BY here")
def a28_r2_upstream(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    own = p.select(F.col("p_partkey").alias("way"), F.col("p_size").cast("double").alias("km"))
    flow = p.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).alias("dst")).where("dst >= 1")
    up = L.upstream(flow, own, G.cut).join(own.select("way"), "way", "left_semi")
    return up.select("way", "km", F.round(F.least(F.greatest((F.log10(F.greatest("km", F.lit(0.01))) + 1) / 4, F.lit(0.0)), F.lit(1.0)), 6).alias("weight"))


# ---- terrain

_HEIGHT = "CASE WHEN px BETWEEN 10 AND 20 AND py BETWEEN 10 AND 20 THEN 50.0 WHEN (px*py) % 97 = 5 THEN NULL ELSE CAST((px*px*3 + py*py*2 + px*py*tile) % 1009 AS DOUBLE) END"
RASTER = f"(SELECT tile, px, py, {_HEIGHT} AS v FROM (SELECT DISTINCT CAST(i // 4096 AS INT) AS tile, CAST(i % 64 AS INT) AS px, CAST(i // 64 % 64 AS INT) AS py FROM (SELECT l_orderkey * 7 + l_linenumber AS i FROM lineitem)))"


def raster(spark, sf):
    """A pixel a line item: tiles of 64 x 64."""
    r = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey * 7 + l_linenumber AS i").selectExpr("CAST(i DIV 4096 AS INT) AS tile", "CAST(i % 64 AS INT) AS px", "CAST(i DIV 64 % 64 AS INT) AS py")
    return dealt(r, 1 << 20, "tile", "px", "py").distinct().selectExpr("tile", "px", "py", f"CAST({_HEIGHT} AS DOUBLE) AS v")


@query(f"""WITH p AS (SELECT p_partkey AS id, CAST(p_partkey % 3 AS INT) AS tile, CAST(p_partkey*7 % 630 AS DOUBLE)/10 AS x, CAST(p_partkey*11 % 630 AS DOUBLE)/10 AS y FROM part), c AS (SELECT id, tile, CAST(floor(x) AS INT)+i AS px, CAST(floor(y) AS INT)+j AS py, CASE i WHEN 1 THEN x-floor(x) ELSE 1-(x-floor(x)) END * CASE j WHEN 1 THEN y-floor(y) ELSE 1-(y-floor(y)) END AS w FROM p, range(2) a(i), range(2) b(j))
SELECT id, tile, round(sum(w*v) FILTER (v IS NOT NULL)/nullif(sum(w) FILTER (v IS NOT NULL), 0), 6) AS v FROM c LEFT JOIN {RASTER} r USING (tile, px, py) GROUP BY id, tile""")
def g15_bilinear(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", "CAST(p_partkey % 3 AS INT) AS tile", "CAST(p_partkey*7 % 630 AS DOUBLE)/10 AS x", "CAST(p_partkey*11 % 630 AS DOUBLE)/10 AS y")
    return R.bilinear(p, raster(spark, sf)).select("id", "tile", F.round("v", 6).alias("v"))


@query(f"SELECT a.tile, a.px, a.py, count(b.v) = 9 AND count(DISTINCT b.v) = 1 AS flat FROM {RASTER} a LEFT JOIN {RASTER} b ON a.tile=b.tile AND b.px BETWEEN a.px-1 AND a.px+1 AND b.py BETWEEN a.py-1 AND a.py+1 WHERE a.v IS NOT NULL GROUP BY a.tile, a.px, a.py")
def g16_flattened(spark, sf):
    return R.flattened(raster(spark, sf))


@query(f"""WITH n AS (SELECT a.*, w.v AS n1, e.v AS n2, s.v AS n3, t.v AS n4 FROM {RASTER} a LEFT JOIN {RASTER} w ON w.tile=a.tile AND w.px=a.px-1 AND w.py=a.py LEFT JOIN {RASTER} e ON e.tile=a.tile AND e.px=a.px+1 AND e.py=a.py LEFT JOIN {RASTER} s ON s.tile=a.tile AND s.px=a.px AND s.py=a.py-1 LEFT JOIN {RASTER} t ON t.tile=a.tile AND t.px=a.px AND t.py=a.py+1 WHERE a.v IS NOT NULL),
g AS (SELECT *, CASE WHEN n1 IS NULL AND n2 IS NULL THEN 0 ELSE (coalesce(n2,v)-coalesce(n1,v))/(30.0*((n1 IS NOT NULL)::INT+(n2 IS NOT NULL)::INT)) END AS gx, CASE WHEN n3 IS NULL AND n4 IS NULL THEN 0 ELSE (coalesce(n4,v)-coalesce(n3,v))/(30.0*((n3 IS NOT NULL)::INT+(n4 IS NOT NULL)::INT)) END AS gy FROM n), d AS (SELECT *, degrees(atan(sqrt(gx*gx+gy*gy))) AS sl FROM g)
SELECT CASE WHEN sl < 25 THEN 0 WHEN sl < 30 THEN 1 WHEN sl < 35 THEN 2 WHEN sl < 45 THEN 3 ELSE 4 END AS band, count(*) AS n, round(avg(sl), 6) AS slope, count(*) FILTER (sl < 2) AS level FROM d GROUP BY band""")
def g17_v4_slopes(spark, sf):
    s = R.slopes(raster(spark, sf), 30.0)
    return s.groupBy(R.slope_band(F.col("slope")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("slope"), 6).alias("slope"), F.sum(F.col("facing").isNull().cast("bigint")).alias("level"))


@query(f"""WITH s AS (SELECT px*64+py AS id, tile AS priority, v, tile = 0 AND px BETWEEN 11 AND 19 AND py BETWEEN 11 AND 19 AS flat FROM {RASTER} WHERE v IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority) AS n FROM s), a AS (SELECT id, priority AS p0, v AS v0, flat AS f0 FROM f WHERE n = 1), l AS (SELECT a.id, arg_min(s.v, s.priority) AS v1 FROM a JOIN s ON s.id=a.id AND f0 AND s.priority > p0 AND s.v < v0 - 0.25 GROUP BY a.id) SELECT a.id, coalesce(v1, v0) AS v FROM a LEFT JOIN l USING (id)""")
def j10_first_with_data(spark, sf):
    s = raster(spark, sf).select((F.col("px") * 64 + F.col("py")).alias("id"), F.col("tile").alias("priority"), "v", ((F.col("tile") == 0) & F.col("px").between(11, 19) & F.col("py").between(11, 19)).alias("flat"))
    return R.first_with_data(s)


@query(f"SELECT round(v/20)*20 AS level, (round(v/20)::INT % 5 + 5) % 5 = 0 AS index, count(*) AS n, min(v) AS lo, max(v) AS hi FROM {RASTER} WHERE v IS NOT NULL GROUP BY ALL")
def v2_a15_contours(spark, sf):
    level, index = R.contour_level(F.col("v"), 20.0)
    return raster(spark, sf).where("v IS NOT NULL").groupBy(level.alias("level"), index.alias("index")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


# ---- names and addresses


@query(f"SELECT kind, trim(name) AS name, trim(reference) AS reference, max(rank) AS rank FROM (SELECT kind, concat(' ', reference, ' ') AS name, CASE WHEN id % 2 = 0 THEN '' ELSE 'x' END AS reference, rank FROM {V.sql('g_place')}) GROUP BY ALL")
def a2_interned(spark, sf):
    p = V.view(spark, sf, "g_place").select("kind", F.concat(F.lit(" "), F.col("reference"), F.lit(" ")).alias("name"), F.when(F.col("id") % 2 == 0, "").otherwise("x").alias("reference"), "rank")
    return S.interned(p)


@query(f"""WITH h AS (SELECT kind, name, reference, rank, lat, lon, least(CASE WHEN strpos(lower(name), 'build') > 1 THEN 2 END, CASE WHEN strpos(lower(reference), 'build')=1 THEN 1 END) AS fit FROM {V.sql('g_place')} WHERE strpos(lower(name), 'build') > 0)
SELECT kind, name, reference, fit, CAST(kind % 3 AS INT) AS tier, rank, lat, lon FROM h ORDER BY fit, tier, rank DESC, kind, name, reference LIMIT 60""")
def x18_a19_t1_search(spark, sf):
    p = V.view(spark, sf, "g_place").withColumns({"depth": F.lit(10), "prefix": F.col("id")})
    return S.search(p, "build", (F.col("kind") % 3).cast("int"))


@query(f"""WITH p AS (SELECT c_custkey AS id, 46 + CAST(c_custkey*7 % 2000 AS DOUBLE)/2000 AS lat, -122 + CAST(c_custkey*11 % 2000 AS DOUBLE)/2000 AS lon FROM customer), j AS (SELECT p.id, a.id AS place, sqrt(pow((a.lon-p.lon)*cos(radians((p.lat+a.lat)/2)),2)+pow(a.lat-p.lat,2))*111320 AS m, CASE WHEN a.zip % 3 = p.id % 3 THEN 0 ELSE 1 END AS s FROM p JOIN {V.sql('g_addr')} a ON abs(a.lat-p.lat) < 0.02 AND abs(a.lon-p.lon) < 0.03)
SELECT id, place, round(m, 2) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, round(m, 6), place) AS n FROM j WHERE m < 2000) WHERE n = 1""")
def j14_nearest(spark, sf):
    p = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS id", "46 + CAST(c_custkey*7 % 2000 AS DOUBLE)/2000 AS lat", "-122 + CAST(c_custkey*11 % 2000 AS DOUBLE)/2000 AS lon", "c_custkey % 3 AS part")
    a = V.view(spark, sf, "g_addr").select("id", "lat", "lon", (F.col("zip") % 3).alias("part"))
    return S.nearest(p, a, per_degree=30, alike="part").select("id", "place", F.round("metres", 2).alias("metres"))


_BOXES = f"(SELECT zip, min(lat) AS lat0, min(lon) AS lon0, max(lat) AS lat1, max(lon) AS lon1 FROM {V.sql('g_addr')} GROUP BY zip)"


@query(f"SELECT * FROM {_BOXES}")
def a22_boxes(spark, sf):
    return S.boxes(V.view(spark, sf, "g_addr"), "zip")


@query(f"""WITH d AS (SELECT zip, least(greatest(45.9, lat0), lat1) AS y, least(greatest(-122.1, lon0), lon1) AS x FROM {_BOXES}) SELECT zip, round(sqrt(pow((x+122.1)*cos(radians((45.9+y)/2)),2)+pow(y-45.9,2))*111320, 6) AS metres FROM d WHERE round(sqrt(pow((x+122.1)*cos(radians((45.9+y)/2)),2)+pow(y-45.9,2))*111320, 6) <= 40000 ORDER BY metres, zip LIMIT 16""")
def j16_t3_boxes_near(spark, sf):
    return S.boxes_near(S.boxes(V.view(spark, sf, "g_addr"), "zip"), "zip", 45.9, -122.1)


@query(f"SELECT a.id AS a, b.id AS b FROM {V.sql('g_box')} a JOIN {V.sql('g_box')} b ON a.lat0 <= b.lat1 AND b.lat0 <= a.lat1 AND a.lon0 <= b.lon1 AND b.lon0 <= a.lon1")
def j17_j18_overlapping(spark, sf):
    b = V.view(spark, sf, "g_box")
    return S.overlapping(b, b)


@query(f"""WITH n AS (SELECT array_to_string(n, ' ') AS normal, zip, id, number FROM ({NORMAL})) SELECT zip, normal, count(*) AS n, min(number) AS lo, max(number) AS hi FROM n GROUP BY ALL""")
def x5_street_ranges(spark, sf):
    a = V.view(spark, sf, "g_addr").withColumn("normal", T.street_normal(F.col("street")))
    return a.groupBy("zip", "normal").agg(F.count("*").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"))


# ---- audits


@query(f"SELECT depth - (prefix % 3) AS depth, count(*) AS cells, CAST(floor(avg(n)) AS BIGINT) AS mean, sum(n)::BIGINT AS total FROM (SELECT depth, prefix, count(*)*4 AS n FROM {TEXELS} GROUP BY ALL) GROUP BY ALL")
def a16_by_depth(spark, sf):
    c = texels(spark, sf).groupBy("depth", "prefix").agg((F.count("*") * 4).alias("bytes"))
    return A.by_depth(c.withColumn("depth", F.col("depth") - F.col("prefix") % 3))


@query(f"SELECT class AS section, sum(cov)::BIGINT AS bytes, round(100.0*sum(cov)/sum(sum(cov)) OVER (), 6) AS share FROM {TEXELS} GROUP BY class")
def a17_shares(spark, sf):
    return A.shares(texels(spark, sf), "class", "cov").withColumn("share", F.round("share", 6))


@query(f"SELECT prefix >> 8 AS area, count(*) AS cells, count(*) FILTER (missing > 0.5) AS bad, max(missing) AS worst FROM (SELECT prefix, round(avg(CASE WHEN class = 0 THEN 1.0 ELSE 0 END), 6) AS missing FROM {TEXELS} GROUP BY prefix) GROUP BY ALL")
def a18_coverage_audit(spark, sf):
    return A.gaps(texels(spark, sf), F.col("class") == 0, 4, 0.5)


@query("SELECT ch AS letter, count(*) AS n FROM (SELECT unnest(string_split(concat(c_name, c_mktsegment), '')) AS ch FROM customer) WHERE ch <> '' GROUP BY ch")
def a25_letters(spark, sf):
    return A.letters(spark.read.parquet(f"{sf}/customer.parquet"), F.concat("c_name", "c_mktsegment"))


@query("WITH h AS (SELECT o_orderkey, o_orderstatus, o_orderdate, CAST(floor(o_totalprice) AS BIGINT) AS b FROM orders), r AS (SELECT *, sum(b) OVER (PARTITION BY o_orderstatus) - coalesce(sum(b) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM h) SELECT o_orderkey FROM r WHERE held > 5000000")
def t4_m10_eviction(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate", F.floor("o_totalprice").alias("b"))
    return S.within_budget(o, "o_orderstatus", ["o_orderdate", "o_orderkey"], "b", 5_000_000).select("o_orderkey")


@query("SELECT o_custkey AS key, max(o_orderkey) AS newest, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY ALL")
def w11_s25_newest(spark, sf):
    return S.newest(spark.read.parquet(f"{sf}/orders.parquet"), ["o_custkey"], "o_orderkey").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("newest"), F.col("o_orderstatus").alias("status"))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def k3_k4_changed(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("v"))
    old = o.where("key % 7 <> 0").withColumn("v", F.when(F.col("key") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return U.changed(o, old, ["key"]).select("key")


# ---- graph

def r7_shortest(spark, sf):
    """Least costs from part 1 over all parts; a recursive query is too slow for the whole table, so the tests hold it against brute force."""
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("src"))
    e = p.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(25), F.lit(200)))).select("src", (F.col("src") + F.col("k")).alias("dst"), (1.0 + (F.col("src") * F.col("k")) % 7).alias("cost"))
    e = e.join(p.select(F.col("src").alias("dst")), "dst", "left_semi")
    return G.shortest(e, spark.createDataFrame([(1, 0.0)], "node bigint, cost double"))


QUERIES["r7_shortest"] = r7_shortest


@query(f"SELECT event_id, round(sqrt(pow((b-a)*10,2)+1), 6) AS len, round(6*exp(-3.5*abs((b-a)/100 + 0.05))/3.6, 6) AS foot FROM (SELECT event_id, accuracy AS a, lead(accuracy) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM {V.sql('g_fix')}) WHERE b IS NOT NULL")
def r11_pace(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    f = V.view(spark, sf, "g_fix").select("event_id", F.col("accuracy").alias("a"), F.lead("accuracy").over(w).alias("b")).where("b IS NOT NULL")
    return f.select("event_id", F.round(F.sqrt(F.pow((F.col("b") - F.col("a")) * 10, 2) + 1), 6).alias("len"), F.round(G.walking_speed((F.col("b") - F.col("a")) / 100), 6).alias("foot"))


# ---- tracks


@query(f"SELECT user_id, CAST((n-1) // 64 AS BIGINT) AS chunk, count(*) AS fixes, min(event_id) AS first, max(event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {V.sql('g_fix')}) GROUP BY ALL")
def m2_k7_chunks(spark, sf):
    return K.chunks(V.view(spark, sf, "g_fix"), "user_id", ["ts", "event_id"], 64).groupBy("user_id", "chunk").agg(F.count("*").alias("fixes"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query(f"SELECT user_id, max(ts) AS ts, arg_max(event_id, {{'t': ts, 'e': event_id}}) AS event_id FROM {V.sql('g_fix')} GROUP BY user_id")
def m1_m5_latest(spark, sf):
    return K.latest(V.view(spark, sf, "g_fix"), "user_id", ["ts", "event_id"]).select("user_id", "ts", "event_id")


@query(f"""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 DAY OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM {V.sql('g_fix')} WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, min(ts) AS begun, count(*) AS fixes FROM g GROUP BY user_id, g""")
def m_sessions(spark, sf):
    return K.sessions(V.view(spark, sf, "g_fix"), "user_id", "ts", "1 day")
