"""Queries of lettering and of resumable passes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators import landuse as U
from ..operators import lettering as L
from ..operators import passes
from ..operators import search as S
from ..operators.graph import shared_dir
from . import views as V
from .routes import _ROUTES
from .tables import TEXELS

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TIER = "CASE kind WHEN 64 THEN 0 WHEN 65 THEN 0 WHEN 66 THEN 5 WHEN 67 THEN 5 ELSE 1 END"
#: Five views, each 1,280 by 720; a label as wide as its name.
_LABELS = f"(SELECT id % 5 AS view, id, {_TIER} AS tier, id % 3 = 0 AS shown, rank, CAST(id * 37 % 1280 AS DOUBLE) AS x0, CAST(id * 101 % 720 AS DOUBLE) AS y0, CAST(id * 37 % 1280 + 7 * length(name) AS DOUBLE) AS x1, CAST(id * 101 % 720 + 14 AS DOUBLE) AS y1 FROM {V.sql('g_place')})"


@query(f"""WITH o AS (SELECT view, list({{'id': id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY tier, shown DESC, rank DESC, id) AS l FROM {_LABELS} GROUP BY view),
k AS (SELECT view, list_reduce(list_transform(l, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda k: greatest(k.x0, x[1].x0) < least(k.x1, x[1].x1) AND greatest(k.y0, x[1].y0) < least(k.y1, x[1].y1))) = 0 THEN list_concat(a, x) ELSE a END) AS l FROM o)
SELECT view, x.id AS id, x.x0 AS x0, x.y0 AS y0 FROM (SELECT view, unnest(l) AS x FROM k)""")
def v9_labels(spark, sf):
    """The labels that stand in each of five views, in the order of tier, shown before, rank."""
    p = V.view(spark, sf, "g_place")
    at = lambda k, m: (F.col("id") * k % m).cast("double")
    labels = p.select((F.col("id") % 5).alias("view"), "id", K.tier(F.col("kind")).alias("tier"), (F.col("id") % 3 == 0).alias("shown"), "rank", at(37, 1280).alias("x0"), at(101, 720).alias("y0"), (at(37, 1280) + 7 * F.length("name")).alias("x1"), (at(101, 720) + 14).alias("y1"))
    return L.chosen(labels, "view", "id", [F.col("tier"), ~F.col("shown"), -F.col("rank")], 14.0).select("view", "id", "x0", "y0")


_MERGED = f"SELECT id, 0 AS view, kind, CAST(id * 53 % 1280 AS DOUBLE) AS x, CAST(id * 29 % 720 AS DOUBLE) AS y FROM {V.sql('g_place')}"


@query(f"""WITH o AS (SELECT kind, list({{'id': id, 'x': x, 'y': y}} ORDER BY id) AS l FROM ({_MERGED}) GROUP BY kind),
k AS (SELECT kind, list_reduce(list_transform(l, lambda p: [p]), lambda a, p: CASE WHEN len(list_filter(a, lambda k: (k.x - p[1].x)*(k.x - p[1].x) + (k.y - p[1].y)*(k.y - p[1].y) < 9216)) = 0 THEN list_concat(a, p) ELSE a END) AS l FROM o)
SELECT kind, p.id AS id FROM (SELECT kind, unnest(l) AS p FROM k)""")
def v9_merged_points(spark, sf):
    """One label for points of one identity within 96 pixels of it."""
    p = V.view(spark, sf, "g_place").select("id", F.lit(0).alias("view"), "kind", (F.col("id") * 53 % 1280).cast("double").alias("x"), (F.col("id") * 29 % 720).cast("double").alias("y"))
    return L.merged_points(p, "view", "id", ["kind"]).select("kind", "id")


_NAMED = "SELECT o_orderkey % 4 AS view, CASE o_custkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 44 ELSE 6 END AS kind, concat('Name ', CAST(o_custkey % 50 AS VARCHAR)) AS name, '' AS reference, o_custkey % 9 AS rank, CAST(o_orderkey % 1000 AS DOUBLE) AS x, CAST(o_orderkey % 700 AS DOUBLE) AS y, CASE o_orderkey % 3 WHEN 0 THEN 44 WHEN 1 THEN 33 END AS area_kind FROM orders"


@query(f"SELECT view, kind, name, reference, max(rank) AS rank, count(*) AS size, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ({_NAMED}) WHERE NOT (kind = 12 AND coalesce(area_kind, 0) = 44) GROUP BY ALL")
def v9_gathered(spark, sf):
    """Each name of a view once, with its texels there and their box."""
    t = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*(f"{e} AS {c}" for e, c in (("o_orderkey % 4", "view"), ("CASE o_custkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 44 ELSE 6 END", "kind"), ("concat('Name ', CAST(o_custkey % 50 AS STRING))", "name"), ("''", "reference"), ("o_custkey % 9", "rank"), ("CAST(o_orderkey % 1000 AS DOUBLE)", "x"), ("CAST(o_orderkey % 700 AS DOUBLE)", "y"), ("CASE o_orderkey % 3 WHEN 0 THEN 44 WHEN 1 THEN 33 END", "area_kind"))))
    return L.gathered(t)


@query("SELECT c_nationkey AS region, c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY ALL")
def m12_passes(spark, sf):
    """A pass over customers, region by region, whose parts are published one by one."""
    t = spark.read.parquet(f"{sf}/customer.parquet").withColumnRenamed("c_nationkey", "region")
    work = lambda df: df.groupBy("region", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    path = f"{shared_dir(spark)}/pass-{uuid.uuid4().hex}"
    passes.run(t, "region", work, path)
    return passes.result(spark, path, work(t).schema)


# ---- land use

_RINGS = f"(SELECT id, lat0, lon0, lat1 + 0.5 AS lat1, lon1 + 0.7 AS lon1 FROM {V.sql('g_box')})"


@query(f"""WITH p AS (SELECT *, lat0 + (lat1-lat0)*0.25e0 AS a0, lat0 + (lat1-lat0)*0.75e0 AS a1, lon0 + (lon1-lon0)*0.3e0 AS o0, lon0 + (lon1-lon0)*0.6e0 AS o1 FROM {_RINGS}), b AS (SELECT s_suppkey AS box, 46.03e0 + s_suppkey % 12 * 0.21 AS y0, -123.01e0 + s_suppkey // 12 % 12 * 0.23 AS x0 FROM supplier), c AS (SELECT *, y0 + 0.3e0 AS y1, x0 + 0.35e0 AS x1 FROM b),
m AS (SELECT id, box, greatest(least(lat1, y1) - greatest(lat0, y0), 0)*greatest(least(lon1, x1) - greatest(lon0, x0), 0) - greatest(least(a1, y1) - greatest(a0, y0), 0)*greatest(least(o1, x1) - greatest(o0, x0), 0) AS area FROM p, c)
SELECT id, box, round(area + 3e-8, 6) AS area FROM m WHERE area > 1e-5""")
def s24_cut_areas(spark, sf):
    """Square degrees of polygons with a hole inside many boxes, all cut in one join."""
    p = V.view(spark, sf, "g_box").withColumns({"lat1": F.col("lat1") + 0.5, "lon1": F.col("lon1") + 0.7})
    hole = {"a0": ("lat0", "lat1", 0.25), "a1": ("lat0", "lat1", 0.75), "o0": ("lon0", "lon1", 0.3), "o1": ("lon0", "lon1", 0.6)}
    p = p.withColumns({n: F.col(lo) + (F.col(hi) - F.col(lo)) * k for n, (lo, hi, k) in hole.items()})
    ring = lambda *at: F.array(*[F.struct(F.col(y).alias("lat"), F.col(x).alias("lon")) for y, x in at])
    outer = ring(("lat0", "lon0"), ("lat0", "lon1"), ("lat1", "lon1"), ("lat1", "lon0"), ("lat0", "lon0"))
    inner = ring(("a0", "o0"), ("a1", "o0"), ("a1", "o1"), ("a0", "o1"), ("a0", "o0"))
    b = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS box", "46.03D + s_suppkey % 12 * 0.21D AS lat0", "-123.01D + s_suppkey DIV 12 % 12 * 0.23D AS lon0").selectExpr("box", "lat0", "lon0", "lat0 + 0.3D AS lat1", "lon0 + 0.35D AS lon1")
    made = U.cut(p.select("id", F.array(outer, inner).alias("rings")), b, "id")
    return U.degrees2(made, "id").where("area > 1e-5").withColumn("area", F.round(F.col("area") + 3e-8, 6))


# ---- search in a view

_VIEW = (46.9, -121.8, 700.0, 1280, 720)
_SOUGHT = f"(SELECT id, CAST(8 + id % 3 * 2 AS INT) AS depth, CASE WHEN id % 7 = 0 THEN 11 ELSE kind END AS kind, concat('Fort ', reference, ' ', CAST(id % 9 AS VARCHAR)) AS name, CASE WHEN id % 2 = 0 THEN reference ELSE '' END AS reference, rank, lat, lon FROM {V.sql('g_place')})"


@query(f"""WITH {V.coded(_SOUGHT)}, t AS (SELECT *, CASE depth WHEN 8 THEN {V.prefix_sql(8)} WHEN 10 THEN {V.prefix_sql(10)} ELSE {V.prefix_sql(12)} END AS prefix, (lon + 121.8e0)*cos(radians(46.9e0))*700 + 640 AS x, (46.9e0 - lat)*700 + 360 AS y, CASE WHEN position('ildi' IN lower(name)) > 0 THEN 3 END AS f1, CASE WHEN position('ildi' IN lower(reference)) > 0 THEN 3 END AS f2 FROM coded),
h AS (SELECT *, coalesce(least(f1, f2), f1, f2) AS fit, (x-640)*(x-640) + (y-360)*(y-360) AS d, CASE kind WHEN 64 THEN 0 WHEN 65 THEN 0 WHEN 66 THEN 5 WHEN 67 THEN 5 ELSE 1 END AS tier FROM t WHERE x BETWEEN 0 AND 1280 AND y BETWEEN 0 AND 720 AND kind <> 11),
g AS (SELECT *, max(depth) OVER n AS deep, row_number() OVER (PARTITION BY kind, name, reference ORDER BY depth DESC, d, lat, lon) AS nth, first_value(prefix) OVER (PARTITION BY kind, name, reference ORDER BY depth DESC, prefix) AS cell, min(fit) OVER n AS f, max(rank) OVER n AS r FROM h WHERE fit IS NOT NULL WINDOW n AS (PARTITION BY kind, name, reference)),
z AS (SELECT kind, name, reference, min(f) AS fit, min(tier) AS tier, max(r) AS rank, count(*) FILTER (depth = deep AND prefix = cell) * 7054000e0/pow(2.0, max(deep))/256 AS size_m, max(lat) FILTER (nth = 1) AS lat, max(lon) FILTER (nth = 1) AS lon FROM g GROUP BY kind, name, reference)
SELECT kind, name, reference, CAST(fit AS INT) AS fit, CAST(tier AS INT) AS tier, rank, round(size_m, 4) AS size_m, lat, lon FROM (SELECT * FROM z ORDER BY fit, tier, rank DESC, size_m DESC, kind, name, reference LIMIT 60)""")
def x18_f9_search_in_view(spark, sf):
    """The names in view that hold a text, each at its place nearest the centre in the deepest cells that have it."""
    from ..functions import cells as C

    p = V.view(spark, sf, "g_place").withColumns({"depth": (8 + F.col("id") % 3 * 2).cast("int"), "kind": F.when(F.col("id") % 7 == 0, 11).otherwise(F.col("kind")), "name": F.concat(F.lit("Fort "), F.col("reference"), F.lit(" "), (F.col("id") % 9).cast("string"))})
    p = C.encode(p.withColumn("reference", F.when(F.col("id") % 2 == 0, F.col("reference")).otherwise("")))
    p = p.withColumn("prefix", F.when(F.col("depth") == 8, C.prefix(8)).when(F.col("depth") == 10, C.prefix(10)).otherwise(C.prefix(12)))
    return S.in_view(p, "ildi", _VIEW, K.tier(F.col("kind"))).withColumn("size_m", F.round("size_m", 4))


# ---- typed places


@query(f"""WITH p AS (SELECT p_partkey AS id, p_partkey % 90 AS a, p_partkey * 7 % 60 AS b, p_partkey * 11 % 60 AS c, p_partkey % 4 AS style FROM part),
d AS (SELECT *, CASE style WHEN 2 THEN a + b/100e0 WHEN 3 THEN a + 60e0 ELSE a + b/60e0 + c/3600e0 END AS lat, CASE style WHEN 2 THEN a + c/100e0 WHEN 3 THEN 0e0 ELSE a + c/60e0 + b/3600e0 END AS lon FROM p)
SELECT id, round(CASE WHEN lat <= 90 THEN CASE style WHEN 1 THEN -lat ELSE lat END END, 9) + 0 AS lat, round(CASE WHEN lat <= 90 THEN CASE WHEN style < 3 THEN -lon ELSE lon END END, 9) + 0 AS lon FROM d""")
def x7_typed_places(spark, sf):
    """Places read from four ways of writing them; null where the latitude is beyond a pole."""
    from ..functions.place import typed_place

    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", "p_partkey % 90 AS a", "p_partkey * 7 % 60 AS b", "p_partkey * 11 % 60 AS c", "p_partkey % 4 AS style")
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    text = (
        F.when(F.col("style") == 0, F.concat_ws(" ", "a", "b", "c", F.lit("N"), "a", "c", "b", F.lit("W")))
        .when(F.col("style") == 1, F.format_string("%d°%d'%d\" s, w%d°%d′%d″", "a", "b", "c", "a", "c", "b"))
        .when(F.col("style") == 2, F.concat(F.lit("N"), "a", F.lit("."), two("b"), F.lit("/W"), "a", F.lit("."), two("c")))
        .otherwise(F.concat((F.col("a") + 60).cast("string"), F.lit(" 0")))
    )
    return p.select("id", typed_place(text).alias("p")).select("id", (F.round("p.lat", 9) + 0).alias("lat"), (F.round("p.lon", 9) + 0).alias("lon"))


# ---- light, resampling, cells, audits, graph check

_MATRIX = [[0.8, 0.25, -0.05], [0.1, 0.85, 0.05], [0.0, 0.1, 0.9]]


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_partkey % 256 AS DOUBLE)/255 AS c, CAST(p_size AS DOUBLE)/40 AS r, CAST(p_partkey % 50 AS DOUBLE)/60 AS g, CAST(p_partkey % 31 AS DOUBLE)/70 AS b, CAST(p_partkey % 17 AS DOUBLE)/20 AS n FROM part)
SELECT id, round(CASE WHEN c <= 0.04045 THEN c/12.92 ELSE pow((c + 0.055e0)/1.055e0, 2.4e0) END, 9) AS light, round((0.8e0*r + 0.25e0*g - 0.05e0*b)/0.3e0, 9) AS red, round((0.1e0*r + 0.85e0*g + 0.05e0*b)/0.3e0, 9) AS green, round((0.1e0*g + 0.9e0*b)/0.3e0, 9) AS blue, round(n/0.5e0, 9) AS nir FROM p""")
def p25_scene_light(spark, sf):
    """Linear light of display bytes; scene light of reflectance in four bands."""
    from ..functions import tone

    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", "p_partkey % 256 AS byte", "CAST(p_size AS DOUBLE)/40 AS r", "CAST(p_partkey % 50 AS DOUBLE)/60 AS g", "CAST(p_partkey % 31 AS DOUBLE)/70 AS b", "CAST(p_partkey % 17 AS DOUBLE)/20 AS n")
    light = tone.scene_light([F.col("r"), F.col("g"), F.col("b")], _MATRIX, F.col("n"))
    return p.select("id", F.round(tone.srgb_light(F.col("byte")), 9).alias("light"), *(F.round(c, 9).alias(n) for c, n in zip(light, ("red", "green", "blue", "nir"), strict=True)))


@query(f"""WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS c, CASE WHEN event_id % 6 > 0 THEN accuracy END AS v FROM {V.sql('g_fix')}), s AS (SELECT user_id, CAST(i AS INT) AS station, i*(c-1)/15e0 AS x, c FROM (SELECT DISTINCT user_id, c FROM p), range(16) r(i)),
j AS (SELECT s.*, a.v AS a, b.v AS b, x - a.k AS f FROM s JOIN p a ON a.user_id = s.user_id AND a.k = CAST(floor(x) AS BIGINT) LEFT JOIN p b ON b.user_id = s.user_id AND b.k = a.k + 1) SELECT user_id, station, round(CASE WHEN a IS NULL OR b IS NULL THEN a ELSE a + (b-a)*f END, 6) AS v FROM j""")
def w7_resampled(spark, sf):
    """Each user's run of values at sixteen even stations."""
    from ..operators import layers

    f = V.view(spark, sf, "g_fix").select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 6 > 0, F.col("accuracy")).alias("v"))
    return layers.resampled(f, "user_id", 16).withColumn("v", F.round("v", 6))


_BOTH = f"(SELECT id, 0 AS kind, lat, lon FROM {V.sql('g_place')} UNION ALL SELECT event_id, 1, lat, lon FROM {V.sql('g_fix')})"


@query(f"WITH {V.coded(_BOTH)}, c AS (SELECT id, kind, {V.prefix_sql(7)} AS prefix FROM coded) SELECT f.id, f.prefix, n.places FROM c f JOIN (SELECT prefix, count(*) AS places FROM c WHERE kind = 0 GROUP BY prefix) n USING (prefix) WHERE f.kind = 1")
def j12_fixes_in_place_cells(spark, sf):
    """The fixes in cells that hold places, with how many those hold: a join of two tables on the cell."""
    from ..functions import cells as C
    from ..operators import layers

    places = C.encode(V.view(spark, sf, "g_place")).groupBy(C.prefix(7).alias("prefix")).agg(F.count("*").alias("places"))
    fixes = C.encode(V.view(spark, sf, "g_fix")).select(F.col("event_id").alias("id"), "diamond", "u", "v")
    return layers.in_cells(fixes, places, 7).select("id", "prefix", "places")


@query(f"""WITH c AS (SELECT prefix, count(*) AS n, count(*) FILTER (class = 0) AS gone, count(*) FILTER (class = 0 AND seq % 3 = 0) AS sea FROM {TEXELS} GROUP BY prefix),
a AS (SELECT prefix >> 2 AS area, count(*) AS cells, count(*) FILTER (gone > 0.2*n) AS bad, sum(n) AS n, sum(gone) AS gone, sum(sea) AS sea FROM c GROUP BY 1) SELECT area, cells, bad, round(100.0::DOUBLE*gone/n, 6) AS missing, round(100.0::DOUBLE*sea/gone, 6) AS wet FROM a WHERE bad > 0 ORDER BY bad DESC, gone DESC, area LIMIT 10""")
def a18_t6_biggest_gaps(spark, sf):
    """The ten areas with most cells that miss texels."""
    from ..operators import audit
    from .tables import texels

    return audit.biggest_gaps(texels(spark, sf), F.col("class") == 0, F.col("seq") % 3 == 0, 1, 0.2)


@query(f"SELECT depth::INT AS depth, prefix, way, count(*) AS texels, 0::BIGINT AS unmarked FROM {_ROUTES} GROUP BY ALL")
def r13_graph_check(spark, sf):
    """Whether every texel of every way is a node or in a corridor."""
    from ..operators import corridors
    from .routes import routes

    s = routes(spark, sf)
    return corridors.check(s, corridors.graph(s, pairs=False)).select("depth", "prefix", "way", "texels", "unmarked")


_D3 = f"(SELECT prefix, texel % 512 AS texel, CASE class WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 3 THEN 9 END AS class, class = 3 AS wet FROM {TEXELS})"


@query(f"""WITH n AS (SELECT prefix, texel, class, count(*) AS n FROM {_D3} GROUP BY ALL), m AS (SELECT prefix, texel, max({{'n': n, 'c': class}}) AS m FROM n GROUP BY ALL), w AS (SELECT prefix, texel, count(*) FILTER (wet) AS n FROM {_D3} GROUP BY ALL)
SELECT prefix, texel, m.c AS class, (m.n*255 // 16)::BIGINT AS cov, coalesce((w.n*255 // 16)::BIGINT, 0) AS water FROM m JOIN w USING (prefix, texel)""")
def d3_a11_mapped_classes(spark, sf):
    """The ruling class of sampled values under a map of classes, and the share of water apart."""
    from ..operators import layers
    from .tables import texels

    s = texels(spark, sf).select("prefix", (F.col("texel") % 512).alias("texel"), F.col("class").alias("value"))
    classes = spark.createDataFrame([(0, 5), (1, 5), (3, 9)], "value bigint, class bigint")
    found = layers.sampled_classes(s, classes=classes).join(layers.water_share(s, F.col("value") == 3).withColumnRenamed("cov", "water"), ["prefix", "texel"], "left")
    return found.select("prefix", "texel", "class", "cov", F.coalesce("water", F.lit(0)).cast("bigint").alias("water"))


@query(f"""WITH n AS (SELECT depth, prefix, texel, class, cov FROM {TEXELS} WHERE seq % 3 > 0), o AS (SELECT depth, prefix, texel, class + 1 AS class, 100 - cov AS cov FROM {TEXELS} WHERE seq % 3 < 2)
SELECT coalesce(n.depth, o.depth) AS depth, coalesce(n.prefix, o.prefix) AS prefix, coalesce(n.texel, o.texel) AS texel, CASE WHEN coalesce(n.cov > o.cov, false) OR o.cov IS NULL THEN n.class ELSE o.class END AS class, CASE WHEN coalesce(n.cov > o.cov, false) OR o.cov IS NULL THEN n.cov ELSE o.cov END AS cov FROM n FULL JOIN o USING (depth, prefix, texel)""")
def d5_merge_where(spark, sf):
    """New texels over old ones where they cover more."""
    from ..operators import merge
    from .tables import texels

    t = texels(spark, sf)
    old = t.where("seq % 3 < 2").withColumns({"class": F.col("class") + 1, "cov": 100 - F.col("cov")})
    return merge.over(t.where("seq % 3 > 0"), old, ["class", "cov"], take_new=lambda n, o: n["cov"] > o["cov"]).select("depth", "prefix", "texel", "class", "cov")
