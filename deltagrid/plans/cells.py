"""Queries of the grid functions and of the minimum slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators.dealt import tasks
from . import views as V

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def globe(spark: SparkSession, sf: str) -> DataFrame:
    return C.encode(V.view(spark, sf, "g_globe"))


GLOBE = V.coded(V.sql("g_globe"))
FIXES = V.coded(V.sql("g_fix"))


@query(f"""WITH {FIXES}, c AS (SELECT {V.prefix_sql(8)} AS p8, user_id, ts FROM coded), up AS (SELECT 8 - k AS depth, p8 >> (2*k) AS prefix, user_id, ts FROM c, range(5) t(k))
SELECT CAST(depth AS INT) AS depth, prefix, count(*) AS fixes, count(DISTINCT user_id) AS users, max(ts) AS last_ts FROM up GROUP BY ALL""")
def slice_fixes_by_cell(spark, sf):
    """How many fixes, users and the last fix, per cell at depth 8 and per ancestor up to depth 4. Users are counted per ancestor after one partial count per cell and user, so what is expanded is that count, not the fixes."""
    per = C.encode(V.view(spark, sf, "g_fix")).withColumn("p8", C.prefix(8)).groupBy("p8", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    up = per.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select((8 - F.col("k")).alias("depth"), C.ancestor(F.col("p8"), F.col("k")).alias("prefix"), "user_id", "n", "ts")
    return up.groupBy("depth", "prefix").agg(F.sum("n").alias("fixes"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last_ts"))


@query(f"WITH {GLOBE} SELECT id, orderkey, diamond, u >> 10 AS u20, v >> 10 AS v20 FROM coded")
def c1_encode(spark, sf):
    return globe(spark, sf).select("id", "orderkey", "diamond", F.shiftright("u", 10).alias("u20"), F.shiftright("v", 10).alias("v20"))


@query(f"WITH {V.coded('(SELECT * FROM ' + V.sql('g_globe') + ')')} SELECT count(*) AS n, sum(CASE WHEN diamond IN (2, 3, 4) THEN 1 ELSE 0 END) AS kept FROM coded")
def c2_encode_within(spark, sf):
    """Encoding within three diamonds agrees with the full search wherever that falls in them."""
    inner = C.encode(globe(spark, sf).withColumnRenamed("diamond", "d0").withColumnRenamed("u", "u0").withColumnRenamed("v", "v0"), within=[2, 3, 4])
    same = (F.col("d0") == F.col("diamond")) & (F.col("u0") == F.col("u")) & (F.col("v0") == F.col("v"))
    return inner.agg(F.count("*").alias("n"), F.sum((F.col("d0").isin(2, 3, 4) & same).cast("bigint")).alias("kept"))


@query(f"""WITH {GLOBE}, s AS (SELECT *, (u+0.5)/1073741824 AS cu, (v+0.5)/1073741824 AS cv FROM coded), {V.locate_sql('s', 'cu', 'cv')}
SELECT id, orderkey, round(lat2, 5) AS lat2, round(lon2, 5) AS lon2 FROM placed""")
def c3_decode(spark, sf):
    return C.decode(globe(spark, sf).select("id", "orderkey", "diamond", "u", "v"), "lat2", "lon2").select("id", "orderkey", F.round("lat2", 5).alias("lat2"), F.round("lon2", 5).alias("lon2"))


@query(f"""WITH s AS (SELECT id, orderkey, CAST(id % 10 AS INT) AS diamond, CAST(id % 97 AS DOUBLE)/96 AS cu, CAST(orderkey % 89 AS DOUBLE)/88 AS cv FROM {V.sql('g_globe')}), {V.locate_sql('s', 'cu', 'cv')}
SELECT id, orderkey, round(lat2, 6) AS lat2, round(cos(radians(lat2))*lon2, 6) + 0.0 AS lon2 FROM placed""")
def c4_locate(spark, sf):
    s = V.view(spark, sf, "g_globe").select("id", "orderkey", (F.col("id") % 10).cast("int").alias("diamond"), ((F.col("id") % 97).cast("double") / 96).alias("cu"), ((F.col("orderkey") % 89).cast("double") / 88).alias("cv"))
    return C.locate(s, "diamond", "cu", "cv", "lat2", "lon2").select("id", "orderkey", F.round("lat2", 6).alias("lat2"), (F.round(F.cos(F.radians("lat2")) * F.col("lon2"), 6) + 0.0).alias("lon2"))


@query(f"WITH {GLOBE} SELECT id, orderkey, {V.spread('u >> 10')} AS spread_u, u >> 10 AS back FROM coded")
def c6_morton(spark, sf):
    g = globe(spark, sf).select("id", "orderkey", F.shiftright("u", 10).alias("x"))
    s = g.withColumn("spread_u", C.spread(F.col("x")))
    return s.select("id", "orderkey", "spread_u", C.compact(F.col("spread_u")).alias("back"))


@query(f"""WITH {GLOBE}, c AS (SELECT {V.prefix_sql(20)} AS p FROM coded) SELECT CAST(20 - 5*k AS INT) AS depth, p >> (10*k) AS prefix, count(*) AS n FROM c, range(5) t(k) GROUP BY ALL""")
def c7_cells(spark, sf):
    n = tasks(V.view(spark, sf, "g_globe"), 1 << 19)
    g = globe(spark, sf).select(C.prefix(20).alias("p")).repartition(n, "p").groupBy("p").count()
    up = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select((20 - 5 * F.col("k")).alias("depth"), C.ancestor(F.col("p"), 5 * F.col("k")).alias("prefix"), "count")
    return up.repartition(5 * n, "depth", "prefix").groupBy("depth", "prefix").agg(F.sum("count").alias("n"))


@query(f"""WITH {GLOBE}, c AS (SELECT DISTINCT {V.prefix_sql(8)} AS p FROM coded), t AS (SELECT DISTINCT p >> 6 AS q FROM c WHERE (p >> 6) % 3 = 0)
SELECT q AS prefix, count(*) AS inside FROM t JOIN c ON (p >> 6) = q GROUP BY q""")
def c8_contains(spark, sf):
    cells8 = globe(spark, sf).select(C.prefix(8).alias("p")).distinct()
    targets = spark.range(10 << 10).where("id % 3 = 0").select(F.col("id").alias("q"))
    joined = cells8.join(targets, C.ancestor(F.col("p"), 3) == F.col("q")).where(C.contains(F.lit(5), F.col("q"), F.lit(8), F.col("p")))
    return joined.groupBy(F.col("q").alias("prefix")).agg(F.count("*").alias("inside"))


@query(f"""WITH {GLOBE}, c AS (SELECT DISTINCT {V.prefix_sql(6)} AS p FROM coded) SELECT p AS prefix, p >> 2 AS parent, (p << 2) | k AS child, (p << 2 | k) >> 4 AS grand FROM c, range(4) t(k)""")
def c9_family(spark, sf):
    c = globe(spark, sf).select(C.prefix(6).alias("prefix")).distinct().withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    return c.select("prefix", C.ancestor(F.col("prefix"), 1).alias("parent"), C.child(F.col("prefix"), F.col("k")).alias("child"), C.ancestor(C.child(F.col("prefix"), F.col("k")), 2).alias("grand"))


@query(f"""WITH {GLOBE}, c AS (SELECT DISTINCT {V.prefix_sql(6)} AS p FROM coded) SELECT p AS prefix, CAST(p >> 12 AS INT) AS diamond,
CAST(list_sum([((p & 4095) >> (2*i+1) & 1) << i for i in range(6)]) AS BIGINT) AS cu, CAST(list_sum([((p & 4095) >> (2*i) & 1) << i for i in range(6)]) AS BIGINT) AS cv, ((((p & 4095) << 2) | 3) << 46) AS centre FROM c""")
def c10_centre_and_grid(spark, sf):
    c = globe(spark, sf).select(C.prefix(6).alias("prefix")).distinct()
    cu, cv = C.grid(6, F.col("prefix"))
    return c.select("prefix", C.cell_diamond(6, F.col("prefix")).cast("int").alias("diamond"), cu.alias("cu"), cv.alias("cv"), F.shiftleft(C.child(F.col("prefix"), 3), 46).bitwiseAND((1 << 60) - 1).alias("centre"))


@query(f"""WITH {GLOBE}, c AS (SELECT DISTINCT {V.prefix_sql(6)} AS p FROM coded), g AS (SELECT p, CAST(p >> 12 AS INT) AS diamond, k, list_sum([((p & 4095) >> (2*i+1) & 1) << i for i in range(6)]) AS gu, list_sum([((p & 4095) >> (2*i) & 1) << i for i in range(6)]) AS gv FROM c, range(4) t(k)),
s AS (SELECT *, CAST(gu + k % 2 AS DOUBLE)/64 AS cu, CAST(gv + k // 2 AS DOUBLE)/64 AS cv FROM g), {V.locate_sql('s', 'cu', 'cv')} SELECT p AS prefix, CAST(k AS INT) AS corner, round(lat2, 6) + 0.0 AS lat, round(cos(radians(lat2))*cos(radians(lon2)), 6) + 0.0 AS x FROM placed""")
def c12_corners(spark, sf):
    c = globe(spark, sf).select(C.prefix(6).alias("prefix")).distinct().withColumn("corner", F.explode(F.array(*map(F.lit, range(4)))))
    gu, gv = C.grid(6, F.col("prefix"))
    c = c.withColumns({"d": C.cell_diamond(6, F.col("prefix")).cast("int"), "cu": (gu + F.col("corner") % 2) / 64, "cv": (gv + F.floor(F.col("corner") / 2)) / 64})
    return C.locate(c, "d", "cu", "cv").select("prefix", "corner", (F.round("lat", 6) + 0.0).alias("lat"), (F.round(F.cos(F.radians("lat")) * F.cos(F.radians("lon")), 6) + 0.0).alias("x"))


@query(f"WITH {GLOBE} SELECT id, orderkey, {V.prefix_sql(10)} AS prefix, {V.texel_sql(10)} AS texel FROM coded")
def c13_texel(spark, sf):
    return globe(spark, sf).select("id", "orderkey", C.prefix(10).alias("prefix"), C.texel(10).alias("texel"))


@query(f"""WITH {GLOBE}, t AS (SELECT DISTINCT {V.texel_sql(10)} AS t FROM coded) SELECT t AS texel, round(((t >> 1) & 255) + CASE t & 1 WHEN 0 THEN 1.0/3 ELSE 2.0/3 END, 6) AS cx, round((t >> 9) + CASE t & 1 WHEN 0 THEN 1.0/3 ELSE 2.0/3 END, 6) AS cy FROM t""")
def c14_texel_centroid(spark, sf):
    t = globe(spark, sf).select(C.texel(10).alias("texel")).distinct()
    tx, ty, half = C.texel_parts(F.col("texel"))
    off = F.when(half == 0, F.lit(1.0) / 3).otherwise(F.lit(2.0) / 3)
    return t.select("texel", F.round(tx + off, 6).alias("cx"), F.round(ty + off, 6).alias("cy"))


@query(f"""WITH {GLOBE}, t AS (SELECT DISTINCT {V.prefix_sql(10)} AS p, {V.texel_sql(10)} AS t FROM coded), x AS (SELECT p, t, (t>>1)&255 AS tx, t>>9 AS ty, t&1 AS h FROM t)
SELECT p AS prefix, t AS texel, p >> 2 AS parent, ((((((p & 1) << 7) + (ty >> 1)) << 8) | (((p >> 1 & 1) << 7) + (tx >> 1))) << 1) | CASE WHEN tx%2=1 AND ty%2=1 THEN 1 WHEN tx%2=0 AND ty%2=0 THEN 0 ELSE h END AS parent_texel FROM x""")
def c15_texel_parent(spark, sf):
    t = globe(spark, sf).select(C.prefix(10).alias("prefix"), C.texel(10).alias("texel")).distinct()
    cell, up = C.texel_parent(F.col("prefix"), F.col("texel"))
    return t.select("prefix", "texel", cell.alias("parent"), up.alias("parent_texel"))


@query(f"""WITH {GLOBE}, t AS (SELECT DISTINCT {V.texel_sql(10)} AS t FROM coded), x AS (SELECT q, c, (c>>1)&255 AS tx, c>>9 AS ty, c&1 AS h FROM range(4) a(q), range(131072) b(c)),
u AS (SELECT q, c, ((((((q & 1) << 7) + (ty >> 1)) << 8) | (((q >> 1 & 1) << 7) + (tx >> 1))) << 1) | CASE WHEN tx%2=1 AND ty%2=1 THEN 1 WHEN tx%2=0 AND ty%2=0 THEN 0 ELSE h END AS up FROM x) SELECT t AS texel, q AS quarter, c AS child FROM t JOIN u ON up = t""")
def c15_texel_children(spark, sf):
    """The four children of each texel, against all texels of four cells whose parent it is."""
    t = globe(spark, sf).select(C.texel(10).alias("texel")).distinct().withColumn("c", F.explode(C.texel_children(F.col("texel"))))
    return t.select("texel", F.col("c.quarter").cast("bigint").alias("quarter"), F.col("c.texel").alias("child"))


@query(f"""WITH {GLOBE}, t AS (SELECT DISTINCT {V.texel_sql(10)} AS t FROM coded), x AS (SELECT t, (t>>1)&255 AS tx, t>>9 AS ty, t&1 AS h, CASE t&1 WHEN 0 THEN -1 ELSE 1 END AS s FROM t),
n AS (SELECT t, h, tx AS x, ty AS y FROM x UNION ALL SELECT t, h, tx+s, ty FROM x UNION ALL SELECT t, h, tx, ty+s FROM x) SELECT t AS texel, (((y << 8) | x) << 1) | (1-h) AS near FROM n WHERE x BETWEEN 0 AND 255 AND y BETWEEN 0 AND 255""")
def c16_neighbours(spark, sf):
    t = globe(spark, sf).select(C.texel(10).alias("texel")).distinct()
    return t.select("texel", F.explode(C.texel_neighbours(F.col("texel"))).alias("near"))


@query(f"""WITH {GLOBE}, k AS (SELECT id, orderkey, diamond, u, v, xor(xor(u + v, u), v) AS c FROM coded) SELECT id, orderkey, diamond, CAST((c >> 30) & 1 AS INT) AS face,
CAST(list_sum([(CASE WHEN (u >> i & 1) <> (v >> i & 1) THEN (u >> i & 1)*2 + (v >> i & 1) ELSE (xor(c, c >> 1) >> i & 1)*3 END) << (2*(i-16)) for i in range(16, 30)]) AS BIGINT) AS digits FROM k""")
def c17_triangle_code(spark, sf):
    g = globe(spark, sf).withColumn("code", C.triangle_code())
    low = F.col("code").bitwiseAND((1 << 58) - 1)
    return g.select("id", "orderkey", F.shiftrightunsigned("code", 59).cast("int").alias("diamond"), F.shiftright("code", 58).bitwiseAND(1).cast("int").alias("face"), F.shiftright(low, 30).alias("digits"))


@query("SELECT p_partkey AS id, CAST(p_partkey % 31 AS INT) AS depth, 1.1071487177940905e0 * 6371000e0 / pow(2.0, p_partkey % 31) AS edge_m, 7054000e0 / pow(2.0, p_partkey % 31) / 256 AS texel_m FROM part")
def c20_sizes(spark, sf):
    d = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 31).cast("int").alias("depth"))
    return d.select("id", "depth", C.cell_edge_m(F.col("depth")).alias("edge_m"), C.texel_m(F.col("depth")).alias("texel_m"))


@query(f"""WITH b AS (SELECT *, greatest(least(1.1071487177940905e0*6371000e0/1024/2/111320, (lat1-lat0)/8), 0.0001) AS ds, greatest(least(1.1071487177940905e0*6371000e0/1024/2/111320, (lon1-lon0)/8), 0.0001) AS dl FROM {V.sql('g_box')}),
s AS (SELECT id, least(lat0 + i*ds, lat1) AS lat, least(lon0 + j*dl, lon1) AS lon FROM b, range(200) a(i), range(200) c(j) WHERE i <= CAST(ceil((lat1-lat0)/ds) AS INT) AND j <= CAST(ceil((lon1-lon0)/dl) AS INT)), {V.coded('s')} SELECT DISTINCT id, {V.prefix_sql(10)} AS prefix FROM coded""")
def c21_cover(spark, sf):
    return C.cover(V.view(spark, sf, "g_box"), 10).select("id", "prefix")


@query("SELECT s_suppkey AS id, CAST(s_suppkey % 4 AS INT) AS depth, r AS prefix FROM supplier JOIN range(640) s(r) ON r < 10 * pow(4, s_suppkey % 4)")
def c23_regions(spark, sf):
    d = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 4).cast("int").alias("depth"))
    return d.select("id", "depth", F.explode(F.sequence(F.lit(0).cast("bigint"), (10 * F.pow(F.lit(4), F.col("depth")) - 1).cast("bigint"))).alias("prefix"))
