"""Queries of camera frames, sampled grids, heights at places, downloads, retries, area documents, file lists, the sun that is followed and shading."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import capture as A
from ..streaming import tracks as T
from . import views as V
from .cells import GLOBE, globe
from .tables import RASTER, raster

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_W, _H = 200, 130
_PIXELS = f"(SELECT l_orderkey % 3 AS frame, l_partkey * 31 % {_W} AS x, l_suppkey * 17 % {_H} AS y, max(l_orderkey * 7919 % 1100) AS v FROM lineitem GROUP BY ALL)"


def pixels(spark, sf):
    p = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey % 3 AS frame", f"l_partkey * 31 % {_W} AS x", f"l_suppkey * 17 % {_H} AS y", "l_orderkey * 7919 % 1100 AS v")
    return p.groupBy("frame", "x", "y").agg(F.max("v").alias("v"))


@query(f"""WITH p AS (SELECT frame, x // 20 AS bx, y // 20 AS yy, (y % 2)*2 + x % 2 AS k, v FROM {_PIXELS} WHERE x < 200 AND y < 120), s AS (SELECT frame, bx, yy, greatest(coalesce(sum(v) FILTER (k = 0), 0) - 6400, 0) AS a, greatest(coalesce(sum(v) FILTER (k = 1), 0) - 6400, 0) AS b, greatest(coalesce(sum(v) FILTER (k = 2), 0) - 6000, 0) AS c, greatest(coalesce(sum(v) FILTER (k = 3), 0) - 6200, 0) AS d, count(*) FILTER (v >= 1021) AS clipped FROM p GROUP BY ALL)
SELECT frame, bx, yy AS "by", (b * 64 // 100)::BIGINT AS red, (((a + d) // 2) * 64 // 100)::BIGINT AS green, (c * 64 // 100)::BIGINT AS blue, clipped FROM s""")
def a29_binned(spark, sf):
    return A.binned(pixels(spark, sf), _W, _H, 10, 1023, (64, 64, 60, 62), "grbg")


@query(f"""WITH h AS (SELECT frame, least(v // 4, 255) AS bin, count(*) AS n FROM {_PIXELS} WHERE y % 2 = 0 AND y < 120 AND x % 16 = 0 AND x <= 184 GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY frame ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY frame) AS total FROM h)
SELECT frame, bin, n, round(min(bin) FILTER (seen * 1000 >= total * 999) OVER (PARTITION BY frame) / 255e0, 6) AS p999 FROM s""")
def a29_histogram(spark, sf):
    h = A.histogram(pixels(spark, sf), _W, _H, 10, 1023)
    return h.join(A.brightest(h), "frame").select("frame", "bin", "n", F.round("p999", 6).alias("p999"))


@query("""WITH g AS (SELECT l_partkey % 50 AS cx, l_suppkey % 40 AS cy, max(l_orderkey % 4 * 60) AS intensity, max(l_linenumber) AS canopy FROM lineitem GROUP BY ALL), p AS (SELECT o_orderkey AS id, 1000 + o_orderkey * 7 % 600/10e0 - 5 AS x, 2000 - o_custkey * 11 % 500/10e0 + 3 AS y FROM orders)
SELECT id, nullif(intensity, 0) AS intensity, canopy FROM p JOIN g ON floor(x - 1000) = cx AND floor(2000 - y) = cy""")
def g20_grid_values(spark, sf):
    g = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_partkey % 50 AS cx", "l_suppkey % 40 AS cy", "l_orderkey % 4 * 60 AS i", "l_linenumber").groupBy("cx", "cy").agg(F.max("i").alias("intensity"), F.max("l_linenumber").alias("canopy"))
    p = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", "1000 + CAST(o_orderkey * 7 % 600 AS DOUBLE)/10 - 5 AS x", "2000 - CAST(o_custkey * 11 % 500 AS DOUBLE)/10 + 3 AS y")
    return A.grid_values(p, g, 1000.0, 2000.0)


_DEPTHS = " UNION ALL ".join(f"SELECT id, diamond, u, v, orderkey, {d} AS depth, {V.prefix_sql(d)} AS prefix, {V.texel_sql(d)} AS texel FROM coded" for d in (2, 3, 4))


@query(f"""WITH {GLOBE}, a AS ({_DEPTHS}), d AS (SELECT depth, prefix, texel, CASE WHEN min(orderkey) % 5 > 0 THEN min(orderkey) % 40000 + 20000 END AS q FROM a WHERE (orderkey + depth) % 3 = 0 GROUP BY ALL),
b AS (SELECT a.id, u, v, arg_max(q, a.depth) FILTER (q IS NOT NULL) AS q FROM a LEFT JOIN d USING (depth, prefix, texel) GROUP BY a.id, diamond, u, v) SELECT id, u, v, q / 2e0 - 11000 AS elev FROM b""")
def g19_elevation_at(spark, sf):
    g = globe(spark, sf)
    a = g.select("orderkey", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), C.prefix(d).alias("prefix"), C.texel(d).alias("texel")) for d in (2, 3, 4)])).alias("a")).select("orderkey", "a.*")
    q = F.min("orderkey")
    dem = a.where("(orderkey + depth) % 3 = 0").groupBy("depth", "prefix", "texel").agg(F.when(q % 5 > 0, q % 40000 + 20000).alias("q"))
    at = g.select(F.struct("id", "diamond", "u", "v").alias("id"), "diamond", "u", "v")
    return A.elevation_at(at, dem, 2, 4).select("id.id", "id.u", "id.v", "elev")


_CELLS = "(SELECT DISTINCT CAST(u AS INT) AS up, p >> (2*u) AS prefix FROM (SELECT o_orderkey % 16384 AS p FROM orders), range(5) r(u))"
_STATUS = "CASE (prefix * 7 + up) % 11 WHEN 0 THEN 'absent' WHEN 1 THEN 'failed' ELSE 'bytes' END"
_EXTRA = "CASE (prefix + up) % 7 WHEN 0 THEN 'absent' WHEN 1 THEN 'failed' ELSE 'bytes' END"


@query(f"""WITH c AS (SELECT *, {_STATUS} AS s, {_EXTRA} AS e FROM {_CELLS}), g AS (SELECT c.*, EXISTS (SELECT 1 FROM c a WHERE a.s = 'absent' AND a.up >= c.up AND a.prefix = c.prefix >> (2*(a.up - c.up))) AS gone FROM c)
SELECT count(*) AS done, count(*) FILTER (gone) AS absent, count(*) FILTER (NOT gone AND s = 'failed') + count(*) FILTER (NOT gone AND s = 'bytes' AND e = 'failed') AS failed, (coalesce(sum(prefix % 1000) FILTER (NOT gone AND s = 'bytes'), 0) + coalesce(sum(up * 10) FILTER (NOT gone AND s = 'bytes' AND e = 'bytes'), 0))::BIGINT AS bytes FROM g""")
def m11_downloaded(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") % 16384).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("up"))
    c = o.selectExpr("up", "shiftright(p, 2 * up) AS prefix").distinct()
    answers = c.selectExpr("'base' AS layer", "up", "prefix", f"{_STATUS} AS status", "prefix % 1000 AS bytes").unionByName(c.selectExpr("'dem' AS layer", "up", "prefix", f"{_EXTRA} AS status", "CAST(up * 10 AS BIGINT) AS bytes"))
    return A.downloaded(c, answers, 4)


@query("""WITH f AS (SELECT l_suppkey AS key, l_orderkey % 5000 / 4e0 AS t FROM lineitem), r AS (SELECT o_orderkey AS id, o_custkey AS key, o_orderkey % 5000 / 4e0 AS t FROM orders) SELECT id, key, t AS "at" FROM r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.key = r.key AND f.t <= r.t AND r.t - f.t < 3)""")
def m7_retried(spark, sf):
    f = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_suppkey AS key", "CAST(l_orderkey % 5000 AS DOUBLE) / 4 AS at")
    r = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS id", "o_custkey AS key", "CAST(o_orderkey % 5000 AS DOUBLE) / 4 AS at")
    return A.retried(r, f).select("id", "key", "at")


@query("SELECT c_nationkey AS area, least(greatest(c_nationkey, 8), 14) AS depth, c_custkey % 12 AS cell_depth, c_custkey % (1::BIGINT << (2 * (c_custkey % 12))) AS prefix, c_custkey % 255 AS cov FROM customer")
def k9_area_documents(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_nationkey AS area", "CAST(c_custkey % 12 AS INT) AS depth", "c_custkey % shiftleft(1L, CAST(2 * (c_custkey % 12) AS INT)) AS prefix", "c_custkey % 255 AS cov")
    n = spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_nationkey AS area", "n_name AS name", "0 AS created", "n_nationkey AS depth", "1L AS fetched", "2L AS bytes")
    return A.from_documents(A.documents(n, c, share=True))


@query("SELECT o_clerk || '.tif' AS file, 1990 + arg_min(o_custkey, o_orderkey) % 30 AS year, min(o_orderkey) AS seq FROM (SELECT *, 'C' || CAST(o_custkey % 90 AS VARCHAR) AS o_clerk FROM orders) GROUP BY o_clerk")
def t9_newest_files(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("concat('C', CAST(o_custkey % 90 AS STRING), '.tif') AS file", "1990 + o_custkey % 30 AS year", "o_orderkey AS seq")
    return A.newest_files(o)


@query("""WITH RECURSIVE f AS (SELECT way, n, az, alt, row_number() OVER (PARTITION BY way ORDER BY n, az, alt) AS k FROM (SELECT l_orderkey AS way, l_linenumber * 1000000 + l_partkey AS n, (l_partkey % 20)/100e0 AS az, (l_suppkey % 9)/100e0 AS alt FROM lineitem)),
r AS (SELECT way, k, az, alt, true AS taken FROM f WHERE k = 1 UNION ALL SELECT f.way, f.k, CASE WHEN abs(f.az - r.az) <= 0.05e0 AND abs(f.alt - r.alt) <= 0.05e0 THEN r.az ELSE f.az END, CASE WHEN abs(f.az - r.az) <= 0.05e0 AND abs(f.alt - r.alt) <= 0.05e0 THEN r.alt ELSE f.alt END, NOT (abs(f.az - r.az) <= 0.05e0 AND abs(f.alt - r.alt) <= 0.05e0) FROM r JOIN f ON f.way = r.way AND f.k = r.k + 1)
SELECT way, count(*) AS n, round(sum(az), 6) AS az, round(sum(alt), 6) AS alt FROM r WHERE taken GROUP BY way""")
def m13_followed(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey AS way", "l_linenumber * 1000000 + l_partkey AS n", "CAST(l_partkey % 20 AS DOUBLE)/100 AS az", "CAST(l_suppkey % 9 AS DOUBLE)/100 AS alt")
    a = li.groupBy("way").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "az", "alt"))), lambda s: F.struct(s["az"].alias("az"), s["alt"].alias("alt"))).alias("s"))
    t = a.select("way", F.explode(A.followed(F.col("s"))).alias("s"))
    return t.groupBy("way").agg(F.count("*").alias("n"), F.round(F.sum("s.az"), 6).alias("az"), F.round(F.sum("s.alt"), 6).alias("alt"))


@query(f"""WITH n AS (SELECT a.*, w.v AS n1, e.v AS n2, s.v AS n3, t.v AS n4 FROM {RASTER} a LEFT JOIN {RASTER} w ON w.tile=a.tile AND w.px=a.px-1 AND w.py=a.py LEFT JOIN {RASTER} e ON e.tile=a.tile AND e.px=a.px+1 AND e.py=a.py LEFT JOIN {RASTER} s ON s.tile=a.tile AND s.px=a.px AND s.py=a.py-1 LEFT JOIN {RASTER} t ON t.tile=a.tile AND t.px=a.px AND t.py=a.py+1 WHERE a.v IS NOT NULL),
g AS (SELECT *, CASE WHEN n1 IS NULL AND n2 IS NULL THEN 0 ELSE (coalesce(n2,v)-coalesce(n1,v))/(30.0*((n1 IS NOT NULL)::INT+(n2 IS NOT NULL)::INT)) END AS gx, CASE WHEN n3 IS NULL AND n4 IS NULL THEN 0 ELSE (coalesce(n4,v)-coalesce(n3,v))/(30.0*((n3 IS NOT NULL)::INT+(n4 IS NOT NULL)::INT)) END AS gy FROM n)
SELECT tile, px, py, round(1/sqrt(gx*gx + gy*gy + 1), 6) AS nz, round(greatest((0.6e0 - gx*0.48e0 + gy*0.64e0)/sqrt(gx*gx + gy*gy + 1), 0), 6) + 0.0 AS light FROM g""")
def v6_shaded(spark, sf):
    s = A.shaded(raster(spark, sf), 30.0, (0.48, -0.64, 0.6))
    return s.select("tile", "px", "py", F.round("nz", 6).alias("nz"), (F.round("light", 6) + 0.0).alias("light"))


_RECORD = {"coord": "event_id * 7", "ms": "event_id * 1000", "height": "CASE WHEN event_id % 9 = 0 THEN -2147483648 ELSE event_id % 5000 - 100 END", "accuracy": "event_id % 3000", "vaccuracy": "CASE WHEN event_id % 4 = 0 THEN 65535 ELSE event_id % 700 END", "speed": "CASE WHEN event_id % 5 = 0 THEN 65535 ELSE event_id % 900 END", "bearing": "event_id % 36000"}


@query(f"""WITH r AS (SELECT user_id, event_id % 5 AS chunk, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id) - 1 AS n, {', '.join(f'{e} AS {c}' for c, e in _RECORD.items())} FROM events WHERE user_id IS NOT NULL)
SELECT user_id, chunk, CAST(n AS INT) AS n, coord, ms AS unix_ms, nullif(height, -2147483648) / 100e0 AS height_m, accuracy / 100e0 AS accuracy_m, nullif(vaccuracy, 65535) / 100e0 AS v_accuracy_m, nullif(speed, 65535) / 100e0 AS speed_ms, nullif(bearing, 65535) / 100e0 AS bearing_deg FROM r WHERE (user_id + chunk) % 11 <> 3""")
def s22_recorded(spark, sf):
    """Chunks of which every eleventh has lost the last entry of a column."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("user_id IS NOT NULL").selectExpr("user_id", "event_id % 5 AS chunk", "event_id", *(f"{x} AS {c}" for c, x in _RECORD.items()))
    g = e.groupBy("user_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("event_id", *_RECORD))).alias("f"))
    g = g.select("user_id", "chunk", *(F.col(f"f.{c}").alias(c) for c in _RECORD))
    lost = F.when((F.col("user_id") + F.col("chunk")) % 11 == 3, F.slice("speed", 1, F.size("speed") - 1)).otherwise(F.col("speed"))
    return T.recorded(g.withColumn("speed", lost), "user_id")
