"""Queries of cell names and orders, regions, stamps, polygons, selections and image cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as C
from ..operators import areas as A
from ..operators import stamp as S
from . import views as V
from .cells import GLOBE, globe
from .tables import TEXELS, texels

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- cells


@query(f"WITH {GLOBE}, c AS (SELECT DISTINCT {V.prefix_sql(7)} AS p FROM coded) SELECT p AS prefix, p AS again, concat('07', lpad(lower(hex(CAST(p AS UBIGINT) * 70368744177664::UBIGINT)), 16, '0')) AS name, p AS named FROM c")
def c11_c19_cell_names(spark, sf):
    """Cells taken apart into column and row and put together, and spelled as file names and read again."""
    c = globe(spark, sf).select(C.prefix(7).alias("prefix")).distinct()
    cu, cv = C.grid(7, F.col("prefix"))
    name = C.file_name(F.lit(7), F.col("prefix"))
    return c.select("prefix", C.from_grid(7, C.cell_diamond(7, F.col("prefix")), cu, cv).alias("again"), name.alias("name"), C.from_file_name(F.concat(name, F.lit(".x")))["prefix"].alias("named"))


@query("SELECT o_orderkey AS id, rtrim(replace(replace(base64(encode(o_orderpriority || CAST(o_orderkey AS VARCHAR))), '+', '-'), '/', '_'), '=') AS name FROM orders")
def c19_base64url(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("id"), C.base64url(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).cast("binary")).alias("name"))


@query(f"""WITH {GLOBE}, t AS (SELECT DISTINCT diamond, {V.prefix_sql(5)} AS prefix, {V.texel_sql(5)} AS texel FROM coded),
x AS (SELECT *, CASE texel & 1 WHEN 0 THEN 1/3e0 ELSE 2/3e0 END AS o, list_sum([((prefix >> (2*i+1)) & 1) << i for i in range(5)]) AS gu, list_sum([((prefix >> (2*i)) & 1) << i for i in range(5)]) AS gv FROM t),
s AS (SELECT *, (gu*256 + ((texel >> 1) & 255) + o)/8192 AS cu, (gv*256 + (texel >> 9) + o)/8192 AS cv FROM x), {V.locate_sql('s', 'cu', 'cv')} SELECT prefix, texel, round(lat2, 6) + 0.0 AS lat, round(cos(radians(lat2))*cos(radians(lon2)), 6) + 0.0 AS x FROM placed""")
def c14_texel_place(spark, sf):
    t = globe(spark, sf).select(C.prefix(5).alias("prefix"), C.texel(5).alias("texel")).distinct()
    p = C.texel_place(t, 5)
    return p.select("prefix", "texel", (F.round("lat", 6) + 0.0).alias("lat"), (F.round(F.cos(F.radians("lat")) * F.cos(F.radians("lon")), 6) + 0.0).alias("x"))


@query(f"""WITH {GLOBE}, t AS (SELECT DISTINCT {V.texel_sql(10)} AS t FROM coded) SELECT t AS texel, count(*) AS n, sum(j)::BIGINT AS total FROM (SELECT t, ((t >> 9) + dy)*512 + (((t >> 1) & 255) + dx)*2 + h AS j, (t >> 9) + dy AS y, ((t >> 1) & 255) + dx AS x FROM t, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy), (VALUES (0), (1)) c(h)) WHERE x BETWEEN 0 AND 255 AND y BETWEEN 0 AND 255 AND j <> t GROUP BY t""")
def c16_texels_around(spark, sf):
    t = globe(spark, sf).select(C.texel(10).alias("texel")).distinct()
    return t.select("texel", F.explode(C.texels_around(F.col("texel"))).alias("j")).groupBy("texel").agg(F.count("*").alias("n"), F.sum("j").alias("total"))


@query(f"WITH {GLOBE} SELECT id, orderkey, diamond, u >> 1 AS u, v >> 1 AS v, 1 AS ok FROM coded")
def c17_triangle_code_back(spark, sf):
    """Places coded as triangles and read again: the same but for the last bit of u and v, which the code does not hold."""
    g = globe(spark, sf).withColumn("code", C.triangle_code()).withColumn("p", C.from_triangle_code(F.col("code")))
    again = g.select("id", "orderkey", "code", F.col("p.diamond").alias("diamond"), F.col("p.u").alias("u"), F.col("p.v").alias("v"))
    return again.select("id", "orderkey", "diamond", F.shiftright("u", 1).alias("u"), F.shiftright("v", 1).alias("v"), (C.triangle_code() == F.col("code")).cast("int").alias("ok"))


@query("""WITH RECURSIVE d AS (SELECT CAST(h AS BIGINT) AS path, 0::BIGINT AS x, 0::BIGINT AS y, CAST(h AS BIGINT) AS h, 0 AS level FROM range(2) r(h) UNION ALL
SELECT path*4 + k, CASE k WHEN 0 THEN 2*x + h WHEN 1 THEN 2*x WHEN 2 THEN 2*x + 1 ELSE 2*x + h END, CASE k WHEN 0 THEN 2*y + h WHEN 1 THEN 2*y + 1 WHEN 2 THEN 2*y ELSE 2*y + h END, CASE k WHEN 3 THEN 1 - h ELSE h END, level + 1 FROM d, range(4) c(k) WHERE level < 8)
SELECT DISTINCT y*512 + x*2 + h AS texel, path AS place FROM d JOIN (SELECT (l_orderkey * 8 + l_linenumber) * 7919 % 131072 AS t FROM lineitem) ON t = y*512 + x*2 + h WHERE level = 8""")
def c18_disk_order(spark, sf):
    """The place on disk of each texel of a cell that a line item names."""
    t = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("(l_orderkey * 8 + l_linenumber) * 7919 % 131072 AS texel").distinct()
    return t.select("texel", C.disk_order(F.col("texel")).alias("place"))


def _samples_sql(depth: int, n: int, margin: float) -> str:
    m, k = 10 * 4**depth, 1 << depth
    return f"""g AS (SELECT p, CAST(p >> {2 * depth} AS INT) AS diamond, list_sum([((p >> (2*i+1)) & 1) << i for i in range({depth})] || [0]) AS gu, list_sum([((p >> (2*i)) & 1) << i for i in range({depth})] || [0]) AS gv FROM (SELECT DISTINCT c_custkey * 37 % {m} AS p FROM customer)),
s AS (SELECT *, (gu - {margin} + {1 + 2 * margin}*i/{n}e0)/{k} AS cu, (gv - {margin} + {1 + 2 * margin}*j/{n}e0)/{k} AS cv FROM g, range({n + 1}) a(i), range({n + 1}) b(j)), {V.locate_sql('s', 'cu', 'cv')},
wr AS (SELECT p, lat2, (lon2 + 180) - 360*floor((lon2 + 180)/360) - 180 AS lon2 FROM placed)"""


@query(f"WITH {_samples_sql(3, 96, 0.02)} SELECT p AS prefix, count(*) AS squares, min(a) AS south, max(a) AS north FROM (SELECT DISTINCT p, CAST(floor(lat2 + 1e-9) AS INT) AS a, CAST(floor(lon2 + 1e-9) AS INT) AS o FROM wr) GROUP BY p")
def c22_degree_squares(spark, sf):
    r = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") * 37 % (10 * 4**3)).alias("prefix")).distinct()
    return C.degree_squares(r, 3).groupBy("prefix").agg(F.count("*").alias("squares"), F.min("lat").alias("south"), F.max("lat").alias("north"))


@query(f"""WITH {_samples_sql(2, 48, 0.03)}, g2 AS (SELECT p, min(lat2) AS s, max(lat2) AS n, max(abs(lat2)) > 89.5 AS pole, min(lon2) AS w, max(lon2) AS e, min(lon2) FILTER (lon2 > 0) AS east, max(lon2) FILTER (lon2 < 0) AS west FROM wr GROUP BY p),
b AS (SELECT p, '' AS part, -180e0 AS lon0, 180e0 AS lon1 FROM g2 WHERE pole UNION ALL SELECT p, 'a', greatest(east - 0.05, -180), 180 FROM g2 WHERE NOT pole AND e - w > 180 UNION ALL SELECT p, 'b', -180, least(west + 0.05, 180) FROM g2 WHERE NOT pole AND e - w > 180 UNION ALL SELECT p, '', greatest(w - 0.05, -180), least(e + 0.05, 180) FROM g2 WHERE NOT pole AND e - w <= 180)
SELECT p AS prefix, part, round(greatest(s - 0.05, -90), 6) AS lat0, round(lon0, 6) AS lon0, round(least(n + 0.05, 90), 6) AS lat1, round(lon1, 6) AS lon1 FROM b JOIN g2 USING (p)""")
def c24_region_boxes(spark, sf):
    r = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") * 37 % (10 * 4**2)).alias("prefix")).distinct()
    return C.region_boxes(r, 2).select("prefix", "part", *(F.round(c, 6).alias(c) for c in ("lat0", "lon0", "lat1", "lon1")))


# ---- stamps

_SEGMENT = {"seq": "s_suppkey", "diamond": "CAST(s_suppkey % 10 AS INT)", "class": "s_suppkey % 9 + 1", "cov_max": "CASE WHEN s_suppkey % 4 = 0 THEN 120 ELSE 255 END", "mag": "s_suppkey * 13 % 255", "uses": "CAST(s_suppkey * 7 % 64 AS BIGINT)", "name": "s_suppkey % 5", "r": "0.5 + CAST(s_suppkey % 4 AS DOUBLE)/2", "au": "1000 + CAST(s_suppkey * 37 % 90 AS DOUBLE) + 0.25", "av": "990 + CAST(s_suppkey * 53 % 80 AS DOUBLE) + 0.5", "bu": "1000 + CAST(s_suppkey * 31 % 90 AS DOUBLE) + 0.75", "bv": "990 + CAST(s_suppkey * 41 % 80 AS DOUBLE)"}


@query(f"""WITH s AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _SEGMENT.items())} FROM supplier), l AS (SELECT *, CAST(greatest(ceil(sqrt((bu-au)*(bu-au)+(bv-av)*(bv-av)+(bu-au)*(bv-av))*2), 1) AS INT) AS steps, CAST(ceil(r*1.16+1) AS INT) AS reach FROM s),
p AS (SELECT *, au + (bu-au)*(i/CAST(steps AS DOUBLE)) AS px, av + (bv-av)*(i/CAST(steps AS DOUBLE)) AS py FROM l, range(2000) k(i) WHERE i <= steps),
t AS (SELECT *, CAST(floor(px) AS BIGINT) + dx AS tx, CAST(floor(py) AS BIGINT) + dy AS ty, CASE h WHEN 0 THEN 1/3e0 ELSE 2/3e0 END AS o FROM p, range(-6, 7) a(dx), range(-6, 7) b(dy), range(2) c(h) WHERE abs(dx) <= reach AND abs(dy) <= reach),
c AS (SELECT *, CAST(trunc(cov_max*least(greatest(r + 0.5 - sqrt((tx+o-px)*(tx+o-px)+(ty+o-py)*(ty+o-py)+(tx+o-px)*(ty+o-py)), 0), 1)) AS INT) AS cov FROM t WHERE tx >= 0 AND ty >= 0 AND tx < 262144 AND ty < 262144),
n AS (SELECT *, row_number() OVER (PARTITION BY diamond, tx, ty, h ORDER BY cov DESC, class, seq) AS rn, bit_or(uses) OVER (PARTITION BY diamond, tx, ty, h) AS bor FROM c WHERE cov > 0)
SELECT (CAST(diamond AS BIGINT) << 20) | ({V.spread('tx >> 8')} << 1) | {V.spread('ty >> 8')} AS prefix, (ty & 255)*512 + (tx & 255)*2 + h AS texel, class, cov, mag, bor AS uses, name FROM n WHERE rn = 1""")
def g8_segment_stamps(spark, sf):
    """Lines as bands of texels at depth 10."""
    return S.segments(spark.read.parquet(f"{sf}/supplier.parquet").selectExpr(*(f"{e} AS `{c}`" for c, e in _SEGMENT.items())), 10)


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY texel ORDER BY seq) AS n FROM (SELECT c_custkey AS seq, c_custkey % 97 AS texel, CASE WHEN c_custkey % 3 = 0 THEN 95 + c_custkey % 10 ELSE 64 + c_custkey % 6 END AS kind, c_custkey * 7919 % 50 AS rank FROM customer)),
h AS (SELECT t AS texel, CASE WHEN t % 4 = 0 THEN 3 ELSE 0 END AS kind, 0::BIGINT AS rank, 0::BIGINT AS seq, 0::BIGINT AS n FROM range(97) r(t) UNION ALL SELECT o.texel, CASE WHEN w THEN o.kind ELSE h.kind END, CASE WHEN w THEN o.rank ELSE h.rank END, CASE WHEN w THEN o.seq ELSE h.seq END, o.n FROM (SELECT o.texel AS ot, o.n AS on_, h.kind = 0 OR (o.kind < 95 AND (h.kind < 64 OR h.kind >= 95)) OR (h.kind >= 64 AND h.rank < o.rank AND (o.kind >= 95) = (h.kind >= 95)) AS w FROM h JOIN o ON o.texel = h.texel AND o.n = h.n + 1) z JOIN o ON o.texel = ot AND o.n = on_ JOIN h ON h.texel = o.texel AND h.n = o.n - 1)
SELECT texel, kind, rank, seq FROM h QUALIFY row_number() OVER (PARTITION BY texel ORDER BY n DESC) = 1""")
def g9_point_stamps(spark, sf):
    """Points put into texels one after the other, over what lines left there."""
    p = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 97).alias("texel"), F.when(F.col("c_custkey") % 3 == 0, 95 + F.col("c_custkey") % 10).otherwise(64 + F.col("c_custkey") % 6).alias("kind"), (F.col("c_custkey") * 7919 % 50).alias("rank"))
    lines = spark.range(97).select(F.col("id").alias("texel"), F.when(F.col("id") % 4 == 0, 3).otherwise(0).alias("kind"))
    return S.points(p, lines, ["texel"]).select("texel", "kind", "rank", "seq")


# ---- polygons and areas

_RING = "[(lat0, lon0), (lat0, lon1), (lat1, lon1), ((lat0+lat1)/2, (lon0+lon1)/2), (lat1, lon0), (lat0, lon0)]"
_SHAPES = f"(SELECT id, lat0, lon0, lat1, lon1 FROM {V.sql('g_box')})"


def shapes(spark, sf):
    """Boxes with a notch from one side to the middle, as one ring."""
    b = V.view(spark, sf, "g_box")
    at = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    c = {k: F.col(k) for k in ("lat0", "lon0", "lat1", "lon1")}
    ring = F.array(at(c["lat0"], c["lon0"]), at(c["lat0"], c["lon1"]), at(c["lat1"], c["lon1"]), at((c["lat0"] + c["lat1"]) / 2, (c["lon0"] + c["lon1"]) / 2), at(c["lat1"], c["lon0"]), at(c["lat0"], c["lon0"]))
    return b.select("id", F.array(ring).alias("rings"))


_EDGES = f"""e AS (SELECT id, unnest([{{'y0': lat0, 'x0': lon0, 'y1': lat0, 'x1': lon1}}, {{'y0': lat0, 'x0': lon1, 'y1': lat1, 'x1': lon1}}, {{'y0': lat1, 'x0': lon1, 'y1': (lat0+lat1)/2, 'x1': (lon0+lon1)/2}}, {{'y0': (lat0+lat1)/2, 'x0': (lon0+lon1)/2, 'y1': lat1, 'x1': lon0}}, {{'y0': lat1, 'x0': lon0, 'y1': lat0, 'x1': lon0}}], recursive := true) FROM {_SHAPES})"""


@query(f"WITH {_EDGES} SELECT p.event_id AS place, e.id AS area FROM {V.sql('g_fix')} p JOIN e ON (y0 <= p.lat) <> (y1 <= p.lat) AND p.lon < x0 + (p.lat - y0)/(y1 - y0)*(x1 - x0) GROUP BY ALL HAVING count(*) % 2 = 1")
def j13_points_in_polygons(spark, sf):
    p = V.view(spark, sf, "g_fix").select(F.col("event_id").alias("place"), "lat", "lon")
    return A.points_in(p, shapes(spark, sf).withColumnRenamed("id", "area")).select("place", "area")


@query(f"""WITH {_EDGES}, c AS (SELECT id, sum((y0+y1)*(x0*y1-x1*y0))/(3*sum(x0*y1-x1*y0)) AS lat FROM e GROUP BY id), x AS (SELECT e.id, c.lat, x0 + (c.lat-y0)/(y1-y0)*(x1-x0) AS x FROM e JOIN c USING (id) WHERE (y0 <= c.lat) <> (y1 <= c.lat)),
r AS (SELECT *, lead(x) OVER w AS x2, row_number() OVER w AS n FROM x WINDOW w AS (PARTITION BY id ORDER BY x)) SELECT id, round(lat, 6) AS lat, round((x+x2)/2, 6) AS lon FROM r WHERE n % 2 = 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(x2-x, 9) DESC, n DESC) = 1""")
def g5_interior_points(spark, sf):
    s = shapes(spark, sf).select("id", A.interior_point(F.col("rings")).alias("p"))
    return s.select("id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query(f"SELECT DISTINCT a.id, b.id AS area FROM {V.sql('g_box')} a JOIN {V.sql('g_box')} b ON b.lat0 <= a.lat1 + 0.002 AND b.lat1 >= a.lat0 - 0.002 AND b.lon0 <= a.lon1 + 0.002 AND b.lon1 >= a.lon0 - 0.002")
def f6_j18_overlapping_sources(spark, sf):
    """Boxes met by the envelopes of polygons, with a pad of 0.002 degrees."""
    b = V.view(spark, sf, "g_box")
    return A.envelopes_meet(b, A.envelopes(shapes(spark, sf).withColumnRenamed("id", "area"), "area"), 0.002).select("id", "area")


@query(f"SELECT d AS depth, prefix FROM (SELECT DISTINCT 12 AS d, prefix >> 4 AS prefix FROM {TEXELS} WHERE cov > 60 UNION ALL SELECT DISTINCT 17, prefix * 64 + ((texel >> 8) & 1) * 32 + ((texel >> 16) & 1) * 16 + ((texel >> 7) & 1) * 8 + ((texel >> 15) & 1) * 4 + ((texel >> 6) & 1) * 2 + ((texel >> 14) & 1) FROM {TEXELS} WHERE cov > 60)")
def g21_shape_cells(spark, sf):
    """The cells of depths 12 and 17 that a shape drawn at depth 14 covers."""
    t = texels(spark, sf).where("cov > 60")
    return A.shape_cells(t, 14, 12).withColumn("depth", F.lit(12)).unionByName(A.shape_cells(t, 14, 17).withColumn("depth", F.lit(17))).select("depth", "prefix")


@query(f"SELECT depth, prefix FROM (SELECT DISTINCT 14 - k AS depth, prefix >> (2*k) AS prefix FROM {TEXELS}, range(15) r(k)) ORDER BY depth, prefix")
def u10_t8_cells_of_all_depths(spark, sf):
    return A.all_depths(texels(spark, sf).select("prefix").distinct(), 14).orderBy("depth", "prefix")


@query(f"SELECT prefix, texel, CASE WHEN texel % 3 = 0 THEN 255 WHEN texel % 3 = 1 THEN 0 ELSE cov END AS cov FROM {TEXELS}")
def u5_selection(spark, sf):
    """A selection with one set of texels added and another taken away."""
    t = texels(spark, sf).select("prefix", "texel", "cov")
    return A.select_texels(A.select_texels(t, t.where("texel % 3 = 0").select("prefix", "texel"), True), t.where("texel % 3 = 1").select("prefix", "texel"), False)


@query(f"""WITH t AS (SELECT prefix, texel, seq % 1000 AS name, mag FROM {TEXELS}), c AS (SELECT prefix, name, count(*) AS uses, max(name * 31 % 97) AS rank FROM t GROUP BY ALL) SELECT prefix, name, uses, rank FROM c QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY rank DESC, uses DESC, name) <= 20""")
def a21_name_cap(spark, sf):
    n = texels(spark, sf).select("prefix", (F.col("seq") % 1000).alias("name")).groupBy("prefix", "name").agg(F.count("*").alias("uses"), F.max(F.col("name") * 31 % 97).alias("rank"))
    return A.capped(n, ["prefix"], [F.desc("rank"), F.desc("uses"), F.col("name")], 20)


@query(f"""WITH n AS (SELECT depth, prefix, texel, concat('new ', seq % 7) AS name FROM {TEXELS} WHERE texel % 5 < 3), o AS (SELECT depth, prefix, texel, concat('old ', seq % 9) AS name FROM {TEXELS} WHERE texel % 4 < 3)
SELECT depth, prefix, texel, CASE WHEN n.name IS NOT NULL AND coalesce(texel % 2 = 0, false) THEN n.name ELSE o.name END AS name FROM n FULL JOIN o USING (depth, prefix, texel) WHERE CASE WHEN n.name IS NOT NULL AND texel % 2 = 0 THEN n.name ELSE o.name END IS NOT NULL""")
def u7_names_merged(spark, sf):
    from ..operators import merge as U

    t = texels(spark, sf)
    new = t.where("texel % 5 < 3").select("depth", "prefix", "texel", F.concat(F.lit("new "), F.col("seq") % 7).alias("name"))
    old = t.where("texel % 4 < 3").select("depth", "prefix", "texel", F.concat(F.lit("old "), F.col("seq") % 9).alias("name"))
    return U.names(new, old, lambda new: new.isNotNull() & (F.col("texel") % 2 == 0))


@query(f"""WITH u AS (SELECT depth, prefix, texel, CAST(1 + cov*2 % 255 AS INT) AS red, CAST(mag AS INT) AS nir, CASE WHEN prefix % 2 = 0 THEN 33 ELSE 18 END AS tone FROM {TEXELS}), f AS (SELECT *, (texel>>1)&255 AS tx, texel>>9 AS ty, texel&1 AS h FROM u),
p AS (SELECT *, prefix >> 2 AS pp, CASE WHEN tx%2=1 AND ty%2=1 THEN 1 WHEN tx%2=0 AND ty%2=0 THEN 0 ELSE h END AS ph FROM f), q AS (SELECT *, (((((prefix & 1) << 7) + (ty >> 1)) << 8) | (((prefix >> 1 & 1) << 7) + (tx >> 1))) * 2 + ph AS pt FROM p),
l AS (SELECT *, CASE tone WHEN 33 THEN atanh(least(pow((red+0.5)/256, 2), 0.999999)) ELSE 2*sin(asin(pow((red+0.5)/256, 2))/3)*2 END AS r, CASE tone WHEN 33 THEN atanh(least(pow((nir+0.5)/256, 2), 0.999999)) ELSE 2*sin(asin(pow((nir+0.5)/256, 2))/3)*2 END AS n FROM q)
SELECT depth - 1 AS depth, pp AS prefix, pt AS texel, CAST(coalesce(least(greatest(floor(sqrt(tanh(avg(r) FILTER (red > 0)))*256), 1), 255), 0) AS INT) AS red, CAST(coalesce(least(greatest(floor(sqrt(tanh(avg(n) FILTER (nir > 0)))*256), 1), 255), 0) AS INT) AS nir FROM l GROUP BY ALL""")
def a7_image_pyramid(spark, sf):
    from ..operators import pyramid as P

    t = texels(spark, sf).select("depth", "prefix", "texel", (1 + F.col("cov") * 2 % 255).cast("int").alias("red"), F.col("mag").cast("int").alias("nir"), F.when(F.col("prefix") % 2 == 0, 33).otherwise(18).alias("tone"))
    return P.images(t, ["red", "nir"])
