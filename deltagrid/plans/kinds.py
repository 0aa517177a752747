"""Queries of names, kinds, travel rules, tones and views; expected values in the SQL are written out, not taken from the tables under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import tone as T
from ..functions import view as W
from . import views as V

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: (tags, expected) of small cases; each row of a table takes one by its key.
OUTLINE = [({"place": "island"}, 78), ({"place": "islet", "shop": "shoes"}, 79), ({"natural": "peninsula"}, 83), ({"place": "locality"}, 85), ({"building": "yes", "amenity": "cafe"}, 95), ({"shop": "deli"}, 100), ({"place": "city"}, None), ({"office": "x"}, 111)]
NAMES = [
    ({"name": "Oak", "ref": "5"}, "Oak", "5"),
    ({"highway": "motorway_link", "destination": "Everett; Vancouver BC;"}, "toward Everett, Vancouver BC", ""),
    ({"highway": "trunk_link", "destination:ref": "I 5 North;US 2"}, "", "I 5 North, US 2"),
    ({"highway": "trunk_link", "name": "Ramp", "destination": "X"}, "Ramp", ""),
    ({"highway": "primary", "destination": "X"}, "", ""),
    ({"highway": "motorway_link", "ref": "7", "destination:ref": "8", "destination": "Y"}, "toward Y", "7"),
]
BUSINESS = [({"name": "Corner", "brand": "Star"}, "Corner", "Star"), ({"brand": "Star"}, "Star", ""), ({"name": "Star Cafe", "brand": "Star"}, "Star Cafe", ""), ({"name": "Solo"}, "Solo", "")]
LABELS = [(68, "Baker", "8611", "Baker", "8611"), (77, "", "165A", "", "165A"), (77, "", "", None, None), (86, "", "", "", "Drinking water"), (93, "", "x", "", "Gate"), (75, "", "3", None, None), (94, "Deep", "", "Deep", "")]
LINES = [({"footway": "sidewalk"}, [1, 2, 3, 1], 1, 0, 1), ({"footway": "crossing"}, [1, 2, 1], 1, 0, 0), ({"natural": "coastline"}, [1, 2, 3, 4], 0, 1, 0), ({"maritime": "yes", "footway": "x"}, [4, 5, 6, 7, 4], 0, 1, 1), ({}, [], 0, 0, 0)]


def _pick(values, kind):
    return F.from_json(F.get(F.array(*[F.lit(v) for v in values]), (F.col("id") % len(values)).cast("int")), kind)


def _tags(cases, at=0):
    import json

    return _pick([json.dumps(c[at]) for c in cases], "map<string,string>")


def _case(cases, at):
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"CASE id % {len(cases)} " + " ".join(f"WHEN {i} THEN {text(c[at])}" for i, c in enumerate(cases)) + " END"


_PART = "(SELECT p_partkey AS id, * FROM part)"


def part(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").withColumn("id", F.col("p_partkey"))


@query(f"SELECT id, {_case(OUTLINE, 1)} AS kind, id % 100 IN (77, 86, 87, 88, 89, 90, 91, 92, 93, 94) AS marked FROM {_PART}")
def p6_outline_kind(spark, sf):
    return part(spark, sf).select("id", K.outline_kind(_tags(OUTLINE)).alias("kind"), K.marks_unnamed(F.col("id") % 100).alias("marked"))


@query(f"SELECT id, {_case(NAMES, 1)} AS name, {_case(NAMES, 2)} AS reference, {_case(BUSINESS, 1)} AS business, {_case(BUSINESS, 2)} AS brand FROM {_PART}")
def p12_feature_names(spark, sf):
    p = part(spark, sf).select("id", K.feature_names(_tags(NAMES)).alias("n"), K.business_names(_tags(BUSINESS)).alias("b"))
    return p.select("id", "n.name", "n.reference", F.col("b.name").alias("business"), F.col("b.reference").alias("brand"))


@query(f"SELECT id, {_case(LABELS, 3)} AS name, {_case(LABELS, 4)} AS reference FROM {_PART} WHERE {_case(LABELS, 3)} IS NOT NULL")
def f4_point_label(spark, sf):
    at = lambda k: F.get(F.array(*[F.lit(c[k]) for c in LABELS]), (F.col("id") % len(LABELS)).cast("int"))
    return part(spark, sf).select("id", K.point_label(at(0), at(1), at(2)).alias("l")).where("l IS NOT NULL").select("id", "l.name", "l.reference")


@query(f"SELECT id, {_case(LINES, 2)} AS furniture, {_case(LINES, 3)} AS seaward, {_case(LINES, 4)} AS closed FROM {_PART}")
def f1_f2_f3_left_out(spark, sf):
    import json

    refs = _pick([json.dumps(c[1]) for c in LINES], "array<bigint>")
    p = part(spark, sf).select("id", _tags(LINES).alias("t"), refs.alias("r"))
    return p.select("id", K.furniture(F.col("t")).cast("int").alias("furniture"), K.seaward(F.col("t")).cast("int").alias("seaward"), F.coalesce(K.closed(F.col("r")), F.lit(False)).cast("int").alias("closed"))


@query(f"SELECT id, CASE id % 3 WHEN 0 THEN 130/3.6e0 WHEN 1 THEN 30/3.6e0 ELSE 6/3.6e0 END AS top, CASE id % 3 WHEN 0 THEN 4e0 WHEN 1 THEN 2e0 ELSE 0e0 END AS turn, id % 3 < 2 AS keeps, id % 3 < 2 AND (id % 5 - 2)*cos(id/100e0) + (id % 7 - 3)*sin(id/100e0) <= -0.05 AS refused FROM {_PART}")
def p19_f15_travel_rules(spark, sf):
    mode = F.get(F.array(*map(F.lit, ("car", "bike", "foot"))), (F.col("id") % 3).cast("int"))
    refused = K.keeps_one_ways(mode) & K.against_one_way(F.col("id") % 5 - 2, F.col("id") % 7 - 3, F.col("id") / 100)
    return part(spark, sf).select("id", K.top_speed(mode).alias("top"), K.turn_seconds(mode).alias("turn"), K.keeps_one_ways(mode).alias("keeps"), refused.alias("refused"))


@query("""SELECT id, kind, CASE WHEN kind = 11 THEN NULL WHEN kind IN (64, 65) THEN 0 WHEN kind IN (68, 69) THEN 1 WHEN kind IN (44, 78, 80, 81, 82) THEN 2 WHEN kind BETWEEN 1 AND 3 THEN 3 WHEN kind = 12 THEN 4 WHEN kind IN (66, 67, 84) THEN 5 WHEN kind IN (4, 5, 8, 9, 18, 20) OR kind BETWEEN 13 AND 17 THEN 6 WHEN kind IN (6, 7, 10, 77) THEN 7 WHEN kind IN (19, 21, 79, 83, 85) THEN 8 WHEN kind >= 95 THEN 20 WHEN kind >= 64 THEN 9 WHEN kind >= 32 THEN 8 ELSE 7 END AS tier,
CASE WHEN kind BETWEEN 64 AND 67 THEN 0 WHEN kind IN (68, 69) THEN 1 WHEN kind = 12 THEN 2 WHEN kind = 44 THEN 3 END AS grp, CAST(floor(least(kind/100e0, 1)*9 + 0.5) AS INT) AS lim FROM (SELECT p_partkey AS id, CAST(p_partkey % 111 + 1 AS INT) AS kind FROM part)""")
def p22_tiers(spark, sf):
    k = part(spark, sf).select("id", (F.col("id") % 111 + 1).cast("int").alias("kind"))
    return k.select("id", "kind", K.tier(F.col("kind")).alias("tier"), K.rank_group(F.col("kind")).alias("grp"), K.tier_limit(F.col("kind") / 100).alias("lim"))


_LIGHT = "CASE WHEN t >> 4 = 1 THEN 2*sin(asin(pow((b+0.5)/256, 2))/3)*greatest(t & 15, 1) WHEN t >> 4 = 2 THEN atanh(least(pow((b+0.5)/256, 2), 0.999999))*greatest(t & 15, 1) ELSE pow((b+0.5)/256, 2) END"


@query(f"""WITH g AS (SELECT id, CAST(([0, 17, 18, 33, 36])[CAST(id // 256 % 5 + 1 AS INT)] AS INT) AS t, CAST(id % 256 AS INT) AS b FROM (SELECT p_partkey AS id FROM part)), l AS (SELECT *, {_LIGHT} AS light FROM g)
SELECT id, t, b, round(light, 9) AS light, CASE WHEN b = 0 THEN 0 ELSE b END AS back, CASE WHEN b = 0 THEN 0 WHEN t = 33 THEN b ELSE CAST(least(greatest(floor(sqrt(tanh(light))*256), 1), 255) AS INT) END AS retoned FROM l""")
def p24_tones(spark, sf):
    """The light of a byte under one of five tones; a byte comes back from its light; and it in the tone of imagery."""
    g = part(spark, sf).select("id", (F.col("id") % 256).cast("int").alias("b"), F.get(F.array(*map(F.lit, (0, 17, 18, 33, 36))), (F.floor(F.col("id") / 256) % 5).cast("int")).alias("t"))
    light = T.unroll(F.col("t"), F.col("b"))
    return g.select("id", "t", "b", F.round(light, 9).alias("light"), F.when(F.col("b") == 0, 0).otherwise(T.roll(F.col("t"), light)).alias("back"), T.retone(F.col("b"), F.col("t"), F.lit(T.IMAGERY)).alias("retoned"))


@query(f"""WITH v AS (SELECT event_id, user_id, pow(2.0, 4 + (event_id * 7 % 90)/10e0) AS ppd, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM {V.sql('g_fix')}),
r AS (SELECT *, ppd * 7054000e0/(111320e0*256e0) AS k FROM v) SELECT event_id, CAST(least(greatest(ceil(log2(k)), 0), 14) AS INT) AS fresh, CASE WHEN k/pow(2.0, 9) BETWEEN 0.45 AND 1.05 THEN 9 ELSE CAST(least(greatest(ceil(log2(k)), 0), 14) AS INT) END AS held, round(k/pow(2.0, 9), 6) AS px FROM r""")
def v1_f14_select_depth(spark, sf):
    ppd = F.pow(F.lit(2.0), 4 + (F.col("event_id") * 7 % 90) / 10)
    f = V.view(spark, sf, "g_fix").select("event_id", ppd.alias("ppd"))
    return f.select("event_id", W.select_depth(F.col("ppd"), F.lit(40), F.lit(14)).alias("fresh"), W.select_depth(F.col("ppd"), F.lit(9), F.lit(14)).alias("held"), F.round(W.texel_px(F.col("ppd"), F.lit(9)), 6).alias("px"))


@query(f"""WITH RECURSIVE v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, pow(2.0, 4 + (event_id * 7 % 90)/10e0)*7054000e0/(111320e0*256e0) AS k FROM {V.sql('g_fix')}), s AS (SELECT user_id, 0::BIGINT AS n, 9 AS depth FROM v WHERE n = 1 UNION ALL SELECT v.user_id, v.n, CASE WHEN k/pow(2.0, s.depth) BETWEEN 0.45 AND 1.05 THEN s.depth ELSE CAST(least(greatest(ceil(log2(k)), 0), 14) AS INT) END FROM s JOIN v ON v.user_id = s.user_id AND v.n = s.n + 1)
SELECT user_id, list(depth ORDER BY n) AS depths FROM s WHERE n > 0 GROUP BY user_id""")
def m6_held_depths(spark, sf):
    ppd = F.pow(F.lit(2.0), 4 + (F.col("event_id") * 7 % 90) / 10)
    views = V.view(spark, sf, "g_fix").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", ppd.alias("p")))), lambda x: x["p"]).alias("views"))
    return views.select("user_id", W.depths(F.col("views"), F.lit(9), F.lit(14)).alias("depths"))


@query(f"SELECT id, CASE WHEN lat1 >= lat0 + id % 3 - 1 THEN greatest((lat1 - lat0 - id % 3 + 1)*1000*0.25/6, 0.5) ELSE 0 END AS metres FROM {V.sql('g_box')}")
def v3_contour_interval(spark, sf):
    b = V.view(spark, sf, "g_box")
    return b.select("id", W.contour_interval((F.col("lat0") + F.col("id") % 3 - 1) * 1000, F.col("lat1") * 1000, F.lit(6)).alias("metres"))


@query(f"SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('milliseconds', ts) AS back FROM {V.sql('g_fix')}")
def x17_unix_time(spark, sf):
    from ..functions import text as X

    f = V.view(spark, sf, "g_fix").withColumn("ts", F.col("ts").cast("timestamp"))
    return f.select("event_id", X.unix_ms(F.col("ts")).alias("ms"), X.from_unix_ms(X.unix_ms(F.col("ts"))).alias("back"))
