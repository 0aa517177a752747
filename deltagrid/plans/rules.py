"""Queries of the text and class functions, over tags and texts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import measure as M
from ..functions import text as T
from . import views as V

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pick(expr: str, values: list[str | None]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE ({expr}) % {len(values)} {cases} END"


#: key -> expression over part; the same for both engines.
TAGS = {
    "highway": pick("p_partkey", ["motorway", "trunk_link", "primary", "secondary", "tertiary", "living_street", "service", "track", "footway", "bridleway", "cycleway", "bus_stop", None]),
    "waterway": pick("p_partkey * 7", [None, "river", "dam", None, None]),
    "railway": pick("p_partkey * 3", [None, None, "rail", None, None, "tram", None]),
    "power": pick("p_partkey * 5", [None, "line", None, None]),
    "natural": pick("p_partkey * 11", [None, "cliff", "wood", "water", "scree", "ridge", "mud", "glacier"]),
    "landuse": pick("p_partkey * 13 + p_size", [None, "residential", "quarry", "forest", None, "farmyard", "vineyard", "basin", "military"]),
    "area": pick("p_partkey", [None, None, None, None, "no", None]),
    "boundary": pick("p_size", [None, "administrative", "national_park", "protected_area", None, "territorial"]),
    "admin_level": pick("p_partkey", ["2", "4", "5", "6", "x", None]),
    "maritime": pick("p_partkey * 3 + 1", [None, None, "yes"]),
    "protect_class": pick("p_partkey", ["1a", "2", "6", None, "5"]),
    "operator": pick("p_partkey * 3", [None, "US Forest Service", "County"]),
    "leisure": pick("p_partkey * 7 + 2", [None, "park", "nature_reserve", None]),
    "maxspeed": pick("p_partkey * 3 + p_size", ["50", "35 mph", "none", None, "80;60", "30 km/h", "400"]),
    "oneway": pick("p_partkey * 7 + 1", [None, "yes", "-1", "no", None]),
    "junction": pick("p_partkey * 3 + 2", [None, None, None, "roundabout"]),
    "layer": pick("p_partkey * 17", [None, "2", "-9", "x", None]),
    "bridge": pick("p_partkey * 5 + 1", [None, "yes", "no"]),
    "tunnel": pick("p_partkey * 5 + 2", [None, None, "culvert"]),
    "sac_scale": pick("p_partkey * 19", [None, "hiking", "alpine_hiking", "odd"]),
    "surface": pick("p_partkey * 23", [None, "gravel", "asphalt", "rock", "paved"]),
    "tracktype": pick("p_partkey * 29", [None, "grade1", "grade3", "grade5"]),
    "smoothness": pick("p_partkey * 31", [None, "bad", "horrible"]),
    "foot": pick("p_partkey * 37", [None, "no", "yes", None, "designated"]),
    "bicycle": pick("p_partkey * 41", [None, "private", "yes"]),
    "horse": pick("p_partkey * 43", [None, "no", "permissive"]),
    "motor_vehicle": pick("p_partkey * 47", [None, "no", "yes", None]),
    "access": pick("p_partkey * 53", [None, None, "private"]),
    "lanes": pick("p_partkey * 59", [None, "2", "4;3", "12", "x"]),
    "voltage": pick("p_partkey * 61", [None, "110000;20000", "x", "400"]),
    "usage": pick("p_partkey * 67", [None, "main", "branch", "tourism"]),
}
FLAT = f"(SELECT p_partkey AS id, {', '.join(f'{e} AS {chr(34)}{k}{chr(34)}' for k, e in TAGS.items())} FROM part)"


def tagged(spark, sf):
    """part as (id, tags): a map without the absent keys."""
    p = spark.read.parquet(f"{sf}/part.parquet").selectExpr("p_partkey AS id", *(f"{e} AS `{k}`" for k, e in TAGS.items()))
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"`{k}`").alias("v")) for k in TAGS]), lambda e: e["v"].isNotNull())
    return p.select("id", F.map_from_entries(entries).alias("tags"))


def _case(col: str, table: dict[int, str]) -> str:
    return "CASE " + " ".join(f"WHEN {col} IN ({', '.join(repr(n) for n in names.split())}) THEN {k}" for k, names in table.items()) + " END"


BORDER = "CASE WHEN boundary = 'territorial' OR (boundary = 'administrative' AND admin_level IN ('2','4','6') AND coalesce(maritime,'no') <> 'yes') THEN 17 END"
WAY = "coalesce(" + ", ".join(_case(f'"{k}"' if k in TAGS else "NULL", t) for k, t in K.WAYS if k in TAGS) + f", {BORDER})"
CLASSED = f"(SELECT *, {WAY} AS cls FROM {FLAT})"


@query(f"SELECT id, cls FROM {CLASSED}")
def p1_p2_p4_way_class(spark, sf):
    return tagged(spark, sf).select("id", K.way_class(F.col("tags")).alias("cls"))


@query(f"""SELECT id, CASE boundary WHEN 'national_park' THEN 13 WHEN 'protected_area' THEN CASE WHEN protect_class IN ('1','1a','1b') THEN 14 WHEN protect_class='2' THEN 13 WHEN protect_class='6' OR lower(operator) LIKE '%forest service%' THEN 15 ELSE 16 END
 WHEN 'administrative' THEN CASE WHEN admin_level IN ('2','4','6') THEN 17 END ELSE CASE WHEN leisure='nature_reserve' THEN 16 END END AS cls FROM {FLAT}""")
def p3_boundary_class(spark, sf):
    return tagged(spark, sf).select("id", K.boundary_class(F.col("tags")).alias("cls"))


@query(f"""SELECT id, CASE WHEN coalesce(area,'') <> 'no' THEN greatest({', '.join(f"CASE WHEN {chr(34)}{k}{chr(34)} IN ({', '.join(repr(n) for n in names.split())}) THEN {c} END" for c, keys in K.AREAS.items() for k, names in keys.items())}) END AS cls FROM {FLAT}""")
def p5_area_class(spark, sf):
    return tagged(spark, sf).select("id", K.area_class(F.col("tags")).alias("cls"))


@query(f"""SELECT id, round(CASE WHEN cls=12 THEN 1.5+18*pow(w,3) ELSE CASE cls {' '.join(f'WHEN {k} THEN {v[1]}' for k, v in K.LINES.items() if v[1] is not None)} END END, 6) AS width,
CASE WHEN cls=12 THEN CAST(trunc(120+135*w) AS INT) ELSE 255 END AS cov, 1 + CAST(trunc(w*254) AS INT) AS mag FROM (SELECT id, cls, CAST(id % 11 AS DOUBLE)/10 AS w FROM {CLASSED}) WHERE cls IS NOT NULL""")
def p8_stamp(spark, sf):
    c = tagged(spark, sf).select("id", K.way_class(F.col("tags")).alias("cls"), ((F.col("id") % 11).cast("double") / 10).alias("w")).where("cls IS NOT NULL")
    return c.select("id", F.round(K.width_m(F.col("cls"), F.col("w")), 6).alias("width"), K.cov_max(F.col("cls"), F.col("w")).alias("cov"), K.mag_byte(F.col("w")).alias("mag"))


_NO, _YES = "('no','private','discouraged')", "('yes','designated','permissive','official')"


@query(f"""WITH e AS (SELECT id, cls, CASE cls {' '.join(f'WHEN {k} THEN {v[2]}' for k, v in K.LINES.items())} END AS own,
 coalesce(foot IN {_YES}, false) AS f1, coalesce(foot IN {_NO}, false) AS f0, coalesce(bicycle IN {_YES}, false) OR coalesce(highway='cycleway', false) AS b1, coalesce(bicycle IN {_NO}, false) OR coalesce(highway IN ('footway','steps'), false) AS b0,
 coalesce(horse IN {_YES}, false) OR coalesce(highway='bridleway', false) AS h1, coalesce(horse IN {_NO}, false) AS h0, coalesce(motor_vehicle IN {_NO}, false) AS m0,
 coalesce(surface IN ('gravel','rock'), false) OR coalesce(tracktype <> 'grade1', false) AS u1, coalesce(surface IN ('asphalt','paved'), false) AS u0, coalesce(access IN {_NO}, false) AS r1, usage, voltage, lanes FROM {CLASSED} WHERE cls IS NOT NULL),
m AS (SELECT *, CASE WHEN cls=11 AND voltage IS NOT NULL AND voltage <> 'x' THEN least(greatest((log10(CASE voltage WHEN '400' THEN 400.0 ELSE 110000.0 END)-2.6)/3.3, 0), 1) WHEN cls=11 THEN 0.3 WHEN cls=10 AND usage IS NOT NULL THEN CASE usage WHEN 'main' THEN 1.0 WHEN 'branch' THEN 0.6 ELSE 0.3 END ELSE CASE cls {' '.join(f'WHEN {k} THEN {v[3]}' for k, v in K.LINES.items())} END END AS mg, CASE lanes WHEN '2' THEN 2.0 WHEN '4;3' THEN 4.0 WHEN '12' THEN 12.0 END AS ln FROM e)
SELECT id, CAST((own & ~(CASE WHEN f0 AND NOT f1 THEN 1 ELSE 0 END | CASE WHEN b0 AND NOT b1 THEN 2 ELSE 0 END | CASE WHEN h0 AND NOT h1 THEN 4 ELSE 0 END | CASE WHEN m0 THEN 16 ELSE 0 END | CASE WHEN u0 AND NOT u1 THEN 32 ELSE 0 END)) | CASE WHEN f1 THEN 1 ELSE 0 END | CASE WHEN b1 THEN 2 ELSE 0 END | CASE WHEN h1 THEN 4 ELSE 0 END | CASE WHEN u1 THEN 32 ELSE 0 END | CASE WHEN r1 THEN 128 ELSE 0 END AS INT) AS uses,
round(CAST(CASE WHEN ln IS NOT NULL AND cls NOT IN (10,11,12) THEN least(greatest(mg*0.6+log2(least(ln,8))/3*0.4, 0), 1) ELSE mg END AS DOUBLE), 6) AS mag FROM m""")
def p9_uses_and_magnitude(spark, sf):
    c = tagged(spark, sf).select("id", "tags", K.way_class(F.col("tags")).alias("cls")).where("cls IS NOT NULL")
    return c.select("id", K.uses(F.col("cls"), F.col("tags")).cast("int").alias("uses"), F.round(K.magnitude(F.col("cls"), F.col("tags")), 6).alias("mag"))


@query(f"""SELECT id, CAST(CASE maxspeed WHEN '50' THEN 50 WHEN '35 mph' THEN 56 WHEN 'none' THEN 0 WHEN '80;60' THEN 80 WHEN '30 km/h' THEN 30 WHEN '400' THEN 255 ELSE CASE WHEN cls=18 THEN 20 ELSE 0 END END AS INT) AS speed,
 greatest(CASE WHEN oneway IS NULL THEN CASE WHEN cls=1 THEN 1 ELSE 0 END WHEN oneway='yes' THEN 1 WHEN oneway='-1' THEN -1 ELSE 0 END, CASE WHEN junction='roundabout' THEN 1 ELSE -1 END) AS oneway,
 CASE layer WHEN '2' THEN 2 WHEN '-9' THEN -5 ELSE CASE WHEN coalesce(bridge,'no') <> 'no' THEN 1 WHEN tunnel IS NOT NULL THEN -1 ELSE 0 END END AS layer,
 CASE sac_scale WHEN 'hiking' THEN 1 WHEN 'alpine_hiking' THEN 4 ELSE 0 END AS difficulty,
 greatest(CASE surface WHEN 'gravel' THEN 1 WHEN 'rock' THEN 2 ELSE 0 END, CASE tracktype WHEN 'grade3' THEN 2 WHEN 'grade5' THEN 3 ELSE 0 END, CASE smoothness WHEN 'bad' THEN 1 WHEN 'horrible' THEN 3 ELSE 0 END) AS rough, cls <= 9 OR cls = 18 AS routable FROM {CLASSED} WHERE cls IS NOT NULL""")
def p10_p11_travel(spark, sf):
    c = tagged(spark, sf).select("id", "tags", K.way_class(F.col("tags")).alias("cls")).where("cls IS NOT NULL").withColumn("t", K.travel(F.col("cls"), F.col("tags")))
    return c.select("id", F.col("t.speed_kmh").alias("speed"), "t.oneway", "t.layer", "t.difficulty", "t.rough", K.routable(F.col("cls")).alias("routable"))


_MAN = pick("s_suppkey", [*K.OWNERS, "Nobody", None])
_TYP = pick("s_suppkey * 7", [*K.OWNER_TYPES, "Unknown"])


@query(f"""SELECT id, coalesce(CASE m {' '.join(f"WHEN '{k}' THEN {v}" for k, v in K.OWNERS.items())} END, CASE t {' '.join(f"WHEN '{k}' THEN {v}" for k, v in K.OWNER_TYPES.items())} END, 12) AS owner FROM (SELECT s_suppkey AS id, {_MAN} AS m, {_TYP} AS t FROM supplier)""")
def p14_owner(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS id", f"{_MAN} AS m", f"{_TYP} AS t")
    return s.select("id", K.owner_class(F.col("m"), F.col("t")).alias("owner"))


_SYM = pick("s_suppkey", ["Roads open to highway legal vehicles", "Roads Open to All Vehicles, Yearlong", "Trails open to all vehicles, seasonal", "Trails open to motorcycles only", "Trails 50\" or less", "Special Designation, seasonal", "Other"])
_KIND, _SEAS = pick("s_suppkey * 3", ["road", "trail"]), pick("s_suppkey * 5", ["Seasonal", "yearlong", ""])


@query(f"""SELECT id, CASE WHEN lower(s) LIKE '%special designation%' THEN 13 WHEN lower(s) LIKE 'roads open to highway legal%' THEN 1 WHEN lower(s) LIKE 'roads open to all%' THEN 3 WHEN lower(s) LIKE 'trails open to all%' THEN 5 WHEN lower(s) LIKE '%motorcycle%' THEN 9 WHEN lower(s) LIKE '%50" or less%' THEN 7 WHEN k='road' THEN 3 ELSE 11 END + CASE WHEN lower(s) LIKE '%seasonal%' OR lower(e)='seasonal' THEN 1 ELSE 0 END AS cls
FROM (SELECT s_suppkey AS id, {_SYM} AS s, {_KIND} AS k, {_SEAS} AS e FROM supplier)""")
def p15_motor_use(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").selectExpr("s_suppkey AS id", f"{_SYM} AS s", f"{_KIND} AS k", f"{_SEAS} AS e")
    return s.select("id", K.motor_use_class(F.col("s"), F.col("k"), F.col("e")).alias("cls"))


@query(f"SELECT id, CASE p_size % 12 {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(K.LAND_COVER.values()))} END AS land, CASE p_size % 12 WHEN 7 THEN true ELSE false END AS water FROM (SELECT p_partkey AS id, p_size FROM part)")
def p16_land_cover(spark, sf):
    codes = F.array(*map(F.lit, K.LAND_COVER))
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.get(codes, F.col("p_size") % 12).alias("b"))
    land = K.lookup(F.col("b"), K.LAND_COVER)
    return p.select("id", land.alias("land"), F.coalesce(land == 13, F.lit(False)).alias("water"))


@query("SELECT p_partkey AS id, round(least(greatest((log10(greatest(p_retailprice - 1000, 0.01)) + 2)/6, 0), 1), 6) AS weight, least(greatest(CAST(trunc((p_retailprice - 12000 + 11000)*2) AS INT), 0), 65534) AS q FROM part")
def p17_p23_weight_and_quantum(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), F.round(M.river_weight(F.col("p_retailprice") - 1000), 6).alias("weight"), M.quantize_elevation(F.col("p_retailprice") - 12000).alias("q"))


@query(f"""WITH w AS (SELECT *, CAST(grade AS INT) & 15 AS d, least(CAST(grade AS INT) >> 4, 3) AS r FROM {V.sql('g_way')}) SELECT way,
round((CASE WHEN uses & 16 <> 0 THEN (CASE WHEN speed_kmh > 0 THEN speed_kmh ELSE CASE class WHEN 1 THEN 105 WHEN 3 THEN 70 WHEN 5 THEN 50 ELSE 20 END END)::DOUBLE*CASE WHEN uses & 32 <> 0 THEN 0.6e0 ELSE 1e0 END*CASE WHEN uses & 128 <> 0 THEN 0.2e0 ELSE 1e0 END*[1.0e0,0.8e0,0.5e0,0.15e0][r+1] END)/3.6e0, 6)::DOUBLE AS car,
round((CASE WHEN uses & 2 <> 0 AND d < 4 THEN CASE WHEN d=3 THEN 5 ELSE CASE WHEN uses & 32 <> 0 OR class >= 8 THEN 12e0 ELSE 18e0 END*[1.0e0,0.9e0,0.6e0,0.4e0][r+1] END END)/3.6e0, 6)::DOUBLE AS bike, round(CASE WHEN uses & 1 <> 0 THEN [4.8e0,4.8e0,4.0e0,3.0e0,2.0e0,1.5e0,1.0e0][least(d,6)+1] END/3.6e0, 6)::DOUBLE AS foot, CASE class WHEN 1 THEN 8 WHEN 3 THEN 8 WHEN 5 THEN 10 WHEN 7 THEN 13 WHEN 9 THEN 11 ELSE 14 END AS floor FROM w""")
def p18_p20_speed(spark, sf):
    w = V.view(spark, sf, "g_way").withColumn("grade", F.col("grade").cast("int"))
    c = [F.col(x) for x in ("class", "uses", "speed_kmh", "grade")]
    return w.select("way", *(F.round(K.travel_speed(m, *c), 6).alias(m) for m in ("car", "bike", "foot")), K.class_floor(F.col("class")).alias("floor"))


@query(f"SELECT id, class, mag, CASE class WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 6 WHEN 5 THEN 7 WHEN 6 THEN 9 END AS shown, CASE WHEN mag >= 200 THEN 0 WHEN mag >= 128 THEN 3 WHEN mag >= 64 THEN 6 ELSE 8 END AS river FROM {V.sql('g_globe')}")
def p21_min_depth(spark, sf):
    g = V.view(spark, sf, "g_globe")
    return g.select("id", "class", "mag", K.line_min_depth(F.col("class"), F.col("mag")).alias("shown"), K.line_min_depth(F.lit(12), F.col("mag")).alias("river"))


_DIR = " ".join(f"WHEN '{x}' THEN '{v}'" for x, v in ({v: v for v in T.DIRECTIONS.values()} | T.DIRECTIONS).items())
_TYPE = " ".join(f"WHEN '{x}' THEN '{v}'" for x, v in ({v: v for v in T.TYPES.values()} | T.TYPES).items())
_WORDS = "list_filter(string_split(regexp_replace(upper(street), '[^\\p{L}\\p{N}]', ' ', 'g'), ' '), lambda x: x <> '')"
NORMAL = f"""SELECT *, [coalesce(CASE WHEN i=1 OR i=len(w) THEN CASE w[i] {_DIR} END END, CASE WHEN i=len(w) AND len(w) > 1 THEN CASE w[i] {_TYPE} END END, w[i]) for i in range(1, len(w)+1)] AS n FROM (SELECT *, {_WORDS} AS w FROM {V.sql('g_addr')})"""
_DS, _TS = ", ".join(f"'{v}'" for v in T.DIRECTIONS.values()), ", ".join(f"'{v}'" for v in dict.fromkeys(T.TYPES.values()))


@query(f"""WITH n AS ({NORMAL}), a AS (SELECT *, CASE WHEN len(n) > 1 AND n[1] IN ({_DS}) THEN n[2:] ELSE n END AS b1 FROM n), b AS (SELECT *, CASE WHEN len(b1) > 1 AND b1[-1] IN ({_DS}) THEN b1[:-2] ELSE b1 END AS b2 FROM a)
SELECT id, array_to_string(n, ' ') AS normal, array_to_string(CASE WHEN len(b2) > 1 AND b2[-1] IN ({_TS}) THEN b2[:-2] ELSE b2 END, ' ') AS base FROM b""")
def x1_x2_street(spark, sf):
    return V.view(spark, sf, "g_addr").select("id", T.street_normal(F.col("street")).alias("normal"), T.street_base(F.col("street")).alias("base"))


@query(f"SELECT id, CAST(number AS INT) AS number, array_to_string(list_filter(string_split(street, ' '), lambda x: x <> ''), ' ') AS street, CASE WHEN id % 3 = 0 THEN CAST(zip AS INT) END AS zip FROM {V.sql('g_addr')} WHERE id % 4 <> 3")
def x3_x4_typed(spark, sf):
    a = V.view(spark, sf, "g_addr")
    typed = F.when(F.col("id") % 4 == 3, F.concat(F.lit("1.5 "), F.col("street"))).otherwise(F.concat(F.col("number"), F.lit(" "), F.col("street"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(", "), F.col("zip"), F.lit("-1234"))).otherwise("")))
    return a.select("id", T.typed_address(typed).alias("t")).where("t IS NOT NULL").select("id", "t.number", "t.street", "t.zip")


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 4392.0 WHEN 1 THEN 14411*0.3048 WHEN 2 THEN 10*0.3048 WHEN 3 THEN 120.0 END AS ele, CASE c_custkey % 3 WHEN 0 THEN 1234567 WHEN 1 THEN 12000 END AS pop, CASE c_custkey % 2 WHEN 0 THEN 110000.0 END AS volts FROM customer")
def x9_x11_numbers(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS id", f"""{pick('c_custkey', ['4392', '14,411 ft', '10', '120 m', 'high'])} AS e""", f"{pick('c_custkey', ['1,234,567', '12 000', 'many'])} AS p", f"{pick('c_custkey', ['20000; 110000', 'x'])} AS v")
    e = F.when(F.col("e") == "10", F.lit("10'")).otherwise(F.col("e"))
    return c.select("id", T.elevation_m(e).alias("ele"), T.population(F.col("p")).alias("pop"), T.max_number(F.col("v")).alias("volts"))


@query(f"""SELECT id, CASE WHEN lower(name)='build' THEN 0 WHEN strpos(lower(name), 'build')=1 THEN 1 WHEN strpos(lower(name), 'build') > 1 AND NOT regexp_matches(substr(lower(name), strpos(lower(name),'build')-1, 1), '[\\p{{L}}\\p{{N}}]') THEN 2 WHEN strpos(lower(name),'build') > 1 THEN 3 END AS a,
CASE WHEN strpos(lower(name), '0000') = 1 THEN 1 WHEN strpos(lower(name), '0000') > 1 AND NOT regexp_matches(substr(lower(name), strpos(lower(name),'0000')-1, 1), '[\\p{{L}}\\p{{N}}]') THEN 2 WHEN strpos(lower(name),'0000') > 1 THEN 3 END AS b,
CASE id % 6 WHEN 0 THEN 'SR 20' WHEN 1 THEN 'SR 20 North' WHEN 2 THEN 'Oak (SR 20)' WHEN 3 THEN '165A Seneca St' WHEN 4 THEN 'K2' WHEN 5 THEN '' END AS label FROM {V.sql('g_place')}""")
def f10_p13_fit_and_label(spark, sf):
    p = V.view(spark, sf, "g_place")
    case = lambda *v: F.get(F.array(*map(F.lit, v)), (F.col("id") % 6).cast("int"))
    label = T.label(case(68, 3, 3, 77, 68, 3), case("", "SR 20 North", "Oak", "Seneca St", "K2", ""), case("SR 20", "SR 20", "SR 20", "165A", "8611", ""))
    return p.select("id", T.fit(F.lit("Build"), F.col("name")).alias("a"), T.fit(F.lit("0000"), F.col("name")).alias("b"), label.alias("label"))


@query("""SELECT o_orderkey AS id, CASE WHEN m < 100 THEN concat(CAST(round(m/10)*10 AS INT), ' m') WHEN m < 1000 THEN concat(CAST(round(m/50)*50 AS INT), ' m') ELSE printf('%.1f km', m/1000) END AS length, CASE WHEN round(s/60) < 60 THEN concat(CAST(round(s/60) AS INT), ' min') ELSE printf('%d h %02d min', CAST(round(s/60) AS INT) // 60, CAST(round(s/60) AS INT) % 60) END AS time, substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 32) AS hash,
CASE o_orderkey % 6 WHEN 0 THEN [0, 2, 7] WHEN 1 THEN [0, 216, 1] WHEN 2 THEN [10, 0, 0] END::BIGINT[] AS version
FROM (SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN 1000 + o_orderkey % 9000 ELSE o_orderkey * 7 % 900000 + 10000 END AS DOUBLE) AS m, (o_orderkey % 20000) * 1e0 AS s FROM orders)""")
def x13_x16_texts(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    m = F.when(F.col("id") % 3 == 0, F.col("id") % 1000).when(F.col("id") % 3 == 1, 1000 + F.col("id") % 9000).otherwise(F.col("id") * 7 % 900000 + 10000).cast("double")
    v = T.version(F.get(F.array(*map(F.lit, ("0.2.7", "0.216.1+457980b", "10.0.0", "1.2", "v1.2.3", "1.2.3.4"))), (F.col("id") % 6).cast("int")))
    return o.select("id", T.rounded_length(m).alias("length"), T.duration((F.col("id") % 20000).cast("double")).alias("time"), T.short_hash(F.col("id").cast("string")).alias("hash"), F.when(v.isNotNull(), F.array(v["major"], v["minor"], v["patch"])).alias("version"))


@query(f"""WITH p AS (SELECT event_id, lat, lon, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM {V.sql('g_fix')} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), q AS (SELECT *, (lon1-lon)*cos(radians((lat+lat1)/2)) AS dx, lat1-lat AS dy FROM p WHERE lat1 IS NOT NULL)
SELECT event_id, round(2*6371*asin(least(sqrt(pow(sin(radians(lat1-lat)/2),2)+cos(radians(lat))*cos(radians(lat1))*pow(sin(radians(lon1-lon)/2),2)),1)), 6) AS km, round(sqrt(dx*dx+dy*dy)*111320, 3) AS flat_m, round(CASE WHEN degrees(atan2(dx,dy)) < 0 THEN degrees(atan2(dx,dy))+360 ELSE degrees(atan2(dx,dy)) END, 5) AS bearing FROM q""")
def g1_g2_g13_distances(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = V.view(spark, sf, "g_fix").withColumns({"lat1": F.lead("lat").over(w), "lon1": F.lead("lon").over(w)}).where("lat1 IS NOT NULL")
    c = [F.col(x) for x in ("lat", "lon", "lat1", "lon1")]
    return p.select("event_id", F.round(M.haversine_km(*c), 6).alias("km"), F.round(M.flat_m(*c), 3).alias("flat_m"), F.round(M.bearing(*c), 5).alias("bearing"))
