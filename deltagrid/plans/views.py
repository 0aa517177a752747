"""Geo views of the driver's tables: the same arithmetic as Spark expressions and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import cells

D = "CAST({} AS DOUBLE)".format

#: view -> (table, {column: expression}, filter); every expression means the same to Spark and to the oracle's engine.
VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "g_fix": ("events", {"event_id": "event_id", "user_id": "user_id", "ts": "ts", "lat": f"46 + {D('(user_id*37) % 100')}/100 + {D('(event_id*101) % 1000')}/100000", "lon": f"-122 + {D('(user_id*53) % 100')}/100 + {D('(event_id*211) % 1000')}/100000", "accuracy": "value", "event_type": "event_type"}, "user_id IS NOT NULL"),
    "g_globe": ("lineitem", {"id": "l_orderkey * 8 + l_linenumber", "orderkey": "l_orderkey", "lat": f"-89.5 + {D('(l_orderkey*7919 + l_partkey*31) % 17900')}/100", "lon": f"-180 + {D('(l_partkey*6007 + l_orderkey*17) % 36000')}/100", "class": "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 5 END + CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END", "cov": "CAST(l_quantity AS BIGINT) * 5", "mag": "(l_partkey * 13) % 255 + 1", "uses": "(l_suppkey * 7) % 64", "seq": "l_orderkey * 1000 + l_partkey"}, "l_orderkey IS NOT NULL"),
    "g_place": ("customer", {"id": "c_custkey", "kind": "64 + (c_nationkey % 6)", "rank": "CAST(floor(c_acctbal) AS BIGINT) + 1000", "name": "concat(c_name, ' ', c_mktsegment)", "reference": "c_mktsegment", "lat": f"46 + {D('(c_custkey*7) % 2000')}/1000", "lon": f"-123 + {D('(c_custkey*11) % 2000')}/1000"}, "c_custkey IS NOT NULL"),
    "g_addr": ("orders", {"id": "o_orderkey", "number": "(o_orderkey * 7) % 9000 + 1", "street": "concat(CASE o_orderkey % 5 WHEN 0 THEN 'North ' WHEN 1 THEN 'S ' WHEN 2 THEN 'Southwest ' ELSE '' END, CASE o_custkey % 7 WHEN 0 THEN 'red widget' WHEN 1 THEN 'North Bend' WHEN 2 THEN 'Talon' WHEN 3 THEN '9th' WHEN 4 THEN 'blue   hill' WHEN 5 THEN 'O''Brien' ELSE 'Main' END, CASE o_orderkey % 6 WHEN 0 THEN ' Street' WHEN 1 THEN ' Ave' WHEN 2 THEN ' Trail' WHEN 3 THEN ' Way' WHEN 4 THEN ' Ln.' ELSE '' END)", "zip": "98000 + o_custkey % 100", "lat": f"46 + {D('(o_orderkey*3) % 1000')}/1000", "lon": f"-122 + {D('(o_custkey*5) % 1000')}/1000"}, "o_orderkey IS NOT NULL"),
    "g_way": ("orders", {"way": "o_orderkey", "class": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 3 WHEN '3' THEN 5 WHEN '4' THEN 7 ELSE 9 END", "uses": "CASE WHEN o_orderkey % 11 = 0 THEN 131 WHEN o_orderkey % 5 = 0 THEN 55 ELSE 19 END", "speed_kmh": "(CAST(floor(o_totalprice) AS BIGINT) % 4) * 30", "oneway": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN -1 ELSE 0 END", "layer": "o_orderkey % 3 - 1", "grade": "(o_custkey % 5) + (o_custkey % 4) * 16", "name": "concat('Way ', CAST(o_custkey % 40 AS STRING))"}, "o_orderkey IS NOT NULL"),
    "g_box": ("nation", {"id": "n_nationkey", "lat0": f"46 + {D('n_nationkey*3 % 17')}/10", "lon0": f"-122.9 + {D('n_nationkey*7 % 19')}/10", "lat1": f"46.05 + {D('n_nationkey*3 % 17')}/10 + {D('n_nationkey')}/100", "lon1": f"-122.85 + {D('n_nationkey*7 % 19')}/10 + {D('n_nationkey')}/80"}, "n_nationkey IS NOT NULL"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, where = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


def sql(name: str) -> str:
    """The view for the oracle."""
    table, columns, where = VIEWS[name]
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table} WHERE {where})".replace("AS STRING)", "AS VARCHAR)")


def _faces() -> str:
    rows = ", ".join(f"({i}, {', '.join(repr(x) for x in (*c, *m))}, {d}, {u})" for i, (c, m, d, u) in enumerate(cells.FACES))
    return f"faces(f, cx, cy, cz, m0, m1, m2, m3, m4, m5, m6, m7, m8, dia, upper) AS (VALUES {rows})"


def spread(x: str) -> str:
    return f"CAST(list_sum([(((({x}) >> i) & 1) << (2*i)) for i in range(30)]) AS BIGINT)"


def coded(source: str, lat: str = "lat", lon: str = "lon") -> str:
    """CTEs ending in `coded`: the source's columns with diamond, u, v by searching all twenty faces."""
    return f"""{_faces()},
src AS (SELECT *, row_number() OVER () AS _r, cos(radians({lat}))*cos(radians({lon})) AS _x, cos(radians({lat}))*sin(radians({lon})) AS _y, sin(radians({lat})) AS _z FROM {source}),
best AS (SELECT _r AS _b, -max({{'d': cx*_x + cy*_y + cz*_z, 'nf': -f}}).nf AS f FROM src CROSS JOIN faces GROUP BY _r),
bary AS (SELECT src.*, dia, upper, m0*_x+m1*_y+m2*_z AS _a, m3*_x+m4*_y+m5*_z AS _s, m6*_x+m7*_y+m8*_z AS _t FROM src JOIN best ON _r = _b JOIN faces USING (f)),
coded AS (SELECT * EXCLUDE (dia, upper, _a, _s, _t, _x, _y, _z, _r), dia AS diamond,
 least(greatest(CAST(trunc((CASE WHEN upper=1 THEN 1-_t/(_a+_s+_t) ELSE _s/(_a+_s+_t) END)*1073741824) AS BIGINT), 0), 1073741823) AS u,
 least(greatest(CAST(trunc((CASE WHEN upper=1 THEN 1-_s/(_a+_s+_t) ELSE _t/(_a+_s+_t) END)*1073741824) AS BIGINT), 0), 1073741823) AS v FROM bary)"""


def prefix_sql(depth: int) -> str:
    return f"((CAST(diamond AS BIGINT) << {2 * depth}) | ({spread(f'u >> {30 - depth}')} << 1) | {spread(f'v >> {30 - depth}')})"


def texel_sql(depth: int) -> str:
    s = 22 - depth
    return f"((((((v >> {s}) & 255) << 8) | ((u >> {s}) & 255)) << 1) | CASE WHEN (u & {(1 << s) - 1}) + (v & {(1 << s) - 1}) >= {1 << s} THEN 1 ELSE 0 END)"


def locate_sql(source: str, u: str, v: str) -> str:
    """CTEs ending in `placed`: the source with lat2, lon2 of continuous diamond coordinates."""
    rows = ", ".join(f"({i}, {', '.join(repr(float(x)) for k in d for x in cells.VERTICES[k])})" for i, d in enumerate(cells.DIAMONDS))
    names = ", ".join(f"{p}{a}" for p in ("va", "vq", "vr", "vb") for a in "xyz")
    axis = "+".join(f"w{p}*v{p}{{0}}" for p in "aqrb")
    return f"""corners(dd, {names}) AS (VALUES {rows}),
w AS (SELECT s.*, CASE WHEN {u}+{v} <= 1 THEN 1-{u}-{v} ELSE 0 END AS wa, CASE WHEN {u}+{v} <= 1 THEN {u} ELSE 1-{v} END AS wq, CASE WHEN {u}+{v} <= 1 THEN {v} ELSE 1-{u} END AS wr, CASE WHEN {u}+{v} <= 1 THEN 0 ELSE {u}+{v}-1 END AS wb FROM {source} s),
xyz AS (SELECT w.*, {axis.format('x')} AS px, {axis.format('y')} AS py, {axis.format('z')} AS pz FROM w JOIN corners ON dd = diamond),
placed AS (SELECT *, degrees(asin(pz/sqrt(px*px+py*py+pz*pz))) AS lat2, degrees(atan2(py, px)) AS lon2 FROM xyz)"""
