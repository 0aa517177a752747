"""Labels chosen in rounds against the sequential choice."""

import random

from pyspark.sql import functions as F

from deltagrid.operators import lettering


def sequential(labels, meet):
    out = []
    for v in sorted({x[0] for x in labels}):
        kept = []
        for x in sorted((x for x in labels if x[0] == v), key=lambda x: (x[2], -x[3], x[1])):
            if all(not meet(x, k) for k in kept):
                kept.append(x)
        out += kept
    return sorted((x[0], x[1]) for x in out)


def meets(a, b):
    return max(a[4], b[4]) < min(a[6], b[6]) and max(a[5], b[5]) < min(a[7], b[7])


SCHEMA = "view int, id int, tier int, rank int, x0 double, y0 double, x1 double, y1 double"


def test_rounds_equal_the_sequential_choice(spark):
    rng, labels = random.Random(2), []
    for i in range(5000):
        v = i % 3
        x, y = (rng.gauss(300, 40), rng.gauss(200, 30)) if i % 4 == 0 else (rng.uniform(0, 1200), rng.uniform(0, 900))
        labels.append((v, i, rng.randint(0, 9), rng.randint(0, 5), x, y, x + rng.choice((20.0, 60.0, 130.0)), y + rng.choice((12.0, 18.0))))
    labels += [(2, 5000 + k, 0, 9, 700.0, 700.0, 760.0, 712.0) for k in range(40)]
    df = spark.createDataFrame([*labels, (1, 9000, 0, 9, None, 1.0, 2.0, 3.0)], SCHEMA)
    got = lettering.chosen(df, "view", "id", [F.col("tier"), -F.col("rank")], 14.0)
    assert sorted((r["view"], r["id"]) for r in got.collect()) == sequential(labels, meets)
    assert got.columns == df.columns
    assert lettering.chosen(df.limit(0), "view", "id", [F.col("tier")], 14.0).count() == 0


def test_points_of_one_name_merge_only_nearby(spark):
    rng = random.Random(3)
    points = [(i % 2, i, rng.choice("ab"), rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(400)]
    want = []
    for p in points:
        if all(q[0] != p[0] or q[2] != p[2] or (q[3] - p[3]) ** 2 + (q[4] - p[4]) ** 2 >= 24 * 24 for q in want):
            want.append(p)
    got = lettering.merged_points(spark.createDataFrame(points, "view int, id int, name string, x double, y double"), "view", "id", ["name"], 24.0)
    assert sorted(r["id"] for r in got.collect()) == [p[1] for p in want] and got.columns == ["view", "id", "name", "x", "y"]


def test_names_are_gathered_once_and_rivers_not_in_lakes(spark):
    t = spark.createDataFrame([(0, 12, "Snake", "", 3, 1.0, 2.0, None), (0, 12, "Snake", "", 7, 4.0, 9.0, 44), (0, 12, "Snake", "", 2, 6.0, 1.0, 9), (0, 44, "Mead", "", 1, 4.0, 9.0, 44)], "view int, kind int, name string, reference string, rank int, x double, y double, area_kind int")
    got = sorted(tuple(r) for r in lettering.gathered(t).collect())
    assert got == [(0, 12, "Snake", "", 3, 2, 1.0, 1.0, 6.0, 2.0), (0, 44, "Mead", "", 1, 1, 4.0, 9.0, 4.0, 9.0)]


def test_of_labels_of_one_box_only_the_first_is_dealt(spark, monkeypatch):
    """A box without an inside meets nothing, itself included, so all of its labels stand."""
    held, cut = [], lettering.cut
    monkeypatch.setattr(lettering, "cut", lambda df: held.append(cut(df)) or held[-1])
    monkeypatch.setattr(lettering, "forget", lambda *_: None)
    df = spark.range(3000).selectExpr("0 AS view", "CAST(id AS INT) AS id", "CAST(id % 7 AS INT) AS tier", "0 AS rank", "CAST(id % 3 * 15 AS DOUBLE) AS x0", "0D AS y0", "CAST(id % 3 * 15 + 20 AS DOUBLE) AS x1", "10D AS y1")
    flat = spark.createDataFrame([(0, 9000 + i, 0, 0, 5.0, 5.0, 5.0, 9.0) for i in range(4)] + [(0, 9100 + i, 0, 0, 500.0, 5.0, 500.0, 9.0) for i in range(4)], SCHEMA)
    labels = df.unionByName(flat)
    got = sorted((r["view"], r["id"]) for r in lettering.chosen(labels, "view", "id", [F.col("tier"), -F.col("rank")], 14.0).collect())
    assert held[0].count() == 3 + 8
    assert got == sequential([tuple(r) for r in labels.collect()], meets)
