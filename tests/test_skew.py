"""Inputs that would fill one task or one square."""

import random

import pytest
from pyspark.sql import functions as F

from deltagrid.operators import areas, layers, search


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
@pytest.mark.parametrize("values", [[1e12, -1e300, 1e300, *map(float, range(900))], [5.0] * 300 + [7.0], [1.0], [], [0.1 * k * (-1) ** k for k in range(400)]])
def test_values_at_ranks_whatever_lies_far_off(spark, values, most):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    n = F.col("n")
    got = layers.at_ranks(df, "x", [F.floor(n / 100), F.floor(n * 99 / 100), F.floor(n / 2)], buckets=16, most=most).first()
    s = sorted(values)
    assert tuple(got) == tuple(s[int(len(s) * k)] if s else None for k in (0.01, 0.99, 0.5))


@pytest.mark.parametrize("pins", [False, True])
def test_what_to_drop_over_many_ranges(spark, pins):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.randint(0, 9), i, rng.randint(1, 50), rng.random() < 0.2 if rng.random() < 0.9 else None) for i in range(2000)] + [(None, 1, 5000 + k, 10, False) for k in range(30)]
    df = spark.createDataFrame(rows, "part string, day int, id int, size bigint, pinned boolean")
    got = search.within_budget(df, "part", ["day", "id"], "size", 9000 if not pins else 14000, "pinned" if pins else None)
    want = []
    for p in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == p), key=lambda r: r[1:3])
        held = sum(r[3] for r in mine)
        for r in mine:
            if pins and r[4]:
                continue
            if held > (14000 if pins else 9000):
                want.append(r[2])
            held -= r[3]
    assert sorted(r["id"] for r in got.collect()) == sorted(want) and want and got.columns == df.columns


def boxes(rng, n, sizes):
    out = []
    for i in range(n):
        a, b, s = rng.uniform(-80, 70), rng.uniform(-170, 150), rng.choice(sizes)
        out.append((i, a, b, a + rng.uniform(0, s), b + rng.uniform(0, s)))
    return out


SCHEMA = "id int, lat0 double, lon0 double, lat1 double, lon1 double"


def test_boxes_of_all_sizes_meet_once_and_large_ones_stay_few_rows(spark):
    rng = random.Random(9)
    a = [*boxes(rng, 300, (0.0, 0.2, 3.0, 40.0)), (300, -90.0, -180.0, 90.0, 180.0), (301, 1.0, 1.0, 1.0, 1.0), (302, None, 1.0, 2.0, 2.0)]
    b = [*boxes(rng, 300, (0.1, 1.0, 20.0)), (300, -90.0, -180.0, 90.0, 180.0), (301, 1.0, 1.0, 2.0, 2.0)]
    fa, fb = (spark.createDataFrame(x, SCHEMA) for x in (a, b))
    meet = lambda p, q, pad=0.0: p[1] is not None and p[1] - pad <= q[3] and q[1] <= p[3] + pad and p[2] - pad <= q[4] and q[2] <= p[4] + pad
    want = sorted((p[0], q[0]) for p in a for q in b if meet(p, q))
    got = sorted((r["a"], r["b"]) for r in search.overlapping(fa, fb).collect())
    assert got == want
    padded = areas.envelopes_meet(fa, fb.withColumnRenamed("id", "other"), 0.5)
    assert sorted((r["id"], r["other"]) for r in padded.collect()) == sorted((p[0], q[0]) for p in a for q in b if meet(p, q, 0.5))
    world = fa.where("id = 300")
    assert sorted(r["b"] for r in search.overlapping(world, fb).collect()) == [q[0] for q in b]
    assert search.overlapping(fa.limit(0), fb).count() == 0
