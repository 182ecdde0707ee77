import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals as iv
from strandline.operators.hierarchy import resolve_roots


def spans(seed, n, top=3_000_000_000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.choice([r.randrange(5000), r.randrange(3_000_000), r.randrange(top)])
        out.append((i, r.choice("ab"), s, s + r.choice([1, 2, 511, 512, 513, r.randrange(1, 5000), r.randrange(1, 5_000_000), r.randrange(1, 1_200_000_000)])))
    return out


def queries(seed, n):
    r = random.Random(seed)
    return [(i, k, s, r.choice([e, s, s - 3, s + 1, e])) for i, k, s, e in spans(seed, n) if s > 3]


@pytest.mark.parametrize("n", [40, 300])
def test_overlapping(spark, n):
    left, right = spans(1, 300), queries(2, n)
    a = spark.createDataFrame(left, "i long, k string, s0 long, e0 long")
    b = spark.createDataFrame(right, "j long, k string, qs long, qe long")
    got = [(x.i, x.j) for x in iv.overlapping(a, b, "k").collect()]
    want = sorted((i, j) for i, k, s, e in left for j, q, x, y in right if k == q and s < y and e > x)
    assert sorted(got) == want and len(want) > 100
    assert iv.overlapping(a.limit(0), b, "k").count() == 0 and iv.overlapping(a, b.limit(0), "k").count() == 0


@pytest.mark.parametrize("n", [40, 300])
def test_touching(spark, n):
    left, right = spans(3, 300), queries(4, n)
    left = [(i, k, e, s) if i % 7 == 0 else (i, k, s, e) for i, k, s, e in left]  # some reversed
    a = spark.createDataFrame(left, "i long, k string, s1 long, e1 long")
    b = spark.createDataFrame(right, "j long, k string, qs long, qe long")
    test = (F.col("s1") >= F.col("qs")) & (F.col("e1") <= F.col("qe"))
    got = sorted(x.i for x in iv.touching(a, b, "k", test, "i").collect())
    assert got == sorted(i for i, k, s, e in left if any(k == q and s >= x and e <= y for _, q, x, y in right)) and got


def test_joins_have_no_nested_loops(spark):
    a = spark.createDataFrame(spans(1, 300), "i long, k string, s0 long, e0 long")
    b = spark.createDataFrame(spans(2, 300), "j long, k string, qs long, qe long")
    plan = iv.overlapping(a, b, "k")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_union_length_and_merge(spark):
    r = random.Random(5)
    rows = [(g, s, s + r.choice([0, 1, r.randrange(40), r.randrange(3_000_000)])) for g in "xyz" for s in (r.randrange(4_000_000) for _ in range(60))] + [("empty", 5, 5)]
    df = spark.createDataFrame(rows, "g string, a long, b long")

    def islands(g):
        out = []
        for s, e in sorted((s, e) for x, s, e in rows if x == g):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return out

    assert {x.g: x.length for x in iv.union_length(df, ["g"]).collect()} == {g: sum(e - s for s, e in islands(g)) for g in "xyz"}
    got = sorted((x.g, x.a, x.b) for x in iv.merged(df, ["g"]).collect())
    assert got == sorted((g, s, e) for g in ("x", "y", "z", "empty") for s, e in islands(g))


def test_results_do_not_depend_on_partitions(spark):
    a = spark.createDataFrame(spans(6, 200), "i long, k string, s0 long, e0 long")
    b = spark.createDataFrame(spans(7, 200), "j long, k string, qs long, qe long")
    one = sorted(map(tuple, iv.overlapping(a.coalesce(1), b, "k").collect()))
    assert one == sorted(map(tuple, iv.overlapping(a.repartition(7), b.orderBy(F.desc("j")), "k").collect()))


def test_roots(spark):
    chain = [(i, i - 1) for i in range(1, 200)] + [(0, 0)] + [(500, 501), (501, 502), (502, 500), (503, 500)] + [(600, 600), (601, 600), (700, 9999), (701, 700), (702, None)]
    got = {x.node: x.root for x in resolve_roots(spark.createDataFrame(chain, "node long, parent long")).collect()}
    assert all(got[i] == 0 for i in range(200)) and got[601] == got[600] == 600
    assert all(got[i] is None for i in (500, 501, 502, 503, 700, 701, 702)) and len(got) == len(chain)
