import random

import pytest
from compare import connect, same
from pyspark.sql import functions as F

from tallyard.llm import queries, splits


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "none"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(2)
    edges = {
        "random": [(f"v{rng.randrange(300):03}", f"v{rng.randrange(300):03}") for _ in range(220)],
        "chain": [(f"v{i:03}", f"v{i + 1:03}") for i in range(150)],
        "star": [("v000", f"v{i:03}") for i in range(1, 400)],
        "none": [],
    }[shape]
    rng.shuffle(edges)
    pairs = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(pairs + [(None, "v001")], "a string, b string").repartition(5)
    got = {r["vertex"]: r["root"] for r in splits.components(df).collect()}
    assert got == brute(pairs)


def test_ties_leave_white_space_aside(spark):
    rows = [("P1", "a b\nc"), ("P2", " a  b c "), ("P3", "a\xa0bc"), ("P4", "a b d"), ("P5", " "), ("P6", ""), ("P7", None), ("P8", "\t"), (None, "a b c"), ("P1", "a b\nc")]
    edges = splits.ties(spark.createDataFrame(rows, "p string, t string"), F.col("p"), F.col("t"))
    assert sorted((r["a"], r["b"]) for r in edges.collect()) == [("P2", "P1"), ("P3", "P1")]


def test_plan_deals_largest_first():
    deal = splits.plan([(10, 3), (1, 70)], 100, [0.8, 0.1, 0.1])
    assert [sum(d) for d in deal.values()] == [3, 70]
    totals = [sum(s * d[i] for s, d in deal.items()) for i in range(3)]
    assert totals == [80, 10, 10]
    assert splits.plan([], 0, [0.8, 0.2]) == {} and splits.plan([(0, 5)], 0, [0.5, 0.5]) == {0: [5, 0]}


def test_assignment_follows_the_plan(spark):
    rng = random.Random(1)
    rows = [(f"g{i:04}", rng.choice([1, 1, 1, 2, 3, 50])) for i in range(500)]
    got = {r["grp"]: r["split"] for r in splits.assign(spark.createDataFrame(rows, "grp string, n bigint"), queries.SHARES).collect()}
    assert len(got) == 500
    total = sum(n for _, n in rows)
    for name, share in queries.SHARES.items():
        assert abs(sum(n for g, n in rows if got[g] == name) / total - share) < 0.01
    assert splits.assign(spark.createDataFrame([], "grp string, n bigint"), queries.SHARES).count() == 0


def test_queries(spark, sf):
    same(queries.p6_found(spark, sf), connect(sf), queries.SQL["p6_found"])
    s = queries.p6_splits(spark, sf)
    assert s.count() == spark.read.parquet(f"{sf}/panel_records.parquet").count()
    assert s.groupBy("group_prompt_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
