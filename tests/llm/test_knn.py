import random

from pyspark.sql import functions as F

from rinsework.llm import knn
from tests.llm.twin import same

SCHEMA = "vec_id long, embedding array<double>, label int, score int"


def brute(rows, k):
    import math

    good = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def check(spark, rows, k=5, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in knn.voronoi_topk(df, F.col("vec_id") % 50 == 0, k=k, **more).collect()) == brute(rows, k)


def test_against_brute_force(spark):
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 3) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rnd.gauss(0, 0.2) for c in centres[i % 5]], 0, 0) for i in range(700)]
    check(spark, rows, block=32)
    check(spark, rows, k=1, pivots=3, block=16)


def test_hot_vector_and_ties(spark):
    check(spark, [(i, [1.0, 0.5] if i % 3 else [0.25, float(i % 7)], 0, 0) for i in range(400)], block=16)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 0, 0), (50, None, 0, 0), (100, [None, 1.0], 0, 0), (3, [float("nan"), 1.0], 0, 0), (4, [float("inf"), 1.0], 0, 0), (None, [1.0, 1.0], 0, 0), (5, [1.0], 0, 0), (5, [1.0], 0, 0), (0, [1.0, 2.0], 0, 0), (150, [], 0, 0)]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [])


def test_large_components_are_exact(spark):
    check(spark, [(i, [1e5 + i, -3e4 * i], 0, 0) for i in range(120)])


def test_scores_beyond_doubles(spark):
    """Products up to 2**63 are exact integers."""
    check(spark, [(i, [2.0**22 + i, 2.0**21 - 3 * i + 1 / 256], 0, 0) for i in range(110)])


def test_what_is_replicated(spark):
    """On clustered vectors a query is sent to few cells, and the result is exact all the same."""
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(i, [c + rnd.gauss(0, 0.05) for c in centres[i % 20]], 0, 0) for i in range(2500)]
    report = {}
    got = knn.voronoi_topk(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, report=report)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)
    assert report["met"] < 0.3


def test_sql_twin(spark):
    same(spark, "/root/testdata/sf0.01", "op2_voronoi_knn")
