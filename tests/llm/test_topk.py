"""Exact top-k search against plain loops: odd vectors, repeated ids, masses of ties, several waves."""

import random

import pytest
from pyspark.sql import functions as F

from barweave.llm import topk_search

KIND = "vec_id long, embedding array<double>, rank int, score long, number long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 8, 9) for i, v in rows], KIND).repartition(3)


def found(spark, rows, k=20, scale=64, **more):
    got = topk_search.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=k, scale=scale, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=str)


def wanted(rows, k=20, scale=64):
    return sorted(topk_search.brute_force(rows, lambda i: i % 20 == 0, k, scale), key=str)


def some(n, dim=16, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.2) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 5, 20])
def test_against_plain_loops(spark, k):
    rows = some(300)
    assert found(spark, rows, k) == wanted(rows, k)


def test_waves_hold_few_queries(spark):
    rows = some(240)
    assert found(spark, rows, 5, wave=5) == wanted(rows, 5)


def test_fewer_rows_than_asked_for(spark):
    rows = some(12)
    assert found(spark, rows) == wanted(rows) and len(found(spark, rows)) == 11


def test_odd_vectors_and_ids(spark):
    rows = some(60) + [(20, [1.0] * 16), (20, [1.0] * 16), (7, [0.5] * 16), (None, [2.0] * 16), (40, None), (40, [None] * 16), (60, [float("nan")] * 16), (80, [float("inf")] * 16), (100, []), (120, [1.0] * 3), (121, [1.0] * 40)]
    for k in (3, 20):
        assert found(spark, rows, k) == wanted(rows, k)


def test_masses_of_equal_scores_go_to_the_smallest_ids(spark):
    rows = [(i, [0.25, -0.5]) for i in range(700)] + [(700 + i, [0.0, 0.0]) for i in range(100)]
    random.Random(2).shuffle(rows)
    assert found(spark, rows, 20) == wanted(rows, 20)


def test_huge_components_stay_whole(spark):
    rows = [(i, [(-1) ** i * 2.0 ** (i % 50), float(i)]) for i in range(80)] + [(100, [1e300, 1.0]), (101, [-1e300, 1.0])]
    exact = [(i, [max(-(2.0**63) / 64, min((2.0**63 - 1024) / 64, x)) for x in v]) for i, v in rows]
    got, want = found(spark, rows, 6), wanted(exact, 6)
    assert [(q, r, s) for q, r, _, s in got if q != 100] == [(q, r, s) for q, r, _, s in want if q != 100]


def test_nothing_to_search(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert found(spark, [(20, [1.0])]) == []
