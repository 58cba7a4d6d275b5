"""Rows at ranks found by counting, against a sort."""

import random

import pytest
from pyspark.sql import functions as F

from quitanda.functions import selection as S
from quitanda.functions.ranking import quantiles, row_numbers
from quitanda.operators import rfm


def rows(n, seed=7):
    """A third of all rows share one key, ids share a long beginning, and one id is null."""
    rng = random.Random(seed)
    made = [(rng.choice([5, 5, 5, -(10**15), 10**15, *range(-400, 400, 7)]), rng.randint(0, 3), f"customer_{i * i % 9973:05d}é{i}") for i in range(n)]
    return [*made, (5, 1, None), (None, 2, "unknown")]


@pytest.mark.parametrize(("read", "buckets"), [(2048, 4096), (3, 4), (1, 2)])
def test_rows_at_ranks_equal_a_sort(spark, monkeypatch, read, buckets):
    monkeypatch.setattr(S, "READ_ROWS", read)
    monkeypatch.setattr(S, "BUCKETS", buckets)
    monkeypatch.setattr(S, "LETTERS", 7)
    data = rows(300)
    df = spark.createDataFrame(data, "x LONG, y LONG, id STRING").repartition(5).persist()
    keys = {"x": F.col("x"), "y": F.col("y")}
    sizes = S.series_sizes(df, keys)
    assert sizes == {"x": (301, -(10**15), 10**15), "y": (302, 0, 3)}
    ranks = {"x": [1, 2, 60, 150, 301], "y": [1, 76, 151, 302]}
    found = S.rows_at_ranks(df, keys, ranks, sizes, "id")
    for k, name in enumerate(("x", "y")):
        order = sorted(((r[k], r[2]) for r in data if r[k] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        assert found[name] == {rank: order[rank - 1] for rank in ranks[name]}
    keys_only = S.rows_at_ranks(df, keys, ranks, sizes)
    assert {n: {r: row[0] for r, row in keys_only[n].items()} for n in keys} == {n: {r: row[0] for r, row in found[n].items()} for n in keys}


@pytest.mark.parametrize(("read", "buckets"), [(2048, 4096), (1, 2)])
def test_numbers_as_ties(spark, monkeypatch, read, buckets):
    monkeypatch.setattr(S, "READ_ROWS", read)
    monkeypatch.setattr(S, "BUCKETS", buckets)
    data = [(i % 3 // 2, i * 7919 % 10007 - 5000) for i in range(300)] + [(0, None)]
    df = spark.createDataFrame(data, "x LONG, id LONG")
    keys = {"x": F.col("x")}
    found = S.rows_at_ranks(df, keys, {"x": [1, 2, 100, 201, 202, 301]}, S.series_sizes(df, keys), "id")
    order = sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    assert found["x"] == {rank: order[rank - 1] for rank in (1, 2, 100, 201, 202, 301)}


def test_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "READ_ROWS", 2)
    df = spark.createDataFrame([(1, "same")] * 20 + [(1, "samee")] * 5 + [(1, "")] * 4, "x LONG, id STRING")
    sizes = S.series_sizes(df, {"x": F.col("x")})
    found = S.rows_at_ranks(df, {"x": F.col("x")}, {"x": [1, 4, 5, 24, 25]}, sizes, "id")
    assert found["x"] == {1: (1, None), 4: (1, None), 5: (1, "same"), 24: (1, "same"), 25: (1, "samee")}


def test_tile_starts_and_nothing(spark):
    for n in (0, 1, 4, 5, 6, 13):
        tiles = [sum(start <= rank for start in S.tile_starts(n, 5)) + 1 for rank in range(1, n + 1)]
        df = spark.createDataFrame([(i,) for i in range(n)], "i INT").selectExpr("i", "ntile(5) OVER (ORDER BY i) AS t")
        assert tiles == [r["t"] for r in df.orderBy("i").collect()]
    empty = spark.createDataFrame([], "x LONG, id STRING")
    assert S.series_sizes(empty, {"x": F.col("x")}) == {}


def test_scores_without_people_and_no_shuffle_of_rows(spark, tables):
    metrics = rfm.customer_metrics(tables)
    assert rfm.quintile_scores(metrics.limit(0)).count() == 0
    assert rfm.summarize_measures(metrics.limit(0)).count() == 0
    plan = rfm.quintile_scores(metrics)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_quartiles_equal_those_of_ranks(spark):
    data = [(str(i), i % 7, i % 3 + 1, str(round(i * 1.37 % 50, 2))) for i in range(203)]
    df = spark.createDataFrame(data, "customer_unique_id STRING, recency LONG, frequency LONG, monetary STRING").withColumn("monetary", F.col("monetary").cast("decimal(18,3)"))
    found = {r["measure"]: (r["q1"], r["mediana"], r["q3"]) for r in rfm.summarize_measures(df).collect()}
    for m in rfm.MEASURES:
        expected = quantiles(row_numbers(df.select(F.col(m).alias("x"), "customer_unique_id"), ["x", "customer_unique_id"]), "x", [], [0.25, 0.5, 0.75]).first()[0]
        assert found[m] == pytest.approx(expected, abs=0.005)
