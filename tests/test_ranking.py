"""Distributed ranks, tiles, quantiles and running sums against brute force."""

import random

import pytest
from pyspark.sql import Window, functions as F

from quitanda.functions import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key value."""
    rng = random.Random(7)
    rows = [("g1" if i % 4 else "g2", 5 if i % 3 == 0 else rng.randint(-400, 400), f"id{i:05d}") for i in range(2003)]
    return spark.createDataFrame(rows, "grp STRING, x LONG, id STRING").repartition(7)


def test_row_numbers_equal_a_global_sort(skewed):
    window = Window.partitionBy("grp").orderBy("x", "id")
    expected = {r["id"]: (r["rn"], r["n"]) for r in skewed.select(
        "id", F.row_number().over(window).alias("rn"), F.count("*").over(Window.partitionBy("grp")).alias("n")).collect()}
    found = R.row_numbers(skewed, ["x", "id"], ["grp"])
    assert {r["id"]: (r["rn"], r["n"]) for r in found.collect()} == expected


def test_row_numbers_without_groups(skewed):
    ordered = [r["id"] for r in R.row_numbers(skewed, ["x", "id"]).orderBy("rn").collect()]
    assert ordered == [r["id"] for r in skewed.orderBy("x", "id").collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 6, 13, 503])
def test_tiles_equal_ntile(spark, n):
    rows = spark.createDataFrame([("m", i % 3, f"{i:04d}") for i in range(n)], "measure STRING, key LONG, id STRING")
    ranked = R.row_numbers(rows, ["key", "id"], ["measure"])
    bounds = R.tile_bounds(ranked, 5, "key", "id", "measure").agg(F.first("bounds")).scalar()
    tile = R.tile_of(bounds, 5, F.col("key"), F.col("id"))
    expected = F.ntile(5).over(Window.orderBy("key", "id"))
    assert rows.select(tile.alias("t"), expected.alias("e")).filter("t <> e").count() == 0


def test_quantiles_equal_percentile(skewed):
    points = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = R.quantiles(R.row_numbers(skewed, ["x", "id"], ["grp"]), "x", ["grp"], points)
    exact = skewed.groupBy("grp").agg(F.percentile("x", points).alias("p"))
    for row in found.join(exact, "grp").collect():
        assert row["quantiles"] == pytest.approx(row["p"])


def test_running_sums(skewed):
    window = Window.partitionBy("grp").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, -1)
    expected = {r["id"]: r["s"] for r in skewed.select("id", F.coalesce(F.sum("x").over(window), F.lit(0)).alias("s")).collect()}
    found = R.running_sums(skewed, ["x", "id"], ["x"], ["grp"])
    assert {r["id"]: r["before_x"] for r in found.collect()} == expected




def test_columns_for_the_order_alone_are_not_kept(skewed, monkeypatch):
    """Ranks are the same without the sorted column, and the kept rows have none of it."""
    kept, keep = [], R.durable
    monkeypatch.setattr(R, "durable", lambda df: kept.append(df.columns) or keep(df))
    keyed = skewed.withColumn("key", F.md5(F.col("id").cast("string")))
    whole, lean = R.row_numbers(keyed, ["key"], ["grp"]), R.row_numbers(keyed, ["key"], ["grp"], drop=["key"])
    assert sorted(whole.drop("key").collect()) == sorted(lean.collect())
    assert "key" in kept[0] and "key" not in kept[2] and "key" not in lean.columns
