"""Hot keys and plans: results stay right and no plan gathers or multiplies rows."""

import random
import time
from datetime import datetime, timedelta
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quitanda.functions import skew
from quitanda.operators import cohort, geo, quality, reviews, rfm, season
from quitanda.plans import export
from quitanda.session import sweep


@pytest.fixture(scope="module")
def hot(spark):
    """One order has a third of all items and reviews, one product and one customer likewise."""
    rng = random.Random(11)
    rows = {
        "orders": ("order_id INT, customer_id INT, order_status STRING, order_purchase_timestamp TIMESTAMP_NTZ", []),
        "order_items": ("order_id INT, product_id INT, price DECIMAL(10,2), freight_value DECIMAL(10,2)", []),
        "order_reviews": ("order_id INT, review_score INT", []),
        "customers": ("customer_id INT, customer_unique_id INT, customer_state STRING", []),
        "products": ("product_id INT, product_category_name STRING", []),
        "sellers": ("seller_id INT, seller_state STRING", []),
        "category_translation": ("product_category_name STRING, product_category_name_english STRING", []),
    }
    start = datetime(2017, 1, 1)
    for order in range(300):
        customer = 0 if order % 3 == 0 else rng.randint(1, 80)
        status = "delivered" if order % 7 else "shipped"
        rows["orders"][1].append((order, customer, status, start + timedelta(hours=rng.randint(0, 9000))))
    for i in range(1500):
        order = 1 if i % 3 == 0 else rng.randint(0, 299)
        product = 0 if i % 3 == 1 else rng.randint(1, 30)
        rows["order_items"][1].append((order, product, Decimal(rng.randint(0, 9999)) / 100, Decimal(rng.randint(0, 999)) / 100))
    for i in range(900):
        rows["order_reviews"][1].append((1 if i % 3 == 0 else rng.randint(0, 299), rng.choice([1, 2, 3, 4, 5, None])))
    rows["customers"][1].extend((c, c // 2, "SP" if c % 3 == 0 else f"S{c % 5}") for c in range(81))
    rows["products"][1].extend((p, "hot" if p % 3 == 0 else f"cat{p % 4}" if p % 5 else None) for p in range(31))
    rows["sellers"][1].extend((s, f"S{s % 4}") for s in range(9))
    rows["category_translation"][1].extend([("hot", "quente"), ("hot", "quente"), ("cat1", "um"), ("cat2", None)])
    frames = {name: spark.createDataFrame(data, schema) for name, (schema, data) in rows.items()}
    connection = duckdb.connect()
    for name, df in frames.items():
        connection.register(f"arrow_{name}", df.toArrow())
        connection.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_{name}")
    return frames, connection


JOINED = """
WITH labels AS (
  SELECT product_id, COALESCE(product_category_name_english, product_category_name, 'sem_categoria') AS label
  FROM products LEFT JOIN category_translation USING (product_category_name)
), sold AS (
  SELECT * FROM orders JOIN customers USING (customer_id) JOIN order_items USING (order_id) WHERE order_status = 'delivered'
)
"""


def same(df, connection, sql):
    left = sorted(map(repr, (tuple(r) for r in df.collect())))
    right = sorted(map(repr, connection.execute(JOINED + sql).fetchall()))
    assert left == right


def test_state_metrics_with_a_hot_order(hot):
    frames, connection = hot
    same(
        geo.geo_state_metrics(frames).select("estado", "pedidos", "receita", "frete_medio", "review_score_medio", "total_vendedores"),
        connection,
        """SELECT customer_state, count(DISTINCT order_id), round(CAST(sum(price + freight_value) AS NUMERIC), 2),
           round(CAST(avg(freight_value) AS NUMERIC), 2), round(avg(review_score), 2),
           COALESCE((SELECT count(*) FROM sellers WHERE seller_state = customer_state), 0)
           FROM sold LEFT JOIN order_reviews USING (order_id) GROUP BY customer_state""",
    )


def test_category_scores_with_a_hot_order_and_product(hot):
    frames, connection = hot
    same(
        reviews.category_review_scores(frames),
        connection,
        """SELECT label, count(*), round(avg(review_score), 2), count(*) FILTER (review_score >= 4),
           count(*) FILTER (review_score <= 2) FROM sold JOIN order_reviews USING (order_id) JOIN labels USING (product_id)
           GROUP BY label HAVING count(*) >= 2""",
    )


def test_top_categories_with_hot_keys(hot):
    frames, connection = hot
    same(
        geo.geo_top_categories(frames),
        connection,
        """SELECT * FROM (SELECT customer_state, label, count(DISTINCT order_id) AS n, round(CAST(sum(price) AS NUMERIC), 2) AS r
           FROM sold JOIN labels USING (product_id) GROUP BY ALL)
           QUALIFY row_number() OVER (PARTITION BY customer_state ORDER BY n DESC, r DESC, label) <= 3""",
    )


def test_customer_metrics_with_a_hot_customer(hot):
    frames, connection = hot
    same(
        rfm.customer_metrics(frames),
        connection,
        """SELECT customer_unique_id, date_diff('day', CAST(max(order_purchase_timestamp) AS DATE),
             (SELECT CAST(max(order_purchase_timestamp) AS DATE) + 1 FROM orders)), count(DISTINCT order_id),
           round(CAST(sum(price + freight_value) AS NUMERIC), 2) FROM sold GROUP BY 1""",
    )


@pytest.mark.parametrize(
    "check",
    [test_category_scores_with_a_hot_order_and_product, test_top_categories_with_hot_keys],
    ids=lambda f: f.__name__.removeprefix("test_"),
)
def test_salted_joins_give_the_same_results(hot, monkeypatch, check):
    monkeypatch.setattr(skew, "HOT_SHARE", 20)
    check(hot)


def test_salt_spreads_only_the_hot_key(hot, monkeypatch):
    frames, _ = hot
    monkeypatch.setattr(skew, "HOT_SHARE", 20)
    items, orders = frames["order_items"], frames["orders"]
    assert skew.hot_keys(items, "order_id") == [1]
    joined = skew.salted_join(items, orders, "order_id", ["product_id"])
    salts = {r["order_id"]: r["n"] for r in joined.groupBy("order_id").agg(F.countDistinct("_salt").alias("n")).collect()}
    assert salts[1] > 10 and all(n == 1 for order, n in salts.items() if order != 1)
    assert joined.count() == items.join(orders, "order_id").count()
    empty = skew.salted_join(items.limit(0), orders, "order_id", ["product_id"])
    assert empty.count() == 0


def test_both_sides_salt_the_same_keys(spark, monkeypatch):
    """Keys drawn anew at each evaluation: two sketches would find different hot keys, one loses no row."""
    monkeypatch.setattr(skew, "HOT_SHARE", 5)
    hot = F.when(F.rand() < 0.5, F.floor(F.rand() * 3)).otherwise(F.col("id") % 500)
    fact = spark.range(4000).select(hot.cast("long").alias("k"), F.col("id").alias("v"))
    side = spark.range(500).select(F.col("id").alias("k"))
    for _ in range(3):
        assert skew.salted_join(fact, side, "k", ["v"]).count() == 4000


def test_skewed_joins_are_split(spark, hot):
    """With thresholds scaled down to the fixture, the adaptive plan splits the hot product."""
    frames, connection = hot
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, setting in settings.items():
            spark.conf.set(key, setting)
        wide = dict(frames) | {"order_items": frames["order_items"].repartition(8)}
        test_top_categories_with_hot_keys((wide, connection))
        df = geo.geo_top_categories(wide)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, setting in before.items():
            spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)
    assert "skew=true" in plan


OPERATORS = [
    cohort.cohort_retention, cohort.cohort_repurchase, geo.geo_state_metrics, geo.geo_top_categories, rfm.customer_metrics,
    reviews.category_review_scores, season.weekday_pattern, season.hourly_pattern, quality.untranslated_categories,
]


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_plans_have_no_products_and_no_python(hot, operator):
    frames, _ = hot
    plan = operator(frames)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInArrow"):
        assert node not in plan


def test_scans_read_few_columns_and_filter_early(spark):
    from checks.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    plan = QUERIES["geo_state_metrics"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "l_shipdate" not in plan and "o_totalprice" not in plan
    plan = QUERIES["nps"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "documents" not in plan and "ReadSchema: struct<o_orderpriority:string>" in plan


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_sweep_deletes_shuffles_that_nobody_holds(spark):
    def left(files):
        until = time.time() + 30
        while files & _shuffle_files(spark) and time.time() < until:
            sweep(spark)
            time.sleep(0.5)
        return files & _shuffle_files(spark)

    before = _shuffle_files(spark)
    rows = spark.range(5000).groupBy((F.col("id") % 100).alias("k")).count()
    assert rows.count() == 100
    new = _shuffle_files(spark) - before
    assert new
    del rows
    assert not left(new)


def test_every_exported_file_is_followed_by_a_sweep(spark, tmp_path, monkeypatch):
    swept = []
    monkeypatch.setattr(export, "sweep", lambda spark: swept.append(len(list(tmp_path.glob("*.json")))))
    rows = spark.createDataFrame([("delivered", 1, 100.0)], "status STRING, contagem LONG, percentual DOUBLE")
    assert export.export_results(spark, {"funil_status": rows, "funil_conversao": rows}, str(tmp_path)) == ["01_funil_status.json", "01_funil_conversao.json"]
    assert swept == [1, 2]
