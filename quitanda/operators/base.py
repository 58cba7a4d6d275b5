"""Shared building blocks over the order tables.

Two rules keep these safe when one key holds a large part of the rows:
facts are reduced per key before they are joined, with partial aggregation on
the map side, and the side they meet is unique on that key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

Tables = Mapping[str, DataFrame]

# Fixed values.
DELIVERED = "delivered"
NO_CATEGORY = "sem_categoria"


def delivered(tables: Tables) -> DataFrame:
    """Orders whose status is delivered.

    A source that knows a cheaper way to select them offers it as the table
    ``delivered_orders``.
    """
    source = "delivered_orders" if "delivered_orders" in tables else "orders"
    return tables[source].filter(F.col("order_status") == DELIVERED)


def delivered_orders(tables: Tables, *columns: str) -> DataFrame:
    """Key and the named columns of delivered orders."""
    return delivered(tables).select("order_id", *columns)


def item_value() -> Column:
    """Price plus freight of an item."""
    return F.col("price") + F.col("freight_value")


def item_totals(tables: Tables) -> DataFrame:
    """Items reduced to one row per order."""
    return tables["order_items"].groupBy("order_id").agg(F.sum(item_value()).alias("order_value"))


def delivered_totals(tables: Tables, *columns: str) -> DataFrame:
    """Delivered orders that have items, with the value of their items.

    The result is partitioned by ``order_id`` when the join shuffles, so a
    distinct count of orders afterwards needs no further exchange.
    """
    return delivered_orders(tables, *columns).join(item_totals(tables), "order_id")


def category_label() -> Column:
    """English name, else the source name, else a fixed label."""
    return F.coalesce(
        F.col("product_category_name_english"), F.col("product_category_name"), F.lit(NO_CATEGORY)
    )


def product_labels(tables: Tables) -> DataFrame:
    """Label of every product; a translated name listed twice gives two rows."""
    products = tables["products"].select("product_id", "product_category_name")
    return products.join(tables["category_translation"], "product_category_name", "left").select(
        "product_id", category_label().alias("categoria")
    )


def review_totals(tables: Tables) -> DataFrame:
    """Reviews reduced to one row per order."""
    score = F.col("review_score")
    return tables["order_reviews"].groupBy("order_id").agg(
        F.count("*").alias("reviews"),
        F.sum(score).alias("score_sum"),
        F.count(score).alias("scored"),
        F.count_if(score >= 4).alias("positive"),
        F.count_if(score <= 2).alias("negative"),
    )
