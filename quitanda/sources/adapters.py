"""The driver's star-schema tables seen as marketplace tables.

Every builder is lazy and selects only what the canonical columns need, so
unused columns never leave the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Order status codes, and English names of part types
# (two types share a name, one has an empty name, one is absent).
STATUS_NAMES = {"F": "delivered", "O": "shipped", "P": "processing"}
CATEGORY_NAMES = [
    ("ECONOMY", "basic"),
    ("STANDARD", "basic"),
    ("MEDIUM", "mid_range"),
    ("SMALL", "compact"),
    ("LARGE", None),
]
ESTIMATE_DAYS = 30
APPROVAL_HOURS = 13

# Schemas already read from file footers, so that a session reads each of them once.
_SCHEMAS: dict[str, T.StructType] = {}


class LazyTables(Mapping[str, DataFrame]):
    """Tables by name, each built when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._builders

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


class StarTables:
    """Marketplace tables over one folder of driver Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._opened: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._opened:
            path = f"{self.folder}/{name}.parquet"
            reader = self.spark.read
            if path in _SCHEMAS:
                reader = reader.schema(_SCHEMAS[path])
            self._opened[name] = reader.parquet(path)
            _SCHEMAS[path] = self._opened[name].schema
        return self._opened[name]

    def lines(self) -> DataFrame:
        """Line items, reduced on the map side before any shuffle."""
        return self.raw("lineitem")

    def _status(self) -> F.Column:
        code = F.col("o_orderstatus")
        label = None
        for letter, name in STATUS_NAMES.items():
            label = F.when(code == letter, F.lit(name)) if label is None else label.when(code == letter, F.lit(name))
        return label

    def orders(self, lifecycle: bool = True, code: str | None = None) -> DataFrame:
        """Orders; without ``lifecycle`` no shipping dates and no pass over line items.

        ``code`` keeps one status by its source code, which reaches the scan;
        a filter on the mapped name would not.
        """
        source = self.raw("orders")
        if code is not None:
            source = source.filter(F.col("o_orderstatus") == code)
        base = source.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            self._status().alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.when(
                ~((F.col("o_orderstatus") == "P") & F.substring("o_orderpriority", 1, 1).isin("4", "5")),
                F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(APPROVAL_HOURS)),
            ).alias("order_approved_at"),
            (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(ESTIMATE_DAYS))).alias(
                "order_estimated_delivery_date"
            ),
        )
        if not lifecycle:
            return base
        shipped = (
            self.lines()
            .groupBy(F.col("l_orderkey").alias("order_id"))
            .agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        )
        status = F.col("order_status")
        return base.join(shipped, "order_id", "left").select(
            *base.columns,
            F.when(status != "processing", F.col("first_ship")).alias("order_delivered_carrier_date"),
            F.when(status == "delivered", F.col("last_ship")).alias("order_delivered_customer_date"),
        )

    def order_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        return self.lines().select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            price.alias("price"),
            (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("freight_value"),
        )

    def customers(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", "n_name")
        return (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("customer_id"),
                F.col("c_custkey").alias("customer_unique_id"),
                F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"),
                F.col("n_name").alias("customer_state"),
            )
        )

    def sellers(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", "n_name")
        return (
            self.raw("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("seller_id"),
                F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"),
                F.col("n_name").alias("seller_state"),
            )
        )

    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
            F.col("p_size").alias("product_weight_g"),
            F.col("p_size").alias("product_length_cm"),
            F.col("p_retailprice").alias("product_height_cm"),
            F.lit(1).alias("product_width_cm"),
        )

    def category_translation(self) -> DataFrame:
        names = pa.table(
            {
                "product_category_name": [source for source, _ in CATEGORY_NAMES],
                "product_category_name_english": [english for _, english in CATEGORY_NAMES],
            }
        )
        return self.spark.createDataFrame(names)

    def order_reviews(self, comments: bool = True) -> DataFrame:
        """One review per order; without ``comments`` no join with the documents."""
        base = self.raw("orders").select(
            F.col("o_orderkey").alias("review_id"),
            F.col("o_orderkey").alias("order_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"),
        )
        if not comments:
            return base
        texts = self.raw("documents").select(
            F.col("doc_id").alias("order_id"), F.col("text").alias("review_comment_message")
        )
        return base.join(texts, "order_id", "left")

    def order_payments(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("payment_value"),
        )

    def geolocation(self) -> DataFrame:
        """Supplier sites as located zip prefixes."""
        return self.raw("supplier").select(
            F.col("s_nationkey").cast("string").alias("geolocation_zip_code_prefix"),
            F.col("s_acctbal").alias("geolocation_lat"),
            F.col("s_suppkey").cast("double").alias("geolocation_lng"),
        )

    def regions(self) -> DataFrame:
        """Region of every state."""
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("customer_state"), F.col("r_name").alias("regiao"))
        )

    def tables(self, lifecycle: bool = True, comments: bool = True) -> LazyTables:
        """All tables by name; only those asked for are opened."""
        return LazyTables(
            {
                "customers": self.customers,
                "orders": lambda: self.orders(lifecycle),
                "delivered_orders": lambda: self.orders(lifecycle, "F"),
                "order_items": self.order_items,
                "order_payments": self.order_payments,
                "order_reviews": lambda: self.order_reviews(comments),
                "products": self.products,
                "sellers": self.sellers,
                "geolocation": self.geolocation,
                "category_translation": self.category_translation,
            }
        )

    # The event stream as a second source of orders.

    def event_orders(self) -> DataFrame:
        """Visits (user and day) that signed up, as orders passing the funnel stages."""

        def first(kind: str) -> F.Column:
            return F.min(F.when(F.col("event_type") == kind, F.col("ts")))

        visits = (
            self.raw("events")
            .filter(F.col("event_type").isin("signup", "view", "click", "purchase"))
            .groupBy("user_id", F.to_date("ts").alias("visit_day"))
            .agg(
                first("signup").alias("order_purchase_timestamp"),
                first("view").alias("order_approved_at"),
                first("click").alias("order_delivered_carrier_date"),
                first("purchase").alias("order_delivered_customer_date"),
            )
            .filter(F.col("order_purchase_timestamp").isNotNull())
        )
        delivered = F.col("order_delivered_customer_date").isNotNull()
        return visits.withColumn(
            "order_status", F.when(delivered, F.lit("delivered")).otherwise(F.lit("created"))
        )

    def event_sales(self) -> dict[str, DataFrame]:
        """Each event as a one-item order; purchases count as delivered."""
        events = self.raw("events")
        status = F.when(F.col("event_type") == "purchase", F.lit("delivered")).otherwise(F.lit("created"))
        return {
            "orders": events.select(
                F.col("event_id").alias("order_id"),
                status.alias("order_status"),
                F.col("ts").alias("order_purchase_timestamp"),
            ),
            "order_items": events.select(
                F.col("event_id").alias("order_id"),
                F.col("value").cast("decimal(10,2)").alias("price"),
                F.lit(0).cast("decimal(10,2)").alias("freight_value"),
            ),
        }
