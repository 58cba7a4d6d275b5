"""Session and a small marketplace whose rows hit the edges of the definitions."""

from __future__ import annotations

import sys
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from quitanda.schemas import table_schema  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def money(text: str) -> Decimal:
    return Decimal(text)


CUSTOMERS = [
    # customer_id, person, zip (leading zero), city, state
    ("c1", "p1", "01001", "a", "SP"),
    ("c2", "p1", "01001", "a", "SP"),  # the same person, another customer_id
    ("c3", "p2", "02002", "b", "RJ"),
    ("c4", "p3", "03003", "c", "MG"),  # state without sellers
    ("c5", "p4", "01001", "a", "SP"),
    ("c6", "p5", "99999", "x", "SP"),  # zip that geolocation lacks
]

ORDERS = [
    # order, customer, status, purchase, approved, carrier, delivered, estimated
    ("o1", "c1", "delivered", "2017-01-31 00:59:00", "2017-01-31 01:01:00", "2017-02-01 10:00:00",
     "2017-02-05 10:00:00", "2017-02-10 00:00:00"),
    ("o2", "c2", "delivered", "2017-03-05 23:30:00", "2017-03-06 00:10:00", "2017-03-08 10:00:00",
     "2017-03-21 00:01:00", "2017-03-20 23:59:00"),  # one minute late is one day late
    ("o3", "c3", "delivered", "2017-03-06 09:00:00", "2017-03-06 10:00:00", "2017-03-07 10:00:00",
     "2017-03-05 08:00:00", "2017-03-20 00:00:00"),  # delivered before the purchase
    ("o4", "c4", "delivered", "2017-03-07 09:00:00", None, None, None, "2017-03-30 00:00:00"),  # no dates
    ("o5", "c5", "canceled", "2017-04-01 09:00:00", "2017-04-01 10:00:00", None, None, "2017-04-20 00:00:00"),
    ("o6", "c5", "delivered", "2017-05-01 09:00:00", "2017-05-01 10:00:00", "2017-05-02 10:00:00",
     "2017-07-15 10:00:00", "2017-05-20 00:00:00"),  # 75 days, 56 late
    ("o7", "c6", "shipped", "2017-05-02 09:00:00", "2017-05-02 10:00:00", "2017-05-03 10:00:00", None,
     "2017-05-20 00:00:00"),
    ("o8", "c6", "delivered", "2017-05-03 09:00:00", "2017-05-03 10:00:00", "2017-05-04 10:00:00",
     "2017-05-13 10:00:00", "2017-05-20 00:00:00"),  # delivered, but without items
]

ITEMS = [
    # order, number, product, seller, limit, price, freight
    ("o1", 1, "a", "s1", None, "100.00", "10.00"),
    ("o1", 2, "b", "s1", None, "50.00", "5.00"),
    ("o1", 3, "c", "s2", None, "0.00", "0.00"),  # nothing to divide by
    ("o2", 1, "d", "s2", None, "20.00", "7.50"),
    ("o3", 1, "a", "s1", None, "80.00", "20.00"),
    ("o4", 1, "e", "s1", None, "10.00", "30.00"),
    ("o5", 1, "a", "s1", None, "500.00", "1.00"),
    ("o6", 1, "b", "s2", None, "33.33", "3.33"),
    ("o7", 1, "a", "s1", None, "70.00", "2.00"),
    ("orphan", 1, "a", "s1", None, "1.00", "1.00"),
]

REVIEWS = [
    # review, order, score, title, message, created, answered
    ("r1", "o1", 5, None, "muito bom", None, None),
    ("r2", "o1", 2, None, None, None, None),  # second review of one order
    ("r3", "o2", 1, None, "chegou atrasado, muito ruim", None, None),
    ("r4", "o3", 4, None, "", None, None),
    ("r5", "o5", None, None, "cancelado", None, None),  # no score
    ("r6", "o6", 3, None, None, None, None),
    ("r7", "nowhere", 5, None, "bom", None, None),
]

PRODUCTS = [
    # product, category, name, description, photos, weight, length, height, width
    ("a", "moveis", 1, 1, 1, 100, 10, 20, 30),
    ("b", "moda", 1, 1, 1, 200, None, 20, 30),  # listed twice in the translation
    ("c", None, 1, 1, 1, 300, 1, 1, 1),  # no category
    ("d", "sem_par", 1, 1, 1, None, 2, 2, 2),  # no translation, no weight
    ("e", "vazio", 1, 1, 1, 50, 5, 5, 5),  # empty translation
]

TRANSLATION = [
    ("moveis", "furniture"), ("moda", "fashion"), ("moda", "fashion"), ("vazio", None), ("outro", "furniture"),
]

SELLERS = [("s1", "01001", "a", "SP"), ("s2", "04004", "d", "BA"), ("s3", "04004", "d", "BA")]

PAYMENTS = [("o1", 1, "credit_card", 3, "165.00"), ("lost", 1, "boleto", 1, "9.00")]

GEOLOCATION = [
    ("01001", -23.5, -46.6, "a", "SP"), ("01001", -23.7, -46.8, "a", "SP"), ("02002", -22.9, -43.2, "b", "RJ"),
    ("03003", -19.9, -43.9, "c", "MG"), ("04004", -12.9, -38.5, "d", "BA"),
]


def _rows() -> dict[str, list[tuple]]:
    return {
        "customers": CUSTOMERS,
        "orders": [(*row[:3], *map(at, row[3:])) for row in ORDERS],
        "order_items": [(*row[:5], money(row[5]), money(row[6])) for row in ITEMS],
        "order_payments": [(*row[:4], money(row[4])) for row in PAYMENTS],
        "order_reviews": REVIEWS,
        "products": PRODUCTS,
        "sellers": SELLERS,
        "geolocation": GEOLOCATION,
        "category_translation": TRANSLATION,
    }


@pytest.fixture(scope="session")
def tables(spark):
    return {name: spark.createDataFrame(rows, table_schema(name)) for name, rows in _rows().items()}


def by(df, *keys):
    """Rows as a dictionary on one or several columns."""
    return {tuple(row[k] for k in keys) if len(keys) > 1 else row[keys[0]]: row for row in df.collect()}
