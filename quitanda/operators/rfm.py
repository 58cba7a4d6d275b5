"""Recency, frequency and monetary value of customers: scores, segments and distributions."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from quitanda.functions.ranking import tile_of
from quitanda.functions.selection import quantile_ranks, rows_at_ranks, series_sizes, tile_starts
from quitanda.functions.semantics import NUMERIC, mean, money, percent, round_double
from quitanda.operators.base import Tables, delivered_totals
from quitanda.session import durable

TILES = 5
MEASURES = ("recency", "frequency", "monetary")

# Segments, first match wins.  Bounds are (lowest, highest) score
# for recency, frequency and monetary; None leaves a score free.
SEGMENTS = (
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal", (3, 5), (3, 5), None),
    ("New Customers", (4, 5), (1, 2), None),
    ("Promising", (3, 5), (1, 2), (3, 5)),
    ("At Risk", (1, 2), (3, 5), None),
    ("Need Attention", (1, 2), (1, 2), (3, 5)),
    ("Lost", (1, 1), (1, 1), (1, 1)),
)
SEGMENT_OTHER = "Hibernating"

# Histogram ranges per measure, (lowest, below, label).
HISTOGRAM_BINS = {
    "recency": (
        (None, 31, "0–30"),
        (31, 91, "31–90"),
        (91, 181, "91–180"),
        (181, 361, "181–360"),
        (361, 541, "361–540"),
        (541, None, "541+"),
    ),
    "frequency": ((None, 2, "1"), (2, 3, "2"), (3, 4, "3"), (4, 6, "4–5"), (6, None, "6+")),
    "monetary": (
        (None, 50, "< R$50"),
        (50, 100, "R$50–100"),
        (100, 200, "R$100–200"),
        (200, 500, "R$200–500"),
        (500, 1000, "R$500–1k"),
        (1000, None, "R$1k+"),
    ),
}


def customer_metrics(tables: Tables) -> DataFrame:
    """Recency, frequency and monetary value of every person with a delivered order.

    Orders are reduced per ``customer_id`` before the customers join and per
    person after it, so a buyer with a large part of all orders never lands in
    one task as raw rows.
    """
    per_customer = (
        delivered_totals(tables, "customer_id", "order_purchase_timestamp")
        .groupBy("customer_id")
        .agg(
            F.countDistinct("order_id").alias("orders"),
            F.max("order_purchase_timestamp").alias("last_purchase"),
            F.sum("order_value").alias("value"),
        )
    )
    people = tables["customers"].select("customer_id", "customer_unique_id")
    newest = tables["orders"].agg(F.date_add(F.max("order_purchase_timestamp").cast("date"), 1)).scalar()
    return (
        per_customer.join(people, "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            F.max("last_purchase").alias("last_purchase"),
            F.sum("orders").alias("frequency"),
            money(F.sum("value")).alias("monetary"),
        )
        .select(
            "customer_unique_id",
            F.datediff(newest, F.col("last_purchase")).cast("long").alias("recency"),
            "frequency",
            "monetary",
        )
    )


def segment_of(scores: Sequence[str] = ("r_score", "f_score", "m_score")) -> Column:
    """Segment of a row of scores."""
    label: Column | None = None
    for name, *bounds in SEGMENTS:
        inside = F.lit(True)
        for score, bound in zip(scores, bounds, strict=True):
            if bound is not None:
                inside = inside & F.col(score).between(*bound)
        label = F.when(inside, F.lit(name)) if label is None else label.when(inside, F.lit(name))
    return label.otherwise(F.lit(SEGMENT_OTHER))


def _thousandths(key: Column) -> Column:
    """A measure's sort key as a whole number."""
    return (key * 1000).cast("long")


def _value_key(measure: str) -> Column:
    return F.col(measure).cast(NUMERIC)


def _score_key(measure: str) -> Column:
    """Ascending key of a score: most recent people last, unknown values after them."""
    value = -F.col(measure) if measure == "recency" else F.col(measure)
    return F.coalesce(value.cast(NUMERIC), F.lit(Decimal("999999999999999.999")).cast(NUMERIC))


def quintile_scores(metrics: DataFrame) -> DataFrame:
    """Scores by the first row of every tile; these rows are found by counting, so no row is sorted."""
    metrics = durable(metrics)
    keys = {m: _thousandths(_score_key(m)) for m in MEASURES}
    sizes = series_sizes(metrics, keys)
    starts = {m: tile_starts(sizes[m][0], TILES) if m in sizes else [] for m in MEASURES}
    found = rows_at_ranks(metrics, keys, starts, sizes, "customer_unique_id")

    kind = metrics.schema["customer_unique_id"].dataType

    def score(measure: str) -> Column:
        bounds = [found[measure][rank] for rank in starts[measure]]
        rows = [F.struct(F.lit(key).cast("long"), F.lit(person).cast(kind)) for key, person in bounds]
        return tile_of(F.array(*rows), TILES, keys[measure], F.col("customer_unique_id")) if rows else F.lit(1)

    return metrics.select("*", *(score(m).alias(f"{m[0]}_score") for m in MEASURES))


def rfm_scores(tables: Tables) -> DataFrame:
    """Measures, quintile scores and segment of every person; ties go by person id."""
    return quintile_scores(customer_metrics(tables)).withColumn("segmento", segment_of())


def segment_profile(scores: DataFrame) -> DataFrame:
    """Size and mean profile of every segment of already scored people."""
    counts = scores.groupBy("segmento").agg(
        F.count("*").alias("contagem"),
        *(F.sum(c).alias(c) for c in (*MEASURES, "r_score", "f_score", "m_score")),
    )
    n = F.col("contagem")
    # One row per segment: the window holds a handful of rows.
    total = F.sum("contagem").over(Window.partitionBy())

    def average(column: str, digits: int) -> Column:
        return round_double(mean(F.col(column), n), digits)

    return counts.select(
        "segmento",
        "contagem",
        percent(n, total).alias("percentual"),
        average("recency", 1).alias("recencia_media"),
        average("frequency", 2).alias("frequencia_media"),
        money(mean(F.col("monetary"), n)).alias("monetario_medio"),
        average("r_score", 2).alias("r_score_medio"),
        average("f_score", 2).alias("f_score_medio"),
        average("m_score", 2).alias("m_score_medio"),
    )


def rfm_segments(tables: Tables) -> DataFrame:
    """Segment profile over ``rfm_scores``."""
    return segment_profile(rfm_scores(tables))


def summarize_measures(metrics: DataFrame) -> DataFrame:
    """Extremes, mean, spread and quartiles of each measure; rows at the quartiles are found by counting."""
    metrics = durable(metrics)
    keys = {m: _thousandths(_value_key(m)) for m in MEASURES}
    sizes = series_sizes(metrics, keys)
    points = [0.25, 0.5, 0.75]
    places = {m: quantile_ranks(sizes[m][0], points) for m in sizes}
    ranks = {m: sorted({r for low, _ in places[m] for r in (low, min(low + 1, sizes[m][0]))}) for m in sizes}
    found = rows_at_ranks(metrics, keys, ranks, sizes)

    def quantile(measure: str, low: int, weight: float) -> float:
        below = found[measure][low][0] / 1000
        return below + weight * (found[measure][min(low + 1, sizes[measure][0])][0] / 1000 - below)

    quartiles = [(m, *(quantile(m, low, weight) for low, weight in places[m])) for m in sizes]
    quartiles = metrics.sparkSession.createDataFrame(quartiles, "measure string, q1 double, median double, q3 double")
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), _value_key(m).cast("double").alias("key")) for m in MEASURES))
    rows = metrics.select(F.inline(rows)).filter("key IS NOT NULL")
    stats = rows.groupBy("measure").agg(F.min("key").alias("min"), F.max("key").alias("max"), F.avg("key").alias("media"), F.stddev_samp("key").alias("std"))
    return stats.join(F.broadcast(quartiles), "measure").select(
        "measure",
        *(
            round_double(F.col(value), 2).alias(name)
            for name, value in (
                ("min", "min"), ("max", "max"), ("media", "media"), ("mediana", "median"), ("std", "std"), ("q1", "q1"), ("q3", "q3")
            )
        ),
    )


def rfm_summary_stats(tables: Tables) -> DataFrame:
    """Summary of each measure over all scored people."""
    return summarize_measures(customer_metrics(tables))


def rfm_histograms(tables: Tables) -> DataFrame:
    """People per range of each measure; ranges without people are left out."""
    metrics = customer_metrics(tables)

    def label(measure: str) -> Column:
        value = F.col(measure)
        text: Column | None = None
        for low, below, name in HISTOGRAM_BINS[measure]:
            inside = F.lit(True)
            if low is not None:
                inside = inside & (value >= low)
            if below is not None:
                inside = inside & (value < below)
            text = F.when(inside, F.lit(name)) if text is None else text.when(inside, F.lit(name))
        return text

    rows = F.array(
        *(F.struct(F.lit(m).alias("measure"), label(m).alias("faixa")) for m in MEASURES)
    )
    return (
        metrics.select(F.inline(rows))
        .groupBy("measure", "faixa")
        .agg(F.count("*").alias("contagem"))
    )


def rfm_correlation(tables: Tables) -> DataFrame:
    """Pearson correlation of every pair of measures."""
    metrics = customer_metrics(tables).select(*(F.col(m).cast("double").alias(m) for m in MEASURES))
    pairs = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
    totals = metrics.agg(*(F.corr(a, b).alias(f"{a}_{b}") for a, b in pairs))
    rows = F.array(
        *(
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), round_double(F.col(f"{a}_{b}"), 4).alias("pearson"))
            for a, b in pairs
        )
    )
    return totals.select(F.inline(rows))
