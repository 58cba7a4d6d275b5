"""Review scores: distribution, promoter score, categories, delays and words."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quitanda.functions.semantics import bucket_label, day_boundaries, mean, percent, ratio, round_double
from quitanda.functions.skew import salted_join
from quitanda.operators.base import Tables, delivered, delivered_orders, product_labels, review_totals

# Delay ranges in days.
DELAY_BUCKETS = (
    (None, 0, "No prazo ou antes"),
    (1, 3, "1-3 dias"),
    (4, 7, "4-7 dias"),
    (8, 14, "8-14 dias"),
    (15, 30, "15-30 dias"),
)
DELAY_OTHER = "Mais de 30 dias"
MIN_CATEGORY_REVIEWS = 2
TOP_WORDS = 10

# Function words left out of word counts.
STOP_WORDS = (
    "a o e de da do das dos em no na nos nas um uma para por com que se foi ser muito mais mas "
    "ao aos as os meu minha eu ele ela the and of to in is it le la les de des un une et der die das und el los"
).split()


def review_distribution(tables: Tables) -> DataFrame:
    """Reviews and share of reviews per score."""
    counts = tables["order_reviews"].groupBy(F.col("review_score").alias("score")).agg(
        F.count("*").alias("contagem")
    )
    total = counts.agg(F.sum("contagem")).scalar()
    return counts.select("score", "contagem", percent(F.col("contagem"), total).alias("percentual"))


def _promoter_counts(weight: Column | None = None) -> list[Column]:
    """Promoters (5), neutrals (3-4) and detractors (the rest, unknown scores too)."""
    score = F.col("review_score")
    kind = F.when(score == 5, F.lit(1)).when(score >= 3, F.lit(0)).otherwise(F.lit(-1))
    if weight is None:
        count = F.count_if
        total = F.count("*")
    else:
        def count(condition: Column) -> Column:
            return F.sum(F.when(condition, weight).otherwise(F.lit(0)))

        total = F.sum(weight)
    return [
        count(kind == 1).alias("promotores"),
        count(kind == 0).alias("neutros"),
        count(kind == -1).alias("detratores"),
        total.alias("total"),
    ]


def _promoter_shares() -> list[Column]:
    total = F.col("total")
    promoters = ratio(F.col("promotores") * F.lit(100.0), total)
    detractors = ratio(F.col("detratores") * F.lit(100.0), total)
    return [
        round_double(promoters, 2).alias("pct_promotores"),
        round_double(detractors, 2).alias("pct_detratores"),
        round_double(promoters - detractors, 2).alias("nps"),
    ]


def nps(tables: Tables) -> DataFrame:
    """Net promoter score over all reviews."""
    return tables["order_reviews"].agg(*_promoter_counts()).select("*", *_promoter_shares())


def _per_category(tables: Tables, per_order: DataFrame) -> DataFrame:
    """Counts per reviewed order summed up per category, once per item of the order.

    Reviews are reduced per order and the result per product before labels
    join, so neither a hot order nor a hot product multiplies rows.
    """
    sums = [c for c in per_order.columns if c != "order_id"]
    items = tables["order_items"].select("order_id", "product_id")
    per_product = (
        salted_join(items, delivered_orders(tables).join(per_order, "order_id"), "order_id", ["product_id"])
        .groupBy("product_id")
        .agg(*(F.sum(c).alias(c) for c in sums))
    )
    return (
        per_product.join(product_labels(tables), "product_id")
        .groupBy("categoria")
        .agg(*(F.sum(c).alias(c) for c in sums))
    )


def category_review_scores(tables: Tables, minimum: int = MIN_CATEGORY_REVIEWS) -> DataFrame:
    """Scores per category, one observation per item and review of delivered orders.

    """
    per_category = _per_category(tables, review_totals(tables)).filter(F.col("reviews") >= minimum)
    return per_category.select(
        "categoria",
        F.col("reviews").alias("total_reviews"),
        round_double(mean(F.col("score_sum"), F.col("scored")), 2).alias("score_medio"),
        F.col("positive").alias("reviews_positivas"),
        F.col("negative").alias("reviews_negativas"),
    )


def reviewed_deliveries(tables: Tables) -> DataFrame:
    """Delivered orders with both dates and reviews: delay in days and review totals."""
    arrived, promised = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    orders = delivered(tables).filter(arrived.isNotNull() & promised.isNotNull())
    return orders.select("order_id", day_boundaries(promised, arrived).alias("dias_atraso")).join(
        review_totals(tables), "order_id"
    )


def delay_vs_score(
    tables: Tables,
    buckets: Sequence[tuple[int | None, int | None, str]] = DELAY_BUCKETS,
    other: str = DELAY_OTHER,
) -> DataFrame:
    """Reviews and mean score by days from estimated to actual delivery."""
    days = F.col("dias_atraso")
    return (
        reviewed_deliveries(tables)
        .groupBy(bucket_label(days, buckets, other).alias("faixa_atraso"))
        .agg(
            F.sum("reviews").alias("contagem"),
            round_double(mean(F.sum("score_sum"), F.sum("scored")), 2).alias("score_medio"),
            F.min(days).alias("min_dias"),
            F.max(days).alias("max_dias"),
        )
    )


def review_comment_share(tables: Tables) -> DataFrame:
    """Reviews with and without a comment."""
    message = F.col("review_comment_message")
    counts = tables["order_reviews"].agg(
        F.count_if(message != "").alias("com_comentario"),
        F.count_if(message.isNull() | (message == "")).alias("sem_comentario"),
        F.count("*").alias("total"),
    )
    return counts.withColumn("pct_com_comentario", percent(F.col("com_comentario"), F.col("total")))


def nps_from_distribution(tables: Tables) -> DataFrame:
    """Promoter score read off the rounded score shares, with its label."""
    share = F.col("percentual") / F.lit(100.0)

    def part(*scores: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("score").isin(*scores), share)), F.lit(0.0))

    parts = review_distribution(tables).agg(
        part(5).alias("promotores"), part(3, 4).alias("neutros"), part(1, 2).alias("detratores")
    )
    # Rounds half up, toward positive infinity.
    score = F.floor((F.col("promotores") - F.col("detratores")) * F.lit(100.0) + F.lit(0.5))
    rated = parts.withColumn("nps", score)
    label = (
        F.when(F.col("nps") > 50, F.lit("Excelente"))
        .when(F.col("nps") > 25, F.lit("Bom"))
        .when(F.col("nps") > 0, F.lit("Regular"))
        .otherwise(F.lit("Crítico"))
    )
    return rated.select(
        *(round_double(F.col(c), 4).alias(c) for c in ("promotores", "neutros", "detratores")),
        "nps",
        label.alias("classificacao"),
    )


def score_bands(tables: Tables, minimum: int = MIN_CATEGORY_REVIEWS) -> DataFrame:
    """Categories with the band of their mean score."""
    score = F.col("score_medio")
    band = F.when(score >= 4.0, F.lit("alto")).when(score >= 3.5, F.lit("medio")).otherwise(F.lit("baixo"))
    return category_review_scores(tables, minimum).select("categoria", "score_medio", band.alias("faixa_score"))


def nps_by_category(tables: Tables) -> DataFrame:
    """Promoter score per category, one observation per item and review of delivered orders."""
    per_order = tables["order_reviews"].groupBy("order_id").agg(*_promoter_counts())
    return _per_category(tables, per_order).select("*", *_promoter_shares())


def word_frequency(
    tables: Tables, top: int = TOP_WORDS, stop_words: Iterable[str] = STOP_WORDS, shortest: int = 2
) -> DataFrame:
    """Most frequent words of positive (4-5) and negative (1-2) reviews.

    Words are counted with partial aggregation right after the split; only the
    counts are ranked.
    """
    score = F.col("review_score")
    group = F.when(score >= 4, F.lit("positiva")).when(score <= 2, F.lit("negativa"))
    words = F.split(F.regexp_replace(F.lower("review_comment_message"), r"[^\p{L}]+", " "), " ")
    counts = (
        tables["order_reviews"]
        .select(group.alias("faixa"), F.explode(words).alias("palavra"))
        .filter(F.col("faixa").isNotNull() & (F.length("palavra") >= shortest))
        .filter(~F.col("palavra").isin(*stop_words))
        .groupBy("faixa", "palavra")
        .agg(F.count("*").alias("contagem"))
    )
    order = Window.partitionBy("faixa").orderBy(F.col("contagem").desc(), F.col("palavra"))
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("faixa", "palavra", "contagem")
    )
