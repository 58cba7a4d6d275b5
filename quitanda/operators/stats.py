"""Hypothesis tests, correlations and outliers as one-row or flagged DataFrames.

Samples are reduced to counts per distinct value, so a value shared by most
rows is one row; what is left to rank is range-partitioned.  P-values are
computed on the single resulting row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quitanda.functions import probability
from quitanda.functions.ranking import (
    quantiles,
    row_numbers,
    running_sums,
)
from quitanda.functions.semantics import ratio, round_double
from quitanda.operators.base import Tables, delivered, item_value
from quitanda.operators.geo import geo_state_metrics
from quitanda.operators.reviews import reviewed_deliveries
from quitanda.session import durable

ALPHA = 0.05

# Test names, texts and effect-size labels (upper bound, label).
MANN_WHITNEY = "Mann-Whitney U"
WELCH = "Welch t-test"
SPEARMAN = "Spearman"
PEARSON = "Pearson"
CHI_SQUARE = "Chi-quadrado"
INSUFFICIENT = "Amostra insuficiente"
COHEN_LABELS = ((0.2, "negligivel"), (0.5, "pequeno"), (0.8, "medio"), (None, "grande"))
RANK_LABELS = ((0.1, "negligivel"), (0.3, "pequeno"), (0.5, "medio"), (None, "grande"))


def two_samples(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One column of each frame as the two groups of a test."""
    def side(df: DataFrame, first: bool) -> DataFrame:
        return df.select(F.col(value).cast("double").alias("value"), F.lit(first).alias("in_a"))

    return side(a, True).unionByName(side(b, False))


def labeled_samples(df: DataFrame, value: Column, in_a: Column, weight: Column | None = None) -> DataFrame:
    """Rows as the two groups of a test; ``in_a`` NULL leaves a row out."""
    columns = [value.cast("double").alias("value"), in_a.alias("in_a")]
    if weight is not None:
        columns.append(weight.alias("weight"))
    return df.select(*columns).filter(F.col("in_a").isNotNull())


def as_record(result: DataFrame) -> dict:
    """The only row of a result as a dictionary."""
    return result.first().asDict(recursive=True)


def rank_totals(samples: DataFrame) -> DataFrame:
    """One row: group sizes, U of the first group and the tie term.

    U is the number of (a, b) pairs with a above b, ties counting half.  Each
    range partition of distinct values sums its own pairs; pairs across
    partitions follow from the partition totals.
    """
    weight = F.col("weight") if "weight" in samples.columns else F.lit(1)
    known = samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = known.groupBy("value").agg(
        F.sum(F.when(F.col("in_a"), weight).otherwise(F.lit(0))).alias("a"),
        F.sum(F.when(F.col("in_a"), F.lit(0)).otherwise(weight)).alias("b"),
    )
    placed = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id())
    below = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    tied = (F.col("a") + F.col("b")).cast("double")
    parts = (
        placed.withColumn("below", F.coalesce(F.sum("b").over(below), F.lit(0)))
        .groupBy("part")
        .agg(
            F.sum("a").alias("a"),
            F.sum("b").alias("b"),
            F.sum(F.col("a") * (F.col("below") + F.col("b") / F.lit(2.0))).alias("u"),
            F.sum(tied * tied * tied - tied).alias("ties"),
        )
    )
    # One row per partition from here on.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifted = parts.withColumn("shift", F.coalesce(F.sum("b").over(earlier), F.lit(0)))
    zero = F.lit(0).cast("long")
    return shifted.agg(
        F.coalesce(F.sum("a"), zero).alias("n_a"),
        F.coalesce(F.sum("b"), zero).alias("n_b"),
        F.sum(F.col("u") + F.col("a").cast("double") * F.col("shift")).alias("u"),
        F.sum("ties").alias("ties"),
    )


# Shipped by value: workers need no copy of the package for these small functions.
cloudpickle.register_pickle_by_value(probability)
_mann_whitney_p = F.udf(probability.mann_whitney_p, T.DoubleType(), useArrow=False)
_student_p = F.udf(probability.student_p, T.DoubleType(), useArrow=False)
_chi_square_p = F.udf(probability.chi_square_p, T.DoubleType(), useArrow=False)


def _enough() -> Column:
    return (F.col("n_a") >= 2) & (F.col("n_b") >= 2)


def _test_record(test: str, statistic: str, effect: str, alpha: float) -> list[Column]:
    """Result columns; those that need two observations per group are NULL without them."""
    enough = _enough()
    return [
        F.lit(test).alias("teste_usado"),
        F.when(enough, round_double(F.col(statistic), 4)).alias(statistic),
        F.when(enough, round_double(F.col("p"), 6)).alias("p_value"),
        F.when(enough, F.coalesce(F.col("p") < alpha, F.lit(False))).alias("significativo"),
        F.when(enough, round_double(F.col(effect), 4)).alias(effect),
        "n_a",
        "n_b",
        F.lit(float(alpha)).alias("alpha"),
        F.when(~enough, F.lit(INSUFFICIENT)).alias("mensagem"),
    ]


def mann_whitney(samples: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Two-sided Mann-Whitney U test of two groups, with the rank-biserial effect."""
    pairs = F.col("n_a").cast("double") * F.col("n_b")
    return (
        rank_totals(samples)
        .withColumn("p", _mann_whitney_p("u", "n_a", "n_b", "ties"))
        .withColumn("u_statistic", F.col("u"))
        .withColumn("tamanho_efeito", F.lit(1.0) - ratio(F.lit(2.0) * F.col("u"), pairs))
        .select(*_test_record(MANN_WHITNEY, "u_statistic", "tamanho_efeito", alpha))
    )


def welch_t_test(samples: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Welch's t test of two groups, with Cohen's d on the pooled deviation."""
    known = samples.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    a, b = F.when(F.col("in_a"), F.col("value")), F.when(~F.col("in_a"), F.col("value"))
    moments = known.agg(
        *(
            column.alias(f"{name}_{side}")
            for side, sample in (("a", a), ("b", b))
            for name, column in (
                ("n", F.count(sample)), ("mean", F.avg(sample)), ("var", F.var_samp(sample))
            )
        )
    )
    gap = F.col("mean_a") - F.col("mean_b")
    share_a, share_b = ratio(F.col("var_a"), F.col("n_a")), ratio(F.col("var_b"), F.col("n_b"))
    spread = F.sqrt(share_a + share_b)
    # Without spread a gap is infinitely many errors wide, and no gap is undefined.
    t = F.when(spread > 0, ratio(gap, spread)).when(gap != 0, F.signum(gap) * F.lit(float("inf")))
    freedom = ratio(
        (share_a + share_b) * (share_a + share_b),
        ratio(share_a * share_a, F.col("n_a") - 1) + ratio(share_b * share_b, F.col("n_b") - 1),
    )
    pooled = F.sqrt(
        ratio(
            (F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"),
            F.col("n_a") + F.col("n_b") - 2,
        )
    )
    return (
        moments.withColumn("t", t)
        .withColumn("p", _student_p("t", F.coalesce(freedom, F.lit(1.0))))
        .withColumn("t_statistic", F.col("t"))
        .withColumn("cohens_d", F.when(pooled > 0, ratio(gap, pooled)).otherwise(F.lit(0.0)))
        .select(*_test_record(WELCH, "t_statistic", "cohens_d", alpha))
    )


def _effect_label(size: Column, labels: Sequence[tuple[float | None, str]]) -> Column:
    text: Column | None = None
    for below, name in labels:
        if below is None:
            return text.otherwise(F.lit(name))
        inside = F.abs(size) < below
        text = F.when(inside, F.lit(name)) if text is None else text.when(inside, F.lit(name))
    return text


def describe_test_result(result: DataFrame, hypothesis: str) -> DataFrame:
    """Add the hypothesis, a worded conclusion and the premises to a test result."""
    welch = "cohens_d" in result.columns
    effect = F.col("cohens_d" if welch else "tamanho_efeito")
    name = "Cohen's d" if welch else "r"
    label = _effect_label(effect, COHEN_LABELS if welch else RANK_LABELS)
    alpha, sizes = F.col("alpha").cast("string"), F.format_string("n_a=%d, n_b=%d", "n_a", "n_b")
    p = F.format_string("%.4f", "p_value")
    verdict = F.when(
        F.col("significativo"),
        F.concat(
            F.lit("Rejeita H0 (p="), p, F.lit(" < alpha="), alpha,
            F.lit("). Ha diferenca estatisticamente significativa."),
        ),
    ).otherwise(
        F.concat(
            F.lit("Nao rejeita H0 (p="), p, F.lit(" >= alpha="), alpha,
            F.lit("). Nao ha evidencia de diferenca significativa."),
        )
    )
    measured = F.when(
        effect.isNotNull(),
        F.concat(
            F.lit(f" Tamanho do efeito ({name}): "), F.format_string("%.4f", effect), F.lit(" ("), label, F.lit(").")
        ),
    ).otherwise(F.lit(""))
    lacking = F.col("mensagem") == INSUFFICIENT
    opening = (
        "Welch t-test (nao assume variancias iguais)." if welch
        else "Teste nao-parametrico (nao assume normalidade)."
    )
    return (
        result.withColumn("hipotese", F.lit(hypothesis))
        .withColumn(
            "conclusao",
            F.when(
                lacking,
                F.concat(
                    F.lit("Inconclusivo: amostra insuficiente ("), sizes,
                    F.lit("). Minimo de 2 observacoes por grupo."),
                ),
            ).otherwise(F.concat(verdict, measured)),
        )
        .withColumn(
            "premissas",
            F.when(lacking, F.lit("Teste nao executado.")).otherwise(
                F.concat(
                    F.lit(f"{opening} Amostras independentes. n="),
                    (F.col("n_a") + F.col("n_b")).cast("string"), F.lit(" ("), sizes,
                    F.lit("). Nivel de significancia: "), alpha, F.lit("."),
                )
            ),
        )
    )


def _mid_ranks(pairs: DataFrame, value: str, rank: str) -> DataFrame:
    """Mean rank of every distinct value, from counts per value."""
    counts = pairs.groupBy(value).agg(F.sum("weight").alias("rows"))
    ranked = running_sums(counts, [value], ["rows"])
    return ranked.select(value, (F.col("before_rows") + (F.col("rows") + 1) / F.lit(2.0)).alias(rank))


def spearman(df: DataFrame, x: Column, y: Column, weight: Column | None = None, alpha: float = ALPHA) -> DataFrame:
    """Spearman rank correlation over rows where both values are known.

    Rows are reduced to counts per value pair before anything is ranked.
    """
    pairs = (
        df.select(
            x.cast("double").alias("x"), y.cast("double").alias("y"),
            (F.lit(1) if weight is None else weight).alias("weight"),
        )
        .dropna(subset=["x", "y"])
        .groupBy("x", "y")
        .agg(F.sum("weight").alias("weight"))
    )
    pairs = durable(pairs)
    ranked = pairs.join(_mid_ranks(pairs, "x", "rx"), "x").join(_mid_ranks(pairs, "y", "ry"), "y")
    middle = (pairs.agg(F.sum("weight")).scalar() + 1) / F.lit(2.0)
    centred = ranked.select(
        F.col("weight").cast("double").alias("w"), (F.col("rx") - middle).alias("dx"), (F.col("ry") - middle).alias("dy")
    )
    sums = centred.agg(
        F.sum("w").cast("long").alias("n"),
        F.sum(F.col("w") * F.col("dx") * F.col("dy")).alias("xy"),
        F.sum(F.col("w") * F.col("dx") * F.col("dx")).alias("xx"),
        F.sum(F.col("w") * F.col("dy") * F.col("dy")).alias("yy"),
    )
    return _correlation_record(sums.select("n", ratio(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("r")),
                               SPEARMAN, alpha)


def _correlation_record(row: DataFrame, test: str, alpha: float) -> DataFrame:
    """Coefficient with its two-sided p from Student's t."""
    r, freedom = F.col("r"), (F.col("n") - 2).cast("double")
    inside = F.greatest(F.lit(1.0) - r * r, F.lit(0.0))
    t = F.when(inside > 0, r * F.sqrt(freedom / inside)).when(r.isNotNull(), F.lit(float("inf")))
    enough = F.col("n") > 2
    return row.withColumn("p", _student_p(t, freedom)).select(
        F.lit(test).alias("teste_usado"),
        F.when(enough, round_double(F.col("p"), 6)).alias("p_value"),
        F.when(enough, F.coalesce(F.col("p") < alpha, F.lit(False))).alias("significativo"),
        round_double(r, 4).alias("tamanho_efeito"),
        "n",
        F.when(~enough, F.lit(INSUFFICIENT)).alias("mensagem"),
    )


def pearson(df: DataFrame, x: Column, y: Column, alpha: float = ALPHA) -> DataFrame:
    """Pearson correlation over rows where both values are known."""
    known = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).dropna()
    return _correlation_record(known.agg(F.count("*").alias("n"), F.corr("x", "y").alias("r")), PEARSON, alpha)


def chi_square(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    """Pearson chi-square test of independence of two categorical columns.

    Only occupied cells are needed: the statistic is the sum of observed squared
    over expected, less the number of rows.
    """
    cells = durable(df.dropna(subset=[a, b]).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("o")))
    # Margins are sums of partial sums; Spark joins them back by their measured sizes.
    rows = cells.groupBy("_a").agg(F.sum("o").alias("row"))
    columns = cells.groupBy("_b").agg(F.sum("o").alias("column"))
    n = cells.agg(F.sum("o").cast("double")).scalar()
    expected = F.col("row") * F.col("column") / n
    scored = cells.join(rows, "_a").join(columns, "_b").select("o", (F.col("o").cast("double") * F.col("o") / expected).alias("part"))
    labels = lambda side: side.agg(F.count("*")).scalar()
    totals = scored.agg(
        F.sum("o").alias("n"),
        (F.sum("part") - F.sum("o")).alias("x"),
    ).withColumn("graus", (labels(rows) - 1) * (labels(columns) - 1))
    return totals.withColumn("p", _chi_square_p("x", "graus")).select(
        F.lit(CHI_SQUARE).alias("teste_usado"),
        round_double(F.col("x"), 4).alias("chi2"),
        round_double(F.col("p"), 6).alias("p_value"),
        F.coalesce(F.col("p") < alpha, F.lit(False)).alias("significativo"),
        "graus",
        "n",
    )


def outliers_iqr(df: DataFrame, key: str, value: str, width: float = 1.5) -> DataFrame:
    """Rows beyond ``width`` interquartile ranges from the quartiles.

    ``key`` must be unique; with ``value`` it orders the rows totally.
    """
    rows = durable(df.select(key, F.col(value).alias("valor")).dropna(subset=["valor"]))
    points = [0.25, 0.75]
    found = quantiles(row_numbers(rows, ["valor", key]), "valor", [], points)
    bounds = found.select(F.struct(F.get("quantiles", F.lit(0)).alias("q1"), F.get("quantiles", F.lit(1)).alias("q3")))
    limits = rows.withColumn("limits", bounds.scalar())
    q1, q3, x = F.col("limits.q1"), F.col("limits.q3"), F.col("valor").cast("double")
    reach = (q3 - q1) * F.lit(width)
    return limits.filter((x < q1 - reach) | (x > q3 + reach)).select(
        key, "valor", F.when(x < q1, F.lit("abaixo")).otherwise(F.lit("acima")).alias("lado")
    )


def outliers_zscore(df: DataFrame, key: str, value: str, limit: float = 3.0) -> DataFrame:
    """Rows more than ``limit`` standard deviations from the mean."""
    x = F.col(value).cast("double")
    moments = df.select(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))).scalar()
    scored = df.withColumn("moments", moments).withColumn(
        "z", ratio(x - F.col("moments.mean"), F.col("moments.sd"))
    )
    return scored.filter(F.abs("z") > limit).select(
        key, F.col(value).alias("valor"), round_double(F.col("z"), 4).alias("z")
    )


# Tests on the order tables.


def _scores_by_delivery(tables: Tables) -> DataFrame:
    """Reviews of delivered orders per order and score, with the order's delay."""
    late = F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date")
    orders = delivered(tables).filter(late.isNotNull()).select("order_id", late.alias("late"))
    scores = tables["order_reviews"].groupBy("order_id", "review_score").agg(F.count("*").alias("reviews"))
    return orders.join(scores, "order_id")


def delay_score_test(tables: Tables, alpha: float = ALPHA) -> DataFrame:
    """Mann-Whitney test of review scores: late deliveries against those on time."""
    rows = _scores_by_delivery(tables)
    return mann_whitney(labeled_samples(rows, F.col("review_score"), F.col("late"), F.col("reviews")), alpha)


def delay_score_spearman(tables: Tables, alpha: float = ALPHA) -> DataFrame:
    """Spearman correlation of delay in days with the review score."""
    days = reviewed_deliveries(tables).select("order_id", "dias_atraso")
    scores = tables["order_reviews"].groupBy("order_id", "review_score").agg(F.count("*").alias("reviews"))
    return spearman(days.join(scores, "order_id"), F.col("dias_atraso"), F.col("review_score"), F.col("reviews"), alpha)


def freight_score_spearman(tables: Tables, alpha: float = ALPHA) -> DataFrame:
    """Spearman correlation of freight share with mean score over states."""
    return spearman(geo_state_metrics(tables), F.col("frete_percentual"), F.col("review_score_medio"), alpha=alpha)


def freight_median_test(tables: Tables, alpha: float = ALPHA) -> DataFrame:
    """Mann-Whitney test of mean scores: states above the median freight share against the rest."""
    share = F.col("frete_percentual").cast("double")
    # One row per state: the median is a window over a few dozen rows.
    states = geo_state_metrics(tables).withColumn("above", share > F.percentile(share, 0.5).over(Window.partitionBy()))
    return mann_whitney(labeled_samples(states, F.col("review_score_medio"), F.col("above")), alpha)


def order_values(tables: Tables) -> DataFrame:
    """Value of the items of every order."""
    return tables["order_items"].groupBy("order_id").agg(F.sum(item_value()).alias("valor_pedido"))
