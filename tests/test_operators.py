"""Operators on the small marketplace: expected values worked out by hand."""

from datetime import date
from decimal import Decimal

import pytest
from conftest import by
from pyspark.sql import Window, functions as F

from quitanda.operators import cohort, funnel, geo, quality, reviews, rfm, season


# Funnel


def test_funnel_status(tables):
    rows = by(funnel.funnel_status(tables), "status")
    assert {s: (r["contagem"], r["percentual"]) for s, r in rows.items()} == {
        "delivered": (6, 75.0), "canceled": (1, 12.5), "shipped": (1, 12.5),
    }


def test_funnel_conversion(tables):
    rows = funnel.funnel_conversion(tables).collect()
    assert [r["etapa"] for r in rows] == list(funnel.STAGES)
    assert [r["pedidos"] for r in rows] == [8, 7, 6, 6]
    assert [r["taxa_conversao"] for r in rows] == [1.0, 0.875, 0.8571, 1.0]
    # Hours from purchase to approval: 1 (a boundary), 1 (midnight), 1, 1, 1, 1, 1.
    assert rows[0]["tempo_medio_dias"] == 0.0
    assert rows[1]["tempo_medio_dias"] == 0.04


def test_funnel_of_no_orders(tables):
    rows = funnel.funnel_conversion({"orders": tables["orders"].limit(0)}).collect()
    assert [r["pedidos"] for r in rows] == [0, 0, 0, 0]
    assert rows[1]["taxa_conversao"] is None


def test_delivery_times_put_negative_days_in_the_last_bucket(tables):
    rows = by(funnel.delivery_time_buckets(tables), "faixa")
    assert {f: (r["contagem"], r["min_dias"], r["max_dias"]) for f, r in rows.items()} == {
        "0-7 dias": (1, 5, 5), "8-14 dias": (1, 10, 10), "15-30 dias": (1, 16, 16), "30+ dias": (2, -1, 75),
    }
    assert rows["30+ dias"]["media_dias_na_faixa"] == 37.0


def test_funnel_share_of_first_stage(tables):
    assert [r["pct_base"] for r in funnel.funnel_pct_of_first(tables).collect()] == [100.0, 87.5, 75.0, 75.0]


def test_cancellations_by_stage(tables):
    rows = by(funnel.cancel_rate_by_stage(tables), "etapa")
    assert (rows["Aprovacao"]["pedidos"], rows["Aprovacao"]["cancelados"]) == (1, 1)
    assert rows["Compra"]["taxa_cancelamento_pct"] == 0.0


# RFM


def test_customer_metrics(tables):
    rows = by(rfm.customer_metrics(tables), "customer_unique_id")
    assert set(rows) == {"p1", "p2", "p3", "p4"}  # p5 has no items
    # Newest purchase of any status is 2017-05-03; p1 bought twice under two ids.
    assert rows["p1"].asDict() == {
        "customer_unique_id": "p1", "recency": 60, "frequency": 2, "monetary": Decimal("192.50"),
    }
    assert rows["p4"]["recency"] == 3
    assert rows["p4"]["monetary"] == Decimal("36.66")


def test_fewer_customers_than_tiles(tables):
    rows = by(rfm.rfm_scores(tables), "customer_unique_id")
    assert sorted(r["m_score"] for r in rows.values()) == [1, 2, 3, 4]
    assert rows["p4"]["r_score"] == 4
    assert rows["p1"]["f_score"] == 4


def ntile_scores(people):
    """The definition of the scores: NTILE over each measure, ties by person."""
    order = {"recency": F.desc_nulls_last, "frequency": F.asc_nulls_last, "monetary": F.asc_nulls_last}
    tile = lambda m: F.ntile(5).over(Window.orderBy(order[m](m), "customer_unique_id"))
    return people.select("*", *(tile(m).alias(f"{m[0]}_score") for m in rfm.MEASURES))


def test_quintile_scores_equal_ntile(spark, tables):
    few = rfm.customer_metrics(tables)
    assert by(rfm.quintile_scores(few), "customer_unique_id") == by(ntile_scores(few), "customer_unique_id")
    rows = [(f"p{i:04d}", (i * 37) % 50, 1 if i % 3 else 2 + i % 4, Decimal(i * 7919 % 1000) / 100) for i in range(1007)]
    people = spark.createDataFrame(
        rows, "customer_unique_id STRING, recency LONG, frequency LONG, monetary DECIMAL(18,2)"
    ).repartition(5)
    assert by(rfm.quintile_scores(people), "customer_unique_id") == by(ntile_scores(people), "customer_unique_id")


@pytest.mark.parametrize(
    "scores, segment",
    [
        ((5, 5, 5), "Champions"), ((4, 4, 3), "Loyal"), ((3, 3, 1), "Loyal"), ((5, 2, 5), "New Customers"),
        ((3, 2, 3), "Promising"), ((2, 3, 1), "At Risk"), ((1, 1, 3), "Need Attention"), ((1, 1, 1), "Lost"),
        ((2, 1, 1), "Hibernating"), ((3, 1, 2), "Hibernating"),
    ],
)
def test_segments(spark, scores, segment):
    row = spark.createDataFrame([scores], "r_score INT, f_score INT, m_score INT")
    assert row.select(rfm.segment_of()).first()[0] == segment


def test_segment_profile_sums_up(tables):
    rows = rfm.rfm_segments(tables).collect()
    assert sum(r["contagem"] for r in rows) == 4
    assert sum(r["percentual"] for r in rows) == pytest.approx(100)


def test_measure_summary(tables):
    metrics = rfm.customer_metrics(tables)
    found = by(rfm.summarize_measures(metrics), "measure")
    for measure in rfm.MEASURES:
        exact = metrics.select(F.percentile(F.col(measure).cast("double"), [0.25, 0.5, 0.75])).first()[0]
        row = found[measure]
        assert [row["q1"], row["mediana"], row["q3"]] == pytest.approx(exact, abs=0.00501)


def test_histograms_cover_everybody(tables):
    rows = rfm.rfm_histograms(tables).groupBy("measure").agg(F.sum("contagem").alias("n")).collect()
    assert {r["measure"]: r["n"] for r in rows} == {"recency": 4, "frequency": 4, "monetary": 4}


# Cohorts


def test_retention_follows_the_person(tables):
    rows = by(cohort.cohort_retention(tables), "coorte_mes", "periodo")
    january = (date(2017, 1, 1), 2)
    assert rows[january]["clientes_ativos"] == 1
    assert rows[january]["taxa_retencao"] == 1.0
    assert rows[(date(2017, 3, 1), 0)]["tamanho_coorte"] == 2
    assert all(r["taxa_retencao"] == 1.0 for (_, period), r in rows.items() if period == 0)


def test_repurchase(tables):
    row = cohort.cohort_repurchase(tables).first()
    assert (row["total_clientes"], row["clientes_recompra"], row["taxa_recompra_pct"]) == (5, 1, 20.0)
    assert row["media_pedidos_por_cliente"] == 1.2
    assert row["dias_medio_ate_recompra"] == 33.0


def test_nobody_buys_again(tables):
    some = dict(tables) | {"orders": tables["orders"].filter("order_id IN ('o1', 'o3')")}
    assert cohort.cohort_repurchase(some).first()["dias_medio_ate_recompra"] is None


def test_heatmap_is_dense(tables):
    rows = by(cohort.cohort_heatmap(tables), "coorte")
    assert {c: list(r["retencao"]) for c, r in rows.items()} == {
        "2017-01": [1.0, None, 1.0], "2017-03": [1.0, None, None], "2017-05": [1.0, None, None],
    }


def test_retained_customers(tables):
    assert all(r["clientes_retidos"] == 1 for r in cohort.retained_customers(tables).filter("periodo > 0").collect())


# Places


def test_state_metrics_count_items_once_per_review(tables):
    rows = by(geo.geo_state_metrics(tables), "estado")
    assert set(rows) == {"SP", "RJ", "MG"}
    sp = rows["SP"]
    # o1 has two reviews, so its items count twice: 2 * 165 + 27.50 + 36.66.
    assert sp["pedidos"] == 3
    assert sp["receita"] == Decimal("394.16")
    assert sp["ticket_medio"] == Decimal("131.39")
    # Eight item-review rows, of which the two without value have no freight share.
    assert sp["frete_medio"] == Decimal("5.10")
    assert sp["review_score_medio"] == 3.13  # 25 / 8
    assert (sp["total_vendedores"], rows["MG"]["total_vendedores"]) == (1, 0)
    assert rows["MG"]["review_score_medio"] is None


def test_top_categories_merge_labels_and_fan_out(tables):
    rows = by(geo.geo_top_categories(tables), "estado", "categoria")
    # moda is translated twice, so its items count twice in revenue but once in orders.
    assert rows[("SP", "fashion")]["pedidos"] == 2
    assert rows[("SP", "fashion")]["receita"] == Decimal("166.66")
    assert rows[("SP", "furniture")]["receita"] == Decimal("100.00")
    assert ("MG", "vazio") in rows
    assert ("SP", "sem_par") in rows and ("SP", "sem_categoria") not in rows  # fourth by revenue
    assert sum(1 for state, _ in rows if state == "SP") == 3


def test_outlier_flags(tables):
    rows = by(geo.freight_score_outliers(tables), "estado")
    assert all(r["frete_alto"] for r in rows.values())
    assert sum(r["frete_baixo"] for r in rows.values()) == 1


def test_zip_centroids(tables):
    row = by(geo.zip_centroids(tables), "zip")["01001"]
    assert (row["lat"], row["lng"], row["pontos"]) == (pytest.approx(-23.6), pytest.approx(-46.7), 2)


# Seasons


def test_monthly_series_has_rows_not_calendar_months(tables):
    rows = season.monthly_series(tables).orderBy("mes").collect()
    assert [r["mes"] for r in rows] == [date(2017, 1, 1), date(2017, 3, 1), date(2017, 5, 1)]
    assert [r["receita"] for r in rows] == [Decimal("165.00"), Decimal("167.50"), Decimal("36.66")]
    assert [r["media_movel_3m"] for r in rows] == [None, None, Decimal("123.05")]
    assert [r["mom_growth"] for r in rows] == [None, Decimal("0.015"), Decimal("-0.781")]


def test_growth_over_zero_revenue_is_unknown(tables):
    free = dict(tables) | {
        "order_items": tables["order_items"].withColumn("price", F.when(F.col("order_id") != "o1", F.col("price")).otherwise(0))
        .withColumn("freight_value", F.when(F.col("order_id") != "o1", F.col("freight_value")).otherwise(0))
    }
    rows = season.monthly_series(free).orderBy("mes").collect()
    assert (rows[0]["receita"], rows[1]["mom_growth"]) == (Decimal("0.00"), None)


def test_weekdays_average_over_weeks_with_sales(tables):
    rows = by(season.weekday_pattern(tables), "dia_semana")
    assert set(rows) == {0, 1, 2}  # Sunday o2, Mondays o3 and o6, Tuesdays o1 and o4
    assert rows[1]["pedidos_medio"] == 1.0
    assert rows[1]["receita_media"] == Decimal("68.33")


def test_hours(tables):
    rows = by(season.hourly_pattern(tables), "hora")
    assert {h: r["pedidos"] for h, r in rows.items()} == {0: 1, 9: 3, 23: 1}
    peaks = by(season.hour_peaks(tables), "hora")
    assert [h for h, r in sorted(peaks.items()) if r["pico"]] == [0, 9]


def test_decomposition_adds_up(spark):
    months = [(date(2015 + i // 12, i % 12 + 1, 1), 100.0 + i + (10.0 if i % 12 == 5 else 0.0)) for i in range(36)]
    series = spark.createDataFrame([("s", d, v) for d, v in months], "serie STRING, mes DATE, v DOUBLE")
    rows = season.decompose(series, "serie", "mes", "v", F.month("mes"), 12).orderBy("mes").collect()
    assert [r["trend"] is None for r in rows] == [i < 6 or i >= 30 for i in range(36)]
    for r in rows[6:30]:
        assert r["trend"] + r["seasonal"] + r["resid"] == pytest.approx(r["observed"])
    assert sum(r["seasonal"] for r in rows[:12]) == pytest.approx(0)
    assert max(rows[:12], key=lambda r: r["seasonal"])["mes"].month == 6


# Reviews


def test_distribution_keeps_unknown_scores(tables):
    rows = by(reviews.review_distribution(tables), "score")
    assert {s: r["contagem"] for s, r in rows.items()} == {5: 2, 2: 1, 1: 1, 4: 1, None: 1, 3: 1}


def test_unknown_score_is_a_detractor(tables):
    row = reviews.nps(tables).first()
    assert (row["promotores"], row["neutros"], row["detratores"], row["total"]) == (2, 2, 3, 7)
    assert row["nps"] == -14.29


def test_comments(tables):
    row = reviews.review_comment_share(tables).first()
    assert (row["com_comentario"], row["sem_comentario"], row["total"], row["pct_com_comentario"]) == (4, 3, 7, 57.14)


def test_category_scores_count_items_times_reviews(tables):
    rows = by(reviews.category_review_scores(tables), "categoria")
    # fashion: o1 (two reviews) and o6, each listed twice; furniture: o1 twice and o3.
    assert rows["fashion"]["total_reviews"] == 6
    assert rows["furniture"]["total_reviews"] == 3
    assert rows["furniture"]["score_medio"] == 3.67
    assert (rows["furniture"]["reviews_positivas"], rows["furniture"]["reviews_negativas"]) == (2, 1)
    assert "sem_par" not in rows  # only one observation


def test_delay_buckets(tables):
    rows = by(reviews.delay_vs_score(tables), "faixa_atraso")
    assert {f: r["contagem"] for f, r in rows.items()} == {"No prazo ou antes": 3, "1-3 dias": 1, "Mais de 30 dias": 1}
    assert rows["1-3 dias"]["min_dias"] == 1


def test_words(tables):
    rows = by(reviews.word_frequency(tables), "faixa", "palavra")
    assert rows[("positiva", "bom")]["contagem"] == 2
    assert rows[("negativa", "ruim")]["contagem"] == 1
    assert not any(word == "muito" for _, word in rows)


def test_nps_label(spark):
    scores = [5] * 9 + [1]
    rows = spark.createDataFrame([(s,) for s in scores], "review_score INT")
    row = reviews.nps_from_distribution({"order_reviews": rows}).first()
    assert (row["nps"], row["classificacao"]) == (80, "Excelente")


# Quality


def test_untranslated_categories(tables):
    assert [r[0] for r in quality.untranslated_categories(tables).collect()] == ["sem_par"]


def test_orphans(tables):
    rows = by(quality.foreign_key_audit(tables), "relacao")
    found = {name.split(" ")[0]: r["orfaos"] for name, r in rows.items()}
    assert found == {
        "orders.customer_id": 0, "order_items.order_id": 1, "order_items.product_id": 0, "order_items.seller_id": 0,
        "order_payments.order_id": 1, "order_reviews.order_id": 1, "customers.customer_zip_code_prefix": 1,
        "sellers.seller_zip_code_prefix": 0,
    }


def test_row_count_drift(tables):
    rows = by(quality.row_count_drift(tables, {"orders": 8, "customers": 5, "sellers": 0}), "tabela")
    assert not rows["orders"]["alerta"]
    assert (rows["customers"]["alerta"], rows["customers"]["diferenca_pct"]) == (True, 20.0)
    assert not rows["sellers"]["alerta"]


