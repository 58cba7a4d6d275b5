"""Registered queries: every operator over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from checks import oracle, oracle_stats
from quitanda.functions.semantics import round_double
from quitanda.operators import clustering, cohort, funnel, geo, prediction, quality, reviews, rfm, season, stats
from quitanda.operators.base import Tables
from quitanda.plans import export
from quitanda.plans.catalog import run_all
from quitanda.plans.job import run_job
from quitanda.schemas import table_schema
from quitanda.session import durable, ensure_checkpoint_dir
from quitanda.sources.adapters import StarTables
from quitanda.sources.csv_tables import FILE_PATTERNS, load_tables, require_inputs

Query = Callable[[SparkSession, str], DataFrame]


def _over(operator: Callable[..., DataFrame], lifecycle: bool = False, comments: bool = False) -> Query:
    """Operator over the star tables; without lifecycle dates unless it reads them."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return operator(StarTables(spark, folder).tables(lifecycle, comments))

    return run


def _event_funnel(spark: SparkSession, folder: str) -> DataFrame:
    return funnel.funnel_conversion({"orders": StarTables(spark, folder).event_orders()})


def _over_events(operator: Callable[..., DataFrame]) -> Query:
    return lambda spark, folder: operator(StarTables(spark, folder).event_sales())


def _heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """One row per cell, because list columns compare poorly across engines."""
    rows = cohort.cohort_heatmap(StarTables(spark, folder).tables(False, False))
    return rows.select("coorte", "tamanho", F.posexplode("retencao").alias("periodo", "retencao")).withColumn(
        "periodo", F.col("periodo").cast("long")
    )


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    star = StarTables(spark, folder)
    return geo.top_categories_by_region(star.tables(False, False), star.regions())


def _rounded(query: Query, *columns: str) -> Query:
    """Six digits for means whose last bit depends on the order of addition."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return query(spark, folder).withColumns({c: round_double(F.col(c), 6) for c in columns})

    return run


# Row counts to check drift against: those of the smallest correctness scale, two of them changed.
EXPECTED_ROWS = {"customers": 1_500, "orders": 15_000, "order_items": 58_000, "products": 2_010, "sellers": 100}

# Columns that identify a row of the delay features well enough to draw a sample by.
SPLIT_KEYS = ("order_id", "preco", "frete", "peso_g", "distancia_estimada_dias", "atraso")


def _price_samples(spark: SparkSession, folder: str) -> DataFrame:
    orders = StarTables(spark, folder).raw("orders").filter(F.col("o_orderstatus").isin("F", "O"))
    return stats.labeled_samples(orders, F.col("o_totalprice"), F.col("o_orderstatus") == "F")


def _described(spark: SparkSession, folder: str) -> DataFrame:
    return stats.describe_test_result(stats.welch_t_test(_price_samples(spark, folder)), "Valor difere por status")


def _described_mw(spark: SparkSession, folder: str) -> DataFrame:
    return stats.describe_test_result(stats.mann_whitney(_price_samples(spark, folder)), "Valor difere por status")


def _pearson(spark: SparkSession, folder: str) -> DataFrame:
    return stats.pearson(StarTables(spark, folder).order_items(), F.col("price"), F.col("freight_value"))


def _chi_square(spark: SparkSession, folder: str) -> DataFrame:
    return stats.chi_square(StarTables(spark, folder).raw("orders"), "o_orderstatus", "o_orderpriority")


def _standardized(spark: SparkSession, folder: str) -> DataFrame:
    people = rfm.customer_metrics(StarTables(spark, folder).tables(False, False))
    return clustering.standardize(people).select("customer_unique_id", *(f"{m}_z" for m in rfm.MEASURES))


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return prediction.delay_features(StarTables(spark, folder).tables(True, False))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return prediction.prepare_training(durable(_features(spark, folder)), keys=SPLIT_KEYS)


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation of a plain rule: expensive items are late."""
    price = F.col("preco")
    return prediction.evaluate_classifier(
        _features(spark, folder).select(
            F.col("atraso").alias("label"),
            (price > 50000).cast("int").alias("predicted"),
            price.cast("double").alias("probability"),
        )
    )


def _costly_orders(tables: Tables) -> DataFrame:
    found = stats.outliers_zscore(stats.order_values(tables), "order_id", "valor_pedido")
    return found.withColumn("valor", F.col("valor").cast("decimal(38,4)"))


def _people(spark: SparkSession, folder: str) -> DataFrame:
    return rfm.rfm_scores(StarTables(spark, folder).tables(False, False))


def _elbow(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.records(spark, clustering.kmeans_elbow(_people(spark, folder)))


def _silhouette(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.records(spark, clustering.kmeans_silhouette(_people(spark, folder)))


def _kmeans(spark: SparkSession, folder: str) -> DataFrame:
    assigned = clustering.kmeans_fit(_people(spark, folder), 4).assigned
    return assigned.select("customer_unique_id", *rfm.MEASURES, clustering.CLUSTER)


def _clustered(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster(_people(spark, folder)).assigned.select(
        "customer_unique_id", *rfm.MEASURES, "segmento", clustering.CLUSTER
    )


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.cluster_profiles(_kmeans(spark, folder))


def _trained(spark: SparkSession, folder: str) -> DataFrame:
    """Coefficients of the logistic model on the training part."""
    split = _split(spark, folder)
    model = prediction.train_delay_model(split.filter(~F.col("em_teste"))).stages[-1]
    rows = [{"feature": f, "coefficient": float(c)} for f, c in zip(prediction.FEATURES, model.coefficients, strict=True)]
    return clustering.records(spark, [*rows, {"feature": "intercept", "coefficient": model.intercept}])


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    return prediction.predict_delays(_features(spark, folder)).rows(spark)


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/quitanda-{uuid.uuid4().hex}"


# Loaded tables, and the amount summed up for each.
LOADED = {
    "customers": None,
    "orders": "length(order_status)",
    "order_items": "price + freight_value",
    "order_payments": "payment_value",
    "order_reviews": "review_score + coalesce(length(review_comment_message), 0)",
    "products": "product_weight_g",
    "sellers": None,
    "geolocation": None,
    "category_translation": "length(product_category_name)",
}


def _csv_folder(spark: SparkSession, folder: str) -> str:
    """All tables as headed CSV files, free text quoted."""
    tables, target = StarTables(spark, folder).tables(), _scratch(spark)
    for name in LOADED:
        df = tables[name]
        columns = [F.col(f.name) if f.name in df.columns else F.lit(None).cast("string").alias(f.name) for f in table_schema(name)]
        if name == "order_reviews":
            # An empty text is read as none, and so is one of carriage returns at the end of a line.
            columns = [F.regexp_replace(c, "\r", " ") if f.name == "review_comment_message" else c for c, f in zip(columns, table_schema(name))]
            columns = [c.alias(f.name) for c, f in zip(columns, table_schema(name))]
        df.select(*columns).write.options(header=True, quote='"', escape='"', lineSep="\n").csv(f"{target}/{name}.csv")
    return target


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and amounts of tables that went through CSV files and back."""
    loaded = load_tables(spark, _csv_folder(spark, folder), {name: FILE_PATTERNS[name] for name in LOADED})
    return reduce(
        DataFrame.unionByName,
        (
            loaded[name].agg(F.count("*").alias("linhas"), F.sum(F.expr(amount or "0")).cast("decimal(38,2)").alias("soma"))
            .select(F.lit(name).alias("tabela"), "linhas", "soma")
            for name, amount in LOADED.items()
        ),
    )


def _required(spark: SparkSession, folder: str) -> DataFrame:
    """Tables whose files are found in a folder of CSV files."""
    found = require_inputs(spark, _csv_folder(spark, folder))
    return clustering.records(spark, [{"tabela": name, "presente": bool(files)} for name, files in found.items()])


def _job(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every file that a whole run from CSV files writes; a document counts as one."""
    target = _scratch(spark)
    names = run_job(spark, _csv_folder(spark, folder), f"{target}/store", f"{target}/out", restarts=1)
    counts = ({"arquivo": name, "linhas": spark.read.option("multiLine", True).json(f"{target}/out/{name}").count()} for name in names)
    return clustering.records(spark, list(counts))


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each person is at the nearest of the fitted centres."""
    found = clustering.kmeans_fit(_people(spark, folder), 4)
    return found.assigned.select("customer_unique_id", *rfm.MEASURES, clustering.nearest_centre(found).alias("mais_proximo"))


def _centres(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each centre is the mean of its people, and whether their numbers add up."""
    gaps = clustering.centre_gaps(clustering.kmeans_fit(_people(spark, folder), 4))
    total = F.sum("rows").over(Window.partitionBy())
    return gaps.select(F.col("cluster").cast("int").alias("cluster"), (F.col("gap") < 2e-3).alias("media"), total.alias("pessoas"))


def _search(spark: SparkSession, folder: str) -> DataFrame:
    """For every k of a search: inertia below that of fewer clusters, a silhouette in range, and whether the best was taken."""
    found = clustering.cluster(_people(spark, folder), restarts=3)
    inertia = {r["k"]: r["inertia"] for r in found.elbow}
    best = max(found.silhouette, key=lambda r: r["silhouette"])["k"]
    return clustering.records(
        spark,
        [
            {"k": k, "cai": k - 1 not in inertia or inertia[k] <= inertia[k - 1], "em_faixa": -1 <= r["silhouette"] <= 1, "certo": found.k_best == best, "n_usado": found.n_used}
            for r in found.silhouette
            for k in [r["k"]]
        ],
    )


def _stationary(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the penalised loss of the logistic model is flat in each coefficient."""
    train = _split(spark, folder).filter(~F.col("em_teste"))
    return prediction.loss_slopes(prediction.train_delay_model(train), train).select("feature", (F.abs("slope") < 1e-3).alias("plano"))


def _confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows of both models, and whether their metrics follow from the confusion cells."""
    rows = _predicted(spark, folder)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    right = round_double((tp + tn) / (tn + fp + fn + tp), 4) == F.col("accuracy")
    return rows.select("modelo", (tn + fp + fn + tp).alias("n_teste"), "n_original", "n_usado", right.alias("confere"), F.col("auc_roc").between(0, 1).alias("em_faixa"))


def _result_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every named result."""
    results = run_all(StarTables(spark, folder).tables())
    return reduce(
        DataFrame.unionByName,
        (df.agg(F.count("*").alias("linhas")).select(F.lit(name).alias("resultado"), "linhas") for name, df in results.items()),
    )


def _exported(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly series, read back from its exported JSON file."""
    target = _scratch(spark)
    series = season.monthly_series(StarTables(spark, folder).tables(False, False))
    names = export.export_results(spark, {"sazonalidade_mensal": series}, target)
    schema = "mes STRING, pedidos LONG, receita DOUBLE, media_movel_3m DOUBLE, mom_growth DOUBLE"
    return spark.read.schema(schema).option("multiLine", True).json(f"{target}/{names[0]}")


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """All customer scores through one JSON document, written as a stream."""
    target = f"{_scratch(spark)}/scores.json"
    export.write_json(spark, _people(spark, folder), target)
    schema = "customer_unique_id LONG, recency LONG, frequency LONG, monetary DOUBLE, r_score INT, f_score INT, m_score INT, segmento STRING"
    return spark.read.schema(schema).option("multiLine", True).json(target)


def _json_safe(tables: Tables) -> DataFrame:
    return export.json_safe(season.year_over_year(tables))


def _round_fields(tables: Tables) -> DataFrame:
    """Shares with more digits than the export keeps."""
    return export.round_fields(geo.geo_state_metrics(tables), ["receita", "frete_percentual", "pedidos"])


QUERIES: dict[str, Query] = {
    "funnel_status": _over(funnel.funnel_status),
    "funnel_conversion": _over(funnel.funnel_conversion, lifecycle=True),
    "funnel_conversion_events": _event_funnel,
    "funnel_pct_of_first": _over(funnel.funnel_pct_of_first, lifecycle=True),
    "cancel_rate_by_stage": _over(lambda t: funnel.cancel_rate_by_stage(t, "processing"), lifecycle=True),
    "delivery_time_buckets": _over(funnel.delivery_time_buckets, lifecycle=True),
    "rfm_scores": _over(rfm.rfm_scores),
    "rfm_segments": _over(rfm.rfm_segments),
    "rfm_summary_stats": _over(rfm.rfm_summary_stats),
    "rfm_histograms": _over(rfm.rfm_histograms),
    "rfm_correlation": _over(rfm.rfm_correlation),
    "cohort_retention": _over(cohort.cohort_retention),
    "cohort_repurchase": _over(cohort.cohort_repurchase),
    "cohort_heatmap": _heatmap,
    "retained_customers": _over(cohort.retained_customers),
    "geo_state_metrics": _over(geo.geo_state_metrics),
    "geo_top_categories": _over(geo.geo_top_categories),
    "top_categories_by_region": _regions,
    "freight_score_outliers": _over(geo.freight_score_outliers),
    "zip_centroids": _rounded(_over(geo.zip_centroids), "lat", "lng"),
    "monthly_series": _over(season.monthly_series),
    "weekday_pattern": _over(season.weekday_pattern),
    "weekday_pattern_events": _over_events(season.weekday_pattern),
    "weekday_vs_mean": _rounded(_over_events(season.weekday_vs_mean), "media"),
    "hourly_pattern": _over(season.hourly_pattern),
    "hourly_pattern_events": _over_events(season.hourly_pattern),
    "hour_peaks": _over_events(season.hour_peaks),
    "year_over_year": _over(season.year_over_year),
    "seasonal_decompose": _over(season.seasonal_decompose),
    "revenue_peaks": _over(season.revenue_peaks),
    "review_distribution": _over(reviews.review_distribution),
    "nps": _over(reviews.nps),
    "nps_by_category": _over(reviews.nps_by_category),
    "nps_from_distribution": _over(reviews.nps_from_distribution),
    "category_review_scores": _over(reviews.category_review_scores),
    "score_bands": _over(reviews.score_bands),
    "delay_vs_score": _over(reviews.delay_vs_score, lifecycle=True),
    "review_comment_share": _over(reviews.review_comment_share, comments=True),
    "untranslated_categories": _over(quality.untranslated_categories),
    "foreign_key_audit": _over(quality.foreign_key_audit),
    "row_count_drift": _over(lambda t: quality.row_count_drift(t, EXPECTED_ROWS)),
    "word_frequency": _over(reviews.word_frequency, comments=True),
    "mann_whitney": lambda spark, folder: stats.mann_whitney(_price_samples(spark, folder)),
    "welch_t_test": lambda spark, folder: stats.welch_t_test(_price_samples(spark, folder)),
    "describe_test_result": _described,
    "delay_score_test": _over(stats.delay_score_test, lifecycle=True),
    "delay_score_spearman": _over(stats.delay_score_spearman, lifecycle=True),
    "freight_score_spearman": _over(stats.freight_score_spearman),
    "freight_median_test": _over(stats.freight_median_test),
    "pearson": _pearson,
    "chi_square": _chi_square,
    "outliers_iqr": _over(lambda t: stats.outliers_iqr(rfm.customer_metrics(t), "customer_unique_id", "monetary")),
    "outliers_zscore": _over(_costly_orders),
    "standardize": _rounded(_standardized, *(f"{m}_z" for m in rfm.MEASURES)),
    "kmeans_elbow": _elbow,
    "kmeans_silhouette": _silhouette,
    "kmeans_fit": _kmeans,
    "rfm_clustering": _clustered,
    "cluster_profiles": _profiles,
    "delay_features": _features,
    "train_test_prepare": _split,
    "train_delay_model": _trained,
    "evaluate_classifier": _evaluated,
    "delay_prediction": _predicted,
    "load_tables": _loaded,
    "require_inputs": _required,
    "run_pipeline": _job,
    "kmeans_fit_certificate": _nearest,
    "kmeans_centres_certificate": _centres,
    "kmeans_search_certificate": _search,
    "train_delay_model_certificate": _stationary,
    "delay_prediction_certificate": _confusion,
    "describe_test_result_mw": _described_mw,
    "run_named_queries": _result_sizes,
    "export_results": _exported,
    "write_json": _written,
    "json_safe": _over(_json_safe),
    "round_fields": _over(_round_fields),
}

_STOP_LIST = ", ".join(f"'{word}'" for word in reviews.STOP_WORDS)
_BODIES = oracle.BODIES | oracle_stats.BODIES
ORACLE: dict[str, str] = {name: oracle.VIEWS + body.replace("{stop}", _STOP_LIST) for name, body in _BODIES.items()}

ORACLE["write_json"] = f"SELECT * REPLACE (CAST(monetary AS DOUBLE) AS monetary) FROM ({ORACLE['rfm_scores']})"

# Query of every named result.
_RESULT_QUERIES = {
    "funil_status": "funnel_status",
    "funil_conversao": "funnel_conversion",
    "funil_tempos": "delivery_time_buckets",
    "rfm_scores": "rfm_scores",
    "rfm_segmentos": "rfm_segments",
    "cohort_retencao": "cohort_retention",
    "cohort_recompra": "cohort_repurchase",
    "geo_estados": "geo_state_metrics",
    "geo_categorias": "geo_top_categories",
    "sazonalidade_mensal": "monthly_series",
    "sazonalidade_semanal": "weekday_pattern",
    "sazonalidade_horaria": "hourly_pattern",
    "reviews_distribuicao": "review_distribution",
    "reviews_nps": "nps",
    "reviews_categorias": "category_review_scores",
    "reviews_atraso": "delay_vs_score",
    "reviews_comentarios": "review_comment_share",
}
ORACLE["run_named_queries"] = " UNION ALL ".join(
    f"SELECT '{name}' AS resultado, count(*) AS linhas FROM ({ORACLE[query]})" for name, query in _RESULT_QUERIES.items()
)

# Files of a whole run: the query whose rows each holds; None for one document.
_FILE_QUERIES = {
    "01_funil_status.json": "funnel_status",
    "01_funil_conversao.json": "funnel_conversion",
    "01_funil_tempos.json": "delivery_time_buckets",
    "02_rfm_distribuicao.json": None,
    "02_rfm_segmentos.json": "rfm_segments",
    "02_rfm_clustering.json": None,
    "03_cohort_heatmap.json": None,
    "03_cohort_recompra.json": "cohort_repurchase",
    "04_geo_estados.json": "geo_state_metrics",
    "04_geo_correlacao.json": None,
    "04_geo_categorias.json": "geo_top_categories",
    "05_sazonalidade_mensal.json": "monthly_series",
    "05_sazonalidade_semanal.json": "weekday_pattern",
    "05_sazonalidade_horaria.json": "hourly_pattern",
    "06_reviews_distribuicao.json": "review_distribution",
    "06_reviews_categorias.json": "category_review_scores",
    "06_reviews_atraso.json": "delay_vs_score",
    "06_reviews_palavras.json": "word_frequency",
}
ORACLE["run_pipeline"] = " UNION ALL ".join(
    f"SELECT '{name}' AS arquivo, " + (f"count(*) AS linhas FROM ({ORACLE[query]})" if query else "1 AS linhas") for name, query in _FILE_QUERIES.items()
)
ORACLE["require_inputs"] = " UNION ALL ".join(f"SELECT '{name}' AS tabela, TRUE AS presente" for name in LOADED)
ORACLE["kmeans_fit_certificate"] = (
    f"SELECT customer_unique_id, recency, frequency, monetary, TRUE AS mais_proximo FROM ({ORACLE['rfm_scores']})"
)
ORACLE["kmeans_centres_certificate"] = (
    f"SELECT CAST(i AS INTEGER) AS cluster, TRUE AS media, (SELECT count(*) FROM ({ORACLE['rfm_scores']})) AS pessoas FROM range(4) s(i)"
)
ORACLE["kmeans_search_certificate"] = (
    f"SELECT i AS k, TRUE AS cai, TRUE AS em_faixa, TRUE AS certo, (SELECT count(*) FROM ({ORACLE['rfm_scores']})) AS n_usado FROM range(2, 11) s(i)"
)
ORACLE["train_delay_model_certificate"] = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, TRUE AS plano" for name in (*prediction.FEATURES, "intercept")
)
_ALL_FEATURES = f"(SELECT count(*) FROM ({ORACLE['delay_features']}))"
ORACLE["delay_prediction_certificate"] = f"""
    SELECT modelo, n_teste, {_ALL_FEATURES} AS n_original, n_usado, TRUE AS confere, TRUE AS em_faixa
    FROM (SELECT count(*) FILTER (em_teste) AS n_teste, count(*) AS n_usado FROM ({ORACLE['train_test_prepare']}))
    CROSS JOIN (VALUES ('logistic'), ('random_forest')) v(modelo)"""
