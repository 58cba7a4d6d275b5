"""The named results by chapter, each with its builder and its row order.

Builders return unordered DataFrames, so that a caller who aggregates further
pays for no sort; ``run_named_queries`` adds the documented order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from quitanda.operators import cohort, funnel, geo, reviews, rfm, season
from quitanda.operators.base import Tables


@dataclass(frozen=True)
class NamedResult:
    """A result: how to build it and how its rows are ordered ('-' marks descending)."""

    build: Callable[[Tables], DataFrame]
    order: Sequence[str] = ()

    def ordered(self, df: DataFrame) -> DataFrame:
        if not self.order:
            return df
        return df.orderBy(
            *(F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in self.order)
        )


# Chapter and result names.
CHAPTERS: dict[str, dict[str, NamedResult]] = {
    "01_funil": {
        "funil_status": NamedResult(funnel.funnel_status, ("-contagem", "status")),
        "funil_conversao": NamedResult(funnel.funnel_conversion),
        "funil_tempos": NamedResult(funnel.delivery_time_buckets, ("min_dias",)),
    },
    "02_rfm": {
        "rfm_scores": NamedResult(rfm.rfm_scores, ("-r_score", "-f_score", "-m_score", "customer_unique_id")),
        "rfm_segmentos": NamedResult(rfm.rfm_segments, ("-contagem", "segmento")),
    },
    "03_cohort": {
        "cohort_retencao": NamedResult(cohort.cohort_retention, ("coorte_mes", "periodo")),
        "cohort_recompra": NamedResult(cohort.cohort_repurchase),
    },
    "04_geo": {
        "geo_estados": NamedResult(geo.geo_state_metrics, ("-pedidos", "estado")),
        "geo_categorias": NamedResult(geo.geo_top_categories, ("estado", "-pedidos", "-receita", "categoria")),
    },
    "05_sazonalidade": {
        "sazonalidade_mensal": NamedResult(season.monthly_series, ("mes",)),
        "sazonalidade_semanal": NamedResult(season.weekday_pattern, ("dia_semana",)),
        "sazonalidade_horaria": NamedResult(season.hourly_pattern, ("hora",)),
    },
    "06_reviews": {
        "reviews_distribuicao": NamedResult(reviews.review_distribution, ("score",)),
        "reviews_nps": NamedResult(reviews.nps),
        "reviews_categorias": NamedResult(reviews.category_review_scores, ("-score_medio", "categoria")),
        "reviews_atraso": NamedResult(reviews.delay_vs_score, ("min_dias",)),
        "reviews_comentarios": NamedResult(reviews.review_comment_share),
    },
}


def run_named_queries(chapter: str, tables: Tables) -> dict[str, DataFrame]:
    """All results of a chapter, lazily and in their documented order."""
    if chapter not in CHAPTERS:
        raise ValueError(f"unknown chapter {chapter!r}, use one of {', '.join(CHAPTERS)}")
    return {name: result.ordered(result.build(tables)) for name, result in CHAPTERS[chapter].items()}


def run_all(tables: Tables) -> dict[str, DataFrame]:
    """Results of all chapters."""
    return {name: df for chapter in CHAPTERS for name, df in run_named_queries(chapter, tables).items()}
