"""SQL of the statistical queries, computed from first principles.

P-values come from numerical integration of the density (Simpson's rule), which
shares nothing with the closed forms used on Spark.
"""

from __future__ import annotations

from checks.oracle import DELAYS, RFM, SERIES, STATES

_STEPS = 20000


def _normal_tail(z: str) -> str:
    """Two-sided tail of a standard normal beyond the non-negative ``z``."""
    return f"""greatest(0.0, 1 - 2 * (SELECT sum(CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * exp(-pow(i * {z} / {_STEPS}, 2) / 2)) * {z} / {_STEPS} / 3 / sqrt(2 * pi()) FROM range({_STEPS + 1}) s(i)))"""


def _student_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's t beyond the non-negative ``t``."""
    return f"""greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi())
        * (SELECT sum(CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * exp(-({df} + 1) / 2 * ln(1 + pow(i * {t} / {_STEPS}, 2) / {df}))) * {t} / {_STEPS} / 3 FROM range({_STEPS + 1}) s(i)))"""


# Samples (x, in_a) -> one row of the Mann-Whitney test.
_MANN_WHITNEY = f"""
, ranked AS (
  SELECT x, in_a, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM samples
), sizes AS (
  SELECT CAST(count(*) FILTER (in_a) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT in_a) AS DOUBLE) AS nb,
         sum(r) FILTER (in_a) AS ra FROM ranked
), tied AS (
  SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM samples GROUP BY x)
), u AS (
  SELECT na, nb, ra - na * (na + 1) / 2 AS u,
         na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1))) AS v
  FROM sizes, tied
), z AS (SELECT *, (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / sqrt(v) AS z FROM u)
, mw AS (
  SELECT *, CASE WHEN z < 0 THEN 1.0 ELSE {_normal_tail('z')} END AS p FROM z
), mw_row AS (
  SELECT 'Mann-Whitney U' AS teste_usado, CASE WHEN enough THEN ROUND(u, 4) END AS u_statistic,
         CASE WHEN enough THEN ROUND(p, 6) END AS p_value, CASE WHEN enough THEN p < 0.05 END AS significativo,
         CASE WHEN enough THEN ROUND(1 - 2 * u / (na * nb), 4) END AS tamanho_efeito,
         CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, CAST(0.05 AS DOUBLE) AS alpha,
         CASE WHEN NOT enough THEN 'Amostra insuficiente' END AS mensagem
  FROM (SELECT *, least(na, nb) >= 2 AS enough FROM mw)
)
"""

# Values (x, y) -> one row of a correlation test on the columns a and b.
def _correlation(test: str, a: str, b: str, source: str) -> str:
    return f"""
, c AS (SELECT count(*) AS n, corr({a}, {b}) AS r FROM {source})
, ct AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, CAST(n - 2 AS DOUBLE) AS df FROM c)
, cp AS (SELECT *, {_student_tail('t', 'df')} AS p FROM ct)
SELECT '{test}' AS teste_usado, ROUND(p, 6) AS p_value, p < 0.05 AS significativo, ROUND(r, 4) AS tamanho_efeito, n,
       CAST(NULL AS VARCHAR) AS mensagem FROM cp
"""


_RANKED_PAIRS = """
, ranked_pairs AS (
  SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
         rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pairs)
"""

_PRICE_SAMPLES = """
, samples AS (SELECT o_totalprice AS x, o_orderstatus = 'F' AS in_a FROM orders WHERE o_orderstatus IN ('F', 'O'))
"""

_WELCH = f"""
, m AS (
  SELECT CAST(count(*) FILTER (in_a) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT in_a) AS DOUBLE) AS nb,
         avg(x) FILTER (in_a) AS ma, avg(x) FILTER (NOT in_a) AS mb,
         var_samp(x) FILTER (in_a) AS va, var_samp(x) FILTER (NOT in_a) AS vb FROM samples
), t AS (
  SELECT *, (ma - mb) / sqrt(va / na + vb / nb) AS t,
         pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM m
), tp AS (SELECT *, {_student_tail('abs(t)', 'df')} AS p FROM t)
, t_row AS (
  SELECT 'Welch t-test' AS teste_usado, ROUND(t, 4) AS t_statistic, ROUND(p, 6) AS p_value, p < 0.05 AS significativo,
         ROUND((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 4) AS cohens_d,
         CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, CAST(0.05 AS DOUBLE) AS alpha,
         CAST(NULL AS VARCHAR) AS mensagem FROM tp)
"""

FEATURES = """
, f AS (
  SELECT o.order_id, weight AS peso_g, freight AS frete, price AS preco, state AS estado_cliente,
         CAST(floor(epoch(promised - bought) / 86400) AS BIGINT) AS distancia_estimada_dias,
         len * height * 1 AS volume_cm3, CAST(arrived > promised AS INTEGER) AS atraso
  FROM m_lifecycle o JOIN m_customers USING (customer_id) JOIN m_items USING (order_id) JOIN m_products USING (product_id)
  WHERE status = 'delivered' AND arrived IS NOT NULL AND promised IS NOT NULL)
"""

_SPLIT = """
, coded AS (
  SELECT * REPLACE (CAST(dense_rank() OVER (ORDER BY estado_cliente) - 1 AS INTEGER) AS estado_cliente) FROM f
), drawn AS (
  SELECT *, row_number() OVER (PARTITION BY atraso
    ORDER BY md5(concat_ws('|', order_id, preco, frete, peso_g, distancia_estimada_dias, atraso, 42))) AS rn FROM coded
), classes AS (
  SELECT atraso, count(*) AS n, sum(count(*)) OVER () AS total FROM f GROUP BY atraso
), floors AS (
  SELECT *, n * (total - ceil(0.2 * total)) / total AS exact, total - ceil(0.2 * total) AS n_train FROM classes
), quota AS (
  SELECT atraso, floor(exact) + CAST(row_number() OVER (ORDER BY exact - floor(exact) DESC, atraso)
         <= n_train - sum(floor(exact)) OVER () AS INTEGER) AS q FROM floors
)
SELECT coded.* EXCLUDE (rn), rn > q AS em_teste FROM drawn coded JOIN quota USING (atraso)
"""

_LATE = """
, samples AS (
  SELECT CAST(score AS DOUBLE) AS x, arrived > promised AS in_a FROM m_lifecycle JOIN m_reviews USING (order_id)
  WHERE status = 'delivered' AND arrived IS NOT NULL AND score IS NOT NULL)
"""

_ORDER_VALUES = """
, v AS (SELECT order_id, sum(price + freight) AS valor FROM m_items GROUP BY 1)
"""

BODIES = {
    "mann_whitney": _PRICE_SAMPLES + _MANN_WHITNEY + "SELECT * FROM mw_row",
    "welch_t_test": _PRICE_SAMPLES + _WELCH + "SELECT * FROM t_row",
    "describe_test_result_mw": _PRICE_SAMPLES
    + _MANN_WHITNEY
    + """SELECT *, 'Valor difere por status' AS hipotese,
        CASE WHEN significativo THEN format('Rejeita H0 (p={:.4f} < alpha={}). Ha diferenca estatisticamente significativa.', p_value, alpha)
             ELSE format('Nao rejeita H0 (p={:.4f} >= alpha={}). Nao ha evidencia de diferenca significativa.', p_value, alpha) END
        || format(' Tamanho do efeito (r): {:.4f} ({}).', tamanho_efeito, CASE WHEN abs(tamanho_efeito) < 0.1 THEN 'negligivel'
             WHEN abs(tamanho_efeito) < 0.3 THEN 'pequeno' WHEN abs(tamanho_efeito) < 0.5 THEN 'medio' ELSE 'grande' END) AS conclusao,
        format('Teste nao-parametrico (nao assume normalidade). Amostras independentes. n={} (n_a={}, n_b={}). Nivel de significancia: {}.',
               n_a + n_b, n_a, n_b, alpha) AS premissas FROM mw_row""",
    "describe_test_result": _PRICE_SAMPLES
    + _WELCH
    + """SELECT *, 'Valor difere por status' AS hipotese,
        CASE WHEN significativo THEN format('Rejeita H0 (p={:.4f} < alpha={}). Ha diferenca estatisticamente significativa.', p_value, alpha)
             ELSE format('Nao rejeita H0 (p={:.4f} >= alpha={}). Nao ha evidencia de diferenca significativa.', p_value, alpha) END
        || format(' Tamanho do efeito (Cohen''s d): {:.4f} ({}).', cohens_d, CASE WHEN abs(cohens_d) < 0.2 THEN 'negligivel'
             WHEN abs(cohens_d) < 0.5 THEN 'pequeno' WHEN abs(cohens_d) < 0.8 THEN 'medio' ELSE 'grande' END) AS conclusao,
        format('Welch t-test (nao assume variancias iguais). Amostras independentes. n={} (n_a={}, n_b={}). Nivel de significancia: {}.',
               n_a + n_b, n_a, n_b, alpha) AS premissas FROM t_row""",
    "delay_score_test": _LATE + _MANN_WHITNEY + "SELECT * FROM mw_row",
    "delay_score_spearman": DELAYS
    + ", pairs AS (SELECT dias_atraso AS x, score AS y FROM delays WHERE score IS NOT NULL)"
    + _RANKED_PAIRS
    + _correlation("Spearman", "rx", "ry", "ranked_pairs"),
    "freight_score_spearman": STATES
    + ", pairs AS (SELECT frete_percentual AS x, review_score_medio AS y FROM states)"
    + _RANKED_PAIRS
    + _correlation("Spearman", "rx", "ry", "ranked_pairs"),
    "freight_median_test": STATES
    + """, samples AS (
          SELECT review_score_medio AS x,
                 CAST(frete_percentual AS DOUBLE) > (SELECT quantile_cont(CAST(frete_percentual AS DOUBLE), 0.5) FROM states) AS in_a
          FROM states)"""
    + _MANN_WHITNEY
    + "SELECT * FROM mw_row",
    "pearson": ", p AS (SELECT CAST(price AS DOUBLE) AS x, CAST(freight AS DOUBLE) AS y FROM m_items)"
    + _correlation("Pearson", "x", "y", "p"),
    "chi_square": """
        , cells AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2)
        , e AS (SELECT *, sum(o) OVER (PARTITION BY a) * 1.0 * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM cells)
        , x AS (SELECT CAST(sum(o) AS BIGINT) AS n, sum(pow(o - e, 2) / e) AS x,
                       (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS graus FROM e)
        , d AS (SELECT *, 1 - (SELECT sum(CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                 * pow(i * x / 20000, graus / 2.0 - 1) * exp(-i * x / 40000)) * x / 20000 / 3
                 / (pow(2, graus / 2.0) * gamma(graus / 2.0)) FROM range(20001) s(i)) AS p FROM x)
        SELECT 'Chi-quadrado' AS teste_usado, ROUND(x, 4) AS chi2, ROUND(p, 6) AS p_value, p < 0.05 AS significativo, graus, n FROM d""",
    "outliers_iqr": RFM
    + """, q AS (SELECT quantile_cont(CAST(monetary AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(monetary AS DOUBLE), 0.75) AS q3 FROM people)
        SELECT person AS customer_unique_id, monetary AS valor, CASE WHEN monetary < q1 THEN 'abaixo' ELSE 'acima' END AS lado
        FROM people, q WHERE CAST(monetary AS DOUBLE) < q1 - 1.5 * (q3 - q1) OR CAST(monetary AS DOUBLE) > q3 + 1.5 * (q3 - q1)""",
    "outliers_zscore": _ORDER_VALUES
    + """, s AS (SELECT avg(CAST(valor AS DOUBLE)) AS m, stddev_samp(CAST(valor AS DOUBLE)) AS sd FROM v)
        SELECT order_id, valor, ROUND((CAST(valor AS DOUBLE) - m) / sd, 4) AS z FROM v, s
        WHERE abs((CAST(valor AS DOUBLE) - m) / sd) > 3""",
    "standardize": RFM
    + "SELECT person AS customer_unique_id, "
    + ", ".join(
        f"ROUND((CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER (), 6) AS {c}_z"
        for c in ("recency", "frequency", "monetary")
    )
    + " FROM people",
    "delay_features": FEATURES + "SELECT * FROM f",
    "train_test_prepare": FEATURES + _SPLIT,
    "evaluate_classifier": FEATURES
    + """, samples AS (SELECT CAST(preco AS DOUBLE) AS x, atraso = 1 AS in_a, preco > 50000 AS guess FROM f)
        , ranked AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS r FROM samples)
        , c AS (SELECT count(*) FILTER (NOT in_a AND NOT guess) AS tn, count(*) FILTER (NOT in_a AND guess) AS fp,
                       count(*) FILTER (in_a AND NOT guess) AS fn, count(*) FILTER (in_a AND guess) AS tp,
                       CAST(count(*) FILTER (in_a) AS DOUBLE) AS na, CAST(count(*) FILTER (NOT in_a) AS DOUBLE) AS nb,
                       sum(r) FILTER (in_a) AS ra FROM ranked)
        SELECT ROUND((tp + tn) / (tp + tn + fp + fn), 4) AS accuracy, ROUND(tp / (tp + fp), 4) AS "precision",
               ROUND(tp / (tp + fn), 4) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 4) AS f1,
               ROUND((ra - na * (na + 1) / 2) / (na * nb), 4) AS auc_roc, tn, fp, fn, tp FROM c""",
    "word_frequency": """
        , words AS (
          SELECT CASE WHEN score >= 4 THEN 'positiva' WHEN score <= 2 THEN 'negativa' END AS faixa,
                 unnest(string_split(regexp_replace(lower(message), '[^\\p{L}]+', ' ', 'g'), ' ')) AS palavra FROM m_comments
        ), counts AS (
          SELECT faixa, palavra, count(*) AS contagem FROM words
          WHERE faixa IS NOT NULL AND length(palavra) >= 2 AND palavra NOT IN ({stop}) GROUP BY 1, 2)
        SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY faixa ORDER BY contagem DESC, palavra) <= 10""",
    "load_tables": """
        SELECT 'customers' AS tabela, count(*) AS linhas, CAST(0 AS DECIMAL(38,2)) AS soma FROM m_customers
        UNION ALL SELECT 'orders', count(*), sum(length(status)) FROM m_orders
        UNION ALL SELECT 'order_items', count(*), sum(price + CAST(freight AS DECIMAL(10,2))) FROM m_items
        UNION ALL SELECT 'order_payments', count(*), sum(CAST(o_totalprice AS DECIMAL(10,2))) FROM orders
        UNION ALL SELECT 'order_reviews', count(*), sum(score + coalesce(length(message), 0)) FROM m_comments
        UNION ALL SELECT 'products', count(*), sum(weight) FROM m_products
        UNION ALL SELECT 'sellers', count(*), 0 FROM m_sellers
        UNION ALL SELECT 'geolocation', count(*), 0 FROM supplier
        UNION ALL SELECT 'category_translation', count(*), sum(length(category)) FROM m_names""",
    "export_results": SERIES
    + """, s AS (SELECT mes, pedidos, receita,
          CASE WHEN row_number() OVER w >= 3 THEN ROUND(CAST(avg(receita) OVER (w ROWS 2 PRECEDING) AS NUMERIC), 2) END AS a,
          CASE WHEN lag(receita) OVER w > 0 THEN CAST((receita - lag(receita) OVER w) / lag(receita) OVER w AS NUMERIC) END AS g
        FROM months WINDOW w AS (ORDER BY mes))
        SELECT strftime(mes, '%Y-%m') AS mes, pedidos, CAST(receita AS DOUBLE) AS receita, CAST(a AS DOUBLE) AS media_movel_3m,
               CAST(g AS DOUBLE) AS mom_growth FROM s""",
    "json_safe": SERIES
    + """SELECT strftime(a.mes, '%Y-%m-%d') AS mes, CAST(a.receita AS DOUBLE) AS receita,
        CAST(b.receita AS DOUBLE) AS receita_ano_anterior,
        CASE WHEN b.receita > 0 THEN CAST(CAST((a.receita - b.receita) / b.receita AS NUMERIC) AS DOUBLE) END AS yoy_growth
        FROM months a LEFT JOIN months b ON b.mes = CAST(a.mes - INTERVAL 12 MONTH AS DATE)""",
    "round_fields": STATES
    + """SELECT * REPLACE (CAST(receita AS DOUBLE) AS receita, CAST(printf('%.2f', CAST(frete_percentual AS DOUBLE)) AS DOUBLE) AS frete_percentual)
        FROM states""",
    "row_count_drift": " UNION ALL ".join(
        f"""SELECT '{name}' AS tabela, count(*) AS linhas, CAST({rows} AS BIGINT) AS esperado,
            ROUND(abs(count(*) - {rows}) * 100.0 / {rows}, 1) AS diferenca_pct, abs(count(*) - {rows}) / {rows} > 0.01 AS alerta FROM {source}"""
        for name, rows, source in (
            ("customers", 1_500, "customer"),
            ("orders", 15_000, "orders"),
            ("order_items", 58_000, "lineitem"),
            ("products", 2_010, "part"),
            ("sellers", 100, "supplier"),
        )
    ),
}
