"""Tests, correlations and outliers against direct computation."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quitanda.functions import probability as P
from quitanda.operators import stats


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v DOUBLE")


def samples(spark, a, b):
    return stats.two_samples(frame(spark, a), frame(spark, b), "v")


def u_of(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


@pytest.fixture(scope="module")
def normals():
    rng = np.random.default_rng(42)
    return rng.normal(10, 2, 100), rng.normal(15, 2, 100), rng.normal(10, 2, 100)


# Distribution functions


def test_exact_u_distribution_by_enumeration():
    for n_a, n_b in ((2, 3), (3, 5), (4, 4)):
        places = [sum(c) + n_a - n_a * (n_a + 1) // 2 for c in itertools.combinations(range(n_a + n_b), n_a)]
        for u in range(n_a * n_b + 1):
            larger = max(u, n_a * n_b - u)
            exact = min(1.0, 2 * sum(p >= larger for p in places) / len(places))
            assert P.mann_whitney_two_sided(u, n_a, n_b, 0) == pytest.approx(exact)


def test_student_and_chi_square_tails():
    # Closed forms: one degree is Cauchy, two degrees algebraic; chi-square with 2 is exponential.
    assert P.student_two_sided(2.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2.0))
    assert P.student_two_sided(2.0, 2) == pytest.approx(1 - 2.0 / math.sqrt(2 + 4.0))
    assert P.chi_square_upper(5.0, 2) == pytest.approx(math.exp(-2.5))
    assert P.chi_square_upper(0.3, 2) == pytest.approx(math.exp(-0.15))
    assert P.chi_square_upper(9.0, 1) == pytest.approx(math.erfc(3 / math.sqrt(2)))


# Mann-Whitney


def test_u_by_pairs_with_ties(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, 60), rng.integers(1, 7, 80)
    result = stats.as_record(stats.mann_whitney(samples(spark, a, b)))
    u = u_of(a, b)
    assert result["u_statistic"] == u
    assert result["tamanho_efeito"] == pytest.approx(1 - 2 * u / (60 * 80), abs=5e-5)
    counts = pd.Series(np.concatenate([a, b])).value_counts()
    n = 140
    spread = math.sqrt(60 * 80 / 12 * ((n + 1) - (counts**3 - counts).sum() / (n * (n - 1))))
    z = (max(u, 4800 - u) - 2400 - 0.5) / spread
    assert result["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_weights_stand_for_repeated_rows(spark):
    rows = [(1, True, 3), (2, True, 1), (2, False, 4), (3, False, 2), (1, False, 1)]
    weighted = spark.createDataFrame(rows, "x INT, a BOOLEAN, w INT")
    spread = [(x, a) for x, a, w in rows for _ in range(w)]
    plain = spark.createDataFrame(spread, "x INT, a BOOLEAN")
    one = stats.mann_whitney(stats.labeled_samples(weighted, F.col("x"), F.col("a"), F.col("w")))
    two = stats.mann_whitney(stats.labeled_samples(plain, F.col("x"), F.col("a")))
    assert stats.as_record(one) == stats.as_record(two)


def test_distinct_and_equal_groups(spark, normals):
    a, b, c = normals
    far, near = (stats.as_record(stats.mann_whitney(samples(spark, a, x))) for x in (b, c))
    assert far["significativo"] and far["tamanho_efeito"] > 0.8
    assert not near["significativo"]


def test_a_hot_value_is_one_row(spark):
    a, b = [3.0] * 3000 + [1.0, 5.0], [3.0] * 3000 + [2.0, 9.0]
    # Ties half, the 3s above 2, and 5 above everything but 9.
    expected = 3000 * 3000 / 2 + 3000 + 3001
    assert stats.as_record(stats.mann_whitney(samples(spark, a, b)))["u_statistic"] == expected


def test_insufficient_identical_and_null(spark):
    short = stats.as_record(stats.mann_whitney(samples(spark, [1.0], [1.0, 2.0, 3.0])))
    assert (short["mensagem"], short["u_statistic"], short["significativo"]) == (stats.INSUFFICIENT, None, None)
    assert (short["n_a"], short["n_b"]) == (1, 3)
    empty = stats.as_record(stats.mann_whitney(samples(spark, [None], [None])))
    assert (empty["n_a"], empty["n_b"]) == (0, 0)
    same = stats.as_record(stats.mann_whitney(samples(spark, [3.0] * 5, [3.0] * 5)))
    assert (same["p_value"], same["significativo"]) == (1.0, False)
    nulls = stats.as_record(stats.mann_whitney(samples(spark, [1, None, 2, 3, None, 4, 5], [10, 11, 12, 13, 14])))
    assert (nulls["n_a"], nulls["p_value"]) == (5, 0.007937)


# Welch


def test_welch(spark, normals):
    a, b, _ = normals
    result = stats.as_record(stats.welch_t_test(samples(spark, a, b), alpha=0.001))
    va, vb = a.var(ddof=1), b.var(ddof=1)
    assert result["t_statistic"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va / 100 + vb / 100), abs=1e-4)
    assert result["cohens_d"] == pytest.approx((a.mean() - b.mean()) / math.sqrt((va + vb) / 2), abs=1e-4)
    assert (result["p_value"], result["significativo"], result["alpha"]) == (0.0, True, 0.001)


def test_welch_without_spread(spark):
    same = stats.as_record(stats.welch_t_test(samples(spark, [3.0] * 5, [3.0] * 5)))
    assert (same["t_statistic"], same["p_value"], same["significativo"], same["cohens_d"]) == (None, None, False, 0.0)
    apart = stats.as_record(stats.welch_t_test(samples(spark, [3.0] * 5, [4.0] * 5)))
    assert (apart["t_statistic"], apart["p_value"], apart["significativo"]) == (-math.inf, 0.0, True)
    short = stats.as_record(stats.welch_t_test(samples(spark, [1.0], [1.0, 2.0])))
    assert (short["t_statistic"], short["cohens_d"], short["mensagem"]) == (None, None, stats.INSUFFICIENT)


# Wording


def test_description(spark, normals):
    a, b, c = normals
    far = stats.as_record(stats.describe_test_result(stats.welch_t_test(samples(spark, a, b)), "H1"))
    assert far["hipotese"] == "H1"
    assert far["conclusao"].startswith("Rejeita H0 (p=0.0000 < alpha=0.05).")
    assert far["conclusao"].endswith("(grande).") and "Cohen's d" in far["conclusao"]
    assert "Welch" in far["premissas"] and "n=200 (n_a=100, n_b=100)" in far["premissas"]
    near = stats.as_record(stats.describe_test_result(stats.mann_whitney(samples(spark, a, c), 0.01), "H2"))
    assert near["conclusao"].startswith("Nao rejeita H0") and "Tamanho do efeito (r)" in near["conclusao"]
    assert "nao-parametrico" in near["premissas"] and near["premissas"].endswith("Nivel de significancia: 0.01.")
    short = stats.as_record(stats.describe_test_result(stats.mann_whitney(samples(spark, [1.0], b)), "H3"))
    assert short["conclusao"].startswith("Inconclusivo: amostra insuficiente (n_a=1, n_b=100).")
    assert short["premissas"] == "Teste nao executado."


# Correlation, independence, outliers


def test_spearman_agrees_with_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, 500)
    y = x + rng.integers(-10, 11, 500)
    rows = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    expected = pd.Series(x).rank().corr(pd.Series(y).rank())
    result = stats.as_record(stats.spearman(rows, F.col("x"), F.col("y")))
    assert result["tamanho_efeito"] == pytest.approx(expected, abs=5e-5)
    assert (result["n"], result["significativo"]) == (500, True)


def test_chi_square_with_an_empty_cell(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "y")] * 30
    result = stats.as_record(stats.chi_square(spark.createDataFrame(rows, "a STRING, b STRING"), "a", "b"))
    assert (result["chi2"], result["graus"], result["n"]) == (12.0, 1, 60)
    assert result["p_value"] == pytest.approx(math.erfc(math.sqrt(6)), abs=1e-6)


def test_outliers(spark):
    values = [float(i % 10) for i in range(1000)] + [100.0, -50.0]
    rows = spark.createDataFrame(list(enumerate(values)), "id LONG, v DOUBLE")
    found = stats.outliers_iqr(rows, "id", "v").orderBy("id").collect()
    assert [(r["valor"], r["lado"]) for r in found] == [(100.0, "acima"), (-50.0, "abaixo")]
    assert {r["valor"] for r in stats.outliers_zscore(rows, "id", "v").collect()} == {100.0, -50.0}


def test_late_orders_score_lower(tables):
    result = stats.as_record(stats.delay_score_test(tables))
    # Late: o2 (1) and o6 (3); on time: o1 (5, 2) and o3 (4).
    assert (result["n_a"], result["n_b"], result["u_statistic"]) == (2, 3, u_of([1, 3], [5, 2, 4]))


@pytest.mark.parametrize("small", [1, 2, 5, 8])
def test_exact_u_of_any_size(small):
    """The tail by inclusion and exclusion equals a table of all U, and no size changes the rule."""
    for large in (8, 30, 61):
        ways = [1] + [0] * (small * large)
        for i in range(1, small + 1):
            for value in range(small * large, large + i - 1, -1):
                ways[value] -= ways[value - large - i]
            for value in range(i, small * large + 1):
                ways[value] += ways[value - i]
        for u in (0, small * large // 2, small * large * 3 // 4, small * large):
            exact = sum(ways[u:]) / math.comb(small + large, small)
            assert P._exact_upper(u, small, large) == pytest.approx(exact, rel=1e-12)


def test_u_is_continuous_in_the_sample_size():
    shares = [P.mann_whitney_two_sided(round(0.36 * 8 * n), 8, n, 0) for n in (240_000, 249_999, 250_001, 260_000, 10**9)]
    assert max(shares) - min(shares) < 1e-4


def test_student_tail_at_many_degrees():
    # The normal tail with the first terms of its expansion in 1 / df.
    for t in (0.01, 0.5, 1.96, 5.0):
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        for df in (1e7, 1e10, 1e12, 1e15):
            tail = math.erfc(t / math.sqrt(2)) + 2 * density * (t * (t * t + 1) / (4 * df))
            assert P.student_two_sided(t, df) == pytest.approx(tail, rel=1e-6, abs=1e-12)
    assert round(P.student_two_sided(0.5, 1e12), 6) == 0.617075
    assert P.student_two_sided(60.0, 1e9) == 0.0 and P.student_two_sided(0.0, 1e9) == 1.0


def test_student_rules_meet():
    for t in (0.3, 2.0, 6.0):
        a = P.incomplete_beta(6_000.0, 0.5, 12_000.0 / (12_000.0 + t * t))
        assert P.student_two_sided(t, 12_000.0) == pytest.approx(a, rel=1e-9, abs=1e-14)


def test_chi_square_tail_at_many_degrees():
    for df in (1e6, 1e9):
        z = 1.5  # Wilson-Hilferty
        x = df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3
        assert P.chi_square_upper(x, df) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-4)


def test_loops_that_do_not_end_raise(monkeypatch):
    monkeypatch.setattr(P, "MAX_TERMS", 3)
    for run in (lambda: P.incomplete_beta(50.0, 60.0, 0.4), lambda: P.student_two_sided(3.0, 1e6), lambda: P.chi_square_upper(50.0, 60.0), lambda: P.chi_square_upper(90.0, 60.0)):
        with pytest.raises(ArithmeticError, match="not converged"):
            run()


def test_chi_square_of_many_labels(spark):
    """One label holds a third of all rows; margins are joined, so no window gathers all cells."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9973).alias("x"), (F.col("id") * 7919 % 101).alias("y")
    )
    found = stats.chi_square(rows, "x", "y")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    table = rows.toPandas()
    cells = table.groupby(["x", "y"]).size().rename("o").reset_index()
    r, c = table.groupby("x").size(), table.groupby("y").size()
    expected = cells["x"].map(r) * cells["y"].map(c) / len(table)
    record = found.first()
    assert record["chi2"] == pytest.approx((cells["o"] ** 2 / expected).sum() - len(table), abs=1e-3)
    assert record["graus"] == (len(r) - 1) * (len(c) - 1) and record["n"] == 60_000
