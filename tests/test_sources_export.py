"""Reading CSV folders, running the batch job and writing JSON."""

import json
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from quitanda.operators import cohort, season
from quitanda.operators.clustering import Clustering
from quitanda.plans import catalog, export, job
from quitanda.schemas import TABLES, table_schema
from quitanda.sources import csv_tables, quoted_csv


@pytest.fixture(scope="module")
def csv_folder(tables, tmp_path_factory):
    """The small marketplace as headed CSV files with shuffled columns."""
    folder = tmp_path_factory.mktemp("csv")
    for name, df in tables.items():
        shuffled = df.select(*reversed(df.columns)).toPandas()
        shuffled.to_csv(folder / f"shop_{name}_dataset.csv", index=False)
    return str(folder)


def test_tables_survive_csv(spark, tables, csv_folder):
    loaded = csv_tables.load_tables(spark, csv_folder)
    assert set(loaded) == set(TABLES)
    for name, df in loaded.items():
        assert df.schema == table_schema(name), name
        assert df.exceptAll(tables[name]).count() == 0 or name == "order_reviews"
        assert df.count() == tables[name].count()
    zips = {r[0] for r in loaded["customers"].select("customer_zip_code_prefix").collect()}
    assert "01001" in zips
    # Empty text is NULL.
    assert loaded["order_reviews"].filter("review_comment_message = ''").count() == 0
    assert loaded["order_reviews"].filter("review_comment_message IS NULL").count() == 3


def test_quoted_line_breaks_stay_in_one_row(spark, tmp_path):
    (tmp_path / "order_reviews.csv").write_text(
        "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\n"
        'r1,o1,5,,"bom\n""muito"" bom",2018-01-01 00:00:00,\n'
    )
    row = csv_tables.read_table(spark, "order_reviews", [str(tmp_path / "order_reviews.csv")]).first()
    assert row["review_comment_message"] == 'bom\n"muito" bom'
    assert row["review_creation_date"] == datetime(2018, 1, 1)


def awkward_csv(rows=400):
    """Quoted line breaks, doubled quotes, commas, \\r\\n, blank lines and a last line without an end."""
    texts = ["plain", 'a "quoted" word', "two\nlines", "three\n\n\"lines\",\nwith more", ", comma", "", "ends in quote\"", "\"", "é\n" * 5, "x" * 300]
    made = [(f"r{i}", f"o{i % 7}", str(i % 5 + 1), texts[i % 3], texts[i % len(texts)]) for i in range(rows)]
    quoted = lambda v: f'"{v.replace(chr(34), chr(34) * 2)}"' if any(c in v for c in '",\n') else v
    lines = [",".join(map(quoted, row)) + ",2018-01-01 00:00:00," + ("\r" if i % 4 == 0 else "") for i, row in enumerate(made)]
    lines.insert(9, "")
    head = "review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp"
    return made, head + "\n" + "\n".join(lines)


@pytest.mark.parametrize("size", ["1g", "97b", "1000b"])
def test_quoted_records_across_byte_ranges(spark, tmp_path, size):
    made, text = awkward_csv()
    for k in range(2):
        (tmp_path / f"{k}_order_reviews.csv").write_text(text, encoding="utf-8", newline="")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size if size == "1g" else "0")
        found = csv_tables.read_table(spark, "order_reviews", [str(p) for p in sorted(tmp_path.iterdir())])
        rows = sorted(tuple(r)[:5] for r in found.select("review_id", "order_id", "review_score", "review_comment_title", "review_comment_message").collect())
        parts = quoted_csv.file_lines(spark, [str(tmp_path / "0_order_reviews.csv")]).select("_range").distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert rows == sorted((a, b, int(c), d or None, e or None) for a, b, c, d, e in made * 2)
    assert parts == 1 if size == "1g" else parts > 10


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"a, b",c\n1,2\n')
    (tmp_path / "b.csv").write_text("c,d\n1,2\n")
    assert quoted_csv.read_quoted(spark, [str(tmp_path / "a.csv")], csv_tables.OPTIONS).columns == ["a, b", "c"]
    with pytest.raises(ValueError, match="differ"):
        quoted_csv.read_quoted(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], csv_tables.OPTIONS)


def test_missing_files_are_listed_together(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id\n")
    with pytest.raises(FileNotFoundError) as error:
        csv_tables.require_inputs(spark, str(tmp_path))
    assert "orders" in str(error.value) and "sellers" in str(error.value) and "*customers*" not in str(error.value)


def test_store_replaces(spark, tables, tmp_path):
    csv_tables.store_tables({"sellers": tables["sellers"]}, str(tmp_path))
    csv_tables.store_tables({"sellers": tables["sellers"].limit(1)}, str(tmp_path))
    assert csv_tables.stored_tables(spark, str(tmp_path), ["sellers"])["sellers"].count() == 1


# Named results


def test_chapters_hold_all_results(tables):
    results = catalog.run_all(tables)
    assert len(results) == 17
    shares = [r["contagem"] for r in results["funil_status"].collect()]
    assert shares == sorted(shares, reverse=True)
    scores = [tuple(r)[4:7] for r in results["rfm_scores"].collect()]
    assert scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError, match="unknown chapter"):
        catalog.run_named_queries("07_nada", tables)


# Values


def test_json_safe_values(spark):
    row = (float("nan"), float("inf"), 1.5, None, Decimal("2.50"), date(2017, 3, 1), datetime(2017, 3, 1, 9, 0), [1.0, float("nan")], 7)
    df = spark.createDataFrame(
        [row], "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e DECIMAL(10,2), f DATE, g TIMESTAMP_NTZ, h ARRAY<DOUBLE>, i INT"
    )
    assert tuple(export.json_safe(df).first()) == (None, None, 1.5, None, 2.5, "2017-03-01", "2017-03-01", [1.0, None], 7)


def test_rounding_leaves_integers_and_nulls(spark):
    df = spark.createDataFrame([(1.23456, 5, None, 9.87654)], "a DOUBLE, b INT, c DOUBLE, d DOUBLE")
    assert tuple(export.round_fields(df, ["a", "b", "c"]).first()) == (1.23, 5, None, 9.87654)


def test_rows_of_any_number_make_one_document(spark, tmp_path, caplog):
    """More rows than the driver would form a document of, in order, over several part files."""
    df = spark.range(30_000).select("id", F.lit(float("nan")).alias("x"), F.lit("ótimo, \"bom\"\n").alias("t"), F.expr("array(1.5D, NULL)").alias("a"))
    path = str(tmp_path / "rows.json")
    export.write_json(spark, df.repartition(7).orderBy(F.desc("id")), path)
    rows = json.loads((tmp_path / "rows.json").read_text(encoding="utf-8"))
    assert [r["id"] for r in rows] == list(range(29_999, -1, -1))
    assert rows[5] == {"id": 29_994, "x": None, "t": 'ótimo, "bom"\n', "a": [1.5, None]}
    assert "above 500 KB" in caplog.text
    export.write_json(spark, df.limit(0), path)
    assert json.loads((tmp_path / "rows.json").read_text()) == []
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []
    export.write_rows(df.limit(11), str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 11


def test_a_large_document_warns(spark, tmp_path, caplog):
    export.write_json(spark, ["x" * 1000] * 600, str(tmp_path / "big.json"))
    assert "above 500 KB" in caplog.text
    export.write_json(spark, {"texto": "ótimo"}, str(tmp_path / "small.json"))
    assert "ótimo" in (tmp_path / "small.json").read_text(encoding="utf-8")


def test_heatmap_document(tables):
    document = export.heatmap_document(cohort.cohort_retention(tables))
    assert document["coortes"] == ["2017-01", "2017-03", "2017-05"]
    assert document["periodos"] == [0, 1, 2]
    assert document["dados"][1] == {"coorte": "2017-03", "tamanho": 2, "retencao": [1.0, None, None]}


def test_absent_results_are_skipped(spark, tables, tmp_path):
    results = {
        "sazonalidade_mensal": season.monthly_series(tables),
        "clustering": Clustering(5, 5, None, [{"k": 2, "inertia": 1.0}], [{"k": 2, "silhouette": 0.5}], 2, [[0.1, 0.2]]),
        "geo_correlacao": {"teste_usado": "Spearman", "p_value": 0.5},
        "unknown": [1],
    }
    names = export.export_results(spark, results, str(tmp_path))
    assert names == ["02_rfm_clustering.json", "04_geo_correlacao.json", "05_sazonalidade_mensal.json"]
    months = json.loads((tmp_path / "05_sazonalidade_mensal.json").read_text())
    assert [m["mes"] for m in months] == ["2017-01", "2017-03", "2017-05"]
    assert json.loads((tmp_path / "02_rfm_clustering.json").read_text())["centroids"] == [[0.1, 0.2]]


# Whole job


def test_job_writes_every_file(spark, csv_folder, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "cluster", lambda scores, restarts: Clustering(scores.count(), 4, scores, k_best=2))
    names = job.run_job(spark, csv_folder, str(tmp_path / "store"), str(tmp_path / "out"))
    assert names == [e.file for e in export.EXPORTS] and len(names) == 18
    for name in names:
        text = (tmp_path / "out" / name).read_text(encoding="utf-8")
        assert "NaN" not in text and len(text) < 500 * 1024
        json.loads(text)
    spread = json.loads((tmp_path / "out" / "02_rfm_distribuicao.json").read_text())
    assert set(spread) == {"recency", "frequency", "monetary"}
    assert set(spread["monetary"]) == {"min", "max", "media", "mediana", "std", "q1", "q3"}
    assert np.isclose(spread["frequency"]["media"], 1.25)


def test_job_reports_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(job, "build_session", lambda: spark)
    assert job.main(["--input", str(tmp_path), "--store", str(tmp_path / "s"), "--output", str(tmp_path / "o")]) == 1


def test_header_needs_no_records(spark, tmp_path, monkeypatch):
    """Names come from the files' first lines; records are put together only for a header of several lines."""
    for name, head in (("a", "x,y"), ("b", "x,y\r")):
        (tmp_path / f"{name}.csv").write_bytes(f'{head}\n1,"two\nlines"\n'.encode())
    (tmp_path / "long.csv").write_bytes(b'x,"y\nz"\n1,2\n')
    whole = quoted_csv.records
    assert [r["y\nz"] for r in quoted_csv.read_quoted(spark, [str(tmp_path / "long.csv")], csv_tables.OPTIONS).collect()] == ["2"]
    monkeypatch.setattr(quoted_csv, "records", lambda *a: whole(*a).filter(F.raise_error(F.lit("read")).isNull()))
    assert quoted_csv.read_quoted(spark, [str(tmp_path / f"{n}.csv") for n in "ab"], csv_tables.OPTIONS).columns == ["x", "y"]
    with pytest.raises(ValueError, match="differ"):
        (tmp_path / "c.csv").write_text("x,z\n1,2\n")
        quoted_csv.read_quoted(spark, [str(tmp_path / f"{n}.csv") for n in "ac"], csv_tables.OPTIONS)
