"""Run registered queries on Spark and their SQL on DuckDB and report differences.

    python -m checks.compare FOLDER [query ...]
"""

from __future__ import annotations

import decimal
import glob
import os
import sys
import time
from collections.abc import Iterable

import duckdb
from pyspark.sql import DataFrame

from checks.catalog import ORACLE, QUERIES
from quitanda.session import build_session


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    """Connection with one view per Parquet file of the folder."""
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return f"{value:f}"
    return repr(value)


def _table(names: list[str], rows: Iterable[Iterable[object]]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in map(tuple, rows)]
    return [names[i] for i in order], sorted(plain)


def spark_types(df: DataFrame) -> dict[str, str]:
    names = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}
    return {c: names.get(t, t.upper()) for c, t in df.dtypes}


def compare(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences in columns, types and values; empty when the results match."""
    result = connection.sql(sql)
    types = dict(zip(result.columns, map(str, result.types)))
    problems = []
    mine = spark_types(df)
    if set(mine) != set(types):
        return [f"columns {sorted(mine)} / {sorted(types)}"]
    problems += [f"type of {c}: {mine[c]} / {types[c]}" for c in mine if mine[c] != types[c].replace(" ", "")]
    _, left = _table(df.columns, df.collect())
    _, right = _table(list(result.columns), result.fetchall())
    if len(left) != len(right):
        problems.append(f"rows {len(left)} / {len(right)}")
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, first {different[0]}")
    return problems


def main(arguments: list[str]) -> int:
    folder, *names = arguments
    spark = build_session("compare", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(folder)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            problems = compare(df, connection, ORACLE[name]) if name in ORACLE else [f"{df.count()} rows, no SQL"]
        except Exception as error:  # report and go on
            problems = [f"error {type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems) and name in ORACLE
        print(f"{name:32s} {time.time() - start:6.2f}s  {'ok' if not problems else '; '.join(problems)}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
