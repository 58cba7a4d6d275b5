"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quitanda.llm import (
    alignment,
    bpe,
    chat,
    jaccard_join,
    line_dedup,
    minhash_dedup,
    multi_index,
    packing,
    quality_rules,
    resample,
    secret_scan,
    spelling,
    token_files,
)

Query = Callable[[SparkSession, str], DataFrame]
_SHIPPED = "_quitanda_shipped"


#: Rows of an Arrow batch: texts are long, and batches of the default 10,000 rows take hundreds of megabytes.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_ROWS, TEXT_ROWS = "10000", "1000"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: its task functions import it there.

    Unless the session has a batch size of its own, batches are cut to a size that texts allow.
    """
    if spark.conf.get(BATCH) == DEFAULT_ROWS:
        spark.conf.set(BATCH, TEXT_ROWS)
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="quitanda-code-")) / "quitanda_code.zip"
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))
    setattr(context, _SHIPPED, True)


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_code(spark)
        return query(spark, folder)

    return run


_ALL: tuple[Query, ...] = (
    resample.op1_resample,
    jaccard_join.op2_near_duplicates,
    chat.op3_chat_format,
    quality_rules.op4_quality_rules,
    bpe.op5_bpe_encode,
    multi_index.op6_nearest,
    token_files.op7_token_counts,
    packing.op8_pack,
    secret_scan.op9_secret_scan,
    line_dedup.op10_line_dedup,
    alignment.op11_token_alignment,
    spelling.op12_spelling_variants,
    minhash_dedup.op13_minhash_dedup,
)
QUERIES: dict[str, Query] = {query.__name__: _shipped(query) for query in _ALL}
ORACLE: dict[str, str] = {"op3_chat_format": chat.OP3_SQL, "op10_line_dedup": line_dedup.OP10_SQL}
