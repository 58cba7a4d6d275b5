"""Corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing.

Each stage takes the rows that its predecessor kept and wrote; all but the last return
the columns of documents.  A stage hands operators what they read and keeps the rows whole beside
it, so no column of a caller is lost to one of an operator's names.  Null texts count as empty,
repeated rows are judged alike, rows without an id stay unless the rules reject them, and an
empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quitanda.llm.bpe import default_tokenizer
from quitanda.llm.entries import ship_code
from quitanda.llm.frames import delete_folder, durable, size_checked
from quitanda.llm.jaccard_join import near_duplicates
from quitanda.llm.line_dedup import drop_repeated_lines
from quitanda.llm.packing import pack_documents
from quitanda.llm.quality_rules import apply_quality, fit_quality
from quitanda.llm.secret_scan import mask_secrets
from quitanda.session import ensure_checkpoint_dir


def _beside(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, text): whole rows beside what the operators read."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), "doc_id", "text")


def _whole(rows: DataFrame, docs: DataFrame, text: str | None = None) -> DataFrame:
    """The rows as they were, with another text, and its length where documents carry one."""
    kinds = dict(docs.dtypes)

    def column(name: str) -> F.Column:
        if text and name == "text":
            return F.col(text)
        if text and name == "n_chars":
            return F.length(text).cast(kinds[name])
        return F.col("_row")[name]

    return rows.select(*(column(name).alias(name) for name in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship_code(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return _whole(apply_quality(_beside(docs), fit_quality(docs, labels)).filter("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many others repeat."""
    return _whole(drop_repeated_lines(_beside(docs)), docs, "kept_text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Rows without an id stay.  Rows that share an id are one document and stay together.
    """
    ship_code(spark)
    gone = near_duplicates(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(size_checked(durable(gone)), "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked."""
    ship_code(spark)
    return _whole(mask_secrets(_beside(docs)), docs, "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    ship_code(spark)
    return pack_documents(docs, default_tokenizer())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_dedup),
    ("secret_scan", secrets),
    ("best_fit_packing", packing),
]

#: The stages hash, train and pack, which SQL does not express; tests/llm/test_pipeline.py compares them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read back, and goes once the next is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
