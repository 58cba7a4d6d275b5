"""Importance resampling as a quality classifier.

Raw and target text are modelled as multinomials over hashed single words and word
pairs.  A document's importance weight is the ratio of its probabilities under the
two; adding Gumbel noise to the log weight and taking the k largest draws k documents
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quitanda.llm.frames import durable
from quitanda.llm.ngrams import UNIT, gram_counts, log_ratios, text_scores, trusted_rows, word_grams

SEED = 17
#: Keys of the draw are whole numbers of this fraction of a nat.
KEY_UNIT = 1 << 20
#: Of the share of documents that labels call bad, so much is still drawn: doubt favours a document.
SLACK = 0.25


def log_weights(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with `log_weight` and `n_grams`; a text without words weighs 0."""

    @F.arrow_udf("struct<units: bigint, n_grams: bigint>")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in text_scores(texts, ratios, word_grams)], ["units", "n_grams"])

    rows = docs.drop("log_weight", "n_grams", "_w").withColumn("_w", weigh(F.col(text).cast("string")))
    return rows.withColumns({"log_weight": F.col("_w.units") / UNIT, "n_grams": F.col("_w.n_grams")}).drop("_w")


def gumbel(seed: int, *keys: str):
    """Gumbel noise that depends on the seed and the keys alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, column: str, k: int, buckets: int = 4096) -> int:
    """The k-th largest value of a column of longs, by counting ever finer buckets."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = -(-(high - low + 1) // buckets)
        inside = df.filter(F.col(column).between(low, high))
        place = F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("long") if width > 1 else F.col(column) - F.lit(low)
        counts = {r["place"]: r["count"] for r in inside.groupBy(place.alias("place")).count().collect()}
        for place in sorted(counts, reverse=True):
            if counts[place] >= k:
                low, high = low + place * width, min(high, low + (place + 1) * width - 1)
                break
            k -= counts[place]
    return low


def draw(weighted: DataFrame, k: int, seed: int = SEED, doc_id: str = "doc_id") -> DataFrame:
    """Add `key`, the log weight with noise, and `kept`, whether it is among the k largest.

    Ties in the key go to the smaller id (a null id is the smallest); rows equal in both
    are kept or left together, so k can be passed by repeats of one row.
    """
    if k <= 0:
        return weighted.withColumns({"key": F.col("log_weight"), "kept": F.lit(False)})
    noisy = F.round((F.col("log_weight") + gumbel(seed, doc_id)) * KEY_UNIT).cast("long")
    rows = durable(weighted.withColumns({"_key": noisy, "_id": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62)))}))
    least = kth_largest(rows, "_key", k)
    above = rows.filter(F.col("_key") > least).count()
    ties = rows.filter(F.col("_key") == least).withColumn("_id", -F.col("_id"))
    last = -kth_largest(ties, "_id", k - above)
    kept = (F.col("_key") > least) | ((F.col("_key") == least) & (F.col("_id") <= last))
    return rows.withColumns({"key": F.col("_key") / KEY_UNIT, "kept": kept}).drop("_key", "_id")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, log_weight, n_grams, key, kept) of every row.

    `share` of the rows are drawn; by default the share of good ones among the labelled
    rows and SLACK of the rest.  A null or empty text weighs 0, as does every text where
    nothing is trusted; repeated rows get equal keys; an empty table gives no rows.
    """
    rows = trusted_rows(docs.select(doc_id, text), labels, doc_id).withColumn("_trusted", F.col("_quality") == 1)
    ratios = log_ratios(gram_counts(rows, text, "_trusted", word_grams))
    weighted = log_weights(rows, ratios, text).select(F.col(doc_id).alias("doc_id"), "log_weight", "n_grams", F.col("_quality"))
    weighted = durable(weighted)
    n, good = weighted.agg(F.count("*"), F.avg((F.col("_quality") == 1).cast("double"))).first()
    if share is None:
        share = 1.0 if good is None else good + SLACK * (1 - good)
    return draw(weighted.drop("_quality"), min(n, round(share * n)), seed)


def op1_resample(spark, folder: str) -> DataFrame:
    """Weight, key and verdict of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    return resample(docs, labels)
