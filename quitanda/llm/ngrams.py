"""Counts of hashed n-grams over all documents, and scores under two multinomials."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quitanda.llm.frames import durable, given_back, size_checked
from quitanda.llm.words import LOWER_CODES, STEP, flat, mix, windows, word_hashes

BUCKETS = 1 << 16
#: Log ratios are kept as whole numbers of this fraction of a nat, so sums do not depend on their order.
UNIT = 1 << 16

#: From the bytes and bounds of texts: the bucket of every n-gram, and the bounds of the texts among them.
Grams = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_grams(raw: np.ndarray, bounds: np.ndarray, size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of bytes, with A-Z in lower case; none across texts."""
    hashed = np.zeros(max(0, len(raw) - size + 1), np.uint16)
    for lo, hi in windows(raw, bounds):
        hi = min(hi, len(hashed))
        total = np.zeros(max(0, hi - lo), np.uint64)
        for k in range(size):
            total = total * STEP + LOWER_CODES[raw[lo + k : hi + k]]
        hashed[lo:hi] = (total >> np.uint64(48)).astype(np.uint16)
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    inside = np.ones(len(raw) + size, bool)
    for k in range(1, size):
        inside[bounds[1:][np.diff(bounds) >= k] - k] = False
    return hashed[inside[: len(hashed)]], np.append(0, np.cumsum(counts))


def word_grams(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed single words and pairs of neighbouring words, in lower case."""
    words, ends = word_hashes(raw, bounds)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(ends))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    two = mix(words[pair] * STEP + words[pair + 1])
    grams = np.concatenate([words, two]) >> np.uint64(48)
    texts = np.concatenate([owner, owner[pair]])
    order = np.argsort(texts, kind="stable")
    return grams[order].astype(np.uint16), np.searchsorted(texts[order], np.arange(len(bounds)))


def gram_counts(docs: DataFrame, text: str, trusted: str, grams: Grams, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-grams of all rows and of rows whose `trusted` is true, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_counts, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, bounds = grams(*flat(part.column(0)))
                raw_counts += np.bincount(found, minlength=buckets)
                chosen = np.repeat(part.column(1).fill_null(False).to_numpy(zero_copy_only=False), np.diff(bounds))
                target += np.bincount(found[chosen], minlength=buckets)
        used = np.flatnonzero(raw_counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw_counts[used], target[used])], ["bucket", "raw", "target"])

    rows = docs.select(F.col(text), F.col(trusted).cast("boolean")).mapInArrow(given_back(run), "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(target share / raw share) of every bucket, in units, with one added to all counts.

    The table has BUCKETS rows whatever the corpus, so it may come to the driver.
    Without any target n-gram all ratios are 0.
    """
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS, np.int64)
    ratio = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    return np.rint(ratio * UNIT).astype(np.int64)


def text_scores(texts: pa.Array, ratios: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its n-grams' ratios, in units, and their number."""
    sums, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(texts), 256):
        found, bounds = grams(*flat(texts.slice(start, 256)))
        running = np.append(0, np.cumsum(ratios[found]))
        sums.append(running[bounds[1:]] - running[bounds[:-1]])
        numbers.append(np.diff(bounds))
    return np.concatenate(sums), np.concatenate(numbers)


def trusted_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """`docs` with `_quality` of their labels: the largest where several rows label one id, null where none does."""
    best = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    best = durable(best.withColumnRenamed("doc_id", "_labelled"))
    return docs.drop("_quality", "_labelled").join(size_checked(best), F.col(doc_id).cast("long") == F.col("_labelled"), "left").drop("_labelled")
