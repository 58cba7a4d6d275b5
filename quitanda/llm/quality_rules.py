"""Quality rules: fixed word rules, then a length-normalised log-likelihood ratio.

Two multinomials over hashed n-grams are counted over whole corpora: one over the
trusted documents (label quality 1), one over all.  A document's score is the mean log
ratio of its n-grams, in whole units, so every run gives the same value.  The threshold
is the middle of the range of scores that best separates labelled good from bad
documents; each document is kept or rejected by it, with no chance involved.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quitanda.llm.frames import given_back
from quitanda.llm.ngrams import UNIT, byte_grams, gram_counts, log_ratios, text_scores, trusted_rows
from quitanda.llm.words import BYTE_CODES, SPACE, STEP, flat, mix, word_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW_WORDS = 3
#: Scores are counted in steps of 1/200 nat between -10 and 10; beyond is the same.
STEPS, EDGE = 200, 10
NOTES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*SYMBOLS.encode()]] = True


def repeated_words(words: np.ndarray, size: int = WINDOW_WORDS) -> int:
    """Words inside windows that occur at least twice."""
    if len(words) <= size:
        return 0
    total = words[: len(words) - size + 1].copy()
    for k in range(1, size):
        total = mix(total * STEP + words[k : len(words) - size + 1 + k])
    _, inverse, counts = np.unique(total, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def text_notes(texts: pa.Array) -> list[np.ndarray]:
    """The five counts of NOTES for each text; null counts as empty."""
    raw, bounds = flat(texts)
    words, ends = word_hashes(raw, bounds, lower=False)
    sums = lambda mask: np.diff(np.append(0, np.cumsum(mask))[bounds])
    repeats = [repeated_words(words[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    lines = [Counter(x for x in (t or "").split("\n") if x.strip(BLANKS)) for t in texts.to_pylist()]
    again = [c.total() - len(c) for c in lines]
    letters = ~SPACE[raw] & ((raw & 0xC0) != 0x80)
    return [np.diff(ends), sums(letters), sums(_SYMBOL[raw]), np.array(again, np.int64), np.array(repeats, np.int64)]


@dataclass(frozen=True)
class QualityModel:
    """Log ratios by bucket, and the least score of a kept document."""

    ratios: np.ndarray
    threshold: float


def noted(docs: DataFrame, ratios: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` with the counts of NOTES, `base_failed`, and `score`, the mean log ratio (null without n-grams)."""
    kinds = "struct<" + ", ".join(f"{n}: bigint" for n in NOTES) + ", score: double>"

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for start in range(0, len(texts), 256):
                part = texts.slice(start, 256)
                sums, numbers = text_scores(part, ratios, byte_grams)
                score = np.where(numbers > 0, sums / np.maximum(numbers, 1) / UNIT, np.nan)
                arrays = [pa.array(c, pa.int64()) for c in text_notes(part)]
                parts.append(pa.StructArray.from_arrays([*arrays, pa.array(score, from_pandas=True)], [*NOTES, "score"]))
            yield pa.concat_arrays(parts) if parts else pa.array([], parts_type)

    @F.arrow_udf(kinds)
    def note(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from given_back(run)(batches)

    parts_type = pa.struct([*((n, pa.int64()) for n in NOTES), ("score", pa.float64())])
    rows = docs.drop(*NOTES, "score", "base_failed", "_note").withColumn("_note", note(F.col(text).cast("string")))
    rows = rows.select("*", "_note.*").drop("_note")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return rows.withColumn("base_failed", failed)


def best_threshold(bins: dict[tuple[int, int], int]) -> float:
    """Middle of the scores that best separate quality 1 (above) from 0, given counts by (step, quality)."""
    low, high = -EDGE * STEPS, EDGE * STEPS
    good, bad = (np.array([bins.get((s, q), 0) for s in range(low, high + 1)], float) for q in (1, 0))
    if not good.any() or not bad.any():
        return -float(EDGE)
    below = lambda x: np.append(0, np.cumsum(x))[:-1] / x.sum()
    gain = np.rint((below(bad) - below(good)) * 1e9)
    best = np.flatnonzero(gain == gain.max())
    return float(low + (best[0] + best[-1]) / 2) / STEPS


def fit_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Count both multinomials over all of `docs` and find the threshold on its labelled rows."""
    rows = trusted_rows(docs.select(doc_id, text), labels, doc_id).withColumn("_trusted", F.col("_quality") == 1)
    ratios = log_ratios(gram_counts(rows, text, "_trusted", byte_grams))
    judged = noted(rows.filter(F.col("_quality").isin(0, 1)), ratios, text)
    # Not a filter: Spark would push it down with a second run of the Python function beside the first.
    within = F.when(~F.col("base_failed"), F.least(F.greatest(F.col("score"), F.lit(-EDGE)), F.lit(EDGE)))
    step = F.floor(within * STEPS).cast("int")
    counts = judged.groupBy(step.alias("step"), F.col("_quality").cast("int").alias("quality")).count().collect()
    return QualityModel(ratios, best_threshold({(r["step"], r["quality"]): r["count"] for r in counts if r["step"] is not None}))


def apply_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """`docs` with the counts, `base_failed`, `score` and `kept`.

    A null or empty text has no words, so the word rules reject it.  Every row is judged
    on its own: repeated rows get equal verdicts, null ids change nothing, and columns
    of the same names are replaced.  Without labels of both kinds every score passes.
    """
    verdict = F.coalesce(F.col("score") >= F.lit(model.threshold), F.lit(True))
    return noted(docs, model.ratios, text).withColumn("kept", ~F.col("base_failed") & verdict)


def op4_quality_rules(spark, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    done = apply_quality(docs, fit_quality(docs, labels))
    return done.select("doc_id", *NOTES, "base_failed", "kept", "score")
