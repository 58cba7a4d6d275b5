"""Line deduplication over levelled sorted runs of line hashes, in DataFrame functions only.

Lines are split and hashed once and written by batch.  A run holds one row per line key: its
128-bit hash, the number of documents with it and the largest id among them, sorted by hash.  Every batch is merge-joined with the runs before it: the anti-join sends keys that no run
has to a new run, so runs share no key and are read side by side; keys that are known go as updates
to runs of their own, which few lines need.  Both kinds enter at level 0; once a level holds `fanout`
runs they are compacted into one run of the next level, so the number of runs grows with the logarithm of
the number of batches.  That number itself grows with the logarithm of the documents, since every batch
shuffles the hashes of all runs (a checkpoint does not keep its partitioning).
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quitanda.llm.frames import Scratch, durable, row_key, size_checked

BLANKS = " \t\n\x0b\f\r"
MIN_CHARS = 40
MIN_DOCUMENTS = 5
HASH = ["h1", "h2"]
#: Documents that two batches hold; twice as many documents make one batch more.
DOCS_OF_TWO_BATCHES = 100_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text: str) -> Column:
    """Lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def hashed(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")]


def batches_for(documents: int) -> int:
    """Batches for so many documents: two at least, and one more whenever they double."""
    return 2 + math.ceil(math.log2(max(1.0, documents / DOCS_OF_TWO_BATCHES)))


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, *columns: str) -> DataFrame:
    """(id, place, h1, h2) of every line whose key has `min_chars` code points, with other columns of `docs`."""
    lines = docs.select(*columns, F.col(doc_id).cast("long").alias("id"), F.posexplode(lines_of(text)).alias("place", "line"))
    lines = lines.filter(F.length("line") >= min_chars).withColumn("line", line_key(F.col("line")))
    return lines.filter(F.length("line") >= min_chars).select(*columns, "id", "place", *hashed("line"))


def batch_run(lines: DataFrame) -> DataFrame:
    """Keys of a batch of lines with the number of distinct ids that hold them and the largest id."""
    counted = lines.select("id", *HASH).distinct().groupBy(*HASH)
    return counted.agg(F.count("id").alias("n_docs"), F.max("id").alias("last_id"))


def side_by_side(runs: list[DataFrame]) -> DataFrame:
    """Rows of several runs."""
    return reduce(DataFrame.unionByName, (r.select(*HASH, "n_docs", "last_id") for r in runs))


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several that share keys: counts add up, the largest id stays."""
    return side_by_side(runs).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))


@dataclass
class LineRuns:
    """Runs of new keys and of updates, by level; all are durable, so losing an executor loses none of them."""

    fanout: int = 2
    min_chars: int = MIN_CHARS
    levels: list[list[DataFrame]] = field(default_factory=list)
    updates: list[list[DataFrame]] = field(default_factory=list)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Take in a batch of documents, see `add_lines`."""
        return self.add_lines(hashed_lines(docs, doc_id, text, self.min_chars))

    def add_lines(self, lines: DataFrame) -> DataFrame:
        """Take in a batch of hashed lines; returns its run with `fresh`: whether no earlier run has the key.

        Counts of batches add up to documents if no id is in two batches.
        """
        run, fresh = batch_run(lines), F.lit(True)
        for i, old in enumerate(r for level in self.levels for r in level):
            known = old.select(*HASH, F.lit(True).alias(f"known{i}")).hint("merge")
            run = run.join(known, HASH, "left")
            fresh = fresh & F.col(f"known{i}").isNull()
        run = durable(run.select(*HASH, "n_docs", "last_id", fresh.alias("fresh")).sortWithinPartitions(*HASH))
        first = not self.levels
        self._place(self.levels, run.filter("fresh").drop("fresh"), 0, side_by_side)
        if not first:
            self._place(self.updates, run.filter("NOT fresh").drop("fresh"), 0, merged)
        return run

    def _place(self, levels: list[list[DataFrame]], run: DataFrame, level: int, compact) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append(run)
        if len(levels[level]) >= self.fanout:
            whole = durable(compact(levels[level]).repartition(*HASH).sortWithinPartitions(*HASH))
            levels[level] = []
            self._place(levels, whole, level + 1, compact)

    def totals(self) -> DataFrame:
        """Every key once: runs of new keys side by side, with the updates of all levels added."""
        rows = side_by_side([r for level in self.levels for r in level])
        later = [r for level in self.updates for r in level]
        if not later:
            return rows
        more = merged(later).select(*HASH, F.col("n_docs").alias("more"), F.col("last_id").alias("later"))
        return rows.join(more, HASH, "left").select(
            *HASH, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_id", "later").alias("last_id")
        )


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
    batches: int | None = None,
) -> DataFrame:
    """`docs` without lines whose key at least `min_documents` documents hold.

    Such lines stay in the rows with the largest id that holds them.  Adds `n_lines`
    (before dropping), `n_dropped` and `kept_text`, replacing columns of these names.
    Rows that share an id are one document, rows without an id count as none and never are
    the last holder; a null text is one empty line.  An empty table gives no rows.
    The number of batches follows the input unless it is given; results do not depend on it.
    """
    batches = batches or batches_for(docs.count())
    docs = docs.withColumns({"_key": row_key(doc_id, text), "_id": F.col(doc_id).cast("long")})
    scratch = Scratch(docs.sparkSession)
    lines = hashed_lines(docs, "_id", text, min_chars, "_key").withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int"))
    lines = scratch.save(lines, "batch")
    runs = LineRuns(min_chars=min_chars)
    for batch in range(batches):
        runs.add_lines(lines.filter(F.col("batch") == batch))
    frequent = durable(runs.totals().filter((F.col("n_docs") >= min_documents) & F.col("last_id").isNotNull()))
    gone = lines.join(size_checked(frequent), HASH).filter(F.col("id").isNull() | (F.col("id") < F.col("last_id")))
    gone = durable(gone.groupBy("_key").agg(F.collect_set("place").alias("_gone")))
    scratch.clear()
    lines, gone_at = lines_of(text), F.coalesce("_gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone_at)
    return (
        docs.drop("n_lines", "n_dropped", "kept_text")
        .join(gone, "_key", "left")
        .withColumns(
            {
                "n_lines": F.size(lines).cast("long"),
                "n_dropped": F.size(gone_at).cast("long"),
                "kept_text": F.when(F.col("_gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(
                    F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
                ),
            }
        )
        .drop("_key", "_id", "_gone")
    )


def op10_line_dedup(spark, folder: str) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    kept = drop_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS place FROM docs),
keyed AS (
  SELECT doc_id, place, lines[place] AS line,
         translate(trim(lines[place], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key
  FROM places
),
frequent AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}
),
marked AS (
  SELECT k.doc_id, k.place, k.line, coalesce(k.doc_id < f.last_id, false) AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
