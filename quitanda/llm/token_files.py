"""Token counts from flat token files without an index, by a separator scan.

A file is a row of 16-bit token ids in which an end-of-document id closes every
document.  It is read in blocks that know nothing of documents: each block is searched
for the separator in one vectorised step, and a prefix scan over the blocks carries the
last separator, the number of documents and the offset across block borders.  The scan
has two levels, so a file with very many blocks is scanned by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quitanda.llm.bpe import default_tokenizer, encoded_slices
from quitanda.llm.frames import durable

SEPARATOR = 49407
BLOCK_TOKENS = 1 << 16
FILE_DOCUMENTS = 1000
BLOCKS_TOGETHER = 1024


def write_blocks(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, separator: int = SEPARATOR
) -> DataFrame:
    """Blocks (file, block, tokens) of flat files: each holds the documents of FILE_DOCUMENTS ids, by id.

    Special tokens in texts are ordinary text here, so that only ends of documents
    have the separator.  Rows without an id make one file, of null id.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded_slices(batches, path, special=False):
            tokens = [np.append(np.frombuffer(i, "<u4"), separator).astype("<u2").tobytes() for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], ["doc_id", "tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, file, block, parts, held = 2 * block_tokens, None, 0, [], 0

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal block, parts, held
            data = b"".join(parts)
            ends = range(size, len(data) + 1, size) if whole else [*range(size, len(data), size), len(data)] * bool(data)
            start = 0
            for end in ends:
                arrays = [pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([data[start:end]], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "tokens"])
                start, block = end, block + 1
            parts, held = [data[start:]], len(data) - start

        for batch in batches:
            for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != file:
                    yield from flush(whole=False)
                    file, block, parts, held = key, 0, [], 0
                parts.append(tokens)
                held += len(tokens)
                if held >= size:
                    yield from flush(whole=True)
        yield from flush(whole=False)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    tokens = rows.mapInArrow(encode, "doc_id long, tokens binary").withColumn("file", file_of("doc_id"))
    ordered = tokens.repartition("file").sortWithinPartitions("file", "doc_id", "tokens").select("file", "tokens")
    return ordered.mapInArrow(cut, "file long, block long, tokens binary")


def file_of(doc_id: str):
    return F.floor(F.col(doc_id) / F.lit(FILE_DOCUMENTS)).cast("long")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Tokens and places of the separator in every block: (file, block, n, ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b or b"", "<u2") for b in batch.column("tokens").to_pylist()]
            ends = [np.flatnonzero(b == separator) for b in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array([len(b) for b in found], pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                ["file", "block", "n", "ends"],
            )

    return blocks.select("file", "block", "tokens").mapInArrow(run, "file long, block long, n long, ends array<long>")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """Documents of flat token files: (file, doc_no, start, n_tokens, closed).

    `doc_no` counts from 0 within a file, `n_tokens` leaves out the separator, and
    tokens behind the last separator of a file are a document that is not closed.
    Empty or null blocks hold nothing; empty documents have 0 tokens; no blocks give
    no rows.  Blocks of a file must have distinct numbers.
    """
    scanned = durable(scan_blocks(blocks, separator)).withColumn("part", F.floor(F.col("block") / BLOCKS_TOGETHER))
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))

    def scan(df: DataFrame, keys: list[str], order: str, n: str, last, count: str, names: list[str]) -> DataFrame:
        """Tokens, last separator and documents of all earlier rows of `keys`."""
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn(names[0], F.coalesce(F.sum(n).over(before), F.lit(0)))
        return df.withColumns(
            {names[1]: F.max(F.col(names[0]) + last).over(before), names[2]: F.coalesce(F.sum(count).over(before), F.lit(0))}
        )

    inner = scan(scanned.withColumn("found", F.size("ends")), ["file", "part"], "block", "n", last, "found", ["at", "seen", "nth"])
    parts = inner.groupBy("file", "part").agg(
        F.sum("n").alias("part_n"), F.max(F.col("at") + last).alias("part_last"), F.sum("found").alias("part_found")
    )
    outer = scan(parts, ["file"], "part", "part_n", F.col("part_last"), "part_found", ["part_at", "part_seen", "part_nth"])
    outer = durable(outer.withColumn("key", F.coalesce("file", F.lit(-(1 << 62)))))
    blocks = inner.withColumn("key", F.coalesce("file", F.lit(-(1 << 62)))).drop("file").join(outer, ["key", "part"])
    carried = F.coalesce(F.col("part_at") + F.col("seen"), F.col("part_seen"), F.lit(-1))
    rows = blocks.select(
        "file", (F.col("part_at") + F.col("at")).alias("base"), (F.col("part_nth") + F.col("nth")).alias("first"), carried.alias("carried"), "ends",
        F.posexplode("ends").alias("i", "end"),
    )
    before = F.when(F.col("i") == 0, F.col("carried")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1))
    closed = rows.select(
        "file", (F.col("first") + F.col("i")).alias("doc_no"), (before + 1).alias("start"), (F.col("base") + F.col("end") - before - 1).alias("n_tokens"), F.lit(True).alias("closed")
    )
    files = outer.groupBy("key").agg(
        F.max("file").alias("file"), F.sum("part_n").alias("n"), F.coalesce(F.max(F.col("part_at") + F.col("part_last")), F.lit(-1)).alias("last"), F.sum("part_found").alias("found")
    )
    rest = files.filter(F.col("n") - 1 > F.col("last")).select(
        "file", F.col("found").alias("doc_no"), (F.col("last") + 1).alias("start"), (F.col("n") - 1 - F.col("last")).alias("n_tokens"), F.lit(False).alias("closed")
    )
    return closed.unionByName(rest)


def op7_token_counts(spark, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat token files that hold all of them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(write_blocks(docs, default_tokenizer()))
    order = Window.partitionBy("file").orderBy("doc_id")
    names = docs.select("doc_id", file_of("doc_id").alias("file")).withColumn("doc_no", (F.row_number().over(order) - 1).cast("long"))
    same = counted["file"].eqNullSafe(names["file"]) & (counted["doc_no"] == names["doc_no"])
    return counted.join(names, same).select(names["doc_id"], counted["file"], counted["doc_no"], "start", "n_tokens", "closed")
