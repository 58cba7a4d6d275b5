"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Pieces differ only by length when they are packed, so the plan is made on a table of
counts by length, whose size the sequence length bounds: a bin is filled greedily with
the longest pieces that fit, then its smallest piece is replaced by two unpacked ones
that fit the expanded gap more tightly, and the pattern found is repeated as long as
its lengths last.  Tasks then number the pieces of each length and read their places
off the plan.  Nothing but the counts and the plan passes through the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quitanda.llm.bpe import default_tokenizer, encoded_slices
from quitanda.llm.frames import durable, given_back

CAPACITY = 2048
SEPARATOR = 0


def _pieces(docs: pa.Array, ids: list[np.ndarray], capacity: int, separator: int) -> tuple[list[list], list[np.ndarray]]:
    """Columns doc_id, piece, start, length and ids_crc32 of the pieces of documents, and the pieces' ids."""
    rows, parts = [], []
    for doc, own in zip(docs.to_pylist(), ids, strict=True):
        whole = np.append(own, separator).astype("<u4")
        for k, start in enumerate(range(0, len(whole), capacity)):
            part = whole[start : start + capacity]
            rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            parts.append(part)
    return [list(c) for c in zip(*rows, strict=True)] or [[]] * 5, parts


def _arrays(columns: list[list]) -> list[pa.Array]:
    return [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def cut_pieces(encoded: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, ids) of rows (doc_id, ids) with the separator added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            columns, parts = _pieces(batch.column(0), [flat[a:b] for a, b in pairwise(bounds.tolist())], capacity, separator)
            ends = np.cumsum([0, *columns[3]], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, "<u4"), *parts]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*_arrays(columns), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*NAMES, "ids"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{PIECE}, ids array<int>")


def encode_pieces(docs: DataFrame, path: str, doc_id: str, text: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of texts: encoded and cut in one task, so ids never leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded_slices(batches, path):
            columns, _ = _pieces(batch.column(0), [np.frombuffer(i, "<u4") for i in ids], capacity, separator)
            yield pa.RecordBatch.from_arrays(_arrays(columns), NAMES)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(given_back(run), PIECE)


def two_that_fit(left: np.ndarray, gap: int, least: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum over `least` and up to `gap`."""
    lengths = np.flatnonzero(left[: max(0, gap)])
    if not len(lengths):
        return None
    place = np.searchsorted(lengths, gap - lengths, side="right") - 1
    other = np.where(place >= 0, lengths[place], 0)
    # A length that is there once cannot be taken twice: take the next shorter one.
    twice = (other == lengths) & (left[lengths] < 2)
    other = np.where(twice, np.where(place > 0, lengths[np.maximum(place - 1, 0)], 0), other)
    total = np.where(other > 0, lengths + other, 0)
    best = int(np.argmax(total))
    return (int(lengths[best]), int(other[best])) if total[best] > least else None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, number of bins so filled), using up all counts."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] += count
    plan = []
    while left.any():
        gap, items = capacity, []
        while gap and len(fitting := np.flatnonzero(left[: gap + 1])):
            items.append(int(fitting[-1]))
            left[items[-1]] -= 1
            gap -= items[-1]
        while gap:
            smallest = min(items)
            two = two_that_fit(left, gap + smallest, smallest) if len(items) > 1 else None
            if two is None:
                break
            items.remove(smallest)
            left[smallest] += 1
            items.extend(two)
            left[list(two)] -= 1 if two[0] != two[1] else 2
            gap += smallest - sum(two)
        used = Counter(items)
        more = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= more * n
        plan.append((tuple(sorted(items, reverse=True)), more + 1))
    return plan


def slots_of(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of equal places: pieces of a length from number `first` on go to bins from `bin` on."""
    seen: Counter = Counter()
    rows, bins = [], 0
    for items, times in plan:
        offset = 0
        for length in items:
            rows.append((length, seen[length], bins, offset))
            seen[length] += times
            offset += length
        bins += times
    rows.sort()
    names = ("length", "first", "bin", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def number_by_length(pieces: DataFrame, rows: int) -> DataFrame:
    """Add `number`, from 0 within each length; frequent lengths are numbered by many tasks."""
    salts = 64 + rows // 500_000
    parts = ["length", "_salt"]
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    local = F.row_number().over(Window.partitionBy(*parts).orderBy("doc_id", "piece", "ids_crc32"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy(*parts).count().withColumn("_base", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    numbered = salted.withColumn("_local", local).join(base.drop("count"), parts)
    return numbered.withColumn("number", F.col("_base") + F.col("_local") - 1).drop("_salt", "_local", "_base")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces (doc_id, piece, start, length, ids_crc32); they are materialised."""
    pieces = durable(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    slots = slots_of(plan_patterns(counts, capacity))
    # Length and number make one key; a run of places starts at each of these.
    span = 1 << 44
    starts = slots["length"] * span + slots["first"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            number = pdf["number"].to_numpy()
            at = np.searchsorted(starts, pdf["length"].to_numpy() * span + number, side="right") - 1
            yield pdf.drop(columns="number").assign(
                sequence_id=slots["bin"][at] + number - slots["first"][at], offset=slots["offset"][at]
            )

    numbered = number_by_length(pieces, sum(counts.values()))
    schema = ", ".join(f"{name} {kind}" for name, kind in pieces.dtypes)
    return numbered.mapInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    A null or empty text is the separator alone.  Rows without an id, repeated rows and
    repeated ids are packed each on its own; other columns are left out; an empty table
    gives no rows.  Only documents longer than a sequence are cut.
    """
    return place_pieces(encode_pieces(docs, path, doc_id, text, capacity), capacity)


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Token ids of every sequence, from placed pieces and the pieces' ids."""
    with_ids = packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return with_ids.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))


def op8_pack(spark, folder: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, default_tokenizer())
