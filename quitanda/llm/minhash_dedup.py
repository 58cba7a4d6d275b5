"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

Texts with equal shingle sets are one set.  Each set has a signature (superminhash.py) whose
registers are cut into bands; sets that agree in a whole band share a bucket.  With 32 bands of
4 registers a pair at the threshold of 0.8 misses all buckets with a probability of about 5e-8.

Buckets with few pairs between components are compared at once.  In the others a hub, the set
that shares most buckets with others, is compared with the members of other components, which
joins most of a group; links are confirmed on whole sets.  Members of buckets that then still hold
several components are dealt out anew under their rarest shingles: two sets within the threshold
t share one of the first (1 - t) n + 1 of them, and positions in these lists tell whether enough
shingles are left.  So texts that have little but a common passage part without a comparison.
After a hub has joined most of each list, all pairs of different components that positions allow are
compared, so nothing is dropped.

Pairs whose signatures agree in less than t - 0.2 of the registers are not read in full: at
128 registers that is 5.6 standard deviations below t.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quitanda.llm.components import components
from quitanda.llm.frames import Scratch, durable, keep_rows, release, size_checked
from quitanda.llm.superminhash import signatures
from quitanda.llm.words import mix, shingle_sets
from quitanda.session import compacted

SHINGLE_WORDS = 4
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 80
BANDS, BAND_ROWS = 32, 4
REGISTERS = BANDS * BAND_ROWS
#: What an estimate from signatures may be off by.
MARGIN = 0.2
#: Parts of buckets with at most so many open pairs a member are compared at once.
PAIRS_PER_MEMBER = 4
#: Cells of the table that tells rare shingles from common ones; any order gives exact results.
CELLS = 1 << 18
ROWS_AT_ONCE = 256


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(start, ROWS_AT_ONCE)
            yield part.column(0), list(shingle_sets(part.column(1), SHINGLE_WORDS))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One 64-bit key for every band of every signature."""
    parts = found.reshape(len(found), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        keys = mix(keys * np.uint64(3) + parts[:, :, k])
    return keys.view(np.int64)


def signed_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch, bands): size, 128-bit digest and signature of every text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches):
            found = signatures(sets, REGISTERS)
            sums = [[int(f(s).sum(dtype=np.uint64).view(np.int64)) for s in sets] for f in (lambda x: x, lambda x: mix(x + np.uint64(1)))]
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            columns = [
                ids,
                pa.array([len(s) for s in sets], pa.int64()),
                *(pa.array(s, pa.int64()) for s in sums),
                pa.array([row.tobytes() for row in found.astype("<u2")], pa.binary()),
                pa.ListArray.from_arrays(ends, pa.array(band_keys(found).ravel())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "sketch", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sketch binary, bands array<long>")


def shared_rows(rows: DataFrame) -> DataFrame:
    """(key, sid, n, pos, weight): rows whose key several sets have; `weight` is the number of entries under all keys of a set."""
    shared = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("sid").alias("low"), F.max("sid").alias("high"), F.max(leads()).alias("leads"))
    shared = durable(shared.filter("low < high AND leads").select("key", "members"))
    rows = durable(rows.join(size_checked(shared), "key").distinct())
    weights = rows.groupBy("sid").agg(F.sum("members").alias("weight"))
    return rows.join(weights, "sid").select("key", "sid", "n", "pos", "weight")


def bucket_rows(single: DataFrame) -> DataFrame:
    """Rows of sets that share a bucket with others."""
    return shared_rows(single.select(F.explode("bands").alias("key"), "sid", "n", F.lit(0).cast("long").alias("pos")))


def list_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the sets of `ids` under the rarest of their shingles, `pos` shingles being rarer still."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for _, sets in _sets(batches):
            total += np.bincount(_cells(np.concatenate(sets)), minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    chosen = keep_rows(docs, ids, "doc_id", "left_semi").select("doc_id", "text")
    counts = np.zeros(CELLS, np.int64)
    for r in chosen.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, sets in _sets(batches):
            sizes = np.array([len(s) for s in sets])
            first = np.where(sizes > 0, sizes - -(-PERCENT * sizes // 100) + 1, 0)
            rare = [s[np.lexsort((s, counts[_cells(s)]))[:k]] for s, k in zip(sets, first.tolist(), strict=True)]
            pos = np.arange(first.sum()) - np.repeat(np.cumsum(first) - first, first)
            columns = [np.concatenate(rare).view(np.int64), np.repeat(doc.to_numpy(), first), np.repeat(sizes, first), pos]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "sid", "n", "pos"])

    return shared_rows(chosen.mapInArrow(run, "key long, sid long, n long, pos long"))


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(CELLS)).astype(np.int64)


def leads() -> Column:
    """Whether a set may link, by its position, with one that is no smaller."""
    return (F.col("n") - F.col("pos")) * (100 + PERCENT) >= F.col("n") * 2 * PERCENT


def agreeing(left: pa.Array, right: pa.Array) -> pa.Array:
    """Share of registers in which two signatures agree."""
    x, y = (np.frombuffer(b"".join(side.to_pylist()), "<u2").reshape(-1, REGISTERS) for side in (left, right))
    return pa.array((x == y).mean(axis=1) if len(x) else np.zeros(0))


def common(left: pa.Array, right: pa.Array) -> pa.Array:
    """Sizes of the intersections of sets of hashes."""
    pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
    return pa.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in pairs], pa.int64())


def _ends(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of `rows` (sid, n, data) for both ends."""
    of = lambda end: rows.select(F.col("sid").alias(end), F.col("n").alias(f"n{end}"), F.col("data").alias(f"d{end}"))
    return pairs.join(of("b"), "b").join(of("a"), "a")


def verified(pairs: DataFrame, single: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    agree, overlap = F.arrow_udf(agreeing, "double"), F.arrow_udf(common, "bigint")
    sketches = single.select("sid", "n", F.col("sketch").alias("data"))
    alike = agree("da", "db") >= PERCENT / 100 - MARGIN
    open_ = scratch.save(_ends(pairs, sketches).filter(alike).select("a", "b").distinct())
    ids = open_.select(F.col("a").alias("doc_id")).union(open_.select("b")).distinct()
    ids = durable(compacted(ids, 2 * open_.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["sid", "n", "data"],
            )

    whole = keep_rows(docs, ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "sid long, n long, data binary")
    exact = _ends(open_, whole.filter("n > 0")).withColumn("same", overlap("da", "db"))
    links = F.col("same") * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT
    done = scratch.save(exact.filter(links).select("a", "b").distinct())
    release(docs.sparkSession)
    return done


def open_parts(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of parts that hold several components, with `part`, the set's component, and `few`, whether few pairs are open."""
    if labels is not None:
        rows = rows.join(size_checked(labels.select(F.col("node").alias("sid"), F.col("component").alias("part"))), "sid", "left")
        rows = rows.withColumn("part", F.coalesce("part", "sid"))
    else:
        rows = rows.withColumn("part", F.col("sid"))
    counts = rows.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum(leads().cast("long")).alias("s")).groupBy("key")
    counts = counts.agg(F.sum("c").alias("m"), F.sum("s").alias("leading"), F.sum(F.col("s") * F.col("c")).alias("own"))
    counts = counts.withColumn("open", F.col("leading") * F.col("m") - F.col("own")).filter("open > 0")
    return rows.join(counts.select("key", (F.col("open") <= 2 * PAIRS_PER_MEMBER * F.col("m")).alias("few")), "key")


def may_link(x: str, y: str) -> Column:
    """Whether sizes and positions of two rows of a part allow a link."""
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return left * (100 + PERCENT) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * PERCENT


def small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components of a part that sizes and positions allow; one of the two leads."""
    x, y = rows.filter(leads()).alias("x"), rows.alias("y")
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") != F.col("y.part")) & may_link("x", "y")
    return x.join(y, on).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of each part's hub, the member that shares most entries, with the members of other components."""
    hubs = rows.groupBy("key").agg(F.max(F.struct("weight", "sid", "part")).alias("hub"))
    rows = rows.join(hubs, "key").filter("part <> hub.part")
    return rows.select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Words are separated by [\\x20\\x09-\\x0D]+ and compared with A-Z in lower case.  A text of
    fewer than four words is one shingle; one without words (or null) is linked with nothing.
    Rows of one id are one document: their component is that of all their texts, and all are
    kept or none.  Rows without an id have no component and are kept.  Repeated rows stay, other
    columns are left out, an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scratch = Scratch(spark)
    sets = scratch.save(signed_sets(docs))
    full = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "d1", "d2"]
    copies = full.groupBy(*same).agg(F.min("doc_id").alias("sid"), F.max("doc_id").alias("last")).filter("sid < last").drop("last")
    members = full.join(size_checked(durable(copies)), same, "left").withColumn("sid", F.coalesce("sid", "doc_id"))
    members = scratch.save(members.select("doc_id", "sid", F.col("n_shingles").alias("n"), F.when(F.col("sid") == F.col("doc_id"), F.struct("sketch", "bands")).alias("own")))
    single = members.filter("own IS NOT NULL").select("sid", "n", "own.*")
    # An id with several texts joins their sets.
    several = members.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("last")).filter("a < last")
    links = scratch.save(members.join(size_checked(durable(several)), "doc_id").filter("sid > a").select("a", F.col("sid").alias("b")))
    labels = None if links.isEmpty() else components(links)

    def join_up(pairs: DataFrame) -> None:
        nonlocal links, labels
        found = verified(scratch.save(compacted(pairs.distinct(), 2 * PAIRS_PER_MEMBER * entries)), single, docs, scratch)
        if not found.isEmpty():
            links = scratch.save(compacted(links.union(found), links.count() + found.count()))
            labels = components(links)

    buckets = scratch.save(bucket_rows(single))
    entries = buckets.count()
    rows = scratch.save(compacted(open_parts(buckets, labels), entries))
    if not rows.isEmpty():
        join_up(small_pairs(rows.filter("few")).union(hub_pairs(rows.filter("NOT few"))))
        left = scratch.save(open_parts(rows.filter("NOT few").drop("part", "few"), labels))
        if not left.isEmpty():
            lists = scratch.save(list_rows(docs, durable(left.select(F.col("sid").alias("doc_id")).distinct())))
            join_up(hub_pairs(open_parts(lists, labels)))
            join_up(small_pairs(open_parts(lists, labels)))
    found = members.select("doc_id", "sid")
    if labels is not None:
        found = found.join(size_checked(labels.withColumnRenamed("node", "sid")), "sid", "left")
    else:
        found = found.withColumn("component", F.col("sid"))
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("component", "sid")).alias("component_id"))
    found = sets.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    whole = durable(found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    scratch.clear()
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark, folder: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return near_copies(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
