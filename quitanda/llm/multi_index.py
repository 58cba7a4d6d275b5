"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised with its own codebook, so K codewords a half make K x K
cells; K grows with the root of the number of vectors.  A query walks the cells in the order
of their summed distance, with a heap over the two lists of codewords, until they hold enough
entries to name k neighbours.  The k-th score found is a floor: the walk goes on through
every cell whose inner product with the query may still pass that floor, and their entries
are ranked by the exact inner product.  Where a dense group fills many cells, its own queries
have a high floor and stop early, and others pass it by, since it holds nothing above theirs.

What a cell may hold is its codewords' inner product and `margin` deviations of what the
codewords leave over.  Among Gaussian scores the k-th of n lies tau deviations out, of
which a part rho is left over, so tau * rho + z(target) * sqrt(1 - rho^2) deviations find the
share `target` of the true neighbours at any n; rho is measured on the sample of the codebooks.

Cells are laid out in blocks of a bounded number of rows, a larger cell over several.  Vectors
are shuffled once for each of the two walks, queries travel to the blocks that they walk, and
a block meets its queries as a stream, so no task holds more than a block and a batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from quitanda.llm.frames import durable

SAMPLE_ROWS = 20_000
ROUNDS = 12
NEIGHBOURS = 20
#: Share of the true neighbours that the margin is set for.
TARGET = 0.95
#: Rows that a cell holds on the average, as long as MOST_CODEWORDS allows.
CELL_ROWS, LEAST_CODEWORDS, MOST_CODEWORDS = 16, 4, 256
#: Entries for each neighbour asked for that the first walk looks at.
SEED = 64
BLOCK_ROWS = 4096


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: finite, not null, not zero."""
    values = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("v")).filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())


def codebook(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a bounded sample; fewer where there are fewer distinct rows."""
    if not sample.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(sample, axis=0)
    centres = distinct[np.random.default_rng(0).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        nearest = quantise(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def quantise(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)


def left_over(sample: np.ndarray, centres: np.ndarray, prior: float = 8.0) -> np.ndarray:
    """Mean square, by codeword and dimension, of what is left of a vector; codewords of few rows lean on all."""
    nearest = quantise(sample, centres)
    rest = (sample - centres[nearest]) ** 2
    sums = np.zeros_like(centres)
    np.add.at(sums, nearest, rest)
    counts = np.bincount(nearest, minlength=len(centres))[:, None]
    return (sums + prior * rest.mean(0)) / (counts + prior)


def margin_for(sample: np.ndarray, books: list[np.ndarray], half: int, k: int, total: int, target: float) -> float:
    """Deviations of what is left over within which the share `target` of k neighbours among `total` lies."""
    parts = zip((sample[:, :half], sample[:, half:]), books, strict=True)
    left = sum(((x - c[quantise(x, c)]) ** 2).sum() for x, c in parts)
    rho2 = min(1.0, float(left / (sample**2).sum()))
    tau = NormalDist().inv_cdf(1 - min(0.5, k / total))
    return tau * rho2**0.5 + NormalDist().inv_cdf(target) * (1 - rho2) ** 0.5


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> np.ndarray:
    """Which cells are walked: pairs of codewords by summed distance, until they hold `enough` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    walked = np.zeros(counts.shape, bool)
    heap, held = [(first[a[0]] + second[b[0]], 0, 0)], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        walked[a[i], b[j]] = True
        held += int(counts[a[i], b[j]])
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
    return walked


@dataclass(frozen=True)
class Layout:
    """Cells that hold vectors, in rising order, with their block, their place in it, and their number of blocks."""

    cells: np.ndarray
    block: np.ndarray
    place: np.ndarray
    parts: np.ndarray


def layout(counts: np.ndarray, rows: int) -> Layout:
    """Blocks of at most about `rows` rows: small cells share one, a larger cell has several of its own."""
    cells = np.flatnonzero(counts)
    found, at, held, place = [], 0, 0, 0
    for n in counts.ravel()[cells].tolist():
        parts = -(-n // rows)
        if held and held + n > rows:
            at, held, place = at + 1, 0, 0
        found.append((at, place, parts))
        if parts > 1:
            at, held, place = at + parts, 0, 0
        else:
            held, place = held + n, place + 1
    block, places, parts = np.array(found, np.int64).reshape(-1, 3).T
    return Layout(cells, block, places, parts)


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves, what they leave over, and where the vectors of each cell lie."""

    half: int
    books: list[np.ndarray]
    left: list[np.ndarray]
    counts: np.ndarray
    layout: Layout
    margin: float
    enough: int

    def chosen(self, v: np.ndarray, floor: float | None) -> np.ndarray:
        """Cells of the first walk; with a floor, the others that may hold a score at or above it."""
        x, y = v[: self.half], v[self.half :]
        # The larger a half's inner product with its codeword, the smaller its distance.
        first, second = self.books[0] @ x, self.books[1] @ y
        walked = walk(-first, -second, self.counts, self.enough)
        if floor is None:
            return walked
        spread = np.sqrt((self.left[0] @ x**2)[:, None] + (self.left[1] @ y**2)[None, :])
        return (first[:, None] + second[None, :] + self.margin * spread >= floor) & ~walked

    def visits(self, v: np.ndarray, floor: float | None) -> list[tuple[int, bytes]]:
        """Blocks to visit, each with the bits of its cells that were chosen."""
        at, out = self.layout, []
        chosen = self.chosen(v, floor).ravel()[at.cells]
        for block in np.unique(at.block[chosen]):
            lo, hi = np.searchsorted(at.block, [block, block + 1])
            bits = np.packbits(chosen[lo:hi]).tobytes()
            out.extend((int(block) + part, bits) for part in range(at.parts[lo]))
        return out

    def located(self, cell: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each vector, dealt by its id where its cell has several, and its cell's place there."""
        i = np.searchsorted(self.layout.cells, cell)
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.layout.block[i] + mixed.astype(np.int64) % self.layout.parts[i], self.layout.place[i]


def best_of(block: pd.DataFrame, v: np.ndarray, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): for each query the k best of a block's chosen cells, none below its floor."""
    ids, place, out = block["vec_id"].to_numpy(), block["place"].to_numpy(), []
    for start in range(0, len(asked), 256):
        some = asked.iloc[start : start + 256]
        own, floor = some["vec_id"].to_numpy()[:, None], some["floor"].fillna(-np.inf).to_numpy(float)[:, None]
        scores = np.stack(some["v"].to_numpy()) @ v.T
        bits = np.unpackbits(np.stack([np.frombuffer(m, np.uint8) for m in some["mask"]]), axis=1)
        scores[(bits[:, place] == 0) | (own == ids)] = -np.inf
        least = floor
        if scores.shape[1] > 4 * k:  # all that may be among the k best, with ties
            least = np.maximum(floor, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None])
        slack = 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
        q, e = np.nonzero((scores >= least - slack) & np.isfinite(scores))
        out.append(pd.DataFrame({"query_id": own[q, 0], "vec_id": ids[e], "q": some["v"].to_numpy()[q], "v": block["v"].to_numpy()[e]}))
    found = pd.concat(out)
    # Summed in one order, so a score does not depend on the block.
    score = np.array([float(np.sum(x * y)) for x, y in zip(found["q"], found["v"], strict=True)], float)
    found = found.assign(score=score)[["query_id", "vec_id", "score"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id").head(k)


def met(stored: DataFrame, visited: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best that each query finds in each block it visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, block, v = None, [], None, None
        for pdf in batches:
            for number, part in pdf.groupby("block", sort=True):
                if number != at:
                    at, parts, block = number, [], None
                stays = part["mask"].isna()
                if stays.any():
                    parts.append(part.loc[stays, ["vec_id", "v", "place"]])
                asked = part[~stays]
                if len(asked):
                    if block is None:
                        block = pd.concat(parts).sort_values("vec_id").astype({"place": "int64"})
                        v, parts = np.stack(block["v"].to_numpy()), []
                    yield best_of(block, v, asked, k)

    nothing = {"mask": F.lit(None).cast("binary"), "floor": F.lit(None).cast("double")}
    both = stored.withColumns(nothing).unionByName(visited.withColumn("place", F.lit(None).cast("int")))
    # Vectors of a block come before the queries that visit it.
    ordered = both.repartition("block").sortWithinPartitions("block", F.col("mask").isNotNull())
    return ordered.mapInPandas(run, "query_id long, vec_id long, score double")


def top(found: DataFrame, k: int) -> DataFrame:
    """`found` with its rank, the k best of every query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def fitted(entries: DataFrame, total: int, codewords: int) -> tuple[np.ndarray, int, list[np.ndarray]]:
    """A sample of about SAMPLE_ROWS vectors, chosen by a hash of the id, the first half's length and both codebooks."""
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    chosen = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = np.array([r["v"] for r in entries.filter(chosen).orderBy("vec_id").limit(2 * SAMPLE_ROWS).select("v").collect()], float)
    if sample.ndim < 2:
        return sample, 0, []
    half = (sample.shape[1] + 1) // 2
    return sample, half, [codebook(sample[:, :half], codewords), codebook(sample[:, half:], codewords)]


def search(
    vectors: DataFrame,
    is_query,
    k: int = NEIGHBOURS,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    codewords: int | None = None,
    target: float = TARGET,
    block_rows: int = BLOCK_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows found nearest to each query row.

    `is_query` is a condition on vec_id.  Nearness is the inner product of the original
    vectors in double precision, ties go to the smaller id, a query is not its own
    neighbour.  Null, zero and non-finite vectors and rows without an id take no part; of
    rows with one id and vector one takes part; other columns are left out; an empty table
    gives no rows.  A query that finds fewer than k rows at first walks every cell.
    Codebooks are fitted to about SAMPLE_ROWS rows, chosen by a hash of the id; all rows are
    indexed.  All vectors have one length.  `codewords` a half follow the input unless given.
    """
    rows = usable(vectors, vec_id, vector)
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    # Of equal vectors only the k + 1 with the smallest ids can be among k neighbours.
    entries = rows.distinct().withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).drop("n")
    entries, queries = durable(entries), durable(rows.filter(is_query).distinct())
    total = entries.count()
    codewords = codewords or min(MOST_CODEWORDS, max(LEAST_CODEWORDS, round((total / CELL_ROWS) ** 0.5)))
    sample, half, books = fitted(entries, total, codewords)
    if not books:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wide = len(books[1])

    def quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                yield pdf.assign(cell=quantise(v[:, :half], books[0]) * wide + quantise(v[:, half:], books[1]))

    indexed = durable(entries.mapInPandas(quantised, "vec_id long, v array<double>, cell long"))
    counts = np.zeros((len(books[0]), wide), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # at most MOST_CODEWORDS squared
        counts.ravel()[r["cell"]] = r["count"]
    left = [left_over(sample[:, :half], books[0]), left_over(sample[:, half:], books[1])]
    index = MultiIndex(half, books, left, counts, layout(counts, block_rows), margin_for(sample, books, half, k, total, target), seed * k)

    def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            block, place = index.located(pdf["cell"].to_numpy(), pdf["vec_id"].to_numpy())
            yield pdf.drop(columns="cell").assign(block=block, place=place)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part = pdf.iloc[start : start + 64]
                floors = part["floor"].to_numpy(float) if "floor" in part else [None] * len(part)
                found = [index.visits(np.asarray(v), f) for v, f in zip(part["v"], floors, strict=True)]
                taken = part.iloc[np.repeat(np.arange(len(part)), [len(f) for f in found])]
                blocks, masks = zip(*(pair for f in found for pair in f)) if len(taken) else ((), ())
                floor = taken["floor"] if "floor" in part else None
                yield pd.DataFrame({"vec_id": taken["vec_id"], "v": taken["v"], "floor": floor}).assign(block=blocks, mask=masks)

    schema = "vec_id long, v array<double>, floor double, block long, mask binary"
    stored = indexed.mapInPandas(located, "vec_id long, v array<double>, block long, place int")
    early = durable(top(met(stored, queries.mapInPandas(visits, schema), k), k))
    # Without k rows there is no floor yet: everything is open.
    floor = F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf")))
    floors = early.groupBy("query_id").agg(floor.alias("floor")).withColumnRenamed("query_id", "vec_id")
    open_queries = queries.join(floors, "vec_id", "left").fillna(float("-inf"), "floor")
    late = met(stored, open_queries.mapInPandas(visits, schema), k)
    found = top(early.drop("rank").unionByName(late), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_nearest(spark, folder: str) -> DataFrame:
    """The 20 nearest of every query, whose id is divisible by 20, among all vectors."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)
