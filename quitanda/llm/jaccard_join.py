"""Near-duplicate join on word shingles, skipping by relations between sets.

Texts with equal sets are one set.  Every set is indexed under its rarest shingles, so
that two sets within the threshold share one of them (prefix filter).  An index list
keeps size and position of each entry; entries whose positions leave too few shingles
for the threshold are skipped, first as whole blocks of entries.  Entries that no other one of
their list may reach, by sizes and positions, leave the index.

Every set is first compared with two sets only, those that most often stand before it.  Sets found highly similar
to a smaller one, their pivot, form its block, and later answers are derived from the
pivot's: the overlap of two members exceeds the overlap of their pivots by no more than
what each has beyond its pivot.  While lists hold many pairs of blocks of different components,
rounds compare each block with a few of the others in its lists, which joins fragments of one group;
they end once few pairs are left or a round no longer halves them.  All pairs of
blocks that are not yet connected are then compared through their pivots once, and members
only where that bound leaves the answer open.  Every set has a bitmap with the parity of its shingles
by cell: as many bits as differ between two, so many shingles at least are in one set only.  Pairs that this
rules out are met inside the joins alone, where only blocks outside a list's largest component look for others.
So all links between different components are found, and a group of near copies costs
about as much as its index lists are long.

Rarity comes from a table of counts by 16 bits of a shingle's hash: its size is fixed, and
any such order of shingles gives exact results.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quitanda.llm.components import components
from quitanda.llm.frames import Scratch, durable, given_back, keep_rows, release, size_checked
from quitanda.llm.words import mix, shingle_hashes, shingle_sets

SHINGLE_WORDS = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
CELLS = 1 << 16
#: Fewest cells of a set's sketch, and the shingles a cell from which on a set has twice as many.
SKETCH_CELLS, SKETCH_FILL = 256, 4
#: Words of 64 bits in a set's bitmap.
BITMAP = 8
#: Sets that each set is compared with first; all others are met through blocks.
NEIGHBOURS = 2
#: Rounds that join fragments go on while lists hold more open pairs a block than this.
PAIRS_PER_BLOCK = 4
#: Lists of shingles this many times as frequent as the mean are dealt out over several tasks.
HOT = 4


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids and shingle sets of few texts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield part.column(0), list(shingle_sets(part.column(1), SHINGLE_WORDS))


def set_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch, bits): size, 128-bit digest, sketch and bitmap of every text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _slices(batches):
            sums = [[int(f(s).sum(dtype=np.uint64).view(np.int64)) for s in sets] for f in (lambda x: x, lambda x: mix(x + np.uint64(1)))]
            n = pa.array([len(s) for s in sets], pa.int64())
            words = np.stack([bitmap(s) for s in sets]).T
            bits = pa.StructArray.from_arrays([pa.array(w) for w in words], [f"w{i}" for i in range(BITMAP)])
            columns = [ids, n, *(pa.array(s, pa.int64()) for s in sums), pa.array([sketch(s) for s in sets], pa.binary()), bits]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "sketch", "bits"])

    bits = ", ".join(f"w{i}: long" for i in range(BITMAP))
    return docs.mapInArrow(given_back(run), f"doc_id long, n_shingles long, d1 long, d2 long, sketch binary, bits struct<{bits}>")


def cell_counts(docs: DataFrame) -> np.ndarray:
    """Shingles of all texts, repeats included, by the first bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                total += np.bincount(cell_of(shingle_hashes(batch.slice(start, 256).column(0), SHINGLE_WORDS)), minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    counts = np.zeros(CELLS, np.int64)
    for r in docs.select("text").mapInArrow(given_back(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]
    return counts


def cell_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(48)).astype(np.int64)


def postings(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, salt, sid, size, pos): the rarest shingles of every set, enough for the threshold."""
    salts = np.minimum(1 + counts // max(1, HOT * int(counts.mean() + 1)), 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _slices(batches):
            sizes = np.array([len(s) for s in sets])
            prefix = np.where(sizes > 0, sizes - -(-PERCENT * sizes // 100) + 1, 0)
            tokens = [np.zeros(0, np.uint64)]
            for s, p in zip(sets, prefix.tolist(), strict=True):
                order = np.lexsort((s, counts[cell_of(s)]))[:p]
                tokens.append(s[order])
            token = np.concatenate(tokens)
            sid = np.repeat(ids.to_numpy(), prefix)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
            shares = salts[cell_of(token)]
            salt = np.where(shares > 1, 1 + mix(sid.astype(np.uint64)) % shares.astype(np.uint64), 0).astype(np.int64)
            # Size, position and salt travel as one number: an entry is most of what is shuffled.
            packed = (np.repeat(sizes, prefix) << 36) | (pos << 8) | salt
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token.view(np.int64), sid, packed)], ["token", "sid", "packed"])

    rows = docs.mapInArrow(given_back(run), "token long, sid long, packed long").repartition("token", F.col("packed").bitwiseAND(F.lit(255)))
    part = lambda shift, bits: F.shiftright("packed", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return rows.select("token", F.col("packed").bitwiseAND(F.lit(255)).alias("salt"), "sid", part(36, 28).alias("size"), part(8, 28).alias("pos"))


def enough(overlap: Column, sizes: Column) -> Column:
    """Whether an overlap reaches the threshold for sets of these sizes together."""
    return overlap * (100 + PERCENT) >= sizes * PERCENT


def index_lists(found: DataFrame) -> DataFrame:
    """Entries that may link with others of their list, with `first` and `prev`, the first entry and the one before.

    By its position an entry reaches sets of a certain size at most.  One that stays has a next one within its reach,
    or one before it that is large enough and one before it that reaches as far.
    """
    order = Window.partitionBy("token", "salt").orderBy("size", "sid")
    entry = F.struct("size", "sid", "pos")
    reach = F.floor((F.col("size") - F.col("pos")) * (100 + PERCENT) / PERCENT) - F.col("size")
    rows = found.withColumns(
        {
            "prev": F.lag(entry).over(order),
            "first": F.first(entry).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "after": F.lead("size").over(order),
            "reached": F.max(reach).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    smaller = (F.col("prev.size") * 100 >= F.col("size") * PERCENT) & (F.col("reached") >= F.col("size"))
    return rows.filter(smaller | (F.col("after") <= reach) | (F.col("salt") > 0)).drop("after", "reached")


def neighbour_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of every set b with the NEIGHBOURS sets a that most often come first or just before it in its lists."""
    heads = lists.filter("salt > 0 AND prev IS NULL")
    tops = heads.groupBy("token").agg(F.min("first").alias("top"))
    heads = heads.join(tops, "token").select("sid", "size", "pos", F.col("top").alias("o"))
    near = lists.filter("prev IS NOT NULL").select("sid", "size", "pos", F.explode(F.array("first", "prev")).alias("o"))
    left = F.least(F.col("size") - F.col("pos"), F.col("o.size") - F.col("o.pos"))
    pairs = near.unionByName(heads).filter((F.col("sid") != F.col("o.sid")) & enough(left, F.col("size") + F.col("o.size")))
    pairs = pairs.groupBy(F.col("o.sid").alias("a"), F.col("sid").alias("b")).count()
    best = Window.partitionBy("b").orderBy(F.desc("count"), "a")
    return pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= NEIGHBOURS).select("a", "b")


def sketch(s: np.ndarray) -> bytes:
    """Counts of a set's shingles in cells, whose number grows with the set; nothing if one does not fit a byte."""
    cells = max(SKETCH_CELLS, 1 << (len(s) // SKETCH_FILL).bit_length())
    counts = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def sketch_bound(x: bytes, y: bytes) -> int:
    """No less than the overlap of two sets: cell by cell, of the smaller number of cells, they share the smaller count at most."""
    if not x or not y:
        return 1 << 40
    cells = min(len(x), len(y))
    return int(np.minimum(*(np.frombuffer(z, np.uint8).reshape(-1, cells).sum(axis=0, dtype=np.int64) for z in (x, y))).sum())


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of a set's shingles in each of 64 * BITMAP cells."""
    cells = ((s >> np.uint64(8)) % np.uint64(64 * BITMAP)).astype(np.int64)
    odd = (np.bincount(cells, minlength=64 * BITMAP) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def bitmap_bound(sizes: Column, x: Column, y: Column) -> Column:
    """No less than the overlap of two sets of these sizes together: bits that differ are shingles of one of them."""
    apart = sum((F.bit_count(x[f"w{i}"].bitwiseXOR(y[f"w{i}"])) for i in range(BITMAP)), F.lit(0))
    return (sizes - apart) / 2


def common(x: bytes, y: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))


def joined(pairs: DataFrame, rows: DataFrame, compare: Callable[[bytes, bytes], int]) -> DataFrame:
    """(a, b, na, nb, overlap) of pairs of ids: `compare` on the data of `rows` (sid, n, data)."""

    @F.arrow_udf("bigint")
    def compared(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([compare(x, y) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int64())

    of = lambda end: rows.select(F.col("sid").alias(end), F.col("n").alias(f"n{end}"), F.col("data").alias(f"d{end}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").withColumn("overlap", compared("da", "db"))
    return durable(both.select("a", "b", "na", "nb", "overlap"))


def overlaps(pairs: DataFrame, docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, na, nb, overlap) of pairs of ids; where sketches rule a link out, their bound stands for the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, sets in _slices(batches):
            columns = [doc, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["sid", "n", "data"])

    pairs = durable(pairs.select("a", "b"))
    met = durable(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
    bounded = joined(pairs, keep_rows(sketches, met, "sid", "left_semi"), sketch_bound)
    may = enough(F.col("overlap"), F.col("na") + F.col("nb"))
    left = durable(bounded.filter(may).select("a", "b").distinct())
    ids = durable(left.select(F.col("a").alias("doc_id")).union(left.select("b")).distinct())
    rows = keep_rows(docs, ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(given_back(run), "sid long, n long, data binary")
    # Written, since both ends of the pairs read them: texts are hashed once, and no task runs several Python functions.
    scratch = Scratch(docs.sparkSession)
    exact = joined(left, scratch.save(rows), common)
    scratch.clear()
    release(docs.sparkSession)
    return bounded.filter(~may).unionByName(exact)


def linked(compared: DataFrame) -> DataFrame:
    return compared.filter(enough(F.col("overlap"), F.col("na") + F.col("nb")))


def members_of(links: DataFrame) -> DataFrame:
    """(sid, pivot, size, extra): sets linked to a pivot and what each has beyond it."""
    ordered = links.select(
        F.when(F.struct("na", "a") < F.struct("nb", "b"), F.struct(F.col("a").alias("p"), F.col("b").alias("m"), F.col("nb").alias("n")))
        .otherwise(F.struct(F.col("b").alias("p"), F.col("a").alias("m"), F.col("na").alias("n"))).alias("x"),
        "overlap",
    ).select("x.*", "overlap")
    roots = ordered.select("p").distinct().join(ordered.select(F.col("m").alias("p")).distinct(), "p", "left_anti")
    best = ordered.join(roots, "p").groupBy("m").agg(F.min(F.struct((F.col("n") - F.col("overlap")).alias("extra"), "p", "n")).alias("best"))
    return best.select(F.col("m").alias("sid"), F.col("best.p").alias("pivot"), F.col("best.n").alias("size"), F.col("best.extra").alias("extra"))


def blocks_of(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(token, pivot, pos, low, high): every block's first position and range of sizes in every list; a set without pivot is its own block."""
    entries = lists.join(size_checked(members.select("sid", "pivot")), "sid", "left")
    blocks = entries.groupBy("token", F.coalesce("pivot", "sid").alias("pivot")).agg(
        F.min("pos").alias("pos"), F.min("size").alias("low"), F.max("size").alias("high")
    )
    return blocks


def mixed_blocks(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of lists that hold several components, with their component `part` and for each list its outermost blocks `x` and `y`,
    its largest component `main`, its number of blocks `m` and how many pairs of blocks of different components it has, `open`."""
    known = blocks.join(size_checked(labels.select(F.col("node").alias("pivot"), F.col("component").alias("part"))), "pivot", "left")
    known = known.withColumn("part", F.coalesce("part", "pivot"))
    block = F.struct("part", "pivot", "pos", "low", "high")
    parts = known.groupBy("token", "part").agg(F.min(block).alias("x"), F.max(block).alias("y"), F.count("*").alias("c")).groupBy("token")
    lists = parts.agg(
        F.min("x").alias("x"),
        F.max("y").alias("y"),
        F.max(F.struct("c", "part")).alias("main"),
        F.sum("c").alias("m"),
        F.sum(F.col("c") ** 2).alias("own"),
    ).filter("x.part <> y.part")
    open_ = ((F.col("m") ** 2 - F.col("own")) / 2).alias("open")
    return known.join(lists.select("token", "x", "y", F.col("main.part").alias("main"), "m", open_), "token")


def many_open(mixed: DataFrame) -> tuple[bool, float]:
    """Whether lists hold many pairs of blocks of different components, and how many."""
    total = mixed.agg(F.count("*").alias("m"), F.sum(F.col("open") / F.col("m")).alias("open")).first()
    return (total["open"] or 0) > PAIRS_PER_BLOCK * total["m"], total["open"] or 0


def may_link(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether blocks of two components that share a list may hold a link, by sizes and positions."""
    left = F.least(x("high") - x("pos"), y("high") - y("pos"))
    sizes = (x("high") * 100 >= y("low") * PERCENT) & (y("high") * 100 >= x("low") * PERCENT)
    return (x("part") != y("part")) & sizes & enough(left, x("low") + y("low"))


def cross_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of every pivot with the NEIGHBOURS pivots of other components that are most often a list's outermost."""
    one = lambda c: F.col(c)
    other = lambda c: F.col(f"o.{c}")
    rows = mixed.withColumn("o", F.when(F.col("part") == F.col("x.part"), F.col("y")).otherwise(F.col("x")))
    pairs = rows.filter(may_link(one, other)).groupBy(F.col("o.pivot").alias("a"), F.col("pivot").alias("b")).count()
    best = Window.partitionBy("b").orderBy(F.desc("count"), "a")
    near = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= NEIGHBOURS)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def pivot_facts(sketches: DataFrame, members: DataFrame) -> DataFrame:
    """(pivot, n, bits, least, most): a set's size and bitmap, the smallest size in its block and the most that one of it has beyond the pivot."""
    blocks = members.groupBy("pivot").agg(F.min("size").alias("least"), F.max("extra").alias("most"))
    rows = sketches.select(F.col("sid").alias("pivot"), "n", "bits").join(size_checked(durable(blocks)), "pivot", "left")
    return rows.withColumns({"least": F.least("n", "least"), "most": F.coalesce("most", F.lit(0))})


def block_pairs(mixed: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of pivots whose blocks share a list, belong to two components and may hold a link.

    One of the two blocks is outside the list's largest component.
    """
    columns = ["token", "pivot", "part", "main", "pos", "low", "high"]
    of = lambda side: lambda c: F.col(f"{side}.{c}")
    l, r = of("l"), of("r")
    known = facts.select("pivot", "n", "bits", "most")
    x = mixed.filter("part <> main").select(columns).join(known, "pivot").alias("l")
    y = mixed.select(columns).join(known, "pivot").alias("r")
    once = (r("part") == r("main")) | (l("pivot") < r("pivot"))
    bound = bitmap_bound(l("n") + r("n"), l("bits"), r("bits")) + l("most") + r("most")
    may = (l("token") == r("token")) & once & may_link(l, r) & enough(bound, l("low") + r("low"))
    return x.join(y, may).select(F.least(l("pivot"), r("pivot")).alias("a"), F.greatest(l("pivot"), r("pivot")).alias("b")).distinct()


def open_pairs(compared: DataFrame, members: DataFrame, labels: DataFrame, facts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of members of compared, unlinked pivots for which the derived bound and the bitmaps leave a link possible."""
    part = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
    rows = compared.filter(~enough(F.col("overlap"), F.col("na") + F.col("nb")))
    for end in ("a", "b"):
        stats = facts.select(F.col("pivot").alias(end), F.col("least").alias(f"low_{end}"), F.col("most").alias(f"most_{end}"), F.col("bits").alias(f"bits_{end}"))
        rows = rows.join(part(end), end, "left").withColumn(f"part_{end}", F.coalesce(f"part_{end}", end))
        rows = rows.join(stats, end)
    rows = rows.filter("part_a <> part_b AND (most_a > 0 OR most_b > 0)")
    rows = durable(rows.filter(enough(F.col("overlap") + F.col("most_a") + F.col("most_b"), F.col("low_a") + F.col("low_b"))))
    own = rows.select(F.col("a").alias("sid"), F.col("na").alias("size")).union(rows.select("b", "nb")).distinct()
    whole = members.select("sid", "pivot", "size", "extra").unionByName(own.select("sid", F.col("sid").alias("pivot"), "size", F.lit(0).cast("long").alias("extra")))
    whole = durable(whole.join(own.select(F.col("sid").alias("pivot")), "pivot", "left_semi"))
    whole = durable(whole.join(sketches.select("sid", "bits"), "sid"))
    end = lambda e: whole.select(F.col("pivot").alias(e), *(F.col(c).alias(f"{n}{e}") for c, n in (("sid", "s"), ("size", "z"), ("extra", "e"), ("bits", "w"))))
    may = enough(F.col("overlap") + F.col("ea") + F.col("most_b"), F.col("za") + F.col("low_b"))
    may &= enough(bitmap_bound(F.col("za") + F.col("nb"), F.col("wa"), F.col("bits_b")) + F.col("most_b"), F.col("za") + F.col("low_b"))
    rows = rows.join(end("a"), "a").filter(may)
    may = enough(F.col("overlap") + F.col("ea") + F.col("eb"), F.col("za") + F.col("zb"))
    may &= enough(bitmap_bound(F.col("za") + F.col("zb"), F.col("wa"), F.col("wb")), F.col("za") + F.col("zb"))
    may &= enough(bitmap_bound(F.col("na") + F.col("zb"), F.col("bits_a"), F.col("wb")) + F.col("ea"), F.col("za") + F.col("zb"))
    sizes = (F.col("za") * 100 >= F.col("zb") * PERCENT) & (F.col("zb") * 100 >= F.col("za") * PERCENT)
    rows = rows.join(end("b"), "b").filter(may & sizes & ((F.col("sa") != F.col("a")) | (F.col("sb") != F.col("b"))))
    return rows.select(F.col("sa").alias("a"), F.col("sb").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are separated by [\\x20\\x09-\\x0D]+ and compared with A-Z in lower case.  A text
    of fewer than five words is one shingle; one without words (or null) is linked with
    nothing.  Rows of one id are one document: their component is that of all their texts.
    Rows without an id are linked with nothing and have no component.  Repeated rows stay; an
    empty table gives no rows.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    sets = scratch.save(set_digests(docs))
    full = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "d1", "d2"]
    groups = full.groupBy(*same).agg(F.min("doc_id").alias("sid"), F.max("doc_id").alias("last")).filter("sid < last").drop("last")
    members = full.join(size_checked(durable(groups)), same, "left").select("doc_id", F.coalesce("sid", "doc_id").alias("sid"))
    members = durable(members)
    copies = durable(members.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("sid")).cast("int")).alias("own")).filter("own = 0"))
    single = keep_rows(docs.filter("doc_id IS NOT NULL"), copies, "doc_id", "left_anti")
    sketches = keep_rows(full, copies, "doc_id", "left_anti").select(F.col("doc_id").alias("sid"), F.col("n_shingles").alias("n"), F.col("sketch").alias("data"), "bits")
    lists = scratch.save(index_lists(postings(single, cell_counts(single))))
    release(docs.sparkSession)
    near = linked(overlaps(neighbour_pairs(lists), single, sketches))
    pivots = durable(members_of(near))
    same_id = members.filter("doc_id <> sid").select(F.col("sid").alias("a"), F.col("doc_id").alias("b"))
    repeated = keep_rows(same_id, members.filter("doc_id = sid").select(F.col("doc_id").alias("b")).distinct(), "b", "left_semi")
    links = near.select("a", "b").union(repeated.select("a", "b"))
    blocks, labels = scratch.save(blocks_of(lists, pivots)), components(links)
    mixed = scratch.save(mixed_blocks(blocks, labels))
    many, pairs = many_open(mixed)
    while many:
        found = linked(overlaps(cross_pairs(mixed), single, sketches))
        if found.isEmpty():
            break
        links = durable(links.union(found.select("a", "b")))
        labels = components(links)
        mixed = scratch.save(mixed_blocks(blocks, labels))
        before, (many, pairs) = pairs, many_open(mixed)
        many = many and 2 * pairs <= before
    facts = pivot_facts(sketches, pivots)
    compared = overlaps(block_pairs(mixed, facts), single, sketches)
    links = durable(links.union(linked(compared).select("a", "b")))
    labels = components(links)
    more = durable(open_pairs(compared, pivots, labels, facts, sketches))
    if not more.isEmpty():
        labels = components(links.union(linked(overlaps(more, single, sketches)).select("a", "b")))
    found = members.join(size_checked(labels.withColumnRenamed("node", "sid")), "sid", "left")
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("component", "sid")).alias("component_id"))
    found = sets.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    whole = durable(found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    scratch.clear()
    return whole


def op2_near_duplicates(spark, folder: str) -> DataFrame:
    """Set size and component of every document."""
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
