"""Exact global ranks, tiles, order statistics and running sums without a single-task sort.

A window without PARTITION BY sorts everything in one task.  Here the rows are
range-partitioned on the full sort key, so a value shared by most rows is
still spread by the tie-breaking key, and only one row per partition is
combined globally.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quitanda.session import durable

_INDEX_BITS = 33
_PART, _INDEX = "_part", "_index"


def _range_sorted(df: DataFrame, keys: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """``df`` sorted across partitions, each row with its partition and index in it, without the columns to ``drop``.

    The result is durable: range bounds come from a sample, and reading the
    rows twice must not sample twice.
    """
    position = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*drop).withColumn(_INDEX, position)
    return durable(
        placed.withColumn(_PART, F.shiftright(_INDEX, _INDEX_BITS)).withColumn(
            _INDEX, F.col(_INDEX).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
        )
    )


def row_numbers(df: DataFrame, by: Sequence[str], group: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Add ``rn``, the 1-based rank by ``by`` within ``group``, and ``n``, the group size; ``drop`` columns used for nothing else.

    ``by`` must order the rows of a group totally (ascending).  There must be
    few groups: their number plus that of partitions bounds what is broadcast.
    """
    group, by = list(group), list(by)
    placed = _range_sorted(df, [*group, *by], drop)
    parts = placed.groupBy(*group, _PART).agg(
        F.count("*").alias("_size"), F.min(_INDEX).alias("_first")
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # Kept, so that a reader of the ranks scans the rows once and not again for these few.
    offsets = durable(
        parts.select(
            *group,
            _PART,
            (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_size").over(whole).alias("n"),
        )
    )
    return (
        placed.join(F.broadcast(offsets), [*group, _PART])
        .withColumn("rn", F.col(_INDEX) + F.col("_shift") + 1)
        .drop(_PART, _INDEX, "_shift")
    )


def tile_start(tile: int, tiles: int, n: Column) -> Column:
    """Rank of the first row of a tile when ``n`` rows are cut into ``tiles``."""
    size, extra = F.floor(n / F.lit(tiles)), n % F.lit(tiles)
    return F.lit(tile - 1) * size + F.least(F.lit(tile - 1).cast("long"), extra) + 1


def tile_bounds(ranked: DataFrame, tiles: int, key: str, tie: str, group: str) -> DataFrame:
    """First row (key, tie) of the tiles after the first, as one sorted array per group."""
    rank, n = F.col("rn"), F.col("n")
    starts = [rank == tile_start(tile, tiles, n) for tile in range(2, tiles + 1)]
    hit = starts[0]
    for start in starts[1:]:
        hit = hit | start
    return (
        ranked.filter(hit)
        .groupBy(group)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(tie)))).alias("bounds"))
    )


def tile_of(bounds: Column, tiles: int, key: Column, tie: Column) -> Column:
    """Tile of a row: one more than the number of tile starts at or before it."""
    row = F.struct(key, tie)
    tile = F.lit(1)
    for position in range(tiles - 1):
        tile = tile + F.coalesce((F.get(bounds, F.lit(position)) <= row).cast("int"), F.lit(0))
    return tile


def quantiles(ranked: DataFrame, key: str, group: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles per group, one array in the order of ``points``."""
    rank, n = F.col("rn"), F.col("n")
    value = F.col(key).cast("double")
    wanted = []
    for point in points:
        place = (n - 1) * F.lit(point)
        low, weight = F.floor(place) + 1, place - F.floor(place)
        wanted.append((low, weight))
    used = F.lit(False)
    for low, _ in wanted:
        used = used | rank.between(low, low + 1)
    at = lambda position: F.max(F.when(rank == position, value))
    return (
        ranked.filter(used)
        .groupBy(*group)
        .agg(
            F.array(
                *(
                    at(low) + F.coalesce(F.max(weight) * (at(low + 1) - at(low)), F.lit(0.0))
                    for low, weight in wanted
                )
            ).alias("quantiles")
        )
    )


def running_sums(df: DataFrame, by: Sequence[str], values: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Add ``before_<value>``: the sum of ``value`` over all earlier rows of the group."""
    group, values = list(group), list(values)
    placed = _range_sorted(df, [*group, *by])
    parts = placed.groupBy(*group, _PART).agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *group, _PART, *(F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values)
    )
    inside = Window.partitionBy(*group, _PART).orderBy(_INDEX).rowsBetween(Window.unboundedPreceding, -1)
    kept = [F.col(c) for c in df.columns]
    return placed.join(F.broadcast(offsets), [*group, _PART]).select(
        *kept,
        *(
            (F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_off_{v}")).alias(f"before_{v}")
            for v in values
        ),
    )
