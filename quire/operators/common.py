"""Building blocks shared by the operators: top-k, upsert, ordered work on hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage

# A key with no more rows than this is ordered inside one task; larger keys are split in blocks.
BLOCK_ROWS = 1_000_000


def let(value: Column, body) -> Column:
    """Bind `value` once and use it several times inside `body` (a lambda over it)."""
    return F.transform(F.array(value), body)[0]


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows of each group. The rank filter becomes a per-task group limit before the
    shuffle, so a hot group sends at most k rows per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | None = None, rank: str = "rank") -> DataFrame:
    """All rows of each group numbered in order, or the first `k`."""
    if k is not None:
        return top_k(df, by, order, k, rank)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in `order`; duplicates are cut before the shuffle."""
    return top_k(df, keys, order, 1, "_rank").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Rows of `old` replaced or extended by rows of `new` with the same key; columns missing on
    one side are null. `order` breaks ties between new rows of one key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(
        new.withColumn("_new", F.lit(1)), allowMissingColumns=True
    )
    return first_per_key(both, keys, [F.desc("_new"), *order]).drop("_new")


def dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """Rows dealt by columns to so many tasks, which stay apart however small their shuffled bytes are:
    rows that compress well would otherwise be put together until a task groups far too many."""
    return df.repartition(tasks, *by) if tasks else df


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def same_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null is a key like any other; the key columns of `left` stay."""
    renamed = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    conditions = [left[k].eqNullSafe(renamed[f"_same_{k}"]) for k in keys]
    return left.join(renamed, reduce(Column.__and__, conditions), how).drop(*[f"_same_{k}" for k in keys])


def hottest_key_rows(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return row["n"] or 0


def ordered_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int = BLOCK_ROWS, counted: DataFrame | None = None
) -> tuple[DataFrame, bool]:
    """Add `_block` and tell whether any key was split. Blocks are contiguous in (keys, order),
    so that (keys, _block) groups stay small.

    When the hottest key is small one block is enough and nothing moves. Otherwise the rows are
    range-partitioned by keys and order and written once; the partition number is the block.
    `order` must be a total order within a key, or equal rows could not be split. `counted`, if given, has
    as many rows of each key and is cheaper to count.
    """
    if hottest_key_rows(df if counted is None else counted, keys) <= block_rows:
        return df.withColumn("_block", F.lit(0)), False
    blocks = max(2, -(-df.count() // block_rows) * 2)
    ranged = df.repartitionByRange(blocks, *keys, *order)
    return cut_lineage(ranged.withColumn("_block", F.spark_partition_id())), True


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    block_rows: int = BLOCK_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Exclusive running sums within each key: `sums` maps an output name to the summed value."""
    return _running(df, keys, order, sums, block_rows, F.sum, lambda a, b: a + b, F.lit(0), counted)


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], maxima: dict[str, Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exclusive running maxima within each key, null before the first value."""
    return _running(df, keys, order, maxima, block_rows, F.max, F.greatest, F.lit(None))


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], block_rows: int, fold, merge, nothing: Column, counted: DataFrame | None = None) -> DataFrame:
    """Two levels for hot keys: a window inside each block, merged with the totals of the earlier
    blocks."""
    valued = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    blocked, split = ordered_blocks(valued, keys, order, block_rows, counted)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.select(
        "*", *[F.coalesce(fold(f"_v_{n}").over(inside), nothing).alias(n) for n in values]
    ).drop(*[f"_v_{n}" for n in values])
    if not split:
        return local.drop("_block")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys, "_block").agg(*[fold(f"_v_{n}").alias(f"_t_{n}") for n in values])
    offsets = totals.select(
        *keys, "_block", *[F.coalesce(fold(f"_t_{n}").over(before), nothing).alias(f"_o_{n}") for n in values]
    )
    joined = same_join(local, offsets, [*keys, "_block"])
    return joined.select(
        *[merge(F.col(c), F.col(f"_o_{c}")).alias(c) if c in values else F.col(c) for c in local.columns if c != "_block"]
    )


def neighbour_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | Column, out: str, ahead: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """`value` of the row before (or after, when `ahead`) within each key; hot keys in blocks."""
    value = F.col(value) if isinstance(value, str) else value
    blocked, split = ordered_blocks(df, keys, order, block_rows)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    shift = F.lead if ahead else F.lag
    local = blocked.withColumn(out, shift(value).over(inside))
    if not split:
        return local.drop("_block")
    edge = F.min_by if ahead else F.max_by
    ends = blocked.groupBy(*keys, "_block").agg(edge(value, F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, "_block", shift("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    # the row at the border of a block takes the value from the neighbouring block
    border = shift(F.lit(1)).over(inside).isNull()
    return (
        same_join(local.withColumn("_border", border), carried, [*keys, "_block"])
        .withColumn(out, F.when(F.col("_border"), F.col("_carry")).otherwise(F.col(out)))
        .drop("_block", "_border", "_carry")
    )


def as_of(
    points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, value: str, tie: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add to each point the `value` of the last mark at or before it within its key.

    Marks and points are merged into one ordered stream, so no key pairs its points with all its
    marks; hot keys are walked in blocks, each starting from the last mark of the blocks before.
    `tie` (a column of both sides) makes the order total.
    """
    kinds = points.select(*keys, at, tie, F.struct(*points.columns).alias("_point"))
    stream = marks.select(*keys, at, tie, F.lit(0).alias("_side"), F.col(value).alias("_mark")).unionByName(
        kinds.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    order = [at, "_side", tie]
    blocked, split = ordered_blocks(stream, keys, order, block_rows)
    upto = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocked.withColumn(value, F.last("_mark", ignorenulls=True).over(upto))
    if split:
        lasts = blocked.where("_side = 0").groupBy(*keys, "_block").agg(F.max_by("_mark", F.struct(*order)).alias("_last"))
        blocks = same_join(blocked.select(*keys, "_block").distinct(), lasts, [*keys, "_block"], "left")
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = blocks.select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
        local = same_join(local, carried, [*keys, "_block"]).withColumn(value, F.coalesce(value, "_carry"))
    return local.where("_side = 1").select("_point.*", value)
