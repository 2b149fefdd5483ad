"""Ranks and running sums within large groups, without gathering a group in one task.

A group is dealt into shards by the leading hexadecimal digits of the MD5 of a key.
Totals per shard are small (one row per group and shard) and give each shard its
offset; a window then runs inside each shard only. Order within a group is the order
of the MD5, so results do not depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 3 hexadecimal digits: 4,096 shards of each group.
DIGITS = 3


def order_key(*columns: Column | str) -> Column:
    """MD5 hex of the columns' texts; a null has a mark of its own."""
    texts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\u0000")) for c in columns]
    return F.md5(F.concat_ws("\u0001", *texts))


def running_sum(
    rows: DataFrame,
    group: str,
    key: str,
    order: list[str],
    value: Column | None = None,
    narrow: DataFrame | None = None,
    per_group: DataFrame | None = None,
    shard: Column | None = None,
) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` (null: count of rows) over the rows of
    the same ``group`` (nulls are one group) that come earlier by ``order``, whose first
    column is the MD5 ``key``, or, if ``shard`` is given, within shards that sort in the order asked for; and ``group_total``. Rows equal in all of ``order`` come
    in any order among themselves. ``narrow`` may hold the same rows' ``group``, ``key``
    and value columns where they are cheaper to read than ``rows``. Columns of
    ``per_group``, a table with one row for every ``group``, are joined by way of the offsets.

    The window and the join share one partitioning: ``rows`` are shuffled once.
    """
    amount = F.lit(1).cast("bigint") if value is None else value.cast("bigint")
    # a null group is told from an empty one by a flag, so that an equi-join finds it
    marks = {"_none": F.col(group).isNull(), "_g": F.coalesce(F.col(group).cast("string"), F.lit(""))}
    by = [*marks, "_shard"]
    sharded = marks | {"_shard": F.substring(key, 1, DIGITS) if shard is None else shard, "_amount": amount}
    placed = rows.withColumns(sharded)
    small = placed if narrow is None else narrow.withColumns(sharded)
    by_group = Window.partitionBy(*marks)
    running = by_group.orderBy("_shard").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        small.groupBy(*by)
        .agg(F.sum("_amount").alias("_sum"))
        .withColumn("_offset", F.sum("_sum").over(running) - F.col("_sum"))
        .withColumn("group_total", F.sum("_sum").over(by_group))
        .drop("_sum")
    )
    if per_group is not None:
        offsets = offsets.join(per_group.withColumns(marks).drop(group), [*marks])
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("_upto", F.sum("_amount").over(inside))
    joined = summed.join(offsets, by)
    return joined.withColumn("before", F.col("_offset") + F.col("_upto") - F.col("_amount")).drop(*by, "_amount", "_offset", "_upto")
