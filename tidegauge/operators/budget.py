"""What a day may still spend, and how much of a queue that admits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_ledger(spent: DataFrame, done: DataFrame, estimates: dict[str, float], default: float, per_item: float) -> DataFrame:
    """``day, lines, spent``: what each day has cost.

    ``spent(at, kind, cost, requests)`` is the ledger: a line counts at its cost or, as long as that is not known, at its requests
    times the estimate of its kind (``default`` for kinds without one). Days that have no line but items in ``done(at)`` are
    estimated at ``per_item`` each, so that what was paid is never taken for nothing.
    """
    rate = F.lit(default)
    for kind, value in estimates.items():
        rate = F.when(F.col("kind") == kind, value).otherwise(rate)
    lines = spent.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("lines"), F.sum(F.coalesce("cost", F.col("requests") * rate)).alias("_paid"))
    items = done.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("_items"))
    both = lines.join(items, "day", "full")
    guessed = F.coalesce("_items", F.lit(0)) * per_item
    return both.select("day", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("_paid", guessed).alias("spent"))


def rests(ledger: DataFrame, cap: float, per_item: float) -> DataFrame:
    """``ledger`` with ``rest`` (not below 0) and ``fits``: the items of average cost that it admits; no cap (0 or less): null."""
    rest = F.greatest(F.lit(0.0), F.lit(cap) - F.col("spent")) if cap > 0 else F.lit(None).cast("double")
    return ledger.withColumn("rest", rest).withColumn("fits", F.floor(F.col("rest") / per_item))


def with_running_sum(queue: DataFrame, at: str, key: str, value: Column, shard_seconds: int = 600) -> DataFrame:
    """``queue`` with ``day`` and ``upto``: the sum of ``value`` over the day's rows by time (then ``key``), each row included.

    A day is dealt into shards of ``shard_seconds``, whose order is that of time. Sums per shard, 144 rows a day, give each
    shard its offset, and a window runs inside each shard only; so no task holds a day.
    """
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    rows = queue.withColumns({"day": F.to_date(at), "_shard": F.floor(seconds / shard_seconds), "_v": value})
    by_day = Window.partitionBy("day").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy("day", "_shard").agg(F.sum("_v").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(by_day), F.lit(0.0))).drop("_sum")
    inside = Window.partitionBy("day", "_shard").orderBy(at, key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_in", F.sum("_v").over(inside)).join(shards, ["day", "_shard"]).withColumn("upto", F.col("_before") + F.col("_in")).drop("_shard", "_v", "_before", "_in")


def admitted(queue: DataFrame, days: DataFrame, at: str, key: str, value: Column) -> DataFrame:
    """``days(day, rest, ...)`` with ``queued`` and ``admitted``: how many of the day's queue, in order of time, fit into its rest.

    A day without a rest (null) has no cap and admits all. Values are not negative.
    """
    placed = with_running_sum(queue, at, key, value).join(days.select("day", "rest"), "day")
    fits = F.col("rest").isNull() | (F.col("upto") <= F.col("rest"))
    counts = placed.groupBy("day").agg(F.count("*").alias("queued"), F.count_if(fits).alias("admitted"))
    zero = F.lit(0).cast("bigint")
    return days.join(counts, "day", "left").withColumns({c: F.coalesce(c, zero) for c in ("queued", "admitted")})
