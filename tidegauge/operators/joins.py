"""Joins over time: as-of, bounded nearest, range and cohort joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    forward: bool = False,
    strict: bool = False,
    null_values: bool = False,
) -> DataFrame:
    """``left`` with ``values`` of the last right row at or before ``left_time``, as struct ``match``.

    ``forward`` takes the first at or after, ``strict`` leaves out equal times, and
    ``null_values`` accepts a right row whose first value is null. Of right rows with
    one key and time, the largest by ``values`` counts. Null keys and times match nothing.

    Distinct keys and times of ``left`` (one per key and day, however many rows a hot
    key has) stand with the right rows in one sorted stream per key; no pair of rows is
    made. ``left`` then takes its match by an equi-join, which Spark can split where
    it is skewed.
    """
    # a probe stands between right rows of the same time that it may not see and those that it may
    right_side = F.lit(2 if strict != forward else 0)
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    probes = left.select(*named, F.col(left_time).alias("_t")).dropna().distinct().select(
        *keys, "_t", F.lit(1).alias("_side"), F.lit(None).cast(_struct_type(right, [right_time, *values])).alias("_v")
    )
    keep = F.lit(True) if null_values else F.col(values[0]).isNotNull()
    seen = right.where(keep).select(*named, F.col(right_time).alias("_t"), right_side.alias("_side"), F.struct(right_time, *values).alias("_v"))
    if forward:
        w = Window.partitionBy(*keys).orderBy(F.desc("_t"), F.desc("_side"), F.asc_nulls_last("_v"))
    else:
        w = Window.partitionBy(*keys).orderBy("_t", "_side", "_v")
    last = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    found = probes.unionByName(seen).withColumn("match", last).where("_side = 1").select(*keys, "_t", "match")
    on = F.col(left_time) == F.col("_t")
    for c, k in zip(by, keys, strict=True):
        on = on & (F.col(c) == F.col(k))
    return left.join(found, on, "left").drop(*keys, "_t")


def _struct_type(df: DataFrame, names: list[str]) -> str:
    return df.select(F.struct(*names).alias("v")).schema["v"].dataType.simpleString()


def nearest_before(
    left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: str, days: int
) -> DataFrame:
    """The last right row in the ``days`` calendar days up to ``left_time``; found even if its value is null."""
    last = as_of(left, right, [by], left_time, right_time, [value], null_values=True)
    near = F.col(f"match.{right_time}") >= F.date_sub(left_time, days)
    return last.select(
        *left.columns, F.when(near, F.col(f"match.{right_time}")).alias("found_at"), F.when(near, F.col(f"match.{value}")).alias("found")
    )


def between_days(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, low: int, high: int) -> DataFrame:
    """Range join: right rows from ``low`` to ``high`` days after ``left_time``, both included, of the same key.

    Both sides are dealt to time buckets as wide as the range, so a row meets the
    rows of at most two buckets instead of the whole history of its key; the key
    with the bucket is an equi-join that a shuffle can spread.
    """
    width = max(high - low + 1, 1)
    day = F.unix_date(F.col(left_time))
    cells = F.sequence(F.floor((day + low) / width), F.floor((day + high) / width))
    l = left.withColumn("_cell", F.explode(cells))  # noqa: E741
    r = right.withColumnRenamed(by, "_by").withColumn("_rcell", F.floor(F.unix_date(F.col(right_time)) / width))
    on = (
        (F.col(by) == F.col("_by"))
        & (F.col("_cell") == F.col("_rcell"))
        & F.col(right_time).between(F.date_add(left_time, low), F.date_add(left_time, high))
    )
    return l.join(r, on).drop("_cell", "_rcell", "_by")


def latest_per(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
