"""Operators that look back or ahead within a key, and checks on tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_before(df: DataFrame, by: str, day: str, key: str, value: str, days: int, most: int) -> DataFrame:
    """``df`` with ``before``: ``value`` of the newest ``most`` rows of the same ``by`` in the ``days`` days
    strictly before (of one day the larger ``key`` is newer).

    Each day keeps its ``most`` newest rows; the ``most`` days before then hold all that
    can count, so a row carries a list of bounded size and no pair of rows is made.
    """
    rank = Window.partitionBy(by, day).orderBy(F.desc(key))
    newest = df.select(by, day, F.struct(F.col(day).alias("d"), F.col(key).alias("k"), F.col(value).alias("v")).alias("x"), F.row_number().over(rank).alias("r"))
    daily = newest.groupBy(by, day).agg(F.collect_list(F.when(F.col("r") <= most, F.col("x"))).alias("xs"))
    earlier = Window.partitionBy(by).orderBy(day).rowsBetween(-most, -1)
    seen = F.filter(F.flatten(F.collect_list("xs").over(earlier)), lambda x: x["d"] >= F.date_sub(F.col(day), days))
    listed = daily.select(by, day, F.transform(F.slice(F.reverse(F.array_sort(seen)), 1, most), lambda x: x["v"]).alias("before"))
    return df.join(listed, [by, day])


def labelled(df: DataFrame, value: str, at: str, classify: Callable[[Column], Column], day_of: Callable[[Column], Column]) -> DataFrame:
    """``class`` and ``day`` by functions of the caller, which Spark compiles with the rest."""
    return df.withColumn("class", classify(F.col(value))).withColumn("day", day_of(F.col(at)))


def captured_after(bars: DataFrame, captured: str, reviewed: DataFrame) -> DataFrame:
    """Bars of the tickers whose last capture is after ``reviewed(ticker, reviewed)``, or that never were."""
    last = bars.groupBy("ticker").agg(F.max(captured).alias("_at")).join(reviewed, "ticker", "left")
    due = last.where("reviewed is null or _at > reviewed").select("ticker")
    return bars.join(due, "ticker", "left_semi")


def later_product(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """``factor``: the product of the ratios of ``splits(ticker, split_date, ratio)`` after each bar; 1 of none.

    Bars and splits run in one sorted stream per ticker; a split counts for earlier days only.
    """
    names = bars.columns
    left = bars.select("ticker", F.col("trade_date").alias("_t"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(0.0).alias("_ln"))
    none = F.lit(None).cast(left.schema["_row"].dataType)
    right = splits.select("ticker", F.col("split_date").alias("_t"), F.lit(0).alias("_side"), none.alias("_row"), F.ln("ratio").alias("_ln"))
    w = Window.partitionBy("ticker").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("factor", F.exp(F.sum("_ln").over(w)))
    return both.where(F.col("_row").isNotNull()).select("_row.*", "factor")


def pending_ranges(stored: DataFrame, stop: Column, slack: int) -> DataFrame:
    """``ticker, start, stop, days`` of the series that end more than ``slack`` days before ``stop``, the longest first."""
    last = stored.groupBy("ticker").agg(F.max("trade_date").alias("_last"))
    days = F.date_diff(stop, F.col("_last")).cast("bigint")
    late = last.select("ticker", F.date_add("_last", 1).alias("start"), stop.alias("stop"), days.alias("days"))
    return late.where(F.col("days") > slack).orderBy(F.desc("days"), "ticker")


def without_dependants(df: DataFrame, key: str, dependants: list[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose key none of the tables refers to."""
    for other, column in dependants:
        df = df.join(other.select(F.col(column).alias(key)), key, "left_anti")
    return df


def violations(df: DataFrame, rules: dict[str, Column], key: str, value: Column) -> DataFrame:
    """``rule, key, value`` of each row and rule that is false; unknown is no violation. One pass for all rules."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).alias("key"), value.alias("value"))


def repeated_keys(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    counted = df.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
    return counted.select(F.lit("unique").alias("rule"), F.col(key).alias("key"), F.col("_n").cast("string").alias("value"))


def sums_in_ranges(
    asked: DataFrame, bars: DataFrame, values: dict[str, Column], ranges: dict[str, tuple[int, int]]
) -> DataFrame:
    """For each ``ticker`` and ``d0`` of ``asked``, the sums of ``values`` of the ticker's bars in each range of days around d0,
    both ends included, as columns ``<range>_<value>``; and the number of bars, ``<range>_n``.

    A sum is the difference of two running sums, so each ticker and day costs two probe rows per range in one
    sorted stream, however many bars lie in a range. The aggregate keeps that partitioning: one shuffle.
    """
    probes = F.array(*[
        F.struct(F.date_add("d0", day).alias("t"), F.lit(side).alias("side"), F.lit(name).alias("name"), F.lit(sign).alias("sign"))
        for name, (low, high) in ranges.items()
        for day, side, sign in ((low, 0, -1), (high, 2, 1))
    ])
    days = asked.select("ticker", "d0").dropna().distinct().select("ticker", "d0", F.explode(probes).alias("p")).select("ticker", "d0", "p.*")
    there = bars.select("ticker", F.col("trade_date").alias("t"), F.lit(1).alias("side"), F.lit(1).alias("_n"), *[v.alias(n) for n, v in values.items()])
    w = Window.partitionBy("ticker").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    names = ("_n", *values)
    run = days.unionByName(there, allowMissingColumns=True).withColumns({n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})
    parts = [
        F.sum(F.when(F.col("name") == r, F.col("sign") * F.col(n))).alias(f"{r}_{n.removeprefix('_')}") for r in ranges for n in names
    ]
    return run.where("d0 is not null").groupBy("ticker", "d0").agg(*parts)


def counts_in_ranges(events: DataFrame, bars: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """``events`` with the number of bars of their ticker in each range of days around d0, both ends included.

    A count is the difference of two running counts, so each ticker and day costs two
    probe rows per range in one sorted stream and one aggregate, however many bars lie in
    a range and however many events on a day.
    """
    probes = F.array(*[
        F.struct(F.date_add("d0", low).alias("t"), F.lit(0).alias("side"), F.lit(name).alias("name"), F.lit(-1).alias("sign"))
        for name, (low, _) in ranges.items()
    ], *[
        F.struct(F.date_add("d0", high).alias("t"), F.lit(2).alias("side"), F.lit(name).alias("name"), F.lit(1).alias("sign"))
        for name, (_, high) in ranges.items()
    ])
    asked = events.select("ticker", "d0").dropna().distinct().select("ticker", "d0", F.explode(probes).alias("p")).select("ticker", "d0", "p.*", F.lit(0).alias("one"))
    none = {c: F.lit(None).cast(t) for c, t in asked.dtypes}
    there = bars.select(
        "ticker", none["d0"].alias("d0"), F.col("trade_date").alias("t"), F.lit(1).alias("side"), none["name"].alias("name"), none["sign"].alias("sign"), F.lit(1).alias("one")
    )
    w = Window.partitionBy("ticker").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = asked.unionByName(there).withColumn("upto", F.sum("one").over(w)).where("d0 is not null")
    counts = [F.sum(F.when(F.col("name") == name, F.col("sign") * F.col("upto"))).alias(name) for name in ranges]
    return events.join(run.groupBy("ticker", "d0").agg(*counts), ["ticker", "d0"])
