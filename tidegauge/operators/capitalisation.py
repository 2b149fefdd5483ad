"""What a company was worth on a day, from what was known on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_of
from .lookback import later_product


def split_products(spans: DataFrame, splits: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Each distinct ``ticker``, ``start`` and ``end`` of ``spans`` with ``factor``: the product of the ratios of
    ``splits(ticker, split_date, ratio)`` after ``start`` and up to ``end``; 1 of none. Null days or tickers have no row.

    The logarithm of the product is a difference of two running sums. The days of all spans stand with the splits in one sorted
    stream per ticker, and a span takes its two sums by equi-joins: no split meets a span.
    """
    asked = spans.select("ticker", F.col(start).alias("_a"), F.col(end).alias("_b")).dropna().distinct()
    days = asked.select("ticker", F.explode(F.array("_a", "_b")).alias("_t")).distinct().select("ticker", "_t", F.lit(1).alias("_side"), F.lit(0.0).alias("_ln"))
    there = splits.where("ratio > 0").select("ticker", F.col("split_date").alias("_t"), F.lit(0).alias("_side"), F.ln("ratio").alias("_ln"))
    upto = Window.partitionBy("ticker").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    sums = days.unionByName(there).withColumn("_upto", F.sum("_ln").over(upto)).where("_side = 1").select("ticker", "_t", "_upto")
    first, last = sums.toDF("ticker", "_a", "_from"), sums.toDF("ticker", "_b", "_to")
    return asked.join(first, ["ticker", "_a"]).join(last, ["ticker", "_b"]).select(
        "ticker", F.col("_a").alias(start), F.col("_b").alias(end), F.exp(F.col("_to") - F.col("_from")).alias("factor")
    )


def at_event(events: DataFrame, accounts: DataFrame, bars: DataFrame, splits: DataFrame, reviewed: DataFrame, latest: DataFrame) -> DataFrame:
    """``events`` with ``period_end``, ``shares``, ``filed_at``, ``price`` and ``cap``, all as known on ``d0``.

    ``accounts(cik, filed_at, period_end, shares)``: the last filed at or before d0 that states shares. ``bars``: the last close at or
    before d0, turned into the price that was traded by the splits after it, if the ticker is in ``reviewed(ticker)``.
    Then the shares are carried to d0 by the splits since they were filed. For other tickers the traded price is not known:
    the smaller of shares times close and ``latest(cik, last_cap)`` stands. Null without shares or a price.
    """
    known = accounts.where("shares is not null").select("cik", F.col("filed_at").cast("date").alias("filed_at"), "shares", "period_end")
    filed = as_of(events, known, ["cik"], "d0", "filed_at", ["shares", "period_end"])
    filed = filed.select(*events.columns, F.col("match.filed_at").alias("filed_at"), F.col("match.shares").alias("shares"), F.col("match.period_end").alias("period_end"))
    priced = later_product(bars.where("close is not null").select("ticker", "trade_date", "close"), splits)
    at = as_of(filed, priced, ["ticker"], "d0", "trade_date", ["close", "factor"])
    since = split_products(filed.where("shares is not null"), splits, "filed_at", "d0").withColumnRenamed("factor", "_since")
    checked = reviewed.select("ticker", F.lit(True).alias("_reviewed")).distinct()
    rows = at.join(since, ["ticker", "filed_at", "d0"], "left").join(checked, "ticker", "left").join(latest.select("cik", "last_cap"), "cik", "left")
    close = F.col("match.close")
    traded = F.when(F.col("_reviewed"), close * F.col("match.factor"))
    cap: Column = (
        F.when(F.col("shares").isNull() | close.isNull(), F.lit(None).cast("double"))
        .when(traded.isNotNull(), F.col("shares") * traded * F.coalesce("_since", F.lit(1.0)))
        .otherwise(F.least(F.col("shares") * close, F.col("last_cap")))
    )
    return rows.select(*events.columns, "period_end", "shares", "filed_at", F.coalesce(traded, close).alias("price"), cap.alias("cap"))
