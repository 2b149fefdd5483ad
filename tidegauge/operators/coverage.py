"""Ranges of days that are stored, needed and missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_floor


def needed(events: DataFrame, before: int, after: int, today: Column) -> DataFrame:
    """``ticker, start, stop``: the days around a ticker's events, to whole months, not beyond ``today``."""
    spans = events.groupBy("ticker").agg(F.min("d0").alias("_first"), F.max("d0").alias("_last"))
    stop = F.least(F.last_day(F.date_add("_last", after)), today)
    return spans.select("ticker", month_floor(F.date_sub("_first", before)).alias("start"), stop.alias("stop")).where("start <= stop")


def missing_ranges(need: DataFrame, stored: DataFrame, slack: int = 7) -> DataFrame:
    """``ticker, start, stop, days, kind``: the parts of ``need(ticker, start, stop)`` of which ``stored(ticker, trade_date)`` has no
    day, where they are longer than ``slack`` days.

    ``kind`` is ``all`` (nothing is stored), ``head``, ``inner`` or ``tail``. Stored days fewer than ``slack`` + 2 apart are one range, so
    weekends and holidays are no gaps. The day before the need and the day after it stand with the stored days in one sorted
    stream per ticker, and a gap lies between neighbours.
    """
    lo, hi = F.date_sub("start", 1), F.date_add("stop", 1)
    edges = need.select("ticker", F.explode(F.array(F.struct(lo.alias("day"), F.lit("a").alias("end")), F.struct(hi.alias("day"), F.lit("z").alias("end")))).alias("e"))
    edges = edges.select("ticker", "e.day", "e.end")
    days = stored.select("ticker", F.col("trade_date").alias("day")).distinct()
    inside = days.join(need, "ticker").where(F.col("day").between(F.col("start"), F.col("stop"))).select("ticker", "day", F.lit("m").alias("end"))
    w = Window.partitionBy("ticker").orderBy("day", "end")
    pairs = edges.unionByName(inside).withColumns({"_from": F.lag("day").over(w), "_side": F.lag("end").over(w)})
    apart = F.date_diff("day", "_from") - 1
    kind = F.concat("_side", "end")
    return pairs.where(apart > slack).select(
        "ticker", F.date_add("_from", 1).alias("start"), F.date_sub("day", 1).alias("stop"), apart.alias("days"),
        F.when(kind == "az", "all").when(kind == "am", "head").when(kind == "mz", "tail").otherwise("inner").alias("kind"),
    )


def download_plan(need: DataFrame, stored: DataFrame, today: Column, slack: int = 7) -> DataFrame:
    """``missing_ranges`` widened to whole months, where these overlap or touch as one: ``ticker, start, stop, ranges``.

    Requests for whole months can be put together for several tickers.
    """
    gaps = missing_ranges(need, stored, slack)
    whole = gaps.select("ticker", month_floor(F.col("start")).alias("start"), F.least(F.last_day("stop"), today).alias("stop"))
    w = Window.partitionBy("ticker").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > F.date_add(reach, 1)).cast("int"), F.lit(1))
    numbered = whole.withColumn("_new", new).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("ticker", "_k").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("ranges")).drop("_k")
