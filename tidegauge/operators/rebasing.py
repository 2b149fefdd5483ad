"""Series that were stored on different bases: versions of bars, and runs of one ratio between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def base_jumps(bars: DataFrame, least: float = 0.3) -> DataFrame:
    """``ticker``, ``jumps`` (moves of the close by more than ``least``) and ``between_captures`` (those of them between bars of
    different ``captured_at``: the mark of a series that mixes two bases). Bars without a close do not count."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    seen = bars.where("close is not null").withColumns({"_before": F.lag("close").over(w), "_captured": F.lag("captured_at").over(w)})
    moved = seen.where((F.col("_before") > 0) & (F.abs(F.col("close") / F.col("_before") - 1) > least))
    return moved.groupBy("ticker").agg(F.count("*").alias("jumps"), F.count_if(F.col("captured_at") != F.col("_captured")).alias("between_captures"))


def version_ratios(versions: DataFrame) -> DataFrame:
    """``ticker, trade_date, captured_at, ratio``: each version of a bar against the version captured before it.

    ``versions(ticker, trade_date, captured_at, close)``. Versions without a positive close do not count; of versions with one
    capture the larger close does. A bar's versions are few, so its window is small however many bars a ticker has.
    """
    good = versions.where("close > 0").groupBy("ticker", "trade_date", "captured_at").agg(F.max("close").alias("close"))
    w = Window.partitionBy("ticker", "trade_date").orderBy("captured_at")
    return good.withColumn("ratio", F.col("close") / F.lag("close").over(w)).where("ratio is not null").drop("close")


def base_changes(ratios: DataFrame, least_change: float = 0.03, same: float = 0.005, least_bars: int = 3) -> DataFrame:
    """Runs of one ratio: ``ticker, captured_at, start, end, bars, ratio`` (their mean).

    Within a ticker's capture, by day, a run goes on while the ratio stays within ``same`` of the bar before. A run whose ratio is
    more than ``least_change`` from 1 and that has ``least_bars`` bars or more is a change of base; a single odd
    bar, or a revision here and there, is none.
    """
    by = ["ticker", "captured_at"]
    w = Window.partitionBy(*by).orderBy("trade_date")
    before = F.lag("ratio").over(w)
    new = F.coalesce((F.abs(F.col("ratio") / before - 1) > same).cast("int"), F.lit(1))
    runs = ratios.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(*by, "_run").agg(
        F.min("trade_date").alias("start"), F.max("trade_date").alias("end"), F.count("*").alias("bars"), F.avg("ratio").alias("ratio")
    )
    return found.where((F.abs(F.col("ratio") - 1) > least_change) & (F.col("bars") >= least_bars)).drop("_run")


def rebased(bars: DataFrame, changed: DataFrame, ratio: Column | str = "ratio") -> DataFrame:
    """``bars`` with closes on the new base: those of a run in ``changed(ticker, start, end, ratio)`` times its ratio.

    Starts and ends stand with the bars in one sorted stream per ticker: the last start at or before a bar says which run it can be in.
    Runs of a ticker do not overlap.
    """
    value = F.col(ratio) if isinstance(ratio, str) else ratio
    marks = changed.select("ticker", F.col("start").alias("trade_date"), F.lit(0).alias("_side"), F.struct(F.col("end").alias("end"), value.alias("ratio")).alias("_run"))
    rows = bars.select("ticker", "trade_date", F.lit(1).alias("_side"), F.struct(*bars.columns).alias("_row"))
    w = Window.partitionBy("ticker").orderBy("trade_date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("_run", F.last("_run", ignorenulls=True).over(w)).where("_side = 1")
    factor = F.when(F.col("trade_date") <= F.col("_run.end"), F.col("_run.ratio")).otherwise(1.0)
    return both.select(*[(F.col("_row.close") * factor).alias(c) if c == "close" else F.col(f"_row.{c}") for c in bars.columns])
