"""Price-quality operators: gaps, bad bars, jumps and liquidity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(bars: DataFrame, is_session: Column) -> DataFrame:
    """Sessions within a ticker's own first and last bar that have none, with a null close."""
    span = bars.groupBy("ticker").agg(F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"))
    days = span.select("ticker", F.explode(F.sequence("_lo", "_hi")).alias("trade_date")).where(is_session)
    missing = days.join(bars.select("ticker", "trade_date"), ["ticker", "trade_date"], "left_anti")
    return missing.select("ticker", "trade_date", F.lit(None).cast("double").alias("close"), F.lit(True).alias("gap"))


def bad_bars(bars: DataFrame, tolerance: float = 0.001, spike: float = 0.5, undone: float = 0.2, is_index: Column | None = None) -> DataFrame:
    """``reason`` why a bar is not to be trusted, the first that holds; null for good bars.

    A spike is a move by more than ``spike`` after which the next close is within ``undone`` of the one before it; where ``is_index`` holds
    spikes are real.
    """
    w = Window.partitionBy("ticker").orderBy("trade_date")
    lag, after = F.lag("close").over(w), F.lead("close").over(w)
    before = F.when(lag > 0, lag)
    jump = F.abs(F.col("close") / before - 1) > spike
    back = F.abs(after / before - 1) < undone
    above = lambda c: F.col(c) > F.col("high") * (1 + tolerance)
    below = lambda c: F.col(c) < F.col("low") * (1 - tolerance)
    exempt = F.lit(False) if is_index is None else F.coalesce(is_index, F.lit(False))
    reason = (
        F.when(F.col("close") <= 0, "close<=0")
        .when(F.col("open") <= 0, "open<=0")
        .when(F.col("high") < F.col("low"), "high<low")
        .when(above("close"), "close above high")
        .when(below("close"), "close below low")
        .when(above("open"), "open above high")
        .when(below("open"), "open below low")
        .when(F.col("volume") < 0, "volume<0")
        .when(~exempt & jump & back, "spike")
    )
    return bars.withColumn("reason", reason)


def liquidity(bars: DataFrame, sessions: int = 60, least_price: float = 5.0, least_value: float = 1e6) -> DataFrame:
    """Last close and mean traded value of the last sessions, and whether both suffice."""
    w = Window.partitionBy("ticker").orderBy(F.desc("trade_date"))
    recent = F.when(F.col("_k") <= sessions, F.col("close") * F.col("volume"))
    out = bars.withColumn("_k", F.row_number().over(w)).groupBy("ticker").agg(
        F.max_by("close", "trade_date").alias("last_close"), F.max("trade_date").alias("last_date"), F.avg(recent).alias("adv_60")
    )
    enough = (F.col("last_close") >= least_price) & (F.col("adv_60") >= least_value)
    return out.withColumn("investable", F.coalesce(enough, F.lit(False)))


def universe_metrics(
    universe: DataFrame, bars: DataFrame, accounts: DataFrame, as_of: Column, stale_days: int = 10, sessions: int = 60,
    least_price: float = 5.0, least_cap: float = 1e6, least_value: float = 1e5,
) -> DataFrame:
    """``universe(cik, ticker)`` with ``price``, ``adv``, ``shares``, ``cap`` and ``investable``.

    The price is the last close, null if it is more than ``stale_days`` before ``as_of``; ``adv`` the mean traded value of the last
    ``sessions`` bars that have one; ``shares`` the last positive ones of ``accounts(cik, filed_at, shares)``. Unknown figures
    are never enough. Prices and values are worked out once per ticker, however many companies share it.
    """
    w = Window.partitionBy("ticker").orderBy(F.desc("trade_date"))
    last = bars.where("close is not null").groupBy("ticker").agg(F.max(F.struct("trade_date", "close")).alias("_last"))
    traded = bars.where("close is not null and volume is not null").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= sessions)
    values = traded.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("adv"))
    held = accounts.where("shares > 0").groupBy("cik").agg(F.max(F.struct("filed_at", "shares"))["shares"].alias("shares"))
    rows = universe.join(last, "ticker", "left").join(values, "ticker", "left").join(held, "cik", "left")
    price = F.when(F.col("_last.trade_date") >= F.date_sub(as_of, stale_days), F.col("_last.close"))
    cap = price * F.col("shares")
    enough = (price >= least_price) & (cap >= least_cap) & (F.col("adv") >= least_value)
    return rows.select(*universe.columns, price.alias("price"), "adv", "shares", cap.alias("cap"), F.coalesce(enough, F.lit(False)).alias("investable"))


def universe_summary(metrics: DataFrame, large: float, mega: float) -> DataFrame:
    """One row: how many companies there are, can be invested in, have no capitalisation, are large and very large."""
    return metrics.agg(
        F.count("*").alias("total"), F.count_if("investable").alias("investable"), F.count_if(F.col("cap").isNull()).alias("without_cap"),
        F.count_if(F.col("cap") >= large).alias("large"), F.count_if(F.col("cap") >= mega).alias("mega"),
    )


def retained_bars(bars: DataFrame, keep_from: Column, kept_tickers: DataFrame) -> DataFrame:
    """``bars`` without those before ``keep_from`` of tickers that are not in ``kept_tickers(ticker)``."""
    kept = kept_tickers.select("ticker", F.lit(True).alias("_kept")).distinct()
    return bars.join(kept, "ticker", "left").where((F.col("trade_date") >= keep_from) | F.col("_kept")).drop("_kept")
