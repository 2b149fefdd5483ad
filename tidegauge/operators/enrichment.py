"""Features of an event from the price bars up to its day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_of, nearest_before
from .lookback import counts_in_ranges
from .windows import one_day_return


def features(events: DataFrame, bars: DataFrame, market: DataFrame, look_back: int = 5, most_days: int = 4) -> DataFrame:
    """``events`` with prices at d0, five and twenty days before, drift, volume, range, traded value and one-day returns.

    A price counts if its bar is at most ``look_back`` calendar days old. The mean volume
    is that of the twenty bars before, if the last of them is within forty days; the mean
    traded value is that of the sixty bars before, twenty or more. All that needs several bars is
    made once per bar by windows, and once per ticker and day by as-of joins; events take
    their row by an equi-join.
    ``market`` has the bars of the market's series, a row per day.
    """
    w = Window.partitionBy("ticker").orderBy("trade_date")
    value = F.col("close") * F.col("volume")
    long, short = w.rowsBetween(-59, 0), w.rowsBetween(-19, 0)
    upto = bars.select(
        "ticker", "trade_date", F.lit(1).alias("there"), F.avg("volume").over(short).alias("usual"),
        F.when(F.count(value).over(long) >= 20, F.avg(value).over(long)).alias("adv"),
    )
    asked = events.select("ticker", "d0").dropna().distinct()
    names = {0: "price_d0", 1: "price_d1", 5: "price_d5", 20: "price_d20"}
    shifted = asked.withColumn("back", F.explode(F.array(*map(F.lit, names)))).withColumn("at", F.date_sub("d0", F.col("back")))
    found = nearest_before(shifted, bars, "ticker", "at", "trade_date", "close", look_back)
    prices = found.groupBy("ticker", "d0").agg(*[F.max(F.when(F.col("back") == k, F.col("found"))).alias(n) for k, n in names.items()])
    before = as_of(asked, upto, ["ticker"], "d0", "trade_date", ["there", "usual", "adv"], strict=True)
    recent = F.col("match.trade_date") >= F.date_sub("d0", 40)
    before = before.select("ticker", "d0", F.col("match.adv").alias("adv"), F.when(recent, F.col("match.usual")).alias("volume_avg_20d"))
    out = events.join(prices.join(before, ["ticker", "d0"]), ["ticker", "d0"], "left")
    own = one_day_return(bars, most_days).select(
        "ticker", F.col("trade_date").alias("d0"), F.col("volume").alias("volume_d0"), (F.col("ret_1d") * 100).alias("ret_pct"),
        (F.try_divide(F.col("high") - F.col("low"), F.nullif(F.col("close"), F.lit(0.0))) * 100).alias("range_pct"),
    )
    whole = one_day_return(market, most_days).select(F.col("trade_date").alias("d0"), (F.col("ret_1d") * 100).alias("market_pct"))
    drift = F.when(F.col("price_d5") > 0, (F.col("price_d1") / F.col("price_d5") - 1) * 100)
    return (
        out.join(own, ["ticker", "d0"], "left")
        .join(whole, "d0", "left")
        .withColumn("drift_pct", drift)
        .withColumn("volume_ratio", F.try_divide(F.col("volume_d0").cast("double"), F.nullif(F.col("volume_avg_20d"), F.lit(0.0))))
        .drop("price_d1")
    )


def sector_moods(events: DataFrame, bars: DataFrame, market: DataFrame, sectors: DataFrame, most_days: int = 4) -> DataFrame:
    """``ticker, d0, sector, sector_mood``: the mean one-day return at d0 of the other tickers of its sector, less the market's,
    in percent. ``sectors(ticker, sector)`` has one row per ticker.

    The mean of the others is the sector's sum less the ticker's own return, so a day of a sector is summed up once however many tickers
    it has. Null if no other ticker, or not the market, has a return on that day.
    """
    own = one_day_return(bars, most_days).where("ret_1d is not null").select("ticker", F.col("trade_date").alias("d0"), "ret_1d").join(sectors, "ticker")
    sums = own.groupBy("sector", "d0").agg(F.sum("ret_1d").alias("_sum"), F.count("*").alias("_n"))
    whole = one_day_return(market, most_days).select(F.col("trade_date").alias("d0"), F.col("ret_1d").alias("_market"))
    asked = events.select("ticker", "d0").dropna().distinct().join(sectors, "ticker", "left")
    rows = asked.join(sums, ["sector", "d0"], "left").join(own.select("ticker", "d0", "ret_1d"), ["ticker", "d0"], "left").join(whole, "d0", "left")
    others = F.col("_n") - F.when(F.col("ret_1d").isNull(), 0).otherwise(1)
    mean = F.try_divide(F.col("_sum") - F.coalesce("ret_1d", F.lit(0.0)), F.nullif(others, F.lit(0)))
    return rows.select("ticker", "d0", "sector", ((mean - F.col("_market")) * 100).alias("sector_mood"))


def gap_warnings(events: DataFrame, bars: DataFrame, look_back: int = 5) -> DataFrame:
    """``ticker, d0, gap_warning``: whether one of the weekdays in the ``look_back`` days up to d0, within the ticker's first and last bar, has no bar."""
    span = bars.groupBy("ticker").agg(F.min("trade_date").alias("_first"), F.max("trade_date").alias("_last"))
    asked = events.select("ticker", "d0").dropna().distinct()
    counts = counts_in_ranges(asked, bars.where(F.weekday("trade_date") < 5).select("ticker", "trade_date").distinct(), {"_there": (-look_back, 0)})
    days = F.filter(F.sequence(F.date_sub("d0", look_back), F.col("d0")), lambda d: (F.weekday(d) < 5) & d.between(F.col("_first"), F.col("_last")))
    warned = F.coalesce(F.size(days) > F.col("_there"), F.lit(False))
    return asked.join(counts, ["ticker", "d0"], "left").join(span, "ticker", "left").select("ticker", "d0", warned.alias("gap_warning"))


def vector(events: DataFrame, bars: DataFrame, market: DataFrame, models: DataFrame, index: DataFrame, sectors: DataFrame) -> DataFrame:
    """``features`` with the betas and length of the model in ``models(ticker, d0, n_est, beta_*)``, ``vix_d0`` (``index(trade_date, close)`` on the very day),
    ``sector``, ``sector_mood``, ``gap_warning`` and ``abnormal_pct``: the return at d0 less beta (1 without a model) times the market's."""
    fitted = models.select("ticker", "d0", "n_est", "beta_mkt_rf", "beta_smb", "beta_hml")
    fear = index.select(F.col("trade_date").alias("d0"), F.col("close").alias("vix_d0"))
    out = features(events, bars, market).join(fitted, ["ticker", "d0"], "left").join(fear, "d0", "left")
    out = out.join(sector_moods(events, bars, market, sectors), ["ticker", "d0"], "left").join(gap_warnings(events, bars), ["ticker", "d0"], "left")
    beta = F.coalesce("beta_mkt_rf", F.lit(1.0))
    return out.withColumns({
        "n_est": F.coalesce("n_est", F.lit(0)), "gap_warning": F.coalesce("gap_warning", F.lit(False)),
        "abnormal_pct": F.col("ret_pct") - beta * F.col("market_pct"),
    })
