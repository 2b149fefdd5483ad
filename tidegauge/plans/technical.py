"""Queries: technical indicators, levels, votes and trade plans.

The SQL of smoothed indicators writes out their recursion as one running sum over the whole series, from the definition:
y(k) = q^k (x(0) + sum of (1 - q) x(i) q^-i). It holds for series of some thousands of bars. Levels, votes and plans rest
on the volume profile, which has no SQL; tests hold them against loops.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import technical, windows
from ..sources import market
from .registry import query


def _mean(value: str, weight: str, first: int) -> str:
    """SQL: exponential mean of ``value`` from bar ``first`` on."""
    term = f"CASE WHEN k < {first} THEN 0 WHEN k = {first} THEN {value} ELSE {value} * {weight} END"
    return f"sum({term} * pow(1 - {weight}, -k)) OVER w * pow(1 - {weight}, k)"


SMOOTHED = f"""bars AS (
        SELECT ticker, trade_date, close, row_number() OVER w - 1 AS k, close - lag(close) OVER w AS step,
               high - lag(high) OVER w AS rise, lag(low) OVER w - low AS fall,
               greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
        FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)
    ), parts AS (
        SELECT *, {_mean("greatest(step, 0)", "(1 / 14.0)", 1)} AS up, {_mean("greatest(-step, 0)", "(1 / 14.0)", 1)} AS down,
               {_mean("tr", "(1 / 14.0)", 0)} AS tr14, {_mean("(CASE WHEN rise > fall AND rise > 0 THEN rise ELSE 0 END)", "(1 / 14.0)", 0)} AS plus,
               {_mean("(CASE WHEN fall > rise AND fall > 0 THEN fall ELSE 0 END)", "(1 / 14.0)", 0)} AS minus,
               {_mean("close", "(2 / 13.0)", 0)} AS ema12, {_mean("close", "(2 / 27.0)", 0)} AS ema26
        FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)
    ), smooth AS (
        SELECT *, CASE WHEN k < 14 THEN NULL WHEN up + down > 0 THEN 100 * up / (up + down) ELSE 50 END AS rsi,
               CASE WHEN k >= 13 THEN tr14 END AS atr,
               CASE WHEN k >= 13 AND tr14 > 0 THEN 100 * plus / tr14 END AS plus_di, CASE WHEN k >= 13 AND tr14 > 0 THEN 100 * minus / tr14 END AS minus_di
        FROM parts
    )"""


def _indicators(spark, sf_dir):
    return technical.indicators(market.prices(spark, sf_dir))


@query("WIN-12", market.oracle("prices", f"""WITH {SMOOTHED}
    SELECT ticker, trade_date, round(CASE WHEN k >= 11 THEN ema12 END, 6) AS ema_12, round(CASE WHEN k >= 25 THEN ema26 END, 6) AS ema_26,
           round(rsi, 6) AS rsi, round(atr, 6) AS atr FROM smooth"""))
def win_12(spark, sf_dir):
    rows = windows.exponential(market.prices(spark, sf_dir))
    return rows.select("ticker", "trade_date", *[F.round(n, 6).alias(n) for n in ("ema_12", "ema_26", "rsi", "atr")])


@query("WIN-13", market.oracle("prices", f"""WITH {SMOOTHED}, dx AS (
        SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM smooth
    )
    SELECT ticker, trade_date, round(rsi, 4) AS rsi, round(atr, 4) AS atr,
           round(CASE WHEN k >= 26 THEN {_mean("dx", "(1 / 14.0)", 13)} END, 4) AS adx, round(plus_di, 4) AS plus_di, round(minus_di, 4) AS minus_di,
           round(CASE WHEN count(rsi) OVER v = 14 THEN (rsi - min(rsi) OVER v) / nullif(max(rsi) OVER v - min(rsi) OVER v, 0) END, 4) AS stoch_rsi
    FROM dx WINDOW w AS (PARTITION BY ticker ORDER BY trade_date), v AS (PARTITION BY ticker ORDER BY trade_date ROWS 13 PRECEDING)"""))
def win_13(spark, sf_dir):
    return _indicators(spark, sf_dir).select("ticker", "trade_date", "rsi", "atr", "adx", "plus_di", "minus_di", "stoch_rsi")


@query("WIN-15", market.oracle("prices", f"""WITH {SMOOTHED}, ends AS (
        SELECT ticker, trade_date, count(rsi) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 29 PRECEDING) AS n,
               min({{'c': close, 'k': k, 'r': rsi}}) OVER early AS lo1, min({{'c': close, 'k': k, 'r': rsi}}) OVER late AS lo2,
               max({{'c': close, 'k': -k, 'r': rsi}}) OVER early AS hi1, max({{'c': close, 'k': -k, 'r': rsi}}) OVER late AS hi2
        FROM smooth WINDOW early AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 29 PRECEDING AND 15 PRECEDING),
                           late AS (PARTITION BY ticker ORDER BY trade_date ROWS 14 PRECEDING)
    )
    SELECT * FROM (SELECT ticker, trade_date, CASE WHEN lo2.c < lo1.c AND lo2.r > lo1.r THEN 'bullish' WHEN hi2.c > hi1.c AND hi2.r < hi1.r THEN 'bearish' END AS rsi_divergence
                   FROM ends WHERE n = 30) WHERE rsi_divergence IS NOT NULL"""))
def win_15(spark, sf_dir):
    return _indicators(spark, sf_dir).where("rsi_divergence is not null").select("ticker", "trade_date", "rsi_divergence")


@query("WIN-17")
def win_17(spark, sf_dir):
    return _indicators(spark, sf_dir).where("poc is not null").select("ticker", "trade_date", "poc", "value_low", "value_high")


def _at_events(spark, sf_dir):
    """Indicators at the day of each event that has a bar."""
    events = market.events(spark, sf_dir).select("event_id", "ticker", F.col("d0").alias("trade_date"), "event_class")
    return events.join(_indicators(spark, sf_dir), ["ticker", "trade_date"])


@query("WIN-18")
def win_18(spark, sf_dir):
    return _at_events(spark, sf_dir)


@query("STA-17")
def sta_17(spark, sf_dir):
    each = _indicators(spark, sf_dir).select("ticker", "trade_date", F.explode(technical.levels()).alias("x"))
    return each.select("ticker", "trade_date", "x.price", "x.kind", "x.major")


@query("STA-18")
def sta_18(spark, sf_dir):
    rows = _indicators(spark, sf_dir)
    named = lambda long: F.array_join(technical.votes(F.lit(long)), ",")
    return rows.select("ticker", "trade_date", named(True).alias("for_long"), named(False).alias("for_short"))


@query("STA-19")
def sta_19(spark, sf_dir):
    """Plans of all events. Those of one day, ticker, direction and confirmation have one plan, which is made once."""
    events = market.events(spark, sf_dir).select("event_id", "ticker", F.col("d0").alias("trade_date"), "event_class")
    events = events.select("event_id", "ticker", "trade_date", F.col("event_class").isin("1-URGENT", "2-HIGH").alias("long"), (F.col("event_class") != "5-LOW").alias("confirmed"))
    kinds = events.select("ticker", "trade_date", "long", "confirmed").distinct()
    rows = kinds.join(_indicators(spark, sf_dir), ["ticker", "trade_date"]).withColumn("vix", 20 + F.col("atr_pct") * 10)
    planned = ("stop", "target", "target2", "risk_reward", "n_votes", "confidence", "passes", "size_pct", "days", "reason")
    plans = technical.trade_plans(rows).select(
        F.col("ticker").alias("_ticker"), F.col("trade_date").alias("_day"), F.col("long").alias("_long"), F.col("confirmed").alias("_confirmed"), F.col("close").alias("entry"), *planned
    )
    same = (F.col("ticker") == F.col("_ticker")) & (F.col("trade_date") == F.col("_day"))
    same = same & F.col("long").eqNullSafe(F.col("_long")) & F.col("confirmed").eqNullSafe(F.col("_confirmed"))
    return events.join(plans, same).select("event_id", "ticker", "trade_date", "entry", *planned)
