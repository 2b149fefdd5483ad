"""Queries: windows over price bars, price quality, as-of and range joins on prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, quality, windows
from ..sources import market
from .registry import query

_W = "OVER (PARTITION BY ticker ORDER BY trade_date)"


def _bars(spark, sf_dir):
    return market.prices(spark, sf_dir)


def _events(spark, sf_dir):
    return market.events(spark, sf_dir)


@query("WIN-01", market.oracle("prices", f"SELECT ticker, trade_date, lag(close) {_W} AS prev_close, lead(close) {_W} AS next_close, trade_date - lag(trade_date) {_W} AS gap_days FROM prices"))
def win_01(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("trade_date")
    return _bars(spark, sf_dir).select(
        "ticker", "trade_date", F.lag("close").over(w).alias("prev_close"), F.lead("close").over(w).alias("next_close"),
        F.date_diff("trade_date", F.lag("trade_date").over(w)).cast("bigint").alias("gap_days"),
    )


@query("WIN-02", market.oracle("prices", "SELECT ticker, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS k FROM prices WHERE close IS NOT NULL) WHERE k <= 60"))
def win_02(spark, sf_dir):
    return windows.last_rows(_bars(spark, sf_dir).where("close is not null"), "ticker", "trade_date", 60).select("ticker", "trade_date", "close")


@query("WIN-03", market.oracle("prices", """
    SELECT ticker, trade_date, close FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM prices)
    WHERE (k - 1) % greatest(n // 60, 1) = 0 OR k = n"""))
def win_03(spark, sf_dir):
    return windows.thinned(_bars(spark, sf_dir), "ticker", "trade_date", 60).select("ticker", "trade_date", "close")


@query("WIN-05", market.oracle("prices", f"""
    SELECT ticker, trade_date, CASE WHEN trade_date - pd <= 4 AND pc <> 0 THEN round(close / pc - 1, 6) END AS ret_1d
    FROM (SELECT *, lag(trade_date) {_W} AS pd, lag(close) {_W} AS pc FROM prices)"""))
def win_05(spark, sf_dir):
    return windows.one_day_return(_bars(spark, sf_dir), 4).select("ticker", "trade_date", F.round("ret_1d", 6).alias("ret_1d"))


@query("WIN-06", market.oracle("prices", """
    SELECT ticker, trade_date, CASE WHEN count(close) OVER w = 20 THEN round(avg(close) OVER w, 5) END AS mean_20,
           CASE WHEN count(close) OVER w = 20 THEN round(stddev_samp(close) OVER w, 5) END AS std_20,
           CASE WHEN count(close) OVER w = 20 THEN min(low) OVER w END AS low_20, CASE WHEN count(close) OVER w = 20 THEN max(high) OVER w END AS high_20
    FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING)"""))
def win_06(spark, sf_dir):
    return windows.trailing(_bars(spark, sf_dir), 20).select(
        "ticker", "trade_date", F.round("mean_20", 5).alias("mean_20"), F.round("std_20", 5).alias("std_20"), "low_20", "high_20"
    )


@query("WIN-07", market.oracle("prices", """
    SELECT ticker, trade_date, CASE WHEN count(close * volume) OVER w >= 20 THEN round(avg(close * volume) OVER w + 0.00002, 4) END AS adv_60,
           CASE WHEN count(volume) OVER v >= 20 THEN round(volume / nullif(avg(volume) OVER v, 0), 5) END AS volume_ratio
    FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
                       v AS (PARTITION BY ticker ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""))
def win_07(spark, sf_dir):
    """The mean is moved off the ties of rounding: its last digits depend on the order of the sum."""
    return windows.traded_value(_bars(spark, sf_dir)).select("ticker", "trade_date", F.round(F.col("adv_60") + 0.00002, 4).alias("adv_60"), F.round("volume_ratio", 5).alias("volume_ratio"))


@query("WIN-08", market.oracle("prices", """
    SELECT ticker, trade_date, CASE WHEN count(ret) OVER w >= 20 THEN round(stddev_samp(ret) OVER w, 6) END AS baseline_vol
    FROM (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS ret FROM prices)
    WINDOW w AS (PARTITION BY ticker ORDER BY trade_date RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND INTERVAL 30 DAY PRECEDING)"""))
def win_08(spark, sf_dir):
    return windows.baseline_volatility(_bars(spark, sf_dir)).select("ticker", "trade_date", F.round("baseline_vol", 6).alias("baseline_vol"))


@query("WIN-09", market.oracle("prices", """
    SELECT ticker, trade_date, max(close) OVER w AS peak, round(close / max(close) OVER w - 1, 6) AS drawdown
    FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)"""))
def win_09(spark, sf_dir):
    return windows.drawdown(_bars(spark, sf_dir), "close").select("ticker", "trade_date", "peak", F.round("drawdown", 6).alias("drawdown"))


@query("WIN-10", market.oracle("prices", f"""
    SELECT ticker, trade_date, sum(signed) {_W} AS obv, round(sum(flow) {_W}, 3) AS accumulation
    FROM (SELECT *, coalesce(sign(close - lag(close) {_W}), 0)::BIGINT * volume AS signed,
                 CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END AS flow FROM prices)"""))
def win_10(spark, sf_dir):
    return windows.volume_flows(_bars(spark, sf_dir)).select("ticker", "trade_date", "obv", F.round("accumulation", 3).alias("accumulation"))


@query("WIN-11", market.oracle("prices", f"SELECT ticker, trade_date, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range FROM (SELECT *, lag(close) {_W} AS pc FROM prices)"))
def win_11(spark, sf_dir):
    return windows.true_range(_bars(spark, sf_dir)).select("ticker", "trade_date", "true_range")


@query("WIN-14", market.oracle("prices", """
    SELECT ticker, trade_date, CASE WHEN count(close) OVER w = 20 THEN round(regr_slope(close, k) OVER w, 5) END AS slope_20
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date)::DOUBLE AS k FROM prices)
    WINDOW w AS (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING)"""))
def win_14(spark, sf_dir):
    return windows.slope(_bars(spark, sf_dir), "close", 20).select("ticker", "trade_date", F.round("slope_20", 5).alias("slope_20"))


@query("WIN-16", market.oracle("prices", """
    SELECT ticker, trade_date, CASE WHEN k - last_cross < 20 THEN k - last_cross END AS bars_since_cross FROM (
        SELECT ticker, trade_date, k, max(CASE WHEN side <> prev AND prev <> 0 THEN k END) OVER (PARTITION BY ticker ORDER BY trade_date) AS last_cross FROM (
            SELECT *, lag(side) OVER (PARTITION BY ticker ORDER BY trade_date) AS prev FROM (
                SELECT ticker, trade_date, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS k,
                       CASE WHEN round(avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 4 PRECEDING), 6) > round(avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING), 6) THEN 1
                            WHEN round(avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 4 PRECEDING), 6) < round(avg(close) OVER (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING), 6) THEN -1 ELSE 0 END AS side
                FROM prices)))"""))
def win_16(spark, sf_dir):
    return windows.bars_since_cross(_bars(spark, sf_dir), 5, 20, 20).select("ticker", "trade_date", "bars_since_cross")


@query("JON-03", market.oracle("prices events", "SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM prices p WHERE p.ticker = ev.ticker AND p.trade_date = ev.d0)"))
def jon_03(spark, sf_dir):
    bars = _bars(spark, sf_dir).select("ticker", F.col("trade_date").alias("d0"))
    return _events(spark, sf_dir).join(bars, ["ticker", "d0"], "left_semi").select("event_id")


@query("JON-04", market.oracle("prices events", """
    SELECT event_id FROM ev WHERE NOT EXISTS (
        SELECT 1 FROM prices p WHERE p.ticker = ev.ticker AND p.high > 2 * p.low AND p.volume < 60 AND p.trade_date BETWEEN ev.d0 - 5 AND ev.d0 + 45)"""))
def jon_04(spark, sf_dir):
    bad = _bars(spark, sf_dir).where("high > 2 * low and volume < 60").select("ticker", "trade_date")
    events = _events(spark, sf_dir)
    hit = joins.between_days(events.select("ticker", "d0").distinct(), bad, "ticker", "d0", "trade_date", -5, 45)
    return events.join(hit.select("ticker", "d0").distinct(), ["ticker", "d0"], "left_anti").select("event_id")


@query("JON-05", market.oracle("prices events", """
    SELECT event_id, p.trade_date AS price_date, p.close AS price
    FROM ev ASOF LEFT JOIN prices p ON ev.ticker = p.ticker AND ev.d0 >= p.trade_date"""))
def jon_05(spark, sf_dir):
    found = joins.as_of(_events(spark, sf_dir), _bars(spark, sf_dir), ["ticker"], "d0", "trade_date", ["close"])
    return found.select("event_id", F.col("match.trade_date").alias("price_date"), F.col("match.close").alias("price"))


@query("JON-06", market.oracle("prices events", """
    SELECT event_id, p.trade_date AS entry_date, p.open AS entry_open
    FROM ev ASOF LEFT JOIN prices p ON ev.ticker = p.ticker AND ev.d0 < p.trade_date"""))
def jon_06(spark, sf_dir):
    found = joins.as_of(_events(spark, sf_dir), _bars(spark, sf_dir), ["ticker"], "d0", "trade_date", ["open"], forward=True, strict=True)
    return found.select("event_id", F.col("match.trade_date").alias("entry_date"), F.col("match.open").alias("entry_open"))


@query("JON-07", market.oracle("prices events", """
    SELECT event_id, max(p.trade_date) AS found_at, arg_max(p.close, p.trade_date) AS found
    FROM ev LEFT JOIN prices p ON ev.ticker = p.ticker AND p.trade_date BETWEEN ev.d0 - 5 AND ev.d0 GROUP BY event_id"""))
def jon_07(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", "ticker", "d0")
    return joins.nearest_before(events, _bars(spark, sf_dir), "ticker", "d0", "trade_date", "close", 5).select("event_id", "found_at", "found")


@query("JON-08", market.oracle("prices events", """
    SELECT event_id, count(*) AS n_bars, min(trade_date) AS first_bar, max(trade_date) AS last_bar, max(high) AS top
    FROM ev JOIN prices p ON ev.ticker = p.ticker AND trade_date BETWEEN d0 - 30 AND d0 + 20 GROUP BY event_id"""))
def jon_08(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_id", "ticker", "d0")
    near = joins.between_days(events.select("ticker", "d0").distinct(), _bars(spark, sf_dir), "ticker", "d0", "trade_date", -30, 20)
    sums = near.groupBy("ticker", "d0").agg(
        F.count("*").alias("n_bars"), F.min("trade_date").alias("first_bar"), F.max("trade_date").alias("last_bar"), F.max("high").alias("top")
    )
    return events.join(sums, ["ticker", "d0"]).drop("ticker", "d0")


@query("TSQ-01", market.oracle("prices", """
    SELECT x.ticker, x.day AS trade_date, NULL::DOUBLE AS close, TRUE AS gap
    FROM (SELECT ticker, unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY))::DATE AS day FROM prices GROUP BY ticker) x
    LEFT JOIN prices p ON p.ticker = x.ticker AND p.trade_date = x.day
    WHERE isodow(x.day) < 6 AND p.ticker IS NULL"""))
def tsq_01(spark, sf_dir):
    return quality.gaps(_bars(spark, sf_dir), F.weekday("trade_date") < 5)


_FLAG = f"""
    SELECT ticker, trade_date, CASE
        WHEN close <= 0 THEN 'close<=0' WHEN open <= 0 THEN 'open<=0' WHEN high < low THEN 'high<low'
        WHEN close > high * 1.001 THEN 'close above high' WHEN close < low * 0.999 THEN 'close below low' WHEN open > high * 1.001 THEN 'open above high' WHEN open < low * 0.999 THEN 'open below low'
        WHEN volume < 0 THEN 'volume<0'
        WHEN ticker <> 'ECONOMY' AND pc > 0 AND abs(close / pc - 1) > 0.5 AND abs(nc / pc - 1) < 0.2 THEN 'spike' END AS reason
    FROM (SELECT *, lag(close) {_W} AS pc, lead(close) {_W} AS nc FROM prices)"""


def _judged(spark, sf_dir):
    """Bars with what is wrong with them; one ticker stands for an index, whose spikes are real."""
    return quality.bad_bars(_bars(spark, sf_dir), is_index=F.col("ticker") == "ECONOMY")


@query("TSQ-02", market.oracle("prices", f"SELECT * FROM ({_FLAG}) WHERE reason IS NOT NULL"))
def tsq_02(spark, sf_dir):
    return _judged(spark, sf_dir).where("reason is not null").select("ticker", "trade_date", "reason")


@query("TSQ-03", market.oracle("prices events", f"""
    SELECT event_id, arg_min(reason, trade_date) AS reason
    FROM ev JOIN ({_FLAG}) f ON f.ticker = ev.ticker AND f.reason IS NOT NULL AND trade_date BETWEEN d0 - 250 AND d0 + 20
    GROUP BY event_id"""))
def tsq_03(spark, sf_dir):
    """The first flagged bar in the range is the first one at or after its start: an as-of join, no pairs."""
    bad = _judged(spark, sf_dir).where("reason is not null").select("ticker", "trade_date", "reason")
    events = _events(spark, sf_dir).select("event_id", "ticker", "d0", F.date_sub("d0", 250).alias("start"))
    found = joins.as_of(events, bad, ["ticker"], "start", "trade_date", ["reason"], forward=True)
    return found.where(F.col("match.trade_date") <= F.date_add("d0", 20)).select("event_id", "match.reason")


@query("AGG-07", market.oracle("prices", """
    SELECT ticker, arg_max(close, trade_date) AS last_close, max(trade_date) AS last_date, round(avg(close * volume) FILTER (k <= 60), 2) AS adv_60,
           coalesce(arg_max(close, trade_date) >= 5 AND avg(close * volume) FILTER (k <= 60) >= 1000000, FALSE) AS investable
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS k FROM prices) GROUP BY ticker"""))
def agg_07(spark, sf_dir):
    return quality.liquidity(_bars(spark, sf_dir)).select("ticker", "last_close", "last_date", F.round("adv_60", 2).alias("adv_60"), "investable")


_AS_OF = "2001-11-05"
_UNIVERSE = f"""u AS (SELECT c_custkey AS cik, (['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD', 'NONE'])[c_custkey % 7 + 1] AS ticker FROM customer),
    lp AS (SELECT ticker, arg_max(close, trade_date) AS close, max(trade_date) AS day FROM prices WHERE volume % 9 > 0 AND NOT (ticker = 'SMALL' AND trade_date > DATE '2001-10-20') GROUP BY 1),
    av AS (SELECT ticker, avg(close * volume) AS adv FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS k FROM prices WHERE volume % 9 > 0 AND NOT (ticker = 'SMALL' AND trade_date > DATE '2001-10-20')) WHERE k <= 60 GROUP BY 1),
    sh AS (SELECT cik, arg_max(shares, filed_at) AS shares FROM fundamentals WHERE shares > 1 GROUP BY 1),
    um AS (SELECT u.cik, u.ticker, CASE WHEN lp.day >= DATE '{_AS_OF}' - 10 THEN lp.close END AS price, adv, shares FROM u LEFT JOIN lp USING (ticker) LEFT JOIN av USING (ticker) LEFT JOIN sh USING (cik)),
    uc AS (SELECT *, price * shares AS cap, coalesce(price >= 5 AND price * shares >= 10000 AND adv >= 100000, FALSE) AS investable FROM um)"""


def _universe(spark, sf_dir):
    names = F.array(*map(F.lit, ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "NONE")))
    universe = market.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.get(names, (F.col("c_custkey") % 7).cast("int")).alias("ticker"))
    bars = _bars(spark, sf_dir).where(~((F.col("ticker") == "SMALL") & (F.col("trade_date") > "2001-10-20"))).withColumn("close", F.when(F.col("volume") % 9 > 0, F.col("close")))
    accounts = market.fundamentals(spark, sf_dir).withColumn("shares", F.when(F.col("shares") > 1, F.col("shares")))
    return quality.universe_metrics(universe, bars, accounts, F.lit(_AS_OF).cast("date"), least_cap=10_000.0)


@query("AGG-07b", market.oracle("prices fundamentals", f"WITH {_UNIVERSE} SELECT cik, ticker, price, round(adv, 2) AS adv, shares, round(cap, 2) AS cap, investable FROM uc"))
def agg_07b(spark, sf_dir):
    """Price, traded value, shares and capitalisation of each company; one series has gone stale, and one ticker has no bars."""
    return _universe(spark, sf_dir).select("cik", "ticker", "price", F.round("adv", 2).alias("adv"), "shares", F.round("cap", 2).alias("cap"), "investable")


@query("AGG-07c", market.oracle("prices fundamentals", f"WITH {_UNIVERSE} SELECT count(*) AS total, count(*) FILTER (investable) AS investable, count(*) FILTER (cap IS NULL) AS without_cap, count(*) FILTER (cap >= 20000) AS large, count(*) FILTER (cap >= 40000) AS mega FROM uc"))
def agg_07c(spark, sf_dir):
    return quality.universe_summary(_universe(spark, sf_dir), 20_000.0, 40_000.0)


@query("TSQ-09b", market.oracle("prices events fundamentals", f"""
    WITH {_UNIVERSE}, b AS (SELECT lp.*, p.trade_date FROM (SELECT DISTINCT ticker FROM prices) lp JOIN prices p USING (ticker))
    SELECT ticker, count(*) AS bars, min(trade_date) AS first FROM b
    WHERE trade_date >= DATE '2000-06-01' OR ticker = 'ECONOMY' OR ticker IN (SELECT ticker FROM uc WHERE investable) OR ticker IN (SELECT ticker FROM ev WHERE event_id % 499 = 0) GROUP BY 1"""))
def tsq_09b(spark, sf_dir):
    """Bars that retention leaves: old ones go unless the ticker is a benchmark, can be invested in, or has an event that others refer to."""
    used = [
        spark.createDataFrame([("ECONOMY",)], "ticker string"),
        _universe(spark, sf_dir).where("investable").select("ticker"),
        _events(spark, sf_dir).where(F.col("event_id") % 499 == 0).select("ticker"),
    ]
    left = quality.retained_bars(_bars(spark, sf_dir), F.lit("2000-06-01").cast("date"), used[0].union(used[1]).union(used[2]))
    return left.groupBy("ticker").agg(F.count("*").alias("bars"), F.min("trade_date").alias("first"))


@query("TSQ-09c", "SELECT o_orderkey AS event_id, CASE WHEN o_orderdate::DATE >= DATE '2001-08-01' - 400 THEN o_orderpriority || ' ' || o_orderkey END AS filing_text FROM orders")
def tsq_09c(spark, sf_dir):
    """Events after the texts of old ones were cleared."""
    kept = F.when(F.col("o_orderdate").cast("date") >= F.date_sub(F.lit("2001-08-01").cast("date"), 400), F.concat_ws(" ", "o_orderpriority", "o_orderkey"))
    return market.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), kept.alias("filing_text"))
