"""Queries: intervals, enrichment, decisions, portfolios, and the read queries of reports and feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance
from ..operators import decisions, enrichment, intervals, portfolio
from ..operators import event_study as es
from ..operators import trades as ops
from ..operators.tables import written
from ..sources import market
from .event_study import _ALL, _BASE, _MODEL, _RETURNS, car_table
from .registry import query
from .trades import _rounded, _sql, trade_table

#: The series that stands for the market.
HEDGE = "ECONOMY"


def _hedge(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("ticker") == HEDGE).select("trade_date", "open", "close")


# ---- intervals and statistics


@query("STA-11")
def sta_11(spark, sf_dir):
    """t-intervals of the mean result per class; Student's t has no SQL, tests hold it against its table."""
    return _rounded(intervals.plain(trade_table(spark, sf_dir), "pnl_pct", ["event_class"]))


_CELLS = """cell AS (SELECT event_class, date_trunc('month', d0) AS m, count(*) AS k, sum(pnl_pct) AS s, sum(pnl_pct * pnl_pct) AS q, count(*) FILTER (pnl_pct > 0) AS h FROM trades GROUP BY ALL),
    tot AS (SELECT event_class, sum(k)::DOUBLE AS n, sum(s) AS t, sum(q) AS q, sum(h) AS hits, count(*) AS g, sum(k * k) AS kk FROM cell GROUP BY 1),
    jack AS (SELECT event_class, var_pop((t - s) / nullif(n - k, 0)) AS v FROM cell JOIN tot USING (event_class) GROUP BY 1)"""


@query("STA-12", _sql(f"""SELECT event_class, n, mean, hits, g, g_effective, df, var_iid, var_cluster FROM (WITH {_CELLS}
    SELECT event_class, n::BIGINT AS n, round(t / n, 6) AS mean, hits::BIGINT AS hits, g, round(n * n / kk, 6) AS g_effective,
           CASE WHEN n * n / kk >= 6 THEN floor(least(n - 1, g - 1, greatest(1, floor(n * n / kk - 1))))::BIGINT END AS df,
           round((tot.q - t * t / n) / (n - 1) / n, 6) AS var_iid, round((g - 1) * v, 6) AS var_cluster FROM tot JOIN jack USING (event_class))"""))
def sta_12(spark, sf_dir):
    """Sums behind the grouped intervals, by month of the event."""
    months = trade_table(spark, sf_dir).withColumn("month", F.trunc("d0", "month"))
    return _rounded(intervals.grouped_sums(months, "pnl_pct", ["event_class"], "month", "event_id"))


def _results(spark, sf_dir) -> DataFrame:
    """The narrow table of trades that intervals start from several times."""
    return written(trade_table(spark, sf_dir).select("event_id", "event_class", "pnl_pct", F.trunc("d0", "month").alias("month")), "results")


def _intervals(months: DataFrame) -> DataFrame:
    return _rounded(intervals.grouped(months, "pnl_pct", ["event_class"], "month", "event_id"))


@query("STA-12b")
def sta_12b(spark, sf_dir):
    """The grouped intervals of mean and share."""
    return _intervals(_results(spark, sf_dir))


@query("STA-03", market.oracle(_BASE, f"""{_ALL},
    want AS (SELECT event_id, w AS window_days FROM ev CROSS JOIN (VALUES (5), (20)) AS ws(w))
    SELECT event_id, window_days FROM want WHERE (event_id, window_days) NOT IN (SELECT (event_id, window_days) FROM car)"""))
def sta_03(spark, sf_dir):
    """Events and windows without a complete abnormal return: what maintenance has to compute again."""
    want = market.events(spark, sf_dir).select("event_id", F.explode(F.array(F.lit(5), F.lit(20))).alias("window_days"))
    done = car_table(spark, sf_dir).select("event_id", F.col("window_days").cast("int").alias("window_days"))
    return want.join(done, ["event_id", "window_days"], "left_anti")


_INDEX = "MEDIUM"  #: the series that stands for the index of fear


@query("STA-14", market.oracle(_BASE, f"""
    WITH {_RETURNS},
    {_MODEL},
    b AS (
        SELECT *, close * volume AS value, lag(close) OVER w AS pc, lag(trade_date) OVER w AS pd,
               CASE WHEN count(close * volume) OVER v60 >= 20 THEN avg(close * volume) OVER v60 END AS adv, avg(volume) OVER v20 AS usual
        FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date), v60 AS (PARTITION BY ticker ORDER BY trade_date ROWS 59 PRECEDING), v20 AS (PARTITION BY ticker ORDER BY trade_date ROWS 19 PRECEDING)),
    o AS (SELECT ticker, trade_date, CASE WHEN trade_date - pd <= 4 AND pc <> 0 THEN close / pc - 1 END AS r, 's' || length(ticker) % 2 AS sector FROM b),
    m AS (SELECT trade_date, r AS market_ret FROM o WHERE ticker = '{HEDGE}'),
    sp AS (SELECT ticker, min(trade_date) AS lo, max(trade_date) AS hi FROM prices GROUP BY 1),
    md AS (SELECT e.event_id, avg(o.r) FILTER (o.ticker <> e.ticker) AS others FROM ev e JOIN o ON o.trade_date = e.d0 AND o.sector = 's' || length(e.ticker) % 2 WHERE o.r IS NOT NULL GROUP BY 1),
    gp AS (SELECT e.event_id, count(*) > 0 AS gap FROM (SELECT ev.event_id, ev.ticker, ev.d0 - k::INT AS day FROM ev, range(0, 6) AS g(k)) e JOIN sp ON sp.ticker = e.ticker AND day BETWEEN lo AND hi
           LEFT JOIN prices p ON p.ticker = e.ticker AND p.trade_date = e.day WHERE isodow(day) < 6 AND p.ticker IS NULL GROUP BY 1)
    SELECT e.event_id, CASE WHEN p0.trade_date >= e.d0 - 5 THEN p0.close END AS price_d0, CASE WHEN p5.trade_date >= e.d0 - 10 THEN p5.close END AS price_d5, CASE WHEN p20.trade_date >= e.d0 - 25 THEN p20.close END AS price_d20,
           round(CASE WHEN p1.trade_date >= e.d0 - 6 AND p5.trade_date >= e.d0 - 10 AND p5.close > 0 THEN (p1.close / p5.close - 1) * 100 END, 5) AS drift_pct,
           d.volume AS volume_d0, round(CASE WHEN s.trade_date >= e.d0 - 40 THEN s.usual END, 5) AS volume_avg_20d, round(d.volume / nullif(CASE WHEN s.trade_date >= e.d0 - 40 THEN s.usual END, 0), 5) AS volume_ratio,
           round((d.high - d.low) / nullif(d.close, 0) * 100, 5) AS range_pct, round(s.adv + 0.00002, 3) AS adv,
           round(CASE WHEN d.trade_date - d.pd <= 4 AND d.pc <> 0 THEN (d.close / d.pc - 1) * 100 END, 5) AS ret_pct, round(m.market_ret * 100, 5) AS market_pct,
           coalesce(n_est, 0) AS n_est, round(b0, 5) AS beta_mkt, round(b1, 5) AS beta_smb, round(b2, 5) AS beta_hml, f.close AS vix_d0, 's' || length(e.ticker) % 2 AS sector, round((others - m.market_ret) * 100, 5) AS sector_mood,
           coalesce(gap, FALSE) AS gap_warning, round(CASE WHEN d.trade_date - d.pd <= 4 AND d.pc <> 0 THEN (d.close / d.pc - 1) * 100 END - coalesce(b0, 1) * m.market_ret * 100, 4) AS abnormal_pct
    FROM ev e ASOF LEFT JOIN b p0 ON p0.ticker = e.ticker AND e.d0 >= p0.trade_date
        ASOF LEFT JOIN b p1 ON p1.ticker = e.ticker AND e.d0 - 1 >= p1.trade_date
        ASOF LEFT JOIN b p5 ON p5.ticker = e.ticker AND e.d0 - 5 >= p5.trade_date
        ASOF LEFT JOIN b p20 ON p20.ticker = e.ticker AND e.d0 - 20 >= p20.trade_date
        ASOF LEFT JOIN b s ON s.ticker = e.ticker AND e.d0 > s.trade_date
        LEFT JOIN b d ON d.ticker = e.ticker AND d.trade_date = e.d0 LEFT JOIN m ON m.trade_date = e.d0 LEFT JOIN model ON model.event_id = e.event_id
        LEFT JOIN prices f ON f.ticker = '{_INDEX}' AND f.trade_date = e.d0 LEFT JOIN md ON md.event_id = e.event_id LEFT JOIN gp ON gp.event_id = e.event_id"""))
def sta_14(spark, sf_dir):
    """The twenty features of each event: prices, drift, volume, range, traded value, returns, model, index, sector, gaps."""
    bars, events = written(market.prices(spark, sf_dir), "bars"), market.events(spark, sf_dir)
    models = es.fitted_models(es.simple_returns(bars), market.factors(spark, sf_dir), events)
    index = bars.where(F.col("ticker") == _INDEX).select("trade_date", "close")
    sectors = bars.select("ticker").distinct().withColumn("sector", F.concat(F.lit("s"), F.length("ticker") % 2))
    found = enrichment.vector(events, bars, bars.where(F.col("ticker") == HEDGE), models, index, sectors).withColumnRenamed("beta_mkt_rf", "beta_mkt")
    five = ("drift_pct", "volume_avg_20d", "volume_ratio", "range_pct", "ret_pct", "market_pct", "beta_mkt", "beta_smb", "beta_hml", "sector_mood")
    rounded = {c: F.round(c, 5) for c in five} | {"adv": F.round(F.col("adv") + 0.00002, 3), "abnormal_pct": F.round("abnormal_pct", 4)}
    return found.withColumns(rounded).select("event_id", "price_d0", "price_d5", "price_d20", "volume_d0", *rounded, "n_est", "vix_d0", "sector", "gap_warning")


@query("STA-21", _sql(f"""SELECT event_id, round(actual, 5) AS actual, round(abs(confidence / 10 - actual), 5) AS error, actual > 0 AS correct FROM (
    SELECT t.event_id, t.confidence, side * (b.c5 / t.entry - 1) * 100 - side * (h2.close / h1.open - 1) * 100 AS actual FROM trades t
    LEFT JOIN (SELECT ticker, trade_date, lead(trade_date, 5) OVER w AS d5, lead(close, 5) OVER w AS c5 FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)) b ON b.ticker = t.ticker AND b.trade_date = t.entry_date
    LEFT JOIN prices h1 ON h1.ticker = '{HEDGE}' AND h1.trade_date = t.entry_date LEFT JOIN prices h2 ON h2.ticker = '{HEDGE}' AND h2.trade_date = b.d5)"""))
def sta_21(spark, sf_dir):
    """Predicted against actual moves five bars later, hedged."""
    bars = market.prices(spark, sf_dir)
    moved = decisions.later_moves(trade_table(spark, sf_dir), bars, _hedge(bars))
    return moved.select("event_id", F.round("actual", 5).alias("actual"), F.round(F.abs(F.col("confidence") / 10 - F.col("actual")), 5).alias("error"), (F.col("actual") > 0).alias("correct"))


_PREDICTED = f"""pr AS (
        SELECT t.event_id, t.side, t.pnl_pct, t.exit_date, (t.confidence / 10)::DOUBLE AS predicted, t.side * (b.c5 / t.entry - 1) * 100 - t.side * (h2.close / h1.open - 1) * 100 AS actual FROM trades t
        LEFT JOIN (SELECT ticker, trade_date, lead(trade_date, 5) OVER w AS d5, lead(close, 5) OVER w AS c5 FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)) b ON b.ticker = t.ticker AND b.trade_date = t.entry_date
        LEFT JOIN prices h1 ON h1.ticker = '{HEDGE}' AND h1.trade_date = t.entry_date LEFT JOIN prices h2 ON h2.ticker = '{HEDGE}' AND h2.trade_date = b.d5)"""


def _predictions(spark, sf_dir) -> DataFrame:
    bars = market.prices(spark, sf_dir)
    moved = decisions.later_moves(trade_table(spark, sf_dir), bars, _hedge(bars))
    return written(moved.select("event_id", "side", "exit_date", "pnl_pct", (F.col("confidence") / 10).alias("predicted"), "actual"), "predictions")


@query("STA-21b", _sql(f"""SELECT side, kind, event_id, value FROM (WITH {_PREDICTED},
    st AS (SELECT side, won, count(*) AS k FROM (SELECT side, pnl_pct > 0 AS won, row_number() OVER (PARTITION BY side ORDER BY exit_date, event_id) - row_number() OVER (PARTITION BY side, pnl_pct > 0 ORDER BY exit_date, event_id) AS island FROM trades) GROUP BY side, won, island)
    SELECT side, 'losses' AS kind, NULL::BIGINT AS event_id, max(k)::DOUBLE AS value FROM st WHERE NOT won GROUP BY 1 HAVING max(k) >= 2
    UNION ALL SELECT side, 'hit', event_id, round(abs(predicted - actual), 6) FROM pr WHERE abs(predicted) >= 1 AND abs(predicted - actual) <= 0.3)"""))
def sta_21b(spark, sf_dir):
    """Alerts: runs of losses, and large predictions that came close."""
    predictions = _predictions(spark, sf_dir)
    return ops.alerts(predictions, predictions, "side").withColumn("value", F.round("value", 6))


@query("STA-21d", _sql(f"""SELECT side, "end", place, event_id, error FROM (WITH {_PREDICTED}, e AS (SELECT side, event_id, abs(predicted - actual) AS error FROM pr WHERE actual IS NOT NULL)
    SELECT side, 'best' AS "end", row_number() OVER (PARTITION BY side ORDER BY error, event_id)::INT AS place, event_id, round(error, 6) AS error FROM e QUALIFY place <= 20
    UNION ALL SELECT side, 'worst', row_number() OVER (PARTITION BY side ORDER BY error DESC, event_id)::INT AS place, event_id, round(error, 6) FROM e QUALIFY place <= 20)"""))
def sta_21d(spark, sf_dir):
    """The best and the worst twenty predictions of each side."""
    return ops.error_ranking(_predictions(spark, sf_dir), "side", 20).withColumn("error", F.round("error", 6))


# ---- decisions

_INPUT = """i AS (SELECT o_orderkey AS k, (o_orderkey % 21 - 10) / 10 AS conviction, (o_orderkey % 101)::DOUBLE AS confidence, (o_orderkey % 100)::DOUBLE AS novelty,
        o_orderkey % 13 = 0 AS warned, o_orderkey % 11 > 0 AS has_model, o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 AS unannounced, CASE WHEN o_orderkey % 17 > 0 THEN o_totalprice * 10 END AS traded, o_totalprice / 10000 AS magnitude FROM orders)"""


def _inputs(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return market.table(spark, sf_dir, "orders").select(
        k.alias("k"), ((k % 21 - 10) / 10).alias("conviction"), (k % 101).cast("double").alias("confidence"), (k % 100).cast("double").alias("novelty"),
        (k % 13 == 0).alias("warned"), (k % 11 > 0).alias("has_model"), ((F.col("o_orderpriority") == "1-URGENT") & (k % 3 == 0)).alias("unannounced"),
        F.when(k % 17 > 0, F.col("o_totalprice") * 10).alias("traded"), (F.col("o_totalprice") / 10_000).alias("magnitude"),
    )


_REASON = "CASE WHEN novelty < 20 THEN 'novelty' WHEN warned THEN 'warning' WHEN NOT has_model THEN 'contradictory' WHEN unannounced THEN 'unannounced' WHEN traded IS NULL OR traded < 1000000 THEN 'illiquid' END"


@query("DEC-03", f"""WITH {_INPUT} SELECT k, {_REASON} AS reason,
    NOT (magnitude / 100 * 60 / 100 * 0.5::DOUBLE >= 0.008::DOUBLE + 0.009::DOUBLE OR magnitude / 100 * 60 / 100 >= 0.005::DOUBLE + 0.009::DOUBLE OR magnitude / 100 * 60 / 100 * 1.8::DOUBLE >= 0.002::DOUBLE + 0.009::DOUBLE) AS out_of_reach FROM i""")
def dec_03(spark, sf_dir):
    """What needs no judgement: objective reasons, and expected values that no conviction can lift over a threshold."""
    best = {s: finance.expected_value(F.lit(1.0), F.col("magnitude"), F.lit(100.0), F.lit(60.0), s) for s in decisions.THRESHOLDS}
    names = ("novelty", "warned", "has_model", "unannounced", "traded")
    return _inputs(spark, sf_dir).select("k", decisions.objective_reason(*map(F.col, names)).alias("reason"), decisions.out_of_reach(best, F.lit(0.009)).alias("out_of_reach"))


_FULL = """CASE WHEN novelty < 20 THEN 'NO_TRADE: novelty' WHEN confidence < 40 THEN 'NO_TRADE: confidence' WHEN abs(ev) < threshold THEN 'NO_TRADE: ev' WHEN warned THEN 'NO_TRADE: warning'
        WHEN NOT has_model OR (abs(conviction) < 0.15::DOUBLE AND confidence >= 60) THEN 'NO_TRADE: contradictory' WHEN unannounced THEN 'NO_TRADE: unannounced'
        WHEN traded IS NULL OR traded < 1000000 THEN 'NO_TRADE: illiquid' WHEN conviction > 0 THEN 'LONG' ELSE 'SHORT' END"""
_EV = "conviction * abs(magnitude) / 100 * confidence / 100 * 60 / 100"


@query("DEC-04", f"""WITH {_INPUT}, e AS (SELECT *, {_EV} AS ev, 0.005::DOUBLE + 0.009::DOUBLE AS threshold FROM i),
    c AS (SELECT k, sign(conviction) * abs(magnitude) / 100 * 60 / 100 AS ev, sign(conviction) AS conviction, 100.0::DOUBLE AS confidence, novelty, warned, has_model, unannounced, traded, threshold FROM e)
    SELECT e.k, e.decision, c.decision AS control, e.decision = c.decision AS same FROM (SELECT k, {_FULL} AS decision FROM e) e JOIN (SELECT k, {_FULL} AS decision FROM c) c USING (k)""")
def dec_04(spark, sf_dir):
    """The full cascade beside a control that follows the sign with full confidence."""
    rows = _inputs(spark, sf_dir)
    rest = [F.lit(0.005) + F.lit(0.009), *map(F.col, ("novelty", "warned", "has_model", "unannounced", "traded"))]

    def decide(conviction, confidence):
        ev = finance.expected_value(conviction, F.col("magnitude"), confidence, F.lit(60.0), "balanced")
        return decisions.abstention(ev, conviction, confidence, *rest)

    both = rows.select("k", decide(F.col("conviction"), F.col("confidence")).alias("decision"), decide(F.signum("conviction"), F.lit(100.0)).alias("control"))
    return both.withColumn("same", F.col("decision") == F.col("control"))


@query("DEC-06", f"""WITH {_INPUT} SELECT k, CASE WHEN confidence >= 70 AND abs({_EV}) >= 0.008::DOUBLE THEN 'conservative' ELSE 'aggressive' END AS style,
    round(2 + greatest(0, least(1, (confidence - 70) / 30)) * 3, 6) AS size_conservative, round(10 + greatest(0, least(1, (confidence - 50) / 50)) * 10, 6) AS size_aggressive FROM i""")
def dec_06(spark, sf_dir):
    ev = finance.expected_value(F.col("conviction"), F.col("magnitude"), F.col("confidence"), F.lit(60.0), "balanced")
    size = lambda s: F.round(decisions.interpolated_size(F.col("confidence"), s), 6).alias(f"size_{s}")
    return _inputs(spark, sf_dir).select("k", decisions.execution_style(F.col("confidence"), ev, 0.008).alias("style"), size("conservative"), size("aggressive"))


_SIZE, _CAPITAL = 1_000.0, 100_000.0


@query("DEC-07", _sql(f"""SELECT event_class, n, round(win_rate, 6) AS win_rate, round(calibration, 6) AS calibration, round(drawdown, 6) AS drawdown, forward,
        CASE WHEN peeked > 0 OR n < 20 THEN 'C' WHEN win_rate > 0.55 AND sharpe > 1 AND calibration > 0.6 AND drawdown < 0.15 AND n > 300 AND forward THEN 'A'
             WHEN sharpe < 0.7 OR win_rate < 0.5 OR calibration < 0.4 THEN 'C' ELSE 'B' END AS verdict
    FROM (SELECT event_class, count(*) AS n, count(*) FILTER (pnl_pct > 0) / count(*) AS win_rate, avg(pnl_pct) / stddev_samp(pnl_pct) AS sharpe, count(*) FILTER (entry_date <= d0) AS peeked,
                 CASE WHEN abs(avg(confidence / 10)) >= 1e-9 THEN 1 - abs(avg(confidence / 10) - avg(pnl_pct)) / abs(avg(confidence / 10)) END AS calibration,
                 CASE WHEN least(count(*) FILTER (early), count(*) FILTER (NOT early)) >= 10 THEN abs(avg((pnl_pct > 0)::INT) FILTER (early) - avg((pnl_pct > 0)::INT) FILTER (NOT early)) * 100 <= 15 AND avg(pnl_pct) FILTER (early) * avg(pnl_pct) FILTER (NOT early) >= 0 END AS forward
          FROM (SELECT *, entry_date < DATE '1998-06-01' AS early FROM trades) GROUP BY 1)
    JOIN (SELECT event_class, max(1 - bal / greatest({_CAPITAL}, peak)) AS drawdown FROM (SELECT *, max(bal) OVER (PARTITION BY event_class ORDER BY exit_date) AS peak FROM (
            SELECT event_class, exit_date, {_CAPITAL} + sum(won) OVER (PARTITION BY event_class ORDER BY exit_date) AS bal FROM (SELECT event_class, exit_date, sum(pnl_pct) * {_SIZE} / 100 AS won FROM trades GROUP BY ALL))) GROUP BY 1) USING (event_class)"""))
def dec_07(spark, sf_dir):
    """A verdict on each class from its win rate, Sharpe ratio, calibration, drawdown, number of trades, stability and look-ahead."""
    trades = written(trade_table(spark, sf_dir).select("event_class", "d0", "entry_date", "exit_date", "pnl_pct", "confidence"), "trades")
    predicted, actual = F.avg(F.col("confidence") / 10), F.avg("pnl_pct")
    sums = trades.groupBy("event_class").agg(
        F.count("*").alias("n"), (F.count_if(F.col("pnl_pct") > 0) / F.count("*")).alias("win_rate"),
        F.try_divide(actual, F.nullif(F.stddev_samp("pnl_pct"), F.lit(0.0))).alias("sharpe"), F.count_if(F.col("entry_date") <= F.col("d0")).alias("peeked"),
        F.when(F.abs(predicted) >= 1e-9, 1 - F.abs(predicted - actual) / F.abs(predicted)).alias("calibration"),
    )
    rows = sums.join(ops.rebuilt_drawdown(trades, ["event_class"], _SIZE, _CAPITAL), "event_class").join(ops.stable_over_time(trades, ["event_class"], F.lit("1998-06-01").cast("date")), "event_class")
    option = decisions.verdict(*(F.col(c) for c in ("win_rate", "sharpe", "calibration", "drawdown", "n", "stable", "peeked")))
    return rows.select("event_class", "n", *[F.round(c, 6).alias(c) for c in ("win_rate", "calibration", "drawdown")], F.col("stable").alias("forward"), option.alias("verdict"))


@query("DEC-08", _sql("""SELECT event_id, CASE WHEN magnitude > 0 AND move >= magnitude THEN 'SELL: fulfilled' WHEN (move > 0 AND move >= saturation) OR ratio >= 3 THEN 'SELL: saturated'
        WHEN event_class = '2-HIGH' AND side = 1 THEN 'SELL: event class' WHEN exit <= entry * 0.6::DOUBLE THEN 'SELL: price'
        WHEN side * conviction < 0 AND confidence >= 60 THEN 'SELL: contradiction' WHEN side * conviction < 0 AND confidence >= 40 THEN 'REDUCE' ELSE 'HOLD' END AS action
    FROM (SELECT *, side * (exit / entry - 1) * 100 AS move, (event_id % 300)::DOUBLE AS magnitude, (event_id % 40) / 10 AS ratio, (event_id % 21 - 10) / 10 AS conviction FROM trades)
    JOIN (SELECT event_class, CASE WHEN count(*) >= 5 THEN 2 * quantile_cont(abs(side * (exit / entry - 1) * 100), 0.5) END AS saturation FROM trades GROUP BY 1) USING (event_class)"""))
def dec_08(spark, sf_dir):
    """Reviews of positions at their exits, with the saturation level of each class."""
    t, k = trade_table(spark, sf_dir), F.col("event_id")
    moved = t.withColumn("move", F.col("side") * (F.col("exit") / F.col("entry") - 1) * 100)
    levels = decisions.saturation_levels(moved, "event_class", "d0", "move")
    action = decisions.review(
        F.col("side"), F.col("move"), (k % 300).cast("double"), F.col("saturation"), (k % 40) / 10, (F.col("event_class") == "2-HIGH") & (F.col("side") == 1),
        F.col("exit"), F.col("entry") * 0.6, F.lit(None).cast("double"), (k % 21 - 10) / 10, F.col("confidence").cast("double"),
    )
    return moved.join(levels, "event_class").select("event_id", action.alias("action"))


# ---- portfolios


@query("SIM-02")
def sim_02(spark, sf_dir):
    """One portfolio per class; the fold is serial, tests hold it against portfolios computed by hand."""
    rated = trade_table(spark, sf_dir).withColumn("ev", F.col("confidence") / 100.0)
    taken = portfolio.simulated(rated, "event_class")
    return _rounded(taken)


@query("SIM-03", _sql(f"""SELECT t.event_id, h.open AS hedge_entry, CASE WHEN x.trade_date >= t.entry_date THEN x.close END AS hedge_exit,
    round(side * (exit / entry - 1) * 100 - side * (CASE WHEN x.trade_date >= t.entry_date THEN x.close END / h.open - 1) * 100 - 0.6::DOUBLE, 5) AS hedged_pct
    FROM trades t LEFT JOIN prices h ON h.ticker = '{HEDGE}' AND h.trade_date = t.entry_date
    ASOF LEFT JOIN (SELECT * FROM prices WHERE ticker = '{HEDGE}') x ON t.exit_date >= x.trade_date"""))
def sim_03(spark, sf_dir):
    done = portfolio.hedged(trade_table(spark, sf_dir), _hedge(market.prices(spark, sf_dir)), 0.6)
    return done.select("event_id", "hedge_entry", "hedge_exit", F.round("hedged_pct", 5).alias("hedged_pct"))


@query("SIM-04", _sql("""SELECT event_id, CASE WHEN reason IS NOT NULL THEN reason WHEN last_bar >= week_end THEN 'TIMEOUT' ELSE 'OPEN' END AS status,
        CASE WHEN reason IS NOT NULL OR last_bar >= week_end THEN x END AS exit_date, round(CASE WHEN reason IS NOT NULL OR last_bar >= week_end THEN price END + 0.00000002::DOUBLE, 6) AS exit
    FROM (SELECT b.event_id, any_value(week_end) AS week_end, any_value(last_bar) AS last_bar, arg_min(reason, trade_date) FILTER (reason IS NOT NULL) AS reason,
                 coalesce(min(trade_date) FILTER (reason IS NOT NULL), max(trade_date)) AS x, coalesce(arg_min(fill, trade_date) FILTER (reason IS NOT NULL), arg_max(close, trade_date)) AS price
          FROM bar b JOIN (SELECT event_id, ticker, entry_date + ((11 - isodow(entry_date)) % 7 + 1)::INT - 0 AS week_end FROM entered) w USING (event_id)
          JOIN (SELECT ticker, max(trade_date) AS last_bar FROM prices GROUP BY 1) l ON l.ticker = w.ticker
          WHERE trade_date <= week_end GROUP BY b.event_id)"""))
def sim_04(spark, sf_dir):
    """Trades of one week: levels first, else the last close of the week; open while the series has not reached its end."""
    from .trades import STOP, TAKE

    bars = market.prices(spark, sf_dir)
    side = F.when(F.col("event_class").isin("1-URGENT", "2-HIGH"), 1).otherwise(-1)
    entered = ops.entries(market.events(spark, sf_dir), bars, side)
    week_end = F.date_add("entry_date", (F.lit(10) - F.weekday("entry_date")) % 7 + 1)
    done = ops.stop_or_take(entered, bars, STOP, TAKE, 8, until=week_end).withColumn("week_end", week_end)
    last = bars.groupBy("ticker").agg(F.max("trade_date").alias("last_bar"))
    rows = done.join(last, "ticker")
    over = (F.col("reason") != "TIME") | (F.col("last_bar") >= F.col("week_end"))
    status = F.when(F.col("reason") != "TIME", F.col("reason")).when(over, "TIMEOUT").otherwise("OPEN")
    return rows.select("event_id", status.alias("status"), F.when(over, F.col("exit_date")).alias("exit_date"), F.round(F.when(over, F.col("exit")) + 2e-8, 6).alias("exit"))


# ---- read queries


@query("QRY-01", "SELECT o_orderpriority AS kind, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS tag FROM orders WHERE o_orderstatus IS DISTINCT FROM 'P' GROUP BY 1")
def qry_01(spark, sf_dir):
    """The latest run of each kind that is not held out."""
    runs = market.table(spark, sf_dir, "orders").where(~F.col("o_orderstatus").eqNullSafe("P"))
    return runs.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("tag"))


@query("QRY-02", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 7 ORDER BY turn")
def qry_02(spark, sf_dir):
    """A report by its tag: the filter reaches the scan."""
    return market.table(spark, sf_dir, "conversations").where("conv_id = 7").orderBy("turn").select("conv_id", "turn", "role", "text")


@query("QRY-05", _sql("SELECT event_id, event_class, d0, confidence, last_tag FROM trades, (SELECT max(o_orderkey) AS last_tag FROM orders) WHERE event_class ILIKE '%high%' AND d0 BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND confidence >= 60 ORDER BY d0 DESC, event_id LIMIT 200"))
def qry_05(spark, sf_dir):
    """The feed: filters that are set, the latest tag beside each row, newest first, as many rows as a page has."""
    wanted = F.col("event_class").ilike("%high%") & F.col("d0").between("1997-01-01", "1998-12-31") & (F.col("confidence") >= 60)
    tag = market.table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last_tag"))
    page = trade_table(spark, sf_dir).where(wanted).orderBy(F.desc("d0"), "event_id").limit(200)
    return page.crossJoin(F.broadcast(tag)).select("event_id", "event_class", "d0", "confidence", "last_tag")


@query("QRY-06", market.oracle("prices", """
    SELECT ticker, arg_max(close, trade_date) AS last_close, count(*) AS n, list(round(close + 0.000000003::DOUBLE, 4) ORDER BY trade_date) FILTER ((k - 1) % greatest(n0 // 60, 1) = 0 OR k = n0) AS sparkline
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS k, count(*) OVER (PARTITION BY ticker) AS n0 FROM prices) GROUP BY ticker"""))
def qry_06(spark, sf_dir):
    """Home summary with a thinned series of about sixty points."""
    from ..operators import windows

    bars = market.prices(spark, sf_dir)
    point = F.struct("trade_date", F.round(F.col("close") + 3e-9, 4).alias("c"))
    line = windows.thinned(bars, "ticker", "trade_date", 60).groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["c"]).alias("sparkline"))
    return bars.groupBy("ticker").agg(F.max_by("close", "trade_date").alias("last_close"), F.count("*").alias("n")).join(line, "ticker")


@query("QRY-08", """
    SELECT CASE WHEN starts_with(p_name, 'red') THEN 'novelty' WHEN contains(p_name, 'widget') THEN 'confidence' WHEN contains(p_name, 'ring') THEN 'ev' ELSE 'other' END AS reason,
           count(*) AS n, max(l_shipdate) AS newest, count(*) FILTER (l_returnflag = 'R') AS returned
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def qry_08(spark, sf_dir):
    """Abstention summary with freshness; the lines are summed by part before the join."""
    sums = market.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("n"), F.max("l_shipdate").alias("newest"), F.count_if(F.col("l_returnflag") == "R").alias("returned")
    )
    rules = [("starts", "red", "novelty"), ("has", "widget", "confidence"), ("has", "ring", "ev")]
    named = market.table(spark, sf_dir, "part").select("p_partkey", finance.first_category(F.col("p_name"), rules, "other").alias("reason"))
    return sums.join(named, "p_partkey").groupBy("reason").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"), F.sum("returned").alias("returned"))


@query("QRY-09")
def qry_09(spark, sf_dir):
    """Signal history of each class with its intervals; as for the intervals, tests take the place of SQL."""
    results = _results(spark, sf_dir)
    history = _rounded(ops.trade_metrics(results, ["event_class"])).select("event_class", "wins", "losses", "expectancy")
    return history.join(_intervals(results), "event_class")


@query("QRY-20", _sql("SELECT event_id, ticker, entry_date FROM trades WHERE exit_date >= DATE '2000-06-01' AND entry_date <= DATE '2000-06-30' AND confidence >= 50 AND event_class NOT IN ('5-LOW')"))
def qry_20(spark, sf_dir):
    """Signals that wait at some time of a month, by predicates composed from settings."""
    first, last = (F.lit(d).cast("date") for d in ("2000-06-01", "2000-06-30"))
    settings = {"confidence": F.col("confidence") >= 50, "classes": ~F.col("event_class").isin("5-LOW"), "entered": F.col("entry_date") <= last, "not left": F.col("exit_date") >= first}
    return trade_table(spark, sf_dir).where(reduce(lambda a, b: a & b, settings.values())).select("event_id", "ticker", "entry_date")


@query("QRY-22", "SELECT event_type, 'k' AS name, (props->>'k')::INT AS level, count(*) AS n FROM events WHERE (props->>'k')::INT >= 95 GROUP BY ALL")
def qry_22(spark, sf_dir):
    """Alerts within nested JSON, exploded."""
    each = market.table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,int>")).alias("name", "level"))
    return each.where("level >= 95").groupBy("event_type", "name", "level").agg(F.count("*").alias("n"))


_WEEK = "date_trunc('week', exit_date)::DATE"


@query("AGG-23", _sql(f"""SELECT {_WEEK} AS week, count(*) AS closed, count(*) FILTER (pnl_pct > 0) AS won, round(sum(pnl_pct), 4) AS total, max(pnl_pct) FILTER (pnl_pct > 0) IS NOT NULL AS any_win FROM trades GROUP BY 1"""))
def agg_23(spark, sf_dir):
    """Weekly digest of what was closed."""
    p = F.col("pnl_pct")
    return trade_table(spark, sf_dir).groupBy(F.trunc("exit_date", "week").alias("week")).agg(
        F.count("*").alias("closed"), F.count_if(p > 0).alias("won"), F.round(F.sum(p), 4).alias("total"), (F.count_if(p > 0) > 0).alias("any_win")
    )


@query("QRY-23", _sql(f"SELECT {_WEEK} AS week, reason, count(*) AS n FROM trades WHERE exit_date BETWEEN DATE '1999-01-04' AND DATE '1999-03-28' GROUP BY ALL"))
def qry_23(spark, sf_dir):
    weeks = trade_table(spark, sf_dir).where(F.col("exit_date").between("1999-01-04", "1999-03-28"))
    return weeks.groupBy(F.trunc("exit_date", "week").alias("week"), "reason").agg(F.count("*").alias("n"))


@query("AGG-17", market.oracle(_BASE, f"""{_ALL}
    SELECT e.event_class, count(*) AS n_events, count(*) FILTER (c.event_id IS NULL) AS n_lost, round(100 * count(*) FILTER (c.event_id IS NULL) / count(*), 6) AS pct_lost,
           100 * count(*) FILTER (c.event_id IS NULL) / count(*) <= 20 AS reliable
    FROM ev e LEFT JOIN (SELECT event_id FROM car WHERE window_days = 20) c USING (event_id) WHERE e.d0 < DATE '2001-12-31' - 120 GROUP BY 1"""))
def agg_17(spark, sf_dir):
    """Events with a closed window but no abnormal return, per class."""
    closed = market.events(spark, sf_dir).where(F.col("d0") < F.date_sub(F.lit("2001-12-31").cast("date"), 120))
    done = car_table(spark, sf_dir, windows=(20,)).select("event_id", F.lit(1).alias("hit"))
    lost = 100 * (F.count("*") - F.count("hit")) / F.count("*")
    sums = closed.join(done, "event_id", "left").groupBy("event_class").agg(F.count("*").alias("n_events"), (F.count("*") - F.count("hit")).alias("n_lost"), lost.alias("pct"))
    return sums.select("event_class", "n_events", "n_lost", F.round("pct", 6).alias("pct_lost"), (F.col("pct") <= 20).alias("reliable"))


@query("STA-20b", _sql("""SELECT count(*) AS n, round(avg(pnl), 5) AS expectancy FROM (
    SELECT side * (exit / p2.open - 1) * 100 - 0.3::DOUBLE AS pnl FROM trades t
    JOIN (SELECT ticker, trade_date, lead(trade_date) OVER w AS next_date, lead(open) OVER w AS open FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)) p2
      ON p2.ticker = t.ticker AND p2.trade_date = t.entry_date WHERE p2.open IS NOT NULL AND exit_date >= next_date)"""))
def sta_20b(spark, sf_dir):
    """Latency: entries at the second bar's open; trades that had left by then go."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    second = market.prices(spark, sf_dir).select("ticker", F.col("trade_date").alias("entry_date"), F.lead("trade_date").over(w).alias("next_date"), F.lead("open").over(w).alias("next_open"))
    late = trade_table(spark, sf_dir).join(second, ["ticker", "entry_date"]).where("next_open is not null and exit_date >= next_date")
    repriced = ops.with_result(late.withColumn("entry", F.col("next_open")), 0.3)
    return repriced.agg(F.count("*").alias("n"), F.round(F.avg("pnl_pct"), 5).alias("expectancy"))

