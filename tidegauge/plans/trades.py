"""Queries: trades without portfolio limits, their metrics, estimates from analogues and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance
from ..functions.stats import wilson
from ..operators import decisions, intervals, scenarios
from ..operators import trades as ops
from ..operators.tables import written
from ..sources import market
from .event_study import _ALL, _BASE, car_table
from .registry import query

#: Stop, take-profit, holding days and costs of the sample strategy.
STOP, TAKE, DAYS, COST = 0.5, 1.5, 20, 0.3
#: Costs that an expected value has to cover beside its threshold.
COST_MARGIN = 0.009


def trade_table(spark, sf_dir) -> DataFrame:
    """Trades of all events: long after the two urgent classes, short after the others."""
    bars = market.prices(spark, sf_dir)
    side = F.when(F.col("event_class").isin("1-URGENT", "2-HIGH"), 1).otherwise(-1)
    entered = ops.entries(market.events(spark, sf_dir), bars, side)
    done = ops.with_result(ops.stop_or_take(entered, bars, STOP, TAKE, DAYS), COST)
    return done.withColumn("confidence", F.col("event_id") % 61 + 40)


_TRADES = f"""entered AS (
        SELECT ev.*, p.trade_date AS entry_date, p.open AS entry, CASE WHEN event_class IN ('1-URGENT', '2-HIGH') THEN 1 ELSE -1 END AS side
        FROM ev ASOF JOIN prices p ON ev.ticker = p.ticker AND ev.d0 < p.trade_date),
    bar AS (
        SELECT e.event_id, trade_date, close, open,
               CASE WHEN side = 1 THEN CASE WHEN low <= entry * (1 - {STOP}) THEN 'STOP' WHEN high >= entry * (1 + {TAKE}) THEN 'TAKE' END
                    ELSE CASE WHEN high >= entry * (1 + {STOP}) THEN 'STOP' WHEN low <= entry * (1 - {TAKE}) THEN 'TAKE' END END AS reason,
               CASE WHEN side = 1 THEN CASE WHEN low <= entry * (1 - {STOP}) THEN least(open, entry * (1 - {STOP})) ELSE greatest(open, entry * (1 + {TAKE})) END
                    ELSE CASE WHEN high >= entry * (1 + {STOP}) THEN greatest(open, entry * (1 + {STOP})) ELSE least(open, entry * (1 - {TAKE})) END END AS fill
        FROM entered e JOIN prices p ON p.ticker = e.ticker AND trade_date BETWEEN entry_date AND entry_date + {DAYS}),
    outcome AS (
        SELECT event_id, coalesce(min(trade_date) FILTER (reason IS NOT NULL), max(trade_date)) AS exit_date,
               coalesce(arg_min(fill, trade_date) FILTER (reason IS NOT NULL), arg_max(close, trade_date)) AS exit,
               coalesce(arg_min(reason, trade_date) FILTER (reason IS NOT NULL), 'TIME') AS reason
        FROM bar GROUP BY event_id),
    trades AS (
        SELECT e.*, exit_date, exit, reason, side * (exit / entry - 1) * 100 - {COST}::DOUBLE AS pnl_pct, event_id % 61 + 40 AS confidence
        FROM entered e JOIN outcome USING (event_id))"""


def _sql(body: str) -> str:
    return market.oracle("prices events", f"WITH {_TRADES} {body}")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("SIM-01", _sql("SELECT event_id, side, entry_date, entry, exit_date, round(exit + 0.00000002::DOUBLE, 6) AS exit, reason FROM trades"))
def sim_01(spark, sf_dir):
    return trade_table(spark, sf_dir).select("event_id", "side", "entry_date", "entry", "exit_date", F.round(F.col("exit") + 2e-8, 6).alias("exit"), "reason")


_METRICS = """count(*) AS n, count(*) FILTER (pnl_pct > 0) AS wins, count(*) FILTER (pnl_pct <= 0) AS losses,
    round(count(*) FILTER (pnl_pct > 0) / count(*), 6) AS win_rate, round(sum(pnl_pct) FILTER (pnl_pct > 0) / nullif(abs(sum(pnl_pct) FILTER (pnl_pct <= 0)), 0), 6) AS profit_factor,
    round(avg(pnl_pct) FILTER (pnl_pct > 0), 6) AS mean_win, round(avg(pnl_pct) FILTER (pnl_pct <= 0), 6) AS mean_loss, round(avg(pnl_pct), 6) AS expectancy,
    round(max(pnl_pct), 6) AS best, round(min(pnl_pct), 6) AS worst"""


_UNIT = """(SELECT side, CASE WHEN gq >= 8 THEN 'quarter' ELSE 'month' END AS unit, round(CASE WHEN gq >= 8 THEN gq ELSE gm END, 6) AS g_effective FROM (
        SELECT side, max(g) FILTER (u = 'q') AS gq, max(g) FILTER (u = 'm') AS gm FROM (
            SELECT side, u, sum(k) * sum(k)::DOUBLE / sum(k * k) AS g FROM (SELECT side, u, date_trunc(CASE u WHEN 'q' THEN 'quarter' ELSE 'month' END, entry_date) AS c, count(*) AS k FROM trades, (VALUES ('q'), ('m')) AS units(u) GROUP BY ALL) GROUP BY ALL) GROUP BY side))"""
_WILSON = """round(CASE WHEN wins = 0 THEN 0 ELSE greatest(0, (wins / n + z * z / (2 * n) - z * sqrt(wins / n * (1 - wins / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 8) AS rate_low,
    round(CASE WHEN wins = n THEN 1 ELSE least(1, (wins / n + z * z / (2 * n) + z * sqrt(wins / n * (1 - wins / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 8) AS rate_high"""


def _side_results(spark, sf_dir) -> DataFrame:
    return written(trade_table(spark, sf_dir).select("event_id", "side", "entry_date", "exit_date", "pnl_pct"), "results")


@query("AGG-10", _sql(f"""SELECT m.*, longest_wins, longest_losses, {_WILSON}, unit, g_effective, g_effective >= 6 AND n >= 20 AS has_interval FROM (SELECT side, {_METRICS}, 1.959963984540054::DOUBLE AS z FROM trades GROUP BY side) m JOIN (
        SELECT side, coalesce(max(k) FILTER (won), 0) AS longest_wins, coalesce(max(k) FILTER (NOT won), 0) AS longest_losses FROM (
            SELECT side, won, count(*) AS k FROM (
                SELECT side, pnl_pct > 0 AS won, row_number() OVER (PARTITION BY side ORDER BY exit_date, event_id) - row_number() OVER (PARTITION BY side, pnl_pct > 0 ORDER BY exit_date, event_id) AS island FROM trades)
            GROUP BY side, won, island) GROUP BY side) s USING (side) JOIN {_UNIT} USING (side)""").replace("SELECT m.*,", "SELECT m.* EXCLUDE (z),"))
def agg_10(spark, sf_dir):
    """Metrics of each side with its streaks, the plain Wilson interval of its win rate, and what the grouped intervals rest on."""
    trades = _side_results(spark, sf_dir)
    sums = ops.trade_metrics(trades, ["side"])
    low, high = wilson(F.col("wins"), F.col("n"))
    rates = sums.select("side", F.round(low, 8).alias("rate_low"), F.round(high, 8).alias("rate_high"))
    block = intervals.block(trades, "pnl_pct", ["side"], "entry_date", "event_id")
    rests = block.select("side", "unit", F.round("g_effective", 6).alias("g_effective"), F.col("low").isNotNull().alias("has_interval"))
    return _rounded(sums).join(ops.longest_streaks(trades, ["side"]), "side").join(rates, "side").join(rests, "side")


@query("AGG-10b")
def agg_10b(spark, sf_dir):
    """The intervals of win rate and mean by effective quarters or months; Student's t has no SQL, tests hold it against loops."""
    return _rounded(intervals.block(_side_results(spark, sf_dir), "pnl_pct", ["side"], "entry_date", "event_id"))


@query("AGG-12", _sql(f"""SELECT event_class, {_METRICS}, round(CASE WHEN count(*) >= 20 THEN avg(pnl_pct) / nullif(stddev_samp(pnl_pct), 0) END, 6) AS sharpe_per_trade,
    count(*) < 20 AS insufficient FROM trades GROUP BY event_class"""))
def agg_12(spark, sf_dir):
    trades = trade_table(spark, sf_dir)
    return _rounded(ops.trade_metrics(trades, ["event_class"])).join(_rounded(ops.sharpe_per_trade(trades, ["event_class"])), "event_class")


_TIERS = decisions.profit_tiers()


def _tier_columns() -> str:
    """The fills of the tiers and of the stop on each bar, written out as the rule has them."""
    made = []
    for k, (gain, _) in enumerate(_TIERS):
        up, down = f"(entry * {1 + gain / 100}::DOUBLE)", f"(entry * {1 - gain / 100}::DOUBLE)"
        made.append(f"CASE WHEN side = 1 AND high >= {up} THEN greatest(open, {up}) WHEN side = -1 AND low <= {down} THEN least(open, {down}) END AS f{k}")
    return ", ".join(made)


_TIER_LIST = ", ".join(f"arg_min(f{k}, trade_date) FILTER (f{k} IS NOT NULL AND (sd IS NULL OR trade_date < sd)) AS f{k}, min(trade_date) FILTER (f{k} IS NOT NULL AND (sd IS NULL OR trade_date < sd)) AS d{k}" for k in range(len(_TIERS)))
_TIER_N = " + ".join(f"(f{k} IS NOT NULL)::INT" for k in range(len(_TIERS)))
_TIER_SUM = " + ".join(f"coalesce({share} * f{k}, 0)" for k, (_, share) in enumerate(_TIERS))
_TIER_LEFT = " - ".join(["1"] + [f"CASE WHEN f{k} IS NULL THEN 0 ELSE {share}::DOUBLE END" for k, (_, share) in enumerate(_TIERS)])


@query("SIM-01b", _sql(f"""SELECT event_id, tiers, exit_date, reason, round(exit + 0.00000002::DOUBLE, 5) AS exit FROM (
    SELECT event_id, n AS tiers, CASE WHEN n = {len(_TIERS)} THEN d{len(_TIERS) - 1} ELSE coalesce(sd, ld) END AS exit_date, CASE WHEN n = {len(_TIERS)} THEN 'TIERS' WHEN sd IS NOT NULL THEN 'STOP' ELSE 'TIME' END AS reason,
           total + CASE WHEN n = {len(_TIERS)} THEN 0 ELSE (left_over) * coalesce(sf, lc) END AS exit FROM (
        SELECT *, {_TIER_N} AS n, {_TIER_SUM} AS total, {_TIER_LEFT} AS left_over FROM (
            SELECT event_id, any_value(sd) AS sd, any_value(sf) AS sf, max(trade_date) AS ld, arg_max(close, trade_date) AS lc, {_TIER_LIST} FROM (
                SELECT *, min(CASE WHEN stop_fill IS NOT NULL THEN trade_date END) OVER v AS sd, arg_min(stop_fill, trade_date) FILTER (stop_fill IS NOT NULL) OVER v AS sf FROM (
                    SELECT e.event_id, p.trade_date, p.close, {_tier_columns()},
                           CASE WHEN side = 1 AND low <= entry * {1 - STOP} THEN least(open, entry * {1 - STOP}) WHEN side = -1 AND high >= entry * {1 + STOP} THEN greatest(open, entry * {1 + STOP}) END AS stop_fill
                    FROM entered e JOIN prices p ON p.ticker = e.ticker AND p.trade_date BETWEEN entry_date AND entry_date + {DAYS})
                WINDOW v AS (PARTITION BY event_id))
            GROUP BY event_id)))"""))
def sim_01b(spark, sf_dir):
    """Trades that are closed in parts at their profit tiers; the stop comes first on each bar."""
    bars = market.prices(spark, sf_dir)
    side = F.when(F.col("event_class").isin("1-URGENT", "2-HIGH"), 1).otherwise(-1)
    entered = ops.entries(market.events(spark, sf_dir), bars, side)
    done = ops.stop_or_tiers(entered, bars, STOP, _TIERS, DAYS)
    return done.select("event_id", "tiers", "exit_date", "reason", F.round(F.col("exit") + 2e-8, 5).alias("exit"))


@query("AGG-11", market.oracle("prices factors", """
    SELECT ticker, round(fin / first - 1, 6) AS total_return, round(CASE WHEN days >= 30 THEN (fin / first - 1) / (days / 365.25) END, 6) AS annual_return, round(dd, 6) AS max_drawdown,
           round(m / nullif(s, 0) * sqrt(252), 6) AS sharpe, round(m / nullif(CASE WHEN nd >= 2 THEN sd ELSE abs(od) END, 0) * sqrt(252), 6) AS sortino,
           round((fin / first - 1) / (days / 365.25) / nullif(dd, 0), 6) AS calmar, round((fin / first - 1) / nullif(dd, 0), 6) AS recovery, round(fin, 6) AS final_balance
    FROM (SELECT ticker, arg_min(close, trade_date) AS first, arg_max(close, trade_date) AS fin, greatest(max(trade_date) - min(trade_date), 1)::DOUBLE AS days, abs(min(d)) AS dd,
                 avg(r) AS m, stddev_samp(r) AS s, count(*) FILTER (r < 0) AS nd, stddev_samp(r) FILTER (r < 0) AS sd, min(r) AS od
          FROM (SELECT prices.*, close / lag(close) OVER w - 1 - coalesce(rf, 0) AS r, close / max(close) OVER w - 1 AS d FROM prices LEFT JOIN factors USING (trade_date) WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)) GROUP BY ticker)"""))
def agg_11(spark, sf_dir):
    curve = market.prices(spark, sf_dir).join(market.factors(spark, sf_dir).select("trade_date", "rf"), "trade_date", "left")
    return _rounded(ops.equity_metrics(curve, ["ticker"], "trade_date", "close", rf="rf"))


@query("AGG-13", _sql("SELECT event_class, count(*) AS n, round(avg((side * (exit / entry - 1) * 100 >= 3)::INT) * 100, 6) AS pct_up, round(avg((side * (exit / entry - 1) * 100 <= -3)::INT) * 100, 6) AS pct_down FROM trades GROUP BY 1"))
def agg_13(spark, sf_dir):
    move = F.col("side") * (F.col("exit") / F.col("entry") - 1) * 100
    share = lambda c: F.avg(c.cast("int")) * 100
    return _rounded(trade_table(spark, sf_dir).groupBy("event_class").agg(F.count("*").alias("n"), share(move >= 3).alias("pct_up"), share(move <= -3).alias("pct_down")))


@query("AGG-14", _sql("SELECT event_class, round(mp, 6) AS mean_predicted, round(ma, 6) AS mean_actual, round(CASE WHEN abs(mp) >= 1e-9 THEN 1 - abs(mp - ma) / abs(mp) END, 6) AS calibration_score FROM (SELECT event_class, avg(confidence / 10) AS mp, avg(pnl_pct) AS ma FROM trades GROUP BY 1)"))
def agg_14(spark, sf_dir):
    means = trade_table(spark, sf_dir).groupBy("event_class").agg(F.avg(F.col("confidence") / 10).alias("mean_predicted"), F.avg("pnl_pct").alias("mean_actual"))
    mp, ma = F.col("mean_predicted"), F.col("mean_actual")
    return _rounded(means.withColumn("calibration_score", F.when(F.abs(mp) >= 1e-9, 1 - F.abs(mp - ma) / F.abs(mp))))


_BUCKETS = "SELECT least(floor((confidence - 50) / 10), 4)::INT + 1 AS bucket, count(*) AS n, avg((pnl_pct > 0)::INT) AS hit_rate, avg(confidence) AS mean_confidence FROM trades WHERE confidence BETWEEN 50 AND 100 GROUP BY 1"


@query("AGG-16", _sql(f"SELECT bucket, n, round(hit_rate, 6) AS hit_rate, round(mean_confidence, 6) AS mean_confidence FROM ({_BUCKETS})"))
def agg_16(spark, sf_dir):
    return _rounded(ops.confidence_buckets(trade_table(spark, sf_dir)))


@query("AGG-16b", _sql(f"""SELECT n, round(c, 6) AS correlation, round(b, 6) AS brier, round(gap / n, 6) AS ece
    FROM (SELECT count(*) AS n, corr(confidence, (pnl_pct > 0)::INT) AS c, avg(power(confidence / 100 - (pnl_pct > 0)::INT, 2)) AS b FROM trades),
         (SELECT sum(n * abs(hit_rate - mean_confidence / 100)) AS gap FROM ({_BUCKETS}))"""))
def agg_16b(spark, sf_dir):
    return _rounded(ops.calibration(trade_table(spark, sf_dir)))


@query("AGG-18", _sql("""SELECT n_before, n_after, round(wb, 6) AS win_rate_before, round(wa, 6) AS win_rate_after, round(eb, 6) AS expectancy_before, round(ea, 6) AS expectancy_after,
        round(abs(wb - wa) * 100, 4) AS win_rate_diff_pp, eb * ea < 0 AS sign_flip, CASE WHEN n_before >= 10 AND n_after >= 10 THEN abs(wb - wa) * 100 <= 15 AND NOT eb * ea < 0 END AS stable
    FROM (SELECT count(*) FILTER (early) AS n_before, count(*) FILTER (NOT early) AS n_after, avg((pnl_pct > 0)::INT) FILTER (early) AS wb, avg((pnl_pct > 0)::INT) FILTER (NOT early) AS wa,
                 avg(pnl_pct) FILTER (early) AS eb, avg(pnl_pct) FILTER (NOT early) AS ea FROM (SELECT *, entry_date < DATE '1998-06-01' AS early FROM trades))"""))
def agg_18(spark, sf_dir):
    found = _rounded(ops.temporal_stability(trade_table(spark, sf_dir), F.lit("1998-06-01").cast("date")))
    return found.withColumn("win_rate_diff_pp", F.round("win_rate_diff_pp", 4))


_RECORDS = """(SELECT event_id, d0, CASE WHEN event_id % 97 = 0 THEN d0 ELSE entry_date END AS entry_date, CASE WHEN event_id % 89 = 0 THEN d0 - 3 ELSE exit_date END AS exit_date FROM trades)"""


@query("AGG-19", _sql(f"""SELECT event_id, 'event ' || event_id || ': entry ' || entry_date || ' is not after ' || d0 AS message FROM {_RECORDS} WHERE entry_date <= d0
    UNION ALL SELECT event_id, 'event ' || event_id || ': exit ' || exit_date || ' is before entry ' || entry_date FROM {_RECORDS} WHERE exit_date < entry_date"""))
def agg_19(spark, sf_dir):
    """Look-ahead in recorded trades, some of which were entered on the day of the event or left before it."""
    k = F.col("event_id")
    records = trade_table(spark, sf_dir).select(
        "event_id", "d0", F.when(k % 97 == 0, F.col("d0")).otherwise(F.col("entry_date")).alias("entry_date"), F.when(k % 89 == 0, F.date_sub("d0", 3)).otherwise(F.col("exit_date")).alias("exit_date")
    )
    return ops.look_ahead_messages(records)


@query("AGG-20", _sql("SELECT reason, side, count(*) AS n FROM trades GROUP BY ALL"))
def agg_20(spark, sf_dir):
    return trade_table(spark, sf_dir).groupBy("reason", "side").agg(F.count("*").alias("n"))


@query("STA-20c", _sql("""SELECT scenario, side, count(*) AS n, round(avg(pnl_pct - extra), 6) AS expectancy, round(count(*) FILTER (pnl_pct - extra > 0) / count(*), 6) AS win_rate
    FROM trades, (VALUES ('base', 0.0::DOUBLE), ('cost+20', 0.4::DOUBLE), ('cost+50', 1.0::DOUBLE)) AS s(scenario, extra) GROUP BY scenario, side"""))
def sta_20c(spark, sf_dir):
    """Extra costs on both legs, as scenarios beside the trades."""
    scenarios = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(x).alias("extra")) for n, x in (("base", 0.0), ("cost+20", 0.4), ("cost+50", 1.0))]))
    many = trade_table(spark, sf_dir).withColumn("s", scenarios).withColumn("pnl_pct", F.col("pnl_pct") - F.col("s.extra")).withColumn("scenario", F.col("s.scenario"))
    return _rounded(ops.trade_metrics(many, ["scenario", "side"])).select("scenario", "side", "n", "expectancy", "win_rate")


_HEDGE, _INDEX = "ECONOMY", "MEDIUM"
_TWO_LEGS = f"""hedge AS (SELECT trade_date, open, close FROM prices WHERE ticker = '{_HEDGE}'),
    t1 AS (SELECT t.*, CASE WHEN event_id % 2 = 0 AND x.trade_date >= t.entry_date AND h.open IS NOT NULL THEN h.open END AS h_in, CASE WHEN event_id % 2 = 0 AND x.trade_date >= t.entry_date AND h.open IS NOT NULL THEN x.close END AS h_out
           FROM trades t LEFT JOIN hedge h ON h.trade_date = t.entry_date ASOF LEFT JOIN hedge x ON t.exit_date >= x.trade_date),
    t2 AS (SELECT * EXCLUDE (pnl_pct), CASE WHEN h_in IS NULL THEN 1 ELSE 2 END AS legs, side * (exit / entry - 1) * 100 - CASE WHEN h_in IS NULL THEN 0 ELSE side * (h_out / h_in - 1) * 100 END AS gross FROM t1),
    t3 AS (SELECT *, gross - legs * {COST}::DOUBLE AS pnl FROM t2),
    nx AS (SELECT ticker, trade_date, lead(trade_date) OVER w AS day2, lead(open) OVER w AS open2 FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
    mk AS (SELECT ticker, trade_date FROM nx WHERE day2 IS NULL OR day2 - trade_date > 4),
    t4 AS (SELECT t.*, n.day2, n.open2, h2.open AS h_in2, mk.ticker IS NOT NULL AS gone, CASE WHEN v.trade_date >= t.d0 - 4 THEN v.close END AS fear
           FROM t3 t ASOF LEFT JOIN nx n ON n.ticker = t.ticker AND t.d0 < n.trade_date LEFT JOIN hedge h2 ON h2.trade_date = n.day2 LEFT JOIN mk ON mk.ticker = t.ticker AND mk.trade_date = t.exit_date
           ASOF LEFT JOIN (SELECT trade_date, close FROM prices WHERE ticker = '{_INDEX}') v ON t.d0 >= v.trade_date),
    med AS (SELECT side, CASE WHEN count(fear) >= 4 THEN quantile_cont(fear, 0.5) END AS med FROM t4 GROUP BY 1),
    t5 AS (SELECT * FROM t4 JOIN med USING (side)),
    sc AS (
        SELECT side, 'base' AS scenario, pnl, FALSE AS affected FROM t5
        UNION ALL SELECT side, 'commission', pnl - legs * 0.1::DOUBLE, TRUE FROM t5
        UNION ALL SELECT side, 'spread', pnl - legs * 0.2::DOUBLE, TRUE FROM t5
        UNION ALL SELECT side, 'latency', side * (exit / open2 - 1) * 100 - CASE WHEN h_in IS NULL THEN 0 ELSE side * (h_out / h_in2 - 1) * 100 END - (gross - pnl), TRUE FROM t5 WHERE open2 IS NOT NULL AND exit_date >= day2 AND (h_in IS NULL OR h_in2 IS NOT NULL)
        UNION ALL SELECT side, 'delisting', CASE WHEN gone THEN side * (exit * 0.7::DOUBLE / entry - 1) * 100 - CASE WHEN h_in IS NULL THEN 0 ELSE side * (h_out / h_in - 1) * 100 END - (gross - pnl) ELSE pnl END, gone FROM t5
        UNION ALL SELECT side, 'confidence', pnl, FALSE FROM t5 WHERE confidence * 0.8::DOUBLE >= 40
        UNION ALL SELECT side, 'high_index', pnl, FALSE FROM t5 WHERE fear >= med
        UNION ALL SELECT side, 'low_index', pnl, FALSE FROM t5 WHERE fear < med)"""


@query("STA-20", _sql(f"""SELECT scenario, side, n, affected, win_rate, expectancy, total_return FROM (WITH {_TWO_LEGS}
    SELECT scenario, side, count(pnl) AS n, count(*) FILTER (affected) AS affected, round(count(*) FILTER (pnl > 0) / nullif(count(pnl), 0), 6) AS win_rate, round(avg(pnl), 6) AS expectancy, round(coalesce(sum(pnl), 0) * 1000 / 100 / 100000, 6) AS total_return
    FROM (SELECT DISTINCT side FROM t5) CROSS JOIN (VALUES ('base'), ('commission'), ('spread'), ('latency'), ('delisting'), ('confidence'), ('high_index'), ('low_index')) AS names(scenario)
    LEFT JOIN sc USING (side, scenario) GROUP BY scenario, side)"""))
def sta_20(spark, sf_dir):
    """Every scenario of each side: costs of both legs, a day later, delistings, less confidence, and halves by the index."""
    bars = written(market.prices(spark, sf_dir), "bars")
    trades = trade_table(spark, sf_dir).select("event_id", "ticker", "d0", "side", "entry_date", "entry", "exit_date", "exit", "confidence")
    hedge = bars.where(F.col("ticker") == _HEDGE).select("trade_date", "open", "close")
    both = written(scenarios.two_legged(trades, hedge, F.col("event_id") % 2 == 0, COST), "two-legged")
    following = F.lead("trade_date").over(Window.partitionBy("ticker").orderBy("trade_date"))
    last = bars.withColumn("_next", following).where("_next is null or date_diff(_next, trade_date) > 4").select("ticker", "trade_date")
    index = bars.where(F.col("ticker") == _INDEX).select("trade_date", "close")
    found = written(scenarios.in_scenarios(both, bars, hedge, last, index, ["side"]), "scenarios")
    return _rounded(scenarios.summaries(found, ["side"], 1_000.0, 100_000.0))


@query("AGG-09", market.oracle(_BASE, f"""{_ALL},
    c AS (SELECT event_id, event_class, ticker, d0, car * 100 AS x, vol_ratio AS v FROM car WHERE window_days = 20),
    one AS (SELECT DISTINCT ON (event_class, ticker, d0) * FROM c ORDER BY event_class, ticker, d0, event_id),
    daily AS (SELECT event_class, d0, count(*) AS k, sum(v) AS sv, count(v) AS kv, sum(x) AS sx, sum(x * x) AS sxx, count(*) FILTER (abs(x) >= 5) AS o5, count(*) FILTER (abs(x) >= 10) AS o10, count(*) FILTER (abs(x) >= 20) AS o20 FROM one GROUP BY ALL),
    s AS (SELECT a.event_class, a.d0, coalesce(sum(b.k), 0) AS n, sum(b.sv) / nullif(sum(b.kv), 0) AS vr, sum(b.sx) AS sx, sum(b.sxx) AS sxx, sum(b.o5) AS o5, sum(b.o10) AS o10, sum(b.o20) AS o20
          FROM (SELECT DISTINCT event_class, d0 FROM c) a LEFT JOIN daily b ON a.event_class = b.event_class AND b.d0 < a.d0 - 20 GROUP BY ALL),
    m AS (SELECT *, sx / n AS mean, sqrt(greatest(0, (sxx - sx * sx / n) / nullif(n - 1, 0))) AS sd, n / (n + 15) * coalesce(sx / n, 0) + (1 - n / (n + 15)) * coalesce(CASE event_class WHEN '1-URGENT' THEN 2.0::DOUBLE WHEN '5-LOW' THEN -1.0::DOUBLE END, sx / n, 0) AS mag FROM s)
    SELECT event_id, n::BIGINT AS n_analogues, round(mag, 4) AS magnitude, CASE WHEN abs(mag) < 0.1 THEN 0.0 ELSE sign(mag) END::DOUBLE AS direction,
           round(coalesce(o5 * 100 / n, 0), 4) AS p_5, round(coalesce(o10 * 100 / n, 0), 4) AS p_10, round(coalesce(o20 * 100 / n, 0), 4) AS p_20,
           round(greatest(0, least(100, (coalesce(vr, 1) - 1) * 50)), 3)::DOUBLE AS volatility,
           round(CASE WHEN n < 5 THEN least(15, n * 3) ELSE greatest(0, least(100, least(n / 50, 1) * 70 + 30 - least(coalesce(sd, 0) / 10, 1) * 30)) END, 3) AS confidence
    FROM c JOIN m USING (event_class, d0)"""))
def agg_09(spark, sf_dir):
    car = car_table(spark, sf_dir, windows=(20,)).withColumn("car_pct", F.col("car") * 100)
    priors = spark.createDataFrame([("1-URGENT", 2.0), ("5-LOW", -1.0)], "event_class string, prior double")
    found = ops.impact_estimates(written(car.select("event_id", "event_class", "ticker", "d0", "window_days", "car_pct", "vol_ratio"), "car"), priors=priors)
    return found.select("event_id", "n_analogues", F.round("magnitude", 4).alias("magnitude"), "direction", *[F.round(f"p_{k}", 4).alias(f"p_{k}") for k in (5, 10, 20)], F.round("volatility", 3).alias("volatility"), F.round("confidence", 3).alias("confidence"))


@query("DEC-01", """
    SELECT o_orderkey, s.style, round((o_orderkey % 21 - 10) / 10 * abs(o_totalprice / 10000) / 100 * (o_orderkey % 101) / 100 * 60 / 100 * f + 0.000000000003::DOUBLE, 9) AS ev,
           round(least(abs((o_orderkey % 21 - 10) / 10 * abs(o_totalprice / 10000) / 100 * (o_orderkey % 101) / 100 * 60 / 100 * f) * 100 * 5 * (o_orderkey % 101) / 100, cap) + 0.00000002::DOUBLE, 4) AS size_pct
    FROM orders, (VALUES ('conservative', 0.5::DOUBLE, 3.0::DOUBLE), ('balanced', 1.0::DOUBLE, 5.0::DOUBLE), ('aggressive', 1.8::DOUBLE, 8.0::DOUBLE)) AS s(style, f, cap)""")
def dec_01(spark, sf_dir):
    return _rounded(_decision_inputs(spark, sf_dir).select("o_orderkey", "style", F.round(F.col("ev") + 3e-12, 9).alias("ev"), F.round(F.col("size_pct") + 2e-8, 4).alias("size_pct")), 10)


def _decision_inputs(spark, sf_dir) -> DataFrame:
    key, conviction = F.col("o_orderkey"), (F.col("o_orderkey") % 21 - 10) / 10
    confidence = (key % 101).cast("double")
    per_style = []
    for style in finance.STYLES:
        ev = finance.expected_value(conviction, F.col("o_totalprice") / 10_000, confidence, F.lit(60.0), style)
        per_style.append(F.struct(F.lit(style).alias("style"), ev.alias("ev"), finance.position_size(ev, confidence, style).alias("size_pct")))
    orders = market.table(spark, sf_dir, "orders").withColumn("s", F.explode(F.array(*per_style)))
    return orders.select("o_orderkey", "s.style", "s.ev", "s.size_pct", confidence.alias("confidence"), (key % 100).cast("double").alias("novelty"), "o_totalprice", "o_orderpriority")


@query("DEC-02", """
    SELECT o_orderkey, style, CASE WHEN o_orderkey % 100 < 20 THEN 'NO_TRADE: novelty' WHEN o_orderkey % 101 < 40 THEN 'NO_TRADE: confidence'
        WHEN abs(ev) < least_ev + 0.009::DOUBLE THEN 'NO_TRADE: ev' WHEN o_orderkey % 13 = 0 THEN 'NO_TRADE: warning'
        WHEN o_orderkey % 11 = 0 OR (abs((o_orderkey % 21 - 10) / 10) < 0.15::DOUBLE AND o_orderkey % 101 >= 60) THEN 'NO_TRADE: contradictory'
        WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN 'NO_TRADE: unannounced'
        WHEN o_orderkey % 17 = 0 OR o_totalprice * 10 < 1000000 THEN 'NO_TRADE: illiquid' WHEN o_orderkey % 21 > 10 THEN 'LONG' ELSE 'SHORT' END AS decision
    FROM (SELECT *, (o_orderkey % 21 - 10) / 10 * abs(o_totalprice / 10000) / 100 * (o_orderkey % 101) / 100 * 60 / 100 * f AS ev
          FROM orders, (VALUES ('conservative', 0.5::DOUBLE, 0.008::DOUBLE), ('balanced', 1.0::DOUBLE, 0.005::DOUBLE), ('aggressive', 1.8::DOUBLE, 0.002::DOUBLE)) AS s(style, f, least_ev))""")
def dec_02(spark, sf_dir):
    """All seven rules per style; the threshold of the expected value is the style's, plus costs."""
    k = F.col("o_orderkey")
    least = F.when(F.lit(False), 0.0)
    for style, value in decisions.THRESHOLDS.items():
        least = least.when(F.col("style") == style, value + COST_MARGIN)
    chosen = decisions.abstention(
        F.col("ev"), (k % 21 - 10) / 10, F.col("confidence"), least, F.col("novelty"), k % 13 == 0, k % 11 > 0,
        (F.col("o_orderpriority") == "1-URGENT") & (k % 3 == 0), F.when(k % 17 > 0, F.col("o_totalprice") * 10),
    )
    return _decision_inputs(spark, sf_dir).select("o_orderkey", "style", chosen.alias("decision"))


@query("STA-15", """
    SELECT o_orderkey, round((CASE WHEN d IS NULL THEN 0 ELSE 0.5::DOUBLE * greatest(0, least(100, 100 - abs(d) / 8 * 100)) END + CASE WHEN g IS NULL THEN 0 WHEN g THEN 5 ELSE 25 END + CASE WHEN r THEN 2.5::DOUBLE ELSE 25 END)
        / (CASE WHEN d IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN g IS NULL THEN 0 ELSE 0.25::DOUBLE END + 0.25::DOUBLE), 6) AS novelty
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 20 - 10 END::DOUBLE AS d, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END AS g, o_orderkey % 7 = 0 AS r FROM orders)""")
def sta_15(spark, sf_dir):
    k = F.col("o_orderkey")
    drift = F.when(k % 9 > 0, (k % 20 - 10).cast("double"))
    score = finance.novelty(drift, F.when(k % 5 > 0, k % 5 == 1), k % 7 == 0)
    return market.table(spark, sf_dir, "orders").select("o_orderkey", F.round(score, 6).alias("novelty"))


#: What is known on this day counts in the quality screen.
SCREEN_DAY = "2000-01-15"


@query("STA-16", market.oracle("fundamentals", f"""
    WITH k AS (SELECT * FROM fundamentals WHERE filed_at <= DATE '{SCREEN_DAY}'),
    y AS (SELECT cik, arg_max(revenue, period_end) AS rev, arg_max(net_income, period_end) AS ni, arg_max(shares, period_end) AS sh,
                 count(*) FILTER (revenue > 0) AS n, arg_min(revenue, period_end) FILTER (revenue > 0) AS r0, arg_max(revenue, period_end) FILTER (revenue > 0) AS r1 FROM k GROUP BY cik),
    a AS (SELECT *, CASE WHEN cik % 10 > 0 THEN rev * (cik % 10) / 5 END AS eq, CASE WHEN cik % 4 > 0 THEN rev * (cik % 5) / 4 END AS debt, CASE WHEN cik % 13 > 0 THEN ni * (cik % 11) / 8 END AS cash,
                 CASE WHEN cik % 7 > 0 THEN ni / 10 END AS capex, CASE WHEN cik % 17 > 0 THEN 4 * rev / sh END AS px FROM y),
    s AS (SELECT cik,
        CASE WHEN eq > 0 THEN greatest(0, least(100, (ni / eq - 0.05::DOUBLE) / 0.15::DOUBLE * 100)) END AS profitability,
        CASE WHEN eq > 0 THEN greatest(0, least(100, (1.5::DOUBLE - coalesce(debt, 0) / eq) * 100)) END AS solidity,
        CASE WHEN ni > 0 THEN greatest(0, least(100, ((cash - capex) / ni - 0.4::DOUBLE) / 0.5::DOUBLE * 100)) END AS earnings_raw, cash, capex,
        CASE WHEN n >= 3 THEN greatest(0, least(100, (power(r1 / r0, 1.0::DOUBLE / (n - 1)) - 1 + 0.1::DOUBLE) / 0.2::DOUBLE * 100)) END AS growth,
        CASE WHEN ni > 0 AND px IS NOT NULL THEN greatest(0, least(100, (35 - px * sh / ni) / 23 * 100)) END AS price FROM a),
    p AS (SELECT cik, profitability, solidity, CASE WHEN cash IS NOT NULL AND capex IS NOT NULL THEN earnings_raw END AS earnings, growth, price FROM s),
    l AS (UNPIVOT p ON profitability, solidity, earnings, growth, price INTO NAME part VALUE score),
    w AS (SELECT cik, sum(score * v) / sum(v) AS total, count(*) AS known FROM l JOIN (VALUES ('profitability', 0.25::DOUBLE), ('solidity', 0.2::DOUBLE), ('earnings', 0.2::DOUBLE), ('growth', 0.2::DOUBLE), ('price', 0.15::DOUBLE)) AS ws(part, v) USING (part) GROUP BY cik)
    SELECT cik, round(profitability, 4) AS profitability, round(solidity, 4) AS solidity, round(earnings, 4) AS earnings, round(growth, 4) AS growth, round(price, 4) AS price, round(total, 4) AS quality,
           coalesce(known, 0)::INT AS known, CASE WHEN total IS NULL THEN 'unknown' WHEN known < 3 THEN 'incomplete' WHEN total >= 75 THEN 'solid' WHEN total >= 55 THEN 'decent' WHEN total >= 35 THEN 'troubled' ELSE 'weak' END AS band
    FROM p LEFT JOIN w USING (cik)"""))
def sta_16(spark, sf_dir):
    """Quality of companies by the accounts filed by the screen's day; equity, debt, cash flow and price are bound to the id."""
    f, k = market.fundamentals(spark, sf_dir).where(F.col("filed_at") <= F.lit(SCREEN_DAY).cast("date")), F.col("cik")
    positive = F.when(F.col("revenue") > 0, F.struct("period_end", "revenue"))
    last = F.max(F.struct("period_end", "revenue", "net_income", "shares")).alias("last")
    a = f.groupBy("cik").agg(F.count(positive).alias("n"), F.min(positive).alias("r0"), F.max(positive).alias("r1"), last)
    rev, ni, sh = (F.col(f"last.{c}") for c in ("revenue", "net_income", "shares"))
    parts = finance.quality_parts(
        ni, F.when(k % 10 > 0, rev * (k % 10) / 5), F.when(k % 4 > 0, rev * (k % 5) / 4), F.when(k % 13 > 0, ni * (k % 11) / 8), F.when(k % 7 > 0, ni / 10),
        F.struct("n", F.col("r0.revenue").alias("first"), F.col("r1.revenue").alias("last")), F.when(k % 17 > 0, 4 * rev / sh), sh,
    )
    scored = a.select("cik", *[c.alias(name) for name, (c, _) in parts.items()])
    total = finance.weighted_over_known([(F.col(name), weight) for name, (_, weight) in parts.items()])
    known = sum((F.col(name).isNotNull().cast("int") for name in parts), F.lit(0))
    done = scored.withColumns({"quality": total, "known": known})
    return _rounded(done.withColumn("band", finance.quality_band(F.col("quality"), F.col("known"))), 4)


@query("STA-13", _sql("""SELECT event_class, round(n * n / sq, 6) AS effective_quarters, CASE WHEN n * n / sq >= 8 THEN 'quarter' ELSE 'month' END AS unit
    FROM (SELECT event_class, sum(k) AS n, sum(k * k) AS sq FROM (SELECT event_class, date_trunc('quarter', d0) AS q, count(*) AS k FROM trades GROUP BY ALL) GROUP BY 1)"""))
def sta_13(spark, sf_dir):
    cells = trade_table(spark, sf_dir).groupBy("event_class", F.trunc("d0", "quarter").alias("q")).agg(F.count("*").alias("k"))
    sums = cells.groupBy("event_class").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    effective = F.col("n") * F.col("n") / F.col("sq")
    return sums.select("event_class", F.round(effective, 6).alias("effective_quarters"), F.when(effective >= 8, "quarter").otherwise("month").alias("unit"))


# ---- reports on trades

_SPLIT = "1999-06-01"


@query("AGG-20b", _sql("""SELECT event_class, finding, finding = 'passes' AS passes, bool_or(finding = 'passes') OVER () AS any_passes FROM (
    SELECT event_class, CASE WHEN peeked > 0 THEN peeked || ' trades look ahead' WHEN n < 20 THEN 'only ' || n || ' trades' WHEN sharpe > 1 AND drawdown < 0.25 AND calibration > 0.6 THEN 'passes'
        ELSE 'fails: ' || concat_ws(', ', CASE WHEN sharpe > 1 THEN NULL ELSE 'sharpe ' || coalesce(printf('%.2f', sharpe), 'unknown') END, CASE WHEN drawdown < 0.25 THEN NULL ELSE 'drawdown ' || coalesce(printf('%.2f', drawdown), 'unknown') END,
             CASE WHEN calibration > 0.6 THEN NULL ELSE 'calibration ' || coalesce(printf('%.2f', calibration), 'unknown') END) END AS finding
    FROM (SELECT event_class, count(*) AS n, avg(pnl_pct) / stddev_samp(pnl_pct) AS sharpe, count(*) FILTER (event_class = '5-LOW' AND event_id % 997 = 1) AS peeked, 1 - abs(avg(confidence / 10) - avg(pnl_pct)) / abs(avg(confidence / 10)) AS calibration FROM trades GROUP BY 1)
    JOIN (SELECT event_class, max(1 - bal / greatest(100000, peak)) AS drawdown FROM (SELECT *, max(bal) OVER (PARTITION BY event_class ORDER BY exit_date) AS peak FROM (
            SELECT event_class, exit_date, 100000 + sum(won) OVER (PARTITION BY event_class ORDER BY exit_date) AS bal FROM (SELECT event_class, exit_date, sum(pnl_pct) * 1000 / 100 AS won FROM trades GROUP BY ALL))) GROUP BY 1) USING (event_class))"""))
def agg_20b(spark, sf_dir):
    """What to make of each class: look-ahead, too few trades, or the figures that it misses; and whether any passes."""
    trades = written(trade_table(spark, sf_dir).select("event_id", "event_class", "exit_date", "pnl_pct", "confidence"), "trades")
    predicted, actual = F.avg(F.col("confidence") / 10), F.avg("pnl_pct")
    sums = trades.groupBy("event_class").agg(
        F.count("*").alias("n"), F.try_divide(actual, F.nullif(F.stddev_samp("pnl_pct"), F.lit(0.0))).alias("sharpe"),
        F.count_if((F.col("event_class") == "5-LOW") & (F.col("event_id") % 997 == 1)).alias("peeked"), (1 - F.abs(predicted - actual) / F.abs(predicted)).alias("calibration"),
    )
    return ops.recommendation(sums.join(ops.rebuilt_drawdown(trades, ["event_class"], 1_000.0, 100_000.0), "event_class"), "event_class")


@query("STA-21c", _sql(f"""SELECT side, n_now, n_before, round(rate_now, 6) AS rate_now, round(rate_before, 6) AS rate_before, round(abs(rate_now - rate_before) * 100, 4) AS diff_pp, abs(rate_now - rate_before) * 100 <= 30 AS matches
    FROM (SELECT side, count(*) AS n_now, avg((pnl_pct > 0)::INT) AS rate_now FROM trades WHERE entry_date >= DATE '{_SPLIT}' GROUP BY 1) FULL JOIN (SELECT side, count(*) AS n_before, avg((pnl_pct > 0)::INT) AS rate_before FROM trades WHERE entry_date < DATE '{_SPLIT}' GROUP BY 1) USING (side)"""))
def sta_21c(spark, sf_dir):
    """Whether recent trades win about as often as earlier ones."""
    trades = trade_table(spark, sf_dir).select("side", "entry_date", "pnl_pct")
    found = ops.against_history(trades.where(F.col("entry_date") >= _SPLIT), trades.where(F.col("entry_date") < _SPLIT), "side")
    return _rounded(found).withColumn("diff_pp", F.round("diff_pp", 4))


_PARTS = f"""pt AS (
        SELECT event_id, ticker, side, entry, entry_date, unnest(list_filter([{", ".join(f"CASE WHEN f{k} IS NOT NULL THEN {{'d': d{k}, 'w': {share}::DOUBLE, 'p': f{k}}} END" for k, (_, share) in enumerate(_TIERS))},
               CASE WHEN left_over > 1e-9 THEN {{'d': coalesce(sd, ld), 'w': left_over, 'p': coalesce(sf, lc)}} END], lambda x: x IS NOT NULL)) AS x
        FROM (SELECT t.*, e.ticker, e.side, e.entry, e.entry_date, {_TIER_LEFT} AS left_over FROM (
            SELECT event_id, any_value(sd) AS sd, any_value(sf) AS sf, max(trade_date) AS ld, arg_max(close, trade_date) AS lc, {_TIER_LIST} FROM (
                SELECT *, min(CASE WHEN stop_fill IS NOT NULL THEN trade_date END) OVER v AS sd, arg_min(stop_fill, trade_date) FILTER (stop_fill IS NOT NULL) OVER v AS sf FROM (
                    SELECT e.event_id, p.trade_date, p.close, {_tier_columns()},
                           CASE WHEN side = 1 AND low <= entry * {1 - STOP} THEN least(open, entry * {1 - STOP}) WHEN side = -1 AND high >= entry * {1 + STOP} THEN greatest(open, entry * {1 + STOP}) END AS stop_fill
                    FROM entered e JOIN prices p ON p.ticker = e.ticker AND p.trade_date BETWEEN entry_date AND entry_date + {DAYS})
                WINDOW v AS (PARTITION BY event_id)) GROUP BY event_id) t JOIN entered e USING (event_id))),
    hg AS (SELECT trade_date, open, close FROM prices WHERE ticker = '{_HEDGE}')"""


def _closes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    bars = written(market.prices(spark, sf_dir), "bars")
    side = F.when(F.col("event_class").isin("1-URGENT", "2-HIGH"), 1).otherwise(-1)
    entered = ops.entries(market.events(spark, sf_dir), bars, side).select("event_id", "ticker", "entry_date", "entry", "side")
    return ops.stop_or_tiers(entered, bars, STOP, _TIERS, DAYS, parts=True), bars


@query("SIM-03b", _sql(f"""SELECT event_id, exit_date, round(exit + 0.00000002::DOUBLE, 5) AS exit, round(hx + 0.0000002::DOUBLE, 5) AS hedge_exit, parts, round(side * (exit / entry - 1) * 100 - CASE WHEN hx IS NULL THEN 0 ELSE side * (hx / h_in - 1) * 100 + {COST}::DOUBLE END - {COST}::DOUBLE, 5) AS pnl_pct FROM (
    WITH {_PARTS} SELECT event_id, max(x.d) AS exit_date, sum(x.w * x.p) / sum(x.w) AS exit, CASE WHEN count(hc) = count(*) THEN sum(x.w * hc) / sum(x.w) END AS hx, count(*) AS parts, any_value(side) AS side, any_value(entry) AS entry, any_value(h_in) AS h_in
    FROM (SELECT pt.*, h.open AS h_in, CASE WHEN c.trade_date >= pt.entry_date AND h.open IS NOT NULL THEN c.close END AS hc FROM (SELECT *, x.d AS xd FROM pt) pt LEFT JOIN hg h ON h.trade_date = pt.entry_date ASOF LEFT JOIN hg c ON pt.xd >= c.trade_date) GROUP BY event_id)"""))
def sim_03b(spark, sf_dir):
    """Trades closed in parts as one record each, with the hedge's weighted exit and the costs of both legs."""
    closes, bars = _closes(spark, sf_dir)
    done = ops.consolidated(closes, bars.where(F.col("ticker") == _HEDGE).select("trade_date", "open", "close"), COST)
    return done.select("event_id", "exit_date", F.round(F.col("exit") + 2e-8, 5).alias("exit"), F.round(F.col("hedge_exit") + 2e-7, 5).alias("hedge_exit"), "parts", F.round("pnl_pct", 5).alias("pnl_pct"))


@query("SIM-03c", _sql(f"""SELECT event_id, round(open_share, 6) AS open_share, round(value, 4) AS value FROM (
    WITH {_PARTS}, q AS (SELECT pt.*, x.d AS xd, least(x.d, DATE '1999-06-30') AS at FROM pt WHERE entry_date <= DATE '1999-06-30')
    SELECT event_id, sum(CASE WHEN xd <= DATE '1999-06-30' THEN 0 ELSE w END) AS open_share,
           sum(1000 * w * (1 + side * (CASE WHEN xd <= DATE '1999-06-30' THEN p WHEN bd >= entry_date THEN bc ELSE entry END / entry - 1) - coalesce(side * (CASE WHEN hd >= entry_date THEN hc ELSE h_in END / h_in - 1), 0))) AS value
    FROM (SELECT q.event_id, q.entry_date, q.entry, q.side, q.xd, q.x.w AS w, q.x.p AS p, b.trade_date AS bd, b.close AS bc, c.trade_date AS hd, c.close AS hc, h.open AS h_in
          FROM q LEFT JOIN hg h ON h.trade_date = q.entry_date ASOF LEFT JOIN hg c ON q.at >= c.trade_date ASOF LEFT JOIN prices b ON b.ticker = q.ticker AND q.at >= b.trade_date) GROUP BY event_id)"""))
def sim_03c(spark, sf_dir):
    """What the trades of SIM-03b are worth at the end of a half-year: closed parts at their exits, the rest at the last closes of both legs."""
    closes, bars = _closes(spark, sf_dir)
    hedge = bars.where(F.col("ticker") == _HEDGE).select("trade_date", "open", "close")
    found = ops.marked_to_market(closes, bars, hedge, F.lit("1999-06-30").cast("date"), 1_000.0)
    return found.select("event_id", F.round("open_share", 6).alias("open_share"), F.round("value", 4).alias("value"))
