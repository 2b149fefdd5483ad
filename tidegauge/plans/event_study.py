"""Queries: returns, models, abnormal returns and event-study statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import t_p_value, wilson
from ..operators import event_study as es
from ..operators.tables import written
from ..sources import market
from .registry import query


def car_table(spark: SparkSession, sf_dir: str, ticker: str = "p_type", windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    returns = es.simple_returns(market.prices(spark, sf_dir, ticker))
    events = market.events(spark, sf_dir, ticker)
    return es.cumulative_abnormal_returns(returns, market.factors(spark, sf_dir), events, windows)


def first_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns over 20 days, one per class, ticker and day, in percent: worked out once and written, as statistics start from them several times."""
    one = es.first_per_event_day(car_table(spark, sf_dir, windows=(20,)))
    return written(one.select("event_id", "event_class", "ticker", "d0", "window_days", (F.col("car") * 100).alias("car_pct")), "car")


def _statistics(car: DataFrame) -> DataFrame:
    stats = es.class_statistics(car)
    return stats.select("event_class", "n", *[F.round(c, 5).alias(c) for c in ("mean", "p25", "median", "p75", "std", "t_stat", "mde")])


_RETURNS = """ret AS (
        SELECT ticker, trade_date, r AS ret FROM (
            SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS r FROM prices) WHERE r IS NOT NULL),
    j AS (SELECT ticker, trade_date, ret, mkt_rf AS x0, smb AS x1, hml AS x2, rf, ret - rf AS y FROM ret JOIN factors USING (trade_date))"""

_MODEL = """est AS (
        SELECT event_id, count(*) AS n, avg(y) AS my, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2,
               var_pop(x0) AS a, covar_pop(x0, x1) AS b, covar_pop(x0, x2) AS c, var_pop(x1) AS d, covar_pop(x1, x2) AS e, var_pop(x2) AS f,
               covar_pop(x0, y) AS p, covar_pop(x1, y) AS q, covar_pop(x2, y) AS r, var_pop(y) AS vy
        FROM ev JOIN j ON j.ticker = ev.ticker AND trade_date BETWEEN d0 - 250 AND d0 - 30
        GROUP BY event_id HAVING count(*) >= 60),
    inv AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM est),
    beta AS (
        SELECT *, (p * (d * f - e * e) + q * (c * e - b * f) + r * (b * e - c * d)) / det AS b0,
               (p * (c * e - b * f) + q * (a * f - c * c) + r * (b * c - a * e)) / det AS b1,
               (p * (b * e - c * d) + q * (b * c - a * e) + r * (a * d - b * b)) / det AS b2
        FROM inv WHERE det <> 0),
    model AS (
        SELECT event_id, n AS n_est, my - b0 * m0 - b1 * m1 - b2 * m2 AS alpha, b0, b1, b2,
               sqrt(greatest(n * (vy - b0 * p - b1 * q - b2 * r), 0) / (n - 4)) AS resid_std
        FROM beta)"""

_CAR = """win AS (
        SELECT event_id, w, count(*) AS n_days, sum(ret - rf) AS sr, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2, stddev_samp(ret) AS event_std
        FROM ev CROSS JOIN (VALUES (5), (20)) AS ws(w)
        JOIN j ON j.ticker = ev.ticker AND trade_date > d0 AND trade_date <= d0 + w
        GROUP BY event_id, w),
    reach AS (SELECT ticker, max(trade_date) AS last_bar FROM j GROUP BY ticker),
    base AS (
        SELECT event_id, CASE WHEN count(*) >= 20 THEN stddev_samp(ret) END AS base_std
        FROM ev JOIN j ON j.ticker = ev.ticker AND trade_date > d0 - 90 AND trade_date <= d0 - 30 GROUP BY event_id),
    car AS (
        SELECT ev.event_id, ev.ticker, event_class, d0, win.w AS window_days, n_days, n_est,
               sr - n_days * alpha - b0 * s0 - b1 * s1 - b2 * s2 AS car, resid_std, event_std, event_std / nullif(base_std, 0) AS vol_ratio
        FROM ev LEFT JOIN base USING (event_id) JOIN win USING (event_id) JOIN model USING (event_id) JOIN reach ON reach.ticker = ev.ticker
        WHERE last_bar >= d0 + win.w
          AND n_days >= greatest(1, ceil(0.8 * len(list_filter(range(1, win.w + 1), lambda k: isodow(d0 + k::INT) < 6)))))"""

_BASE = "prices factors events"
_ALL = f"WITH {_RETURNS},\n    {_MODEL},\n    {_CAR}"


_FACTOR = "CASE WHEN trade_date < DATE '1998-01-01' AND length(ticker) % 2 = 0 THEN 0.5::DOUBLE WHEN day(trade_date) % 10 > 0 THEN 1.01::DOUBLE END"


@query("WIN-04", market.oracle("prices", f"""
    WITH a AS (SELECT ticker, trade_date, CASE WHEN volume % 50 > 0 THEN close END * coalesce({_FACTOR}, 1) AS c FROM prices)
    SELECT ticker, trade_date, round(ret, 6) AS ret FROM (SELECT ticker, trade_date, c / lag(c) OVER (PARTITION BY ticker ORDER BY trade_date) - 1 AS ret FROM a) WHERE ret IS NOT NULL"""))
def win_04(spark, sf_dir):
    """Returns on closes adjusted by a factor that can be unknown, over bars without a close."""
    day = F.col("trade_date")
    factor = F.when((day < "1998-01-01") & (F.length("ticker") % 2 == 0), 0.5).when(F.dayofmonth(day) % 10 > 0, 1.01)
    bars = market.prices(spark, sf_dir).withColumns({"adj_factor": factor, "close": F.when(F.col("volume") % 50 > 0, F.col("close"))})
    return es.simple_returns(bars, "adj_factor").withColumn("ret", F.round("ret", 6))


@query("JON-09", market.oracle("prices factors", f"WITH {_RETURNS} SELECT ticker, trade_date, round(y, 6) AS excess, x0 AS mkt_rf FROM j"))
def jon_09(spark, sf_dir):
    joined = es.simple_returns(market.prices(spark, sf_dir)).join(market.factors(spark, sf_dir), "trade_date")
    return joined.select("ticker", "trade_date", F.round(F.col("ret") - F.col("rf"), 6).alias("excess"), "mkt_rf")


@query("STA-01", market.oracle(_BASE, f"WITH {_RETURNS},\n    {_MODEL} SELECT event_id, n_est, round(b0, 5) AS beta_mkt_rf, round(b1, 5) AS beta_smb, round(b2, 5) AS beta_hml, round(resid_std, 6) AS resid_std FROM model"))
def sta_01(spark, sf_dir):
    events = market.events(spark, sf_dir)
    models = es.fitted_models(es.simple_returns(market.prices(spark, sf_dir)), market.factors(spark, sf_dir), events)
    return events.select("event_id", "ticker", "d0").join(models, ["ticker", "d0"]).select("event_id", "n_est", *[F.round(f"beta_{x}", 5).alias(f"beta_{x}") for x in es.X], F.round("resid_std", 6).alias("resid_std"))


@query("STA-02", market.oracle(_BASE, f"{_ALL} SELECT event_id, window_days, n_days, n_est, round(car, 5) AS car, round(resid_std, 6) AS resid_std, round(event_std, 6) AS event_std, round(vol_ratio, 4) AS vol_ratio FROM car"))
def sta_02(spark, sf_dir):
    car = car_table(spark, sf_dir)
    return car.select("event_id", F.col("window_days").cast("int").alias("window_days"), "n_days", "n_est", F.round("car", 5).alias("car"), F.round("resid_std", 6).alias("resid_std"), F.round("event_std", 6).alias("event_std"), F.round("vol_ratio", 4).alias("vol_ratio"))


_DEDUP = "one AS (SELECT DISTINCT ON (event_class, ticker, d0, window_days) * FROM car ORDER BY event_class, ticker, d0, window_days, event_id)"


@query("AGG-04", market.oracle(_BASE, f"{_ALL}, {_DEDUP} SELECT event_id, window_days, event_class, ticker, d0 FROM one"))
def agg_04(spark, sf_dir):
    return es.first_per_event_day(car_table(spark, sf_dir)).select("event_id", F.col("window_days").cast("int").alias("window_days"), "event_class", "ticker", "d0")


@query("STA-04", market.oracle(_BASE, f"""{_ALL}, {_DEDUP}
    SELECT event_class, count(*) AS n, round(avg(car * 100), 5) AS mean, round(quantile_cont(car * 100, 0.25), 5) AS p25,
           round(quantile_cont(car * 100, 0.5), 5) AS median, round(quantile_cont(car * 100, 0.75), 5) AS p75,
           round(stddev_samp(car * 100), 5) AS std, round(avg(car * 100) / (stddev_samp(car * 100) / sqrt(count(*))), 5) AS t_stat,
           round(2.8 * stddev_samp(car * 100) / sqrt(count(*)), 5) AS mde
    FROM one WHERE window_days = 20 GROUP BY event_class"""))
def sta_04(spark, sf_dir):
    return _statistics(first_cars(spark, sf_dir))


@query("STA-05", market.oracle(_BASE, f"""{_ALL}, {_DEDUP},
    q AS (SELECT event_class, count(*) AS n, quantile_cont(car * 100, 0.01) AS lo, quantile_cont(car * 100, 0.99) AS hi FROM one WHERE window_days = 20 GROUP BY 1)
    SELECT event_id, round(CASE WHEN n >= 100 THEN greatest(lo, least(hi, car * 100)) ELSE car * 100 END, 5) AS car_pct
    FROM one JOIN q USING (event_class) WHERE window_days = 20"""))
def sta_05(spark, sf_dir):
    return _percent(spark, sf_dir).select("event_id", F.round("car_pct", 5).alias("car_pct"))


def _percent(spark, sf_dir) -> DataFrame:
    return es.winsorised(first_cars(spark, sf_dir), "car_pct", ["event_class"])


_WINSOR = """x AS (
        SELECT one.*, CASE WHEN n >= 100 THEN greatest(lo, least(hi, car * 100)) ELSE car * 100 END AS v, date_trunc('month', d0) AS month
        FROM one JOIN (SELECT event_class, count(*) AS n, quantile_cont(car * 100, 0.01) AS lo, quantile_cont(car * 100, 0.99) AS hi FROM one WHERE window_days = 20 GROUP BY 1) USING (event_class)
        WHERE window_days = 20),
    mean AS (SELECT event_class, avg(v) AS m, count(*) AS n FROM x GROUP BY 1),
    cell AS (SELECT event_class, month, sum(v - m) AS e FROM x JOIN mean USING (event_class) GROUP BY ALL),
    clu AS (SELECT event_class, n, count(*) AS g, m, count(*) / (count(*) - 1) * sum(e * e) / (n * n) AS var FROM cell JOIN mean USING (event_class) GROUP BY event_class, n, m)"""


@query("STA-07", market.oracle(_BASE, f"{_ALL}, {_DEDUP}, {_WINSOR} SELECT event_class, n, g AS n_clusters, round(m, 5) AS mean, round(m / sqrt(var), 4) AS t_cluster, g - 1 AS df FROM clu"))
def sta_07(spark, sf_dir):
    found = _clustered(spark, sf_dir)
    return found.select("event_class", "n", "n_clusters", F.round("mean", 5).alias("mean"), F.round("t_cluster", 4).alias("t_cluster"), "df")


def _clustered(spark, sf_dir) -> DataFrame:
    return es.clustered_t(_percent(spark, sf_dir).withColumn("month", F.trunc("d0", "month")), "car_pct", ["event_class"], "month")


@query("STA-06")
def sta_06(spark, sf_dir):
    """p-values of the plain and the clustered t."""
    plain = _statistics(first_cars(spark, sf_dir))
    return plain.select("event_class", "n", "t_stat", F.round(t_p_value(F.col("t_stat"), (F.col("n") - 1).cast("double")), 6).alias("p_value"))


@query("STA-08", market.oracle(_BASE, f"""{_ALL}, {_DEDUP}
    SELECT event_class, count(s) AS n, round(avg(s), 5) AS mean_scar, round(avg(s) / (stddev_samp(s) / sqrt(count(s))), 4) AS t_bmp
    FROM (SELECT event_class, car / nullif(resid_std * sqrt(n_days), 0) AS s FROM one WHERE window_days = 20) GROUP BY 1"""))
def sta_08(spark, sf_dir):
    one = es.first_per_event_day(car_table(spark, sf_dir, windows=(20,)))
    scar = F.try_divide(F.col("car"), F.nullif(F.col("resid_std") * F.sqrt("n_days"), F.lit(0.0)))
    s = F.col("s")
    return one.select("event_class", scar.alias("s")).groupBy("event_class").agg(
        F.count(s).alias("n"),
        F.round(F.avg(s), 5).alias("mean_scar"),
        F.round(F.try_divide(F.avg(s), F.nullif(F.stddev_samp(s) / F.sqrt(F.count(s)), F.lit(0.0))), 4).alias("t_bmp"),
    )


@query("STA-09")
def sta_09(spark, sf_dir):
    """Adjusted p-values of the clustered t over classes."""
    found = _clustered(spark, sf_dir).withColumn("p_value", t_p_value("t_cluster", F.col("df").cast("double")))
    tested = es.benjamini_hochberg(found, "p_value", "event_class")
    return tested.select("event_class", F.round("p_value", 6).alias("p_value"), F.round("p_adjusted", 6).alias("p_adjusted"), "rejected")


@query("STA-10", market.oracle(_BASE, f"""{_ALL}, {_DEDUP},
    c AS (SELECT event_class, count(*) AS n, count(*) FILTER (car > 0) AS k FROM one WHERE window_days = 20 GROUP BY 1),
    p AS (SELECT *, 1.959963984540054::DOUBLE AS z, k / n AS p FROM c)
    SELECT event_class, n, k, round(CASE WHEN k <= 0 THEN 0 ELSE greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)) END, 8) AS low,
           round(CASE WHEN k >= n THEN 1 ELSE least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)) END, 8) AS high FROM p"""))
def sta_10(spark, sf_dir):
    one = es.first_per_event_day(car_table(spark, sf_dir, windows=(20,)))
    c = one.groupBy("event_class").agg(F.count("*").alias("n"), F.count_if(F.col("car") > 0).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("event_class", "n", "k", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("STA-04b")
def sta_04b(spark, sf_dir):
    """Each class's statistics with the clustered test and what follows from it; Student's t has no SQL, tests hold the words against cases."""
    cars = first_cars(spark, sf_dir)
    tested = es.clustered_t(es.winsorised(cars, "car_pct", ["event_class"]).withColumn("month", F.trunc("d0", "month")), "car_pct", ["event_class"], "month")
    tested = tested.select("event_class", "n_clusters", t_p_value("t_cluster", F.col("df").cast("double")).alias("p_value"))
    rows = es.class_statistics(cars).join(tested, "event_class", "left")
    said = es.conclusion(F.col("n"), F.col("std"), F.col("n_clusters"), F.col("p_value"), F.col("mde"))
    return rows.select("event_class", "n", "n_clusters", F.round("mean", 5).alias("mean"), F.round("mde", 5).alias("mde"), F.round("p_value", 6).alias("p_value"), said.alias("conclusion"))
