"""Queries: upkeep of stored results, series on changed bases, capitalisation, download plans, budgets and schedules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cron
from ..operators import budget, capitalisation, coverage, rebasing, upkeep
from ..operators.tables import written
from ..sources import market
from .event_study import _ALL, _BASE, car_table
from .registry import query


def _day(text: str):
    return F.lit(text).cast("date")


# ---- prices on changed bases

_CAPTURED = "(date_trunc('month', trade_date) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE"


@query("TSQ-05", market.oracle("prices", f"""
    SELECT ticker, count(*) AS jumps, count(*) FILTER (captured <> pcap) AS between_captures
    FROM (SELECT ticker, close, {_CAPTURED} AS captured, lag(close) OVER w AS pc, lag({_CAPTURED}) OVER w AS pcap FROM prices WINDOW w AS (PARTITION BY ticker ORDER BY trade_date))
    WHERE pc > 0 AND abs(close / pc - 1) > 0.3 GROUP BY ticker"""))
def tsq_05(spark, sf_dir):
    """Jumps of stored series, and those between bars of different downloads; a download covers a month."""
    return rebasing.base_jumps(market.prices(spark, sf_dir).withColumn("captured_at", F.last_day("trade_date")))


_FACTOR = """CASE WHEN dayofyear(trade_date) = 100 THEN 1.5::DOUBLE WHEN length(ticker) % 2 = 0 AND trade_date < DATE '1998-01-01' THEN 0.5::DOUBLE
    WHEN ticker = 'PROMO' AND trade_date BETWEEN DATE '1999-03-01' AND DATE '1999-06-30' THEN 1.25::DOUBLE ELSE 1 + (day(trade_date) % 3) * 0.001::DOUBLE END"""


def _versions(bars: DataFrame) -> DataFrame:
    """Three captures of each bar: as stored, after splits with an odd bar a year, and with one ticker on a tenth of it."""
    day = F.col("trade_date")
    second = (
        F.when(F.dayofyear(day) == 100, 1.5)
        .when((F.length("ticker") % 2 == 0) & (day < _day("1998-01-01")), 0.5)
        .when((F.col("ticker") == "PROMO") & day.between("1999-03-01", "1999-06-30"), 1.25)
        .otherwise(1 + (F.dayofmonth(day) % 3) * 0.001)
    )
    third = second * F.when(F.col("ticker") == "LARGE", 0.1).otherwise(1.0)
    made = [F.struct(_day(at).alias("captured_at"), (F.col("close") * f).alias("close")) for at, f in (("2001-12-01", F.lit(1.0)), ("2001-12-31", second), ("2002-01-31", third))]
    return bars.select("ticker", "trade_date", F.explode(F.array(*made)).alias("v")).select("ticker", "trade_date", "v.*")


@query("TSQ-05b", market.oracle("prices", f"""
    WITH f AS (SELECT ticker, trade_date, close, {_FACTOR} AS f FROM prices),
    v AS (SELECT ticker, trade_date, DATE '2001-12-01' AS captured_at, close FROM f UNION ALL SELECT ticker, trade_date, DATE '2001-12-31', close * f FROM f
          UNION ALL SELECT ticker, trade_date, DATE '2002-01-31', close * f * CASE WHEN ticker = 'LARGE' THEN 0.1::DOUBLE ELSE 1 END FROM f),
    r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker, trade_date ORDER BY captured_at) AS ratio FROM v),
    n AS (SELECT *, coalesce((abs(ratio / lag(ratio) OVER (PARTITION BY ticker, captured_at ORDER BY trade_date) - 1) > 0.005)::INT, 1) AS new FROM r WHERE ratio IS NOT NULL),
    g AS (SELECT *, sum(new) OVER (PARTITION BY ticker, captured_at ORDER BY trade_date) AS run FROM n)
    SELECT ticker, captured_at, min(trade_date) AS "start", max(trade_date) AS "end", count(*) AS bars, round(avg(ratio), 6) AS ratio
    FROM g GROUP BY ticker, captured_at, run HAVING count(*) >= 3 AND abs(avg(ratio) - 1) > 0.03"""))
def tsq_05b(spark, sf_dir):
    """Changes of base between versions of the same bars: runs of one ratio, without single odd bars."""
    found = rebasing.base_changes(rebasing.version_ratios(_versions(market.prices(spark, sf_dir))))
    return found.select("ticker", "captured_at", "start", "end", "bars", F.round("ratio", 6).alias("ratio"))


# ---- capitalisation

_SPLITS = "sp AS (SELECT ticker, trade_date AS split_date, CASE WHEN volume % 2 = 0 THEN 1.01::DOUBLE ELSE 0.98::DOUBLE END AS ratio FROM prices WHERE high > 6 * low AND volume < 150)"


def _splits(bars: DataFrame) -> DataFrame:
    ratio = F.when(F.col("volume") % 2 == 0, 1.01).otherwise(0.98)
    return bars.where("high > 6 * low and volume < 150").select("ticker", F.col("trade_date").alias("split_date"), ratio.alias("ratio"))


@query("TSQ-07", market.oracle("prices events fundamentals", f"""
    WITH {_SPLITS},
    acc AS (SELECT cik, filed_at, period_end, shares FROM fundamentals WHERE shares % 3 <> 0),
    pr AS (SELECT p.ticker, p.trade_date, any_value(close) AS close, any_value(close) * coalesce(exp(sum(ln(ratio))), 1) AS traded FROM prices p LEFT JOIN sp ON sp.ticker = p.ticker AND sp.split_date > p.trade_date GROUP BY 1, 2),
    a AS (SELECT ev.event_id, ev.ticker, ev.cik, ev.d0, acc.filed_at, acc.period_end, acc.shares, pr.close, CASE WHEN length(ev.ticker) % 2 = 1 THEN pr.traded END AS traded
          FROM ev ASOF LEFT JOIN acc ON acc.cik = ev.cik AND ev.d0 >= acc.filed_at ASOF LEFT JOIN pr ON pr.ticker = ev.ticker AND ev.d0 >= pr.trade_date),
    days AS (SELECT DISTINCT ticker, filed_at, d0 FROM a WHERE filed_at IS NOT NULL),
    f AS (SELECT d.ticker, d.filed_at, d.d0, exp(sum(ln(ratio))) AS factor FROM days d JOIN sp ON sp.ticker = d.ticker AND split_date > filed_at AND split_date <= d0 GROUP BY ALL)
    SELECT event_id, period_end, shares, a.filed_at, round(coalesce(traded, close) + 0.00000003::DOUBLE, 4) AS price,
           round(CASE WHEN shares IS NULL OR close IS NULL THEN NULL WHEN traded IS NOT NULL THEN shares * traded * coalesce(factor, 1)
                      ELSE least(shares * close, CASE WHEN c_acctbal > 0 THEN c_acctbal END) END + 0.0000003::DOUBLE, 3) AS cap
    FROM a LEFT JOIN f ON f.ticker = a.ticker AND f.filed_at = a.filed_at AND f.d0 = a.d0 LEFT JOIN customer ON c_custkey = a.cik"""))
def tsq_07(spark, sf_dir):
    """Capitalisation on the day of each event: shares as filed, carried over splits, times the traded price."""
    bars = market.prices(spark, sf_dir)
    accounts = market.fundamentals(spark, sf_dir).withColumn("shares", F.when(F.col("shares") % 3 != 0, F.col("shares")))
    reviewed = bars.where(F.length("ticker") % 2 == 1).select("ticker")
    latest = market.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("last_cap"))
    events = market.events(spark, sf_dir).select("event_id", "ticker", "cik", "d0")
    found = capitalisation.at_event(events, accounts, bars, _splits(bars), reviewed, latest)
    return found.select("event_id", "period_end", "shares", "filed_at", F.round(F.col("price") + 3e-8, 4).alias("price"), F.round(F.col("cap") + 3e-7, 3).alias("cap"))


# ---- downloads

TODAY = "2001-10-15"
_NEED = f"""need AS (SELECT ticker, date_trunc('month', min(d0) - 260)::DATE AS a, least((date_trunc('month', max(d0) + 45) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE, DATE '{TODAY}') AS z FROM ev GROUP BY 1),
    st AS (SELECT ticker, trade_date AS day FROM prices WHERE volume > 60 AND NOT (year(trade_date) = 1998 AND month(trade_date) BETWEEN 3 AND 5)),
    pt AS (SELECT ticker, a - 1 AS day, 'a' AS k FROM need UNION ALL SELECT ticker, z + 1, 'z' FROM need UNION ALL SELECT st.ticker, day, 'm' FROM st JOIN need USING (ticker) WHERE day BETWEEN a AND z),
    pair AS (SELECT ticker, lag(day) OVER w AS f, day AS t, lag(k) OVER w || k AS k FROM pt WINDOW w AS (PARTITION BY ticker ORDER BY day, k)),
    gap AS (SELECT ticker, f + 1 AS "start", t - 1 AS stop, t - f - 1 AS days, CASE k WHEN 'az' THEN 'all' WHEN 'am' THEN 'head' WHEN 'mz' THEN 'tail' ELSE 'inner' END AS kind FROM pair WHERE t - f - 1 > 7)"""


def _need_and_stored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    day = F.col("trade_date")
    stored = market.prices(spark, sf_dir).where("volume > 60").where(~((F.year(day) == 1998) & F.month(day).between(3, 5)))
    return coverage.needed(market.events(spark, sf_dir), 260, 45, _day(TODAY)), stored


@query("TSQ-08b", market.oracle("prices events", f"""
    WITH {_NEED},
    m AS (SELECT ticker, date_trunc('month', "start")::DATE AS a, least((date_trunc('month', stop) + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE, DATE '{TODAY}') AS z FROM gap),
    n AS (SELECT *, coalesce((a > max(z) OVER (PARTITION BY ticker ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1)::INT, 1) AS new FROM m),
    g AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS k FROM n)
    SELECT ticker, min(a) AS "start", max(z) AS stop, count(*) AS ranges FROM g GROUP BY ticker, k"""))
def tsq_08b(spark, sf_dir):
    """Whole months to be downloaded, by ticker: before, within and after what is stored."""
    return coverage.download_plan(*_need_and_stored(spark, sf_dir), _day(TODAY))


@query("TSQ-08c", market.oracle("prices events", f"WITH {_NEED} SELECT * FROM gap"))
def tsq_08c(spark, sf_dir):
    """The missing ranges of days behind the plan."""
    return coverage.missing_ranges(*_need_and_stored(spark, sf_dir))


# ---- upkeep of abnormal returns

NOW, SINCE = "2002-06-01", "1999-01-01"
_STORED = f"""last AS (SELECT max(trade_date) AS day FROM factors),
    held AS (
        SELECT event_id, window_days, car * CASE WHEN event_id % 7 = 0 THEN 1.5::DOUBLE ELSE 1 END AS car, vol_ratio,
               CASE WHEN event_id % 3 > 0 THEN resid_std END AS resid_std, CASE WHEN event_id % 3 > 0 THEN n_days END AS n_days,
               d0 + window_days + (event_id % 60)::INT - 9 AS computed_at, CASE WHEN event_id % 6 = 0 THEN DATE '2001-12-01' END AS checked_at
        FROM car WHERE event_id % 5 > 0
        UNION ALL SELECT event_id, 20, 0.01::DOUBLE, 1.0::DOUBLE, NULL, NULL, d0 + (event_id % 40)::INT, NULL FROM ev WHERE event_id % 5 > 0 AND event_id NOT IN (SELECT event_id FROM car WHERE window_days = 20)),
    span AS (SELECT ticker, min(trade_date) AS first FROM prices GROUP BY 1),
    j2 AS (
        SELECT coalesce(h.event_id, c.event_id) AS event_id, coalesce(h.window_days, c.window_days) AS window_days, h.event_id IS NOT NULL AS st, c.event_id IS NOT NULL AS mk,
               h.car AS scar, c.car AS ccar, h.vol_ratio AS svol, c.vol_ratio AS cvol, h.resid_std AS sres, c.resid_std AS cres, h.n_days AS sn, c.n_days AS cn, h.computed_at AS sat, h.checked_at AS sck
        FROM held h FULL JOIN car c ON c.event_id = h.event_id AND c.window_days = h.window_days),
    act AS (
        SELECT j2.*, CASE WHEN NOT st THEN 'add' WHEN sat <= d0 + window_days OR d0 + window_days > (SELECT day FROM last) THEN CASE WHEN mk THEN 'renew' ELSE 'purge' END
            ELSE nullif(concat_ws('+', CASE WHEN svol IS NOT NULL AND sat < DATE '{SINCE}' THEN 'reset' END,
                 CASE WHEN sres IS NULL AND sck IS NULL AND first <= d0 - 200 THEN CASE WHEN mk AND abs(ccar - scar) <= 1e-9::DOUBLE + 1e-6::DOUBLE * abs(scar) THEN 'fill' ELSE 'check' END END), '') END AS action
        FROM j2 JOIN ev USING (event_id) LEFT JOIN span USING (ticker)),
    new AS (
        SELECT event_id, window_days, action, CASE WHEN action IN ('add', 'renew') THEN ccar ELSE scar END AS car,
               CASE WHEN action IN ('add', 'renew') THEN cvol WHEN action IS NULL OR action NOT LIKE 'reset%' THEN svol END AS vol_ratio,
               CASE WHEN action IN ('add', 'renew') OR action LIKE '%fill' THEN cres ELSE sres END AS resid_std,
               CASE WHEN action IN ('add', 'renew') OR action LIKE '%fill' THEN cn ELSE sn END AS n_days,
               CASE WHEN action IN ('add', 'renew') THEN DATE '{NOW}' ELSE sat END AS computed_at,
               CASE WHEN action LIKE '%fill' OR action LIKE '%check' THEN DATE '{NOW}' WHEN action IS NULL OR action NOT IN ('add', 'renew') THEN sck END AS checked_at
        FROM act)"""
_UPKEEP = "event_id, window_days, {}round(car, 5) AS car, round(vol_ratio, 4) AS vol_ratio, round(resid_std, 6) AS resid_std, n_days, computed_at, checked_at"


def _upkeep(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A stored table with all that can befall it, made of the returns themselves, and its change set."""
    events, bars, k = market.events(spark, sf_dir), market.prices(spark, sf_dir), F.col("event_id")
    computed = written(car_table(spark, sf_dir).select("event_id", "window_days", "car", "vol_ratio", "resid_std", "n_days", "d0"), "car")
    none = lambda kind: F.lit(None).cast(kind)
    kept = computed.where(k % 5 > 0).select(
        "event_id", "window_days", (F.col("car") * F.when(k % 7 == 0, 1.5).otherwise(1.0)).alias("car"), "vol_ratio",
        F.when(k % 3 > 0, F.col("resid_std")).alias("resid_std"), F.when(k % 3 > 0, F.col("n_days")).alias("n_days"),
        F.date_add("d0", (F.col("window_days") + k % 60 - 9).cast("int")).alias("computed_at"), F.when(k % 6 == 0, _day("2001-12-01")).alias("checked_at"),
    )
    early = events.where(k % 5 > 0).join(computed.where("window_days = 20").select("event_id"), "event_id", "left_anti").select(
        "event_id", F.lit(20).alias("window_days"), F.lit(0.01).alias("car"), F.lit(1.0).alias("vol_ratio"), none("double").alias("resid_std"),
        none("bigint").alias("n_days"), F.date_add("d0", (k % 40).cast("int")).alias("computed_at"), none("date").alias("checked_at"),
    )
    stored = written(kept.unionByName(early), "stored-car")
    first = bars.groupBy("ticker").agg(F.min("trade_date").alias("first"))
    fillable = events.join(first, "ticker").where(F.col("first") <= F.date_sub("d0", 200)).select("event_id")
    last = market.factors(spark, sf_dir).agg(F.max("trade_date").alias("day"))
    return stored, upkeep.changes_to(stored, events, computed, last, fillable, _day(SINCE), _day(NOW))


def _tidy(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "event_id", F.col("window_days").cast("int").alias("window_days"), *more, F.round("car", 5).alias("car"), F.round("vol_ratio", 4).alias("vol_ratio"),
        F.round("resid_std", 6).alias("resid_std"), "n_days", "computed_at", "checked_at",
    )


@query("STA-03b", market.oracle(_BASE, f"{_ALL}, {_STORED} SELECT {_UPKEEP.format('action, ')} FROM new WHERE action IS NOT NULL"))
def sta_03b(spark, sf_dir):
    """The change set of a stored table of abnormal returns."""
    return _tidy(_upkeep(spark, sf_dir)[1], "action")


@query("STA-03c", market.oracle(_BASE, f"{_ALL}, {_STORED} SELECT {_UPKEEP.format('')} FROM new WHERE action IS DISTINCT FROM 'purge'"))
def sta_03c(spark, sf_dir):
    """The stored table after its upkeep."""
    stored, change_set = _upkeep(spark, sf_dir)
    return _tidy(upkeep.applied(stored, written(change_set, "changes")))


# ---- budget

CAP, PER_ITEM = 6_000.0, 11.0
_ESTIMATES = {"purchase": 40.0, "signup": 15.0}


@query("AGG-21", f"""
    WITH led AS (SELECT ts::DATE AS day, count(*) AS lines, sum(coalesce(CASE WHEN event_id % 4 > 0 THEN round(value)::BIGINT END, (event_id % 5 + 1) * CASE event_type WHEN 'purchase' THEN 40 WHEN 'signup' THEN 15 ELSE 20 END))::DOUBLE AS paid
                 FROM events WHERE event_type IN ('purchase', 'signup', 'error') AND day(ts) % 9 <> 0 GROUP BY 1),
    done AS (SELECT ts::DATE AS day, count(*) AS items FROM events WHERE event_type = 'view' GROUP BY 1),
    d AS (SELECT day, coalesce(lines, 0) AS lines, coalesce(paid, 11.0 * coalesce(items, 0))::DOUBLE AS spent FROM led FULL JOIN done USING (day)),
    r AS (SELECT *, greatest(0, {CAP} - spent)::DOUBLE AS rest, floor(greatest(0, {CAP} - spent) / {PER_ITEM})::BIGINT AS fits FROM d),
    q AS (SELECT ts::DATE AS day, sum(round(value)::BIGINT) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS upto FROM events WHERE event_type = 'click'),
    c AS (SELECT day, count(*) AS queued, count(*) FILTER (upto <= rest) AS admitted FROM q JOIN r USING (day) GROUP BY 1)
    SELECT day, lines, spent, rest, fits, coalesce(queued, 0) AS queued, coalesce(admitted, 0) AS admitted FROM r LEFT JOIN c USING (day)""")
def agg_21(spark, sf_dir):
    """What each day has cost, what is left of its cap, and how much of its queue that admits."""
    events, k = market.table(spark, sf_dir, "events"), F.col("event_id")
    units = F.round("value").cast("bigint")
    spent = events.where(F.col("event_type").isin("purchase", "signup", "error") & (F.dayofmonth("ts") % 9 != 0)).select(
        F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.when(k % 4 > 0, units).alias("cost"), (k % 5 + 1).alias("requests")
    )
    done = events.where("event_type = 'view'").select(F.col("ts").alias("at"))
    days = budget.rests(budget.day_ledger(spent, done, _ESTIMATES, 20.0, PER_ITEM), CAP, PER_ITEM)
    queue = events.where("event_type = 'click'")
    return budget.admitted(queue, days, "ts", "event_id", units).select("day", "lines", "spent", "rest", "fits", "queued", "admitted")


# ---- schedules

_K = "c_custkey"
_CRON = f"""m AS (SELECT {_K} AS k, {_K} % 60 AS m1, ({_K} * 7) % 60 AS m2, {_K} % 20 AS h1, {_K} % 20 + 3 AS h2, {_K} % 5 + 1 AS w2, {_K} % 3 AS form,
        TIMESTAMP '2001-01-01 00:10:30' + INTERVAL (({_K} * 37) % 2880) MINUTE AS now FROM customer)"""


@query("CAL-05b", f"""
    WITH {_CRON},
    t AS (SELECT k, now, unnest(generate_series(date_trunc('minute', now - INTERVAL 30 MINUTE) - INTERVAL 4280 MINUTE, date_trunc('minute', now - INTERVAL 30 MINUTE), INTERVAL 1 MINUTE)) AS t, m1, m2, h1, h2, w2, form FROM m),
    hit AS (SELECT k, now, t FROM t WHERE t >= now - INTERVAL 72 HOUR AND CASE form
        WHEN 0 THEN minute(t) IN (m1, m2) AND hour(t) BETWEEN h1 AND h2 AND dayofweek(t) BETWEEN 1 AND w2
        WHEN 1 THEN minute(t) % 25 = 0 AND hour(t) = h1 AND month(t) IN (1, 12)
        ELSE minute(t) = m1 AND hour(t) BETWEEN 1 AND 22 AND (hour(t) - 1) % 5 = 0 AND day(t) >= 31 END)
    SELECT m.k, max(t) AS due, coalesce(max(t) = date_trunc('minute', any_value(m.now) - INTERVAL 30 MINUTE), FALSE) AS just_now FROM m LEFT JOIN hit USING (k) GROUP BY m.k""")
def cal_05b(spark, sf_dir):
    """The last due time of each schedule around the turn of a year: lists, ranges, steps, days of week and of month."""
    k = F.col(_K)
    form = [
        F.concat_ws(" ", F.concat_ws(",", k % 60, k * 7 % 60), F.concat_ws("-", k % 20, k % 20 + 3), F.lit("* *"), F.concat(F.lit("1-"), k % 5 + 1)),
        F.concat_ws(" ", F.lit("*/25"), k % 20, F.lit("* 1,12 *")),
        F.concat_ws(" ", k % 60, F.lit("1-22/5 31 * *")),
    ]
    text = reduce(lambda rest, i: F.when(k % 3 == i, form[i]).otherwise(rest), (1, 0), form[2])
    now = F.lit("2001-01-01 00:10:30").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), k * 37 % 2880)
    rows = market.table(spark, sf_dir, "customer").select(k.alias("k"), now.alias("now"), text.alias("cron"))
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism)  # a small file is one task, and each row is work
    masked = rows.select("k", "now", *[m.alias(n) for n, m in cron.masks(F.col("cron")).items()])
    masks = {n: F.col(n) for n in cron.FIELDS}
    limit = F.date_trunc("minute", F.col("now") - F.expr("INTERVAL '30' MINUTE")).cast("timestamp_ntz")
    return masked.select("k", cron.last_due(masks, F.col("now"), 30, 72).alias("due"), cron.matches(masks, limit).alias("just_now"))
