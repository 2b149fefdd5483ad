"""Independent trades from events and bars, and the metrics over trades and balances."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .event_study import first_per_event_day
from .joins import as_of, between_days


def entries(events: DataFrame, bars: DataFrame, side: Column) -> DataFrame:
    """Each event with ``entry_date`` and ``entry`` (the open of the first bar after d0) and ``side`` (1 or -1)."""
    found = as_of(events, bars, ["ticker"], "d0", "trade_date", ["open"], forward=True, strict=True)
    return found.where("match.open is not null").select(
        *events.columns, F.col("match.trade_date").alias("entry_date"), F.col("match.open").alias("entry"), side.alias("side")
    )


def filled(open_: Column, level: Column, favourable_side: Column) -> Column:
    """A level's fill: the open if the bar opened beyond it."""
    return F.when(open_.isNull(), level).when(favourable_side, F.greatest(open_, level)).otherwise(F.least(open_, level))


def stop_or_take(
    entered: DataFrame, bars: DataFrame, stop: float, take: float, days: int, until: Column | None = None
) -> DataFrame:
    """``exit_date``, ``exit`` and ``reason`` of each trade: on each bar the stop comes first, then the take
    level; else the close of the last bar within ``days`` (and no later than the day ``until``, an expression on ``entry_date``).

    Trades do not touch one another, so the walk over bars becomes a range join and
    two aggregates: the first bar that hits a level, and the last bar. Trades entered on
    one bar and side end alike, so they are walked once however many they are.
    """
    long = F.col("side") > 0
    asked = entered.select("ticker", "entry_date", "entry", "side").distinct()
    near = between_days(asked, bars, "ticker", "entry_date", "trade_date", 0, days)
    if until is not None:
        near = near.where(F.col("trade_date") <= until)
    low_level = F.col("entry") * F.when(long, 1 - stop).otherwise(1 - take)
    high_level = F.col("entry") * F.when(long, 1 + take).otherwise(1 + stop)
    low_hit, high_hit = F.col("low") <= low_level, F.col("high") >= high_level
    stopped = F.when(long, low_hit).otherwise(high_hit)
    reason = F.when(stopped, "STOP").when(F.when(long, high_hit).otherwise(low_hit), "TAKE")
    level = F.when(long == stopped, low_level).otherwise(high_level)
    fill = filled(F.col("open"), level, long != stopped)
    marked = near.where("high is not null and low is not null and close is not null").withColumn("_reason", reason).withColumn("_fill", fill)
    out = marked.groupBy("ticker", "entry_date", "side").agg(
        F.min(F.when(F.col("_reason").isNotNull(), F.struct("trade_date", "_fill", "_reason"))).alias("_hit"),
        F.max(F.struct("trade_date", "close")).alias("_last"),
    )
    return entered.join(out, ["ticker", "entry_date", "side"]).select(
        *entered.columns,
        F.coalesce("_hit.trade_date", "_last.trade_date").alias("exit_date"),
        F.coalesce("_hit._fill", "_last.close").alias("exit"),
        F.coalesce("_hit._reason", F.lit("TIME")).alias("reason"),
    )


def stop_or_tiers(
    entered: DataFrame, bars: DataFrame, stop: float, tiers: tuple[tuple[float, float], ...], days: int, parts: bool = False
) -> DataFrame:
    """Each trade with its exit in parts: ``exit_date`` (of the last part), ``exit`` (mean by share), ``reason`` of the last
    part and ``tiers`` (how many were reached).

    ``tiers`` holds (gain in percent, share of the position that is closed there), ascending, shares adding up to 1. On each bar the stop comes
    first and closes all that is left, then every tier that the bar reaches; the rest goes at the last close within
    ``days``. A higher tier is never reached before a lower one, so each tier counts if its first bar is
    before the first bar of the stop: one range join and one aggregate, no walk over bars.

    With ``parts`` each closed part is a row instead: ``close_date``, ``fraction`` and ``price``.
    """
    long = F.col("side") > 0
    asked = entered.select("ticker", "entry_date", "entry", "side").distinct()
    near = between_days(asked, bars, "ticker", "entry_date", "trade_date", 0, days).where("high is not null and low is not null and close is not null")
    stop_at = F.col("entry") * F.when(long, 1 - stop).otherwise(1 + stop)
    stopped = F.when(long, F.col("low") <= stop_at).otherwise(F.col("high") >= stop_at)
    first = lambda hit, fill: F.min(F.when(hit, F.struct("trade_date", fill.alias("fill"))))
    reached = []
    for k, (gain, _) in enumerate(tiers):
        level = F.col("entry") * F.when(long, 1 + gain / 100).otherwise(1 - gain / 100)
        hit = F.when(long, F.col("high") >= level).otherwise(F.col("low") <= level)
        reached.append(first(hit, filled(F.col("open"), level, long)).alias(f"_t{k}"))
    out = near.groupBy("ticker", "entry_date", "side").agg(
        first(stopped, filled(F.col("open"), stop_at, ~long)).alias("_stop"), F.max(F.struct("trade_date", F.col("close").alias("fill"))).alias("_last"), *reached
    )
    counts = [F.col(f"_t{k}.trade_date").isNotNull() & (F.col("_stop").isNull() | (F.col(f"_t{k}.trade_date") < F.col("_stop.trade_date"))) for k in range(len(tiers))]
    summed = lambda parts: reduce(add, parts, F.lit(0.0))
    n = reduce(add, [c.cast("int") for c in counts], F.lit(0))
    if parts:
        return _parts(entered, out, counts, tiers)
    left = summed([F.when(c, 0.0).otherwise(share) for c, (_, share) in zip(counts, tiers, strict=True)])
    closed = summed([F.when(c, share * F.col(f"_t{k}.fill")).otherwise(0.0) for k, (c, (_, share)) in enumerate(zip(counts, tiers, strict=True))])
    rest, all_closed = F.coalesce("_stop", "_last"), n == len(tiers)
    done = out.select(
        "ticker", "entry_date", "side",
        F.when(all_closed, F.col(f"_t{len(tiers) - 1}.trade_date")).otherwise(rest["trade_date"]).alias("exit_date"),
        (closed + F.when(all_closed, 0.0).otherwise(left * rest["fill"])).alias("exit"),
        F.when(all_closed, "TIERS").when(F.col("_stop").isNotNull(), "STOP").otherwise("TIME").alias("reason"),
        n.alias("tiers"),
    )
    return entered.join(done, ["ticker", "entry_date", "side"])


def _parts(entered: DataFrame, out: DataFrame, reached: list[Column], tiers: tuple[tuple[float, float], ...]) -> DataFrame:
    rest, part = F.coalesce("_stop", "_last"), lambda x, share: F.struct(x["trade_date"].alias("close_date"), share.alias("fraction"), x["fill"].alias("price"))
    left = reduce(add, [F.when(c, 0.0).otherwise(share) for c, (_, share) in zip(reached, tiers, strict=True)], F.lit(0.0))
    each = [F.when(c, part(F.col(f"_t{k}"), F.lit(share))) for k, (c, (_, share)) in enumerate(zip(reached, tiers, strict=True))]
    rows = out.select("ticker", "entry_date", "side", F.explode(F.array_compact(F.array(*each, F.when(left > 1e-9, part(rest, left))))).alias("_p"))
    return entered.join(rows.select("ticker", "entry_date", "side", "_p.*"), ["ticker", "entry_date", "side"])


def with_result(trades: DataFrame, cost_pct: float) -> DataFrame:
    return trades.withColumn("pnl_pct", F.col("side") * (F.col("exit") / F.col("entry") - 1) * 100 - cost_pct)


def trade_metrics(trades: DataFrame, by: list[str]) -> DataFrame:
    """Counts, win rate, profit factor, means and extremes of ``pnl_pct``; a result of 0 is a loss."""
    p = F.col("pnl_pct")
    win, loss = F.when(p > 0, p), F.when(p <= 0, p)
    return trades.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(win).alias("wins"),
        F.count(loss).alias("losses"),
        (F.count(win) / F.count("*")).alias("win_rate"),
        F.try_divide(F.sum(win), F.nullif(F.abs(F.sum(loss)), F.lit(0.0))).alias("profit_factor"),
        F.avg(win).alias("mean_win"),
        F.avg(loss).alias("mean_loss"),
        F.avg(p).alias("expectancy"),
        F.max(p).alias("best"),
        F.min(p).alias("worst"),
    )


def sharpe_per_trade(trades: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """``sharpe_per_trade``: mean over spread of ``pnl_pct``, not annualised; null, and ``insufficient``, under ``least`` trades."""
    ratio = F.try_divide(F.avg("pnl_pct"), F.nullif(F.stddev_samp("pnl_pct"), F.lit(0.0)))
    few = F.count("*") < least
    return trades.groupBy(*by).agg(F.when(~few, ratio).alias("sharpe_per_trade"), few.alias("insufficient"))


def temporal_stability(trades: DataFrame, split: Column, least: int = 10, most_pp: float = 15.0) -> DataFrame:
    """One row: counts, win rates and expectancies of trades entered before ``split`` and from it on, and ``stable``.

    Not stable if win rates differ by more than ``most_pp`` points or the expectancy changes its sign; null (nothing can
    be said) if a side has fewer than ``least`` trades.
    """
    p, early = F.col("pnl_pct"), F.col("entry_date") < split
    sides = {"before": early, "after": ~early}
    sums = trades.agg(
        *[F.count_if(c).alias(f"n_{s}") for s, c in sides.items()],
        *[F.avg(F.when(c, (p > 0).cast("double"))).alias(f"win_rate_{s}") for s, c in sides.items()],
        *[F.avg(F.when(c, p)).alias(f"expectancy_{s}") for s, c in sides.items()],
    )
    diff = F.abs(F.col("win_rate_before") - F.col("win_rate_after")) * 100
    flip = F.col("expectancy_before") * F.col("expectancy_after") < 0
    enough = F.least("n_before", "n_after") >= least
    return sums.withColumns({"win_rate_diff_pp": diff, "sign_flip": flip, "stable": F.when(enough, (diff <= most_pp) & ~flip)})


def longest_streaks(trades: DataFrame, by: list[str]) -> DataFrame:
    """Longest runs of wins and of losses by exit date (then id).

    Runs are found within each day; a day is then summed up by its first, last and
    longest runs, and days - one row each, however many trades - are joined in order.
    """
    cell = [*by, "exit_date"]
    w = Window.partitionBy(*cell).orderBy("event_id")
    same = Window.partitionBy(*cell, "_won").orderBy("event_id")
    islands = (
        trades.withColumn("_won", F.col("pnl_pct") > 0)
        .withColumn("_at", F.row_number().over(w))
        .withColumn("_island", F.col("_at") - F.row_number().over(same))
        .groupBy(*cell, "_won", "_island")
        .agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    )
    most = lambda won: F.coalesce(F.max(F.when(F.col("_won") == won, F.col("_n"))), F.lit(0))
    run = F.struct("_won", "_n")
    days = islands.groupBy(*cell).agg(
        F.min_by(run, "_from").alias("first"), F.max_by(run, "_from").alias("last"), F.count("*").alias("runs"),
        most(True).alias("wins"), most(False).alias("losses"),
    )
    start = F.struct(F.lit(True).alias("won"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("wins"), F.lit(0).cast("bigint").alias("losses"))

    def follow(now: Column, day: Column) -> Column:
        first = day["first"]["_n"] + F.when(day["first"]["_won"] == now["won"], now["n"]).otherwise(0)
        end = F.when(day["runs"] == 1, first).otherwise(day["last"]["_n"])
        best = lambda won, k: F.greatest(now[k], day[k], F.when(day["first"]["_won"] == won, first).otherwise(0))
        return F.struct(day["last"]["_won"].alias("won"), end.alias("n"), best(True, "wins").alias("wins"), best(False, "losses").alias("losses"))

    ordered = F.array_sort(F.collect_list(F.struct("exit_date", "first", "last", "runs", "wins", "losses")))
    done = days.groupBy(*by).agg(F.aggregate(ordered, start, follow).alias("s"))
    return done.select(*by, F.col("s.wins").alias("longest_wins"), F.col("s.losses").alias("longest_losses"))


def equity_metrics(curve: DataFrame, by: list[str], date: str, balance: str, least_days: int = 30, rf: str | None = None) -> DataFrame:
    """Returns, drawdown and risk ratios of one balance series per key; the first balance is the capital.

    The column ``rf`` (null: 0), if named, is the day's risk-free return, taken off before the ratios of Sharpe and Sortino.
    """
    w = Window.partitionBy(*by).orderBy(date)
    b, before = F.col(balance), F.lag(balance).over(w)
    peak = F.max(balance).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = curve.withColumns({
        "_ret": F.when(before > 0, (b - before) / before) - (F.coalesce(F.col(rf), F.lit(0.0)) if rf else F.lit(0.0)),
        "_dd": F.when(peak > 0, (b - peak) / peak),
    })
    down = F.when(F.col("_ret") < 0, F.col("_ret"))
    sums = rows.groupBy(*by).agg(
        F.min_by(balance, date).alias("_first"),
        F.max_by(balance, date).alias("final_balance"),
        F.greatest(F.date_diff(F.max(date), F.min(date)), F.lit(1)).alias("_days"),
        F.abs(F.least(F.min("_dd"), F.lit(0.0))).alias("max_drawdown"),
        F.count("_ret").alias("_n"),
        F.avg("_ret").alias("_mean"),
        F.stddev_samp("_ret").alias("_std"),
        F.count(down).alias("_n_down"),
        F.stddev_samp(down).alias("_std_down"),
        F.min(down).alias("_only_down"),
    )
    total = F.col("final_balance") / F.col("_first") - 1
    annual = F.when(F.col("_days") >= least_days, total / (F.col("_days") / 365.25))
    ratio = lambda spread: F.try_divide(F.col("_mean"), F.nullif(spread, F.lit(0.0))) * F.sqrt(F.lit(252.0))
    sortino = F.when(F.col("_n_down") >= 2, ratio(F.col("_std_down"))).when(F.col("_n_down") == 1, ratio(F.abs("_only_down")))
    drawn = F.nullif(F.col("max_drawdown"), F.lit(0.0))
    return sums.select(
        *by,
        total.alias("total_return"),
        annual.alias("annual_return"),
        "max_drawdown",
        F.when(F.col("_n") >= 2, ratio(F.col("_std"))).alias("sharpe"),
        F.when(F.col("_n") >= 2, sortino).alias("sortino"),
        F.try_divide(annual, drawn).alias("calmar"),
        F.try_divide(total, drawn).alias("recovery"),
        "final_balance",
    )


def confidence_buckets(trades: DataFrame, edges: tuple[int, ...] = (50, 60, 70, 80, 90, 100)) -> DataFrame:
    """Hit rate and mean confidence per band; bands hold their lower edge, the last one both."""
    c = F.col("confidence")
    bucket = F.least(F.width_bucket(c, F.lit(float(edges[0])), F.lit(float(edges[-1])), F.lit(len(edges) - 1)), F.lit(len(edges) - 1))
    inside = trades.where(c.between(edges[0], edges[-1])).withColumn("bucket", bucket.cast("int"))
    return inside.groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg((F.col("pnl_pct") > 0).cast("double")).alias("hit_rate"), F.avg(c).alias("mean_confidence")
    )


def calibration(trades: DataFrame, edges: tuple[int, ...] = (50, 60, 70, 80, 90, 100)) -> DataFrame:
    """One row: correlation of confidence and outcome, Brier score and expected calibration error."""
    hit = (F.col("pnl_pct") > 0).cast("double")
    c = F.col("confidence").cast("double")
    whole = trades.agg(F.count("*").alias("n"), F.corr(c, hit).alias("correlation"), F.avg((c / 100 - hit) ** 2).alias("brier"))
    gap = F.abs(F.col("hit_rate") - F.col("mean_confidence") / 100)
    bands = confidence_buckets(trades, edges).agg(F.sum(F.col("n") * gap).alias("gap"))
    enough = lambda x: F.when(F.col("n") >= 2, x)
    return whole.crossJoin(bands).select(
        "n", enough(F.col("correlation")).alias("correlation"), enough(F.col("brier")).alias("brier"), enough(F.col("gap") / F.col("n")).alias("ece")
    )


def impact_estimates(car: DataFrame, window_days: int = 20, shrink: float = 15.0, priors: DataFrame | None = None) -> DataFrame:
    """Per event with a window of ``window_days``, what earlier events of its class moved whose outcome was already known.

    A cohort is all events of the class with d0 + window before the event's d0. Its
    sums come from one window over days per class, so no pair of events is made. Events of
    one ticker and day are one analogue. The mean of the analogues is shrunk towards the class prior: that of
    ``priors(event_class, prior)`` where it has one, else the mean of the class's analogues known by then, or 0 where
    there are none. ``volatility`` is how far their mean ratio of spreads is over 1, from 0 to 100.
    ``car(event_id, event_class, ticker, d0, window_days, car_pct, vol_ratio)``.
    """
    x = F.col("car_pct")
    day, car = F.unix_date("d0"), car.where(F.col("window_days") == window_days)
    over = lambda k: F.sum((F.abs(x) >= k).cast("int"))
    analogues = first_per_event_day(car.select("event_id", "event_class", "ticker", "d0", "window_days", "car_pct", "vol_ratio"))
    daily = analogues.groupBy("event_class", "window_days", "d0").agg(
        F.count("*").alias("k"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum("vol_ratio").alias("sv"), F.count("vol_ratio").alias("kv"), *[over(k).alias(f"over_{k}") for k in (5, 10, 20)]
    )
    known = Window.partitionBy("event_class", "window_days").orderBy(day).rangeBetween(Window.unboundedPreceding, -window_days - 1)
    run = lambda c: F.coalesce(F.sum(c).over(known), F.lit(0))
    cohort = daily.select("event_class", "window_days", "d0", run("k").alias("n"), run("sx").alias("sx"), run("sxx").alias("sxx"), run("sv").alias("sv"), run("kv").alias("kv"), *[run(f"over_{k}").alias(f"over_{k}") for k in (5, 10, 20)])
    n = F.col("n")
    mean = F.try_divide(F.col("sx"), n)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("sxx") - n * mean * mean, F.nullif(n - 1, F.lit(0)))))
    given = F.lit(None).cast("double")
    if priors is not None:
        cohort, given = cohort.join(priors.select("event_class", "prior"), "event_class", "left"), F.col("prior")
    prior, weight = F.coalesce(given, mean, F.lit(0.0)), n / (n + shrink)
    magnitude = weight * F.coalesce(mean, F.lit(0.0)) + (1 - weight) * prior
    wild = F.coalesce(F.try_divide(F.col("sv"), F.nullif(F.col("kv"), F.lit(0))), F.lit(1.0))
    steady = F.least(n / 50.0, F.lit(1.0)) * 70 + 30 - F.least(F.coalesce(spread, F.lit(0.0)) / 10, F.lit(1.0)) * 30
    confidence = F.when(n < 5, F.least(F.lit(15.0), n * 3.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), steady)))
    estimated = cohort.select(
        "event_class", "window_days", "d0", n.alias("n_analogues"), magnitude.alias("magnitude"),
        F.when(F.abs(magnitude) < 0.1, 0.0).otherwise(F.signum(magnitude)).alias("direction"),
        *[F.coalesce(F.try_divide(F.col(f"over_{k}") * 100.0, n), F.lit(0.0)).alias(f"p_{k}") for k in (5, 10, 20)],
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), (wild - 1) * 50)).alias("volatility"),
        confidence.alias("confidence"),
    )
    return car.select("event_id", "event_class", "window_days", "d0").join(estimated, ["event_class", "window_days", "d0"])


def rebuilt_drawdown(trades: DataFrame, by: list[str], size: float, capital: float) -> DataFrame:
    """``drawdown``: the largest fall below its peak, as a share, of the balance that results of ``size`` a trade, booked by exit day, make of
    ``capital``. A row per day goes through the window, however many trades."""
    days = trades.groupBy(*by, "exit_date").agg((F.sum("pnl_pct") * size / 100).alias("_won"))
    w = Window.partitionBy(*by).orderBy("exit_date").rowsBetween(Window.unboundedPreceding, 0)
    held = days.withColumn("_balance", F.lit(capital) + F.sum("_won").over(w))
    peaks = held.withColumn("_peak", F.greatest(F.lit(capital), F.max("_balance").over(w)))
    return peaks.groupBy(*by).agg(F.max(1 - F.col("_balance") / F.col("_peak")).alias("drawdown"))


def stable_over_time(trades: DataFrame, by: list[str], split: Column, least: int = 10, most_pp: float = 15.0) -> DataFrame:
    """``by`` and ``stable``, as in ``temporal_stability``, for each group."""
    p, early = F.col("pnl_pct"), F.col("entry_date") < split
    rate = lambda c: F.avg(F.when(c, (p > 0).cast("double")))
    sums = trades.groupBy(*by).agg(
        F.count_if(early).alias("_a"), F.count_if(~early).alias("_b"), (F.abs(rate(early) - rate(~early)) * 100).alias("_diff"),
        (F.avg(F.when(early, p)) * F.avg(F.when(~early, p))).alias("_sign"),
    )
    return sums.select(*by, F.when(F.least("_a", "_b") >= least, (F.col("_diff") <= most_pp) & (F.col("_sign") >= 0)).alias("stable"))


def look_ahead_messages(records: DataFrame) -> DataFrame:
    """``event_id`` and ``message`` of each breach in ``records(event_id, d0, entry_date, exit_date)``: entered on d0 or before, or left before entered."""
    entered = F.when(F.col("entry_date") <= F.col("d0"), F.format_string("event %s: entry %s is not after %s", "event_id", F.col("entry_date").cast("string"), F.col("d0").cast("string")))
    left = F.when(F.col("exit_date") < F.col("entry_date"), F.format_string("event %s: exit %s is before entry %s", "event_id", F.col("exit_date").cast("string"), F.col("entry_date").cast("string")))
    return records.select("event_id", F.explode(F.array_compact(F.array(entered, left))).alias("message"))


#: An alert on losses in a row from so many on, and on a prediction of so many percent that was right within so many.
LOSSES_IN_A_ROW, LARGE_PREDICTION, CLOSE_CALL = 2, 1.0, 0.3


def alerts(trades: DataFrame, predictions: DataFrame, by: str) -> DataFrame:
    """``by``, ``kind``, ``event_id`` and ``value`` of what is worth a look.

    ``losses``: a group whose longest run of losses in ``trades`` is LOSSES_IN_A_ROW or more (its length). ``hit``: a large prediction in
    ``predictions(event_id, predicted, actual)`` that came close (its error); unknown moves give none.
    """
    runs = longest_streaks(trades, [by]).where(F.col("longest_losses") >= LOSSES_IN_A_ROW)
    losses = runs.select(by, F.lit("losses").alias("kind"), F.lit(None).cast("bigint").alias("event_id"), F.col("longest_losses").cast("double").alias("value"))
    error = F.abs(F.col("predicted") - F.col("actual"))
    hits = predictions.where((F.abs("predicted") >= LARGE_PREDICTION) & (error <= CLOSE_CALL))
    return losses.union(hits.select(by, F.lit("hit").alias("kind"), F.col("event_id").cast("bigint"), error.alias("value")))


def error_ranking(predictions: DataFrame, by: str, most: int) -> DataFrame:
    """The ``most`` best and worst predictions of each group by error: ``by, end, place, event_id, error``. Ties stand by id; unknown moves do not count.

    A group's first and last ``most`` are kept by row numbers, which Spark cuts off in each task before the shuffle.
    """
    known = predictions.select(by, "event_id", F.abs(F.col("predicted") - F.col("actual")).alias("error")).where("error is not null")
    ends = {"best": F.col("error").asc(), "worst": F.col("error").desc()}
    ranked = [
        known.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order, "event_id"))).where(F.col("place") <= most).select(by, F.lit(end).alias("end"), "place", "event_id", "error")
        for end, order in ends.items()
    ]
    return ranked[0].union(ranked[1])


def against_history(now: DataFrame, before: DataFrame, by: str, most_pp: float = 30.0, least: int = 1) -> DataFrame:
    """Win rates of ``now`` beside those of ``before``, their difference in points, and whether it is ``most_pp`` or less; null under ``least`` trades on a side."""
    rate = lambda df, name: df.groupBy(by).agg(F.count("*").alias(f"n_{name}"), F.avg((F.col("pnl_pct") > 0).cast("double")).alias(f"rate_{name}"))
    both = rate(now, "now").join(rate(before, "before"), by, "full")
    diff = F.abs(F.col("rate_now") - F.col("rate_before")) * 100
    enough = F.least(F.coalesce("n_now", F.lit(0)), F.coalesce("n_before", F.lit(0))) >= least
    return both.withColumns({"diff_pp": diff, "matches": F.when(enough, diff <= most_pp)})


#: What a group of trades has to reach before money is put on it.
SHARPE_TARGET, DRAWDOWN_CEILING, CALIBRATION_TARGET, LEAST_TRADES = 1.0, 0.25, 0.6, 20


def recommendation(reports: DataFrame, by: str) -> DataFrame:
    """``by``, ``finding`` and ``passes`` for each row of ``reports(n, sharpe, drawdown, calibration, peeked)``, and ``any_passes`` over all.

    A look-ahead or too few trades say so and nothing else; unknown figures do not pass.
    """
    marks = {"sharpe": F.col("sharpe") > SHARPE_TARGET, "drawdown": F.col("drawdown") < DRAWDOWN_CEILING, "calibration": F.col("calibration") > CALIBRATION_TARGET}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit(f"{n} "), F.when(F.col(n).isNotNull(), F.format_string("%.2f", n)).otherwise("unknown"))) for n, ok in marks.items()]))
    finding = (
        F.when(F.col("peeked") > 0, F.format_string("%d trades look ahead", "peeked"))
        .when(F.col("n") < LEAST_TRADES, F.format_string("only %d trades", "n"))
        .when(F.size(failed) == 0, "passes")
        .otherwise(F.concat(F.lit("fails: "), F.array_join(failed, ", ")))
    )
    rows = reports.select(by, finding.alias("finding")).withColumn("passes", F.col("finding") == "passes")
    return rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.bool_or("passes"), F.lit(False)).alias("any_passes"))))  # one row


def consolidated(closes: DataFrame, hedge: DataFrame, cost_pct: float) -> DataFrame:
    """One record of each trade that was closed in parts, with both legs: ``event_id, exit_date, exit, hedge_exit, parts, pnl_pct``.

    ``closes(event_id, side, entry, entry_date, close_date, fraction, price)`` has a row per part. Exits are means of the parts' prices
    weighted by their fractions; the hedge's price of a part is its last close up to that day. A hedged trade (one with
    a hedge open on its entry day) pays ``cost_pct`` twice; parts before the hedge's first bar leave it unhedged.
    """
    opened = hedge.select(F.col("trade_date").alias("entry_date"), F.col("open").alias("hedge_entry"))
    series = hedge.select(F.lit(1).alias("_one"), F.col("trade_date").alias("_day"), "close")
    rows = as_of(closes.withColumn("_one", F.lit(1)).join(opened, "entry_date", "left"), series, ["_one"], "close_date", "_day", ["close"])
    part = F.when((F.col("match._day") >= F.col("entry_date")) & F.col("hedge_entry").isNotNull(), F.col("match.close"))
    weight = F.sum("fraction")
    sums = rows.withColumn("_hedge", part).groupBy("event_id").agg(
        F.max("close_date").alias("exit_date"), (F.sum(F.col("fraction") * F.col("price")) / weight).alias("exit"),
        F.when(F.count("_hedge") == F.count("*"), F.sum(F.col("fraction") * F.col("_hedge")) / weight).alias("hedge_exit"),
        F.count("*").alias("parts"), F.max("side").alias("_side"), F.max("entry").alias("_entry"), F.max("hedge_entry").alias("_hedge_entry"),
    )
    move = lambda a, b: F.col("_side") * (F.col(b) / F.col(a) - 1) * 100
    hedged = F.col("hedge_exit").isNotNull()
    pnl = move("_entry", "exit") - F.when(hedged, move("_hedge_entry", "hedge_exit") + cost_pct).otherwise(0.0) - cost_pct
    return sums.select("event_id", "exit_date", "exit", "hedge_exit", "parts", pnl.alias("pnl_pct"))


def marked_to_market(closes: DataFrame, bars: DataFrame, hedge: DataFrame, day: Column, size: float) -> DataFrame:
    """Value on ``day`` of ``size`` put into each trade entered by then: ``event_id``, ``open_share`` and ``value``, both legs.

    Parts closed by then are worth what they were closed at; the rest is worth the last closes up to the day. Without a hedge price after the entry the
    hedge is worth its entry. A trade without a bar is worth its entry.
    """
    by_day = closes.where(F.col("entry_date") <= day).withColumn("_day", day)
    at = F.least("close_date", "_day")
    opened = hedge.select(F.col("trade_date").alias("entry_date"), F.col("open").alias("hedge_entry"))
    series = hedge.select(F.lit(1).alias("_one"), F.col("trade_date").alias("_h"), F.col("close").alias("_hc"))
    rows = as_of(by_day.withColumns({"_one": F.lit(1), "_at": at}).join(opened, "entry_date", "left"), series, ["_one"], "_at", "_h", ["_hc"]).withColumnRenamed("match", "_hedge")
    rows = as_of(rows, bars.select("ticker", F.col("trade_date").alias("_b"), F.col("close").alias("_bc")), ["ticker"], "_at", "_b", ["_bc"])
    closed = F.col("close_date") <= F.col("_day")
    price = F.when(closed, F.col("price")).otherwise(F.when(F.col("match._b") >= F.col("entry_date"), F.col("match._bc")).otherwise(F.col("entry")))
    other = F.when(F.col("_hedge._h") >= F.col("entry_date"), F.col("_hedge._hc")).otherwise(F.col("hedge_entry"))
    gain = F.col("side") * (price / F.col("entry") - 1) - F.coalesce(F.col("side") * (other / F.col("hedge_entry") - 1), F.lit(0.0))
    return rows.groupBy("event_id").agg(
        F.sum(F.when(closed, 0.0).otherwise(F.col("fraction"))).alias("open_share"), F.sum(F.lit(size) * F.col("fraction") * (1 + gain)).alias("value")
    )
