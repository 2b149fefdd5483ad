"""How trades would have ended under other costs, a later entry, delistings, less confidence, or in calm and wild markets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_of
from .quantiles import exact_quantiles

#: The scenarios, in the order of reports.
NAMES = ("base", "commission", "spread", "latency", "delisting", "confidence", "high_index", "low_index")
#: Extra costs of a position in percent, loss of a share that is delisted, share of confidence taken off and its floor.
COMMISSION, SPREAD, LOSS, HAIRCUT, FLOOR = 0.1, 0.2, 0.3, 0.2, 40.0
#: Fewest trades with an index value for a split by its median, and days that such a value may be old.
LEAST_SPLIT, INDEX_DAYS = 4, 4


def move(side: Column, start: Column, end: Column) -> Column:
    return side * (F.try_divide(end, start) - 1) * 100


def two_legged(trades: DataFrame, hedge: DataFrame, is_hedged: Column, cost_pct: float) -> DataFrame:
    """``trades`` with ``hedge_entry``, ``hedge_exit``, ``legs``, ``gross_pct`` (both legs) and ``pnl_pct``, which pays costs for each leg.

    A trade that is to be hedged but finds no hedge price at its entry or up to its exit is left with one leg.
    ``hedge(trade_date, open, close)`` has a row per day.
    """
    opened = hedge.select(F.col("trade_date").alias("entry_date"), F.col("open").alias("_in"))
    series = hedge.select(F.lit(1).alias("_one"), F.col("trade_date").alias("_day"), "close")
    found = as_of(trades.withColumn("_one", F.lit(1)).join(opened, "entry_date", "left"), series, ["_one"], "exit_date", "_day", ["close"])
    both = is_hedged & (F.col("match._day") >= F.col("entry_date")) & F.col("_in").isNotNull()
    rows = found.withColumns({"hedge_entry": F.when(both, F.col("_in")), "hedge_exit": F.when(both, F.col("match.close"))}).drop("_one", "_in", "match")
    side, hedged = F.col("side"), F.col("hedge_entry").isNotNull()
    legs = F.when(hedged, 2).otherwise(1)
    gross = move(side, F.col("entry"), F.col("exit")) - F.when(hedged, move(side, F.col("hedge_entry"), F.col("hedge_exit"))).otherwise(0.0)
    return rows.withColumns({"legs": legs, "gross_pct": gross}).withColumn("pnl_pct", F.col("gross_pct") - F.col("legs") * cost_pct)


def in_scenarios(trades: DataFrame, bars: DataFrame, hedge: DataFrame, last_marks: DataFrame, index: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``scenario``, ``event_id``, ``pnl_pct`` and ``affected``: a row for each trade of ``two_legged`` and scenario that it is in.

    * ``commission``, ``spread``: COMMISSION or SPREAD more for each leg.
    * ``latency``: entered at the open of the second bar after d0 (the hedge on that day too), same exit and costs. Trades without
      such a bar or hedge price, or that left before it, are not in it.
    * ``delisting``: exits on a day in ``last_marks(ticker, trade_date)``, the last bars of series that end, at LOSS less.
    * ``confidence``: trades whose confidence less HAIRCUT is FLOOR or more.
    * ``high_index``, ``low_index``: by the last value of ``index(trade_date, close)`` up to d0, INDEX_DAYS old at most, at or over the exact
      median of the group's trades, or under it; none with fewer than LEAST_SPLIT such trades.

    Second bars and index values are found per ticker and day by as-of joins; the median comes from counts of values.
    """
    w = Window.partitionBy("ticker").orderBy("trade_date")
    ahead = bars.select("ticker", "trade_date", F.lit(1).alias("_there"), F.lead("trade_date").over(w).alias("_day2"), F.lead("open").over(w).alias("_open2"))
    rows = as_of(trades, ahead, ["ticker"], "d0", "trade_date", ["_there", "_day2", "_open2"], forward=True, strict=True)
    rows = rows.withColumns({"_day2": F.col("match._day2"), "_open2": F.col("match._open2")}).drop("match")
    rows = rows.join(hedge.select(F.col("trade_date").alias("_day2"), F.col("open").alias("_hedge2")), "_day2", "left")
    marks = last_marks.select("ticker", F.col("trade_date").alias("exit_date"), F.lit(True).alias("_gone")).distinct()
    rows = rows.join(marks, ["ticker", "exit_date"], "left").withColumn("_one", F.lit(1))
    values = index.select(F.lit(1).alias("_one"), F.col("trade_date").alias("_at"), F.col("close").alias("_value"))
    rows = as_of(rows, values, ["_one"], "d0", "_at", ["_value"])
    recent = F.col("match._at") >= F.date_sub("d0", INDEX_DAYS)
    rows = rows.withColumn("_index", F.when(recent, F.col("match._value"))).drop("match", "_one")
    known = rows.where("_index is not null")
    enough = known.groupBy(*by).agg(F.count("*").alias("_k")).where(F.col("_k") >= LEAST_SPLIT)
    medians = exact_quantiles(known, "_index", by, {"_median": 0.5}).join(enough, by).select(*by, "_median")
    rows = rows.join(F.broadcast(medians), by, "left")  # a row per group: a shuffle would bring each group's trades to one task

    side, pnl, legs = F.col("side"), F.col("pnl_pct"), F.col("legs")
    hedged, costs = F.col("hedge_entry").isNotNull(), F.col("gross_pct") - F.col("pnl_pct")
    other = F.when(hedged, move(side, F.col("hedge_entry"), F.col("hedge_exit"))).otherwise(0.0)
    later = F.when(hedged, move(side, F.col("_hedge2"), F.col("hedge_exit"))).otherwise(0.0)
    in_time = F.col("_open2").isNotNull() & (F.col("exit_date") >= F.col("_day2"))
    gone, wild = F.coalesce("_gone", F.lit(False)), F.col("_index") >= F.col("_median")
    no, always = F.lit(False), F.lit(True)
    made = {  # result, whether the trade is in it, whether it is another than before
        "base": (pnl, always, no),
        "commission": (pnl - legs * COMMISSION, always, always),
        "spread": (pnl - legs * SPREAD, always, always),
        "latency": (move(side, F.col("_open2"), F.col("exit")) - later - costs, in_time, always),
        "delisting": (F.when(gone, move(side, F.col("entry"), F.col("exit") * (1 - LOSS)) - other - costs).otherwise(pnl), always, gone),
        "confidence": (pnl, F.col("confidence") * (1 - HAIRCUT) >= FLOOR, no),
        "high_index": (pnl, wild, no),
        "low_index": (pnl, ~wild, no),
    }
    each = [F.struct(F.lit(n).alias("scenario"), F.when(F.coalesce(inside, no), result).alias("pnl_pct"), changed.alias("affected")) for n, (result, inside, changed) in made.items()]
    return rows.select(*by, "event_id", F.explode(F.array(*each)).alias("s")).select(*by, "event_id", "s.*").where("pnl_pct is not null")


def summaries(in_scenario: DataFrame, by: list[str], size: float, capital: float) -> DataFrame:
    """``scenario``, ``by``, ``n``, ``affected``, ``win_rate``, ``expectancy`` and ``total_return`` (of ``size`` a trade on ``capital``): a row for each
    group and scenario, also for those without a trade."""
    groups = in_scenario.where("scenario = 'base'").select(*by).distinct().withColumn("scenario", F.explode(F.array(*map(F.lit, NAMES))))
    p = F.col("pnl_pct")
    sums = in_scenario.groupBy(*by, "scenario").agg(
        F.count("*").alias("n"), F.count_if("affected").alias("affected"), (F.count_if(p > 0) / F.count("*")).alias("win_rate"), F.avg(p).alias("expectancy"), F.sum(p).alias("_sum")
    )
    zero = F.lit(0).cast("bigint")
    out = groups.join(sums, [*by, "scenario"], "left")
    return out.select(
        "scenario", *by, F.coalesce("n", zero).alias("n"), F.coalesce("affected", zero).alias("affected"), "win_rate", "expectancy",
        F.coalesce(F.col("_sum") * size / 100 / capital, F.lit(0.0)).alias("total_return"),
    )
