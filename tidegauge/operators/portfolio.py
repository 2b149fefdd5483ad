"""Portfolios with limited slots, cash and a loss pause, as a fold over each portfolio's days.

A trade's exit does not depend on the portfolio, so exits are found set-wise first
(``operators.trades``). What is left is serial: which entries are taken, and at what
size. Entries and exits of a portfolio stand in one sorted stream; the state that
is carried along is the balance, the open positions (as many as there are slots) and
the pause, so memory does not grow with the number of trades. Portfolios - versions,
scenarios, classes - run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "portfolio string, event_id bigint, entry_date date, exit_date date, dollars double, profit double, balance double, half_size boolean"


@dataclass
class State:
    """One portfolio on its way: ``open`` has the committed dollars of each open position by event."""

    balance: float
    cash: float
    peak: float
    open: dict[int, tuple[float, object, bool]] = field(default_factory=dict)
    paused_until: object = None
    resume_at: float | None = None

    def half_size(self) -> bool:
        return self.resume_at is not None


def step(state: State, row, slots: int, size_pct: float, drawdown: float, pause_days: int) -> tuple | None:
    """Takes one entry or exit; an exit of a position that was taken gives a row of RESULT without the portfolio.

    Exits of a day come before its entries. A fall of ``drawdown`` from the peak stops
    entries for ``pause_days`` calendar days; after that, sizes are halved until the
    balance has regained the peak.
    """
    if row.is_exit:
        held = state.open.pop(row.event_id, None)
        if held is None:
            return None
        dollars, entered, half = held
        profit = dollars * row.pnl_pct / 100
        state.cash += dollars + profit
        state.balance += profit
        if state.resume_at is not None and state.balance >= state.resume_at:
            state.resume_at = None
        state.peak = max(state.peak, state.balance)
        if state.resume_at is None and state.balance <= state.peak * (1 - drawdown):
            state.paused_until = row.day + pd.Timedelta(days=pause_days)
            state.resume_at = state.peak
        return row.event_id, entered, row.day, dollars, profit, state.balance, half
    if len(state.open) >= slots or (state.paused_until is not None and row.day <= state.paused_until):
        return None
    dollars = min(state.balance * size_pct / 100 * (0.5 if state.half_size() else 1.0), state.cash)
    if dollars > 0:
        state.cash -= dollars
        state.open[row.event_id] = (dollars, row.day, state.half_size())
    return None


def simulated(
    trades: DataFrame, portfolio: str, capital: float = 100_000.0, slots: int = 5, size_pct: float = 10.0, drawdown: float = 0.15, pause_days: int = 28
) -> DataFrame:
    """The trades that each portfolio takes, with their size, profit and the balance after.

    ``trades(event_id, entry_date, exit_date, pnl_pct, ev)`` and the column ``portfolio``.
    Of one day's entries the one with the largest ``|ev|`` comes first, then the smaller
    id. Trades without a date or a result are left out; an exit on the entry day comes
    after that day's entries.
    """
    known = trades.where("entry_date is not null and exit_date is not null and pnl_pct is not null")
    one_day = F.col("entry_date") == F.col("exit_date")
    rows = known.select(
        F.col(portfolio).cast("string").alias("portfolio"), "event_id", "pnl_pct", F.abs("ev").alias("size_of_ev"),
        F.explode(F.array(
            F.struct(F.col("entry_date").alias("day"), F.lit(1).alias("turn"), F.lit(False).alias("is_exit")),
            F.struct(F.col("exit_date").alias("day"), F.when(one_day, 2).otherwise(0).alias("turn"), F.lit(True).alias("is_exit")),
        )).alias("e"),
    ).select("portfolio", "event_id", "pnl_pct", "size_of_ev", "e.*")
    ordered = rows.repartition("portfolio").sortWithinPartitions("portfolio", "day", "turn", F.desc_nulls_last("size_of_ev"), "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        now, state = None, State(capital, capital, capital)
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if row.portfolio != now:
                    now, state = row.portfolio, State(capital, capital, capital)
                out = step(state, row, slots, size_pct, drawdown, pause_days)
                if out is not None:
                    done.append((now, *out))
            yield pd.DataFrame(done, columns=names)

    return ordered.mapInPandas(run, RESULT)


def hedged(trades: DataFrame, hedge: DataFrame, cost_pct: float) -> DataFrame:
    """``hedge_entry``, ``hedge_exit`` and ``hedged_pct`` of trades with ``side``: the move less the hedge's over the same days.

    The hedge is entered at its open on the very day, and left at its last close at or
    before the exit; a trade without one of them has no hedged result. ``hedge(trade_date, open, close)``
    has a row per day.
    """
    from .joins import as_of

    start = hedge.select(F.col("trade_date").alias("entry_date"), F.col("open").alias("hedge_entry"))
    series = hedge.select(F.lit(1).alias("one"), F.col("trade_date").alias("hedge_day"), "close")
    entered = trades.join(start, "entry_date", "left").withColumn("one", F.lit(1))
    left = as_of(entered, series, ["one"], "exit_date", "hedge_day", ["close"])
    price = F.when(F.col("match.hedge_day") >= F.col("entry_date"), F.col("match.close"))
    rows = left.withColumn("hedge_exit", price).drop("match", "one")
    move = lambda a, b: F.col("side") * (F.try_divide(F.col(b), F.col(a)) - 1) * 100
    return rows.withColumn("hedged_pct", move("entry", "exit") - move("hedge_entry", "hedge_exit") - cost_pct)
