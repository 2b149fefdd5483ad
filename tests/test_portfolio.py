"""Portfolio folds by hand, the t distribution against its table, and rules on single rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import stats
from tidegauge.operators import decisions, event_study, intervals, portfolio

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def trades(spark, rows):
    return spark.createDataFrame(
        [("p", i, day(a), day(b), float(x), float(ev)) for i, a, b, x, ev in rows],
        "portfolio string, event_id bigint, entry_date date, exit_date date, pnl_pct double, ev double",
    )


def test_slots_order_and_sizes(spark):
    rows = [(1, 0, 5, 10, 0.1), (2, 0, 5, -10, 0.3), (3, 0, 5, 50, 0.2), (4, 5, 5, 20, 0.1), (5, 9, 12, 1, 0.1)]
    got = portfolio.simulated(trades(spark, rows), "portfolio", capital=1000, slots=2, size_pct=10).collect()
    out = {r.event_id: (r.dollars, round(r.profit, 6), round(r.balance, 6)) for r in got}
    assert set(out) == {2, 3, 4, 5}  # the two of day 0 with the largest value, then day 5 after its exits
    assert out[2][:2] == (100, -10) and out[3][:2] == (100, 50)
    assert out[4] == (104, 20.8, 1060.8) and out[5] == (106.08, 1.0608, 1061.8608)


def test_pause_and_half_size(spark):
    rows = [(1, 0, 1, -50, 1), (2, 2, 3, 10, 1), (3, 40, 41, 100, 1), (4, 50, 51, 10, 1)]
    got = {r.event_id: r for r in portfolio.simulated(trades(spark, rows), "portfolio", capital=1000, slots=1, size_pct=50, drawdown=0.15, pause_days=28).collect()}
    assert set(got) == {1, 3, 4}  # the loss of 25 % pauses entries
    assert got[3].half_size and got[3].dollars == 750 * 0.25 and got[3].balance == 937.5
    assert got[4].half_size


def test_portfolios_do_not_touch(spark):
    rows = trades(spark, [(1, 0, 1, 10, 1)])
    two = rows.unionByName(rows.withColumn("portfolio", F.lit("q")))
    assert {(r.portfolio, r.balance) for r in portfolio.simulated(two, "portfolio", capital=100, size_pct=10).collect()} == {("p", 101.0), ("q", 101.0)}
    assert portfolio.simulated(rows.limit(0), "portfolio").count() == 0


def test_t_against_its_table():
    table = {1: 12.706, 2: 4.303, 5: 2.571, 10: 2.228, 30: 2.042, 120: 1.980}
    for df, wanted in table.items():
        assert float(stats.t_quantile(0.975, df)) == pytest.approx(wanted, abs=6e-4)
        assert float(stats.t_two_sided(wanted, df)) == pytest.approx(0.05, abs=1e-4)


def test_adjusted_p_values(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {r.k: (round(r.p_adjusted, 6), r.rejected) for r in event_study.benjamini_hochberg(rows, "p", "k").collect()}
    assert got == {"a": (0.03, True), "b": (0.04, True), "c": (0.04, True)}


def test_grouped_intervals(spark):
    rows = [("x", f"m{i % 8}", float(i % 5)) for i in range(40)] + [("few", "m1", 1.0), ("few", "m2", 2.0)]
    df = spark.createDataFrame(rows, "by string, month string, v double").withColumn("key", F.monotonically_increasing_id())
    got = {r.by: r for r in intervals.grouped(df, "v", ["by"], "month", "key").collect()}
    assert got["x"].g_effective == 8 and got["x"].df == 7 and got["few"].df is None
    values = [float(i % 5) for i in range(40)]
    mean = sum(values) / 40
    without = [(sum(values) - sum(v for i, v in enumerate(values) if i % 8 == g)) / 35 for g in range(8)]
    middle = sum(without) / 8
    assert got["x"].var_cluster == pytest.approx(7 / 8 * sum((w - middle) ** 2 for w in without))
    assert got["x"].var_iid == pytest.approx(sum((v - mean) ** 2 for v in values) / 39 / 40)
    assert got["x"].low < mean < got["x"].high and got["few"].low is None


def test_verdicts_and_reviews(spark):
    lit = F.lit
    one = spark.range(1)
    verdict = lambda *a: one.select(decisions.verdict(*[x if x is not None else lit(None).cast("double") for x in a]).alias("v")).first().v
    good = [lit(0.6), lit(1.2), lit(0.7), lit(0.1), lit(400), lit(True), lit(0)]
    assert verdict(*good) == "A"
    assert verdict(*good[:-1], lit(1)) == "C" and verdict(*good[:4], lit(5), *good[5:]) == "C"
    assert verdict(None, *good[1:]) == "B" and verdict(good[0], lit(0.6), *good[2:]) == "C"
    review = lambda **k: one.select(decisions.review(**{n: k.get(n, lit(None).cast("double")) for n in (
        "realised", "expected", "saturation", "volume_ratio", "price", "below", "above", "conviction", "confidence")}, side=lit(1), invalid_class=k.get("bad", lit(False))).alias("v")).first().v
    assert review(realised=lit(5.0), expected=lit(4.0)) == "SELL: fulfilled" and review(realised=lit(5.0), expected=lit(0.0)) == "HOLD"
    assert review(volume_ratio=lit(3.0)) == "SELL: saturated" and review(bad=lit(True)) == "SELL: event class"
    assert review(conviction=lit(-0.5), confidence=lit(70.0)) == "SELL: contradiction" and review(conviction=lit(-0.5), confidence=lit(50.0)) == "REDUCE"
    assert decisions.profit_tiers() == ((20.0, 0.3), (40.0, 0.3), (60.0, 0.3), (80.0, pytest.approx(0.1)))
