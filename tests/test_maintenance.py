"""Upkeep, bases, capitalisation, download plans, budgets, schedules and scenarios on small hand-made inputs."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import cron
from tidegauge.operators import budget, capitalisation, coverage, enrichment, intervals, rebasing, scenarios, upkeep
from tidegauge.operators import trades as ops

D = dt.date


def day(text: str) -> dt.date:
    return D.fromisoformat(text)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- splits and capitalisation


def test_products_between_two_dates_per_row(spark):
    r = random.Random(1)
    start = day("2000-01-01")
    at = lambda k: start + dt.timedelta(days=k)
    splits = [(t, at(r.randrange(60)), r.choice([0.5, 2.0, 0.1, 3.0])) for t in "AB" for _ in range(12)]
    spans = [(r.choice("ABC"), at(a), at(a + r.randrange(30))) for a in (r.randrange(50) for _ in range(200))]
    df = spark.createDataFrame(spans + [(None, start, start), ("A", None, start)], "ticker string, start date, end date")
    found = {tuple(x)[:3]: x["factor"] for x in capitalisation.split_products(df, spark.createDataFrame(splits, "ticker string, split_date date, ratio double")).collect()}
    assert set(found) == set(spans)
    for (ticker, a, b), factor in found.items():
        wanted = math.prod(x for t, d, x in splits if t == ticker and a < d <= b)
        assert factor == pytest.approx(wanted)


def test_capitalisation_with_splits_before_between_and_after(spark):
    events = spark.createDataFrame(
        [(1, "A", 7, day("2020-06-01")), (2, "B", 8, day("2020-06-01")), (3, "A", 9, day("2020-06-01")), (4, "Z", 7, day("2020-06-01")), (5, "A", 7, day("2020-01-01")), (6, "B", 10, day("2020-06-01"))],
        "event_id int, ticker string, cik int, d0 date",
    )
    accounts = spark.createDataFrame(
        [(7, day("2020-03-01"), day("2019-12-31"), 100), (7, day("2020-07-01"), day("2020-06-30"), 999), (7, day("2020-05-01"), day("2020-03-31"), None), (8, day("2020-03-01"), day("2019-12-31"), 50), (10, day("2020-03-01"), day("2019-12-31"), 50)],
        "cik int, filed_at date, period_end date, shares int",
    )
    bars = spark.createDataFrame([(t, day(d), c) for t in "AB" for d, c in (("2020-05-29", 10.0), ("2020-06-02", 99.0))], "ticker string, trade_date date, close double")
    splits = spark.createDataFrame([("A", day("2020-02-01"), 3.0), ("A", day("2020-04-01"), 2.0), ("A", day("2020-09-01"), 5.0), ("B", day("2020-04-01"), 2.0)], "ticker string, split_date date, ratio double")
    reviewed = spark.createDataFrame([("A",), ("A",)], "ticker string")
    latest = spark.createDataFrame([(7, 1.0), (8, 300.0)], "cik int, last_cap double")
    found = {r["event_id"]: (r["shares"], r["price"] and round(r["price"], 9), r["cap"] and round(r["cap"], 6)) for r in capitalisation.at_event(events, accounts, bars, splits, reviewed, latest).collect()}
    assert found[1] == (100, 50.0, 100 * 2 * 50.0)  # price as traded before the later split, shares carried over the one between
    assert found[2] == (50, 10.0, 300.0)  # not reviewed: the smaller of 50 x 10 and the latest
    assert found[3] == (None, 50.0, None)  # no accounts
    assert found[4][2] is None and found[5][2] is None  # no price, and nothing filed yet
    assert found[6] == (50, 10.0, 500.0)  # no latest figure: the other one


# ---- upkeep

STORED = "event_id int, window_days int, car double, vol_ratio double, resid_std double, n_days bigint, computed_at date, checked_at date"


def test_upkeep_change_set_and_its_second_application(spark):
    events = spark.createDataFrame([(k, day("2020-01-10")) for k in range(1, 10)], "event_id int, d0 date")
    late, early = day("2020-03-01"), day("2020-01-12")
    stored = spark.createDataFrame(
        [
            (1, 5, 0.1, 1.0, 0.2, 4, late, None),  # as it should be
            (2, 5, 0.1, 1.0, 0.2, 4, early, None),  # before its window's end, known now
            (3, 5, 0.1, 1.0, 0.2, 4, early, None),  # before its window's end, still unknown
            (4, 5, 0.1, 1.0, None, None, late, None),  # the same return: filled
            (5, 5, 0.1, 1.0, None, None, late, None),  # another return: tried
            (6, 5, 0.1, 1.0, None, None, day("2020-02-01"), None),  # ratio reset, and filled
            (7, 5, 0.1, 1.0, None, None, late, late),  # tried before
            (8, 5, 0.1, 1.0, None, None, late, None),  # no old prices
            (99, 5, 0.1, None, None, None, early, None),  # no such event
        ],
        STORED,
    )
    computed = spark.createDataFrame(
        [(k, 5, 0.1 * (1 + 5e-7 if k != 5 else 2), 2.0, 0.3, 4) for k in (1, 2, 4, 5, 6, 7, 8, 9)], "event_id int, window_days int, car double, vol_ratio double, resid_std double, n_days bigint"
    )
    last = spark.createDataFrame([(day("2020-02-28"),)], "day date")
    fillable = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 7, 9)], "event_id int")
    made = lambda table: upkeep.changes_to(table, events, computed, last, fillable, F.lit(day("2020-02-15")), F.lit(day("2020-06-01")))
    changed = made(stored)
    assert {r["event_id"]: r["action"] for r in changed.collect()} == {2: "renew", 3: "purge", 4: "fill", 5: "check", 6: "reset+fill", 9: "add"}
    once = upkeep.applied(stored, changed)
    kept = {r["event_id"]: r for r in once.collect()}
    assert set(kept) == {1, 2, 4, 5, 6, 7, 8, 9, 99}
    assert kept[4]["resid_std"] == 0.3 and kept[4]["car"] == 0.1 and kept[4]["checked_at"] == day("2020-06-01")
    assert kept[5]["resid_std"] is None and kept[5]["checked_at"] == day("2020-06-01")
    assert kept[6]["vol_ratio"] is None and kept[2]["computed_at"] == day("2020-06-01")
    assert rows_of(upkeep.applied(once, changed)) == rows_of(once)
    assert made(once).collect() == []


# ---- bases


def test_planted_splits_are_found_and_single_odd_bars_not(spark):
    start = day("2021-01-04")
    rows = []
    for k in range(60):
        d = start + dt.timedelta(days=k)
        close = 10 + k % 7
        rows.append(("A", d, day("2021-06-01"), float(close)))
        factor = 0.5 if k < 30 else 1.5 if k == 40 else 1.001
        rows.append(("A", d, day("2021-07-01"), close * factor))
        rows.append(("A", d, day("2021-08-01"), close * factor))
        rows.append(("B", d, day("2021-06-01"), None if k == 3 else float(close)))
        rows.append(("B", d, day("2021-07-01"), close * (1.3 if k in (20, 22) else 1.0)))
    versions = spark.createDataFrame(rows + rows[:1], "ticker string, trade_date date, captured_at date, close double")
    found = rebasing.base_changes(rebasing.version_ratios(versions)).collect()
    assert [(r["ticker"], r["captured_at"], r["start"], r["end"], r["bars"], r["ratio"]) for r in found] == [("A", day("2021-07-01"), start, start + dt.timedelta(days=29), 30, 0.5)]
    bars = spark.createDataFrame([("A", start + dt.timedelta(days=k), 1.0) for k in range(60)] + [("B", start, 1.0)], "ticker string, trade_date date, close double")
    closes = {(r["ticker"], (r["trade_date"] - start).days): r["close"] for r in rebasing.rebased(bars, rebasing.base_changes(rebasing.version_ratios(versions))).collect()}
    assert len(closes) == 61 and {k for k, v in closes.items() if v == 0.5} == {("A", k) for k in range(30)}


def test_jumps_between_captures(spark):
    rows = [("A", 1, 10.0, 1), ("A", 2, 20.0, 1), ("A", 3, None, 2), ("A", 4, 40.0, 2), ("A", 5, 41.0, 3), ("B", 1, 0.0, 1), ("B", 2, 5.0, 2)]
    bars = spark.createDataFrame([(t, D(2020, 1, d), c, D(2020, 2, k)) for t, d, c, k in rows], "ticker string, trade_date date, close double, captured_at date")
    assert rows_of(rebasing.base_jumps(bars)) == [("A", 2, 1)]


# ---- download plans


def test_missing_ranges_and_whole_months(spark):
    need = spark.createDataFrame([(t, day("2020-01-01"), day("2020-12-31")) for t in "ABCD"], "ticker string, start date, stop date")
    every = [day("2020-01-01") + dt.timedelta(days=k) for k in range(366)]
    gone = lambda d: (d < day("2020-02-10")) or day("2020-05-20") <= d <= day("2020-06-03") or day("2020-06-05") <= d <= day("2020-06-28") or d > day("2020-11-15")
    stored = [("A", d) for d in every if not gone(d)] + [("B", d) for d in every if d.weekday() < 5 and not d.month == 12 or d.day > 8] + [("D", day("2019-05-05")), ("X", day("2020-05-05"))]
    days = spark.createDataFrame(stored, "ticker string, trade_date date")
    assert rows_of(coverage.missing_ranges(need, days)) == sorted([
        ("A", day("2020-01-01"), day("2020-02-09"), 40, "head"), ("A", day("2020-05-20"), day("2020-06-03"), 15, "inner"), ("A", day("2020-06-05"), day("2020-06-28"), 24, "inner"),
        ("A", day("2020-11-16"), day("2020-12-31"), 46, "tail"), ("B", day("2020-12-01"), day("2020-12-08"), 8, "inner"),
        ("C", day("2020-01-01"), day("2020-12-31"), 366, "all"), ("D", day("2020-01-01"), day("2020-12-31"), 366, "all"),
    ], key=repr)
    plan = coverage.download_plan(need, days, F.lit(day("2020-12-15"))).select("ticker", "start", "stop", "ranges")
    assert rows_of(plan) == sorted([
        ("A", day("2020-01-01"), day("2020-02-29"), 1), ("A", day("2020-05-01"), day("2020-06-30"), 2), ("A", day("2020-11-01"), day("2020-12-15"), 1),
        ("B", day("2020-12-01"), day("2020-12-15"), 1), ("C", day("2020-01-01"), day("2020-12-15"), 1), ("D", day("2020-01-01"), day("2020-12-15"), 1),
    ], key=repr)


# ---- budget


def test_ledger_estimates_and_fallback(spark):
    at = dt.datetime(2024, 1, 1, 5)
    spent = spark.createDataFrame([(at, "judge", 2.0, 9), (at, "judge", None, 3), (at, "other", None, 2)], "at timestamp_ntz, kind string, cost double, requests int")
    done = spark.createDataFrame([(at,), (at + dt.timedelta(days=1),), (at + dt.timedelta(days=1),)], "at timestamp_ntz")
    days = budget.rests(budget.day_ledger(spent, done, {"judge": 0.5}, 0.1, 3.0), 5.0, 0.5)
    assert rows_of(days) == [(D(2024, 1, 1), 3, 3.7, pytest.approx(1.3), 2), (D(2024, 1, 2), 0, 6.0, 0.0, 0)]
    assert {r["rest"] for r in budget.rests(budget.day_ledger(spent, done, {}, 0.1, 3.0), 0.0, 0.5).collect()} == {None}


def test_queue_is_admitted_by_sharded_sums(spark):
    r = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    queue = [(k, start + dt.timedelta(seconds=r.randrange(3 * 86_400) // 40 * 40), r.randrange(6)) for k in range(3_000)]
    rest = {D(2024, 1, 1): 700.0, D(2024, 1, 2): None, D(2024, 1, 3): 0.0, D(2024, 1, 4): 5.0}
    df = spark.createDataFrame(queue, "id int, at timestamp_ntz, cost int")
    days = spark.createDataFrame(list(rest.items()), "day date, rest double")
    got = {x["day"]: (x["queued"], x["admitted"]) for x in budget.admitted(df, days, "at", "id", F.col("cost")).collect()}
    for d, most in rest.items():
        mine, total, fits = sorted((a, i, c) for i, a, c in queue if a.date() == d), 0, 0
        for _, _, c in mine:
            total += c
            fits += most is None or total <= most
        assert got[d] == (len(mine), fits)
    summed = {x["id"]: x["upto"] for x in budget.with_running_sum(df, "at", "id", F.col("cost")).collect()}
    total = 0
    for a, i, c in sorted((a, i, c) for i, a, c in queue if a.date() == D(2024, 1, 2)):
        total += c
        assert summed[i] == total


# ---- schedules


def plain_field(field, value, low, high):
    for part in field.split(","):
        body, _, step = part.partition("/")
        a, b = (low, high) if body == "*" else (int(body.split("-")[0]), int(body.split("-")[1]) if "-" in body else (high if step else int(body.split("-")[0])))
        if a <= value <= b and (value - a) % int(step or 1) == 0:
            return True
    return False


def plain_match(text, t):
    values = (t.minute, t.hour, t.day, t.month, (t.weekday() + 1) % 7)
    return all(plain_field(f, v, *cron.FIELDS[n]) for f, v, n in zip(text.split(), values, cron.FIELDS, strict=True))


def test_last_due_is_found_in_masks(spark):
    crons = ["*/15 * * * *", "5,35 8-18/2 * * 1-5", "0 0 1 1 *", "59 23 31 12 *", "7 3 29 2 *", "0 6 * * 0", "10/20 4 1-7,15 * *", "30 22 * 1,12 *", "0 12 31 * 6"]
    nows = [dt.datetime(2020, 3, 1, 0, 20), dt.datetime(2021, 1, 1, 0, 5, 30), dt.datetime(2020, 12, 31, 23, 59), dt.datetime(2021, 1, 3, 7, 0), dt.datetime(2021, 6, 15, 12, 31)]
    rows = spark.createDataFrame([(c, n) for c in crons for n in nows], "cron string, now timestamp_ntz")
    m = cron.masks(F.col("cron"))
    for grace, hours in ((20, 30), (0, 24 * 40)):
        got = {(r["cron"], r["now"]): r["due"] for r in rows.select("cron", "now", cron.last_due(m, F.col("now"), grace, hours).alias("due")).collect()}
        for (text, now), due in got.items():
            t, oldest = (now - dt.timedelta(minutes=grace)).replace(second=0), now - dt.timedelta(hours=hours)
            while t >= oldest and not plain_match(text, t):
                t -= dt.timedelta(minutes=1)
            assert due == (t if t >= oldest else None), (text, now, grace)


def test_odd_schedules(spark):
    rows = spark.createDataFrame([(None,), ("* * *",), ("x * * * *",), ("61 * * * *",), ("5-3 * * * *",)], "cron string")
    due = cron.last_due(cron.masks(F.col("cron")), F.lit(dt.datetime(2021, 1, 1)).cast("timestamp_ntz"), 5, 30)
    assert [r[0] for r in rows.select(due).collect()] == [None] * 5


# ---- features, intervals, scenarios


def test_mood_of_the_other_tickers_of_a_sector(spark):
    closes = {"A": (10, 11), "B": (10, 9), "C": (10, 12), "M": (100, 101), "L": (5, 6)}
    bars = spark.createDataFrame([(t, D(2020, 1, 6 + k), float(c)) for t, cs in closes.items() for k, c in enumerate(cs)], "ticker string, trade_date date, close double")
    sectors = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "x"), ("N", "x"), ("L", "y")], "ticker string, sector string")
    events = spark.createDataFrame([(t, D(2020, 1, 7)) for t in "ABNL"] + [("A", D(2020, 1, 6))], "ticker string, d0 date")
    found = {(r["ticker"], r["d0"].day): r["sector_mood"] for r in enrichment.sector_moods(events, bars, bars.where("ticker = 'M'"), sectors).collect()}
    assert found[("A", 7)] == pytest.approx((((-0.1 + 0.2) / 2) - 0.01) * 100)
    assert found[("B", 7)] == pytest.approx((((0.1 + 0.2) / 2) - 0.01) * 100)
    assert found[("N", 7)] == pytest.approx((((0.1 - 0.1 + 0.2) / 3) - 0.01) * 100)  # no bar of its own
    assert found[("L", 7)] is None and found[("A", 6)] is None  # alone, and no return


def test_gaps_before_an_event(spark):
    days = [D(2020, 1, d) for d in (6, 7, 8, 9, 10, 13, 15, 16, 17, 20, 21, 22, 23, 24)]  # the 14th is missing
    bars = spark.createDataFrame([("A", d) for d in days], "ticker string, trade_date date")
    asked = spark.createDataFrame([("A", D(2020, 1, k)) for k in (7, 13, 14, 19, 20, 24, 31)] + [("Z", D(2020, 1, 7))], "ticker string, d0 date")
    found = {(r["ticker"], r["d0"].day): r["gap_warning"] for r in enrichment.gap_warnings(asked, bars).collect()}
    assert {k for k, v in found.items() if v} == {("A", 14), ("A", 19)} and len(found) == 8


def test_interval_block_chooses_quarters_or_months(spark):
    r = random.Random(4)
    rows = [("long", k, D(2015 + k // 120, k // 10 % 12 + 1, 5), r.gauss(0.4, 1)) for k in range(480)]
    rows += [("short", k, D(2020, k % 8 + 1, 5), r.gauss(-2, 1)) for k in range(40)] + [("few", k, D(2020, 1, 5), 1.0) for k in range(50)]
    df = spark.createDataFrame(rows, "side string, event_id int, entry_date date, pnl_pct double")
    found = {x["side"]: x for x in intervals.block(df, "pnl_pct", ["side"], "entry_date", "event_id").collect()}
    assert [found[s]["unit"] for s in ("long", "short", "few")] == ["quarter", "month", "month"]
    assert found["long"]["g_effective"] == pytest.approx(16) and found["short"]["g_effective"] == pytest.approx(8)
    assert found["few"]["low"] is None and found["few"]["apart"] is None and found["few"]["share_low"] is None
    assert found["short"]["apart"] and found["short"]["high"] < 0
    # the mean's interval by hand: jackknife over quarters, t of 15 degrees of freedom
    mine = [(x[2], x[3]) for x in rows if x[0] == "long"]
    mean, groups = sum(v for _, v in mine) / 480, {}
    for d, v in mine:
        groups.setdefault((d.year, (d.month - 1) // 3), []).append(v)
    without = [(mean * 480 - sum(g)) / (480 - len(g)) for g in groups.values()]
    centre = sum(without) / 16
    clustered = 15 / 16 * sum((w - centre) ** 2 for w in without)
    plain = sum((v - mean) ** 2 for _, v in mine) / 479 / 480
    margin = 2.131449546 * math.sqrt(max(clustered, plain))
    assert found["long"]["low"] == pytest.approx(mean - margin, rel=1e-6) and found["long"]["high"] == pytest.approx(mean + margin, rel=1e-6)


def test_scenarios_by_hand(spark):
    at = lambda k: D(2020, 1, k)
    bars = spark.createDataFrame([("A", at(k), 10.0 + k, 10.5 + k) for k in (2, 3, 6, 7, 8)], "ticker string, trade_date date, open double, close double")
    hedge = spark.createDataFrame([(at(k), 100.0, 100.0 + k) for k in (2, 3, 6, 7, 8)], "trade_date date, open double, close double")
    trades = spark.createDataFrame(
        [(1, "A", at(2), 1, at(3), 13.0, at(8), 18.5, 90.0), (2, "A", at(2), 1, at(3), 13.0, at(3), 13.5, 45.0), (3, "A", at(6), -1, at(7), 17.0, at(8), 18.5, 60.0), (4, "A", at(2), 1, at(3), 13.0, at(6), 16.5, 50.0)],
        "event_id int, ticker string, d0 date, side int, entry_date date, entry double, exit_date date, exit double, confidence double",
    )
    both = scenarios.two_legged(trades, hedge, F.col("event_id") != 2, 0.3)
    legs = {r["event_id"]: (r["legs"], r["hedge_exit"], round(r["pnl_pct"], 6)) for r in both.collect()}
    assert legs[1] == (2, 108.0, round((18.5 / 13 - 1) * 100 - 8 - 0.6, 6)) and legs[2] == (1, None, round((13.5 / 13 - 1) * 100 - 0.3, 6))
    index = spark.createDataFrame([(at(2), 20.0), (at(6), 30.0)], "trade_date date, close double")
    found = scenarios.in_scenarios(both.withColumn("all", F.lit("x")), bars, hedge, bars.where(F.col("trade_date") == at(8)).select("ticker", "trade_date"), index, ["all"])
    got = {(r["scenario"], r["event_id"]): round(r["pnl_pct"], 6) for r in found.collect()}
    assert got["commission", 1] == round(legs[1][2] - 0.2, 6) and got["spread", 2] == round(legs[2][2] - 0.2, 6)
    assert got["latency", 1] == round((18.5 / 16 - 1) * 100 - 8 - 0.6, 6) and ("latency", 2) not in got  # left before the second bar
    assert got["delisting", 1] == round((18.5 * 0.7 / 13 - 1) * 100 - 8 - 0.6, 6) and got["delisting", 4] == legs[4][2]
    assert {e for s, e in got if s == "confidence"} == {1, 3, 4}
    assert {e for s, e in got if s == "high_index"} == {1, 2, 3, 4} and not [e for s, e in got if s == "low_index"]  # the median is 20
    sums = {r["scenario"]: r for r in scenarios.summaries(found, ["all"], 1_000.0, 100_000.0).collect()}
    assert set(sums) == set(scenarios.NAMES) and sums["low_index"]["n"] == 0 and sums["low_index"]["win_rate"] is None
    assert sums["base"]["total_return"] == pytest.approx(sum(legs[k][2] for k in legs) / 100 * 1_000 / 100_000)
    assert sums["delisting"]["affected"] == 2


def test_drawdown_stability_and_messages(spark):
    rows = [("a", k, D(2020, 1, k + 1), D(2020, 1, k + 2), p) for k, p in enumerate([10.0, -20.0, 5.0, -1.0])]
    df = spark.createDataFrame(rows, "c string, event_id int, entry_date date, exit_date date, pnl_pct double")
    assert ops.rebuilt_drawdown(df, ["c"], 100.0, 100.0).first()["drawdown"] == pytest.approx(1 - 90 / 110)
    assert ops.stable_over_time(df, ["c"], F.lit("2020-01-03").cast("date"), least=2).first()["stable"] is False  # -5 before, 2 after
    steady = spark.createDataFrame([("a", D(2020, 1, 1 + k % 4), float(k % 2 * 3 - 1)) for k in range(40)], "c string, entry_date date, pnl_pct double")
    assert ops.stable_over_time(steady, ["c"], F.lit("2020-01-03").cast("date")).first()["stable"] is True
    assert ops.stable_over_time(steady, ["c"], F.lit("2019-01-03").cast("date")).first()["stable"] is None
    records = spark.createDataFrame([(1, D(2020, 1, 2), D(2020, 1, 2), D(2020, 1, 1)), (2, D(2020, 1, 2), D(2020, 1, 3), D(2020, 1, 3))], "event_id int, d0 date, entry_date date, exit_date date")
    assert [r["message"] for r in ops.look_ahead_messages(records).orderBy("message").collect()] == [
        "event 1: entry 2020-01-02 is not after 2020-01-02", "event 1: exit 2020-01-01 is before entry 2020-01-02"
    ]


# ---- quality, universe, reports


def test_bad_bars_tell_sides_apart_and_indices_may_spike(spark):
    rows = [("A", 1, 10, 12, 9, 10, 5), ("A", 2, 10, 20, 9, 16, 5), ("A", 3, 10, 12, 9, 10.5, 5), ("A", 4, 10, 12, 9, 13, 5), ("A", 5, 8, 12, 9, 10, 5), ("A", 6, 10, 8, 9, 10, 5), ("A", 7, 0, 12, 9, 10, 5), ("A", 8, 10, 12, 9, 10, -1), ("A", 9, 10, 12, 9, 8, 5), ("A", 10, 13, 12, 9, 10, 5)]
    rows += [("I", d, *r) for d, *r in [x[1:] for x in rows[:3]]]
    bars = spark.createDataFrame([(t, D(2020, 1, d), float(o), float(h), float(lo), float(c), v) for t, d, o, h, lo, c, v in rows], "ticker string, trade_date date, open double, high double, low double, close double, volume int")
    from tidegauge.operators import quality

    found = {(r["ticker"], r["trade_date"].day): r["reason"] for r in quality.bad_bars(bars, is_index=F.col("ticker") == "I").collect() if r["reason"]}
    assert found == {("A", 2): "spike", ("A", 4): "close above high", ("A", 5): "open below low", ("A", 6): "high<low", ("A", 7): "open<=0", ("A", 8): "volume<0", ("A", 9): "close below low", ("A", 10): "open above high"}


def test_universe_and_retention(spark):
    from tidegauge.operators import quality

    bars = spark.createDataFrame(
        [("A", D(2020, 1, 10), 10.0, 100), ("A", D(2020, 1, 9), 20.0, None), ("A", D(2020, 1, 8), 6.0, 50), ("S", D(2019, 12, 1), 50.0, 1000), ("A", D(2020, 1, 11), None, 5)],
        "ticker string, trade_date date, close double, volume int",
    )
    universe = spark.createDataFrame([(1, "A"), (2, "A"), (3, "S"), (4, "Z"), (5, None)], "cik int, ticker string")
    accounts = spark.createDataFrame([(1, D(2019, 1, 1), 5), (1, D(2020, 1, 1), 0), (1, D(2019, 6, 1), 7), (3, D(2019, 1, 1), 9)], "cik int, filed_at date, shares int")
    metrics = quality.universe_metrics(universe, bars, accounts, F.lit(D(2020, 1, 15)), least_price=5.0, least_cap=60.0, least_value=600.0)
    assert rows_of(metrics) == sorted([
        (1, "A", 10.0, 650.0, 7, 70.0, True), (2, "A", 10.0, 650.0, None, None, False), (3, "S", None, 50_000.0, 9, None, False), (4, "Z", None, None, None, None, False), (5, None, None, None, None, None, False)
    ], key=repr)
    assert tuple(quality.universe_summary(metrics, 70.0, 71.0).first()) == (5, 1, 4, 1, 0)
    left = quality.retained_bars(bars, F.lit(D(2020, 1, 9)), spark.createDataFrame([("S",)], "ticker string"))
    assert sorted((r["ticker"], r["trade_date"].day) for r in left.collect()) == [("A", 9), ("A", 10), ("A", 11), ("S", 1)]


def test_adjusted_returns_over_gaps(spark):
    from tidegauge.operators import event_study as es

    bars = spark.createDataFrame([("A", D(2020, 1, 1), 10.0, 0.5), ("A", D(2020, 1, 2), 6.0, None), ("A", D(2020, 1, 3), None, 1.0), ("A", D(2020, 1, 6), 9.0, 1.0), ("A", D(2020, 1, 7), 18.0, 0.5)], "ticker string, trade_date date, close double, adj_factor double")
    assert [(r["trade_date"].day, round(r["ret"], 9)) for r in es.simple_returns(bars, "adj_factor").collect()] == [(2, 0.2), (7, 0.0)]


def test_alerts_ranking_history_and_recommendation(spark):
    trades = spark.createDataFrame([("a", k, D(2020, 1, k), p) for k, p in enumerate([1.0, -1.0, -2.0, 3.0], 1)] + [("b", 9, D(2020, 1, 1), 1.0), ("b", 10, D(2020, 1, 2), -1.0)], "side string, event_id int, exit_date date, pnl_pct double")
    predicted = spark.createDataFrame([("a", 1, 2.0, 2.25), ("a", 2, 0.5, 0.5), ("a", 3, -3.0, 3.0), ("b", 9, 1.0, None), ("b", 10, 4.0, 3.0)], "side string, event_id int, predicted double, actual double")
    assert rows_of(ops.alerts(trades, predicted, "side")) == sorted([("a", "losses", None, 2.0), ("a", "hit", 1, 0.25)], key=repr)
    ranks = rows_of(ops.error_ranking(predicted, "side", 2))
    assert ranks == sorted([("a", "best", 1, 2, 0.0), ("a", "best", 2, 1, 0.25), ("a", "worst", 1, 3, 6.0), ("a", "worst", 2, 1, 0.25), ("b", "best", 1, 10, 1.0), ("b", "worst", 1, 10, 1.0)], key=repr)
    more = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("c", 1.0)], "side string, pnl_pct double")
    history = {r["side"]: r["matches"] for r in ops.against_history(trades, more, "side").collect()}
    assert history == {"a": False, "b": None, "c": None}
    reports = spark.createDataFrame([("x", 30, 2.0, 0.1, 0.9, 0), ("y", 30, 2.0, 0.3, None, 0), ("z", 5, 9.0, 0.0, 1.0, 0), ("w", 90, 9.0, 0.0, 1.0, 2)], "name string, n bigint, sharpe double, drawdown double, calibration double, peeked bigint")
    assert rows_of(ops.recommendation(reports, "name")) == sorted([
        ("x", "passes", True, True), ("y", "fails: drawdown 0.30, calibration unknown", False, True), ("z", "only 5 trades", False, True), ("w", "2 trades look ahead", False, True)
    ], key=repr)


def test_parts_of_both_legs_by_hand(spark):
    at = lambda k: D(2020, 1, k)
    closes = spark.createDataFrame(
        [(1, "A", 1, 10.0, at(2), at(3), 0.5, 12.0), (1, "A", 1, 10.0, at(2), at(6), 0.5, 14.0), (2, "B", -1, 10.0, at(1), at(3), 1.0, 8.0)],
        "event_id int, ticker string, side int, entry double, entry_date date, close_date date, fraction double, price double",
    )
    hedge = spark.createDataFrame([(at(2), 100.0, 101.0), (at(3), 100.0, 110.0), (at(5), 100.0, 120.0)], "trade_date date, open double, close double")
    found = {r["event_id"]: r for r in ops.consolidated(closes, hedge, 0.3).collect()}
    assert found[1]["exit"] == 13.0 and found[1]["hedge_exit"] == 115.0 and found[1]["exit_date"] == at(6) and found[1]["parts"] == 2
    assert found[1]["pnl_pct"] == pytest.approx(30 - 15 - 0.6)
    assert found[2]["hedge_exit"] is None and found[2]["pnl_pct"] == pytest.approx(20 - 0.3)  # no hedge opened on the first
    bars = spark.createDataFrame([("A", at(4), 13.0), ("B", at(2), 9.0)], "ticker string, trade_date date, close double")
    value = {r["event_id"]: (r["open_share"], round(r["value"], 6)) for r in ops.marked_to_market(closes, bars, hedge, F.lit(at(4)), 100.0).collect()}
    # half closed at 12 against the hedge at 110, half at 13 against 110; the other trade is closed at 8
    assert value == {1: (0.5, round(50 * (1 + 0.2 - 0.1) + 50 * (1 + 0.3 - 0.1), 6)), 2: (0.0, 120.0)}


def test_impact_estimates_shrink_towards_a_given_prior(spark):
    rows = [(k, "a", f"t{k}", D(2020, 1, 1) + dt.timedelta(days=30 * k), 20, 10.0, 1.0) for k in range(6)]
    car = spark.createDataFrame(rows, "event_id int, event_class string, ticker string, d0 date, window_days int, car_pct double, vol_ratio double")
    priors = spark.createDataFrame([("a", -5.0)], "event_class string, prior double")
    found = {r["event_id"]: r["magnitude"] for r in ops.impact_estimates(car, priors=priors).collect()}
    assert found[0] == -5.0 and found[5] == pytest.approx(5 / 20 * 10 + 15 / 20 * -5)
    assert {r["event_id"]: r["magnitude"] for r in ops.impact_estimates(car).collect()}[5] == 10.0


def test_conclusions_in_words(spark):
    from tidegauge.operators import event_study as es

    rows = [(2, 1.0, 2, 0.5, 1.0), (9, 0.0, 3, None, 0.0), (9, 1.0, 1, None, 1.0), (9, 1.0, 3, None, 1.0), (9, 1.0, 3, 0.01, 1.0), (9, 1.0, 3, 0.2, 0.933)]
    df = spark.createDataFrame(rows, "n bigint, s double, k int, p double, m double")
    assert [r[0] for r in df.select(es.conclusion(*(F.col(c) for c in "nskpm"))).collect()] == [
        "n=2: too few events", "n=9: all returns are equal, no test", "n=9: one month only, no clustered test", "n=9: no spread between months, no clustered test",
        "significant (p=0.0100)", "not significant (p=0.2000): an effect under 0.93 points would not show",
    ]


def test_schedules_are_read_once_a_part(spark):
    """The texts of a field are not read again for each value that it may admit."""
    m = cron.masks(F.col("cron"))
    rows = spark.createDataFrame([("*/7 2-30/9 0/4 13 *",), ("0-59 * 1,40 */5 6-7",)], "cron string").select(*[x.alias(n) for n, x in m.items()])
    want = [[sum(1 << v for v in range(0, 60, 7)), 1 << 2 | 1 << 11 | 1 << 20, sum(1 << v for v in range(4, 32, 4)), 0, 127], [(1 << 60) - 1, (1 << 24) - 1, 2, 1 << 1 | 1 << 6 | 1 << 11, 64]]
    assert [list(r) for r in rows.collect()] == want
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 2 * len(m)


def test_trades_of_a_group_are_not_gathered_for_its_median(spark):
    """STA-20: trades take their group's median where they are; a shuffle by the group would put each group in one task."""
    at = lambda k: D(2020, 1, k)
    bars = spark.createDataFrame([("A", at(k), 10.0 + k, 10.5 + k) for k in (2, 3, 6, 7, 8)], "ticker string, trade_date date, open double, close double")
    hedge = bars.drop("ticker")
    trades = spark.createDataFrame(
        [(k, "A", at(2), 1, at(3), 13.0, at(8), 18.5, 90.0, "x") for k in range(8)],
        "event_id int, ticker string, d0 date, side int, entry_date date, entry double, exit_date date, exit double, confidence double, kind string",
    )
    both = scenarios.two_legged(trades, hedge, F.lit(True), 0.3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = scenarios.in_scenarios(both, bars, hedge, bars.select("ticker", "trade_date"), hedge.select("trade_date", "close"), ["kind"])
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.splitlines() if "Join [kind" in x and "LeftOuter" in x]
    assert len(joins) == 1 and "BroadcastHashJoin" in joins[0], joins
