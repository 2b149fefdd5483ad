"""Indicators against plain loops, and plans on hand-made rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidegauge.operators import technical as t
from tidegauge.operators import windows


def walk(n: int = 320, seed: int = 7) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 50 * np.cumprod(1 + rng.normal(0, 0.02, n))
    return pd.DataFrame({"close": close, "high": close * (1 + rng.random(n) * 0.02), "low": close * (1 - rng.random(n) * 0.02), "volume": rng.integers(1, 1000, n).astype(float)})


def smoothed(values, alpha):
    out, now = [], None
    for x in values:
        if x == x:
            now = x if now is None else now + alpha * (x - now)
        out.append(now)
    return out


def computed(spark, b: pd.DataFrame) -> pd.DataFrame:
    b = b.copy()
    b["ticker"], b["trade_date"] = "A", [d.date() for d in pd.bdate_range("2021-01-04", periods=len(b))]
    return t.indicators(spark.createDataFrame(b)).toPandas().sort_values("trade_date", ignore_index=True)


def near(got, wanted):
    return np.allclose(np.asarray(got, float), np.asarray(wanted, float), atol=6e-5)


def test_smoothed_means_against_loops_over_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(100, 20, 9_000)
    b = pd.DataFrame({"ticker": "A", "trade_date": [d.date() for d in pd.date_range("2001-01-01", periods=len(x))], "x": x})
    b.loc[:4, "x"] = np.nan
    rows = spark.createDataFrame(b).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    asked = {"a": ("x", 1 / 14, 14), "b": ("x", 2 / 10, 9), "c": ("x", 2 / 51, 50), "d": ("x", 2 / 201, 200)}
    got = windows.smoothed(rows, asked).toPandas().sort_values("trade_date", ignore_index=True)
    for name, (_, alpha, least) in asked.items():
        wanted = smoothed(x[5:], alpha)
        assert got[name][: 5 + least - 1].isna().all() and np.allclose(got[name][5 + least - 1 :], wanted[least - 1 :], rtol=1e-10)


def test_rsi_and_range_against_loops(spark):
    b = walk()
    got = computed(spark, b)
    steps = [math.nan, *np.diff(b.close)]
    up = smoothed([max(x, 0) if x == x else x for x in steps], 1 / 14)
    down = smoothed([max(-x, 0) if x == x else x for x in steps], 1 / 14)
    wanted = [100 - 100 / (1 + u / d) for u, d in zip(up[14:], down[14:], strict=True)]
    assert near(got.rsi[14:], wanted) and got.rsi[:14].isna().all()
    ranges = [b.high[0] - b.low[0]] + [max(b.high[i] - b.low[i], abs(b.high[i] - b.close[i - 1]), abs(b.low[i] - b.close[i - 1])) for i in range(1, len(b))]
    assert near(got.atr[13:], smoothed(ranges, 1 / 14)[13:]) and got.atr[:13].isna().all()
    flat = pd.DataFrame({"close": [5.0] * 40, "high": [5.0] * 40, "low": [5.0] * 40, "volume": [1.0] * 40})
    assert computed(spark, flat).rsi.iloc[-1] == 50
    assert computed(spark, flat.assign(close=np.arange(40.0), high=np.arange(40.0), low=np.arange(40.0))).rsi.iloc[-1] == 100
    low, high = ([f([x for x in got.rsi[i - 13 : i + 1]]) for i in range(27, len(got))] for f in (min, max))
    assert np.allclose(got.stoch_rsi[27:], [(x - lo) / (hi - lo) for x, lo, hi in zip(got.rsi[27:], low, high, strict=True)], atol=1e-3)


def test_directional_against_loops(spark):
    b = walk(seed=3)
    plus, minus = [0.0], [0.0]
    for i in range(1, len(b)):
        up, down = b.high[i] - b.high[i - 1], b.low[i - 1] - b.low[i]
        plus.append(up if up > down and up > 0 else 0.0)
        minus.append(down if down > up and down > 0 else 0.0)
    ranges = [b.high[0] - b.low[0]] + [max(b.high[i] - b.low[i], abs(b.high[i] - b.close[i - 1]), abs(b.low[i] - b.close[i - 1])) for i in range(1, len(b))]
    tr = smoothed(ranges, 1 / 14)
    p, m = ([100 * a / r for a, r in zip(smoothed(x, 1 / 14), tr, strict=True)] for x in (plus, minus))
    got = computed(spark, b)
    assert near(got.plus_di[13:], p[13:]) and near(got.minus_di[13:], m[13:])
    dx = [math.nan] * 13 + [100 * abs(x - y) / (x + y) for x, y in zip(p[13:], m[13:], strict=True)]
    assert near(got.adx[26:], smoothed(dx, 1 / 14)[26:])


def test_means_bands_and_flows_against_loops(spark):
    b = walk(seed=5)
    got = computed(spark, b)
    fast, slow = smoothed(b.close, 2 / 13), smoothed(b.close, 2 / 27)
    macd = [f - s for f, s in zip(fast, slow, strict=True)]
    signal = [math.nan] * 25 + smoothed(macd[25:], 0.2)
    assert near(got.macd[25:], macd[25:]) and near(got.macd_signal[33:], signal[33:])
    for i in (40, 150, 319):
        c, v = b.close[i - 19 : i + 1], b.volume[i - 19 : i + 1]
        typical = (b.high + b.low + b.close)[i - 19 : i + 1] / 3
        assert near([got.bb_mid[i], got.bb_upper[i], got.vwap20[i]], [c.mean(), c.mean() + 2 * c.std(), (typical * v).sum() / v.sum()])
        assert near([got.volume_ratio[i], got.high_20[i], got.prev_low[i]], [b.volume[i] / b.volume[i - 20 : i].mean(), b.high[i - 20 : i].max(), b.low[i - 1]])
        flow = np.sign(np.diff(b.close[: i + 1], prepend=b.close[0])) * b.volume[: i + 1]
        assert near(got.obv_slope_20[i], np.polyfit(range(20), np.cumsum(flow)[-20:], 1)[0])
        widths = [4 * np.std(b.close[k - 19 : k + 1], ddof=1) / np.mean(b.close[k - 19 : k + 1]) for k in range(max(19, i - 119), i + 1)]
        assert near(got.bb_width_median_120[i], np.median(widths))
        if len(widths) == 120:
            assert got["squeeze"][i] == (min(widths[-10:]) <= np.quantile(widths, 0.2))
    gap = [None if math.isnan(x) or math.isnan(y) else x - y for x, y in zip(got.sma50, got.sma200, strict=True)]
    last = None
    for i in range(1, len(b)):
        if gap[i - 1] is not None and gap[i - 1] <= 0 < gap[i]:
            last = i
        assert (None if got.golden_ago.isna()[i] else got.golden_ago[i]) == (i - last if last is not None and i - last < 20 else None)


def test_divergence(spark):
    b = walk(n=200, seed=8)
    got = computed(spark, b)
    close, rsi = b.close.to_numpy(), got.rsi.to_numpy(float)
    for i in range(len(b)):
        c, r = close[max(i - 29, 0) : i + 1], rsi[max(i - 29, 0) : i + 1]
        want = None
        if len(c) == 30 and not np.isnan(r).any():
            lo1, lo2, hi1, hi2 = c[:15].argmin(), c[15:].argmin() + 15, c[:15].argmax(), c[15:].argmax() + 15
            if c[lo2] < c[lo1] and r[lo2] > r[lo1]:
                want = "bullish"
            elif c[hi2] > c[hi1] and r[hi2] < r[hi1]:
                want = "bearish"
        assert (got.rsi_divergence[i] or None) == want, i
    assert set(got.rsi_divergence.dropna()) >= {"bullish"} or set(got.rsi_divergence.dropna()) >= {"bearish"}


def test_volume_profile(spark):
    table = np.array([[10.0] * 5 + [22.0] * 2 + [34.0], [1.0] * 8, [5.0] * 4 + [np.nan] * 4])
    got = t.profiles(table, np.ones((3, 8)))
    assert (round(got[0, 0], 6), got[0, 1]) == (10.5, 10.0) and 22 <= got[0, 2] <= 23
    assert np.isnan(got[1:]).all()
    b = walk(n=120, seed=2)
    rows = computed(spark, b)
    typical, volume = (b.high + b.low + b.close).to_numpy() / 3, b.volume.to_numpy()
    assert rows.poc[:30].isna().all()
    for i in range(30, 120):  # by brute force
        x, v = typical[max(i - 60, 0) : i], volume[max(i - 60, 0) : i]
        held, edges = np.histogram(x, 24, weights=v)
        a = z = int(held.argmax())
        while held[a : z + 1].sum() < 0.7 * held.sum():
            up, down = held[z + 1] if z < 23 else -1, held[a - 1] if a else -1
            a, z = (a, z + 1) if up >= down else (a - 1, z)
        k = int(held.argmax())
        assert near([rows.poc[i], rows.value_low[i], rows.value_high[i]], [(edges[k] + edges[k + 1]) / 2, edges[a], edges[z + 1]])


def test_indicators_and_plans_of_a_frame(spark):
    b = walk()
    b["ticker"], b["trade_date"] = "A", [d.date() for d in pd.bdate_range("2021-01-04", periods=len(b))]
    bars = spark.createDataFrame(b)
    rows = t.indicators(bars)
    got = rows.toPandas().sort_values("trade_date", ignore_index=True)
    assert len(got) == len(b)
    last = got.iloc[-1]
    assert last.n_bars == len(b) and last.low_20 == round(b.low[-21:-1].min(), 4) and last.swing_high == round(b.high[-60:].max(), 4)
    assert math.isnan(got.ema200[198]) and got.ema200[199] > 0
    plans = t.trade_plans(rows.withColumns({"long": F.lit(True), "confirmed": F.lit(True), "vix": F.lit(40.0)})).toPandas().sort_values("trade_date", ignore_index=True)
    assert (plans.reason[:59] == "too few bars").all() and (plans.confidence[:59] == 40).all() and not plans.passes[:59].any()
    full = plans[60:]
    assert (full.stop < full.close).all() and (full.target > full.close).all()
    assert full.size_pct.between(0.5, 1.5).all() and full.days.between(3, 20).all()
    assert (~full.passes | ((full.risk_reward >= 2) & (full.n_votes >= 2))).all()
    assert t.indicators(bars.limit(0)).count() == 0


def test_plans_are_made_once_a_day_and_kind_for_all_events(spark, monkeypatch):
    """STA-19: the same rows as from a plan for each event, with a plan for each day, ticker, direction and confirmation."""
    from tidegauge.plans import technical as plans

    sf_dir = "/root/testdata/sf0.001"
    rows = plans._at_events(spark, sf_dir).withColumns({
        "long": F.col("event_class").isin("1-URGENT", "2-HIGH"), "confirmed": F.col("event_class") != "5-LOW", "vix": 20 + F.col("atr_pct") * 10,
    })
    each, given = t.trade_plans(rows).withColumn("entry", F.col("close")), []
    monkeypatch.setattr(plans.technical, "trade_plans", lambda at, f=t.trade_plans: given.append(at) or f(at))
    got = plans.sta_19(spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, each.select(*got.columns).collect()), key=str)
    kinds = given[0].select("ticker", "trade_date", "long", "confirmed")
    assert kinds.count() == kinds.distinct().count() < each.count()
