"""Factor-model abnormal returns and event-study statistics."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookback import sums_in_ranges
from .quantiles import exact_quantiles, quantiles_of, value_counts

X = ("mkt_rf", "smb", "hml")


def simple_returns(prices: DataFrame, factor: str | None = None) -> DataFrame:
    """``ret`` against the bar before, on closes times the column ``factor`` (null: 1) if one is named; null closes take
    part in the order and propagate, then go."""
    w = Window.partitionBy("ticker").orderBy("trade_date")
    if factor:
        prices = prices.withColumn("close", F.col("close") * F.coalesce(factor, F.lit(1.0)))
    ret = F.try_divide(F.col("close"), F.lag("close").over(w)) - 1
    return prices.select("ticker", "trade_date", ret.alias("ret")).where("ret is not null")


def _determinant(m: list[list[Column]]) -> Column:
    """Of a 3 x 3 matrix."""
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _products() -> dict[str, Column]:
    """The terms whose sums are the normal equations of the three-factor model, and the spread of returns."""
    y = F.col("ret") - F.col("rf")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return (
        {"y": y, "yy": y * y, "r": F.col("ret"), "rr": F.col("ret") * F.col("ret")}
        | {f"x{i}": F.col(x) for i, x in enumerate(X)}
        | {f"y{i}": F.col(x) * y for i, x in enumerate(X)}
        | {f"{i}{j}": F.col(X[i]) * F.col(X[j]) for i, j in pairs}
    )


def _solved(sums: DataFrame, least: int) -> DataFrame:
    """Adds ``n_est``, ``alpha``, the betas and ``resid_std`` from the sums ``est_*``; rows without a model go."""
    s = lambda name: F.col(f"est_{name}")
    n = s("n")
    cov = lambda i, j: s(f"{min(i, j)}{max(i, j)}") - s(f"x{i}") * s(f"x{j}") / n
    rhs = [s(f"y{i}") - s(f"x{i}") * s("y") / n for i in range(3)]
    matrix = [[cov(i, j) for j in range(3)] for i in range(3)]
    replaced = lambda k: [[rhs[i] if j == k else matrix[i][j] for j in range(3)] for i in range(3)]
    det = F.nullif(F.col("_det"), F.lit(0.0))
    # beyond the rounding of sums of squares, collinear factors have no determinant
    scale = matrix[0][0] * matrix[1][1] * matrix[2][2]
    solved = sums.where(n >= least).withColumn("_det", _determinant(matrix)).where(F.abs("_det") > 1e-12 * scale)
    solved = solved.withColumns({f"_b{k}": F.try_divide(_determinant(replaced(k)), det) for k in range(3)}).where("_b0 is not null")
    alpha = (s("y") - reduce(add, [F.col(f"_b{k}") * s(f"x{k}") for k in range(3)])) / n
    ssr = s("yy") - s("y") * s("y") / n - reduce(add, [F.col(f"_b{k}") * rhs[k] for k in range(3)])
    return solved.withColumns(
        {"n_est": n, "alpha": alpha, "resid_std": F.sqrt(F.greatest(ssr, F.lit(0.0)) / (n - 4))} | {f"beta_{x}": F.col(f"_b{k}") for k, x in enumerate(X)}
    )


def fitted_models(returns: DataFrame, factors: DataFrame, events: DataFrame, low: int = -250, high: int = -30, least: int = 60) -> DataFrame:
    """Three-factor OLS of ret - rf for each ``ticker`` and ``d0`` of events over the days ``low``..``high`` around d0.

    Differences of running sums per ticker give the centred normal equations, solved by Cramer's rule in columns; no
    bar is met more than once. Events of one ticker and day share their model. Fewer than ``least`` bars or
    collinear factors: no model.
    """
    sums = sums_in_ranges(events, returns.join(factors, "trade_date"), _products(), {"est": (low, high)})
    return _solved(sums, least).select("ticker", "d0", "n_est", "alpha", *[f"beta_{x}" for x in X], "resid_std")


def cumulative_abnormal_returns(
    returns: DataFrame,
    factors: DataFrame,
    events: DataFrame,
    windows: tuple[int, ...] = (5, 20),
    estimation: tuple[int, int] = (-250, -30),
    least: int = 60,
    baseline: tuple[int, int] = (-89, -30),
    least_baseline: int = 20,
) -> DataFrame:
    """``car`` of each event and window of calendar days after d0, with the checks that a window is complete.

    ``vol_ratio`` is the spread of returns in the window over that of the ``baseline`` days before d0; null if these
    have fewer than ``least_baseline`` bars or no spread.

    The series must reach the end of the window, and at least 80 % of its weekdays
    must have bars. CAR is linear in sums over the window, so it needs no residuals; the model's sums and those of the windows
    come from one stream of bars per ticker.
    """
    joined = returns.join(factors, "trade_date")
    reach = joined.groupBy("ticker").agg(F.max("trade_date").alias("last_bar"))
    sums = sums_in_ranges(events, joined, _products(), {"est": estimation, "base": baseline} | {f"w{w}": (1, w) for w in windows})
    models = _solved(sums, least)

    def spread_of(part: str) -> Column:
        n, r, rr = (F.col(f"{part}_{c}") for c in ("n", "r", "rr"))
        return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), rr - r * r / n) / (n - 1)))

    usual = F.when(F.col("base_n") >= least_baseline, F.nullif(spread_of("base"), F.lit(0.0)))

    def window(w: int) -> Column:
        s = lambda name: F.col(f"w{w}_{name}")
        n = s("n")
        expected = n * F.col("alpha") + reduce(add, [F.col(f"beta_{x}") * s(f"x{i}") for i, x in enumerate(X)])
        spread = spread_of(f"w{w}")
        return F.struct(
            F.lit(w).alias("window_days"), n.alias("n_days"), (s("y") - expected).alias("car"), spread.alias("event_std"),
            F.try_divide(spread, usual).alias("vol_ratio"),
        )

    end = F.date_add("d0", F.col("window_days"))
    weekdays = F.size(F.filter(F.sequence(F.date_add("d0", 1), end), lambda d: F.weekday(d) < 5))
    complete = (F.col("last_bar") >= end) & (F.col("n_days") >= F.greatest(F.lit(1), F.ceil(0.8 * weekdays)))
    each = models.select("ticker", "d0", "n_est", "resid_std", F.explode(F.array(*map(window, windows))).alias("w"))
    returned = (
        each.select("ticker", "d0", "n_est", "resid_std", "w.*")
        .join(reach, "ticker")
        .where(complete)
        .select("ticker", "d0", "window_days", "n_days", "n_est", "car", "resid_std", "event_std", "vol_ratio")
    )
    return events.select("event_id", "ticker", "event_class", "d0").join(returned, ["ticker", "d0"])


def first_per_event_day(car: DataFrame) -> DataFrame:
    """Events of one class, ticker and day count once: the smallest id; one aggregate."""
    keys = ["event_class", "ticker", "d0", "window_days"]
    rest = [c for c in car.columns if c not in keys and c != "event_id"]
    best = car.groupBy(*keys).agg(F.min(F.struct("event_id", *rest)).alias("_r"))
    return best.select(*keys, "_r.*").select(*car.columns)


def class_statistics(car: DataFrame, by: tuple[str, ...] = ("event_class",)) -> DataFrame:
    """Mean, quartiles, spread, t and minimal detectable effect of ``car_pct`` per class; null under three events."""
    enough = lambda c: F.when(F.col("n") >= 3, c)
    counts = value_counts(car, "car_pct", list(by))  # the one shuffle that everything here starts from
    moments = counts.groupBy(*by).agg(
        F.sum("_k").alias("n"), F.sum(F.col("_v") * F.col("_k")).alias("t"), F.sum(F.col("_v") * F.col("_v") * F.col("_k")).alias("q")
    )
    mean = F.col("t") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("t") * mean, F.nullif(F.col("n") - 1, F.lit(0)))))
    quartiles = quantiles_of(counts, list(by), {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    sums = moments.withColumns({"m": mean, "s": F.when(F.col("n") > 1, spread)}).join(quartiles, list(by), "left")
    t = F.try_divide(F.col("m"), F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0)))
    return sums.select(
        *by,
        "n",
        enough(F.col("m")).alias("mean"),
        enough(F.col("q25")).alias("p25"),
        enough(F.col("q50")).alias("median"),
        enough(F.col("q75")).alias("p75"),
        enough(F.col("s")).alias("std"),
        enough(t).alias("t_stat"),
        enough(2.8 * F.col("s") / F.sqrt("n")).alias("mde"),
    )


def winsorised(df: DataFrame, value: str, by: list[str], low: float = 0.01, high: float = 0.99, least: int = 100) -> DataFrame:
    """``value`` clamped to its percentiles within groups of ``least`` rows or more."""
    counted = df.groupBy(*by).agg(F.count(value).alias("_n"))
    bounds = counted.join(exact_quantiles(df, value, by, {"_low": low, "_high": high}), by, "left")
    clamp = F.greatest(F.col("_low"), F.least(F.col("_high"), F.col(value)))
    return df.join(bounds, by).withColumn(value, F.when(F.col("_n") >= least, clamp).otherwise(F.col(value))).drop("_n", "_low", "_high")


def clustered_t(df: DataFrame, value: str, by: list[str], cluster: str) -> DataFrame:
    """t of the mean with errors clustered; two levels of sums, no group is gathered."""
    cells = df.groupBy(*by, cluster).agg(F.count("*").alias("k"), F.sum(value).alias("sx"))
    total = cells.groupBy(*by).agg(
        F.sum("k").alias("n"),
        F.count("*").alias("g"),
        F.sum("sx").alias("t"),
        F.sum(F.col("sx") * F.col("sx")).alias("a"),
        F.sum(F.col("sx") * F.col("k")).alias("b"),
        F.sum(F.col("k") * F.col("k")).alias("c"),
    )
    mean = F.col("t") / F.col("n")
    spread = F.col("a") - 2 * mean * F.col("b") + mean * mean * F.col("c")
    var = F.try_divide(F.col("g").cast("double"), F.nullif(F.col("g") - 1, F.lit(0))) * spread / (F.col("n") * F.col("n"))
    ok = (F.col("n") >= 3) & (F.col("g") >= 2) & (var > 0)
    return total.select(
        *by, "n", F.col("g").alias("n_clusters"), mean.alias("mean"), F.when(ok, mean / F.sqrt(var)).alias("t_cluster"),
        F.when(ok, F.col("g") - 1).alias("df"),
    )


def benjamini_hochberg(df: DataFrame, p: str, key: str, level: float = 0.05) -> DataFrame:
    """``p_adjusted`` and ``rejected`` over all rows with a p-value; a row per class, so one window holds them."""
    known = df.where(F.col(p).isNotNull())
    ordered = Window.orderBy(p, key)
    ranked = known.withColumn("_rank", F.row_number().over(ordered)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    upward = Window.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(upward))
    return ranked.withColumn("p_adjusted", adjusted).withColumn("rejected", F.col("p_adjusted") <= level).drop("_rank", "_m")


def conclusion(n: Column, spread: Column, clusters: Column, p: Column, mde: Column, alpha: float = 0.05) -> Column:
    """What a class's test says, in words: first why there is none, then whether the mean differs from 0, and if it does not, from which
    size on an effect would have shown."""
    known = lambda c: F.coalesce(c, F.lit(False))
    count = F.format_string("n=%d", n)
    return (
        F.when(n < 3, F.concat(count, F.lit(": too few events")))
        .when(known(spread == 0), F.concat(count, F.lit(": all returns are equal, no test")))
        .when(known(clusters < 2), F.concat(count, F.lit(": one month only, no clustered test")))
        .when(p.isNull(), F.concat(count, F.lit(": no spread between months, no clustered test")))
        .when(p < alpha, F.format_string("significant (p=%.4f)", p))
        .otherwise(F.format_string("not significant (p=%.4f): an effect under %.2f points would not show", p, mde))
    )
