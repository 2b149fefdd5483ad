"""Decision rules as column expressions: abstention, verdicts, execution styles and reviews of open positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

# Floors of the abstention rules, and thresholds of the expected value by style.
NOVELTY_FLOOR, CONFIDENCE_FLOOR, TRADED_FLOOR = 20, 40, 1_000_000
SPLIT_CONVICTION, SPLIT_CONFIDENCE = 0.15, 60.0
THRESHOLDS = {"conservative": 0.008, "balanced": 0.005, "aggressive": 0.002}


def objective_reason(novelty: Column, warned: Column, has_model: Column, unannounced: Column, traded: Column) -> Column:
    """Why there is no trade whatever the conviction: the first rule that holds; null if none does."""
    return (
        F.when(novelty < NOVELTY_FLOOR, "novelty")
        .when(warned, "warning")
        .when(~has_model, "contradictory")
        .when(unannounced, "unannounced")
        .when(traded.isNull() | (traded < TRADED_FLOOR), "illiquid")
    )


def abstention(
    ev: Column, conviction: Column, confidence: Column, threshold: Column, novelty: Column, warned: Column, has_model: Column,
    unannounced: Column, traded: Column,
) -> Column:
    """LONG, SHORT, or NO_TRADE with the first of the seven rules that holds, in their order."""
    split = (F.abs(conviction) < SPLIT_CONVICTION) & (confidence >= SPLIT_CONFIDENCE)
    reason = (
        F.when(novelty < NOVELTY_FLOOR, "novelty")
        .when(confidence < CONFIDENCE_FLOOR, "confidence")
        .when(F.abs(ev) < threshold, "ev")
        .when(warned, "warning")
        .when(~has_model | split, "contradictory")
        .when(unannounced, "unannounced")
        .when(traded.isNull() | (traded < TRADED_FLOOR), "illiquid")
    )
    side = F.when(conviction > 0, "LONG").otherwise("SHORT")
    return F.coalesce(F.concat(F.lit("NO_TRADE: "), reason), side)


def out_of_reach(best_by_style: dict[str, Column], margin: Column, thresholds: dict[str, float] = THRESHOLDS) -> Column:
    """True where not even full conviction and confidence lift the expected value over the threshold of any style."""
    reached = [F.abs(best_by_style[s]) >= thresholds[s] + margin for s in thresholds]
    return ~reduce(lambda a, b: a | b, reached)


def profit_tiers(step: float = 20.0, fraction: float = 0.30) -> tuple[tuple[float, float], ...]:
    """(gain in percent, share of the original position that is closed), until nothing is left."""
    out, left, at = [], 1.0, step
    while left > 1e-9:
        out.append((at, min(fraction, left)))
        left -= fraction
        at += step
    return tuple(out)


# The two execution styles.
STYLES = {
    "conservative": {"min": 2.0, "max": 5.0, "days": 5, "take": 2.0, "stop": 1.5, "confidence": 70.0, "slots": 3},
    "aggressive": {"min": 10.0, "max": 20.0, "days": 20, "take": None, "stop": 5.0, "confidence": 50.0, "slots": 2},
}


def execution_style(confidence: Column, ev: Column, threshold: float) -> Column:
    """Conservative where both the confidence and the size of the expected value reach that style's thresholds."""
    high = (confidence >= STYLES["conservative"]["confidence"]) & (F.abs(ev) >= threshold)
    return F.when(high, "conservative").otherwise("aggressive")


def interpolated_size(confidence: Column, style: str) -> Column:
    """Percent of equity: the style's least at its confidence threshold, its most at 100."""
    s = STYLES[style]
    share = (confidence - s["confidence"]) / (100 - s["confidence"])
    return s["min"] + F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (s["max"] - s["min"])


def verdict(win_rate: Column, sharpe: Column, calibration: Column, drawdown: Column, n: Column, forward: Column, peeked: Column) -> Column:
    """A, B or C from the metrics of a strategy; unknown metrics never count as passed.

    C on any look-ahead or under 20 trades; A if all marks are passed; C if one is
    clearly failed; else B.
    """
    known = lambda c: F.coalesce(c, F.lit(False))
    passed = (win_rate > 0.55) & (sharpe > 1.0) & (calibration > 0.6) & (drawdown < 0.15) & (n > 300) & forward
    failed = known(sharpe < 0.7) | known(win_rate < 0.5) | known(calibration < 0.4)
    return F.when((peeked > 0) | (n < 20), "C").when(known(passed), "A").when(failed, "C").otherwise("B")


def review(
    side: Column, realised: Column, expected: Column, saturation: Column, volume_ratio: Column, invalid_class: Column, price: Column,
    below: Column, above: Column, conviction: Column, confidence: Column,
) -> Column:
    """What a new event does to an open position: the first that holds of fulfilled, saturated, invalid by class,
    invalid by price, strong contradiction (all sell), weak contradiction (halve), else hold."""
    known = lambda c: F.coalesce(c, F.lit(False))
    against = side * conviction < 0
    return (
        F.when(known((expected > 0) & (realised >= expected)), "SELL: fulfilled")
        .when(known((realised > 0) & (realised >= saturation)) | known(volume_ratio >= 3.0), "SELL: saturated")
        .when(known(invalid_class), "SELL: event class")
        .when(known(price <= below) | known(price >= above), "SELL: price")
        .when(known(against & (confidence >= SPLIT_CONFIDENCE)), "SELL: contradiction")
        .when(known(against & (confidence >= CONFIDENCE_FLOOR)), "REDUCE")
        .otherwise("HOLD")
    )


def saturation_levels(moves: DataFrame, by: str, day: str, move: str, least: int = 5, multiple: float = 2.0) -> DataFrame:
    """``by``, ``saturation``: a multiple of the median size of the moves of a class; null under ``least`` of them."""
    sized = moves.select(by, F.abs(F.col(move)).alias("_size"))
    counted = sized.groupBy(by).agg(F.count("_size").alias("_n")).join(exact_quantiles(sized, "_size", [by], {"_middle": 0.5}), by, "left")
    return counted.select(by, F.when(F.col("_n") >= least, multiple * F.col("_middle")).alias("saturation"))


def later_moves(entered: DataFrame, bars: DataFrame, hedge: DataFrame, bars_ahead: int = 5) -> DataFrame:
    """``actual``: the move in percent from the entry's open to the close ``bars_ahead`` bars later in the trade's
    direction, less the hedge's over the same days; null where a price is missing.

    The later bar comes from a lead within the series, so a trade is joined to one row.
    ``hedge(trade_date, open, close)`` has a row per day.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("trade_date")
    ahead = bars.select(
        "ticker", F.col("trade_date").alias("entry_date"), F.lead("trade_date", bars_ahead).over(w).alias("later"), F.lead("close", bars_ahead).over(w).alias("later_close")
    )
    start = hedge.select(F.col("trade_date").alias("entry_date"), F.col("open").alias("hedge_open"))
    end = hedge.select(F.col("trade_date").alias("later"), F.col("close").alias("hedge_close"))
    joined = entered.join(ahead, ["ticker", "entry_date"], "left").join(start, "entry_date", "left").join(end, "later", "left")
    gain = lambda a, b: F.col("side") * (F.try_divide(F.col(b), F.col(a)) - 1) * 100
    return joined.withColumn("actual", gain("entry", "later_close") - gain("hedge_open", "hedge_close"))
