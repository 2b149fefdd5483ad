"""Column functions of the decision and cost rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_investable(price: Column, cap: Column, traded: Column) -> Column:
    """Price of 5, capitalisation of 50 M and daily value of 1 M or more; any null is false."""
    return F.coalesce((price >= 5) & (cap >= 50_000_000) & (traded >= 1_000_000), F.lit(False))


def sample_side(day: Column, end_in: str, start_out: str) -> Column:
    """In or out of sample; null in the embargo between."""
    return F.when(day < F.lit(end_in).cast("date"), "in").when(day >= F.lit(start_out).cast("date"), "out")


def first_category(value: Column, rules: list[tuple[str, str, str]], default: str) -> Column:
    """The category of the first rule (``starts`` or ``has``, text, category) that holds."""
    test = {"starts": lambda t: value.startswith(t), "has": lambda t: value.contains(t)}
    out = reduce(lambda c, r: c.when(test[r[0]](r[1]), r[2]), rules, F.when(F.lit(False), default))
    return out.otherwise(default)


def stepped(value: Column, steps: list[tuple[float, float]], default: float) -> Column:
    """The result of the first step (least value, result) that the value reaches."""
    return reduce(lambda c, s: c.when(value >= s[0], s[1]), steps, F.when(F.lit(False), default)).otherwise(default)


def hedged_round_trip(slippage_bps: Column, fee_bps: float) -> Column:
    """Fees and slippage in and out, and the hedge's fees in and out."""
    return 2 * fee_bps + 2 * slippage_bps + 2 * fee_bps


def product(ratio: Column) -> Column:
    """Aggregate: product of positive ratios; 1 of none."""
    return F.coalesce(F.exp(F.sum(F.ln(ratio))), F.lit(1.0))


def scaled(value: Column, low: float, high: float) -> Column:
    """0 at ``low``, 100 at ``high``, clamped; ``high`` may be under ``low``; null stays null."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (value - low) / (high - low) * 100))
    return F.when(value.isNotNull(), clamped)


def weighted_over_known(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are not null, weights scaled up over these; null if none is."""
    top = reduce(lambda a, b: a + b, [F.coalesce(c * w, F.lit(0.0)) for c, w in parts])
    weights = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts])
    return F.try_divide(top, F.nullif(weights, F.lit(0.0)))


def novelty(drift_pct: Column, guidance: Column, rumour: Column) -> Column:
    """High for little drift before the event and neither guidance nor rumour."""
    moved = scaled(F.abs(drift_pct), 8, 0)
    told = F.when(guidance, 20.0).when(~guidance, 100.0)
    heard = F.when(rumour, 10.0).when(~rumour, 100.0)
    return weighted_over_known([(moved, 0.5), (told, 0.25), (heard, 0.25)])


#: Fixed values by style: factor of the expected value, cap of a position in percent.
STYLES = {"conservative": (0.5, 3.0), "balanced": (1.0, 5.0), "aggressive": (1.8, 8.0)}


def expected_value(conviction: Column, magnitude: Column, confidence: Column, impact: Column, style: str) -> Column:
    return conviction * F.abs(magnitude) / 100 * confidence / 100 * impact / 100 * STYLES[style][0]


def position_size(ev: Column, confidence: Column, style: str) -> Column:
    """Percent of equity, capped by the style."""
    return F.least(F.abs(ev) * 100 * 5 * confidence / 100, F.lit(STYLES[style][1]))


def quality_parts(
    net_income: Column, equity: Column, debt: Column, cash_flow: Column, capex: Column, revenues: Column, price: Column, shares: Column
) -> dict[str, tuple[Column, float]]:
    """Score (0 to 100, null where it cannot be told) and weight of each part of a company's quality.

    Return on equity, debt to equity (no debt reported is none), free cash flow over profit, yearly growth over
    ``revenues`` - a struct of the number ``n`` of years with revenue, the ``first`` and the ``last`` - and price over profit.
    """
    own, profit = F.when(equity > 0, equity), F.when(net_income > 0, net_income)
    growth = F.when(revenues["n"] >= 3, F.pow(revenues["last"] / revenues["first"], 1.0 / (revenues["n"] - 1)) - 1)
    return {
        "profitability": (scaled(net_income / own, 0.05, 0.20), 0.25),
        "solidity": (scaled(F.coalesce(debt, F.lit(0.0)) / own, 1.5, 0.5), 0.20),
        "earnings": (scaled((cash_flow - capex) / profit, 0.4, 0.9), 0.20),
        "growth": (scaled(growth, -0.10, 0.10), 0.20),
        "price": (scaled(price * F.when(shares > 0, shares) / profit, 35, 12), 0.15),
    }


def quality_band(total: Column, known: Column) -> Column:
    """What a total from ``known`` parts says; fewer than three parts are incomplete whatever the total."""
    return (
        F.when(total.isNull(), "unknown").when(known < 3, "incomplete").when(total >= 75, "solid")
        .when(total >= 55, "decent").when(total >= 35, "troubled").otherwise("weak")
    )
