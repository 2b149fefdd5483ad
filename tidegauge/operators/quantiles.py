"""Exact quantiles of large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins that a group's distinct values are dealt to.
BINS = 16


def value_counts(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by``, ``_v`` and ``_k``: how often each value occurs; nulls do not count."""
    v = F.col(value)
    return df.where(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_k"))


def exact_quantiles(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    return quantiles_of(value_counts(df, value, by), by, shares)


def quantiles_of(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``by`` with one column for each of ``shares`` (name to probability), interpolated linearly, from ``value_counts``.

    Spark's own exact percentile keeps all values of a group in one task. Here equal
    values are counted first, a bounded sketch cuts each group into bins, bin counts (a few rows
    per group) say which bins hold the ranks asked for, and only those bins are sorted.
    """
    steps = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = counts.groupBy(*by).agg(F.percentile_approx("_v", steps, F.lit(1_000)).alias("_cuts"))
    binned = counts.join(cuts, by).withColumn("_bin", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    order = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy(*by, "_bin").agg(F.sum("_k").alias("_nb")).withColumns({
        "_before": F.sum("_nb").over(order) - F.col("_nb"), "_n": F.sum("_nb").over(Window.partitionBy(*by)),
    })
    at = {name: (F.col("_n") - 1) * p for name, p in shares.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in at.values()])))
    held = bins.where(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_nb"))))
    inside = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = binned.join(held, [*by, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_k").over(inside))
    value_at = lambda r: F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_k")), F.col("_v")))
    found = placed.groupBy(*by).agg(
        F.first("_n").alias("_n"), *[value_at(F.floor(h)).alias(f"_lo_{n}") for n, h in at.items()], *[value_at(F.ceil(h)).alias(f"_hi_{n}") for n, h in at.items()]
    )
    between = lambda n, h: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (h - F.floor(h))
    return found.select(*by, *[between(n, h).alias(n) for n, h in at.items()])
