"""Confidence intervals of means and shares, plain and with errors that are shared within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_critical, wilson

#: Fewest values for an interval of a mean, fewest effective groups, and effective quarters to group by quarter.
LEAST_VALUES, LEAST_GROUPS, LEAST_QUARTERS = 20, 6, 8


def plain(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``n``, ``mean``, ``low`` and ``high`` (95 %, Student's t); no interval under LEAST_VALUES values."""
    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    margin = F.when(F.col("n") >= LEAST_VALUES, t_critical((F.col("n") - 1).cast("double")) * F.col("std") / F.sqrt("n"))
    held = sums.withColumn("margin", margin)
    return held.select(*by, "n", "mean", "std", (F.col("mean") - F.col("margin")).alias("low"), (F.col("mean") + F.col("margin")).alias("high"))


def grouped_sums(df: DataFrame, value: str, by: list[str], group: str, key: str) -> DataFrame:
    """``n``, ``mean``, ``hits``, ``g``, ``g_effective``, ``df``, ``var_iid`` and ``var_cluster`` of the mean.

    A row without a group is one of its own. The grouped variance is the jackknife
    that leaves a group out; it comes from sums per group, two levels of aggregates
    and one small join, so no group of rows is gathered.
    """
    v = F.col(value)
    own = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("k"), F.col(key).cast("string")))
    cells = df.where(v.isNotNull()).groupBy(*by, own.alias("_g")).agg(
        F.count("*").alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count_if(v > 0).alias("h")
    )
    total = cells.groupBy(*by).agg(
        F.sum("k").alias("n"), F.sum("s").alias("t"), F.sum("q").alias("q"), F.sum("h").alias("hits"), F.count("*").alias("g"),
        F.sum(F.col("k") * F.col("k")).alias("kk"),
    )
    without = F.try_divide(F.col("t") - F.col("s"), F.nullif(F.col("n") - F.col("k"), F.lit(0)))
    spread = cells.select(*by, "k", "s").join(total.select(*by, "n", "t"), by).groupBy(*by).agg(F.var_pop(without).alias("_v"))
    n, g = F.col("n").cast("double"), F.col("g")
    effective = n * n / F.col("kk")
    freedom = F.when(effective >= LEAST_GROUPS, F.floor(F.least(n - 1, (g - 1).cast("double"), F.greatest(F.lit(1.0), F.floor(effective - 1)))))
    var = F.when(n > 1, (F.col("q") - F.col("t") * F.col("t") / n) / (n - 1) / n).otherwise(0.0)
    return total.join(spread, by).select(
        *by, "n", (F.col("t") / n).alias("mean"), "hits", "g", effective.alias("g_effective"), freedom.cast("bigint").alias("df"),
        var.alias("var_iid"), F.when(g >= 2, (g - 1) * F.col("_v")).alias("var_cluster"),
    )


def grouped(df: DataFrame, value: str, by: list[str], group: str, key: str) -> DataFrame:
    """``grouped_sums`` with ``low`` and ``high`` of the mean, and ``share_low`` and ``share_high`` of the share of positive values."""
    sums = grouped_sums(df, value, by, group, key).withColumn("t", t_critical(F.col("df").cast("double")))
    margin = F.when(F.col("n") >= LEAST_VALUES, F.col("t") * F.sqrt(F.greatest("var_iid", "var_cluster")))
    p = F.col("hits") / F.col("n")
    var_i = p * (1 - p) / F.greatest(F.col("n") - 1, F.lit(1))
    hits = grouped_sums(df.withColumn("_hit", (F.col(value) > 0).cast("double")), "_hit", by, group, key).select(*by, F.col("var_cluster").alias("_hit_var"))
    both = sums.join(hits, by).withColumn("_effect", F.when(var_i > 0, F.greatest(F.lit(1.0), F.col("_hit_var") / var_i)).otherwise(1.0))
    low, high = wilson(F.col("hits") / F.col("_effect"), F.col("n") / F.col("_effect"), F.col("t"))
    known = lambda c: F.when(F.col("df").isNotNull(), c)
    return both.select(
        *[c for c in sums.columns if c != "t"], (F.col("mean") - margin).alias("low"), (F.col("mean") + margin).alias("high"),
        known(low).alias("share_low"), known(high).alias("share_high"),
    )


def block(df: DataFrame, value: str, by: list[str], day: str, key: str) -> DataFrame:
    """The intervals of ``grouped`` by quarter of ``day`` where a group has LEAST_QUARTERS effective quarters or more, else by month:
    ``unit``, ``g_effective``, ``df``, ``share_low``, ``share_high``, ``low``, ``high`` and ``apart`` (whether the mean's interval leaves out 0)."""

    def of(unit: str) -> DataFrame:
        found = grouped(df.withColumn("_unit", F.trunc(day, unit)), value, by, "_unit", key)
        names = ("g_effective", "df", "share_low", "share_high", "low", "high")
        return found.select(*by, F.struct(F.lit(unit).alias("unit"), *names).alias(unit))

    both = of("quarter").join(of("month"), by)
    chosen = F.when(F.col("quarter.g_effective") >= LEAST_QUARTERS, F.col("quarter")).otherwise(F.col("month"))
    out = both.select(*by, chosen.alias("_c")).select(*by, "_c.*")
    return out.withColumn("apart", (F.col("low") > 0) | (F.col("high") < 0))
