"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node in ``links(a, b)``.

    Each round hangs the larger neighbours of a node, then the smaller ones, on its
    smallest neighbour; the links shrink to stars in a logarithmic number of rounds.
    Links are written after every round, so that no plan or lineage grows. A node's
    smallest neighbour comes from an aggregate, which is pre-summed before the
    shuffle; no group of neighbours is gathered.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("n"), "m")
        large = (
            both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = large.join(low, F.col("a") == F.col("n"))
        small = (
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = written(small, "links")
        total = now.agg(
            F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))
        ).first()
        if total[0] == 0 or tuple(total) == state:
            break
        state = tuple(total)
    else:
        raise RuntimeError(f"the links did not settle in {most_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
