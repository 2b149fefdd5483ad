"""Upserts, updates and deletes as functions of tables, and groups with a representative."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``target`` with ``columns`` from the matching row of ``source``, kept where there is none or it is null.

    ``source`` has one row per key.
    """
    new = source.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = target.join(new, keys, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source, keys, "left_anti")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], greatest: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both; of one key the source's values, the larger of both for ``greatest``, the target's for ``keep``.

    One aggregate over the union: each key's rows are pre-merged before the shuffle.
    """
    values = [c for c in target.columns if c not in keys]
    tag = lambda df, n: df.select(*keys, F.struct(F.lit(n).alias("_from"), *values).alias("_r"))
    both = tag(target, 0).unionByName(tag(source.select(*target.columns), 1))
    merged = both.groupBy(*keys).agg(
        F.max_by("_r", "_r._from").alias("_new"),
        F.min_by("_r", "_r._from").alias("_old"),
        *[F.max(f"_r.{c}").alias(f"_max_{c}") for c in greatest],
    )
    pick = lambda c: F.col(f"_max_{c}") if c in greatest else F.col(f"_old.{c}" if c in keep else f"_new.{c}")
    return merged.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in target.columns])


def with_representative(df: DataFrame, group: Column, key: str) -> DataFrame:
    """``rep``: the smallest key of the row's group; a row without a group stands for itself."""
    marked = df.withColumn("_g", group)
    reps = marked.where("_g is not null").groupBy("_g").agg(F.min(key).alias("_rep"))
    return marked.join(reps, "_g", "left").withColumn("rep", F.coalesce("_rep", key)).drop("_g", "_rep")
