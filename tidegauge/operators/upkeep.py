"""Upkeep of a stored table of abnormal returns: what has to go, be reset, be filled in or be added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import changes

KEYS = ["event_id", "window_days"]
#: Columns of the stored table beside its keys.
VALUES = ["car", "vol_ratio", "resid_std", "n_days", "computed_at", "checked_at"]
#: How far a recomputed value may be from the stored one, relative to it and as such.
RELATIVE, ABSOLUTE = 1e-6, 1e-9


def agrees(made: Column, stored: Column) -> Column:
    return F.abs(made - stored) <= ABSOLUTE + RELATIVE * F.abs(stored)


def changes_to(
    stored: DataFrame, events: DataFrame, computed: DataFrame, last_factor_day: DataFrame, fillable: DataFrame, reset_before: Column, now: Column
) -> DataFrame:
    """Change set of ``stored``: ``event_id, window_days, action`` and the new values of VALUES.

    * ``purge``: computed on or before the end of its window, or the window ends after the one row of ``last_factor_day(day)``.
      It goes, or is replaced (``renew``) if ``computed`` has it.
    * ``add``: ``computed(event_id, window_days, car, vol_ratio, resid_std, n_days)`` has a row that is not stored.
    * ``reset``: the volatility ratio of a row computed before ``reset_before`` becomes null.
    * ``fill``: a row without ``resid_std`` that was never checked, of an event in ``fillable(event_id)``, takes it if the
      return computed now agrees with the stored one; ``check`` marks it as tried if not.
    * ``reset+fill`` and ``reset+check``: both.

    Rows that need nothing are left out, so a change set of what a change set was applied to is empty. Rows of stored whose event
    is unknown need nothing. One full join by key, which is that of the stored table.
    """
    days = events.select("event_id", F.col("d0").alias("_d0"))
    held = stored.select(*KEYS, *[F.col(c).alias(f"_s_{c}") for c in VALUES], F.lit(True).alias("_stored")).join(days, "event_id", "left")
    made = computed.select(*KEYS, *[F.col(c).alias(f"_c_{c}") for c in VALUES[:4]], F.lit(True).alias("_made"))
    both = held.join(made, KEYS, "full").join(fillable.select("event_id", F.lit(True).alias("_fillable")).distinct(), "event_id", "left")
    both = both.crossJoin(F.broadcast(last_factor_day.select(F.col("day").alias("_last"))))  # one row
    s, c = (lambda n: F.col(f"_s_{n}")), (lambda n: F.col(f"_c_{n}"))
    end = F.date_add("_d0", F.col("window_days"))
    early = F.coalesce((s("computed_at") <= end) | (end > F.col("_last")), F.lit(False))
    stale = s("vol_ratio").isNotNull() & (s("computed_at") < reset_before)
    open_ = F.col("_fillable") & s("resid_std").isNull() & s("checked_at").isNull()
    same = F.coalesce(F.col("_made") & agrees(c("car"), s("car")), F.lit(False))
    fill = F.when(open_, F.when(same, "fill").otherwise("check"))
    action = (
        F.when(F.col("_stored").isNull(), "add")
        .when(early, F.when(F.col("_made"), "renew").otherwise("purge"))
        .when(stale | open_, F.concat_ws("+", F.when(stale, "reset"), fill))
    )
    fresh = F.col("action").isin("add", "renew")
    filled = F.col("action").endswith("fill")
    tried = filled | F.col("action").endswith("check")
    new = {
        "car": F.when(fresh, c("car")).otherwise(s("car")),
        "vol_ratio": F.when(fresh, c("vol_ratio")).when(~F.col("action").startswith("reset"), s("vol_ratio")),
        "resid_std": F.when(fresh | filled, c("resid_std")).otherwise(s("resid_std")),
        "n_days": F.when(fresh | filled, c("n_days")).otherwise(s("n_days")),
        "computed_at": F.when(fresh, now).otherwise(s("computed_at")),
        "checked_at": F.when(tried, now).when(~fresh, s("checked_at")),
    }
    some = both.withColumn("action", action).where("action is not null")
    return some.select(*KEYS, "action", *[v.alias(n) for n, v in new.items()])


def applied(stored: DataFrame, change_set: DataFrame) -> DataFrame:
    """``stored`` after the changes. Applying a change set twice gives the same table."""
    left = changes.delete_using(stored, change_set.where("action = 'purge'").select(*KEYS), KEYS)
    return changes.upsert(left, change_set.where("action <> 'purge'").select(*stored.columns), KEYS)
