"""Schedules in five fields (minute, hour, day of month, month, day of week from Sunday 0), as column expressions.

A field is a list of ``*``, numbers and ranges, each of which may have a step (``*/15``, ``8-18/2``). A field becomes a bit mask;
times are matched by a bit of each mask, and the last due time is found in the masks, not minute by minute.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least and greatest value of each field.
FIELDS = {"minute": (0, 59), "hour": (0, 23), "dom": (1, 31), "month": (1, 12), "dow": (0, 6)}


def _number(text: Column) -> Column:
    return text.try_cast("int")


def field_mask(field: Column, low: int, high: int) -> Column:
    """Bit v is set if the field admits v. Parts that are no part of a schedule admit nothing; a null field is null."""

    def read(part: Column) -> Column:
        step = F.greatest(F.coalesce(_number(F.regexp_extract(part, r"/(\d+)$", 1)), F.lit(1)), F.lit(1)).cast("bigint")
        return F.struct(F.regexp_extract(part, r"^([^/]*)(?:/(\d+))?$", 1).alias("body"), step.alias("step"), part.contains("/").alias("stepped"))

    def bounds(x: Column) -> Column:
        body, ranged = x["body"], x["body"].contains("-")
        first = F.when(body == "*", low).otherwise(_number(F.substring_index(body, "-", 1)))
        end = _number(F.substring_index(F.substring_index(body, "-", 2), "-", -1))
        last = F.when(body == "*", high).when(ranged, end).when(x["stepped"], high).otherwise(first)
        return F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), x["step"].alias("step"))

    def values(x: Column) -> Column:
        """First and last value within low..high; the steps count from ``first``, also where that is below."""
        first = F.when(x["first"] < low, x["first"] + F.ceil((low - x["first"]) / x["step"]) * x["step"]).otherwise(x["first"])
        return F.struct(first.alias("first"), F.least(x["last"], F.when(x["last"].isNotNull(), F.lit(high))).alias("last"), x["step"].alias("step"))

    def part_mask(x: Column) -> Column:
        on = F.when(x["first"] <= x["last"], F.sequence(x["first"], x["last"], x["step"]))
        some = F.aggregate(on, F.lit(0).cast("bigint"), lambda m, v: m.bitwiseOR(_bit(v.cast("int"))))
        every = (x["first"] == low) & (x["last"] == high) & (x["step"] == 1)
        return F.when(every, sum(1 << v for v in range(low, high + 1))).otherwise(F.coalesce(some, F.lit(0).cast("bigint")))

    # the texts are read once a part, not once a value
    parts = F.transform(F.transform(F.transform(F.split(field, ","), read), bounds), values)
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(part_mask(x)))


def _bit(v: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), v)


def masks(cron: Column) -> dict[str, Column]:
    """The masks of a schedule's five fields; null if it does not have five."""
    parts = F.split(F.trim(cron), r"\s+")
    whole = F.when(F.size(parts) == 5, parts)
    return {name: field_mask(F.get(whole, F.lit(k)), *FIELDS[name]) for k, name in enumerate(FIELDS)}


def _has(mask: Column, v: Column) -> Column:
    return mask.bitwiseAND(_bit(v)) != 0


def _day_matches(m: dict[str, Column], day: Column) -> Column:
    return _has(m["dom"], F.dayofmonth(day)) & _has(m["month"], F.month(day)) & _has(m["dow"], F.dayofweek(day) - 1)


def matches(m: dict[str, Column], at: Column) -> Column:
    """Whether the minute of ``at`` is one of the schedule's; all fields have to match."""
    return _has(m["minute"], F.minute(at)) & _has(m["hour"], F.hour(at)) & _day_matches(m, F.to_date(at))


def _highest(mask: Column, most: Column | int) -> Column:
    """The highest value of a mask that is not above ``most``; null if there is none."""
    below = mask.bitwiseAND(_bit((F.lit(most) if isinstance(most, int) else most) + 1) - 1)
    return F.when(below != 0, F.length(F.bin(below)) - 1)


def last_due(m: dict[str, Column], now: Column, grace_minutes: int, most_hours: int) -> Column:
    """The last time of the schedule that was due: ``grace_minutes`` before ``now`` or earlier, but not more than ``most_hours`` before it.

    Of each day in that time only the fields of the day are looked at; on the last day that matches, the latest hour and minute
    come from the masks. If the limit's own day has none early enough, the day before it counts.
    """
    limit = F.date_trunc("minute", now - F.expr(f"INTERVAL '{grace_minutes}' MINUTE"))
    oldest = now - F.expr(f"INTERVAL '{most_hours}' HOUR")
    day = F.to_date(limit)
    hour, minute = F.hour(limit), F.minute(limit)
    # on the limit's day: the latest minute within its hour, else the latest minute of an hour before
    within = F.when(_has(m["hour"], hour), _highest(m["minute"], minute))
    before = _highest(m["hour"], hour - 1)
    last_minute = _highest(m["minute"], 59)
    today = F.when(_day_matches(m, day), F.when(within.isNotNull(), hour * 60 + within).otherwise(before * 60 + last_minute))
    days = F.sequence(F.to_date(oldest), F.date_sub(day, 1))
    earlier = F.when(F.to_date(oldest) < day, F.array_max(F.filter(days, lambda d: _day_matches(m, d))))
    full = _highest(m["hour"], 23) * 60 + last_minute
    at = lambda d, minutes: d.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    found = F.when(today.isNotNull(), at(day, today)).otherwise(at(earlier, full))
    return F.when(found >= oldest, found)
