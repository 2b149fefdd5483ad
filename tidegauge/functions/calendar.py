"""Exchange calendar as column expressions: holidays, early closes, sessions and the event day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Closures that follow no rule (fixed values).
EXTRA_CLOSURES = ("2025-01-09",)


def _date(year: Column, month: Column | int, day: Column | int) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.make_date(year, as_col(month), as_col(day))


def easter_sunday(year: Column) -> Column:
    """Anonymous Gregorian computus."""
    div = lambda a, b: F.floor(a / b)
    golden, century, in_century = year % 19, div(year, 100), year % 100
    skipped = div(century + 8, 25)
    epact = (19 * golden + century - div(century, 4) - div(century - skipped + 1, 3) + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * div(in_century, 4) - epact - in_century % 4) % 7
    late = div(golden + 11 * epact + 22 * weekday, 451)
    place = epact + weekday - 7 * late + 114
    return _date(year, div(place, 31).cast("int"), (place % 31 + 1).cast("int"))


def nth_weekday(year: Column, month: int, weekday: int, nth: int) -> Column:
    """The nth ``weekday`` (Monday 0) of a month; -1 is the last."""
    if nth > 0:
        first = _date(year, month, 1)
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))
    last = F.last_day(_date(year, month, 1))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def observed(day: Column) -> Column:
    """Saturday holidays on Friday, Sunday ones on Monday."""
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def holidays_of(year: Column) -> Column:
    """Array of the weekday closures of a year. New Year's Day on a Saturday is not moved to the Friday before."""
    new_year = _date(year, 1, 1)
    days = [F.when(F.weekday(new_year) != 5, observed(new_year)), F.date_sub(easter_sunday(year), 2)]
    days += [nth_weekday(year, month, weekday, nth) for month, weekday, nth in ((1, 0, 3), (2, 0, 3), (5, 0, -1), (9, 0, 1), (11, 3, 4))]
    days += [F.when(year >= 2022, observed(_date(year, 6, 19))), observed(_date(year, 7, 4)), observed(_date(year, 12, 25))]
    return F.array_compact(F.array(*days))


def is_holiday(day: Column) -> Column:
    """For a few days; large tables join the calendar, where each holiday is worked out once."""
    return F.array_contains(holidays_of(F.year(day)), day) | day.isin(*[F.lit(d).cast("date") for d in EXTRA_CLOSURES])


def is_session(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~is_holiday(day)


def closes_early(day: Column) -> Column:
    """13:00: the day after Thanksgiving, and July 3 and December 24 from Monday to Thursday."""
    after = day == F.date_add(nth_weekday(F.year(day), 11, 3, 4), 1)
    month_day = F.date_format(day, "MM-dd")
    return is_session(day) & (after | (month_day.isin("07-03", "12-24") & (F.weekday(day) <= 3)))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """``day, is_session, closes_early, next_session`` of every day from ``start`` to ``end``.

    The next session is the day itself on a session; null after the last one. Rules
    are worked out per year, and days take them by joins.
    """
    years = spark.range(int(start[:4]), int(end[:4]) + 1).select(F.col("id").cast("int").alias("y"))
    extra = spark.createDataFrame([(d,) for d in EXTRA_CLOSURES], "day string").select(F.to_date("day").alias("day"))
    closed = years.select(F.explode(holidays_of(F.col("y"))).alias("day")).union(extra).distinct().withColumn("_closed", F.lit(True))
    short = years.select(F.date_add(nth_weekday(F.col("y"), 11, 3, 4), 1).alias("day"), F.lit(True).alias("_short"))
    days = spark.sql(f"SELECT explode(sequence(DATE'{start}', DATE'{end}')) AS day")
    joined = days.join(F.broadcast(closed), "day", "left").join(F.broadcast(short), "day", "left")
    session = (F.weekday("day") < 5) & F.col("_closed").isNull()
    eve = F.date_format("day", "MM-dd").isin("07-03", "12-24") & (F.weekday("day") <= 3)
    marked = joined.select("day", session.alias("is_session"), (session & (F.col("_short").isNotNull() | eve)).alias("closes_early"))
    ahead = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)  # a row per day
    return marked.withColumn("next_session", F.min(F.when(F.col("is_session"), F.col("day"))).over(ahead))


def assigned(df: DataFrame, local: str, name: str, days: DataFrame) -> DataFrame:
    """``df`` with ``name``: the session on which an event at the time ``local`` counts, by the calendar ``days``.

    That is the local day, or the next one if the hour is unknown (midnight) or at or
    after that day's close, rolled to a session. Null outside the calendar, which has a row per
    day and is broadcast.
    """
    early = days.select(F.col("day").alias("_day"), F.col("closes_early").alias("_early"))
    rolled = days.select(F.col("day").alias("_from"), F.col("next_session").alias(name))
    time = F.date_format(local, "HH:mm:ss")
    late = (F.date_format(local, "HH:mm:ss.SSSSSS") == "00:00:00.000000") | (time >= F.when(F.col("_early"), "13:00:00").otherwise("16:00:00"))
    dated = df.withColumn("_day", F.to_date(local)).join(F.broadcast(early), "_day", "left")
    dated = dated.withColumn("_from", F.when(late, F.date_add("_day", 1)).otherwise(F.col("_day")))
    return dated.join(F.broadcast(rolled), "_from", "left").drop("_day", "_early", "_from")


def hour_unknown(at: Column, created: Column, zone: str = "America/New_York") -> Column:
    """Midnight in ``zone``, or in UTC for rows made before times had a zone: the hour was not known."""
    midnight = lambda t: F.date_format(t, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
    old = created < F.lit("2026-09-26").cast("timestamp")
    return midnight(F.from_utc_timestamp(at, zone)) | (old & midnight(at))


def moment_text(local: Column) -> Column:
    """The day and when in it something was published, in words."""
    minutes = F.hour(local) * 60 + F.minute(local)
    unknown = F.date_format(local, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
    part = F.when(unknown, " (hour unknown)").when(minutes < 570, " before the open").when(minutes >= 960, " after the close")
    return F.concat(F.date_format(local, "yyyy-MM-dd"), part.otherwise(" during the session"))


def last_complete_week(day: Column) -> tuple[Column, Column]:
    """Monday and Friday of the last week that had ended; on a weekend that is the week just past."""
    friday = F.date_sub(day, (F.weekday(day) + 3) % 7)
    ended = F.when(F.weekday(day) == 4, F.date_sub(friday, F.lit(7))).otherwise(friday)
    return F.date_sub(ended, 4), ended


def month_floor(day: Column) -> Column:
    return F.trunc(day, "month")


def month_ceil(day: Column) -> Column:
    """The first of the next month, unless ``day`` is a first."""
    return F.when(F.dayofmonth(day) == 1, day).otherwise(F.date_add(F.last_day(day), 1))


def week_id(day: Column) -> Column:
    """Year and week by ISO 8601."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
