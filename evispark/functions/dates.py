"""Calendar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(date: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(date) - 1


def next_weekday(date: Column, day: Column | int) -> Column:
    """The first such weekday strictly after the date."""
    ahead = F.pmod(F.lit(day) - weekday(date) + 6, F.lit(7)) + 1
    return F.date_add(date, ahead.cast("int"))


def previous_weekday(date: Column, day: Column | int) -> Column:
    """The last such weekday strictly before the date."""
    back = F.pmod(weekday(date) - F.lit(day) + 6, F.lit(7)) + 1
    return F.date_sub(date, back.cast("int"))


def next_monthly(start: Column, after: Column) -> Column:
    """The first date strictly after ``after`` on start's day of the month; months without that day are skipped.

    Eight months ahead always hold one (no day is missing twice in a row beyond February).
    """
    months = F.sequence(F.lit(0), F.lit(8))
    first = F.trunc(after, "month")
    made = F.transform(months, lambda k: F.date_add(F.add_months(first, k.cast("int")), (F.dayofmonth(start) - 1).cast("int")))
    return F.array_min(F.filter(made, lambda d: (d > after) & (F.dayofmonth(d) == F.dayofmonth(start))))


def next_anniversary(birth: Column, today: Column) -> Column:
    """The next day (today included) of birth's day and month; 29 February waits for a leap year."""
    years = F.sequence(F.year(today), F.year(today) + 8)
    made = F.transform(years, lambda y: F.call_function("make_date", y, F.lit(1), F.lit(1)))
    on = F.transform(made, lambda d: F.date_add(F.add_months(d, (F.month(birth) - 1).cast("int")), (F.dayofmonth(birth) - 1).cast("int")))
    return F.array_min(F.filter(on, lambda d: (d >= today) & (F.dayofmonth(d) == F.dayofmonth(birth)) & (F.month(d) == F.month(birth))))


def cycle_phase(elapsed: Column, parts: list[tuple[str, int]]) -> Column:
    """The name of the part of a repeating cycle that the elapsed time falls in; parts are (name, length)."""
    whole = sum(length for _, length in parts)
    at, out, end = F.pmod(elapsed, F.lit(whole)), F.lit(parts[-1][0]), whole
    for name, length in reversed(parts):
        end -= length
        out = F.when(at < end + length, F.lit(name)).otherwise(out)
    return out


def next_occurrence(base: Column, repeat: Column, after: Column) -> Column:
    """The first date strictly after ``after`` of a repetition of ``base``, by day, week, month or year; days that a month or year lacks are skipped."""
    days = lambda n: F.date_add(after, (F.pmod(F.datediff(base, after) - 1, F.lit(n)) + 1).cast("int"))
    yearly = next_anniversary(base, F.date_add(after, 1))
    return F.when(repeat == "day", F.date_add(after, 1)).when(repeat == "week", days(7)).when(repeat == "month", next_monthly(base, after)).when(repeat == "year", yearly)


def cron_days(field: Column) -> Column:
    """The weekdays (0 Sunday to 6; 7 is Sunday too) of "*", "1-5" or "1,3"; null if it can't be read."""
    def days(part: Column) -> Column:
        low, high = F.substring(part, 1, 1).cast("int"), F.substring(part, -1, 1).cast("int")
        return F.when(part.rlike("^[0-7]-[0-7]$") & (low <= high), F.sequence(low, F.greatest(low, high))).when(part.rlike("^[0-7]$"), F.array(low))

    parts = F.transform(F.split(field, ","), days)
    every = F.array_distinct(F.transform(F.flatten(parts), lambda d: F.pmod(d, F.lit(7))))
    return F.when(field == "*", F.sequence(F.lit(0), F.lit(6))).when(~F.exists(parts, lambda p: p.isNull()), every)


def next_run(cron: Column, after: Column) -> Column:
    """The first time after ``after`` of a schedule "minute hour * * weekdays"; null for any other form."""
    parts = F.split(F.trim(cron), r"\s+")
    sound = (F.size(parts) == 5) & F.trim(cron).rlike(r"^([0-5]?\d)\s+([01]?\d|2[0-3])\s+\*\s+\*\s+\S+$")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)).try_cast("int"), F.lit(0))
    minutes = at(2) * 60 + at(1)
    days = cron_days(F.try_element_at(parts, F.lit(5)))
    first = F.date_trunc("day", after)
    made = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.timestamp_micros(F.unix_micros(first) + (k.cast("long") * 1440 + minutes) * 60_000_000))
    fits = F.filter(made, lambda t: (t > after) & F.array_contains(days, F.dayofweek(t) - 1))
    return F.when(sound & days.isNotNull(), F.array_min(fits))
