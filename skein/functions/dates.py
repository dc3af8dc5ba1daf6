"""Calendar days and schedules. The session time zone is taken to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats read besides ISO days and ISO instants; any other text is no date.
FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d", "M/d/yyyy", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss")


def day(text: Column) -> Column:
    """ISO day of a date text: ISO days pass, instants with a zone are read in UTC, others as written."""
    tidy = F.trim(text)
    iso = F.when(tidy.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(tidy, "yyyy-MM-dd"))
    instant = F.when(tidy.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), F.to_date(tidy.try_cast("timestamp")))
    return F.date_format(F.coalesce(iso, instant, *[F.try_to_date(tidy, f) for f in FORMATS]), "yyyy-MM-dd")


def first_instant(local: Column, zone: str) -> Column:
    """UTC instant of a wall time: inside a spring gap the first instant after it, in an autumn overlap the first.

    A wall time in a gap reads back shifted; the gap ends at the wall time of one hour before, moved on by the
    offset change, which is where the clock stood when it jumped.
    """
    straight = F.to_utc_timestamp(local, zone)
    shift = F.unix_seconds(F.from_utc_timestamp(straight, zone)) - F.unix_seconds(local)
    into_gap = F.when(shift != 0, F.minute(local) * 60 + F.second(local)).otherwise(F.lit(0))
    # before an autumn change the same wall time also exists one hour earlier
    earlier = straight - F.expr("INTERVAL 1 HOUR")
    overlaps = F.from_utc_timestamp(earlier, zone) == local
    return F.when(overlaps, earlier).when(shift != 0, F.timestamp_seconds(F.unix_seconds(straight) - into_gap)).otherwise(straight)


def next_run_at(after: Column, weekdays: list[int], hour: int, minute: int, zone: str) -> Column:
    """The next instant after ``after`` at the given wall time on one of the ISO weekdays (Monday is 1)."""
    today = F.to_date(F.from_utc_timestamp(after, zone))

    def on(day_number: Column) -> Column:
        date = F.date_add(today, day_number.cast("int"))
        wall = F.date_trunc("day", date.cast("timestamp")) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute), F.lit(0))
        wanted = (F.weekday(date) + 1).isin(weekdays)
        return F.when(wanted, first_instant(wall, zone))

    instants = F.transform(F.sequence(F.lit(0), F.lit(8)), on)
    return F.array_min(F.filter(instants, lambda t: t > after))


def month_bounds(month: str) -> tuple[Column, Column]:
    """First instants of a ``YYYY-MM`` month and of the next, UTC."""
    first = F.to_timestamp(F.lit(f"{month}-01"))
    return first, F.add_months(first, 1).cast("timestamp")


def shift_month(month: Column, by: int) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), by), "yyyy-MM")


def duration_label(seconds: Column) -> Column:
    """``12 s`` under a minute, ``5 min`` under an hour, then ``1 h 04 min``, each rounded."""
    s = F.greatest(F.floor(seconds.cast("double") + 0.5), F.lit(0)).cast("long")
    minutes = F.floor(s / 60.0 + 0.5).cast("long")
    hours = F.format_string("%d h %02d min", F.floor(minutes / 60).cast("long"), F.pmod(minutes, F.lit(60)))
    label = F.when(s < 60, F.format_string("%d s", s)).when(minutes < 60, F.format_string("%d min", minutes)).otherwise(hours)
    return F.when(seconds.isNotNull(), label)
