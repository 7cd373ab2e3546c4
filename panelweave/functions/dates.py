"""Date expressions. Weeks start on Monday unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_utc(col) -> Column:
    """Text stamp with or without a zone to a UTC stamp without one."""
    stamp = F.try_to_timestamp(_col(col).cast("string"))
    return F.to_timestamp_ntz(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def week_start(col) -> Column:
    """Monday on or before the stamp."""
    return F.to_date(F.date_trunc("week", _col(col)))


def week_label(col, weekday="MON") -> Column:
    """Closing day of the seven-day week that ends on ``weekday``."""
    shift = _DAYS.index(weekday) + 1
    return F.date_add(week_start(F.date_sub(_col(col), shift)), shift + 6)


def biweek_index(week, first_week) -> Column:
    """Number of the two-week bin: the first observed week stands alone, then
    weeks go in pairs."""
    weeks = F.floor(F.datediff(_col(week), _col(first_week)) / 7)
    return F.floor((weeks + 1) / 2)


def month_of(col) -> Column:
    return F.month(_col(col))


def month_distance(col, base=2) -> Column:
    """Calendar months since month ``base``."""
    return F.month(_col(col)) - base


def event_distance(col, event) -> Column:
    """Days from the event date to the date."""
    event = F.lit(event).cast("date") if isinstance(event, str) else event
    return F.datediff(_col(col), event)


def distance_label(distance, unit="days") -> Column:
    """Text form of a distance, as in ``-7 days``."""
    return F.concat(_col(distance).cast("string"), F.lit(f" {unit}"))
