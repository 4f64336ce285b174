"""Calendar features and timestamp arithmetic (CAL1-CAL11).

All of it works on wall-clock time: ``TIMESTAMP_NTZ`` columns never touch the
session time zone, ``TIMESTAMP`` columns are read in it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
DAY_MICROS = 86_400_000_000
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds of wall-clock time since 1970."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), _col(ts).cast("timestamp_ntz"))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_add("MICROSECOND", _col(us), F.expr(EPOCH))


def time_of_day(ts: Column | str) -> Column:
    """CAL1: fraction of the day in [0, 1)."""
    return F.pmod(micros(ts), F.lit(DAY_MICROS)) / F.lit(float(DAY_MICROS))


def time_of_day_minutes(ts: Column | str) -> Column:
    """CAL1, whole minutes only."""
    ts = _col(ts)
    return (F.hour(ts) * 60 + F.minute(ts)) / F.lit(1440.0)


def time_of_day_index(t_idx: Column | str, steps_per_day: int) -> Column:
    """CAL2."""
    return F.pmod(_col(t_idx), F.lit(steps_per_day)) / F.lit(float(steps_per_day))


def day_of_week(ts: Column | str) -> Column:
    """CAL3: Monday is 0."""
    return F.weekday(_col(ts)) / F.lit(7.0)


def day_of_week_index(t_idx: Column | str, steps_per_day: int) -> Column:
    """CAL4."""
    return F.pmod(F.floor(_col(t_idx) / F.lit(steps_per_day)), F.lit(7)) / F.lit(7.0)


def day_of_month(ts: Column | str) -> Column:
    """CAL5."""
    return (F.dayofmonth(_col(ts)) - 1) / F.lit(31.0)


def day_of_year(ts: Column | str) -> Column:
    """CAL6."""
    return (F.dayofyear(_col(ts)) - 1) / F.lit(366.0)


def centred(feature: Column | str) -> Column:
    """CAL10: [0, 1) to [-0.5, 0.5)."""
    return _col(feature) - F.lit(0.5)


def parse_time(text: Column | str, fmt: str = TIME_FORMAT) -> Column:
    """CAL11: text to timestamp; unreadable text becomes NULL."""
    return F.try_to_timestamp(_col(text), F.lit(fmt)).cast("timestamp_ntz")


def format_time(ts: Column | str, fmt: str = TIME_FORMAT) -> Column:
    return F.date_format(_col(ts), fmt)


FEATURES = {
    "tod": time_of_day,
    "dow": day_of_week,
    "dom": day_of_month,
    "doy": day_of_year,
}
