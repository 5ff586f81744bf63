"""Date functions; instants are UTC."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

#: Semesters of a course.
LAST_PERIOD = 8


def week_start(ts: Column) -> Column:
    """Monday of the week as yyyy-MM-dd."""
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def semester_index(date: Column) -> Column:
    """Semesters since year 0; the second half of a year begins in July."""
    return F.year(date) * 2 + F.when(F.month(date) >= 7, 1).otherwise(0)


def academic_period(start: Column, today: Column) -> Column:
    """Struct of status (not_started, in_progress, completed) and period (1 to 8 while in progress)."""
    n = semester_index(today) - semester_index(start) + 1
    status = F.when(n < 1, "not_started").when(n > LAST_PERIOD, "completed").otherwise("in_progress")
    return F.struct(status.alias("status"), F.when(n.between(1, LAST_PERIOD), n).alias("period"))


def period_label(start: Column, period: Column) -> Column:
    """Calendar semester of a period, as 2026.1 or 2026.2."""
    i = semester_index(start) + period - 1
    return F.concat(F.floor(i / 2).cast("string"), F.lit("."), (i % 2 + 1).cast("string"))


def within_days(a: Column, b: Column, days: float) -> Column:
    """Whether two instants are at most so many days apart."""
    return F.abs(F.unix_millis(a) - F.unix_millis(b)) <= int(days * 86_400_000)


def wall_clock(ts: Column, zone: str) -> Column:
    """Local date and time as yyyy-MM-dd HH:mm."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm")


def tolerant_timestamp(text: Column) -> Column:
    """Timestamp of an ISO string; null for what is none."""
    return F.try_to_timestamp(text)


def recency_window_days(now: Column, last_success: Column, recent: float, most: float) -> Column:
    """Days to look back: since the last success, within bounds; the upper bound where there was none."""
    gap = (F.unix_millis(now) - F.unix_millis(last_success)) / 86_400_000.0
    return F.when(gap.isNull(), F.lit(float(most))).otherwise(F.least(F.greatest(gap, F.lit(float(recent))), F.lit(float(most))))


def cron_every_hours(hours: int) -> str:
    """Cron line of a run every so many hours."""
    return f"0 */{hours} * * *"


def cron_daily(time: str) -> str:
    """Cron line of a daily run at HH:mm."""
    hour, minute = time.split(":")
    return f"{int(minute)} {int(hour)} * * *"


def rounded_millis(ts: Column) -> Column:
    """Milliseconds since 1970, the nearest (halves away from zero) as DuckDB's ``epoch_ms`` has them; ``unix_millis`` cuts."""
    return F.call_function("div", F.round(F.unix_micros(ts), -3), F.lit(1000))
