"""Date columns: coercing parsers and the weekday calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.numeric import as_col


def parse_published(text: Column | str, default: Column) -> Column:
    """Epoch seconds or an ISO timestamp; anything else, or null, gives the default."""
    t = F.trim(as_col(text))
    epoch = F.timestamp_seconds(F.when(t.rlike("^[0-9]+$"), t).try_cast("double"))
    iso = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t))
    return F.coalesce(epoch, iso, default)


def coerce_timestamp(text: Column | str) -> Column:
    """A timestamp, or null where the text is not one."""
    t = F.trim(as_col(text))
    return F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t))


def is_weekday(day: Column) -> Column:
    return ~F.dayofweek(day).isin(1, 7)


def forecast_dates(last: Column | str, n: int) -> Column:
    """The last date followed by the next ``n`` weekdays."""
    start = as_col(last)
    following = F.sequence(F.date_add(start, 1), F.date_add(start, 7 * (n // 5 + 2)))
    return F.concat(F.array(start), F.slice(F.filter(following, is_weekday), 1, n))
