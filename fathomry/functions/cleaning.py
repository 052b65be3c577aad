"""Reading rules shared by every query over the check-in log and the blocking index.

All rules are Column expressions, so they stay inside whole-stage codegen and are pruned with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MS_PER_DAY = 86_400_000
#: A positive time stamp below this is in seconds.
SECONDS_BELOW = 100_000_000_000
BLANKS = " \t\n\r\f\x0b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without blanks, tabs and line ends on either side; null stays null."""
    return F.btrim(_col(c), F.lit(BLANKS))


def identifier(c: Column | str) -> Column:
    """Trimmed and lower-cased; null when nothing is left."""
    x = F.lower(stripped(c))
    return F.when(x != "", x)


def present(c: Column | str) -> Column:
    """The text as it is; null when it is empty."""
    return F.when(_col(c) != "", _col(c))


def event_ms(c: Column | str) -> Column:
    """Unix milliseconds. Null, zero and negative values are no time; small positive values are seconds."""
    t = _col(c)
    return F.when(t >= SECONDS_BELOW, t).when(t > 0, t * 1000)


def day_number(ms: Column | str) -> Column:
    """Days since 1970-01-01 (UTC) as int."""
    return F.floor(_col(ms) / F.lit(MS_PER_DAY)).cast("int")


def day_text(day: Column | str) -> Column:
    """A day number written YYYY-MM-DD."""
    return F.date_format(F.date_from_unix_date(_col(day)), "yyyy-MM-dd")


def checkins(raw: DataFrame) -> DataFrame:
    """Cleaned check-ins ``(event_id, account, visitor, ip, ms, day)`` of rows that have a time.

    Repeated deliveries are still there: each consumer folds them where it groups anyway, which saves a shuffle.
    The address stays raw (:func:`fathomry.functions.net.canonical_ip` makes it comparable).
    """
    ms = event_ms("ts")
    return raw.select(
        "event_id",
        present("account_id").alias("account"),
        identifier("visitor_id").alias("visitor"),
        "ip",
        ms.alias("ms"),
    ).where("ms is not null").withColumn("day", day_number("ms"))
